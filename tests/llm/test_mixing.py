import pytest
from pyspark.sql import functions as F

from plumbline.llm import mixing
from plumbline.plans.check import differs

SF = "/root/testdata/sf0.001"


def plain_targets(sizes, weights=(1, 2, 3), cap=3):
    """Resharing by hand: cap whoever is above, share the excess, until none is."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(cap * sizes[s] for s in capped)
        open_ = [s for s in sizes if s not in capped]
        level = rest / sum(w[s] for s in open_) if open_ else 0
        over = {s for s in open_ if level * w[s] > cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] if s in capped else level * w[s] for s in sizes}
        capped |= over


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 10, "c": 1}, {"a": 5, "b": 5, None: 5}, {"a": 1000, "b": 1, "c": 1, "d": 1, None: 2}, {"x": 7}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(plain_targets(sizes))


def test_oracle(spark):
    assert not differs(mixing.op1_source_mix(spark, SF), mixing.OP1_SQL, SF)


def test_edges(spark):
    rows = [(1, "a b", "s", 9), (1, "a b", "s", 9), (2, None, "s", 9), (3, "", None, 9), (None, "x " * 5000, None, 9), (None, None, None, 9)] + [(i, f"w{i} " * 3, "t", 9) for i in range(10, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    out = mixing.mix(docs)
    assert out.columns[:4] == docs.columns  # a column of a clashing name stays
    got = out.withColumn("taken", F.col("mix_size") * F.col("mix_epochs")).collect()
    assert len(got) == len(rows)
    assert all(0 <= r["mix_epochs"] <= 3 for r in got)
    by = {}
    for r in got:
        by.setdefault(r["source"], [0, r["mix_target"], r["mix_source_size"], 0])
        by[r["source"]][0] += r["taken"]
        by[r["source"]][3] = max(by[r["source"]][3], r["mix_size"])
    assert sum(t for _, t, _, _ in by.values()) == pytest.approx(sum(n for _, _, n, _ in by.values()))
    for taken, target, _, largest in by.values():
        assert abs(taken - target) <= largest
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(map(tuple, mixing.mix(docs).collect()), key=repr)


def test_smaller_budget_is_subset(spark):
    docs = spark.createDataFrame([(i, f"w{i} " * (i % 7 + 1), "ab"[i % 2]) for i in range(500)], "doc_id long, text string, source string")
    few = {r["doc_id"]: r["mix_epochs"] for r in mixing.mix(docs, weights=(1, 1)).collect()}
    more = {r["doc_id"]: r["mix_epochs"] for r in mixing.mix(docs, weights=(1, 2)).collect()}
    assert all(few[i] >= more[i] for i in few if i % 2 == 0)
    assert all(few[i] <= more[i] for i in few if i % 2 == 1)


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
