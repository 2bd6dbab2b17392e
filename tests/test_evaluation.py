import random
import statistics

import pytest
from pyspark.sql import functions as F

from plumbline.operators import metrics as M
from plumbline.operators import providers as P
from plumbline.operators import quality as Q
from plumbline.operators import resampling as R


def test_wilson(spark):
    df = spark.createDataFrame([(0, 0), (0, 31), (31, 31), (25, 34)], "k long, n long")
    got = [tuple(r["w"]) for r in df.select(M.wilson(F.col("k"), F.col("n")).alias("w")).collect()]
    assert got[0] == (0.0, 1.0) and got[1] == pytest.approx((0.0, 0.1103), abs=1e-3) and got[2] == pytest.approx((0.8897, 1.0), abs=1e-3) and got[3] == pytest.approx((0.569, 0.854), abs=1e-3)


def test_scores(spark):
    hits = spark.createDataFrame([("s", 1, 1, 10), ("s", 1, 2, 11), ("s", 2, 1, 10), ("s", 1, 3, 12)], "strategy string, query_id long, rank int, chunk_id long")
    gold = spark.createDataFrame([(1, 11), (1, 12), (1, 99), (2, 11), (1, 11)], "query_id long, chunk_id long")
    got = {r["query_id"]: (r["hit"], r["rr"], r["coverage"]) for r in M.score_questions(hits, gold).collect()}
    assert got[1] == pytest.approx((1.0, 0.5, 2 / 3)) and got[2] == (0.0, 0.0, 0.0)


def test_runs_of_a_question(spark):
    runs = {"a": [(True, False), (True, False), (False, True)], "b": [(True, False), (False, False)], "c": [(False, False)] * 3, "d": [(True, False)], "e": [(True, False)]}
    rows = [(k, n, "first" if n == 1 else "later", k != "c", k != "e" if n == 1 else False, *x) for k, v in runs.items() for n, x in enumerate(v, 1)]
    gen = spark.createDataFrame(rows[::-1], "id string, run int, type string, answerable boolean, gold_labelled boolean, refused boolean, gold_retrieved boolean")
    found = M.by_question(gen)
    q = {r["id"]: r for r in found.collect()}
    assert q["a"]["refused"] and q["a"]["unstable"] and q["a"]["gold_retrieved"]
    assert not q["b"]["refused"] and q["b"]["unstable"] and not q["c"]["unstable"]
    assert {r["type"] for r in q.values()} == {"first"} and q["a"]["gold_labelled"] and not q["e"]["gold_labelled"]
    # Only a refusal whose gold is labelled and wasn't found is justified.
    assert tuple(M.justified_refusals(found).first()) == (3, 1, 2)


def test_empty_rates(spark):
    empty = spark.createDataFrame([], "answerable boolean, refused boolean, supported int, unsupported int, judge_errors int")
    assert M.answer_rates(empty).first()["refusal"] == 0.0 and M.groundedness(empty).first()["groundedness"] == 0.0


def test_upper_median(spark):
    df = spark.createDataFrame([([1, 2, 3, 10],), ([5],), ([3, 1, 2],)], "v array<int>")
    assert [r["m"] for r in df.select(M.upper_median(F.col("v")).alias("m")).collect()] == [3, 5, 2]


def test_bootstraps(spark):
    values = [0.0, 1.0, 0.5, -0.25, 1.0, 0.0]
    rng = random.Random(0)
    means = sorted(sum(rng.choice(values) for _ in values) / 6 for _ in range(10_000))
    assert R.interval(values, "mean") == (means[250], means[9750])
    rng = random.Random(20260918)
    means = sorted(sum(values[rng.randrange(6)] for _ in values) / 6 for _ in range(10_000))
    assert R.interval(values, "paired") == (means[250], means[9749])
    rng = random.Random(20260908)
    means = sorted(statistics.fmean(rng.choices(values, k=6)) for _ in range(20_000))
    assert R.interval(values, "ordering") == (means[500], means[19500])
    assert R.interval([]) == (0.0, 1.0)
    df = spark.createDataFrame([("g", i, v) for i, v in enumerate(values)] + [("h", 0, None)], "g string, i int, v double")
    got = {r["g"]: (r["n"], r["low"], r["high"]) for r in R.bootstrap(df, "g", "i", "v").collect()}
    assert got["g"] == (6, *R.interval(values)) and got["h"] == (0, 0.0, 1.0)


KEYED = "doc_key string, chunk_index int, content string"


def test_relocation_by_probes(spark):
    sentence = lambda i: f"This is the long sentence number {i} of the filing, which is distinctive."
    old = [("d", i, " ".join(sentence(10 * i + j) for j in range(6))) for i in range(6)] + [("d", 6, "tiny")]
    new = [("d", i - 1 if i > 2 else i, t) for _, i, t in old if i not in (2, 5)]
    new = [("d", 7, " ".join(sentence(50 + j) for j in range(3))), ("d", 8, " ".join(sentence(53 + j) for j in range(3)))] + new
    got = {r["from"]: (r["to"], r["outcome"]) for r in Q.relocate_by_probes(spark.createDataFrame(old, KEYED), spark.createDataFrame(new, KEYED)).collect()}
    assert got[0] == (0, "found") and got[1] == (1, "found") and got[3] == (2, "found") and got[4] == (3, "found")
    assert got[2][1] == "lost" and got[5] == (None, "lost") and 6 not in got


def test_ties_go_to_what_did_not_rise(spark):
    text = "The same long boilerplate sentence stands in many places of the filing. " * 3
    old, new = [("d", 5, text)], [("d", i, text) for i in (1, 4, 6, 9)]
    r = Q.relocate_by_probes(spark.createDataFrame(old, KEYED), spark.createDataFrame(new, KEYED)).first()
    assert (r["to"], r["outcome"]) == (4, "found")


def test_extended_anchors(spark):
    chunks = [("d", 0, "net sales 2025 were 10 in the north"), ("d", 1, "net sales 2025 were 10 in the south"), ("d", 2, "other text 2025"), ("e", 0, "net sales 2025")]
    labels = [(1, "d", 1, "2025"), (2, "d", 2, "other"), (3, "d", 0, "absent"), (4, "d", 9, "2025")]
    got = {r["query_id"]: (r["anchor"], r["n"]) for r in Q.extend_anchors(spark.createDataFrame(labels, "query_id long, doc_key string, chunk_index int, contains string"), spark.createDataFrame(chunks, KEYED)).collect()}
    assert got[1][1] == 1 and "2025" in got[1][0] and "south" in got[1][0]
    assert got[2] == ("other", 1) and got[3] == ("absent", 0) and got[4] == ("2025", 0)


def test_providers(spark):
    prompts = spark.createDataFrame([(1, "a"), (2, "b")], "key int, message string")
    got = P.complete(prompts, lambda: P.provider("echo"), "system").collect()
    assert {r["reply"] for r in got} == {"INSUFFICIENT_CONTEXT"}
    assert [r["key"] for r in P.uncached(prompts, prompts.filter("key = 1")).collect()] == [2]
    with pytest.raises(ValueError):
        P.provider("vertex")
    with pytest.raises(ValueError):
        P.provider("echo", require="anthropic")
    tries, waits = [], []

    def call():
        tries.append(1)
        if len(tries) < 3:
            raise TimeoutError
        return "ok"

    assert P.with_retries(call, sleep=waits.append) == "ok" and len(waits) == 2 and 2 <= waits[0] < 3 and 4 <= waits[1] < 5
