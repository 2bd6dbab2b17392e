import random

import numpy as np
import pytest

from plumbline.llm import ngram_join as nj
from plumbline.plans.check import differs

SF = "/root/testdata/sf0.001"


def brute(rows):
    """component of each row's id by comparing all pairs."""
    sh = nj.Shingler()
    sets = [set(sh(t).tolist()) for _, t in rows]
    ids = [i for i, _ in rows]
    root = {i: i for i in ids if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if ids[a] is None or ids[b] is None or not sets[a] or not sets[b]:
                continue
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(ids[a]), find(ids[b])
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def near_copies(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    texts = [" ".join(word() for _ in range(rng.randint(0, 120))) for _ in range(120)]
    passage = " ".join(word() for _ in range(60))
    texts += [f"{' '.join(word() for _ in range(40))} {passage} {' '.join(word() for _ in range(rng.randint(0, 60)))}" for _ in range(60)]
    for size, edits in ((40, 3), (150, 6), (12, 14)):
        texts += near_copies(rng, [word() for _ in range(150)], size, edits)
    chain = [word() for _ in range(100)]
    for i in range(12):  # neighbours are alike, the ends are not
        chain = [*chain[2:], word(), word()]
        texts.append(" ".join(chain))
    texts += [texts[3]] * 30 + ["", " \t", "a", "A", "one two three four", "ONE two\nthree  four"]
    rng.shuffle(texts)
    return [(7 * i + 2, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("members", "frequent"), [(2000, 32), (25, 32), (10, 10**9)])
def test_against_all_pairs(spark, monkeypatch, members, frequent):
    monkeypatch.setattr(nj, "PART_MEMBERS", members)
    monkeypatch.setattr(nj, "FREQUENT_LEAST", frequent)
    rows = corpus(members)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: r["component_id"] for r in nj.jaccard_components(docs).collect()}
    assert got == brute(rows)


def test_oracle(spark):
    assert not differs(nj.op6_ngram_jaccard(spark, SF), nj.OP6_SQL, SF)


def test_threshold_is_exact():
    base = [f"t{i}" for i in range(200)]
    sh = nj.Shingler()
    for cut in range(1, 60):
        a, b = sh(" ".join(base)), sh(" ".join(base[cut:]))
        want = 100 * np.intersect1d(a, b).size >= 80 * np.union1d(a, b).size
        assert bool(nj.links([5, 9], [a, b])) == want


def test_bounds_never_lose_a_pair():
    rng = random.Random(5)
    sh = nj.Shingler()
    sets = [sh(t) for _, t in corpus(5)]
    sets = [s for s in sets if s.size]
    alive = nj.survivors(np.array([s.size for s in sets]), [nj.bitmap(s) for s in sets])
    for _ in range(4000):
        i, j = rng.randrange(len(sets)), rng.randrange(len(sets))
        if i != j and 100 * np.intersect1d(sets[i], sets[j]).size >= 80 * np.union1d(sets[i], sets[j]).size:
            assert alive[i] and alive[j]


def test_components(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100, 60), (100, 50), (99, 60), (99, 55)]
    got = {r["child"]: r["root"] for r in nj.components(spark.createDataFrame(edges, "child long, parent long"), []).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 50 for i in (55, 60, 99, 100)}}
    assert nj.components(spark.createDataFrame([], "child long, parent long"), []).count() == 0


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(40_000))
    rows = [(None, "a b c d e f"), (4, None), (5, ""), (6, "a b c d e f"), (7, "A B C D E F"), (8, long), (9, long + " x"), (6, "other words that stand here"), (10, "other words that stand here"), (10, "other words that stand here")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n string")
    got = sorted(((r["doc_id"] or 0), r["n_shingles"], r["component_id"]) for r in nj.jaccard_components(docs.select("doc_id", "text", "n")).collect())
    assert got == [(0, 2, None), (4, 0, 4), (5, 0, 5), (6, 1, 6), (6, 2, 6), (7, 2, 6), (8, 39_996, 8), (9, 39_997, 8), (10, 1, 6), (10, 1, 6)]
    assert nj.jaccard_components(docs.limit(0)).count() == 0
    kept = sorted((r["doc_id"] or 0) for r in nj.keep_one(docs).collect())
    assert kept == [4, 5, 6, 6, 8] and nj.keep_one(docs).columns == docs.columns


def test_one_of_each_group_stays(spark):
    """Repeated rows, rows with null ids, clashing names and an empty table."""
    rows = [(None, "one two three four five six", "a"), (None, "one two three four five six", "a"), (None, "One two three four  five six", "b"), (None, None, "c"), (3, "seven eight nine ten eleven twelve", "d"), (3, "seven eight nine ten eleven twelve", "d"), (3, "seven eight nine ten eleven twelve", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    kept = nj.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted((r["doc_id"] or 0, (r["text"] or "").lower().split()[:1]) for r in kept.collect())
    assert got == [(0, []), (0, ["one"]), (3, ["seven"])] and nj.keep_one(docs.limit(0)).count() == 0


def test_thinly_spread_shingles_are_found(spark, monkeypatch):
    """A passage that no task sees three times, in most documents."""
    monkeypatch.setattr(nj, "COUNTED", 200)
    passage = " ".join(f"p{i}" for i in range(60))
    docs = spark.createDataFrame([(i, " ".join(f"d{i}x{j}" for j in range(150)) + " " + passage) for i in range(400)], "doc_id long, text string").repartition(4)
    often, want = nj._frequent(docs, 5), nj.Shingler()(passage)
    assert np.isin(want, often).mean() > 0.9 and often.size < 2 * want.size


def test_tables_are_removed(spark):
    import os

    from plumbline.llm.common import shared_dir

    before = set(os.listdir(shared_dir(spark).removeprefix("file:")))
    nj.jaccard_components(spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f g"), (3, "x")], "doc_id long, text string")).collect()
    left = set(os.listdir(shared_dir(spark).removeprefix("file:"))) - before
    assert sorted(x.rsplit("-", 1)[0] for x in left) == ["join-components", "join-sketches"]
