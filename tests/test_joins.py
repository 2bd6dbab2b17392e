"""Containment by tokens against plain loops, and what is built on it."""

import random
import re

import pytest
from pyspark.sql import functions as F

from plumbline.operators import joins
from plumbline.operators import quality as Q
from plumbline.sources import writers

WORDS = ["alpha", "be", "Gamma", "x1", "é", "45%", "a-b", "the", "The", "of"]


def corpus(seed, n):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 25))) for _ in range(n)]


@pytest.mark.parametrize("block", [500, 2])
def test_holding(spark, block):
    rng = random.Random(4)
    texts = [(i, t, f"k{i % 3}") for i, t in enumerate(corpus(1, 60))]
    needles = {(t[a : a + rng.randint(1, 40)], f"k{rng.randrange(3)}") for _, t, _ in texts for a in [rng.randrange(len(t) + 1)] if t[a:]} | {("nowhere at all here", "k0"), ("the", "k1"), ("%", "k2")}
    docs = spark.createDataFrame(texts, "chunk_id long, content string, doc_key string")
    asked = spark.createDataFrame([*needles, (None, "k0")], "needle string, doc_key string")
    got = {(r["chunk_id"], r["needle"], r["doc_key"]) for r in joins.holding(docs, asked, F.contains("content", "needle"), on=("doc_key",), block=block).collect()}
    assert got == {(i, n, k) for i, t, k in texts for n, k2 in needles if k == k2 and n in t}
    every = {(r["chunk_id"], r["needle"]) for r in joins.holding(docs, asked, F.contains("content", "needle")).collect()}
    assert every == {(i, n) for i, t, _ in texts for n, _ in needles if n in t}
    assert joins.holding(docs.limit(0), asked, F.contains("content", "needle")).count() == 0


def test_holding_with_wildcards(spark):
    texts = [(i, t, "") for i, t in enumerate(corpus(2, 50))]
    needles = ["alpha_be", "alpha %e", "the%of", "gamma x1 the", "a_b the x"]
    docs, asked = spark.createDataFrame(texts, "chunk_id long, content string, doc_key string"), spark.createDataFrame([(n,) for n in needles], "needle string")
    like = F.ilike(F.col("content"), F.concat(F.lit("%"), F.col("needle"), F.lit("%")))
    got = {(r["chunk_id"], r["needle"]) for r in joins.holding(docs, asked, like).collect()}
    pattern = {n: re.compile("".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in n), re.IGNORECASE | re.DOTALL) for n in needles}
    assert got == {(i, n) for i, t, _ in texts for n in needles if pattern[n].search(t)}


def grown(body, texts, needle, max_words=20, max_places=6):
    """The rule in words: grow each place by the word that leaves fewer texts, the first of equal ones; the place with the fewest counts."""
    low, best = body.lower(), None
    holding = lambda s: sum(s.lower().strip() in t for t in texts)
    starts = [m.start() for m in re.finditer(f"(?={re.escape(needle)})", low)][:max_places] if needle else []
    for at in starts:
        ends = sorted({m.start() for m in re.finditer(" ", body)} | {len(body)})
        begins = [0, *(m.end() for m in re.finditer(" ", body))]
        a, b = max(x for x in begins if x <= at), at + len(needle)
        for _ in range(max_words):
            wider = [(x, b) for x in begins[::-1] if x < a][:1] + [(a, x) for x in ends if x > b][:1]
            if holding(body[a:b]) <= 1 or not wider:
                break
            a, b = min(wider, key=lambda w: (holding(body[w[0] : w[1]]), body[w[0] : w[1]]))
        if best is None or holding(body[a:b]) < best[0]:
            best = (holding(body[a:b]), body[a:b].strip())
    return best


def test_extended_anchors(spark):
    texts = [" ".join(t.split()) for t in corpus(7, 80)]
    rng = random.Random(8)
    chunks = [(i, f"k{i % 2}", i, t) for i, t in enumerate(texts)]
    labels = []
    for i, k, _, t in chunks:
        if len(t) > 3:
            a = rng.randrange(len(t) - 1)
            needle = t[a : a + rng.choice([1, 3, 8])].strip()
            labels.append((i, k, i, needle))
    labels += [(900, "k0", 4, "not there"), (901, "k0", 77_777, "alpha"), (902, "k1", 1, "")]
    got = {r["query_id"]: (r["n"], r["anchor"]) for r in Q.extend_anchors(spark.createDataFrame(labels, "query_id long, doc_key string, chunk_index int, contains string"), spark.createDataFrame(chunks, "chunk_id long, doc_key string, chunk_index int, content string")).collect()}
    for q, k, i, needle in labels:
        if q >= 900 or not needle:
            assert got[q] == (0, needle)
            continue
        want = grown(texts[i], [t.lower() for j, t in enumerate(texts) if f"k{j % 2}" == k], needle.lower())
        assert got[q] == want, (texts[i], needle)


def test_repeated_keys(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k long, v string, n int")
    new = spark.createDataFrame([(2, "x", 5), (2, "y", 4), (3, "p", 1), (3, "q", 1)], "k long, v string, n int")
    got = lambda df: sorted(map(tuple, df.collect()))
    assert got(writers.upsert(old, new, ["k"], ["v", "n"])) == [(1, "a", 1), (2, "y", 4), (3, "q", 1)]
    assert got(writers.upsert(old, new, ["k"], ["v"], order=("n",))) == [(1, "a", 1), (2, "x", 1), (3, "q", 1)]
    assert got(writers.insert_ignore(old, new, ["k"])) == [(1, "a", 1), (2, "b", 1), (3, "q", 1)]
    assert got(writers.update_by_key(old, new, ["k"], "v")) == [(1, "a", 1), (2, "y", 1)]
