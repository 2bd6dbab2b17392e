import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import search as S

CHUNKS = [(1, "a", "x", 1, 2, "red shoes", [1.0, 0.0]), (2, "a", "x", 2, 2, "red red boots", [0.8, 0.6]), (3, "b", "y", 1, 2, "blue shoes", [0.0, 1.0]), (4, "b", "y", 2, 2, "red blue", None), (5, "c", "x", 1, 1, "", [0.8, 0.6])]
DDL = "chunk_id long, doc_key string, item_section string, chunk_index int, token_count int, content string, embedding array<double>"


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(CHUNKS, DDL)


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(1, "red shoes", ["red", "shoes"], [1.0, 0.0]), (2, "blue", ["blue"], [0.0, 2.0]), (3, "none", ["none"], None)], "query_id long, text string, terms array<string>, qv array<double>")


def ids(df, q):
    return [r["chunk_id"] for r in df.filter(F.col("query_id") == q).orderBy("rank").collect()]


def test_semantic(chunks, queries):
    hits = S.semantic(chunks, queries, 3)
    assert ids(hits, 1) == [1, 2, 5] and ids(hits, 2) == [3, 2, 5] and ids(hits, 3) == []
    assert hits.filter("query_id = 1 and rank = 2").first()["score"] == pytest.approx(0.8)


def test_semantic_in_batches_is_exact(spark):
    rng = np.random.default_rng(0)
    v, q = rng.normal(size=(3000, 8)), rng.normal(size=(5, 8))
    c = spark.createDataFrame([(i, "a", "x", i, 1, "", x.tolist()) for i, x in enumerate(v)], DDL).repartition(7)
    qs = spark.createDataFrame([(i, "", [], x.tolist()) for i, x in enumerate(q)], "query_id long, text string, terms array<string>, qv array<double>")
    hits = S.semantic(c, qs, 20)
    s = (v / np.linalg.norm(v, axis=1, keepdims=True)) @ (q / np.linalg.norm(q, axis=1, keepdims=True)).T
    for i in range(5):
        assert ids(hits, i) == np.argsort(-s[:, i])[:20].tolist()


def test_keyword_falls_back(chunks, queries):
    found = S.matches(chunks, queries)
    modes = {r["query_id"]: (r["and_hits"], r["or_hits"], r["mode"]) for r in S.keyword_modes(found, queries, least=1).collect()}
    assert modes == {1: (1, 4, "AND"), 2: (2, 2, "AND"), 3: (0, 0, "OR")}
    assert ids(S.keyword(chunks, queries, 9), 1) == [1, 2, 3, 4]  # fewer than five have both: any
    assert ids(S.keyword(chunks, queries, 9, mode="AND"), 1) == [1]


def test_scores(chunks, queries):
    r = S.keyword(chunks, queries, 9).filter("query_id = 1 and chunk_id = 2").first()
    assert r["score"] == pytest.approx(math.log(3))
    hits = S.hybrid(chunks, queries, 9)
    both = hits.filter("query_id = 1 and chunk_id = 1").first()
    assert both["score"] == pytest.approx(1 / 41 + 1 / 41) and both["semantic_rank"] == both["keyword_rank"] == 1
    only = hits.filter("query_id = 1 and chunk_id = 4").first()
    assert only["semantic_rank"] is None and only["score"] == pytest.approx(1 / 44)


def test_quota_and_interleave(spark, chunks, queries):
    targets = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (1, "c", 2)], "query_id long, ticker string, pos int")
    hits = S.search(chunks, queries, targets, 7)
    # 7 div 3 = 2 places each, in order of mention: a, b, c, then a, b.
    assert ids(hits, 1) == [1, 3, 5, 2, 4]
    assert ids(hits, 2) == ids(S.hybrid(chunks, queries, 7), 2)


def test_ties_end_with_the_smaller_id(spark, queries):
    c = spark.createDataFrame([(i, "a", "x", i, 1, "red shoes", [1.0, 0.0]) for i in (9, 3, 7, 5, 1, 8)], DDL)
    assert ids(S.hybrid(c, queries, 4), 1) == [1, 3, 5, 7]


def test_restrictions(chunks):
    assert S.restricted(chunks, sections=["y"]).count() == 2 and S.restricted(chunks, sections=[], tickers=None).count() == 5
    assert S.restricted(chunks, sections=["x"], tickers=["a", "b"]).count() == 2


def test_plans(chunks, queries):
    """Ids and scores alone are shuffled, and ranking is cut before and after the exchange."""
    plan = S.keyword(chunks, queries, 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan
