"""More questions than one block holds are all answered."""

import numpy as np

from plumbline.operators import search as S
from tests.test_search import DDL, ids

Q = "query_id long, text string, terms array<string>, qv array<double>"


def test_more_rows_than_the_old_limit(spark):
    n = 4 * S.BATCH + 1
    c = spark.createDataFrame([(1, "a", "x", 1, 1, "", [1.0, 0.0]), (2, "a", "x", 2, 1, "", [0.0, 1.0])], DDL)
    qs = spark.range(n).selectExpr("id as query_id", "'' as text", "array('') as terms", "if(id % 2 = 0, array(1d, 0d), array(0d, 1d)) as qv")
    hits = S.semantic(c, qs, 1).collect()
    assert {(r["query_id"], r["chunk_id"], r["rank"]) for r in hits} == {(i, i % 2 + 1, 1) for i in range(n)} and len(hits) == n


def test_blocks_give_the_same_hits(spark, monkeypatch):
    rng = np.random.default_rng(1)
    c = spark.createDataFrame([(i, "ab"[i % 2], "x", i, 1, "", x.tolist()) for i, x in enumerate(rng.normal(size=(300, 4)))], DDL).repartition(3)
    qs = spark.createDataFrame([(i, "", [], x.tolist()) for i, x in enumerate(rng.normal(size=(9, 4)))], Q)
    targets = spark.createDataFrame([(i, t, p) for i in range(5) for p, t in enumerate("ba")], "query_id long, ticker string, pos int")
    rows = lambda: sorted(map(str, S.semantic(c, qs, 6, targets).collect()))
    whole = rows()
    assert len(whole) == 14 * 6
    monkeypatch.setattr(S, "BATCH", 3)
    assert rows() == whole
