"""Judged claims and answers, and keyword search by stems."""

import pytest

from plumbline.functions import filings
from plumbline.operators import judging as J
from plumbline.operators import search as S
from plumbline.plans import registry
from plumbline.plans.check import differs
from pyspark.sql import functions as F
from tests.conftest import SF


def fake():
    def reply(system, user, max_tokens):
        claim = user.rpartition("CLAIM:\n")[2]
        if "silent" in claim:
            return ""
        return '{"verdict": "SUPPORTED"}' if "five" in user.rpartition("CLAIM:")[0] else "UNSUPPORTED, I think"

    return reply


def test_claims(spark):
    text = "Sales grew by five percent [1][3]. Costs fell by a lot too [2]. Short one [1]. The judge is silent here [1]."
    excerpts = [(1, "(A)", "nothing"), (2, "(B)", "nothing"), (3, "(C)", "five percent")]
    rows = spark.createDataFrame([(1, 1, text, excerpts), (2, 1, "No citation here at all.", excerpts), (3, 1, None, None)], "id long, run int, text string, excerpts array<struct<rank: int, label: string, content: string>>")
    got = {r["claim"][:5]: (r["cited"], r["verdict"]) for r in J.judge_claims(rows, fake).collect()}
    assert got == {"Sales": ([1, 3], "supported"), "Costs": ([2], "unsupported"), "The j": ([1], "judge_error")}


@pytest.mark.parametrize("name", ["x6_judged_answers", "a45_label_counts", "k3_upsert_chunks"])
def test_against_sql(spark, name):
    assert not differs(registry.QUERIES[name](spark, SF), registry.ORACLES[name], SF)


def test_stems_meet(spark):
    chunks = spark.createDataFrame([(1, "k", "the running shoes"), (2, "k", "a shoe that runs"), (3, "k", "the and of"), (4, "k", None)], "chunk_id long, doc_key string, content string")
    q = spark.createDataFrame([(7, "Run of the shoe")], "query_id long, text string").withColumn("terms", F.array_distinct(filings.lexemes(F.col("text"))))
    found = S.matches(chunks, q, filings.lexemes)
    assert {r["chunk_id"]: r["n_terms"] for r in found.collect()} == {1: 2, 2: 2}
    assert [r["chunk_id"] for r in S.keyword(chunks, q, 5, found=found).orderBy("rank").collect()] == [1, 2]
