"""Every word of a question is searched, not its first two."""

import pytest
from pyspark.sql import functions as F

from plumbline.functions.text import tokens
from plumbline.plans import registry
from plumbline.plans import workload as W
from plumbline.plans.check import differs
from tests.conftest import SF

def test_terms_are_the_whole_question(spark):
    rows = W.queries(spark, SF).withColumn("own", F.array_sort(F.array_distinct(tokens(F.col("text"))))).collect()
    assert rows and all(r["terms"] == r["own"] for r in rows) and min(len(r["terms"]) for r in rows) > 2


@pytest.mark.parametrize("name", ["a35_keyword_modes", "t2_keyword_topk", "t3_hybrid_rrf", "t4_search", "t11_deep_ranks", "a9_question_scores"])
def test_against_sql(spark, name):
    assert not differs(registry.QUERIES[name](spark, SF), registry.ORACLES[name], SF)
