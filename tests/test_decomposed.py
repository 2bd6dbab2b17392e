"""Each company gets the question without the other companies."""

from pyspark.sql import functions as F

from plumbline.functions import companies
from plumbline.operators import search as S
from plumbline.plans import registry
from plumbline.plans import workload as W
from tests.conftest import SF
from tests.test_search import DDL, ids


def test_sub_question_is_strip_others(spark):
    cases = [("How do Columbia Sportswear and Under Armour compare?", "UAA", ["COLM", "UAA"]), ("Do both Crocs and Etsy grow?", "ETSY", ["CROX", "ETSY"]), ("What were Gap's sales versus Abercrombie?", "ANF", ["GAP", "ANF"]), ("Did Nike grow?", "NKE", ["NKE"])]
    for q, keep, named in cases:
        row = spark.createDataFrame([(q, keep, named)], "q string, keep string, named array<string>")
        got = row.select(companies.sub_question(F.col("q"), F.col("keep"), F.col("named")), companies.strip_others(F.col("q"), keep, tuple(named))).first()
        assert got[0] == got[1]


def test_what_stays_of_a_question(spark):
    cases = [
        ("How do Deckers Outdoor and Abercrombie & Fitch compare?", ["DECK", "ANF"], {"DECK": "How do Deckers Outdoor compare?", "ANF": "How do Abercrombie & Fitch compare?"}),
        ("Do both Levi Strauss & Co, Gap Inc, and Urban Outfitters, Inc grow?", ["LEVI", "GAP", "URBN"], {"LEVI": "Do Levi Strauss & Co grow?", "GAP": "Do Gap Inc grow?", "URBN": "Do Urban Outfitters, Inc grow?"}),
        ("Were Etsy's or Crocs' margins wider, and why?", ["ETSY", "CROX"], {"ETSY": "Were Etsy's margins wider, and why?", "CROX": "Were Crocs' margins wider, and why?"}),
        ("Compare sales of Nike with those of Peloton.", ["NKE", "PTON"], {"NKE": "Compare sales of Nike with those of.", "PTON": "Compare sales of with those of Peloton."}),
        ("Is it Chewy, or is it Wayfair?", ["CHWY", "W"], {"CHWY": "Is it Chewy, or is it?", "W": "Is it is it Wayfair?"}),
    ]
    rows = spark.createDataFrame([(q, k, named, want) for q, named, each in cases for k, want in each.items()], "q string, keep string, named array<string>, want string")
    got = rows.select("want", companies.sub_question(F.col("q"), F.col("keep"), F.col("named")).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_each_company_is_searched_by_its_own_question(spark):
    c = spark.createDataFrame([(1, "CROX", "x", 1, 1, "crocs crocs etsy", [1.0, 0.0]), (2, "CROX", "x", 2, 1, "etsy " * 6, [0.0, 1.0]), (3, "ETSY", "x", 1, 1, "crocs crocs crocs", [0.0, 1.0]), (4, "ETSY", "x", 2, 1, "etsy", [1.0, 0.0])], DDL)
    q = spark.createDataFrame([(7, "Do both Crocs and Etsy grow?", ["crocs", "etsy"], [0.0, 1.0])], "query_id long, text string, terms array<string>, qv array<double>")
    t = spark.createDataFrame([(7, "CROX", 0), (7, "ETSY", 1)], "query_id long, ticker string, pos int")
    # The vector of a question with both names points elsewhere than those of its parts.
    encode = lambda x: F.when(F.contains(x, F.lit("Crocs")) & F.contains(x, F.lit("Etsy")), F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(0.0)))
    assert ids(S.search(c, q, t, 2), 7) == [2, 3]
    assert ids(S.decomposed(c, q, t, companies.sub_question, encode, 2), 7) == [1, 4]


def test_registered(spark):
    q, t = W.named(spark, SF)
    n = W.gold(spark, SF).join(q, "query_id", "left_semi").count()
    moves = {r["movement"]: r["n"] for r in registry.QUERIES["t10_decomposed"](spark, SF).collect()}
    assert n and sum(moves.values()) == n
