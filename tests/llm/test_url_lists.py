import datetime as dt

from plumbline.llm import url_lists as ul
from plumbline.plans.check import differs

SF = "/root/testdata/sf0.001"
D = dt.date


def test_oracle(spark):
    assert not differs(ul.op5_url_lists(spark, SF), ul.OP5_SQL, SF)


ENTRIES = [
    ("block", "domain:bad.com", "add", D(2024, 1, 5)), ("block", "domain:bad.com", "remove", D(2024, 2, 1)), ("block", "domain:bad.com", "add", D(2024, 3, 1)),
    ("block", "domain:bad.com", "add", D(2024, 1, 5)), ("allow", "domain:ok.bad.com", "add", D(2024, 1, 10)), ("block", "prefix:mixed.org/x/y", "add", D(2024, 1, 1)),
    ("block", "domain:both.net", "add", D(2024, 1, 1)), ("allow", "domain:both.net", "add", D(2024, 1, 2)), ("block", "domain:gone.net", "add", D(2024, 1, 3)), ("block", "domain:gone.net", "remove", D(2024, 1, 3)),
    ("block", None, "add", D(2024, 1, 1)), ("block", "domain:x", None, D(2024, 1, 1)), (None, "domain:x", "add", D(2024, 1, 1)),
]
CAPTURES = [
    (1, "http://bad.com/", D(2024, 1, 4), False), (2, "http://bad.com/", D(2024, 1, 5), True), (3, "https://u:p@www.BAD.com:81/q?z#f", D(2024, 1, 31), True), (4, "http://bad.com", D(2024, 2, 1), False),
    (5, "http://bad.com./a", D(2024, 3, 9), True), (6, "http://ok.bad.com/", D(2024, 3, 9), False), (7, "http://notbad.com/", D(2024, 3, 9), False), (8, "http://mixed.org/x/y/z", D(2024, 1, 1), True),
    (9, "http://mixed.org/x/yy", D(2024, 1, 1), False), (10, "http://both.net/", D(2024, 1, 1), True), (11, "http://both.net/", D(2024, 1, 2), False), (12, "http://gone.net/", D(2024, 1, 9), False),
    (13, None, D(2024, 1, 1), False), (14, "http://bad.com/", None, False), (15, "no url", D(2024, 1, 9), False), (16, "", D(2024, 1, 9), False), (None, "http://bad.com/", D(2024, 1, 5), True), (2, "http://bad.com/", D(2024, 1, 5), True), (17, "http://x/" + "a/" * 3000, D(2024, 1, 9), False),
]


def test_edges(spark):
    entries = spark.createDataFrame(ENTRIES, "list string, key string, action string, at date")
    captures = spark.createDataFrame([(i, u, t, w, "k") for i, u, t, w in CAPTURES], "id long, url string, fetched date, want boolean, key string")
    got = ul.judge(captures, entries).collect()
    assert len(got) == len(CAPTURES) and all(r["blocked"] == r["want"] for r in got)
    assert {r["rule"] for r in got if r["id"] == 6} == {"domain:ok.bad.com"} and all(r["key"] == "k" for r in got)
    assert ul.judge(captures.limit(0), entries).count() == 0
    assert ul.judge(captures, entries.limit(0)).filter("blocked").count() == 0


def test_long_urls_and_clashing_names(spark):
    long = "http://a.example.org/x/" + "y" * 200_000 + "/z"
    rows = [(1, long, D(2024, 5, 1), "own"), (2, None, D(2024, 5, 1), "own"), (3, "http://b.org/", None, "own")]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched date, rule string")
    entries = spark.createDataFrame([("block", "prefix:a.example.org/x", "add", D(2024, 1, 1)), ("allow", "domain:example.org", "add", D(2024, 1, 1))], "list string, key string, action string, at date")
    got = {r["page_id"]: (r["blocked"], r["rule"]) for r in ul.judge(captures, entries).collect()}
    assert got == {1: (True, "prefix:a.example.org/x"), 2: (False, None), 3: (False, None)}
