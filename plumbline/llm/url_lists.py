"""URL filters by dated lists: entries become validity intervals, and every
capture is judged by the entries that were active when it was fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import lookup, table

URL = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)(?::[0-9]*)?([^?#]*)"


def host(url: Column) -> Column:
    """Lower-case host without user, port and final dot; empty if url is null or has none."""
    return F.lower(F.regexp_replace(F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1), r"\.$", ""))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


def url_keys(url: Column) -> Column:
    """What entries can match: the host and each domain above it, and each whole-segment prefix of host and path."""
    labels, parts = F.split(host(url), r"\."), F.filter(F.split(path(url), "/"), lambda x: x != "")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("prefix:"), host(url), F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")))
    none = F.array().cast("array<string>")
    return F.when(host(url) == "", none).otherwise(F.array_distinct(F.concat(domains, F.when(F.size(parts) > 0, prefixes).otherwise(none))))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, key, since, until) from entries (list, key, action, at): an add is
    valid until the next entry of its list and key, null if there is none.

    Rows with a null list, key, action or date say nothing; of entries of one
    date a remove wins; repeated entries count once."""
    known = entries.dropna(subset=["list", "key", "action", "at"]).groupBy("list", "key", "at").agg(F.max("action").alias("action"))
    until = F.lead("at").over(Window.partitionBy("list", "key").orderBy("at"))
    return known.withColumn("until", until).filter("action = 'add'").select("list", "key", F.col("at").alias("since"), "until")


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", at: str = "fetched") -> DataFrame:
    """captures with blocked, rule and since, which replace columns of these names:
    the longest active key decides, and of equally long ones an allow before a block.

    A capture without a host or date, or that nothing matches, isn't blocked
    and has no rule. Each url and date is judged once, so that a host with
    many captures costs what its distinct urls cost; the intervals are
    broadcast if they are few, else both sides are shuffled by key, where Spark
    may split a key with many captures. Urls are used whole, of any length."""
    asked = captures.select(F.col(url).alias("_ul_url"), F.col(at).alias("_ul_at")).dropna().distinct()
    keyed = asked.withColumn("key", F.explode(url_keys(F.col("_ul_url"))))
    valid = lookup(intervals(entries))
    hits = keyed.join(valid, "key").filter((F.col("since") <= F.col("_ul_at")) & (F.col("until").isNull() | (F.col("_ul_at") < F.col("until"))))
    order = F.struct(F.char_length("key").alias("n"), (F.col("list") == "allow").cast("int").alias("allow"), F.col("key").alias("rule"), F.col("since").alias("since"))
    best = hits.groupBy("_ul_url", "_ul_at").agg(F.max(order).alias("_ul")).select(F.col("_ul_url").alias("_ul_of"), F.col("_ul_at").alias("_ul_on"), "_ul")
    out = captures.join(best, (F.col(url) == F.col("_ul_of")) & (F.col(at) == F.col("_ul_on")), "left")
    return out.withColumns({"blocked": F.coalesce(F.col("_ul.allow") == 0, F.lit(False)), "rule": F.col("_ul.rule"), "since": F.col("_ul.since")}).drop("_ul", "_ul_of", "_ul_on")


def sample_entries(pages: DataFrame) -> DataFrame:
    """Dated entries for the query, made from the pages' own hosts by hashes: half
    of the hosts are blocked, unblocked and blocked again, a quarter of their
    parent domains are allowed from a day on, and an eighth of the first path
    segments are blocked."""
    day = lambda x, first, most: F.conv(F.substring(F.md5(x), first, 4), 16, 10).cast("int") % most
    digit = lambda x, first: F.conv(F.substring(F.md5(x), first, 1), 16, 10).cast("int")
    start = F.lit("2024-01-01").cast("date")
    hosts = pages.select(host(F.col("url")).alias("h")).filter("h <> ''").distinct()
    blocked = hosts.filter(digit(F.col("h"), 9) < 8).withColumns({"a": day(F.col("h"), 1, 366), "b": day(F.col("h"), 5, 120) + 1})
    events = F.explode(F.array(F.struct(F.lit("add").alias("action"), F.col("a").alias("d")), F.struct(F.lit("remove").alias("action"), (F.col("a") + F.col("b")).alias("d")), F.struct(F.lit("add").alias("action"), (F.col("a") + F.col("b") + 30).alias("d"))))
    out = blocked.select(F.lit("block").alias("list"), F.concat(F.lit("domain:"), F.col("h")).alias("key"), events.alias("e")).select("list", "key", "e.action", F.date_add(start, F.col("e.d")).alias("at"))
    parents = hosts.select(F.regexp_extract("h", r"([^.]+\.[^.]+)$", 1).alias("p")).filter("p <> ''").distinct().filter(digit(F.col("p"), 10) < 4)
    out = out.unionByName(parents.select(F.lit("allow").alias("list"), F.concat(F.lit("domain:"), F.col("p")).alias("key"), F.lit("add").alias("action"), F.date_add(start, day(F.col("p"), 1, 366)).alias("at")))
    heads = pages.select(F.concat(host(F.col("url")), F.lit("/"), F.regexp_extract(path(F.col("url")), "^/+([^/]+)", 1)).alias("k")).filter(~F.col("k").rlike("^/|/$")).distinct().filter(digit(F.col("k"), 11) < 2)
    return out.unionByName(heads.select(F.lit("block").alias("list"), F.concat(F.lit("prefix:"), F.col("k")).alias("key"), F.lit("add").alias("action"), F.date_add(start, day(F.col("k"), 1, 366)).alias("at")))


def op5_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, fetched on day page_id mod 366 of 2024, against dated entries
    that sample_entries() makes of the pages' own hosts, as no table holds a list."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 366).cast("int"))
    return judge(pages.withColumn("fetched", fetched), sample_entries(pages)).select("page_id", "url", "fetched", "blocked", "rule", "since")


OP5_SQL = r"""
WITH p AS (
  SELECT page_id, url, DATE '2024-01-01' + (page_id % 366)::INTEGER AS fetched,
         lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1), '\.$', '')) AS h,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)(?::[0-9]*)?([^?#]*)', 2) AS path FROM pages),
h AS (SELECT DISTINCT h FROM p WHERE h <> ''),
x AS (SELECT h, ('0x' || substr(md5(h), 1, 4))::INTEGER % 366 AS a, ('0x' || substr(md5(h), 5, 4))::INTEGER % 120 + 1 AS b FROM h WHERE ('0x' || substr(md5(h), 9, 1))::INTEGER < 8),
q AS (SELECT DISTINCT regexp_extract(h, '([^.]+\.[^.]+)$', 1) AS q FROM h),
k AS (SELECT DISTINCT h || '/' || regexp_extract(path, '^/+([^/]+)', 1) AS k FROM p),
e AS (
  SELECT 'block' AS list, 'domain:' || h AS key, 'add' AS action, DATE '2024-01-01' + a AS day FROM x
  UNION SELECT 'block', 'domain:' || h, 'remove', DATE '2024-01-01' + (a + b) FROM x
  UNION SELECT 'block', 'domain:' || h, 'add', DATE '2024-01-01' + (a + b + 30) FROM x
  UNION SELECT 'allow', 'domain:' || q, 'add', DATE '2024-01-01' + ('0x' || substr(md5(q), 1, 4))::INTEGER % 366 FROM q WHERE q <> '' AND ('0x' || substr(md5(q), 10, 1))::INTEGER < 4
  UNION SELECT 'block', 'prefix:' || k, 'add', DATE '2024-01-01' + ('0x' || substr(md5(k), 1, 4))::INTEGER % 366 FROM k WHERE NOT regexp_matches(k, '^/|/$') AND ('0x' || substr(md5(k), 11, 1))::INTEGER < 2),
i AS (SELECT list, key, action, day AS since, lead(day) OVER (PARTITION BY list, key ORDER BY day) AS until FROM e),
m AS (
  SELECT p.page_id, p.url, p.fetched, i.list, i.key, i.since
  FROM p JOIN i ON i.action = 'add' AND p.h <> '' AND i.since <= p.fetched AND (i.until IS NULL OR p.fetched < i.until)
   AND (i.key = 'domain:' || p.h OR (starts_with(i.key, 'domain:') AND ends_with(p.h, '.' || substr(i.key, 8)))
        OR (starts_with(i.key, 'prefix:') AND (p.h || '/' || regexp_extract(path, '^/+([^/]+)', 1)) = substr(i.key, 8)))),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY length(key) DESC, (list = 'allow')::INTEGER DESC, key DESC) AS n FROM m)
SELECT p.page_id, p.url, p.fetched, coalesce(r.list = 'block', false) AS blocked, r.key AS rule, r.since
FROM p LEFT JOIN r ON r.page_id = p.page_id AND r.url = p.url AND r.n = 1
"""
