"""Registered queries: labels, corpus checks, text functions, loading."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import config as C
from plumbline.functions import companies, filings, text as T
from plumbline.operators import quality as Q
from plumbline.plans import workload as W
from plumbline.plans.workload import with_views
from plumbline.sources import writers

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
CH = with_views("", "chunks")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


FLAT = r"lower(trim(regexp_replace({}, '\s+', ' ', 'g')))"


def _labels(spark, d):
    """Gold pairs as labels, some with a wrong place or text: every fifth question's index moves by 20, every seventh's text is absent."""
    g = W.gold(spark, d).join(W.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), "query_id")
    docs = W.table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc_key"))
    shifted = F.when(F.col("query_id") % 5 == 0, F.col("chunk_id") + 20).when(F.col("query_id") % 11 == 0, -F.lit(1)).otherwise(F.col("chunk_id"))
    needle = F.when(F.col("query_id") % 7 == 0, F.lit("no such passage")).when(F.col("query_id") % 13 == 0, F.lit(None).cast("string")).otherwise(F.col("text"))
    return g.join(docs, "chunk_id").select("query_id", "doc_key", shifted.cast("int").alias("chunk_index"), needle.alias("contains"))


LABELS = with_views("", "gold", "chunks") + """, labelled AS (SELECT g.query_id, d.source AS doc_key, (CASE WHEN g.query_id % 5 = 0 THEN g.chunk_id + 20 WHEN g.query_id % 11 = 0 THEN -1 ELSE g.chunk_id END)::INTEGER AS chunk_index,
  CASE WHEN g.query_id % 7 = 0 THEN 'no such passage' WHEN g.query_id % 13 = 0 THEN NULL ELSE b.text END AS contains FROM gold g JOIN documents d ON d.doc_id = g.chunk_id JOIN benchmark b ON b.item_id = g.query_id)"""


@query("j4_label_resolution", LABELS + f""" SELECT l.query_id, l.doc_key, l.chunk_index, c.chunk_id, CASE WHEN c.chunk_id IS NULL THEN 'missing' WHEN l.contains IS NULL THEN 'unanchored'
  WHEN contains({FLAT.format('c.content')}, {FLAT.format('l.contains')}) THEN 'resolved' ELSE 'moved' END AS outcome FROM labelled l LEFT JOIN chunks c USING (doc_key, chunk_index)""")
def j4(spark, d):
    """J4, P11."""
    return Q.resolve_labels(_labels(spark, d), W.chunks(spark, d))


@query("a45_label_counts", LABELS + " SELECT count(*) AS labels, count(contains) AS anchored, count(DISTINCT query_id) AS questions FROM labelled")
def a45(spark, d):
    """Labels, those with a text to check, and their questions."""
    return _labels(spark, d).agg(F.count("*").alias("labels"), F.count("contains").alias("anchored"), F.count_distinct("query_id").alias("questions"))


@query("j5_neighbours", LABELS + " SELECT l.query_id, l.doc_key, l.chunk_index, c.chunk_id AS neighbour_id FROM labelled l JOIN chunks c ON c.doc_key = l.doc_key AND c.chunk_index BETWEEN l.chunk_index - 40 AND l.chunk_index + 40 AND c.chunk_index >= 0")
def j5(spark, d):
    """Chunks near labelled ones, a source's indices being 20 apart."""
    return Q.neighbours(_labels(spark, d), W.chunks(spark, d), 40).select("query_id", "doc_key", "chunk_index", "neighbour_id")


@query("j6_fixture", LABELS + " SELECT DISTINCT c.chunk_id, c.doc_key, c.chunk_index FROM chunks c SEMI JOIN labelled l ON c.doc_key = l.doc_key AND c.chunk_index BETWEEN l.chunk_index - 40 AND l.chunk_index + 40 AND c.chunk_index >= 0")
def j6(spark, d):
    c = W.chunks(spark, d)
    near = Q.neighbours(_labels(spark, d), c, 40).select(F.col("neighbour_id").alias("chunk_id")).distinct()
    return c.join(near, "chunk_id", "left_semi").select("chunk_id", "doc_key", "chunk_index")


@query("a32_anchor_buckets", LABELS + f""", n AS (SELECT l.query_id, l.doc_key, l.contains, count(*) FILTER (contains({FLAT.format('c.content')}, {FLAT.format('l.contains')})) AS n FROM labelled l JOIN chunks c USING (doc_key) WHERE l.contains IS NOT NULL GROUP BY ALL)
SELECT CASE WHEN n <= 1 THEN 'unique' WHEN n <= 8 THEN '2-8' ELSE 'over 8' END AS bucket, count(*) AS labels FROM n GROUP BY 1""")
def a32(spark, d):
    """In how many chunks of its document a label's text stands."""
    return Q.anchor_buckets(Q.anchor_counts(_labels(spark, d).filter("contains is not null"), W.chunks(spark, d)))


@query("j14_nearest_anchor", LABELS + f""", h AS (SELECT l.query_id, l.doc_key, l.chunk_index, c.chunk_index AS i FROM labelled l JOIN chunks c USING (doc_key) WHERE contains({FLAT.format('c.content')}, {FLAT.format('l.contains')}))
SELECT query_id, doc_key, chunk_index, arg_min(i, abs(i - chunk_index) * 1e9 + i)::INTEGER AS nearest, (arg_min(i, abs(i - chunk_index) * 1e9 + i) - chunk_index)::INTEGER AS "offset", count(*) AS places FROM h GROUP BY 1, 2, 3""")
def j14(spark, d):
    return Q.nearest_anchor(_labels(spark, d), W.chunks(spark, d))


NEW = ", renumbered AS (SELECT doc_key, (chunk_index + CASE WHEN chunk_index >= 100 THEN 20 ELSE 0 END)::INTEGER AS chunk_index, content, chunk_id FROM chunks WHERE chunk_index % 9 <> 0)"


def _renumbered(spark, d):
    """A later corpus: some chunks gone, indices from 100 on 20 higher."""
    return W.chunks(spark, d).filter("chunk_index % 9 <> 0").withColumn("chunk_index", F.col("chunk_index") + F.when(F.col("chunk_index") >= 100, 20).otherwise(0))


@query("j13_relocation", CH + NEW + f""", n AS (SELECT doc_key, sha256({FLAT.format('content')}) AS same, count(*) AS n, min(chunk_index) AS "to" FROM renumbered GROUP BY 1, 2)
SELECT c.doc_key, c.chunk_index AS "from", CASE WHEN n.n = 1 THEN n."to" END AS "to", CASE WHEN n.n IS NULL THEN 'gone' WHEN n.n > 1 THEN 'ambiguous' WHEN n."to" = c.chunk_index THEN 'same' ELSE 'moved' END AS outcome
FROM chunks c LEFT JOIN n ON n.doc_key = c.doc_key AND n.same = sha256({FLAT.format('c.content')})""")
def j13(spark, d):
    return Q.relocate_by_content(W.chunks(spark, d), _renumbered(spark, d))


@query("j11_warehouse_vs_disk", CH + """, r AS (SELECT doc_key, chunk_index, content || CASE WHEN chunk_id % 10 = 3 THEN '!' ELSE '' END AS content FROM chunks WHERE chunk_id % 6 <> 0)
SELECT coalesce(c.doc_key, r.doc_key) AS doc_key, count(c.content) AS left_rows, count(r.content) AS right_rows, count(*) FILTER (r.content IS NULL) AS left_only, count(*) FILTER (c.content IS NULL) AS right_only,
  count(*) FILTER (c.content <> r.content) AS differ, min(c.chunk_index) FILTER (c.content <> r.content) AS first_difference FROM chunks c FULL JOIN r ON c.doc_key = r.doc_key AND c.chunk_index = r.chunk_index GROUP BY 1""")
def j11(spark, d):
    c = W.chunks(spark, d)
    disk = c.filter("chunk_id % 6 <> 0").withColumn("content", F.concat("content", F.when(F.col("chunk_id") % 10 == 3, "!").otherwise("")))
    return Q.compare_tables(c, disk)


@query("j12_truth_table", LABELS + NEW + f""", t AS (SELECT a.content AS a, b.content AS b, coalesce(contains({FLAT.format('a.content')}, {FLAT.format('l.contains')}), false) AS ha, coalesce(contains({FLAT.format('b.content')}, {FLAT.format('l.contains')}), false) AS hb
  FROM labelled l LEFT JOIN chunks a ON a.doc_key = l.doc_key AND a.chunk_index = l.chunk_index LEFT JOIN renumbered b ON b.doc_key = l.doc_key AND b.chunk_index = l.chunk_index)
SELECT CASE WHEN a IS NULL AND b IS NULL THEN 'absent' WHEN ha AND hb THEN 'both' WHEN ha THEN 'first only' WHEN hb THEN 'second only' ELSE 'neither' END AS kind, count(*) AS labels, count(*) FILTER (a <> b) AS texts_differ FROM t GROUP BY 1""")
def j12(spark, d):
    return Q.truth_table(_labels(spark, d), W.chunks(spark, d), _renumbered(spark, d))


@query("j15_probe_relocation")
def j15(spark, d):
    """Gold chunks found again by probes; the tests compare with a plain loop."""
    c = W.chunks(spark, d)
    marked = c.join(W.gold(spark, d).select("chunk_id").distinct(), "chunk_id", "left_semi")
    return Q.relocate_by_probes(marked, _renumbered(spark, d))


@query("j3_orphans", CH + ", documents2 AS (SELECT DISTINCT source AS doc_key FROM documents WHERE source <> 'src3') SELECT chunk_id, doc_key FROM chunks ANTI JOIN documents2 USING (doc_key)")
def j3(spark, d):
    parents = W.table(spark, d, "documents").filter("source <> 'src3'").select(F.col("source").alias("doc_key")).distinct()
    return Q.orphans(W.chunks(spark, d), parents).select("chunk_id", "doc_key")


@query("a7_reconcile", CH + """, p AS (SELECT DISTINCT source AS doc_key FROM documents WHERE source <> 'src3'), f AS (SELECT unnest([{'check': 'documents', 'found': (SELECT count(*) FROM p), 'expected': 20}, {'check': 'chunks', 'found': (SELECT count(*) FROM chunks), 'expected': 1000},
  {'check': 'without vector', 'found': (SELECT count(*) FROM chunks WHERE embedding IS NULL), 'expected': 0}, {'check': 'without words', 'found': (SELECT count(*) FROM chunks WHERE token_count = 0), 'expected': 0}, {'check': 'orphans', 'found': (SELECT count(*) FROM chunks ANTI JOIN p USING (doc_key)), 'expected': 0}]) AS c)
SELECT c.check AS check, c.found AS found, c.expected::BIGINT AS expected, c.found = c.expected AS ok FROM f""")
def a7(spark, d):
    """A load's five checks, some of which fail here."""
    parents = W.table(spark, d, "documents").filter("source <> 'src3'").select(F.col("source").alias("doc_key")).distinct()
    return Q.reconcile(W.chunks(spark, d), parents, 20, 1000)


@query("a2_section_histogram", CH + " SELECT item_section, count(*) AS n, round(avg(token_count), 6) AS mean_tokens FROM chunks GROUP BY 1")
def a2(spark, d):
    return Q.section_histogram(W.chunks(spark, d))


@query("a3_null_vectors", CH + " SELECT doc_key, count(*) AS n FROM chunks WHERE embedding IS NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
def a3(spark, d):
    """A3, P5: the eight documents with most chunks without a vector."""
    return W.chunks(spark, d).filter("embedding is null").groupBy("doc_key").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "doc_key").limit(8)


@query("a4_keys_of_chunks", with_views("", "gold") + " SELECT DISTINCT source AS doc_key FROM gold JOIN documents ON doc_id = chunk_id")
def a4(spark, d):
    return W.chunks(spark, d).join(W.gold(spark, d), "chunk_id", "left_semi").select("doc_key").distinct()


@query("a5_token_stats", CH + ", s AS (SELECT item_section, list_sort(list(token_count)) AS t FROM chunks GROUP BY 1) SELECT item_section, t[1] AS least, t[len(t) // 2 + 1] AS upper_median, t[-1] AS most, len([x for x in t if x > 420])::BIGINT AS over_budget FROM s")
def a5(spark, d):
    """A5: by section, with the upper median: exact counts of each size stand for the sorted list, so no section is gathered."""
    from pyspark.sql import Window

    sizes = W.chunks(spark, d).groupBy("item_section", "token_count").agg(F.count("*").alias("n"))
    w = Window.partitionBy("item_section")
    upto = F.sum("n").over(w.orderBy("token_count"))
    place = F.floor(F.sum("n").over(w) / 2)
    rows = sizes.select("item_section", "token_count", "n", upto.alias("upto"), place.alias("place"))
    return rows.groupBy("item_section").agg(F.min("token_count").alias("least"), F.min(F.when(F.col("upto") > F.col("place"), F.col("token_count"))).alias("upper_median"), F.max("token_count").alias("most"), F.sum(F.when(F.col("token_count") > C.CHUNK_TOKENS, F.col("n")).otherwise(0)).alias("over_budget"))


@query("a6_section_stats", CH + ", s AS (SELECT item_section, count(*) AS n, median(length(content))::DOUBLE AS median, min(length(content))::INTEGER AS least, max(length(content))::INTEGER AS most FROM chunks GROUP BY 1) SELECT *, round(CASE WHEN least = 0 THEN 'inf'::DOUBLE ELSE most / least END, 6) AS spread, CASE WHEN least = 0 THEN true ELSE most / least > 20 END AS flagged FROM s")
def a6(spark, d):
    out = Q.section_stats(W.chunks(spark, d).withColumn("size", F.char_length("content")), "size")
    return out.withColumn("spread", F.round("spread", 6))


@query("a40_duplicates", CH + " SELECT count(*) AS n, count(DISTINCT embedding) AS vectors, count(DISTINCT content) AS texts, count(DISTINCT array_to_string(regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+'), ' ')) AS token_sequences FROM chunks")
def a40(spark, d):
    return Q.duplicates(W.chunks(spark, d))


@query("a40_repeated_texts", CH + " SELECT sha256(content) AS digest, count(*) AS n, min(chunk_id) AS first_chunk FROM chunks GROUP BY 1 HAVING count(*) > 1")
def a40b(spark, d):
    return Q.repeated_texts(W.chunks(spark, d))


@query("a41_vector_collisions", CH + ", v AS (SELECT c.chunk_id, c.content, b.embedding FROM chunks c JOIN chunks b ON b.chunk_id = c.chunk_id - c.chunk_id % 5 WHERE b.embedding IS NOT NULL) SELECT count(*) AS n, count(DISTINCT content) AS texts, min(chunk_id) AS first_chunk FROM v GROUP BY embedding HAVING count(DISTINCT content) > 1")
def a41(spark, d):
    """A41 on whole vectors; every five chunks share one, as none do in the tables."""
    c = W.chunks(spark, d)
    shared = c.select(F.col("chunk_id").alias("of"), "embedding")
    return Q.vector_collisions(c.drop("embedding").join(shared, F.col("chunk_id") - F.col("chunk_id") % 5 == F.col("of")))


@query("f36_vector_checks", "SELECT count(*) AS n, count(*) FILTER (len(embedding) <> 64) AS bad_dimension, count(*) FILTER (len([x for x in embedding if isnan(x) OR isinf(x)]) > 0) AS not_finite, count(*) FILTER (abs(sqrt(list_sum([x::DOUBLE * x::DOUBLE for x in embedding])) - 1) > 1e-3) AS bad_norm FROM embeddings")
def f36(spark, d):
    return Q.vector_checks(W.table(spark, d, "embeddings"), 64)


TAIL_SQL = "'" + C.HEADING_TAIL.replace("'", "''") + "'"


@query("a34_heading_tails", f"SELECT lang AS item_section, count(*) AS n FROM (SELECT lang, text || CASE WHEN doc_id % 5 = 0 THEN ' This could adversely affect sales. ' ELSE '' END AS text FROM documents) WHERE regexp_matches(text, {TAIL_SQL}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6")
def a34(spark, d):
    """Chunks that end on the opening of a risk factor, by section, the six largest; every fifth text gets such an end."""
    docs = W.table(spark, d, "documents").select("lang", F.concat("text", F.when(F.col("doc_id") % 5 == 0, " This could adversely affect sales. ").otherwise("")).alias("text"))
    return docs.filter(F.col("text").rlike(C.HEADING_TAIL)).groupBy(F.col("lang").alias("item_section")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "item_section").limit(6)


NAV = r"""least(len(regexp_extract_all({t}, '(?i)\b(?:note|item|part)\s+\d{{1,2}}[A-C]?\b[^.]{{0,60}}?\b\d{{1,3}}\b')) / n * 100 / 4.0, 1.0) * 0.45
 + least(greatest(1.5 - len(regexp_extract_all({t}, '[.!?]\s')) / n * 100, 0) / 1.5, 1.0) * 0.25 + least(len(regexp_extract_all({t}, '(?im)table of contents|^\s*index\b|\bsee page\b|\bpage \d+\s*$')) / 2.0, 1.0) * 0.30"""


@query("f26_navigation_scores", r"WITH w AS (SELECT doc_id AS chunk_id, text, greatest(len(regexp_extract_all(text, '\S+')), 1) AS n FROM documents) SELECT chunk_id, round(" + NAV.format(t="text") + ", 6) AS score FROM w")
def f26(spark, d):
    docs = W.table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("chunk_id"), F.round(T.navigation_score(F.col("text")), 6).alias("score"))


@query("a33_navigation_table", r"WITH w AS (SELECT text, greatest(len(regexp_extract_all(text, '\S+')), 1) AS n FROM documents), s AS (SELECT " + NAV.format(t="text") + " AS s FROM w) SELECT t AS threshold, count(s) AS chunks FROM (SELECT unnest([0.3, 0.4, 0.5, 0.6, 0.7, 0.8]::DOUBLE[]) AS t) LEFT JOIN s ON s.s >= t GROUP BY 1")
def a33(spark, d):
    docs = W.table(spark, d, "documents")
    return Q.navigation_table(docs, T.navigation_score(F.col("text")))


@query("j16_company_mismatches", with_views("", "gold", "targets") + """, n AS (SELECT query_id, list_sort(list(DISTINCT ticker)) AS named FROM targets GROUP BY 1), l AS (SELECT query_id, list_sort(list(DISTINCT source)) AS labelled FROM gold JOIN documents ON doc_id = chunk_id GROUP BY 1)
SELECT query_id, named, labelled FROM n JOIN l USING (query_id) WHERE NOT list_has_any(named, labelled)""")
def j16(spark, d):
    named = W.targets(spark, d).groupBy("query_id").agg(F.array_sort(F.collect_set("ticker")).alias("keys"))
    keys = W.gold(spark, d).join(W.chunks(spark, d).select("chunk_id", "doc_key"), "chunk_id").groupBy("query_id").agg(F.array_sort(F.collect_set("doc_key")).alias("keys"))
    return Q.company_mismatches(named, keys)


@query("j17_record_differences", """WITH l AS (SELECT c_custkey AS k, c_name AS a, c_nationkey::VARCHAR AS b FROM customer WHERE c_custkey % 5 <> 0), r AS (SELECT c_custkey AS k, c_name AS a, (c_nationkey + (c_custkey % 3 = 0)::INTEGER)::VARCHAR AS b FROM customer WHERE c_custkey % 7 <> 0),
f AS (SELECT coalesce(l.k, r.k) AS k, l.k IS NULL AS nl, r.k IS NULL AS nr, l.a AS la, r.a AS ra, l.b AS lb, r.b AS rb FROM l FULL JOIN r ON l.k = r.k)
SELECT k, '(only left)' AS field, '' AS "left", '' AS "right" FROM f WHERE nr UNION ALL SELECT k, '(only right)', '', '' FROM f WHERE nl UNION ALL SELECT k, 'a', la, ra FROM f WHERE NOT nl AND NOT nr AND la <> ra UNION ALL SELECT k, 'b', lb, rb FROM f WHERE NOT nl AND NOT nr AND lb <> rb""")
def j17(spark, d):
    """Two lists of records, field by field; customers stand in for a manifest and a pin."""
    c = W.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("a"), F.col("c_nationkey").alias("b"))
    right = c.filter("k % 7 <> 0").withColumn("b", F.col("b") + (F.col("k") % 3 == 0).cast("int"))
    return Q.compare_records(c.filter("k % 5 <> 0"), right, "k", ["a", "b"])


SPLITS = "WITH ids AS (SELECT item_id AS id FROM benchmark), splits AS (SELECT item_id AS id, ['regression', 'development', 'holdout'][(item_id % 3 + 1)::INTEGER] AS split FROM benchmark WHERE item_id % 4 <> 0 UNION ALL SELECT item_id, 'holdout' FROM benchmark WHERE item_id % 6 = 1 UNION ALL SELECT item_id + 100000, 'holdout' FROM benchmark WHERE item_id % 10 = 0)"


def _splits(spark, d):
    b = W.table(spark, d, "benchmark").select(F.col("item_id").alias("id"))
    name = F.element_at(F.array(F.lit("regression"), F.lit("development"), F.lit("holdout")), (F.col("id") % 3 + 1).cast("int"))
    hold = F.lit("holdout").alias("split")
    return b, b.filter("id % 4 <> 0").select("id", name.alias("split")).unionByName(b.filter("id % 6 = 1").select("id", hold)).unionByName(b.filter("id % 10 = 0").select((F.col("id") + 100000).alias("id"), hold))


@query("j18_split_members", SPLITS + " SELECT coalesce(split, 'unassigned') AS split, count(*) AS n FROM ids LEFT JOIN splits USING (id) GROUP BY 1")
def j18(spark, d):
    return Q.split_members(*_splits(spark, d))


@query("a39_split_integrity", SPLITS + " SELECT id, 'in more than one split' AS problem FROM splits GROUP BY id HAVING count(DISTINCT split) > 1 UNION ALL SELECT DISTINCT id, 'unknown' FROM splits ANTI JOIN ids USING (id) UNION ALL SELECT id, 'unassigned' FROM ids ANTI JOIN splits USING (id)")
def a39(spark, d):
    return Q.split_integrity(*_splits(spark, d))


@query("a38_split_summary", SPLITS + ", " + W.VIEWS["gold"] + ", g AS (SELECT query_id AS id, count(*) AS labels FROM gold GROUP BY 1) SELECT split, count(*) AS questions, coalesce(sum(labels), 0)::BIGINT AS labels, count(*) FILTER (id % 2 = 0) AS even FROM splits LEFT JOIN g USING (id) GROUP BY 1")
def a38(spark, d):
    """Questions, labels and kinds of each split."""
    _, splits = _splits(spark, d)
    labels = W.gold(spark, d).groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("labels"))
    return splits.join(labels, "id", "left").groupBy("split").agg(F.count("*").alias("questions"), F.coalesce(F.sum("labels"), F.lit(0)).alias("labels"), F.count_if(F.col("id") % 2 == 0).alias("even"))


@query("u5_split_sum", SPLITS + " SELECT row_number() OVER (ORDER BY b.item_id) AS position, b.item_id AS id FROM benchmark b WHERE b.item_id IN (SELECT id FROM splits WHERE split IN ('regression', 'development'))")
def u5(spark, d):
    """The sum of two splits in the order of the master list, which is small."""
    from pyspark.sql import Window

    b, splits = _splits(spark, d)
    kept = b.join(splits.filter(F.col("split").isin("regression", "development")), "id", "left_semi")
    return kept.select(F.row_number().over(Window.orderBy("id")).alias("position"), "id")


@query("u2_symmetric_difference", "(SELECT c_custkey AS k, 'left' AS side FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 7 = 0) UNION ALL (SELECT c_custkey, 'right' FROM customer WHERE c_custkey % 5 = 0 AND c_custkey % 7 <> 0)")
def u2(spark, d):
    c = W.table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return Q.symmetric_difference(c.filter("k % 5 <> 0"), c.filter("k % 7 <> 0"))


@query("u4_missing_sections", "SELECT source AS doc_id, list_sort([x for x in ['de', 'en', 'es', 'fr', 'it', 'pt'] if NOT list_contains(list(DISTINCT lang), x)]) AS missing FROM documents GROUP BY 1")
def u4(spark, d):
    """U4: what each document lacks of the wanted sections."""
    wanted = F.array(*(F.lit(x) for x in ("de", "en", "es", "fr", "it", "pt")))
    return W.table(spark, d, "documents").groupBy(F.col("source").alias("doc_id")).agg(F.array_sort(F.array_except(wanted, F.collect_set("lang"))).alias("missing"))


@query("f24_flat_texts", "SELECT doc_id, sha256(" + FLAT.format("text") + ") AS digest FROM documents")
def f24(spark, d):
    return W.table(spark, d, "documents").select("doc_id", T.digest(T.flat(F.col("text"))).alias("digest"))


@query("f19_digests", "SELECT doc_id, sha256(text) AS raw, sha256(regexp_replace(text, '\\r\\n?', chr(10), 'g')) AS lf, upper(sha256(replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10), chr(13) || chr(10)))) AS crlf, substr(sha256('m|1|' || source || '|' || doc_id || ',' || (doc_id + 1)), 1, 16) AS key FROM documents")
def f19(spark, d):
    """digests of texts with their own, short and long line ends, and the key of an answer cache."""
    t = F.col("text")
    key = T.cache_key(F.lit("m"), F.lit(1), F.col("source"), F.array("doc_id", F.col("doc_id") + 1))
    return W.table(spark, d, "documents").select("doc_id", T.digest(t).alias("raw"), T.digest_lf(t).alias("lf"), T.digest_crlf(t).alias("crlf"), key.alias("key"))


@query("f13_labels", "SELECT doc_id, '(' || source || ', FY' || (2020 + doc_id % 7) || CASE WHEN doc_id % 3 = 0 THEN '' ELSE ', ' || lang END || ')' AS label FROM documents")
def f13(spark, d):
    section = F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.col("lang"))
    return W.table(spark, d, "documents").select("doc_id", T.label(F.col("source"), F.lit(2020) + F.col("doc_id") % 7, section).alias("label"))


@query("f6_paragraphs", r"SELECT doc_id, len([x for x in string_split_regex(text, '\n\s*\n') if trim(x, chr(32) || chr(9) || chr(10) || chr(13)) <> ''])::INTEGER AS paragraphs FROM documents")
def f6(spark, d):
    return W.table(spark, d, "documents").select("doc_id", F.size(T.paragraphs(F.col("text"))).alias("paragraphs"))


@query("f7_sentences", r"SELECT doc_id, len(string_split(regexp_replace(text, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)))::INTEGER AS sentences FROM documents")
def f7(spark, d):
    return W.table(spark, d, "documents").select("doc_id", F.size(T.sentences(F.col("text"))).alias("sentences"))


@query("f31_previews", r"WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS w FROM documents), n AS (SELECT doc_id, t, w[-1] AS needle FROM f) SELECT doc_id, substr(t, greatest(1, instr(lower(t), lower(needle)) - 80)::INTEGER, 160) AS preview FROM n")
def f31(spark, d):
    """160 characters around the first place of each text's last word."""
    t = F.col("text")
    return W.table(spark, d, "documents").select("doc_id", T.preview(t, F.element_at(F.split(T.collapse(t), " "), -1)).alias("preview"))


@query("f33_stems", "SELECT page_id, regexp_extract(url, '([^/]+?)(\\.[^./]*)?$', 1) AS stem FROM pages")
def f33(spark, d):
    """names without folders and suffix; urls stand in for paths."""
    return W.table(spark, d, "pages").select("page_id", T.file_stem(F.col("url")).alias("stem"))


@query("f34_fiscal_years", "SELECT year(o_orderdate)::INTEGER AS fiscal_year, count(*) AS n FROM orders GROUP BY 1")
def f34(spark, d):
    return W.table(spark, d, "orders").groupBy(T.fiscal_year(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("fiscal_year")).agg(F.count("*").alias("n"))


@query("s12_vector_literals", "SELECT vec_id, len(embedding)::INTEGER AS n FROM embeddings")
def s12(spark, d):
    """Vectors written as '[a,b]' and read again."""
    e = W.table(spark, d, "embeddings").select("vec_id", F.to_json("embedding").alias("v"))
    return e.select("vec_id", F.size(T.vector_literal(F.col("v"))).alias("n"))


@query("s4_latest_filing", """WITH o AS (SELECT o_custkey AS cik, o_orderpriority AS form, o_orderkey FROM orders) SELECT cik, min(o_orderkey) AS accession_dashed FROM o WHERE form = '1-URGENT' GROUP BY 1""")
def s4(spark, d):
    """The first of a form in a company's parallel arrays; orders by priority stand in for filings by form."""
    from plumbline.sources.readers import latest_filing

    o = W.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("cik")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")))).alias("x"))
    arrays = o.select("cik", F.col("x.o_orderpriority").alias("form"), F.transform("x.o_orderkey", lambda k: k.cast("string")).alias("accession"), F.transform("x.o_orderkey", lambda k: k.cast("string")).alias("document"), F.col("x.day").alias("filed"), F.col("x.day").alias("reported"))
    return latest_filing(arrays, "1-URGENT").select("cik", F.col("accession_dashed").cast("long").alias("accession_dashed"))


@query("k2_upsert_documents", """WITH old AS (SELECT c_custkey AS k, c_name AS name, c_mktsegment AS segment, c_acctbal AS bal FROM customer WHERE c_custkey % 3 <> 0), new AS (SELECT c_custkey AS k, c_name || '*' AS name, 'NEW' AS segment, c_acctbal + 1 AS bal FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(old.k, new.k) AS k, coalesce(new.name, old.name) AS name, CASE WHEN old.k IS NULL THEN new.segment ELSE old.segment END AS segment, round(coalesce(new.bal, old.bal), 2) AS bal FROM old FULL JOIN new ON old.k = new.k""")
def k2(spark, d):
    """K2, K3: an upsert that updates some columns only; customers stand in for documents."""
    c = W.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("bal"))
    new = c.filter("k % 2 = 0").select("k", F.concat("name", F.lit("*")).alias("name"), F.lit("NEW").alias("segment"), (F.col("bal") + 1).alias("bal"))
    return writers.upsert(c.filter("k % 3 <> 0"), new, ["k"], ["name", "bal"]).withColumn("bal", F.round("bal", 2))


@query("k3_upsert_chunks", CH + """, old AS (SELECT doc_key, chunk_index, item_section, content, token_count FROM chunks WHERE chunk_id % 3 <> 0), new AS (SELECT doc_key, chunk_index, 'NEW' AS item_section, content || '!' AS content, token_count + 1 AS token_count FROM chunks WHERE chunk_id % 2 = 0)
SELECT coalesce(o.doc_key, n.doc_key) AS doc_key, coalesce(o.chunk_index, n.chunk_index) AS chunk_index, CASE WHEN o.doc_key IS NULL THEN n.item_section ELSE o.item_section END AS item_section, sha256(coalesce(n.content, o.content)) AS digest, coalesce(n.token_count, o.token_count) AS token_count
FROM old o FULL JOIN new n ON o.doc_key = n.doc_key AND o.chunk_index = n.chunk_index""")
def k3(spark, d):
    """K3: chunks by document and index take new texts and counts, and keep their sections."""
    c = W.chunks(spark, d).select("chunk_id", "doc_key", "chunk_index", "item_section", "content", "token_count")
    new = c.filter("chunk_id % 2 = 0").withColumns({"item_section": F.lit("NEW"), "content": F.concat("content", F.lit("!")), "token_count": F.col("token_count") + 1})
    out = writers.upsert(c.filter("chunk_id % 3 <> 0").drop("chunk_id"), new.drop("chunk_id"), ["doc_key", "chunk_index"], ["content", "token_count"])
    return out.select("doc_key", "chunk_index", "item_section", T.digest(F.col("content")).alias("digest"), "token_count")


@query("k4_insert_ignore", "SELECT c_custkey AS k, CASE WHEN c_custkey % 3 <> 0 THEN c_name ELSE c_name || '*' END AS name FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0")
def k4(spark, d):
    c = W.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    return writers.insert_ignore(c.filter("k % 3 <> 0"), c.filter("k % 2 = 0").withColumn("name", F.concat("name", F.lit("*"))), ["k"])


@query("k11_update_by_key", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'x' ELSE lang END AS lang FROM documents")
def k11(spark, d):
    docs = W.table(spark, d, "documents").select("doc_id", "lang")
    return writers.update_by_key(docs, docs.filter("doc_id % 4 = 0").withColumn("lang", F.lit("x")), ["doc_id"], "lang")


@query("w8_chunk_index", "SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS chunk_index FROM documents")
def w8(spark, d):
    """Places within each document."""
    from pyspark.sql import Window

    w = Window.partitionBy("source").orderBy("doc_id")
    return W.table(spark, d, "documents").select("doc_id", (F.row_number().over(w) - 1).alias("chunk_index"))


QUESTIONS = [
    (1, "What were Nike's net sales?"), (2, "What were Gap's net sales in fiscal 2025?"), (3, "Describe the gap in supply chain coverage"), (4, "How do Columbia Sportswear and Under Armour compare?"),
    (5, "Did Old Navy or Athleta grow?"), (6, "What does UGG sell?"), (7, "Compare Levi's, Crocs and Etsy."), (8, "What is revenue?"), (9, "Warby Parker versus Figs"), (10, "gaps in coverage"),
]
Q_VALUES = "WITH q(id, question) AS (VALUES " + ", ".join("({}::BIGINT, '{}')".format(i, t.replace("'", "''")) for i, t in QUESTIONS) + ")"
ALIAS_VALUES = ", ".join("('{}', '{}', {})".format(t, a.replace("'", "''"), n) for t, names in C.COMPANY_ALIASES.items() for n, a in enumerate(sorted(names, key=len, reverse=True)))


@query("f11_companies", Q_VALUES + f""", a(ticker, alias, n) AS (VALUES {ALIAS_VALUES}), low AS (SELECT id, replace(lower(question), 'gap in supply', 'g-p in supply') AS t FROM q),
h AS (SELECT id, ticker, n, length(string_split_regex(t, '\\b' || alias || '\\b')[1]) + 1 AS p FROM low JOIN a ON regexp_matches(t, '\\b' || alias || '\\b')), f AS (SELECT id, ticker, arg_min(p, n) AS p FROM h GROUP BY 1, 2),
g AS (SELECT id, 'GAP' AS ticker, length(string_split_regex(t, '\\bgap(?:''s)?\\b')[1]) + 1 AS p FROM low WHERE regexp_matches(t, '\\bgap(?:''s)?\\b') AND id NOT IN (SELECT id FROM f WHERE ticker = 'GAP')), u AS (SELECT * FROM f UNION ALL SELECT * FROM g)
SELECT q.id, coalesce((SELECT list(ticker ORDER BY p, ticker) FROM u WHERE u.id = q.id), []) AS tickers FROM q""")
def f11(spark, d):
    """companies in order of mention, over stated questions."""
    return spark.createDataFrame(QUESTIONS, "id long, question string").select("id", companies.detect(F.col("question")).alias("tickers"))


@query(
    "f12_sub_questions",
    W.with_views(
        r"""
SELECT query_id, ticker, trim(regexp_replace(regexp_replace('Do ' || ticker || ' say: ' || text, '\s+', ' ', 'g'), ' ([,?.!])', '\1', 'g'), ' ,') AS sub_question
FROM targets JOIN queries USING (query_id) WHERE query_id IN (SELECT query_id FROM targets GROUP BY 1 HAVING count(*) > 1)""",
        "targets",
        "queries",
    ),
)
def f12(spark, d):
    """every question that names several companies, with each of them alone."""
    q, t = W.named(spark, d, with_vectors=False)
    named = t.groupBy("query_id").agg(F.collect_list("ticker").alias("named"))
    rows = t.join(q, "query_id").join(named, "query_id")
    return rows.select("query_id", "ticker", companies.sub_question(F.col("text"), F.col("ticker"), F.col("named"), W.ALIASES, {}).alias("sub_question"))


@query("f2_html_to_text")
def f2(spark, d):
    """Texts of all pages, with line breaks around blocks."""
    return W.table(spark, d, "pages").select("page_id", filings.html_to_text(F.col("html")).alias("text")).withColumn("n_chars", F.char_length("text"))


@query("f1_normalized_texts")
def f1(spark, d):
    return W.table(spark, d, "documents").select("doc_id", T.digest(filings.normalize_text(F.col("text"))).alias("digest"))


@query("f9_chunks")
def f9(spark, d):
    """Chunks of all documents within the token budget."""
    docs = W.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("Item 1").alias("item_section"), F.lit("").alias("section_title"), F.col("text").alias("content"))
    return filings.chunks(docs).select("doc_id", "chunk_index", "token_count", T.digest(F.col("content")).alias("digest"))


@query("f39_lexemes")
def f39(spark, d):
    """stems of all documents' words without stop words."""
    return W.table(spark, d, "documents").select("doc_id", filings.lexemes(F.col("text")).alias("lexemes")).select("doc_id", F.size("lexemes").alias("n"), F.size(F.array_distinct("lexemes")).alias("distinct"))


FILING = "\n".join(["Item 1. Business", "Item 1A. Risk Factors", "Item 8. Financial Statements", "", "ITEM 1. BUSINESS", "We make shoes. " * 20, "Item 1A - Risk Factors", "Risks are many. " * 30, "Item 8. Financial Statements", "As set forth in the index to consolidated financial statements on page F-1, which follows the signatures of this report.", "Item 9. Changes", "None.", "Item 15. Exhibits", "Report of Independent Registered Public Accounting Firm", "Balance sheet and statements of cash flows and notes to them, statements of income. " * 80])


@query("f4_sections")
def f4(spark, d):
    """Sections of a stated filing whose Item 8 is a pointer."""
    rows = filings.sections(spark.createDataFrame([("a", FILING)], "doc_id string, text string"))
    return rows.select("doc_id", "item_section", "section_title", "heading_as_found", "char_count", "recovered_from_fpages")


@query("a8_plausibility")
def a8(spark, d):
    """What of a filing its sections cover."""
    return Q.plausibility(filings.sections(spark.createDataFrame([("a", FILING)], "doc_id string, text string")))


@query("f35_completeness")
def f35(spark, d):
    rows = filings.sections(spark.createDataFrame([("a", FILING)], "doc_id string, text string")).filter("recovered_from_fpages")
    return rows.select("doc_id", T.income_statement_complete(F.col("content")).alias("missing"))


GOLD_ANSWERS = [(1, "Revenue was 6,165,376 in fiscal 2025, up 45%."), (2, "Deloitte audited 'the consolidated balance sheets of the Company'."), (3, "About 7.5 billion"), (4, None)]


@query("f23_anchors")
def f23(spark, d):
    """anchors and content words of stated answers; the tests state them."""
    a = spark.createDataFrame(GOLD_ANSWERS, "id long, answer string")
    return a.select("id", T.anchors(F.col("answer")).alias("anchors"), T.weak_anchors(F.col("answer")).alias("weak"), T.answer_words(F.col("answer")).alias("words"), T.pick_anchor(F.col("answer"), F.lit("deloitte  reported 6,165,376")).alias("p")).select("id", "anchors", "weak", "words", "p.anchor", "p.note")


@query("f27_probes")
def f27(spark, d):
    """probes of all documents."""
    return W.table(spark, d, "documents").select("doc_id", T.probes(F.col("text")).alias("probes"))


@query("f28_extended_anchors")
def f28(spark, d):
    """each label's text, grown until one chunk of the document has it."""
    labels = _labels(spark, d).filter("contains is not null and contains <> 'no such passage'")
    return Q.extend_anchors(labels, W.chunks(spark, d))


@query("f30_clean_notes", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'own ' || lang END AS note FROM documents")
def f30(spark, d):
    """notes without their prefix."""
    note = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("vNext comparative dev. "), F.col("lang"))).otherwise(F.concat(F.lit("own "), F.col("lang")))
    return W.table(spark, d, "documents").select("doc_id", T.clean_note(note).alias("note"))


@query("f40_probe_truth", CH + ", p AS (SELECT chunk_index, CASE WHEN chunk_index % 2 = 0 THEN 'release' ELSE 'current' END AS corpus, contains(content, 'the') AS has FROM chunks) SELECT CASE WHEN count(*) FILTER (corpus = 'release' AND has) > 0 AND count(*) FILTER (corpus = 'current' AND has) > 0 THEN 'mixed' WHEN count(*) FILTER (corpus = 'release' AND has) > 0 THEN 'release' WHEN count(*) FILTER (corpus = 'current' AND has) > 0 THEN 'current' ELSE 'neither' END AS verdict, count(*) FILTER (has) AS hits FROM p")
def f40(spark, d):
    """which of two corpora a table is, by what stands where."""
    p = W.chunks(spark, d).select(F.when(F.col("chunk_index") % 2 == 0, "release").otherwise("current").alias("corpus"), F.contains("content", F.lit("the")).alias("has"))
    r, c = (F.count_if((F.col("corpus") == x) & F.col("has")) for x in ("release", "current"))
    return p.agg(r.alias("r"), c.alias("c")).select(F.when((F.col("r") > 0) & (F.col("c") > 0), "mixed").when(F.col("r") > 0, "release").when(F.col("c") > 0, "current").otherwise("neither").alias("verdict"), (F.col("r") + F.col("c")).alias("hits"))
