"""Registered queries: retrieval and its evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import config as C
from plumbline.functions import companies, filings
from plumbline.functions.text import flat
from plumbline.operators import metrics as M
from plumbline.operators import search as S
from plumbline.operators.joins import holding
from plumbline.plans import workload as W
from plumbline.plans.workload import interleave_sql, kw_sql, rrf_sql, sem_sql, with_views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
K, POOL = C.RETRIEVAL_TOP_K, C.RETRIEVAL_POOL


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _in(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return W.chunks(spark, d), W.queries(spark, d), W.targets(spark, d)


def _scored(hits: DataFrame) -> DataFrame:
    return hits.withColumn("score", F.round("score", 6))


SEM0 = with_views(", " + sem_sql("sem", "q0", POOL), "chunks", "queries", "q0")
KW0 = with_views(", " + sem_sql("sem", "q0", POOL) + ", " + kw_sql("kw", "q0", POOL), "chunks", "queries", "q0", "matches", "modes")
RRF0 = KW0 + ", " + rrf_sql("hyb", "sem", "kw", K)


@query("t1_semantic_topk", with_views(", " + sem_sql("sem", "q0", K), "chunks", "queries", "q0") + " SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM sem")
def t1(spark, d):
    """Nearest chunks of every question."""
    c, q, _ = _in(spark, d)
    return _scored(S.semantic(c, q, K)).select("query_id", "rank", "chunk_id", "score")


@query("t2_keyword_topk", with_views(", " + kw_sql("kw", "q0", K), "chunks", "queries", "q0", "matches", "modes") + " SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM kw")
def t2(spark, d):
    """Chunks by terms, all or any."""
    c, q, _ = _in(spark, d)
    return _scored(S.keyword(c, q, K)).select("query_id", "rank", "chunk_id", "score")


@query("t3_hybrid_rrf", RRF0 + " SELECT query_id, rank, chunk_id, round(score, 6) AS score, semantic_rank, keyword_rank FROM hyb")
def t3(spark, d):
    """Both pools fused by reciprocal ranks; the flagship."""
    c, q, _ = _in(spark, d)
    return _scored(S.hybrid(c, q)).select("query_id", "rank", "chunk_id", "score", "semantic_rank", "keyword_rank")


@query("j1_hits_with_text", RRF0 + " SELECT query_id, rank, chunk_id, doc_key, item_section, length(content)::BIGINT AS n_chars FROM hyb JOIN chunks USING (chunk_id)")
def j1(spark, d):
    """The fused ids joined with their chunks at the end."""
    c, q, _ = _in(spark, d)
    hits = S.hybrid(c, q).select("query_id", "rank", "chunk_id")
    return hits.join(c, "chunk_id").select("query_id", "rank", "chunk_id", "doc_key", "item_section", F.char_length("content").cast("long").alias("n_chars"))


KW1 = with_views(", " + sem_sql("sem", "q1", POOL) + ", " + kw_sql("kw", "q1", POOL), "chunks", "queries", "targets", "q1", "matches", "modes")


@query("t4_search", KW1 + ", " + rrf_sql("hyb", "sem", "kw", K) + ", " + interleave_sql("hits", "hyb", K) + " SELECT query_id, rank, chunk_id, ticker, bucket_rank FROM hits")
def t4(spark, d):
    """A fused list per company, interleaved under quotas."""
    c, q, t = _in(spark, d)
    return S.search(c, q, t).select("query_id", "rank", "chunk_id", "ticker", "bucket_rank")


@query("t5_keyword_company", with_views(", " + kw_sql("kw", "q1", K) + ", " + interleave_sql("hits", "kw", K), "chunks", "queries", "targets", "q1", "matches", "modes") + " SELECT query_id, rank, chunk_id, ticker FROM hits")
def t5(spark, d):
    c, q, t = _in(spark, d)
    return S.interleave(S.keyword(c, q, K, t), t).select("query_id", "rank", "chunk_id", "ticker")


#: The strategies' hits as SQL: each pool and list under its own name.
STRATEGY_SQL = (
    with_views("", "chunks", "queries", "targets", "q0", "q1", "matches", "modes")
    + ", " + ", ".join([
        sem_sql("s0", "q0", POOL), kw_sql("k0", "q0", POOL), rrf_sql("h0", "s0", "k0", K), sem_sql("s1", "q1", POOL), kw_sql("k1", "q1", POOL), rrf_sql("h1", "s1", "k1", K), interleave_sql("i1", "h1", K),
        interleave_sql("ik", "(SELECT * FROM k1 WHERE rank <= 16)", K), sem_sql("sx", "q0", 1), kw_sql("kx", "q0", 1), rrf_sql("hx", "sx", "kx", 1), kw_sql("ko", "q0", POOL, "'OR'"), rrf_sql("ho", "s0", "ko", K),
        """hits AS (SELECT 'semantic' AS strategy, query_id, rank, chunk_id FROM s0 WHERE rank <= 16 UNION ALL SELECT 'keyword', query_id, rank, chunk_id FROM k0 WHERE rank <= 16
  UNION ALL SELECT 'hybrid', query_id, rank, chunk_id FROM h0 UNION ALL SELECT 'hybrid+company', query_id, rank, chunk_id FROM i1 UNION ALL SELECT 'keyword+company', query_id, rank, chunk_id FROM ik
  UNION ALL SELECT 'SABOTAGE starved', query_id, rank, chunk_id FROM hx UNION ALL SELECT 'SABOTAGE no-company', query_id, rank, chunk_id FROM h0 UNION ALL SELECT 'SABOTAGE or-keyword', query_id, rank, chunk_id FROM ho)""",
    ])
)
SCORES_SQL = STRATEGY_SQL + """, asked AS (SELECT query_id, count(DISTINCT chunk_id) AS n_gold FROM gold GROUP BY 1),
scores AS (SELECT n.strategy, a.query_id, a.n_gold, count(DISTINCT g.chunk_id) AS n_found, min(h.rank) FILTER (g.chunk_id IS NOT NULL) AS first_gold_rank,
  CASE WHEN count(g.chunk_id) > 0 THEN 1.0::DOUBLE ELSE 0 END AS hit, coalesce(1.0::DOUBLE / min(h.rank) FILTER (g.chunk_id IS NOT NULL), 0) AS rr, count(DISTINCT g.chunk_id)::DOUBLE / a.n_gold AS coverage
  FROM (SELECT DISTINCT strategy FROM hits) n CROSS JOIN asked a LEFT JOIN hits h ON h.strategy = n.strategy AND h.query_id = a.query_id LEFT JOIN gold g ON g.query_id = h.query_id AND g.chunk_id = h.chunk_id GROUP BY n.strategy, a.query_id, a.n_gold)"""
SCORES_SQL = SCORES_SQL.replace("WITH ", "WITH " + W.VIEWS["gold"] + ",\n", 1)


@query("t6_strategies", STRATEGY_SQL + " SELECT strategy, query_id, rank, chunk_id FROM hits")
def t6(spark, d):
    """Every strategy and its sabotaged forms."""
    return S.run_strategies(*_in(spark, d))


def scores(spark, d):
    return M.score_questions(S.run_strategies(*_in(spark, d)), W.gold(spark, d))


@query("a9_question_scores", SCORES_SQL + " SELECT strategy, query_id, n_gold, n_found, first_gold_rank, hit, rr, coverage FROM scores")
def a9(spark, d):
    """A9, J7, W9."""
    return scores(spark, d)


MEANS_SQL = SCORES_SQL + ", means AS (SELECT strategy, count(*) AS n, avg(hit) AS recall, avg(rr) AS mrr, avg(coverage) AS coverage FROM scores GROUP BY 1)"


@query("a10_strategy_means", MEANS_SQL + " SELECT strategy, n, round(recall, 6) AS recall, round(mrr, 6) AS mrr, round(coverage, 6) AS coverage FROM means")
def a10(spark, d):
    return M.strategy_means(scores(spark, d)).select("strategy", "n", *(F.round(c, 6).alias(c) for c in ("recall", "mrr", "coverage")))


@query("a11_means_by_type", SCORES_SQL + " SELECT strategy, ['extractive', 'multi_chunk', 'comparative'][(query_id % 3 + 1)::INTEGER] AS type, count(*) AS n, round(avg(hit), 6) AS recall, round(avg(rr), 6) AS mrr, round(avg(coverage), 6) AS coverage FROM scores GROUP BY 1, 2")
def a11(spark, d):
    kind = F.element_at(F.array(F.lit("extractive"), F.lit("multi_chunk"), F.lit("comparative")), (F.col("query_id") % 3 + 1).cast("int"))
    return M.strategy_means(scores(spark, d).withColumn("type", kind), "type").select("strategy", "type", "n", *(F.round(c, 6).alias(c) for c in ("recall", "mrr", "coverage")))


@query("a12_rrf_sweep", KW0 + ", " + ", ".join(rrf_sql(f"h{r}", "sem", "kw", K, r) for r in C.RRF_SWEEP) + " " + " UNION ALL ".join(f"SELECT {r} AS rrf_k, query_id, rank, chunk_id FROM h{r}" for r in C.RRF_SWEEP))
def a12(spark, d):
    c, q, _ = _in(spark, d)
    return S.sweep(c, q).select("rrf_k", "query_id", "rank", "chunk_id")


@query("a13_sabotage", MEANS_SQL + " SELECT m.strategy, round(m.recall, 6) AS recall, round(b.recall - m.recall, 6) AS drop, abs(b.recall - m.recall) < 0.01 AS moved_nothing FROM means m, (SELECT recall FROM means WHERE strategy = 'hybrid+company') b WHERE m.strategy LIKE 'SABOTAGE%'")
def a13(spark, d):
    return M.sabotage_deltas(M.strategy_means(scores(spark, d))).select("strategy", F.round("recall", 6).alias("recall"), F.round("drop", 6).alias("drop"), "moved_nothing")


WILSON_SQL = "round(greatest(0, (k / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n)), 6) AS low, round(least(1, (k / n + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n)), 6) AS high"


@query("a23_wilson", SCORES_SQL + f" SELECT strategy, k, n, {WILSON_SQL} FROM (SELECT strategy, sum(hit)::BIGINT AS k, count(*) AS n FROM scores GROUP BY 1)")
def a23(spark, d):
    return M.with_intervals(scores(spark, d)).select("strategy", "k", "n", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("a29_lift", MEANS_SQL + " SELECT max(recall) AS best, max(recall) FILTER (strategy = 'keyword') AS keyword, max(recall) - max(recall) FILTER (strategy = 'keyword') AS lift FROM means")
def a29(spark, d):
    """What the best strategy adds to bare terms."""
    base = F.max(F.when(F.col("strategy") == "keyword", F.col("recall")))
    return M.strategy_means(scores(spark, d)).agg(F.max("recall").alias("best"), base.alias("keyword"), (F.max("recall") - base).alias("lift"))


DEEP_SQL = with_views(", " + ", ".join([sem_sql("sem", "q0", 200), kw_sql("kw", "q0", 200), rrf_sql("deep", "sem", "kw", 200)]), "gold", "chunks", "queries", "q0", "matches", "modes")


@query("a36_reachability", DEEP_SQL + " SELECT CASE WHEN rank <= 16 THEN 'delivered' WHEN rank <= 32 THEN 'near' WHEN rank IS NOT NULL THEN 'deeper' ELSE 'unreachable' END AS bucket, count(*) AS n FROM gold LEFT JOIN deep USING (query_id, chunk_id) GROUP BY 1")
def a36(spark, d):
    """A36, T11."""
    c, q, _ = _in(spark, d)
    return M.reachability(W.gold(spark, d), S.hybrid(c, q, 200, pool=200))


@query("t8_rank_of_gold", DEEP_SQL + " SELECT query_id, chunk_id, CASE WHEN rank <= 100 THEN rank::VARCHAR ELSE 'not in the top 100' END AS place FROM gold LEFT JOIN deep USING (query_id, chunk_id)")
def t8(spark, d):
    """Where labelled chunks stand in the first 100."""
    c, q, _ = _in(spark, d)
    deep = S.hybrid(c, q, 200, pool=200).select("query_id", "chunk_id", "rank")
    place = F.when(F.col("rank") <= 100, F.col("rank").cast("string")).otherwise("not in the top 100")
    return W.gold(spark, d).join(deep, ["query_id", "chunk_id"], "left").select("query_id", "chunk_id", place.alias("place"))


@query("t11_deep_ranks", DEEP_SQL + " SELECT query_id, rank, chunk_id FROM deep")
def t11(spark, d):
    c, q, _ = _in(spark, d)
    return S.hybrid(c, q, 200, pool=200).select("query_id", "rank", "chunk_id")


@query(
    "a37_rank_movement",
    with_views("", "gold", "chunks", "queries", "targets", "q0", "q1", "matches", "modes")
    + ", " + ", ".join([sem_sql("s0", "q0", POOL), kw_sql("k0", "q0", POOL), rrf_sql("h0", "s0", "k0", K), sem_sql("s1", "q1", POOL), kw_sql("k1", "q1", POOL), rrf_sql("h1", "s1", "k1", K), interleave_sql("i1", "h1", K)])
    + """ SELECT CASE WHEN b.rank IS NULL AND a.rank IS NULL THEN 'both absent' WHEN b.rank IS NULL THEN 'better' WHEN a.rank IS NULL THEN 'LOST' WHEN a.rank < b.rank THEN 'better' WHEN a.rank > b.rank THEN 'worse' ELSE 'same' END AS movement, count(*) AS n
  FROM gold g LEFT JOIN h0 b USING (query_id, chunk_id) LEFT JOIN i1 a USING (query_id, chunk_id) GROUP BY 1""",
)
def a37(spark, d):
    """What one list per company does to the gold's ranks."""
    c, q, t = _in(spark, d)
    return M.rank_movement(W.gold(spark, d), S.hybrid(c, q), S.search(c, q, t))


@query("t10_decomposed")
def t10(spark, d):
    """What a question of its own for each company does to the gold's ranks in the first 200, where two or more are named."""
    c, (q, t) = W.chunks(spark, d), W.named(spark, d)
    rewrite = lambda text, keep, named: companies.sub_question(text, keep, named, W.ALIASES, {})
    gold = W.gold(spark, d).join(q.select("query_id"), "query_id", "left_semi")
    return M.rank_movement(gold, S.search(c, q, t, 200), S.decomposed(c, q, t, rewrite, W.encoder(spark, d), 200))


@query("a46_missed", SCORES_SQL + " SELECT strategy, coalesce(list_sort(list(query_id) FILTER (hit = 0)), []) AS missed FROM scores GROUP BY 1")
def a46(spark, d):
    return M.missed(scores(spark, d))


@query("a35_keyword_modes", with_views("", "chunks", "queries", "matches", "modes") + " SELECT query_id, wanted, and_hits, or_hits, mode FROM modes")
def a35(spark, d):
    """Hits of all terms and of any, and which form a question gets."""
    c, q, _ = _in(spark, d)
    return S.keyword_modes(S.matches(c, q), q)


@query("p6_stemmed_keyword")
def p6(spark, d):
    """Whole questions as stems without stop words, searched among those of the chunks."""
    c, q, _ = _in(spark, d)
    q = q.withColumn("terms", F.array_distinct(filings.lexemes(F.col("text"))))
    return S.keyword(c, q, K, found=S.matches(c, q, filings.lexemes)).select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


@query("a44_overlaps", RRF0 + """, s AS (SELECT * FROM sem WHERE rank <= 16), k AS (SELECT * FROM kw WHERE rank <= 16),
u AS (SELECT query_id, chunk_id, max(s) AS s, max(k) AS k, max(h) AS h FROM (SELECT query_id, chunk_id, 1 AS s, 0 AS k, 0 AS h FROM s UNION ALL SELECT query_id, chunk_id, 0, 1, 0 FROM k UNION ALL SELECT query_id, chunk_id, 0, 0, 1 FROM hyb) GROUP BY 1, 2)
SELECT query_id, sum(s * k)::BIGINT AS sem_kw, sum(h * s)::BIGINT AS hyb_sem, sum(h * k)::BIGINT AS hyb_kw, sum(h * (1 - s) * (1 - k))::BIGINT AS only_hyb FROM u GROUP BY 1""")
def a44(spark, d):
    """A44, U1."""
    c, q, _ = _in(spark, d)
    sem, kw = S.semantic(c, q, POOL), S.keyword(c, q, POOL)
    return M.overlaps(sem.filter(F.col("rank") <= K), kw.filter(F.col("rank") <= K), S.fuse(sem, kw, K))


@query("t7_literal_search", """SELECT query_id, rank, chunk_id FROM (SELECT b.item_id AS query_id, d.doc_id AS chunk_id, row_number() OVER (PARTITION BY b.item_id ORDER BY d.doc_id) AS rank
  FROM documents d JOIN benchmark b ON d.text ILIKE '%' || regexp_replace(b.text, ' ', '_') || '%') WHERE rank <= 48""")
def t7(spark, d):
    """Chunks like %text%, the text of each item with a wildcard for its first space."""
    needles = W.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.regexp_replace("text", "^([^ ]*) ", "$1_").alias("needle"))
    return S.literal(W.chunks(spark, d), needles)


@query("p10_flat_containment", r"""SELECT b.item_id AS query_id, count(*) AS n FROM documents d JOIN benchmark b
  ON contains(lower(trim(regexp_replace(d.text, '\s+', ' ', 'g'))), lower(trim(regexp_replace(b.text, '\s+', ' ', 'g')))) GROUP BY 1""")
def p10(spark, d):
    """Literal containment whatever case and white space."""
    docs = W.table(spark, d, "documents").select("doc_id", flat(F.col("text")).alias("body"))
    items = W.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), flat(F.col("text")).alias("needle"))
    return holding(docs, items, F.contains("body", "needle"), "doc_id", "body").join(items, "needle").groupBy("query_id").agg(F.count("*").alias("n"))


OVERLAP_SQL = "len(list_intersect(list_distinct(regexp_extract_all(lower(q.text), '[\\p{L}\\p{N}]+')), regexp_extract_all(lower(c.content), '[\\p{L}\\p{N}]+')))::DOUBLE / greatest(1, len(list_distinct(regexp_extract_all(lower(q.text), '[\\p{L}\\p{N}]+'))))"


def _rerank_sql(hits: str, k: int) -> str:
    return f"rr AS (SELECT * FROM (SELECT h.query_id, h.ticker, h.pos, h.chunk_id, {OVERLAP_SQL} AS score, row_number() OVER (PARTITION BY h.query_id, h.ticker, h.pos ORDER BY {OVERLAP_SQL} DESC, h.chunk_id) AS rank FROM {hits} h JOIN chunks c USING (chunk_id) JOIN queries q USING (query_id)) WHERE rank <= {k})"


@query("t9_rerank_global", KW0 + ", " + rrf_sql("hyb", "sem", "kw", 64) + ", " + _rerank_sql("hyb", K) + " SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM rr")
def t9(spark, d):
    """A fused pool of 64 in the order of a scorer."""
    c, q, _ = _in(spark, d)
    return _scored(S.rerank(S.hybrid(c, q, 64), c, q, S.overlap_scorer)).select("query_id", "rank", "chunk_id", "score")


@query("t9_rerank_bucket", KW1 + ", " + rrf_sql("hyb", "sem", "kw", 32) + ", " + _rerank_sql("hyb", K) + ", " + interleave_sql("hits", "rr", K) + " SELECT query_id, rank, chunk_id, ticker FROM hits")
def t9b(spark, d):
    c, q, t = _in(spark, d)
    return S.interleave(S.rerank(S.hybrid(c, q, 32, targets=t), c, q, S.overlap_scorer), t).select("query_id", "rank", "chunk_id", "ticker")


@query("p2_section_filter", with_views("", "chunks", "queries", "q0").replace("ON e.vec_id = d.doc_id)", "ON e.vec_id = d.doc_id WHERE d.lang IN ('fr', 'de'))") + ", " + sem_sql("sem", "q0", K) + " SELECT query_id, rank, chunk_id FROM sem")
def p2(spark, d):
    """The nearest of two sections; the filter stands before the ranking."""
    c, q, _ = _in(spark, d)
    return S.semantic(S.restricted(c, sections=["fr", "de"]), q, K).select("query_id", "rank", "chunk_id")


@query("p3_company_filter", with_views("", "chunks", "queries", "q0").replace("ON e.vec_id = d.doc_id)", "ON e.vec_id = d.doc_id WHERE d.source IN ('src1', 'src2'))") + ", " + sem_sql("sem", "q0", K) + " SELECT query_id, rank, chunk_id FROM sem")
def p3(spark, d):
    c, q, _ = _in(spark, d)
    return S.semantic(S.restricted(c, tickers=["src1", "src2"]), q, K).select("query_id", "rank", "chunk_id")
