"""The driver's tables as the inputs of the retrieval and evaluation operators.

documents stand in for chunks (natural key: source and doc_id), embeddings
for their vectors and for those of the questions, benchmark items for
questions, containment of an item in a document for gold labels, assistant
turns for generated answers. Each view is stated twice: as a DataFrame and as
SQL, the second for comparison in another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import tokens
from plumbline.operators.joins import holding


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, vectors = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    rows = docs.join(vectors, docs.doc_id == vectors.vec_id, "left")
    return rows.select(
        docs.doc_id.alias("chunk_id"), docs.source.alias("doc_key"), docs.lang.alias("item_section"), docs.doc_id.cast("int").alias("chunk_index"), F.size(tokens(docs.text)).alias("token_count"), docs.text.alias("content"), vectors.embedding.cast("array<double>").alias("embedding")
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as questions; all their distinct tokens are terms."""
    items, vectors = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "embeddings")
    rows = items.join(vectors, items.item_id == vectors.vec_id, "left")
    terms = F.array_sort(F.array_distinct(tokens(items.text)))
    return rows.select(items.item_id.alias("query_id"), items.text, terms.alias("terms"), vectors.embedding.cast("array<double>").alias("qv"))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """None to three companies a question."""
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    n = (F.col("query_id") % 4).cast("int")
    each = q.select("query_id", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))).alias("pos"))
    return each.select("query_id", F.concat(F.lit("src"), ((F.col("query_id") * 7 + F.col("pos") * 3) % 20).cast("string")).alias("ticker"), "pos")


def named(spark: SparkSession, sf_dir: str, with_vectors: bool = True) -> tuple[DataFrame, DataFrame]:
    """Questions that name two companies or more, "Do src1 and src4 say: ...", with terms and vectors by encoder() if wanted, and their targets."""
    t = targets(spark, sf_dir)
    names = t.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "ticker"))).alias("t")).filter(F.size("t") > 1)
    text = F.concat(F.lit("Do "), F.array_join(F.transform("t", lambda x: x["ticker"]), " and "), F.lit(" say: "), F.col("text"))
    q = queries(spark, sf_dir).select("query_id", "text").join(names, "query_id").select("query_id", text.alias("text"))
    if with_vectors:
        q = q.withColumns({"terms": F.array_sort(F.array_distinct(tokens(F.col("text")))), "qv": encoder(spark, sf_dir)(F.col("text"))})
    return q, t.join(names.select("query_id"), "query_id")


def encoder(spark: SparkSession, sf_dir: str) -> Callable[[Column], Column]:
    """A stand-in for an encoder: the sum of pseudo-random vectors of a text's tokens, of the tables' length; null without tokens."""
    one = table(spark, sf_dir, "embeddings").filter("embedding is not null").select(F.size("embedding")).first()
    n = one[0] if one else 1
    at = lambda i, t: (F.pmod(F.xxhash64(t, i), F.lit(2001)) - 1000) / 1000.0
    return lambda text: F.when(F.size(tokens(text)) > 0, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.aggregate(tokens(text), F.lit(0.0), lambda s, t: s + at(i, t))))


#: The names of targets() for rewriting.
ALIASES = {f"src{n}": (f"src{n}",) for n in range(20)}


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold an item's text."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("needle"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return holding(docs, items, F.contains("text", "needle"), text="text").join(items, "needle").select("query_id", "chunk_id")


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers: a conversation is a question, its assistant turns are runs. What
    models would have said of them is taken from the turns' lengths."""
    t = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    n = F.char_length("text")
    verdict = F.element_at(F.array(*(F.lit(x) for x in ("CORRECT", "PARTIALLY_CORRECT", "INCORRECT", "JUDGE_ERROR", "CORRECT"))), n % 5 + 1)
    kinds = [F.lit(x) for x in ("extractive", "multi_chunk", "comparative", "unanswerable_absent", "extractive", "multi_chunk", "comparative", "unanswerable_adversarial")]
    kind = F.element_at(F.array(*kinds), (F.col("conv_id") % 8 + 1).cast("int"))
    labelled = F.col("conv_id") % 6 < 5
    return t.select(
        F.col("conv_id").alias("id"), F.col("turn").alias("run"), kind.alias("type"), (F.col("conv_id") % 4 < 3).alias("answerable"), "text", (n % 7 < 2).alias("refused"), verdict.alias("verdict"),
        (n % 4).cast("int").alias("n_cited"), (n % 6).cast("int").alias("supported"), (n % 3).cast("int").alias("unsupported"), (n % 2).cast("int").alias("judge_errors"), labelled.alias("gold_labelled"), (labelled & (n % 5 < 3)).alias("gold_retrieved"),
    )


#: The same views as common table expressions.
VIEWS = {
    "chunks": """chunks AS (SELECT d.doc_id AS chunk_id, d.source AS doc_key, d.lang AS item_section, d.doc_id::INTEGER AS chunk_index, len(regexp_extract_all(lower(d.text), '[\\p{L}\\p{N}]+'))::INTEGER AS token_count,
  d.text AS content, e.embedding::DOUBLE[] AS embedding FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id)""",
    "queries": """queries AS (SELECT b.item_id AS query_id, b.text, list_sort(list_distinct(regexp_extract_all(lower(b.text), '[\\p{L}\\p{N}]+'))) AS terms, e.embedding::DOUBLE[] AS qv
  FROM benchmark b LEFT JOIN embeddings e ON e.vec_id = b.item_id)""",
    "targets": """targets AS (SELECT item_id AS query_id, 'src' || ((item_id * 7 + p * 3) % 20)::VARCHAR AS ticker, p::INTEGER AS pos FROM benchmark, range(3) r(p) WHERE p < item_id % 4)""",
    "gold": """gold AS (SELECT b.item_id AS query_id, d.doc_id AS chunk_id FROM documents d JOIN benchmark b ON contains(d.text, b.text))""",
    "gen": """gen AS (SELECT conv_id AS id, turn AS run, ['extractive', 'multi_chunk', 'comparative', 'unanswerable_absent', 'extractive', 'multi_chunk', 'comparative', 'unanswerable_adversarial'][(conv_id % 8 + 1)::INTEGER] AS type, conv_id % 4 < 3 AS answerable, text,
  length(text) % 7 < 2 AS refused, ['CORRECT', 'PARTIALLY_CORRECT', 'INCORRECT', 'JUDGE_ERROR', 'CORRECT'][(length(text) % 5 + 1)::INTEGER] AS verdict, (length(text) % 4)::INTEGER AS n_cited,
  (length(text) % 6)::INTEGER AS supported, (length(text) % 3)::INTEGER AS unsupported, (length(text) % 2)::INTEGER AS judge_errors, conv_id % 6 < 5 AS gold_labelled, conv_id % 6 < 5 AND length(text) % 5 < 3 AS gold_retrieved FROM conversations WHERE role = 'assistant')""",
    "q1": """q1 AS (SELECT q.query_id, q.qv, q.terms, len(q.terms) AS wanted, t.ticker, coalesce(t.pos, 0) AS pos FROM queries q LEFT JOIN targets t USING (query_id))""",
    "q0": """q0 AS (SELECT query_id, qv, terms, len(terms) AS wanted, NULL::VARCHAR AS ticker, 0 AS pos FROM queries)""",
    "matches": """tok AS (SELECT chunk_id, doc_key, unnest(regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+')) AS token FROM chunks),
term AS (SELECT query_id, unnest(terms) AS token FROM queries),
tfs AS (SELECT query_id, chunk_id, doc_key, token, count(*) AS tf FROM tok JOIN term USING (token) GROUP BY ALL),
matches AS (SELECT query_id, chunk_id, doc_key, count(*) AS n_terms, round(sum(ln(1 + tf)), 9) AS lex_score FROM tfs GROUP BY ALL)""",
    "modes": """modes AS (SELECT q.query_id, len(q.terms)::INTEGER AS wanted, count(m.chunk_id) FILTER (m.n_terms = len(q.terms)) AS and_hits, count(m.chunk_id) AS or_hits,
  CASE WHEN count(m.chunk_id) FILTER (m.n_terms = len(q.terms)) >= 5 THEN 'AND' ELSE 'OR' END AS mode FROM queries q LEFT JOIN matches m USING (query_id) GROUP BY ALL)""",
}


def with_views(sql: str, *names: str) -> str:
    return "WITH " + ",\n".join(VIEWS[n] for n in names) + sql


def sem_sql(name: str, q: str, pool: int) -> str:
    return f"""{name} AS (SELECT * FROM (SELECT q.query_id, q.ticker, q.pos, c.chunk_id, round(list_cosine_similarity(c.embedding, q.qv), 9) AS score,
  row_number() OVER (PARTITION BY q.query_id, q.ticker, q.pos ORDER BY round(list_cosine_similarity(c.embedding, q.qv), 9) DESC, c.chunk_id) AS rank
  FROM {q} q JOIN chunks c ON c.embedding IS NOT NULL AND q.qv IS NOT NULL AND (q.ticker IS NULL OR q.ticker = c.doc_key)) WHERE rank <= {pool})"""


def kw_sql(name: str, q: str, pool: int, mode: str = "m.mode") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT q.query_id, q.ticker, q.pos, h.chunk_id, h.lex_score AS score,
  row_number() OVER (PARTITION BY q.query_id, q.ticker, q.pos ORDER BY h.lex_score DESC, h.chunk_id) AS rank
  FROM {q} q JOIN modes m USING (query_id) JOIN matches h USING (query_id)
  WHERE ({mode} = 'OR' OR h.n_terms = q.wanted) AND (q.ticker IS NULL OR q.ticker = h.doc_key)) WHERE rank <= {pool})"""


def rrf_sql(name: str, sem: str, kw: str, k: int, rrf_k: int = 40) -> str:
    return f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, ticker, pos ORDER BY score DESC, chunk_id) AS rank FROM (
  SELECT coalesce(s.query_id, k.query_id) AS query_id, coalesce(s.ticker, k.ticker) AS ticker, coalesce(s.pos, k.pos) AS pos, coalesce(s.chunk_id, k.chunk_id) AS chunk_id,
  coalesce(1.0::DOUBLE / ({rrf_k} + s.rank), 0) + coalesce(1.0::DOUBLE / ({rrf_k} + k.rank), 0) AS score, s.rank AS semantic_rank, k.rank AS keyword_rank
  FROM {sem} s FULL JOIN {kw} k ON s.query_id = k.query_id AND s.pos = k.pos AND s.chunk_id = k.chunk_id)) WHERE rank <= {k})"""


def interleave_sql(name: str, hits: str, k: int) -> str:
    return f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bucket_rank, pos) AS rank FROM (
  SELECT * EXCLUDE (rank), rank AS bucket_rank, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY rank, pos) AS seen FROM (
    SELECT h.*, CASE WHEN n.n IS NULL THEN {k} ELSE greatest(1, {k} // n.n) END AS quota FROM {hits} h LEFT JOIN (SELECT query_id, count(DISTINCT pos) AS n FROM targets GROUP BY 1) n USING (query_id)) WHERE rank <= quota) WHERE seen = 1)
  WHERE rank <= {k})"""
