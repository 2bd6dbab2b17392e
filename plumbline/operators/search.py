"""Batch retrieval: every function takes all questions at once.

queries: query_id, text, terms array<string>, qv array<double>.
targets: query_id, ticker, pos: the companies a question names, in order; a
question without a row there searches everything.
Hits are long tables (query_id, rank, chunk_id, score, ...). Ties end with the
smaller chunk_id. Only ids are ranked and fused; texts are joined last."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline import config as C
from plumbline.functions.text import tokens
from plumbline.operators.joins import holding, is_small, lookup, lookup_if

KEYS = ["query_id", "ticker", "pos"]
#: About as many (question, company) rows are broadcast at once; more are searched in several blocks.
BATCH = 2_000


def with_targets(queries: DataFrame, targets: DataFrame | None) -> DataFrame:
    """One row per question and company, with a null company where none is named."""
    if targets is None:
        return queries.withColumns({"ticker": F.lit(None).cast("string"), "pos": F.lit(0)})
    return queries.join(targets, "query_id", "left").withColumn("pos", F.coalesce("pos", F.lit(0)))


def restricted(chunks: DataFrame, sections: list[str] | None = None, tickers: list[str] | None = None) -> DataFrame:
    """Section and company restrictions together; none where a list is empty."""
    for column, values in (("item_section", sections), ("doc_key", tickers)):
        if values:
            chunks = chunks.filter(F.col(column).isin(*values))
    return chunks


def ranked(hits: DataFrame, keys: list[str], k: int, score: str = "score") -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col("chunk_id").asc())
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def semantic(chunks: DataFrame, queries: DataFrame, k: int, targets: DataFrame | None = None) -> DataFrame:
    """Exact nearest chunks by cosine similarity, in (query, company) groups.

    The questions go to the executors as one matrix, or, beyond BATCH rows, in
    blocks dealt by hash, each with its own pass over the vectors; a batch of
    vectors is multiplied with it and only its own k best of each group leave
    the task, so the shuffle doesn't grow with the vectors. Chunks without a
    vector can't be found; similarities that agree to nine decimals are ties."""
    asked = with_targets(queries, targets).select(*KEYS, "qv").filter("qv is not null")
    first = asked.limit(BATCH + 1).toPandas()
    if len(first) <= BATCH:
        return ranked(_nearest(chunks, first, k), KEYS, k)
    blocks = -(-asked.count() // BATCH)
    found = (_nearest(chunks, asked.filter(F.pmod(F.xxhash64(*KEYS), F.lit(blocks)) == b).toPandas(), k) for b in range(blocks))
    return ranked(reduce(DataFrame.unionAll, found), KEYS, k)


def _nearest(chunks: DataFrame, asked: pd.DataFrame, k: int) -> DataFrame:
    """The k nearest chunks of each batch of vectors to each row of asked, unranked."""
    shared = chunks.sparkSession.sparkContext.broadcast(asked)

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q = shared.value
        if not len(q):
            return
        matrix = np.array(q["qv"].tolist(), dtype=np.float64)
        matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
        for pdf in batches:
            if not len(pdf):
                continue
            ids, docs = pdf["chunk_id"].to_numpy(), pdf["doc_key"].to_numpy()
            vectors = np.array(pdf["embedding"].tolist(), dtype=np.float64)
            scores = np.round((vectors / np.linalg.norm(vectors, axis=1, keepdims=True)) @ matrix.T, 9)
            out = []
            for i, (query, ticker, pos) in enumerate(zip(q["query_id"], q["ticker"], q["pos"], strict=True)):
                at = np.arange(len(ids)) if ticker is None else np.flatnonzero(docs == ticker)
                at = at[np.lexsort((ids[at], -scores[at, i]))[:k]]
                out.append(pd.DataFrame({"query_id": query, "ticker": ticker, "pos": pos, "chunk_id": ids[at], "score": scores[at, i]}))
            yield pd.concat(out)

    rows = chunks.filter("embedding is not null").select("chunk_id", "doc_key", "embedding")
    return rows.mapInPandas(best, "query_id long, ticker string, pos int, chunk_id long, score double")


def postings(chunks: DataFrame) -> DataFrame:
    """(token, chunk_id, doc_key, tf). Written once and bucketed by token where questions come often."""
    return chunks.select("chunk_id", "doc_key", F.explode(tokens(F.col("content"))).alias("token")).groupBy("token", "chunk_id", "doc_key").agg(F.count("*").alias("tf"))


def few_terms(queries: DataFrame, targets: DataFrame | None = None) -> bool:
    """Can all terms, questions and companies be broadcast? By a count of terms and of (question, company) rows."""
    return is_small(queries.select(F.explode(F.array_distinct("terms")))) and is_small(with_targets(queries.select("query_id"), targets))


def matches(chunks: DataFrame, queries: DataFrame, analyze: Callable[[Column], Column] = tokens, few: bool | None = None) -> DataFrame:
    """(query_id, chunk_id, doc_key, n_terms, lex_score): chunks with any term.
    analyze makes terms of a chunk's text as the questions' terms were made;
    filings.lexemes gives stems without stop words.
    Each chunk goes to one task and its terms are counted there once, whatever the
    number of questions that share them; nothing is shuffled after that.
    lex_score is the sum of ln(1 + tf) to nine decimals: frequency counts, rarity doesn't."""
    terms = queries.select("query_id", F.explode(F.array_distinct("terms")).alias("token"))
    few = is_small(terms) if few is None else few
    rows = chunks.select("chunk_id", "doc_key", "content").repartition("chunk_id")
    each = rows.select("chunk_id", "doc_key", F.explode(analyze(F.col("content"))).alias("token")).join(lookup_if(few, terms.select("token").distinct()), "token", "left_semi")
    tf = each.groupBy("chunk_id", "doc_key", "token").agg(F.count("*").alias("tf")).join(lookup_if(few, terms), "token")
    return tf.groupBy("query_id", "chunk_id", "doc_key").agg(F.count("*").alias("n_terms"), F.round(F.sum(F.log1p("tf")), 9).alias("lex_score"))


def keyword_modes(found: DataFrame, queries: DataFrame, least: int = C.KEYWORD_MIN_AND_HITS, few: bool | None = None) -> DataFrame:
    """(query_id, wanted, and_hits, or_hits, mode): all terms if enough chunks
    have them, else any. The count follows sections but not companies."""
    wanted = queries.select("query_id", F.size(F.array_distinct("terms")).alias("wanted"))
    counts = found.join(lookup_if(is_small(wanted) if few is None else few, wanted), "query_id").groupBy("query_id").agg(F.count_if(F.col("n_terms") == F.col("wanted")).alias("and_hits"), F.count("*").alias("or_hits"))
    out = wanted.join(counts, "query_id", "left").na.fill(0, ["and_hits", "or_hits"])
    return out.withColumn("mode", F.when(F.col("and_hits") >= least, "AND").otherwise("OR"))


def keyword(chunks: DataFrame, queries: DataFrame, k: int, targets: DataFrame | None = None, mode: str | None = None, found: DataFrame | None = None, few: bool | None = None) -> DataFrame:
    """Best chunks by terms, in (query, company) groups; mode forces AND or OR.
    found: matches() of the same, if at hand or if terms aren't tokens; few: few_terms() of the same."""
    few = few_terms(queries, targets) if few is None else few
    found = matches(chunks, queries, few=few) if found is None else found
    modes = keyword_modes(found, queries, few=few).withColumn("mode", F.lit(mode) if mode else F.col("mode"))
    hits = found.join(lookup_if(few, modes.select("query_id", "wanted", "mode")), "query_id").filter("mode = 'OR' or n_terms = wanted")
    groups = with_targets(queries.select("query_id"), targets)
    hits = hits.join(lookup_if(few, groups), "query_id").filter("ticker is null or ticker = doc_key")
    return ranked(hits.select(*KEYS, "chunk_id", F.col("lex_score").alias("score")), KEYS, k)


def fuse(sem: DataFrame, kw: DataFrame, k: int, rrf_k: Column | int = C.RRF_K, extra: tuple[str, ...] = ()) -> DataFrame:
    """Reciprocal rank fusion of two pools of ids; a missing side adds nothing."""
    keys = [*KEYS, *extra]
    side = lambda df, name: df.select(*keys, "chunk_id", F.col("rank").alias(name))
    # A union and one aggregation instead of a full outer join: null companies group, and partial sums shuffle less.
    both = side(sem, "semantic_rank").withColumn("keyword_rank", F.lit(None).cast("int")).unionByName(side(kw, "keyword_rank").withColumn("semantic_rank", F.lit(None).cast("int")))
    one = both.groupBy(*keys, "chunk_id").agg(F.max("semantic_rank").alias("semantic_rank"), F.max("keyword_rank").alias("keyword_rank"))
    part = lambda c: F.coalesce(F.lit(1.0) / (F.col(c) + rrf_k).cast("double"), F.lit(0.0))
    return ranked(one.withColumn("score", part("semantic_rank") + part("keyword_rank")), keys, k)


def hybrid(chunks: DataFrame, queries: DataFrame, k: int = C.RETRIEVAL_TOP_K, pool: int = C.RETRIEVAL_POOL, rrf_k: int = C.RRF_K, targets: DataFrame | None = None, mode: str | None = None) -> DataFrame:
    return fuse(semantic(chunks, queries, pool, targets), keyword(chunks, queries, pool, targets, mode), k, rrf_k)


def interleave(hits: DataFrame, targets: DataFrame, k: int = C.RETRIEVAL_TOP_K) -> DataFrame:
    """Company lists of a question as one: k div n of each (at least 1), first all
    first places in order of mention, then all second; a chunk counts once. The
    rest of the division is left out, so three companies fill 15 of 16 places."""
    quotas = targets.groupBy("query_id").agg(F.greatest(F.floor(F.lit(k) / F.count_distinct("pos")), F.lit(1)).alias("quota"))
    kept = hits.join(lookup(quotas), "query_id", "left").filter(F.col("rank") <= F.coalesce("quota", F.lit(k)))
    first = Window.partitionBy("query_id", "chunk_id").orderBy("rank", "pos")
    once = kept.withColumn("seen", F.row_number().over(first)).filter("seen = 1").drop("seen", "quota")
    order = Window.partitionBy("query_id").orderBy("bucket_rank", "pos")
    return once.withColumnRenamed("rank", "bucket_rank").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(chunks: DataFrame, queries: DataFrame, targets: DataFrame, k: int = C.RETRIEVAL_TOP_K, **options) -> DataFrame:
    return interleave(hybrid(chunks, queries, k, targets=targets, **options), targets, k)


def sub_queries(queries: DataFrame, targets: DataFrame, rewrite: Callable[[Column, Column, Column], Column], encode: Callable[[Column], Column]) -> DataFrame:
    """One row per question and company: rewrite(text, ticker, all tickers of the question), its terms and its vector."""
    named = targets.groupBy("query_id").agg(F.array_sort(F.collect_set("ticker")).alias("named"))
    each = queries.select("query_id", "text").join(targets, "query_id").join(named, "query_id")
    each = each.select(*KEYS, rewrite(F.col("text"), F.col("ticker"), F.col("named")).alias("text"))
    return each.withColumns({"terms": F.array_sort(F.array_distinct(tokens(F.col("text")))), "qv": encode(F.col("text"))})


def decomposed(chunks: DataFrame, queries: DataFrame, targets: DataFrame, rewrite: Callable[[Column, Column, Column], Column], encode: Callable[[Column], Column], k: int = C.RETRIEVAL_TOP_K, **options) -> DataFrame:
    """search() with a question of its own for each company. Questions without a company aren't searched."""
    subs = sub_queries(queries, targets, rewrite, encode)
    width = (targets.agg(F.max("pos")).first()[0] or 0) + 1
    sub_id = (F.col("query_id") * width + F.col("pos")).alias("query_id")
    hits = hybrid(chunks, subs.select(sub_id, "text", "terms", "qv"), k, targets=targets.select(sub_id, "ticker", "pos"), **options)
    return interleave(hits.withColumn("query_id", F.expr(f"(query_id - pos) div {width}")), targets, k)


def pools(chunks: DataFrame, queries: DataFrame, targets: DataFrame, pool: int = C.RETRIEVAL_POOL) -> dict[str, DataFrame]:
    """The ranked pools that all strategies draw on, without and with companies. Each is one plan, so that Spark makes its shuffle once however many strategies use it."""
    few = few_terms(queries, targets)
    found = matches(chunks, queries, few=few)
    return {
        "semantic": semantic(chunks, queries, pool), "keyword": keyword(chunks, queries, pool, found=found, few=few), "keyword or": keyword(chunks, queries, pool, mode="OR", found=found, few=few),
        "semantic by company": semantic(chunks, queries, pool, targets), "keyword by company": keyword(chunks, queries, pool, targets, found=found, few=few),
    }


def _first(hits: DataFrame, k: int) -> DataFrame:
    return hits.filter(F.col("rank") <= k)


#: Strategies as functions of pools(), targets and k.
STRATEGIES = {
    "semantic": lambda p, t, k: _first(p["semantic"], k),
    "keyword": lambda p, t, k: _first(p["keyword"], k),
    "hybrid": lambda p, t, k: fuse(p["semantic"], p["keyword"], k),
    "hybrid+company": lambda p, t, k: interleave(fuse(p["semantic by company"], p["keyword by company"], k), t, k),
    "keyword+company": lambda p, t, k: interleave(_first(p["keyword by company"], k), t, k),
    "SABOTAGE starved": lambda p, t, k: fuse(_first(p["semantic"], 1), _first(p["keyword"], 1), 1),
    "SABOTAGE no-company": lambda p, t, k: fuse(p["semantic"], p["keyword"], k),
    "SABOTAGE or-keyword": lambda p, t, k: fuse(p["semantic"], p["keyword or"], k),
}


def run_strategies(chunks: DataFrame, queries: DataFrame, targets: DataFrame, k: int = C.RETRIEVAL_TOP_K, names: tuple[str, ...] = tuple(STRATEGIES)) -> DataFrame:
    """(strategy, query_id, rank, chunk_id) of several strategies."""
    shared = pools(chunks, queries, targets)
    hits = (STRATEGIES[name](shared, targets, k).select(F.lit(name).alias("strategy"), "query_id", "rank", "chunk_id") for name in names)
    return reduce(DataFrame.unionByName, hits)


def sweep(chunks: DataFrame, queries: DataFrame, values: tuple[int, ...] = C.RRF_SWEEP, k: int = C.RETRIEVAL_TOP_K, pool: int = C.RETRIEVAL_POOL) -> DataFrame:
    """hybrid for several rrf_k; the pools are found once and repeated by the list of values."""
    each = lambda df: df.withColumn("rrf_k", F.explode(F.array(*(F.lit(v) for v in values))))
    return fuse(each(semantic(chunks, queries, pool)), each(keyword(chunks, queries, pool)), k, F.col("rrf_k"), ("rrf_k",))


def rerank(hits: DataFrame, chunks: DataFrame, queries: DataFrame, scorer, k: int = C.RETRIEVAL_TOP_K) -> DataFrame:
    """Hits in the order of scorer(question text, chunk text) -> Column; within (query, company) groups, which interleave() makes one list."""
    pairs = hits.select(*KEYS, "chunk_id").join(chunks.select("chunk_id", "content"), "chunk_id").join(lookup(queries.select("query_id", "text"), 20_000), "query_id")
    return ranked(pairs.select(*KEYS, "chunk_id", scorer(F.col("text"), F.col("content")).alias("score")), KEYS, k)


def overlap_scorer(question: Column, content: Column) -> Column:
    """Share of the question's tokens that the chunk has: a scorer that needs no model."""
    asked = F.array_distinct(tokens(question))
    return F.size(F.array_intersect(asked, tokens(content))) / F.greatest(F.size(asked), F.lit(1))


def literal(chunks: DataFrame, needles: DataFrame, k: int = 48) -> DataFrame:
    """Chunks whose text is like %needle%, case ignored, wildcards kept; by chunk_id. needles: query_id, needle."""
    like = F.ilike(F.col("content"), F.concat(F.lit("%"), F.col("needle"), F.lit("%")))
    hits = holding(chunks, needles, like).join(needles, "needle")
    order = Window.partitionBy("query_id").orderBy("chunk_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "chunk_id")
