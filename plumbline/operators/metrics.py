"""Evaluation of retrieval and of generated answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline import config as C


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 for an empty whole."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def rate(flag: Column) -> Column:
    """Share of rows where flag holds, 0 without rows."""
    return F.coalesce(F.avg(F.when(flag, 1.0).otherwise(0.0)), F.lit(0.0))


def wilson(k: Column, n: Column, z: float = C.WILSON_Z) -> Column:
    """struct(low, high) of the Wilson score interval, (0, 1) without trials."""
    p, d = k / n, 1 + z * z / n
    centre = p + z * z / (2 * n)
    margin = F.lit(z) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    low, high = F.greatest(F.lit(0.0), (centre - margin) / d), F.least(F.lit(1.0), (centre + margin) / d)
    return F.struct(F.when(n > 0, low).otherwise(0.0).alias("low"), F.when(n > 0, high).otherwise(1.0).alias("high"))


def score_questions(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """(strategy, query_id, n_gold, n_found, first_gold_rank, hit, rr, coverage)
    for each question with gold and each strategy of hits: any-hit recall,
    1 / rank of the first gold chunk, share of the gold found."""
    asked = gold.groupBy("query_id").agg(F.count_distinct("chunk_id").alias("n_gold"))
    found = hits.join(gold.distinct(), ["query_id", "chunk_id"]).groupBy("strategy", "query_id").agg(F.count_distinct("chunk_id").alias("n_found"), F.min("rank").alias("first_gold_rank"))
    every = hits.select("strategy").distinct().crossJoin(F.broadcast(asked))
    out = every.join(found, ["strategy", "query_id"], "left").na.fill(0, ["n_found"])
    return out.select("strategy", "query_id", "n_gold", "n_found", "first_gold_rank", (F.col("n_found") > 0).cast("double").alias("hit"), F.coalesce(1 / F.col("first_gold_rank"), F.lit(0.0)).alias("rr"), ratio(F.col("n_found"), F.col("n_gold")).alias("coverage"))


def strategy_means(scores: DataFrame, *by: str) -> DataFrame:
    return scores.groupBy("strategy", *by).agg(F.count("*").alias("n"), F.avg("hit").alias("recall"), F.avg("rr").alias("mrr"), F.avg("coverage").alias("coverage"))


def sabotage_deltas(means: DataFrame, baseline: str = "hybrid+company") -> DataFrame:
    """What degrading a strategy costs against the baseline; less than a hundredth moved nothing."""
    base = means.filter(F.col("strategy") == baseline).select(F.col("recall").alias("base"))
    out = means.filter(F.col("strategy").startswith("SABOTAGE")).crossJoin(F.broadcast(base))
    drop = F.col("base") - F.col("recall")
    return out.select("strategy", "recall", drop.alias("drop"), (F.abs(drop) < 0.01).alias("moved_nothing"))


def with_intervals(scores: DataFrame) -> DataFrame:
    means = scores.groupBy("strategy").agg(F.sum("hit").cast("long").alias("k"), F.count("*").alias("n"))
    return means.select("strategy", "k", "n", wilson(F.col("k"), F.col("n")).alias("w")).select("strategy", "k", "n", "w.low", "w.high")


def reachability(gold: DataFrame, deep: DataFrame, k: int = C.RETRIEVAL_TOP_K) -> DataFrame:
    """Gold chunks as delivered (rank to k), within 2k, deeper, or unreachable."""
    ranks = gold.join(deep.select("query_id", "chunk_id", "rank"), ["query_id", "chunk_id"], "left")
    bucket = F.when(F.col("rank") <= k, "delivered").when(F.col("rank") <= 2 * k, "near").when(F.col("rank").isNotNull(), "deeper").otherwise("unreachable")
    return ranks.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def rank_movement(gold: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """What a change does to the ranks of gold chunks."""
    side = lambda df, name: df.select("query_id", "chunk_id", F.col("rank").alias(name))
    both = gold.join(side(before, "b"), ["query_id", "chunk_id"], "left").join(side(after, "a"), ["query_id", "chunk_id"], "left")
    b, a = F.col("b"), F.col("a")
    move = F.when(b.isNull() & a.isNull(), "both absent").when(b.isNull(), "better").when(a.isNull(), "LOST").when(a < b, "better").when(a > b, "worse").otherwise("same")
    return both.groupBy(move.alias("movement")).agg(F.count("*").alias("n"))


def missed(scores: DataFrame) -> DataFrame:
    """Questions that each strategy misses, sorted."""
    return scores.groupBy("strategy").agg(F.array_sort(F.collect_list(F.when(F.col("hit") == 0, F.col("query_id")))).alias("missed"))


def overlaps(sem: DataFrame, kw: DataFrame, hyb: DataFrame) -> DataFrame:
    """Per question how many chunks two lists share, and how many only the fused one has."""
    name = lambda df, n: df.select("query_id", "chunk_id", F.lit(n).alias("side"))
    sides = name(sem, "s").unionByName(name(kw, "k")).unionByName(name(hyb, "h")).groupBy("query_id", "chunk_id").agg(F.max((F.col("side") == "s").cast("int")).alias("s"), F.max((F.col("side") == "k").cast("int")).alias("k"), F.max((F.col("side") == "h").cast("int")).alias("h"))
    return sides.groupBy("query_id").agg(F.sum(F.col("s") * F.col("k")).alias("sem_kw"), F.sum(F.col("h") * F.col("s")).alias("hyb_sem"), F.sum(F.col("h") * F.col("k")).alias("hyb_kw"), F.sum(F.col("h") * (1 - F.col("s")) * (1 - F.col("k"))).alias("only_hyb"))


def answer_rates(gen: DataFrame) -> DataFrame:
    """Refusals of unanswerable, false refusals and hallucinations."""
    yes, no = F.col("answerable"), ~F.col("answerable")
    return gen.agg(
        F.count("*").alias("n"),
        F.coalesce(F.avg(F.when(no, F.col("refused").cast("double"))), F.lit(0.0)).alias("refusal"),
        F.coalesce(F.avg(F.when(yes, F.col("refused").cast("double"))), F.lit(0.0)).alias("false_refusal"),
        F.coalesce(F.avg(F.when(no, (~F.col("refused")).cast("double"))), F.lit(0.0)).alias("hallucination"),
    )


def rates_by_type(gen: DataFrame) -> DataFrame:
    return gen.groupBy("type").agg(F.count("*").alias("n"), rate(F.col("refused")).alias("refused"), rate(~F.col("refused")).alias("answered"))


def flips(gen: DataFrame) -> DataFrame:
    """Questions that were refused in some runs only."""
    return gen.groupBy("id").agg(F.count("*").alias("runs"), F.count_if("refused").alias("refusals")).filter("refusals > 0 and refusals < runs")


def groundedness(gen: DataFrame) -> DataFrame:
    s, u, e = F.sum("supported"), F.sum("unsupported"), F.sum("judge_errors")
    return gen.agg(s.alias("supported"), u.alias("unsupported"), e.alias("errors"), ratio(s, s + u).alias("groundedness"), ratio(e, s + u + e).alias("error_rate"))


def verdicts(gen: DataFrame, *by: str) -> DataFrame:
    """Verdicts with their share of all and of decided ones."""
    counts = gen.groupBy(*by, "verdict").agg(F.count("*").alias("n"))
    every = Window.partitionBy(*by)
    decided = F.sum(F.when(F.col("verdict") != "JUDGE_ERROR", F.col("n")).otherwise(0)).over(every)
    return counts.select(*by, "verdict", "n", (F.col("n") / F.sum("n").over(every)).alias("of_all"), F.when(F.col("verdict") != "JUDGE_ERROR", ratio(F.col("n"), decided)).otherwise(0.0).alias("of_decided"))


def by_question(gen: DataFrame) -> DataFrame:
    """A question's runs as one observation: what the first run says of the
    question; refused by majority, a tie isn't; gold found by any run."""
    first = (F.min_by(c, "run").alias(c) for c in ("type", "answerable", "gold_labelled"))
    out = gen.groupBy("id").agg(*first, F.count("*").alias("runs"), F.count_if("refused").alias("refusals"), F.max("gold_retrieved").alias("gold_retrieved"))
    return out.withColumn("refused", 2 * F.col("refusals") > F.col("runs")).withColumn("unstable", (F.col("refusals") > 0) & (F.col("refusals") < F.col("runs")))


def justified_refusals(questions: DataFrame) -> DataFrame:
    """Refusals of answerable questions: justified where gold is labelled and wasn't found."""
    refused, justified = questions.filter("answerable and refused"), F.col("gold_labelled") & ~F.col("gold_retrieved")
    return refused.agg(F.count("*").alias("refused"), F.count_if(justified).alias("justified"), F.count_if(~justified).alias("unjustified"))


def behaviour(gen: DataFrame) -> DataFrame:
    per = gen.groupBy("id").agg(F.count("*").alias("runs"), F.count_if("refused").alias("refusals"))
    kind = F.when(F.col("refusals") == F.col("runs"), "every run").when(F.col("refusals") > 0, "some runs").otherwise("no run")
    return per.groupBy(kind.alias("refused_in")).agg(F.count("*").alias("questions"))


def question_rates(gen: DataFrame) -> DataFrame:
    """Share of legible verdicts that are correct, null where none is legible."""
    return gen.groupBy("id").agg(F.avg(F.when(F.col("verdict") != "JUDGE_ERROR", (F.col("verdict") == "CORRECT").cast("double"))).alias("rate"))


def paired(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, before, after, diff, side) of two sides' rates; side says where an id is missing."""
    both = before.select("id", F.col("rate").alias("before"), F.lit(True).alias("in_b")).join(after.select("id", F.col("rate").alias("after"), F.lit(True).alias("in_a")), "id", "full")
    side = F.when(F.col("in_a").isNull(), "before only").when(F.col("in_b").isNull(), "after only").when(F.col("before").isNull() | F.col("after").isNull(), "illegible").otherwise("paired")
    return both.select("id", "before", "after", (F.col("after") - F.col("before")).alias("diff"), side.alias("side"))


def signs(pairs: DataFrame) -> DataFrame:
    p = pairs.filter("side = 'paired'")
    return p.agg(F.count("*").alias("n"), F.avg("diff").alias("mean_diff"), F.count_if(F.col("diff") > 0).alias("up"), F.count_if(F.col("diff") < 0).alias("down"), F.count_if(F.col("diff") == 0).alias("unchanged"))


def merged(files: DataFrame) -> DataFrame:
    """One record per id and run, that of the first file; files: file_ord, id, run, ..."""
    w = Window.partitionBy("id", "run").orderBy("file_ord")
    return files.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def latency(rows: DataFrame, price_in: float, price_out: float) -> DataFrame:
    stats = [f(c).alias(f"{n}_{c}") for c in ("retrieval_s", "generation_s", "total_s") for n, f in (("median", F.median), ("min", F.min), ("max", F.max))]
    cost = F.median(F.col("input_tokens") / 1e6 * price_in + F.col("output_tokens") / 1e6 * price_out)
    return rows.agg(F.count("*").alias("n"), *stats, F.median("input_tokens").alias("median_input_tokens"), F.median("output_tokens").alias("median_output_tokens"), cost.alias("median_cost"))


def upper_median(values: Column) -> Column:
    """The element n div 2 of the sorted values, counted from 0: the upper one of an even number."""
    return F.element_at(F.array_sort(values), (F.size(values) / 2).cast("int") + 1)
