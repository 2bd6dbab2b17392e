"""Mixing sources to target weights by hash-threshold histograms.

Every document has a 60-bit hash. Words are summed by source and hash bucket,
the running sum of a source's buckets shows the bucket in which its budget
ends, and only that bucket is divided again by the next bits of the hash,
until it holds one hash. A document is taken if its hash is not above its
source's threshold, so no documents are sorted or ranked, and a smaller budget
takes a subset of what a larger one takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import WORD_PATTERN, hash60, lookup, materialize, remove, table

HASH_BITS = 60
BUCKET_BITS = 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3) -> DataFrame:
    """Targets of sources, from (source, source_size), one row a source.

    Sources by code point, null last, weigh as in weights, repeating. Shares
    of the total go by weight; a target stops at cap times its source's size
    and the excess goes to the others by weight. The result is the level at
    which the capped and the uncapped targets add up to the total: in order of
    cap / weight, the first source whose cap isn't below the level sets it.
    The windows see one row a source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.pmod(F.col("pos") - 1, F.lit(len(weights))) + 1)
    ranked = sizes.withColumn("pos", F.row_number().over(order)).withColumn("weight", weight)
    ranked = ranked.withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    by_ratio = Window.orderBy((F.col("most") / F.col("weight")).asc(), F.col("pos").asc())
    before, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    levelled = ranked.withColumn("level", level).withColumn("capped", F.col("most") / F.col("weight") < F.col("level"))
    final = F.min_by(F.when(~F.col("capped"), F.col("level")), F.when(~F.col("capped"), F.struct(F.col("most") / F.col("weight"), F.col("pos")))).over(everything)
    target = F.when(F.col("capped") | final.isNull(), F.col("most")).otherwise(F.least(final * F.col("weight"), F.col("most")))
    return levelled.withColumn("target", target).select("source", "source_size", "weight", "target")


def _cumulated(hist: DataFrame) -> DataFrame:
    """The bucket in which each source's budget ends; hist: source, budget, bucket, words, low, high."""
    w = Window.partitionBy("source").orderBy("bucket")
    run = hist.withColumn("upto", F.sum("words").over(w))
    ends = run.filter((F.col("budget") > 0) & (F.col("upto") >= F.col("budget")) & (F.col("upto") - F.col("words") < F.col("budget")))
    return ends.withColumn("rest", F.col("budget") - (F.col("upto") - F.col("words")))


def _histogram(rows: DataFrame, keys: list[str], shift: int) -> DataFrame:
    bucket = F.shiftright("h", shift)
    return rows.groupBy(*keys, bucket.alias("bucket")).agg(F.sum("size").alias("words"), F.min("h").alias("low"), F.max("h").alias("high"))


def thresholds(rows: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3) -> DataFrame:
    """Per source its size, target, epochs (whole passes) and the hash up to
    which documents are taken once more, as a table of the shared folder; rows: source, size, h."""
    gone: list[str] = []
    # Each round reads the rows again, so they are kept without their texts.
    rows = materialize(rows, "mix-rows", gone)
    shift = HASH_BITS - BUCKET_BITS
    hist = materialize(_histogram(rows, ["source"], shift), "mix-histogram", gone)
    sizes = hist.groupBy("source").agg(F.sum("words").alias("source_size"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = source_targets(sizes, weights, cap).withColumn("epochs", epochs.cast("long"))
    plan = materialize(plan.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-plan", gone)
    budgets = lookup(plan.select(F.col("source").alias("of"), "budget"))
    open_ = _cumulated(hist.join(budgets, F.col("source").eqNullSafe(F.col("of"))).drop("of"))
    done = None
    while True:
        ends = materialize(open_.select("source", "bucket", "words", "rest", "low", "high"), "mix-ends", gone)
        single = ends.filter(F.col("low") == F.col("high"))
        nearer = F.col("words") - F.col("rest") < F.col("rest")
        cut = single.select("source", (F.col("low") - F.when(nearer, 0).otherwise(1)).alias("threshold"))
        done = cut if done is None else done.unionByName(cut)
        ends = ends.filter(F.col("low") != F.col("high"))
        if ends.isEmpty():
            break
        inside = lookup(ends.select(F.col("source").alias("of"), F.col("bucket").alias("in"), F.col("rest").alias("budget")))
        within = rows.join(inside, F.col("source").eqNullSafe(F.col("of")) & (F.shiftright("h", shift) == F.col("in")))
        shift -= BUCKET_BITS
        open_ = _cumulated(_histogram(within, ["source", "budget"], shift))
    cuts = done.withColumnRenamed("source", "of")
    full = plan.join(lookup(cuts), F.col("source").eqNullSafe(F.col("of")), "left").drop("of", "budget")
    found = materialize(full.withColumn("threshold", F.coalesce("threshold", F.lit(-1))), "mix-thresholds")
    remove(found.sparkSession, gone)
    return found


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3, source: str = "source", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with mix_size, mix_source_size, mix_target and mix_epochs (how often
    the mix takes the document: 0 to cap).

    A null text has size 0; null sources are one source, the last. Repeated
    rows have one hash and are taken together. Documents of size 0 bring no
    words and go with their hash. An empty table gives no rows. Only the
    three named columns are used; others pass unchanged, but for columns of
    the four names above, which are replaced."""
    size, h = word_count(F.col(text)), hash60(F.col(doc_id), F.col(text))
    rows = docs.select(F.col(source).alias("source"), size.alias("size"), h.alias("h"))
    cuts = thresholds(rows, weights, cap).select(
        F.col("source").alias("_mix_of"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), F.col("epochs").alias("_mix_whole"), F.col("threshold").alias("_mix_threshold")
    )
    out = docs.withColumns({"mix_size": size, "_mix_h": h}).join(lookup(cuts), F.col(source).eqNullSafe(F.col("_mix_of")), "left")
    more = F.when(F.col("_mix_h") <= F.col("_mix_threshold"), 1).otherwise(0)
    return out.withColumn("mix_epochs", F.col("_mix_whole") + more).drop("_mix_h", "_mix_of", "_mix_whole", "_mix_threshold")


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_epochs")).alias("taken")
    )


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS s FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS pos FROM s),
w AS (SELECT *, CAST((pos - 1) % 3 + 1 AS DOUBLE) AS w, 3.0::DOUBLE * s AS most FROM r),
l AS (SELECT *, (sum(s) OVER () - coalesce(sum(most) OVER b, 0.0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0.0)) AS level
      FROM w WINDOW b AS (ORDER BY most / w, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(level, most / w) AS level FROM l WHERE most / w >= level),
t AS (SELECT l.source, l.s, CASE WHEN l.most / l.w < l.level OR f.level IS NULL THEN l.most ELSE least(f.level * l.w, l.most) END AS target FROM l LEFT JOIN f ON true),
p AS (SELECT *, CASE WHEN s > 0 THEN floor(target / s) ELSE 0 END AS epochs, target - (CASE WHEN s > 0 THEN floor(target / s) ELSE 0 END) * s AS budget FROM t),
g AS (SELECT source, h, sum(size) AS words FROM d GROUP BY source, h),
c AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY h) AS upto FROM g),
e AS (SELECT c.source, c.h, c.upto <= p.budget OR (c.upto - c.words < p.budget AND c.upto - p.budget < p.budget - (c.upto - c.words)) AS more
      FROM c JOIN p ON c.source IS NOT DISTINCT FROM p.source)
SELECT d.doc_id, d.size, p.s::BIGINT AS source_size, p.target,
       (d.size * (p.epochs + CASE WHEN e.more AND p.budget > 0 THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source JOIN e ON e.source IS NOT DISTINCT FROM d.source AND e.h = d.h
"""
