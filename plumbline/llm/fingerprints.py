"""Document fingerprints: bottom-k sketches of five-word shingle hashes.

A sketch is the sorted array of the k smallest distinct hashes, so sketches of
parts merge into that of the whole, and two sketches estimate resemblance,
containment and the number of distinct shingles. All of it is built from
DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import SPACE_CHARS, SPACE_PATTERN, lookup, materialize, table

SHINGLE_WORDS = 5
SKETCH_SIZE = 64
#: Rows of a bucket of neighbouring ids, until there are BUCKETS of them; beyond, buckets grow and sort on disk.
BUCKET_ROWS, CELLS, BUCKETS = 1_000, 1_024, 500_000


def _with_shingles(df: DataFrame, text: str, out: str, words: int) -> DataFrame:
    """df with the hashes of text's shingles, repeats included. The words' hashes
    are a column of their own, so that no shingle splits the text again."""
    bare = F.btrim(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(SPACE_CHARS))
    split = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_PATTERN))
    df = df.withColumn("_fp_words", F.transform(split, lambda w: F.xxhash64(w)))
    starts = F.sequence(F.lit(0), F.size("_fp_words") - words)
    shingles = F.when(
        F.size("_fp_words") >= words, F.transform(starts, lambda i: F.xxhash64(*(F.get("_fp_words", i + j) for j in range(words))))
    ).when(F.size("_fp_words") > 0, F.array(F.xxhash64("_fp_words"))).otherwise(F.array().cast("array<long>"))
    return df.withColumn(out, shingles).drop("_fp_words")


def bottom(hashes: Column, k: int = SKETCH_SIZE) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def with_sketch(df: DataFrame, text: str = "text", out: str = "sketch", k: int = SKETCH_SIZE, words: int = SHINGLE_WORDS) -> DataFrame:
    """df with the sketch of text in out.

    Words are split at ASCII white space and lower-cased; with fewer than
    words of them the whole sequence is the one shingle; a null text or one
    without words has an empty sketch. Equal texts have equal sketches."""
    return _with_shingles(df, text, out, words).withColumn(out, bottom(F.col(out), k))


def merge_sketches(a: Column, b: Column, k: int = SKETCH_SIZE) -> Column:
    """The sketch of both parts together."""
    return bottom(F.concat(a, b), k)


def merged_by(df: DataFrame, keys: list[str], sketch: str = "sketch", k: int = SKETCH_SIZE) -> DataFrame:
    """One sketch per group. Hashes are made distinct before they meet and only
    ranks up to k within a hash stripe go on, so no task gathers a group."""
    each = df.select(*keys, F.explode(sketch).alias("_fp_hash")).distinct()
    stripe = Window.partitionBy(*keys, "_fp_stripe").orderBy("_fp_hash")
    near = each.withColumn("_fp_stripe", F.pmod(F.xxhash64("_fp_hash"), F.lit(64))).withColumn("_fp_at", F.row_number().over(stripe))
    kept = near.filter(F.col("_fp_at") <= k).groupBy(*keys).agg(F.collect_list("_fp_hash").alias(sketch))
    return kept.withColumn(sketch, bottom(F.col(sketch), k))


def distinct_count(sketch: Column, k: int = SKETCH_SIZE) -> Column:
    """Exact below k hashes, else (k - 1) / the k-th hash's share of the range."""
    share = (F.element_at(sketch, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) / share)


def resemblance(a: Column, b: Column, k: int = SKETCH_SIZE) -> Column:
    """Estimate of the Jaccard similarity: the part of the union's sketch that both hold; two empty ones are alike."""
    union = merge_sketches(a, b, k)
    return F.when(F.size(union) == 0, 1.0).otherwise(F.size(F.array_intersect(union, F.array_intersect(a, b))) / F.size(union))


def containment(a: Column, b: Column, k: int = SKETCH_SIZE) -> Column:
    """Estimate of the part of a's shingles that b holds; an empty a is contained."""
    j, n, m = resemblance(a, b, k), distinct_count(a, k), distinct_count(b, k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), j * (n + m) / ((1 + j) * n)))


def as_text(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda h: F.lower(F.hex(h))), ",")


def _bucket(docs: DataFrame) -> tuple[Column, Column]:
    """The cell of doc_id, and from _fp_cell a bucket number that falls with doc_id.

    Quantiles of the ids, at most CELLS, each divided evenly by id; how even
    they are changes no result. Null ids come last."""
    n = docs.count()
    rows = max(BUCKET_ROWS, -(-n // BUCKETS))
    cells = max(1, min(CELLS, n // (4 * rows)))
    row = docs.agg(F.percentile_approx("doc_id", [i / cells for i in range(cells + 1)], 20 * CELLS).alias("q")).first()
    cuts = sorted(set(row["q"] or [0]))
    parts = max(1, -(-n // (len(cuts) * rows)))
    steps = [1 << i for i in range(len(cuts).bit_length() - 1, -1, -1)]
    q = F.array(*(F.lit(x).cast("long") for x in cuts))
    cell = F.aggregate(F.array(*(F.lit(x) for x in steps)), F.lit(0), lambda at, step: F.when(F.get(q, at + step) <= F.col("doc_id"), at + step).otherwise(at))
    widths = [max(1, -(-(b - a) // parts)) for a, b in zip(cuts, [*cuts[1:], cuts[-1] + parts], strict=True)]
    width = F.get(F.array(*(F.lit(x).cast("long") for x in widths)), F.col("_fp_cell"))
    part = F.least(F.greatest(F.floor((F.col("doc_id") - F.get(q, F.col("_fp_cell"))) / width), F.lit(0)), F.lit(parts - 1))
    return cell, F.coalesce((F.col("_fp_cell") * parts + part).cast("long"), F.lit(-1))


def with_next(docs: DataFrame, k: int = SKETCH_SIZE) -> DataFrame:
    """docs(doc_id, text) with sketch, next_text and next_sketch: those of the
    next document by descending doc_id; after the last comes the first.

    Null ids come last, rows of one id by text; columns of the three names are
    replaced, others pass. Rows are dealt to buckets of
    neighbouring ids; the first row of a bucket is copied to the end of the
    bucket before it, so one exchange suffices and none gathers all rows."""
    cell, bucket = _bucket(docs.select("doc_id"))
    placed = docs.withColumn("_fp_cell", cell).withColumn("_fp_at", bucket).drop("_fp_cell")
    # One row a bucket, about BUCKETS at most.
    firsts = materialize(placed.groupBy("_fp_at").agg(F.max("doc_id").alias("_fp_first")), "fp-firsts")
    down = Window.orderBy(F.col("_fp_at").desc())
    before = F.coalesce(F.lag("_fp_at").over(down), F.min("_fp_at").over(Window.partitionBy()))
    firsts = lookup(firsts.withColumn("_fp_to", before).withColumnRenamed("_fp_at", "_fp_from"), 2 * BUCKETS)
    heads = placed.join(firsts, (F.col("_fp_at") == F.col("_fp_from")) & F.col("doc_id").eqNullSafe(F.col("_fp_first")))
    heads = heads.withColumn("_fp_at", F.col("_fp_to")).drop("_fp_from", "_fp_first", "_fp_to").withColumn("_fp_copy", F.lit(1))
    w = Window.partitionBy("_fp_at").orderBy("_fp_copy", F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first())
    rows = placed.withColumn("_fp_copy", F.lit(0)).unionByName(heads)
    rows = with_sketch(rows, k=k).withColumns({f"next_{c}": F.lead(c).over(w) for c in ("text", "sketch")})
    return rows.filter("_fp_copy = 0").drop("_fp_copy", "_fp_at")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's sketch beside those of its edited text and of the next
    document, with what they estimate: resemblance, containment, and the
    numbers of distinct shingles of the text and of both documents together.
    A null text counts as empty; other columns of the table aren't used."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    both = with_next(docs)
    both = both.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("_half", F.floor(F.col("n_chars") / 2).cast("int"))
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - F.col("_half")).cast("int")), F.substring("next_text", F.lit(1), F.col("_half")))
    both = both.withColumn("edited", edited).drop("text", "next_text")
    done = with_sketch(both, "edited", "edited_sketch")
    return done.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        F.rint(distinct_count(F.col("sketch"))).cast("long").alias("n_shingles_estimate"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("held_by_edited"),
        F.rint(distinct_count(merge_sketches(F.col("sketch"), F.col("next_sketch")))).cast("long").alias("n_shingles_with_next"),
    )
