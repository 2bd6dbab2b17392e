"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of the corpus contracts: runs of anything but ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACE_PATTERN = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: A lookup table of at most this many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 50_000
#: Rows of texts that Python workers get at a time, and bytes of a sample of texts that the driver gets.
BATCH_ROWS, SAMPLE_BYTES = 1_000, 96 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in spark.checkpoint.dir. Only where executors are
    threads of the driver, as in tests, is a temporary folder set instead."""
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def materialize(df: DataFrame, name: str, within: list[str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage there,
    so that a lost executor costs a read of files and no earlier stage. The
    path is appended to within, whose owner removes it when nothing reads it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if within is not None:
        within.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables of materialize() and empty the list."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while paths:
        path = jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(conf).delete(path, True)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Have Spark hand whole texts to Python workers by at most `rows`: a batch
    is in memory several times on both sides. A smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def lookup(small: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """small, marked for broadcast if a count of its rows proves it small."""
    return F.broadcast(small) if small.limit(limit + 1).count() <= limit else small


def hash60(*cols: Column) -> Column:
    """60 bits of the MD5 of the columns, as a long that other engines can compute."""
    joined = F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("")) for c in cols))
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("long")


def learnable(doc_id: Column) -> Column:
    """Rows that models may learn from; the others are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1, F.lit(True))


def held_out(doc_id: Column) -> Column:
    return ~learnable(doc_id)


def bounded_sample(rows: DataFrame, limit: int, nbytes: int = SAMPLE_BYTES, order: tuple[str, ...] = ("h",), per: str | None = None) -> DataFrame:
    """The first rows of rows(size, ...) by order, at most limit of them, whose
    sizes add up to at most nbytes; the first one always. With per, rows take
    turns by their value there, so that a rare value isn't left out. Ties in
    order share all that counts. Runs on ids and sizes alone: limit rows, after
    a cut that each task makes by itself, are ordered in one place. Values of
    per with many rows are thinned before, by a hash of order, to about twice
    the limit, so that no task gets all rows of one; rows are read twice then."""
    if per is not None:
        counts = lookup(rows.groupBy(per).agg(F.count("*").alias("_n")))
        place = (F.xxhash64(*order).cast("double") + 2.0**63) / 2.0**64
        rows = rows.join(counts, per).filter(place * F.col("_n") <= 2 * limit + 100).select(*rows.columns)
        turn = Window.partitionBy(per).orderBy(*order)
        rows = rows.withColumn("_turn", F.row_number().over(turn)).filter(F.col("_turn") <= limit)
        order = ("_turn", *order)
    first = rows.orderBy(*order).limit(limit)
    total = F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    place = F.row_number().over(Window.orderBy(*order))
    kept = first.withColumns({"_total": total, "_place": place}).filter((F.col("_total") <= nbytes) | (F.col("_place") == 1))
    return kept.drop("_turn", "_total", "_place")
