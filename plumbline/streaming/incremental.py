"""Incremental loading: the batch upsert applied to each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from plumbline.sources.writers import latest, upsert


def stream_upserts(source: DataFrame, folder: str, checkpoint: str, keys: list[str], update: list[str], on_batch: Callable[[int], None] | None = None, order: tuple[str, ...] = ()) -> StreamingQuery:
    """Upsert a stream into folder. Every batch writes a version of its own, named
    after the batch, from the one before: a batch that runs again writes the
    same. Of several updates of a key in a batch that of the greatest order
    counts. Each batch rewrites the table, so batches should be few and large."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = read_version(spark, folder, number - 1)
        out = latest(batch, keys, order) if before is None else upsert(before, batch, keys, update, order)
        out.write.mode("overwrite").parquet(f"{folder}/v={number}")
        if on_batch:
            on_batch(number)

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_version(spark: SparkSession, folder: str, number: int) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/v={number}")
    exists = number >= 0 and path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.parquet(f"{folder}/v={number}") if exists else None
