"""Writers: upserts without a table format, dumps, results."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.text import digest


def create_tables(spark: SparkSession) -> None:
    from plumbline import schemas

    for name, ddl in (("documents", schemas.DOCUMENTS), ("chunks", schemas.CHUNKS)):
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({ddl}) USING parquet")


def drop_tables(spark: SparkSession) -> None:
    for name in ("chunks", "documents"):
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def latest(rows: DataFrame, keys: list[str], order: tuple[str, ...] = ()) -> DataFrame:
    """One row a key: the greatest by order and then by all other columns, so that it is the same one each time."""
    rest = [c for c in rows.columns if c not in order]
    best = rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_row"))
    return best.select(*(F.col(f"_row.{c}").alias(c) for c in rows.columns))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], update: list[str], order: tuple[str, ...] = ()) -> DataFrame:
    """old with the rows of new: a key that old has takes only the update
    columns, others are added whole. Columns that neither names stay. Of rows
    of new that repeat a key the latest() counts."""
    new = latest(new, keys, order)
    n = new.select(*(F.col(c).alias(f"_n_{c}") for c in new.columns), F.lit(True).alias("_n"))
    same = [F.col(k).eqNullSafe(F.col(f"_n_{k}")) for k in keys]
    both = old.withColumn("_o", F.lit(True)).join(n, same, "full")
    has = set(new.columns)

    def column(c: str) -> Column:
        if c not in has:
            return F.col(c)
        fresh, kept = F.col(f"_n_{c}"), F.col(c)
        if c in update:
            return F.when(F.col("_n"), fresh).otherwise(kept).alias(c)
        return F.when(F.col("_o"), kept).otherwise(fresh).alias(c)

    return both.select(*(column(c) for c in old.columns))


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new whose keys it lacks; of rows that repeat a key the latest()."""
    new = latest(new, keys)
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti").select(*old.columns))


def with_serial(rows: DataFrame, order: list[str], name: str = "chunk_id") -> DataFrame:
    """Numbers from 1 in order of a key, without all rows in one task: rows are
    dealt to ranges, written in order, and each range starts where those before end."""
    parts = rows.repartitionByRange(*(F.col(c) for c in order)).withColumn("_part", F.spark_partition_id()).checkpoint()
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = counts.withColumn("_from", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.join(F.broadcast(starts), "_part").withColumn(name, F.col("_from") + within).drop("_part", "_from")


def dump(chunks: DataFrame, path: str, keys: tuple[str, ...] = ("doc_key", "chunk_index")) -> str:
    """Write sorted by key, read again, compare by key, and give a digest that doesn't depend on files or order."""
    chunks.repartitionByRange(*(F.col(k) for k in keys)).sortWithinPartitions(*keys).write.parquet(path)
    back = chunks.sparkSession.read.schema(chunks.schema).parquet(path)
    left, right = (table_digest(x) for x in (chunks, back))
    if left != right:
        raise ValueError("what was read back isn't what was written")
    return left


def table_digest(rows: DataFrame) -> str:
    """A digest of a table as a set of rows with counts: sums of row digests' parts."""
    h = digest(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}))
    part = lambda i: F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")
    row = rows.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(part(i)), F.lit(0).cast("decimal(38,0)")).alias(f"s{i}") for i in range(4))).first()
    return "-".join(str(x) for x in row)


def write_result(rows: DataFrame, path: str, provenance: dict) -> None:
    """JSON lines with a provenance record beside them; an earlier result isn't overwritten."""
    rows.write.mode("errorifexists").json(path)
    rows.sparkSession.createDataFrame([(json.dumps(provenance, sort_keys=True),)], "value string").write.mode("errorifexists").text(f"{path}.provenance")


def require(condition: bool, reason: str) -> None:
    """Guards before a write: an unempty target, broken labels, an existing snapshot."""
    if not condition:
        raise ValueError(reason)


def load_into_empty(rows: DataFrame, path: str) -> None:
    spark = rows.sparkSession
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    exists = target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
    require(not exists or spark.read.schema(rows.schema).parquet(path).isEmpty(), f"{path} already holds rows")
    rows.write.mode("overwrite").parquet(path)


def update_by_key(rows: DataFrame, changes: DataFrame, keys: list[str], column: str) -> DataFrame:
    """rows with column replaced where changes has the key, by the latest() of it; nothing else moves."""
    fresh = latest(changes.select(*keys, column), keys).select(*keys, F.col(column).alias("_fresh"))
    return rows.join(fresh, keys, "left").withColumn(column, F.coalesce("_fresh", column)).drop("_fresh").select(*rows.columns)
