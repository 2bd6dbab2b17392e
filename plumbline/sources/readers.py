"""Readers: pages, parsed filings, manifests, ticker indexes, benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import schemas
from plumbline.functions.text import file_stem, fiscal_year, vector_literal


def html_files(spark: SparkSession, pattern: str) -> DataFrame:
    """(doc_id, html) of whole files; bytes that aren't UTF-8 are replaced."""
    files = spark.read.format("binaryFile").load(pattern)
    return files.select(file_stem(F.col("path")).alias("doc_id"), F.make_valid_utf8(F.col("content").cast("string")).alias("html"))


def parsed_filings(spark: SparkSession, pattern: str) -> DataFrame:
    """Parsed filings as JSON, with the doc_id of their file's name."""
    return spark.read.schema(schemas.PARSED).json(pattern, multiLine=True).withColumn("doc_id", file_stem(F.input_file_name()))


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest; an entry without doc_id gets its file's stem."""
    out = json_array(spark, path, schemas.MANIFEST)
    return out.withColumn("doc_id", F.coalesce(F.nullif("doc_id", F.lit("")), file_stem(F.col("local_path"))))


def ticker_index(spark: SparkSession, path: str) -> DataFrame:
    """(ticker, cik, company) from a JSON object of objects, by ticker."""
    row = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, struct<cik_str: bigint, ticker: string, title: string>>").alias("m"))
    return row.select(F.explode(F.map_values("m")).alias("e")).select(F.upper("e.ticker").alias("ticker"), F.col("e.cik_str").alias("cik"), F.col("e.title").alias("company")).orderBy("ticker")


def write_ticker_cache(index: DataFrame, path: str) -> None:
    index.orderBy("ticker").coalesce(1).write.csv(path, header=True, mode="overwrite")


def read_ticker_cache(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("ticker string, cik bigint, company string").csv(path, header=True)


def latest_filing(submissions: DataFrame, form: str = "10-K") -> DataFrame:
    """The first filing of a form from parallel arrays (form, accession, document,
    filed, reported), one row a company; those without one are left out."""
    z = F.arrays_zip("form", "accession", "document", "filed", "reported")
    first = F.get(F.filter(z, lambda x: x["form"] == form), F.lit(0))
    out = submissions.select("cik", first.alias("f")).filter("f is not null").select("cik", "f.*")
    return out.withColumns({"accession_dashed": F.col("accession"), "accession": F.replace("accession", F.lit("-"), F.lit("")), "fiscal_year": fiscal_year(F.col("reported"))})


def pinned_filings(spark: SparkSession, path: str) -> DataFrame:
    """Filings that a YAML file pins; a missing field is an error."""
    import yaml

    with open(path, encoding="utf-8") as file:
        rows = yaml.safe_load(file).get("filings", [])
    fields = ("ticker", "cik", "accession", "document", "filed_date", "report_date", "fiscal_year", "company")
    for row in rows:
        if lacks := [f for f in fields if row.get(f) in (None, "")]:
            raise ValueError(f"pinned filing {row.get('ticker')} lacks {', '.join(lacks)}")
    data = [tuple(int(r[f]) if f in ("cik", "fiscal_year") else str(r[f]) for f in fields) for r in rows]
    return spark.createDataFrame(data, "ticker string, cik bigint, accession string, document string, filed_date string, report_date string, fiscal_year int, company string")


def benchmark(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a YAML list."""
    import yaml

    with open(path, encoding="utf-8") as file:
        data = yaml.safe_load(file)
    rows = data["questions"] if isinstance(data, dict) else data
    pick = lambda g: {"doc_id": g.get("doc_id"), "chunk_index": g.get("chunk_index"), "contains": g.get("contains"), "unlocalisable": g.get("unlocalisable")}
    out = [{"id": str(r["id"]), "question": r.get("question"), "type": r.get("type"), "answerable": bool(r.get("answerable")), "gold_answer": r.get("gold_answer"), "notes": r.get("notes"), "gold_chunk_ids": [int(x) for x in r.get("gold_chunk_ids") or []], "gold_chunks": [pick(g) for g in r.get("gold_chunks") or []]} for r in rows]
    return spark.createDataFrame(out, schemas.QUESTION)


def vectors_of_text(rows: DataFrame, column: str = "embedding") -> DataFrame:
    return rows.withColumn(column, vector_literal(F.col(column)))


def npy_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(position, embedding) of a two-dimensional .npy file, each file whole in one task, handed on by row ranges."""
    import numpy as np

    def run(batches):
        import io

        import pandas as pd

        for pdf in batches:
            for data in pdf["content"]:
                m = np.load(io.BytesIO(data), allow_pickle=False)
                for at in range(0, len(m), 4096):
                    yield pd.DataFrame({"position": range(at, min(at + 4096, len(m))), "embedding": list(m[at : at + 4096].astype("float32"))})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "position long, embedding array<float>")


def tables_and_settings(spark: SparkSession, settings: tuple[str, ...] = ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone")) -> DataFrame:
    """What the catalog holds and how the session is set."""
    rows = [("table", t.name, t.tableType) for t in spark.catalog.listTables()] + [("setting", s, spark.conf.get(s)) for s in settings]
    return spark.createDataFrame(rows, "kind string, name string, value string")
