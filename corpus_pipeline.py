"""A corpus pipeline of five stages over documents; part of the subpackage llm.

Every stage takes rows with nulls in any column, empty and very long texts,
repeated rows, other columns than those of documents, and an empty table; all
but the last return the columns they got."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import langid, mixing, ngram_join, sentencepieces, toxicity
from plumbline.llm.common import materialize, remove, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is found with some certainty. A null text, or
    one without a letter, has none and goes; repeated rows fare alike."""
    return langid.keep_known(docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't score as toxic; a null text scores as an empty one. Null labels and ids teach nothing."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id; a row
    with a null id yields to any with one. A text without words is like no other."""
    return ngram_join.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, each as often as it takes it. Null
    sources are one source; a text without words goes with its hash."""
    mixed = mixing.mix(docs).filter("mix_epochs > 0")
    copies = mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("mix_epochs").cast("int"))))
    return copies.select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, and whether they decode to it; a null text has none and decodes to an empty one."""
    found = sentencepieces.encode(docs, decoded="_back")
    same = F.col("_back") == F.coalesce("text", F.lit(""))
    return found.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_ids"), "ids", same.alias("round_trip"))


STAGES = [("language", language), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("mixture", mixture), ("tokens", tokens)]

#: Trained models and SentencePiece aren't SQL; the tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; a stage's table is removed once the next one is written, the last one's input stays."""
    docs, old = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        new: list[str] = []
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}", new)
        remove(spark, old)
        old = new
    return STAGES[-1][1](spark, docs, sf_dir)
