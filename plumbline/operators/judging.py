"""Answers and their claims, judged by a language model. An unreadable reply is an error, never a verdict against the answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import answers as A
from plumbline.operators.providers import Provider, complete

CLAIM_TASK = 'Do the excerpts state the claim? Reply with JSON alone: {"verdict": "SUPPORTED"}, "UNSUPPORTED", or "ABSENCE" if the claim is that something is not stated.'
ANSWER_TASK = 'Compare the generated answer with the reference. Reply with JSON alone: {"verdict": "CORRECT", "reason": "..."}, "PARTIALLY_CORRECT" or "INCORRECT".'
MAX_TOKENS = 512


def _block(title: str | Column, body: Column) -> Column:
    return F.concat(F.lit(title) if isinstance(title, str) else title, F.lit(":\n"), F.coalesce(body, F.lit("")))


def judge_claims(answers: DataFrame, make: Callable[[], Provider], system: str = CLAIM_TASK, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """(id, run, claim, cited, verdict, reply), a row for each claim of answers(id,
    run, text, excerpts array<struct<rank, label, content>>), judged against all
    excerpts that it cites at once; citations of others are left out of the prompt."""
    each = answers.select("id", "run", F.explode(A.claims(F.col("text"))).alias("c"), "excerpts").select("id", "run", "c.claim", "c.cited", "excerpts")
    cited = F.filter("excerpts", lambda e: F.array_contains("cited", e["rank"]))
    blocks = F.transform(cited, lambda e: _block(F.concat(F.lit("EXCERPT "), e["label"]), e["content"]))
    message = F.array_join(F.array_append(blocks, _block("CLAIM", F.col("claim"))), "\n\n")
    judged = complete(each.withColumn("message", message), make, system, max_tokens=max_tokens)
    return judged.select("id", "run", "claim", "cited", A.claim_verdict(F.col("reply")).alias("verdict"), "reply")


def judge_answers(answers: DataFrame, make: Callable[[], Provider], system: str = ANSWER_TASK, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """answers(question, reference, generated, ...) with verdict, reason and reply."""
    message = F.concat_ws("\n\n", _block("QUESTION", F.col("question")), _block("REFERENCE ANSWER", F.col("reference")), _block("GENERATED ANSWER", F.col("generated")))
    judged = complete(answers.withColumn("message", message), make, system, max_tokens=max_tokens).drop("message")
    reason = F.regexp_extract(F.col("reply"), r'"reason"\s*:\s*"([^"]*)"', 1)
    return judged.withColumns({"verdict": A.answer_verdict(F.col("reply")), "reason": reason})
