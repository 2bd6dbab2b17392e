"""Citations, refusals and verdicts in generated answers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline import config as C


def sentences(text: Column) -> Column:
    return F.split(text, C.SENTENCE_SPLIT)


def cited(text: Column) -> Column:
    """Numbers of excerpts as cited, in order, repeats included."""
    return F.transform(F.regexp_extract_all(text, F.lit(C.CITATION), 1), lambda x: x.cast("int"))


def is_refusal(text: Column) -> Column:
    """Is the limitation the answer, not a caveat to one?

    The marker counts only at the start. A phrase counts if it is in the first
    sentence, or if no sentence without it cites anything."""
    first = F.coalesce(F.get(F.filter(sentences(F.regexp_replace(text, r"(?U)^\s+|\s+$", "")), lambda s: F.trim(s) != ""), F.lit(0)), F.lit(""))
    answered = F.exists(sentences(text), lambda s: ~s.rlike(C.PROSE_REFUSAL) & s.rlike(C.CITATION))
    return (
        F.when(F.regexp_replace(text, r"(?U)^\s+", "").startswith(C.REFUSAL_MARKER), True)
        .when(F.contains(text, F.lit(C.REFUSAL_MARKER)), False)
        .when(~text.rlike(C.PROSE_REFUSAL), False)
        .when(first.rlike(C.PROSE_REFUSAL), True)
        .otherwise(~answered)
    )


def problems(text: Column, n_excerpts: Column) -> Column:
    """What is wrong with an answer's citations."""
    empty = F.array().cast("array<string>")
    outside = F.array_sort(F.array_distinct(F.filter(cited(text), lambda c: (c < 1) | (c > n_excerpts))))
    bad = F.when(F.size(outside) > 0, F.array(F.format_string("cited excerpt(s) [%s] but only %d were supplied", F.array_join(F.transform(outside, lambda x: x.cast("string")), ", "), n_excerpts))).otherwise(empty)
    opening = F.get(sentences(F.replace(text, F.lit(C.REFUSAL_MARKER), F.lit(""))), F.lit(0))
    stated = F.when(opening.rlike(C.ANSWERING_FIGURE) & ~opening.rlike(C.CITATION), F.array(F.lit("refused and stated an uncited figure - a figure in a refusal must cite the excerpt it came from"))).otherwise(empty)
    hedged = F.when(text.rlike(C.HEDGE), F.array(F.lit("hedged figure in a refusal"))).otherwise(empty)
    none = F.when(F.size(cited(text)) == 0, F.array(F.lit("no citations at all"))).otherwise(empty)
    uncited = F.transform(F.filter(sentences(text), lambda s: s.rlike(C.FIGURE) & ~s.rlike(C.CITATION)), lambda s: F.concat(F.lit("uncited figure: "), F.substring(F.trim(s), 1, 70)))
    return F.when(is_refusal(text), F.concat(bad, stated, hedged)).otherwise(F.concat(bad, none, uncited))


def verify(text: Column, n_excerpts: Column) -> Column:
    return F.struct(F.array_sort(F.array_distinct(cited(text))).alias("cited"), problems(text, n_excerpts).alias("problems"))


def claims(text: Column) -> Column:
    """Sentences of more than three words that cite something, with what they cite."""
    held = F.filter(sentences(text), lambda s: s.rlike(C.CITATION) & (F.size(F.split(F.trim(s), r"\s+")) > 3))
    return F.transform(held, lambda s: F.struct(F.trim(s).alias("claim"), F.transform(F.regexp_extract_all(s, F.lit(C.CITATION), 1), lambda x: x.cast("int")).alias("cited")))


def claim_verdict(reply: Column) -> Column:
    """A judge's reply on one claim. An unreadable reply is an error, never unsupported."""
    text = F.trim(F.coalesce(reply, F.lit("")))
    named = F.regexp_extract(text, C.CLAIM_VERDICT, 1)
    up = F.upper(text)
    return (
        F.when(text == "", "judge_error")
        .when(named == "SUPPORTED", "supported")
        .when(named == "UNSUPPORTED", "unsupported")
        .when(named == "ABSENCE", "absence")
        .when(named != "", "judge_error")
        .when(F.contains(up, F.lit("ABSENCE")), "absence")
        .when(up.rlike("UNSUPPORTED|NOT SUPPORTED"), "unsupported")
        .when(F.contains(up, F.lit("SUPPORTED")), "supported")
        .otherwise("judge_error")
    )


def answer_verdict(reply: Column) -> Column:
    """A judge's reply on a whole answer; of the names in free text the longest first."""
    text = F.trim(F.coalesce(reply, F.lit("")))
    named = F.regexp_extract(text, C.ANSWER_VERDICT, 1)
    up = F.upper(text)
    out = F.when(text == "", "JUDGE_ERROR").when(named.isin("CORRECT", "PARTIALLY_CORRECT", "INCORRECT"), named)
    for name in ("PARTIALLY_CORRECT", "INCORRECT", "CORRECT"):
        out = out.when(F.contains(up, F.lit(name)), name)
    return out.otherwise("JUDGE_ERROR")


def user_message(question: Column, excerpts: Column) -> Column:
    """The prompt from array<struct<rank, label, content>>, by rank."""
    ordered = F.array_sort(F.transform(excerpts, lambda e: F.struct(e["rank"].alias("rank"), e["label"].alias("label"), e["content"].alias("content"))))
    blocks = F.transform(ordered, lambda e: F.concat(F.lit("["), e["rank"].cast("string"), F.lit("] "), e["label"], F.lit("\n"), e["content"]))
    return F.concat(F.lit("EXCERPTS:\n\n"), F.array_join(blocks, "\n\n"), F.lit("\n\nQUESTION: "), question)
