"""Companies that a question names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline import config as C


def _java(alias: str) -> str:
    return r"(?U)\b" + re.sub(r"([^\w\s'])", r"\\\1", alias) + r"\b"


def detect(question: Column, aliases: dict[str, tuple[str, ...]] = C.COMPANY_ALIASES, patterns: dict[str, str] = C.COMPANY_PATTERNS) -> Column:
    """Tickers in order of mention. A ticker's longest alias that occurs gives
    its place; patterns count only for tickers without one. The alias table is
    a parameter of fixed size, so this is one projection over the questions."""
    low = F.lower(question)
    places = []
    for ticker in {**aliases, **patterns}:
        at = None
        for alias in sorted(aliases.get(ticker, ()), key=len, reverse=True):
            found = F.nullif(F.regexp_instr(low, F.lit(_java(alias))), F.lit(0))
            at = found if at is None else F.coalesce(at, found)
        if ticker in patterns:
            found = F.nullif(F.regexp_instr(low, F.lit(patterns[ticker])), F.lit(0))
            at = found if at is None else F.coalesce(at, found)
        places.append(F.struct(at.alias("at"), F.lit(ticker).alias("ticker")))
    return F.transform(F.array_sort(F.filter(F.array(*places), lambda p: p["at"].isNotNull())), lambda p: p["ticker"])


# Private-use characters that stand for a company that goes, and around the one that stays.
_GONE, _KEPT = "\ue000", "\ue001"
_JOINT = r"(?:\s*(?:,\s*(?:and|or)\b|[,&]|\b(?:and|or|versus|vs\b\.?))\s*)"
# A mention that goes, with its possessive; a list of mentions, which "both" may introduce.
_OWN = r"(?:['\x{2019}]s?(?!\w))?"
_MENTION = rf"\s*{_GONE}{_OWN}"
_BOTH = r"(?:\bboth\s+)?"


def _named(ticker: str, aliases: dict[str, tuple[str, ...]], patterns: dict[str, str]) -> str | None:
    """A pattern for all forms of a company's name, the longest first."""
    forms = [_java(x) for x in sorted({*aliases.get(ticker, ()), *C.STRIP_EXTRA.get(ticker, ())}, key=lambda x: (-len(x), x))]
    if ticker in patterns:
        forms.append(patterns[ticker])
    return "(?i)(?:" + "|".join(forms) + ")" if forms else None


def _collapsed(marked: Column) -> Column:
    """A list of mentions becomes its one member that stays; a list of which
    none stays goes, with the joint that ties it to what follows or, at an end, precedes."""
    out = F.regexp_replace(marked, rf"(?i){_BOTH}(?:{_MENTION}{_JOINT})*\s*{_KEPT}([^{_KEPT}]*){_KEPT}({_OWN})(?:{_JOINT}{_MENTION})*", " $1$2")
    out = F.regexp_replace(out, rf"(?i){_BOTH}{_MENTION}(?:{_JOINT}?{_MENTION})*", f" {_GONE}")
    out = F.regexp_replace(out, rf"(?i){_GONE}\s*(?:{_JOINT}|(?=[?.!]|$))|{_JOINT}?{_GONE}(?=\s*(?:[?.!]|$))|{_GONE}", " ")
    # One space between words, none before a stop or at the ends.
    return F.btrim(F.regexp_replace(F.regexp_replace(out, r"\s+", " "), r" (?=[,?.!])", ""), F.lit(" ,"))


def sub_question(question: Column, keep: Column, named: Column, aliases: dict[str, tuple[str, ...]] = C.COMPANY_ALIASES, patterns: dict[str, str] = C.COMPANY_PATTERNS) -> Column:
    """The question for one company of several: every other named one goes, and
    what tied it to its neighbours. keep is a ticker, named an array of them;
    a question that names one company or none stays as it is."""
    out = question
    for ticker in {**aliases, **patterns}:
        if (pattern := _named(ticker, aliases, patterns)) is None:
            continue
        # The condition picks pattern and text, so that out stands in the expression once.
        by = F.when(keep == ticker, F.lit(f"{_KEPT}$0{_KEPT}")).otherwise(F.lit(_GONE))
        out = F.regexp_replace(out, F.when(F.array_contains(named, ticker), F.lit(pattern)).otherwise(F.lit("(?!)")), by)
    return F.when(F.size(named) > 1, _collapsed(out)).otherwise(question)


def strip_others(question: Column, keep: str, tickers: tuple[str, ...]) -> Column:
    """sub_question for a ticker to keep and named ones that are the same for all rows."""
    return sub_question(question, F.lit(keep), F.array(*(F.lit(t) for t in tickers)))
