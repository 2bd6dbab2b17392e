"""Joins that hold at any size: checked broadcasts, and containment of texts in texts."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import tokens

#: Tables of at most so many rows are broadcast; larger ones are joined by shuffle.
LOOKUP_ROWS = 100_000
#: Tokens of a needle that stand whole in any text that holds it: neither at an end nor beside a wildcard.
WHOLE_TOKEN = r"(?<=[^\p{L}\p{N}%_])[\p{L}\p{N}]+(?=[^\p{L}\p{N}%_])"


def is_small(df: DataFrame, limit: int = LOOKUP_ROWS) -> bool:
    return df.limit(limit + 1).count() <= limit


def lookup(small: DataFrame, limit: int = LOOKUP_ROWS) -> DataFrame:
    """small, marked for broadcast if a count of its rows proves it small."""
    return F.broadcast(small) if is_small(small, limit) else small


def lookup_if(proved: bool, small: DataFrame) -> DataFrame:
    """small, marked for broadcast if something that has as many rows was counted."""
    return F.broadcast(small) if proved else small


def holding(texts: DataFrame, needles: DataFrame, test: Column, key: str = "chunk_id", text: str = "content", needle: str = "needle", on: tuple[str, ...] = (), block: int = 500) -> DataFrame:
    """(key, text, *on, needle): the pairs of rows of texts(key, text, *on) and needles(needle, *on) whose
    on columns are equal and that pass test, a condition on text and needle
    that no text passes without the needle's whole tokens, whatever their case.

    A needle looks for its longest whole token, so the pairs that are tested
    come from an equi-join. Needles without a whole token, such as single
    words, are tested against all texts, in blocks of a fixed size."""
    wanted = needles.filter(F.col(needle).isNotNull()).select(*on, needle).distinct()
    whole = F.regexp_extract_all(F.lower(needle), F.lit(WHOLE_TOKEN), 0)
    longest = F.array_max(F.transform(whole, lambda t: F.struct(F.char_length(t).alias("n"), t.alias("token"))))["token"]
    wanted = wanted.withColumn("_hd_token", longest)
    words = texts.select(key, *on, F.explode(F.array_distinct(tokens(F.col(text)))).alias("_hd_token"))
    seeking = wanted.filter("_hd_token is not null")
    ids = words.join(lookup(seeking), ["_hd_token", *on]).select(F.col(key).alias("_hd_key"), F.col(needle).alias("_hd_needle"), *(F.col(c).alias(f"_hd_{c}") for c in on)).distinct()
    body = texts.select(key, text, *on)
    found = body.join(ids, _all([F.col(key) == F.col("_hd_key"), *(F.col(c) == F.col(f"_hd_{c}") for c in on)])).withColumnRenamed("_hd_needle", needle)
    found = found.filter(test).select(key, text, *on, needle)
    bare = wanted.filter("_hd_token is null").drop("_hd_token")
    blocks = -(-bare.count() // block)
    for b in range(blocks):
        some = bare.filter(F.pmod(F.xxhash64(needle, *on), F.lit(blocks)) == b)
        some = some.select(needle, *(F.col(c).alias(f"_hd_{c}") for c in on))
        found = found.unionByName(body.join(lookup(some), _all([F.col(c) == F.col(f"_hd_{c}") for c in on]) & test).select(key, text, *on, needle))
    return found


def _all(conditions: list[Column]) -> Column:
    return reduce(and_, conditions) if conditions else F.lit(True)
