"""Language models behind one interface. Offline there is the echo provider;
others are registered by the caller."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline import config as C

Provider = Callable[[str, str, int], str]
PROVIDERS: dict[str, Callable[[], Provider]] = {}


def echo(reply: str = C.REFUSAL_MARKER) -> Provider:
    return lambda system, user, max_tokens: reply


PROVIDERS["echo"] = echo


def provider(name: str = "echo", require: str | None = None) -> Provider:
    """A registered provider; asking for another than the required one is an error."""
    if require and name != require:
        raise ValueError(f"this run needs the provider {require}, not {name}")
    if name not in PROVIDERS:
        raise ValueError(f"no provider {name}; known: {', '.join(sorted(PROVIDERS))}")
    return PROVIDERS[name]()


def with_retries(call: Callable[[], str], attempts: int = 5, retry_on: tuple[type[Exception], ...] = (ConnectionError, TimeoutError), sleep: Callable[[float], None] = time.sleep) -> str:
    """Try again after 2, 4, 8 ... seconds and up to one more."""
    for n in range(attempts):
        try:
            return call()
        except retry_on:
            if n == attempts - 1:
                raise
            sleep(2.0 * 2**n + random.random())
    raise AssertionError


def complete(prompts: DataFrame, make: Callable[[], Provider], system: str, user: str = "message", out: str = "reply", max_tokens: int = 700) -> DataFrame:
    """prompts with the provider's replies; it is made once per task, never per row."""

    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ask = make()
        for texts in batches:
            yield texts.map(lambda t: with_retries(lambda: ask(system, t, max_tokens)))

    return prompts.withColumn(out, of(F.col(user)))


def uncached(prompts: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """Prompts whose key the cache lacks."""
    return prompts.join(cache.select(key), key, "left_anti")
