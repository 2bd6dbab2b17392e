"""Percentile bootstraps. The published figures depend on the random calls of
their language's generator, so the resampling runs it, in one task per group
of question-level values. Its time is the number of repetitions times that of
values, so groups are meant to have hundreds of questions, not corpus rows."""

from __future__ import annotations

import random
import statistics
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame

#: reps, seed, index of the upper end below the 97.5th percentile, and how a mean is drawn.
VARIANTS: dict[str, tuple[int, int, int, Callable[[random.Random, list[float]], float]]] = {
    "mean": (10_000, 0, 0, lambda r, v: sum(r.choice(v) for _ in v) / len(v)),
    "paired": (10_000, 20260918, 1, lambda r, v: sum(v[r.randrange(len(v))] for _ in v) / len(v)),
    "ordering": (20_000, 20260908, 0, lambda r, v: statistics.fmean(r.choices(v, k=len(v)))),
}


def interval(values: list[float], variant: str = "mean") -> tuple[float, float]:
    """The 95% interval of the mean; (0, 1) without values."""
    if not values:
        return 0.0, 1.0
    reps, seed, less, draw = VARIANTS[variant]
    rng = random.Random(seed)
    means = sorted(draw(rng, values) for _ in range(reps))
    return means[int(0.025 * reps)], means[int(0.975 * reps) - less]


def bootstrap(rows: DataFrame, group: str, order: str, value: str, variant: str = "mean") -> DataFrame:
    """(group, n, mean, low, high); values in order of `order`, nulls left out."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values(order)[value].dropna().tolist()
        low, high = interval(v, variant)
        return pd.DataFrame({group: [pdf[group].iloc[0]], "n": [len(v)], "mean": [sum(v) / len(v) if v else None], "low": [low], "high": [high]})

    kind = dict(rows.dtypes)[group]
    return rows.select(group, order, value).groupBy(group).applyInPandas(run, f"{group} {kind}, n long, mean double, low double, high double")
