"""Toxicity by a factorization machine over hashed terms.

Besides a weight, each term has a short vector; the product of two terms'
vectors weighs their meeting in one text, such as an insult with the mention
of a group, which added weights alone can't express."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import batched, chain, pairwise

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import SAMPLE_BYTES, bounded_sample, hash60, held_out, learnable, small_batches, table

HASH_BITS = 20
#: Beginnings of words are terms too, so that inflected and joined forms share them.
PREFIXES = (3, 4, 5, 6, 8)
FACTORS = 4
#: Most labelled documents that the model is fitted on.
TRAIN_DOCS = 8_000
THRESHOLD = 0.7
#: Largest norm of a text's values.
NORM = 5.0
#: Words whose terms a worker remembers, and texts that it looks up together.
MEMO, GROUP = 100_000, 128
WORD = re.compile(r"[^\W\d_]+")


def word_terms(word: str) -> list[int]:
    """Hashes of a lower-case word and of its beginnings."""
    return [xxhash.xxh64_intdigest(x) >> (64 - HASH_BITS) for x in (f"={word}", *(f"^{word[:n]}" for n in PREFIXES if len(word) >= n))]


@dataclass
class FactorizationMachine:
    """Over the terms of the training texts; row 0 stands for all others and is zero."""

    slot: np.ndarray = field(default_factory=lambda: np.zeros(1 << HASH_BITS, np.int32))
    bias: float = 0.0
    w: np.ndarray = field(default_factory=lambda: np.zeros(1))
    v: np.ndarray = field(default_factory=lambda: np.zeros((1, FACTORS)))
    slope: float = 1.0
    shift: float = 0.0

    def __post_init__(self) -> None:
        self.memo: dict[str, bytes] = {}

    def terms(self, texts: Iterable[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each whole text the slots of its known terms and their values 1 + ln(count), scaled down where their norm is over NORM."""
        for some in batched(texts, GROUP):
            counts = [Counter(WORD.findall(text.lower())) for text in some]
            new = list(dict.fromkeys(word for each in counts for word in each if word not in self.memo))
            if len(self.memo) + len(new) > MEMO:
                self.memo.clear()
                new = list(dict.fromkeys(word for each in counts for word in each))
            hashes = [word_terms(word) for word in new]
            slots = self.slot[np.fromiter(chain.from_iterable(hashes), np.int64)]
            known = np.concatenate([[0], np.cumsum(slots > 0)])
            ends = 4 * known[np.cumsum([0, *map(len, hashes)])]
            data = slots[slots > 0].tobytes()
            self.memo.update((word, data[a:b]) for word, (a, b) in zip(new, pairwise(ends.tolist()), strict=True))
            for each in counts:
                found = [*map(self.memo.__getitem__, each)]
                sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
                times = np.fromiter(each.values(), np.float64, len(found))
                at, where = np.unique(np.frombuffer(b"".join(found), np.int32).astype(np.int64), return_inverse=True)
                x = 1 + np.log(np.bincount(where, np.repeat(times, sizes), len(at)))
                yield at, x / max(1.0, float(np.linalg.norm(x)) / NORM)

    def raw(self, at: np.ndarray, x: np.ndarray) -> float:
        vx = self.v[at] * x[:, None]
        return self.bias + float(self.w[at] @ x) + 0.5 * float((vx.sum(axis=0) ** 2 - (vx * vx).sum(axis=0)).sum())

    def scores(self, texts: Iterable[str | None]) -> list[float]:
        return [float(sigmoid(self.slope * self.raw(*found) + self.shift)) for found in self.terms(text or "" for text in texts)]

    def score(self, text: str | None) -> float:
        return self.scores([text])[0]


def sigmoid(x: float | np.ndarray) -> float | np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def known_terms(texts: list[str], least: int = 3) -> np.ndarray:
    """Hashes of all terms that at least `least` texts hold, whatever their labels: a term may matter only beside another."""
    held, remembered = np.zeros(1 << HASH_BITS, np.int64), lru_cache(MEMO)(word_terms)
    for text in texts:
        found = {term for word in set(WORD.findall(text.lower())) for term in remembered(word)}
        held[np.fromiter(found, np.int64, len(found))] += 1
    return np.flatnonzero(held >= least)


def fit(texts: list[str], labels: list[int], epochs: int = 12, rate: float = 0.1, l1: float = 1e-3, l2: float = 3e-2, seed: int = 11) -> FactorizationMachine:
    """AdaGrad on the log loss, elastic net on the weights, l2 on the vectors; then
    a logistic calibration on every fifth text, which is kept out. The penalties
    and NORM hold back the many terms that tell nothing, as no term is screened."""
    y = np.array(labels, dtype=np.int64)
    if len(set(labels)) < 2:
        return FactorizationMachine(bias=(-30.0 if not len(y) or not y[0] else 30.0))
    own = np.arange(len(y)) % 5 != 4 if len(y) >= 1000 else np.ones(len(y), bool)
    kept = known_terms([t for t, o in zip(texts, own, strict=True) if o])
    fm = FactorizationMachine()
    fm.slot[kept] = np.arange(1, len(kept) + 1, dtype=np.int32)
    rng = np.random.default_rng(seed)
    fm.w, fm.v = np.zeros(len(kept) + 1), rng.normal(0, 0.02, (len(kept) + 1, FACTORS))
    data = list(fm.terms(texts))
    base = y[own].mean()
    fm.bias = float(np.log(base / (1 - base)))
    # Weight and vector of a term side by side, and their sums of squared gradients.
    both, past, past_bias = np.column_stack([fm.w, fm.v]), np.full((len(fm.w), 1 + FACTORS), 0.1), 0.1
    for _ in range(epochs):
        for i in rng.permutation(np.flatnonzero(own)):
            at, x = data[i]
            mine = both[at]
            px = mine * x[:, None]
            total = px.sum(axis=0)
            s = fm.bias + total[0] + 0.5 * float((total[1:] ** 2 - np.einsum("ij,ij->j", px, px)[1:]).sum())
            e = float(sigmoid(s)) - y[i]
            past_bias += e * e
            fm.bias -= rate * e / past_bias**0.5
            if not len(at):
                continue
            grad = total - px
            grad[:, 0] = 1.0
            grad *= (e * x)[:, None]
            grad += l2 * mine
            squares = past[at] + grad * grad
            past[at] = squares
            step = rate / np.sqrt(squares)
            mine -= step * grad
            w = mine[:, 0]
            mine[:, 0] = np.sign(w) * np.maximum(0, np.abs(w) - step[:, 0] * l1)
            both[at] = mine
    fm.w, fm.v = both[:, 0].copy(), both[:, 1:].copy()
    rest = ~own if (~own).any() else own
    raw = np.clip(np.array([fm.raw(*data[i]) for i in np.flatnonzero(rest)]), -20, 20)
    a, b, t = 1.0, 0.0, y[rest]
    for _ in range(50):  # Newton's method, in steps of 1 at most
        p = sigmoid(a * raw + b)
        q = p * (1 - p)
        g = np.array([((p - t) * raw).sum() + (a - 1), (p - t).sum()])
        h = np.array([[(q * raw * raw).sum() + 1, (q * raw).sum()], [(q * raw).sum(), q.sum() + 1e-3]])
        da, db = (d := np.linalg.solve(h, g)) / max(1.0, float(np.abs(d).max()))
        a, b = a - da, b - db
    fm.slope, fm.shift = max(float(a), 0.05), float(b)
    fm.memo.clear()
    return fm


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS, nbytes: int = SAMPLE_BYTES, doc_id: str = "doc_id", text: str = "text") -> FactorizationMachine:
    """Fit on at most limit labelled documents and nbytes of them, those with
    the least hashes, of those whose crc32(doc_id) mod 3 isn't 1; repeated rows count once. Null labels and ids teach nothing;
    a document with two labels is toxic if one of them is."""
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & learnable(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").alias("_tx_id")).agg(F.max("toxic").alias("toxic"))
    texts = F.coalesce(F.col(text), F.lit(""))
    rows = docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("_tx_id"), F.octet_length(texts).cast("long").alias("size"), F.xxhash64(texts).alias("same"))
    # Repeated rows count once; ids and hashes alone are dealt and ordered.
    rows = rows.join(known, "_tx_id").groupBy("_tx_id", "same").agg(F.max("toxic").alias("toxic"), F.max("size").alias("size")).withColumn("h", hash60(F.col("_tx_id")))
    chosen = F.broadcast(bounded_sample(rows, limit, nbytes, ("h", "_tx_id", "same")))
    sample = docs.join(chosen, (F.col(doc_id) == F.col("_tx_id")) & (F.xxhash64(texts) == F.col("same")))
    # A chosen row stands for all that repeat it.
    sample = sample.groupBy("h", "_tx_id", "same").agg(F.first(texts).alias("text"), F.first(chosen["toxic"]).alias("toxic")).toPandas()
    sample = sample.sort_values(["h", "text"])
    return fit(sample["text"].tolist(), sample["toxic"].clip(0, 1).astype(int).tolist())


def score(docs: DataFrame, model: FactorizationMachine, text: str = "text", out: str = "toxicity") -> DataFrame:
    """docs with the toxicity in out, from 0 to 1; a column of this name is replaced. A null text scores as an empty one."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fm = shared.value
        for texts in batches:
            yield pd.Series(fm.scores(texts), dtype="float64")

    return docs.withColumn(out, of(F.col(text)))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **columns: str) -> DataFrame:
    """The documents that score below threshold, with the columns they had."""
    found = score(docs, train(docs, labels, **columns), columns.get("text", "text"), "_tx_score")
    return found.filter(F.col("_tx_score") < threshold).select(*docs.columns)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"))
