"""Language identification: sparse multinomial logistic regression on TF-IDF
character n-grams, trained by follow-the-regularised-leader with elastic-net
penalties, then calibrated by a temperature."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import SAMPLE_BYTES, bounded_sample, hash60, held_out, learnable, materialize, remove, small_batches, table

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
ORDERS = (1, 2, 3)
#: Most labelled documents that the classifier is fitted on, and letters in all of them.
TRAIN_DOCS = 4_000
EPOCHS = 3
UNKNOWN = "und"
#: Characters handled at a time.
PIECE = 1 << 18


@cache
def _letters() -> np.ndarray:
    """Which code points are letters; combining marks go with their letters."""
    import unicodedata

    out = np.zeros(0x110000, dtype=bool)
    out[[i for i in range(0x110000) if chr(i).isalpha() or 0x300 <= i < 0x370 or (i > 0x7FF and unicodedata.category(chr(i)) in ("Mn", "Mc"))]] = True
    return out


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def ngram_buckets(text: str) -> Iterator[np.ndarray]:
    """Hash buckets of the character n-grams of the whole text, lower-cased,
    all but letters as spaces; piece by piece, an n-gram belongs to the piece it ends in."""
    lower, reach = text.lower(), max(ORDERS) - 1
    for start in range(0, max(1, len(lower)), PIECE):
        part = (" " if start == 0 else "") + lower[max(0, start - reach) : start + PIECE] + (" " if start + PIECE >= len(lower) else "")
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(_letters()[codes], codes, 32).astype(np.uint64)
        skip = reach if start else 0
        out = []
        for n in ORDERS:
            if codes.size < n:
                continue
            h = np.full(codes.size - n + 1, n, dtype=np.uint64)
            letter = np.zeros(h.size, dtype=bool)
            for i in range(n):
                at = codes[i : i + h.size]
                h = (h ^ at) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
                letter |= at != 32
            first = max(0, skip - n + 1)
            out.append((h[first:] >> np.uint64(64 - BUCKET_BITS))[letter[first:]].astype(np.int64))
        yield np.concatenate(out) if out else np.zeros(0, np.int64)


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    #: (buckets, languages): idf times weight.
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.languages)), 0
        for buckets in ngram_buckets(text):
            total += np.take(self.weights, buckets, axis=0).sum(axis=0)
            n += buckets.size
        return total / max(1, n) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not has_letter(text) or not self.languages:
            return UNKNOWN, 0.0
        p = softmax(self.logits(text) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def document_frequencies(texts: DataFrame, text: str = "text") -> tuple[int, np.ndarray]:
    """Number of rows, and of rows that hold each bucket, over all of texts.

    A partition yields one vector, vectors are added up in groups, and the
    driver gets one vector of BUCKETS numbers."""
    spark = texts.sparkSession

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n, seen = np.zeros(BUCKETS, np.int64), 0, np.full(BUCKETS, -1, np.int64)
        for pdf in batches:
            for x in pdf[text]:
                for buckets in ngram_buckets(x or ""):
                    seen[buckets] = n
                df += seen == n
                n += 1
        if n:
            yield pd.DataFrame({"n": [n], "df": [df.tobytes()]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(BUCKETS, np.int64), 0
        for pdf in batches:
            n += int(pdf["n"].sum())
            for x in pdf["df"]:
                df += np.frombuffer(x, np.int64)
        if n:
            yield pd.DataFrame({"n": [n], "df": [df.tobytes()]})

    parts = texts.select(text).mapInPandas(count, "n long, df binary")
    for width in (64, 1):
        parts = parts.repartition(width if width == 1 else min(width, spark.sparkContext.defaultParallelism)).mapInPandas(add, "n long, df binary")
    row = parts.first()
    return (0, np.zeros(BUCKETS, np.int64)) if row is None else (row["n"], np.frombuffer(row["df"], np.int64))


def _features(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    buckets = np.concatenate(list(ngram_buckets(text)))
    at, n = np.unique(buckets, return_counts=True)
    return at, n / max(1, buckets.size) * idf[at]


def fit(texts: list[str], langs: list[str], idf: np.ndarray, alpha: float = 0.5, beta: float = 1.0, l1: float = 2e-5, l2: float = 1e-4, epochs: int = EPOCHS, scale: float = 50.0, seed: int = 7) -> LanguageModel:
    """FTRL-proximal, one state per bucket and language. Every fifth document
    is kept out of training and gives the temperature."""
    languages = sorted(set(langs))
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0)
    number = {x: i for i, x in enumerate(languages)}
    z, s = np.zeros((BUCKETS, len(languages))), np.zeros((BUCKETS, len(languages)))
    zb = np.zeros(len(languages))
    data = [(*_features(t, idf), number[x]) for t, x in zip(texts, langs, strict=True) if has_letter(t)]
    kept_out = data[::5] if len(data) >= 50 else data
    train = [x for i, x in enumerate(data) if i % 5] if len(data) >= 50 else data

    def weights(at: np.ndarray) -> np.ndarray:
        zz = z[at]
        w = -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(s[at])) / alpha + l2)
        return np.where(np.abs(zz) <= l1, 0.0, w)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(train)):
            at, x, y = train[i]
            x = x * scale
            w = weights(at)
            p = softmax(x @ w + zb)
            p[y] -= 1
            zb -= 0.01 * p
            g = x[:, None] * p
            sigma = (np.sqrt(s[at] + g * g) - np.sqrt(s[at])) / alpha
            z[at] += g - sigma * w
            s[at] += g * g
    full = weights(np.arange(BUCKETS)) * scale
    logits = np.array([x @ full[at] + zb for at, x, _ in kept_out]).reshape(-1, len(languages))
    labels = np.array([y for *_, y in kept_out], dtype=np.int64)
    temperatures = np.geomspace(0.05, 5, 60)
    losses = [-np.log(softmax(logits / t)[np.arange(len(labels)), labels] + 1e-9).mean() if len(labels) else 0.0 for t in temperatures]
    return LanguageModel(languages, full * idf[:, None], zb, float(temperatures[int(np.argmin(losses))]))


def train(docs: DataFrame, limit: int = TRAIN_DOCS, nbytes: int = SAMPLE_BYTES, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageModel:
    """Fit on at most limit documents and nbytes of them, of the rows with a
    language whose crc32(doc_id) mod 3 isn't 1: languages take turns with their
    least hashes, repeated rows count once. The inverse document frequencies
    cover all such rows."""
    small_batches(docs.sparkSession)
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & learnable(F.col(doc_id)))
    n, df = document_frequencies(rows, text)
    idf = np.log((1 + n) / (1 + df)) + 1
    keyed = rows.select(hash60(F.col(doc_id)).alias("h"), F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("same"))
    # Repeated rows count once; hashes alone are dealt and ordered.
    gone: list[str] = []
    each = materialize(keyed.groupBy("h", "lang", "same").agg(F.max(F.octet_length("text")).cast("long").alias("size")), "lang-rows", gone)
    chosen = F.broadcast(bounded_sample(each, limit, nbytes, ("h", "lang", "same"), "lang").drop("size"))
    sample = keyed.join(chosen, ["h", "lang", "same"]).groupBy("h", "lang", "same").agg(F.first("text").alias("text")).toPandas()
    remove(docs.sparkSession, gone)
    sample = sample.sort_values(["h", "text", "lang"]).drop_duplicates(["lang", "text"])
    return fit(sample["text"].tolist(), sample["lang"].tolist(), idf)


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", lang: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """docs with the language and its score; columns of these names are replaced.
    A null text, or one without a letter, is und with score 0."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(x) for x in texts], columns=["lang", "score"])

    found = docs.withColumn("_li", of(F.col(text)))
    return found.withColumns({lang: F.col("_li.lang"), score: F.col("_li.score")}).drop("_li")


def keep_known(docs: DataFrame, min_score: float = 0.4, **columns: str) -> DataFrame:
    """The documents whose language is found with at least min_score, with the columns they had."""
    found = predict(docs, train(docs, **columns), columns.get("text", "text"), "_li_lang", "_li_score")
    return found.filter((F.col("_li_lang") != UNKNOWN) & (F.col("_li_score") >= min_score)).select(*docs.columns)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = predict(docs, train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
