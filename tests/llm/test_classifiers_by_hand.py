"""The classifiers' queries against plain recomputations, row by row, from the trained weights."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from plumbline.llm import common, langid, toxicity

SF = "/root/testdata/sf0.001"


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_language_by_hand(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs.select("doc_id", "text", "lang"))

    def predicted(text):
        if not any(c.isalpha() for c in text or ""):
            return "und", 0.0
        codes = [ord(c) if c.isalpha() or 0x300 <= ord(c) < 0x370 else 32 for c in f" {text.lower()} "]
        total, n = np.zeros(len(model.languages)), 0
        for size in (1, 2, 3):
            for i in range(len(codes) - size + 1):
                gram = codes[i : i + size]
                if any(c != 32 for c in gram):
                    h = size
                    for c in gram:
                        h = (h ^ c) * 0x9E3779B97F4A7C15 % (1 << 64)
                        h ^= h >> 29
                    total += model.weights[h >> (64 - langid.BUCKET_BITS)]
                    n += 1
        e = np.exp((total / n + model.bias) / model.temperature)
        p = e / e.sum()
        return model.languages[int(p.argmax())], float(p.max())

    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = langid.op10_language_id(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        lang, score = predicted(texts[r["doc_id"]])
        assert r["lang_pred"] == lang and r["score"] == pytest.approx(score) and r["held_out"] == held(r["doc_id"])


def test_toxicity_by_hand(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    fm = toxicity.train(docs.select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic"))

    def score(text):
        counts = Counter()
        for word, n in Counter(re.findall(r"[^\W\d_]+", (text or "").lower())).items():
            for term in [f"={word}", *(f"^{word[:k]}" for k in (3, 4, 5, 6, 8) if len(word) >= k)]:
                counts[int(fm.slot[xxhash.xxh64_intdigest(term) >> 44])] += n
        counts.pop(0, None)
        at, x = list(counts), np.array([1 + math.log(n) for n in counts.values()])
        x = x * min(1.0, toxicity.NORM / (float(np.sqrt((x * x).sum())) or 1.0))
        meeting = fm.v[at] @ fm.v[at].T * np.outer(x, x)
        raw = fm.bias + float(fm.w[at] @ x) + float(np.triu(meeting, 1).sum())  # each pair of terms once
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, fm.slope * raw + fm.shift))))

    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = toxicity.op9_toxicity(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = score(texts[r["doc_id"]])
        assert r["score"] == pytest.approx(want, abs=1e-9) and r["predicted"] == (want >= 0.7) and r["held_out"] == held(r["doc_id"])


def test_samples_are_bounded_and_settled(spark):
    """Ties, repeated rows and bytes: the same rows whatever their order; a rare language gets its turn."""
    rows = [(i % 40, "x" * (i % 7 + 1), "rare" if i % 40 == 3 else "often", i % 7 + 1) for i in range(400)]
    df = spark.createDataFrame(rows, "h long, text string, lang string, size long").distinct()
    pick = lambda d, **k: sorted(map(tuple, common.bounded_sample(d, 20, order=("h", "text"), **k).collect()))
    assert pick(df) == pick(df.repartition(7, "text")) == pick(df.orderBy(F.desc("h"))) and len(pick(df)) == 20
    assert sum(r[3] for r in pick(df, nbytes=30)) <= 30 and len(pick(df, nbytes=0)) == 1
    assert sum(r[2] == "rare" for r in pick(df, per="lang")) >= 5 and len(pick(df.limit(0))) == len(pick(df.limit(0), per="lang")) == 0
    many = spark.range(6_000).selectExpr("id as h", "'t' as text", "if(id % 100 = 0, 'rare', 'often') as lang", "1L as size")
    got = pick(many, per="lang")
    assert got == pick(many.repartition(9), per="lang") and [r[2] for r in got].count("rare") == 10 == len(got) - 10


def test_repeated_rows_change_no_model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").limit(80)
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    twice = docs.unionAll(docs).repartition(5)
    a, b = toxicity.train(docs, labels), toxicity.train(twice, labels)
    assert (a.w == b.w).all() and a.bias == b.bias
    assert langid.train(docs).languages == langid.train(twice).languages
