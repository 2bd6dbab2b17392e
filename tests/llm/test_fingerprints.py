import hashlib
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from plumbline.llm import fingerprints as fp


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def fingerprint(text, k=64):
    """The k least shingle hashes by a plain loop: XXH64 with seed 42, chained over the five words' hashes."""
    signed = lambda h: h - (1 << 64) if h >> 63 else h

    def chain(hashes):
        out = 42
        for h in hashes:
            out = xxhash.xxh64_intdigest(struct.pack("<Q", h), out)
        return out

    words = [xxhash.xxh64_intdigest(w.encode(), 42) for w in (text or "").lower().split()]
    found = {chain(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {chain(words)} if words else set()
    return ",".join(f"{h & (1 << 64) - 1:x}" for h in sorted(map(signed, found))[:k])


def test_query(spark, tmp_path):
    texts = [None, "", " \n", "one two", "a b c d e f g h", "é" * 11, "x y z " * 400, "a b c d e f g h", " ".join(f"long{i}" for i in range(60_000))] + [f"w{i} v{i % 3} common words here and there {i}" for i in range(60)]
    rows = [(i * i + 3, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    old = fp.BUCKET_ROWS
    fp.BUCKET_ROWS = 4
    try:
        got = {r["doc_id"]: r for r in fp.op3_fingerprints(spark, str(tmp_path)).collect()}
    finally:
        fp.BUCKET_ROWS = old
    order = sorted(rows, reverse=True)
    assert len(got) == len(rows)
    for (i, t), (_, u) in zip(order, [*order[1:], order[0]], strict=True):
        t, u = t or "", u or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + u[:half]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == fingerprint(t) and r["edited_fingerprint"] == fingerprint(edited)
        union = set(fingerprint(t).split(",")) | set(fingerprint(u).split(",")) - {""}
        if len(shingles(t) | shingles(u)) < 64 and t and u:
            assert r["n_shingles_with_next"] == len(union) and r["n_shingles_estimate"] == len(shingles(t))
            a, b = shingles(t), shingles(edited)
            assert len(a | b) >= 64 or r["held_by_edited"] == pytest.approx(len(a & b) / len(a) if a else 1.0)
        for name, other in (("near_edited", edited), ("near_next", u)):
            a, b = shingles(t), shingles(other)
            want = len(a & b) / len(a | b) if a | b else 1.0
            assert r[name] == pytest.approx(want) if len(a | b) <= 64 else abs(r[name] - want) < 0.3


def test_merge_and_estimates(spark):
    df = spark.createDataFrame([(" ".join(f"w{i}" for i in range(0, 3000)), " ".join(f"w{i}" for i in range(1000, 4000)))], "a string, b string")
    df = fp.with_sketch(fp.with_sketch(df, "a", "sa", k=512), "b", "sb", k=512)
    a, b = F.col("sa"), F.col("sb")
    r = df.select(fp.resemblance(a, b, 512).alias("j"), fp.containment(a, b, 512).alias("c"), fp.distinct_count(a, 512).alias("n"), (fp.merge_sketches(a, b, 512) == fp.merge_sketches(b, a, 512)).alias("same"), (fp.merge_sketches(a, a, 512) == a).alias("own")).first()
    assert abs(r["j"] - 1996 / 3996) < 0.08 and abs(r["c"] - 1996 / 2996) < 0.12 and abs(r["n"] / 2996 - 1) < 0.15
    assert r["same"] and r["own"]


def test_merged_by_equals_whole(spark):
    parts = [(i % 3, " ".join(f"g{i % 3}w{j}" for j in range(i, i + 90))) for i in range(30)]
    df = fp.with_sketch(spark.createDataFrame(parts, "g int, text string"))
    merged = {r["g"]: r["sketch"] for r in fp.merged_by(df, ["g"]).collect()}
    for g in range(3):
        every = sorted({h for r in df.filter(F.col("g") == g).collect() for h in r["sketch"]})[:64]
        assert merged[g] == every


def test_null_ids_and_repeats(spark):
    rows = [(None, "b b b b b b"), (None, "a"), (7, "c"), (7, "c"), (7, None), (1, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("text", F.coalesce("text", F.lit("")))
    assert sorted(((r["doc_id"] or 0), r["text"], r["next_text"]) for r in fp.with_next(docs).collect()) == sorted([(7, "", "c"), (7, "c", "c"), (7, "c", "d"), (1, "d", "a"), (0, "a", "b b b b b b"), (0, "b b b b b b", "")])
    assert fp.with_next(docs.limit(0)).count() == 0


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", "x", "y", "z"), (2, "c d", "x", "y", "z")], "doc_id long, text string, sketch string, next_text string, other string")
    got = {r["doc_id"]: r for r in fp.with_next(docs).collect()}
    assert got[2]["next_text"] == "a b" and got[1]["next_text"] == "c d" and got[1]["other"] == "z" and len(got[1]["sketch"]) == 1
