import zlib

import numpy as np
import pytest

from plumbline.llm import langid, toxicity

SF = "/root/testdata/sf0.01"


def auc(scores, labels):
    order = np.argsort(np.argsort(scores))
    on = np.array(labels) == 1
    return (order[on].sum() - on.sum() * (on.sum() - 1) / 2) / (on.sum() * (~on).sum())


def test_held_out_accuracy(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    lang = langid.op10_language_id(spark, SF).collect()
    assert len(lang) == len(docs) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in lang)
    held = [r for r in lang if r["held_out"]]
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held]) > 0.97
    tox = [r for r in toxicity.op9_toxicity(spark, SF).collect() if r["held_out"] and r["doc_id"] in labels]
    assert auc([r["score"] for r in tox], [labels[r["doc_id"]] for r in tox]) > 0.9
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in tox)


def test_pairs_are_learned():
    """Neither word alone is toxic, both together are: additive weights can't tell."""
    rng = np.random.default_rng(0)
    texts, labels = [], []
    for _ in range(1200):
        a, b = rng.random(2) < 0.5
        filler = " ".join(rng.choice(["tree", "house", "river", "stone", "cloud"], 6))
        texts.append(f"{filler} {'insultx ' if a else ''}{'groupx' if b else ''}")
        labels.append(int(a and b))
    # Kept terms are those with a marginal effect, which both words have here.
    fm = toxicity.fit(texts, labels, epochs=20)
    got = [fm.score(f"tree {x}") for x in ("insultx", "groupx", "insultx groupx", "")]
    assert got[2] > 0.8 and max(got[0], got[1], got[3]) < 0.3


def test_language_edges(spark):
    en, fr = "the cat and the dog are in the house with her", "le chat et le chien sont dans la maison avec elle"
    rows = [(i, (en if i % 2 else fr) + f" {i}", "en" if i % 2 else "fr", "s") for i in range(200)]
    rows += [(900, None, "en", "s"), (901, "", "fr", "s"), (902, "123 !!", "en", "s"), (None, en, None, "s"), (903, en * 20_000, None, "s"), (904, en, None, "s"), (904, en, None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_score string")
    model = langid.train(docs)
    got = {(r["doc_id"], r["lang"]): r for r in langid.predict(docs, model).collect()}
    assert got[(900, "en")]["lang_pred"] == got[(901, "fr")]["lang_pred"] == got[(902, "en")]["lang_pred"] == "und"
    assert got[(None, None)]["lang_pred"] == got[(903, None)]["lang_pred"] == "en" and 0 <= got[(903, None)]["lang_score"] <= 1
    kept = langid.keep_known(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3
    assert {r["lang_score"] for r in kept.collect()} == {"s"}
    assert langid.predict(docs.limit(0), langid.train(docs.limit(0))).count() == 0
    assert langid.train(docs.limit(0)).predict("the") == ("und", 0.0)


def test_pieces_give_the_same_ngrams(monkeypatch):
    text = "Ein längerer Text, 12 Wörter!" * 9
    whole = np.concatenate(list(langid.ngram_buckets(text)))
    monkeypatch.setattr(langid, "PIECE", 17)
    assert sorted(np.concatenate(list(langid.ngram_buckets(text))).tolist()) == sorted(whole.tolist())


def test_document_frequencies(spark):
    texts = ["aa b", "b", None, "c aa"]
    n, df = langid.document_frequencies(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    want = np.zeros(langid.BUCKETS, int)
    for t in texts:
        want[np.unique(np.concatenate(list(langid.ngram_buckets(t or ""))))] += 1
    assert n == 4 and (df == want).all()


def test_toxicity_edges(spark):
    rows = [(i, "you are a stupid fool" if i % 4 == 0 else "a nice calm day", None) for i in range(300)] + [(None, "stupid", "x"), (500, None, "x"), (501, "", "x"), (502, "calm " * 100_000 + "stupid fool", "x"), (502, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string").selectExpr("*", "'own' as toxicity")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)] + [(None, 1), (5, None), (10_000, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {(r["doc_id"], r["text"]): r["score"] for r in toxicity.score(docs, model, out="score").collect()}
    assert got[(0, "you are a stupid fool")] > 0.7 > 0.3 > got[(1, "a nice calm day")]
    assert got[(500, None)] == got[(501, "")] < 0.7 and len(got) == len(rows)
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns and {r["toxicity"] for r in kept.collect()} == {"own"}
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), labels)).count() == 0
    assert toxicity.train(docs, labels.limit(0)).score("stupid") == pytest.approx(0, abs=1e-9)
