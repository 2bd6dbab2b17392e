from collections import Counter

import pytest

import corpus_pipeline
from plumbline.llm import langid, mixing, sentencepieces, toxicity

SF = "/root/testdata/sf0.001"


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "near_duplicates", "mixture", "tokens"]


def test_run_against_brute_force(spark):
    """Every stage's decisions by hand: the models row by row, all pairs, and the mix's own words."""
    from tests.llm.test_ngram_join import brute

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    model = langid.train(docs)
    kept = [r for r in rows if (p := model.predict(r["text"]))[0] != "und" and p[1] >= 0.4]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    ids = {r["doc_id"] for r in kept}
    tox = toxicity.train(docs.filter(docs.doc_id.isin(*ids)), labels)
    kept = [r for r in kept if tox.score(r["text"]) < toxicity.THRESHOLD]
    component = brute([(r["doc_id"], r["text"]) for r in kept])
    kept = [r for r in kept if component[r["doc_id"]] == r["doc_id"]]
    mixed = {r["doc_id"]: r["mix_epochs"] for r in mixing.mix(docs.filter(docs.doc_id.isin(*(r["doc_id"] for r in kept)))).collect()}
    codec = sentencepieces.Codec(sentencepieces.load())
    want = Counter((r["doc_id"], tuple(codec.encode(r["text"]))) for r in kept for _ in range(mixed[r["doc_id"]]))
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == want and all(r["round_trip"] for r in got)


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES[:-1])
def test_stages_keep_columns_and_bear_odd_rows(spark, name, stage):
    rows = [(1, None, None, None, 0), (None, "some words of a text", "en", "a", 20), (2, "", "en", "a", 0), (3, "some words of a text that is longer", "en", "a", 35), (3, "some words of a text that is longer", "en", "a", 35)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert stage(spark, docs, SF).columns == docs.columns
    assert stage(spark, docs, SF).count() <= 3 * len(rows)
    assert stage(spark, docs.limit(0), SF).count() == 0
