import random

import pytest
import sentencepiece

from plumbline.llm import sentencepieces as sp

MODEL = sentencepiece.SentencePieceProcessor(model_file=sp.MODEL_PATH)
CODEC = sp.Codec(sp.load())


def same(text):
    ids = MODEL.encode(text)
    assert CODEC.encode(text) == ids
    assert CODEC.decode(ids) == MODEL.decode(ids)


@pytest.mark.parametrize("text", ["", " ", "  ", "a", "Hello  world\n é ☃ ", "▁x a▁b", "\x00\t\r\n", "ﬁ Å ①", "=" * 1000, "   " * 300 + "x", "日本語 의 text", "a" * 5000, "ab" * 3000])
def test_as_the_library(text):
    same(text)


def test_random_texts():
    rng = random.Random(2)
    for _ in range(1500):
        same("".join(rng.choice("ab cde  the in ing er\n\té☃--#①日本語의") for _ in range(rng.randint(0, 90))))


def prose(n, seed=4):
    rng = random.Random(seed)
    words = ["the", "inth", "Enter", "sheading", "éàç", "ﬁn.", "a\nb", "nation,", "über", "東京", "x" * 70]
    return " ".join(rng.choice(words) + rng.choice(["", "s", "ing", "ation"]) for _ in range(n))


def test_window_of_a_long_word():
    text = "".join(random.Random(3).choice("abcdefgh") for _ in range(20_000))
    codec = sp.Codec(sp.load())
    assert codec.encode(text) == MODEL.encode(text)
    assert codec.commits > 100 and codec.widest <= 10 * codec.longest


def test_prose_streams_through_the_window():
    """160,000 characters through one sliding window: commits all along, few boundaries held."""
    text = prose(24_000)[:160_000]
    codec = sp.Codec(sp.load())
    found = [ids for ids in codec.search(codec._normalized(text)) if ids]
    assert [i for ids in found for i in ids] == MODEL.encode(text)
    assert codec.commits > 2_000 and codec.widest <= 10 * codec.longest and max(map(len, found)) <= 10 * codec.longest


def test_prose_in_lockstep():
    text = prose(20_000)
    codec = sp.Codec(sp.load())
    assert codec.encode(text) == MODEL.encode(text)
    assert codec.commits > 40 and codec.widest <= max(sp.WORD_CHARS + 1, 10 * codec.longest)


def test_parts_and_generations(monkeypatch):
    """Texts cut for normalisation, groups of few words and a small memory give the same ids."""
    text = prose(3_000, 9) + "  two  spaces\n\nlines " + prose(50, 1)
    for name, value in (("PART_CHARS", 100), ("GROUP", 50), ("MEMO", 5), ("PAIR_BITS", 4), ("PAIRS", 7)):
        monkeypatch.setattr(sp, name, value)
    codec = sp.Codec(sp.load())
    assert len(list(codec._normalized(text))) > 100
    assert codec.encode(text) == MODEL.encode(text)
    assert [i for ids in codec.search(codec._normalized(text)) for i in ids] == MODEL.encode(text)


def test_unigram_search():
    """A unigram model's search against all segmentations."""
    codec = sp.Codec.__new__(sp.Codec)
    pieces = {"a": -2.0, "b": -2.5, "c": -3.0, "ab": -3.2, "bc": -4.4, "abc": -5.9, "ca": -4.0, "aa": -3.9}
    codec.bytes = {}
    codec._prepare(sp.UNIGRAM, list(pieces), list(pieces.values()), {p: i for i, p in enumerate(pieces)})

    def best(text, memo={}):  # noqa: B006
        if text not in memo:
            memo[text] = max((pieces[text[:n]] + best(text[n:]) for n in range(1, 4) if text[:n] in pieces), default=float("-inf")) if text else 0.0
        return memo[text]

    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("abc") for _ in range(rng.randint(1, 60)))
        cut = rng.randint(0, len(text))
        ids = [i for part in codec.search((text[:cut], text[cut:])) for i in part]
        assert "".join(codec.text[i] for i in ids) == text
        assert sum(codec.score[i] for i in ids) == pytest.approx(best(text))


def test_frames(spark):
    rows = [(1, "the text", 3), (2, None, 3), (3, "", 3), (3, "", 3), (None, "x " * 20_000, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int").drop("ids").selectExpr("*", "'e' as extra")
    got = {r["doc_id"]: r for r in sp.encode(docs, decoded="back").collect()}
    assert list(got[1]["ids"]) == MODEL.encode("the text") and got[2]["ids"] == [] and got[None]["back"] == "x " * 20_000 and got[1]["extra"] == "e"
    again = {r["doc_id"]: r["out"] for r in sp.decode(sp.encode(docs), out="out").collect()}
    assert again[1] == "the text" and again[3] == ""
    assert sp.encode(docs.limit(0)).count() == 0


def test_query(spark):
    rows = sp.op7_sentencepiece(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 200 and all(r["round_trip"] for r in rows)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert all(list(r["ids"]) == MODEL.encode(texts[r["doc_id"]]) for r in rows)
