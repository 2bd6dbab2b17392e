import random
import time

import pytest

from plumbline.llm import extraction as ex

MODEL = ex.default_model()


def test_held_out_pages():
    pages = ex.training_pages(250, 77)
    got = [(MODEL.decode([MODEL.emission(f) for f in features]), labels) for features, labels in pages]
    blocks = sum(len(y) for _, y in got)
    assert sum(a == b for p, y in got for a, b in zip(p, y, strict=True)) / blocks > 0.985
    assert sum(p == y for p, y in got) / len(got) > 0.85


def test_blocks():
    page = '<html><head><title>T</title></head><body><p>One &amp; <b>two<br>three <p>four&nbsp;five</p><script>var t="</p>no";</script><!-- x <p>no</p> --><ul><li>a<li>b</ul><a href="x">l</a> tail'
    assert [b.text for b in ex.leaf_blocks(page)] == ["One & two three", "four five", "a", "b", "l tail"]
    assert [b.linked for b in ex.leaf_blocks(page)] == [0, 0, 0, 0, 1]
    assert ex.leaf_blocks("") == [] and [b.text for b in ex.leaf_blocks("a < b > c <3 \" ' <p class=\"x>")] and [b.text for b in ex.leaf_blocks("plain")] == ["plain"]
    node = ex.leaf_blocks('<article class="Post-Body"><P id=q1>x')[0].node
    assert node.blocks == ("article", "p") and node.parent.names == ("post", "body") and {"in:article", "in:p", "name:body", "name:q"} < set(ex.block_features(ex.Block("x", node, 0), None))


def test_words_stay_whole():
    """What isn't white space on the page puts none into a word; only scripts, styles and the like go."""
    text = lambda page: ex.main_text(f"<article><h1>Title of the page</h1><p>{page}</p><p>And a second paragraph.</p></article>", MODEL).split("\n\n")[1:-1]
    assert text("super<wbr>cali<img src=x>fragi<script>x()</script>listic one<br>two") == ["supercalifragilistic one two"]
    for tag in ("math", "object", "iframe", "video", "audio", "canvas", "svg"):
        assert text(f"where <{tag} a=1><b>E</b></{tag}> is energy") == ["where E is energy"]
    assert text("one <select><option>two</select> three <!-- four --> five") == ["one three five"]
    assert text("one <select> two <textarea> three") == ["one two three"]


def test_quotes():
    text = lambda page: [b.text for b in ex.leaf_blocks(page)]
    assert text('<p title="a > b" x=\'>\'>one</p>') == ["one"]
    assert text("<p title=it's>one</p><p \">two</p>") == ["one", "two"]
    assert text('<p>one</p><p title="x>two</p><p>three') == ["one", "two", "three"]
    assert text("<p>one</p><p clas") == ["one"] and text("5 < 6 </ x> <é> &lt;b") == ["5 < 6 <é> <b"]


@pytest.mark.parametrize(
    "page",
    [
        "<div>x" * 100_000, "<div class=a>" * 100_000 + "</section>" * 100_000, "<b>" * 100_000 + "<p>" + "</i>" * 100_000, "<i><p>" + "<b>" * 100_000 + "</i>" * 100_000,
        "<span class='" + " ".join(f"n{i}" for i in range(1000)) + "'>" + "<p>x" * 100_000, '<a "' * 250_000, '<a ="' * 200_001, "<a ='\"" * 170_000, "<a title='" * 100_000 + ">" * 10, "<select>" * 100_000, "<!" * 500_000, "<" * 1_000_000, "</" * 500_000 + ">",
        "".join(f"<div class=c{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}>x" for i in range(50_000)),
    ],
    ids=range(14),
)
def test_hostile_pages_in_time(page):
    start = time.monotonic()
    ex.main_text(page, MODEL)
    assert time.monotonic() - start < 5


def test_sums_of_elements_are_the_features():
    rng = random.Random(6)
    for _ in range(60):
        blocks, nodes = ex.parse(ex.labelled_page(rng)[0])
        assert ex.emissions(blocks, nodes, MODEL) == pytest.approx([MODEL.emission(f) for f in ex.features_of(blocks)])


def test_junk_goes():
    page = """<body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice"><p>We use cookies, please accept them all.</p></div>
    <article><h1>Title</h1><p>First   paragraph &eacute;.</p><div class="ad">Buy this now.</div><p>Second.</p><form><label>Mail</label><input></form></article>
    <aside><p>A long text about something else that stands in the sidebar of the page.</p></aside><section class="comments"><h3>Comments</h3><div class="comment"><p>I liked this article a lot, thank you.</p></div></section><footer>&copy; 2024 Site</footer></body>"""
    assert ex.main_text(page, MODEL) == "Title\n\nFirst paragraph é.\n\nSecond."


def test_viterbi_is_the_best_path():
    rng = random.Random(4)
    crf = ex.ChainField(steps=[0.3, -0.7, 0.1, 0.4])
    for _ in range(200):
        scores = [rng.uniform(-2, 2) for _ in range(rng.randint(1, 9))]
        value = lambda y: sum(s for s, k in zip(scores, y, strict=True) if k) + sum(crf.steps[2 * a + b] for a, b in zip(y, y[1:], strict=False))  # noqa: E731, B023
        every = [[(n >> i) & 1 for i in range(len(scores))] for n in range(1 << len(scores))]
        assert abs(value(crf.decode(scores)) - max(map(value, every))) < 1e-9


def test_expectations_by_enumeration():
    import math

    crf = ex.ChainField(steps=[0.3, -0.7, 0.1, 0.4])
    scores = [0.5, -1.0, 2.0, 0.1]
    value = lambda y: sum(s for s, k in zip(scores, y, strict=True) if k) + sum(crf.steps[2 * a + b] for a, b in zip(y, y[1:], strict=False))
    every = [[(n >> i) & 1 for i in range(4)] for n in range(16)]
    total = sum(math.exp(value(y)) for y in every)
    on, steps = crf.expectations(scores)
    for i in range(4):
        assert abs(on[i] - sum(math.exp(value(y)) for y in every if y[i]) / total) < 1e-9
    assert abs(steps[3] - sum(math.exp(value(y)) * sum(a and b for a, b in zip(y, y[1:], strict=False)) for y in every) / total) < 1e-9


def test_query_matches_articles(spark):
    import html
    import re

    rows = ex.op8_html_extraction(spark, "/root/testdata/sf0.001").collect()
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search("<article>(.*?)</article>", pages[r["page_id"]], re.DOTALL)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", article)]
        assert r["text"] == "\n\n".join(x for x in parts if x) and r["n_chars"] == len(r["text"])


def test_edges(spark):
    pages = spark.createDataFrame([(1, None, "t"), (2, "", "t"), (None, "<script>x", "t"), (3, "<article><p>" + "word " * 200_000, "t"), (3, "<p>", "t")], "page_id long, html string, text string")
    got = ex.extract(pages, out="main").collect()
    assert sorted((r["page_id"] or 0, len(r["main"])) for r in got) == [(0, 0), (1, 0), (2, 0), (3, 0), (3, 999_999)] and all(r["text"] == "t" for r in got)
    assert ex.extract(pages.limit(0)).count() == 0
