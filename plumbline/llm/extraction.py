"""Main text of HTML pages by a linear-chain conditional random field.

A page becomes the sequence of its leaf blocks: runs of text between block
tags, with their ancestors' tags and class names. A chain over the blocks,
trained on labelled pages, tells main text from everything else by Viterbi.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import table

#: A tag; quotes hide its end only where a value starts. LAX_TAG is for pages in which a quote is never closed.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])))*+)>")
LAX_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# Fixed values of the HTML standard: elements without content, elements whose content isn't part of the page's text, and elements that start a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title select datalist".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table caption tbody td tfoot th thead tr ul button label".split())
#: An opening tag ends open elements of these names, unless one of the second set lies between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}


#: Elements that say what a part of a page is.
HOLDERS = frozenset("article aside dialog footer form header main nav section".split())


class Node:
    """An element with a link to the one that holds it: what all blocks in it have in common is stated once."""

    __slots__ = ("blocks", "blocky", "holder", "named", "new", "number", "parent", "path", "tag", "names")

    def __init__(self, number: int, parent: Node | None, tag: str, names: tuple[str, ...], new: tuple[str, ...], path: int) -> None:
        self.number, self.parent, self.tag, self.names, self.new, self.path = number, parent, tag, names, new, path
        self.blocky = tag in BLOCK
        up = parent.blocks if parent else ()
        #: The last two block tags, and the last tag that says what a part of a page is.
        self.blocks = (*up[-1:], tag) if self.blocky else up
        self.holder = tag if tag in HOLDERS else parent.holder if parent else "none"
        self.named = bool(names) or (parent is not None and parent.named)


@dataclass
class Block:
    text: str
    node: Node
    linked: int


class Elements:
    """The open elements; every step takes constant time but for elements that it closes."""

    def __init__(self) -> None:
        self.root = Node(0, None, "", (), (), 0)
        self.nodes, self.stack = [self.root], [self.root]
        #: Places on the stack by tag, and of block elements; open elements by class, id and role word; numbers of paths of tags.
        self.places: dict[str, list[int]] = {}
        self.block_places: list[int] = []
        self.held: dict[str, int] = {}
        self.paths: dict[tuple[int, str], int] = {}

    def top(self, tags: Iterable[str]) -> int:
        """The highest place of an open element with one of the tags; 0 if none is open."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def links(self) -> int:
        return len(self.places.get("a", ()))

    def open(self, tag: str, names: tuple[str, ...]) -> None:
        at, parent = len(self.stack), self.stack[-1]
        words = dict.fromkeys(names)
        new = [f"name:{x}" for x in words if not self.held.get(x)]
        if tag in BLOCK:
            if not self.places.get(tag):
                new.append(f"in:{tag}")
            self.block_places.append(at)
        for x in words:
            self.held[x] = self.held.get(x, 0) + 1
        self.places.setdefault(tag, []).append(at)
        path = self.paths.setdefault((parent.path, tag), len(self.paths) + 1)
        node = Node(len(self.nodes), parent, tag, names, tuple(new), path)
        self.nodes.append(node)
        self.stack.append(node)

    def close(self, at: int) -> None:
        """Close the element at a place and all in it."""
        while len(self.stack) > at:
            node = self.stack.pop()
            self.places[node.tag].pop()
            if node.blocky:
                self.block_places.pop()
            for x in dict.fromkeys(node.names):
                self.held[x] -= 1


@cache
def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{name}\b[^>]*+>", re.IGNORECASE)


def parse(page: str) -> tuple[list[Block], list[Node]]:
    """The page's blocks in order, and all elements, each after the one that
    holds it. Comments, scripts, styles and other raw elements give no text, a
    raw element of a form that nothing closes is skipped alone; unclosed
    elements end where the standard ends them, an unfinished tag at the end of
    the page is dropped. Time and memory are in proportion to the page."""
    out: list[Block] = []
    elements = Elements()
    parts: list[str] = []
    linked = at = 0
    tag_at, endless = TAG, set()

    def flush() -> None:
        nonlocal linked
        if parts:
            if text := " ".join("".join(parts).split()):
                out.append(Block(text, elements.stack[-1], linked))
            parts.clear()
            linked = 0

    def close(place: int) -> None:
        if elements.block_places and elements.block_places[-1] >= place:
            flush()
        elements.close(place)

    def text(raw: str) -> None:
        nonlocal linked
        raw = html.unescape(raw) if "&" in raw else raw
        parts.append(raw)
        if elements.links():
            linked += len(raw.strip())

    while (lt := page.find("<", at)) >= 0:
        if lt > at:
            text(page[at:lt])
        after = page[lt + 1 : lt + 2]
        letter = page[lt + 2 : lt + 3] if after == "/" else after
        if after in ("!", "?") or (after == "/" and not (letter.isascii() and letter.isalpha())):
            comment = page.startswith("<!--", lt)
            end = page.find("-->" if comment else ">", lt + 2)
            at = len(page) if end < 0 else end + (3 if comment else 1)
            continue
        if not (letter.isascii() and letter.isalpha()):
            text("<")
            at = lt + 1
            continue
        m = tag_at.match(page, lt)
        if m is None and tag_at is TAG:
            # A quote that nothing closes: from here on a tag ends at its first >.
            tag_at = LAX_TAG
            m = tag_at.match(page, lt)
        if m is None:
            at = len(page)
            break
        at, name = m.end(), m[2].lower()
        if m[1]:
            if name in BLOCK:
                flush()
            place = elements.top((name,))
            if place and (name in BLOCK or not elements.block_places or elements.block_places[-1] < place):
                close(place)
            continue
        if name in RAW:
            if name not in endless:
                if end := _raw_end(name).search(page, at):
                    at = end.end()
                else:
                    endless.add(name)
                    if name in ("script", "style"):
                        at = len(page)
            continue
        if name in BLOCK:
            flush()
            names, stops = ENDS.get(name, ({"p"}, {"table", "td", "th", "button"}))
            if (place := elements.top(names)) > elements.top(stops - names):
                close(place)
        if name in VOID:
            if name == "br":
                parts.append(" ")
            continue
        found = [p.lower() for a in ATTRIBUTE.finditer(m[3]) for p in NAME_PART.findall(a[2] or a[3] or a[4] or "")] if "=" in m[3] else []
        elements.open(name, tuple(found))
    if at < len(page):
        text(page[at:])
    flush()
    return out, elements.nodes


def leaf_blocks(page: str) -> list[Block]:
    return parse(page)[0]


def own_features(block: Block, before: Block | None) -> tuple[str, ...]:
    """What the holding element and the shape of the text say; what all ancestors say is in Node.new."""
    text, node = block.text, block.node
    n = len(text)
    out = ["bias", f"own:{node.blocks[-1] if node.blocks else 'none'}", f"path:{'>'.join(node.blocks)}", f"holder:{node.holder}"]
    out.append("named" if node.named else "unnamed")
    out.append(f"long:{min(5, n.bit_length() // 2)}")
    out.append(f"links:{min(4, round(4 * block.linked / n))}")
    if text[0] in "©" or "©" in text[:40]:
        out.append("copyright")
    if text[-1] in ".!?:;\"'»”":
        out.append("stop")
    if before is None:
        out.append("first")
    elif before.node.path == node.path:
        out.append("same place")
    return tuple(out)


def block_features(block: Block, before: Block | None) -> tuple[str, ...]:
    """All features of a block: its own, and ancestors' tags and class, id and role words."""
    above: list[str] = []
    node: Node | None = block.node
    while node is not None:
        above += node.new
        node = node.parent
    return own_features(block, before) + tuple(above)


@dataclass
class ChainField:
    """Two labels, 1 for main text: a weight per feature for label 1 and a weight per step between labels."""

    weights: dict[str, float] = field(default_factory=dict)
    steps: list[float] = field(default_factory=lambda: [0.0] * 4)

    def emission(self, features: tuple[str, ...]) -> float:
        get = self.weights.get
        return sum(get(x, 0.0) for x in features)

    def decode(self, scores: list[float]) -> list[int]:
        """Viterbi."""
        if not scores:
            return []
        a, b = 0.0, scores[0]
        s00, s01, s10, s11 = self.steps
        back = []
        for s in scores[1:]:
            from0, from1 = (0, a + s00) if a + s00 >= b + s10 else (1, b + s10), (0, a + s01) if a + s01 >= b + s11 else (1, b + s11)
            back.append((from0[0], from1[0]))
            a, b = from0[1], from1[1] + s
        out = [1 if b > a else 0]
        for step in reversed(back):
            out.append(step[out[-1]])
        return out[::-1]

    def expectations(self, scores: list[float]) -> tuple[list[float], list[float]]:
        """Probability of label 1 at each block, and expected number of each step."""
        s = self.steps
        add = lambda x, y: max(x, y) + math.log1p(math.exp(-abs(x - y)))
        forward = [(0.0, scores[0])]
        for e in scores[1:]:
            a, b = forward[-1]
            forward.append((add(a + s[0], b + s[2]), add(a + s[1], b + s[3]) + e))
        backward = [(0.0, 0.0)]
        for e in reversed(scores[1:]):
            a, b = backward[-1]
            backward.append((add(s[0] + a, s[1] + e + b), add(s[2] + a, s[3] + e + b)))
        backward.reverse()
        total = add(*forward[-1])
        on = [math.exp(f[1] + g[1] - total) for f, g in zip(forward, backward, strict=True)]
        steps = [0.0] * 4
        for f, g, e in zip(forward, backward[1:], scores[1:], strict=False):
            for i in (0, 1):
                for j in (0, 1):
                    steps[2 * i + j] += math.exp(f[i] + s[2 * i + j] + j * e + g[j] - total)
        return on, steps

    def fit(self, pages: list[tuple[list[tuple[str, ...]], list[int]]], epochs: int = 8, rate: float = 0.3, l2: float = 1e-4, seed: int = 3) -> ChainField:
        """AdaGrad on the conditional log likelihood with an l2 penalty."""
        rng, past, past_steps = random.Random(seed), {}, [1e-6] * 4
        order = [i for i, (x, _) in enumerate(pages) if x]
        for _ in range(epochs):
            rng.shuffle(order)
            for i in order:
                features, labels = pages[i]
                on, steps = self.expectations([self.emission(f) for f in features])
                for a, b in zip(labels, labels[1:], strict=False):
                    steps[2 * a + b] -= 1
                for k in range(4):
                    g = steps[k] + l2 * self.steps[k]
                    past_steps[k] += g * g
                    self.steps[k] -= rate * g / past_steps[k] ** 0.5
                grad: dict[str, float] = {}
                for f, p, y in zip(features, on, labels, strict=True):
                    if abs(p - y) > 1e-4:
                        for x in f:
                            grad[x] = grad.get(x, 0.0) + p - y
                for x, g in grad.items():
                    g += l2 * self.weights.get(x, 0.0)
                    past[x] = past.get(x, 1e-6) + g * g
                    self.weights[x] = self.weights.get(x, 0.0) - rate * g / past[x] ** 0.5
        return self


def labelled_page(rng: random.Random) -> tuple[str, list[str]]:
    """An invented page and its main blocks: many layouts, texts of any length
    on either side, so that the place of a block decides more than its shape."""
    pick = rng.choice
    syllables = ["an", "the", "re", "ou", "ti", "er", "sch", "ión", "el", "va", "mo", "lin", "que", "st"]

    def words(low: int, high: int) -> str:
        n = rng.randint(low, high)
        return " ".join("".join(pick(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n)).capitalize() + pick([".", ".", ".", "", "!", "?"])

    def attributes(names: list[str]) -> str:
        name = pick(names)
        return pick([f' class="{name}"', f' id="{name}"', f' class="{name} {pick(["wide", "box", "clear", "inner"])}"', f" class='{name}'"])

    link = lambda: f'<a href="/{rng.randint(0, 999)}">{words(1, 3)}</a>'
    some = lambda: words(1, 4) if rng.random() < 0.3 else words(5, 60)

    def listed(tag: str = "li") -> str:
        return "<ul>" + "".join(f"<{tag}>{link()}" + pick([f"</{tag}>", ""]) for _ in range(rng.randint(2, 7))) + "</ul>"

    junk = {
        "menu": lambda: pick([f"<nav>{listed()}</nav>", f"<div{attributes(['menu', 'nav', 'navbar', 'breadcrumb', 'topnav', 'navigation'])}>{pick([listed(), ' '.join(link() for _ in range(4))])}</div>", f'<div role="navigation">{listed()}</div>']),
        "header": lambda: pick([f"<header><h1>{words(1, 4)}</h1><p>{some()}</p></header>", f"<div{attributes(['header', 'masthead', 'site-header', 'topbar', 'logo'])}><p>{some()}</p></div>", f"<header>{link()} {words(1, 5)}</header>"]),
        "footer": lambda: pick([f"<footer>{pick(['&copy; ', '© ', '', 'Copyright '])}{words(2, 30)}</footer>", f"<footer><p>{some()}</p><p>{link()}</p></footer>", f"<div{attributes(['footer', 'site-footer', 'copyright', 'bottom', 'legal'])}>{pick(['&copy; ', ''])}<p>{some()}</p></div>"]),
        "sidebar": lambda: pick([f"<aside><h2>{words(1, 4)}</h2><p>{some()}</p>{listed()}</aside>", f"<div{attributes(['sidebar', 'related', 'widget', 'rail', 'recommended', 'side', 'more-stories'])}><h3>{words(1, 4)}</h3>{listed()}<p>{some()}</p></div>", f"<aside>{some()}</aside>"]),
        "notice": lambda: pick([f"<div{attributes(['cookie', 'cookie-notice', 'notice', 'banner', 'consent', 'gdpr', 'alert', 'popup', 'modal', 'paywall', 'disclaimer', 'cookies', 'message'])}>{pick(['<p>%s</p>', '%s', '<p>%s</p><button>Accept</button>']) % some()}</div>", f"<dialog><p>{some()}</p></dialog>", f'<div role="alert">{some()}</div>', f"<section{attributes(['notice', 'banner', 'cookie'])}><p>{some()}</p></section>"]),
        "advert": lambda: pick([f"<div{attributes(['ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo', 'promotion', 'adbox', 'ad-slot', 'sponsor', 'banner-ad'])}>{pick(['<p>%s</p>', '%s', '<a href=/x>%s</a>']) % some()}</div>", f"<aside{attributes(['ad', 'advert', 'promo'])}>{some()}</aside>"]),
        "form": lambda: pick([f"<form><label>{words(1, 4)}</label><input name=q><p>{some()}</p><button>{words(1, 2)}</button></form>", f"<div{attributes(['newsletter', 'subscribe', 'search', 'signup', 'login', 'form'])}><form><p>{some()}</p><input><button>Go</button></form></div>", f"<form>{words(1, 9)} <input type=text> <select><option>A<option>B</select></form>"]),
        "comments": lambda: pick(
            [
                f"<div{attributes(['comments', 'comment-list', 'responses', 'discussion', 'disqus', 'comment', 'reader-comments', 'replies'])}><h3>{words(1, 3)}</h3>" + "".join(pick([f'<div class="comment"><p>{some()}</p></div>', f"<p>{some()}</p>", f"<article><p>{some()}</p></article>"]) for _ in range(rng.randint(1, 5))) + "</div>",
                f"<section{attributes(['comments', 'reader-comments', 'discussion'])}><ul>" + "".join(f"<li><p>{some()}</p></li>" for _ in range(rng.randint(1, 4))) + "</ul></section>",
                f"<ol{attributes(['comments', 'commentlist', 'comment-list'])}>" + "".join(f"<li>{some()}</li>" for _ in range(rng.randint(1, 4))) + "</ol>",
            ]
        ),
        "share": lambda: f"<div{attributes(['share', 'social', 'tags', 'byline', 'author-bio', 'pagination', 'tools'])}>{pick([listed(), some(), ' '.join(link() for _ in range(3))])}</div>",
        "script": lambda: pick(['<script>var t="</p><p>x";track(1);</script>', "<style>p{margin:0}</style>", "<!-- ad 1 <p>no</p> -->", f"<noscript><p>{some()}</p></noscript>"]),
    }
    main: list[str] = []

    def kept(low: int = 1, high: int = 90) -> str:
        text = words(low, high)
        shown = text
        if rng.random() < 0.25:
            a = shown.split(" ")
            i = rng.randrange(len(a))
            a[i] = pick(["<b>%s</b>", "<em>%s</em>", '<a href="/y">%s</a>', "<span>%s</span>", "<b>%s"]) % a[i]
            shown = " ".join(a)
        if rng.random() < 0.15:
            shown, text = shown + " &amp; x&nbsp;y", text + " & x y"
        main.append(text)
        return shown

    body: list[str] = []
    body.append(f"<h{pick('112')}>{kept(1, 14)}</h1>" if rng.random() < 0.8 else f"<p>{kept()}</p>")
    for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 8, 12])):
        r = rng.random()
        plain = pick(["", "", "", ' class="lead"', ' class="text wide"', ' class="box"', ' class="inner"', ' id="p1"'])
        if r < 0.5:
            body.append(f"<p{plain}>{kept(1, 4) if rng.random() < 0.2 else kept()}{pick(['</p>', '</p>', '<br>', ''])}")
        elif r < 0.56:
            body.append(f"<div{plain}>{kept()}</div>")
        elif r < 0.59:
            body.append(f"<section{plain}><h2>{kept(1, 8)}</h2><p>{kept()}</p></section>")
        elif r < 0.62:
            body.append(pick(["<dl><dt>%s<dd>%s</dl>", "<pre>%s</pre><p>%s", "<details><summary>%s</summary><p>%s</p></details>"]) % (kept(1, 6), kept()))
        elif r < 0.7:
            body.append(f"<h{pick('23')}>{kept(1, 8)}</h2>")
        elif r < 0.78:
            tag = pick(["ul", "ol"])
            body.append(f"<{tag}>" + "".join(f"<li>{kept(1, 20)}</li>" for _ in range(rng.randint(1, 5))) + f"</{tag}>")
        elif r < 0.83:
            body.append(f"<blockquote><p>{kept()}</p></blockquote>")
        elif r < 0.87:
            body.append("<table>" + "".join(f"<tr><td>{kept(1, 4)}</td><td>{kept(1, 4)}</td></tr>" for _ in range(rng.randint(1, 3))) + "</table>")
        elif r < 0.9:
            body.append(f"<figure><img src=x><figcaption>{kept(2, 12)}</figcaption></figure>")
        else:
            body.append(junk[pick(["advert", "notice", "form", "sidebar", "share", "script", "comments"])]())
    inner = "".join(body)
    if rng.random() < 0.15:
        inner += junk["comments"]()
    content = pick(["content", "post", "entry", "entry-content", "article", "article-body", "story", "post-body", "main", "text", "body-copy", "page-content"])
    holder = pick(["<article>%s</article>"] * 4 + ["<main>%s</main>", "<main><article>%s</article></main>", f'<div class="{content}">%s</div>', f'<div id="{content}">%s</div>', f'<section class="{content}">%s</section>', f'<article class="{content}">%s</article>', '<div role="main">%s</div>', "<div><div>%s</div></div>", "<div>%s</div>", "%s"])
    before = [junk[k]() for k in ("script", "notice", "header", "menu", "advert", "form", "sidebar") if rng.random() < 0.45]
    after = [junk[k]() for k in ("share", "comments", "advert", "sidebar", "form", "notice", "menu", "script") if rng.random() < 0.35]
    rng.shuffle(before)
    rng.shuffle(after)
    if rng.random() < 0.85:
        after.append(junk["footer"]())
    wrap = pick(["%s", "%s", '<div class="wrapper">%s</div>', '<div id="page">%s</div>'])
    head = f"<!DOCTYPE html><html><head><title>{words(1, 6)}</title></head><body>"
    return head + wrap % ("".join(before) + holder % inner + "".join(after)) + "</body></html>", main


def training_pages(n: int, seed: int) -> list[tuple[list[tuple[str, ...]], list[int]]]:
    """Feature sequences of n invented pages; a block is main if its text is the next main text."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        page, main = labelled_page(rng)
        blocks, labels, at = leaf_blocks(page), [], 0
        for b in blocks:
            hit = at < len(main) and b.text == main[at]
            labels.append(int(hit))
            at += hit
        if at == len(main):
            out.append((features_of(blocks), labels))
    return out


def features_of(blocks: list[Block]) -> list[tuple[str, ...]]:
    return [block_features(b, a) for a, b in zip([None, *blocks], blocks, strict=False)]


@cache
def default_model(pages: int = 600, seed: int = 5) -> ChainField:
    return ChainField().fit(training_pages(pages, seed))


def emissions(blocks: list[Block], nodes: list[Node], model: ChainField) -> list[float]:
    """A score per block; what ancestors add is summed once an element, from the outermost on."""
    above = [0.0] * len(nodes)
    for node in nodes[1:]:
        above[node.number] = above[node.parent.number] + (model.emission(node.new) if node.new else 0.0)
    return [above[b.node.number] + model.emission(own_features(b, a)) for a, b in zip([None, *blocks], blocks, strict=False)]


def main_text(page: str | None, model: ChainField) -> str:
    """Main blocks, joined by an empty line; empty for a null page or one without text."""
    if not page:
        return ""
    blocks, nodes = parse(page)
    labels = model.decode(emissions(blocks, nodes, model))
    return "\n\n".join(b.text for b, y in zip(blocks, labels, strict=True) if y)


def extract(pages: DataFrame, model: ChainField | None = None, source: str = "html", out: str = "main_text") -> DataFrame:
    """pages with the main text of the html column in out; a null page gives an empty text."""
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())

    @F.pandas_udf("string")
    def of(batch: pd.Series) -> pd.Series:
        return pd.Series([main_text(x, shared.value) for x in batch], dtype="object")

    return pages.withColumn(out, of(F.col(source)))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"), out="text")
    return pages.selectExpr("page_id", "url", "text", "cast(char_length(text) as long) as n_chars")
