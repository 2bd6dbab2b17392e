"""N-gram Jaccard join by signature trees.

Documents are sets of word shingles; two are linked when 100 * |A and B| >=
80 * |A or B|, and a component is what links reach. Nothing is approximate:

1. Documents with equal sets become one vertex, their smallest id.
2. Two linked sets share a shingle among the first n - ceil(0.8 n) + 1 of each
   under one order of all shingles: frequent ones last, then by hash. The
   vertices with such a shingle in common form a block, named after its
   smallest vertex, the pivot; blocks of one pivot are one, so that a group of
   near copies is in few blocks. Any linked pair is in one block.
3. A signature tree over a block's bitmaps (nodes hold the OR of their
   members' bitmaps and the range of their sizes) drops vertices that can
   reach the overlap with no other.
4. A tree over the rest, now with their sets, is traversed against itself:
   node pairs that can't reach the overlap are pruned, and so are pairs that
   are already in one component. Pairs that remain are compared exactly. The
   links that join something new come out, at most one a vertex.
5. Links make components. Blocks too large for a task are dealt as parts that
   all hold the pivot; members that aren't in the pivot's component then meet
   the other parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import hash60, lookup, materialize, remove, small_batches, table

WORDS = 5
#: Linked when OF * intersection >= PART * union.
PART, OF = 80, 100
#: Most members of a part of a block, and shingles of all of them.
PART_MEMBERS, PART_SHINGLES = 2_000, 4_000_000
#: A shingle is frequent if at least so many documents and this share of all have it; most such shingles kept.
FREQUENT_LEAST, FREQUENT_SHARE, FREQUENT_MOST = 32, 20_000, 500_000
#: Shingles that a task counts at a time.
COUNTED = 1_000_000
LEAF, FANOUT = 16, 4
_MEMO = 100_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """Sorted distinct 64-bit hashes of a text's shingles: ASCII letters lower-cased,
    words split at ASCII white space, a text of fewer words is one shingle."""

    def __init__(self, words: int = WORDS) -> None:
        self.words, self.memo = words, {}

    def __call__(self, text: str | None) -> np.ndarray:
        parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not parts:
            return np.zeros(0, np.uint64)
        if len(parts) < self.words:
            return np.array([xxhash.xxh64_intdigest(b" ".join(parts), 1)], np.uint64)
        memo = self.memo
        if len(memo) > _MEMO:
            memo.clear()
        hashes = []
        for w in parts:
            if (h := memo.get(w)) is None:
                h = memo[w] = xxhash.xxh64_intdigest(w)
            hashes.append(h)
        h = np.array(hashes, np.uint64)
        out = h[: h.size - self.words + 1].copy()
        for i in range(1, self.words):
            out = (out ^ (out >> np.uint64(32))) * _STEP + h[i : i + out.size]
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return np.unique(out ^ (out >> np.uint64(29)))


def prefix_length(n: int) -> int:
    return n - -(-PART * n // OF) + 1


def bitmap_width(n: int) -> int:
    return max(64, 1 << max(0, n - 1).bit_length())


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """About a bit a shingle; the width is a power of two, so that a wide one folds onto a narrow one."""
    bits = np.zeros(bitmap_width(shingles.size), np.uint8)
    bits[(shingles >> np.uint64(20)) & np.uint64(bits.size - 1)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def fold(maps: np.ndarray) -> np.ndarray:
    half = maps.shape[-1] // 2
    return maps[..., :half] | maps[..., half:]


class SignatureTree:
    """Members in order of size; nodes of a level hold FANOUT nodes of the one below, the lowest LEAF members."""

    def __init__(self, sizes: np.ndarray, maps: np.ndarray) -> None:
        self.sizes, self.maps = sizes, maps
        self.slack = sizes - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
        starts = np.arange(0, len(sizes), LEAF)
        level = (np.bitwise_or.reduceat(maps, starts, axis=0), np.minimum.reduceat(sizes, starts), np.maximum.reduceat(sizes, starts), np.maximum.reduceat(self.slack, starts))
        self.levels = [level]
        while len(self.levels[-1][1]) > 1:
            bits, low, high, slack = self.levels[-1]
            at = np.arange(0, len(low), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(bits, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(slack, at)))

    def members(self, level: int, node: int) -> slice:
        width = LEAF * FANOUT**level
        return slice(node * width, min((node + 1) * width, len(self.sizes)))

    def children(self, level: int, node: int) -> range:
        return range(node * FANOUT, min((node + 1) * FANOUT, len(self.levels[level - 1][1])))


def possible(n: np.ndarray, m: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Can sets of n and m members with an overlap of at most `most` be linked?"""
    return (OF + PART) * most >= PART * (n + m)


def node_possible(a: SignatureTree, la: int, i: int, b: SignatureTree, lb: int, j: int) -> bool:
    bits, low, high, slack = (x[i] for x in a.levels[la])
    bits2, low2, high2, slack2 = (x[j] for x in b.levels[lb])
    if OF * high < PART * low2 or OF * high2 < PART * low:
        return False
    common = int(np.bitwise_count(bits & bits2).sum()) + min(slack, slack2)
    return bool((OF + PART) * min(common, high, high2) >= PART * (low + low2))


def traverse(a: SignatureTree, b: SignatureTree, skip, leaf) -> None:
    """Dual traversal of a and b, which may be one tree; skip(slice, slice) prunes what
    needs no more work, leaf(slice, slice, mask) gets the pairs that may be linked."""
    same = a is b
    stack = [(len(a.levels) - 1, 0, len(b.levels) - 1, 0)]
    while stack:
        la, i, lb, j = stack.pop()
        x, y = a.members(la, i), b.members(lb, j)
        if skip(x, y) or not (same and (la, i) == (lb, j)) and not node_possible(a, la, i, b, lb, j):
            continue
        if la == lb == 0:
            common = np.bitwise_count(a.maps[x, None, :] & b.maps[None, y, :]).sum(axis=2, dtype=np.int64)
            n, m = a.sizes[x, None], b.sizes[None, y]
            most = np.minimum(common + np.minimum(a.slack[x, None], b.slack[None, y]), np.minimum(n, m))
            mask = possible(n, m, most)
            leaf(x, y, np.triu(mask, 1) if same and i == j else mask)
        elif same and (la, i) == (lb, j):
            kids = list(a.children(la, i))
            # Later pairs first: a stack takes the last, so nodes meet themselves before others.
            stack += [(la - 1, k, la - 1, m) for n, k in enumerate(kids) for m in kids[n + 1 :]]
            stack += [(la - 1, k, la - 1, k) for k in kids]
        elif la >= lb and la:
            stack += [(la - 1, k, lb, j) for k in a.children(la, i)]
        else:
            stack += [(la, i, lb - 1, k) for k in b.children(lb, j)]


def joined(sizes: np.ndarray, maps: list[np.ndarray], skip, leaf) -> None:
    """All pairs of a block, by trees: one per bitmap width, and the next width folded onto it.
    skip and leaf get arrays of member numbers. Sizes of linked sets differ by a quarter at most, so widths by one step."""
    widths = np.array([m.size for m in maps])
    trees: dict[int, tuple[np.ndarray, SignatureTree]] = {}
    for w in np.unique(widths):
        at = np.flatnonzero(widths == w)
        at = at[np.argsort(sizes[at], kind="stable")]
        trees[int(w)] = (at, SignatureTree(sizes[at], np.stack([maps[i] for i in at])))
    for w, (at, tree) in trees.items():
        if len(at) > 1:
            traverse(tree, tree, lambda x, y, at=at: skip(at[x], at[y]), lambda x, y, mask, at=at: leaf(at[x], at[y], mask))
        if 2 * w in trees:
            at2, wide = trees[2 * w]
            folded = SignatureTree(wide.sizes, fold(wide.maps))
            traverse(tree, folded, lambda x, y, a=at, b=at2: skip(a[x], b[y]), lambda x, y, mask, a=at, b=at2: leaf(a[x], b[y], mask))


def survivors(sizes: np.ndarray, maps: list[np.ndarray]) -> np.ndarray:
    """Members whose bitmaps leave at least one other that they may be linked with."""
    alive = np.zeros(len(sizes), bool)

    def leaf(a: np.ndarray, b: np.ndarray, mask: np.ndarray) -> None:
        alive[a[mask.any(axis=1)]] = True
        alive[b[mask.any(axis=0)]] = True

    joined(sizes, maps, lambda a, b: alive[a].all() and alive[b].all(), leaf)
    return alive


def links(keys: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join all linked members: (larger key, smallest key reached). Members of one key are one from the start."""
    keys_ = np.array(keys, np.int64)
    ids, start = np.unique(keys_, return_inverse=True)
    root = list(range(len(ids)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def skip(a: np.ndarray, b: np.ndarray) -> bool:
        r = find(int(start[a[0]]))
        return find(int(start[b[-1]])) == r and all(find(int(start[i])) == r for i in a) and all(find(int(start[i])) == r for i in b)

    def leaf(a: np.ndarray, b: np.ndarray, mask: np.ndarray) -> None:
        for i, j in zip(*np.nonzero(mask), strict=True):
            p, q = int(a[i]), int(b[j])
            x, y = find(int(start[p])), find(int(start[q]))
            if x != y:
                s, t = (sets[p], sets[q]) if sets[p].size <= sets[q].size else (sets[q], sets[p])
                at = np.minimum(np.searchsorted(t, s), t.size - 1)
                both = int((t[at] == s).sum())
                if OF * both >= PART * (s.size + t.size - both):
                    root[max(x, y)] = min(x, y)

    joined(np.array([s.size for s in sets], np.int64), [bitmap(s) for s in sets], skip, leaf)
    return [(int(ids[i]), int(ids[r])) for i in range(len(ids)) if (r := find(i)) != i]


def _frequent(docs: DataFrame, words: int) -> np.ndarray:
    """The frequent shingles, sorted, by estimate. They only set the order of
    shingles, which every document shares, so an error here changes no result.

    A task counts what it reads in stretches of COUNTED shingles. It passes on
    what a stretch has three times, and of the rest every 16th by a hash that
    differs between stretches, which then counts 16 times: a shingle that is
    spread thinly over many tasks is found as well. The driver gets at most
    FREQUENT_MOST numbers."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        shingler, held, size = Shingler(words), [], 0
        seed = np.random.default_rng(TaskContext.get().partitionId())

        def out() -> pd.DataFrame:
            at, n = np.unique(np.concatenate(held), return_counts=True)
            few = n < 3
            drawn = ((at ^ seed.integers(0, 1 << 63, dtype=np.uint64)) * _STEP) >> np.uint64(60) == 0
            n = np.where(few, n * 16, n)[kept := ~few | drawn]
            return pd.DataFrame({"token": at[kept].view(np.int64), "n": n.astype(np.int64)})

        for pdf in batches:
            for text in pdf["text"]:
                held.append(shingler(text))
                size += held[-1].size
                if size > COUNTED:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    least = max(FREQUENT_LEAST, docs.count() // FREQUENT_SHARE)
    counts = docs.select("text").mapInPandas(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = counts.filter(F.col("n") >= least).orderBy(F.col("n").desc(), "token").limit(FREQUENT_MOST).select("token").toPandas()["token"]
    return np.sort(top.to_numpy(np.int64).view(np.uint64))


def _sketches(docs: DataFrame, frequent: np.ndarray, words: int) -> DataFrame:
    """(doc_id, n, hi, lo, rare, common, bits): size, 128 bits of the set, the prefix in two parts, bitmap."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, often = Shingler(words), shared.value
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                s = shingler(text)
                if not s.size:
                    rows.append((0, 0, 0, [], [], b""))
                    continue
                at = np.minimum(np.searchsorted(often, s), max(0, often.size - 1))
                known = often[at] == s if often.size else np.zeros(s.size, bool)
                rare, p = s[~known], prefix_length(s.size)
                common = s[known][: max(0, p - rare.size)]
                whole = xxhash.xxh3_128_intdigest(s.tobytes())
                hi, lo = np.array([whole >> 64, whole & (1 << 64) - 1], np.uint64).view(np.int64).tolist()
                rows.append((s.size, hi, lo, rare[:p].view(np.int64), common.view(np.int64), bitmap(s).tobytes()))
            out = pd.DataFrame(rows, columns=["n", "hi", "lo", "rare", "common", "bits"])
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield out

    return docs.mapInPandas(run, "doc_id string, n long, hi long, lo long, rare array<long>, common array<long>, bits binary").withColumn("doc_id", F.col("doc_id").cast("long"))


def _units(batches: Iterator[pd.DataFrame]) -> Iterator[list[tuple]]:
    """Rows of one (pivot, part, other) after another from sorted batches."""
    held, key = [], None
    for pdf in batches:
        for row in pdf.itertuples(index=False, name=None):
            if row[:3] != key:
                if held:
                    yield held
                held, key = [], row[:3]
            held.append(row)
    if held:
        yield held


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("pivot", "part", "other").sortWithinPartitions("pivot", "part", "other")


def _filtered(members: DataFrame) -> DataFrame:
    """(pivot, v, n) of blocks that fit one part, without members that no other can be linked with."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for unit in _units(batches):
            alive = survivors(np.array([x[4] for x in unit], np.int64), [np.frombuffer(x[5], np.uint64) for x in unit])
            out += [(x[0], x[3], x[4]) for x, keep in zip(unit, alive, strict=True) if keep]
            if len(out) > 20_000:
                yield pd.DataFrame(out, columns=["pivot", "v", "n"])
                out = []
        yield pd.DataFrame(out, columns=["pivot", "v", "n"]).astype("int64")

    return _dealt(members).select("pivot", "part", "other", "v", "n", "bits").mapInPandas(run, "pivot long, v long, n long")


def _linked(units: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(child, parent) from units(pivot, part, other, v, label): members of one label are known to be connected."""

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(words)
        for pdf in batches:
            pdf["set"] = [shingler(x).tobytes() for x in pdf.pop("text")]
            yield pdf

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for unit in _units(batches):
            out += links([x[3] for x in unit], [np.frombuffer(x[4], np.uint64) for x in unit])
            if len(out) > 50_000:
                yield pd.DataFrame(out, columns=["child", "parent"])
                out = []
        yield pd.DataFrame(out, columns=["child", "parent"]).astype("int64")

    # A document goes to all its blocks as text, in one shuffle; its set is made once and copied.
    mine = units.groupBy("v").agg(F.first("label").alias("label"), F.collect_list(F.struct("pivot", "part", "other")).alias("in"))
    # By shuffle at every size: the blocks grow with the documents.
    rows = docs.join(mine.hint("merge"), F.col("doc_id") == F.col("v")).select("label", "in", "text")
    rows = rows.mapInPandas(sets, "label long, in array<struct<pivot: long, part: long, other: long>>, set binary")
    rows = rows.select(F.explode("in").alias("at"), "label", "set").select("at.pivot", "at.part", "at.other", "label", "set")
    return _dealt(rows).mapInPandas(run, "child long, parent long").distinct()


def components(edges: DataFrame, within: list[str]) -> DataFrame:
    """(child, root) of all vertices that aren't the smallest of their component,
    from edges (child, parent) with parent < child.

    Rounds of: a vertex keeps its smallest parent and hands the others to it;
    then every vertex moves to its parent's parent. Each round is written to
    the shared folder, the last one stays there under a path in within; nothing
    but two counts reaches the driver."""
    spark, old, new = edges.sparkSession, [], []
    edges = materialize(edges.distinct(), "join-edges", old)
    while True:
        least = F.min("parent").over(_by("child"))
        hooked = edges.withColumn("least", least)
        hooked = hooked.select("child", F.col("least").alias("parent")).unionByName(hooked.filter("parent <> least").select(F.col("parent").alias("child"), F.col("least").alias("parent"))).distinct()
        hooked = materialize(hooked, "join-hooked", old)
        up = hooked.groupBy(F.col("child").alias("mid")).agg(F.min("parent").alias("up"))
        moved = hooked.join(up, F.col("parent") == F.col("mid"), "left")
        edges = materialize(moved.select("child", F.coalesce("up", "parent").alias("parent"), F.col("up").isNotNull().alias("rose")).distinct(), "join-edges", new)
        state = edges.agg(F.count("*").alias("n"), F.count_distinct("child").alias("children"), F.coalesce(F.max(F.col("rose").cast("int")), F.lit(0)).alias("rose")).first()
        edges = edges.select("child", "parent").distinct()
        remove(spark, old)
        if not state["rose"] and state["n"] == state["children"]:
            within += new
            return edges.select("child", F.col("parent").alias("root"))
        old, new = new, []


def _by(*keys: str):
    from pyspark.sql import Window

    return Window.partitionBy(*keys)


def _blocks(vertices: DataFrame) -> DataFrame:
    """(v, pivot) for all vertices with a prefix shingle in common.

    A rare shingle is in a bounded share of documents and its block is seen in
    one place; for the common ones, at most FREQUENT_MOST, the pivots are
    aggregated and looked up, so that a group of near copies isn't gathered."""
    rare = vertices.select(F.explode("rare").alias("token"), "v").withColumn("pivot", F.min("v").over(_by("token"))).withColumn("last", F.max("v").over(_by("token")))
    common = vertices.select(F.explode("common").alias("token"), "v")
    pivots = common.groupBy("token").agg(F.min("v").alias("pivot"), F.max("v").alias("last")).filter("pivot <> last")
    shared = common.join(lookup(pivots, FREQUENT_MOST), "token")
    return rare.filter("pivot <> last").select("v", "pivot").unionByName(shared.select("v", "pivot")).distinct()


def vertex_components(docs: DataFrame, words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """docs(doc_id long, text): the sketches (doc_id, n, hi, lo), and (hi, lo,
    component, copies) of the sets that more than one document has or that are
    linked with another. Both are tables of the shared folder; what leads to
    them is removed there.

    Large blocks are few, at most a PART_MEMBERS-th of their members; what is
    known of them is looked up, so that no task gets a whole block."""
    spark, gone = docs.sparkSession, []
    keep = lambda df, name: materialize(df, f"join-{name}", gone)
    full = keep(_sketches(docs.withColumn("doc_id", F.col("doc_id").cast("string")), _frequent(docs, words), words), "full")
    sketches = materialize(full.select("doc_id", "n", "hi", "lo"), "join-sketches")
    classes = keep(sketches.filter("n > 0 and doc_id is not null").groupBy("hi", "lo").agg(F.min("doc_id").alias("v"), F.count("*").alias("copies")), "classes")
    heads = classes.select("hi", "lo", F.col("v").alias("doc_id")).hint("merge")
    own = full.join(heads, ["hi", "lo", "doc_id"], "left_semi").withColumnRenamed("doc_id", "v")
    own = keep(own.dropDuplicates(["v", "hi", "lo"]).select("v", "n", "rare", "common", "bits"), "vertices")
    blocks = keep(_blocks(own), "blocks")
    sizes = own.groupBy("v").agg(F.max("n").alias("n"))
    members = blocks.join(sizes, "v")
    totals = keep(members.groupBy("pivot").agg(F.greatest(F.ceil(F.count("*") / PART_MEMBERS), F.ceil(F.sum("n") / PART_SHINGLES)).alias("parts")).filter("parts > 1"), "totals")
    large = keep(members.join(lookup(totals), "pivot").withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts"))), "large")
    zero = F.lit(0).cast("long")
    small = blocks.join(lookup(totals.select("pivot")), "pivot", "left_anti").join(own.select("v", "n", "bits"), "v")
    kept = _filtered(small.select("pivot", zero.alias("part"), zero.alias("other"), "v", "n", "bits"))
    units = kept.select("pivot", zero.alias("part"), zero.alias("other"), "v").distinct()
    heads = totals.select("pivot", F.explode(F.sequence(zero, F.col("parts") - 1)).alias("part"), zero.alias("other"), F.col("pivot").alias("v"))
    units = units.unionByName(large.select("pivot", "part", zero.alias("other"), "v")).unionByName(heads).distinct()
    # Deterministic units: the filter isn't run again when a later task is.
    units = keep(units.withColumn("label", F.col("v")), "units")
    found = components(_linked(units, docs, words), gone)
    if not totals.isEmpty():
        labelled = large.join(found, F.col("v") == F.col("child"), "left").withColumn("label", F.coalesce("root", "v")).select("pivot", "part", "parts", "v", "n", "label")
        heads = totals.select("pivot").join(found, F.col("pivot") == F.col("child"), "left").select("pivot", F.coalesce("root", "pivot").alias("head"))
        labelled = keep(labelled.join(lookup(heads), "pivot"), "labelled")
        loose = labelled.filter("label <> head")
        groups = keep(loose.groupBy("pivot").agg(F.greatest(F.ceil(F.count("*") / PART_MEMBERS), F.ceil(F.sum("n") / PART_SHINGLES)).alias("others")), "groups")
        if not groups.isEmpty():
            # Loose members in groups of their own; each group meets each part.
            every = labelled.join(lookup(groups), "pivot").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
            each = loose.join(lookup(groups), "pivot").withColumn("other", F.pmod(F.xxhash64("v", F.lit(1)), F.col("others"))).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            again = every.select("pivot", "part", F.col("other").cast("long").alias("other"), "v", "label").unionByName(each.select("pivot", F.col("part").cast("long").alias("part"), "other", "v", "label")).distinct()
            more = _linked(keep(again, "again"), docs, words)
            found = components(found.select("child", F.col("root").alias("parent")).unionByName(more), gone)
    roots = classes.join(found, F.col("v") == F.col("child"), "left").select("hi", "lo", F.coalesce("root", "v").alias("component"), "v", "copies")
    result = materialize(roots.filter("copies > 1 or component <> v").drop("v"), "join-components")
    remove(spark, gone)
    return sketches, result


def jaccard_components(docs: DataFrame, words: int = WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for every row of docs.

    A null text or one without words has no shingles and is linked with
    nothing; so is a row with a null id, whose component is null. Rows that
    share an id are one vertex, linked with whatever one of them is. Sets that
    over a thousandth of all documents have are fewer than a thousand and are
    looked up by broadcast, the others by shuffle."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketches, found = vertex_components(docs, words)
    share = max(100, docs.count() // 1000)
    hot = F.broadcast(found.filter(F.col("copies") > share).select(F.col("hi").alias("hot_hi"), F.col("lo").alias("hot_lo"), F.col("component").alias("hot")))
    cold = found.filter(F.col("copies") <= share).select(F.col("hi").alias("cold_hi"), F.col("lo").alias("cold_lo"), F.col("component").alias("cold"))
    rows = sketches.select("doc_id", "n", "hi", "lo").join(hot, (F.col("hi") == F.col("hot_hi")) & (F.col("lo") == F.col("hot_lo")), "left")
    key = F.when(F.col("hot").isNull() & (F.col("n") > 0), F.col("hi")).otherwise(F.xxhash64("doc_id"))
    rows = rows.withColumn("key", key).join(cold, (F.col("key") == F.col("cold_hi")) & (F.col("lo") == F.col("cold_lo")), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.coalesce("hot", "cold", "doc_id")).otherwise(F.col("doc_id")))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one(docs: DataFrame, words: int = WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, that of the smallest id; the same columns.

    A row with a null id takes part under an id past all others, made of the
    row's columns; of rows that repeat an id and a text one stays, and of
    repeats that differ in other columns it isn't stated which. Rows that
    share an id but not the text are one document of the join and stay or go
    together."""
    made = F.lit(1 << 61).cast("long") + hash60(*(F.col(c) for c in docs.columns))
    keyed = docs.withColumns({"_nj_id": F.coalesce(F.col(doc_id).cast("long"), made), "_nj_same": F.xxhash64(text)})
    found = jaccard_components(keyed.select("_nj_id", F.col(text).alias("_nj_text")), words, "_nj_id", "_nj_text")
    heads = found.filter("component_id = doc_id").select(F.col("doc_id").alias("_nj_head")).distinct()
    kept = keyed.join(heads, F.col("_nj_id") == F.col("_nj_head"), "left_semi")
    # Only rows that do repeat are gathered.
    twice = keyed.groupBy("_nj_id", "_nj_same").agg(F.count("*").alias("n")).filter("n > 1").select("_nj_id", "_nj_same")
    if twice.isEmpty():
        return kept.select(*docs.columns)
    repeats = lookup(twice)
    once = kept.join(repeats, ["_nj_id", "_nj_same"], "left_semi").dropDuplicates(["_nj_id", "_nj_same"])
    return kept.join(repeats, ["_nj_id", "_nj_same"], "left_anti").unionByName(once, allowMissingColumns=True).select(*docs.columns)


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) END AS g FROM d),
t AS (SELECT doc_id, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * n >= 80 * (len(x.g) + len(y.g) - n)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS v, doc_id AS c FROM s UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.v WHERE r.c < e.b)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, min(r.c) AS component_id FROM s JOIN r ON r.v = s.doc_id GROUP BY 1, 2
"""
