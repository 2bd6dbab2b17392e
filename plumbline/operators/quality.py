"""Checks of tables, labels and splits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline import config as C
from plumbline.functions.text import collapse, flat, probes, tokens
from plumbline.operators.joins import holding


def orphans(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    return chunks.join(documents, "doc_key", "left_anti")


def reconcile(chunks: DataFrame, documents: DataFrame, expected_documents: int, expected_chunks: int) -> DataFrame:
    """The load's five checks as rows (check, found, expected, ok)."""
    one = chunks.agg(F.count("*").alias("chunks"), F.count_if(F.col("embedding").isNull()).alias("without vector"), F.count_if(F.size(tokens(F.col("content"))) == 0).alias("without words"))
    row = one.crossJoin(documents.agg(F.count("*").alias("documents"))).crossJoin(orphans(chunks, documents).agg(F.count("*").alias("orphans")))
    names = {"documents": expected_documents, "chunks": expected_chunks, "without vector": 0, "without words": 0, "orphans": 0}
    each = F.array(*(F.struct(F.lit(n).alias("check"), F.col(n).alias("found"), F.lit(e).cast("long").alias("expected")) for n, e in names.items()))
    return row.select(F.explode(each).alias("c")).select("c.*", (F.col("c.found") == F.col("c.expected")).alias("ok"))


def section_histogram(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("item_section").agg(F.count("*").alias("n"), F.round(F.avg("token_count"), 6).alias("mean_tokens"))


def section_stats(sections: DataFrame, size: str) -> DataFrame:
    """n, median, min, max and spread by section; a spread over 20 is flagged, one from 0 is infinite."""
    out = sections.groupBy("item_section").agg(F.count("*").alias("n"), F.median(size).alias("median"), F.min(size).alias("least"), F.max(size).alias("most"))
    spread = F.when(F.col("least") == 0, F.lit(float("inf"))).otherwise(F.col("most") / F.col("least"))
    return out.withColumn("spread", spread).withColumn("flagged", F.col("spread") > 20)


def plausibility(sections: DataFrame) -> DataFrame:
    """Per document: characters in sections, sections that are too short, and the longest narrative."""
    short = (F.col("char_count") < C.MIN_PLAUSIBLE_CHARS) & ~F.col("item_section").isin(*C.SHORT_ITEMS)
    longest = F.max_by("item_section", F.struct("char_count", (-F.col("start")).alias("start")))
    out = sections.groupBy("doc_id").agg(F.sum("char_count").alias("covered"), F.array_sort(F.collect_list(F.when(short, F.col("item_section")))).alias("short"), longest.alias("longest"))
    return out.withColumn("longest_is_risk_factors", F.col("longest") == "Item 1A")


def vector_checks(vectors: DataFrame, dimension: int, tolerance: float = C.VECTOR_NORM_TOLERANCE) -> DataFrame:
    """Counts of vectors of another dimension, with a value that isn't finite, and not of norm 1."""
    v = F.col("embedding")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    odd = F.exists(v, lambda x: F.isnan(x) | x.isin(float("inf"), float("-inf")))
    return vectors.agg(F.count("*").alias("n"), F.count_if(F.size(v) != dimension).alias("bad_dimension"), F.count_if(odd).alias("not_finite"), F.count_if(F.abs(norm - 1) > tolerance).alias("bad_norm"))


def duplicates(chunks: DataFrame) -> DataFrame:
    """Distinct vectors against distinct texts and token sequences, by digests: what is grouped stays narrow."""
    key = lambda c: F.sha2(c.cast("binary"), 256)
    return chunks.agg(F.count("*").alias("n"), F.count_distinct(key(F.to_json("embedding"))).alias("vectors"), F.count_distinct(key(F.col("content"))).alias("texts"), F.count_distinct(key(F.array_join(tokens(F.col("content")), " "))).alias("token_sequences"))


def repeated_texts(chunks: DataFrame, least: int = 2) -> DataFrame:
    return chunks.groupBy(F.sha2(F.col("content").cast("binary"), 256).alias("digest")).agg(F.count("*").alias("n"), F.min("chunk_id").alias("first_chunk")).filter(F.col("n") >= least)


def vector_collisions(chunks: DataFrame) -> DataFrame:
    """Equal vectors with different texts."""
    rows = chunks.filter("embedding is not null").select(F.sha2(F.to_json("embedding").cast("binary"), 256).alias("vector"), F.sha2(F.col("content").cast("binary"), 256).alias("text"), "chunk_id")
    return rows.groupBy("vector").agg(F.count("*").alias("n"), F.count_distinct("text").alias("texts"), F.min("chunk_id").alias("first_chunk")).filter("texts > 1").drop("vector")


def resolve_labels(labels: DataFrame, chunks: DataFrame) -> DataFrame:
    """labels(query_id, doc_key, chunk_index, contains) as resolved, moved (the text
    isn't in the chunk), missing (no such chunk) or unanchored (nothing to check)."""
    found = labels.join(chunks.select("doc_key", "chunk_index", "chunk_id", "content"), ["doc_key", "chunk_index"], "left")
    outcome = F.when(F.col("chunk_id").isNull(), "missing").when(F.col("contains").isNull(), "unanchored").when(F.contains(flat(F.col("content")), flat(F.col("contains"))), "resolved").otherwise("moved")
    return found.select("query_id", "doc_key", "chunk_index", "chunk_id", outcome.alias("outcome"))


def neighbours(rows: DataFrame, chunks: DataFrame, window: int) -> DataFrame:
    """Chunks of the same document at most window places from (doc_key, chunk_index), by equi-join on each place."""
    near = rows.withColumn("near", F.explode(F.sequence(F.col("chunk_index") - window, F.col("chunk_index") + window))).filter("near >= 0")
    other = chunks.select(F.col("doc_key").alias("k"), F.col("chunk_index").alias("i"), F.col("chunk_id").alias("neighbour_id"))
    return near.join(other, (F.col("doc_key") == F.col("k")) & (F.col("near") == F.col("i"))).drop("k", "i", "near")


def _anchored(labels: DataFrame, chunks: DataFrame) -> DataFrame:
    """labels with at, the index of every chunk of the document that holds the label's text whatever its case and white space."""
    bodies = chunks.select("doc_key", F.col("chunk_index").alias("at"), flat(F.col("content")).alias("content"))
    wanted = labels.withColumn("needle", flat(F.col("contains")))
    pairs = holding(bodies, wanted, F.contains("content", "needle"), "at", on=("doc_key",)).drop("content")
    return wanted.join(pairs, ["doc_key", "needle"]).drop("needle")


def anchor_counts(labels: DataFrame, chunks: DataFrame) -> DataFrame:
    """In how many chunks of its document a label's text stands; labels of documents without chunks are left out."""
    hits = _anchored(labels, chunks).groupBy("query_id", "doc_key", "contains").agg(F.count("*").alias("n"))
    known = labels.join(chunks.select("doc_key").distinct(), "doc_key", "left_semi").select("query_id", "doc_key", "contains").distinct()
    same = (known["query_id"] == hits["query_id"]) & (known["doc_key"] == hits["doc_key"]) & known["contains"].eqNullSafe(hits["contains"])
    return known.join(hits, same, "left").select(known["query_id"], known["doc_key"], known["contains"], F.coalesce("n", F.lit(0)).alias("n"))


def anchor_buckets(counts: DataFrame) -> DataFrame:
    bucket = F.when(F.col("n") <= 1, "unique").when(F.col("n") <= 8, "2-8").otherwise("over 8")
    return counts.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("labels"))


def nearest_anchor(labels: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunk of the document with the label's text that is nearest to the labelled place, of equally near ones the first."""
    near = F.min(F.struct(F.abs(F.col("at") - F.col("chunk_index")).alias("far"), F.col("at").alias("at")))
    return _anchored(labels, chunks).groupBy("query_id", "doc_key", "chunk_index").agg(near.alias("n"), F.count("*").alias("places")).select("query_id", "doc_key", "chunk_index", F.col("n.at").alias("nearest"), (F.col("n.at") - F.col("chunk_index")).alias("offset"), "places")


def relocate_by_content(old: DataFrame, new: DataFrame) -> DataFrame:
    """Where chunks went: to the one chunk of the document with the same text, whatever its white space and case; several or none move nothing."""
    key = lambda df, n: df.select("doc_key", F.col("chunk_index").alias(n), F.sha2(flat(F.col("content")).cast("binary"), 256).alias("same"))
    targets = key(new, "to").groupBy("doc_key", "same").agg(F.count("*").alias("n"), F.min("to").alias("to"))
    found = key(old, "from").join(targets, ["doc_key", "same"], "left")
    return found.select("doc_key", "from", F.when(F.col("n") == 1, F.col("to")).alias("to"), F.when(F.col("n").isNull(), "gone").when(F.col("n") > 1, "ambiguous").when(F.col("to") == F.col("from"), "same").otherwise("moved").alias("outcome"))


def relocate_by_probes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Where chunks went, by the share of their probes that a chunk of the
    document holds. Of equal shares an index that didn't rise, then the nearest,
    then the lower wins; a share under the confident one, or another close
    below it, moves nothing."""
    asked = old.select("doc_key", F.col("chunk_index").alias("from"), probes(F.col("content")).alias("probes")).filter(F.size("probes") > 0)
    asked = asked.join(new.select("doc_key").distinct(), "doc_key", "left_semi")
    each = asked.select("doc_key", "from", F.size("probes").alias("asked"), F.explode("probes").alias("needle"))
    bodies = new.select("doc_key", F.col("chunk_index").alias("at"), flat(F.col("content")).alias("content"))
    held = holding(bodies, each, F.contains("content", "needle"), "at", on=("doc_key",)).drop("content")
    hits = each.join(held, ["doc_key", "needle"])
    pairs = hits.groupBy("doc_key", "from", "at").agg((F.count("*") / F.first("asked")).alias("share"))
    group = Window.partitionBy("doc_key", "from")
    key = F.struct((-F.col("share")).alias("s"), (F.col("at") > F.col("from")).alias("up"), F.abs(F.col("from") - F.col("at")).alias("far"), F.col("at").alias("at"))
    ranked = pairs.withColumn("best", F.max("share").over(group))
    found = ranked.groupBy("doc_key", "from").agg(F.first("best").alias("best"), F.min(key).alias("k"), F.max(F.when(F.col("share") < F.col("best") - 1e-9, F.col("share"))).alias("runner_up"))
    out = asked.select("doc_key", "from").join(found, ["doc_key", "from"], "left").na.fill(0.0, ["best", "runner_up"])
    outcome = F.when(F.col("best") < C.CONFIDENT, "lost").when((F.col("best") < 1.0) & (F.col("best") - F.col("runner_up") < C.AMBIGUOUS_MARGIN), "ambiguous").otherwise("found")
    return out.select("doc_key", "from", F.when(outcome == "found", F.col("k.at")).alias("to"), "best", "runner_up", outcome.alias("outcome"))


def compare_tables(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per document: rows of each side, keys on one side, texts that differ, the first such index."""
    side = lambda df, n: df.select("doc_key", "chunk_index", F.sha2(F.col("content").cast("binary"), 256).alias(n))
    both = side(left, "l").join(side(right, "r"), ["doc_key", "chunk_index"], "full")
    differ = F.col("l").isNotNull() & F.col("r").isNotNull() & (F.col("l") != F.col("r"))
    return both.groupBy("doc_key").agg(F.count("l").alias("left_rows"), F.count("r").alias("right_rows"), F.count_if(F.col("r").isNull()).alias("left_only"), F.count_if(F.col("l").isNull()).alias("right_only"), F.count_if(differ).alias("differ"), F.min(F.when(differ, F.col("chunk_index"))).alias("first_difference"))


def truth_table(labels: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """In which of two corpora the labelled chunks hold the label's text."""
    side = lambda df, n: df.select("doc_key", "chunk_index", F.col("content").alias(n))
    both = labels.join(side(first, "a"), ["doc_key", "chunk_index"], "left").join(side(second, "b"), ["doc_key", "chunk_index"], "left")
    has = lambda c: F.coalesce(F.contains(flat(F.col(c)), flat(F.col("contains"))), F.lit(False))
    kind = F.when(F.col("a").isNull() & F.col("b").isNull(), "absent").when(has("a") & has("b"), "both").when(has("a"), "first only").when(has("b"), "second only").otherwise("neither")
    return both.groupBy(kind.alias("kind")).agg(F.count("*").alias("labels"), F.count_if(F.col("a") != F.col("b")).alias("texts_differ"))


def company_mismatches(detected: DataFrame, gold_keys: DataFrame) -> DataFrame:
    """Questions whose named companies and gold companies have nothing in common; both (query_id, keys)."""
    both = detected.select("query_id", F.col("keys").alias("named")).join(gold_keys.select("query_id", F.col("keys").alias("labelled")), "query_id")
    return both.filter((F.size("named") > 0) & (F.size("labelled") > 0) & ~F.arrays_overlap("named", "labelled"))


def compare_records(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, left, right): fields that differ as text, and whole records on one side."""
    side = lambda df, n: df.select(key, F.struct(*(F.col(f).cast("string").alias(f) for f in fields)).alias(n))
    both = side(left, "l").join(side(right, "r"), key, "full")
    whole = F.when(F.col("r").isNull(), F.array(F.struct(F.lit("(only left)").alias("field"), F.lit("").alias("left"), F.lit("").alias("right")))).when(F.col("l").isNull(), F.array(F.struct(F.lit("(only right)").alias("field"), F.lit("").alias("left"), F.lit("").alias("right"))))
    each = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"l.{f}").alias("left"), F.col(f"r.{f}").alias("right")) for f in fields))
    rows = F.coalesce(whole, F.filter(each, lambda x: ~x["left"].eqNullSafe(x["right"])))
    return both.select(key, F.explode(rows).alias("d")).select(key, "d.*")


def split_members(ids: DataFrame, splits: DataFrame) -> DataFrame:
    """Number of ids by split; ids without one are unassigned."""
    return ids.join(splits, "id", "left").groupBy(F.coalesce("split", F.lit("unassigned")).alias("split")).agg(F.count("*").alias("n"))


def split_integrity(ids: DataFrame, splits: DataFrame) -> DataFrame:
    """(id, problem): in more than one split, unknown, or in none."""
    twice = splits.groupBy("id").agg(F.count_distinct("split").alias("n")).filter("n > 1").select("id", F.lit("in more than one split").alias("problem"))
    unknown = splits.join(ids, "id", "left_anti").select("id").distinct().withColumn("problem", F.lit("unknown"))
    none = ids.join(splits, "id", "left_anti").select("id").withColumn("problem", F.lit("unassigned"))
    return twice.unionByName(unknown).unionByName(none)


def symmetric_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def navigation_table(scores: DataFrame, score: Column, thresholds: tuple[float, ...] = (0.3, 0.4, 0.5, 0.6, 0.7, 0.8)) -> DataFrame:
    """Chunks at or over each threshold, in one pass without a row per pair."""
    each = F.explode(F.filter(F.array(*(F.lit(t) for t in thresholds)), lambda t: t <= F.col("s")))
    counts = scores.select(score.alias("s")).select(each.alias("threshold")).groupBy("threshold").agg(F.count("*").alias("chunks"))
    every = scores.sparkSession.createDataFrame([(t,) for t in thresholds], "threshold double")
    return every.join(counts, "threshold", "left").na.fill(0, ["chunks"])


def extend_anchors(labels: DataFrame, chunks: DataFrame, max_words: int = 20, max_places: int = 6) -> DataFrame:
    """(query_id, doc_key, chunk_index, anchor, n): a label's text grown word by
    word, to the side that fewer chunks of the document hold, until one chunk
    is left. Every step takes a whole word, also the last of a chunk; of a
    text's first max_places places in its chunk the one that ends with the
    fewest chunks counts.

    Each hit of a text is reduced to how many words before and after it agree
    with those around a place in the labelled chunk. A text grown by i words
    before and j after is in the chunks with a hit that agrees in i and j at
    least, so all that growing needs is a table of (i, j) a place, which Spark
    counts; no task gets the texts of a document."""
    keys = ["query_id", "doc_key", "chunk_index", "contains"]
    asked = labels.select(F.struct(*keys).alias("label"), "doc_key", "chunk_index", flat(F.col("contains")).alias("needle")).distinct()
    own = chunks.select("doc_key", "chunk_index", collapse(F.col("content")).alias("body"))
    rows = asked.join(own, ["doc_key", "chunk_index"], "left").withColumn("places", _around(F.col("body"), F.col("needle"), max_words, max_places)).drop("body")
    bodies = chunks.select("doc_key", F.col("chunk_index").alias("at"), flat(F.col("content")).alias("content"))
    hits = holding(bodies, asked.filter("needle <> ''").select("doc_key", "needle"), F.contains("content", "needle"), "at", on=("doc_key",))
    met = rows.filter(F.size("places") > 0).join(hits, ["doc_key", "needle"])
    cells = met.select("label", F.explode(_agreements(F.col("places"), F.col("needle"), F.col("content"))).alias("c")).select("label", "c.*")
    counts = cells.groupBy("label", "place", "before", "after").agg(F.count("*").alias("n"))
    # At most (max_words + 1) squared cells a place.
    table = counts.groupBy("label", "place").agg(F.collect_list(F.struct("before", "after", "n")).alias("table"))
    each = rows.select("label", F.posexplode("places").alias("place", "around"))
    grown = each.join(table, ["label", "place"]).select("label", "place", _grown("around", "table", max_words).alias("g"))
    best = grown.groupBy("label").agg(F.min(F.struct("g.n", "place", "g.anchor")).alias("b"))
    out = asked.select("label").join(best, "label", "left")
    return out.select("label.query_id", "label.doc_key", "label.chunk_index", F.coalesce("b.anchor", "label.contains").alias("anchor"), F.coalesce("b.n", F.lit(0)).cast("long").alias("n"))


def _around(body: Column, needle: Column, max_words: int, max_places: int) -> Column:
    """The first places of needle in body: what stands there, from the start of
    its first word, and what each further word before and after adds."""

    def words_before(text: str, stop: int) -> list[str]:
        out = []
        while stop > 0 and len(out) < max_words:
            start = text.rfind(" ", 0, stop - 1) + 1
            out.append(text[start:stop])
            stop = start
        return out

    def words_after(text: str, start: int) -> list[str]:
        out = []
        while start < len(text) and len(out) < max_words:
            stop = text.find(" ", start + 1)
            stop = len(text) if stop < 0 else stop
            out.append(text[start:stop])
            start = stop
        return out

    @F.pandas_udf("array<struct<core: string, offset: int, before: array<string>, after: array<string>>>")
    def of(bodies: pd.Series, needles: pd.Series) -> pd.Series:
        def one(text: str | None, wanted: str | None) -> list[dict]:
            out, low = [], (text or "").lower()
            at = low.find(wanted) if wanted else -1
            while at >= 0 and len(out) < max_places:
                start, end = text.rfind(" ", 0, at) + 1, at + len(wanted)
                out.append({"core": text[start:end], "offset": at - start, "before": words_before(text, start), "after": words_after(text, end)})
                at = low.find(wanted, at + 1)
            return out

        return pd.Series([one(*x) for x in zip(bodies, needles, strict=True)], dtype="object")

    return of(body, needle)


def _agreements(places: Column, needle: Column, content: Column) -> Column:
    """Of each place, the numbers of words before and after with which one of the text's hits agrees."""

    @F.pandas_udf("array<struct<place: int, before: int, after: int>>")
    def of(all_places: pd.Series, needles: pd.Series, texts: pd.Series) -> pd.Series:
        def agreeing(words: list[str], holds) -> int:
            n, joint = 0, ""
            while n < len(words) and (joint := holds(joint, words[n].lower())) is not None:
                n += 1
            return n

        def one(around, wanted: str, text: str) -> list[dict]:
            cells = set()
            for place, x in enumerate(around):
                lead = x["core"][: x["offset"]].lower()
                at = text.find(wanted)
                while at >= 0:
                    if text.startswith(lead, at - len(lead)) and at >= len(lead):
                        left, right = at - len(lead), at + len(wanted)
                        earlier = lambda joint, w: w + joint if text.endswith(w, 0, left - len(joint)) else None  # noqa: B023, E731
                        later = lambda joint, w: joint + w if text.startswith(w, right + len(joint)) else None  # noqa: B023, E731
                        i, j = agreeing(list(x["before"]), earlier), agreeing(list(x["after"]), later)
                        cells.update((place, a, b) for a in range(i + 1) for b in range(j + 1))
                    at = text.find(wanted, at + 1)
            return [{"place": p, "before": a, "after": b} for p, a, b in sorted(cells)]

        return pd.Series([one(*x) for x in zip(all_places, needles, texts, strict=True)], dtype="object")

    return of(places, needle, content)


def _grown(around: str, table: str, max_words: int) -> Column:
    """The text that growing ends with, and the chunks that hold it; of equal counts the text that sorts first is taken."""

    @F.pandas_udf("n long, anchor string")
    def of(places: pd.Series, tables: pd.Series) -> pd.DataFrame:
        out = []
        for x, cells in zip(places.to_dict("records"), tables, strict=True):
            count = {(c["before"], c["after"]): c["n"] for c in cells}
            before, after = list(x["before"]), list(x["after"])
            text = lambda i, j: "".join(before[:i][::-1]) + x["core"] + "".join(after[:j])  # noqa: B023, E731
            here = (0, 0)
            for _ in range(max_words):
                wider = [(count.get(to, 0), text(*to), to) for to in ((here[0] + 1, here[1]), (here[0], here[1] + 1)) if to[0] <= len(before) and to[1] <= len(after)]
                if count.get(here, 0) <= 1 or not wider:
                    break
                here = min(wider)[2]
            out.append((count.get(here, 0), text(*here).strip()))
        return pd.DataFrame(out, columns=["n", "anchor"])

    return of(F.col(around), F.col(table))
