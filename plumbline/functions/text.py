"""Text functions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline import config as C

SPACE = r"(?U)\s+"


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def flat(text: Column) -> Column:
    return F.lower(collapse(text))


def contains_flat(text: Column, needle: Column) -> Column:
    """Does text hold needle, whatever the case and white space? An empty needle is nowhere."""
    wanted = flat(needle)
    return F.when(wanted == "", False).otherwise(F.contains(flat(text), wanted))


def tokens(text: Column) -> Column:
    """Runs of letters and digits of any script, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), 0)


def words(text: Column) -> Column:
    return F.when(collapse(text) == "", F.array().cast("array<string>")).otherwise(F.split(collapse(text), " "))


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, C.PARAGRAPH_BREAK), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: p != "")


def sentences(text: Column) -> Column:
    return F.split(text, C.SENTENCE_BREAK)


def label(company: Column, fiscal_year: Column, section: Column) -> Column:
    """(Company, FY2026, Item 8); a missing section leaves no comma."""
    return F.concat(F.lit("("), F.concat_ws(", ", F.nullif(company, F.lit("")), F.concat(F.lit("FY"), fiscal_year.cast("string")), F.nullif(section, F.lit(""))), F.lit(")"))


def digest(data: Column) -> Column:
    return F.sha2(data.cast("binary"), 256)


def digest_lf(text: Column) -> Column:
    """Digest with line ends as \\n."""
    return digest(F.regexp_replace(text, "\r\n?", "\n"))


def digest_crlf(text: Column) -> Column:
    """Upper-case digest with line ends as \\r\\n."""
    return F.upper(digest(F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "\n", "\r\n")))


def cache_key(model: Column, run: Column, question: Column, ids: Column) -> Column:
    joined = F.concat_ws("|", model, run.cast("string"), question, F.array_join(F.transform(ids, lambda x: x.cast("string")), ","))
    return F.substring(digest(joined), 1, 16)


def file_stem(path: Column) -> Column:
    """Name without folders and last suffix; both slashes separate folders."""
    return F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), r"([^/]+?)(\.[^./]*)?$", 1)


def fiscal_year(report_date: Column) -> Column:
    return F.year(F.to_date(report_date))


def vector_literal(text: Column) -> Column:
    """'[0.1,0.2]' as an array."""
    return F.from_json(text, "array<float>")


def distinct_ignoring_case(values: Column) -> Column:
    """The first of each, in order."""
    return F.aggregate(values, F.array().cast("array<string>"), lambda seen, x: F.when(F.exists(seen, lambda y: F.lower(y) == F.lower(x)), seen).otherwise(F.array_append(seen, x)))


def _bare(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(value, r"^[\s,;:]+|[\s,;:]+$", ""), r"\.+$", "")


def anchors(answer: Column) -> Column:
    """What must survive of a labelled answer: long figures, openings of quotes, names; at least 4 characters."""
    text = F.coalesce(answer, F.lit(""))
    quoted = F.transform(F.regexp_extract_all(text, F.lit(C.QUOTED), 1), lambda q: F.array_join(F.slice(F.split(collapse(q), " "), 1, 6), " "))
    names = F.filter(F.regexp_extract_all(text, F.lit(C.PROPER), 0), lambda x: ~x.isin(*C.NOT_A_NAME))
    found = F.concat(F.regexp_extract_all(text, F.lit(C.LONG_FIGURE), 0), quoted, names)
    return distinct_ignoring_case(F.filter(F.transform(found, _bare), lambda x: F.char_length(x) >= 4))


def weak_anchors(answer: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(C.SHORT_FIGURE), 0)
    return distinct_ignoring_case(F.filter(F.transform(found, _bare), lambda x: x != ""))


def pick_anchor(answer: Column, content: Column) -> Column:
    """struct(anchor, note): the first strong anchor that content holds, else the first weak one."""
    body = flat(content)
    held = lambda xs: F.get(F.filter(xs, lambda x: F.contains(body, flat(x))), F.lit(0))
    strong, weak = held(anchors(answer)), held(weak_anchors(answer))
    note = F.when(strong.isNotNull(), "strong").when(weak.isNotNull(), "weak").when(F.size(anchors(answer)) + F.size(weak_anchors(answer)) > 0, "absent").otherwise("none")
    return F.struct(F.coalesce(strong, weak).alias("anchor"), note.alias("note"))


def answer_words(answer: Column) -> Column:
    """Content words of an answer: figures of any length, other words of 3 letters and more."""
    raw = F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"(?U)[\w,\.%$€£]+"), 0)
    bare = F.transform(raw, lambda w: F.lower(F.regexp_replace(w, r"""^[$€£.,;:()\[\]"']+|[$€£.,;:()\[\]"']+$""", "")))
    return F.array_sort(F.array_distinct(F.filter(bare, lambda w: ~w.isin("", *C.ANSWER_STOP_WORDS) & (w.rlike(r"\d") | (F.char_length(w) > 2)))))


def navigation_score(text: Column) -> Column:
    """From 0, prose, to 1, a list of pointers: contents entries, lack of sentences, and markers."""
    n = F.greatest(F.size(words(text)), F.lit(1))
    entries = F.least(F.regexp_count(text, F.lit(C.NAV_ENTRY)) / n * 100 / 4.0, F.lit(1.0))
    sparse = F.least(F.greatest(1.5 - F.regexp_count(text, F.lit(r"[.!?]\s")) / n * 100, F.lit(0.0)) / 1.5, F.lit(1.0))
    markers = F.least(F.regexp_count(text, F.lit(C.NAV_MARKERS)) / 2.0, F.lit(1.0))
    return 0.45 * entries + 0.25 * sparse + 0.30 * markers


def probes(content: Column) -> Column:
    """Pieces of a text, spread over its length, by which it can be found again."""
    trimmed = F.transform(F.split(content, C.PROBE_BREAK), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", ""))
    pieces = F.transform(F.filter(trimmed, lambda p: F.char_length(p) >= C.PROBE_MIN_CHARS), flat)
    body = flat(content)
    starts = F.sequence(F.lit(1), F.greatest(F.char_length(body), F.lit(1)), F.lit(200))
    windows = F.filter(F.transform(starts, lambda i: F.substring(body, i, F.lit(120))), lambda p: F.char_length(p) >= C.PROBE_MIN_CHARS)
    found = F.when(F.size(pieces) > 0, pieces).otherwise(windows)
    spread = F.transform(F.sequence(F.lit(0), F.lit(C.PROBE_COUNT - 1)), lambda i: F.get(found, F.floor(i * F.size(found) / C.PROBE_COUNT).cast("int")))
    return F.when(F.size(found) <= C.PROBE_COUNT, found).otherwise(spread)


def clean_note(note: Column) -> Column:
    """A note without its internal prefix."""
    return F.trim(F.regexp_replace(F.coalesce(note, F.lit("")), C.NOTE_PREFIX, ""))


def preview(text: Column, needle: Column, width: int = 160) -> Column:
    """About width characters around the first place of needle, or the beginning."""
    one = collapse(text)
    at = F.position(F.lower(needle), F.lower(one))
    start = F.greatest(F.lit(1), at - width // 2)
    return F.substring(one, start.cast("int"), F.lit(width))


def income_statement_complete(text: Column) -> Column:
    """What a captured set of financial statements lacks."""
    low = F.lower(text)
    lacks = F.filter(F.array(*(F.lit(x) for x in C.FPAGE_REQUIRED)), lambda x: ~F.contains(low, x))
    income = reduce(lambda a, b: a | b, (F.contains(low, F.lit(x)) for x in C.FPAGE_INCOME))
    return F.concat(lacks, F.when(income, F.array().cast("array<string>")).otherwise(F.array(F.lit("statements of operations/income"))))
