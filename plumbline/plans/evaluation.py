"""Registered queries: generated answers and their statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from plumbline.functions import answers as A
from plumbline.operators import judging as J
from plumbline.operators import metrics as M
from plumbline.operators import resampling as R
from plumbline.plans import workload as W
from plumbline.plans.retrieval import WILSON_SQL
from plumbline.plans.workload import with_views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
G = with_views("", "gen")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def rounded(df, *columns: str):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("a14_answer_rates", G + " SELECT count(*) AS n, round(coalesce(avg(refused::INTEGER) FILTER (NOT answerable), 0), 6) AS refusal, round(coalesce(avg(refused::INTEGER) FILTER (answerable), 0), 6) AS false_refusal, round(coalesce(avg((NOT refused)::INTEGER) FILTER (NOT answerable), 0), 6) AS hallucination FROM gen")
def a14(spark, d):
    return rounded(M.answer_rates(W.generations(spark, d)), "refusal", "false_refusal", "hallucination")


@query("a15_rates_by_type", G + " SELECT type, count(*) AS n, round(avg(refused::INTEGER), 6) AS refused, round(avg((NOT refused)::INTEGER), 6) AS answered FROM gen GROUP BY 1")
def a15(spark, d):
    return rounded(M.rates_by_type(W.generations(spark, d)), "refused", "answered")


@query("a16_flips", G + " SELECT id, count(*) AS runs, count(*) FILTER (refused) AS refusals FROM gen GROUP BY 1 HAVING count(DISTINCT refused) > 1")
def a16(spark, d):
    return M.flips(W.generations(spark, d))


@query("a17_groundedness", G + " SELECT sum(supported)::BIGINT AS supported, sum(unsupported)::BIGINT AS unsupported, sum(judge_errors)::BIGINT AS errors, round(sum(supported) / (sum(supported) + sum(unsupported)), 6) AS groundedness, round(sum(judge_errors) / (sum(supported) + sum(unsupported) + sum(judge_errors)), 6) AS error_rate FROM gen")
def a17(spark, d):
    return rounded(M.groundedness(W.generations(spark, d)), "groundedness", "error_rate")


V = ", v AS (SELECT {by} verdict, count(*) AS n FROM gen GROUP BY ALL) SELECT {by} verdict, n, round(n / sum(n) OVER w, 6) AS of_all, round(CASE WHEN verdict <> 'JUDGE_ERROR' THEN n / sum(n) FILTER (verdict <> 'JUDGE_ERROR') OVER w ELSE 0 END, 6) AS of_decided FROM v WINDOW w AS ({part})"


@query("a18_verdicts", G + V.format(by="", part=""))
def a18(spark, d):
    return rounded(M.verdicts(W.generations(spark, d)), "of_all", "of_decided")


@query("a18_verdicts_by_type", G + V.format(by="type,", part="PARTITION BY type"))
def a18b(spark, d):
    return rounded(M.verdicts(W.generations(spark, d), "type"), "of_all", "of_decided")


@query("a19_correct_without_gold", G + " SELECT id, run FROM gen WHERE verdict = 'CORRECT' AND NOT gold_retrieved AND answerable")
def a19(spark, d):
    return W.generations(spark, d).filter("verdict = 'CORRECT' and not gold_retrieved and answerable").select("id", "run")


BYQ = ", byq AS (SELECT id, arg_min(type, run) AS type, arg_min(answerable, run) AS answerable, arg_min(gold_labelled, run) AS gold_labelled, count(*) AS runs, count(*) FILTER (refused) AS refusals, bool_or(gold_retrieved) AS gold_retrieved FROM gen GROUP BY 1), bq AS (SELECT *, 2 * refusals > runs AS refused, refusals > 0 AND refusals < runs AS unstable FROM byq)"


@query("a20_by_question", G + BYQ + " SELECT * FROM bq")
def a20(spark, d):
    return M.by_question(W.generations(spark, d))


@query("a21_justified_refusals", G + BYQ + " SELECT count(*) AS refused, count(*) FILTER (gold_labelled AND NOT gold_retrieved) AS justified, count(*) FILTER (NOT gold_labelled OR gold_retrieved) AS unjustified FROM bq WHERE answerable AND refused")
def a21(spark, d):
    return M.justified_refusals(M.by_question(W.generations(spark, d)))


@query("a22_pooled_zero_rate", G + BYQ + f", p AS (SELECT id % 2 AS split, id FROM bq WHERE NOT answerable AND NOT refused UNION ALL SELECT 2, id FROM bq WHERE false), c AS (SELECT (SELECT count(*) FROM p)::DOUBLE AS k, count(*) AS n FROM bq WHERE NOT answerable) SELECT k, n, {WILSON_SQL} FROM c")
def a22(spark, d):
    """Inventions pooled over two splits, with the interval that a zero rate needs."""
    q = M.by_question(W.generations(spark, d)).filter("not answerable")
    pooled = q.filter("id % 2 = 0").unionByName(q.filter("id % 2 = 1"))
    out = pooled.agg(F.count_if(~F.col("refused")).cast("double").alias("k"), F.count("*").alias("n"))
    return rounded(out.select("k", "n", M.wilson(F.col("k"), F.col("n")).alias("w")).select("k", "n", "w.low", "w.high"), "low", "high")


@query("a24_bootstrap_mean")
def a24(spark, d):
    """Interval of the mean rate per type; the generator isn't SQL, tests compare with a plain loop."""
    rates = M.question_rates(W.generations(spark, d)).join(W.generations(spark, d).select("id", "type").distinct(), "id")
    return R.bootstrap(rates, "type", "id", "rate", "mean")


def _pairs(spark, d):
    g = W.generations(spark, d)
    return M.paired(M.question_rates(g.filter("run % 4 < 2")), M.question_rates(g.filter("run % 4 >= 2")))


PAIRS = G + """, b AS (SELECT id, avg(CASE WHEN verdict <> 'JUDGE_ERROR' THEN (verdict = 'CORRECT')::INTEGER END) AS before, true AS y FROM gen WHERE run % 4 < 2 GROUP BY 1),
a AS (SELECT id, avg(CASE WHEN verdict <> 'JUDGE_ERROR' THEN (verdict = 'CORRECT')::INTEGER END) AS after, true AS y FROM gen WHERE run % 4 >= 2 GROUP BY 1),
pairs AS (SELECT id, before, after, after - before AS diff, CASE WHEN a.y IS NULL THEN 'before only' WHEN b.y IS NULL THEN 'after only' WHEN before IS NULL OR after IS NULL THEN 'illegible' ELSE 'paired' END AS side FROM b FULL JOIN a USING (id))"""


@query("a25_paired_bootstrap")
def a25(spark, d):
    return R.bootstrap(_pairs(spark, d).filter("side = 'paired'"), "side", "id", "diff", "paired")


@query("a26_ordering_bootstrap")
def a26(spark, d):
    return R.bootstrap(_pairs(spark, d).filter("side = 'paired'"), "side", "id", "diff", "ordering")


@query("a27_question_rates", G + " SELECT id, round(avg(CASE WHEN verdict <> 'JUDGE_ERROR' THEN (verdict = 'CORRECT')::INTEGER END), 6) AS rate FROM gen GROUP BY 1")
def a27(spark, d):
    return rounded(M.question_rates(W.generations(spark, d)), "rate")


@query("j10_paired", PAIRS + " SELECT id, round(before, 6) AS before, round(after, 6) AS after, round(diff, 6) AS diff, side FROM pairs")
def j10(spark, d):
    """Two sides' questions, paired or on one side only."""
    return rounded(_pairs(spark, d), "before", "after", "diff")


@query("a28_signs", PAIRS + " SELECT count(*) AS n, round(avg(diff), 6) AS mean_diff, count(*) FILTER (diff > 0) AS up, count(*) FILTER (diff < 0) AS down, count(*) FILTER (diff = 0) AS unchanged FROM pairs WHERE side = 'paired'")
def a28(spark, d):
    return rounded(M.signs(_pairs(spark, d)), "mean_diff")


FILES = ", f AS (SELECT 0 AS file_ord, * FROM gen WHERE id % 3 <> 0 UNION ALL SELECT 1, * REPLACE ('second' AS type) FROM gen), m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, run ORDER BY file_ord) AS n FROM f) WHERE n = 1)"


@query("a30_merged_files", G + FILES + " SELECT file_ord, type, count(*) AS records, (SELECT sum(supported)::BIGINT FROM f) AS supported_in_all FROM m GROUP BY 1, 2")
def a30(spark, d):
    """Records once, from the first file that has them; counters add up over all files."""
    g = W.generations(spark, d)
    files = g.filter("id % 3 <> 0").withColumn("file_ord", F.lit(0)).unionByName(g.withColumns({"file_ord": F.lit(1), "type": F.lit("second")}))
    total = files.agg(F.sum("supported").alias("supported_in_all"))
    return M.merged(files).groupBy("file_ord", "type").agg(F.count("*").alias("records")).crossJoin(F.broadcast(total))


@query("a31_latency_cost", """SELECT count(*) AS n, round(median(value), 6) AS median_retrieval_s, round(min(value), 6) AS min_retrieval_s, round(max(value), 6) AS max_retrieval_s,
  round(median(2 * value), 6) AS median_generation_s, round(min(2 * value), 6) AS min_generation_s, round(max(2 * value), 6) AS max_generation_s, round(median(3 * value), 6) AS median_total_s, round(min(3 * value), 6) AS min_total_s, round(max(3 * value), 6) AS max_total_s,
  median(user_id)::DOUBLE AS median_input_tokens, median(user_id % 100)::DOUBLE AS median_output_tokens, round(median(user_id / 1e6 * 3.0 + (user_id % 100) / 1e6 * 15.0), 9) AS median_cost FROM events""")
def a31(spark, d):
    """Medians and ranges of times, and of the cost at two prices; events stand in for timed calls."""
    e = W.table(spark, d, "events")
    rows = e.select(F.col("value").alias("retrieval_s"), (2 * F.col("value")).alias("generation_s"), (3 * F.col("value")).alias("total_s"), F.col("user_id").alias("input_tokens"), (F.col("user_id") % 100).alias("output_tokens"))
    out = M.latency(rows, 3.0, 15.0)
    return out.select(*(F.round(c, 9 if c == "median_cost" else 6).alias(c) if c.endswith(("_s", "cost")) else c for c in out.columns))


@query("a42_behaviour", G + BYQ + " SELECT CASE WHEN refusals = runs THEN 'every run' WHEN refusals > 0 THEN 'some runs' ELSE 'no run' END AS refused_in, count(*) AS questions FROM bq GROUP BY 1")
def a42(spark, d):
    return M.behaviour(W.generations(spark, d))


@query("p18_cases", G + """ SELECT kind, count(*) AS n FROM (SELECT unnest([x for x in [CASE WHEN refused AND answerable THEN 'false refusal' END, CASE WHEN NOT refused AND NOT answerable THEN 'hallucination' END,
  CASE WHEN n_cited = 0 AND NOT refused THEN 'citation problem' END, CASE WHEN NOT refused THEN 'answered' END, CASE WHEN unsupported > 0 THEN 'unsupported' END, CASE WHEN judge_errors > 0 THEN 'judge error' END] if x IS NOT NULL]) AS kind FROM gen) GROUP BY 1""")
def p18(spark, d):
    """Answers by what makes them worth reading; one answer can be several."""
    g = W.generations(spark, d)
    c, flags = F.col, {"false refusal": F.col("refused") & F.col("answerable"), "hallucination": ~F.col("refused") & ~F.col("answerable"), "citation problem": (F.col("n_cited") == 0) & ~F.col("refused"), "answered": ~F.col("refused")}
    flags |= {"unsupported": c("unsupported") > 0, "judge error": c("judge_errors") > 0}
    kinds = F.filter(F.array(*(F.when(f, k) for k, f in flags.items())), lambda x: x.isNotNull())
    return g.select(F.explode(kinds).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query("p19_gallery", G + " SELECT CASE WHEN NOT answerable AND type = 'unanswerable_adversarial' THEN 'trap' WHEN answerable AND refused THEN 'miss' WHEN NOT answerable THEN 'absent' ELSE 'answered' END AS place, count(*) AS n FROM gen GROUP BY 1")
def p19(spark, d):
    """The first group that fits."""
    place = F.when(~F.col("answerable") & (F.col("type") == "unanswerable_adversarial"), "trap").when(F.col("answerable") & F.col("refused"), "miss").when(~F.col("answerable"), "absent").otherwise("answered")
    return W.generations(spark, d).groupBy(place.alias("place")).agg(F.count("*").alias("n"))


@query("p13_answerable_labelled", G + " SELECT type, count(*) AS n FROM gen WHERE answerable AND gold_labelled AND type <> 'comparative' GROUP BY 1")
def p13(spark, d):
    """Answers to labelled questions that have one, of some types."""
    return W.generations(spark, d).filter("answerable and gold_labelled and type <> 'comparative'").groupBy("type").agg(F.count("*").alias("n"))


@query("j8_question_records", G + " SELECT c.conv_id AS id, count(g.run) AS records FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN gen g ON g.id = c.conv_id GROUP BY 1")
def j8(spark, d):
    """Questions with their records, also those without."""
    ids = W.table(spark, d, "conversations").select(F.col("conv_id").alias("id")).distinct()
    return ids.join(W.generations(spark, d).select("id", "run"), "id", "left").groupBy("id").agg(F.count("run").alias("records"))


@query("j9_cited_chunks", G + """, x AS (SELECT id, run, unnest(range(1, n_cited + 3)) AS cited, [(id + 1) % 100, (id + 2) % 100, (id + 3) % 100] AS excerpts FROM gen)
SELECT x.id, x.run, x.cited, d.doc_id AS chunk_id, d.source AS doc_key FROM x JOIN documents d ON d.doc_id = x.excerpts[x.cited] WHERE x.cited BETWEEN 1 AND 3""")
def j9(spark, d):
    """Citation numbers as chunks, those outside the excerpts left out."""
    g = W.generations(spark, d).withColumn("excerpts", F.array(*((F.col("id") + i) % 100 for i in (1, 2, 3))))
    each = g.select("id", "run", F.explode(F.sequence(F.lit(1).cast("long"), (F.col("n_cited") + 2).cast("long"))).alias("cited"), "excerpts")
    found = each.filter(F.col("cited").between(1, F.size("excerpts"))).withColumn("chunk_id", F.element_at("excerpts", F.col("cited").cast("int")))
    docs = W.table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc_key"))
    return found.join(docs, "chunk_id").select("id", "run", "cited", "chunk_id", "doc_key")


#: Answers, judges' replies and their expected readings: no table holds such texts.
ANSWERS = [
    (1, "Net sales rose to $280 million [1]. Growth was 5% [2]."),
    (2, "Net sales rose to $280 million. Growth was 5% [2]."),
    (3, "Sales were strong [7]."),
    (4, "INSUFFICIENT_CONTEXT"),
    (5, "INSUFFICIENT_CONTEXT. The excerpts cover fiscal 2026 only."),
    (6, "INSUFFICIENT_CONTEXT. Revenue was $12 million."),
    (7, "The excerpts do not provide a count. Twelve countries have employees [3]."),
    (8, "Net sales rose by 5% [1]. The excerpts do not provide brand-level figures."),
    (9, "Revenue grew strongly."),
    (10, "- **One**: founded in 1978 [1]\n- **Two**: founded in 1983 [2]"),
    (11, ""),
]


def _answers(spark):
    return spark.createDataFrame(ANSWERS, "id long, text string")


VALUES = "VALUES " + ", ".join(f"({i}::BIGINT, {chr(39)}{t.replace(chr(39), chr(39) * 2)}{chr(39)})" for i, t in ANSWERS)
RE_REFUSAL = r"(?i)\b(?:do(?:es)? not (?:provide|contain|state|specify|include|give)|cannot be determined|is not (?:given|provided|stated|specified|disclosed)|no (?:exact |precise |specific )?(?:count|number|figure|data|information)\s+(?:is |of |for )?|not (?:disclosed|available) in the excerpts|the excerpts? (?:do|does) not)\b"
SPLIT_SQL = r"string_split(regexp_replace(regexp_replace(text, '([.!?])\s+([A-Z(\[]|[-*•]\s)', '\1' || chr(1) || '\2', 'g'), '\n\s*([-*•]\s)', chr(1) || '\1', 'g'), chr(1))"
REFUSED_SQL = f", s AS (SELECT *, {SPLIT_SQL} AS parts, regexp_matches(text, '{RE_REFUSAL}') AS prose FROM a), r AS (SELECT *, CASE WHEN starts_with(text, 'INSUFFICIENT_CONTEXT') THEN true WHEN contains(text, 'INSUFFICIENT_CONTEXT') THEN false WHEN NOT prose THEN false WHEN regexp_matches(parts[1], '{RE_REFUSAL}') THEN true ELSE len([p for p in parts if NOT regexp_matches(p, '{RE_REFUSAL}') AND regexp_matches(p, '\\[(\\d{{1,2}})\\]')]) = 0 END AS refused FROM s)"
ANSWERS_SQL = f"WITH a(id, text) AS ({VALUES})" + REFUSED_SQL


@query("a43_recomputed", G + ", a AS (SELECT refused AS before, CASE WHEN length(text) % 4 = 0 THEN 'INSUFFICIENT_CONTEXT. ' || text WHEN length(text) % 4 = 1 THEN 'The excerpts do not state it. ' || text ELSE text END AS text FROM gen)" + REFUSED_SQL + " SELECT before, refused AS after, count(*) AS n FROM r GROUP BY 1, 2")
def a43(spark, d):
    """Refusals found again from the saved text, of which half get such an opening, against the saved flags."""
    n = F.char_length("text") % 4
    text = F.when(n == 0, F.concat(F.lit("INSUFFICIENT_CONTEXT. "), "text")).when(n == 1, F.concat(F.lit("The excerpts do not state it. "), "text")).otherwise(F.col("text"))
    return W.generations(spark, d).groupBy(F.col("refused").alias("before"), A.is_refusal(text).alias("after")).agg(F.count("*").alias("n"))


@query("f16_is_refusal", ANSWERS_SQL + " SELECT id, refused FROM r")
def f16(spark, d):
    return _answers(spark).select("id", A.is_refusal(F.col("text")).alias("refused"))


@query("f15_citations", ANSWERS_SQL + r" SELECT id, [x::INTEGER for x in regexp_extract_all(text, '\[(\d{1,2})\]', 1)] AS cited FROM r")
def f15(spark, d):
    return _answers(spark).select("id", A.cited(F.col("text")).alias("cited"))


@query("f18_figures", ANSWERS_SQL + r" SELECT id, len([p for p in parts if regexp_matches(p, '[$€£]\s?[\d,]+|\b\d[\d,]*\.?\d*\s?%|\b\d[\d,]*\.?\d*\s?(?:million|billion|thousand)\b|\b(?:19|20)\d{2}\b') AND NOT regexp_matches(p, '\[(\d{1,2})\]')])::INTEGER AS uncited FROM r")
def f18(spark, d):
    """sentences with a figure and no citation."""
    from plumbline import config as C

    return _answers(spark).select("id", F.size(F.filter(A.sentences(F.col("text")), lambda s: s.rlike(C.FIGURE) & ~s.rlike(C.CITATION))).alias("uncited"))


@query("f17_verified")
def f17(spark, d):
    """cited excerpts and problems of each answer, given five excerpts; the tests state them."""
    return _answers(spark).select("id", A.verify(F.col("text"), F.lit(5)).alias("v")).select("id", "v.cited", "v.problems")


def _parity() -> Callable[[str, str, int], str]:
    """A stand-in for a model: its reply depends on the length of the prompt."""
    replies = ('{"verdict": "CORRECT", "reason": "same"}', "It is PARTIALLY_CORRECT.", "", '{"verdict": "INCORRECT"}', "no idea")
    return lambda system, user, max_tokens: replies[len(user) % 5]


@query("x6_judged_answers", """SELECT conv_id AS id, turn AS run, ['CORRECT', 'PARTIALLY_CORRECT', 'JUDGE_ERROR', 'INCORRECT', 'JUDGE_ERROR'][(n % 5 + 1)::INTEGER] AS verdict, CASE WHEN n % 5 = 0 THEN 'same' ELSE '' END AS reason
  FROM (SELECT *, length('QUESTION:' || chr(10) || 'of ' || conv_id || chr(10) || chr(10) || 'REFERENCE ANSWER:' || chr(10) || upper(role) || chr(10) || chr(10) || 'GENERATED ANSWER:' || chr(10) || text) AS n FROM conversations WHERE role = 'assistant')""")
def x6(spark, d):
    """Every answer judged by a provider."""
    t = W.table(spark, d, "conversations").filter("role = 'assistant'")
    rows = t.select(F.col("conv_id").alias("id"), F.col("turn").alias("run"), F.concat(F.lit("of "), F.col("conv_id").cast("string")).alias("question"), F.upper("role").alias("reference"), F.col("text").alias("generated"))
    return J.judge_answers(rows, _parity).select("id", "run", "verdict", "reason")


@query("f20_claims", ANSWERS_SQL + r", c AS (SELECT id, unnest([p for p in parts if regexp_matches(p, '\[(\d{1,2})\]') AND len(regexp_extract_all(p, '\S+')) > 3]) AS claim FROM r) SELECT id, trim(claim) AS claim FROM c")
def f20(spark, d):
    return _answers(spark).select("id", F.explode(A.claims(F.col("text"))).alias("c")).select("id", "c.claim")


REPLIES = [(1, '{"verdict": "SUPPORTED"}'), (2, 'Sure: {"verdict": "UNSUPPORTED", "why": "x"}'), (3, "NOT SUPPORTED by it"), (4, "This is supported."), (5, ""), (6, '{"verdict": "ABSENCE"}'), (7, '{"verdict": "MAYBE"}'), (8, "no idea"), (9, '{"verdict": "PARTIALLY_CORRECT", "reason": "half"}'), (10, "It is incorrect"), (11, "CORRECT"), (12, "partially_correct, I think")]
REPLY_VALUES = "WITH r(id, text) AS (VALUES " + ", ".join(f"({i}::BIGINT, '{t}')" for i, t in REPLIES) + ")"


@query("f21_claim_verdicts", REPLY_VALUES + r""", n AS (SELECT *, regexp_extract(text, '\{[^{}]*"verdict"\s*:\s*"([A-Z_]+)"[^{}]*\}', 1) AS v, upper(text) AS u FROM r)
SELECT id, CASE WHEN text = '' THEN 'judge_error' WHEN v IN ('SUPPORTED', 'UNSUPPORTED', 'ABSENCE') THEN lower(v) WHEN v <> '' THEN 'judge_error' WHEN contains(u, 'ABSENCE') THEN 'absence'
  WHEN contains(u, 'UNSUPPORTED') OR contains(u, 'NOT SUPPORTED') THEN 'unsupported' WHEN contains(u, 'SUPPORTED') THEN 'supported' ELSE 'judge_error' END AS verdict FROM n""")
def f21(spark, d):
    return spark.createDataFrame(REPLIES, "id long, text string").select("id", A.claim_verdict(F.col("text")).alias("verdict"))


@query("f22_answer_verdicts", REPLY_VALUES + r""", n AS (SELECT *, regexp_extract(text, '"verdict"\s*:\s*"([A-Z_]+)"', 1) AS v, upper(text) AS u FROM r)
SELECT id, CASE WHEN v IN ('CORRECT', 'PARTIALLY_CORRECT', 'INCORRECT') THEN v WHEN contains(u, 'PARTIALLY_CORRECT') THEN 'PARTIALLY_CORRECT' WHEN contains(u, 'INCORRECT') THEN 'INCORRECT' WHEN contains(u, 'CORRECT') THEN 'CORRECT' ELSE 'JUDGE_ERROR' END AS verdict FROM n""")
def f22(spark, d):
    return spark.createDataFrame(REPLIES, "id long, text string").select("id", A.answer_verdict(F.col("text")).alias("verdict"))


@query("f14_user_messages", with_views("", "gold") + """ SELECT g.query_id, 'EXCERPTS:' || chr(10) || chr(10) || string_agg('[' || g.rank || '] (' || d.source || ', FY2026, ' || d.lang || ')' || chr(10) || d.text, chr(10) || chr(10) ORDER BY g.rank) || chr(10) || chr(10) || 'QUESTION: ' || any_value(b.text) AS message
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) AS rank FROM gold) g JOIN documents d ON d.doc_id = g.chunk_id JOIN benchmark b ON b.item_id = g.query_id GROUP BY 1""")
def f14(spark, d):
    """prompts with labelled excerpts; a question has few."""
    from pyspark.sql import Window

    from plumbline.functions.text import label

    hits = W.gold(spark, d).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("chunk_id")))
    docs = W.table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), label(F.col("source"), F.lit(2026), F.col("lang")).alias("label"), F.col("text").alias("content"))
    each = hits.join(docs, "chunk_id").groupBy("query_id").agg(F.collect_list(F.struct("rank", "label", "content")).alias("excerpts"))
    items = W.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return each.join(items, "query_id").select("query_id", A.user_message(F.col("question"), F.col("excerpts")).alias("message"))
