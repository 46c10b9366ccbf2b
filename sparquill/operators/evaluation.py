"""Evaluation of retrieval runs: per case hits, coverage and precision, where and why it failed, and groups of cases."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from sparquill.functions import columns as F

#: Full-width forms and typographic marks, and what compares equal to them.
WIDE = "".join(chr(i) for i in range(0xFF01, 0xFF5F)) + "。"
PLAIN = "".join(chr(i - 0xFEE0) for i in range(0xFF01, 0xFF5F)) + "."
QUOTES = "“”‘’「」『』\"'"


def eval_text(text: Column) -> Column:
    """A text as evaluations compare it: no code, bold or italic marks, plain punctuation, no quotes, single blanks, lower case, no mark at its end."""
    t = F.translate(F.coalesce(text, F.lit("")), WIDE, PLAIN)
    for pattern, to in (("`+([^`]+?)`+", "$1"), (r"\*\*([^*]+?)\*\*", "$1"), (r"(^|[^\w*])\*([^*]+?)\*(?=[^\w*]|$)", "$1$2")):
        t = F.regexp_replace(t, pattern, to)
    t = F.translate(t, QUOTES, "")
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(t, r"\s+", " "))), "[.,;:!?]+$", "")


def mentions(text: Column, phrase: Column) -> Column:
    """Whether an eval_text() holds a phrase; an empty phrase is held by all."""
    return (phrase == "") | ((eval_text(phrase) != "") & F.contains(text, eval_text(phrase)))


def _is(value: str):
    return lambda x: x == value


def measured(cases: DataFrame) -> DataFrame:
    """cases with their metrics, null where a case doesn't ask for one.

    cases: docs, keywords, phrases, forbidden (arrays), cited, answerable, mode (what is expected), ev: array of (pos, doc_id,
    unit_id, locator, text) in order, context, selected_mode, predicted, traced, latency.
    """
    c = F.col
    match = lambda e: F.array_contains("docs", e["doc_id"])
    some = lambda test, units="ev": F.exists(units, test)
    asked = F.size("docs") > 0
    rows = cases.withColumn("ev", F.transform("ev", lambda e: F.struct(e["doc_id"].alias("doc_id"), e["unit_id"].alias("unit_id"), e["locator"].alias("locator"), e["text"].alias("text"), eval_text(e["text"]).alias("plain"))))
    rows = rows.withColumn("plain", eval_text(c("context")))
    hit = F.when(asked, some(match))
    rows = rows.withColumn("retrieval_hit", hit).withColumn("top_1", F.when(asked, some(match, F.slice("ev", 1, 1)))).withColumn("top_3", F.when(asked, some(match, F.slice("ev", 1, 3))))
    rows = rows.withColumn("citation_hit", F.when(c("cited"), some(lambda e: e["unit_id"].isNotNull() & (F.coalesce(e["locator"], F.lit("")) != "") & (~asked | match(e)))))
    found = F.filter("keywords", lambda k: mentions(c("plain"), k))
    rows = rows.withColumn("missing", F.array_except("keywords", found)).withColumn("coverage", F.when(F.size("keywords") == 0, F.lit(1.0)).otherwise(F.size(found) / F.size("keywords")))
    held = lambda e: F.exists("phrases", lambda p: mentions(e["plain"], p))
    literal = lambda e: F.exists("phrases", lambda p: F.contains(F.lower(e["text"]), F.lower(p)))
    bad = lambda e: F.exists("forbidden", lambda p: mentions(e["plain"], p))
    rows = rows.withColumn("expected_hit", F.when(F.size("phrases") > 0, some(lambda e: match(e) & held(e)))).withColumn("literal_hit", F.when(F.size("phrases") > 0, some(lambda e: match(e) & literal(e))))
    rows = rows.withColumn("forbidden_hit", F.when(F.size("forbidden") > 0, some(bad)))
    kinds = F.transform("ev", lambda e: F.when(bad(e) | (asked & ~match(e)), F.lit("irrelevant")).when((F.size("phrases") > 0) & held(e), F.lit("relevant")).otherwise(F.lit("unknown")))
    rows = rows.withColumn("kinds", kinds)
    rows = rows.withColumns({k: F.size(F.filter("kinds", _is(k))) for k in ("relevant", "irrelevant", "unknown")})
    rows = rows.withColumn("precision", F.when(c("relevant") + c("irrelevant") > 0, c("relevant") / (c("relevant") + c("irrelevant"))))
    rows = rows.withColumn("router_ok", F.when(c("mode").isNotNull(), c("mode") == c("selected_mode"))).withColumn("answer_ok", F.when(c("answerable").isNotNull(), c("answerable") == c("predicted")))
    no = lambda x: F.coalesce(~c(x), F.lit(False))
    yes = lambda x: F.coalesce(c(x), F.lit(False))
    why = [
        ("expected_document_not_retrieved", no("retrieval_hit")), ("expected_evidence_not_selected", no("expected_hit")), ("forbidden_evidence_selected", yes("forbidden_hit")), ("router_mode_mismatch", no("router_ok")),
        ("unexpected_no_answer", yes("answerable") & ~c("predicted")), ("unexpected_answerable", no("answerable") & c("predicted")), ("citation_missing", no("citation_hit")), ("trace_missing", ~c("traced")),
    ]
    rows = rows.withColumn("reasons", F.array_compact(F.array(*(F.when(t, F.lit(n)) for n, t in why))))
    stage = (
        F.when(no("answerable"), F.when(c("predicted"), F.lit("support_gate_miss")).otherwise(F.lit("genuine_no_answer"))).when(no("raw_document"), F.lit("retrieval_document_miss")).when(no("raw_evidence"), F.lit("raw_candidate_miss"))
        .when(no("retrieval_hit") | no("expected_hit"), F.lit("evidence_selection_miss")).when(~c("predicted"), F.lit("support_gate_miss")).when(yes("expected_hit") & no("literal_hit"), F.lit("expected_phrase_format_mismatch")).otherwise(F.lit("success"))
    )
    return rows.withColumn("stage", stage)


RATES = ["retrieval_hit", "citation_hit", "top_1", "top_3", "expected_hit", "router_ok", "answer_ok"]


def by_group(results: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Passed, applicable and rate of every metric by group and over all: null results don't apply."""
    rate = lambda m: [F.count_if(m).alias(f"{m}_passed"), F.count(m).alias(f"{m}_n"), F.round(F.avg(F.col(m).cast("int")), 6).alias(f"{m}_rate")]
    aggs = [F.count("*").alias("cases"), F.round(F.avg("coverage"), 6).alias("coverage"), F.round(F.avg("precision"), 6).alias("mean_precision"), *(a for m in RATES for a in rate(m))]
    return results.groupingSets([list(groups), []], *(F.col(g) for g in groups)).agg(*aggs)


def compared(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Deltas of two by_group() results' rates by group."""
    names = [f"{m}_rate" for m in RATES]
    left, right = a.select(F.coalesce(key, F.lit("all")).alias(key), *names), b.select(F.coalesce(key, F.lit("all")).alias(key), *(F.col(n).alias(f"{n}_b") for n in names))
    return left.join(right, key, "full_outer").select(key, *(F.round(F.col(f"{n}_b") - F.col(n), 6).alias(n.replace("_rate", "_delta")) for n in names))


def side_deltas(results: DataFrame, key: str) -> DataFrame:
    """What the rates of side b are above those of side a, by group and over all, from the results of both in one pass."""
    rate = lambda m, s: F.round(F.avg(F.when(F.col("side") == s, F.col(m).cast("int"))), 6)
    rows = results.groupingSets([[key], []], key).agg(*(F.round(rate(m, "b") - rate(m, "a"), 6).alias(f"{m}_delta") for m in RATES))
    return rows.withColumn(key, F.coalesce(key, F.lit("all")))


def report_lines(grouped: DataFrame, key: str) -> DataFrame:
    """(line_no, line): a Markdown table of by_group(), all cases first, then groups by name; n/a for what doesn't apply."""
    show = lambda m: F.when(F.col(f"{m}_n") == 0, F.lit("n/a")).otherwise(F.format_string("%d/%d (%.1f %%)", f"{m}_passed", f"{m}_n", 100 * F.col(f"{m}_rate")))
    row = F.concat_ws(" | ", F.coalesce(key, F.lit("all")), F.col("cases").cast("string"), *(show(m) for m in RATES))
    spark = grouped.sparkSession
    head = spark.createDataFrame([(0, 0, "", "| group | cases | " + " | ".join(RATES) + " |"), (1, 0, "", "|" + "---|" * (len(RATES) + 2))], "part int, place int, name string, line string")
    body = grouped.select(F.lit(2).alias("part"), F.when(F.col(key).isNull(), 0).otherwise(1).alias("place"), F.coalesce(key, F.lit("")).alias("name"), F.concat(F.lit("| "), row, F.lit(" |")).alias("line"))
    return head.unionAll(body)
