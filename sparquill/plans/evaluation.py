"""Evaluation of the handbook questions: what each case expects, its metrics, groups, a report and a comparison."""
from __future__ import annotations

from sparquill.functions import columns as F

from sparquill.functions import questions as Q
from sparquill.operators import evaluation as E
from sparquill.plans import answers, kb
from sparquill.plans import answers_sql as SQL
from sparquill.plans.questions import _TESTS, cases, lit

#: What the case of each question template expects: category, mode, answerable, keywords, phrases.
CASES = [
    ("definition", "chunk_only", True, ["supplier"], ["is a “supplier”"]), ("attribute", "chunk_only", True, ["office", "color"], ["office of"]), ("relation", "graph_vector_mix", True, ["works with"], ["works with customers"]), ("technical", "hybrid_text", True, ["acct_balance"], ["default value of `acct_balance`"]),
    ("technical", "hybrid_text", True, ["open", "held", "closed"], ["supports open, held or closed."]), ("reason", "chunk_only", True, ["because"], ["because short routes"]), ("overview", "overview", True, [], []), ("attribute", "chunk_only", False, ["weight"], ["weight"]),
    ("technical", "hybrid_text", True, ["volumes"], ["removes the volumes"]), ("generic", "chunk_only", None, [], []), ("definition", "chunk_only", True, ["supplier"], ["is a supplier"]), ("overview", "overview", True, [], []),
    ("technical", "hybrid_text", False, ["default"], ["default value of item_status"]), ("technical", "hybrid_text", False, ["acct_number"], ["acct_number"]), ("overview", "overview", False, [], []), ("generic", "chunk_only", True, [], ["is a supplier"]), ("technical", "hybrid_text", None, [], []),
    ("attribute", "graph_vector_mix", True, [], ["隶属"]), ("relation", "graph_vector_mix", True, [], ["can_delete"]), ("generic", "chunk_only", True, ["redis"], ["runs on **Redis**"]),
]
FORBIDDEN = ["Source basis"]
assert len(CASES) == len(kb.QUESTIONS)


def expectations(spark):
    rows = [(t, c, m, a, k, p, FORBIDDEN) for t, (c, m, a, k, p) in enumerate(CASES)]
    return spark.createDataFrame(rows, "t int, category string, mode string, answerable boolean, keywords array<string>, phrases array<string>, forbidden array<string>")


def judged(spark, sf_dir, fallback: bool = False):
    """Every handbook question with what its case expects, its selected evidence and the gate's decision."""
    g = answers.decided(spark, sf_dir, answers.final_units(spark, sf_dir, fallback), ["doc_id", "unit_id", "locator", "text"])
    g = g.select("question_id", F.col("answerable").alias("predicted"), F.col("final").alias("ev")).withColumn("context", F.array_join(F.transform("ev", lambda e: e["text"]), "\n"))
    # Raw candidates are all units of the handbook, so that a phrase is among them if any unit holds it. Each unit meets the few phrases where it is.
    phrases = sorted({p for _, _, _, _, ps in CASES for p in ps})
    text = kb.units(spark, sf_dir).select("doc_id", E.eval_text(F.col("unit")).alias("plain"))
    raw = text.groupBy("doc_id").agg(F.array_compact(F.array(*(F.when(F.bool_or(E.mentions(F.col("plain"), F.lit(p))), F.lit(p)) for p in phrases))).alias("raw"))
    q = kb.questions(spark, sf_dir).withColumn("selected_mode", Q.route(F.col("question"))["mode"])
    rows = q.join(F.broadcast(expectations(spark)), "t").join(g, "question_id").join(raw, "doc_id", "left")
    rows = rows.withColumn("docs", F.array("doc_id")).withColumn("cited", F.col("answerable").isNull() | F.col("answerable"))
    return rows.withColumn("raw_document", F.col("raw").isNotNull()).withColumn("raw_evidence", F.when(F.size("phrases") > 0, F.arrays_overlap("raw", "phrases"))).withColumn("traced", F.lit(True))


def results(spark, sf_dir, fallback: bool = False):
    """Every handbook question's metrics over its selected evidence; fallback: see final_units()."""
    return E.measured(judged(spark, sf_dir, fallback))


FLAGS = ["retrieval_hit", "citation_hit", "top_1", "top_3", "expected_hit", "literal_hit", "forbidden_hit", "router_ok", "answer_ok"]


def evaluation_cases(spark, sf_dir):
    r = results(spark, sf_dir)
    return r.select("question_id", "category", *FLAGS, F.round("coverage", 6).alias("coverage"), F.array_join("missing", ",").alias("missing"), "relevant", "irrelevant", "unknown", F.round("precision", 6).alias("precision"), F.array_join("reasons", ",").alias("reasons"), "stage")


def evaluation_groups(spark, sf_dir):
    """Metrics by category and over all cases; questions for which nothing was selected have their fallback."""
    return E.by_group(results(spark, sf_dir, fallback=True), ["category"]).withColumn("category", F.coalesce("category", F.lit("all")))


def evaluation_report(spark, sf_dir):
    """The evaluation as lines of Markdown, numbered in their order."""
    from pyspark.sql import Window

    lines = E.report_lines(E.by_group(results(spark, sf_dir), ["category"]), "category")
    return lines.select((F.row_number().over(Window.orderBy("part", "place", "name")) - 1).alias("line_no"), "line")


def evaluation_delta(spark, sf_dir):
    """What limiting each question's evidence to its first unit changes, by category."""
    first = F.transform(F.slice("ev", 1, 1), lambda e: F.struct(F.lit(1).alias("pos"), *(e[c].alias(c) for c in ("doc_id", "unit_id", "locator", "text"))))
    sides = F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("ev")), F.struct(F.lit("b").alias("side"), first.alias("ev")))).alias("s")
    rows = judged(spark, sf_dir)
    return E.side_deltas(E.measured(rows.select(*(c for c in rows.columns if c != "ev"), sides).select("*", "s.side", "s.ev").drop("s")), "category")


def _plain(x: str) -> str:
    t = f"translate(coalesce({x}, ''), {lit(E.WIDE)}, {lit(E.PLAIN)})"
    t = rf"regexp_replace(regexp_replace(regexp_replace({t}, '`+([^`]+?)`+', '\1', 'g'), '\*\*([^*]+?)\*\*', '\1', 'g'), '(^|[^\w*])\*([^*]+?)\*([^\w*]|$)', '\1\2\3', 'g')"
    for c in E.QUOTES:
        t = f"replace({t}, {lit(c)}, '')"
    return rf"regexp_replace(lower(trim(regexp_replace({t}, '\s+', ' ', 'g'), ' ')), '[.,;:!?]+$', '')"


def _holds(text: str, phrase: str) -> str:
    return f"({phrase} = '' OR ({_plain(phrase)} <> '' AND contains({text}, {_plain(phrase)})))"


def _any(xs: str, test: str, var: str) -> str:
    return f"len(list_filter({xs}, lambda {var}: {test})) > 0"


_EXPECT = ", ".join(f"({t}, {lit(c)}, {lit(m)}, {'NULL' if a is None else a}::BOOLEAN, {SQL.strings(k)}, {SQL.strings(p)})" for t, (c, m, a, k, p) in enumerate(CASES))
_MODE = cases(_TESTS, [r[0] for r in Q.ROUTES])
_MATCH = "e.doc_id = doc_id"
_RES = f"""{SQL._HEAD}, {SQL.SELECTED}, {SQL.NEEDS}, {SQL._FINAL}, {SQL.GATE},
xe AS (SELECT * FROM (VALUES {_EXPECT}) v(t, category, mode, answerable, keywords, phrases)), ev AS (SELECT question_id, list({{'unit_id': unit_id, 'locator': locator, 'text': text, 'plain': {_plain('text')}, 'pos': pos}} ORDER BY pos) AS ev, string_agg(text, chr(10) ORDER BY pos) AS context FROM evidence GROUP BY question_id),
rw AS (SELECT doc_id, list(DISTINCT {_plain('unit')}) AS raw FROM units GROUP BY doc_id), md AS (SELECT question_id, {_MODE} AS selected_mode FROM a0),
r0 AS (SELECT q.question_id, q.doc_id, x.*, selected_mode, g.answerable AS predicted, coalesce(ev.ev, []) AS ev, {_plain("coalesce(ev.context, '')")} AS plain, raw FROM questions q JOIN xe x USING (t) JOIN gated g USING (question_id) JOIN md USING (question_id) JOIN rw ON rw.doc_id = q.doc_id LEFT JOIN ev ON ev.question_id = q.question_id),
r1 AS (SELECT *, len(ev) > 0 AS retrieval_hit, len(ev) > 0 AS top_1, len(ev) > 0 AS top_3, CASE WHEN coalesce(answerable, true) THEN len(ev) > 0 END AS citation_hit, list_filter(keywords, lambda k: NOT {_holds('plain', 'k')}) AS missing,
  CASE WHEN len(phrases) > 0 THEN {_any('ev', _any('phrases', _holds('e.plain', 'p'), 'p'), 'e')} END AS expected_hit, CASE WHEN len(phrases) > 0 THEN {_any('ev', _any('phrases', 'contains(lower(e.text), lower(p))', 'p'), 'e')} END AS literal_hit, {_any('ev', _holds('e.plain', lit(FORBIDDEN[0])), 'e')} AS forbidden_hit,
  list_transform(ev, lambda e: CASE WHEN {_holds('e.plain', lit(FORBIDDEN[0]))} THEN 'irrelevant' WHEN len(phrases) > 0 AND {_any('phrases', _holds('e.plain', 'p'), 'p')} THEN 'relevant' ELSE 'unknown' END) AS kinds, CASE WHEN len(phrases) > 0 THEN {_any('raw', _any('phrases', _holds('x', 'p'), 'p'), 'x')} END AS raw_evidence FROM r0),
r2 AS (SELECT *, CASE WHEN len(keywords) = 0 THEN 1.0::DOUBLE ELSE (len(keywords) - len(missing))::DOUBLE / len(keywords) END AS coverage, len(list_filter(kinds, lambda k: k = 'relevant'))::INTEGER AS relevant, len(list_filter(kinds, lambda k: k = 'irrelevant'))::INTEGER AS irrelevant, len(list_filter(kinds, lambda k: k = 'unknown'))::INTEGER AS unknown,
  mode = selected_mode AS router_ok, CASE WHEN answerable IS NOT NULL THEN answerable = predicted END AS answer_ok FROM r1),
res AS (SELECT *, CASE WHEN relevant + irrelevant > 0 THEN relevant::DOUBLE / (relevant + irrelevant) END AS precision, list_filter([CASE WHEN NOT retrieval_hit THEN 'expected_document_not_retrieved' END, CASE WHEN NOT expected_hit THEN 'expected_evidence_not_selected' END, CASE WHEN forbidden_hit THEN 'forbidden_evidence_selected' END, CASE WHEN NOT router_ok THEN 'router_mode_mismatch' END,
  CASE WHEN answerable AND NOT predicted THEN 'unexpected_no_answer' END, CASE WHEN NOT answerable AND predicted THEN 'unexpected_answerable' END, CASE WHEN NOT citation_hit THEN 'citation_missing' END], lambda x: x IS NOT NULL) AS reasons,
  CASE WHEN NOT coalesce(answerable, true) THEN CASE WHEN predicted THEN 'support_gate_miss' ELSE 'genuine_no_answer' END WHEN NOT coalesce(raw_evidence, true) THEN 'raw_candidate_miss' WHEN NOT retrieval_hit OR NOT coalesce(expected_hit, true) THEN 'evidence_selection_miss' WHEN NOT predicted THEN 'support_gate_miss' WHEN coalesce(expected_hit, false) AND NOT coalesce(literal_hit, true) THEN 'expected_phrase_format_mismatch' ELSE 'success' END AS stage FROM r2)"""
CASES_SQL = f"WITH {_RES.removeprefix('WITH ')} SELECT question_id, category, {', '.join(FLAGS)}, round(coverage, 6) AS coverage, array_to_string(missing, ',') AS missing, relevant, irrelevant, unknown, round(precision, 6) AS precision, array_to_string(reasons, ',') AS reasons, stage FROM res"
_RATES = ", ".join(f"count(*) FILTER ({m}) AS {m}_passed, count({m}) AS {m}_n, round(avg({m}::INT), 6) AS {m}_rate" for m in E.RATES)
_GROUPS = f"SELECT category AS g, count(*) AS cases, round(avg(coverage), 6) AS coverage, round(avg(precision), 6) AS mean_precision, {_RATES} FROM res GROUP BY GROUPING SETS ((category), ())"
GROUPS_SQL = f"WITH RECURSIVE {_RES.removeprefix('WITH ').replace(SQL._FINAL, SQL.FINAL)}, gr AS ({_GROUPS}) SELECT coalesce(g, 'all') AS category, * EXCLUDE (g) FROM gr"
_SHOW = " || ' | ' || ".join(f"CASE WHEN {m}_n = 0 THEN 'n/a' ELSE printf('%d/%d (%.1f %%)', {m}_passed, {m}_n, 100 * {m}_rate) END" for m in E.RATES)
REPORT_SQL = f"""WITH {_RES.removeprefix('WITH ')}, gr AS ({_GROUPS}), li AS (SELECT 0 AS part, 0 AS place, '' AS name, '| group | cases | {' | '.join(E.RATES)} |' AS line UNION ALL SELECT 1, 0, '', '|{'---|' * (len(E.RATES) + 2)}' UNION ALL SELECT 2, CASE WHEN g IS NULL THEN 0 ELSE 1 END, coalesce(g, ''), '| ' || coalesce(g, 'all') || ' | ' || cases || ' | ' || {_SHOW} || ' |' FROM gr)
SELECT (row_number() OVER (ORDER BY part, place, name) - 1)::INTEGER AS line_no, line FROM li"""
_FIRST = _RES.replace("ev AS (SELECT question_id, list({", "ev AS (SELECT question_id, list({", 1)
_FIRST = _FIRST.replace("FROM evidence GROUP BY question_id),\nrw", "FROM evidence WHERE pos = 1 GROUP BY question_id),\nrw", 1)
DELTA_SQL = f"""WITH ga AS (WITH {_RES.removeprefix('WITH ')} {_GROUPS}), gb AS (WITH {_FIRST.removeprefix('WITH ')} {_GROUPS})
SELECT coalesce(ga.g, 'all') AS category, {', '.join(f'round(gb.{m}_rate - ga.{m}_rate, 6) AS {m}_delta' for m in E.RATES)} FROM ga JOIN gb ON ga.g IS NOT DISTINCT FROM gb.g"""

QUERIES = {"evaluation_cases": (evaluation_cases, CASES_SQL), "evaluation_groups": (evaluation_groups, GROUPS_SQL), "evaluation_report": (evaluation_report, REPORT_SQL), "evaluation_delta": (evaluation_delta, DELTA_SQL)}
