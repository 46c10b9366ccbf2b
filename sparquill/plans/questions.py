"""Analysis of questions about the handbooks, of user turns and of benchmark passages; documents that a question names."""
from __future__ import annotations

from pyspark.sql import Window as W
from sparquill.functions import columns as F

from sparquill.functions import questions as Q
from sparquill.plans import kb
from sparquill.sources import table

#: Unicode word characters for RE2, whose \\w is ASCII.
WORD = r"\pL\pM\pN_"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def has(x: str, pattern: str, any_case: bool = False) -> str:
    return f"regexp_matches({x}, {lit(('(?i)' if any_case else '') + pattern)})"


def any_sql(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(w)})" for w in words) + ")"


def spaced_sql(x: str) -> str:
    return rf"trim(regexp_replace(coalesce({x}, ''), '\s+', ' ', 'g'), ' ')"


def cases(tests: list[str], values: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN {t} THEN {lit(v)}" for t, v in zip(tests, values)) + " END"


def listed(pairs: list[tuple[str, str]]) -> str:
    """The values whose condition holds."""
    return "list_filter([" + ", ".join(f"CASE WHEN {t} THEN {lit(v)} END" for t, v in pairs) + "], lambda x: x IS NOT NULL)"


def attributes_sql(low: str, aliases=Q.ALIASES) -> str:
    return listed([(has(low, Q.guarded(a)), name) for name, a in aliases.items()])


def entity_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, '[^{WORD}]+', ' ', 'g'), ' ')"


_ENT = rf"len(list_distinct(list_transform(regexp_extract_all(q, {lit(Q.ENTITY_TOKEN)}), lambda e: trim(e, ' ')))) >= 2"
_REL = f"({has('q', Q.joined(Q.RELATION), True)} AND NOT ({any_sql('q', Q.WEAK)} AND NOT {any_sql('q', Q.STRONG)}) AND ({has('q', Q.CONNECTOR, True)} OR {_ENT} OR {any_sql('q', Q.SINGLE)} OR contains(low, 'belongs to') OR contains(low, 'part of')))"
_TECH = f"({has('q', Q.joined(Q.TECHNICAL))} OR {has('q', Q.joined(Q.TECHNICAL_ANY_CASE), True)} OR contains(low, 'source locator') OR {has('low', '(?:^|[^a-z0-9_])depends(?:$|[^a-z0-9_])')})"
_TESTS = [has("q", Q.joined(Q.OVERVIEW), True), _REL, "contains(q, '有什么特点')", _TECH, f"({any_sql('q', Q.WEAK)} OR {any_sql('low', ['api', 'config', 'dependency', 'mvcc'])})", "true"]
_EVERY_ID = ", ".join(f"regexp_extract_all(q, {lit(('(?i)' if c else '') + p)}, {g})" for p, g, c in Q.IDENTIFIERS)
IDS_SQL = f"list_filter(list_transform(flatten([{_EVERY_ID}]), lambda x: trim(x, '`''\" ')), lambda x: x <> '')"


_NAMED = "flatten([" + ", ".join(f"CASE WHEN list_contains(attributes, {lit(name)}) THEN [{', '.join(map(lit, a))}] ELSE [] END" for name, a in Q.ALIASES.items()) + "])"
_LEFT = f"list_reduce(list_concat(ids, {_NAMED}), lambda s, x: regexp_replace(s, '(?i)\\Q' || x || '\\E', ' ', 'g'), q)"
_CJK_FILLERS, _WORD_FILLERS = Q.FILLERS.rsplit("|\\b", 1)
_OTHER = f"[^{WORD}]"
#: Fillers between characters that are no word characters; blanks are doubled, so that neighbouring fillers don't share one.
_FILLED = f"regexp_replace(regexp_replace(regexp_replace({_LEFT}, {lit(_CJK_FILLERS)}, ' ', 'g'), '({_OTHER}+)', '\\1\\1', 'g'), {lit(f'(?i)(^|{_OTHER})' + _WORD_FILLERS.removesuffix(chr(92) + 'b') + f'({_OTHER}|$)')}, '\\1 \\2', 'g')"
ANALYSIS_SQL = rf"""a0 AS (SELECT *, {spaced_sql('question')} AS q, lower({spaced_sql('question')}) AS low FROM asked),
ai AS (SELECT *, {IDS_SQL} AS each FROM a0),
a1 AS (SELECT * EXCLUDE (each), list_filter(each, lambda x, i: list_position(each, x) = i) AS ids, {attributes_sql('low')} AS every FROM ai),
a2 AS (SELECT * EXCLUDE (every), list_filter(every, lambda x: NOT (x = 'location' AND list_contains(every, 'configuration') AND {has('low', r'配置(?:在)?哪里|where\s+(?:is\s+\w+\s+)?configur')}) AND NOT (x = 'date' AND len(ids) > 0 AND {has('low', r'调用|执行|运行|阶段|\b(?:call|invoke|execute|run|stage)\b')})) AS attributes FROM a1),
a3 AS (SELECT *, CASE WHEN {has('q', Q.ASKED_OVERVIEW, True)} OR {has('q', Q.ASKED_ALL, True)} THEN 'overview' WHEN {has('q', Q.ASKED_RELATION, True)} THEN 'entity_relation' WHEN len(ids) > 0 THEN 'exact_technical' WHEN len(attributes) > 0 THEN 'entity_attribute'
  WHEN contains(q, '为什么') OR {has('low', r'\bwhy\b')} THEN 'entity_reason' WHEN {any_sql('low', Q.ASKED_DEFINITION)} THEN 'entity_definition' ELSE 'generic_factual' END AS kind FROM a2),
a4 AS (SELECT *, {entity_sql(_FILLED)} AS rest, {entity_sql(f"regexp_extract(q, {lit('(?i)' + Q.PAIR_OF)}, 1)")} AS e1, {entity_sql(f"regexp_extract(q, {lit('(?i)' + Q.PAIR_OF)}, 2)")} AS e2, {entity_sql(f"regexp_extract(q, {lit(Q.REASON_BEFORE)}, 1)")} AS before, {entity_sql(f"regexp_extract(q, {lit(Q.REASON_AFTER)}, 1)")} AS after FROM a3),
analysed AS (SELECT *, CASE WHEN kind = 'entity_relation' AND {has('q', Q.PAIR_OF, True)} THEN list_filter([e1, e2], lambda x: x <> '') WHEN kind = 'entity_reason' AND before <> '' THEN [before] WHEN kind = 'entity_reason' AND after <> '' THEN [after] WHEN rest <> '' THEN [rest] ELSE [] END AS entities FROM a4)"""


def asked(spark, sf_dir):
    """(source, id, turn, question): handbook questions, user turns and benchmark passages."""
    own = kb.questions(spark, sf_dir).select(F.lit("handbook").alias("source"), F.col("question_id").alias("id"), F.col("t").cast("long").alias("turn"), "question")
    turns = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.lit("turn"), "conv_id", "turn", "text")
    passages = table(spark, sf_dir, "benchmark").select(F.lit("benchmark"), "item_id", F.lit(0).cast("long"), "text")
    return own.unionAll(turns).unionAll(passages)


ASKED = f"""{kb.SUPPLIERS}, {kb.QUESTIONS_SQL}, asked AS (SELECT 'handbook' AS source, question_id AS id, t::BIGINT AS turn, question FROM questions UNION ALL SELECT 'turn', conv_id, turn, text FROM conversations WHERE role = 'user' UNION ALL SELECT 'benchmark', item_id, 0, text FROM benchmark)"""


def analysed(rows, question: str = "question"):
    """rows with q, low, ids, attributes, kind and entities of their question."""
    rows = rows.withColumn("q", Q.spaced(F.col(question))).withColumn("low", F.lower("q"))
    rows = rows.withColumn("ids", Q.identifiers(F.col("q")))
    rows = rows.withColumn("attributes", Q.requested(F.col("q"), F.col("ids")))
    rows = rows.withColumn("kind", Q.query_type(F.col("q"), F.col("attributes"), F.col("ids")))
    return rows.withColumn("entities", Q.entities(F.col("q"), F.col("kind"), F.col("attributes"), F.col("ids")))


def query_routing(spark, sf_dir):
    """Retrieval mode, reason, confidence and intent of every question, by ordered rules."""
    return asked(spark, sf_dir).select("source", "id", "turn", Q.route(F.col("question")).alias("r"), Q.intent(F.col("question")).alias("intent")).select("source", "id", "turn", "r.mode", "r.reason", "r.confidence", "intent")


ROUTING = f"WITH {ASKED}, a0 AS (SELECT *, {spaced_sql('question')} AS q, lower({spaced_sql('question')}) AS low FROM asked) SELECT source, id, turn, " + ", ".join(f"{cases(_TESTS, [r[k] for r in Q.ROUTES])} AS {n}" for k, n in enumerate(("mode", "reason", "confidence"))) + f", CASE WHEN {any_sql('low', Q.INTENT)} THEN 'kb_overview' ELSE 'kb_fact_qa' END AS intent FROM a0"


def question_analysis(spark, sf_dir):
    """Type, requested attributes, identifiers, entities and keywords of every question."""
    a = analysed(asked(spark, sf_dir))
    return a.select("source", "id", "turn", "kind", F.array_join("attributes", ",").alias("attributes"), F.array_join(F.array_sort("ids"), ",").alias("identifiers"), F.array_join("entities", "|").alias("entities"), F.array_join(Q.keywords(F.col("q")), " ").alias("keywords"))


_KEYWORDS = rf"list_filter(regexp_extract_all(q, '[A-Za-z_][A-Za-z0-9_]*|[\x{{4e00}}-\x{{9fff}}]{{2,}}'), lambda w: lower(w) NOT IN ({', '.join(map(lit, Q.STOP_KEYWORDS))}))"
ANALYSIS = f"WITH {ASKED}, {ANALYSIS_SQL} SELECT source, id, turn, kind, array_to_string(attributes, ',') AS attributes, array_to_string(list_sort(ids), ',') AS identifiers, array_to_string(entities, '|') AS entities, array_to_string({_KEYWORDS}, ' ') AS keywords FROM analysed"


def question_terms(spark, sf_dir):
    """The expanded keyword terms of every question."""
    t = asked(spark, sf_dir).select("source", "id", "turn", Q.terms(F.col("question")).alias("t"))
    return t.select("source", "id", "turn", F.size("t").alias("n"), F.array_join(F.array_sort("t"), " ").alias("terms"))


def terms_sql(x: str) -> str:
    """The expanded terms of a question, as a sorted list. Words with accents are none; RE2's boundaries don't know them, so they go first."""
    stem = lambda t: f"regexp_replace({t}, '\\.[^.]*$', '')"
    base = r"regexp_extract(t, '([^/\\]*)$', 1)"
    parts = [
        "[t]", r"CASE WHEN regexp_matches(t, '[/\\]') THEN list_filter(regexp_split_to_array(t, '[/\\]'), lambda p: p <> '') ELSE [] END", rf"CASE WHEN regexp_matches(t, '[/\\]') AND {base} <> '' THEN [{base}] ELSE [] END",
        rf"CASE WHEN regexp_matches(t, '[/\\]') AND contains({base}, '.') THEN [{stem(base)}] ELSE [] END", f"CASE WHEN contains(t, '.') THEN [{stem('t')}] ELSE [] END", "CASE WHEN regexp_matches(t, '[-.:_]') THEN list_filter(regexp_split_to_array(t, '[-./:_]'), lambda p: p <> '') ELSE [] END",
        r"CASE WHEN regexp_full_match(t, '[\x{4e00}-\x{9fff}]{1,12}') THEN regexp_extract_all(t, '[\x{4e00}-\x{9fff}]') ELSE [] END",
    ]
    return rf"list_sort(list_distinct(list_filter(list_transform(flatten(list_transform(list_transform(regexp_extract_all(regexp_replace({x}, '[A-Za-z0-9_]*[\x{{c0}}-\x{{24f}}][A-Za-z0-9_\x{{c0}}-\x{{24f}}]*', '', 'g'), {lit(Q.TERM)}), lambda t: lower(t)), lambda t: flatten([{', '.join(parts)}]))), lambda t: trim(t, ' ')), lambda t: t <> '')))"


TERMS = f"WITH {ASKED}, t AS (SELECT source, id, turn, {terms_sql('question')} AS t FROM asked) SELECT source, id, turn, len(t)::INTEGER AS n, array_to_string(t, ' ') AS terms FROM t"


def target_documents(spark, sf_dir):
    """Which handbooks each question names: by their full name, else by most of its words; or that it names one there isn't."""
    a = kb.questions(spark, sf_dir).select("question_id", Q.spaced(F.col("question")).alias("q"), Q.name_text(F.col("question")).alias("nq"))
    d = kb.handbooks(spark, sf_dir).select("doc_id", Q.name_text(F.col("filename")).alias("whole"), Q.name_text(F.regexp_replace("filename", r"(?i)\.(?:md|txt|pdf|docx)\b", "")).alias("stem"))
    a = a.withColumn("wide", Q.found(F.col("q"), Q.KB_WIDE, True) | (F.col("nq") == "")).withColumn("qw", F.array_distinct(Q.meaningful(F.col("nq"))))
    d = d.withColumn("dw", F.array_distinct(Q.meaningful(F.col("stem"))))
    inside = lambda x: F.contains(F.concat(F.lit(" "), F.col("nq"), F.lit(" ")), F.concat(F.lit(" "), F.col(x), F.lit(" ")))
    # Names meet questions on a shared word, so that only what can match is compared.
    met = a.select("question_id", "nq", "qw", F.explode(F.array_distinct(F.split("nq", " "))).alias("w")).join(d.withColumn("w", F.explode(F.array_distinct(F.split("stem", " ")))), "w").dropDuplicates(["question_id", "doc_id"])
    shared = F.size(F.array_intersect("qw", "dw"))
    met = met.withColumn("high", inside("whole") | inside("stem")).withColumn("coverage", F.when(shared >= 2, shared / F.greatest(F.size("dw"), F.lit(1)))).where("high OR coverage >= 0.6")
    # A matched name inside a longer matched one counts only where the question has it beside that one too; then the best coverage.
    longer = met.where("high").groupBy("question_id").agg(F.collect_set("stem").alias("stems"))
    met = met.join(longer, "question_id", "left")
    others = F.filter(F.coalesce("stems", F.array().cast("array<string>")), lambda s: (s != F.col("stem")) & F.contains(F.concat(F.lit(" "), s, F.lit(" ")), F.concat(F.lit(" "), F.col("stem"), F.lit(" "))))
    rest = F.aggregate(others, F.col("nq"), lambda t, s: F.regexp_replace(t, F.concat(F.lit("^(.*?)\\Q"), s, F.lit("\\E")), F.lit("$1 ")))
    beside = F.contains(F.concat(F.lit(" "), F.regexp_replace(rest, " +", " "), F.lit(" ")), F.concat(F.lit(" "), F.col("stem"), F.lit(" ")))
    by = W.partitionBy("question_id")
    met = met.withColumn("any_high", F.bool_or("high").over(by)).withColumn("best", F.max("coverage").over(by))
    kept = met.where((F.col("high") & ((F.size(others) == 0) | beside)) | (~F.col("any_high") & (F.col("coverage") == F.col("best"))))
    targets = kept.groupBy("question_id").agg(F.array_join(F.array_sort(F.collect_set("doc_id")), ",").alias("targets"), F.first("any_high").alias("any_high"))
    rows = a.join(targets, "question_id", "left")
    hit = F.col("targets").isNotNull() & ~F.col("wide")
    missing = ~F.col("wide") & Q.asks_for_document(F.col("q"))
    confidence = F.when(hit & F.col("any_high"), F.lit("high")).when(hit, F.lit("medium")).otherwise(F.lit("none"))
    reason = F.when(hit & F.col("any_high"), F.lit("filename_stem_match")).when(hit, F.lit("filename_token_overlap")).when(missing, F.lit("requested_document_not_found")).otherwise(F.lit("knowledge_base_overview"))
    return rows.select("question_id", F.when(hit, F.col("targets")).otherwise(F.lit("")).alias("targets"), confidence.alias("confidence"), reason.alias("reason"), (hit | missing).alias("requested"))


def _name_sql(x: str) -> str:
    return rf"trim(regexp_replace(lower(regexp_replace({x}, '([a-z0-9])([A-Z][a-z])', '\1 \2', 'g')), '[^a-z0-9\x{{4e00}}-\x{{9fff}}]+', ' ', 'g'), ' ')"


def _words_sql(x: str) -> str:
    return rf"list_distinct(list_filter(regexp_extract_all({x}, '[a-z0-9]+|[\x{{4e00}}-\x{{9fff}}]+'), lambda w: w NOT IN ({', '.join(map(lit, Q.GENERIC))}) AND length(w) > 1))"


TARGETS_SQL = rf"""ta AS (SELECT question_id, {spaced_sql('question')} AS q, {_name_sql('question')} AS nq FROM questions),
tq AS (SELECT *, {has('q', Q.KB_WIDE, True)} OR nq = '' AS wide, {_words_sql('nq')} AS qw FROM ta),
td AS (SELECT doc_id, {_name_sql('filename')} AS whole, {_name_sql("regexp_replace(filename, '(?i)" + chr(92) + ".(md|txt|pdf|docx)$', '')")} AS stem FROM handbooks),
te AS (SELECT *, {_words_sql('stem')} AS dw FROM td),
tm AS (SELECT question_id, doc_id, stem, contains(' ' || nq || ' ', ' ' || whole || ' ') OR contains(' ' || nq || ' ', ' ' || stem || ' ') AS high, CASE WHEN len(list_intersect(qw, dw)) >= 2 THEN len(list_intersect(qw, dw))::DOUBLE / len(dw) END AS coverage FROM tq, te),
tk AS (SELECT *, bool_or(high) OVER (PARTITION BY question_id) AS any_high, max(coverage) OVER (PARTITION BY question_id) AS best FROM tm WHERE high OR coverage >= 0.6),
tt AS (SELECT question_id, array_to_string(list_sort(list(DISTINCT doc_id)), ',') AS targets, any_value(any_high) AS any_high FROM tk WHERE high OR (NOT any_high AND coverage = best) GROUP BY question_id),
ts AS (SELECT tq.*, targets, any_high, targets IS NOT NULL AND NOT wide AS hit, NOT wide AND NOT ({has('q', r'(?:这个|这份|该)文档|' + chr(92) + r'b(?:this|the)\s+document\b', True)} OR {has('q', r'文件(?:类型|格式|扩展名)|\bfile\s+(?:types?|formats?|extensions?)\b', True)}) AND {has('q', r'\.(?:md|txt|pdf|docx)\b|文档|文件|\bdocument\b|\bfile\b|\bguide\b', True)} AS missing FROM tq LEFT JOIN tt USING (question_id)),
targets AS (SELECT question_id, CASE WHEN hit THEN targets ELSE '' END AS targets, CASE WHEN hit AND any_high THEN 'high' WHEN hit THEN 'medium' ELSE 'none' END AS confidence,
  CASE WHEN hit AND any_high THEN 'filename_stem_match' WHEN hit THEN 'filename_token_overlap' WHEN missing THEN 'requested_document_not_found' ELSE 'knowledge_base_overview' END AS reason, hit OR missing AS requested FROM ts)"""
TARGETS = f"WITH {kb.SUPPLIERS}, {kb.QUESTIONS_SQL}, {kb.HANDBOOKS_SQL}, {TARGETS_SQL} SELECT * FROM targets"

QUERIES = {"query_routing": (query_routing, ROUTING), "question_analysis": (question_analysis, ANALYSIS), "question_terms": (question_terms, TERMS), "target_documents": (target_documents, TARGETS)}
