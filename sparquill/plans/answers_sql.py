"""DuckDB SQL of the evidence plans: profiles, unit scores, selection, support gate and policy as common table expressions."""
from __future__ import annotations

from functools import reduce

from sparquill.functions import questions as Q
from sparquill.operators import support as S
from sparquill.operators import units as U
from sparquill.plans import kb
from sparquill.plans.questions import ANALYSIS_SQL, any_sql, attributes_sql, entity_sql, has, lit, spaced_sql

CJK = r"[\x{4e00}-\x{9fff}]"
STRICT = "(?:[A-Z][A-Z0-9]+(?:_[A-Z0-9]+)+|[a-z][a-z0-9]+_[a-z0-9_]+)"


def strings(words) -> str:
    return "[" + ", ".join(map(lit, words)) + "]" if words else "[]::VARCHAR[]"


def one(x: str) -> str:
    return f"CASE WHEN {x} <> '' THEN [{x}] ELSE [] END"


def filled(*lists: str) -> str:
    return "CASE " + " ".join(f"WHEN len({x}) > 0 THEN {x}" for x in lists[:-1]) + f" ELSE {lists[-1]} END"


def choose(tests: list[str], values: list[str], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {t} THEN {v}" for t, v in zip(tests, values)) + f" ELSE {other} END"


def pair(pattern: str) -> str:
    side = lambda g: entity_sql(f"regexp_replace(regexp_extract(q, {lit('(?i)' + pattern)}, {g}), {lit('(?i)' + S.TAIL)}, '', 'g')")
    return f"list_filter([{side(1)}, {side(2)}], lambda x: x <> '')"


def compact(x: str) -> str:
    return rf"regexp_replace(lower({x}), '[^\pL\pM\pN]+', '', 'g')"


def parts(x: str) -> str:
    t = rf"regexp_replace(regexp_replace(regexp_replace({x}, '[`''\"]', ' ', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[_-]+', ' ', 'g')"
    return f"list_transform(regexp_extract_all({t}, '[A-Za-z0-9]+'), lambda w: CASE WHEN length(w) > 4 AND ends_with(lower(w), 'ies') THEN lower(w)[1:length(w) - 3] || 'y' WHEN length(w) > 4 AND ends_with(lower(w), 's') AND NOT ends_with(lower(w), 'ss') THEN lower(w)[1:length(w) - 1] ELSE lower(w) END)"


def words(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[a-z_][a-z0-9_]*|{CJK}+')"


def prepared(x: str) -> str:
    ids = ", ".join(f"regexp_extract_all({x}, {lit(p)})" for p, _, _ in S.EXACT[:2])
    return f"{{'text': {x}, 'low': lower({x}), 'compact': {compact(x)}, 'parts': {parts(x)}, 'words': {words(x)}, 'ids': list_transform(flatten([{ids}]), lambda i: lower(i))}}"


def all_of(xs: str, test: str, var: str) -> str:
    return f"len(list_filter({xs}, lambda {var}: NOT ({test}))) = 0"


def any_in(xs: str, test: str, var: str) -> str:
    return f"len(list_filter({xs}, lambda {var}: {test})) > 0"


def inside(some: str, of: str) -> str:
    """Every element of one list is in the other."""
    return f"list_has_all({of}, {some})"


def term(t: str, c: str) -> str:
    known = "CASE " + " ".join(f"WHEN w = {lit(k)} THEN list_has_any({c}.words, {strings(v)})" for k, v in S.TOKEN_ALIASES.items()) + f" ELSE list_contains({c}.words, w) END"
    return f"(({compact(t)} <> '' AND contains({c}.compact, {compact(t)})) OR (len({parts(t)}) > 0 AND {inside(parts(t), c + '.parts')}) OR {all_of(words(t), known, 'w')})"


def bare(i: str) -> str:
    return f"trim({i}, '`''\" ')"


def near(i: str, c: str) -> str:
    return f"list_filter({c}.ids, lambda x: list_has_any(string_split(x, '_'), string_split(lower({bare(i)}), '_')))"


def identifier(i: str, c: str) -> str:
    loose = f"(contains({c}.compact, {compact(i)}) OR (len({parts(i)}) > 0 AND {inside(parts(i), c + '.parts')}))"
    return f"CASE WHEN regexp_full_match({bare(i)}, '{STRICT}') AND len({near(i, c)}) > 0 THEN list_contains({near(i, c)}, lower({bare(i)})) ELSE {loose} END"


def unit_identifier(i: str, c: str) -> str:
    loose = f"({inside(parts(i), c + '.parts')} OR contains(array_to_string({c}.parts, ''), array_to_string({parts(i)}, '')))"
    return f"CASE WHEN regexp_full_match({bare(i)}, '{STRICT}') AND len({near(i, c)}) > 0 THEN list_contains({near(i, c)}, lower({bare(i)})) ELSE {loose} END"


def values(c: str) -> str:
    return f"({any_sql(c + '.low', S.SUPPORTED_WORDS)} OR {has(c + '.low', Q.joined(S.SUPPORTED_LISTS))})"


def attribute(a: str, c: str) -> str:
    named = "CASE " + " ".join(f"WHEN {a} = {lit(n)} THEN {has(c + '.low', Q.guarded(v))}" for n, v in S.EVERY_ALIAS.items()) + f" ELSE contains({c}.low, {a}) END"
    return f"({named} OR ({a} = 'supported_values' AND {values(c)}))"


_P_TESTS = ["len(pr) > 0", "len(attributes) > 0", any_sql("low", S.PROFILE_ATTRIBUTE), any_sql("low", ["为什么", "受欢迎"]), any_sql("low", ["是谁", "是什么", "是啥", "介绍", "定义"])]
_CLEANED = reduce(lambda t, w: f"replace({t}, {lit(w)}, ' ')", S.PROFILE_CLEAN, "q")
_ASKED = "list_distinct(flatten([" + ", ".join(f"CASE WHEN list_contains(attributes, {lit(n)}) THEN {strings([a.lower() for a in v])} ELSE [] END" for n, v in Q.ALIASES.items()) + "]))"
_WIDE = r"list_distinct(list_filter(list_transform(list_concat(entities, flatten(list_transform(entities, lambda x: regexp_extract_all(x, '\b[A-Z][A-Za-z0-9_-]*(?:\s+[A-Za-z][A-Za-z0-9_-]*)*')))), lambda x: trim(x, ' ')), lambda x: x <> ''))"
_W = {k: strings(v) for k, v in S.INTENTS.items()}
BASE = f"{kb.SUPPLIERS}, {kb.UNITS_SQL}, {kb.QUESTIONS_SQL}, {kb.HANDBOOKS_SQL}, asked AS (SELECT * FROM questions), {ANALYSIS_SQL}"
PROFILE = f"""p0 AS (SELECT question_id, doc_id, t, q, low, ids, attributes, kind, entities, CASE WHEN {has('q', S.PROFILE_PAIRS)} THEN {pair(S.PROFILE_PAIRS)} ELSE [] END AS pr, {one(entity_sql(_CLEANED))} AS cleaned, {_WIDE} AS wide FROM analysed),
profiled AS (SELECT * EXCLUDE (pr, cleaned, wide), {choose(_P_TESTS, [lit(k) for k in ("entity_relation", "entity_attribute", "entity_attribute", "entity_reason", "entity_definition")], lit("generic_factual"))} AS p_type,
  {choose(_P_TESTS, ["pr", "entities", "cleaned", "wide", "wide"], "[]")} AS p_entities, {choose(_P_TESTS, [_W["entity_relation"], _ASKED, _W["entity_attribute"], _W["entity_reason"], _W["entity_definition"]], "[]")} AS p_intents FROM p0)"""


def features(x: str) -> str:
    low = f"lower({spaced_sql(x)})"
    cjk = f"array_to_string(regexp_extract_all({low}, '{CJK}'), '')"
    return f"list_distinct(list_concat(regexp_extract_all({low}, '[a-z0-9]+'), list_transform(range(1, length({cjk})), lambda i: substr({cjk}, i, 2))))"


_SYN = ", ".join(f"CASE WHEN contains(low, {lit(p)}) THEN {strings(list(dict.fromkeys([p, *(s[i : i + 2] for s in ss for i in range(len(s) - 1))])))} ELSE [] END" for p, ss in U.SYNONYMS.items())
_OWN_IDS = ", ".join(f"regexp_extract_all(q, {lit(p)}, 1)" for p in U.TECHNICAL)
ASKING = f"""asking AS (SELECT * EXCLUDE (p_type, p_entities, p_intents), list_distinct(flatten([{features('q')}, {_SYN}])) AS q_features, CASE WHEN len(ids) > 0 THEN ids ELSE list_distinct(flatten([{_OWN_IDS}])) END AS t_ids,
  CASE WHEN {any_sql('low', ['默认值', 'default value', 'default'])} THEN 'default_value' WHEN {any_sql('low', ['支持哪些值', '哪些值', 'supported values', 'valid values'])} THEN 'supported_values' END AS t_intent,
  CASE WHEN kind = 'exact_technical' THEN 'generic_factual' ELSE p_type END AS p_type, CASE WHEN kind = 'exact_technical' THEN [] ELSE p_entities END AS p_entities, CASE WHEN kind = 'exact_technical' THEN [] ELSE p_intents END AS p_intents FROM profiled)"""


def relevance(x: str) -> str:
    return f"CASE WHEN len(q_features) > 0 THEN len(list_intersect({features(x)}, q_features))::DOUBLE / len(q_features) ELSE 0 END"


def share(low: str) -> str:
    return f"CASE WHEN len(p_intents) > 0 THEN len(list_filter(p_intents, lambda t: contains({low}, lower(t))))::DOUBLE / len(p_intents) ELSE 0 END"


def names(low: str) -> str:
    hits = f"len(list_filter(p_entities, lambda t: contains({low}, lower(t))))"
    return f"(len(p_entities) > 0 AND CASE WHEN p_type = 'entity_relation' THEN {hits} >= least(2, len(p_entities)) OR ({hits} > 0 AND {share(low)} > 0) ELSE {hits} > 0 END)"


def heading(x: str) -> str:
    low = f"lower(trim({x}, ' '))"
    return rf"({low} NOT IN ({', '.join(map(lit, U.PLAIN_HEADINGS))}) AND NOT {has(low, U.GENERAL_HEADING)} AND (len(regexp_extract_all({x}, '\b[A-Z][A-Za-z0-9_-]*\b')) >= 2 OR regexp_full_match({x}, '{CJK}{{2,8}}')))"


_ALIGNED = f"CASE WHEN t_intent = 'default_value' THEN CASE WHEN {any_sql('lower(unit)', ['default', '默认'])} AND {has('lower(unit)', S.LITERAL)} THEN 1.0 ELSE 0.0 END WHEN t_intent = 'supported_values' THEN CASE WHEN {any_sql('lower(unit)', U.VALUE_WORDS)} THEN 1.0 ELSE 0.0 END ELSE 0.5 END"
_SECTION = r"regexp_extract(before, '(?s)^(?:.*\n)?((?:#{1,6}\s+[^\n]+|[一二三四五六七八九十]+[、.．]\s*[^\n]+)\n.*)$', 1)"
#: Units are whole lines of their chunk here, so that a unit is always found as it stands.
SCORED = f"""ch AS (SELECT doc_id, chunk_id, string_agg(unit, chr(10) ORDER BY i) AS chunk FROM units GROUP BY ALL),
s0 AS (SELECT a.*, u.chunk_id, u.unit_id, u.section, u.path, u.unit, u.score, c.chunk, concat_ws(' ', u.unit, u.section, array_to_string(u.path, ' ')) AS ctx, lower({spaced_sql('u.unit')}) AS unit_low, lower({spaced_sql("concat_ws(' ', u.section, array_to_string(u.path, ' '))")}) AS heads_low, substr(c.chunk, 1, instr(c.chunk, u.unit) - 1) AS before
  FROM asking a JOIN units u USING (doc_id) JOIN ch c USING (doc_id, chunk_id)),
s1 AS (SELECT *, lower({spaced_sql('ctx')}) AS ctx_low, {prepared('ctx')} AS c, greatest({relevance('unit')}, 0.85::DOUBLE * {relevance('ctx')}) AS lexical, lower({spaced_sql(f"CASE WHEN {_SECTION} <> '' THEN {_SECTION} ELSE before END")}) AS local FROM s0),
s2 AS (SELECT *, CASE WHEN p_type = 'entity_relation' THEN ctx_low ELSE unit_low END AS judged, {attributes_sql('lower(ctx)')} AS named, CASE WHEN length(local) > 400 THEN rtrim(substr(local, 1, 397)) || '...' ELSE local END AS anchor FROM s1),
s3 AS (SELECT *, {names('judged')} AS entity, {share('judged')} AS intent, len(ids) > 0 AND {all_of('ids', unit_identifier('i', 'c'), 'i')} AS identifier, CASE WHEN len(t_ids) > 0 AND {all_of('t_ids', unit_identifier('i', 'c'), 'i')} THEN {_ALIGNED} ELSE 0.0 END::DOUBLE AS technical,
  list_filter(attributes, lambda a: list_contains(named, a) OR (a = 'supported_values' AND {has('lower(ctx)', U.SUPPORTED)})) AS matched, {has('unit_low', U.BOILERPLATE)} AS boilerplate, coalesce(nullif(section, ''), path[-1], '') AS head FROM s2),
s4 AS (SELECT *, CASE WHEN len(attributes) > 0 THEN len(matched)::DOUBLE / len(attributes) ELSE 0 END AS alignment, CASE WHEN len(attributes) > 0 THEN least(1.0::DOUBLE, len(list_filter(named, lambda a: a IN ({', '.join(map(lit, U.OTHER_ATTRIBUTES))}) AND NOT list_contains(attributes, a)))::DOUBLE / 2) ELSE 0 END AS penalty,
  p_type IN ('entity_definition', 'entity_attribute', 'entity_reason') AND len(p_entities) > 0 AND NOT {names('unit_low')} AND intent > 0 AND lexical >= {U.CONTEXT_LEXICAL} AND ({names('heads_low')} OR {names('anchor')}) AS context,
  kind = 'entity_attribute' AND len(p_entities) > 0 AND head <> '' AND {heading('head')} AND NOT {names('lower(head)')} AND NOT {names('unit_low')} AS collision FROM s3),
s5 AS (SELECT *, CASE WHEN kind = 'entity_attribute' THEN alignment > 0 WHEN kind = 'exact_technical' THEN identifier AND technical > 0 WHEN kind = 'entity_definition' THEN {has('lower(unit)', U.DEFINES)} WHEN kind = 'entity_reason' THEN {has('lower(unit)', U.REASONS)} WHEN kind = 'overview' THEN NOT boilerplate ELSE false END AS direct FROM s4),
s6 AS (SELECT *, CASE WHEN p_type <> 'generic_factual' THEN 0.5::DOUBLE * score + 0.25::DOUBLE * lexical + CASE WHEN entity OR context THEN 0.15::DOUBLE ELSE 0 END + 0.1::DOUBLE * intent ELSE 0.6::DOUBLE * score + 0.4::DOUBLE * lexical + 0.1::DOUBLE * technical END
  + 0.3::DOUBLE * alignment + CASE WHEN identifier THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN direct THEN 0.25::DOUBLE ELSE 0 END - 0.35::DOUBLE * penalty - CASE WHEN collision THEN 0.8::DOUBLE ELSE 0 END - CASE WHEN boilerplate THEN 0.45::DOUBLE ELSE 0 END AS raw FROM s5),
s7 AS (SELECT *, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, raw)), 6) AS unit_score, p_type = 'entity_reason' AND direct AND lexical >= 0.05 AS reasoned, entity OR context AS supported FROM s6),
scored AS (SELECT *, CASE WHEN kind IN ('entity_attribute', 'entity_definition', 'entity_reason', 'exact_technical', 'overview') AND boilerplate THEN 'boilerplate' WHEN collision THEN 'cross_entity_binding' WHEN len(attributes) > 0 AND alignment <= 0 THEN 'missing_requested_attribute' WHEN len(ids) > 0 AND NOT identifier THEN 'missing_technical_identifier'
  WHEN p_type <> 'generic_factual' AND ((p_type = 'entity_relation' AND intent <= 0) OR (p_type IN ('entity_attribute', 'entity_reason') AND intent <= 0 AND NOT (p_type = 'entity_attribute' AND alignment > 0 AND direct) AND NOT reasoned) OR (lexical <= 0 AND intent <= 0)) THEN 'entity_gate' END AS rejection FROM s7)"""
SELECTED = f"""k0 AS (SELECT *, row_number() OVER (PARTITION BY question_id, doc_id, chunk_id ORDER BY unit_score DESC, unit_id) AS n FROM scored WHERE rejection IS NULL),
k1 AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY unit_score DESC, doc_id, chunk_id, unit_id) AS r FROM k0 WHERE n <= CASE WHEN p_type IN ('entity_definition', 'entity_attribute', 'entity_reason') THEN greatest(1, len(attributes)) ELSE {U.PER_CHUNK} END),
k2 AS (SELECT *, min(CASE WHEN supported OR reasoned THEN r END) OVER (PARTITION BY question_id) AS top FROM k1),
k3 AS (SELECT k2.*, x.unit_score AS top_score, x.doc_id AS top_doc, x.chunk_id AS top_chunk FROM k2 LEFT JOIN k1 x ON x.question_id = k2.question_id AND x.r = k2.top),
k4 AS (SELECT *, CASE WHEN context AND NOT entity THEN {U.CONTEXT_LEXICAL} ELSE {U.SAME_CHUNK_LEXICAL} END AS least_same, CASE WHEN context AND NOT entity THEN {U.CONTEXT_LEXICAL} ELSE {U.FOLLOWUP_LEXICAL} END AS least_other, unit_score >= {U.RELATIVE}::DOUBLE * top_score AS near_top FROM k3),
k5 AS (SELECT *, CASE WHEN p_type = 'entity_relation' THEN supported AND (intent > 0 OR lexical >= {U.FOLLOWUP_LEXICAL}) AND near_top WHEN reasoned THEN near_top WHEN doc_id = top_doc AND chunk_id = top_chunk THEN supported AND intent > 0 AND lexical >= least_same ELSE supported AND lexical >= least_other AND (intent > 0 OR lexical >= {U.STRONG_LEXICAL}) AND near_top END AS follows FROM k4),
k6 AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY CASE WHEN p_type <> 'generic_factual' AND r = top THEN 0 ELSE 1 END, r) AS pos FROM k5 WHERE p_type = 'generic_factual' OR (top IS NOT NULL AND (r = top OR follows))),
k7 AS (SELECT *, flatten(list(matched) OVER (PARTITION BY question_id)) AS have FROM k6 WHERE pos <= CASE WHEN p_type IN ('generic_factual', 'entity_relation') THEN {U.MAX_UNITS} ELSE {U.ENTITY_UNITS} END),
picked AS (SELECT * FROM k7 WHERE kind <> 'entity_attribute' OR list_has_all(have, attributes))"""

_FLAGS = "entity, context, identifier, collision, boilerplate, direct"
_HEAD = f"WITH {BASE}, {PROFILE}, {ASKING}, {SCORED}"
CANDIDATES = f"{_HEAD} SELECT question_id, unit_id, {_FLAGS}, {', '.join(f'round({n}::DOUBLE, 6) AS {n}' for n in ('lexical', 'intent', 'technical', 'alignment', 'penalty'))}, array_to_string(matched, ',') AS matched, unit_score, rejection FROM scored"
SELECTION = f"{_HEAD}, {SELECTED} SELECT question_id, pos::INTEGER AS pos, 'S' || pos AS marker, doc_id, chunk_id, unit_id, unit_score, array_to_string(matched, ',') AS matched FROM picked"
_COUNTS = ", ".join(f"count(*) FILTER (rejection = '{r}') AS {r}" for r in ("boilerplate", "cross_entity_binding", "missing_requested_attribute", "missing_technical_identifier", "entity_gate"))
DIAGNOSTICS = f"{_HEAD}, {SELECTED}, hits AS (SELECT question_id, unit_id, 1 AS hit FROM picked) SELECT question_id, count(*) AS candidates, count(hit) AS selected, {_COUNTS}, count(*) FILTER (rejection IS NULL AND hit IS NULL) AS lower_rank FROM scored LEFT JOIN hits USING (question_id, unit_id) GROUP BY question_id"

# The gate.
_EXACT = ", ".join(f"regexp_extract_all(q, {lit(('(?i)' if c else '') + p)}, {g})" for p, g, c in S.EXACT)
_BY_ATTRIBUTE = one(entity_sql(f"regexp_replace(list_reduce({strings(S.ATTRIBUTE_WORDS)}, lambda s, x: regexp_replace(s, '(?i)\\Q' || x || '\\E', ' ', 'g'), q), '[?？。,.，]', ' ', 'g')"))
_BY_REASON = one(entity_sql(f"regexp_replace(q, {lit('(?i)' + S.REASON_WORDS)}, ' ', 'g')"))
_BY_DEFINITION = one(entity_sql(f"regexp_replace(q, {lit('(?i)' + S.DEFINITION_WORDS)}, ' ', 'g')"))
_S_TESTS = [f"({any_sql('low', Q.INTENT)} OR {any_sql('low', S.OVERVIEW)})", "(len(pr) > 0 OR p_type = 'entity_relation')", "len(x_ids) > 0", "len(x_attributes) > 0", any_sql("low", ["为什么", "why ", "主要目的", "目的"]), "p_type IN ('entity_definition', 'entity_attribute', 'entity_reason')", any_sql("low", ["是谁", "是什么", "what is", "介绍", "定义"])]
_KINDS = [lit("overview"), lit("entity_relation"), lit("exact_technical"), lit("entity_attribute"), lit("entity_reason"), "p_type", lit("entity_definition")]
_BY_PROFILE = "CASE WHEN p_type = 'entity_attribute' THEN by_attribute WHEN p_type = 'entity_reason' THEN by_reason ELSE by_definition END"
_WHO = ["[]", filled("pr", "p_entities"), "p_entities", filled("entities", "by_attribute", "p_entities"), filled("by_reason", "p_entities"), filled(f"({_BY_PROFILE})", "p_entities"), filled("p_entities", "by_definition")]
_KEYWORDS = rf"list_filter(regexp_extract_all(q, '[A-Za-z_][A-Za-z0-9_]*|{CJK}{{2,}}'), lambda w: lower(w) NOT IN ({', '.join(map(lit, Q.STOP_KEYWORDS))}))"
NEEDS = f"""n0 AS (SELECT *, CASE WHEN {has('q', S.PAIRS, True)} THEN {pair(S.PAIRS)} WHEN {has('q', S.BETWEEN, True)} THEN {pair(S.BETWEEN)} ELSE {one(entity_sql(f"regexp_extract(q, {lit(S.SINGLE)}, 1)"))} END AS pr,
  list_distinct(list_concat(ids, list_filter(list_transform(list_concat(flatten([{_EXACT}]), list_concat(CASE WHEN contains(low, 'docker compose down -v') THEN ['docker compose down -v'] ELSE [] END, CASE WHEN regexp_matches(q, '\\bDepends\\b') THEN ['Depends'] ELSE [] END)), lambda x: trim(x, '` ')), lambda x: x <> ''))) AS x_ids,
  list_concat(attributes, list_filter({attributes_sql('low', S.ALIASES)}, lambda x: NOT list_contains(attributes, x))) AS x_attributes, {_KEYWORDS} AS kw, {_BY_ATTRIBUTE} AS by_attribute, {_BY_REASON} AS by_reason, {_BY_DEFINITION} AS by_definition FROM profiled),
n1 AS (SELECT *, {choose(_S_TESTS, _KINDS, lit('generic_factual'))} AS st, {choose(_S_TESTS, _WHO, 'p_entities')} AS ent FROM n0),
needs AS (SELECT question_id, doc_id, st, ent, kw, CASE WHEN st = 'exact_technical' THEN x_ids ELSE [] END AS sid, CASE WHEN st IN ('exact_technical', 'entity_attribute') THEN x_attributes ELSE [] END AS att, lower(array_to_string(kw, ' ')) AS kwl, len(list_filter(CASE WHEN st = 'exact_technical' THEN x_ids ELSE [] END, lambda x: regexp_matches(lower(x), {lit(S.CLI_OPTION)}))) > 0 AS cli FROM n1)"""


def lowered(x: str, vocabulary: list[str]) -> str:
    return any_sql(x, [w.lower() for w in vocabulary])


def intent(low: str, cli: str = "cli") -> str:
    technical = f"CASE WHEN {cli} THEN {lowered(low, S.CLI_ACTIONS)} WHEN {any_sql('kwl', ['影响', '发生什么', 'what happens'])} THEN {lowered(low, ['remove', 'delete', 'preserve', '删除', '移除', '保留', 'happens', '会'])} ELSE true END"
    return f"CASE WHEN st = 'entity_definition' THEN {lowered(low, S.DEFINITION)} WHEN st = 'entity_reason' THEN {lowered(low, S.REASON)} WHEN st = 'entity_relation' THEN {lowered(low, S.RELATION)} WHEN st = 'exact_technical' THEN {technical} ELSE true END"


def technical_intent(c: str) -> str:
    low, author = f"{c}.low", ["作者", "author", "created by", "maintainer"]
    return f"CASE WHEN {lowered('kwl', ['支持哪些值', '哪些值', 'supported values', 'valid values', 'options'])} THEN {values(c)} WHEN {lowered('kwl', ['默认值', 'default value', 'default'])} THEN {lowered(low, ['默认值', 'default'])} AND {has(low, S.LITERAL)} WHEN {lowered('kwl', author)} THEN {lowered(low, author)} WHEN cli THEN {lowered(low, S.CLI_ACTIONS)} ELSE {intent(low)} END"


def covered(c: str) -> str:
    return f"(len(ent) = 0 OR {any_in('ent', term('t', c), 't')})"


def related(c: str) -> str:
    hits = f"len(list_filter(ent, lambda t: {term('t', c)}))"
    return f"CASE WHEN len(ent) = 0 THEN true WHEN len(ent) = 1 THEN {hits} >= 1 ELSE {hits} >= 2 END"


_ALONE = f"""CASE WHEN st = 'exact_technical' THEN {all_of('sid', identifier('i', 'ctx'), 'i')} AND {intent('ctx.low')} WHEN st = 'entity_attribute' THEN {covered('ctx')} AND {all_of('att', attribute('a', 'ctx'), 'a')} WHEN st = 'entity_reason' THEN {covered('ctx')} AND {lowered('ctx.low', S.REASON)}
  WHEN st = 'entity_relation' THEN {related('ctx')} AND {lowered('ctx.low', S.RELATION_EVIDENCE)} WHEN st = 'entity_definition' THEN {covered('ctx')} AND {lowered('ctx.low', S.DEFINITION)} ELSE ctx.text <> '' END"""
_CLI_IN = "len(list_filter(sid, lambda x: NOT regexp_matches(own.low, '(?:^|[^a-z0-9_-])\\Q' || trim(lower(x), ' ') || '\\E(?:$|[^a-z0-9_-])'))) = 0"
_S = ["has_evidence", "entity", "intent", "attribute", "identifier", "relation", "lexical", "scored"]
_SCORE = " + ".join(f"CASE WHEN g_{n} THEN {w}::DOUBLE ELSE 0 END" for n, w in S.WEIGHTS.items())
#: ``evidence`` (question_id, pos, marker, doc_id, document, section, path, locator, score, text) comes before this.
GATE = f"""e0 AS (SELECT n.* EXCLUDE (doc_id), e.pos, e.marker, e.doc_id, e.score, CASE WHEN len(e.path) > 0 THEN 'heading:' || lower(array_to_string(e.path, '/')) ELSE 'section:' || lower(e.section) END AS scope, {spaced_sql("concat_ws(' ', e.text, e.document, e.section, array_to_string(e.path, ' '), e.locator)")} AS ctx_text, {spaced_sql("concat_ws(' ', e.text, e.section, array_to_string(e.path, ' '), e.locator)")} AS own_text FROM needs n JOIN evidence e USING (question_id)),
e1 AS (SELECT * EXCLUDE (ctx_text, own_text), {prepared('ctx_text')} AS ctx, {prepared('own_text')} AS own FROM e0),
e2 AS (SELECT *, {_ALONE} AS alone, {related('own')} AND {lowered('own.low', S.RELATION_EVIDENCE)} AS direct_rel, {lowered('own.low', S.RELATION_EVIDENCE)} AS rel_word, {_CLI_IN} AS cli_in, {_CLI_IN} AND {technical_intent('own')} AS cli_hit, list_filter(att, lambda a: {attribute('a', 'own')} AND {covered('own')}) AS att_in FROM e1),
w0 AS (SELECT question_id, doc_id, min(pos) AS first_pos, string_agg(own.text, chr(10) ORDER BY pos) AS txt, list(marker ORDER BY pos) AS markers, list(marker ORDER BY pos) FILTER (direct_rel) AS direct, any_value(sid) AS sid, any_value(st) AS st, any_value(kwl) AS kwl, any_value(cli) AS cli FROM e2 GROUP BY ALL),
w1 AS (SELECT *, {prepared('txt')} AS c FROM w0),
w2 AS (SELECT *, {all_of('sid', identifier('i', 'c'), 'i')} AS id_in, {all_of('sid', identifier('i', 'c'), 'i')} AND {technical_intent('c')} AS id_hit FROM w1),
h0 AS (SELECT question_id, doc_id, scope, min(pos) AS first_pos, string_agg(own.text, chr(10) ORDER BY pos) AS txt, list(marker ORDER BY pos) AS markers, bool_or(rel_word) AS rel_word, any_value(ent) AS ent FROM e2 GROUP BY ALL),
h1 AS (SELECT *, {prepared('txt')} AS c FROM h0),
h2 AS (SELECT question_id, doc_id, arg_min(markers, first_pos) AS scoped FROM h1 WHERE rel_word AND {related('c')} GROUP BY ALL),
d0 AS (SELECT w2.question_id, arg_min(CASE WHEN len(direct) > 0 THEN direct ELSE scoped END, first_pos) FILTER (len(direct) > 0 OR scoped IS NOT NULL) AS rel_ids, bool_or(id_in) AS id_in, arg_min(markers, first_pos) FILTER (id_hit) AS id_ids FROM w2 LEFT JOIN h2 USING (question_id, doc_id) GROUP BY 1),
g0 AS (SELECT question_id, list(marker ORDER BY pos) AS markers, list(marker ORDER BY pos) FILTER (alone) AS alone_ids, max(score) AS best, string_agg(ctx.text, chr(10) ORDER BY pos) AS txt, bool_or(cli_in) AS cli_in, arg_min(marker, pos) FILTER (cli_hit) AS cli_id, list({{'marker': marker, 'att': att_in}} ORDER BY pos) AS att_units FROM e2 GROUP BY 1),
g1 AS (SELECT n.*, coalesce(g.markers, []) AS markers, coalesce(alone_ids, []) AS alone_ids, coalesce(best, 0) AS best, {prepared("coalesce(txt, '')")} AS c, coalesce(cli_in, false) AS cli_in, cli_id, coalesce(att_units, []) AS att_units, rel_ids, coalesce(d.id_in, false) AS id_in, id_ids FROM needs n LEFT JOIN g0 g USING (question_id) LEFT JOIN d0 d USING (question_id)),
g2 AS (SELECT *, CASE WHEN st <> 'entity_relation' THEN [] WHEN len(ent) = 0 THEN markers ELSE coalesce(rel_ids, []) END AS relation_ids, CASE WHEN st <> 'exact_technical' THEN [] WHEN cli THEN CASE WHEN cli_id IS NOT NULL THEN [cli_id] ELSE [] END ELSE coalesce(id_ids, []) END AS technical_ids,
  list_transform(att, lambda a: {{'a': a, 'u': list_transform(list_filter(att_units, lambda u: list_contains(u.att, a)), lambda u: u.marker)}}) AS mapped FROM g1),
g3 AS (SELECT *, list_filter(markers, lambda m: len(list_filter(mapped, lambda x: list_contains(x.u, m))) > 0) AS att_ids, len(list_filter(kw, lambda k: length(k) > 1)) AS long FROM g2),
g4 AS (SELECT *, CASE WHEN st = 'entity_relation' AND len(relation_ids) > 0 THEN relation_ids WHEN st = 'exact_technical' AND len(technical_ids) > 0 THEN technical_ids WHEN st = 'entity_attribute' THEN att_ids ELSE alone_ids END AS supporting, true AS g_has_evidence, {covered('c')} AS g_entity,
  CASE WHEN st = 'exact_technical' THEN len(technical_ids) > 0 WHEN st = 'entity_relation' THEN len(relation_ids) > 0 ELSE {intent('c.low', 'false')} END AS g_intent, len(list_filter(mapped, lambda m: len(m.u) = 0)) = 0 AS g_attribute,
  CASE WHEN st = 'exact_technical' THEN CASE WHEN cli THEN cli_in ELSE id_in END ELSE true END AS g_identifier, CASE WHEN st = 'entity_relation' THEN len(ent) = 0 OR rel_ids IS NOT NULL ELSE {related('c')} END AS g_relation,
  long = 0 OR len(list_filter(kw, lambda k: length(k) > 1 AND contains(c.low, lower(k))))::DOUBLE / greatest(long, 1) >= 0.35 AS g_lexical, best >= 0.15 AS g_scored FROM g3),
g5 AS (SELECT *, CASE WHEN len(markers) = 0 THEN CASE WHEN len(att) > 0 THEN 'missing_attribute_support' ELSE 'no_evidence' END WHEN st = 'overview' AND len(supporting) = 0 THEN 'insufficient_query_coverage' WHEN st = 'exact_technical' AND NOT g_identifier THEN 'missing_exact_identifier_support' WHEN st = 'exact_technical' AND NOT g_intent THEN 'insufficient_query_coverage'
  WHEN st = 'entity_attribute' AND len(att) > 0 AND (NOT g_attribute OR len(supporting) = 0) THEN 'missing_attribute_support' WHEN st = 'entity_reason' AND NOT g_intent AND NOT g_lexical THEN 'missing_reason_support' WHEN st = 'entity_relation' AND NOT g_relation THEN 'missing_entity_support' WHEN st = 'entity_relation' AND NOT g_intent THEN 'missing_relation_support'
  WHEN st = 'entity_definition' AND len(ent) > 0 AND NOT g_entity AND NOT g_lexical THEN 'missing_entity_support' WHEN st = 'entity_definition' AND NOT g_intent AND NOT g_lexical THEN 'insufficient_query_coverage' ELSE 'supported' END AS reason, round(least(1.0::DOUBLE, {_SCORE}), 3) AS total FROM g4),
gated AS (SELECT *, reason = 'supported' AS answerable, CASE WHEN len(markers) = 0 THEN 0.0::DOUBLE WHEN reason = 'supported' THEN total ELSE least(total, 0.49::DOUBLE) END AS support_score FROM g5)"""
_BEST = """bu AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, unit_id) AS pos FROM units QUALIFY pos <= 8),
evidence AS (SELECT q.question_id, u.pos, 'S' || u.pos AS marker, u.doc_id, h.filename AS document, u.section, u.path, 'section:' || u.section AS locator, u.score, u.unit AS text, u.unit_id FROM questions q JOIN bu u USING (doc_id) JOIN handbooks h USING (doc_id))"""
_FINAL = "evidence AS (SELECT p.question_id, p.pos, 'S' || p.pos AS marker, p.doc_id, h.filename AS document, p.section, p.path, 'section:' || p.section AS locator, p.unit_score AS score, p.unit AS text, p.unit_id FROM picked p JOIN handbooks h USING (doc_id))"
_BLOCK = "'[' || marker || ']' || chr(10) || 'document_name: ' || document || chr(10) || 'source_type: markdown' || chr(10) || 'section_title: ' || section || chr(10) || 'source_locator: ' || locator || chr(10) || 'content: ' || text"
#: s6's score without what the chunk says before the unit.
_BARE = SCORED.split("s6 AS (SELECT *, ")[1].split(" AS raw FROM s5)")[0].replace("entity OR context", f"entity OR (context AND {names('heads_low')})")
#: ``evidence`` with the citation-ready fallback; the statement has to be recursive.
FINAL = f"""fq AS (SELECT question_id FROM asking WHERE kind NOT IN ('entity_attribute', 'exact_technical') AND question_id NOT IN (SELECT question_id FROM picked)),
f0 AS (SELECT s5.*, u.i, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, {_BARE})), 6) AS bare FROM s5 JOIN (SELECT unit_id, i FROM units) u USING (unit_id) WHERE question_id IN (SELECT question_id FROM fq)),
f1 AS (SELECT * FROM f0 QUALIFY row_number() OVER (PARTITION BY question_id, doc_id, chunk_id, unit_low ORDER BY bare DESC, i, unit_id) = 1),
f2 AS (SELECT *, row_number() OVER w AS n, first_value(i) OVER w AS i0 FROM f1 WINDOW w AS (PARTITION BY question_id, doc_id, chunk_id ORDER BY bare DESC, i, unit_id)),
f3 AS (SELECT f2.*, row_number() OVER (PARTITION BY question_id, doc_id, chunk_id ORDER BY n > 1, abs(i - i0) DESC, bare DESC, i, unit_id) AS m, h.filename AS document, 'S1' AS marker, 'section:' || section AS locator, unit AS text FROM f2 JOIN handbooks h USING (doc_id) QUALIFY m <= {U.PER_CHUNK}),
f4 AS (SELECT *, length({_BLOCK}) AS chars, row_number() OVER (PARTITION BY question_id ORDER BY m, CASE WHEN m > 1 THEN lexical ELSE 0 END DESC, CASE WHEN m > 1 THEN intent ELSE 0 END DESC, CASE WHEN m > 1 THEN bare ELSE 0 END DESC, score DESC, doc_id, chunk_id, unit_id) AS o FROM f3),
f5 AS (SELECT question_id, 0::BIGINT AS o, 0::BIGINT AS held, 0::BIGINT AS size, false AS taken FROM fq
UNION ALL SELECT question_id, o, CASE WHEN fits THEN held + 1 ELSE held END, CASE WHEN fits THEN more ELSE size END, fits FROM (SELECT f4.question_id, f4.o, held, size, size + chars + CASE WHEN held > 0 THEN 2 ELSE 0 END AS more, held < {U.MAX_UNITS} AND size + chars + CASE WHEN held > 0 THEN 2 ELSE 0 END <= {U.CONTEXT_CHARS} AS fits FROM f5 JOIN f4 ON f4.question_id = f5.question_id AND f4.o = f5.o + 1)),
fallen AS (SELECT f4.*, row_number() OVER (PARTITION BY f4.question_id ORDER BY score DESC, doc_id, chunk_id, m) AS pos FROM f4 JOIN f5 ON f4.question_id = f5.question_id AND f4.o = f5.o WHERE taken),
{_FINAL.removesuffix(')')} UNION ALL SELECT question_id, pos, 'S' || pos, doc_id, document, section, path, locator, bare, text, unit_id FROM fallen)"""
_MAPPED = "array_to_string(list_transform(mapped, lambda m: m.a || '=' || array_to_string(m.u, '+')), ';')"
SUPPORT = f"WITH {BASE}, {PROFILE}, {NEEDS}, {_BEST}, {GATE} SELECT question_id, st AS s_type, array_to_string(list_sort(ent), '|') AS entities, array_to_string(list_sort(att), ',') AS attributes, array_to_string(list_sort(sid), ',') AS identifiers, {', '.join('g_' + n for n in _S)}, array_to_string(list_sort(supporting), ',') AS supporting, array_to_string(list_filter(markers, lambda m: NOT list_contains(supporting, m)), ',') AS rejected, {_MAPPED} AS attribute_units, support_score, reason, answerable FROM gated"
POLICY = f"""{_HEAD}, {SELECTED}, {NEEDS}, {_FINAL}, {GATE}, po AS (SELECT *, CASE WHEN NOT answerable THEN 'evidence_support_rejected' WHEN len(markers) = 0 THEN 'supported_without_final_evidence' WHEN best < 0.15 THEN 'unreliable_retrieval_context' ELSE 'supported' END AS why FROM gated)
SELECT question_id, answerable, reason AS support_reason, CASE WHEN why = 'supported' THEN 'answer' ELSE 'refuse' END AS outcome, why AS reason, CASE WHEN why = 'supported' THEN array_to_string(markers, ',') ELSE '' END AS allowed, why = 'supported' AS citation_required FROM po"""
_SHORT = f"CASE WHEN length({spaced_sql('text')}) > 260 THEN rtrim(substr({spaced_sql('text')}, 1, 257)) || '...' ELSE {spaced_sql('text')} END || ' [' || marker || ']'"
CONTEXT = f"{_HEAD}, {SELECTED}, {_FINAL} SELECT question_id, string_agg({_BLOCK}, chr(10) || chr(10) ORDER BY pos) AS context, '根据当前知识库证据，' || string_agg({_SHORT}, ' ' ORDER BY pos) FILTER (pos <= 2) AS answer FROM evidence GROUP BY question_id"
_BOTH = "lower(" + spaced_sql("concat_ws(' ', text, heads)") + ")"
_ANSWERS = f"CASE WHEN kind = 'entity_definition' THEN {has('lower(text)', U.DEFINES)} WHEN kind = 'entity_reason' THEN {has('lower(text)', U.REASONS)} WHEN kind = 'overview' THEN NOT {has('lower(' + spaced_sql('text') + ')', U.BOILERPLATE)} ELSE false END"
RANKING = f"""WITH {BASE}, {PROFILE}, {ASKING}, rc AS (SELECT doc_id, chunk_id, string_agg(unit, chr(10) ORDER BY i) AS text, arg_min(section, i) AS section, arg_min(path, i) AS path, any_value(score) AS score FROM units GROUP BY ALL),
ri AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, chunk_id) AS idx, concat_ws(' ', section, array_to_string(path, ' '), 'section:' || section) AS heads FROM rc),
rq AS (SELECT *, {_BOTH} AS both_low, list_distinct({parts('heads')}) AS hp FROM asking JOIN ri USING (doc_id)),
rs AS (SELECT question_id, chunk_id, idx, CASE WHEN NOT (p_type = 'generic_factual' AND NOT (len(t_ids) > 0 AND t_intent IS NOT NULL)) THEN round(CASE WHEN p_type = 'entity_relation' THEN 0.25::DOUBLE ELSE 0.35::DOUBLE END * greatest(0, score) + 0.35::DOUBLE * {relevance('text')} + 0.15::DOUBLE * {relevance('heads')} + CASE WHEN {names('both_low')} THEN 0.1::DOUBLE ELSE 0 END
  + CASE WHEN {share('both_low')} > 0 THEN CASE WHEN p_type = 'entity_relation' THEN 0.15::DOUBLE ELSE 0.05::DOUBLE END ELSE 0 END + CASE WHEN len(hp) >= 2 AND list_has_all({parts('q')}, hp) THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN p_type = 'entity_definition' AND {names('both_low')} AND {_ANSWERS} THEN 0.2::DOUBLE ELSE 0 END
  - CASE WHEN p_type = 'entity_definition' AND {has('lower(' + spaced_sql('text') + ')', U.BOILERPLATE)} THEN 0.2::DOUBLE ELSE 0 END, 6) END AS priority FROM rq)
SELECT question_id, chunk_id, priority, row_number() OVER (PARTITION BY question_id ORDER BY priority DESC NULLS LAST, idx)::INTEGER AS place FROM rs"""
_TOK = lambda x: f"regexp_extract_all(lower({x}), '[A-Za-z0-9]+|{CJK}')"
_COUNT = "len(list_filter({a}, lambda y: y = x))"
RERANKED = f"""{_HEAD.replace('WITH', 'WITH RECURSIVE', 1)}, {SELECTED}, {FINAL}, rr AS (SELECT question_id, unit_id, pos, {_TOK('question')} AS q, {_TOK('text')} AS d, {_TOK("concat_ws(' ', document, locator, section)")} AS m, contains(lower({spaced_sql('text')}), lower({spaced_sql('question')})) AS ph FROM evidence JOIN questions USING (question_id)),
rs AS (SELECT question_id, unit_id, pos, round(least(1.0::DOUBLE, CASE WHEN ph THEN 0.35::DOUBLE ELSE 0 END + 0.45::DOUBLE * len(list_intersect(list_distinct(q), d)) / greatest(1, len(list_distinct(q))) + 0.15::DOUBLE * coalesce(list_sum(list_transform(list_intersect(list_distinct(q), d), lambda x: least({_COUNT.format(a='q')}, {_COUNT.format(a='d')}))), 0) / greatest(1, len(q)) + 0.05::DOUBLE * len(list_intersect(list_distinct(q), m)) / greatest(1, len(list_distinct(q)))), 6) AS rerank FROM rr)
SELECT question_id, unit_id, rerank, row_number() OVER (PARTITION BY question_id ORDER BY rerank DESC, pos)::INTEGER AS rank FROM rs QUALIFY rank <= 3"""
