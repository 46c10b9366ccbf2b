"""What a question asks for, as column expressions: routing, identifiers, attributes, entities, keywords and terms.

The vocabularies are data; each rule is one regular expression or a fold over a short list, so that
questions are analysed inside whole-stage code. (?U) gives \\w and \\b their Unicode meaning.
"""
from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from sparquill.functions import columns as F

OVERVIEW = ["总结", "概括", "归纳", "综述", "主要内容", "核心内容", "主要包含哪些内容", "主要包含什么", "哪些方面", "主要环节", "有哪些主要", "有哪些部分", "包括哪些内容", "列出所有", "列出.*主要", "整体介绍", "整体架构", "文档讲了什么", r"\boverview\b", r"\bsummarize\b", r"\bsummary\b", r"\bmain topics\b", r"\blist all\b", r"\bwhat are the main\b", "成员有哪些[？?]?$"]
RELATION = ["什么关系", "关系", "关联", "依赖", "属于", "包含", "调用", "负责", "合作", "协作", "伙伴", "同事", "隶属", "连接", "组成", "与.+之间", r"\brelationship\b", r"\bdepends on\b", r"\bbelongs? to\b", r"\bpart of\b", r"\bworks with\b"]
WEAK = ["影响", "权限", "成员", "作用", "特点", "介绍"]
STRONG = ["什么关系", "属于哪个", "属于什么", "合作", "协作", "伙伴", "同事", "隶属", "依赖", "调用", "与", "和"]
SINGLE = ["属于哪个", "属于什么", "隶属"]
#: Exact technical signals, those that mind letters' case and those that don't; a path may not follow a word character.
FOLDERS = "app|tests|docs|frontend|scripts|alembic|worker-go"
TECHNICAL = [r"\.env(?:\.[\w-]+)?\b", r"\b[A-Z][A-Z0-9]+(?:_[A-Z0-9]+)+\b", r"\b[a-z][a-z0-9]+_[a-z0-9_]+\b", r"\b__[A-Za-z0-9_]+__\b", r"\b[A-Za-z_][A-Za-z0-9_]*\s*\(", r"\b(?:401|403|404|500)\b", "`[^`]+`", "['\"][^'\"]+['\"]", r"\b[A-Za-z_][A-Za-z0-9_]*\.[A-Za-z_][A-Za-z0-9_]*\b"]
TECHNICAL_ANY_CASE = [rf"(?:^|[^\w])/(?:api|v\d+|{FOLDERS})(?:/[\w.{{}}:-]+)+", r"\b(?:GET|POST|PUT|PATCH|DELETE)\s+/[\w./{}:-]+", rf"\b(?:{FOLDERS})/(?:[\w.{{}}:-]+/)*[\w.{{}}:-]+", r"\b(?:docker\s+compose|npm\s+run|pnpm|pytest|curl)\b", r"\bpython\s+[\w./-]+\.py\b", r"\bHTTP\s*(?:401|403|404|500)\b"]
CONNECTOR = r"\s(?:和|与|及|、|and)\s?"
ENTITY_TOKEN = r"\b[A-Z][A-Za-z0-9]*(?:\s+[A-Z][A-Za-z0-9]*)*\b|\b[a-z]+_[a-z0-9_]+\b|[\x{4e00}-\x{9fff}A-Za-z0-9_]+(?:Block|Chunk|Parser|API|MVCC|Labs|Systems)"
INTENT = ["总结", "概括", "主要内容", "关键点", "梳理", "整体", "有哪些内容", "讲了什么", "这些资料主要", "这些文档主要", "summarize", "summary", "overview", "key points", "main topics", "what is this knowledge base about"]

#: Attributes that a question can ask for, with the words that name them.
ALIASES: dict[str, list[str]] = {
    "location": ["在哪里", "在哪", "办公地点", "办公城市", "城市", "地址", "location", "office", "city", "address"],
    "processor": ["处理器", "cpu", "gpu", "芯片", "processor", "chipset"],
    "color": ["颜色", "配色", "color", "colour", "finish"],
    "weight": ["重量", "多重", "weight"],
    "height": ["身高", "height"],
    "role": ["角色", "职位", "职务", "role", "position", "title"],
    "responsibility": ["负责", "职责", "责任", "responsibility", "responsibilities", "owns"],
    "group": ["隶属", "属于哪个组", "属于哪个团队", "group", "team", "belongs to"],
    "configuration": ["配置", "环境变量", "config", "configuration", "environment variable"],
    "default_value": ["默认值", "缺省值", "default value", "defaults to", "default"],
    "supported_values": ["支持哪些值", "可选值", "允许值", "supported values", "valid values", "options"],
    "file_types": ["文件类型", "文件格式", "输入文件", "文本格式", "扩展名", "file types", "file formats", "input files", "formats", "extensions"],
    "version": ["版本", "version", "release"],
    "date": ["日期", "时间", "哪一年", "什么时候", "date", "year", "when"],
    "leave_entitlement": ["休假额度", "休假天数", "多少天休假", "假期天数", "leave entitlement", "vacation allowance", "leave days"],
}
#: Identifier patterns: (pattern, group, any case).
IDENTIFIERS = [
    ("`([^`]+)`", 1, False), (r"\b[A-Z][A-Z0-9]+(?:_[A-Z0-9]+)+\b", 0, False), (r"\b[a-z][a-z0-9]+_[a-z0-9_]+\b", 0, False), (r"\b__[A-Za-z0-9_]+__\b", 0, False), (r"\b(?:GET|POST|PUT|PATCH|DELETE)\s+/[\w./{}:-]+", 0, True),
    (r"(?:^|[^\w])(/(?:api|v\d+)(?:/[\w.{}:-]+)+)", 1, True), (rf"\b(?:{FOLDERS})/(?:[\w.{{}}:-]+/)*[\w.{{}}:-]+", 0, True), (r"\b[A-Za-z_][A-Za-z0-9_]*\(\)", 0, False), (r"(?:中|调用|使用)\s*([A-Z][A-Za-z0-9_]+)\s*(?:的|在|是)", 1, False),
    (r"\b[\w.-]+\.(?:py|md|txt|pdf|docx|ya?ml|json)\b", 0, True), (r"\b(?:docker\s+compose(?:\s+[A-Za-z0-9_.-]+)+|npm\s+run\s+[A-Za-z0-9_:-]+|pnpm\s+[A-Za-z0-9_:-]+|pytest(?:\s+[A-Za-z0-9_./:-]+)*|curl\s+\S+)", 0, True),
]
ASKED_OVERVIEW = r"总结|概括|归纳|综述|主要内容|\boverview\b|\bsummary\b|\bsummarize\b"
ASKED_ALL = r"列出所有|全部|所有|有哪些|哪些成员|\blist\s+all\b|\ball\s+(?:the\s+)?(?:items|members|documents)\b"
ASKED_RELATION = r"什么关系|有.*关系|\brelationship\b|\brelated\b"
ASKED_DEFINITION = ["是谁", "是什么", "介绍", "定义", "what is"]
FILLERS = (
    r"为什么|是谁|是什么|是多少|在哪里|在哪|位于哪里|有什么|什么|如何|怎么|请问|请|的|型号|作用|用途|特点|特征|支持|使用|调用|保存|办公|文本|哪些值|哪些|值|列出所有|全部|所有|总结|概括|归纳|当前|中的|和外壳|分别|"
    r"\b(?:why|what|where|when|how|does|do|is|are|the|a|an|please|list|all)\b"
)
PAIR_OF = r"(.+?)(?:和|与|跟|\band\b)(.+?)(?:是什么关系|有.*关系|\brelationship\b|\brelated\b|[？?]?$)"
REASON_BEFORE, REASON_AFTER = r"^\s*(.+?)\s*为什么", r"为什么\s*(.+?)(?:需要|会|要|使用|采用|适合|拒绝|触发|导致)"
STOP_KEYWORDS = ["是什么", "是谁", "为什么", "哪里", "什么", "多少", "这个", "文档", "请问", "how", "what", "why", "the", "does"]
#: Alternatives in this order: relative path, absolute path, capitals, stamped number, identifier, CJK run.
TERM = r"[A-Za-z0-9_.-]+(?:/[A-Za-z0-9_{}.-]+)+|/[A-Za-z0-9_{}./:-]+|\b[A-Z][A-Z0-9_]{2,}\b|\b\d{8}_\d{3,6}\b|\b[A-Za-z0-9_][A-Za-z0-9_.-]*\b|[\x{4e00}-\x{9fff}]+"
KB_WIDE = r"(?:当前|整个|全部|所有)?知识库|当前语料|全部文档|所有文档|\bknowledge\s+base\b|\ball\s+(?:the\s+)?documents\b|\bentire\s+(?:collection|corpus)\b"
GENERIC = ["all", "content", "cover", "current", "document", "documents", "file", "files", "give", "knowledge", "main", "me", "of", "overview", "please", "summary", "summarize", "the", "what", "总结", "概括", "归纳", "文档", "文件", "内容", "介绍", "主要", "当前", "知识库"]


def joined(parts: Sequence[str]) -> str:
    return "|".join(f"(?:{p})" for p in parts)


def guarded(aliases: Sequence[str]) -> str:
    """A pattern for lower-case text: ASCII aliases between other characters, the rest anywhere."""
    ascii_ones = [a for a in aliases if any(c.isascii() and (c.isalnum() or c == "_") for c in a)]
    rest = [a for a in aliases if a not in ascii_ones]
    return joined(([f"(?:^|[^a-z0-9_])(?:{'|'.join(ascii_ones)})(?:$|[^a-z0-9_])"] if ascii_ones else []) + rest)


def found(text: Column, pattern: str, any_case: bool = False) -> Column:
    return text.rlike(("(?iuU)" if any_case else "(?U)") + pattern)


def spaced(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "(?U)\\s+", " "))


def any_of(text: Column, words: Sequence[str]) -> Column:
    """Whether a text holds one of words, by one pattern: long lists make no large plans."""
    return text.rlike("|".join(map(re.escape, words)))


def relation_signal(q: Column) -> Column:
    """A word of relations, not a weak one alone, and two entities or a phrase that needs one."""
    low = F.lower(q)
    entities = F.array_distinct(F.transform(F.regexp_extract_all(q, F.lit("(?U)" + ENTITY_TOKEN), F.lit(0)), lambda e: F.trim(e)))
    two = found(q, CONNECTOR, True) | (F.size(entities) >= 2)
    one = any_of(q, SINGLE) | F.contains(low, F.lit("belongs to")) | F.contains(low, F.lit("part of"))
    return found(q, joined(RELATION), True) & ~(any_of(q, WEAK) & ~any_of(q, STRONG)) & (two | one)


def technical_signal(q: Column) -> Column:
    low = F.lower(q)
    return found(q, joined(TECHNICAL)) | found(q, joined(TECHNICAL_ANY_CASE), True) | F.contains(low, F.lit("source locator")) | low.rlike("(?:^|[^a-z0-9_])depends(?:$|[^a-z0-9_])")


ROUTES = [("overview", "question asks for overview or summary", "high"), ("graph_vector_mix", "question asks about explicit entity relations", "high"), ("chunk_only", "default factual question", "low"), ("hybrid_text", "question contains exact technical identifier", "high"), ("chunk_only", "low-confidence router signal; defaulting to chunk_only", "low"), ("chunk_only", "default factual question", "low")]


def route(question: Column) -> Column:
    """struct(mode, reason, confidence) by the first rule that holds: overview, relation, attribute phrase, identifier, weak signal, none."""
    q = spaced(question)
    low = F.lower(q)
    tests = [found(q, joined(OVERVIEW), True), relation_signal(q), F.contains(q, F.lit("有什么特点")), technical_signal(q), any_of(q, WEAK) | any_of(low, ["api", "config", "dependency", "mvcc"]), F.lit(True)]
    pick = lambda k: F.coalesce(*(F.when(t, F.lit(r[k])) for t, r in zip(tests, ROUTES)))
    return F.struct(pick(0).alias("mode"), pick(1).alias("reason"), pick(2).alias("confidence"))


def intent(question: Column) -> Column:
    return F.when(any_of(F.lower(spaced(question)), INTENT), F.lit("kb_overview")).otherwise(F.lit("kb_fact_qa"))


#: Where runs of [a-z0-9_] begin and end.
WORD_EDGE = "(?<![a-z0-9_])(?=[a-z0-9_])|(?<=[a-z0-9_])(?![a-z0-9_])"


def marked_aliases(aliases: dict[str, list[str]]) -> Column:
    """(name, words) of each attribute, one literal: ASCII aliases, which begin and end with a letter or digit, have word edges marked."""
    text = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return F.expr("array(" + ", ".join(f"named_struct('name', {text(n)}, 'words', array({', '.join(text(re.sub(WORD_EDGE, chr(1), a)) for a in own)}))" for n, own in aliases.items()) + ")")


def attributes_in(low: Column, aliases: dict[str, list[str]] = ALIASES) -> Column:
    """Names of the attributes that a lower-case text mentions, in their listed order: by guarded() aliases, but looked up in the text with its word edges marked, a tenth of a pattern's time."""
    named = lambda t: F.filter(marked_aliases(aliases), lambda a: F.exists(a["words"], lambda w: F.contains(t, w)))
    # The text is an array of one, so that it is marked once.
    marked = F.transform(F.array(F.regexp_replace(low, WORD_EDGE, chr(1))), lambda t: F.transform(named(t), lambda a: a["name"]))
    return F.when(low.isNull(), F.array().cast("array<string>")).otherwise(marked[0])


def identifiers(q: Column) -> Column:
    """Technical identifiers in pattern order, each once."""
    flags = lambda any_case: "(?iuU)" if any_case else "(?U)"
    every = F.flatten(F.array(*(F.regexp_extract_all(q, F.lit(flags(c) + p), F.lit(g)) for p, g, c in IDENTIFIERS)))
    return F.array_distinct(F.filter(F.transform(every, lambda x: F.regexp_replace(x, "^[`'\" ]+|[`'\" ]+$", "")), lambda x: x != ""))


def requested(q: Column, ids: Column) -> Column:
    """Attributes asked for: 'where configured' is no location, the time of a call no date."""
    low = F.lower(q)
    every = attributes_in(low)
    placed = F.array_contains(every, "configuration") & F.array_contains(every, "location") & found(low, r"配置(?:在)?哪里|where\s+(?:is\s+\w+\s+)?configur")
    called = (F.size(ids) > 0) & found(low, r"调用|执行|运行|阶段|\b(?:call|invoke|execute|run|stage)\b")
    every = F.when(placed, F.array_remove(every, "location")).otherwise(every)
    return F.when(called, F.array_remove(every, "date")).otherwise(every)


def query_type(q: Column, attributes: Column, ids: Column) -> Column:
    low = F.lower(q)
    return (
        F.when(found(q, ASKED_OVERVIEW, True) | found(q, ASKED_ALL, True), F.lit("overview"))
        .when(found(q, ASKED_RELATION, True), F.lit("entity_relation"))
        .when(F.size(ids) > 0, F.lit("exact_technical"))
        .when(F.size(attributes) > 0, F.lit("entity_attribute"))
        .when(F.contains(q, F.lit("为什么")) | found(low, r"\bwhy\b"), F.lit("entity_reason"))
        .when(any_of(low, ASKED_DEFINITION), F.lit("entity_definition"))
        .otherwise(F.lit("generic_factual"))
    )


def entity_text(text: Column) -> Column:
    """Word characters of a text with single blanks between them."""
    return F.trim(F.regexp_replace(text, "(?U)[^\\w]+", " "))


def without(text: Column, words: Column) -> Column:
    """text with each of an array of words taken out, whatever its case."""
    return F.aggregate(words, text, lambda t, w: F.regexp_replace(t, F.concat(F.lit("(?iu)\\Q"), w, F.lit("\\E")), F.lit(" ")))


def entities(q: Column, kind: Column, attributes: Column, ids: Column) -> Column:
    """The entities a question is about: both sides of a relation, the subject of a reason, else what is left of the question."""
    pair = F.array(*(entity_text(F.regexp_extract(q, "(?iu)" + PAIR_OF, g)) for g in (1, 2)))
    pair = F.filter(pair, lambda x: x != "")
    before, after = entity_text(F.regexp_extract(q, REASON_BEFORE, 1)), entity_text(F.regexp_extract(q, REASON_AFTER, 1))
    none = F.array().cast("array<string>")
    named = F.flatten(F.array(*(F.when(F.array_contains(attributes, name), F.array(*map(F.lit, a))).otherwise(none) for name, a in ALIASES.items())))
    left = without(q, F.concat(ids, named))
    left = entity_text(F.regexp_replace(left, "(?iuU)" + FILLERS, " "))
    rest = F.when(left != "", F.array(left)).otherwise(F.array().cast("array<string>"))
    reason = F.when(before != "", F.array(before)).when(after != "", F.array(after)).otherwise(rest)
    return F.when((kind == "entity_relation") & q.rlike("(?iu)" + PAIR_OF), pair).when(kind == "entity_reason", reason).otherwise(rest)


def keywords(q: Column) -> Column:
    """Latin words and CJK runs of two characters or more, without question words."""
    return F.filter(F.regexp_extract_all(q, F.lit(r"[A-Za-z_][A-Za-z0-9_]*|[\x{4e00}-\x{9fff}]{2,}"), F.lit(0)), lambda w: ~F.lower(w).isin(STOP_KEYWORDS))


def _expanded(token: Column) -> Column:
    """A token with its path parts, base name, stems, technical parts and, of short CJK runs, characters."""
    none = F.array().cast("array<string>")
    parts = F.filter(F.split(token, r"[/\\]"), lambda x: x != "")
    pathed = token.rlike(r"[/\\]")
    base = F.regexp_extract(token, r"([^/\\]*)$", 1)
    stem = lambda t: F.regexp_replace(t, r"\.[^.]*$", "")
    return F.concat(
        F.array(token), F.when(pathed, parts).otherwise(none), F.when(pathed & (base != ""), F.array(base)).otherwise(none), F.when(pathed & F.contains(base, F.lit(".")), F.array(stem(base))).otherwise(none),
        F.when(F.contains(token, F.lit(".")), F.array(stem(token))).otherwise(none), F.when(token.rlike("[-.:_]"), F.filter(F.split(token, "[-./:_]"), lambda x: x != "")).otherwise(none),
        F.when(token.rlike(r"^[\x{4e00}-\x{9fff}]{1,12}$"), F.regexp_extract_all(token, F.lit(r"[\x{4e00}-\x{9fff}]"), F.lit(0))).otherwise(none),
    )


def terms(question: Column) -> Column:
    """The keyword terms of a question, expanded, lower case, each once in order."""
    tokens = F.transform(F.regexp_extract_all(question, F.lit("(?U)" + TERM), F.lit(0)), lambda t: F.lower(spaced(t)))
    return F.array_distinct(F.filter(F.transform(F.flatten(F.transform(tokens, lambda t: _expanded(t))), lambda t: F.trim(t)), lambda t: t != ""))


def name_text(name: Column) -> Column:
    """A file name or question for comparing: camel case split, other characters as blanks, lower case."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(name, "(?<=[a-z0-9])(?=[A-Z][a-z])", " ")), r"[^a-z0-9\x{4e00}-\x{9fff}]+", " "))


def meaningful(text: Column) -> Column:
    """Words of a name_text() that say something, in order."""
    return F.filter(F.regexp_extract_all(text, F.lit(r"[a-z0-9]+|[\x{4e00}-\x{9fff}]+"), F.lit(0)), lambda w: ~w.isin(GENERIC) & (F.length(w) > 1))


def asks_for_document(q: Column) -> Column:
    """Whether a question names some document or file, but not just its type or 'this document'."""
    here = found(q, r"(?:这个|这份|该)文档|\b(?:this|the)\s+document\b", True) | found(q, r"文件(?:类型|格式|扩展名)|\bfile\s+(?:types?|formats?|extensions?)\b", True)
    return ~here & found(q, r"\.(?:md|txt|pdf|docx)\b|文档|文件|\bdocument\b|\bfile\b|\bguide\b", True)
