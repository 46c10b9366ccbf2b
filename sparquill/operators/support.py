"""Whether final evidence supports an answer: what the question needs, what the units cover, and why not.

A question's evidence is a short list (a handful of units, bounded by the selection before), so a
question is one row and every signal is a fold over its list, without Python and without a join.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from sparquill.functions import columns as F

from sparquill.functions import questions as Q

#: Further names of attributes that the gate knows, beside those of question analysis.
ALIASES: dict[str, list[str]] = {
    "financial": ["利润", "收入", "营收", "融资", "revenue", "profit", "funding", "financing"], "leadership": ["ceo", "chief executive", "首席执行官", "负责人"], "founder": ["创始人", "founder", "founded by"], "listing": ["上市", "ipo", "listed"],
    "processor": ["处理器", "cpu", "processor", "芯片", "显卡", "gpu"], "birthday": ["生日", "出生", "出生日期", "出生年份", "birthday", "born"], "location": ["在哪里", "在哪", "办公地点", "办公城市", "地点", "位置", "地址", "总部", "街道地址", "location", "city", "address"],
    "color": ["颜色", "color", "finish", "银色", "黑色", "蓝色", "灰色"], "weight": ["重量", "多重", "weight", "kg"], "height": ["身高", "height", "tall"], "role": ["角色", "职位", "role"], "responsibility": ["负责", "职责", "responsibility", "owns", "maintains", "focuses"],
    "group": ["隶属", "属于哪个组", "属于哪个团队", "group", "belongs to"], "configuration": ["配置", "在哪里配置", "environment variable", "环境变量", "config"], "default_value": ["默认值", "default value", "default"], "remote_work_policy": ["远程办公", "remote work"],
    "invention_date": ["哪一年", "发明", "created", "invented", "founded"], "leave_entitlement": ["休假额度", "休假天数", "多少天休假", "假期天数", "leave entitlement", "vacation allowance", "leave days"],
}
#: What names an attribute in a text: the words of either list.
EVERY_ALIAS = {name: list(dict.fromkeys([*ALIASES.get(name, []), *Q.ALIASES.get(name, [])])) for name in [*Q.ALIASES, *(n for n in ALIASES if n not in Q.ALIASES)]}
DEFINITION = ["是", "为", "指", "定义", "身份", "角色", "人物", "产品", "概念", "工具", "系统", "records", "preserve", "organizes", "is a", "are a", "refers to", "defined", "usually"]
REASON = ["因为", "用于", "用来", "目的", "可以", "能够", "避免", "减少", "保持", "需要", "优势", "helps", "because", "allows", "provides", "designed to", "used to", "so ", "can ", "should", "reduce", "preserve", "keep"]
RELATION = ["关系", "关联", "依赖", "属于", "隶属", "合作", "伙伴", "同事", "成员", "包含", "调用", "负责", "连接", "组成", "derived from", "depends", "belongs", "part of", "works with", "partner", "relationship", "supports", "strategies"]
RELATION_EVIDENCE = [*RELATION, "follow", "follows", "followed", "lead", "leads", "led", "encounter", "encounters", "encountered", "speaks with", "faces", "draws", "produce", "produces", "becomes", "become", "without blocking", "跟随", "遇到", "带领", "引向"]
OVERVIEW = ["总结", "概括", "归纳", "综述", "主要内容", "主要环节", "有哪些", "overview", "summary", "summarize"]
EXACT = [(r"\b[A-Z][A-Z0-9]+(?:_[A-Z0-9]+)+\b", 0, False), (r"\b[a-z][a-z0-9]+_[a-z0-9_]+\b", 0, False), (r"\b__[A-Za-z0-9_]+__\b", 0, False), (r"\b(?:GET|POST|PUT|PATCH|DELETE)\s+/[\w./{}:-]+", 0, True), (r"(?:^|[^\w])(/(?:api|v\d+)(?:/[\w.{}:-]+)+)", 1, True), ("`([^`]+)`", 1, False)]
PAIRS = r"(.+?)(?:和|与|跟)(.+?)(?:是什么关系|有(?:什么)?关系|的关系|之间是什么.+关系|关系)"
PROFILE_PAIRS = r"(.+?)(?:和|与|跟)(.+?)(?:是什么关系|有(?:什么)?关系|的关系|关系)"
#: The second side of an English relation is taken to its first character only, as the rule has it.
BETWEEN = r"relationship between (.+?) and (.)"
SINGLE = r"(.+?)(?:属于哪个|属于什么|隶属于哪个|隶属于什么)"
TAIL = r"(?:的)?(?:情节|故事|剧情|人物|角色)?(?:关系)?(?:是什么|如何)?\s*$"
ATTRIBUTE_WORDS = sorted({"的", "是什么", "是谁", "是多少", "什么", "在哪里", "在哪", "什么时候", "哪一年", "哪一天", "去年", "规则", "办公", "型号", "使用哪款", "有多重", *(a for v in ALIASES.values() for a in v)}, key=lambda w: (-len(w), w))
REASON_WORDS = "为什么|why|使用|需要|适合|受欢迎|有用|主要目的|目的|是什么|的"
DEFINITION_WORDS = r"是什么|是谁|是啥|what is|介绍一下|介绍|定义|\?|？|。"
PROFILE_ATTRIBUTE = ["长什么样", "长啥样", "外貌", "样子", "颜色", "重量", "尺寸", "规格", "配置", "属性", "特点", "特征", "办公地点", "地点", "位置"]
PROFILE_CLEAN = ["长什么样", "长啥样", "是什么样", "是什么颜色", "是什么规格", "是什么", "是多少", "外貌是什么", "在哪里", "在哪", "外貌", "样子", "颜色", "重量", "尺寸", "规格", "配置", "属性", "特点", "特征", "办公地点", "地点", "位置", "的", "多少"]
INTENTS = {
    "entity_definition": ["身份", "人物", "角色", "定义", "介绍", "职业", "产品", "项目", "工具", "系统", "组织", "概念"],
    "entity_attribute": ["属性", "外貌", "外形", "外型", "形态", "结构", "样子", "颜色", "尺寸", "重量", "特征", "特点", "配置", "规格", "地点", "位置", "办公地点"],
    "entity_reason": ["原因", "为什么", "优势", "影响", "受欢迎", "人气", "吸引力", "因素", "特点", "适合", "适用场景", "because", "designed to", "useful"],
    "entity_relation": ["关系", "关联", "依赖", "朋友", "伙伴", "合作", "同事", "成员", "隶属", "属于", "包含", "调用", "负责", "权限", "上下游", "连接", "组成", "derived from", "depends on", "works with", "follows", "followed", "leads", "encounters", "produces", "becomes", "creates", "reduces", "supports", "without blocking"],
}
SUPPORTED_WORDS = ["supported values", "valid values", "accepted values", "allowed values", "可选值", "允许值", "支持的值", "可设置为"]
SUPPORTED_LISTS = [r"\b(?:supports?|accepts?|allows?|options?\s+(?:are|include))\b[^.;。\n]{0,120}(?:,|\band\b|\bor\b|/|、|，)", r"(?:支持|允许|可选)[^。\n]{0,120}(?:、|，|或|和)"]
LITERAL = r"(?:^|[\s:=])(?:-?\d+(?:\.\d+)?|true|false|none|null)(?:$|[\s,.;，。])"
CLI_OPTION = r"(?:^|\s)--?[a-z0-9]"
CLI_ACTIONS = ["validate", "print", "show", "list", "write", "create", "remove", "delete", "preserve", "start", "stop", "applies", "apply", "check", "output", "验证", "检查", "输出", "打印", "写入", "创建", "删除", "移除", "保留", "启动", "停止", "应用"]
TOKEN_ALIASES = {"类": ["class", "classes", "类"], "目的": ["purpose", "目的"], "办公城市": ["办公地点", "city", "location", "办公城市"], "显式锁": ["显式锁", "lock", "locks", "locking", "blocking"]}
WEIGHTS = {"has_evidence": 0.15, "entity": 0.20, "intent": 0.20, "attribute": 0.15, "identifier": 0.15, "relation": 0.10, "lexical": 0.10, "scored": 0.05}


def none() -> Column:
    return F.array().cast("array<string>")


def first_filled(*arrays: Column) -> Column:
    """The first of arrays that isn't empty."""
    return reduce(lambda other, a: F.when(F.size(a) > 0, a).otherwise(other), reversed(arrays[:-1]), arrays[-1])


def one(term: Column) -> Column:
    return F.when(term != "", F.array(term)).otherwise(none())


def compact(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "(?U)[\\W_]+", "")


def identifier_tokens(text: Column) -> Column:
    """Parts of identifiers and words, camel case and underscores split, in the singular."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[`'\"]", " "), "([a-z0-9])(?=[A-Z])", "$1 "), "[_-]+", " ")

    def singular(w: Column) -> Column:
        long = F.length(w) > 4
        return F.when(long & w.endswith("ies"), F.concat(F.substr(w, F.lit(1), F.length(w) - 3), F.lit("y"))).when(long & w.endswith("s") & ~w.endswith("ss"), F.substr(w, F.lit(1), F.length(w) - 1)).otherwise(w)

    return F.transform(F.regexp_extract_all(t, F.lit("[A-Za-z0-9]+"), F.lit(0)), lambda w: singular(F.lower(w)))


def _parts_covered(tokens: Column, context_tokens: Column) -> Column:
    return (F.size(tokens) > 0) & (F.size(F.array_except(tokens, context_tokens)) == 0)


def prepared(context: Column) -> Column:
    """A context with what the tests below look at, computed once: text, lower, compact, identifier parts, entity tokens, identifiers, attributes, and whether it lists values."""
    low = F.lower(context)
    words = F.regexp_extract_all(low, F.lit(r"[a-z_][a-z0-9_]*|[\x{4e00}-\x{9fff}]+"), F.lit(0))
    ids = F.concat(*(F.regexp_extract_all(context, F.lit("(?U)" + p), F.lit(0)) for p, _, _ in EXACT[:2]))
    return F.struct(context.alias("text"), low.alias("low"), compact(context).alias("compact"), identifier_tokens(context).alias("parts"), words.alias("words"), F.transform(ids, lambda x: F.lower(x)).alias("ids"), Q.attributes_in(low, EVERY_ALIAS).alias("named"), lists_values(low).alias("lists"))


def term_covered(term: Column, c: Column) -> Column:
    """An entity's text, its parts, or its words or their other names are in the prepared context."""
    small = compact(term)
    words = F.regexp_extract_all(F.lower(term), F.lit(r"[a-z_][a-z0-9_]*|[\x{4e00}-\x{9fff}]+"), F.lit(0))

    def there(w: Column) -> Column:
        known = reduce(lambda other, kv: F.when(w == kv[0], F.arrays_overlap(c["words"], F.array(*map(F.lit, kv[1])))).otherwise(other), TOKEN_ALIASES.items(), F.array_contains(c["words"], w))
        return known

    return ((small != "") & F.contains(c["compact"], small)) | _parts_covered(identifier_tokens(term), c["parts"]) | F.forall(words, there)


def identifier_covered(identifier: Column, c: Column) -> Column:
    """Exactly, where it is a strict identifier and the context has similar ones; else as text or by its parts."""
    bare = F.regexp_replace(identifier, "^[`'\" ]+|[`'\" ]+$", "")
    strict = bare.rlike("^(?:[A-Z][A-Z0-9]+(?:_[A-Z0-9]+)+|[a-z][a-z0-9]+_[a-z0-9_]+)$")
    near = F.filter(c["ids"], lambda x: F.arrays_overlap(F.split(x, "_"), F.split(F.lower(bare), "_")))
    loose = F.contains(c["compact"], compact(identifier)) | _parts_covered(identifier_tokens(identifier), c["parts"])
    return F.when(strict & (F.size(near) > 0), F.array_contains(near, F.lower(bare))).otherwise(loose)


def attribute_in(name: Column, c: Column) -> Column:
    """Whether the prepared context names an attribute; supported values also by a list of them."""
    return F.array_contains(c["named"], name) | ((name == "supported_values") & c["lists"])


def lists_values(low: Column) -> Column:
    return Q.any_of(low, SUPPORTED_WORDS) | low.rlike("(?U)" + Q.joined(SUPPORTED_LISTS))


def _pair_terms(q: Column, pattern: str) -> Column:
    sides = (Q.entity_text(F.regexp_replace(F.regexp_extract(q, "(?iu)" + pattern, g), "(?iu)" + TAIL, "")) for g in (1, 2))
    return F.filter(F.array(*sides), lambda x: x != "")


def profile(rows: DataFrame) -> DataFrame:
    """rows of analysed questions (q, low, attributes, entities) with p_type, p_entities and p_intents, the words of an answer."""
    low, e = F.col("low"), F.col("entities")
    pair = F.when(F.col("q").rlike(PROFILE_PAIRS), _pair_terms(F.col("q"), PROFILE_PAIRS)).otherwise(none())
    rows = rows.withColumn("_pair", pair)
    test = [F.size("_pair") > 0, F.size("attributes") > 0, Q.any_of(low, PROFILE_ATTRIBUTE), Q.any_of(low, ["为什么", "受欢迎"]), Q.any_of(low, ["是谁", "是什么", "是啥", "介绍", "定义"])]
    kinds = ["entity_relation", "entity_attribute", "entity_attribute", "entity_reason", "entity_definition"]
    kind = F.coalesce(*(F.when(t, F.lit(k)) for t, k in zip(test, kinds)), F.lit("generic_factual"))
    names = F.flatten(F.transform(e, lambda x: F.regexp_extract_all(x, F.lit(r"(?U)\b[A-Z][A-Za-z0-9_-]*(?:\s+[A-Za-z][A-Za-z0-9_-]*)*"), F.lit(0))))
    wide = F.array_distinct(F.filter(F.transform(F.concat(e, names), lambda x: F.trim(x)), lambda x: x != ""))
    cleaned = one(Q.entity_text(reduce(lambda t, w: F.replace(t, F.lit(w), F.lit(" ")), PROFILE_CLEAN, F.col("q"))))
    asked = F.flatten(F.array(*(F.when(F.array_contains("attributes", n), F.array(*(F.lit(a.lower()) for a in v))).otherwise(none()) for n, v in Q.ALIASES.items())))
    words = {k: F.array(*map(F.lit, v)) for k, v in INTENTS.items()}
    choose = lambda values, other: reduce(lambda o, tv: F.when(tv[0], tv[1]).otherwise(o), reversed(list(zip(test, values))), other)
    rows = rows.withColumn("p_type", kind).withColumn("p_entities", choose([F.col("_pair"), e, cleaned, wide, wide], none()))
    return rows.withColumn("p_intents", choose([words["entity_relation"], F.array_distinct(asked), words["entity_attribute"], words["entity_reason"], words["entity_definition"]], none())).drop("_pair")


def support_query(rows: DataFrame) -> DataFrame:
    """rows of profiled questions with s_type, s_entities, s_attributes, s_ids and s_keywords: what evidence must cover."""
    q, low = F.col("q"), F.col("low")
    pair = F.when(q.rlike("(?iu)" + PAIRS), _pair_terms(q, PAIRS)).when(q.rlike("(?iu)" + BETWEEN), _pair_terms(q, BETWEEN)).otherwise(one(Q.entity_text(F.regexp_extract(q, SINGLE, 1))))
    flags = lambda c: "(?iuU)" if c else "(?U)"
    exact = F.concat(F.flatten(F.array(*(F.regexp_extract_all(q, F.lit(flags(c) + p), F.lit(g)) for p, g, c in EXACT))), F.when(F.contains(low, F.lit("docker compose down -v")), F.array(F.lit("docker compose down -v"))).otherwise(none()), F.when(Q.found(q, r"\bDepends\b"), F.array(F.lit("Depends"))).otherwise(none()))
    exact = F.filter(F.transform(exact, lambda x: F.regexp_replace(x, "^[` ]+|[` ]+$", "")), lambda x: x != "")
    own = Q.attributes_in(low, ALIASES)
    rows = rows.withColumn("_pair", pair).withColumn("s_ids", F.array_distinct(F.concat("ids", exact))).withColumn("s_attributes", F.array_distinct(F.concat("attributes", own)))
    left = Q.without(q, F.array(*map(F.lit, ATTRIBUTE_WORDS)))
    by_attribute = one(Q.entity_text(F.regexp_replace(left, "[?？。,.，]", " ")))
    by_reason = one(Q.entity_text(F.regexp_replace(q, "(?iu)" + REASON_WORDS, " ")))
    by_definition = one(Q.entity_text(F.regexp_replace(q, "(?iu)" + DEFINITION_WORDS, " ")))
    p = F.col("p_entities")
    by_profile = F.when(F.col("p_type") == "entity_attribute", by_attribute).when(F.col("p_type") == "entity_reason", by_reason).otherwise(by_definition)
    wide = (Q.intent(q) == "kb_overview") | Q.any_of(low, OVERVIEW)
    tests = [wide, (F.size("_pair") > 0) | (F.col("p_type") == "entity_relation"), F.size("s_ids") > 0, F.size("s_attributes") > 0, Q.any_of(low, ["为什么", "why ", "主要目的", "目的"]), F.col("p_type").isin("entity_definition", "entity_attribute", "entity_reason"), Q.any_of(low, ["是谁", "是什么", "what is", "介绍", "定义"])]
    kinds = [F.lit("overview"), F.lit("entity_relation"), F.lit("exact_technical"), F.lit("entity_attribute"), F.lit("entity_reason"), F.col("p_type"), F.lit("entity_definition")]
    who = [none(), first_filled(F.col("_pair"), p), p, first_filled(F.col("entities"), by_attribute, p), first_filled(by_reason, p), first_filled(by_profile, p), first_filled(p, by_definition)]
    choose = lambda values, other: reduce(lambda o, tv: F.when(tv[0], tv[1]).otherwise(o), reversed(list(zip(tests, values))), other)
    rows = rows.withColumn("s_type", choose(kinds, F.lit("generic_factual"))).withColumn("s_entities", choose(who, p)).withColumn("s_keywords", Q.keywords(q)).drop("_pair")
    # Identifiers count for technical questions alone, attributes for those, attribute questions and what a profile settled.
    return rows.withColumn("s_ids", F.when(F.col("s_type") == "exact_technical", F.col("s_ids")).otherwise(none())).withColumn("s_attributes", F.when(F.col("s_type").isin("exact_technical", "entity_attribute"), F.col("s_attributes")).otherwise(none()))


def _covered(entities: Column, c: Column) -> Column:
    return (F.size(entities) == 0) | F.exists(entities, lambda t: term_covered(t, c))


def _related(entities: Column, c: Column) -> Column:
    hits = F.size(F.filter(entities, lambda t: term_covered(t, c)))
    return F.when(F.size(entities) == 0, F.lit(True)).when(F.size(entities) == 1, hits >= 1).otherwise(hits >= 2)


def _any(text: Column, words: list[str]) -> Column:
    return Q.any_of(text, [w.lower() for w in words])


def _intent(kind: Column, cli: Column, keywords: Column, low: Column) -> Column:
    happens = Q.any_of(F.lower(F.array_join(keywords, " ")), ["影响", "发生什么", "what happens"])
    technical = F.when(cli, _any(low, CLI_ACTIONS)).when(happens, _any(low, ["remove", "delete", "preserve", "删除", "移除", "保留", "happens", "会"])).otherwise(F.lit(True))
    return F.when(kind == "entity_definition", _any(low, DEFINITION)).when(kind == "entity_reason", _any(low, REASON)).when(kind == "entity_relation", _any(low, RELATION)).when(kind == "exact_technical", technical).otherwise(F.lit(True))


def _technical_intent(kind: Column, cli: Column, keywords: Column, c: Column) -> Column:
    words, low = F.lower(F.array_join(keywords, " ")), c["low"]
    author = ["作者", "author", "created by", "maintainer"]
    return (
        F.when(_any(words, ["支持哪些值", "哪些值", "supported values", "valid values", "options"]), c["lists"])
        .when(_any(words, ["默认值", "default value", "default"]), _any(low, ["默认值", "default"]) & low.rlike(LITERAL))
        .when(_any(words, author), _any(low, author)).when(cli, _any(low, CLI_ACTIONS)).otherwise(_intent(kind, cli, keywords, low))
    )


def _cli_covered(ids: Column, c: Column) -> Column:
    return F.forall(ids, lambda x: F.rlike(c["low"], F.concat(F.lit("(?:^|[^a-z0-9_-])\\Q"), F.trim(F.lower(x)), F.lit("\\E(?:$|[^a-z0-9_-])"))))


def _markers(units: Column) -> Column:
    return F.array_distinct(F.transform(units, lambda u: u["marker"]))


def gate(rows: DataFrame) -> DataFrame:
    """Decisions for rows of support_query() with ev, their evidence in order: array of (marker, doc, scope, score, ctx, own).

    ctx is the prepared text with document and headings, own the one with headings alone; scope names the heading it is under.
    Adds answerable, reason, score, the signals, supporting and rejected markers and each requested attribute's evidence.
    """
    kind, ent, ids, att, kw, ev = (F.col(c) for c in ("s_type", "s_entities", "s_ids", "s_attributes", "s_keywords", "ev"))
    rows = rows.withColumn("cli", F.exists(ids, lambda x: F.lower(x).rlike(CLI_OPTION)))
    cli = F.col("cli")
    whole = lambda units, part: prepared(F.array_join(F.transform(units, lambda u: u[part]["text"]), "\n"))
    docs = F.array_distinct(F.transform(ev, lambda u: u["doc"]))
    scopes = F.array_distinct(F.filter(F.transform(ev, lambda u: F.struct(u["doc"].alias("doc"), u["scope"].alias("scope"))), lambda s: s["scope"] != ""))
    rows = rows.withColumn("all", whole(ev, "ctx")).withColumn("docs", F.transform(docs, lambda d: F.filter(ev, lambda u: u["doc"] == d)))
    rows = rows.withColumn("by_doc", F.transform("docs", lambda us: F.struct(us.alias("units"), whole(us, "own").alias("c"))))
    rows = rows.withColumn("by_scope", F.transform(scopes, lambda s: F.filter(F.col("ev"), lambda u: (u["doc"] == s["doc"]) & (u["scope"] == s["scope"]))))
    rows = rows.withColumn("by_scope", F.transform("by_scope", lambda us: F.struct(us.alias("units"), whole(us, "own").alias("c"))))
    c = F.col("all")

    def alone(u: Column) -> Column:
        """One unit supports the question by itself."""
        x, named = u["ctx"], (F.size(ent) == 0) | F.exists(ent, lambda t: term_covered(t, u["ctx"]))
        return (
            F.when(kind == "exact_technical", F.forall(ids, lambda i: identifier_covered(i, x)) & _intent(kind, cli, kw, x["low"]))
            .when(kind == "entity_attribute", named & F.forall(att, lambda a: attribute_in(a, x))).when(kind == "entity_reason", named & _any(x["low"], REASON))
            .when(kind == "entity_relation", _related(ent, x) & _any(x["low"], RELATION_EVIDENCE)).when(kind == "entity_definition", named & _any(x["low"], DEFINITION)).otherwise(x["text"] != "")
        )

    # Relations: by document, units with both sides and a word of relation; else a heading's units together.
    related = lambda u: _related(ent, u["own"]) & _any(u["own"]["low"], RELATION_EVIDENCE)
    per_doc = F.transform(F.col("docs"), lambda us: F.struct(F.filter(us, related).alias("direct"), F.filter(F.col("by_scope"), lambda s: (s["units"][0]["doc"] == us[0]["doc"]) & _related(ent, s["c"]) & F.exists(s["units"], lambda u: _any(u["own"]["low"], RELATION_EVIDENCE))).alias("scoped")))
    per_doc = F.filter(per_doc, lambda d: (F.size(d["direct"]) > 0) | (F.size(d["scoped"]) > 0))
    rows = rows.withColumn("_rel", per_doc)
    found = F.col("_rel")[0]
    relation_ids = F.when(F.size(ent) == 0, _markers(ev)).when(F.size("_rel") == 0, none()).when(F.size(found["direct"]) > 0, _markers(found["direct"])).otherwise(_markers(found["scoped"][0]["units"]))
    rows = rows.withColumn("relation_ids", F.when(kind == "entity_relation", relation_ids).otherwise(none()))
    relation = F.when(kind == "entity_relation", (F.size(ent) == 0) | (F.size("_rel") > 0)).otherwise(_related(ent, c))
    # Identifiers: a command in one unit, others in one document's units together.
    rows = rows.withColumn("_cli", F.filter(ev, lambda u: _cli_covered(ids, u["own"]))).withColumn("_docs", F.filter("by_doc", lambda d: F.forall(ids, lambda i: identifier_covered(i, d["c"]))))
    cli_hit = F.filter("_cli", lambda u: _technical_intent(kind, cli, kw, u["own"]))
    doc_hit = F.filter("_docs", lambda d: _technical_intent(kind, cli, kw, d["c"]))
    technical_ids = F.when(cli, F.when(F.size(cli_hit) > 0, F.array(cli_hit[0]["marker"])).otherwise(none())).otherwise(F.when(F.size(doc_hit) > 0, _markers(doc_hit[0]["units"])).otherwise(none()))
    rows = rows.withColumn("technical_ids", F.when(kind == "exact_technical", technical_ids).otherwise(none()))
    identifier = F.when(kind == "exact_technical", F.when(cli, F.size("_cli") > 0).otherwise(F.size("_docs") > 0)).otherwise(F.forall(ids, lambda i: identifier_covered(i, c)))
    # Attributes: each with the units that name it and the entity.
    mapped = F.transform(att, lambda a: F.struct(a.alias("attribute"), _markers(F.filter(ev, lambda u: attribute_in(a, u["own"]) & _covered(ent, u["own"]))).alias("units")))
    rows = rows.withColumn("mapped", mapped)
    attribute = F.forall("mapped", lambda m: F.size(m["units"]) > 0)
    long = F.filter(kw, lambda k: F.length(k) > 1)
    lexical = (F.size(long) == 0) | (F.size(F.filter(long, lambda k: F.contains(c["low"], F.lower(k)))) / F.greatest(F.size(long), F.lit(1)) >= 0.35)
    intent = F.when(kind == "exact_technical", F.size("technical_ids") > 0).when(kind == "entity_relation", F.size("relation_ids") > 0).otherwise(_intent(kind, F.lit(False), kw, c["low"]))
    rows = rows.withColumn("supporting", F.when((kind == "entity_relation") & (F.size("relation_ids") > 0), F.col("relation_ids")).when((kind == "exact_technical") & (F.size("technical_ids") > 0), F.col("technical_ids")).when(kind == "entity_attribute", F.array_distinct(F.flatten(F.transform("mapped", lambda m: m["units"])))).otherwise(_markers(F.filter(ev, alone))))
    signals = {"has_evidence": F.lit(True), "entity": _covered(ent, c), "intent": intent, "attribute": attribute, "identifier": identifier, "relation": relation, "lexical": lexical, "scored": F.coalesce(F.array_max(F.transform(ev, lambda u: u["score"])), F.lit(0.0)) >= 0.15}
    for name, value in signals.items():
        rows = rows.withColumn("g_" + name, value)
    s = lambda n: F.col("g_" + n)
    weak = ~s("intent") & ~s("lexical")
    reason = (
        F.when(F.size(ev) == 0, F.when(F.size(att) > 0, F.lit("missing_attribute_support")).otherwise(F.lit("no_evidence")))
        .when((kind == "overview") & (F.size("supporting") == 0), F.lit("insufficient_query_coverage"))
        .when((kind == "exact_technical") & ~s("identifier"), F.lit("missing_exact_identifier_support")).when((kind == "exact_technical") & ~s("intent"), F.lit("insufficient_query_coverage"))
        .when((kind == "entity_attribute") & (F.size(att) > 0) & (~s("attribute") | (F.size("supporting") == 0)), F.lit("missing_attribute_support"))
        .when((kind == "entity_reason") & weak, F.lit("missing_reason_support"))
        .when((kind == "entity_relation") & ~s("relation"), F.lit("missing_entity_support")).when((kind == "entity_relation") & ~s("intent"), F.lit("missing_relation_support"))
        .when((kind == "entity_definition") & (F.size(ent) > 0) & ~s("entity") & ~s("lexical"), F.lit("missing_entity_support")).when((kind == "entity_definition") & weak, F.lit("insufficient_query_coverage"))
        .otherwise(F.lit("supported"))
    )
    total = F.round(F.least(F.lit(1.0), reduce(lambda x, y: x + y, (F.when(s(n), F.lit(w)).otherwise(0.0) for n, w in WEIGHTS.items()))), 3)
    rows = rows.withColumn("reason", reason).withColumn("answerable", F.col("reason") == "supported")
    rows = rows.withColumn("support_score", F.when(F.size(ev) == 0, F.lit(0.0)).when(F.col("answerable"), total).otherwise(F.least(total, F.lit(0.49))))
    rows = rows.withColumn("rejected", F.array_except(_markers(ev), F.col("supporting")))
    return rows.drop("all", "docs", "by_doc", "by_scope", "_rel", "_cli", "_docs")


def evidence_lists(units: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(question_id, ev) from units (question_id, pos, marker, doc_id, document, section, path, locator, score, text): a question's few units in order. keep: columns of units that come along as final, in the same order."""
    heads = F.array_join(F.filter("path", lambda h: h.isNotNull() & (h != "")), " ")
    own = Q.spaced(F.concat_ws(" ", "text", "section", heads, F.when(F.lower("locator").startswith("section:"), F.col("locator"))))
    ctx = Q.spaced(F.concat_ws(" ", "text", "document", "section", heads, "locator"))
    scope = F.when(F.size("path") > 0, F.concat(F.lit("heading:"), F.lower(F.array_join("path", "/")))).when(F.trim("section") != "", F.concat(F.lit("section:"), F.lower(F.trim("section")))).when(F.lower(F.trim("locator")).startswith("section:"), F.lower(F.trim("locator"))).otherwise(F.lit(""))
    rows = units.select("question_id", F.struct("pos", "marker", F.col("doc_id").cast("string").alias("doc"), scope.alias("scope"), F.col("score").cast("double").alias("score"), ctx.alias("ctx"), own.alias("own")).alias("u"), *([F.struct("pos", *keep).alias("k")] if keep else []))
    lists = rows.groupBy("question_id").agg(*(F.array_sort(F.collect_list(c)).alias(c) for c in rows.columns[1:]))
    return lists.select("question_id", *([F.col("k").alias("final")] if keep else []), F.transform("u", lambda u: F.struct(u["marker"].alias("marker"), u["doc"].alias("doc"), u["scope"].alias("scope"), u["score"].alias("score"), prepared(u["ctx"]).alias("ctx"), prepared(u["own"]).alias("own"))).alias("ev"))


def policy(rows: DataFrame, reliable: Callable[[], Column] | None = None) -> DataFrame:
    """Outcome, reason and allowed markers of decided rows with final: array of (marker, unit_id, locator), their final evidence."""
    ready = F.filter("final", lambda e: e["unit_id"].isNotNull() & (F.coalesce(e["locator"], F.lit("")) != "") & (F.regexp_replace(F.coalesce(e["marker"], F.lit("")), "[^0-9]", "") != ""))
    context = F.lit(True) if reliable is None else reliable()
    reason = (
        F.when(~F.col("answerable"), F.lit("evidence_support_rejected")).when(F.size("final") == 0, F.lit("supported_without_final_evidence")).when(~context, F.lit("unreliable_retrieval_context"))
        .when(F.size(ready) == 0, F.lit("no_citation_ready_evidence")).when(F.size(ready) != F.size("final"), F.lit("final_evidence_not_citation_aligned")).otherwise(F.lit("supported"))
    )
    markers = F.array_distinct(F.transform(ready, lambda e: F.concat(F.lit("S"), F.regexp_replace(e["marker"], "[^0-9]", "").cast("long").cast("string"))))
    rows = rows.withColumn("policy_reason", reason).withColumn("outcome", F.when(F.col("policy_reason") == "supported", F.lit("answer")).otherwise(F.lit("refuse")))
    return rows.withColumn("allowed", F.when(F.col("outcome") == "answer", markers).otherwise(none()))


def refused(rows: DataFrame, why: Column, reason: str) -> DataFrame:
    """Decisions turned into refusals where ``why`` holds: no call, no citation asked for; the markers stay."""
    return rows.withColumn("policy_reason", F.when(why, F.lit(reason)).otherwise(F.col("policy_reason"))).withColumn("outcome", F.when(why, F.lit("refuse")).otherwise(F.col("outcome")))
