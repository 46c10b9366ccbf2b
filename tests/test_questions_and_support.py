"""Routing, question analysis, units and the support gate on small cases with CJK and identifiers."""
import pytest
from pyspark.sql import functions as F
from sparquill.functions import questions as Q
from sparquill.operators import support as S
from sparquill.operators import units as U
from sparquill.plans.questions import analysed

ROUTED = {
    "总结一下这个知识库": "overview", "list all parts please": "overview", "Redis 和 Kafka 是什么关系": "graph_vector_mix", "Alpha depends on Beta": "graph_vector_mix", "这个权限有什么作用": "chunk_only", "它有什么特点": "chunk_only",
    "where is MAX_SIZE set": "hybrid_text", "GET /api/v1/users returns 404": "hybrid_text", "run docker compose up": "hybrid_text", "what is the weather": "chunk_only", "read app/core/config.py": "hybrid_text", "": "chunk_only",
}


def test_routes(spark):
    df = spark.createDataFrame([(q,) for q in ROUTED], "q string").select("q", Q.route(F.col("q"))["mode"].alias("m"))
    assert {r["q"]: r["m"] for r in df.collect()} == ROUTED


def test_analysis(spark):
    rows = [("Aurora 的办公地点在哪里？",), ("What is the default value of `MAX_SIZE` in settings.py?",), ("Why does Aurora need caching",), ("where is x configured in 配置哪里",), ("Alpha 和 Beta 有什么关系？",), (None,)]
    got = [(r["kind"], list(r["attributes"]), list(r["ids"]), list(r["entities"])) for r in analysed(spark.createDataFrame(rows, "question string")).collect()]
    assert got[0][0] == "entity_attribute" and got[0][1] == ["location"] and got[0][3] == ["Aurora"]
    assert got[1][0] == "exact_technical" and got[1][2] == ["MAX_SIZE", "settings.py"] and "default_value" in got[1][1]
    assert got[2][0] == "entity_reason" and got[4][0] == "entity_relation" and got[4][3] == ["Alpha", "Beta"] and "location" not in got[3][1]
    assert got[5] == ("generic_factual", [], [], [])


def test_terms_in_order(spark):
    got = spark.createDataFrame([("Read app/core/config.py 中文",)], "q string").select(Q.terms(F.col("q"))).first()[0]
    assert got == ["read", "app/core/config.py", "app", "core", "config.py", "config", "app/core/config", "py", "中文", "中", "文"]


@pytest.mark.parametrize("term,text,covered", [("Aurora", "the AURORA team", True), ("max_size", "maxSize limits", True), ("policies", "one policy", True), ("类", "two classes", True), ("Beta", "alpha only", False)])
def test_terms_covered(spark, term, text, covered):
    df = spark.createDataFrame([(term, text)], "t string, x string")
    assert df.select(S.term_covered(F.col("t"), S.prepared(F.col("x")))).first()[0] is covered


@pytest.mark.parametrize("name,text,covered", [("MAX_SIZE", "MAX_SIZE is 3", True), ("MAX_SIZE", "MIN_SIZE is 3", False), ("max_size", "the max size", True), ("run()", "call run now", True)])
def test_identifiers_covered(spark, name, text, covered):
    df = spark.createDataFrame([(name, text)], "t string, x string")
    assert df.select(S.identifier_covered(F.col("t"), S.prepared(F.col("x")))).first()[0] is covered


def test_local_context_and_headings(spark):
    chunk = "# One\nalpha\n## Two\nbeta comes first.\ngamma is asked."
    df = spark.createDataFrame([(chunk, "gamma is asked."), (chunk, "not there at all")], "c string, u string").select(U.local_context(F.col("c"), F.col("u")))
    assert [r[0] for r in df.collect()] == ["## Two beta comes first.", None]
    heads = ["Aurora Labs", "Configuration Details", "summary", "王小明", "one"]
    got = spark.createDataFrame([(h,) for h in heads], "h string").select(U.entity_heading(F.col("h")))
    assert [r[0] for r in got.collect()] == [True, False, False, True, False]


def gate(spark, question, units):
    q = S.support_query(S.profile(analysed(spark.createDataFrame([(1, question)], "question_id int, question string"))))
    rows = [(1, i, f"S{i}", d, "doc", h, [h] if h else [], f"section:{h}" if h else None, s, t) for i, (d, h, s, t) in enumerate(units, 1)]
    e = S.evidence_lists(spark.createDataFrame(rows, "question_id int, pos int, marker string, doc_id long, document string, section string, path array<string>, locator string, score double, text string"))
    empty = F.array().cast(e.schema["ev"].dataType)
    return S.gate(q.join(e, "question_id", "left").withColumn("ev", F.coalesce("ev", empty))).first()


def test_gate(spark):
    r = gate(spark, "Aurora 的办公地点在哪里？", [(1, "Aurora", 0.5, "办公地点在上海"), (1, "Borealis", 0.4, "办公地点在北京")])
    assert r["answerable"] and list(r["supporting"]) == ["S1"] and r["support_score"] == 1.0
    r = gate(spark, "Aurora 的重量是多少？", [(1, "Aurora", 0.5, "办公地点在上海")])
    assert not r["answerable"] and r["reason"] == "missing_attribute_support" and r["support_score"] <= 0.49
    r = gate(spark, "Alpha 和 Beta 是什么关系？", [(1, "Team", 0.5, "Alpha is new."), (1, "Team", 0.5, "It depends on Beta."), (2, "Other", 0.5, "Beta alone")])
    assert r["answerable"] and list(r["supporting"]) == ["S1", "S2"]
    r = gate(spark, "docker compose down -v 会影响什么？", [(1, "CLI", 0.5, "docker compose down -v"), (1, "CLI", 0.5, "docker compose down -v removes volumes")])
    assert r["answerable"] and list(r["supporting"]) == ["S2"]
    r = gate(spark, "what is MAX_SIZE", [(1, "CLI", 0.5, "MIN_SIZE is 4")])
    assert r["reason"] == "missing_exact_identifier_support"
    r = gate(spark, "anything", [])
    assert r["reason"] == "no_evidence" and r["support_score"] == 0.0


def test_columns_as_text_equal_pyspark(spark):
    from pyspark.sql import functions as P
    from sparquill.functions import columns as T

    def made(F):
        c = F.col("s")
        step = lambda a, x: F.struct((a["n"] + x["k"]).alias("n"), F.concat(a["t"], x["t"]).alias("t"))
        return {
            "lit": F.concat(F.lit("it's \\d \n`"), c), "re": F.regexp_replace(c, r"(\w+)'(?:s|$)\\?", "<$1>"), "in": c.isin("a", "it's") | ~c.rlike(r"^\w"), "case": F.when(c == "b", 1).when(c.isNull(), -2).otherwise(3), "open": F.when(c == "b", F.lit(0.5) - F.size("xs") / 2),
            "nested": F.transform("xs", lambda x, i: F.struct(x["k"].alias("k"), i.alias("i"), F.filter("xs", lambda y: y["k"] > x["k"]).alias("more"))), "fold": F.aggregate("xs", F.struct(F.lit(0).cast("bigint").alias("n"), F.lit("").alias("t")), step),
            "mixed": F.transform("xs", lambda x: P.concat(x["t"], P.lit("!"))), "split": F.split(c, "[' ]")[0], "null": F.coalesce(F.lit(None).cast("string"), F.lit("${x}")), "struct": F.struct("s", F.col("xs")[0]["t"].alias("t")),
        }

    rows = spark.createDataFrame([("it's", [(1, "p"), (5, "q")]), ("b", [(2, "r")]), (None, [(3, "z")])], "s string, xs array<struct<k: bigint, t: string>>")
    want, got = (rows.select(*(c.alias(n) for n, c in made(F).items())) for F in (P, T))
    assert got.dtypes == want.dtypes
    assert got.collect() == want.collect()


def test_plan_asks_the_jvm_little(spark, monkeypatch):
    from py4j.clientserver import JavaClient
    from sparquill.operators import support

    rows = spark.createDataFrame([("What is A?", "what is a?", ["color"], ["A"])], "q string, low string, attributes array<string>, entities array<string>")
    asked, send = [], JavaClient.send_command
    monkeypatch.setattr(JavaClient, "send_command", lambda self, *args, **more: asked.append(1) or send(self, *args, **more))
    support.profile(rows)
    assert len(asked) < 1000


def test_context_before_a_unit(spark):
    from pyspark.sql import functions as F
    from sparquill.operators import units

    chunk = "# One\nfirst line\n# Two\n" + "word " * 100 + "\nthe unit here"
    rows = spark.createDataFrame([("# One\nfirst line\nthe unit", "the unit"), (chunk, "the unit here"), ("other", "the unit"), ("the unit", "the unit")], "chunk string, unit string")
    got = [r[0] for r in rows.select(units.local_context(F.col("chunk"), F.col("unit"))).collect()]
    assert got[0] == "# One first line" and got[1].startswith("# Two word") and got[1].endswith("...") and len(got[1]) <= 400 and got[2:] == [None, ""]
