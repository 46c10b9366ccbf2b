import hashlib
import math
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F
from sparquill.functions import text as T
from sparquill.operators import evidence as E
from sparquill.operators import retrieval as R

TEXTS = ["Hello World 12", "naïve café", "中文 test", "", "   ", "A_b-C 3.14", "ÀÉ x"]


def test_tokens_like_python(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", T.tokens(F.col("t")).alias("x"))
    for r in df.collect():
        assert r["x"] == re.findall("[A-Za-z0-9]+|[一-鿿]", r["t"].lower())


@pytest.mark.parametrize("text,status", [("", "empty"), (None, "empty"), (" \n", "empty"), ("ab", "too_short"), ("a proper text", "valid"), ("!!!!!!!!!!!!!!!!ab", "garbled"), ("a\x01b\x02c\x03defgh", "garbled"), ("a\0bcdef", "binary_like")])
def test_quality(spark, text, status):
    assert spark.createDataFrame([(text,)], "t string").select(T.quality(F.col("t"))).first()[0] == status


def test_sanitized(spark):
    got = spark.createDataFrame([("a\r\nb\tc  d \n\n\n\n e\x07f ",)], "t string").select(T.sanitized(F.col("t"))).first()[0]
    assert got == "a\nb c d\n\nef"


def test_markdown_inline(spark):
    got = spark.createDataFrame([("> **bold** and `code` with [link](http://x) ~~gone~~ *it*",)], "t string").select(T.markdown_inline(F.col("t"))).first()[0]
    assert got == "bold and code with link gone it"


def test_lexical_formula(spark):
    docs = {1: "alpha beta gamma alpha", 2: "beta", 3: "nothing here", 4: "the alpha  beta pair"}
    queries = {10: "alpha beta", 11: "alpha alpha zeta"}
    got = {(r["query_id"], r["doc_id"]): r["lexical"] for r in R.lexical_scores(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(queries.items()), "query_id long, query string")).collect()}
    want = {}
    for q, query in queries.items():
        qt = query.split()
        for d, text in docs.items():
            dt = text.split()
            h = sum(min(qt.count(t), dt.count(t)) for t in set(qt))
            if h:
                want[q, d] = min(1, 0.55 * len(set(qt) & set(dt)) / len(set(qt)) + 0.3 * h / len(qt) + 0.15 * min(6 * h / min(len(dt), 300), 1) + (0.2 if query in re.sub(r"\s+", " ", text) else 0))
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)


def test_hashed_bow(spark):
    v = [0] * 128
    for t in ["a", "b", "a"]:
        h = hashlib.sha256(t.encode()).digest()
        v[int.from_bytes(h[:4], "big") % 128] += 1 if h[4] % 2 == 0 else -1
    size = math.sqrt(sum(x * x for x in v))
    got = {r["bucket"]: r["value"] for r in R.hashed_bow(spark.createDataFrame([(1, "a b A")], "doc_id long, text string"), "doc_id", "text").collect()}
    assert {k: round(x, 9) for k, x in got.items()} == {i: round(x / size, 9) for i, x in enumerate(v) if x}


def test_vector_neighbours_with_ties(spark):
    rows = [(i, [1.0, 0.0]) for i in range(5)] + [(9, [0.0, 1.0]), (10, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = R.vector_neighbours(df, df, "id", "v", 2).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in got][:4] == [(0, 1), (0, 2), (1, 0), (1, 2)] and 9 not in {r["query_id"] for r in got}


def _candidates(spark, rows):
    return spark.createDataFrame(pd.DataFrame(rows, columns=["query_id", "doc_id", "source", "text", "score"]))


def test_context_packing(spark):
    rows = [(1, 1, "a", "x " * 3000, 0.9), (1, 2, "a", "short one", 0.8), (1, 3, "b", "short one", 0.7), (1, 4, "c", "other", 0.6)]
    assert [r["doc_id"] for r in E.pack_context(_candidates(spark, rows)).collect()] == [1]
    rows[0] = (1, 1, "a", "first words", 0.9)
    assert [r["doc_id"] for r in E.pack_context(_candidates(spark, rows)).orderBy("position").collect()] == [1, 2, 4]


def test_diversity(spark):
    rows = [(1, 1, "a", "one two", 0.9), (1, 2, "a", "one two", 0.88), (1, 3, "b", "three", 0.8)]
    got = [(r["doc_id"], r["final"]) for r in E.diverse(_candidates(spark, rows)).orderBy("rank").collect()]
    assert got == [(1, 0.9), (3, 0.8), (2, 0.63)]


def test_markers():
    assert E.checked_markers("A [S1]. B [1, S2, S9] c [x]", ["S1", "S2"]) == ("A [S1]. B [S1][S2] c [x]", ["S1", "S2"], 1)
    assert E.checked_markers("none", []) == ("none", [], 0)


def test_lexical_arms_agree(spark, monkeypatch):
    """Postings, pruned postings and the join give the same best documents."""
    import random

    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for i in range(120)] + [(900, None)], "doc_id long, text string").repartition(3)
    queries = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(4))) for i in range(15)], "query_id long, query string")
    best = lambda df: sorted((r["query_id"], r["doc_id"], round(r["lexical"], 6)) for r in R.top_k(df.withColumn("lexical", F.round("lexical", 6)), 5, "lexical").collect())
    whole, pruned = best(R.lexical_scores(docs, queries)), best(R.lexical_scores(docs, queries, 5))
    monkeypatch.setattr(R, "MAX_BROADCAST_QUERIES", 3)
    assert whole == pruned == best(R.lexical_scores(docs, queries)) and len(whole) == 75


def test_keyword_scores(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "See app/main.py for details", "guide.md", "x"), (2, "nothing", None, None), (3, "MAIN and app", "main.txt", None)], "doc_id long, text string, name string, metadata string")
    queries = spark.createDataFrame([(7, "app/main.py"), (8, "??"), (9, "details guide")], "query_id long, query string")
    got = {(r["query_id"], r["doc_id"]): (r["keyword"], r["matched"]) for r in R.keyword_scores(docs, queries).collect()}
    # Terms of 7: app/main.py, app, main.py, main, app/main, py; the phrase, three technical terms. The name follows the text, so that 9 is a phrase.
    assert got[7, 1] == (1.4, 6) and got[7, 3] == (round(2 / 6 + 0.2, 6), 2) and got[9, 1] == (1.45, 2) and (7, 2) not in got and (8, 1) not in got
    monkeypatch.setattr(R, "MAX_BROADCAST_QUERIES", 1)
    assert {(r["query_id"], r["doc_id"]): (r["keyword"], r["matched"]) for r in R.keyword_scores(docs, queries).collect()} == got


def test_metadata_score(spark):
    rows = [("how is page 7 set up", "Set Up", ["Guide"], None, "pdf", 7), ("what", None, None, None, None, None), ("", "a", None, None, None, None)]
    df = spark.createDataFrame(rows, "query string, title string, headings array<string>, locator string, source_type string, page int")
    got = [r[0] for r in df.select(R.metadata_score(*(F.col(c) for c in df.columns))).collect()]
    assert [round(x, 6) for x in got] == [round(0.7 * 4 / 6 + 0.25 + 0.15, 6), 0.0, 0.0]


def test_snippets(spark):
    text = "A. " * 60 + "the needle is here, in the middle of it; " + "B. " * 100
    rows = spark.createDataFrame([("needle", text), ("absent", "short text"), ("zzz", text)], "query string, text string")
    got = [r["snippet"] for r in R.query_snippet(rows).collect()]
    assert "needle" in got[0] and got[0].startswith("...") and got[0].endswith("...") and len(got[0]) < 360 and got[1] == "short text" and got[2].startswith("A. A.")


def test_near_duplicate_lines_equal_the_bigram_rules_across_blocks(spark, monkeypatch):
    import itertools
    import random

    from pyspark.sql import functions as F
    from sparquill.functions import text as T
    from sparquill.operators import lines as L

    monkeypatch.setattr(L, "BLOCK", 7)
    r = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "团队知识库", "Ünder", "İdx", "K9", "x-y_z"]
    text = "\n".join(" ".join(r.choices(words, k=r.randint(0, 5))) for _ in range(60)) + "\n" + "ab" * 400 + "\n" + "ab" * 90 + "\r\n end of it all"
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string").select(F.posexplode(F.split("text", "\n")).alias("i", "l")).select("i", T.dedup_text(F.col("l")).alias("t")).collect()
    assert [x["t"] if len(x["t"]) >= 8 else "" for x in rows] == L.comparable(text)
    grams = {x["i"]: ({a + b for a, b in zip(x["t"], x["t"][1:])}, x["t"]) for x in rows if len(x["t"]) >= 8}

    def near(x, y):
        (a, s), (b, t) = grams[x], grams[y]
        n = len(a & b)
        return s == t or (s in t or t in s) and min(len(s), len(t)) / max(len(s), len(t)) >= 0.55 or n / len(a | b) >= 0.75 or n / min(len(a), len(b)) >= 0.75

    want = {(x, y) for x, y in itertools.combinations(grams, 2) if near(x, y)}
    got = [(int(x), int(y)) for i, j in L.alike(L.comparable(text)) for x, y in zip(i, j)]
    assert want and len(got) == len(want) and set(got) == want


def test_near_duplicate_lines_leave_no_pair_to_the_jvm(spark):
    from sparquill.operators import lines as L

    docs = spark.createDataFrame([(1, "one same line\nother\none same line"), (2, None), (3, "")], "doc_id long, text string")
    found = L.near_duplicates(docs)
    assert [tuple(x) for x in found.collect()] == [(1, 0, 2)]
    assert not any(w in found._jdf.queryExecution().optimizedPlan().toString() for w in ("Generate", "Exchange"))


def test_hybrid_arms_come_from_one_reading(spark):
    """What the three arms find one by one, ties and small tasks included, from one reading of the documents."""
    from pyspark.sql import functions as F
    from sparquill.operators import retrieval as R

    texts = ["alpha beta gamma", "Beta  beta 文件 delta", "", None, "alpha", "gamma_1 delta\nalpha beta gamma", "管理员 文件", "zzz"]
    docs = spark.createDataFrame([(i, texts[i % 8] if i % 3 else (texts[i % 8] or "") + f" n{i % 5}", f"f{i % 4}.txt", "en") for i in range(400)], "doc_id long, text string, name string, metadata string").repartition(3)
    queries = spark.createDataFrame([(1, "alpha beta gamma"), (2, "文件 delta"), (3, ""), (4, None), (5, "n3 gamma_1 f2.txt")], "query_id long, query string")
    got = R.hybrid_candidates(docs, queries, {"vector": 6, "lexical": 5, "keyword": 4})
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    lexical = R.top_k(R.lexical_scores(docs, queries).withColumn("lexical", F.round("lexical", 6)), 5, "lexical")
    vector = R.top_k(R.bow_scores(docs, queries).withColumn("vector", F.round("vector", 6)).where("vector > 0"), 6, "vector")
    keyword = R.top_k(R.keyword_scores(docs, queries), 4, "keyword")
    rows = got.collect()
    for arm, want in (("lexical", lexical), ("vector", vector), ("keyword", keyword)):
        assert {(r["query_id"], r["doc_id"], r[arm]) for r in rows if r[arm] is not None} == {(r["query_id"], r["doc_id"], r[arm]) for r in want.collect()}


def test_attributes_are_those_of_the_guarded_patterns(spark):
    from pyspark.sql import functions as F
    from sparquill.functions import questions as Q

    texts = ["the default value", "defaults to 1", "default-value", "x_default", "office", "officer", "1office", "éoffice", "在哪里office", "default \x01value", "city\n", "颜色 和 colour", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    guarded = F.array_compact(F.array(*(F.when(F.col("t").rlike(Q.guarded(a)), F.lit(n)) for n, a in Q.ALIASES.items())))
    got = Q.attributes_in(F.col("t"))
    assert "rlike" not in rows.select(got)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert all(r["a"] == r["b"] for r in rows.select(guarded.alias("a"), got.alias("b")).collect())
