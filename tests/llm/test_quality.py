import re

import pytest
from sparquill.llm import quality as Q

GOOD = "The quick brown fox jumps over the lazy dog, and then it rests under a tree near the river until evening comes.\nAnother line follows here with more words."


def rejects(t):
    if t is None:
        return True
    blanks = t.count(" ") + t.count("\n")
    words, solid = blanks + 1, len(t) - blanks
    lines = t.split("\n")
    split = t.replace("\n", " ").split(" ")
    return (
        solid == 0
        or sum(t.count(s) for s in Q.SYMBOLS) > 0.1 * words
        or t.count("|") > 0.1 * words
        or t.count("!!") > 0.2 * words
        or (solid >= 20 and len(re.findall("[A-Z]", t)) > 0.4 * solid)
        or (solid >= 40 and len(re.findall(Q.NON_WORD + "|[0-9]", t)) > 0.6 * solid)
        or (words >= 30 and len(set(split)) < 2.0 * words**0.5)
        or (len(lines) >= 6 and len(lines) - len(set(lines)) > 0.5 * len(lines))
        or (solid > 0 and not 1.5 * words <= solid <= 25 * words)
        or "lorem ipsum" in t.lower()
    )


TEXTS = [GOOD, "", " ", "\n\n", None, "Short one.", "a | b | c | d", "SHOUT!! LOUD!! NOW!!", "x*** y%%% z&&& w$$$", "word " * 100, "\n".join(["same line here"] * 10), "9" * 80, "A" * 30 + " B", GOOD * 500, "Lorem ipsum dolor sit amet", "x" * 5000, "été à la plage avec des amis " + GOOD]


def test_matches_rules_one_by_one(make):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(0, GOOD), (None, GOOD)]
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["keep"]) for r in Q.judge(make(rows)).collect())
    assert got == sorted((i if i is not None else -1, not rejects(t)) for i, t in rows)


def test_passing_keeps_columns_and_clashing_names(make, spark):
    rows = [(1, GOOD, "en", "a", 3, "k", 1), (2, "", "en", None, None, None, None)]
    df = make(rows, "doc_id long, text string, lang string, source string, n_chars long, size string, words int")
    out = Q.passing(df)
    assert out.columns == df.columns and [r["doc_id"] for r in out.collect()] == [1]


def test_empty_table(make):
    assert Q.passing(make([])).count() == 0


def test_cascade_order_is_greedy_by_rejections_per_cost():
    assert Q.cascade_order(["a", "b", "c"], {"a": 1.0, "b": 1.0, "c": 10.0}, {0b001: 5, 0b011: 10, 0b010: 1, 0b100: 30, 0: 100}) == ["a", "c", "b"]


def test_rule_names_are_those_listed(spark):
    from pyspark.sql import functions as F

    assert list(Q.rules(F.lit(""), Q.sizes(F.lit("")))) == Q.RULES


@pytest.mark.parametrize("order", [Q.RULES, Q.RULES[::-1]])
def test_order_does_not_change_decisions(make, order):
    from pyspark.sql import functions as F

    df = make([(i, t) for i, t in enumerate(TEXTS)]).withColumn("r", Q.rejected_by(F.col("text"), order).isNotNull())
    assert all(r["r"] == rejects(r["text"]) for r in df.collect())
