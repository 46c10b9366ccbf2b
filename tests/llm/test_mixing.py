import hashlib
import random
from collections import defaultdict

import pytest
from sparquill.llm import mixing as X


def h(doc):
    return int(hashlib.md5(("" if doc is None else str(doc)).encode()).hexdigest()[:15], 16)


def words(t):
    return t.count(" ") + t.count("\n") + 1 if t else 0


def brute(rows, weights=None, budgets=X.BUDGETS):
    by = defaultdict(list)
    for doc, text, _, source, _ in rows:
        by[source].append((h(doc), words(text), doc))
    has = {s: sum(t for _, t, _ in d) for s, d in by.items()}
    w = {s: has[s] ** X.TEMPERATURE if weights is None else weights.get(s, 0) for s in by if has[s]}
    w = {s: x for s, x in w.items() if x > 0}
    best = {}
    for b in budgets:
        goal, low, high = b * X.SHARE * sum(has[s] for s in w), 0.0, 1e12
        for _ in range(300):  # bisection for the level at which all sources together give the goal
            level = (low + high) / 2
            low, high = (level, high) if sum(min(has[s], level * x) for s, x in w.items()) < goal else (low, level)
        for s, x in w.items():
            share = int(min(has[s], low * x) + 1e-6)
            for a, _, doc in by[s]:
                if sum(t for c, t, _ in by[s] if c <= a) <= share:
                    best[doc, s] = min(b, best.get((doc, s), 9))
    return best


def rows_of(seed=1, n=300):
    rng = random.Random(seed)
    return [(i, " ".join(["w"] * rng.randint(1, 40)), "en", rng.choice("aaab" + "c"), 1) for i in range(n)]


@pytest.mark.parametrize("weights", [None, {"a": 3, "b": 1}, {"a": 0.2, "b": 0.3, "c": 0.5, "none": 9}])
def test_against_brute_force(make, weights):
    rows = rows_of()
    got = {(r["doc_id"], r["source"]): r["budget"] for r in X.mix(make(rows), weights, out="budget").collect()}
    assert got == brute(rows, weights) and got


def test_nulls_ties_repeats_and_extremes(make):
    rows = rows_of(2, 80) + [(5, "x y z", "en", "a", 1)] * 3 + [(None, "q r", None, None, None), (None, "s", None, None, None), (900, None, None, "a", None), (901, "", None, "b", 0), (902, "v " * 50_000, "en", "c", 1)]
    got = {(r["doc_id"], r["source"]): r["budget"] for r in X.mix(make(rows), out="budget").collect()}
    assert got == brute(rows)


def test_columns_empty_table_and_no_tokens(make):
    df = make([(1, "a b", "en", "a", 1, 2, 3), (2, "a b", "en", "b", 1, 2, 3)], "doc_id long, text string, lang string, source string, n_chars long, h int, below int")
    assert X.mix(df).columns == df.columns and X.mix(make([(i, "a b", "en", "ab"[i % 2], 1, 2, 3) for i in range(10)], df.schema)).count() == 8
    assert X.mix(make([])).count() == 0
    assert X.mix(make([(1, "", "en", "a", 0)])).count() == 0  # no tokens: no source takes part
    with pytest.raises(ValueError):
        X.mix(df, out="H")


def test_a_small_source_gives_all_and_shrinks_nothing(make):
    rows = [(i, "w " * 19 + "w", "en", "big", 1) for i in range(100)] + [(1000, "w w", "en", "tiny", 1), (1001, "w", "en", None, 1)]
    got = X.mix(make(rows), {"big": 1, "tiny": 1}).collect()
    assert sum(r["source"] == "big" for r in got) == 79 and [r["doc_id"] for r in got if r["source"] == "tiny"] == [1000]


def test_beyond_the_broadcast_limit(make, monkeypatch):
    monkeypatch.setattr(X, "MAX_BROADCAST_ROWS", 0)
    rows = rows_of(4, 100)
    assert {(r["doc_id"], r["source"]): r["budget"] for r in X.mix(make(rows), out="budget").collect()} == brute(rows)
