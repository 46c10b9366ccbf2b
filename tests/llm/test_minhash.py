import random
import re

import numpy as np
import pytest
from sparquill.llm import minhash_dedup as M
from sparquill.llm.components import components
from sparquill.llm.shingles import shingles, word_hashes


def sets(text):
    w = re.findall("[0-9A-Za-z_\u0080-\U0010ffff]+", text.lower())
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def roots(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up if find(x) != x}


def brute(rows, t=M.THRESHOLD):
    own = [(d, sets(x)) for d, x in rows if d is not None and x]
    own = [(d, s) for d, s in own if s]
    return roots((a, b) for i, (a, s) in enumerate(own) for b, r in own[:i] if a != b and len(s & r) >= t * len(s | r))


def edited(rng, words, share):
    return " ".join(rng.choice(VOCABULARY) if rng.random() < share else w for w in words)


VOCABULARY = [f"w{i}é" for i in range(3000)]


def corpus(seed=3):
    rng = random.Random(seed)
    rows, passage = [], " ".join(rng.choice(VOCABULARY) for _ in range(55))
    for i in range(60):
        words = [rng.choice(VOCABULARY) for _ in range(rng.choice([4, 30, 120, 400]))]
        rows.append((len(rows), " ".join(words)))
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            rows.append((len(rows), edited(rng, words, rng.choice([0, 0.02, 0.03]))))
        if i % 6 == 0:
            rows.append((len(rows), passage + " " + " ".join(rng.choice(VOCABULARY) for _ in range(300))))
    base = [rng.choice(VOCABULARY) for _ in range(150)]
    rows += [(1000 + k, edited(rng, base, 0.02)) for k in range(60)]
    return rows


def test_groups_against_brute_force(make):
    rows = corpus()
    want = brute(rows)
    got = {r["doc_id"]: r["kept_id"] for r in M.duplicates(make(rows)).collect()}
    assert len(want) > 80 and len(set(got.items()) & set(want.items())) >= 0.97 * len(want)
    assert set(got) <= set(want)


def crowd(rng, first, size, share):
    """Texts that keep each word of one base text but for a share: pairs of a Jaccard of 0.5 to 0.7."""
    base = [rng.choice(VOCABULARY) for _ in range(300)]
    return [(first + k, edited(rng, base, share)) for k in range(size)]


def test_crowds_around_the_threshold(make):
    rng, rows = random.Random(17), []
    for c in range(12):
        rows += crowd(rng, 1000 * c, 40, 0.045 + 0.003 * (c % 4))
    want = brute(rows)
    got = {r["doc_id"]: r["kept_id"] for r in M.duplicates(make(rows)).collect()}
    lost = set(want) - set(got)
    assert len(want) > 60 and set(got) <= set(want)
    assert len(lost) <= 0.01 * len(want) and len(set(got.items()) & set(want.items())) >= 0.97 * len(want), (len(want), len(lost))


def test_edge_rows_and_columns(make):
    long = " ".join(VOCABULARY[i % 3000] for i in range(60_000))
    rows = [(1, "Same words, here now!"), (2, "same WORDS here now"), (2, "same WORDS here now"), (3, None), (4, ""), (5, "... !!"), (6, "--"), (None, "same words here now"), (7, long), (8, long + " end"), (9, "one"), (10, "One.")]
    df = make([(d, t, None, "s", 1, 5) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _gone_id int")
    assert {r["doc_id"]: r["kept_id"] for r in M.duplicates(df).collect()} == {2: 1, 8: 7, 10: 9}
    out = M.one_of_each(df)
    assert out.columns == df.columns
    assert sorted((r["doc_id"] or 0) for r in out.collect()) == [0, 1, 3, 4, 5, 6, 7, 9]


def test_empty_table(make):
    assert M.duplicates(make([])).count() == 0 and M.one_of_each(make([])).count() == 0


def test_beyond_the_broadcast_limit(make, monkeypatch):
    monkeypatch.setattr(M, "MAX_BROADCAST_IDS", 0)
    rows = corpus(5)[:60]
    assert {r["doc_id"] for r in M.duplicates(make(rows)).collect()} == set(brute(rows))


@pytest.mark.parametrize("jaccard", [0.3, 0.6, 0.9])
def test_estimates(jaccard):
    rng, errors = np.random.default_rng(1), []
    for _ in range(40):
        n = 600
        both = int(2 * n * jaccard / (1 + jaccard))
        h = rng.integers(0, 2**63, 2 * n).astype(np.uint64)
        a, b = h[:n], np.concatenate([h[:both], h[n : 2 * n - both]])
        sketch = M.registers(np.concatenate([a, b]), np.array([0, n, 2 * n]))
        errors.append(M.estimated(sketch[0], n, sketch[1], n) - jaccard)
    assert abs(np.mean(errors)) < 0.03


def test_registers_keep_zeros_and_mantissa():
    sketch = M.registers(np.array([12345], np.uint64), np.array([0, 1]))
    assert (sketch != 0).sum() == M.ROUNDS and M.registers(np.array([], np.uint64), np.array([0, 0])).sum() == 0
    assert 0 < M.expected_collisions(100, 100) < 2**-M.MANTISSA


def test_shingles_match_words():
    texts = ["a b c d", "", "A  b,c", "x", "é_1 b c a b c"]
    h, at = shingles(texts, 3)
    assert np.diff(at).tolist() == [2, 0, 1, 1, 4] and h[0] == h[2]
    w, wat = word_hashes(["b a", "a b"])
    assert w[0] == w[3] and w[1] == w[2]


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == roots([p for p in pairs if p[0] != p[1]])
