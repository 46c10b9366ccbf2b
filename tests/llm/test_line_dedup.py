import random

import numpy as np
from sparquill.llm import line_dedup as L


def brute(rows):
    seen, out = {}, {}
    for doc, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        if not text:
            continue
        for i, line in enumerate(text.split("\n")):
            if line and not line.isspace():
                seen.setdefault(line, (doc, i))
    for doc, text in set(rows):
        keep = [x for i, x in enumerate(text.split("\n")) if not x or x.isspace() or seen[x] == (doc, i)] if text else None
        out[doc] = text if not text else "\n".join(keep)
    return out


def test_whole_fixture_against_brute_force(make):
    rng = random.Random(1)
    pool = [f"line number {i} of the pool" for i in range(60)] + ["", " ", "hot line"] * 3
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 9)))) for i in range(150)]
    rows += [(1000, None), (1001, ""), (None, "only with a null id\nhot line"), (1002, "long " * 100_000 + "\nhot line")]
    got = {r["doc_id"]: r["text"] for r in L.dedup_lines(make(rows)).collect()}
    assert got == brute(rows)


def test_repeated_rows_are_rewritten_alike(make):
    rows = [(1, "a b\nc d"), (1, "a b\nc d"), (2, "c d\ne f")]
    got = sorted((r["doc_id"], r["text"], r["n_chars"]) for r in L.dedup_lines(make(rows)).collect())
    assert got == [(1, "a b\nc d", 7), (1, "a b\nc d", 7), (2, "e f", 3)]


def test_emptied_documents_and_clashing_columns(make):
    rows = [(1, "a b", "en", "s", 3, "x", "y"), (2, "a b", "en", "s", 3, "x", "y"), (3, None, None, None, None, None, None)]
    df = make(rows, "doc_id long, text string, lang string, source string, n_chars long, line string, _suspect string")
    out = L.dedup_lines(df, drop_emptied=True)
    assert out.columns == df.columns and sorted(r["doc_id"] for r in out.collect()) == [1, 3]
    assert {r["doc_id"]: r["text"] for r in L.dedup_lines(df).collect()} == {1: "a b", 2: "", 3: None}


def test_empty_table(make):
    assert L.dedup_lines(make([])).count() == 0


def test_a_full_filter_only_suspects_more(make, monkeypatch):
    monkeypatch.setattr(L, "MAX_FILTER_BYTES", 16)
    monkeypatch.setattr(L, "MAX_BROADCAST_LISTS", 0)
    rows = [(i, f"own {i}\nshared {i % 7}\nother {i}") for i in range(80)]
    assert {r["doc_id"]: r["text"] for r in L.dedup_lines(make(rows)).collect()} == brute(rows)


def test_filter_never_misses():
    h = np.random.default_rng(0).integers(1, 2**63, 500).astype(np.uint64)
    bits = 1 << 12
    twice = np.zeros(bits // 8, np.uint8)
    at = L.positions(h, bits).ravel()
    np.bitwise_or.at(twice, (at >> np.uint64(3)).astype(int), (1 << (at & np.uint64(7)).astype(int)).astype(np.uint8))
    assert L.suspected(h, twice, bits).all() and not L.suspected(np.zeros(3, np.uint64), twice, bits).any()
