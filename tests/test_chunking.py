"""Golden cases of parsing, chunking and sentence spans."""
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from sparquill.operators import chunking as C

DOC = "# One\n\nIntro text\nmore\n\n- item a\n- item b\nName: value\n## Two\n| a | b |\n| 1 | 2 |\n\n```py\n# not a heading\n```\n### Three\nend"


def test_blocks():
    assert C.blocks(DOC) == [
        ("heading", 1, "One", "One"), ("text", 0, "One", "Intro text more"), ("list_item", 0, "One", "- item a"), ("list_item", 0, "One", "- item b"), ("field", 0, "One", "Name: value"),
        ("heading", 2, "One > Two", "Two"), ("table", 0, "One > Two", "| a | b |\n| 1 | 2 |"), ("code", 0, "One > Two", "# not a heading"), ("heading", 3, "One > Two > Three", "Three"), ("text", 0, "One > Two > Three", "end"),
    ]
    assert C.blocks("") == [] and C.blocks("```\nopen") == [("code", 0, "", "open")]


def test_sentences_keep_dots_of_tokens():
    text = "Version 3.14 of a.b works. Really?!\n\nNew “one.” Last"
    assert [s for _, _, s in C.sentences(text)] == ["Version 3.14 of a.b works.", "Really?!", "New “one.”", "Last"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab. \n?!，。“”1", max_size=200))
def test_spans_are_slices_in_order(text):
    at = 0
    for a, b, s in C.sentences(text):
        assert at <= a < b <= len(text) and text[a:b] == s and s == s.strip()
        at = b


def test_fixed_chunks_overlap_and_cover():
    rng = random.Random(0)
    text = " ".join("w" * rng.randint(1, 12) for _ in range(1500))
    parts = C.fixed_chunks(text)
    assert parts[0][0] == 0 and parts[-1][1] == len(text) and all(b - a <= 1200 for a, b, _ in parts)
    assert all(y[0] < x[1] and y[1] > x[1] for x, y in zip(parts, parts[1:]))
    assert C.fixed_chunks("short") == [(0, 5, "short")] and C.fixed_chunks(" ") == []
    assert len(C.fixed_chunks("x" * 5000)) == 5


def test_citation_units_bounds():
    text = "Tiny. " * 30 + "x" * 700 + ". End."
    units = C.citation_units(text)
    assert all(b - a <= 300 for a, b, _ in units) and units[0][2].startswith("Tiny.")


def test_legacy_chunks():
    assert C.legacy_chunks("a\n\nb") == ["a\n\nb"] and [len(c) for c in C.legacy_chunks("x" * 1200)] == [500, 500, 200]
    assert C.legacy_chunks("a" * 300 + "\n\n" + "b" * 300) == ["a" * 300, "b" * 300] and C.legacy_chunks("") == []


def test_block_aware_chunks_stay_in_sections():
    text = "# A\n" + "\n\n".join(["p " * 200] * 6) + "\n# B\nshort tail"
    got = C.block_aware_chunks(text)
    assert {p for p, _ in got} == {"A", "B"} and all(len(c) <= 1400 for _, c in got)


def test_exploded_skips_nulls(spark):
    df = spark.createDataFrame([(1, "a. b."), (2, None), (3, "")], "doc_id long, text string")
    got = C.exploded(df, C.sentences, "start_at int, end_at int, sentence string", ["start_at", "end_at", "sentence"]).orderBy("doc_id", "part").collect()
    assert [(r["doc_id"], r["part"], r["sentence"]) for r in got] == [(1, 0, "a."), (1, 1, "b.")]
