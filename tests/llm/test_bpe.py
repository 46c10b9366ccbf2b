import os

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from sparquill.llm import bpe as B

pytestmark = pytest.mark.skipif(not os.path.exists(B.PATH), reason="no vocabulary file")
TEXTS = ["", "Hello world", "it's   \n\n\n we'll", " " * 3000, "ab" * 4000, "日本語🎉🎉  x 　y", "naïve café — “quotes”", "a1b2c3 4.5%", "\t\r\n x​", "<|endoftext|>"]


@pytest.fixture(scope="module")
def whole():
    return tiktoken.Encoding("t", pat_str=B.PATTERN, mergeable_ranks=B.codec().ranks, special_tokens={})


def test_ids_are_those_of_whole_texts(whole):
    assert B.codec().encode_batch(TEXTS) == [whole.encode_ordinary(t) for t in TEXTS]


@settings(max_examples=150, deadline=None)
@given(st.text())
def test_any_text_round_trips(text):
    text = text.encode("utf-8", "ignore").decode()
    c = B.codec()
    whole = tiktoken.Encoding("t", pat_str=B.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    ids = c.encode(text)
    assert ids == whole.encode_ordinary(text) and c.decode(ids) == text


def test_forgetting_changes_nothing(monkeypatch, whole):
    monkeypatch.setattr(B, "MEMORY", 3)
    c = B.Codec()
    assert [c.encode(t) for t in TEXTS * 2] == [whole.encode_ordinary(t) for t in TEXTS * 2]


def test_no_token_spans_a_certain_cut():
    import numpy as np

    c = B.codec()
    data = "Über 12 naïve cats' ###x\n\ny".encode()
    cuts = set(c.cuts(np.frombuffer(data, np.uint8)).tolist())
    assert cuts and all(data[k - 1 : k + 1] not in t for k in cuts for t in c.ranks)


def test_table(make):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100, None), (None, "x y"), (0, ""), (101, "word " * 50_000)]
    out = B.encode(make(rows), ["doc_id"]).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r["token_ids"] is None) == (r["doc_id"] == 100)
    assert sorted(r["decoded"] or "" for r in out) == sorted(t or "" for _, t in rows)
    back = B.decode(B.encode(make(rows), ["doc_id"]), ["doc_id"]).collect()
    assert sorted(r["text"] or "" for r in back) == sorted(t or "" for _, t in rows)
    assert B.encode(make([]), ["doc_id", "source"]).count() == 0
