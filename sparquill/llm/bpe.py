"""Byte-pair encoding and decoding with forced-boundary splitting.

A pair of neighbouring bytes that occurs inside no token of the vocabulary can never be merged
over: it marks a certain cut. A text is first taken apart by the vocabulary's word pattern, then
each piece at its certain cuts. The fragments are encoded independently of each other and their
ids concatenated; equal fragments, very frequent in any language, are encoded once a
task's memory. The ids are those of encoding the whole text at once, and decoding gives the text back.

Merges inside a fragment follow the ranks of the vocabulary file (tiktoken's merge of one piece); it is read by every worker from
``path`` (a parameter; the file is not part of this repository and no vocabulary is trained).

Defined results: null gives null, an empty text an empty list. Equal rows are encoded alike.
"""
from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from sparquill.llm.common import col, in_small_batches, lean
from sparquill.sources import table

PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces and fragments that a task remembers; then it forgets all and goes on.
MEMORY = 50_000


class Codec:
    """A vocabulary of byte tokens with ranks."""

    def __init__(self, path: str = PATH, pattern: str = PATTERN):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.shared = {i: i for i in self.tokens}  # one number object an id, however many lists hold it
        self.inside = np.zeros(1 << 16, bool)
        for t in self.ranks:
            for a, b in zip(t, t[1:]):
                self.inside[a << 8 | b] = True
        self.pieces = regex.compile(pattern).findall
        self.merge = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})._core_bpe.encode_single_piece
        self.known: dict[str, list[int]] = {}
        self.fragments: dict[bytes, list[int]] = {}

    def cuts(self, flat: np.ndarray) -> np.ndarray:
        """Offsets at which bytes must be cut: no token holds the bytes on both sides."""
        pair = flat[:-1].astype(np.uint16) << np.uint16(8) | flat[1:]
        return np.flatnonzero(~self.inside[pair]) + 1

    def learn(self, pieces: list[str]) -> None:
        """Encode pieces by their fragments, and remember them and the fragments."""
        data = [p.encode() for p in pieces]
        joined = b"".join(data)
        ends = np.cumsum([len(d) for d in data])
        at = np.union1d(self.cuts(np.frombuffer(joined, np.uint8)), np.concatenate([[0], ends]))
        bounds = at.tolist()
        parts = [joined[a:b] for a, b in zip(bounds, bounds[1:])]
        known, merge = self.fragments, self.merge
        for f in set(parts) - known.keys():
            known[f] = [*map(self.shared.__getitem__, merge(f))]
        first = [0, *np.searchsorted(at, ends).tolist()]
        for p, i, j in zip(pieces, first, first[1:]):
            self.known[p] = known[parts[i]] if j == i + 1 else [x for f in parts[i:j] for x in known[f]]

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text."""
        pieces = [self.pieces(t) for t in texts]
        new = set().union(*pieces) - self.known.keys()
        if len(self.known) + len(new) > MEMORY or len(self.fragments) > MEMORY:
            self.known.clear()
            self.fragments.clear()
            new = set().union(*pieces)
        if new:
            self.learn(list(new))
        ids = self.known.__getitem__
        return [list(chain.from_iterable(map(ids, p))) for p in pieces]

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0]

    def decode(self, ids) -> str:
        return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", "replace")


def codec(path: str = PATH, pattern: str = PATTERN) -> Codec:
    """A codec of a vocabulary file. A task makes its own: idle workers, which live on beside later stages, hold none."""
    return Codec(path, pattern)


def _lists(rows: list[list[int] | None]) -> pa.ListArray:
    ends = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) if r is not None else 0 for r in rows], out=ends[1:])
    flat = np.concatenate([np.asarray(r, np.int32) for r in rows if r is not None] or [np.zeros(0, np.int32)])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=pa.array([r is None for r in rows]))


def _encode(path: str, pattern: str, rows: int = 256):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                texts = batch.column(batch.num_columns - 1).to_pylist()
                ids = [None if t is None else x for t, x in zip(texts, c.encode_batch([t or "" for t in texts]))]
                counts = pa.array([None if x is None else len(x) for x in ids], pa.int32())
                back = pa.array([None if x is None else c.decode(x) for x in ids], pa.string())
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns - 1)), _lists(ids), counts, back], [*batch.schema.names[:-1], "token_ids", "n_tokens", "decoded"])

    return run


def encode(docs: DataFrame, keep: list[str], text_col: str = "text", path: str = PATH, pattern: str = PATTERN) -> DataFrame:
    """The columns ``keep`` of docs with token_ids, n_tokens and the text decoded from the ids."""
    rows = in_small_batches(docs).select(*(col(c) for c in keep), col(text_col).alias("_bpe_text"))
    kinds = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(lean(_encode(path, pattern)), f"{kinds}{', ' if kinds else ''}token_ids array<int>, n_tokens int, decoded string")


def decode(rows: DataFrame, keep: list[str], ids_col: str = "token_ids", path: str = PATH, pattern: str = PATTERN) -> DataFrame:
    """The columns ``keep`` of rows with the text of their ids; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            last = batch.num_columns - 1
            texts = pa.array([None if x is None else c.decode(x) for x in batch.column(last).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(last)), texts], [*batch.schema.names[:-1], "text"])

    picked = rows.select(*(col(c) for c in keep), col(ids_col).alias("_bpe_ids"))
    kinds = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])
    return picked.mapInArrow(lean(run), f"{kinds}{', ' if kinds else ''}text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), ["doc_id"])
