"""Near-duplicate lines inside a document: character bigrams of all its lines against each other, as products of 0/1 matrices."""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Lines of a block; with the 319 bigrams that a line has at most, a block's matrix stays below 21 MB.
BLOCK = 128
SHARE = 0.75
#: Pairs that a task hands out at once.
HELD = 1 << 20


_OTHER = re.compile("[^0-9a-z\u4e00-\u9fff]+")


def comparable(text: str) -> list[str]:
    """dedup_text() of a text's lines in order; "" for a line of less than 8 characters, which is compared with none."""
    short = (_OTHER.sub("", line.lower())[:320] for line in text.split("\n"))
    return [t if len(t) >= 8 else "" for t in short]


def alike(lines: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(line, other) of the lines of which the one with fewer different bigrams shares three quarters of them.

    Equal and contained lines are among these, as all bigrams of the shorter are the longer's; so are those of a Jaccard
    similarity of three quarters, which is never more than this share.
    """
    at = np.array([i for i, t in enumerate(lines) if t], np.int64)
    if len(at) < 2:
        return
    texts = [lines[i] for i in at]
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(at)), [len(t) for t in texts])
    same = row[1:] == row[:-1]
    # Compared characters are ASCII or CJK, all below 2 ** 16.
    key = np.unique((row[:-1] << 32 | codes[:-1] << 16 | codes[1:])[same])
    row, gram = key >> 32, key & 0xFFFFFFFF
    first = np.searchsorted(row, np.arange(0, len(at) + BLOCK, BLOCK))
    size = np.bincount(row, minlength=len(at))
    for a in range(0, len(at), BLOCK):
        here = slice(first[a // BLOCK], first[a // BLOCK + 1])
        words, place = np.unique(gram[here], return_inverse=True)
        x = np.zeros((min(BLOCK, len(at) - a), len(words)), np.float32)
        x[row[here] - a, place] = 1
        for b in range(a, len(at), BLOCK):
            y = x
            if b > a:
                there = slice(first[b // BLOCK], first[b // BLOCK + 1])
                place = np.minimum(np.searchsorted(words, gram[there]), len(words) - 1)
                known = words[place] == gram[there]
                y = np.zeros((min(BLOCK, len(at) - b), len(words)), np.float32)
                y[(row[there] - b)[known], place[known]] = 1
            least = np.minimum(size[a : a + len(x), None], size[None, b : b + len(y)])
            hit = x @ y.T >= SHARE * least
            i, j = np.nonzero(np.triu(hit, 1) if a == b else hit)
            if len(i):
                yield at[a + i], at[b + j]


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, line, other), line < other: the alike() lines of each document (doc_id, text), without a shuffle."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "line", "other"]
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            found, held = [], 0

            def out() -> pa.RecordBatch:
                d, i, j = (np.concatenate(x) for x in zip(*found))
                return pa.RecordBatch.from_arrays([ids.take(pa.array(d)), pa.array(i, pa.int32()), pa.array(j, pa.int32())], names)

            for d in range(len(texts)):
                for i, j in alike(comparable(texts[d].as_py() or "")):
                    found.append((np.full(len(i), d), i, j))
                    held += len(i)
                    if held > HELD:
                        yield out()
                        found, held = [], 0
            if found:
                yield out()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, line int, other int")
