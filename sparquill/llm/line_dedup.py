"""Line deduplication over a corpus with two Bloom filters.

A line that is equal to an earlier line of the corpus is removed. Occurrences are ordered by
(doc_id, the text's hash, line number), a null doc_id first; the first one stays.

1. Every task makes two Bloom filters of the 64-bit hashes of its lines: once-seen and
   twice-seen. They are made and merged by slice: what two tasks have both seen once counts as seen
   twice. Only compressed bit slices move here. A filter never misses a repeated line.
2. Lines in the twice-seen filter are suspected repeats. Only they shuffle, with their text:
   grouping by the text itself confirms repeats exactly and chooses each first occurrence.
3. Documents without suspects pass straight through; the others get the list of the suspects
   that stay.

The filters take BITS_PER_LINE bits a line, up to MAX_FILTER_BYTES each. Beyond that size they
fill up and suspect more lines, which then shuffle too: slower, the same result.

Defined results: blank lines always stay. Null and empty texts are unchanged. Rows of the same
doc_id and text are one document: each is rewritten in the same way. Documents all of whose lines
are removed get an empty text, or go with drop_emptied. Other columns pass through untouched.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparquill.llm.common import col, fresh, in_small_batches, lean, release, written
from sparquill.sources import table

BITS_PER_LINE = 16
MAX_FILTER_BYTES = 1 << 27
HASHES = 4
#: Lists of staying suspects are broadcast up to this many documents (some 100 MB); beyond it
#: Catalyst chooses the join, which then shuffles the documents with suspects.
MAX_BROADCAST_LISTS = 1_000_000
#: Bits in a slice of a filter: the slices are merged in parallel.
SLICE_BITS = 1 << 22


def line_hashes(text: str) -> tuple[list[str], np.ndarray]:
    """The lines of a text and the hash of each; 0 for a blank line."""
    lines = text.split("\n")
    digest = xxhash.xxh3_64_intdigest
    return lines, np.fromiter((digest(x) if x and not x.isspace() else 0 for x in lines), np.uint64, len(lines))


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """HASHES bit positions for each hash, by double hashing; bits is a power of two."""
    low, high = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
    return (low[:, None] + high[:, None] * np.arange(HASHES, dtype=np.uint64)[None, :]) & np.uint64(bits - 1)


def suspected(hashes: np.ndarray, twice: np.ndarray, bits: int) -> np.ndarray:
    """Which of the hashes the twice-seen filter may hold; never a blank line."""
    at = positions(hashes, bits)
    found = (twice[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
    return found.all(axis=1) & (hashes != 0)


def _local(bits: int):
    """Slices of a task's two filters."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [line_hashes(t)[1] for batch in batches for part in range(0, batch.num_rows, 512) for t in batch.column(0).slice(part, 512).to_pylist() if t]
        hashes, count = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
        some = hashes != 0
        once, twice = (np.unique(positions(h, bits)).astype(np.int64) for h in (hashes[some], hashes[some & (count > 1)]))
        pack, size = zstandard.ZstdCompressor(level=1), min(bits, SLICE_BITS)

        def packed(at: np.ndarray, k: int) -> bytes:
            own = np.zeros(size, bool)
            own[at[np.searchsorted(at, k * size) : np.searchsorted(at, (k + 1) * size)] - k * size] = True
            return pack.compress(np.packbits(own, bitorder="little").tobytes())

        for k in np.unique(once // size).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([packed(once, k)], pa.binary()), pa.array([packed(twice, k)], pa.binary())], ["k", "once", "twice"])

    return build


def _merge(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One twice-seen slice for each k; a k's rows are all in this task, next to each other."""
    unpack, pack = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
    now, once, twice = None, None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([pack.compress(twice.tobytes())], pa.binary())], ["k", "twice"])

    for batch in rows:
        for k, a, b in zip(*(batch.column(i).to_pylist() for i in range(3))):
            a, b = (np.frombuffer(unpack.decompress(x), np.uint8) for x in (a, b))
            if k != now:
                if now is not None:
                    yield done()
                now, once, twice = k, a.copy(), b.copy()
            else:
                twice |= b | (once & a)
                once |= a
    if now is not None:
        yield done()


def twice_filter(docs: DataFrame, text_col: str) -> tuple[Broadcast, int]:
    """The broadcast twice-seen filter, packed, and its bits."""
    text = col(text_col)
    lines = docs.agg(F.sum((F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long"))).first()[0] or 1
    bits = 1 << max(10, min(8 * MAX_FILTER_BYTES, BITS_PER_LINE * lines) - 1).bit_length()
    bits = min(bits, 8 * MAX_FILTER_BYTES)
    slices = docs.select(text.alias("t")).mapInArrow(lean(_local(bits)), "k int, once binary, twice binary")
    merged = slices.repartition("k").sortWithinPartitions("k").mapInArrow(lean(_merge), "k int, twice binary").collect()
    size, unpack = min(bits, SLICE_BITS) // 8, zstandard.ZstdDecompressor()
    twice = np.zeros(bits // 8, np.uint8)
    for k, packed in merged:
        twice[k * size : (k + 1) * size] = np.frombuffer(unpack.decompress(packed), np.uint8)
    return docs.sparkSession.sparkContext.broadcast(twice), bits


def _suspect_lines(twice: Broadcast, bits: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, 512) for whole in batches for i in range(0, whole.num_rows, 512)):
            ids, keys, at, found = [], [], [], []
            for doc, key, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if text:
                    lines, hashes = line_hashes(text)
                    for i in np.flatnonzero(suspected(hashes, twice.value, bits)):
                        ids.append(doc), keys.append(key), at.append(int(i)), found.append(lines[i])
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(keys, pa.int64()), pa.array(at, pa.int32()), pa.array(found, pa.string())], ["doc", "key", "at", "line"])

    return find


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", drop_emptied: bool = False) -> DataFrame:
    """docs without the lines that repeat earlier ones; chars_col, if docs has it, is counted anew."""
    twice, bits = twice_filter(in_small_batches(docs), text_col)
    doc_type = docs.schema[id_col].dataType.simpleString()
    key = F.xxhash64(col(text_col))
    suspects = docs.select(col(id_col).alias("doc"), key.alias("key"), col(text_col).alias("text")).where(F.contains(F.col("text"), F.lit("\n")) | (F.length("text") > 0))
    suspects = suspects.mapInArrow(lean(_suspect_lines(twice, bits)), f"doc {doc_type}, key long, at int, line string")
    first = suspects.groupBy("line").agg(F.min(F.struct("doc", "key", "at")).alias("f"))
    stays = written(first.groupBy(F.col("f.doc").alias("doc"), F.col("f.key").alias("key")).agg(F.collect_set("f.at").alias("at")), "line-firsts")

    @F.pandas_udf(T.BooleanType())
    def has_suspect(texts: pd.Series) -> pd.Series:
        return pd.Series([bool(t) and bool(suspected(line_hashes(t)[1], twice.value, bits).any()) for t in texts], dtype=bool)

    @F.pandas_udf(T.StringType())
    def rewrite(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        def one(text: str | None, at) -> str | None:
            if not text:
                return text
            lines, hashes = line_hashes(text)
            gone = suspected(hashes, twice.value, bits)
            if at is not None:
                gone[np.asarray(at, np.int64)] = False
            return text if not gone.any() else "\n".join(x for x, g in zip(lines, gone) if not g)

        for texts, keep in batches:
            yield pd.Series([one(t, a) for t, a in zip(texts, keep)], dtype=object)
        release()

    few = stays.count() <= MAX_BROADCAST_LISTS
    flag, new, doc, own, at = (fresh(docs, x) for x in ("_suspect", "_new_text", "_stays_doc", "_stays_key", "_stays_at"))
    stays = stays.select(F.col("doc").alias(doc), F.col("key").alias(own), F.col("at").alias(at))
    same = col(id_col).eqNullSafe(col(doc)) & (key == col(own))
    untouched = None
    if few:
        touched = docs.join(F.broadcast(stays), same, "left")
    else:
        rows = docs.withColumn(flag, has_suspect(col(text_col)))
        untouched = rows.where(~col(flag)).select(*(col(c) for c in docs.columns))
        touched = rows.where(col(flag)).join(stays, same, "left")
    touched = touched.withColumn(new, rewrite(col(text_col), col(at)))
    if drop_emptied:
        touched = touched.where(col(new).isNull() | (col(new) != "") | (col(text_col) == ""))
    out = []
    for c in docs.columns:
        if c == text_col:
            out.append(col(new).alias(c))
        elif chars_col and c == chars_col:
            out.append(F.when(col(text_col) == col(new), col(c)).otherwise(F.length(col(new))).cast(docs.schema[c].dataType).alias(c))
        else:
            out.append(col(c))
    touched = touched.select(*out)
    return touched if untouched is None else untouched.unionAll(touched)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), chars_col=None)


ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents WHERE text <> ''
), ranked AS (
  SELECT doc_id, i, line, regexp_full_match(line, '\s*') OR row_number() OVER (PARTITION BY line ORDER BY doc_id, i) = 1 AS stays FROM lines
), kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM ranked WHERE stays GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN kept k USING (doc_id)
"""
