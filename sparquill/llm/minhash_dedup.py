"""Near-duplicate groups by HyperMinHash registers.

1. Documents of the same words are one node: its number is their least id.
2. A node's sketch has ROUNDS x BUCKETS registers. In every round each shingle of SHINGLE words
   falls into a bucket by the first bits of a hash; the register keeps the least remaining bits,
   compressed to their count of leading zeros (6 bits) and the MANTISSA bits that follow.
3. ROWS registers make a band. Nodes with an equal band are candidates; bands without a filled
   register don't count. Only (band, node) pairs shuffle; sketches follow for bands that meet.
4. Within a band the share of equal registers, less the collisions expected by chance, estimates
   the Jaccard similarity. Nodes that are safely above the threshold are linked by a spanning
   forest, grown from one pivot after another, so that a band of n copies yields n - 1 links and
   not n * n / 2. Each remaining node is linked to the node it is most similar to.
5. Every link is verified on the exact shingle sets. Verified links form the groups.
6. Bands whose nodes are then of several groups are gone through again: pairs across groups whose
   estimate doesn't rule them out are verified too, each node's NEXT best first, and then all that
   still lie across groups, until none is left.

No bucket, band or group is capped. Defined results: null and wordless texts, and rows whose id
is null, are in no group. Rows of equal id and words are one document; an id with several texts
is judged by each of them. Other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparquill.llm.common import col, drop_written, fresh, in_small_batches, lean, written
from sparquill.llm.components import components
from sparquill.llm.shingles import in_chunks, mixed, shingles, word_hashes
from sparquill.sources import table

SHINGLE = 3
THRESHOLD = 0.6
ROUNDS, BUCKETS, ROWS = 8, 16, 4
MANTISSA = 10
REGISTERS = ROUNDS * BUCKETS
BANDS = REGISTERS // ROWS
#: Partners of other groups that a node of a band is verified against before all of them are.
NEXT = 16
#: Ids of documents to verify or to drop are broadcast up to this many (some 50 MB); beyond it Catalyst chooses the join.
MAX_BROADCAST_IDS = 2_000_000
_SEEDS = [np.uint64((0x9E3779B97F4A7C15 * (2 * i + 3)) % (1 << 64)) for i in range(ROUNDS)]


def registers(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(texts, REGISTERS) compressed registers of the shingles of each text; 0 is an empty one."""
    n, bits = len(at) - 1, BUCKETS.bit_length() - 1
    doc = np.repeat(np.arange(n) * REGISTERS, np.diff(at))
    least = np.full(n * REGISTERS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for r, seed in enumerate(_SEEDS):
        g = mixed(h ^ seed)
        np.minimum.at(least, doc + r * BUCKETS + (g >> np.uint64(64 - bits)).astype(np.int64), (g << np.uint64(bits)) >> np.uint64(bits))
    empty = least == np.uint64(0xFFFFFFFFFFFFFFFF)
    # Leading zeros of the 64 - bits that remain, by the exponent of the value's upper half or lower half.
    high, low = (least >> np.uint64(32)).astype(np.float64), (least & np.uint64(0xFFFFFFFF)).astype(np.float64)
    top = np.where(high > 0, np.frexp(high)[1] + 32, np.frexp(low)[1])  # bits in use, 0 for the value 0
    zeros = (64 - bits - top).astype(np.uint64)
    shift = np.maximum(top - 1, 0).astype(np.uint64)
    rest = least & ((np.uint64(1) << shift) - np.uint64(1))
    back = np.where(shift >= MANTISSA, shift - np.minimum(shift, MANTISSA), 0).astype(np.uint64)
    mantissa = (rest >> back) << np.maximum(np.int64(MANTISSA) - shift.astype(np.int64), 0).astype(np.uint64)
    out = ((np.minimum(zeros, 62) + np.uint64(1)) << np.uint64(MANTISSA)) | mantissa
    out[empty] = 0
    return out.astype(np.uint16).reshape(n, REGISTERS)


def expected_collisions(n: np.ndarray | float, m: np.ndarray | float) -> np.ndarray:
    """Share of registers that are equal by chance for disjoint sets of n and m shingles.

    The approximation of the HyperMinHash paper for sets that are small against the hash range.
    """
    ratio = np.maximum(n, m) / np.maximum(np.minimum(n, m), 1)
    return 0.169919487159739093975315012348 * 2.0**-MANTISSA * 4 * ratio / (1 + ratio) ** 2


def estimated(a: np.ndarray, na, b: np.ndarray, nb) -> np.ndarray:
    """Jaccard estimates of sketches a and b (one may be a single row), corrected for collisions."""
    used = ((a != 0) | (b != 0)).sum(axis=-1)
    equal = ((a == b) & (a != 0)).sum(axis=-1)
    chance = expected_collisions(na, nb)
    share = equal / np.maximum(used, 1)
    return np.maximum(0.0, (share - chance) / (1 - chance))


def band_keys(sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts, BANDS) 64-bit keys, and which of them have a filled register."""
    bands = sketch.reshape(len(sketch), BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)[None, :] + np.uint64(1)
    for i in range(ROWS):
        key = mixed(key * np.uint64(0xA0761D6478BD642F) + bands[:, :, i])
    return key, (bands != 0).any(axis=2)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text with words: its id, two hashes of all its words, number of shingles, sketch."""
    for batch in (whole.slice(i, 512) for whole in batches for i in range(0, whole.num_rows, 512)):
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        for i, j in in_chunks(texts):
            h, at = shingles(texts[i:j], SHINGLE)
            words, wat = word_hashes(texts[i:j])
            some = np.flatnonzero(np.diff(at) > 0)
            if not len(some):
                continue
            order = mixed(words + np.arange(len(words), dtype=np.uint64) - np.repeat(wat[:-1].astype(np.uint64), np.diff(wat)))
            start = wat[:-1][some]
            whole = np.add.reduceat(order, start), np.bitwise_xor.reduceat(mixed(order), start)
            sketch = registers(h, at)[some]
            flat = pa.py_buffer(np.ascontiguousarray(sketch).tobytes())
            offsets = pa.py_buffer((np.arange(len(some) + 1, dtype=np.int32) * (2 * REGISTERS)).tobytes())
            yield pa.RecordBatch.from_arrays([ids.slice(i, j - i).take(pa.array(some)), pa.array(whole[0].view(np.int64)), pa.array(whole[1].view(np.int64)), pa.array(np.diff(at)[some].astype(np.int32)), pa.Array.from_buffers(pa.binary(), len(some), [None, offsets, flat])], ["doc", "w1", "w2", "n", "sketch"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            key, filled = band_keys(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, REGISTERS))
            row, band = np.nonzero(filled)
            yield pa.RecordBatch.from_arrays([pa.array(key[row, band].view(np.int64)), batch.column(0).take(pa.array(row))], ["band", "node"])


def forest(ids: np.ndarray, sketch: np.ndarray, n: np.ndarray, threshold: float) -> Iterator[tuple[int, int]]:
    """Links (positions) between the nodes of one band: a spanning forest of the safe ones, the best for the others."""
    slack = 2.5 * np.sqrt(threshold * (1 - threshold) / REGISTERS)
    seen, left = [], np.arange(len(ids))
    while len(left):
        pivot, left = left[0], left[1:]
        if seen:
            before = np.asarray(seen)
            e = estimated(sketch[before], n[before], sketch[pivot], n[pivot])
            best = int(e.argmax())
            if e[best] >= threshold - slack:
                yield int(before[best]), int(pivot)
        seen.append(pivot)
        front = [pivot]
        while front and len(left):
            p = front.pop()
            near = estimated(sketch[left], n[left], sketch[p], n[p]) >= threshold + slack
            for x in left[near]:
                yield int(p), int(x)
                front.append(x)
                seen.append(x)
            left = left[~near]


def _links(threshold: float):
    """(u, v, band): links with a null band; a band of more than two nodes that has a link, alone in a row."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slack = 2.5 * np.sqrt(threshold * (1 - threshold) / REGISTERS)
        for batch in batches:
            group, bands = batch.column(0), batch.column(1).to_numpy()
            at, rows = group.offsets.to_numpy(), group.flatten()
            base = at[0]
            ids, n = rows.field(0).to_numpy(zero_copy_only=False), rows.field(1).to_numpy(zero_copy_only=False).astype(np.float64)
            sketch = np.frombuffer(b"".join(rows.field(2).to_pylist()), np.uint16).reshape(-1, REGISTERS)
            out: list[np.ndarray] = []
            crowds: list[int] = []
            first = at[:-1] - base
            pairs = first[np.diff(at) == 2]
            if len(pairs):
                e = estimated(sketch[pairs], n[pairs], sketch[pairs + 1], n[pairs + 1])
                pairs = pairs[e >= threshold - slack]
                out.append(np.stack([ids[pairs], ids[pairs + 1]]))
            for i in np.flatnonzero(np.diff(at) > 2):
                s = slice(at[i] - base, at[i + 1] - base)
                order = np.argsort(ids[s])
                own, links = ids[s][order], list(forest(ids[s], sketch[s][order], n[s][order], threshold))
                if links:  # without one, each node was compared with all others
                    out.append(own[np.asarray(links).T])
                    crowds.append(bands[i])
            if out:
                u, v = np.concatenate(out, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v)), pa.nulls(len(u), pa.int64())], ["u", "v", "band"])
            if crowds:
                yield pa.RecordBatch.from_arrays([pa.nulls(len(crowds), pa.int64()), pa.nulls(len(crowds), pa.int64()), pa.array(crowds, pa.int64())], ["u", "v", "band"])

    return link


def across(root: np.ndarray, sketch: np.ndarray, n: np.ndarray, least: float, most: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (positions) of one band's nodes of different roots, estimated at ``least`` or more: each node's ``most`` best, or all."""
    for i in range(len(root)):
        other = np.flatnonzero(root != root[i]) if most else i + 1 + np.flatnonzero(root[i + 1 :] != root[i])
        if len(other):
            e = estimated(sketch[other], n[other], sketch[i], n[i])
            good = np.flatnonzero(e >= least)
            if most and len(good) > most:
                good = good[np.argpartition(-e[good], most - 1)[:most]]
            if len(good):
                yield np.full(len(good), i), other[good]


def _rest(threshold: float, most: int | None):
    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = threshold - 2.5 * np.sqrt(threshold * (1 - threshold) / REGISTERS)

        def batch_of(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            u, v = (np.concatenate(x) for x in zip(*parts))
            pairs = np.unique(np.stack([np.maximum(u, v), np.minimum(u, v)]), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["u", "v"])

        for batch in batches:
            group = batch.column(0)
            at, rows = group.offsets.to_numpy(), group.flatten()
            ids, n, root = rows.field(0).to_numpy(zero_copy_only=False), rows.field(1).to_numpy(zero_copy_only=False).astype(np.float64), rows.field(3).to_numpy(zero_copy_only=False)
            sketch = np.frombuffer(b"".join(rows.field(2).to_pylist()), np.uint16).reshape(-1, REGISTERS)
            parts, size = [], 0
            for a, b in zip(at[:-1] - at[0], at[1:] - at[0]):
                for x, y in across(root[a:b], sketch[a:b], n[a:b], least, most):
                    parts.append((ids[a:b][x], ids[a:b][y]))
                    size += len(x)
                    if size > 200_000:
                        yield batch_of(parts)
                        parts, size = [], 0
            if parts:
                yield batch_of(parts)

    return rest


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different shingles of each text."""
    for batch in (whole.slice(i, 512) for whole in batches for i in range(0, whole.num_rows, 512)):
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        for i, j in in_chunks(texts):
            h, at = shingles(texts[i:j], SHINGLE)
            own = [np.unique(h[a:b]) for a, b in zip(at[:-1], at[1:])]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(own).view(np.int64)))], ["node", "s"])


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, kept_id): every document of a group but the one that stays, the group's least id."""
    texts = in_small_batches(docs).select(col(id_col).cast("long").alias("doc"), col(text_col).alias("text")).where("doc IS NOT NULL AND text <> ''")
    sketches = written(texts.mapInArrow(lean(_sketches), "doc long, w1 long, w2 long, n int, sketch binary"), "hyperminhash")
    same = written(sketches.groupBy("w1", "w2").agg(F.min("doc").alias("node"), F.min("n").alias("n"), F.min("sketch").alias("sketch"), F.collect_set("doc").alias("docs")), "hyperminhash-nodes")
    exact = same.where(F.size("docs") > 1).select(F.explode("docs").alias("u"), F.col("node").alias("v")).where("u <> v")
    # An id with several texts is several nodes of one number; their sketches are candidates each.
    met = same.select("node", "sketch").mapInArrow(lean(_bands), "band long, node long").groupBy("band").agg(F.sort_array(F.collect_set("node")).alias("nodes")).where(F.size("nodes") > 1)
    met = written(met.select("nodes").distinct().select(F.xxhash64("nodes").alias("g"), F.explode("nodes").alias("node")), "hyperminhash-bands")
    groups = met.join(same.select("node", "n", "sketch"), "node").groupBy("g").agg(F.collect_list(F.struct("node", "n", "sketch")).alias("x")).select("x", "g")
    found = written(groups.mapInArrow(lean(_links(threshold)), "u long, v long, band long"), "hyperminhash-found")
    tried = written(found.where("u <> v").select("u", "v").distinct(), "hyperminhash-links")
    near = _verified(texts, tried, threshold)
    groups = components(near.unionAll(exact))
    crowds = met.join(found.where("band IS NOT NULL").select(F.col("band").alias("g")).distinct(), "g", "left_semi")
    for most in (NEXT, None):
        # Nodes of their crowds with their roots; crowds that are one group by now need nothing more.
        rooted = crowds.join(groups.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").select("g", "node", F.coalesce("root", "node").alias("root"))
        open_ = rooted.groupBy("g").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("g")
        lists = rooted.join(open_, "g", "left_semi").join(same.select("node", "n", "sketch"), "node").groupBy("g").agg(F.collect_list(F.struct("node", "n", "sketch", "root")).alias("x")).select("x")
        more = lists.mapInArrow(lean(_rest(threshold, most)), "u long, v long").where("u <> v").distinct()
        more = written(more.join(tried, ["u", "v"], "left_anti"), "hyperminhash-more")
        if more.isEmpty():
            continue
        joined = _verified(texts, more, threshold)
        tried = tried.unionAll(more)
        if not joined.isEmpty():
            near = near.unionAll(joined)
            groups = components(near.unionAll(exact))
    return groups.select(F.col("node").alias("doc_id"), F.col("root").alias("kept_id"))


def _verified(texts: DataFrame, links: DataFrame, threshold: float) -> DataFrame:
    """The links (u, v) whose texts' shingle sets have a Jaccard similarity of threshold or more."""
    ends = written(links.select(F.col("u").alias("node")).unionAll(links.select("v")).distinct(), "hyperminhash-ends")
    ends = F.broadcast(ends) if ends.count() <= MAX_BROADCAST_IDS else ends
    sets = texts.join(ends, texts["doc"] == ends["node"], "left_semi").mapInArrow(lean(_sets), "node long, s array<long>")
    sets = written(sets.distinct(), "hyperminhash-sets")
    both = links.join(sets.select(F.col("node").alias("u"), F.col("s").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("s").alias("b")), "v")
    shared = F.size(F.array_intersect("a", "b"))
    near = both.where(shared >= F.lit(threshold) * (F.size("a") + F.size("b") - shared)).select("u", "v")
    near = written(near, "hyperminhash-near")
    drop_written(sets)
    return near


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the documents that duplicates() lists; rows of an id that stays all stay."""
    name = fresh(docs, "_gone_id")
    gone = written(duplicates(docs, id_col, text_col, threshold).select(F.col("doc_id").alias(name)), "near-duplicates")
    gone = F.broadcast(gone) if gone.count() <= MAX_BROADCAST_IDS else gone
    return docs.join(gone, col(id_col).cast("long") == F.col(name), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
