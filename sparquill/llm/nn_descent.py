"""Near-duplicate embeddings by NN-descent: the pairs of a cosine of at least THRESHOLD.

0. Equal vectors are one class, named by its least id, which alone takes part: copies, however
   many, cost nothing further and their pairs are never expanded.
1. Random hyperplanes put the vectors into leaves, TREES times over; each vector's nearest in its
   leaves are its first neighbours.
2. Rounds of neighbours-of-neighbours joins: around every vector, its neighbours and those whose
   neighbour it is are compared with each other, where one of the two is new; who is nearer than
   the last of a list enters it. Of a list that has grown, only the NEIGHBOURS nearest and those of a
   cosine of EXPLORE or more lead anywhere: others stay in it but open no join. Crowds are compared
   in random chunks of CHUNK, so that no join is quadratic; all of a crowd's members are, in rows of
   CROWD chunks, so that nobody new goes without a join.
3. A list that is full of neighbours above the threshold is saturated: it grows GROWTH times and
   is explored anew. Rounds go on until no pair above the threshold enters and no list is saturated.
4. An audit compares AUDIT vectors with all others, and so many more until PAIRED have a pair or no
   vector is left. While the graph has less than RECALL of their pairs, or of a vector's pairs in the
   mean of the vectors that have one, leaves of new hyperplanes are added and the rounds resume.

The result is a row a vector: its class and the number of its links, that is of all other vectors
of a cosine of at least THRESHOLD, its own copies among them. Pairs are those of classes.

Defined results: null vectors, vectors with null, NaN or infinite parts, zero vectors and vectors
not of the commonest length (ties: the greatest) are classes of their own, without links. Rows of
one id are one vector, the least; rows whose id is null are left out. An empty table gives none.
Other columns, whatever their names, are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparquill.llm.common import col, drop_written, lean, written
from sparquill.sources import table

THRESHOLD = 0.9
NEIGHBOURS = 8
GROWTH = 4
LEAF = 96
TREES = 8
EXPLORE = 0.6
CHUNK = 64
CROWD = 4
AUDIT = 1024
PAIRED = 128
RECALL = 0.97
MAX_ROUNDS = 60
MAX_AUDITS = 8
_NB = "array<struct<s:float,v:long,f:boolean>>"


def _flat(vectors: pa.BinaryArray) -> np.ndarray:
    """The vectors of a binary column as the rows of a matrix, without a copy."""
    _, ends, data = vectors.buffers()
    ends = np.frombuffer(ends, np.int32)[vectors.offset : vectors.offset + len(vectors) + 1]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(np.float32).reshape(len(vectors), -1)


def _unit(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            size = np.linalg.norm(x, axis=1)
            good = np.flatnonzero(np.isfinite(size) & (size > 0))
            unit = (x[good] / size[good, None]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good)), pa.array([r.tobytes() for r in unit], pa.binary())], ["id", "vec"])

    return run


def _leaves(dim: int, bits: int, seed: int):
    planes = np.random.default_rng(seed).standard_normal((dim, TREES * bits)).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                side = (_flat(batch.column(1)) @ planes > 0).reshape(-1, TREES, bits)
                code = (side << np.arange(bits)).sum(axis=2) + (np.arange(TREES, dtype=np.int64) << bits)
                row = np.repeat(np.arange(batch.num_rows), TREES)
                yield pa.RecordBatch.from_arrays([pa.array(code.ravel()), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row))], ["leaf", "id", "vec"])

    return run


def _named(ids: np.ndarray, x: np.ndarray, least: np.ndarray, new: np.ndarray | None, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(u, v, s): for each of ids its ``most`` nearest of the others that are nearer than ``least``; of two old ones, neither."""
    s = x @ x.T
    np.fill_diagonal(s, -3)
    s[ids[:, None] == ids[None, :]] = -3
    if new is not None:
        s[~(new[:, None] | new[None, :])] = -3
    most = min(most, len(ids) - 1)
    near = np.argpartition(-s, most - 1, axis=1)[:, :most] if most < len(ids) - 1 else np.argsort(-s, axis=1)[:, :most]
    value = np.take_along_axis(s, near, axis=1)
    row, k = np.nonzero((value > least[:, None]) & (value > -2))
    return ids[row], ids[near[row, k]], value[row, k]


def _out(parts: list[tuple]) -> pa.RecordBatch:
    u, v, s = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((v, u))
    u, v, s = u[order], v[order], s[order]
    first = np.concatenate([[True], (u[1:] != u[:-1]) | (v[1:] != v[:-1])])
    return pa.RecordBatch.from_arrays([pa.array(u[first]), pa.array(v[first]), pa.array(np.round(s[first].astype(np.float64), 6).astype(np.float32))], ["u", "v", "s"])


def _compare(seed: int, most: int, rounds: bool):
    """The pairs that each row's list of vectors names, in random chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng, parts, size = np.random.default_rng(seed), [], 0
        chunk = CHUNK if rounds else 8 * LEAF
        for lists in (whole.column(0).slice(i, 256) for whole in batches for i in range(0, whole.num_rows, 256)):
            ends, rows = lists.offsets.to_numpy(), lists.flatten()
            base = ends[0]
            ids = rows.field("id").to_numpy(zero_copy_only=False)
            vectors = _flat(rows.field("vec")) if len(ids) else None
            least = rows.field("least").to_numpy(zero_copy_only=False) if rounds else np.full(len(ids), -2.0)
            new = rows.field("f").to_numpy(zero_copy_only=False).astype(bool) if rounds else None
            for a, b in zip(ends[:-1] - base, ends[1:] - base):
                if b - a < 2 or (rounds and not new[a:b].any()):
                    continue
                at = np.arange(a, b)
                if rounds:  # a neighbour both ways is listed twice: once is enough, new if either is
                    at = at[np.lexsort((~new[at], ids[at]))]
                    at = at[np.concatenate([[True], ids[at][1:] != ids[at][:-1]])]
                if len(at) > chunk:
                    at = rng.permutation(at)
                for i in range(0, len(at), chunk):
                    c = at[i : i + chunk]
                    if len(c) > 1 and (not rounds or new[c].any()):
                        parts.append(_named(ids[c], vectors[c], least[c], None if new is None else new[c], most))
                        size += len(parts[-1][0])
                if size > 600_000:
                    yield _out(parts)
                    parts, size = [], 0
        if size:
            yield _out(parts)

    return run


def _merge(threshold: float, keep: bool = False):
    """Rows of (u, k, nb, found): the k best of both; found ones are new, and all of a list that was saturated; with keep, those not joined yet stay new."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, 512) for whole in batches for i in range(0, whole.num_rows, 512)):
            n = batch.num_rows
            us, ks = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            old, got = batch.column(2), batch.column(3)
            oe, ge = old.offsets.to_numpy(), got.offsets.to_numpy()
            o, g = old.flatten(), got.flatten()
            waiting = o.field("f").to_numpy(zero_copy_only=False).astype(bool) & keep
            os_, ov = o.field("s").to_numpy(zero_copy_only=False), o.field("v").to_numpy(zero_copy_only=False)
            gs, gv = g.field("s").to_numpy(zero_copy_only=False), g.field("v").to_numpy(zero_copy_only=False)
            oe, ge = oe - oe[0], ge - ge[0]
            s_out, v_out, f_out, lengths, k_out, entered, saturated = [], [], [], [], [], [], []
            for i in range(n):
                a, b, c, d = oe[i], oe[i + 1], ge[i], ge[i + 1]
                s, v = np.concatenate([os_[a:b], gs[c:d]]), np.concatenate([ov[a:b], gv[c:d]])
                f = np.concatenate([waiting[a:b], np.ones(d - c, bool)])
                order = np.lexsort((f, v))
                order = order[np.concatenate([[True], v[order][1:] != v[order][:-1]])] if len(order) else order
                order = order[np.lexsort((v[order], -s[order]))][: ks[i]]
                s, v, f = s[order], v[order], f[order]
                full = len(s) == ks[i] and s[-1] >= threshold
                entered.append(int((f & (s >= threshold)).sum())), saturated.append(bool(full)), k_out.append(int(ks[i]) * (GROWTH if full else 1))
                s_out.append(s), v_out.append(v), f_out.append((f | full) & ((s >= EXPLORE) | (np.arange(len(s)) < NEIGHBOURS))), lengths.append(len(s))
            flat = pa.StructArray.from_arrays([pa.array(np.concatenate(s_out).astype(np.float32)), pa.array(np.concatenate(v_out).astype(np.int64)), pa.array(np.concatenate(f_out).astype(bool))], ["s", "v", "f"]) if n else None
            if n:
                nb = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), flat)
                yield pa.RecordBatch.from_arrays([us, pa.array(k_out, pa.int32()), nb, pa.array(entered, pa.int64()), pa.array(saturated)], ["u", "k", "nb", "entered", "saturated"])

    return run


def _graph(before: DataFrame, pairs: DataFrame, threshold: float, keep: bool = False) -> DataFrame:
    found = pairs.groupBy(F.col("u").alias("w")).agg(F.collect_set(F.struct("s", "v")).alias("found"))
    rows = before.join(found, F.col("u") == F.col("w"), "left").select("u", "k", "nb", F.coalesce("found", F.array().cast("array<struct<s:float,v:long>>")).alias("found"))
    return written(rows.mapInArrow(lean(_merge(threshold, keep)), f"u long, k int, nb {_NB}, entered long, saturated boolean"), "nn-graph")


def _round(graph: DataFrame, vectors: DataFrame, seed: int, threshold: float) -> DataFrame:
    edges = graph.select("u", F.explode("nb").alias("e")).select("u", "e.v", "e.f")
    around = edges.select(F.col("u").alias("c"), F.col("v").alias("m"), "f").unionAll(edges.select(F.col("v").alias("c"), F.col("u").alias("m"), "f")).unionAll(graph.select(F.col("u").alias("c"), F.col("u").alias("m"), F.lit(False).alias("f")))
    # Who is in which join is settled on ids alone: a crowd in rows of CROWD chunks, of which those with someone new are joined with their vectors.
    lists = around.groupBy("c").agg(F.collect_list(F.struct("m", "f")).alias("x")).where(F.exists("x", lambda x: x["f"]))
    width = CROWD * CHUNK
    mixed = lists.select("c", F.when(F.size("x") > width, F.transform(F.array_sort(F.transform("x", lambda e: F.struct(F.xxhash64(e["m"], "c", F.lit(seed)).alias("h"), e["m"].alias("m"), e["f"].alias("f")))), lambda e: F.struct(e["m"].alias("m"), e["f"].alias("f")))).otherwise(F.col("x")).alias("x"))
    rows = F.transform(F.sequence(F.lit(0), F.floor((F.size("x") - 1) / width).cast("int")), lambda i: F.slice("x", i * width + 1, width))
    around = mixed.select("c", F.posexplode(rows).alias("row", "x")).where(F.exists("x", lambda x: x["f"])).select("c", "row", F.explode("x").alias("x")).select("c", "row", "x.m", "x.f")
    full = F.size("nb") >= F.col("k")
    state = vectors.join(graph.select("u", F.when(full, F.element_at("nb", -1)["s"]).otherwise(F.lit(-2.0)).cast("float").alias("least")), F.col("id") == F.col("u")).drop("u")
    lists = around.join(state, F.col("m") == F.col("id")).groupBy("c", "row").agg(F.collect_list(F.struct("id", "f", "least", "vec")).alias("x")).select("x")
    return _graph(graph.select("u", "k", "nb"), lists.mapInArrow(lean(_compare(seed, CHUNK, True)), "u long, v long, s float"), threshold)


def _audited(graph: DataFrame, vectors: DataFrame, n: int, threshold: float, seed: int) -> tuple[int, int, int, float]:
    """By comparing vectors with all: their pairs, how many of them the graph has, the vectors with a pair, the mean share of a vector's pairs that the graph has."""
    order = vectors.orderBy(F.xxhash64("id", F.lit(seed)), "id")
    have = pairs_of(graph, threshold).select("vec_a", "vec_b", F.lit(1).alias("hit"))
    true = found = paired = start = 0
    shares = 0.0
    while start < n and paired < PAIRED:
        sample = order.offset(start).limit(AUDIT).collect()
        start += AUDIT
        ids, x = np.array([r["id"] for r in sample]), _flat(pa.array([bytes(r["vec"]) for r in sample], pa.binary()))

        def run(batches: Iterator[pa.RecordBatch], ids=ids, x=x) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    own = batch.column(0).to_numpy()
                    s = _flat(batch.column(1)) @ x.T
                    a, b = np.nonzero((s >= threshold + 1e-6) & (own[:, None] != ids[None, :]))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[b]), pa.array(own[a])], ["of", "other"])

        pairs = vectors.mapInArrow(run, "of long, other long").select("of", F.least("of", "other").alias("a"), F.greatest("of", "other").alias("b"))
        each = pairs.join(have, (F.col("a") == F.col("vec_a")) & (F.col("b") == F.col("vec_b")), "left").groupBy("of").agg(F.count("*").alias("t"), F.count("hit").alias("g"))
        row = each.agg(F.sum("t"), F.sum("g"), F.count("*"), F.sum(F.col("g") / F.col("t"))).first()
        true, found, paired, shares = true + (row[0] or 0), found + (row[1] or 0), paired + row[2], shares + (row[3] or 0.0)
    return true, found, paired, shares / paired if paired else 1.0


def pairs_of(graph: DataFrame, threshold: float) -> DataFrame:
    e = graph.select("u", F.explode("nb").alias("e")).where(F.col("e.s") >= threshold).select(F.least("u", "e.v").alias("vec_a"), F.greatest("u", "e.v").alias("vec_b"), "e.s")
    return e.groupBy("vec_a", "vec_b").agg(F.round(F.max("s").cast("double"), 5).alias("cosine"))


def classes(embeddings: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, DataFrame] | None:
    """(id, class) of the vectors that can have pairs, and (id, vec, copies), a unit vector for each class; None if there is none."""
    rows = embeddings.select(col(id_col).cast("long").alias("id"), col(vec_col).alias("v")).where("id IS NOT NULL AND size(v) > 0 AND NOT exists(v, x -> x IS NULL)")
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None:
        return None
    vectors = written(rows.where(F.size("v") == sizes["d"]).groupBy("id").agg(F.min("v").alias("v")).mapInArrow(_unit(sizes["d"]), "id long, vec binary"), "nn-vectors")
    each = written(vectors.groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "nn-classes")
    # Only ids and vectors of classes with copies meet; the adaptive join splits a class that holds a third of all rows.
    copied = each.where("copies > 1").select(F.col("id").alias("class"), F.col("vec").alias("w"))
    return vectors.join(copied, F.col("vec") == F.col("w"), "left").select("id", F.coalesce("class", "id").alias("class")), each


def near_pairs(each: DataFrame, threshold: float = THRESHOLD, report: dict | None = None) -> DataFrame:
    """(vec_a, vec_b, cosine), vec_a < vec_b, of the pairs found among the unit vectors (id, vec); report gets n, rounds and the audit's counts."""
    vectors = each.select("id", "vec")
    n, dim = vectors.agg(F.count("*"), F.max(F.octet_length("vec")) / 4).first()
    if not n:
        return each.sparkSession.createDataFrame([], "vec_a long, vec_b long, cosine double")
    dim = int(dim)
    bits = max(1, int(np.ceil(np.log2(max(1, n) / LEAF))))
    graph, rounds, true, found = vectors.select(F.col("id").alias("u"), F.lit(NEIGHBOURS).alias("k"), F.array().cast(_NB).alias("nb")), 0, 0, 0
    for audit in range(MAX_AUDITS):
        leaves = vectors.mapInArrow(_leaves(dim, bits, 17 + audit), "leaf long, id long, vec binary").groupBy("leaf").agg(F.collect_list(F.struct("id", "vec")).alias("x")).select("x")
        graph = _graph(graph.select("u", "k", "nb"), leaves.mapInArrow(lean(_compare(audit, NEIGHBOURS, False)), "u long, v long, s float"), threshold, keep=True)
        while rounds < MAX_ROUNDS:
            after = _round(graph, vectors, 1000 + rounds, threshold)
            rounds += 1
            moved = after.agg(F.sum("entered"), F.sum(F.col("saturated").cast("int"))).first()
            drop_written(graph)
            graph = after
            if not any(moved):
                break
        true, found, paired, share = _audited(graph, vectors, n, threshold, audit)
        if found >= RECALL * true and share >= RECALL:
            if report is not None:
                report.update(n=n, rounds=rounds, audits=audit + 1, true=true, found=found, paired=paired, share=share)
            return pairs_of(graph, threshold)
    raise RuntimeError(f"{found} of {true} audited pairs, {share:.3f} of a vector's, after {rounds} rounds and {MAX_AUDITS} sets of leaves")


def near_vectors(embeddings: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, report: dict | None = None) -> DataFrame:
    """(vec_id, class_id, links): a row for every id."""
    ids = embeddings.select(col(id_col).cast("long").alias("vec_id")).where("vec_id IS NOT NULL").distinct()
    made = classes(embeddings, id_col, vec_col)
    if made is None:
        return ids.select("vec_id", F.col("vec_id").alias("class_id"), F.lit(0).cast("long").alias("links"))
    members, each = made
    pairs = near_pairs(each, threshold, report)
    both = pairs.select(F.col("vec_a").alias("of"), F.col("vec_b").alias("other")).unionAll(pairs.select("vec_b", "vec_a"))
    others = both.join(each.select(F.col("id").alias("other"), "copies"), "other").groupBy("of").agg(F.sum("copies").alias("near"))
    own = each.select(F.col("id").alias("class"), (F.col("copies") - 1).alias("twins")).join(others, F.col("class") == F.col("of"), "left")
    links = own.select("class", (F.col("twins") + F.coalesce("near", F.lit(0))).alias("links"))
    known = members.join(links, "class").select(F.col("id").alias("_id"), F.col("class").alias("class_id"), "links")
    return ids.join(known, F.col("vec_id") == F.col("_id"), "left").select("vec_id", F.coalesce("class_id", "vec_id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
