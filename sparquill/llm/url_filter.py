"""URL blocklists as sorted digest arrays.

The blocklist's entries (hosts, or hosts with a path prefix) are split by the first bits of their
64-bit xxhash into shards; each shard is a file of sorted digests beside one of the entries
themselves, written by executors into the shared folder. A worker memory-maps the shards, makes
for each URL all the entries that could block it (the host and its parent domains, alone and with
each prefix of the path, of no more labels and parts than any entry has), probes their digests by vectorised binary search, and confirms every
hit on the stored string, so that a collision of digests blocks nothing.

Where the shared folder is no mounted file system (an object store), the shards are broadcast
instead, up to MAX_BROADCAST_BYTES; a larger blocklist then is an error, not a partial result.

Defined results: scheme, user, port, ``www.``, letters' case of the host, query and fragment don't
matter. A null or empty URL, or one without host, is not blocked. Rows are judged each by itself;
repeated rows stay, an empty table stays empty. An empty blocklist blocks nothing. Other columns pass
through; a column of the result's name is an error.
"""
from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparquill.llm.common import col, fresh, mounted, shared_dir, written
from sparquill.sources import table

#: Shards are about this many entries.
SHARD_ENTRIES = 1 << 20
MAX_BROADCAST_BYTES = 1 << 29
#: Families of hosts that serve spam, on every domain that they were seen on.
FAMILIES = ["spam-farm", "cheap-pills", "malware", "casino-bonus", "casino-win", "free-bets", "ads-track"]
DOMAINS = ["example.com", "example.net", "example.org"]
#: Further entries of the query's blocklist, hosts and URLs by turns, so that it has a production list's size and several shards.
LISTED = 1_200_000


def normal(url: str | None) -> tuple[str, list[str]]:
    """Host and path parts of a URL or entry; an empty host if there is none."""
    rest = (url or "").strip()
    scheme = rest.find("://")
    rest = rest[scheme + 3 :] if scheme >= 0 else rest.removeprefix("//")
    for mark in "#?":
        rest = rest.partition(mark)[0]
    host, _, path = rest.partition("/")
    host = host.rpartition("@")[2].partition(":")[0].lower().strip(".")
    host = host[4:] if host.startswith("www.") else host
    return host, [p for p in path.split("/") if p]


def entry(url: str | None) -> str:
    host, path = normal(url)
    return "/".join([host, *path]) if host else ""


def candidates(url: str | None, longest: tuple[int, int] | None = None) -> list[str]:
    """All entries that block this URL, the longest host first; with longest, those of so many labels and path parts at most.

    No entry of the blocklist has more, so that a very long host or path costs no more than its reading.
    """
    host, path = normal(url)
    if not host:
        return []
    labels = host.split(".")
    first, most = (0, len(path)) if longest is None else (max(0, len(labels) - longest[0]), min(len(path), longest[1]))
    hosts = [".".join(labels[i:]) for i in range(first, max(1, len(labels) - 1))]
    return ["/".join([h, *path[:n]]) for h in hosts for n in range(most + 1)]


def _arrays(entries: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted digests, and the entries in the same order as ends and bytes."""
    digests = np.array([xxhash.xxh64_intdigest(e) for e in entries], np.uint64)
    order = np.argsort(digests, kind="stable")
    data = [entries[i].encode() for i in order]
    return digests[order], np.cumsum([len(d) for d in data]).astype(np.int64), np.frombuffer(b"".join(data), np.uint8)


def _write(folder: str | None):
    """Shards of rows (shard, entry) as files in folder, or as rows where there is none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for shard, rows in pd.concat([pd.DataFrame({"shard": [], "entry": []}), *batches]).groupby("shard"):
            arrays = _arrays(sorted(set(rows["entry"])))
            if folder is not None:
                name = os.path.join(folder, f"{int(shard):05d}")
                # A retried or doubled task writes the same bytes under a name of its own, then renames.
                for suffix, array in zip(PARTS, arrays):
                    part = f"{name}.{suffix}.{uuid.uuid4().hex}.npy"
                    np.save(part, array)
                    os.replace(part, f"{name}.{suffix}.npy")
            yield pd.DataFrame({"shard": [int(shard)], "bytes": [sum(x.nbytes for x in arrays)], **{p: [b"" if folder is not None else x.tobytes()] for p, x in zip(PARTS, arrays)}})

    return run


PARTS = ("digests", "ends", "strings")


def build(entries: DataFrame, url_col: str = "entry") -> tuple[str | Broadcast, int, tuple[int, int], frozenset[int]]:
    """The shards of a blocklist, as a folder or a broadcast, their number, a power of two, the most labels and path parts of an entry, and the shards that have entries."""
    spark = entries.sparkSession
    normalised = F.pandas_udf(lambda s: s.map(entry), "string")
    clean = entries.select(normalised(col(url_col)).alias("entry")).where("entry <> ''").distinct()
    host = F.split("entry", "/")[0]
    n, labels, parts = clean.agg(F.count("*"), F.max(F.size(F.split(host, "\\."))), F.max(F.size(F.split("entry", "/")) - 1)).first()
    longest = labels or 0, parts or 0
    shards = 1 << max(0, (n - 1) // SHARD_ENTRIES).bit_length()
    bits = shards.bit_length() - 1
    shared = mounted(spark, shared_dir(spark))
    folder = None
    if shared is not None:
        folder = os.path.join(shared, f"url-digests-{uuid.uuid4().hex}")
        os.makedirs(folder)
    place = F.pandas_udf(lambda s: s.map(lambda e: xxhash.xxh64_intdigest(e) >> (64 - bits) if bits else 0), "int")
    made = clean.select(place("entry").alias("shard"), "entry").repartition(shards, "shard").mapInPandas(_write(folder), "shard int, bytes long, digests binary, ends binary, strings binary")
    if folder is not None:
        return folder, shards, longest, frozenset(r[0] for r in made.select("shard").collect())
    made = written(made, "url-digests")
    if (made.agg(F.sum("bytes")).first()[0] or 0) > MAX_BROADCAST_BYTES:
        raise ValueError("a blocklist of this size needs a shared folder that executors mount")
    kinds = (np.uint64, np.int64, np.uint8)
    parts: list = [None] * shards
    for r in made.collect():
        parts[r["shard"]] = [np.frombuffer(bytes(r[p]), k) for p, k in zip(PARTS, kinds)]
    return spark.sparkContext.broadcast(parts), shards, longest, frozenset(i for i, p in enumerate(parts) if p is not None)


class Digests:
    """Memory-mapped shards of a blocklist; one that has entries and can't be found is an error, as nothing of it would be blocked."""

    def __init__(self, folder: str | Broadcast, shards: int, longest: tuple[int, int] | None = None, filled: frozenset[int] = frozenset()):
        self.longest = longest
        self.shift = np.uint64(64 - (shards.bit_length() - 1)) if shards > 1 else None
        self.parts = folder.value if not isinstance(folder, str) else []
        if self.parts:
            return
        for i in range(shards):
            name = os.path.join(folder, f"{i:05d}")
            there = i in filled or os.path.exists(f"{name}.digests.npy")
            self.parts.append([np.load(f"{name}.{x}.npy", mmap_mode="r") for x in PARTS] if there else None)

    def string(self, part: list, i: int) -> str:
        _, ends, strings = part
        return strings[int(ends[i - 1]) if i else 0 : int(ends[i])].tobytes().decode()

    def first_blocking(self, urls: list[str | None]) -> list[str | None]:
        """For each URL the first of its candidates that is in the blocklist."""
        each = [candidates(u, self.longest) for u in urls]
        flat = [c for x in each for c in x]
        out: list[str | None] = [None] * len(urls)
        if not flat:
            return out
        digests = np.array([xxhash.xxh64_intdigest(c) for c in flat], np.uint64)
        owner = np.repeat(np.arange(len(urls)), [len(x) for x in each])
        shard = (digests >> self.shift).astype(np.int64) if self.shift is not None else np.zeros(len(flat), np.int64)
        hits: list[int] = []
        for s in np.unique(shard):
            if (part := self.parts[s]) is None:
                continue
            mine = np.flatnonzero(shard == s)
            at = np.searchsorted(part[0], digests[mine])
            for k, i in zip(mine[hit := (at < len(part[0])) & (part[0][np.minimum(at, len(part[0]) - 1)] == digests[mine])], at[hit]):
                while i < len(part[0]) and part[0][i] == digests[k]:
                    if self.string(part, int(i)) == flat[k]:
                        hits.append(int(k))
                        break
                    i += 1
        for k in sorted(hits, reverse=True):
            out[owner[k]] = flat[k]
        return out


#: The blocklist that this worker has open: one, so that a long-lived worker doesn't gather them.
_open: dict[str, Digests] = {}


def blocked_by(pages: DataFrame, entries: DataFrame, url_col: str = "url", entry_col: str = "entry", out: str = "blocked_by") -> DataFrame:
    """pages and the entry that blocks each row's URL in a column ``out``, null where none does."""
    if fresh(pages, out) != out:
        raise ValueError(f"pages has a column {out}")
    folder, shards, longest, filled = build(entries, entry_col)
    name = folder if isinstance(folder, str) else uuid.uuid4().hex

    @F.pandas_udf("string")
    def probe(urls: pd.Series) -> pd.Series:
        if name not in _open:
            _open.clear()
            _open[name] = Digests(folder, shards, longest, filled)
        return pd.Series(_open[name].first_blocking([u if isinstance(u, str) else None for u in urls]), dtype=object)

    return pages.withColumn(out, probe(col(url_col)))


def blocklist(spark: SparkSession) -> DataFrame:
    """(entry): the families' hosts and LISTED more entries; any table of entries can take its place."""
    hosts = spark.range(1).select(F.explode(F.array(*(F.lit(f"{f}.{d}") for f in FAMILIES for d in DOMAINS))).alias("entry"))
    i = F.col("id")
    more = F.concat(F.lit("h"), i.cast("string"), F.lit(".listed.example"), F.when(i % 3 == 0, F.concat(F.lit("/p/"), (i % 97).cast("string"))).otherwise(F.lit("")))
    return hosts.unionAll(spark.range(LISTED).select(more.alias("entry")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocked_by(table(spark, sf_dir, "pages").select("page_id", "url"), blocklist(spark)).select("page_id", "url", "blocked_by")


_FAMILY_HOSTS = ", ".join(f"('{f}.{d}')" for f in FAMILIES for d in DOMAINS)
ORACLE_SQL = f"""
WITH b AS (
  SELECT e FROM (VALUES {_FAMILY_HOSTS}) v(e)
  UNION ALL SELECT 'h' || i || '.listed.example' || CASE WHEN i % 3 = 0 THEN '/p/' || (i % 97) ELSE '' END FROM range({LISTED}) r(i)
), p AS (
  SELECT page_id, url, string_split(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\\.', ''), '.') AS labels,
    list_filter(string_split(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1), '/'), lambda x: x <> '') AS path FROM pages
), h AS (
  SELECT page_id, url, path, i, array_to_string(labels[i:], '.') AS host FROM (SELECT *, unnest(range(1, greatest(2, len(labels)))) AS i FROM p)
), c AS (
  SELECT page_id, url, i, n, CASE WHEN n = 0 THEN host ELSE host || '/' || array_to_string(path[1:n], '/') END AS e FROM (SELECT *, unnest(range(0, len(path) + 1)) AS n FROM h)
)
SELECT pages.page_id, pages.url, f.e AS blocked_by
FROM pages LEFT JOIN (SELECT page_id, arg_min(e, i * 1000 + n) AS e FROM c JOIN b USING (e) GROUP BY page_id) f USING (page_id)
"""
