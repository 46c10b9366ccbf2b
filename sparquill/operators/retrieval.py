"""Scoring and fusion of retrieval candidates. Tables: docs(doc_id, text), queries(query_id, query)."""
from __future__ import annotations

import hashlib
import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparquill.functions import text as T

#: Query tables go to every task up to this many rows and characters (some 100 MB as postings); beyond either, Catalyst chooses a join.
MAX_BROADCAST_QUERIES = 100_000
MAX_QUERY_CHARS = 10_000_000
#: Cells (texts x queries) that are scored at once.
CELLS = 4_000_000
_TOKENS = re.compile("[a-z0-9]+|[\u4e00-\u9fff]").findall
_BLANKS = re.compile("[ \t\n\r\f\v]+")


def small(df: DataFrame, limit: int = MAX_BROADCAST_QUERIES) -> DataFrame:
    """df as a broadcast side if it has at most limit rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, query, token, qtf, n, u): every token of a query, its count, tokens and different tokens of the query."""
    t = queries.select("query_id", T.normalized(F.col("query")).alias("query"), T.tokens(F.col("query")).alias("all"))
    t = t.withColumn("n", F.size("all")).withColumn("u", F.size(F.array_distinct("all")))
    return t.select("query_id", "query", "n", "u", F.explode("all").alias("token")).groupBy("query_id", "query", "n", "u", "token").agg(F.count("*").alias("qtf"))


def _lexical_join(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """lexical_scores() for query tables of any size: tokens are counted in each document before they meet the terms."""
    terms = query_terms(queries).drop("query")
    words = docs.select("doc_id", T.tokens(F.col("text")).alias("all")).select("doc_id", F.size("all").alias("c"), F.explode("all").alias("token"))
    counts = words.groupBy("doc_id", "c", "token").agg(F.count("*").alias("ctf"))
    pairs = counts.join(terms, "token").groupBy("query_id", "doc_id", "n", "u", "c").agg(F.count("*").alias("mt"), F.sum(F.least("qtf", "ctf")).alias("h"))
    whole = pairs.where("mt = u").select("query_id", F.col("doc_id").alias("d")).join(queries.select("query_id", T.normalized(F.col("query")).alias("query")), "query_id")
    phrase = whole.join(docs.select("doc_id", "text"), F.col("d") == F.col("doc_id")).where(F.contains(F.lower(T.collapsed(F.col("text"))), F.col("query"))).select("query_id", "doc_id", F.lit(0.2).alias("bonus"))
    score = 0.55 * F.col("mt") / F.col("u") + 0.3 * F.col("h") / F.col("n") + 0.15 * F.least(6 * F.col("h") / F.least("c", F.lit(300)), F.lit(1.0)) + F.coalesce("bonus", F.lit(0.0))
    return pairs.join(phrase, ["query_id", "doc_id"], "left").select("query_id", "doc_id", F.least(F.lit(1.0), score).alias("lexical"))


class Terms:
    """The terms of a bounded set of queries: postings (query, count) by term, and what a score needs of each query."""

    def __init__(self, queries: list[str]):
        tokens = [_TOKENS(q.lower()) for q in queries]
        self.phrase = [_BLANKS.sub(" ", q).strip(" ").lower() for q in queries]
        self.n = np.array([len(t) for t in tokens], np.float64)
        self.u = np.array([len(set(t)) for t in tokens], np.int64)
        self.term: dict[str, int] = {}
        rows = sorted((self.term.setdefault(t, len(self.term)), q, f) for q, own in enumerate(tokens) for t, f in Counter(own).items())
        at, self.query, self.count = (np.array(x, np.int64) for x in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 3
        self.first = np.searchsorted(at, np.arange(len(self.term) + 1))

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, query, score) of the pairs that share a term."""
        get = self.term.get
        lists = [_TOKENS(t.lower()) for t in texts]
        c = np.array([len(x) for x in lists], np.float64)
        found = [[i for t in x if (i := get(t)) is not None] for x in lists]
        doc = np.repeat(np.arange(len(texts)), [len(x) for x in found])
        return self.counted(texts, c, doc, np.fromiter((i for x in found for i in x), np.int64, len(doc)))

    def counted(self, texts: list[str], c: np.ndarray, doc: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """scores() from the number of tokens of each text, and the text and the term of every token that is one."""
        q = len(self.n)
        key, ctf = np.unique(doc * len(self.term) + term, return_counts=True)
        doc, term = key // max(1, len(self.term)), key % max(1, len(self.term))
        length = self.first[term + 1] - self.first[term]
        at = np.repeat(self.first[term] - np.concatenate([[0], np.cumsum(length)[:-1]]) if len(term) else term, length) + np.arange(length.sum())
        pair = np.repeat(doc, length) * q + self.query[at]
        mt = np.bincount(pair, minlength=len(texts) * q)
        h = np.bincount(pair, weights=np.minimum(self.count[at], np.repeat(ctf, length)), minlength=len(texts) * q)
        pair = np.flatnonzero(mt)
        mt, h, d, q = mt[pair], h[pair], pair // q, pair % q
        bonus = np.zeros(len(pair))
        low: dict[int, str] = {}
        for i in np.flatnonzero(mt == self.u[q]):
            text = low.get(d[i]) or low.setdefault(d[i], _BLANKS.sub(" ", texts[d[i]]).lower())
            bonus[i] = 0.2 if self.phrase[q[i]] in text else 0.0
        score = 0.55 * mt / self.u[q] + 0.3 * h / self.n[q] + 0.15 * np.minimum(6 * h / np.minimum(c[d], 300), 1.0) + bonus
        return d, q, np.minimum(1.0, score)


def best(q: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of what can be among the k best of its query once scores are rounded to 6 places: ties stay."""
    order = np.lexsort((-score, q))
    first = np.searchsorted(q[order], q[order])
    rank = np.arange(len(order)) - first
    last = score[order][np.minimum(first + k - 1, len(order) - 1)]
    return order[(rank < k) | ((q[order][np.minimum(first + k - 1, len(order) - 1)] == q[order]) & (score[order] >= last - 2e-6))]


def _scored(docs: DataFrame, query_ids: list, kind: str, name: str, scores: Callable[[list[str]], tuple], k: int | None) -> DataFrame:
    """(query_id, doc_id, score): scores() over batches of texts; with k, a task hands out what can be among its k best of a query."""
    cells = max(1, len(query_ids))
    rows, doc_kind = max(1, min(256, CELLS // cells)), docs.schema["doc_id"].dataType.simpleString()
    ids = pa.array(query_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size, doc_type = 0, None

        def out(parts: list) -> pa.RecordBatch:
            d, q, s = (np.concatenate(x) for x in zip(*parts))
            return pa.RecordBatch.from_arrays([ids.take(pa.array(q)), pa.array(d.tolist(), doc_type), pa.array(s)], ["query_id", "doc_id", name])

        def pruned(parts: list) -> list:
            d, q, s = (np.concatenate(x) for x in zip(*parts))
            at = best(q, s, k)
            return [(d[at], q[at], s[at])]

        for batch in batches:
            doc_type = batch.schema.field(0).type
            for i in range(0, batch.num_rows, rows):
                part = batch.slice(i, rows)
                own = part.column(0).to_numpy(zero_copy_only=False)
                d, q, s = scores([t or "" for t in part.column(1).to_pylist()])
                if not len(d):
                    continue
                held.append((own[d], q, s))
                size += len(d)
                if k is None and size > CELLS // 4:
                    yield out(held)
                    held, size = [], 0
                elif k is not None and size > 4 * k * cells + CELLS // 4:
                    held = pruned(held)
                    size = len(held[0][0])
        if held:
            yield out(held if k is None else pruned(held))

    return docs.select("doc_id", "text").mapInArrow(run, f"query_id {kind}, doc_id {doc_kind}, `{name}` double")


def small_queries(queries: DataFrame) -> tuple[list, list[str], str] | None:
    """Ids and texts of a query table of at most MAX_BROADCAST_QUERIES rows and MAX_QUERY_CHARS characters, else None.

    A null text is a query without tokens; of one id the least text counts.
    """
    rows, chars = queries.limit(MAX_BROADCAST_QUERIES + 1).agg(F.count("*"), F.sum(F.length("query"))).first()
    if rows > MAX_BROADCAST_QUERIES or (chars or 0) > MAX_QUERY_CHARS:
        return None
    found = {r["query_id"]: r["query"] or "" for r in queries.select("query_id", "query").orderBy(F.desc("query")).collect()}
    return list(found), list(found.values()), queries.schema["query_id"].dataType.simpleString()


def lexical_scores(docs: DataFrame, queries: DataFrame, k: int | None = None) -> DataFrame:
    """(query_id, doc_id, lexical) of every pair that shares a token; with k, at least all that can be among a query's k best.

    A bounded set of queries goes to the documents as postings: a document is scored where it is, and with k only a task's
    best shuffle. A larger set is joined on tokens that were counted in each document before.
    """
    small_set = small_queries(queries)
    if small_set is None:
        return _lexical_join(docs, queries)
    ids, texts, kind = small_set
    return _scored(docs, ids, kind, "lexical", Terms(texts).scores, k)


def top_k(scored: DataFrame, k: int, score: str, by: str = "query_id", tie: str = "doc_id") -> DataFrame:
    """The k best rows of each query with their rank; ties by id."""
    order = Window.partitionBy(by).orderBy(F.desc(score), tie)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


@lru_cache(maxsize=1 << 17)
def _hashed(token: str, dimension: int) -> tuple[int, int]:
    """A token's bucket and sign."""
    h = hashlib.sha256(token.encode()).digest()
    return int.from_bytes(h[:4], "big") % dimension, 1 if h[4] % 2 == 0 else -1


def bow_matrix(texts: list[str], dimension: int) -> np.ndarray:
    """Signed-hash bag-of-words rows of length 1, or of zeros where the counts cancel out."""
    out = np.zeros((len(texts), dimension))
    for row, text in zip(out, texts):
        counts = Counter(_TOKENS(text.lower()))
        if counts:
            at = np.array([_hashed(t, dimension) for t in counts])
            np.add.at(row, at[:, 0], at[:, 1] * np.fromiter(counts.values(), np.int64, len(counts)))
    size = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, size, out=out, where=size > 0)


def hashed_bow(texts: DataFrame, id_col: str, text_col: str, dimension: int = 128) -> DataFrame:
    """(id, bucket, value): sparse signed-hash bag-of-words vectors of length 1; texts whose counts cancel out have no rows."""
    kind = texts.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, 512) for whole in batches for i in range(0, whole.num_rows, 512)):
            x = bow_matrix([t or "" for t in batch.column(1).to_pylist()], dimension)
            row, bucket = np.nonzero(x)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(bucket), pa.array(x[row, bucket])], [id_col, "bucket", "value"])

    return texts.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, bucket long, value double")


def bow_scores(docs: DataFrame, queries: DataFrame, dimension: int = 128, k: int | None = None) -> DataFrame:
    """(query_id, doc_id, vector): cosines above 0 of hashed vectors; with k, at least all that can be among a query's k best.

    Bounded query sets go to the documents as one matrix; larger ones are joined on the buckets.
    """
    small_set = small_queries(queries)
    if small_set is None:
        d = hashed_bow(docs, "doc_id", "text", dimension)
        q = hashed_bow(queries, "query_id", "query", dimension).withColumnRenamed("value", "qv")
        return d.join(q, "bucket").groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("value") * F.col("qv")), 9).alias("vector")).where("vector > 0")
    ids, texts, kind = small_set
    matrix = bow_matrix(texts, dimension).T

    def scores(own: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        s = bow_matrix(own, dimension) @ matrix
        d, q = np.nonzero(s > 1e-9)
        return d, q, s[d, q]

    return _scored(docs, ids, kind, "vector", scores, k).withColumn("vector", F.round("vector", 9))


def metadata_score(query: Column, title: Column, headings: Column, locator: Column, source_type: Column, page: Column) -> Column:
    """Share of a query's different tokens that the metadata has, times 0.7; 0.25 for a title in the query or around it, 0.15 for a page that it names."""
    own = F.array_distinct(T.tokens(query))
    paged = F.when(page.isNotNull(), F.concat(F.lit("page "), page.cast("string")))
    there = F.array_distinct(T.tokens(F.concat_ws(" ", title, F.array_join(headings, " "), locator, source_type, paged)))
    low, small = T.normalized(query), T.normalized(F.coalesce(title, F.lit("")))
    titled = (small != "") & (F.contains(low, small) | F.contains(small, low))
    named = page.isNotNull() & (F.array_contains(own, page.cast("string")) | F.contains(low, paged))
    score = 0.7 * F.size(F.array_intersect(own, there)) / F.greatest(F.size(own), F.lit(1)) + F.when(titled, 0.25).otherwise(0.0) + F.when(F.coalesce(named, F.lit(False)), 0.15).otherwise(0.0)
    return F.when((F.size(own) > 0) & (F.size(there) > 0), F.least(F.lit(1.0), score)).otherwise(F.lit(0.0))


#: A table's metadata columns where it has none of them.
NO_METADATA = {"title": "string", "headings": "array<string>", "locator": "string", "source_type": "string", "page": "int"}


def with_metadata(rows: DataFrame) -> DataFrame:
    """rows with every metadata column, null where there was none."""
    return rows.withColumns({c: F.lit(None).cast(kind) for c, kind in NO_METADATA.items() if c not in rows.columns})


def fused(vector: DataFrame, lexical: DataFrame, k: int, queries: DataFrame | None = None, metadata: DataFrame | None = None) -> DataFrame:
    """The k best of both arms: 0.55 and 0.35 of the scores against each arm's best, 0.1 of metadata_score(), 0.03 for indexed documents.

    metadata: (doc_id and some of NO_METADATA); only the arms' candidates, a few a query, meet it.
    """
    limit = max(4 * k, 12)
    v = top_k(vector, limit, "vector").drop("rank")
    x = top_k(lexical, limit, "lexical").drop("rank")
    return blended(v.join(x, ["query_id", "doc_id"], "full_outer"), k, queries, metadata)


def blended(both: DataFrame, k: int, queries: DataFrame | None = None, metadata: DataFrame | None = None) -> DataFrame:
    """fused() of (query_id, doc_id, vector, lexical), the arms' best, null where an arm has none."""
    if queries is not None and metadata is not None:
        both = both.join(small(queries.select("query_id", "query")), "query_id").join(with_metadata(metadata), "doc_id")
        both = both.withColumn("metadata", metadata_score(*(F.col(c) for c in ("query", *NO_METADATA)))).drop("query", *NO_METADATA)
    else:
        both = both.withColumn("metadata", F.lit(0.0))
    w = Window.partitionBy("query_id")
    score = 0.55 * F.coalesce(F.col("vector") / F.max("vector").over(w), F.lit(0.0)) + 0.35 * F.coalesce(F.col("lexical") / F.max("lexical").over(w), F.lit(0.0)) + 0.1 * F.col("metadata")
    both = both.withColumn("score", F.round(F.least(F.lit(1.0), score + F.when(F.col("vector").isNotNull(), F.lit(0.03)).otherwise(F.lit(0.0))), 6))
    return top_k(both.where("score > 0"), k, "score").select("query_id", "doc_id", F.coalesce("vector", "score").alias("raw_vector"), "score", "rank")


class Keywords:
    """Terms and phrases of a bounded set of queries in one automaton: a text is read once, whatever their number."""

    def __init__(self, phrases: list[str], terms: list[list[str]]):
        import ahocorasick

        self.number: dict[str, int] = {}
        rows = [(self.number.setdefault(t, len(self.number)), q) for q, own in enumerate(terms) for t in own]
        rows += [(self.number.setdefault(p, len(self.number)), q) for q, p in enumerate(phrases) if p]
        n = len(self.number)
        kinds = np.repeat([0, 1], [sum(map(len, terms)), len(rows) - sum(map(len, terms))])
        order = sorted(range(len(rows)), key=lambda i: rows[i][0])
        self.word, self.query, self.kind = (np.array([x[i] for i in order], np.int64) for x in ([r[0] for r in rows], [r[1] for r in rows], kinds))
        self.first = np.searchsorted(self.word, np.arange(n + 1))
        self.technical = np.array([any(c in "_-/.{}" or c.isdigit() for c in t) for t in self.number], bool)
        self.sizes = np.array([len(t) for t in terms], np.float64)
        self.automaton = ahocorasick.Automaton()
        for t, i in self.number.items():
            self.automaton.add_word(t, i)
        if n:
            self.automaton.make_automaton()

    def _postings(self, found: list[int]) -> np.ndarray:
        at = np.fromiter(found, np.int64, len(found))
        length = self.first[at + 1] - self.first[at]
        return np.repeat(self.first[at] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum()) if len(at) else at

    def score(self, text: str, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, score, matched terms) of the queries that share a term with a normalised text."""
        queries = len(self.sizes)
        found = list({i for _, i in self.automaton.iter(text)}) if self.number else []
        at = self._postings(found)
        term, phrase = at[self.kind[at] == 0], at[self.kind[at] == 1]
        matched = np.bincount(self.query[term], minlength=queries)
        technical = np.bincount(self.query[term], weights=self.technical[self.word[term]], minlength=queries)
        bonus = np.zeros(queries)
        bonus[self.query[phrase]] = 0.25
        if name and found:
            named = self._postings(list({i for _, i in self.automaton.iter(name)}))
            bonus[np.unique(self.query[named[self.kind[named] == 0]])] += 0.2
        q = np.flatnonzero(matched)
        return q, np.minimum(1.5, matched[q] / self.sizes[q] + bonus[q] + np.minimum(0.25, 0.05 * technical[q])), matched[q]


def searchable(docs: DataFrame) -> list[Column]:
    """What keywords are looked for in: text, name and metadata as s, and the name."""
    part = lambda c: T.normalized(F.coalesce(F.col(c), F.lit(""))) if c in docs.columns else F.lit("")
    return [F.array_join(F.filter(F.array(part("text"), part("name"), part("metadata")), lambda x: x != ""), " ").alias("s"), part("name").alias("name")]


def keyword_scores(docs: DataFrame, queries: DataFrame, k: int | None = None, least: float = 0.05) -> DataFrame:
    """(query_id, doc_id, keyword, matched) by substring matches of each query's expanded terms in text, name and metadata.

    docs: doc_id, text and, where there are any, name and metadata. A query's phrase counts 0.25, a term in the name 0.2,
    technical terms 0.05 each. Of more queries than fit in a task's memory, blocks are matched one after another.
    """
    from sparquill.functions import questions as Q

    n, chars = queries.agg(F.count("*"), F.sum(F.length("query"))).first()
    blocks = -(-n // MAX_BROADCAST_QUERIES) + (chars or 0) // MAX_QUERY_CHARS
    if blocks > 1:
        at = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
        return reduce(DataFrame.unionAll, (keyword_scores(docs, queries.where(at == i), k, least) for i in range(blocks)))
    made = [r for r in queries.select("query_id", T.normalized(F.col("query")).alias("phrase"), Q.terms(F.col("query")).alias("terms")).collect() if r["terms"]]
    ids, kind, doc_kind = pa.array([r["query_id"] for r in made]), queries.schema["query_id"].dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString()
    phrases, terms = [r["phrase"] for r in made], [list(r["terms"]) for r in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, size = Keywords(phrases, terms), [], 0
        for batch in batches:
            doc_type = batch.schema.field(0).type

            def out(parts: list, doc_type=doc_type) -> pa.RecordBatch:
                d, q, s, m = (np.concatenate(x) for x in zip(*parts))
                at = best(q, s, k) if k is not None else np.arange(len(q))
                return pa.RecordBatch.from_arrays([ids.take(pa.array(q[at])), pa.array(d[at].tolist(), doc_type), pa.array(s[at]), pa.array(m[at].astype(np.int32))], ["query_id", "doc_id", "keyword", "matched"])

            for doc, text, name in zip(*(batch.column(i).to_pylist() for i in range(3))):
                q, s, m = words.score(text, name)
                some = s >= least - 1e-9
                held.append((np.full(some.sum(), doc), q[some], s[some], m[some]))
                size += some.sum()
                if size > CELLS // 8:
                    yield out(held)
                    held, size = [], 0
        if size:
            yield out(held)

    rows = docs.where("doc_id IS NOT NULL").select("doc_id", *searchable(docs))
    found = rows.mapInArrow(run, f"query_id {kind}, doc_id {doc_kind}, keyword double, matched int")
    return found.withColumn("keyword", F.round("keyword", 6)).where(F.col("keyword") >= least)


class Codes(dict):
    """Tokens as numbers, with the place of their signed hash (bucket, or dimension + bucket for a negative one) and their number among terms, or -1."""

    def __init__(self, term: dict[str, int], dimension: int):
        super().__init__()
        self.terms, self.dimension, self.place, self.term = term, dimension, array("q"), array("q")

    def __missing__(self, token: str) -> int:
        bucket, sign = _hashed(token, self.dimension)
        self.place.append(bucket if sign > 0 else self.dimension + bucket)
        self.term.append(self.terms.get(token, -1))
        self[token] = code = len(self)
        return code


class Arms:
    """The lexical and the vector arm over one set of tokens: a text is taken apart once."""

    def __init__(self, queries: list[str], dimension: int = 128):
        self.terms, self.dimension = Terms(queries), dimension
        self.matrix = bow_matrix(queries, dimension).T
        self.codes = Codes(self.terms.term, dimension)

    def scores(self, texts: list[str]) -> tuple[tuple, tuple]:
        """(text, query, score) of Terms.scores(), and of the cosines above 0."""
        if len(self.codes) > 1 << 18:
            self.codes = Codes(self.terms.term, self.dimension)
        lists = [_TOKENS(t.lower()) for t in texts]
        c = np.array([len(x) for x in lists], np.int64)
        doc = np.repeat(np.arange(len(texts)), c)
        code = np.fromiter(map(self.codes.__getitem__, chain.from_iterable(lists)), np.int64, len(doc))
        place, term = (np.array(x, np.int64)[code] for x in (self.codes.place, self.codes.term))
        n = self.dimension
        counts = np.bincount(doc * 2 * n + place, minlength=len(texts) * 2 * n).reshape(len(texts), 2, n)
        x = (counts[:, 0] - counts[:, 1]).astype(np.float64)
        size = np.sqrt((x * x).sum(axis=1, keepdims=True))
        s = np.divide(x, size, out=x, where=size > 0) @ self.matrix
        d, q = np.nonzero(s > 1e-9)
        known = term >= 0
        return self.terms.counted(texts, c.astype(np.float64), doc[known], term[known]), (d, q, s[d, q])


def hybrid_candidates(docs: DataFrame, queries: DataFrame, limits: dict[str, int], least: float = 0.05) -> DataFrame | None:
    """(query_id, doc_id, vector, lexical, keyword): the best of each arm, as many as limits has for it, null where an arm has no such document.

    docs: as for keyword_scores(). Documents are read once for all arms; None for a query table that is no small one.
    """
    from sparquill.functions import questions as Q

    small_set = small_queries(queries)
    if small_set is None:
        return None
    ids, texts, kind = small_set
    asked = [r for r in queries.select("query_id", T.normalized(F.col("query")).alias("phrase"), Q.terms(F.col("query")).alias("terms")).collect() if r["terms"]]
    phrases, terms, doc_kind = [r["phrase"] for r in asked], [list(r["terms"]) for r in asked], docs.schema["doc_id"].dataType.simpleString()
    by_arm = {"lexical": pa.array(ids), "vector": pa.array(ids), "keyword": pa.array([r["query_id"] for r in asked])}
    rows = max(1, min(256, CELLS // max(1, len(ids))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arms, words = Arms(texts), Keywords(phrases, terms)
        held: dict[str, list] = {a: [] for a in by_arm}
        size, doc_type = dict.fromkeys(by_arm, 0), None

        # What a query's score must reach here: its k-th best so far, less what rounding may change.
        floor = {a: np.full(len(names), -np.inf) for a, names in by_arm.items()}

        def add(arm: str, own: np.ndarray, d: np.ndarray, q: np.ndarray, s: np.ndarray) -> None:
            at = np.flatnonzero(s >= floor[arm][q])
            held[arm].append((own[d[at]], q[at], s[at]))
            size[arm] += len(at)
            if size[arm] > 4 * limits[arm] * len(by_arm[arm]):
                prune(arm)

        def prune(arm: str) -> None:
            d, q, s = (np.concatenate(x) for x in zip(*held[arm]))
            at, k = best(q, s, limits[arm]), limits[arm]
            d, q, s = d[at], q[at], s[at]
            held[arm], size[arm] = [(d, q, s)], len(at)
            last = np.searchsorted(q, np.arange(len(floor[arm]))) + k - 1
            full = np.flatnonzero((last < len(q)) & (q[np.minimum(last, len(q) - 1)] == np.arange(len(last))))
            floor[arm][full] = s[last[full]] - 2e-6

        for whole in batches:
            doc_type = whole.schema.field(0).type
            for batch in (whole.slice(i, rows) for i in range(0, whole.num_rows, rows)):
                own = batch.column(0).to_numpy(zero_copy_only=False)
                lexical, vector = arms.scores([t or "" for t in batch.column(1).to_pylist()])
                add("lexical", own, *lexical)
                add("vector", own, *vector)
                for i, (text, name) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                    q, s, _ = words.score(text, name)
                    some = s >= least - 1e-9
                    add("keyword", own, np.full(some.sum(), i), q[some], s[some])
        for arm, names in by_arm.items():
            if size[arm]:
                prune(arm)
                d, q, s = held[arm][0]
                yield pa.RecordBatch.from_arrays([pa.array([arm] * len(d)), names.take(pa.array(q)), pa.array(d.tolist(), doc_type), pa.array(s)], ["arm", "query_id", "doc_id", "score"])

    found = docs.where("doc_id IS NOT NULL").select("doc_id", "text", *searchable(docs)).mapInArrow(run, f"arm string, query_id {kind}, doc_id {doc_kind}, score double")
    score = F.round(F.when(F.col("arm") == "vector", F.round("score", 9)).otherwise(F.col("score")), 6)
    found = found.withColumn("score", score).where(F.when(F.col("arm") == "keyword", F.col("score") >= least).when(F.col("arm") == "vector", F.col("score") > 0).otherwise(F.lit(True)))
    rank = F.row_number().over(Window.partitionBy("query_id", "arm").orderBy(F.desc("score"), "doc_id"))
    most = reduce(lambda other, a: F.when(F.col("arm") == a, limits[a]).otherwise(other), limits, F.lit(0))
    return found.withColumn("_r", rank).where(F.col("_r") <= most).groupBy("query_id", "doc_id").agg(*(F.max(F.when(F.col("arm") == a, F.col("score"))).alias(a) for a in ("vector", "lexical", "keyword")))


def fused_text(hybrid: DataFrame, keyword: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, merged, sources, rank) of both arms: 0.7 and 0.3 of the scores against each arm's best where both have a document, else the score itself.

    hybrid: (query_id, doc_id, raw_vector); keyword: (query_id, doc_id, keyword). Arms' best are those of the query.
    """
    w = Window.partitionBy("query_id")
    both = hybrid.select("query_id", "doc_id", "raw_vector").join(keyword.select("query_id", "doc_id", "keyword"), ["query_id", "doc_id"], "full_outer")
    both = both.withColumn("h", F.col("raw_vector") / F.max("raw_vector").over(w)).withColumn("y", F.col("keyword") / F.max("keyword").over(w))
    merged = F.when(F.col("h").isNotNull() & F.col("y").isNotNull(), 0.7 * F.least(F.lit(1.0), "h") + 0.3 * F.least(F.lit(1.0), "y")).otherwise(F.coalesce("keyword", "raw_vector"))
    sources = F.concat_ws("+", F.when(F.col("raw_vector").isNotNull(), F.lit("vector")), F.when(F.col("keyword").isNotNull(), F.lit("keyword")))
    return top_k(both.select("query_id", "doc_id", F.round(merged, 6).alias("merged"), sources.alias("sources")), k, "merged")


def rerank_scores(candidates: DataFrame) -> DataFrame:
    """Rule-based reranking of (query_id, query, doc_id, text): phrase, token overlap, clipped counts, and tokens in ``metadata`` if there is such a column."""
    q, d = T.tokens(F.col("query")), T.tokens(F.col("text"))
    meta = T.tokens(F.col("metadata")) if "metadata" in candidates.columns else F.array().cast("array<string>")
    rows = candidates.select("query_id", "doc_id", q.alias("q"), d.alias("d"), meta.alias("m"), F.contains(T.normalized(F.col("text")), T.normalized(F.col("query"))).alias("phrase"))
    u = F.array_distinct("q")
    count = lambda a, t: F.size(F.filter(a, lambda x: x == t))
    clipped = F.aggregate(F.transform(F.array_intersect("q", "d"), lambda t: F.least(count(F.col("q"), t), count(F.col("d"), t))), F.lit(0), lambda s, x: s + x)
    n = F.greatest(F.lit(1), F.size(u))
    score = F.when(F.col("phrase"), 0.35).otherwise(0.0) + 0.45 * F.size(F.array_intersect("q", "d")) / n + 0.15 * clipped / F.greatest(F.lit(1), F.size("q")) + 0.05 * F.size(F.array_intersect("q", F.coalesce("m", F.array().cast("array<string>")))) / n
    return rows.select("query_id", "doc_id", F.round(F.least(F.lit(1.0), score), 6).alias("rerank"))


def prepared_rerank(candidates: DataFrame) -> DataFrame:
    """(query_id, doc_id, coverage, quality, section_match, rerank) of (query_id, query, doc_id, text, score) with metadata columns: what diversity selection starts from."""
    rows = with_metadata(candidates)
    q, d = F.array_distinct(T.tokens(F.col("query"))), F.array_distinct(T.tokens(F.col("text")))
    rows = rows.withColumn("q", q).withColumn("d", d).withColumn("n", F.greatest(F.lit(1), F.size("q")))
    both = F.size(F.array_intersect("q", "d"))
    coverage = F.when(F.size("d") > 0, F.least(F.lit(1.0), 0.8 * both / F.col("n") + 0.2 * F.least(8 * both / F.least(F.size("d"), F.lit(200)), F.lit(1.0)))).otherwise(F.lit(0.0))
    paged = F.when(F.col("page").isNotNull(), F.concat(F.lit("page "), F.col("page").cast("string")))
    meta = F.array_distinct(T.tokens(F.concat_ws(" ", "title", F.array_join("headings", " "), "locator", paged, "source_type")))
    head = F.concat_ws(" ", "title", F.array_join("headings", " "))
    section = F.when(F.trim(head) == "", F.lit(0.0)).when(F.contains(T.normalized(head), T.normalized(F.col("query"))), F.lit(1.0)).otherwise(F.size(F.array_intersect("q", T.tokens(head))) / F.col("n"))
    rows = rows.withColumn("coverage", coverage).withColumn("quality", F.size(F.array_intersect("q", meta)) / F.col("n")).withColumn("section_match", section)
    score = F.least(F.lit(1.0), 0.6 * F.col("score") + 0.2 * F.col("coverage") + 0.12 * F.col("quality") + 0.08 * F.col("section_match"))
    return rows.select("query_id", "doc_id", *(F.round(c, 6).alias(c) for c in ("coverage", "quality", "section_match")), F.round(score, 6).alias("rerank"))


STRONG, WEAK = "。！？；.!?;", "，,、：:"


def boundary(text: Column, limit: Column) -> Column:
    """Where a collapsed text is best cut before limit: after its last strong mark, else weak mark, in the second half; else at the last blank of the last third; else null."""
    head = F.substr(text, F.lit(1), limit)
    last = lambda marks: F.length(F.regexp_extract(head, f"(?s)^(.*[{marks}])", 1))
    half, third = F.greatest(F.lit(1), F.floor(limit / 2)), F.greatest(F.lit(1), F.floor(limit * 2 / 3))
    blank = F.length(F.regexp_extract(head, "(?s)^(.*) ", 1))
    return F.when(last(STRONG) > half, last(STRONG)).when(last(WEAK) > half, last(WEAK)).when(blank >= third, blank)


def snippet(rows: DataFrame, text: str = "text", most: int = 260, out: str = "snippet") -> DataFrame:
    """rows with the start of their text, cut at a boundary near ``most`` characters."""
    rows = rows.withColumn("_t", F.trim(T.collapsed(F.col(text)))).withColumn("_b", boundary(F.col("_t"), F.least(F.length("_t"), F.lit(most + max(40, most // 3)))))
    cut = F.regexp_replace(F.substr("_t", F.lit(1), F.col("_b")), f"[ {WEAK}]+$", "")
    short = F.when(F.length("_t") <= most, F.col("_t")).when(F.col("_b").isNull(), F.concat(F.rtrim(F.substring("_t", 1, most - 3)), F.lit("..."))).when(F.length(cut) == F.length("_t"), cut).otherwise(F.concat(cut, F.lit("...")))
    return rows.withColumn(out, short).drop("_t", "_b")


def query_snippet(rows: DataFrame, most: int = 260, out: str = "snippet") -> DataFrame:
    """rows of (query, text) with the part of the text around the query, or around its first token that occurs, between boundaries."""
    back, over = 80, max(40, most // 3)
    rows = snippet(rows, "text", most, "_start")
    rows = rows.withColumn("_t", F.trim(T.collapsed(F.col("text")))).withColumn("_l", F.lower("_t")).withColumn("_n", F.length("_t"))
    phrase = F.instr("_l", T.normalized(F.col("query"))) - 1
    places = F.filter(F.transform(F.array_distinct(T.tokens(F.col("query"))), lambda t: F.instr(F.col("_l"), t) - 1), lambda p: p >= 0)
    rows = rows.withColumn("_a", F.when((T.normalized(F.col("query")) != "") & (phrase >= 0), phrase).otherwise(F.get(places, F.lit(0))))
    first = F.greatest(F.lit(0), F.col("_a") - most // 3)
    rows = rows.withColumn("_e", F.least(F.col("_n"), first + most)).withColumn("_s", F.when(F.col("_e") - first < most, F.greatest(F.lit(0), F.col("_e") - most)).otherwise(first))
    before = F.substr("_t", F.greatest(F.lit(0), F.col("_s") - back) + 1, F.least(F.col("_s"), F.lit(back)))
    snapped = F.length(F.regexp_extract(before, f"(?s)^(.*[{STRONG}{WEAK}])", 1))
    rows = rows.withColumn("_s2", F.when(snapped > 0, F.greatest(F.lit(0), F.col("_s") - back) + snapped).otherwise(F.col("_s")))
    rows = rows.withColumn("_w", F.trim(F.substr("_t", F.col("_s2") + 1, F.least(F.col("_n"), F.col("_e") + over) - F.col("_s2"))))
    rows = rows.withColumn("_b", boundary(F.col("_w"), F.least(F.length("_w"), F.greatest(F.least(F.col("_n"), F.col("_e") + over) - F.col("_s2"), F.col("_e") - F.col("_s2")))))
    rows = rows.withColumn("_e2", F.when(F.col("_b").isNotNull(), F.col("_s2") + F.col("_b")).otherwise(F.col("_e")))
    body = F.trim(F.substr("_t", F.col("_s2") + 1, F.col("_e2") - F.col("_s2")))
    around = F.concat(F.when(F.col("_s2") > 0, F.lit("...")).otherwise(F.lit("")), body, F.when(F.col("_e2") < F.col("_n"), F.lit("...")).otherwise(F.lit("")))
    made = F.when(F.col("_n") <= most, F.col("_t")).when(F.col("_a").isNull(), F.col("_start")).otherwise(around)
    return rows.withColumn(out, made).drop("_start", "_t", "_l", "_n", "_a", "_e", "_s", "_s2", "_w", "_b", "_e2")


#: Queries of a vector search that go to every task at once, some 50 MB; more are searched in blocks.
QUERY_BYTES = 1 << 26


def vector_neighbours(vectors: DataFrame, queries: DataFrame, id_col: str, vec_col: str, k: int) -> DataFrame:
    """(query_id, vec_id, score, rank): for every row of queries (same columns) its k nearest other rows of vectors of a cosine above 0; ties by id.

    Exact search in one pass: the queries' matrix goes to the vectors, each task keeps its k best of a query and only those
    shuffle. Null and empty vectors, null ids and vectors of another length than the query's have no neighbours.
    """
    clean = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("id IS NOT NULL AND size(v) > 0 AND NOT exists(v, x -> x IS NULL)")
    asked = clean(queries)
    n, dim = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    blocks = max(1, -(-n * 8 * (dim or 1) // QUERY_BYTES))
    parts = (asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i).collect() for i in range(blocks))
    found = [clean(vectors).mapInArrow(_nearest(np.array([r["id"] for r in rows], np.int64), [r["v"] for r in rows], k), "query_id long, vec_id long, score double") for rows in parts]
    return top_k(reduce(DataFrame.unionAll, found).withColumn("score", F.round("score", 6)).where("score > 0"), k, "score", tie="vec_id")


def _unit(rows: list) -> np.ndarray:
    x = np.asarray(rows, np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _nearest(ids: np.ndarray, rows: list, k: int):
    groups = {d: np.flatnonzero([len(r) == d for r in rows]) for d in {len(r) for r in rows}}
    sides = {d: (at, _unit([rows[i] for i in at])) for d, at in groups.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in (whole.slice(i, 1024) for whole in batches for i in range(0, whole.num_rows, 1024)):
            own, vectors = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for d, (at, side) in sides.items():
                same = np.flatnonzero([len(v) == d for v in vectors])
                if not len(same):
                    continue
                s = side @ _unit([vectors[i] for i in same]).T
                s[ids[at][:, None] == own[same][None, :]] = -2
                # The k-th best of each query here, and all that reach it: ties are settled by id later.
                least = np.maximum(np.partition(s, max(0, len(same) - k), axis=1)[:, max(0, len(same) - k)] - 2e-6, 1e-12)
                q, j = np.nonzero(s >= least[:, None])
                held.append((at[q], own[same][j], s[q, j]))
                size += len(q)
            if size > 8 * k * max(1, len(ids)) + CELLS // 8:
                q, v, s = (np.concatenate(x) for x in zip(*held))
                keep = best(q, s, k)
                held, size = [(q[keep], v[keep], s[keep])], len(keep)
        if held:
            q, v, s = (np.concatenate(x) for x in zip(*held))
            keep = best(q, s, k)
            yield pa.RecordBatch.from_arrays([pa.array(ids[q[keep]]), pa.array(v[keep]), pa.array(s[keep])], ["query_id", "vec_id", "score"])

    return run
