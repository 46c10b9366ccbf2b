"""Retrieval queries over the driver tables: documents are chunks, benchmark passages are queries."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparquill.functions import text as T
from sparquill.operators import retrieval as R
from sparquill.sources import kept, table

def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's metadata: its source as locator, its language as source type."""
    return table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("locator"), F.col("lang").alias("source_type"))


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a file name and their metadata as text, for keyword matching."""
    return table(spark, sf_dir, "documents").select("doc_id", "text", F.concat("source", F.lit(".txt")).alias("name"), F.col("lang").alias("metadata"))


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def lexical_topk(spark, sf_dir):
    found = R.top_k(R.lexical_scores(_docs(spark, sf_dir), _queries(spark, sf_dir), 10).withColumn("lexical", F.round("lexical", 6)), 10, "lexical")
    return found.select("query_id", "doc_id", "lexical", "rank")


TOK = r"regexp_extract_all(lower({x}), '[A-Za-z0-9]+|[\x{{4e00}}-\x{{9fff}}]')"
_LEX = rf"""
qt AS (SELECT item_id AS query_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS query, {TOK.format(x='text')} AS toks FROM benchmark),
qx AS (SELECT query_id, query, len(toks) AS n, len(list_distinct(toks)) AS u, unnest(toks) AS token FROM qt),
q AS (SELECT query_id, query, n, u, token, count(*) AS qtf FROM qx GROUP BY ALL),
dt AS (SELECT doc_id, text, {TOK.format(x='text')} AS toks FROM documents),
dx AS (SELECT doc_id, len(toks) AS c, unnest(toks) AS token FROM dt),
d AS (SELECT doc_id, c, token, count(*) AS ctf FROM dx GROUP BY ALL),
p AS (SELECT query_id, doc_id, query, n, u, c, count(*) AS mt, sum(least(qtf, ctf)) AS h FROM q JOIN d USING (token) GROUP BY ALL),
lexical AS (SELECT query_id, doc_id, least(1.0::DOUBLE, 0.55::DOUBLE * mt / u + 0.3::DOUBLE * h / n + 0.15::DOUBLE * least(6::DOUBLE * h / least(c, 300), 1.0::DOUBLE)
  + CASE WHEN mt = u AND contains(lower(regexp_replace(text, '\s+', ' ', 'g')), query) THEN 0.2::DOUBLE ELSE 0 END) AS lexical FROM p JOIN documents USING (doc_id))"""
LEXICAL_SQL = f"""WITH {_LEX}, r AS (SELECT query_id, doc_id, round(lexical, 6) AS lexical FROM lexical)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, doc_id)::INTEGER AS rank FROM r QUALIFY rank <= 10"""


def hashed_bow_vectors(spark, sf_dir):
    return R.hashed_bow(_docs(spark, sf_dir), "doc_id", "text").withColumn("value", F.round("value", 6))


def _bow(source: str, key: str, alias: str) -> str:
    return rf"""
{alias}w AS (SELECT {key} AS id, unnest({TOK.format(x='text')}) AS token FROM {source}),
{alias}c AS (SELECT id, token, count(*) AS n FROM {alias}w GROUP BY ALL),
{alias}b AS (SELECT id, CAST('0x' || substr(sha256(token), 1, 8) AS BIGINT) % 128 AS bucket, sum(n * CASE WHEN CAST('0x' || substr(sha256(token), 9, 2) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END) AS v FROM {alias}c GROUP BY ALL HAVING v <> 0),
{alias}v AS (SELECT id, bucket, v / sqrt(sum(v * v) OVER (PARTITION BY id)) AS value FROM {alias}b)"""


BOW_SQL = f"WITH {_bow('documents', 'doc_id', 'd')} SELECT id AS doc_id, bucket, round(value, 6) AS value FROM dv"


def hybrid_fusion_topk(spark, sf_dir):
    docs, queries = _docs(spark, sf_dir), _queries(spark, sf_dir)
    lexical = R.lexical_scores(docs, queries, 32).withColumn("lexical", F.round("lexical", 6))
    vector = R.bow_scores(docs, queries, k=32).withColumn("vector", F.round("vector", 6)).where("vector > 0")
    return R.fused(vector, lexical, 8, queries, _metadata(spark, sf_dir)).select("query_id", "doc_id", "score", "rank")


_META = f"len(list_intersect(list_distinct(q.toks), list_distinct({TOK.format(x="source || ' ' || lang")})))::DOUBLE / len(list_distinct(q.toks))"


def _fused_sql(k: int) -> str:
    limit = max(4 * k, 12)
    return f"""vs AS (SELECT qv.id AS query_id, dv.id AS doc_id, round(sum(dv.value * qv.value), 6) AS vector FROM dv JOIN qv USING (bucket) GROUP BY ALL HAVING vector > 0),
v AS (SELECT * FROM vs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY vector DESC, doc_id) <= {limit}),
ls AS (SELECT query_id, doc_id, round(lexical, 6) AS lexical FROM lexical),
x AS (SELECT * FROM ls QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, doc_id) <= {limit}),
c AS (SELECT query_id, doc_id, vector, lexical, least(1.0::DOUBLE, 0.7::DOUBLE * {_META}) AS metadata FROM (SELECT * FROM v FULL JOIN x USING (query_id, doc_id)) JOIN documents USING (doc_id) JOIN qt q USING (query_id)),
b AS (SELECT query_id, doc_id, vector, round(least(1.0::DOUBLE, 0.55::DOUBLE * coalesce(vector / max(vector) OVER w, 0) + 0.35::DOUBLE * coalesce(lexical / max(lexical) OVER w, 0) + 0.1::DOUBLE * metadata + CASE WHEN vector IS NOT NULL THEN 0.03::DOUBLE ELSE 0 END), 6) AS score
  FROM c WINDOW w AS (PARTITION BY query_id)),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM b WHERE score > 0 QUALIFY rank <= {k})"""


_ARMS = f"{_LEX}, {_bow('documents', 'doc_id', 'd')}, {_bow('benchmark', 'item_id', 'q')}"
FUSION_SQL = f"WITH {_ARMS}, {_fused_sql(8)} SELECT query_id, doc_id, score, rank FROM fused"


def vector_topk(spark, sf_dir):
    """The ten nearest vectors of every vector whose id is divisible by 100, against all."""
    v = table(spark, sf_dir, "embeddings")
    found = R.vector_neighbours(v, v.where("vec_id % 100 = 0"), "vec_id", "embedding", 10)
    labels = v.select("vec_id", "label")
    mine = labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label"))
    return found.join(mine, "query_id").join(labels, "vec_id").select("query_id", "query_label", "vec_id", "label", "score", "rank")


_VEC = """WITH s AS (
  SELECT q.vec_id AS query_id, q.label AS query_label, v.vec_id, v.label, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
  FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0
), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s WHERE score > 0 QUALIFY rank <= 10)"""
VECTOR_SQL = f"{_VEC} SELECT * FROM t"


def vector_label_hit_rate(spark, sf_dir):
    found = vector_topk(spark, sf_dir).withColumn("hit", F.col("label") == F.col("query_label"))
    per = found.groupBy("query_id", "query_label").agg(F.bool_or("hit").alias("hit"), F.bool_or(F.col("hit") & (F.col("rank") == 1)).alias("top1"), F.bool_or(F.col("hit") & (F.col("rank") <= 3)).alias("top3"), F.avg(F.col("hit").cast("int")).alias("precision"))
    return per.groupBy(F.col("query_label").alias("label")).agg(F.count("*").alias("queries"), F.round(F.avg(F.col("hit").cast("int")), 6).alias("hit_rate"), F.round(F.avg(F.col("top1").cast("int")), 6).alias("top1_rate"), F.round(F.avg(F.col("top3").cast("int")), 6).alias("top3_rate"), F.round(F.avg("precision"), 6).alias("precision"))


HIT_SQL = f"""{_VEC}, p AS (SELECT query_id, query_label, bool_or(label = query_label) AS hit, bool_or(label = query_label AND rank = 1) AS top1, bool_or(label = query_label AND rank <= 3) AS top3, avg((label = query_label)::INT) AS precision FROM t GROUP BY ALL)
SELECT query_label AS label, count(*) AS queries, round(avg(hit::INT), 6) AS hit_rate, round(avg(top1::INT), 6) AS top1_rate, round(avg(top3::INT), 6) AS top3_rate, round(avg(precision), 6) AS precision FROM p GROUP BY query_label"""


def keyword_topk(spark, sf_dir):
    """The 20 best documents of every passage by its expanded keyword terms."""
    found = R.keyword_scores(_named(spark, sf_dir), _queries(spark, sf_dir), 20)
    return R.top_k(found, 20, "keyword").select("query_id", "doc_id", "keyword", "matched", "rank")


def _keyword_sql() -> str:
    from sparquill.plans.questions import terms_sql

    norm = r"lower(trim(regexp_replace({0}, '\s+', ' ', 'g'), ' '))"
    return f"""kt AS (SELECT item_id AS query_id, {norm.format('text')} AS phrase, {terms_sql('text')} AS terms FROM benchmark),
kd AS (SELECT doc_id, {norm.format('text')} || ' ' || lower(source) || '.txt ' || lower(lang) AS s, lower(source) || '.txt' AS name FROM documents),
kw AS (SELECT DISTINCT unnest(terms) AS term FROM kt),
kh AS (SELECT doc_id, term, contains(name, term) AS named FROM kd JOIN kw ON contains(s, term)),
kq AS (SELECT query_id, len(terms) AS n, unnest(terms) AS term FROM kt),
km AS (SELECT query_id, doc_id, any_value(n) AS n, count(*) AS matched, bool_or(named) AS named, count(*) FILTER (regexp_matches(term, '[-_/.{{}}0-9]')) AS technical FROM kq JOIN kh USING (term) GROUP BY ALL),
ks AS (SELECT query_id, doc_id, matched::INTEGER AS matched, round(least(1.5::DOUBLE, matched::DOUBLE / n + CASE WHEN contains(s, phrase) AND phrase <> '' THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN named THEN 0.2::DOUBLE ELSE 0 END + least(0.25::DOUBLE, 0.05::DOUBLE * technical)), 6) AS keyword FROM km JOIN kt USING (query_id) JOIN kd USING (doc_id)),
keyworded AS (SELECT query_id, doc_id, keyword, matched, row_number() OVER (PARTITION BY query_id ORDER BY keyword DESC, doc_id)::INTEGER AS rank FROM ks WHERE keyword >= 0.05 QUALIFY rank <= 20)"""


KEYWORD_SQL = f"WITH {_keyword_sql()} SELECT * FROM keyworded"


def _merged(spark, sf_dir, k: int = 20) -> tuple[DataFrame, DataFrame]:
    """Each passage's k best keyword candidates, and the merged ones."""
    docs, queries = _docs(spark, sf_dir), _queries(spark, sf_dir)
    arms = R.hybrid_candidates(_named(spark, sf_dir), queries, {"vector": 4 * k, "lexical": 4 * k, "keyword": k})
    if arms is None:
        lexical = R.lexical_scores(docs, queries, 4 * k).withColumn("lexical", F.round("lexical", 6))
        vector = R.bow_scores(docs, queries, k=4 * k).withColumn("vector", F.round("vector", 6)).where("vector > 0")
        keyword, hybrid = keyword_topk(spark, sf_dir), R.fused(vector, lexical, k, queries, _metadata(spark, sf_dir))
    else:
        arms = kept(arms)
        keyword = arms.where("keyword IS NOT NULL").select("query_id", "doc_id", "keyword")
        hybrid = R.blended(arms.where("vector IS NOT NULL OR lexical IS NOT NULL").drop("keyword"), k, queries, _metadata(spark, sf_dir))
    return keyword, R.fused_text(hybrid, keyword, k)


def hybrid_text_merge(spark, sf_dir):
    """Fused and keyword candidates of every passage merged, with the arms that found each."""
    return _merged(spark, sf_dir)[1]


_MERGED = f"""{_ARMS}, {_fused_sql(20)}, {_keyword_sql()},
hb AS (SELECT query_id, doc_id, coalesce(vector, score) AS raw_vector FROM fused),
hm AS (SELECT query_id, doc_id, raw_vector, keyword, raw_vector / max(raw_vector) OVER w AS h, keyword / max(keyword) OVER w AS y FROM hb FULL JOIN keyworded USING (query_id, doc_id) WINDOW w AS (PARTITION BY query_id)),
hs AS (SELECT query_id, doc_id, round(CASE WHEN h IS NOT NULL AND y IS NOT NULL THEN 0.7::DOUBLE * least(1, h) + 0.3::DOUBLE * least(1, y) ELSE coalesce(keyword, raw_vector) END, 6) AS merged, concat_ws('+', CASE WHEN raw_vector IS NOT NULL THEN 'vector' END, CASE WHEN keyword IS NOT NULL THEN 'keyword' END) AS sources FROM hm),
merged AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY merged DESC, doc_id)::INTEGER AS rank FROM hs QUALIFY rank <= 20)"""
MERGE_SQL = f"WITH {_MERGED} SELECT query_id, doc_id, merged, sources, rank FROM merged"


def hybrid_fallbacks(spark, sf_dir):
    """Per passage, whether keyword matching added anything to the fused candidates, or the mode falls back and why."""
    queries = _queries(spark, sf_dir)
    keyword, merged = _merged(spark, sf_dir)
    keyword = keyword.groupBy("query_id").agg(F.count("*").alias("keyword_candidates"))
    merged = merged.groupBy("query_id").agg(F.bool_or(F.col("sources").contains("keyword")).alias("used"))
    rows = queries.select("query_id").join(keyword, "query_id", "left").join(merged, "query_id", "left")
    n = F.coalesce("keyword_candidates", F.lit(0))
    reason = F.when(n == 0, F.lit("keyword_candidates_empty")).when(F.col("used") == F.lit(False), F.lit("hybrid_no_additional_signal"))
    return rows.select("query_id", n.alias("keyword_candidates"), F.when(reason.isNotNull(), F.lit("chunk_only")).otherwise(F.lit("hybrid_text")).alias("effective_mode"), reason.alias("fallback_reason"))


FALLBACK_SQL = f"""WITH {_MERGED}, n AS (SELECT query_id, count(*) AS n FROM keyworded GROUP BY 1), u AS (SELECT query_id, bool_or(contains(sources, 'keyword')) AS used FROM merged GROUP BY 1),
r AS (SELECT item_id AS query_id, coalesce(n, 0) AS keyword_candidates, CASE WHEN coalesce(n, 0) = 0 THEN 'keyword_candidates_empty' WHEN used = false THEN 'hybrid_no_additional_signal' END AS fallback_reason FROM benchmark LEFT JOIN n ON item_id = n.query_id LEFT JOIN u ON item_id = u.query_id)
SELECT query_id, keyword_candidates, CASE WHEN fallback_reason IS NULL THEN 'hybrid_text' ELSE 'chunk_only' END AS effective_mode, fallback_reason FROM r"""


def query_snippets(spark, sf_dir):
    """The part of each passage's five best documents that is around what it asks, and their start."""
    docs, queries = _docs(spark, sf_dir), _queries(spark, sf_dir)
    found = R.top_k(R.lexical_scores(docs, queries, 5).withColumn("lexical", F.round("lexical", 6)), 5, "lexical").select("query_id", "doc_id")
    rows = found.join(R.small(queries), "query_id").join(docs, "doc_id")
    return R.snippet(R.query_snippet(rows, out="around"), out="start").select("query_id", "doc_id", "around", "start")


def _boundary_sql(t: str, limit: str) -> str:
    head = f"substr({t}, 1, {limit})"
    last = lambda marks: f"length(regexp_extract({head}, '(?s)^(.*[{marks}])', 1))"
    blank = f"length(regexp_extract({head}, '(?s)^(.*) ', 1))"
    return f"CASE WHEN {last(R.STRONG)} > greatest(1, {limit} // 2) THEN {last(R.STRONG)} WHEN {last(R.WEAK)} > greatest(1, {limit} // 2) THEN {last(R.WEAK)} WHEN {blank} >= greatest(1, {limit} * 2 // 3) THEN {blank} END"


_START = f"CASE WHEN n <= 260 THEN t WHEN b IS NULL THEN rtrim(substr(t, 1, 257)) || '...' WHEN length(regexp_replace(substr(t, 1, b), '[ {R.WEAK}]+$', '')) = n THEN regexp_replace(substr(t, 1, b), '[ {R.WEAK}]+$', '') ELSE regexp_replace(substr(t, 1, b), '[ {R.WEAK}]+$', '') || '...' END"
SNIPPET_SQL = rf"""WITH {_LEX}, f AS (SELECT query_id, doc_id FROM lexical QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(lexical, 6) DESC, doc_id) <= 5),
s0 AS (SELECT f.query_id, doc_id, q.query AS nq, list_filter(q.toks, lambda x, i: list_position(q.toks, x) = i) AS toks, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM f JOIN documents USING (doc_id) JOIN qt q USING (query_id)),
s1 AS (SELECT *, length(t) AS n, lower(t) AS l, {_boundary_sql('t', 'least(length(t), 346)')} AS b FROM s0),
s2 AS (SELECT *, {_START} AS start, CASE WHEN nq <> '' AND instr(l, nq) > 0 THEN instr(l, nq) - 1 ELSE list_filter(list_transform(toks, lambda x: instr(l, x) - 1), lambda p: p >= 0)[1] END AS a FROM s1),
s3 AS (SELECT *, greatest(0, a - 86) AS f0, least(n, greatest(0, a - 86) + 260) AS e FROM s2),
s4 AS (SELECT *, CASE WHEN e - f0 < 260 THEN greatest(0, e - 260) ELSE f0 END AS s FROM s3),
s5 AS (SELECT *, length(regexp_extract(substr(t, greatest(0, s - 80) + 1, least(s, 80)), '(?s)^(.*[{R.STRONG}{R.WEAK}])', 1)) AS snap FROM s4),
s6 AS (SELECT *, CASE WHEN snap > 0 THEN greatest(0, s - 80) + snap ELSE s END AS s2 FROM s5),
s7 AS (SELECT *, least(n, e + 86) - s2 AS room, trim(substr(t, s2 + 1, least(n, e + 86) - s2)) AS w FROM s6),
s8 AS (SELECT *, {_boundary_sql('w', 'least(length(w), greatest(room, e - s2))')} AS wb FROM s7),
s9 AS (SELECT *, CASE WHEN wb IS NOT NULL THEN s2 + wb ELSE e END AS e2 FROM s8)
SELECT query_id, doc_id, CASE WHEN n <= 260 THEN t WHEN a IS NULL THEN start ELSE CASE WHEN s2 > 0 THEN '...' ELSE '' END || trim(substr(t, s2 + 1, e2 - s2)) || CASE WHEN e2 < n THEN '...' ELSE '' END END AS around, start FROM s9"""


def local_rule_rerank(spark, sf_dir):
    docs, queries = _docs(spark, sf_dir), _queries(spark, sf_dir)
    found = R.top_k(R.lexical_scores(docs, queries, 10).withColumn("lexical", F.round("lexical", 6)), 10, "lexical").select("query_id", "doc_id")
    full = found.join(R.small(queries), "query_id").join(_named(spark, sf_dir).select("doc_id", "text", F.concat_ws(" ", "name", "metadata").alias("metadata")), "doc_id")
    return R.top_k(R.rerank_scores(full), 5, "rerank").select("query_id", "doc_id", "rerank", "rank")


RERANK_SQL = rf"""WITH {_LEX}, f AS (SELECT query_id, doc_id FROM lexical QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(lexical, 6) DESC, doc_id) <= 10),
g AS (SELECT query_id, doc_id, any_value(p.n) AS n, any_value(p.u) AS u, any_value(p.mt) AS mt, any_value(p.h) AS h, any_value(p.query) AS query FROM f JOIN p USING (query_id, doc_id) GROUP BY ALL),
s AS (SELECT query_id, doc_id, round(least(1.0::DOUBLE, CASE WHEN contains(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), query) THEN 0.35::DOUBLE ELSE 0 END + 0.45::DOUBLE * mt / u + 0.15::DOUBLE * h / n + 0.05::DOUBLE * len(list_intersect(list_distinct(qt.toks), {TOK.format(x="source || '.txt ' || lang")}))::DOUBLE / u), 6) AS rerank FROM g JOIN documents USING (doc_id) JOIN (SELECT query_id, toks FROM qt) qt USING (query_id))
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank DESC, doc_id)::INTEGER AS rank FROM s QUALIFY rank <= 5"""


def rerank_features(spark, sf_dir):
    """Coverage, metadata and section features of each passage's ten best documents, and the score that diverse selection starts from."""
    docs, queries = _docs(spark, sf_dir), _queries(spark, sf_dir)
    found = R.top_k(R.lexical_scores(docs, queries, 10).withColumn("score", F.round("lexical", 6)), 10, "score").select("query_id", "doc_id", "score")
    rows = found.join(R.small(queries), "query_id").join(docs, "doc_id").join(_metadata(spark, sf_dir).withColumn("title", F.col("locator")), "doc_id")
    return R.prepared_rerank(rows)


FEATURES_SQL = rf"""WITH {_LEX}, f AS (SELECT query_id, doc_id, round(lexical, 6) AS score FROM lexical QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(lexical, 6) DESC, doc_id) <= 10),
g AS (SELECT f.query_id, doc_id, score, query, list_distinct(qt.toks) AS q, list_distinct({TOK.format(x='d.text')}) AS d, list_distinct({TOK.format(x="d.source || ' ' || d.source || ' ' || d.lang")}) AS m, {TOK.format(x='d.source')} AS h, lower(d.source) AS head FROM f JOIN documents d USING (doc_id) JOIN qt USING (query_id)),
s AS (SELECT query_id, doc_id, score, least(1.0::DOUBLE, 0.8::DOUBLE * len(list_intersect(q, d)) / len(q) + 0.2::DOUBLE * least(8::DOUBLE * len(list_intersect(q, d)) / least(len(d), 200), 1)) AS coverage, len(list_intersect(q, m))::DOUBLE / len(q) AS quality, CASE WHEN contains(head, query) THEN 1 ELSE len(list_intersect(q, h))::DOUBLE / len(q) END AS section_match FROM g)
SELECT query_id, doc_id, round(coverage, 6) AS coverage, round(quality, 6) AS quality, round(section_match, 6) AS section_match, round(least(1.0::DOUBLE, 0.6::DOUBLE * score + 0.2::DOUBLE * coverage + 0.12::DOUBLE * quality + 0.08::DOUBLE * section_match), 6) AS rerank FROM s"""


def retrieval_eval_metrics(spark, sf_dir):
    """Hit metrics of lexical retrieval: a document is relevant if it holds the passage; by toxicity label and over all."""
    docs, queries = _docs(spark, sf_dir), _queries(spark, sf_dir)
    found = R.top_k(R.lexical_scores(docs, queries, 8).withColumn("lexical", F.round("lexical", 6)), 8, "lexical")
    rows = found.join(docs, "doc_id").join(queries, "query_id").withColumn("hit", F.contains(T.normalized(F.col("text")), T.normalized(F.col("query"))))
    per = rows.groupBy("query_id").agg(F.bool_or("hit").alias("hit"), F.bool_or(F.col("hit") & (F.col("rank") == 1)).alias("top1"), F.bool_or(F.col("hit") & (F.col("rank") <= 3)).alias("top3"), F.avg(F.col("hit").cast("int")).alias("precision"), F.max("lexical").alias("best"))
    per = per.withColumn("category", F.when(F.col("query_id") % 2 == 0, "even").otherwise("odd"))
    grouped = per.groupingSets([["category"], []], F.col("category")).agg(F.count("*").alias("total"), F.count_if("hit").alias("passed"), F.round(F.avg(F.col("hit").cast("int")), 6).alias("retrieval_hit"), F.round(F.avg(F.col("top1").cast("int")), 6).alias("top_1"), F.round(F.avg(F.col("top3").cast("int")), 6).alias("top_3"), F.round(F.avg("precision"), 6).alias("precision"), F.count_if(F.col("best") >= 0.15).alias("reliable"))
    return grouped.withColumn("category", F.coalesce("category", F.lit("all")))


EVAL_SQL = rf"""WITH {_LEX}, f AS (SELECT query_id, doc_id, round(lexical, 6) AS lexical, row_number() OVER (PARTITION BY query_id ORDER BY round(lexical, 6) DESC, doc_id) AS rank FROM lexical QUALIFY rank <= 8),
g AS (SELECT f.*, contains(lower(trim(regexp_replace(d.text, '\s+', ' ', 'g'))), lower(trim(regexp_replace(b.text, '\s+', ' ', 'g')))) AS hit FROM f JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = f.query_id),
e AS (SELECT query_id, bool_or(hit) AS hit, bool_or(hit AND rank = 1) AS top1, bool_or(hit AND rank <= 3) AS top3, avg(hit::INT) AS precision, max(lexical) AS best, CASE WHEN query_id % 2 = 0 THEN 'even' ELSE 'odd' END AS category FROM g GROUP BY query_id)
SELECT coalesce(category, 'all') AS category, count(*) AS total, count_if(hit)::BIGINT AS passed, round(avg(hit::INT), 6) AS retrieval_hit, round(avg(top1::INT), 6) AS top_1, round(avg(top3::INT), 6) AS top_3, round(avg(precision), 6) AS precision, count_if(best >= 0.15)::BIGINT AS reliable
FROM e GROUP BY GROUPING SETS ((category), ())"""

QUERIES = {
    "lexical_topk": (lexical_topk, LEXICAL_SQL),
    "hashed_bow_vectors": (hashed_bow_vectors, BOW_SQL),
    "hybrid_fusion_topk": (hybrid_fusion_topk, FUSION_SQL),
    "vector_topk": (vector_topk, VECTOR_SQL),
    "vector_label_hit_rate": (vector_label_hit_rate, HIT_SQL),
    "keyword_topk": (keyword_topk, KEYWORD_SQL),
    "hybrid_text_merge": (hybrid_text_merge, MERGE_SQL),
    "local_rule_rerank": (local_rule_rerank, RERANK_SQL),
    "retrieval_eval_metrics": (retrieval_eval_metrics, EVAL_SQL),
    "hybrid_fallbacks": (hybrid_fallbacks, FALLBACK_SQL),
    "query_snippets": (query_snippets, SNIPPET_SQL),
    "rerank_features": (rerank_features, FEATURES_SQL),
}
