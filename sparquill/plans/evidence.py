"""Routing, context packing, diversity, answer policy, citation readiness and traces over lexical candidates."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparquill.functions import text as T
from sparquill.operators import evidence as E
from sparquill.operators import retrieval as R
from sparquill.plans.retrieval import _LEX
from sparquill.sources import table


def candidates(spark, sf_dir, k: int = 20) -> DataFrame:
    """(query_id, doc_id, source, lang, text, score, rank) of the k best documents a query."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    found = R.top_k(R.lexical_scores(d, q, k).withColumn("score", F.round("lexical", 6)), k, "score").select("query_id", "doc_id", "score", "rank")
    return found.join(d, "doc_id")


def context_packing(spark, sf_dir):
    return E.pack_context(candidates(spark, sf_dir))


def mmr_rerank(spark, sf_dir):
    return E.diverse(candidates(spark, sf_dir).select("query_id", "doc_id", "source", "text", "score"))


_CAND = f"{_LEX}, cand AS (SELECT query_id, doc_id, source, lang, text, round(lexical, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(lexical, 6) DESC, doc_id) AS rank FROM lexical JOIN documents USING (doc_id) QUALIFY rank <= 20)"


def evidence_dedup(spark, sf_dir):
    """Candidates of one query with the same text keep the best provenance, in the first one's place."""
    c = candidates(spark, sf_dir).withColumn("key", F.sha2(T.normalized(F.col("text")), 256))
    g = c.groupBy("query_id", "key").agg(F.min("rank").alias("position"), F.min_by("doc_id", F.struct(F.when(F.col("lang") == "en", 0).otherwise(1).alias("p"), "rank")).alias("doc_id"), F.count("*").alias("merged"))
    return g.select("query_id", F.concat(F.lit("S"), F.row_number().over(W.partitionBy("query_id").orderBy("position")).cast("string")).alias("marker"), "doc_id", "merged")


EDEDUP = rf"""WITH {_CAND}, g AS (SELECT query_id, sha256(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS key, min(rank) AS position, arg_min(doc_id, CASE WHEN lang = 'en' THEN 0 ELSE 1000 END + rank) AS doc_id, count(*) AS merged FROM cand GROUP BY ALL)
SELECT query_id, 'S' || row_number() OVER (PARTITION BY query_id ORDER BY position) AS marker, doc_id, merged FROM g"""


def citation_readiness_summary(spark, sf_dir):
    c = candidates(spark, sf_dir)
    reason = F.when(F.col("lang").isNull() & F.col("source").isNull(), F.lit("missing_both")).when(F.length("text") < 40, F.lit("missing_citation_unit")).when(F.col("lang") != "en", F.lit("missing_source_locator")).otherwise(F.lit("ready"))
    return c.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"), F.countDistinct("query_id").alias("queries"))


READINESS = f"WITH {_CAND} SELECT CASE WHEN lang IS NULL AND source IS NULL THEN 'missing_both' WHEN length(text) < 40 THEN 'missing_citation_unit' WHEN lang <> 'en' THEN 'missing_source_locator' ELSE 'ready' END AS reason, count(*) AS n, count(DISTINCT query_id) AS queries FROM cand GROUP BY 1"


def trace_items(spark, sf_dir):
    """Every candidate with its rank, whether it was selected (five best), and why not."""
    c = candidates(spark, sf_dir)
    why = F.when(F.col("rank") <= 5, F.lit(None).cast("string")).when(F.col("score") < 0.15, F.lit("low_score")).otherwise(F.lit("rank_cutoff"))
    return c.select("query_id", "doc_id", F.col("rank").alias("initial_rank"), (F.col("rank") <= 5).alias("selected"), why.alias("filtered_reason"), T.shortened(F.col("text"), 400).alias("preview"))


TRACE = rf"""WITH {_CAND}, t AS (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS c FROM cand)
SELECT query_id, doc_id, rank::INTEGER AS initial_rank, rank <= 5 AS selected, CASE WHEN rank <= 5 THEN NULL WHEN score < 0.15 THEN 'low_score' ELSE 'rank_cutoff' END AS filtered_reason, CASE WHEN length(c) > 400 THEN rtrim(substr(c, 1, 397)) || '...' ELSE c END AS preview FROM t"""


def overview_selection(spark, sf_dir):
    """Round robin over sources: their best documents by overview score, two each."""
    from sparquill.plans.texts import overview_chunk_score

    s = overview_chunk_score(spark, sf_dir).withColumn("slot", F.row_number().over(W.partitionBy("source").orderBy(F.desc("score"), "doc_id"))).where("slot <= 2")
    return s.select("source", "doc_id", "score", "slot")


def _overview_sql() -> str:
    from sparquill.plans.texts import OVERVIEW

    return f"SELECT source, doc_id, score, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id)::INTEGER AS slot FROM ({OVERVIEW}) QUALIFY slot <= 2"


QUERIES = {
    "context_packing": (context_packing, None), "mmr_rerank": (mmr_rerank, None), 
    "evidence_dedup": (evidence_dedup, EDEDUP), "citation_readiness_summary": (citation_readiness_summary, READINESS), "trace_items": (trace_items, TRACE), "overview_selection": (overview_selection, _overview_sql()),
}
