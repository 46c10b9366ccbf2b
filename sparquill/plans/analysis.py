"""Near-duplicate lines, features, merges of arms, failure analysis, baselines, attempts and JSON payloads."""


import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparquill.functions import text as T
from sparquill.operators import evidence as E
from sparquill.operators import lines as L
from sparquill.operators import retrieval as R
from sparquill.operators.units import question_features, text_features
from sparquill.plans import answers_sql as SQL
from sparquill.plans.graph import _M as GRAPH_M
from sparquill.plans.graph import mentions
from sparquill.plans.retrieval import _LEX, hybrid_fusion_topk, lexical_topk
from sparquill.sources import kept, table


def near_duplicate_lines(spark, sf_dir):
    """Pairs of lines of one document that are near duplicates: equal, contained, or alike by character bigrams.

    Lines meet inside their document, so that a document's pairs are made where it is, without a shuffle.
    """
    return L.near_duplicates(table(spark, sf_dir, "documents"))


NEAR = r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
t AS (SELECT doc_id, i, substr(regexp_replace(lower(line), '[^0-9a-z\x{4e00}-\x{9fff}]', '', 'g'), 1, 320) AS t FROM l),
b AS (SELECT doc_id, i, t, list_distinct(list_transform(range(1, length(t)), lambda k: substr(t, k, 2))) AS b FROM t WHERE length(t) >= 8),
p AS (SELECT x.doc_id, x.i AS line, y.i AS other, x.t AS t1, y.t AS t2, len(list_intersect(x.b, y.b)) AS c, len(x.b) AS n1, len(y.b) AS n2 FROM b x JOIN b y ON x.doc_id = y.doc_id AND x.i < y.i)
SELECT doc_id, line::INTEGER AS line, other::INTEGER AS other FROM p WHERE t1 = t2 OR ((contains(t1, t2) OR contains(t2, t1)) AND least(length(t1), length(t2))::DOUBLE / greatest(length(t1), length(t2)) >= 0.55) OR c::DOUBLE / (n1 + n2 - c) >= 0.75 OR c::DOUBLE / least(n1, n2) >= 0.75"""


def turn_relevance(spark, sf_dir):
    """Share of each user turn's features, words and pairs of CJK characters, that the next turn of the conversation has."""
    w = W.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", question_features(F.col("text")).alias("q"), text_features(F.lead("text").over(w)).alias("a"), F.lead("text").over(w).alias("n"))
    return c.where("role = 'user' AND n IS NOT NULL AND size(q) > 0").select("conv_id", "turn", F.round(F.size(F.array_intersect("q", "a")) / F.size("q"), 6).alias("relevance"))


RELEVANCE = f"""WITH c AS (SELECT conv_id, turn, role, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations), t AS (SELECT conv_id, turn, {SQL.features('text')} AS q, {SQL.features('nxt')} AS a FROM c WHERE role = 'user' AND nxt IS NOT NULL)
SELECT conv_id, turn, round(len(list_intersect(q, a))::DOUBLE / len(q), 6) AS relevance FROM t WHERE len(q) > 0"""


def graph_vector_merge(spark, sf_dir):
    """Documents by the better of their lexical score and the graph's: 1 for one that mentions an entity of the passage's best document that few do."""
    lex = kept(lexical_topk(spark, sf_dir).select("query_id", "doc_id", "lexical", "rank"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # The names of the best documents alone, one a query, are counted and looked up.
    best = R.small(lex.where("rank = 1").select("query_id", "doc_id"))
    own = kept(mentions(docs.join(best.select("doc_id").distinct(), "doc_id")).select("doc_id", "name").join(best, "doc_id").select("query_id", "name"))
    found = kept(mentions(docs).select("doc_id", "name").join(R.small(own.select("name").distinct()), "name"))
    rare = found.groupBy("name").agg(F.count("*").alias("n")).where("n <= 5")
    graph = found.join(own.join(rare, "name").select("query_id", "name"), "name").groupBy("query_id", "doc_id").agg(F.lit(1.0).alias("score"))
    both = lex.select("query_id", "doc_id", F.col("lexical").alias("score")).unionByName(graph).groupBy("query_id", "doc_id").agg(F.max("score").alias("score"), F.count("*").alias("arms"))
    return R.top_k(both, 15, "score").select("query_id", "doc_id", "score", "arms", "rank")


_DOC_MENTIONS = GRAPH_M.replace("UNION ALL SELECT unit_id + 1000000000000, unit FROM units", "")
for _old, _new in (("e AS (SELECT doc_id, list_concat", "ge AS (SELECT doc_id, list_concat"), ("FROM e)", "FROM ge)"), ("x AS (SELECT doc_id, unnest", "gx AS (SELECT doc_id, unnest"), ("FROM x GROUP", "FROM gx GROUP"), ("\ng AS (", "\ngg AS ("), ("FROM g)", "FROM gg)")):
    _DOC_MENTIONS = _DOC_MENTIONS.replace(_old, _new)
GVM = f"""WITH {_LEX}, lx AS (SELECT query_id, doc_id, round(lexical, 6) AS lexical, row_number() OVER (PARTITION BY query_id ORDER BY round(lexical, 6) DESC, doc_id) AS rank FROM lexical QUALIFY rank <= 10), {_DOC_MENTIONS},
rare AS (SELECT name FROM m GROUP BY name HAVING count(*) <= 5), nm AS (SELECT query_id, name FROM lx JOIN m USING (doc_id) JOIN rare USING (name) WHERE rank = 1),
gr AS (SELECT DISTINCT query_id, doc_id, 1.0::DOUBLE AS score FROM nm JOIN m USING (name)), un AS (SELECT query_id, doc_id, lexical AS score FROM lx UNION ALL SELECT * FROM gr),
ag AS (SELECT query_id, doc_id, max(score) AS score, count(*) AS arms FROM un GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM ag QUALIFY rank <= 15"""


def _cases(spark, sf_dir):
    docs, q = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    rows = lexical_topk(spark, sf_dir).join(docs, "doc_id").join(q, "query_id").withColumn("hit", F.contains(T.normalized(F.col("text")), T.normalized(F.col("query"))))
    return rows.groupBy("query_id").agg(F.bool_or("hit").alias("hit"), F.max("lexical").alias("best"), F.min(F.when(F.col("hit"), F.col("rank"))).alias("first_hit"))


def failure_stages(spark, sf_dir):
    """The first stage at which each query fails, and all reasons."""
    c = _cases(spark, sf_dir)
    reasons = F.array_compact(F.array(F.when(~F.col("hit"), F.lit("retrieval_miss")), F.when(F.col("best") < 0.15, F.lit("unreliable")), F.when(F.col("first_hit") > 3, F.lit("ranked_low"))))
    stage = F.when(~F.col("hit"), F.lit("candidate_generation")).when(F.col("best") < 0.15, F.lit("support_gate")).when(F.col("first_hit") > 3, F.lit("ranking")).otherwise(F.lit("passed"))
    return c.select("query_id", stage.alias("stage"), F.array_join(reasons, ",").alias("reasons"))


_CASES = rf"""{_LEX}, f AS (SELECT query_id, doc_id, round(lexical, 6) AS lexical, row_number() OVER (PARTITION BY query_id ORDER BY round(lexical, 6) DESC, doc_id) AS rank FROM lexical QUALIFY rank <= 10),
hh AS (SELECT f.*, contains(lower(trim(regexp_replace(dd.text, '\s+', ' ', 'g'))), lower(trim(regexp_replace(b.text, '\s+', ' ', 'g')))) AS hit FROM f JOIN documents dd USING (doc_id) JOIN benchmark b ON b.item_id = f.query_id),
cs AS (SELECT query_id, bool_or(hit) AS hit, max(lexical) AS best, min(CASE WHEN hit THEN rank END) AS first_hit FROM hh GROUP BY query_id)"""
STAGES = f"""WITH {_CASES} SELECT query_id, CASE WHEN NOT hit THEN 'candidate_generation' WHEN best < 0.15 THEN 'support_gate' WHEN first_hit > 3 THEN 'ranking' ELSE 'passed' END AS stage,
array_to_string(list_filter([CASE WHEN NOT hit THEN 'retrieval_miss' END, CASE WHEN best < 0.15 THEN 'unreliable' END, CASE WHEN first_hit > 3 THEN 'ranked_low' END], lambda x: x IS NOT NULL), ',') AS reasons FROM cs"""


def baseline_overlap(spark, sf_dir):
    """Per query, what lexical and fused retrieval have in common, and whether their best document is the same."""
    a = lexical_topk(spark, sf_dir).where("rank <= 8").select("query_id", "doc_id", F.col("rank").alias("ra"))
    b = hybrid_fusion_topk(spark, sf_dir).select("query_id", "doc_id", F.col("rank").alias("rb"))
    j = a.join(b, ["query_id", "doc_id"], "full_outer")
    return j.groupBy("query_id").agg(F.count_if(F.col("ra").isNotNull() & F.col("rb").isNotNull()).alias("common"), F.count("*").alias("either"), F.bool_or(F.coalesce((F.col("ra") == 1) & (F.col("rb") == 1), F.lit(False))).alias("same_best"))


def event_payloads(spark, sf_dir):
    """The JSON payloads of events, parsed leniently, by key value: invalid ones count as missing."""
    e = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k int", {"mode": "PERMISSIVE"})["k"].alias("k"))
    return e.groupBy("k").agg(F.count("*").alias("n"), F.countDistinct("event_type").alias("types"))


PAYLOADS = "SELECT CAST(json_extract(props, '$.k') AS INTEGER) AS k, count(*) AS n, count(DISTINCT event_type) AS types FROM events GROUP BY 1"


def processing_attempts(spark, sf_dir):
    """Every event as an attempt of its user: number, trigger by the state before, and whether one was already active."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    prev = F.lag("event_type").over(w)
    e = table(spark, sf_dir, "events")
    trigger = F.when(prev == "error", F.lit("retry")).when(prev.isin("purchase", "signup"), F.lit("reprocess")).otherwise(F.lit("process"))
    return e.select("event_id", F.row_number().over(w).alias("attempt"), trigger.alias("trigger"), F.coalesce(prev.isin("view", "click"), F.lit(False)).alias("blocked"))


ATTEMPTS = """WITH p AS (SELECT *, lag(event_type) OVER w AS prev, row_number() OVER w AS attempt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, attempt::INTEGER AS attempt, CASE WHEN prev = 'error' THEN 'retry' WHEN prev IN ('purchase', 'signup') THEN 'reprocess' ELSE 'process' END AS trigger, coalesce(prev IN ('view', 'click'), false) AS blocked FROM p"""


def clause_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    clauses = F.filter(F.split("text", "[，,、：:]"), lambda c: F.length(F.trim(c)) > 0)
    return d.select("doc_id", F.size(clauses).alias("clauses"), F.array_max(F.transform(clauses, lambda c: F.length(c))).alias("longest"))


CLAUSES = "WITH c AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[，,、：:]'), lambda c: length(trim(c, ' ')) > 0) AS c FROM documents) SELECT doc_id, len(c)::INTEGER AS clauses, list_max(list_transform(c, lambda x: length(x)))::INTEGER AS longest FROM c"


def index_identity(spark, sf_dir):
    """Vectors, dimensions and zero norms by label: an index of mixed dimensions is not compatible."""
    v = table(spark, sf_dir, "embeddings")
    return v.groupBy("label").agg(F.count("*").alias("vectors"), F.min(F.size("embedding")).alias("least_dim"), F.max(F.size("embedding")).alias("most_dim"), F.count_if(F.abs(T.norm(F.col("embedding")) - 1) < 1e-3).alias("unit"), (F.count_distinct(F.size("embedding")) == 1).alias("compatible"))


IDENTITY = "SELECT label, count(*) AS vectors, min(len(embedding))::INTEGER AS least_dim, max(len(embedding))::INTEGER AS most_dim, count_if(abs(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) < 1e-3)::BIGINT AS unit, count(DISTINCT len(embedding)) = 1 AS compatible FROM embeddings GROUP BY label"


def answer_markers(spark, sf_dir):
    """Assistant turns with citation markers checked against three allowed ones."""
    def check(texts: pd.Series) -> pd.DataFrame:
        found = [E.checked_markers(t or "", ["S1", "S2", "S3"]) for t in texts]
        return pd.DataFrame([(len(a), ",".join(u), r) for a, u, r in found], columns=["chars", "used", "removed"])

    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    marked = F.concat(F.col("text"), F.lit(" [S1] ["), (F.col("turn") % 5 + 1).cast("string"), F.lit(", S9]"))
    return c.select("conv_id", "turn", F.pandas_udf(check, "chars int, used string, removed int")(marked).alias("x")).select("conv_id", "turn", "x.used", "x.removed")


MARKERS = "SELECT conv_id, turn, CASE turn % 5 + 1 WHEN 2 THEN 'S1,S2' WHEN 3 THEN 'S1,S3' ELSE 'S1' END AS used, CASE WHEN turn % 5 + 1 <= 3 THEN 1 ELSE 2 END AS removed FROM conversations WHERE role = 'assistant'"

QUERIES = {
    "near_duplicate_lines": (near_duplicate_lines, NEAR), "turn_relevance": (turn_relevance, RELEVANCE), "graph_vector_merge": (graph_vector_merge, GVM), "failure_stages": (failure_stages, STAGES), "baseline_overlap": (baseline_overlap, None),
    "event_payloads": (event_payloads, PAYLOADS), "processing_attempts": (processing_attempts, ATTEMPTS), "clause_counts": (clause_counts, CLAUSES), "index_identity": (index_identity, IDENTITY), "answer_markers": (answer_markers, MARKERS),
}
