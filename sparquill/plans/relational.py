"""Relational glue: status counts, latest rows, timeouts, retries, health, access, conversations, latencies."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparquill.functions import text as T
from sparquill.sources import table

NOW = "2024-01-31 00:00:00"
W = Window


def latest_event_per_user(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    best = e.groupBy("user_id").agg(F.max_by(F.struct("event_id", "ts", "event_type"), F.struct("ts", "event_id")).alias("x"))
    return best.select("user_id", "x.event_id", "x.ts", "x.event_type")


LATEST = "SELECT user_id, event_id, ts, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"


def event_status_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.round(F.sum("value"), 4).alias("total"))


STATUS = "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, min(ts) AS first_ts, max(ts) AS last_ts, round(sum(value), 4) AS total FROM events GROUP BY event_type"


def active_jobs(spark, sf_dir):
    """Users and their active (view, click) and failed (error) jobs, and whether a user is at the limit."""
    e = table(spark, sf_dir, "events")
    active = F.count_if(F.col("event_type").isin("view", "click"))
    return e.groupBy("user_id").agg(active.alias("active"), F.count_if(F.col("event_type") == "error").alias("failed"), (active >= 5).alias("at_limit"))


ACTIVE = "SELECT user_id, count_if(event_type IN ('view', 'click'))::BIGINT AS active, count_if(event_type = 'error')::BIGINT AS failed, count_if(event_type IN ('view', 'click')) >= 5 AS at_limit FROM events GROUP BY user_id"


def timeout_sweep(spark, sf_dir):
    """Jobs whose event was followed by no other of the user within 1800 seconds, or by none until NOW."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", F.lead("ts").over(w).alias("next_ts"))
    e = e.withColumn("idle_s", F.timestamp_diff("SECOND", F.col("ts"), F.coalesce("next_ts", F.lit(NOW).cast("timestamp"))))
    return e.where("event_type IN ('view', 'click') AND idle_s >= 1800").select("event_id", "user_id", "idle_s")


TIMEOUT = f"""WITH n AS (SELECT event_id, user_id, event_type, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_ts FROM events)
SELECT event_id, user_id, date_sub('second', ts, coalesce(next_ts, TIMESTAMP '{NOW}')) AS idle_s FROM n WHERE event_type IN ('view', 'click') AND date_sub('second', ts, coalesce(next_ts, TIMESTAMP '{NOW}')) >= 1800"""


def retry_decision(spark, sf_dir):
    """Failures by attempt: retried while fewer than three and the code is retryable."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", "user_id", F.row_number().over(w).alias("attempt"), F.from_json("props", "k int")["k"].alias("code"))
    return e.withColumn("decision", F.when(F.col("code").isNull() | (F.col("code") % 4 == 0), F.lit("fail_permanent")).when(F.col("attempt") > 3, F.lit("fail_exhausted")).otherwise(F.lit("retry")))


RETRY = """WITH e AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INTEGER AS attempt, CAST(json_extract(props, '$.k') AS INTEGER) AS code FROM events WHERE event_type = 'error')
SELECT *, CASE WHEN code IS NULL OR code % 4 = 0 THEN 'fail_permanent' WHEN attempt > 3 THEN 'fail_exhausted' ELSE 'retry' END AS decision FROM e"""


def job_duration_ms(spark, sf_dir):
    """Milliseconds from each signup to the same user's next purchase."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(1, W.unboundedFollowing)
    e = table(spark, sf_dir, "events")
    nxt = F.min(F.when(F.col("event_type") == "purchase", F.col("ts"))).over(w)
    return e.select("event_id", "user_id", "event_type", F.timestamp_diff("MILLISECOND", F.col("ts"), nxt).alias("duration_ms")).where("event_type = 'signup' AND duration_ms IS NOT NULL").drop("event_type")


DURATION = """WITH e AS (SELECT event_id, user_id, event_type, ts, min(CASE WHEN event_type = 'purchase' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM events)
SELECT event_id, user_id, date_sub('millisecond', ts, nxt) AS duration_ms FROM e WHERE event_type = 'signup' AND nxt IS NOT NULL"""


def latency_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ms", F.bround(F.col("value") * 10).cast("int"))
    p = lambda q: F.bround(F.percentile("ms", q)).cast("long")
    return e.groupBy("event_type").agg(F.round(F.avg("ms"), 3).alias("mean"), p(0.5).alias("p50"), p(0.95).alias("p95"), F.max("ms").alias("max_ms"))


LATENCY = "WITH e AS (SELECT event_type, round_even(value * 10, 0)::INTEGER AS ms FROM events) SELECT event_type, round(avg(ms), 3) AS mean, round_even(quantile_cont(ms, 0.5), 0)::BIGINT AS p50, round_even(quantile_cont(ms, 0.95), 0)::BIGINT AS p95, max(ms) AS max_ms FROM e GROUP BY event_type"


def document_health(spark, sf_dir):
    """Documents of each source by state: labelled, missing labels, toxic, ready."""
    d, x = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), table(spark, sf_dir, "labels")
    rows = d.join(x, "doc_id", "left")
    return rows.groupBy("source").agg(F.count("*").alias("docs"), F.count("quality").alias("labelled"), F.count_if(F.col("quality").isNull()).alias("missing"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0) & (F.col("n_chars") >= 40)).alias("ready"))


HEALTH = "SELECT source, count(*) AS docs, count(quality) AS labelled, count_if(quality IS NULL)::BIGINT AS missing, count_if(toxic = 1)::BIGINT AS toxic, count_if(quality = 1 AND toxic = 0 AND n_chars >= 40)::BIGINT AS ready FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source"


def index_compatibility(spark, sf_dir):
    """Whether each document's index identity fits the current one; the label table stands for the index."""
    d, x = table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels")
    rows = d.join(x, "doc_id", "left")
    reason = F.when(F.col("quality").isNull(), F.lit("legacy_unknown")).when(F.col("quality") == 0, F.lit("not_indexed")).when(F.col("lang") != "en", F.lit("model_mismatch")).when(F.col("toxic") == 1, F.lit("dimension_mismatch")).otherwise(F.lit("ok"))
    return rows.select("doc_id", reason.alias("reason")).withColumn("allowed", F.col("reason").isin("legacy_unknown", "ok"))


COMPAT = "WITH r AS (SELECT doc_id, CASE WHEN quality IS NULL THEN 'legacy_unknown' WHEN quality = 0 THEN 'not_indexed' WHEN lang <> 'en' THEN 'model_mismatch' WHEN toxic = 1 THEN 'dimension_mismatch' ELSE 'ok' END AS reason FROM documents LEFT JOIN labels USING (doc_id)) SELECT doc_id, reason, reason IN ('legacy_unknown', 'ok') AS allowed FROM r"


def conversation_window(spark, sf_dir):
    """The newest turns of each conversation that fit 3000 characters, each cut to 800, in their order."""
    c = table(spark, sf_dir, "conversations").withColumn("body", F.substring(F.trim("text"), 1, 800))
    after = F.sum(F.length("body")).over(W.partitionBy("conv_id").orderBy(F.desc("turn")))
    return c.withColumn("used", after).withColumn("left", 3000 - F.col("used") + F.length("body")).where("left > 0").select("conv_id", "turn", "role", F.when(F.col("used") <= 3000, F.col("body")).otherwise(F.expr("substring(body, 1, cast(left as int))")).alias("context"))


CONV = """WITH c AS (SELECT conv_id, turn, role, substr(trim(text, ' '), 1, 800) AS body FROM conversations), u AS (SELECT *, sum(length(body)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS used FROM c)
SELECT conv_id, turn, role, CASE WHEN used <= 3000 THEN body ELSE substr(body, 1, (3000 - used + length(body))::BIGINT) END AS context FROM u WHERE 3000 - used + length(body) > 0"""


def retrieval_query_rewrite(spark, sf_dir):
    """The last two user turns and the last assistant turn (200 characters) of each conversation as one query."""
    c = table(spark, sf_dir, "conversations").where("role IN ('user', 'assistant')")
    n = F.row_number().over(W.partitionBy("conv_id", "role").orderBy(F.desc("turn")))
    c = c.withColumn("n", n).where("(role = 'user' AND n <= 2) OR (role = 'assistant' AND n = 1)")
    piece = F.when(F.col("role") == "assistant", F.substring(T.normalized(F.col("text")), 1, 200)).otherwise(T.normalized(F.col("text")))
    return c.withColumn("piece", piece).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "piece"))), lambda x: x["piece"]), "\n").alias("query"))


REWRITE = r"""WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS n, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS t FROM conversations WHERE role IN ('user', 'assistant'))
SELECT conv_id, string_agg(CASE WHEN role = 'assistant' THEN substr(t, 1, 200) ELSE t END, chr(10) ORDER BY turn) AS query FROM c WHERE (role = 'user' AND n <= 2) OR (role = 'assistant' AND n = 1) GROUP BY conv_id"""


def conversation_titles(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"), F.count("*").alias("questions"))
    return c.select("conv_id", T.shortened(F.col("text"), 120).alias("title"), "questions")


TITLES = r"""WITH c AS (SELECT conv_id, trim(regexp_replace(arg_min(text, turn), '\s+', ' ', 'g')) AS t, count(*) AS questions FROM conversations WHERE role = 'user' GROUP BY conv_id)
SELECT conv_id, CASE WHEN length(t) > 120 THEN rtrim(substr(t, 1, 117)) || '...' ELSE t END AS title, questions FROM c"""


def accessible_customers(spark, sf_dir):
    """Customers a team may see: of its region, or with a large order of its own."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    own = table(spark, sf_dir, "orders").where("o_totalprice > 300000").groupBy("o_custkey").agg(F.count("*").alias("large_orders"))
    rows = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(own, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.where("n_regionkey = 1 OR o_custkey IS NOT NULL").select("c_custkey", "c_name", "n_name", F.coalesce("large_orders", F.lit(0)).alias("large_orders"))


ACCESS = "WITH o AS (SELECT o_custkey, count(*) AS large_orders FROM orders WHERE o_totalprice > 300000 GROUP BY 1) SELECT c_custkey, c_name, n_name, coalesce(large_orders, 0) AS large_orders FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN o ON c_custkey = o_custkey WHERE n_regionkey = 1 OR o_custkey IS NOT NULL"


def job_search(spark, sf_dir):
    """Orders by status and priority whose customer's segment matches, with counts: a filtered job list."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).where(F.col("c_mktsegment").ilike("%build%"))
    return rows.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("newest"))


SEARCH = "SELECT o_orderstatus, o_orderpriority, count(*) AS n, max(o_orderkey) AS newest FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment ILIKE '%build%' GROUP BY ALL"


def event_hours(spark, sf_dir):
    """Hourly windows over the event stream, as the streaming query computes them."""
    from sparquill.streaming.jobs import hourly

    return hourly(table(spark, sf_dir, "events"))


HOURS = "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"


def sessions(spark, sf_dir):
    """User sessions: events less than 30 minutes apart."""
    e = table(spark, sf_dir, "events")
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = e.withColumn("new", F.coalesce((F.timestamp_diff("SECOND", F.lag("ts").over(w), F.col("ts")) >= 1800).cast("int"), F.lit(1)))
    e = e.withColumn("session", F.sum("new").over(w))
    return e.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))


SESSIONS = """WITH l AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events), s AS (SELECT *, sum(CASE WHEN p IS NULL OR date_sub('second', p, ts) >= 1800 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session FROM l)
SELECT user_id, session, count(*) AS n, min(ts) AS start_ts, max(ts) AS end_ts FROM s GROUP BY ALL"""

QUERIES = {
    "latest_event_per_user": (latest_event_per_user, LATEST), "event_status_counts": (event_status_counts, STATUS), "active_jobs": (active_jobs, ACTIVE), "timeout_sweep": (timeout_sweep, TIMEOUT),
    "retry_decision": (retry_decision, RETRY), "job_duration_ms": (job_duration_ms, DURATION), "latency_summary": (latency_summary, LATENCY), "document_health": (document_health, HEALTH),
    "index_compatibility": (index_compatibility, COMPAT), "conversation_window": (conversation_window, CONV), "retrieval_query_rewrite": (retrieval_query_rewrite, REWRITE), "conversation_titles": (conversation_titles, TITLES),
    "accessible_customers": (accessible_customers, ACCESS), "job_search": (job_search, SEARCH), "event_hours": (event_hours, HOURS), "user_sessions": (sessions, SESSIONS),
}
