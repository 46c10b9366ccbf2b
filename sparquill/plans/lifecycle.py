"""Uploads, jobs, indexes, listings and traces: the relational state around documents, over the driver's tables.

Pages stand for uploaded files, events for the log of a document's jobs (a user is a document here),
labels for reviews; each rule is the engine's own, the tables only give it rows to work on.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparquill.sources import table

# Uploads.
EXTENSIONS = [".pdf", ".docx", ".md", ".txt"]
MIME = {".pdf": ["application/pdf"], ".docx": ["application/vnd.openxmlformats-officedocument.wordprocessingml.document"], ".md": ["text/markdown", "text/plain"], ".txt": ["text/plain"]}
ALLOWED_MIME = sorted({m for ms in MIME.values() for m in ms})
SOURCE_TYPES = {".txt": "text", ".md": "markdown", ".pdf": "pdf", ".docx": "docx", ".mp3": "audio", ".wav": "audio", ".m4a": "audio", ".mp4": "video", ".mov": "video", ".m4v": "video", ".png": "image", ".jpg": "image", ".jpeg": "image"}
MAX_MB, MAX_USER_JOBS, MAX_BASE_JOBS = 1, 5, 400


def suffix(name: Column) -> Column:
    """Lower-case extension of a file name with its dot, empty if there is none."""
    return F.lower(F.regexp_extract(name, r"[^./\\](\.[^./\\]+)$", 1))


def source_type(name: Column) -> Column:
    """What kind of source a file name says."""
    ext = suffix(name)
    return F.coalesce(*(F.when(ext == e, F.lit(t)) for e, t in SOURCE_TYPES.items()), F.lit("text"))


def upload_problem(name: Column, mime: Column, size: Column, max_mb: int = MAX_MB) -> Column:
    """The first rule that an upload breaks: its name, extension, MIME type, size or emptiness; null if none."""
    clean = F.trim(F.coalesce(name, F.lit("")))
    ext = suffix(clean)
    kind = F.lower(F.trim(F.split(F.coalesce(mime, F.lit("")), ";")[0]))
    fits = F.coalesce(*(F.when(ext == e, kind.isin(ms)) for e, ms in MIME.items()), F.lit(False))
    return (
        F.when((clean == "") | clean.rlike(r"[/\\\x00]") | (F.length(clean) > 255), F.lit("VALIDATION_ERROR:name"))
        .when(~ext.isin(EXTENSIONS), F.lit("UNSUPPORTED_FILE_TYPE:extension")).when((kind != "") & (kind != "application/octet-stream") & ~fits, F.lit("UNSUPPORTED_FILE_TYPE:mime"))
        .when(size > max_mb * 1024 * 1024, F.lit("UPLOAD_TOO_LARGE")).when(size == 0, F.lit("VALIDATION_ERROR:empty"))
    )


NAMES = [".pdf", ".docx", ".md", ".txt", ".exe", "", ".PDF", ".png", "/x.md", ".m4a", "blank"]
MIMES = ["application/pdf", "text/plain; charset=utf-8", "text/markdown", "application/octet-stream", None, MIME[".docx"][0], "image/png"]


def uploads(spark, sf_dir) -> DataFrame:
    """(page_id, filename, mime, size): a file for every page."""
    i = F.col("page_id")
    name = F.element_at(F.array(*map(F.lit, NAMES)), (i % len(NAMES) + 1).cast("int"))
    mime = F.element_at(F.array(*map(F.lit, MIMES)), (F.floor(i / 3) % len(MIMES) + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", F.when(name == "blank", F.lit("  ")).otherwise(F.concat(F.lit("page"), i.cast("string"), name)).alias("filename"), mime.alias("mime"), (F.length("html") * (i % 5) * 100).cast("long").alias("size"))


def _lit(x) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


UPLOADS = f"""up AS (SELECT page_id, CASE WHEN page_id % {len(NAMES)} = {len(NAMES) - 1} THEN '  ' ELSE 'page' || page_id || ([{', '.join(map(_lit, NAMES))}])[page_id % {len(NAMES)} + 1] END AS filename, ([{', '.join(map(_lit, MIMES))}])[page_id // 3 % {len(MIMES)} + 1] AS mime, length(html) * (page_id % 5) * 100 AS size FROM pages),
ux AS (SELECT *, trim(filename, ' ') AS clean, lower(regexp_extract(trim(filename, ' '), '[^./\\\\](\\.[^./\\\\]+)$', 1)) AS ext, lower(trim(string_split(coalesce(mime, ''), ';')[1], ' ')) AS kind FROM up)"""


def upload_validation(spark, sf_dir):
    u = uploads(spark, sf_dir)
    problem = upload_problem(F.col("filename"), F.col("mime"), F.col("size"))
    return u.select("page_id", source_type(F.col("filename")).alias("source_type"), problem.alias("problem"), F.when(problem.isNull(), F.lit(201)).when(problem.startswith("UNSUPPORTED"), F.lit(415)).when(problem == "UPLOAD_TOO_LARGE", F.lit(413)).otherwise(F.lit(400)).alias("status"))


_TYPES = " ".join(f"WHEN '{e}' THEN '{t}'" for e, t in SOURCE_TYPES.items())
_FITS = " OR ".join(f"(ext = '{e}' AND kind IN ({', '.join(map(_lit, ms))}))" for e, ms in MIME.items())
VALIDATION = f"""WITH {UPLOADS}, p AS (SELECT page_id, CASE ext {_TYPES} ELSE 'text' END AS source_type, CASE WHEN clean = '' OR regexp_matches(clean, '[/\\\\\\x00]') OR length(clean) > 255 THEN 'VALIDATION_ERROR:name' WHEN ext NOT IN ({', '.join(map(_lit, EXTENSIONS))}) THEN 'UNSUPPORTED_FILE_TYPE:extension'
  WHEN kind NOT IN ('', 'application/octet-stream') AND NOT ({_FITS}) THEN 'UNSUPPORTED_FILE_TYPE:mime' WHEN size > {MAX_MB * 1024 * 1024} THEN 'UPLOAD_TOO_LARGE' WHEN size = 0 THEN 'VALIDATION_ERROR:empty' END AS problem FROM ux)
SELECT *, CASE WHEN problem IS NULL THEN 201 WHEN starts_with(problem, 'UNSUPPORTED') THEN 415 WHEN problem = 'UPLOAD_TOO_LARGE' THEN 413 ELSE 400 END AS status FROM p"""


def job_limits(spark, sf_dir):
    """Whether each user may start another job, by the user's and the base's active jobs (users of one base share their id's last digit)."""
    e = table(spark, sf_dir, "events").withColumn("active", F.col("event_type").isin("view", "click").cast("long"))
    users = e.groupBy("user_id").agg(F.sum("active").alias("user_jobs")).withColumn("base", F.col("user_id") % 10)
    bases = users.groupBy("base").agg(F.sum("user_jobs").alias("base_jobs"))
    why = F.when(F.col("user_jobs") >= MAX_USER_JOBS, F.lit("user")).when(F.col("base_jobs") >= MAX_BASE_JOBS, F.lit("knowledge_base"))
    return users.join(F.broadcast(bases), "base").select("user_id", "user_jobs", "base_jobs", why.alias("limited_by"))


LIMITS = f"""WITH u AS (SELECT user_id, sum((event_type IN ('view', 'click'))::BIGINT)::BIGINT AS user_jobs FROM events GROUP BY user_id), b AS (SELECT user_id % 10 AS base, sum(user_jobs)::BIGINT AS base_jobs FROM u GROUP BY 1)
SELECT user_id, user_jobs, base_jobs, CASE WHEN user_jobs >= {MAX_USER_JOBS} THEN 'user' WHEN base_jobs >= {MAX_BASE_JOBS} THEN 'knowledge_base' END AS limited_by FROM u JOIN b ON user_id % 10 = base"""

# Chunk metadata and locators.
TIMED, TEXTUAL = ["audio", "video"], ["text", "markdown", "txt", "md", "docx"]


def locator(kind: Column, start: Column, end: Column, page: Column, t0: Column, t1: Column, section: Column) -> Column:
    """Where a chunk is in its source: page, heading or section, time, or characters."""
    norm = F.when(kind == "md", F.lit("markdown")).when(kind == "txt", F.lit("text")).otherwise(kind)
    named = F.trim(F.coalesce(section, F.lit(""))) != ""
    time = lambda t: F.format_string("%.3f", t)
    return (
        F.when(page.isNotNull(), F.concat(F.lit("page:"), page.cast("string"))).when(named & (norm == "markdown"), F.concat(F.lit("heading:"), F.trim(section))).when(named, F.concat(F.lit("section:"), F.trim(section)))
        .when(t0.isNotNull() & t1.isNotNull(), F.concat(F.lit("time:"), time(t0), F.lit("-"), time(t1))).when(start.isNotNull() & end.isNotNull(), F.concat(F.lit("chars:"), start.cast("string"), F.lit("-"), end.cast("string")))
    )


def locator_kind(kind: Column, start: Column, end: Column, page: Column, t0: Column, t1: Column, section: Column, path: Column, text: Column) -> Column:
    """How a preview finds a chunk: time range, PDF page, image region, text range, or only its locator's text; null if not at all."""
    named = (F.trim(F.coalesce(section, F.lit(""))) != "") | (F.size(F.coalesce(path, F.array().cast("array<string>"))) > 0)
    return (
        F.when(kind.isin(TIMED) & t0.isNotNull() & t1.isNotNull(), F.lit("time_range")).when((kind == "pdf") & page.isNotNull(), F.lit("pdf_page")).when(kind == "image", F.lit("image_region"))
        .when(kind.isin(TEXTUAL) | start.isNotNull() | end.isNotNull() | named, F.lit("text_range")).when(F.trim(F.coalesce(text, F.lit(""))) != "", F.lit("unknown"))
    )


PAYLOAD = "source_type string, char_start string, char_end string, page_number string, start_time string, end_time string, section_title string, source_locator string, heading_path string"
KINDS = ["txt", "md", "pdf", "docx", "audio", "image"]


def parsed_metadata(raw: Column) -> Column:
    """A chunk's metadata from JSON, leniently: numbers only where they are JSON numbers, blank texts and invalid JSON as null."""
    p = F.from_json(raw, PAYLOAD)
    number = lambda c, pattern: F.when(F.regexp_extract(raw, f'"{c}"\\s*:\\s*({pattern})\\s*[,}}]', 1) != "", p[c])
    text = lambda c: F.when(F.trim(p[c]) != "", F.trim(p[c]))
    kind = F.when(text("source_type") == "txt", F.lit("text")).when(text("source_type") == "md", F.lit("markdown")).otherwise(text("source_type"))
    return F.struct(kind.alias("source_type"), *(number(c, "-?[0-9]+").cast("int").alias(c) for c in ("char_start", "char_end", "page_number")), *(number(c, "-?[0-9.]+").cast("double").alias(c) for c in ("start_time", "end_time")), text("section_title").alias("section_title"), text("source_locator").alias("source_locator"))


def chunk_metadata(spark, sf_dir) -> DataFrame:
    """(doc_id, raw): metadata of a chunk a document as JSON, some of it with wrong types, blank or broken."""
    i = F.col("doc_id")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (i % len(KINDS) + 1).cast("int"))
    number = lambda x, quoted: F.when(quoted, F.concat(F.lit('"'), x.cast("string"), F.lit('"'))).otherwise(x.cast("string"))
    raw = F.concat(
        F.lit('{"source_type": "'), kind, F.lit('", "char_start": '), number(F.lit(0), i % 11 == 0), F.lit(', "char_end": '), number(F.col("n_chars"), i % 11 == 0), F.lit(', "page_number": '), F.when(kind == "pdf", number(i % 7 + 1, i % 13 == 0)).otherwise(F.lit("null")),
        F.lit(', "start_time": '), F.when(kind == "audio", (i % 90).cast("string")).otherwise(F.lit("null")), F.lit(', "end_time": '), F.when(kind == "audio", F.concat((i % 90 + 4).cast("string"), F.lit(".5"))).otherwise(F.lit("null")),
        F.lit(', "section_title": "'), F.when(i % 3 == 0, F.col("source")).when(i % 3 == 1, F.lit("  ")).otherwise(F.lit("")), F.when(i % 17 == 0, F.lit("")).otherwise(F.lit('"}')),
    )
    return table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw"))


def chunk_locators(spark, sf_dir):
    """Metadata read back from JSON, with the chunk's locator and the kind of its preview."""
    m = chunk_metadata(spark, sf_dir).select("doc_id", parsed_metadata(F.col("raw")).alias("m")).select("doc_id", "m.*")
    args = [F.col(c) for c in ("source_type", "char_start", "char_end", "page_number", "start_time", "end_time", "section_title")]
    found = F.coalesce("source_locator", locator(*args))
    return m.select("doc_id", "source_type", "char_start", "char_end", "page_number", "start_time", "end_time", "section_title", found.alias("locator"), locator_kind(*args, F.array_compact(F.array("section_title")), found).alias("preview"))


def _num(x: str, quoted: str) -> str:
    return f"CASE WHEN {quoted} THEN '\"' || {x} || '\"' ELSE ({x})::VARCHAR END"


_K = f"([{', '.join(map(_lit, KINDS))}])[doc_id % {len(KINDS)} + 1]"
_RAW = f"""'{{"source_type": "' || {_K} || '", "char_start": ' || {_num('0', 'doc_id % 11 = 0')} || ', "char_end": ' || {_num('n_chars', 'doc_id % 11 = 0')} || ', "page_number": ' || CASE WHEN {_K} = 'pdf' THEN {_num('doc_id % 7 + 1', 'doc_id % 13 = 0')} ELSE 'null' END || ', "start_time": ' || CASE WHEN {_K} = 'audio' THEN (doc_id % 90)::VARCHAR ELSE 'null' END || ', "end_time": ' || CASE WHEN {_K} = 'audio' THEN (doc_id % 90 + 4) || '.5' ELSE 'null' END || ', "section_title": "' || CASE WHEN doc_id % 3 = 0 THEN source WHEN doc_id % 3 = 1 THEN '  ' ELSE '' END || CASE WHEN doc_id % 17 = 0 THEN '' ELSE '"}}' END"""


def _json_number(c: str, kind: str) -> str:
    return f"CASE WHEN json_valid(raw) AND json_type(raw, '$.{c}') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN TRY_CAST(json_extract_string(raw, '$.{c}') AS {kind}) END AS {c}"


LOCATORS = f"""WITH r AS (SELECT doc_id, {_RAW} AS raw FROM documents), v AS (SELECT doc_id, CASE WHEN json_valid(raw) THEN raw ELSE '{{}}' END AS raw FROM r),
p AS (SELECT doc_id, CASE json_extract_string(raw, '$.source_type') WHEN 'txt' THEN 'text' WHEN 'md' THEN 'markdown' ELSE json_extract_string(raw, '$.source_type') END AS source_type, {', '.join(_json_number(c, 'INTEGER') for c in ('char_start', 'char_end', 'page_number'))}, {', '.join(_json_number(c, 'DOUBLE') for c in ('start_time', 'end_time'))}, nullif(trim(json_extract_string(raw, '$.section_title'), ' '), '') AS section_title FROM v),
l AS (SELECT *, CASE WHEN page_number IS NOT NULL THEN 'page:' || page_number WHEN section_title IS NOT NULL AND source_type = 'markdown' THEN 'heading:' || section_title WHEN section_title IS NOT NULL THEN 'section:' || section_title WHEN start_time IS NOT NULL AND end_time IS NOT NULL THEN printf('time:%.3f-%.3f', start_time, end_time) WHEN char_start IS NOT NULL AND char_end IS NOT NULL THEN 'chars:' || char_start || '-' || char_end END AS locator FROM p)
SELECT *, CASE WHEN source_type IN ('audio', 'video') AND start_time IS NOT NULL AND end_time IS NOT NULL THEN 'time_range' WHEN source_type = 'pdf' AND page_number IS NOT NULL THEN 'pdf_page' WHEN source_type = 'image' THEN 'image_region' WHEN source_type IN ('text', 'markdown', 'txt', 'md', 'docx') OR char_start IS NOT NULL OR char_end IS NOT NULL OR section_title IS NOT NULL THEN 'text_range' WHEN locator IS NOT NULL THEN 'unknown' END AS preview FROM l"""

# Index life cycle: a document's events are operations on its vector index.
OPERATIONS = {"signup": "request", "click": "indexing", "view": "indexed", "error": "failed", "purchase": "stale"}
CREATES = ["indexing", "indexed", "failed"]
STATUS = {"request": "pending", "indexing": "indexing", "indexed": "indexed", "failed": "failed", "stale": "stale"}
#: Identities that indexes were built under, by the event's value; the first is today's.
IDENTITIES = [("local_hashed_bow", "hashed_bow_v1", 128), ("local_hashed_bow", "hashed_bow_v0", 128), ("fastembed", "small", 384), ("local_hashed_bow", "hashed_bow_v1", 64)]


def folded_index(log: DataFrame) -> DataFrame:
    """(user_id, status, indexed_at, provider, model, dim, reason) of indexes after their log (user_id, event_id, ts, op, provider, model, dim): the last operation of each that applied.

    Marking stale and asking for a reindex need an index; the first of the others makes it. Identity is that of the last
    operation that has one; an index that is made anew has no time until it is indexed.
    """
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    made = F.coalesce(F.max(F.col("op").isin(CREATES).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(0)) == 1
    last = F.struct("ts", "event_id")
    own = F.when(F.col("op").isin(CREATES), last)
    rows = log.withColumn("made", made).where("made")
    state = rows.groupBy("user_id").agg(
        F.max_by("op", last).alias("op"), F.max(F.when(F.col("op") == "indexed", last)).alias("done"), F.max(F.when(F.col("op") == "indexing", last)).alias("begun"),
        *(F.max_by(c, own).alias(c) for c in ("provider", "model", "dim")),
    )
    status = F.coalesce(*(F.when(F.col("op") == o, F.lit(s)) for o, s in STATUS.items()))
    at = F.when(F.col("done").isNotNull() & (F.col("begun").isNull() | (F.col("done") > F.col("begun"))), F.col("done.ts"))
    return state.select("user_id", status.alias("status"), at.alias("indexed_at"), "provider", "model", "dim", F.when(F.col("op") == "stale", F.lit("content_changed")).alias("reason"))


def index_log(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    op = F.coalesce(*(F.when(F.col("event_type") == t, F.lit(o)) for t, o in OPERATIONS.items()))
    i = (F.floor("value") % len(IDENTITIES) + 1).cast("int")
    pick = lambda k: F.element_at(F.array(*(F.lit(x[k]) for x in IDENTITIES)), i)
    return e.where("event_id % 3 = 0 OR event_type <> 'view'").select("user_id", "event_id", "ts", op.alias("op"), pick(0).alias("provider"), pick(1).alias("model"), pick(2).alias("dim"))


def compatibility(status: Column, provider: Column, model: Column, dim: Column, now=IDENTITIES[0]) -> Column:
    """Why an index can't serve today's identity: not indexed, another provider, model or dimension; null if it can; legacy_unknown, which can, if there is none."""
    return (
        F.when(status.isNull(), F.lit("legacy_unknown")).when(status != "indexed", F.lit("status_not_indexed")).when(provider != now[0], F.lit("provider_mismatch")).when(model != now[1], F.lit("model_mismatch"))
        .when(dim.isNotNull() & F.lit(now[2]).isNotNull() & (dim != now[2]), F.lit("dimension_mismatch"))
    )


def index_lifecycle(spark, sf_dir):
    """Every document's vector index after its log, whether it can be searched, and what a sweep makes of it."""
    ids = table(spark, sf_dir, "events").select("user_id").distinct()
    x = ids.join(folded_index(index_log(spark, sf_dir)), "user_id", "left")
    why = compatibility(*(F.col(c) for c in ("status", "provider", "model", "dim")))
    x = x.withColumn("why", why).withColumn("allowed", why.isNull() | (why == "legacy_unknown"))
    swept = F.when(~F.col("allowed") & (F.col("status") == "indexed"), F.lit("stale")).otherwise(F.col("status"))
    filtered = F.when(F.col("why") == "legacy_unknown", F.lit("legacy_unknown_allowed")).when((F.col("why") == "status_not_indexed") & (F.col("status") == "stale"), F.lit("stale_index")).when(F.col("why") == "status_not_indexed", F.lit("document_not_ready")).when(F.col("why").isNotNull(), F.lit("incompatible_index"))
    return x.select("user_id", "status", "indexed_at", "provider", "model", "dim", "why", "allowed", swept.alias("swept_status"), filtered.alias("trace_reason"))


_OP = "CASE event_type " + " ".join(f"WHEN '{t}' THEN '{o}'" for t, o in OPERATIONS.items()) + " END"
_PICK = lambda k: f"([{', '.join(repr(x[k]) for x in IDENTITIES)}])[(floor(value)::BIGINT % {len(IDENTITIES)})::INTEGER + 1]"
LIFECYCLE = f"""WITH l AS (SELECT user_id, event_id, ts, {_OP} AS op, {_PICK(0)} AS provider, {_PICK(1)} AS model, {_PICK(2)} AS dim FROM events WHERE event_id % 3 = 0 OR event_type <> 'view'),
f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM l), g AS (SELECT *, min(CASE WHEN op IN ('indexing', 'indexed', 'failed') THEN n END) OVER (PARTITION BY user_id) AS first FROM f), h AS (SELECT * FROM g WHERE n >= first),
s AS (SELECT user_id, arg_max(op, n) AS op, max(n) FILTER (op = 'indexed') AS done, max(n) FILTER (op = 'indexing') AS begun, arg_max(ts, n) FILTER (op = 'indexed') AS done_ts, arg_max(provider, n) FILTER (op IN ('indexing', 'indexed', 'failed')) AS provider, arg_max(model, n) FILTER (op IN ('indexing', 'indexed', 'failed')) AS model, arg_max(dim, n) FILTER (op IN ('indexing', 'indexed', 'failed')) AS dim FROM h GROUP BY user_id),
x AS (SELECT user_id, CASE op WHEN 'request' THEN 'pending' ELSE op END AS status, CASE WHEN done IS NOT NULL AND (begun IS NULL OR done > begun) THEN done_ts END AS indexed_at, provider, model, dim FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN s USING (user_id)),
w AS (SELECT *, CASE WHEN status IS NULL THEN 'legacy_unknown' WHEN status <> 'indexed' THEN 'status_not_indexed' WHEN provider <> '{IDENTITIES[0][0]}' THEN 'provider_mismatch' WHEN model <> '{IDENTITIES[0][1]}' THEN 'model_mismatch' WHEN dim <> {IDENTITIES[0][2]} THEN 'dimension_mismatch' END AS why FROM x)
SELECT user_id, status, indexed_at, provider, model, dim, why, why IS NULL OR why = 'legacy_unknown' AS allowed, CASE WHEN NOT (why IS NULL OR why = 'legacy_unknown') AND status = 'indexed' THEN 'stale' ELSE status END AS swept_status,
CASE WHEN why = 'legacy_unknown' THEN 'legacy_unknown_allowed' WHEN why = 'status_not_indexed' AND status = 'stale' THEN 'stale_index' WHEN why = 'status_not_indexed' THEN 'document_not_ready' WHEN why IS NOT NULL THEN 'incompatible_index' END AS trace_reason FROM w"""


def upserted(index: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """A vector index after a batch: all rows of the batch's keys are replaced by the batch's."""
    return index.join(batch.select(key).distinct(), key, "left_anti").unionByName(batch)


def mixed_fields(index: DataFrame, fields: list[str]) -> list[Column]:
    """Aggregates that name the metadata fields of which an index has several values."""
    return [F.when(F.count_distinct(f) > 1, F.lit(f)) for f in fields]


def vector_index_update(spark, sf_dir):
    """A vector index by label after one label's vectors were written anew with half as many, another's were deleted, and which metadata is mixed."""
    v = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.size("embedding").alias("dim"), F.lit("v1").alias("model"))
    batch = v.where("label = 1 AND vec_id % 2 = 0").withColumn("model", F.lit("v2"))
    after = upserted(v, batch, "label").where("label <> 2")
    mixed = F.array_join(F.array_compact(F.array(*mixed_fields(after, ["dim", "model"]))), ",")
    whole = after.agg(mixed.alias("mixed"))
    return after.groupBy("label").agg(F.count("*").alias("vectors"), F.max("model").alias("model"), F.max("dim").alias("dim")).crossJoin(whole)


UPDATE = """WITH v AS (SELECT label, vec_id, len(embedding) AS dim, 'v1' AS model FROM embeddings), a AS (SELECT * FROM v WHERE label NOT IN (1, 2) UNION ALL SELECT label, vec_id, dim, 'v2' FROM v WHERE label = 1 AND vec_id % 2 = 0)
SELECT label, count(*) AS vectors, max(model) AS model, max(dim)::INTEGER AS dim, (SELECT concat_ws(',', CASE WHEN count(DISTINCT dim) > 1 THEN 'dim' END, CASE WHEN count(DISTINCT model) > 1 THEN 'model' END) FROM a) AS mixed FROM a GROUP BY label"""

# Job queue: orders stand for jobs.
RETRYABLE = ["TEMPORARY_FAILURE", "TIMEOUT", "PROVIDER_UNAVAILABLE", "RATE_LIMITED"]
CODES = ["TEMPORARY_FAILURE", "INVALID_FILE", "TIMEOUT", "UNSUPPORTED_FILE_TYPE", "PROVIDER_UNAVAILABLE", "EMPTY_TEXT", "RATE_LIMITED"]
MAX_RETRIES = 3


def jobs(spark, sf_dir) -> DataFrame:
    """(job_id, document_id, status, attempt, code, created): orders as jobs; F finished with an error, O queued, P being worked on."""
    o = table(spark, sf_dir, "orders")
    i = F.col("o_orderkey")
    return o.select(i.alias("job_id"), F.col("o_custkey").alias("document_id"), "o_orderstatus", (i % 5).cast("int").alias("attempt"), F.element_at(F.array(*map(F.lit, CODES)), (i % len(CODES) + 1).cast("int")).alias("code"), F.col("o_orderdate").alias("created"))


_JOBS = f"""j AS (SELECT o_orderkey AS job_id, o_custkey AS document_id, o_orderstatus, (o_orderkey % 5)::INTEGER AS attempt, ([{', '.join(map(_lit, CODES))}])[o_orderkey % {len(CODES)} + 1] AS code, o_orderdate AS created FROM orders)"""


def queue_round(spark, sf_dir):
    """One round of the queue: what each job becomes, the message it leaves, and why.

    Failed jobs are queued again while their error may pass and retries are left; jobs in work whose worker is gone (a day
    that divides by four) go back to the queue's head; the oldest queued job of each document is claimed, others of the
    document wait for it.
    """
    j = jobs(spark, sf_dir)
    retry = F.col("code").isin(RETRYABLE) & (F.col("attempt") < MAX_RETRIES)
    lost = F.dayofmonth("created") % 4 == 0
    queued = (F.col("o_orderstatus") == "O") | ((F.col("o_orderstatus") == "P") & lost)
    turn = F.row_number().over(W.partitionBy("document_id", queued).orderBy(F.when(F.col("o_orderstatus") == "P", 0).otherwise(1), "created", "job_id"))
    working = F.max(((F.col("o_orderstatus") == "P") & ~lost).cast("int")).over(W.partitionBy("document_id"))
    j = j.withColumn("turn", turn).withColumn("working", working)
    to = (
        F.when(F.col("o_orderstatus") == "F", F.when(retry, F.lit("queued")).otherwise(F.lit("failed")))
        .when(queued & (F.col("turn") == 1) & (F.col("working") == 0), F.lit("processing")).when(queued, F.lit("queued")).otherwise(F.lit("processing"))
    )
    why = (
        F.when((F.col("o_orderstatus") == "F") & retry, F.lit("retry")).when((F.col("o_orderstatus") == "F") & F.col("code").isin(RETRYABLE), F.lit("retries_exhausted")).when(F.col("o_orderstatus") == "F", F.lit("permanent_error"))
        .when(queued & (F.col("turn") == 1) & (F.col("working") == 0), F.lit("claimed")).when(queued & (F.col("o_orderstatus") == "P"), F.lit("requeued_inflight")).when(queued, F.lit("waits_for_document")).otherwise(F.lit("in_work"))
    )
    message = F.when(to == "queued", F.concat(F.lit('{"job_id":'), F.col("job_id").cast("string"), F.lit("}")))
    return j.select("job_id", to.alias("status"), why.alias("why"), message.alias("message"), F.when(why == "retry", F.col("attempt") + 1).otherwise(F.col("attempt")).alias("attempt"))


QUEUE = f"""WITH {_JOBS}, k AS (SELECT *, code IN ({', '.join(map(_lit, RETRYABLE))}) AS passing, day(created) % 4 = 0 AS lost FROM j),
q AS (SELECT *, o_orderstatus = 'O' OR (o_orderstatus = 'P' AND lost) AS queued FROM k),
t AS (SELECT *, row_number() OVER (PARTITION BY document_id, queued ORDER BY CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END, created, job_id) AS turn, max((o_orderstatus = 'P' AND NOT lost)::INT) OVER (PARTITION BY document_id) AS working FROM q),
w AS (SELECT *, CASE WHEN o_orderstatus = 'F' AND passing AND attempt < {MAX_RETRIES} THEN 'retry' WHEN o_orderstatus = 'F' AND passing THEN 'retries_exhausted' WHEN o_orderstatus = 'F' THEN 'permanent_error' WHEN queued AND turn = 1 AND working = 0 THEN 'claimed' WHEN queued AND o_orderstatus = 'P' THEN 'requeued_inflight' WHEN queued THEN 'waits_for_document' ELSE 'in_work' END AS why FROM t),
s AS (SELECT *, CASE why WHEN 'retry' THEN 'queued' WHEN 'retries_exhausted' THEN 'failed' WHEN 'permanent_error' THEN 'failed' WHEN 'claimed' THEN 'processing' WHEN 'in_work' THEN 'processing' ELSE 'queued' END AS status FROM w)
SELECT job_id, status, why, CASE WHEN status = 'queued' THEN '{{"job_id":' || job_id || '}}' END AS message, CASE WHEN why = 'retry' THEN attempt + 1 ELSE attempt END AS attempt FROM s"""


def job_page(spark, sf_dir):
    """The second page of finished jobs whose document's name matches, newest first, each with the number of all that match."""
    j, c = jobs(spark, sf_dir), table(spark, sf_dir, "customer")
    rows = j.where("o_orderstatus = 'F'").join(c.where(F.col("c_name").ilike("%00001%")), F.col("document_id") == F.col("c_custkey"))
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(F.desc("job_id")).offset(10).limit(10).crossJoin(total).select("job_id", "c_name", "attempt", "total")


PAGE = f"WITH {_JOBS}, r AS (SELECT job_id, c_name, attempt, count(*) OVER () AS total FROM j JOIN customer ON document_id = c_custkey WHERE o_orderstatus = 'F' AND c_name ILIKE '%00001%') SELECT * FROM r ORDER BY job_id DESC LIMIT 10 OFFSET 10"


def active_job_of_document(spark, sf_dir):
    """The newest job of each document that is queued or in work, the newest of all, and the attempt that a new one would be."""
    j = jobs(spark, sf_dir)
    active = F.col("o_orderstatus").isin("O", "P")
    return j.groupBy("document_id").agg(F.max(F.when(active, F.col("job_id"))).alias("active_job"), F.max("job_id").alias("latest_job"), (F.max_by("attempt", "job_id") + 1).alias("next_attempt")).withColumn("may_start", F.col("active_job").isNull())


ACTIVE_JOB = f"WITH {_JOBS}, a AS (SELECT document_id, max(job_id) FILTER (o_orderstatus IN ('O', 'P')) AS active_job, max(job_id) AS latest_job, arg_max(attempt, job_id) + 1 AS next_attempt FROM j GROUP BY document_id) SELECT *, active_job IS NULL AS may_start FROM a"

# Listings and access.


def pending_reviews(spark, sf_dir):
    """Documents without a review by source, oldest first, the place of each among its source's; and the one that approval takes next."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")
    # A source's places come from counts of id ranges, so that no source is ordered in one task.
    return d.groupBy("source").agg(F.count("*").alias("pending"), F.min("doc_id").alias("next_doc"), F.max("doc_id").alias("newest_doc"))


PENDING = "SELECT source, count(*) AS pending, min(doc_id) AS next_doc, max(doc_id) AS newest_doc FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY source"


def review_approval(spark, sf_dir):
    """Every document after approval of those that wait and are long enough: review status, processing status and who approved."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    waits = F.col("quality").isNull()
    status = F.when(waits & (F.col("n_chars") >= 40), F.lit("approved")).when(waits, F.lit("pending_review")).when(F.col("quality") == 1, F.lit("approved")).otherwise(F.lit("rejected"))
    by = F.when(waits & (F.col("n_chars") >= 40), F.lit("sweep"))
    return d.select("doc_id", status.alias("review_status"), by.alias("reviewed_by"), F.when(status == "approved", F.lit("queued")).otherwise(F.lit("none")).alias("processing"))


APPROVAL = """SELECT doc_id, CASE WHEN quality IS NULL AND n_chars >= 40 THEN 'approved' WHEN quality IS NULL THEN 'pending_review' WHEN quality = 1 THEN 'approved' ELSE 'rejected' END AS review_status, CASE WHEN quality IS NULL AND n_chars >= 40 THEN 'sweep' END AS reviewed_by,
CASE WHEN (quality IS NULL AND n_chars >= 40) OR quality = 1 THEN 'queued' ELSE 'none' END AS processing FROM documents LEFT JOIN labels USING (doc_id)"""


def teams_of_user(spark, sf_dir):
    """Each region (team) and its suppliers (members): how many customers (bases) each sees through the team, its role, and invites it may still give."""
    n, r, s, c = (table(spark, sf_dir, t) for t in ("nation", "region", "supplier", "customer"))
    bases = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.count("*").alias("bases"))
    m = s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    role = F.when(F.col("s_acctbal") > 5000, F.lit("admin")).otherwise(F.lit("member"))
    return m.join(F.broadcast(bases), "n_regionkey", "left").select("s_suppkey", F.col("r_name").alias("team"), role.alias("role"), F.coalesce("bases", F.lit(0)).alias("bases"), F.when(role == "admin", 10 - F.col("s_suppkey") % 10).otherwise(F.lit(0)).cast("long").alias("invites_left"))


TEAMS = """WITH b AS (SELECT n_regionkey, count(*) AS bases FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
SELECT s_suppkey, r_name AS team, CASE WHEN s_acctbal > 5000 THEN 'admin' ELSE 'member' END AS role, coalesce(bases, 0) AS bases, CASE WHEN s_acctbal > 5000 THEN 10 - s_suppkey % 10 ELSE 0 END::BIGINT AS invites_left FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN b USING (n_regionkey)"""


def invite_uses(spark, sf_dir):
    """Events of users as uses of a team's invite (code: user modulo 7): joined, already a member, expired or used up."""
    e = table(spark, sf_dir, "events").where("event_type = 'signup'").withColumn("code", F.col("user_id") % 7)
    first = F.row_number().over(W.partitionBy("code", "user_id").orderBy("ts", "event_id")) == 1
    e = e.withColumn("first", first)
    joined = F.sum(F.col("first").cast("int")).over(W.partitionBy("code").orderBy("ts", "event_id"))
    limit = F.col("code") + 3
    result = F.when(F.hour("ts") == 13, F.lit("expired")).when(~F.col("first"), F.lit("already_member")).when(joined > limit, F.lit("used_up")).otherwise(F.lit("joined"))
    return e.select("event_id", "code", result.alias("result"))


INVITES = """WITH e AS (SELECT *, user_id % 7 AS code, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 AS first FROM events WHERE event_type = 'signup'), j AS (SELECT *, sum(first::INT) OVER (PARTITION BY code ORDER BY ts, event_id) AS joined FROM e)
SELECT event_id, code, CASE WHEN hour(ts) = 13 THEN 'expired' WHEN NOT first THEN 'already_member' WHEN joined > code + 3 THEN 'used_up' ELSE 'joined' END AS result FROM j"""


def conversation_access(spark, sf_dir):
    """Conversations a user may read: the owner's, and through a base's membership, joined with the predicate in its ON."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("messages"), F.max("turn").alias("last_turn"))
    c = c.withColumn("owner", F.col("conv_id") % 4).withColumn("base", F.col("conv_id") % 25)
    m = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nk"), (F.col("n_regionkey") > 1).alias("active"), F.col("n_name").alias("base_name"))
    rows = c.join(F.broadcast(m), (F.col("base") == F.col("nk")) & F.col("active"), "left")
    return rows.where((F.col("owner") == 1) | F.col("nk").isNotNull()).select("conv_id", "messages", "last_turn", "base_name", F.when(F.col("owner") == 1, F.lit("owner")).otherwise(F.lit("member")).alias("role"))


CONVERSATIONS = """WITH c AS (SELECT conv_id, count(*) AS messages, max(turn) AS last_turn, conv_id % 4 AS owner, conv_id % 25 AS base FROM conversations GROUP BY conv_id)
SELECT conv_id, messages, last_turn, n_name AS base_name, CASE WHEN owner = 1 THEN 'owner' ELSE 'member' END AS role FROM c LEFT JOIN nation ON base = n_nationkey AND n_regionkey > 1 WHERE owner = 1 OR n_nationkey IS NOT NULL"""


def saved_citations(spark, sf_dir):
    """Citations saved with assistant turns, read back from JSON: what isn't a list counts as none, entries without id or text are left out."""
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    i = F.col("conv_id") + F.col("turn")
    raw = F.when(i % 5 == 0, F.lit("not json")).when(i % 5 == 1, F.lit('{"id": 1}')).otherwise(F.concat(F.lit('[{"citation_id": '), i.cast("string"), F.lit(', "text": "a"}, {"text": "b"}, {"citation_id": 7, "text": '), F.when(i % 2 == 0, F.lit("null")).otherwise(F.lit('"c"')), F.lit("}]")))
    items = F.from_json(F.when(raw.startswith("["), raw), "array<struct<citation_id:long,text:string>>")
    kept = F.filter(F.coalesce(items, F.array().cast("array<struct<citation_id:long,text:string>>")), lambda x: x["citation_id"].isNotNull() & x["text"].isNotNull())
    return c.select("conv_id", "turn", F.size(kept).alias("citations"), F.array_join(F.transform(kept, lambda x: x["citation_id"].cast("string")), ",").alias("ids"))


CITATIONS = """SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 5 <= 1 THEN 0 WHEN (conv_id + turn) % 2 = 0 THEN 1 ELSE 2 END AS citations, CASE WHEN (conv_id + turn) % 5 <= 1 THEN '' WHEN (conv_id + turn) % 2 = 0 THEN (conv_id + turn)::VARCHAR ELSE (conv_id + turn) || ',7' END AS ids FROM conversations WHERE role = 'assistant'"""


def document_states(spark, sf_dir):
    """What a document's page shows: state, step and whether it can be retried, by review, text and latest job (orders of the customer of its id)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    j = jobs(spark, sf_dir).groupBy(F.col("document_id").alias("doc")).agg(F.max_by(F.struct("o_orderstatus", "code", "attempt"), "job_id").alias("j")).select("doc", "j.*")
    rows = d.join(j, F.col("doc_id") == F.col("doc"), "left")
    state = (
        F.when(F.col("quality") == 0, F.lit("rejected")).when(F.col("o_orderstatus") == "O", F.lit("queued")).when(F.col("o_orderstatus") == "P", F.lit("processing")).when(F.col("o_orderstatus") == "F", F.lit("failed"))
        .when(F.col("quality").isNull(), F.lit("pending_review")).when(F.col("n_chars") < 40, F.lit("empty")).otherwise(F.lit("ready"))
    )
    retry = (state == "failed") & F.col("code").isin(RETRYABLE) & (F.col("attempt") < MAX_RETRIES)
    searchable = state.isin("ready")
    return rows.select("doc_id", state.alias("state"), F.coalesce(retry, F.lit(False)).alias("can_retry"), F.when(state == "failed", F.col("code")).alias("error"), searchable.alias("searchable"))


STATES = f"""WITH {_JOBS}, l AS (SELECT document_id, arg_max(o_orderstatus, job_id) AS st, arg_max(code, job_id) AS code, arg_max(attempt, job_id) AS attempt FROM j GROUP BY document_id),
s AS (SELECT doc_id, code, attempt, CASE WHEN quality = 0 THEN 'rejected' WHEN st = 'O' THEN 'queued' WHEN st = 'P' THEN 'processing' WHEN st = 'F' THEN 'failed' WHEN quality IS NULL THEN 'pending_review' WHEN n_chars < 40 THEN 'empty' ELSE 'ready' END AS state FROM documents LEFT JOIN labels USING (doc_id) LEFT JOIN l ON document_id = doc_id)
SELECT doc_id, state, coalesce(state = 'failed' AND code IN ({', '.join(map(_lit, RETRYABLE))}) AND attempt < {MAX_RETRIES}, false) AS can_retry, CASE WHEN state = 'failed' THEN code END AS error, state = 'ready' AS searchable FROM s"""

QUERIES = {
    "upload_validation": (upload_validation, VALIDATION), "job_limits": (job_limits, LIMITS), "chunk_locators": (chunk_locators, LOCATORS), "index_lifecycle": (index_lifecycle, LIFECYCLE), "vector_index_update": (vector_index_update, UPDATE),
    "queue_round": (queue_round, QUEUE), "job_page": (job_page, PAGE), "active_job_of_document": (active_job_of_document, ACTIVE_JOB), "pending_reviews": (pending_reviews, PENDING), "review_approval": (review_approval, APPROVAL), "teams_of_user": (teams_of_user, TEAMS),
    "invite_uses": (invite_uses, INVITES), "conversation_access": (conversation_access, CONVERSATIONS), "saved_citations": (saved_citations, CITATIONS), "document_states": (document_states, STATES),
}
