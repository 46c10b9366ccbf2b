"""Text queries over the driver tables: hygiene, quality, tokens, duplicates, corpus manifest."""
from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparquill.functions import text as T
from sparquill.plans import kb
from sparquill.plans.retrieval import TOK
from sparquill.sources import table


def token_frequency(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("lang", F.explode(T.tokens(F.col("text"))).alias("token")).groupBy("lang", "token").agg(F.count("*").alias("n"))


FREQ = f"WITH t AS (SELECT lang, unnest({TOK.format(x='text')}) AS token FROM documents) SELECT lang, token, count(*) AS n FROM t GROUP BY ALL"


def text_quality_report(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.quality(F.col("text")).alias("status"), T.readable(F.col("text")).alias("readable"))


QUALITY = r"""WITH c AS (SELECT doc_id, text, len(regexp_extract_all(text, '[\x01-\x08\x0b\x0c\x0e-\x1f\x7f]')) AS controls, len(regexp_extract_all(text, '[^\s]')) AS visible, len(regexp_extract_all(text, '[\p{L}\p{N}]')) AS alnum FROM documents)
SELECT doc_id, CASE WHEN text IS NULL OR visible = 0 THEN 'empty' WHEN controls > 0.02 * length(text) THEN 'garbled' WHEN visible >= 12 AND alnum < 0.35 * visible THEN 'garbled' WHEN alnum < 4 THEN 'too_short' ELSE 'valid' END AS status, alnum::INTEGER AS readable FROM c"""


def doc_exact_dup_groups(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy(F.sha2("text", 256).alias("sha256")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"), F.countDistinct("source").alias("sources")).where("copies > 1")


DUPS = "SELECT sha256(text) AS sha256, count(*) AS copies, min(doc_id) AS first_id, count(DISTINCT source) AS sources FROM documents GROUP BY 1 HAVING copies > 1"


def sanitized_texts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", T.sanitized(F.col("text")).alias("t"))
    return d.select("doc_id", F.length("t").alias("chars"), F.md5("t").alias("digest"))


SANITIZED = r"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(9), ' '), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '[ \x{00a0}]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS t FROM documents),
s AS (SELECT doc_id, regexp_replace(t, '^\s+|\s+$', '', 'g') AS t FROM t) SELECT doc_id, length(t)::INTEGER AS chars, md5(t) AS digest FROM s"""


def corpus_manifest(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.length("text").alias("char_count"), F.size(F.split("text", "\n")).alias("line_count"), F.sha2("text", 256).alias("sha256"), F.length("text").between(800, 2500).alias("in_range"))


MANIFEST = "SELECT doc_id, length(text)::INTEGER AS char_count, len(string_split(text, chr(10)))::INTEGER AS line_count, sha256(text) AS sha256, length(text) BETWEEN 800 AND 2500 AS in_range FROM documents"


def document_previews(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.shortened(F.col("text"), 400).alias("preview"))


PREVIEW = r"""WITH c AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents) SELECT doc_id, CASE WHEN length(t) > 400 THEN rtrim(substr(t, 1, 397)) || '...' ELSE t END AS preview FROM c"""


def line_roles(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    role = F.coalesce(T.line_role(F.col("line")), F.when(F.contains("line", F.lit(" | ")), F.lit("table_row")), F.lit("text"))
    return d.select("doc_id", role.alias("role")).groupBy("doc_id", "role").agg(F.count("*").alias("lines"))


ROLES = r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(line, '^\s*([-*+]|[0-9]+[.)])\s+[^\s]') THEN 'list_item' WHEN regexp_matches(line, '^[^\s:.|]([^:.|\n]{0,38}[^\s:.|])?:\s*[^\s]') THEN 'field' WHEN contains(line, ' | ') THEN 'table_row' ELSE 'text' END AS role, count(*) AS lines FROM l GROUP BY ALL"""


OVERVIEW_WORDS = ["摘要", "概述", "简介", "背景", "主要内容", "关键点", "总结", "结论", "引言", "abstract", "overview", "introduction", "summary", "conclusion", "background"]
BOILERPLATE = ["目录", "免责声明", "版权", "页眉", "页脚", "参考文献", "附录", "table of contents", "copyright", "disclaimer", "references", "appendix"]
LIST_MARK = r"(^|\n)\s*(?:[-*]\s+|\d+\.\s+|[一二三四五六七八九十]+、)"


def overview_scored(rows):
    """rows (title, text, index) with their overview score: keywords of title and start, length, structure, place, boilerplate."""
    flat = T.normalized(F.col("text"))
    title, first, n = T.normalized(F.coalesce("title", F.lit(""))), F.substring(flat, 1, 240), F.length(flat)
    words, bad = "|".join(OVERVIEW_WORDS), "|".join(BOILERPLATE)
    own = (
        F.when(title.rlike(words), 3.0).otherwise(0.0) + F.when(first.rlike(words), 1.0).otherwise(0.0) + F.when(n.between(200, 1200), 1.0).when(n.between(80, 199), 0.3).when(n < 80, -1.0).otherwise(0.0) + F.when(flat.rlike("[：:]"), 0.5).otherwise(0.0)
        + F.when(flat.rlike(LIST_MARK), 0.5).otherwise(0.0) + F.when(F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")) >= 3, 0.3).otherwise(0.0) - F.when(title.rlike(bad) | first.rlike(bad), 2.0).otherwise(0.0)
    )
    return rows.withColumn("own", own)


def overview_chunk_score(spark, sf_dir):
    """Overview scores of documents as chunks of their source. Texts are scored where they are; only ids and scores are numbered."""
    rows = overview_scored(table(spark, sf_dir, "documents").withColumn("title", F.col("source"))).select("doc_id", "source", "own")
    index = F.row_number().over(W.partitionBy("source").orderBy("doc_id")) - 1
    return rows.withColumn("i", index).select("doc_id", "source", F.round(F.col("own") + F.greatest(F.lit(0.0), 1 - 0.1 * F.col("i")), 6).alias("score"))


OVERVIEW = rf"""WITH d AS (SELECT doc_id, source, text, lower(trim(regexp_replace(text, '\s+', ' ', 'g'), ' ')) AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM documents), e AS (SELECT *, substr(t, 1, 240) AS f, length(t) AS n FROM d)
SELECT doc_id, source, round((CASE WHEN regexp_matches(lower(source), '{'|'.join(OVERVIEW_WORDS)}') THEN 3.0 ELSE 0 END + CASE WHEN regexp_matches(f, '{'|'.join(OVERVIEW_WORDS)}') THEN 1.0 ELSE 0 END + CASE WHEN n BETWEEN 200 AND 1200 THEN 1.0 WHEN n BETWEEN 80 AND 199 THEN 0.3 WHEN n < 80 THEN -1.0 ELSE 0 END + CASE WHEN regexp_matches(t, '[：:]') THEN 0.5 ELSE 0 END + CASE WHEN regexp_matches(t, '{LIST_MARK}') THEN 0.5 ELSE 0 END
 + CASE WHEN len(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '')) >= 3 THEN 0.3 ELSE 0 END + greatest(0.0, 1 - 0.1 * i) - CASE WHEN regexp_matches(lower(source), '{'|'.join(BOILERPLATE)}') OR regexp_matches(f, '{'|'.join(BOILERPLATE)}') THEN 2.0 ELSE 0 END)::DOUBLE, 6) AS score FROM e"""


def overview_document_order(spark, sf_dir):
    """Handbooks in the order of the words that their names share with each question; ties as they were."""
    q = kb.questions(spark, sf_dir)
    stem = lambda a: F.transform(a, lambda t: F.when((F.length(t) > 3) & t.endswith("s"), F.substr(t, F.lit(1), F.length(t) - 1)).otherwise(t))
    none = F.array().cast("array<string>")
    more = F.concat(*(F.when(F.contains("question", F.lit(w)), F.array(*map(F.lit, a))).otherwise(none) for w, a in TOPICS.items()))
    q = q.select("question_id", F.array_distinct(F.concat(stem(T.tokens(F.col("question"))), more)).alias("qt"))
    d = kb.handbooks(spark, sf_dir).withColumn("dt", F.array_distinct(stem(T.tokens(F.regexp_replace("filename", "[-_.]+", " ")))))
    # Names meet questions on shared words; a question's other documents follow in their own order and need no row.
    shared = q.select("question_id", F.explode("qt").alias("w")).join(d.select("doc_id", F.explode("dt").alias("w")), "w").groupBy("question_id", "doc_id").agg(F.count("*").alias("shared"))
    return shared.withColumn("place", F.row_number().over(W.partitionBy("question_id").orderBy(F.desc("shared"), "doc_id")))


TOPICS = {"团队": ["team"], "成员": ["member", "role"]}
_STEM = "CASE WHEN length(x) > 3 AND ends_with(x, 's') THEN x[1:length(x) - 1] ELSE x END"
_MORE = ", ".join(f"CASE WHEN contains(question, '{w}') THEN {a} ELSE [] END" for w, a in TOPICS.items())
ORDER = rf"""WITH {kb.SUPPLIERS}, {kb.QUESTIONS_SQL}, {kb.HANDBOOKS_SQL}, q AS (SELECT question_id, unnest(list_distinct(list_concat(list_transform({TOK.format(x='question')}, lambda x: {_STEM}), flatten([{_MORE}])))) AS w FROM questions),
d AS (SELECT doc_id, unnest(list_distinct(list_transform({TOK.format(x="regexp_replace(filename, '[-_.]+', ' ', 'g')")}, lambda x: {_STEM}))) AS w FROM handbooks), s AS (SELECT question_id, doc_id, count(*) AS shared FROM q JOIN d USING (w) GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY shared DESC, doc_id)::INTEGER AS place FROM s"""


def markdown_inline_texts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.md5(T.markdown_inline(F.col("text"))).alias("digest"))


MARKDOWN = r"""WITH c AS (SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?m)^\s*>+\s?', '', 'g'), '(?m)^\s*(?:[-*+]|\d+[.)])\s+', '', 'g'), '!?\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '`+([^`]*)`+', '\1', 'g'), '\*\*([^*]+)\*\*', '\1', 'g'), '~~([^~]+)~~', '\1', 'g'), '\*([^*\n]+)\*', '\1', 'g') AS t FROM conversations)
SELECT conv_id, turn, md5(trim(t, ' ')) AS digest FROM c"""

QUERIES = {
    "token_frequency": (token_frequency, FREQ), "text_quality_report": (text_quality_report, QUALITY), "doc_exact_dup_groups": (doc_exact_dup_groups, DUPS), "sanitized_texts": (sanitized_texts, SANITIZED),
    "corpus_manifest": (corpus_manifest, MANIFEST), "document_previews": (document_previews, PREVIEW), "line_roles": (line_roles, ROLES), "overview_chunk_score": (overview_chunk_score, OVERVIEW), "overview_document_order": (overview_document_order, ORDER),
    "markdown_inline_texts": (markdown_inline_texts, MARKDOWN),
}
