"""Chunks, sentences, citation units and blocks of the driver tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from sparquill.operators import blocks as B
from sparquill.operators import chunking as C
from sparquill.plans import kb
from sparquill.sources import table


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def legacy_chunks(spark, sf_dir):
    return C.exploded(_docs(spark, sf_dir), C.legacy_chunks, "chunk string", ["chunk"])


#: No driver document has an empty line, so that each is one paragraph: the long-block rule alone.
LEGACY = r"""WITH t AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents WHERE NOT regexp_matches(text, '\n\s*\n'))
SELECT doc_id, i::INTEGER AS part, substr(t, i * 500 + 1, 500) AS chunk FROM (SELECT doc_id, t, unnest(range((length(t) + 499) // 500)) AS i FROM t)"""


def fixed_chunks(spark, sf_dir):
    return C.exploded(_docs(spark, sf_dir), C.fixed_chunks, "start_at int, end_at int, chunk string", ["start_at", "end_at", "chunk"])


def sentence_spans(spark, sf_dir):
    return C.exploded(_docs(spark, sf_dir), C.sentences, "start_at int, end_at int, sentence string", ["start_at", "end_at", "sentence"])


def citation_units(spark, sf_dir):
    return C.exploded(_docs(spark, sf_dir), C.citation_units, "start_at int, end_at int, unit string", ["start_at", "end_at", "unit"])


def document_blocks(spark, sf_dir):
    """Headings, tables, code, list items, fields and paragraphs of every document with their range in its plain text."""
    return B.blocks_of(_docs(spark, sf_dir))


def block_aware_chunks(spark, sf_dir):
    """Chunks of every document that keep to its sections, with the source of each span of theirs."""
    return B.chunks_of(_docs(spark, sf_dir))


def page_blocks(spark, sf_dir):
    """Pages' markup as Markdown lines, then as blocks."""
    t = F.regexp_replace("html", "(?is)<(script|style|head)\\b.*?</\\1>|<!--.*?-->", "")
    for pattern, to in (("(?i)<h([1-6])[^>]*>", "\n\n# "), ("(?i)<li[^>]*>", "\n- "), ("(?i)</?(p|div|ul|ol|table|tr|article|section|nav|footer|header|br|h[1-6])\\b[^>]*>", "\n\n"), ("<[^>]+>", ""), ("&nbsp;|&middot;|&copy;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        t = F.regexp_replace(t, pattern, to)
    pages = table(spark, sf_dir, "pages").select("page_id", t.alias("text"))
    return B.blocks_of(pages, id_col="page_id")


def _handbooks(spark, sf_dir):
    """(doc_id, text): the handbooks as Markdown, a section a supplier."""
    u = kb.units(spark, sf_dir).groupBy("doc_id", "chunk_id").agg(F.array_sort(F.collect_list(F.struct("i", "unit"))).alias("x"))
    section = F.concat(F.lit("## Supplier "), F.col("chunk_id").cast("string"), F.lit("\n\n"), F.array_join(F.transform("x", lambda x: x["unit"]), "\n\n"))
    s = u.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_id", section.alias("s")))).alias("s"))
    return s.select("doc_id", F.concat(F.lit("# Handbook\n\n"), F.array_join(F.transform("s", lambda x: x["s"]), "\n\n")).alias("text"))


def handbook_blocks(spark, sf_dir):
    """The handbooks' blocks: kind, role, heading path and range in the plain text."""
    return B.blocks_of(_handbooks(spark, sf_dir)).select("doc_id", F.col("part_no").alias("block_no"), "kind", "role", F.array_join("path", " > ").alias("path"), "text", F.col("start").alias("start_at"), F.col("end").alias("end_at"))


def handbook_chunks(spark, sf_dir):
    """The handbooks' chunks: section, text, number of spans and the source range that they cover."""
    c = B.chunks_of(_handbooks(spark, sf_dir))
    return c.select("doc_id", F.col("part_no").alias("chunk_no"), F.array_join("path", " > ").alias("path"), "text", F.size("spans").alias("spans"), F.array_min(F.transform("spans", lambda s: s["start"])).alias("start_at"), F.array_max(F.transform("spans", lambda s: s["end"])).alias("end_at"))



def block_citations(spark, sf_dir):
    """Citation units of every document that cross no block, line of a field or list, or empty line."""
    return B.citations_of(_docs(spark, sf_dir))


def handbook_citations(spark, sf_dir):
    """The handbooks' citation units: chunk, role, text, source range and locator."""
    c = B.citations_of(_handbooks(spark, sf_dir))
    return c.select("doc_id", F.col("part_no").alias("unit_no"), "chunk_no", "kind", "role", "text", F.col("start").alias("start_at"), F.col("end").alias("end_at"), "locator")


_BLOCKS = rf"""{kb.SUPPLIERS}, {kb.UNITS_SQL}, rows AS (SELECT doc_id, -1::BIGINT AS chunk_id, -1 AS i, 'heading' AS kind, NULL::VARCHAR AS role, 'Handbook' AS path, 'Handbook' AS text FROM units GROUP BY doc_id
UNION ALL SELECT DISTINCT doc_id, chunk_id, -1, 'heading', NULL, 'Handbook > Supplier ' || chunk_id, 'Supplier ' || chunk_id FROM units
UNION ALL SELECT doc_id, chunk_id, i, 'text', CASE WHEN regexp_matches(unit, '^[^：:
]{{1,32}}[：:]\s*\S+') THEN 'field' END, 'Handbook > Supplier ' || chunk_id, unit FROM units),
ranged AS (SELECT *, (row_number() OVER w - 1)::INTEGER AS block_no, (sum(length(text) + 2) OVER w - length(text) - 2)::INTEGER AS start_at, (sum(length(text) + 2) OVER w - 2)::INTEGER AS end_at FROM rows WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_id, i))"""
HANDBOOK_BLOCKS = f"WITH {_BLOCKS} SELECT doc_id, block_no, kind, role, path, text, start_at, end_at FROM ranged"
#: A section's units packed to 900 characters; with ten short units a section is one chunk or two.
_PACKED = f"""WITH RECURSIVE {_BLOCKS}, t AS (SELECT *, length(text) AS n FROM ranged WHERE kind = 'text'),
p AS (SELECT doc_id, chunk_id, i, n AS size, 0 AS part FROM t WHERE i = 0 UNION ALL SELECT t.doc_id, t.chunk_id, t.i, CASE WHEN size + 2 + n > 900 THEN n ELSE size + 2 + n END, CASE WHEN size + 2 + n > 900 THEN part + 1 ELSE part END FROM p JOIN t ON t.doc_id = p.doc_id AND t.chunk_id = p.chunk_id AND t.i = p.i + 1),
g AS (SELECT doc_id, chunk_id, part, string_agg(text, chr(10) || chr(10) ORDER BY i) AS text, any_value(path) AS path, count(*) AS spans, min(start_at) AS start_at, max(end_at) AS end_at FROM p JOIN t USING (doc_id, chunk_id, i) GROUP BY ALL),
m AS (SELECT *, CASE WHEN length(text) < 120 AND part > 0 THEN part - 1 ELSE part END AS part2 FROM g), j AS (SELECT doc_id, chunk_id, part2, string_agg(text, chr(10) || chr(10) ORDER BY part) AS text, any_value(path) AS path, sum(spans)::INTEGER AS spans, min(start_at) AS start_at, max(end_at) AS end_at FROM m GROUP BY ALL),
c AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY chunk_id, part2) - 1)::INTEGER AS chunk_no, path, text, spans, start_at, end_at FROM j)"""
HANDBOOK_CHUNKS = f"{_PACKED} SELECT * FROM c"
#: A unit is one or two sentences of its block, together below 300 characters and the first below 120: one citation.
HANDBOOK_CITATIONS = f"""{_PACKED} SELECT t.doc_id, (row_number() OVER (PARTITION BY t.doc_id ORDER BY t.start_at) - 1)::INTEGER AS unit_no, chunk_no, kind, role, t.text, t.start_at, t.end_at, 'heading:Supplier ' || chunk_id AS locator
FROM t JOIN c ON t.doc_id = c.doc_id AND t.start_at >= c.start_at AND t.end_at <= c.end_at"""


QUERIES = {
    "legacy_chunks": (legacy_chunks, LEGACY), "fixed_chunks": (fixed_chunks, None), "sentence_spans": (sentence_spans, None), "citation_units": (citation_units, None),
    "document_blocks": (document_blocks, None), "block_aware_chunks": (block_aware_chunks, None), "page_blocks": (page_blocks, None), "handbook_blocks": (handbook_blocks, HANDBOOK_BLOCKS), "handbook_chunks": (handbook_chunks, HANDBOOK_CHUNKS),
    "block_citations": (block_citations, None), "handbook_citations": (handbook_citations, HANDBOOK_CITATIONS),
}
