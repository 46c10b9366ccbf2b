"""Handbooks as files of four formats, and what is read back from them; OCR lines and speech segments of their units."""
from __future__ import annotations

import io
import zipfile
import zlib

import pandas as pd
from pyspark.sql import functions as F

from sparquill.functions import text as T
from sparquill.plans import kb
from sparquill.sources import files as X

EXTENSIONS = ["txt", "md", "docx", "pdf"]


def made_file(extension: str, sections: list[tuple[str, list[str]]]) -> bytes:
    """A small file of sections of lines."""
    if extension == "txt":
        return "\n".join(line for head, lines in sections for line in [head, *lines]).encode()
    if extension == "md":
        return "\n\n".join(line for head, lines in sections for line in [f"## {head}", *lines]).encode()
    if extension == "docx":
        w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        safe = lambda s: s.replace("&", "&amp;").replace("<", "&lt;")
        p = lambda s, style="": f"<w:p>{style}<w:r><w:t>{safe(s)}</w:t></w:r></w:p>"
        body = "".join(p(head, '<w:pPr><w:pStyle w:val="h1"/></w:pPr>') + "".join(map(p, lines)) for head, lines in sections)
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr(zipfile.ZipInfo("word/document.xml"), f"<w:document {w}><w:body>{body}</w:body></w:document>")
            z.writestr(zipfile.ZipInfo("word/styles.xml"), f'<w:styles {w}><w:style w:styleId="h1"><w:name w:val="heading 1"/></w:style></w:styles>')
        return out.getvalue()
    objects = []
    for i, (head, lines) in enumerate(sections):
        stream = "\n".join(f"BT ({line}) Tj ET" for line in [head, *lines]).encode()
        objects.append(f"{2 * i + 1} 0 obj << /Type /Page /Contents {2 * i + 2} 0 R >> endobj".encode())
        objects.append(f"{2 * i + 2} 0 obj << /Filter /FlateDecode >>\nstream\n".encode() + zlib.compress(stream) + b"\nendstream endobj")
    return b"%PDF-1.4\n" + b"\n".join(objects)


def extracted_files(spark, sf_dir):
    """Each handbook written as text, Markdown, DOCX and PDF and read back: segments, sections, pages and the text's digest."""
    u = kb.units(spark, sf_dir).groupBy("doc_id", "chunk_id").agg(F.array_sort(F.collect_list(F.struct("i", "unit"))).alias("x"))
    s = u.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_id", "x"))).alias("s"))
    rows = s.select("doc_id", F.explode(F.array(*map(F.lit, EXTENSIONS))).alias("ext"), "s")

    @F.pandas_udf("binary")
    def content(ext: pd.Series, sections: pd.Series) -> pd.Series:
        return pd.Series([made_file(e, [(f"Supplier section {x['chunk_id']}", [y["unit"] for y in x["x"]]) for x in xs]) for e, xs in zip(ext, sections)])

    made = rows.select("doc_id", "ext", F.concat(F.lit("h"), F.col("doc_id").cast("string"), F.lit("."), "ext").alias("path"), content("ext", "s").alias("content"))
    found = X.extracted(made)
    valid = F.filter(F.transform("segments", lambda g: F.struct(T.sanitized(g["text"]).alias("t"), g["section"].alias("section"), g["page"].alias("page"))), lambda g: ~T.quality(g["t"]).isin("empty", "garbled", "binary_like"))
    found = found.withColumn("v", valid)
    sections = F.size(F.array_distinct(F.array_compact(F.transform("v", lambda g: g["section"]))))
    return found.select("doc_id", "ext", "extractor", "encoding", "error", F.size("v").alias("segments"), sections.alias("sections"), F.coalesce(F.array_max(F.transform("v", lambda g: g["page"])), F.lit(0)).alias("pages"), F.md5(F.array_join(F.transform("v", lambda g: g["t"]), "\n\n")).alias("digest"))


EXTRACTED = f"""WITH {kb.SUPPLIERS}, {kb.UNITS_SQL}, c AS (SELECT doc_id, chunk_id, 'Supplier section ' || chunk_id AS head, string_agg(unit, chr(10) ORDER BY i) AS one, string_agg(unit, chr(10) || chr(10) ORDER BY i) AS two, count(*) AS n FROM units GROUP BY ALL),
d AS (SELECT doc_id, string_agg(head || chr(10) || one, chr(10) ORDER BY chunk_id) AS txt, string_agg(head || chr(10) || chr(10) || two, chr(10) || chr(10) ORDER BY chunk_id) AS parts, string_agg(head || chr(10) || one, chr(10) || chr(10) ORDER BY chunk_id) AS paged, sum(n + 1)::INTEGER AS segments, count(*)::INTEGER AS sections FROM c GROUP BY doc_id)
SELECT doc_id, ext, CASE ext WHEN 'txt' THEN 'text' WHEN 'md' THEN 'markdown' ELSE ext END AS extractor, CASE WHEN ext IN ('txt', 'md') THEN 'utf-8' END AS encoding, NULL::VARCHAR AS error, CASE ext WHEN 'txt' THEN 1 WHEN 'pdf' THEN sections ELSE segments END AS segments, CASE WHEN ext IN ('md', 'docx') THEN sections ELSE 0 END AS sections, CASE WHEN ext = 'pdf' THEN sections ELSE 0 END AS pages,
md5(CASE ext WHEN 'txt' THEN txt WHEN 'pdf' THEN paged ELSE parts END) AS digest FROM d, (VALUES ('txt'), ('md'), ('docx'), ('pdf')) e(ext)"""


def ocr_lines(spark, sf_dir):
    """Units as an OCR engine prints them, word by word, six a line, read back as lines with boxes and confidence."""
    words = F.split("unit", " ")
    line = lambda i: F.floor(i / 6)
    row = lambda w, i: F.concat_ws("\t", F.lit("5"), F.lit("1"), F.lit("1"), F.lit("1"), line(i).cast("string"), (i % 6).cast("string"), (i % 6 * 50).cast("string"), (line(i) * 20).cast("string"), F.lit("40"), F.lit("15"), F.when(i % 5 == 4, F.lit("-1")).otherwise((90 - i % 5).cast("string")), w)
    head = F.lit("level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext\n4\t1\t1\t1\t0\t0\t0\t0\t0\t0\t-1\t\n5\tx\t1\t1\t0\t0\t0\t0\t0\t0\t50\tbad\n")
    u = kb.units(spark, sf_dir).select("unit_id", F.concat(head, F.array_join(F.transform(words, row), "\n")).alias("tsv"))
    r = X.ocr_regions(u.select("unit_id", X.ocr_words(F.col("tsv")).alias("w")), "unit_id")
    return r.select("unit_id", F.col("at.line").alias("line"), "text", "left", "top", "width", "height", F.round("confidence", 6).alias("confidence"))


OCR = f"""WITH {kb.SUPPLIERS}, {kb.UNITS_SQL}, w AS (SELECT unit_id, unnest(string_split(unit, ' ')) AS w, generate_subscripts(string_split(unit, ' '), 1) - 1 AS i FROM units)
SELECT unit_id, (i // 6)::INTEGER AS line, string_agg(w, ' ' ORDER BY i) AS text, min(i % 6 * 50)::INTEGER AS "left", min(i // 6 * 20)::INTEGER AS top, (max(i % 6 * 50) + 40 - min(i % 6 * 50))::INTEGER AS width, 15 AS height, round(avg(CASE WHEN i % 5 <> 4 THEN (90 - i % 5)::DOUBLE END), 6) AS confidence FROM w WHERE w <> '' GROUP BY unit_id, i // 6"""


def speech_segments(spark, sf_dir):
    """Units as a speech engine's JSON, some without words, text or form, read back as timed segments."""
    i = F.col("unit_id")
    text = F.replace("unit", F.lit('"'), F.lit(""))
    words = F.when(i % 4 == 0, F.lit("")).otherwise(F.concat(F.lit(', "result": [{"start": '), (i % 60).cast("string"), F.lit('.5, "end": 61, "word": "a"}, {"start": 62, "end": '), (i % 60 + 70).cast("string"), F.lit('.25, "word": "b"}]')))
    raw = F.when(i % 11 == 0, F.lit("no json")).when(i % 13 == 0, F.lit('{"text": "  "}')).otherwise(F.concat(F.lit('{"text": "  '), text, F.lit('"'), words, F.lit("}")))
    return kb.units(spark, sf_dir).select("unit_id", X.speech_segment(raw).alias("s")).where("s IS NOT NULL").select("unit_id", F.col("s.text").alias("text"), F.col("s.start").alias("start_s"), F.col("s.end").alias("end_s"))


SPEECH = f"""WITH {kb.SUPPLIERS}, {kb.UNITS_SQL} SELECT unit_id, trim(replace(unit, '"', ''), ' ') AS text, CASE WHEN unit_id % 4 <> 0 THEN unit_id % 60 + 0.5::DOUBLE END AS start_s, CASE WHEN unit_id % 4 <> 0 THEN unit_id % 60 + 70 + 0.25::DOUBLE END AS end_s FROM units WHERE unit_id % 11 <> 0 AND unit_id % 13 <> 0"""

QUERIES = {"extracted_files": (extracted_files, EXTRACTED), "ocr_lines": (ocr_lines, OCR), "speech_segments": (speech_segments, SPEECH)}
