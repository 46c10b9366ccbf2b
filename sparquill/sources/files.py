"""Text of files: plain text, Markdown, DOCX and text PDF, read as binary columns and taken apart where they are.

Only the standard library is used. A file that can't be read gives a row with its error and no segments,
so that one broken file stops no job. OCR and speech results are shaped from the text that their engines print.
"""
from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENCODINGS = ("utf-8", "utf-8-sig", "gb18030")
KINDS = {".txt": "text", ".md": "markdown", ".docx": "docx", ".pdf": "pdf"}
_HEADING = re.compile(r"(#{1,6})\s+(.*)")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_STRING = rb"\((?:\\.|[^\\()])*\)"
_ESCAPES = {ord("n"): 10, ord("r"): 13, ord("t"): 9, ord("b"): 8, ord("f"): 12}


class Unreadable(ValueError):
    """A file without text that can be taken out."""


def decoded(data: bytes) -> tuple[str, str]:
    """Text and encoding by the first of ENCODINGS that fits."""
    if not data:
        raise Unreadable("empty")
    for name in ENCODINGS:
        try:
            return data.decode(name), name
        except UnicodeDecodeError:
            continue
    raise Unreadable("undecodable")


def inline(text: str) -> str:
    """A Markdown line's text without quote, list, link and emphasis marks."""
    text = re.sub(r"^\s*>+\s?", "", text.strip())
    for pattern, to in ((r"^\s*(?:[-*+]|\d+[.)])\s+", ""), (r"!?\[([^\]]*)\]\([^)]+\)", r"\1"), ("`", ""), (r"\*\*(?=\S)(.+?)(?<=\S)\*\*", r"\1"), (r"~~(?=\S)(.+?)(?<=\S)~~", r"\1"), (r"(?<!\*)\*(?!\*)(?=\S)(.+?)(?<=\S)(?<!\*)\*(?!\*)", r"\1"), (r"(?<!\w)_(?!_)(?=\S)(.+?)(?<=\S)(?<!_)_(?!\w)", r"\1")):
        text = re.sub(pattern, to, text)
    return text.strip()


def markdown_segments(text: str) -> list[dict]:
    """Headings and paragraphs under the heading they follow."""
    out, heading, held = [], None, []

    def close() -> None:
        if body := " ".join(held).strip():
            out.append({"text": body, "section": heading})
        held.clear()

    for line in (x.strip() for x in re.split(r"\r\n|\r|\n", text)):
        found = _HEADING.match(line)
        if found or not line:
            close()
        if found:
            heading = inline(found[2]) or None
            if heading:
                out.append({"text": heading, "section": heading})
        elif line:
            held.append(inline(line))
    close()
    return out


def docx_segments(data: bytes) -> list[dict]:
    """Paragraphs of a DOCX file; those of a heading or title style name the section of what follows."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            names = archive.namelist()
            body = ElementTree.fromstring(archive.read("word/document.xml"))
            styles = ElementTree.fromstring(archive.read("word/styles.xml")) if "word/styles.xml" in names else None
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        raise Unreadable("not a DOCX file") from e
    named = {}
    for style in styles.iter(f"{_W}style") if styles is not None else ():
        name = style.find(f"{_W}name")
        named[style.get(f"{_W}styleId")] = name.get(f"{_W}val") if name is not None else style.get(f"{_W}styleId")
    out, section = [], None
    for paragraph in body.iterfind(f".//{_W}body/{_W}p") if body.tag != f"{_W}document" else body.iterfind(f"{_W}body/{_W}p"):
        text = "".join(t.text or "" for t in paragraph.iter(f"{_W}t")).strip()
        if not text:
            continue
        style = paragraph.find(f"{_W}pPr/{_W}pStyle")
        key = style.get(f"{_W}val") if style is not None else None
        if heading_style(key, named.get(key, key)):
            section = text
        out.append({"text": text, "section": section})
    return out


def heading_style(*names: str | None) -> bool:
    low = [n.strip().lower() for n in names if n and n.strip()]
    return any(n.startswith("heading") or n == "title" for n in low)


def pdf_string(token: bytes) -> str:
    """Text of a literal string of a PDF, its escapes resolved."""

    def escaped(m: re.Match) -> bytes:
        x = m[1]
        if x[:1].isdigit() and x[0] < 56:
            return bytes([int(x, 8) & 255])
        return bytes([_ESCAPES.get(x[0], x[0])])

    return _pdf_text(re.sub(rb"\\([0-7]{1,3}|.)", escaped, token[1:-1], flags=re.S))


def _pdf_text(raw: bytes) -> str:
    if raw[:2] in (b"\xfe\xff", b"\xff\xfe"):
        return raw.decode("utf-16", "ignore").strip()
    try:
        return raw.decode("utf-8").strip()
    except UnicodeDecodeError:
        return raw.decode("latin-1").strip()


def _pdf_hex(digits: bytes) -> str:
    clean = re.sub(rb"\s+", b"", digits)
    return _pdf_text(bytes.fromhex((clean + b"0" * (len(clean) % 2)).decode()))


def pdf_stream_text(stream: bytes) -> str:
    """A line for each text object of a content stream: its arrays, literal and hexadecimal strings."""
    lines = []
    for block in re.findall(rb"BT(.*?)ET", stream, re.S) or [stream]:
        parts = []
        for array in re.findall(rb"\[(.*?)\]\s*TJ", block, re.S):
            parts += [pdf_string(m) for m in re.findall(_STRING, array)] + [_pdf_hex(m) for m in re.findall(rb"<([0-9A-Fa-f\s]+)>", array)]
        parts += [pdf_string(m) for m in re.findall(rb"(" + _STRING + rb")\s*(?:Tj|'|\")", block)]
        parts += [_pdf_hex(m) for m in re.findall(rb"<([0-9A-Fa-f\s]+)>\s*(?:Tj|'|\")", block)]
        lines.append(" ".join(p.strip() for p in parts if p.strip()))
    return "\n".join(x for x in lines if x)


def _inflated(data: bytes) -> bytes:
    """What a compressed stream holds: it knows its own end, so that its last byte, which may be a carriage return, isn't taken for the line's end."""
    z = zlib.decompressobj()
    out = z.decompress(data)
    if not z.eof:
        raise zlib.error("incomplete stream")
    return out


def pdf_segments(data: bytes) -> list[dict]:
    """A segment for each page that has text, in the order of its object's number."""
    if not data.startswith(b"%PDF"):
        raise Unreadable("not a PDF file")
    objects = {int(n): body for n, body in re.findall(rb"(?ms)(\d+)\s+\d+\s+obj(.*?)endobj", data)}
    out = []
    for _, body in sorted(objects.items()):
        if not re.search(rb"/Type\s*/Page\b", body):
            continue
        array = re.search(rb"/Contents\s*\[(.*?)\]", body, re.S)
        refs = re.findall(rb"(\d+)\s+\d+\s+R", array[1]) if array else re.findall(rb"/Contents\s+(\d+)\s+\d+\s+R", body)[:1]
        texts = []
        for ref in map(int, refs):
            stream = re.search(rb"stream\r?\n(.*?\n)endstream", objects.get(ref, b""), re.S)
            if stream:
                try:
                    texts.append(pdf_stream_text(_inflated(stream[1]) if b"/FlateDecode" in objects[ref] else stream[1]))
                except zlib.error:
                    continue
        if text := "\n".join(t for t in texts if t).strip():
            out.append({"text": text, "page": len(out) + 1, "locator": f"page:{len(out) + 1}"})
    if not out:
        raise Unreadable("no text in the PDF")
    return out


def needs_ocr(pages: list[str]) -> bool:
    """Whether a PDF's text is too little to be its content: under 16 letters and digits and under four words."""
    text = " ".join(pages)
    return sum(c.isalnum() for c in text) < 16 and sum(any(c.isalnum() for c in w) for w in text.split()) < 4


def segments(kind: str | None, data: bytes) -> tuple[str, list[dict], str | None]:
    """Extractor, segments and encoding of a file's content."""
    if kind == "docx":
        return "docx", docx_segments(data), None
    if kind == "pdf":
        return "pdf", pdf_segments(data), None
    if kind in ("text", "markdown"):
        text, encoding = decoded(data)
        return kind, [{"text": text, "section": None}] if kind == "text" else markdown_segments(text), encoding
    raise Unreadable("unsupported file type")


SCHEMA = "extractor string, encoding string, error string, segments array<struct<text:string,section:string,page:int,locator:string>>"


def extracted(files: DataFrame, name: str = "path", content: str = "content") -> DataFrame:
    """files (name and content columns) with extractor, encoding, error and raw segments of each; null content is an error."""
    rest = files.drop(content).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for path, data in zip(rows[name], rows[content]):
                kind = KINDS.get(("." + str(path).rpartition(".")[2].lower()) if "." in str(path) else "")
                try:
                    extractor, found, encoding = segments(kind, bytes(data) if data is not None else b"")
                    out.append((extractor, encoding, None, [{"text": s["text"], "section": s.get("section"), "page": s.get("page"), "locator": s.get("locator")} for s in found]))
                except Unreadable as e:
                    out.append((None, None, str(e), []))
            yield pd.concat([rows.drop(columns=[content]).reset_index(drop=True), pd.DataFrame(out, columns=["extractor", "encoding", "error", "segments"])], axis=1)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.fields)
    return files.select(*(F.col(f.name) for f in rest.fields), content).mapInPandas(run, f"{kinds}, {SCHEMA}")


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files under path by Spark's binary source, which leaves out files without a byte: (path, modificationTime, length, sha256) and what extracted() gives."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return extracted(files.withColumn("sha256", F.sha2("content", 256)))


def ocr_words(tsv: Column) -> Column:
    """Words of an OCR engine's tab-separated output: rows of level 5 with whole numbers and a text, others are left out."""
    rows = F.filter(F.transform(F.split(tsv, "\n"), lambda r: F.split(r, "\t")), lambda c: (F.size(c) >= 12) & (F.try_element_at(c, F.lit(1)) == "5") & (F.trim(c[11]) != ""))
    whole = F.filter(rows, lambda c: F.forall(F.slice(c, 2, 9), lambda x: x.rlike("^-?[0-9]+$")))
    number = lambda c, i: c[i].cast("int")
    return F.transform(whole, lambda c: F.struct(F.struct(*(number(c, i).alias(n) for i, n in ((1, "page"), (2, "block"), (3, "par"), (4, "line")))).alias("at"), number(c, 6).alias("left"), number(c, 7).alias("top"), number(c, 8).alias("width"), number(c, 9).alias("height"), F.when(c[10].cast("double") >= 0, c[10].cast("double")).alias("confidence"), F.trim(c[11]).alias("text")))


def ocr_regions(words: DataFrame, by: str) -> DataFrame:
    """(by, at, text, left, top, width, height, confidence): lines of (by, w) words from left to right, with the box around them."""
    w = words.select(by, F.explode("w").alias("w")).select(by, "w.*")
    g = w.groupBy(by, "at").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("left", "top", "text"))), lambda x: x["text"]), " ").alias("text"), F.min("left").alias("left"), F.min("top").alias("top"), F.max(F.col("left") + F.col("width")).alias("right"), F.max(F.col("top") + F.col("height")).alias("bottom"), F.avg("confidence").alias("confidence"),
    )
    return g.select(by, "at", "text", "left", "top", F.greatest(F.col("right") - F.col("left"), F.lit(0)).alias("width"), F.greatest(F.col("bottom") - F.col("top"), F.lit(0)).alias("height"), "confidence")


def speech_segment(payload: Column) -> Column:
    """struct(text, start, end) of a speech engine's JSON result; null if it has no text or isn't an object."""
    p = F.from_json(payload, "text string, result array<struct<start:double,end:double,word:string>>")
    text = F.trim(F.regexp_replace(p["text"], "\\s+", " "))
    n = F.size(F.coalesce(p["result"], F.array().cast("array<struct<start:double,end:double,word:string>>")))
    made = F.struct(text.alias("text"), F.when(n > 0, F.element_at(p["result"], 1)["start"]).alias("start"), F.when(n > 0, F.element_at(p["result"], -1)["end"]).alias("end"))
    return F.when(text != "", made)
