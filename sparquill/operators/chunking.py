"""Structural parsing, chunking and sentence spans: ordered scans, one document a row, in Arrow batches.

The scans keep state from line to line, which column expressions can't; each is a pure function of
one text, applied where the document is.
"""
from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LIST = re.compile(r"\s*(?:[-*+]|\d+[.)])\s+\S")
_FIELD = re.compile(r"[^\s:：.|][^:：.|\n]{0,39}[:：]\s*\S")
_END = "。！？；.!?;"
_CLOSE = "\"'”’）)]}】》」』"
#: Where sentences may end: a mark with the marks and closing quotes after it, or empty lines.
_BREAK = re.compile(rf"[{_END}][{re.escape(_END + _CLOSE)}]*|\n\n+")


def legacy_chunks(text: str, size: int = 500) -> list[str]:
    """Paragraphs packed greedily to at most size characters; longer ones are cut without overlap."""
    out, now = [], ""
    for block in (b.strip() for b in re.split(r"\n\s*\n", text)):
        if not block:
            continue
        if len(block) > size:
            if now:
                out.append(now)
                now = ""
            out += [block[i : i + size] for i in range(0, len(block), size)]
        elif now and len(now) + 2 + len(block) > size:
            out.append(now)
            now = block
        else:
            now = f"{now}\n\n{block}" if now else block
    return [*out, now] if now else out


def fixed_chunks(text: str, size: int = 1200, overlap: int = 120, whole: int = 1200) -> list[tuple[int, int, str]]:
    """(start, end, text) windows that end at the last line end, else blank, of their second half."""
    if len(text) <= whole:
        return [(0, len(text), text)] if text.strip() else []
    out, start = [], 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            half = start + size // 2
            for mark in ("\n", " "):
                at = text.rfind(mark, half, end)
                if at > half:
                    end = at
                    break
        piece = text[start:end].strip()
        if piece:
            out.append((start, end, piece))
        if end >= len(text):
            break
        start = max(end - overlap, start + 1)
        while start < len(text) and text[start].isspace():
            start += 1
    return out


def _inside_token(text: str, i: int) -> bool:
    """A dot between parts of a number, name or path is no end of a sentence."""
    return text[i] == "." and 0 < i < len(text) - 1 and all(c.isalnum() or c in "_-" for c in (text[i - 1], text[i + 1]))


def sentences(text: str) -> list[tuple[int, int, str]]:
    """(start, end, text) of sentences, trimmed; empty lines end them too."""
    out, start = [], 0

    def close(end: int) -> None:
        piece = text[start:end]
        bare = piece.strip()
        if bare:
            a = start + len(piece) - len(piece.lstrip())
            out.append((a, a + len(bare), bare))

    for m in _BREAK.finditer(text):
        if text[m.start()] == "\n":
            close(m.start())
            start = m.end()
        elif not _inside_token(text, m.start()):
            close(m.end())
            start = m.end()
    close(len(text))
    return out


def citation_units(text: str, least: int = 40, target: int = 120, most: int = 300, count: int = 3) -> list[tuple[int, int, str]]:
    """Sentences merged to units: up to count of them, until target and at least least, never beyond most characters."""
    spans, out, i = sentences(text), [], 0
    while i < len(spans):
        a, b, _ = spans[i]
        n, i = 1, i + 1
        while i < len(spans) and n < count and b - a < target and spans[i][1] - a <= most:
            b, n, i = spans[i][1], n + 1, i + 1
        if b - a < least and i < len(spans) and spans[i][1] - a <= most:
            b, i = spans[i][1], i + 1
        for k in range(a, b, most):
            out.append((k, min(b, k + most), " ".join(text[k : min(b, k + most)].split())))
    return out


def blocks(text: str) -> list[tuple[str, int, str, str]]:
    """(kind, level, heading path, text): fences are code, | rows tables, # lines headings, the rest paragraphs, lists and fields."""
    out: list[tuple[str, int, str, str]] = []
    path: list[tuple[int, str]] = []
    held: list[str] = []
    kind, fence = "text", None

    def flush() -> None:
        nonlocal held, kind
        if held:
            body = ("\n" if kind in ("code", "table") else " ").join(held)
            if body.strip():
                out.append((kind, 0, " > ".join(h for _, h in path), body if kind == "code" else body.strip()))
        held, kind = [], "text"

    for line in text.split("\n"):
        bare = line.strip()
        if fence is not None:
            if bare.startswith(fence):
                flush()
                fence = None
            else:
                held.append(line)
            continue
        if bare.startswith(("```", "~~~")):
            flush()
            fence, kind = bare[:3], "code"
            continue
        heading = re.match(r"(#{1,6})\s+(.+)", bare)
        if heading:
            flush()
            level = len(heading[1])
            while path and path[-1][0] >= level:
                path.pop()
            path.append((level, heading[2].strip(" #")))
            out.append(("heading", level, " > ".join(h for _, h in path), path[-1][1]))
        elif bare.startswith("|") and bare.endswith("|") and len(bare) > 1 or " | " in bare:
            if kind != "table":
                flush()
                kind = "table"
            held.append(bare)
        elif not bare:
            flush()
        elif _LIST.match(line) or _FIELD.match(bare):
            flush()
            out.append(("list_item" if _LIST.match(line) else "field", 0, " > ".join(h for _, h in path), bare))
        else:
            if kind == "table":
                flush()
            held.append(bare)
    if fence is not None:
        kind = "code"
    flush()
    return out


def block_aware_chunks(text: str, target: int = 900, most: int = 1400, least: int = 120) -> list[tuple[str, str]]:
    """(heading path, text): tables and code alone, other blocks packed to target within their section; a short tail joins the chunk before."""
    out: list[tuple[str, str]] = []
    now: list[str] = []
    at = ""

    def flush() -> None:
        nonlocal now
        if now:
            body = "\n".join(now)
            if len(body) < least and out and out[-1][0] == at and len(out[-1][1]) + len(body) < most:
                out[-1] = (at, out[-1][1] + "\n" + body)
            else:
                out.append((at, body))
        now = []

    for kind, _, where, body in blocks(text):
        if where != at:
            flush()
            at = where
        if kind == "heading":
            flush()
        elif kind in ("table", "code"):
            flush()
            out += [(at, body[i : i + 1800]) for i in range(0, len(body), 1800)]
        else:
            for piece in [body] if len(body) <= most else [body[i : i + most] for i in range(0, len(body), most)]:
                if now and sum(map(len, now)) + len(now) + len(piece) > target:
                    flush()
                now.append(piece)
    flush()
    return out


def exploded(docs: DataFrame, split: Callable[[str], list], schema: str, names: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, index, ...): the parts of every text that is not null, numbered from 0."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                rows = [(doc, i, *(part if isinstance(part, tuple) else (part,))) for doc, text in zip(*(batch.column(k).to_pylist() for k in (0, 1))) if text is not None for i, part in enumerate(split(text))]
                columns = list(zip(*rows)) if rows else [[]] * (2 + len(names))
                types = [batch.schema.field(0).type, pa.int32(), *(pa.int32() if t.strip().endswith(" int") else pa.string() for t in schema.split(","))]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], ["id", "part", *names])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(run, f"id {kind}, part int, {schema}").withColumnRenamed("id", id_col)
