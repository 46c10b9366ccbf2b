"""Structured blocks of texts and chunks that keep where they come from.

A block is a dict of kind, text, order, level, path, role, language and its range in the plain text; ranges
count the blank line between blocks. The scans keep state from line to line; each is a pure function of one
text, and blocks_of() and chunks_of() apply them where the documents are.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparquill.operators.chunking import sentences
from sparquill.sources.files import inline

_HEADING = re.compile(r"(#{1,6})\s+(\S.*)")
_FENCE = re.compile(r"```([A-Za-z0-9_-]+)?\s*")
_LIST = re.compile(r"\s*(?:[-*+]|\d+[.)])\s+\S")
_FIELD = re.compile(r"[^：:\n]{1,32}[：:]\s*\S+")


def lines_of(text: str) -> list[str]:
    return re.split(r"\r\n|\r|\n", text)


def structured(text: str) -> bool:
    """Whether a text has Markdown structure: two headings or more, not mostly headings, with text around them."""
    rows, heads, code = lines_of(text), [], False
    for i, line in enumerate(x.strip() for x in rows):
        if _FENCE.fullmatch(line):
            code = not code
        elif not code and (m := _HEADING.fullmatch(line)) and not line.startswith(("#!", "##!")) and not m[2].lower().startswith(("include ", "define ", "pragma ", "!/")):
            heads.append(i)
    filled = sum(bool(x.strip()) for x in rows)
    if len(heads) < 2 or len(heads) / filled > 0.5:
        return False
    return any(body(rows[a + 1 : b]) for a, b in zip([-1, *heads], [*heads, len(rows)]))


def body(rows: list[str]) -> bool:
    code = False
    for line in (x.strip() for x in rows):
        if _FENCE.fullmatch(line):
            code = not code
        elif line and not code and not _HEADING.fullmatch(line):
            return True
    return False


def parsed(text: str) -> list[dict]:
    """The blocks of a text: headings, tables, code, list items, fields and paragraphs, under their heading path."""
    out: list[dict] = []
    path: list[tuple[int, str]] = []
    held: list[str] = []
    table: list[str] = []
    code: list[str] | None = None
    language = None

    def add(kind: str, value: str, **more) -> None:
        if value.strip():
            out.append({"kind": kind, "text": value.strip(), "level": None, "role": None, "language": None, "path": [t for _, t in path], **more})

    def close() -> None:
        if held:
            add("text", " ".join(map(inline, held)))
        if table:
            add("table", "\n".join(table))
        held.clear(), table.clear()

    for line in lines_of(text):
        bare = line.strip()
        if m := _FENCE.fullmatch(bare):
            if code is None:
                close()
                code, language = [], m[1]
            else:
                add("code", "\n".join(code), language=language)
                code = None
        elif code is not None:
            code.append(line.rstrip())
        elif not bare:
            close()
        elif m := _HEADING.fullmatch(bare):
            close()
            while path and path[-1][0] >= len(m[1]):
                path.pop()
            path.append((len(m[1]), inline(m[2])))
            add("heading", path[-1][1], level=len(m[1]))
        elif bare.startswith("|") and bare.endswith("|") and bare.count("|") >= 2:
            if held:
                add("text", " ".join(map(inline, held)))
                held.clear()
            table.append(bare)
        else:
            if table:
                add("table", "\n".join(table))
                table.clear()
            plain = inline(bare)
            if _LIST.match(bare) or _FIELD.match(plain):
                close()
                add("text", plain, role="list_item" if _LIST.match(bare) and not _FIELD.match(plain) else "field")
            else:
                held.append(bare)
    if code is not None:
        add("code", "\n".join(code), language=language)
    close()
    return ranged(out)


def ranged(blocks: list[dict]) -> list[dict]:
    """Blocks in order, those without text left out, numbered anew, each with its range in plain()."""
    out, at = [], 0
    for b in blocks:
        text = b["text"].strip()
        if text:
            at += 2 * bool(out)
            out.append({**b, "text": text, "order": len(out), "start": at, "end": at + len(text)})
            at += len(text)
    return out


def plain(blocks: list[dict]) -> str:
    return "\n\n".join(b["text"].strip() for b in blocks if b["text"].strip())


def rendered(blocks: list[dict]) -> str:
    """Blocks as Markdown: headings with their level's marks, tables under [Table], code in fences."""
    show = {"heading": lambda b, t: f"{'#' * max(1, min(b['level'] or 1, 6))} {t}", "table": lambda b, t: t if t.startswith("[Table]") else f"[Table]\n{t}", "code": lambda b, t: f"```{b['language'] or ''}\n{t}\n```"}
    return "\n\n".join(show.get(b["kind"], lambda _, t: t)(b, b["text"].strip()) for b in blocks if b["text"].strip())


def cuts(text: str, most: int, overlap: int = 0) -> list[tuple[int, int]]:
    """(start, end) of pieces of at most ``most`` characters: packed lines where there are several, else windows that overlap; trimmed."""
    units = [(m.start(), m.end()) for m in re.finditer(r"[^\n]+", text) if m[0].strip()]
    units = [(a + len(text[a:b]) - len(text[a:b].lstrip()), b - (len(text[a:b]) - len(text[a:b].rstrip()))) for a, b in units]
    out: list[tuple[int, int]] = []
    if len(units) > 1:
        now: list[tuple[int, int]] = []
        size = 0
        for a, b in units:
            if b - a > most:
                if now:
                    out.append((now[0][0], now[-1][1]))
                now, size = [], 0
                out += [(a + x, a + y) for x, y in cuts(text[a:b], most)]
            elif now and size + 1 + b - a > most:
                out.append((now[0][0], now[-1][1]))
                now, size = [(a, b)], b - a
            else:
                size += b - a + bool(now)
                now.append((a, b))
        return [*out, (now[0][0], now[-1][1])] if now else out
    start = 0
    while start < len(text):
        end = min(len(text), start + most)
        piece = text[start:end]
        if piece.strip():
            out.append((start + len(piece) - len(piece.lstrip()), end - (len(piece) - len(piece.rstrip()))))
        if end >= len(text):
            break
        start = max(end - overlap, start + 1)
    return out


def chunked(blocks: list[dict], target: int = 900, most: int = 1400, least: int = 120, table: int = 1800, overlap: int = 120) -> list[dict]:
    """Chunks of text, path, kinds, orders, part and spans (start and end in the chunk and in the source).

    Tables and code stand alone; other blocks are packed to target inside their section; a block longer than most is cut;
    a tail shorter than least joins the chunk before it in its section.
    """
    out: list[dict] = []

    def made(own: list[dict]) -> dict:
        spans, at = [], 0
        for b in own:
            at += 2 * bool(spans)
            spans.append((at, at + len(b["text"]), b["start"], b["end"]))
            at += len(b["text"])
        return {"text": plain(own), "path": here, "kinds": list(dict.fromkeys(b["kind"] for b in own)), "orders": [b["order"] for b in own], "part": None, "parts": None, "spans": spans}

    def cut(b: dict, size: int, over: int) -> list[dict]:
        pieces = cuts(b["text"], size, over)
        return [{**made([b]), "text": b["text"][x:y], "part": i, "parts": len(pieces), "spans": [(0, y - x, b["start"] + x, b["start"] + y)]} for i, (x, y) in enumerate(pieces)]

    def section(own: list[dict]) -> None:
        first = len(out)
        now: list[dict] = []
        for b in own:
            if len(b["text"]) > most:
                if now:
                    out.append(made(now))
                out.extend(cut(b, most, overlap))
                now = []
            elif now and len(plain(now)) + 2 + len(b["text"]) > target:
                out.append(made(now))
                now = [b]
            else:
                now.append(b)
        if now and len(plain(now)) < least and len(out) > first:
            tail, before = made(now), out[-1]
            shift = len(before["text"]) + 2
            before.update(text=f"{before['text']}\n\n{tail['text']}", kinds=list(dict.fromkeys(before["kinds"] + tail["kinds"])), orders=before["orders"] + tail["orders"], spans=before["spans"] + [(a + shift, b + shift, c, d) for a, b, c, d in tail["spans"]])
        elif now:
            out.append(made(now))

    here: list[str] = []
    held: list[dict] = []
    for b in blocks:
        if b["kind"] in ("heading", "table", "code"):
            section(held)
            held = []
            here = b["path"]
            if b["kind"] != "heading":
                size = table if b["kind"] == "table" else most
                out.extend([made([b])] if len(b["text"]) <= size else cut(b, size, 0))
        else:
            here = b["path"]
            held.append(b)
    section(held)
    return out


#: Words that stand alone as a sentence and say nothing.
_EMPTY = {"概要", "登场角色", "如下：", "因此。", "综上。", "该方法。"}
_CLAUSE = re.compile(r"[^，,、：:]*[，,、：:]|[^，,、：:]+")


def low_value(text: str, title: str | None = None, path: list[str] | None = None) -> bool:
    """Whether a sentence says nothing to cite: hardly a letter, a stock phrase, or just its heading."""
    t = " ".join(text.split())
    letters = sum(c.isalnum() for c in t)
    heads = {" ".join(h.split()) for h in [title or "", *(path or [])]} - {""}
    return not letters or len(t) < 8 and letters < 3 or t in heads or t in _EMPTY or t.endswith("...") and len(t) < 16


def trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    """The range without the blanks at its ends."""
    piece = text[a:b]
    return (a + len(piece) - len(piece.lstrip()), a + len(piece.rstrip())) if piece.strip() else (a, a)


def groups(text: str, role: str | None) -> list[tuple[int, int, str | None]]:
    """(start, end, role) of the parts of a span that no citation crosses: a field or list item alone, other lines up to the next blank one."""
    if role:
        a, b = trimmed(text, 0, len(text))
        return [(a, b, role)] if a < b else []
    out: list[tuple[int, int, str | None]] = []
    at, joins = 0, False
    for line in text.splitlines(keepends=True):
        a, b = trimmed(text, at, at + len(line))
        at += len(line)
        own = ("list_item" if _LIST.match(text[a:b]) else "field" if _FIELD.match(text[a:b]) else None) if a < b else None
        if a < b and joins and not own:
            out[-1] = (out[-1][0], b, None)
        elif a < b:
            out.append((a, b, own))
        joins = a < b and not own
    return out


def clauses(text: str, most: int) -> list[tuple[int, int]]:
    """Ranges of a sentence: all of it, or if it is longer than most, clauses packed to most; one clause is never cut."""
    if len(" ".join(text.split())) <= most:
        return [(0, len(text))]
    spans = [x for m in _CLAUSE.finditer(text) if (x := trimmed(text, *m.span()))[0] < x[1]]
    out: list[tuple[int, int]] = []
    size = 0
    for a, b in spans:
        n = len(" ".join(text[a:b].split()))
        if out and size + 1 + n <= most:
            out[-1], size = (out[-1][0], b), size + 1 + n
        else:
            out.append((a, b))
            size = n
    return out or [(0, len(text))]


def cited(blocks: list[dict], least: int = 40, target: int = 120, most: int = 300, count: int = 3) -> list[dict]:
    """Citation units of a text's chunks: sentences merged inside one group of one block, with where they are in the source.

    A sentence shorter than target takes the next ones until the unit has least characters, up to count sentences and most
    characters; least is at most target. Headings and sentences of low value give none. A text without any gives no row;
    equal sentences give a unit each.
    """
    out: list[dict] = []
    for no, c in enumerate(chunked(blocks)):
        path = c["path"]
        title = path[-1] if path else None
        for (a, b, start, _), order in zip(c["spans"], c["orders"]):
            whole = c["text"][a:b]
            for ga, gb, role in groups(whole, blocks[order]["role"]):
                found = [(ga + sa + x, ga + sa + y) for sa, _, s in sentences(whole[ga:gb]) for x, y in clauses(s, most)]
                spans = [(x, y, t) for x, y in found if not low_value(t := " ".join(whole[x:y].split()), title, path)]
                i = 0
                while i < len(spans):
                    k, text = 1, spans[i][2]
                    while i + k < len(spans) and k < count and (len(text) < least or k == 1 and len(text) < target) and len(text) + 1 + len(spans[i + k][2]) <= most:
                        text += " " + spans[i + k][2]
                        k += 1
                    x, y = start + spans[i][0], start + spans[i + k - 1][1]
                    i += k
                    if not low_value(text, title, path):
                        out.append({"chunk_no": no, "kind": blocks[order]["kind"], "role": blocks[order]["role"], "path": path, "section": title, "text": text, "start": x, "end": y, "locator": f"heading:{title}" if title else f"chars:{x}-{y}"})
    return out


#: Parts that a task hands out at once.
HELD = 4096


def _column(docs: DataFrame, make, schema: str, fields: list[tuple[str, pa.DataType]], id_col: str, text_col: str) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []

            def out(rows: list[tuple], id_type: pa.DataType = batch.schema.field(0).type) -> pa.RecordBatch:
                columns = [pa.array([r[0] for r in rows], id_type), pa.array([r[1] for r in rows], pa.int32())]
                columns += [pa.array([r[2][name] for r in rows], t) for name, t in fields]
                return pa.RecordBatch.from_arrays(columns, ["id", "part_no", *(n for n, _ in fields)])

            # A text may be a whole book: its parts leave before the next text is read.
            for doc, text in zip(batch.column(0), batch.column(1)):
                if text.is_valid:
                    held.extend((doc.as_py(), i, x) for i, x in enumerate(make(text.as_py())))
                while len(held) >= HELD:
                    yield out(held[:HELD])
                    del held[:HELD]
            if held:
                yield out(held)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(run, f"id {kind}, part_no int, {schema}").withColumnRenamed("id", id_col)


_S, _I, _L = pa.string(), pa.int32(), pa.list_(pa.string())


def blocks_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, part_no, kind, level, role, language, path, text, start, end): the blocks of every text that is not null."""
    return _column(docs, parsed, "kind string, level int, role string, language string, path array<string>, text string, start int, `end` int", [("kind", _S), ("level", _I), ("role", _S), ("language", _S), ("path", _L), ("text", _S), ("start", _I), ("end", _I)], id_col, text_col)


def chunks_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, part_no, path, kinds, orders, part, parts, text, spans): block-aware chunks with where each span of theirs comes from."""
    span = pa.struct([("at", _I), ("to", _I), ("start", _I), ("end", _I)])
    make = lambda t: [{**c, "spans": [dict(zip(("at", "to", "start", "end"), s)) for s in c["spans"]]} for c in chunked(parsed(t))]
    return _column(docs, make, "path array<string>, kinds array<string>, orders array<int>, part int, parts int, text string, spans array<struct<at:int,to:int,start:int,`end`:int>>", [("path", _L), ("kinds", _L), ("orders", pa.list_(_I)), ("part", _I), ("parts", _I), ("text", _S), ("spans", pa.list_(span))], id_col, text_col)


def citations_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, part_no, chunk_no, kind, role, path, section, text, start, end, locator): citation units of every text that is not null, numbered through the text."""
    fields = [("chunk_no", _I), ("kind", _S), ("role", _S), ("path", _L), ("section", _S), ("text", _S), ("start", _I), ("end", _I), ("locator", _S)]
    return _column(docs, lambda t: cited(parsed(t)), "chunk_no int, kind string, role string, path array<string>, section string, text string, start int, `end` int, locator string", fields, id_col, text_col)
