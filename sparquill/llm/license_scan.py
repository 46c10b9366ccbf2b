"""License scans as an exact set-similarity join.

A text block is a line or, with paragraphs, a run of lines that aren't blank, so that license text
wrapped over lines is one block; its tokens are the different lower-cased runs of ASCII letters and digits.
A block matches a template if at least THRESHOLD of the template's tokens are in it.

Tokens are ordered by the number of blocks of the whole corpus that hold them, rarest first. Of a
template of n tokens of which o have to be found, one of the first n - o + 1 must be in every
matching block (prefix filter, an inverted index over the templates); the block must have at
least o tokens of the templates' vocabulary (length filter); and the tokens of block and template
behind the first common one must suffice for o (positional filter). What passes is counted
exactly. The index holds templates, not documents; templates beyond MAX_TEMPLATES are scanned
for in several passes, so that it stays small.

Defined results: null and empty texts have no blocks that match; a template without tokens
matches nothing; repeated rows give repeated matches; a block can match several templates.
"""
from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparquill.llm.common import col, in_small_batches, lean
from sparquill.sources import table

THRESHOLD = 0.8
MAX_TEMPLATES = 20_000
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-4.0": "Licensed under the Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
}
_TOKEN = re.compile("[a-z0-9]+").findall


def tokens(text: str) -> set[str]:
    return set(_TOKEN(text.lower()))


def needed(n: int, threshold: float) -> int:
    """How many of a template's n tokens a matching block holds at least."""
    return max(1, math.ceil(threshold * n - 1e-9))


def blocks_of(text: str, paragraphs: bool) -> Iterator[tuple[int, str]]:
    """The blocks of a text, each with the number of its (first) line."""
    lines = text.split("\n")
    if not paragraphs:
        yield from enumerate(lines)
        return
    start = 0
    for i in range(len(lines) + 1):
        if i == len(lines) or not lines[i].strip():
            if i > start:
                yield start, "\n".join(lines[start:i])
            start = i + 1


def block_counts(docs: DataFrame, text_col: str, vocabulary: set[str], paragraphs: bool = False) -> Counter:
    """Blocks of the corpus that hold each token of the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for _, block in blocks_of(text or "", paragraphs):
                    found.update(tokens(block) & vocabulary)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array(list(found.values()), pa.int64())], ["token", "n"])

    rows = docs.select(col(text_col)).mapInArrow(lean(count), "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return Counter({r["token"]: r["n"] for r in rows.collect()})


class Index:
    """Templates by the tokens of their prefixes, under a global token order."""

    def __init__(self, templates: dict[str, str], counts: Counter, threshold: float):
        sets = {name: tokens(text) for name, text in templates.items()}
        every = sorted(set().union(*sets.values()), key=lambda t: (counts[t], t))
        self.rank = {t: i for i, t in enumerate(every)}
        self.templates, self.prefix = [], defaultdict(list)
        for name, own in sets.items():
            if own:
                order = sorted(self.rank[t] for t in own)
                o = needed(len(order), threshold)
                for at in range(len(order) - o + 1):
                    self.prefix[order[at]].append((len(self.templates), at))
                self.templates.append((name, frozenset(order), o))
        self.words, self.starts = set(self.rank), {every[i] for i in self.prefix}

    def matches(self, block: str) -> list[tuple[str, int, int]]:
        """(template, common tokens, its tokens) of the templates that the block contains."""
        own = tokens(block)
        if own.isdisjoint(self.starts):
            return []
        order = sorted(self.rank[t] for t in own & self.words)
        found, seen = [], set()
        for j, token in enumerate(order):
            for k, at in self.prefix.get(token, ()):
                if k in seen:
                    continue
                seen.add(k)  # this is the first token that both have, in either's order
                name, want, o = self.templates[k]
                if len(order) < o or 1 + min(len(want) - at - 1, len(order) - j - 1) < o:
                    continue
                common = len(want.intersection(order))
                if common >= o:
                    found.append((name, common, len(want)))
        return found


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", paragraphs: bool = False) -> DataFrame:
    """(doc_id, block, template, containment): every block (its first line's number from 0) that contains a template."""
    kind = in_small_batches(docs).schema[id_col].dataType.simpleString()
    names = sorted(templates)
    out = None
    for start in range(0, max(1, len(names)), MAX_TEMPLATES):
        part = {n: templates[n] for n in names[start : start + MAX_TEMPLATES]}
        counts = block_counts(docs, text_col, set().union(*map(tokens, part.values())), paragraphs)
        index = docs.sparkSession.sparkContext.broadcast(Index(part, counts, threshold))

        def find(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows: list[tuple] = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if text and not tokens(text).isdisjoint(index.value.starts):
                        for i, block in blocks_of(text, paragraphs):
                            rows += [(doc, i, name, common / size) for name, common, size in index.value.matches(block)]
                doc, at, name, share = zip(*rows) if rows else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(doc, batch.schema.field(0).type), pa.array(at, pa.int32()), pa.array(name, pa.string()), pa.array(share, pa.float64())], ["doc_id", "block", "template", "containment"])

        found = docs.select(col(id_col), col(text_col)).mapInArrow(lean(find), f"doc_id {kind}, block int, template string, containment double")
        out = found if out is None else out.unionAll(found)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def paragraphs_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan by paragraphs: what query() finds in a line, and license text wrapped over lines."""
    return scan(table(spark, sf_dir, "documents"), paragraphs=True)


_VALUES = ", ".join("('" + n + "', '" + t.lower().replace("'", "''") + "')" for n, t in TEMPLATES.items())
ORACLE_SQL = f"""
WITH t AS (
  SELECT template, list_distinct(regexp_extract_all(txt, '[a-z0-9]+')) AS want FROM (VALUES {_VALUES}) v(template, txt)
), b AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS block
  FROM documents WHERE text <> ''
), k AS (
  SELECT doc_id, block, list_distinct(regexp_extract_all(lower(line), '[a-z0-9]+')) AS own FROM b
), m AS (
  SELECT doc_id, block::INTEGER AS block, template, len(list_intersect(own, want)) AS common, len(want) AS size FROM k CROSS JOIN t
)
SELECT doc_id, block, template, common / size::DOUBLE AS containment FROM m WHERE common >= ceil({THRESHOLD} * size - 1e-9)
"""
