"""Main text of HTML pages by boosted trees over DOM nodes.

A page becomes a tree of elements. Each element has features: its depth, children and place among
its siblings, size and density of its subtree's text, links and punctuation, and tokens of its tag,
id and class and of its ancestors'. Boosted trees give each the log-odds of being content. A
hierarchical decoding then chooses the most likely labels of the whole tree in which no content
lies under a dropped ancestor. What is kept is written out, one line a block.

The trees are fitted on the driver on at most TRAIN_PAGES pages whose text is known (``gold``):
an element is content if at least half of its words are in runs of three that the known text has.
Where no page has a known text, the page's own semantic tags (article, main; nav, aside, footer)
label the sample.

Defined results: null HTML gives null, HTML without content an empty text; scripts, styles, heads
and comments never count; unclosed and stray tags are tolerated. Rows are judged each by itself.
"""
from __future__ import annotations

import html as entities
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparquill.llm.boosting import Boosted
from sparquill.llm.common import col, in_small_batches, lean
from sparquill.sources import table

TRAIN_PAGES = 400
_TAG = re.compile(r"<!--.*?(?:-->|$)|<(script|style|head|noscript|template|svg)\b.*?(?:</\1\s*>|$)|<(/?)([a-zA-Z][a-zA-Z0-9-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S | re.I)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table td th tr ul".split())
_PHRASES = frozenset("p b i span a em strong".split())
_GOOD = frozenset("article main content body post entry story text".split())
_BAD = frozenset("nav menu ad ads advert banner footer header aside sidebar social share related comment comments cookie promo breadcrumb links widget copyright".split())
_KINDS = {t: i for i, ts in enumerate(("p", "div section", "ul ol li", "a", "nav aside", "footer header", "article main", "h1 h2 h3 h4 h5 h6", "table tr td th", "span b i em strong u", "html body"), 1) for t in ts.split()}
_WORD = re.compile(r"\w+")
FEATURES = ["depth", "children", "place", "siblings", "like", "text", "own", "elements", "density", "links", "points", "words", "kind", "parent_kind", "good", "bad", "over_good", "over_bad", "before", "share"]


class Page:
    """The elements of a page in document order; texts[i] are the pieces of text directly in element i."""

    __slots__ = ("tags", "parents", "names", "pieces")

    def __init__(self, html: str):
        self.tags, self.parents, self.names, self.pieces = ["#root"], [-1], [frozenset()], []
        stack, last = [0], 0
        # Where in the stack each tag is open, and blocks, and blocks other than p: no tag makes the parser search the stack.
        open_at: dict[str, list[int]] = {}
        blocks, others = [], []

        def close(k: int) -> None:
            for i in range(len(stack) - 1, k - 1, -1):
                open_at[self.tags[stack[i]]].pop()
                for held in (blocks, others):
                    if held and held[-1] == i:
                        held.pop()
            del stack[k:]

        for m in _TAG.finditer(html):
            if m.start() > last:
                self.pieces.append((stack[-1], html[last : m.start()]))
            last = m.end()
            tag = m.group(3)
            if not tag:
                continue
            tag = tag.lower()
            if m.group(2):
                at = open_at.get(tag)
                around = others if tag == "p" else blocks
                # A stray end tag of a phrase doesn't close the blocks around it.
                if at and not (tag in _PHRASES and around and around[-1] > at[-1]):
                    close(at[-1])
                continue
            if tag in ("p", "li") and blocks and self.tags[stack[blocks[-1]]] == tag:
                close(blocks[-1])
            attrs = m.group(4)
            named = frozenset(t for x in _NAMES.findall(attrs) for t in re.split(r"[^a-z0-9]+", "".join(x).lower()) if t) if "=" in attrs else frozenset()
            self.tags.append(tag), self.parents.append(stack[-1]), self.names.append(named)
            if tag in _VOID:
                self.pieces.append((len(self.tags) - 1, ""))
            elif not attrs.endswith("/"):
                open_at.setdefault(tag, []).append(len(stack))
                if tag in _BLOCK:
                    blocks.append(len(stack))
                    if tag != "p":
                        others.append(len(stack))
                stack.append(len(self.tags) - 1)
        if last < len(html):
            self.pieces.append((stack[-1], html[last:]))

    def features(self) -> np.ndarray:
        n, parent = len(self.tags), self.parents
        own, words, points, before = [0] * n, [0] * n, [0] * n, [0] * n
        links, upto = [0] * n, 0
        in_link = [False] * n
        depth, children, place, kinds, over_good, over_bad = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
        good, bad, alike = [0] * n, [0] * n, {}
        for i in range(n):
            p, tag = parent[i], self.tags[i]
            names = self.names[i]
            good[i] = int(tag in _GOOD) + len(names & _GOOD) if tag != "body" else 0
            bad[i] = int(tag in _BAD) + len(names & _BAD)
            kinds[i] = _KINDS.get(tag, 0)
            if p >= 0:
                depth[i], place[i] = depth[p] + 1, children[p]
                children[p] += 1
                in_link[i] = in_link[p] or tag == "a"
                over_good[i], over_bad[i] = over_good[p] + good[p], over_bad[p] + bad[p]
                alike[p, tag] = alike.get((p, tag), 0) + 1
        total, first = [0] * n, [None] * n
        for i, text in self.pieces:
            size = len(text.strip())
            if first[i] is None:
                first[i] = upto
            upto += size
            own[i] += size
            total[i] += size
            words[i] += text.count(" ") + 1 if size else 0
            points[i] += text.count(".") + text.count(",")
            if in_link[i]:
                links[i] += size
        elements = [1] * n
        for i in range(n - 1, 0, -1):
            p = parent[i]
            for x in (total, words, points, links, elements):
                x[p] += x[i]
            if first[i] is not None and (first[p] is None or first[i] < first[p]):
                first[p] = first[i]
        page = max(1, total[0])
        before = [(x or 0) / page for x in first]
        t = np.asarray(total, float)
        floor = np.maximum(t, 1)
        up = np.maximum(np.asarray(parent), 0)
        kinds, kids = np.asarray(kinds), np.asarray(children)
        return np.stack([np.asarray(depth), kids, np.asarray(place), kids[up], np.asarray([alike.get((p, g), 0) for p, g in zip(parent, self.tags)]), np.log1p(t), np.log1p(np.asarray(own)), np.log1p(np.asarray(elements)), t / np.asarray(elements), np.asarray(links) / floor, np.asarray(points) / floor, np.log1p(np.asarray(words)), kinds, kinds[up], np.asarray(good), np.asarray(bad), np.asarray(over_good), np.asarray(over_bad), np.asarray(before), t / page], axis=1).astype(np.float32)

    def text(self, kept: np.ndarray) -> str:
        """The pieces in kept elements, a line for each block."""
        lines, line, block = [], [], None
        for i, piece in self.pieces:
            if not kept[i]:
                continue
            b = i
            while self.tags[b] not in _BLOCK and b > 0:
                b = self.parents[b]
            if b != block and line:
                lines.append("".join(line))
                line = []
            block = b
            line.append(piece)
        lines.append("".join(line))
        return "\n".join(x for x in (" ".join(entities.unescape(x).split()) for x in lines) if x)

    def labels(self, known: set[tuple[str, ...]]) -> np.ndarray:
        """1 for elements at least half of whose words are in runs of three that are known."""
        n = len(self.tags)
        hit, size = np.zeros(n), np.zeros(n)
        for i, piece in self.pieces:
            w = _WORD.findall(entities.unescape(piece))
            size[i] += len(w)
            hit[i] += _covered(w, known)
        for i in range(n - 1, 0, -1):
            hit[self.parents[i]] += hit[i]
            size[self.parents[i]] += size[i]
        return (hit >= 0.5 * np.maximum(size, 1)).astype(float)

    def semantic_labels(self) -> np.ndarray:
        out = np.zeros(len(self.tags))
        for i in range(1, len(out)):
            names = self.names[i] | {self.tags[i]}
            out[i] = 0 if names & _BAD else 1 if names & {"article", "main", "html", "body"} else out[self.parents[i]]
        return out


def _covered(words: list[str], known: set[tuple[str, ...]]) -> int:
    inside = [False] * len(words)
    for k in range(len(words) - 2):
        if (words[k], words[k + 1], words[k + 2]) in known:
            inside[k] = inside[k + 1] = inside[k + 2] = True
    if 0 < len(words) < 3:
        return len(words) if tuple(words) in known else 0
    return sum(inside)


def runs(text: str) -> set[tuple[str, ...]]:
    """Runs of up to three words."""
    w = _WORD.findall(text)
    return {tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)}


def decode(score: np.ndarray, parents: list[int]) -> np.ndarray:
    """The most likely labels under which every content element's ancestors are content too."""
    best = score.astype(float).copy()
    best[0] = max(best[0], 1e-9)
    for i in range(len(best) - 1, 0, -1):
        if best[i] > 0:
            best[parents[i]] += best[i]
    kept = best > 0
    for i in range(1, len(best)):
        kept[i] &= kept[parents[i]]
    return kept


def fit(pages: list[str], gold: list[str | None]) -> Boosted | None:
    """Trees fitted on pages with the text of each where it is known; None if there is no page."""
    trees = [Page(p) for p in pages]
    known = [(t, t.labels(runs(g))) for t, g in zip(trees, gold) if g]
    known = [(t, y) for t, y in known if y.sum() > 1 and len(y) > 1] or [(t, t.semantic_labels()) for t in trees]
    return Boosted().fit(np.concatenate([t.features() for t, _ in known]), np.concatenate([y for _, y in known])) if known else None


def extract_one(page: Page, score: np.ndarray) -> str:
    return page.text(decode(score, page.parents))


def extract(pages: DataFrame, gold: DataFrame | Callable[[DataFrame], DataFrame] | None, keep: list[str], html_col: str = "html", page_col: str = "page_id", train_pages: int = TRAIN_PAGES) -> DataFrame:
    """The columns ``keep`` of pages with the main ``text`` of each.

    gold: (page_id, text) of some pages, or what makes it for the bounded sample of pages it is given.
    """
    some = in_small_batches(pages).where(col(html_col).isNotNull())
    ids = [r[0] for r in some.select(col(page_col)).orderBy(F.xxhash64(col(page_col)), col(page_col)).limit(train_pages).collect()]
    picked = some.where(col(page_col).isin([i for i in ids if i is not None]) | (col(page_col).isNull() if None in ids else F.lit(False))).limit(train_pages)
    rows = [(r[0], r[1]) for r in picked.select(col(page_col), col(html_col)).collect()]
    rows.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    texts: dict = {}
    if gold is not None and rows:
        known = gold(picked.select(*(col(c) for c in pages.columns if c != html_col))) if callable(gold) else gold.where(F.col("page_id").isin([i for i in ids if i is not None]))
        texts = {r["page_id"]: r["text"] for r in known.select("page_id", "text").collect()}
    model = pages.sparkSession.sparkContext.broadcast(fit([h for _, h in rows], [texts.get(i) for i, _ in rows]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                last = batch.num_columns - 1
                parsed = [None if h is None else Page(h) for h in batch.column(last).to_pylist()]
                some = [p for p in parsed if p is not None]
                out: list[str | None] = [None] * len(parsed)
                if some and model.value is not None:
                    score = model.value.log_odds(np.concatenate([p.features() for p in some]))
                    scores = iter(np.split(score, np.cumsum([len(p.tags) for p in some])[:-1]))
                    out = [None if p is None else extract_one(p, next(scores)) for p in parsed]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(last)), pa.array(out, pa.string())], [*batch.schema.names[:-1], "text"])

    rest = pages.select(*(col(c) for c in keep), col(html_col).alias("_html"))
    kinds = "".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}, " for f in rest.schema.fields[:-1])
    return rest.mapInArrow(lean(run), f"{kinds}text string")


def gold_of(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """(page_id, text): pages whose URL ends in a document's number, with that document's text."""
    number = F.regexp_extract("url", r"/(\d+)(?:[/?#.]|$)", 1).try_cast("long")
    return pages.select("page_id", number.alias("n")).join(docs.select("doc_id", "text"), F.col("n") == F.col("doc_id")).select("page_id", "text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # The sample has TRAIN_PAGES rows at most, so that it can be broadcast and no document shuffles.
    return extract(table(spark, sf_dir, "pages"), lambda sample: gold_of(F.broadcast(sample), docs), ["page_id"])
