"""Order-dependent selection of evidence, one small group of candidates a query, and marker checks."""
from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame

_TOKEN = re.compile(r"[a-z0-9]+|[一-鿿]")


def _tokens(text: str) -> set[str]:
    return set(_TOKEN.findall(text.lower()))


def _alike(a: set[str], b: set[str], least: float) -> bool:
    return bool(a or b) and len(a & b) >= least * len(a | b)


def pack_context(candidates: DataFrame, chunks: int = 6, chars: int = 4200, per_group: int = 2) -> DataFrame:
    """Candidates (query_id, doc_id, source, text, score) that enter the context, greedily by score: the first always;
    then those that fit the characters, at most per_group of a source, none that starts with the same 320 characters as an
    earlier one, or whose tokens one of its source has to 90 %. Texts of blanks never enter."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "doc_id"], ascending=[False, True])
        taken, used, groups, starts = [], 0, {}, set()
        for r in rows.itertuples():
            text = " ".join((r.text or "").split())
            words, own = _tokens(text), groups.setdefault(r.source, [])
            if len(taken) >= chunks or len(own) >= per_group or not text or text[:320] in starts or any(_alike(words, s, 0.9) for s in own) or (taken and used + len(text) > chars):
                continue
            taken.append((r.query_id, r.doc_id, len(taken) + 1, len(text)))
            used += len(text)
            own.append(words)
            starts.add(text[:320])
        return pd.DataFrame(taken, columns=["query_id", "doc_id", "position", "chars"])

    return candidates.groupBy("query_id").applyInPandas(one, "query_id long, doc_id long, position int, chars int")


def diverse(candidates: DataFrame, k: int = 5) -> DataFrame:
    """k candidates of each query by score less penalties for those of their source that were taken: 0.07 each, 0.22 at most, 0.18 for one of
    the same words (82 %), 0.08 for one of the same locator, if there is such a column. The earliest wins ties."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "doc_id"], ascending=[False, True])
        left = [(r.query_id, r.doc_id, r.source, r.score, _tokens(r.text or ""), getattr(r, "locator", None)) for r in rows.itertuples()]
        out, groups = [], {}
        while left and len(out) < k:
            scores = []
            for _, _, g, s, w, at in left:
                own = groups.get(g, [])
                lost = min(0.22, 0.07 * len(own)) + sum(0.18 * _alike(w, x, 0.82) + 0.08 * (at is not None and at == y) for x, y in own)
                scores.append(max(0.0, s - lost))
            best = max(range(len(left)), key=lambda i: (round(scores[i], 9), -i))
            q, d, g, _, w, at = left.pop(best)
            out.append((q, d, len(out) + 1, round(min(1.0, scores[best]), 6)))
            groups.setdefault(g, []).append((w, at))
        return pd.DataFrame(out, columns=["query_id", "doc_id", "rank", "final"])

    return candidates.groupBy("query_id").applyInPandas(one, "query_id long, doc_id long, rank int, final double")


_GROUP = re.compile(r"\[\s*(S?\d+(?:\s*[,，]\s*S?\d+)*)\s*\]")


def checked_markers(answer: str, allowed: list[str]) -> tuple[str, list[str], int]:
    """The answer with normalised markers of evidence that is allowed, the ones used in order, and how many were removed."""
    used: list[str] = []
    removed = 0

    def swap(m: re.Match) -> str:
        nonlocal removed
        good = []
        for x in re.split(r"\s*[,，]\s*", m[1]):
            name = "S" + x.removeprefix("S")
            if name in allowed:
                good.append(name)
                used.append(name) if name not in used else None
            else:
                removed += 1
        return "".join(f"[{x}]" for x in good)

    return _GROUP.sub(swap, answer), used, removed
