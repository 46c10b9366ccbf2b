"""Word shingles of whole texts as 64-bit hashes, computed over flat byte arrays."""
from __future__ import annotations

import numpy as np

_M = 0x9E3779B97F4A7C15 | 1
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = True
_C = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _C[0]
    x = (x ^ (x >> np.uint64(27))) * _C[1]
    return x ^ (x >> np.uint64(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        n = max(n, 2 * len(_powers[0]))
        both = []
        for base in (_M, pow(_M, -1, 1 << 64)):
            p = np.full(n, np.uint64(base))
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _powers = (both[0], both[1])
    return _powers


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts, end to end, and where each text's words start (and the last ends).

    A word is a run of ASCII letters, digits, underscores and non-ASCII characters.
    """
    data = [t.lower().encode() for t in texts]
    flat = np.frombuffer(b" ".join(data) + b" ", np.uint8)
    ends = np.cumsum([len(d) + 1 for d in data], dtype=np.int64)
    inside = _WORD[flat]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
    start, stop = edge[::2], edge[1::2]
    up, down = _tables(len(flat) + 1)
    total = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * up[: len(flat)], out=total[1:])
    words = mixed((total[stop] - total[start]) * down[start] ^ (stop - start).astype(np.uint64) * _C[2])
    return words, np.concatenate([[0], np.searchsorted(start, ends)])


def shingles(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each run of ``width`` words, and where each text's runs start (and the last ends).

    A text of fewer words has one shingle of all its words; a text without words has none.
    """
    words, at = word_hashes(texts)
    count = np.diff(at)
    runs = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
    out_at = np.concatenate([[0], np.cumsum(runs)])
    doc = np.repeat(np.arange(len(texts)), runs)
    first = at[:-1][doc] + (np.arange(out_at[-1]) - out_at[:-1][doc])
    length = np.minimum(count, width)[doc]
    h = np.zeros(len(first), np.uint64)
    for i in range(width):
        here = i < length
        if here.all():
            h = mixed(h * _C[3] + words[first + i])
        else:
            h[here] = mixed(h[here] * _C[3] + words[first[here] + i])
    return h, out_at


def in_chunks(texts: list[str], limit: int = 1 << 18):
    """(start, stop) of runs of texts of about limit characters; a longer text is a run of its own."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)
