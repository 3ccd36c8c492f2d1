"""Vectorised hashing of byte windows, words and word shingles (numpy, inside tasks)."""

from __future__ import annotations

from functools import cache

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_CHUNK = 1 << 19

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit integers over all bits (bijective)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@cache
def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    def row(base: int) -> np.ndarray:
        out = np.full(n, base, U)
        out[0] = 1
        return np.multiply.accumulate(out)

    return row(base), row(pow(base, -1, 1 << 64))


def powers(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    size = _CHUNK
    while size < n:
        size *= 2
    p, q = _powers(size, base)
    return p[:n], q[:n]


def window_hashes(b: np.ndarray, w: int, seed: int = 0) -> np.ndarray:
    """64-bit hash of b[i : i + w] for every i, modulo 2**64, mixed; another function for each seed."""
    base = (_BASE + 2 * seed * 0x632BE59BD9B4E019) % (1 << 64)
    n = len(b) - w + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.empty(n, U)
    for s in range(0, n, _CHUNK - w):
        part = b[s : s + _CHUNK - 1]
        m = min(len(part) - w + 1, _CHUNK - w)
        p, q = powers(len(part), base)
        c = np.zeros(len(part) + 1, U)
        np.cumsum((part.astype(U) + U(1)) * p, out=c[1:])
        out[s : s + m] = mix((c[w : w + m] - c[:m]) * q[:m])
    return out


def shingle_sets(texts: list[bytes], k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text number, shingle hash), sorted and distinct: the sets of k-word shingles.

    Words are runs without ASCII white space, A-Z lower-cased. A text of one to
    k - 1 words gives one shingle of all its words.
    """
    none = np.zeros(0, np.int64), np.zeros(0, U)
    if not texts:
        return none
    b = LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    space = SPACE[b]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return none
    p, q = powers(len(b))
    c = np.zeros(len(b) + 1, U)
    np.cumsum((b.astype(U) + U(1)) * p, out=c[1:])
    word = mix((c[ends] - c[starts]) * q[starts])
    first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]])
    doc = np.searchsorted(first, starts, side="right") - 1
    n = np.bincount(doc, minlength=len(texts))
    total, odd = np.zeros(len(word), U), U(1)
    short = n[doc] < k
    at = np.arange(len(word)) - (np.cumsum(n) - n)[doc]  # place of the word in its text
    for j in range(k):
        odd = U((int(odd) * 0xD1342543DE82EF95 + 2 * j + 2) % (1 << 64) | 1)
        total[: len(word) - j] += np.where(doc[: len(word) - j] == doc[j:], mix(word[j:] + odd) * odd, U(j + 1))
    ok = np.where(short, at == 0, at <= n[doc] - k)
    doc, sh = doc[ok], mix(total[ok])
    order = np.lexsort((sh, doc))
    doc, sh = doc[order], sh[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (sh[1:] != sh[:-1])
    return doc[new], sh[new]
