"""Words and their 64-bit hashes, by numpy over whole batches of texts.

A word is a run of bytes other than space and 9 to 13, which in UTF-8 cuts at the same places as in code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Base of the polynomial in a word's bytes, its inverse modulo 2**64, and the multipliers of the finishing mix.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bytes of text that are hashed at a time.
CHUNK = 1 << 19

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64; n of them at least."""
    if base not in _powers or len(_powers[base]) < n:
        steps = np.full(max(n, CHUNK) + 64, base, np.uint64)
        steps[0] = 1
        with np.errstate(over="ignore"):
            _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return _powers[base]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose results look independent."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * MIX1
        h = (h ^ (h >> np.uint64(27))) * MIX2
    return h ^ (h >> np.uint64(31))


def chunks(texts: list[bytes], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Consecutive slices of ``texts`` with about ``limit`` bytes each, one text at least."""
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word."""
    b = np.frombuffer(data, np.uint8)
    gap = np.concatenate([[True], (b == 32) | ((b >= 9) & (b <= 13)), [True]])
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = edge[::2], edge[1::2]
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _power(BASE, len(b))[: len(b)], dtype=np.uint64)])
        h = (sums[end] - sums[start]) * _power(INVERSE, len(b) + 1)[start]
        h = mix(h + (end - start).astype(np.uint64) * MIX2)
    return h, start, end


def hash_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and where each text's words begin (one more entry than texts).

    A text of over 8 chunks is hashed in parts that end at white space, so memory stays at a few dozen bytes for each of its words.
    """
    if sum(map(len, texts)) > 8 * CHUNK:
        parts = [_long(t) for t in texts]
        return np.concatenate([np.empty(0, np.uint64), *parts]), np.cumsum([0, *map(len, parts)])
    h, start, _ = _words(b"\n".join(texts))
    at = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return h, np.searchsorted(start, at)


def _long(text: bytes) -> np.ndarray:
    parts, lo = [np.empty(0, np.uint64)], 0
    while lo < len(text):
        hi = min(len(text), lo + CHUNK)
        while hi < len(text) and text[hi] not in b" \t\n\x0b\x0c\r":
            hi += 1
        parts.append(_words(text[lo:hi])[0])
        lo = hi
    return np.concatenate(parts)


def as_bytes(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column; null is empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]
