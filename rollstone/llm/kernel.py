"""Text kernels over whole Arrow batches: code points, character classes and 64-bit hashes of spans, all in numpy.

A span's hash is a polynomial over mixed code points modulo 2**64, taken from one running sum, and mixed at the end.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Code points handled at once; bounds the memory of a Python worker. One longer text is handled alone.
CHUNK = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = np.asarray(x, np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@lru_cache(1)
def _symbols() -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


@lru_cache(1)
def alnum() -> np.ndarray:
    """By code point: whether it is a letter or digit."""
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)


@lru_cache(1)
def classes() -> np.ndarray:
    """By code point: 1 letter, 2 number, 3 white space, 0 anything else."""
    out = np.fromiter(({"L": 1, "N": 2}.get(unicodedata.category(chr(i))[0], 0) for i in range(0x110000)), np.uint8, 0x110000)
    # fixed values: the white space of Unicode
    out[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = 3
    return out


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(max(n, CHUNK + 65536), base, np.uint64)
            p[0] = 1
            with np.errstate(over="ignore"):
                _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


def chunks(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Index of the first text, code points of some texts in a row, and the offsets of these texts (one more than texts)."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= CHUNK):
            size += len(texts[end])
            end += 1
        part = texts[at:end]
        offsets = np.zeros(len(part) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, part), np.int64, len(part)), out=offsets[1:])
        yield at, np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32), offsets
        at = end


def running(points: np.ndarray) -> np.ndarray:
    """Running sums from which spans() takes the hash of any span."""
    forward, _ = powers(len(points) + 1)
    out = np.zeros(len(points) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_symbols()[points] * forward[: len(points)], out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans; equal spans have equal hashes wherever they stand."""
    _, back = powers(len(sums))
    with np.errstate(over="ignore"):
        return mix((sums[end] - sums[start]) * back[start])


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).view(np.int8)))
    return edge[::2], edge[1::2]


def word_runs(texts: list[str], n: int) -> Iterator[np.ndarray]:
    """For each text, the sorted distinct hashes of its runs of n consecutive words; words are runs of letters and digits, lower case."""
    rolled = [np.uint64(pow(0xC2B2AE3D27D4EB4F | 1, k + 1, 1 << 64)) for k in range(n)]
    for _, points, offsets in chunks([t.lower() + "\n" for t in texts]):
        start, end = runs(alnum()[points])
        h = spans(running(points), start, end)
        first = np.searchsorted(start, offsets)
        with np.errstate(over="ignore"):
            grams = h[: max(len(h) - n + 1, 0)] * rolled[0]
            for k in range(1, n):
                grams = grams + h[k : len(grams) + k] * rolled[k]
        grams = mix(grams)
        for a, b in zip(first[:-1], first[1:]):
            yield np.unique(grams[a : max(b - n + 1, a)])
