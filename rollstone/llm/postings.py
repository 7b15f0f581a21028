"""Posting lists as packed arrays: cut by hash range, joined on equal hashes in a task, and cut into blocks where a hash is hot."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..work import durable
from .sketch import ROWS, pack, slots, unpack

#: Pairs made at once in a task; pairs of one hash from which it is cut into blocks; members of a block.
MADE, HOT, BLOCK = 1 << 22, 1 << 24, 2048


def planes(x: np.ndarray) -> bytes:
    """The array's bytes, the lowest of all values first: small values compress well this way."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes() if len(x) else b""


def from_planes(b: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(width, len(b) // width).T).view(kind).ravel()


def by_range(h: np.ndarray, parts: int, *cols: np.ndarray) -> pa.RecordBatch:
    """part (range of the hash), the hashes in order as gaps, and the columns as planes."""
    order = np.argsort(h, kind="stable")
    h = h[order]
    part = ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    cut = np.flatnonzero(np.diff(part.astype(np.int64), prepend=-1))
    ends = [*cut[1:], len(h)]
    return pa.RecordBatch.from_arrays([pa.array(part[cut].astype(np.int32)), pa.array([pack(h[a:b]) for a, b in zip(cut, ends)], pa.binary()), *(pa.array([planes(c[order[a:b]]) for a, b in zip(cut, ends)], pa.binary()) for c in cols)], ["part", "hashes", *(f"c{i}" for i in range(len(cols)))])


def parts_of(batches: Iterator[pa.RecordBatch], types: list[type]) -> Iterator[list[tuple[np.ndarray, ...]]]:
    """The blobs of one part after the other, unpacked, from rows sorted by part."""
    now, blobs = None, []
    for b in batches:
        for part, h, *cols in zip(*(c.to_pylist() for c in b.columns)):
            if part != now and blobs:
                yield blobs
                blobs = []
            now = part
            blobs.append((unpack(h), *(from_planes(c, t) for c, t in zip(cols, types))))
    if blobs:
        yield blobs


def estimated_repeated(blobs: list[tuple[np.ndarray, ...]], load: float) -> np.ndarray:
    """Count-min estimate over the blobs' (hash, owner, ...): which of all rows have a hash that two rows at least have; never no wrongly.

    Every blob's sketch is added to those of the others; counters stop at 2. load: rows a slot.
    """
    width = max(6, int(np.ceil(np.log2(max(sum(len(b[0]) for b in blobs) / load, 1)))))
    sketch = np.zeros((ROWS, 1 << width), np.uint8)
    for h, *_ in blobs:
        for row in range(ROWS):
            at, n = np.unique(slots(h, row, width), return_counts=True)
            sketch[row, at] = np.minimum(sketch[row, at] + np.minimum(n, 2), 2)
    h = np.concatenate([b[0] for b in blobs])
    kept = np.ones(len(h), bool)
    for row in range(ROWS):
        kept &= sketch[row, slots(h, row, width)] > 1
    return kept


def _within(left: list[np.ndarray], right: list[np.ndarray], num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indexes of pairs on equal hashes where the left size is within [num / den * right size, right size]; both sides sorted by (hash, size, ...)."""
    u = np.unique(left[0])
    wide = int(max(left[1].max(initial=0), right[1].max(initial=0))) + 2
    at = lambda h, n: np.searchsorted(u, h).astype(np.int64) * wide + n
    known = np.isin(right[0], u)
    key = at(left[0], left[1])
    rows = np.flatnonzero(known)
    n = right[1][rows]
    low = np.searchsorted(key, at(right[0][rows], -(-n * num // den)))
    high = np.searchsorted(key, at(right[0][rows], n), "right")
    size = np.maximum(high - low, 0)
    rows, low, size = rows[size > 0], low[size > 0], size[size > 0]
    ends = np.cumsum(size)
    a = 0
    while a < len(rows):
        b = max(int(np.searchsorted(ends, (ends[a - 1] if a else 0) + MADE, "right")), a + 1)
        s = size[a:b]
        yield np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s) + np.repeat(low[a:b], s), np.repeat(rows[a:b], s)
        a = b


def _runs(h: np.ndarray) -> dict[int, tuple[int, int]]:
    start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    return {int(h[a]): (int(a), int(b)) for a, b in zip(start, [*start[1:], len(h)])}


def meet(left: list[np.ndarray], right: list[np.ndarray], num: int, den: int, hot: int) -> Iterator[tuple[np.ndarray, np.ndarray] | bytes]:
    """Pairs of indexes of sides sorted by (hash, size), or, for a hash with more than hot pairs, blocks of both sides to be joined elsewhere."""
    of_right = _runs(right[0]) if len(left[0]) * len(right[0]) > hot else {}
    cold_l, cold_r = np.ones(len(left[0]), bool), np.ones(len(right[0]), bool)
    for h, (a, b) in (_runs(left[0]) if of_right else {}).items():
        c, d = of_right.get(h, (0, 0))
        if (b - a) * (d - c) <= hot:
            continue
        cold_l[a:b] = cold_r[c:d] = False
        for i in range(a, b, BLOCK):
            for j in range(c, d, BLOCK):
                x, y = [v[i : min(i + BLOCK, b)] for v in left], [v[j : min(j + BLOCK, d)] for v in right]
                if x[1][-1] * den >= y[1][0] * num and x[1][0] <= y[1][-1]:
                    yield pickle.dumps((x, y))
    l, r = np.flatnonzero(cold_l), np.flatnonzero(cold_r)
    for i, j in _within([v[l] for v in left], [v[r] for v in right], num, den):
        yield l[i], r[j]


def pairs_of(sent: DataFrame, parts: int, schema: str, reduce: Callable, join: Callable, num: int, den: int, name: str, hot: int | None = None) -> DataFrame:
    """Rows of schema from blobs (part, hashes, ...) in two steps: cold hashes in the task of their part, blocks of hot ones over all tasks.

    reduce: a part's blobs to two sides sorted by (hash, size). join(emit): a collector with add(left, right, i, j) and rest(), both yielding batches of schema.
    """
    hot = HOT if hot is None else hot
    names = [c.split()[0] for c in schema.split(", ")]

    def with_block(made: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in made:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.nulls(b.num_rows, pa.binary())], [*names, "block"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = join()
        empty = None
        for left, right in reduce(batches):
            for made in meet(left, right, num, den, hot):
                if isinstance(made, bytes):
                    empty = empty or out.empty()
                    yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in empty), pa.array([made], pa.binary())], [*names, "block"])
                else:
                    yield from with_block(out.add(left, right, *made))
        yield from with_block(out.rest())

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = join()
        for b in batches:
            for block in b.column(0).to_pylist():
                left, right = pickle.loads(block)
                for i, j in _within(left, right, num, den):
                    yield from out.add(left, right, i, j)
        yield from out.rest()

    made = sent.repartition(min(parts, 20_000), "part").sortWithinPartitions("part").mapInArrow(first, f"{schema}, block binary")
    made = durable(made, name)
    blocks = made.where("block IS NOT NULL").select("block")
    cold = made.where("block IS NULL").select(*names)
    n = blocks.count()
    out = cold.unionByName(blocks.repartition(max(1, min(n, 20_000)), F.xxhash64("block")).mapInArrow(second, schema)) if n else cold
    out._rollstone_path = made._rollstone_path
    return out
