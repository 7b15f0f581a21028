"""Sketches of how often hashes occur, merged over partitions, and packing of sorted hashes.

A sketch of counts never counts too few. It serves to order hashes by rarity and to leave out those of one record; results are the same however full it
is. Its size has a bound, so it can be broadcast whatever the input. Each partition sends the slots it fills as sorted gaps in byte
planes, which the shuffle compresses; slots are merged by range of slots, each range in a task of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from ..work import durable, ship
from .kernel import mix

#: Rows of a count-min sketch, and the log2 of its slots where none is given.
ROWS, WIDTH = 2, 27
#: Hashes that a task holds before it sends them on; bounds its memory.
HELD = 1 << 21


def slots(hashes: np.ndarray, row: int, width: int = WIDTH) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(hashes.astype(np.uint64) + np.uint64((0xA0761D6478BD642F * (row + 1)) & ((1 << 64) - 1))) >> np.uint64(64 - width)


def _pack32(sorted_slots: np.ndarray) -> bytes:
    return np.diff(sorted_slots.astype(np.uint32), prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpack32(b: bytes) -> np.ndarray:
    planes = np.frombuffer(b, np.uint8).reshape(4, len(b) // 4)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint32).ravel(), dtype=np.uint32)


def pack(ascending: np.ndarray) -> bytes:
    """Sorted 64-bit values as gaps in byte planes, which compress well."""
    return np.diff(ascending.astype(np.uint64), prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(b: bytes) -> np.ndarray:
    planes = np.frombuffer(b, np.uint8).reshape(8, len(b) // 8)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


#: Slots of the sketch of frequencies; four bytes each.
FREQUENCY = 20


def frequencies(df: DataFrame, hashes: Callable[[pa.RecordBatch], np.ndarray], width: int = FREQUENCY) -> Broadcast:
    """One-row count-min sketch of how often hashes occur, counters up to 2**32 - 1; for ordering by rarity, never for results."""
    ship(df.sparkSession)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << width, np.int64)
        for b in batches:
            total += np.bincount(slots(hashes(b), 0, width).astype(np.int64), minlength=1 << width)
        total = np.minimum(total, 0xFFFFFFFF).astype(np.uint32).reshape(16, -1)
        yield pa.RecordBatch.from_pydict({"part": pa.array(range(16), pa.int32()), "counts": pa.array([x.tobytes() for x in total], pa.binary())})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for b in batches:
            for part, counts in zip(*(c.to_pylist() for c in b.columns)):
                totals[part] = totals.get(part, 0) + np.frombuffer(counts, np.uint32).astype(np.int64)
        for part, total in totals.items():
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "counts": pa.array([np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes()], pa.binary())})

    merged = df.mapInArrow(fill, "part int, counts binary").repartition(8, "part").mapInArrow(merge, "part int, counts binary")
    whole = np.zeros((16, (1 << width) // 16), np.uint32)
    for r in merged.collect():  # 2**width counters, whatever the input
        whole[r.part] = np.frombuffer(r.counts, np.uint32)
    return df.sparkSession.sparkContext.broadcast(whole.ravel())


def frequency(whole: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return whole[slots(hashes, 0, (len(whole)).bit_length() - 1).astype(np.int64)]




#: Most counters of the sketch that also tells which hashes only one record has, as a power of two; a byte each.
COUNTERS = 25


def coded(n: np.ndarray) -> np.ndarray:
    """Counts as bytes: 0 and 1 as they are, 2 and more by their logarithm in eighths, so that the order stays right up to 2**31."""
    return np.where(n > 1, 1 + np.floor(8 * np.log2(np.maximum(n, 1))), n).clip(0, 255).astype(np.uint8)


def count_sketch(df: DataFrame, describe: Callable[[pa.RecordBatch], tuple[np.ndarray, list[pa.Array]]], schema: str, width: int = COUNTERS) -> tuple[Broadcast, DataFrame]:
    """One pass over df for a one-row count-min sketch and a table of rows.

    describe: a batch's hashes (each once a record) and its rows of the table. Counters are broadcast as coded() bytes and never count too few
    of one and two; partitions send the slots they fill as sorted gaps with counts.
    """
    ship(df.sparkSession)
    shift = max(width - 6, 0)
    names = [c.split()[0] for c in schema.split(", ")]
    whole_schema = f"{schema}, part int, slots binary, counts binary"

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        types: list[pa.DataType] = []

        def send() -> pa.RecordBatch:
            s, n = np.unique(np.concatenate(held), return_counts=True)
            cut = np.flatnonzero(np.diff((s >> np.uint32(shift)).astype(np.int64), prepend=-1))
            ends = [*cut[1:], len(s)]
            low = np.uint32((1 << shift) - 1)
            return pa.RecordBatch.from_arrays([*(pa.nulls(len(cut), t) for t in types), pa.array((s[cut] >> np.uint32(shift)).astype(np.int32)), pa.array([_pack32(s[a:b] & low) for a, b in zip(cut, ends)], pa.binary()), pa.array([np.minimum(n[a:b], 255).astype(np.uint8).tobytes() for a, b in zip(cut, ends)], pa.binary())], [*names, "part", "slots", "counts"])

        for b in batches:
            hashes, cols = describe(b)
            types = [c.type for c in cols]
            yield pa.RecordBatch.from_arrays([*cols, pa.nulls(len(cols[0]), pa.int32()), pa.nulls(len(cols[0]), pa.binary()), pa.nulls(len(cols[0]), pa.binary())], [*names, "part", "slots", "counts"])
            held.append(slots(hashes, 0, width).astype(np.uint32))
            size += len(hashes)
            if size >= 2 * HELD:
                yield send()
                held, size = [], 0
        if size:
            yield send()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for b in batches:
            for part, s, n in zip(*(c.to_pylist() for c in b.columns)):
                total = totals.setdefault(part, np.zeros(1 << shift, np.int64))
                total[_unpack32(s)] += np.frombuffer(n, np.uint8)
        for part, total in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([coded(total).tobytes()], pa.binary())], ["part", "total"])

    both = durable(df.mapInArrow(fill, whole_schema), "described")
    merged = both.where("part IS NOT NULL").select("part", "slots", "counts").repartition(16, "part").mapInArrow(merge, "part int, total binary")
    whole = np.zeros((1 << (width - shift), 1 << shift), np.uint8)
    for r in merged.collect():  # 2**width bytes, whatever the input
        whole[r.part] = np.frombuffer(r.total, np.uint8)
    rows = both.where("part IS NULL").select(*names)
    rows._rollstone_path = both._rollstone_path  # discard() ends both
    return df.sparkSession.sparkContext.broadcast(whole.ravel()), rows
