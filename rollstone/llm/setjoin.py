"""Problem 5: all pairs of records whose sets of values are similar.

Pigeonhole partitioning: for a set of n members the universe is split by hash into m(n) segments, one more than the most
members by which a similar set of any length up to n / limit can differ. A set that looks for shorter ones needs segments
whose allowances add up to the difference possible with them; it takes the cheapest ones by the rarity of their members, each
allowed one deletion (worth two). Sets meet on equal segments or equal one-deletion signatures, and are then compared exactly.
Sets with equal members are one class from the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..work import durable, ship
from .kernel import mix
from .postings import by_range, estimated_repeated, pairs_of, parts_of
from .sketch import HELD, frequencies, frequency


class Plan:
    """How far sets of given sizes may differ, and into how many segments sizes are split."""

    def __init__(self, similarity: float):
        limit = Fraction(str(similarity))
        self.num, self.den = limit.numerator, limit.denominator
        self.known: dict = {}

    def differ(self, r: int, s: int) -> int:
        """Most members by which similar sets of r and s members differ."""
        return r + s - 2 * -(-self.num * (r + s) // (self.num + self.den))

    def segments(self, s: int) -> int:
        if s not in self.known:
            # the bound is monotone in r up to parity, so the two greatest partners decide
            top = s * self.den // self.num
            self.known[s] = max(self.differ(r, s) for r in {top, max(top - 1, s)}) + 1
        return self.known[s]

    def probes(self, r: int) -> list[tuple[int, int]]:
        """(segments, segments to take) for each class of sizes up to r in which similar sets may be."""
        if ("p", r) not in self.known:
            most: dict[int, int] = {}
            for s in range(max(-(-r * self.num // self.den), 1), r + 1):
                m = self.segments(s)
                most[m] = max(most.get(m, -1), self.differ(r, s))
            self.known["p", r] = [(m, (h + 2) // 2) for m, h in most.items()]
        return self.known["p", r]


def _signatures(flat: np.ndarray, owner: np.ndarray, sets: int, m: int, take: np.ndarray | None, often: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """Exact and one-deletion signatures of sets split into m segments, each with its set; take: how many segments of each set, the cheapest."""
    with np.errstate(over="ignore"):
        seg = (mix(flat ^ np.uint64((m * 0x9FB21C651E98DF25) & ((1 << 64) - 1))) % np.uint64(m)).astype(np.int64)
        cell = owner * m + seg
        spread = mix(flat + np.uint64(0x60642E2A34326F15))
        total = np.zeros(sets * m, np.uint64)
        np.add.at(total, cell, spread)
        tag = mix(np.arange(m, dtype=np.uint64) + np.uint64(m << 32))
        exact, gone = mix(total ^ np.tile(tag, sets)), mix((total[cell] - spread) ^ tag[seg])
    cells = np.arange(sets * m)
    if take is None:
        return exact, cells // m, gone, owner
    f = frequency(often, flat).astype(np.float64) + 1
    order = np.lexsort((f, cell))
    c, f = cell[order], f[order]
    size = np.bincount(cell, minlength=sets * m)
    start = np.concatenate(([0], np.cumsum(size)[:-1]))
    cost = np.full(sets * m, 1e15)  # an empty segment meets any other one
    some = size > 0
    cost[some] = size[some] * f[start[some]] + 1e12
    more = size > 1
    cost[more] += f[start[more] + 1] - 1e12
    rank = np.empty((sets, m), np.int64)
    np.put_along_axis(rank, np.argsort(cost.reshape(sets, m), axis=1, kind="stable"), np.arange(m)[None, :], 1)
    chosen = (rank < take[:, None]).ravel()
    return exact[chosen], cells[chosen] // m, gone[chosen[cell]], owner[chosen[cell]]


def _both_sides(lists: pa.ListArray, plan: Plan, often: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of the sets of a batch: hash, set, whether it looks (else it is found), whether a member is gone."""
    flat, offsets = np.asarray(lists.flatten()).view(np.uint64), np.asarray(lists.offsets)
    offsets = offsets - offsets[0]
    n = np.diff(offsets)
    work: dict[tuple[int, bool], list[tuple[int, int]]] = {}
    for i, k in enumerate(n.tolist()):
        work.setdefault((plan.segments(k), False), []).append((i, 0))
        for m, q in plan.probes(k):
            work.setdefault((m, True), []).append((i, q))
    out: list[tuple] = []
    for (m, looks), rows in work.items():
        at, take = (np.array(x, np.int64) for x in zip(*rows))
        size = n[at]
        own = np.repeat(np.arange(len(at)), size)
        where = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(offsets[at], size)
        exact, e, gone, g = _signatures(flat[where], own, len(at), m, take if looks else None, often)
        out += [(exact, at[e], looks, False), (gone, at[g], looks, True)]
    return (np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out]), *(np.concatenate([np.full(len(x[0]), x[k]) for x in out]) for k in (2, 3)))


def _bitmaps(lists: pa.ListArray) -> np.ndarray:
    """A 64-bit map of each set's members by hash."""
    flat, offsets = np.asarray(lists.flatten()).view(np.uint64), np.asarray(lists.offsets)
    return np.bitwise_or.reduceat(np.uint64(1) << (mix(flat ^ np.uint64(0x2545F4914F6CDD1D)) & np.uint64(63)), offsets[:-1] - offsets[0])


#: Signatures of a hash range on average, and of a set by the size of its members, for the number of ranges.
RANGE, PER_MEMBER = 1 << 20, 4


class _Pairs:
    """Pairs of set numbers that the sizes and bit maps allow."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def add(self, left: list[np.ndarray], right: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
        n_a, n_b = left[1][i], right[1][j]
        both = n_a + n_b
        most = both - 2 * -(-self.num * both // (self.num + self.den))
        fits = np.flatnonzero(np.bitwise_count(left[3][i] ^ right[3][j]) <= most)
        i, j = i[fits], j[fits]
        a, b = left[2][i], right[2][j]
        fits = ((n_a[fits] < n_b[fits]) | (a < b)) & (a != b) & ~(left[4][i] & right[4][j])
        a, b = a[fits], b[fits]
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        if len(a):
            once = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
            yield pa.RecordBatch.from_arrays([pa.array(a[once]), pa.array(b[once])], ["a", "b"])

    def rest(self) -> Iterator[pa.RecordBatch]:
        return iter(())

    def empty(self) -> list[pa.DataType]:
        return [pa.int64(), pa.int64()]


def similar_sets(sets: DataFrame, similarity: float, load: float = 0.25, range_: int = RANGE, hot: int | None = None) -> DataFrame:
    """(set_a, set_b) of sets (set: binary key, members: distinct bigint hashes, not empty) above the limit; each key once in sets.

    Signatures travel once, as packed hashes with a set number of 64 bits, by ranges of hashes; in a range a count-min sketch of load
    signatures a slot drops those of one set alone, and the rest are joined exactly. A signature of more than hot pairs is cut into blocks.
    """
    ship(sets.sparkSession)
    plan = Plan(similarity)
    num, den = plan.num, plan.den
    often = frequencies(sets.select("members"), lambda b: np.asarray(b.column(0).flatten()).view(np.uint64))
    sets = sets.withColumn("number", F.xxhash64("set"))
    total = sets.agg(F.sum(F.size("members"))).first()[0] or 0
    parts = max(32, -(-PER_MEMBER * total // range_))

    def cut(held: list[tuple]) -> pa.RecordBatch:
        sig, *cols = (np.concatenate(x) for x in zip(*held))
        return by_range(sig, parts, *cols)

    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for b in batches:
            for part in _parts(b):
                sig, own, looks, gone = _both_sides(part.column(1), plan, often.value)
                n = np.diff(np.asarray(part.column(1).offsets)).astype(np.int32)
                # n, and in its lowest bits whether the set looks and whether a member is gone
                held.append((sig, np.asarray(part.column(0))[own], (n[own] << 2) | (looks.astype(np.int32) << 1) | gone, _bitmaps(part.column(1))[own]))
                size += len(sig)
            if size >= HELD:
                yield cut(held)
                held, size = [], 0
        if size:
            yield cut(held)

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], list[np.ndarray]]]:
        for blobs in parts_of(batches, [np.int64, np.int32, np.uint64]):
            kept = estimated_repeated(blobs, load)
            h, number, about, bits = (np.concatenate(x)[kept] for x in zip(*blobs))
            n, looks, gone = (about >> 2).astype(np.int64), (about & 2) > 0, (about & 1) > 0
            order = np.lexsort((n, h))
            yield tuple([x[order[sel[order]]] for x in (h, n, number, bits, gone)] for sel in (~looks, looks))

    sent = sets.select("number", "members").mapInArrow(signatures, "part int, hashes binary, c0 binary, c1 binary, c2 binary")
    met = pairs_of(sent, parts, "a bigint, b bigint", sides, lambda: _Pairs(num, den), num, den, "candidates", hot)
    pairs = met.distinct()
    left, right = (sets.select(F.col("number").alias(c), F.col("set").alias(f"set_{c}"), F.col("members").alias(f"m_{c}")) for c in "ab")
    o = F.size(F.array_intersect("m_a", "m_b"))
    return pairs.join(left, "a").join(right, "b").where(o * den >= num * (F.size("m_a") + F.size("m_b") - o)).select("set_a", "set_b")


def _parts(b: pa.RecordBatch, most: int = 1 << 17) -> Iterator[pa.RecordBatch]:
    """The batch in parts of so many members at most, one set at least; bounds the memory of a Python worker."""
    offsets = np.asarray(b.column(b.num_columns - 1).offsets)
    at = 0
    while at < b.num_rows:
        end = max(int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1, at + 1)
        yield b.slice(at, end - at)
        at = end


def sets_of(df: DataFrame, key: str, value, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """Distinct sets (set, members) and who has which, (id, set), from rows of a key and a value; null keys and values don't exist.

    Only keys with at least so many distinct values.
    """
    base = df.select(F.col(key).alias("id"), F.xxhash64(value).alias("v")).where(F.col("id").isNotNull() & value.isNotNull())
    base = base.groupBy("id").agg(F.array_sort(F.collect_set("v")).alias("members")).where(F.size("members") >= least)
    base = durable(base.withColumn("set", F.unhex(F.md5(F.array_join(F.col("members").cast("array<string>"), ",")))), "sets", "lz4")
    return durable(base.select("set", "members").dropDuplicates(["set"]), "distinct_sets", "lz4"), base.select("id", "set")
