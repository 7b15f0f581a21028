"""Problem 4: near-duplicate records by the Jaccard similarity of their word runs.

Rare-first prefix filtering: word runs are ordered by an estimate of their frequency, rarest first. Two sets of n_a and n_b runs
above the limit have an overlap of at least o = limit / (1 + limit) * (n_a + n_b), so at least m of their common runs (m = SHARE, or
o if that is less) stand among the first n_a - o + m of the one and n_b - o + m of the other. Runs that only one record has, by a sketch
that never counts too few, meet nobody and aren't sent. The rest are joined on the run in posting lists, with the filters of length
and position; meetings are counted per pair, as packed pair codes in sorted gaps; pairs with m meetings pass a suffix filter
(sizes by hash range) and are compared once on their whole sets. Records with equal sets are one class from the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..work import discard, durable
from .kernel import mix, word_runs
from .postings import by_range, pairs_of, parts_of
from .sketch import COUNTERS, count_sketch, frequency

#: Defaults of near-duplicate operators.
WORDS, SIMILARITY = 5, 0.8
#: Meetings of a pair before it is compared; any value loses nothing. Runs to a part of the posting lists and pair counts.
SHARE, RANGE = 4, 1 << 20
#: Pair codes that a task holds before it sorts and sends them.
HELD = 1 << 21


def _halves(h: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """The digest of a set of hashes; the first half is the set's number."""
    with np.errstate(over="ignore"):
        return h.sum(dtype=np.uint64), mix(h).sum(dtype=np.uint64)


def _digest(h: np.ndarray) -> bytes:
    return np.array(_halves(h), np.uint64).tobytes()


def _profile(h: np.ndarray) -> tuple[int, int]:
    """Members by sixteenth of the hash range, each up to 127, as bytes of two integers."""
    return tuple(np.minimum(np.bincount((h >> np.uint64(60)).astype(np.int64), minlength=16), 127).astype(np.uint8).view(np.int64).tolist())


def _differ(a: str, b: str) -> Column:
    """Least size of the symmetric difference that two profiles allow."""
    at = lambda c, k: F.shiftright(F.col(c), 8 * k).bitwiseAND(F.lit(127))
    return sum((F.abs(at(f"{p}_{a}", k) - at(f"{p}_{b}", k)) for p in ("p1", "p2") for k in range(8)), F.lit(0))


class _Meetings:
    """Counts meetings of pairs of set numbers: sorts and adds up what it holds, and sends it cut by the first number."""

    def __init__(self, parts: int, num: int, den: int):
        self.parts, self.num, self.den, self.held, self.size = parts, num, den, [], 0

    def add(self, left: list[np.ndarray], right: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
        n_a, n_b = left[1][i], right[1][j]
        least = -(-self.num * (n_a + n_b) // (self.num + self.den))
        share = np.minimum(least, SHARE)
        # positions first: they leave few pairs
        near = np.flatnonzero((left[3][i] < n_a - least + share) & (right[3][j] < n_b - least + share))
        a, b = left[2][i[near]], right[2][j[near]]
        once = (n_a[near] < n_b[near]) | (a < b)
        once &= a != b
        near, a, b = near[once], a[once], b[once]
        if len(near):
            self.held.append((a, b, np.where(least[near] < SHARE, SHARE, 1)))
            self.size += len(near)
            if self.size >= HELD:
                yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            a, b, n = _added(*(np.concatenate(x) for x in zip(*self.held)))
            sent = by_range(mix(a.view(np.uint64)), self.parts, b, np.minimum(n, 255).astype(np.uint8))
            yield pa.RecordBatch.from_arrays(sent.columns, ["part", "firsts", "seconds", "counts"])
            self.held, self.size = [], 0

    def empty(self) -> list[pa.DataType]:
        return [pa.int32(), pa.binary(), pa.binary(), pa.binary()]


def _added(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal pairs as one, with the sum of their numbers."""
    order = np.lexsort((b, a))
    a, b, n = a[order], b[order], n[order]
    start = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, np.int64)
    return a[start], b[start], np.add.reduceat(n.astype(np.int64), start) if len(a) else n


def _often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blobs of meetings sorted by part to the pairs (mixed first number, second number) with SHARE meetings."""
    for blobs in parts_of(batches, [np.int64, np.uint8]):
        a, b, n = _added(*(np.concatenate(x) for x in zip(*blobs)))
        a, b = a[n >= SHARE].view(np.int64), b[n >= SHARE]
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def similar_sets(df: DataFrame, key: str, text: Column, words: int = WORDS, similarity: float = SIMILARITY, counters: int = COUNTERS, hot: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Pairs of different word-run sets above the limit, (set_a, set_b), and who has which set, (id, set), distinct.

    A row with a null key or no word run is left out. Rows delivered twice count once; a key given with two texts has two sets. counters: bound of the
    sketch of frequencies, as a power of two; hot: pairs of one run from which its posting list is cut into blocks.
    """
    limit = Fraction(str(similarity))
    num, den = limit.numerator, limit.denominator
    kind = df.schema[key].dataType.simpleString()
    texts = df.select(F.col(key).alias("id"), text.alias("content")).where(F.col("id").isNotNull())
    chars = texts.agg(F.sum(F.char_length("content"))).first()[0] or 0
    runs = chars // 6  # about as many as there are words
    parts = max(64, -(-runs // RANGE))

    def describe(b: pa.RecordBatch) -> tuple[np.ndarray, list[pa.Array]]:
        sets = list(word_runs(b.column(1).to_pylist(), words))
        at = [i for i, h in enumerate(sets) if len(h)]
        digest = np.array([_halves(sets[i]) for i in at], np.uint64).reshape(-1, 2)
        profile = [_profile(sets[i]) for i in at]
        cols = [[d.tobytes() for d in digest], digest[:, 0].view(np.int64), mix(digest[:, 0]).view(np.int64), [len(sets[i]) for i in at], [p for p, _ in profile], [p for _, p in profile]]
        return np.concatenate([np.zeros(0, np.uint64), *sets]), [b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())))]

    often, known = count_sketch(texts, describe, f"id {kind}, set binary, number bigint, mixed bigint, n int, p1 bigint, p2 bigint", min(max((2 * runs).bit_length(), 10), counters))
    members = durable(known.select("id", "set").distinct(), "members")
    sets = known.groupBy("set").agg(F.min("id").alias("id"), *(F.first(c).alias(c) for c in ("number", "mixed", "n", "p1", "p2")))
    sets = durable(sets, "sets")
    discard(known)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        total = 0

        def send() -> pa.RecordBatch:
            h, number, n, pos = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((number, h))
            once = order[np.r_[True, (np.diff(h[order]) != 0) | (np.diff(number[order]) != 0)]]  # copies, and rows delivered twice
            return by_range(h[once], parts, number[once], n[once].astype(np.int32), pos[once].astype(np.int32))

        for b in batches:
            for h in word_runs(b.column(0).to_pylist(), words):
                if not (n := len(h)):
                    continue
                f = frequency(often.value, h)
                order = np.argsort(f, kind="stable")[: min(n - -(-num * n // den) + SHARE, n)]
                pos = np.flatnonzero(f[order] > 1)
                held.append((h[order[pos]] & ~np.uint64(0xFFFF), np.full(len(pos), h.sum(dtype=np.uint64).view(np.int64)), np.full(len(pos), n), pos))
                total += len(pos)
            if total >= HELD:
                yield send()
                held, total = [], 0
        if total:
            yield send()

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], list[np.ndarray]]]:
        for blobs in parts_of(batches, [np.int64, np.int32, np.int32]):
            h, number, n, pos = (np.concatenate(x) for x in zip(*blobs))
            order = np.lexsort((number, n, h))
            h, number = h[order], number[order]
            once = np.r_[True, (h[1:] != h[:-1]) | (number[1:] != number[:-1])] if len(h) else np.zeros(0, bool)
            side = [h[once], n[order][once].astype(np.int64), number[once], pos[order][once].astype(np.int64)]
            yield side, side

    lists = texts.select("content").mapInArrow(prefixes, "part int, hashes binary, c0 binary, c1 binary, c2 binary")
    met = pairs_of(lists, parts, "part int, firsts binary, seconds binary, counts binary", sides, lambda: _Meetings(parts, num, den), num, den, "meetings", hot)
    often_met = met.repartition(min(parts, 20_000), "part").sortWithinPartitions("part").mapInArrow(_often, "a bigint, b bigint")
    # a set's number is its digest's first half; the first number of a pair comes mixed
    a, b = (sets.select(F.col(number).alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("set", "n", "p1", "p2", "id"))) for s, number in (("a", "mixed"), ("b", "number")))
    both = F.col("n_a") + F.col("n_b")
    least = F.ceil(both * num / F.lit(float(num + den)) - 1e-9)  # overlap that the limit asks for; the exact test comes last
    pairs = durable(often_met.join(a, "a").join(b, "b").where(_differ("a", "b") <= both - 2 * least).select("set_a", "set_b", "n_a", "n_b", "id_a", "id_b"), "candidates")
    discard(met)

    ids = durable(pairs.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct(), "needed")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = list(word_runs(b.column(0).to_pylist(), words))
            yield pa.RecordBatch.from_arrays([pa.array(map(_digest, sets), pa.binary()), pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64()))], ["set", "runs"])

    texts = texts.join(ids, "id", "left_semi").select("content")
    runs_of = texts.mapInArrow(whole, "set binary, runs array<bigint>").dropDuplicates(["set"])
    sides_ = [runs_of.select(F.col("set").alias(f"set_{s}"), F.col("runs").alias(f"runs_{s}")) for s in "ab"]
    overlap = F.size(F.array_intersect("runs_a", "runs_b"))
    true = pairs.join(sides_[0], "set_a").join(sides_[1], "set_b").withColumn("o", overlap).where(F.col("o") * den >= num * (both - F.col("o")))
    return durable(true.select("set_a", "set_b"), "similar"), members


def expand_sets(pairs: DataFrame, members: DataFrame, a: str = "id_a", b: str = "id_b") -> DataFrame:
    """Pairs of ids, a < b and distinct, from pairs of sets and their members, with the pairs inside each set."""
    left = members.select(F.col("set").alias("set_a"), F.col("id").alias("x"))
    right = members.select(F.col("set").alias("set_b"), F.col("id").alias("y"))
    across = pairs.select("set_a", "set_b").join(left, "set_a").join(right, "set_b").select("x", "y").where("x <> y")
    several = members.groupBy("set").count().where("count > 1").select("set")
    own = members.join(several, "set", "left_semi")
    within = own.select("set", F.col("id").alias("x")).join(own.select("set", F.col("id").alias("y")), "set").where("x < y").select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias(a), F.greatest("x", "y").alias(b)).distinct()


def groups(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """One row per id of members: id, group (smallest id of its connected group) and links (ids it is similar to). Copies aren't expanded."""
    size = members.groupBy("set").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    both = pairs.select(F.col("set_a").alias("set"), F.col("set_b").alias("other"))
    both = both.union(both.select("other", "set"))
    links = both.join(size.select(F.col("set").alias("other"), "n"), "other").groupBy("set").agg(F.sum("n").alias("around"))
    group = components(pairs, "set_a", "set_b").withColumnRenamed("node", "set")
    named = size.join(links, "set", "left").join(group, "set", "left").withColumn("component", F.coalesce("component", "set"))
    least = named.groupBy("component").agg(F.min("least").alias("group"))
    per_set = named.join(least, "component").select("set", "group", (F.col("n") - 1 + F.coalesce("around", F.lit(0))).alias("links"))
    return members.join(per_set, "set").groupBy("id").agg(F.min("group").alias("group"), F.sum("links").alias("links"))
