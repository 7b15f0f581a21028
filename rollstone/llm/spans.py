"""Problem 9: long spans that stand word for word in more than one record.

Every window of the wanted length holds one anchor: its rarest-hashing half-length window, or, where that half occurs in it
twice (periodic text), the whole window. The choice depends on the window's characters alone, so two records with a common
span share an anchor. Anchors travel as packed 64-bit hashes with a record number, by ranges of hashes whose number follows from the
characters of all texts. In each range the partitions' count-min sketches are added up; they overestimate how many records have an
anchor, and only anchors estimated repeated go on to the second pass, which groups them exactly. The characters around the repeated ones
are fetched last. An anchor's occurrences fall into classes by the whole windows they stand in, so nothing is compared pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..work import discard, durable, ship
from .kernel import chunks, mix, running, spans
from .sketch import HELD, ROWS, pack, slots, unpack

#: Characters (code points) of a span; anchors of a range on average; occurrences of an anchor that one task groups.
LENGTH, RANGE, HOT = 150, 1 << 19, 20_000
#: Rows of a class that meet in one task; characters that a task of the joins gets.
BLOCK, JOINED = 2_000, 1 << 24


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(points: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Position, hash and extent (the half or the whole length) of the anchors of all windows within the texts."""
    half = length // 2
    wide = length - half + 1
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(points) < length:
        return none
    sums = running(points)
    at = np.arange(len(points) - half + 1)
    key = spans(sums, at, at + half) & ~np.uint64(0xFFFF)
    place = (at & 0xFFFF).astype(np.uint64)
    left = _sliding_min(key | place, wide)
    right = _sliding_min(key | (np.uint64(0xFFFF) - place), wide)
    valid = np.zeros(len(points) + 1, np.int8)
    begin, end = offsets[:-1], offsets[1:] - length + 1
    long = end > begin
    valid[begin[long]] += 1
    valid[end[long]] -= 1
    s = np.flatnonzero(np.cumsum(valid[: len(left)]))
    if not len(s):
        return none
    where = lambda low: s + ((low.astype(np.int64) - s) & 0xFFFF)
    first = where(left[s] & np.uint64(0xFFFF))
    tied = first != where(np.uint64(0xFFFF) - (right[s] & np.uint64(0xFFFF)))
    one, whole = np.unique(first[~tied]), s[tied]
    return np.concatenate([one, whole]), np.concatenate([spans(sums, one, one + half), spans(sums, whole, whole + length)]), np.concatenate([np.full(len(one), half), np.full(len(whole), length)])


def _by_text(texts: list[str], length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    for at, points, offsets in chunks(texts):
        pos, h, extent = anchors(points, offsets, length)
        order = np.argsort(pos, kind="stable")
        pos, h, extent = pos[order], h[order], extent[order]
        cut = np.searchsorted(pos, offsets)
        for i in range(len(offsets) - 1):
            a, b = cut[i], cut[i + 1]
            yield at + i, pos[a:b] - offsets[i], h[a:b], extent[a:b]


def _send(bits: int, length: int):
    """(rid, text) to packed anchors: part (range of the hash), hashes, rids, positions. The lowest bit of a hash marks a whole window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def send() -> pa.RecordBatch:
            h, rid, pos = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(h, kind="stable")
            h, rid, pos = h[order], rid[order], pos[order].astype(np.int32)
            part = (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
            cut = np.flatnonzero(np.diff(part, prepend=-1))
            ends = [*cut[1:], len(h)]
            return pa.RecordBatch.from_arrays([pa.array(part[cut].astype(np.int32)), *(pa.array([f(x[a:b]) for a, b in zip(cut, ends)], pa.binary()) for f, x in ((pack, h), (np.ndarray.tobytes, rid), (np.ndarray.tobytes, pos)))], ["part", "hashes", "rids", "pos"])

        for b in batches:
            rids = np.asarray(b.column(0))
            for i, pos, h, extent in _by_text(b.column(1).to_pylist(), length):
                if len(h):
                    held.append((h & ~np.uint64(1) | (extent == length).astype(np.uint64), np.full(len(h), rids[i]), pos))
                    size += len(h)
            if size >= HELD:
                yield send()
                held, size = [], 0
        if size:
            yield send()

    return run


def _distinct(h: np.ndarray, rid: np.ndarray) -> np.ndarray:
    """Hashes, once for each record that has them."""
    order = np.lexsort((rid, h))
    h, rid = h[order], rid[order]
    return h[np.r_[True, (h[1:] != h[:-1]) | (rid[1:] != rid[:-1])]] if len(h) else h


def _repeated(load: float):
    """Blobs sorted by part to (rid, anchor, pos, n): the anchors that two records at least have, n their occurrences."""

    def found(blobs: list[tuple]) -> pa.RecordBatch:
        hs, rids, pos = zip(*((unpack(h), np.frombuffer(r, np.int64), np.frombuffer(p, np.int32)) for h, r, p in blobs))
        width = max(6, int(np.ceil(np.log2(max(sum(map(len, hs)) / load, 1)))))
        sketch = np.zeros((ROWS, 1 << width), np.uint8)
        for h, r in zip(hs, rids):  # a partition's sketch, added to those of the others; counters stop at 2
            own = _distinct(h, r)
            for row in range(ROWS):
                at, n = np.unique(slots(own, row, width), return_counts=True)
                sketch[row, at] = np.minimum(sketch[row, at] + np.minimum(n, 2), 2)
        h, rid, pos = (np.concatenate(x) for x in (hs, rids, pos))
        kept = np.ones(len(h), bool)
        for row in range(ROWS):
            kept &= sketch[row, slots(h, row, width)] > 1
        h, rid, pos = h[kept], rid[kept], pos[kept]
        # second pass, exact: how many records, and how many occurrences
        u, records = np.unique(_distinct(h, rid), return_counts=True)
        _, n = np.unique(h, return_counts=True)
        at = np.searchsorted(u, h)
        sure = records[at] > 1 if len(h) else np.zeros(0, bool)
        return pa.RecordBatch.from_arrays([pa.array(rid[sure]), pa.array(h[sure].view(np.int64)), pa.array(pos[sure]), pa.array(n[at[sure]] if len(h) else n)], ["rid", "anchor", "pos", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs = None, []
        for b in batches:
            for part, *blob in zip(*(c.to_pylist() for c in b.columns)):
                if part != now and blobs:
                    yield found(blobs)
                    blobs = []
                now = part
                blobs.append(blob)
        if blobs:
            yield found(blobs)

    return run


def _points(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix hashes of the texts by length (0 to width), and the texts' lengths."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    grid = np.zeros((len(texts), width), np.uint64)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    with np.errstate(over="ignore"):
        grid[np.repeat(np.arange(len(texts)), size), at] = mix(flat + np.uint64(0x632BE59BD9B4E019)) * mix(at.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        return np.concatenate([np.zeros((len(texts), 1), np.uint64), np.cumsum(grid, axis=1, dtype=np.uint64)], axis=1), size


def _windows(anchor: np.ndarray, record: np.ndarray, before: list[str], after: list[str], reach: int) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Whole groups of occurrences of anchors: for each the least and most characters before it in a window that another record has too (-1 for none).

    Also the classes: (occurrences, their class) of windows that records share, left out where an earlier class holds the same occurrences.
    """
    pre, n_pre = _points(before, reach)
    post, n_post = _points(after, reach)
    k = len(anchor)
    low, high, last, classes = np.full(k, -1), np.full(k, -1), np.full(k, -1), []
    for x in range(reach + 1):
        fits = np.flatnonzero((n_pre >= x) & (n_post >= reach - x))
        now = np.full(k, -1)
        if len(fits):
            with np.errstate(over="ignore"):
                w = mix(mix(pre[fits, x] + anchor[fits]) + post[fits, reach - x] * np.uint64(0xD6E8FEB86659FD93 | 1))
            order = np.argsort(w, kind="stable")
            rows, w = fits[order], w[order]
            start = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
            of = np.cumsum(np.r_[False, w[1:] != w[:-1]])
            shared = np.minimum.reduceat(record[rows], start) != np.maximum.reduceat(record[rows], start)
            fresh = shared & ((np.minimum.reduceat(last[rows], start) != np.maximum.reduceat(last[rows], start)) | (last[rows[start]] < 0))
            sel = shared[of]
            now[rows[sel]] = of[sel]
            low[rows[sel]] = np.where(low[rows[sel]] < 0, x, low[rows[sel]])
            high[rows[sel]] = x
            sel = fresh[of]
            if sel.any():
                classes.append((rows[sel], of[sel]))
        last = now
    return low, high, classes


def _group(reach: int, half: int, least: int = 20_000):
    """Rows sorted by anchor (doc, record, anchor, pos, before, after) to spans (doc, start, end) and members of classes (doc, record, c1, c2, size).

    A class is named by a digest of its records, so equal classes of several anchors are one.
    """

    def made(t: pa.Table) -> Iterator[pa.RecordBatch]:
        doc, record, anchor, pos = t.column(0).combine_chunks(), *(t.column(i).to_numpy() for i in (1, 2, 3))
        low, high, classes = _windows(anchor.view(np.uint64), record, t.column(4).to_pylist(), t.column(5).to_pylist(), reach)
        at = np.flatnonzero(low >= 0)
        none = lambda n, kind: pa.nulls(n, kind)
        yield pa.RecordBatch.from_arrays([doc.take(pa.array(at)), pa.array((pos[at] - high[at]).astype(np.int32)), pa.array((pos[at] + half + reach - low[at]).astype(np.int32)), *(none(len(at), pa.int64()) for _ in range(4))], ["doc", "start", "end", "record", "c1", "c2", "size"])
        for rows, of in classes:
            # one row for each record of a class
            order = np.lexsort((record[rows], of))
            rows, of = rows[order], of[order]
            once = np.r_[True, (of[1:] != of[:-1]) | (record[rows][1:] != record[rows][:-1])]
            rows, of = rows[once], of[once]
            start = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            size = np.diff(np.r_[start, len(of)])
            c1, c2 = (np.repeat(np.add.reduceat(mix(record[rows].view(np.uint64) + np.uint64(k)), start), size).view(np.int64) for k in (1, 2))
            yield pa.RecordBatch.from_arrays([doc.take(pa.array(rows)), none(len(rows), pa.int32()), none(len(rows), pa.int32()), pa.array(record[rows]), pa.array(c1), pa.array(c2), pa.array(np.repeat(size, size))], ["doc", "start", "end", "record", "c1", "c2", "size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= least:
                t = pa.Table.from_batches(held)
                anchor = t.column(2).to_numpy()
                whole = int(np.searchsorted(-(anchor[::-1] == anchor[-1]).astype(np.int8), 0))  # rows of the last anchor
                if whole < len(anchor):
                    yield from made(t.slice(0, len(anchor) - whole))
                held, size = t.slice(len(anchor) - whole).to_batches(), whole
        if size:
            yield from made(pa.Table.from_batches(held))

    return run


def _classes(texts: DataFrame) -> DataFrame:
    """Ids of equal texts, (doc, rep), where there are two at least; rep is the smallest id."""
    digests = durable(texts.select("doc", F.unhex(F.md5("text")).alias("digest")).distinct(), "digests")
    reps = digests.groupBy("digest").agg(F.min("doc").alias("rep"), F.count("*").alias("n")).where("n > 1")
    return durable(digests.join(reps, "digest").select("doc", "rep"), "classes")


def _digest() -> list:
    """Aggregates that name a class of distinct records."""
    mixed = lambda k: F.sum(F.shiftright(F.xxhash64(F.lit(k), "record"), 24))
    return [mixed(1).alias("c1"), mixed(2).alias("c2"), F.count("*").alias("size")]


def shared(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, load: float = 0.25, range_: int = RANGE, hot: int = HOT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Spans of different texts that stand elsewhere too, members of the classes that share one, and the classes of equal texts.

    Spans: doc (the smallest id of its text), start, end. Members: doc, record, c1, c2, size: all records of a class have one window of length characters in common.
    Null and short texts have no spans. A key given twice with different texts counts with both. load: entries a slot of the sketches;
    hot: occurrences from which an anchor is grouped by joins, over all tasks.
    """
    half = length // 2
    reach = length - half
    texts = df.select(F.col(key).alias("doc"), F.col(text).alias("text")).where(F.col("doc").isNotNull() & (F.char_length("text") >= length))
    ship(df.sparkSession)
    classes = _classes(texts)
    # a record is a text of a document; equal texts are one class already and take part once
    own = texts.join(classes.where("doc <> rep").select("doc"), "doc", "left_anti").withColumn("rid", F.xxhash64("doc", "text"))
    size = texts.agg(F.sum(F.char_length("text"))).first()[0] or 0
    bits = max(3, int(np.ceil(np.log2(max(2 * size / (half + 1) / range_, 1)))))
    tasks = min(1 << bits, 20_000)
    # by counted characters, so that a task gets some megabytes at every size
    joined = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-size // JOINED), 100_000))
    sent = own.select("rid", "text").mapInArrow(_send(bits, length), "part int, hashes binary, rids binary, pos binary")
    again = durable(sent.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(_repeated(load), "rid bigint, anchor bigint, pos int, n bigint"), "anchors")

    per_record = again.repartition(joined, "rid").groupBy("rid").agg(F.collect_list(F.struct("anchor", "pos", "n")).alias("at"))
    each = own.repartition(joined, "rid").join(per_record, "rid").select("doc", F.col("rid").alias("record"), "text", F.explode("at").alias("at"))
    narrow = F.col("at.anchor").bitwiseAND(F.lit(1)) == 0
    at = F.col("at.pos")
    before = F.reverse(F.substring("text", F.greatest(at - reach + 1, F.lit(1)), F.least(at, F.lit(reach))))
    after = F.substring("text", at + half + 1, F.lit(reach))
    found = durable(each.select("doc", "record", "at.anchor", "at.pos", "at.n", F.when(narrow, before).alias("before"), F.when(narrow, after).alias("after")), "found")
    discard(again)

    kind = texts.schema["doc"].dataType.simpleString()
    schema = f"doc {kind}, start int, end int, record bigint, c1 bigint, c2 bigint, size bigint"
    cold = found.where(f"before IS NOT NULL AND n <= {hot}").select("doc", "record", "anchor", "pos", "before", "after")
    grouped = cold.repartition(joined, "anchor").sortWithinPartitions("anchor").mapInArrow(_group(reach, half), schema)
    # whole windows, and every window of hot anchors, as rows
    whole = found.where("before IS NULL").select("doc", "record", "pos", F.col("anchor").alias("w"), F.col("pos").alias("start"))
    windows = found.where(f"before IS NOT NULL AND n > {hot}").withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(reach)))).where(f"char_length(before) >= x AND char_length(after) >= {reach} - x")
    windows = windows.select("doc", "record", "pos", F.xxhash64("anchor", "x", F.substring("before", F.lit(1), F.col("x")), F.substring("after", F.lit(1), F.lit(reach) - F.col("x"))).alias("w"), (F.col("pos") - F.col("x")).alias("start"))
    rows = whole.unionByName(windows)
    several = rows.select("w", "record").distinct().groupBy("w").agg(*_digest()).where("size > 1")
    rows = durable(rows.join(several, "w"), "windows")
    spans_ = rows.select("doc", "start", (F.col("start") + length).alias("end"))
    members = rows.select("doc", "record", "c1", "c2", "size").distinct()
    grouped = durable(grouped, "grouped")
    spans_ = spans_.unionByName(grouped.where("start IS NOT NULL").select("doc", "start", "end"))
    members = members.unionByName(grouped.where("start IS NULL").select("doc", "record", "c1", "c2", "size")).dropDuplicates(["c1", "c2", "size", "record"])
    return spans_, members, classes


def expand(members: DataFrame, classes: DataFrame, a: str = "doc_a", b: str = "doc_b") -> DataFrame:
    """All pairs of ids, a < b and distinct, that share a window, from members of classes and the classes (doc, rep) of equal texts.

    A large class is cut into blocks by the record, and the pairs of two blocks are made together.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    key = ["c1", "c2", "size", "block"]
    left = members.select("c1", "c2", "size", F.pmod(F.xxhash64("record"), blocks).cast("int").alias("block"), F.col("doc").alias("x"))
    right = members.select("c1", "c2", "size", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.col("doc").alias("y"))
    pairs = left.join(right, key).where("x < y").select("x", "y").distinct()
    one = classes.select(F.col("rep").alias("ra"), F.col("doc").alias("da"))
    two = classes.select(F.col("rep").alias("rb"), F.col("doc").alias("db"))
    across = pairs.join(one, F.col("x") == F.col("ra"), "left").join(two, F.col("y") == F.col("rb"), "left").select(F.coalesce("da", "x").alias("x"), F.coalesce("db", "y").alias("y"))
    within = one.join(two, F.col("ra") == F.col("rb")).where("da < db").select(F.col("da").alias("x"), F.col("db").alias("y"))
    return across.unionByName(within).select(F.least("x", "y").alias(a), F.greatest("x", "y").alias(b)).distinct()


def shared_pairs(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, **sizes) -> DataFrame:
    """Pairs doc_a < doc_b whose texts have a common substring of at least length code points."""
    _, members, classes = shared(df, key, text, length, **sizes)
    return expand(members, classes)


def shared_extent(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, **sizes) -> DataFrame:
    """Per record: doc_id, n_chars, shared_chars (characters inside spans that stand elsewhere too) and shared_part (0 to 1).

    Null and empty texts have 0 of 0 characters and part 0. Rows grow with the anchors, however many records share them.
    """
    spans_, _, classes = shared(df, key, text, length, **sizes)
    spans_ = spans_.groupBy("doc", "start").agg(F.max("end").alias("end"))
    w = W.partitionBy("doc").orderBy("start")
    covered = spans_.withColumn("reach", F.coalesce(F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).groupBy("doc").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "reach"))).alias("covered"))
    whole = classes.select("doc", F.lit(True).alias("copied")).distinct()
    d = df.select(F.col(key).alias("doc"), F.coalesce(F.char_length(text), F.lit(0)).cast("bigint").alias("n_chars"))
    out = d.join(covered, "doc", "left").join(whole, "doc", "left")
    n = F.when(F.col("copied"), F.col("n_chars")).otherwise(F.coalesce("covered", F.lit(0))).cast("bigint")
    return out.select(F.col("doc").alias(key), "n_chars", n.alias("shared_chars"), F.when(F.col("n_chars") > 0, n / F.col("n_chars")).otherwise(0.0).alias("shared_part"))
