"""Problem 6: how often items occur together in a record, and how much more often than chance.

Items get dense codes in the order of their names; a pair is one packed 64-bit code. Each task fills a run of codes, sorts it and
counts equal neighbours; Spark's external sort spills and merges the runs by code, and one pass over the merged order adds up.
Items that no wanted pair can have, by the two bounds n_ab <= min(n_a, n_b), are left out before pairs are made.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from ..work import durable, maybe_broadcast

#: Packed codes that a task holds before it sorts them; 8 bytes each. Members of a record that one row pairs with the rest.
RUN, SLICE = 1 << 21, 1024


@lru_cache(64)
def _triangle(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def _count_runs(batches: Iterator[pa.RecordBatch], slice_: int) -> Iterator[pa.RecordBatch]:
    """Rows of sorted codes and the first of them to be paired, to codes of pairs with their counts."""
    held: list[np.ndarray] = []
    size = 0

    def run() -> pa.RecordBatch:
        code, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], ["pair", "n"])

    for b in batches:
        lists, first = b.column(0), np.asarray(b.column(1))
        flat, offsets = np.asarray(lists.flatten()).astype(np.int64), np.asarray(lists.offsets)
        offsets = offsets - offsets[0]
        for k in range(len(lists)):
            x = flat[offsets[k] : offsets[k + 1]]
            if len(x) <= slice_:
                i, j = _triangle(len(x))
                made = [(x[i] << 32) | x[j]]
            else:
                made = ((x[i] << 32) | x[i + 1 :] for i in range(first[k], min(first[k] + slice_, len(x))))
            for codes in made:
                held.append(codes)
                size += len(codes)
                if size >= RUN:
                    yield run()
                    held, size = [], 0
    if size:
        yield run()


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of their codes, to one row a code; the last code of a batch waits for the next."""
    last: tuple[int, int] | None = None
    for b in batches:
        code, n = np.asarray(b.column(0)), np.asarray(b.column(1))
        if not len(code):
            continue
        if last is not None:
            code, n = np.r_[last[0], code], np.r_[last[1], n]
        start = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        total = np.add.reduceat(n, start)
        code = code[start]
        last = int(code[-1]), int(total[-1])
        yield pa.RecordBatch.from_arrays([pa.array(code[:-1]), pa.array(total[:-1])], ["pair", "n_ab"])
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last[0]], pa.int64()), pa.array([last[1]], pa.int64())], ["pair", "n_ab"])


def together(df: DataFrame, key: str, value: Column, min_count: int = 1, min_lift: float = 0, slice_: int = SLICE) -> DataFrame:
    """Pairs of values that at least min_count keys have both of, at least min_lift times as many as chance would give.

    Columns: item_a < item_b (by code point), n_ab, n_a, n_b, n (keys with a value), lift = n_ab * n / (n_a * n_b), and
    odds_ratio with half a record added to each of the four cells. Null keys and values don't exist; repeated rows count once.
    """
    rows = df.select(F.col(key).alias("id"), value.alias("name")).where("id IS NOT NULL AND name IS NOT NULL")
    hashed = rows.select("id", F.xxhash64("name").alias("v"))
    base = durable(hashed.distinct(), "records", "lz4")
    n = base.select("id").distinct().count()
    counts = base.groupBy("v").agg(F.count("*").alias("n_i")).where((F.col("n_i") >= max(min_count, 1)) & (F.col("n_i") * min_lift <= n))
    names = rows.select(F.xxhash64("name").alias("v"), "name").groupBy("v").agg(F.min("name").alias("name"))
    items = durable(numbered(counts.join(names, "v"), ["name"]), "codes")
    size = items.count()
    if size >= 1 << 31:
        raise ValueError("more than 2**31 items")
    codes = maybe_broadcast(items.select("v", "code"), size, 48)
    records = base.join(codes, "v").groupBy("id").agg(F.array_sort(F.collect_list("code")).alias("codes")).where(F.size("codes") > 1)
    sliced = records.select("codes", F.explode(F.sequence(F.lit(0), F.size("codes") - 1, F.lit(slice_))).alias("first"))
    runs = sliced.mapInArrow(lambda batches: _count_runs(batches, slice_), "pair bigint, n bigint")
    pairs = runs.repartition("pair").sortWithinPartitions("pair").mapInArrow(_add_up, "pair bigint, n_ab bigint").where(F.col("n_ab") >= min_count)
    a, b = (maybe_broadcast(items.select(F.col("code").alias(f"c_{s}"), F.col("name").alias(f"item_{s}"), F.col("n_i").alias(f"n_{s}")), size, 128) for s in "ab")
    pairs = pairs.select(F.shiftright("pair", 32).alias("c_a"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("c_b"), "n_ab")
    out = pairs.join(a, "c_a").join(b, "c_b").drop("c_a", "c_b").withColumn("n", F.lit(n).cast("bigint"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    out = out.where(wide("n_ab") * wide("n") >= F.lit(min_lift).cast("decimal(9,3)") * (wide("n_a") * wide("n_b")).cast("decimal(29,0)"))
    lift = F.col("n_ab") * F.col("n") / (F.col("n_a").cast("double") * F.col("n_b"))
    odds = (F.col("n_ab") + 0.5) * (F.col("n") - F.col("n_a") - F.col("n_b") + F.col("n_ab") + 0.5) / ((F.col("n_a") - F.col("n_ab") + 0.5) * (F.col("n_b") - F.col("n_ab") + 0.5))
    return out.select("item_a", "item_b", "n_ab", "n_a", "n_b", "n", lift.alias("lift"), odds.alias("odds_ratio"))
