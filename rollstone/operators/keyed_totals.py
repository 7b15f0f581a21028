"""Problem 3: results per key without slow tasks where a few keys hold most rows.

Each input split encodes its keys by a dictionary of its own and adds into dense arrays (numpy bincount). The arrays leave the
split cut into blocks by the keys' hash, one number per key and measure, and the blocks are summed by a distributed reduction.
A split sends a key at most once per fill of its dictionary, so a key with a third of all rows costs no task more than any other.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..work import ship

#: Keys that a task's dictionary holds before it is sent on; blocks that the arrays are cut into.
KEYS, BLOCKS = 400_000, 512


class Accumulator:
    """Dense arrays of sums by key."""

    def __init__(self, kinds: list[type]):
        self.kinds, self.codes = kinds, {}
        self.sums = [np.zeros(1024, k) for k in kinds]

    def add(self, keys: pa.Array, values: list[np.ndarray]) -> None:
        """Adds rows; keys: strings without null, values: an array for each measure."""
        local = keys.dictionary_encode()
        codes = self.codes
        known = np.fromiter((codes.setdefault(k, len(codes)) for k in local.dictionary.to_pylist()), np.int64, len(local.dictionary))
        at = known[local.indices.to_numpy()] if len(local) else known[:0]
        need = len(codes)
        for i, v in enumerate(values):
            if len(self.sums[i]) < need:
                self.sums[i] = np.concatenate([self.sums[i], np.zeros(max(need, len(self.sums[i])), self.kinds[i])])
            if self.kinds[i] is np.float64:
                self.sums[i][:need] += np.bincount(at, v, need)
            else:  # bincount's weights are doubles; integers stay exact this way
                np.add.at(self.sums[i], at, v)

    def result(self) -> tuple[list[str], list[np.ndarray]]:
        return list(self.codes), [s[: len(self.codes)] for s in self.sums]


def dense_sums(df: DataFrame, key: Column, measures: dict[str, Column], key_name: str = "key") -> DataFrame:
    """One row per key that isn't null: the key and the sums of the measures (bigint or double; nulls add nothing).

    Measures are named as in the result, whatever columns df has. An empty table has no row.
    """
    ship(df.sparkSession)
    rows = df.select(key.cast("string").alias("key"), *(c.alias(n) for n, c in measures.items())).where("key IS NOT NULL")
    names = list(measures)
    kinds = [np.float64 if rows.schema[n].dataType.typeName() in ("double", "float") else np.int64 for n in names]
    types = ["double" if k is np.float64 else "bigint" for k in kinds]
    rows = rows.select("key", *(F.coalesce(F.col(f"`{n}`"), F.lit(0)).cast(t).alias(n) for n, t in zip(names, types)))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = Accumulator(kinds)
        for b in batches:
            acc.add(b.column(0), [b.column(1 + i).to_numpy(zero_copy_only=False) for i in range(len(kinds))])
            if len(acc.codes) >= KEYS:
                yield blocks(acc)
                acc = Accumulator(kinds)
        if acc.codes:
            yield blocks(acc)

    def blocks(acc: Accumulator) -> pa.RecordBatch:
        keys, sums = acc.result()
        block = np.fromiter((zlib.crc32(k.encode()) % BLOCKS for k in keys), np.int64, len(keys))
        order = np.argsort(block, kind="stable")
        cut = np.flatnonzero(np.diff(block[order], prepend=-1))
        offsets = pa.array(np.append(cut, len(keys)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(keys, pa.string()).take(pa.array(order))), *(pa.ListArray.from_arrays(offsets, pa.array(s[order])) for s in sums)]
        return pa.RecordBatch.from_arrays([pa.array(block[order][cut].astype(np.int32)), *lists], ["block", "keys", *names])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Accumulator] = {}
        for b in batches:
            for i, block in enumerate(b.column(0).to_pylist()):
                held.setdefault(block, Accumulator(kinds)).add(b.column(1)[i].values, [b.column(2 + k)[i].values.to_numpy() for k in range(len(kinds))])
        for acc in held.values():
            keys, sums = acc.result()
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *map(pa.array, sums)], [key_name, *names])

    sent = rows.mapInArrow(split, "block int, keys array<string>, " + ", ".join(f"`{n}` array<{t}>" for n, t in zip(names, types)))
    return sent.repartition("block").mapInArrow(reduce, f"`{key_name}` string, " + ", ".join(f"`{n}` {t}" for n, t in zip(names, types)))


def totals_per_key(df: DataFrame, key: Column, distinct: dict[str, Column] | None = None, sums: dict[str, Column] | None = None, key_name: str = "key") -> DataFrame:
    """Per key: rows, the number of distinct values (nulls don't count) of some columns and the sums of others.

    Distinct pairs of key and value are made by a shuffle on both, which no heavy key can bend, and counted like rows.
    """
    distinct, sums = distinct or {}, sums or {}
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    none = F.lit(0.0)
    every = ["rows", *distinct, *sums]
    kept = df.select(key.cast("string").alias("_k"), *(c.alias(f"_d{i}") for i, c in enumerate(distinct.values())), *(c.alias(f"_s{i}") for i, c in enumerate(sums.values()))).where("_k IS NOT NULL")
    kinds = {n: kept.schema[f"_s{i}"].dataType.typeName() for i, n in enumerate(sums)}
    zeros = {"rows": zero} | dict.fromkeys(distinct, zero) | {n: none if kinds[n] in ("double", "float") else zero for n in sums}
    parts = [kept.select("_k", *(c.alias(n) for n, c in (zeros | {"rows": one} | {n: F.coalesce(F.col(f"_s{i}"), zeros[n]) for i, n in enumerate(sums)}).items()))]
    for i, n in enumerate(distinct):
        pairs = kept.select("_k", F.xxhash64(f"_d{i}").alias("v"), f"_d{i}").where(F.col(f"_d{i}").isNotNull()).select("_k", "v").distinct()
        parts.append(pairs.select("_k", *(c.alias(m) for m, c in (zeros | {n: one}).items())))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return dense_sums(whole, F.col("_k"), {n: F.col(f"`{n}`") for n in every}, key_name)
