"""Walks down trees of paths, a group's tree in one task; the paths are never listed.

A tree comes as rows of a group, one for each hop and target, with the codes of the members that reach them (codes in the order of the members' names).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of members' codes that one round of walks may shuffle.
ROUND_BYTES = 256 << 20


def _places(texts: list[str], salt: str, group: np.ndarray, walk: np.ndarray, n: np.ndarray) -> np.ndarray:
    """From 0 to n - 1, by 32 bits of an MD5 of seed, salt, key and walk; where n is 1 nothing is hashed."""
    at = np.flatnonzero(n > 1)
    out = np.zeros(len(n), np.int64)
    if len(at):
        begun = {g: md5(f"{salt}|{texts[g]}|".encode()) for g in set(group[at].tolist())}
        ends = [str(w).encode() for w in range(int(walk[at].max()) + 1)]
        digests = bytearray()
        for g, w in zip(group[at].tolist(), walk[at].tolist()):
            h = begun[g].copy()
            h.update(ends[w])
            digests += h.digest()[:4]
        out[at] = np.frombuffer(bytes(digests), ">u4").astype(np.int64) % n[at]
    return out


def _changes(*columns: np.ndarray) -> np.ndarray:
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _walk(rows: pa.Table, seed: int, summed: bool) -> tuple[pa.Table, dict[str, np.ndarray]]:
    """The row that each walk ends at, and the walk's numbers. rows: whole groups, in the order of group, hop and target."""
    first = _changes(rows["_group"].to_numpy(), np.array(rows["_key"].combine_chunks().dictionary_encode().indices))
    group = np.cumsum(first) - 1
    members = rows["ms"].combine_chunks()
    lengths, codes = np.diff(members.offsets.to_numpy()), members.flatten().to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(rows)), lengths)
    order = np.argsort((group[row] << 32) | codes, kind="stable")  # rows of a group keep their order
    row, codes = row[order], codes[order]
    of = group[row]
    hop = np.cumsum(first | _changes(np.array(rows["hop"].combine_chunks().dictionary_encode().indices)))
    new1 = _changes(of, codes)
    s1, s2 = np.flatnonzero(new1), np.flatnonzero(new1 | _changes(hop[row]))
    # the places of each group's members, of each member's hops and of each hop's targets
    f1 = np.append(np.searchsorted(of[s1], np.arange(group[-1] + 1)), len(s1))
    f2 = np.append(np.searchsorted(s2, s1), len(s2))
    f3 = np.append(s2, len(row))
    texts = rows["_key"].filter(first).to_pylist()
    k = np.asarray(rows["walks"])[first].astype(np.int64)
    g = np.repeat(np.arange(len(k)), k)
    walk = np.arange(len(g)) - np.repeat(np.cumsum(k) - k, k)
    at, n = g, []
    for salt, f in ((1, f1), (2, f2), (3, f3)):
        n.append(f[at + 1] - f[at])
        at = f[at] + _places(texts, f"{seed}|{salt}", g, walk, n[-1])
    if summed:  # per row how many walks end there and the sum of their estimates, which are whole numbers
        hits = np.bincount(row[at], minlength=len(rows))
        weight = np.zeros(len(rows), np.int64)
        np.add.at(weight, row[at], n[0] * n[1] * n[2])
        there = np.flatnonzero(hits)
        return rows.take(there), {"hits": hits[there], "weight": weight[there]}
    paths = np.bincount(of, minlength=len(k))
    return rows.take(row[at]), {"walk": walk.astype(np.int32), "code": codes[at], "n1": n[0], "n2": n[1], "n3": n[2], "paths": paths[g]}


def _task(names: list[str], seed: int, summed: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ends, numbers = _walk(pa.Table.from_batches(parts), seed, summed)
            out = pa.table({**{c: ends[c] for c in names}, **numbers})
            yield from out.to_batches(max_chunksize=20000)

        for b in batches:
            if not b.num_rows:
                continue
            keys, ids = b.column("_key"), b.column("_group")
            last = (ids[-1], keys[-1])
            same = np.array(ids) == last[0].as_py()
            cut = b.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0  # where the last group begins
            if cut or held and (held[-1].column("_group")[-1], held[-1].column("_key")[-1]) != last:
                if parts := [*held, *([b.slice(0, cut)] if cut else [])]:
                    yield from done(parts)
                held = []
            held.append(b.slice(cut))
        if held:
            yield from done(held)

    return run


def walked(trees: DataFrame, key: list[str], seed: int = 0, summed: bool = False) -> DataFrame:
    """key, hop, target, walk, code, n1, n2, n3, paths of each walk; summed: key, hop, target, hits, weight of the rows that walks end at.

    trees: key, hop ('' for none), target, ms (codes of members), walks (how many the group has). n1 to n3 are the numbers of nodes that each step chose from, paths
    those of the group.
    """
    cols = list(dict.fromkeys([*key, "hop", "target"]))
    near = trees.where("walks > 0").repartition(*key).select(*cols, "ms", "walks", F.xxhash64(*key).alias("_group"), F.concat_ws("|", *(F.col(c).cast("string") for c in key)).alias("_key"))
    near = near.sortWithinPartitions("_group", "_key", "hop", "target")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in near.select(*cols).schema)
    rest = "hits bigint, weight bigint" if summed else "walk int, code bigint, n1 bigint, n2 bigint, n3 bigint, paths bigint"
    return near.mapInArrow(_task(cols, seed, summed), f"{kept}, {rest}")
