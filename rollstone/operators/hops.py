"""Counts of walks of two and three links from blocks of sources; the walks and their middle nodes are never listed outside a task.

The links lie in the shared folder once, packed by node. The task of a block reads them piece by piece, and holds the counts of its sources and one run of pieces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs, parquet

#: Links of a packed piece, of the pieces that a task takes together, and walks that it takes at once.
PIECE, HELD, WALKS = 1 << 20, 1 << 22, 1 << 20
#: Nodes of a piece: the number of each as a target (-1 for none), of its links, and the codes of its neighbours, as 32-bit numbers.
PACKED = "own binary, sizes binary, codes binary"
COUNTS = "t int, one bigint, two bigint, three bigint"


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the pieces that begin there and are so long."""
    return np.repeat(starts - _starts(sizes), sizes) + np.arange(int(sizes.sum()))


def packing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over links (a, code, own) of whole nodes a: rows of PACKED. A link that is given twice counts once."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held)
    node = np.asarray(t["a"].combine_chunks().dictionary_encode().indices).astype(np.int64)
    own = np.full(int(node.max()) + 1, -1, np.int32)
    own[node] = t["own"].to_numpy()
    link = np.unique((node << 32) | t["code"].to_numpy())
    codes, sizes = link.astype(np.int32), np.bincount(link >> 32).astype(np.int32)
    first = _starts(sizes)
    begin = np.flatnonzero(np.append(True, np.diff(first // PIECE) > 0))
    for i, j in zip(begin.tolist(), [*begin[1:].tolist(), len(sizes)]):
        part = codes[first[i] : first[j] if j < len(sizes) else len(codes)]
        yield pa.record_batch({"own": [own[i:j].tobytes()], "sizes": [sizes[i:j].tobytes()], "codes": [part.tobytes()]})


def aims(n_targets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over rows of PACKED: the numbers of targets in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(n_targets, bool)
        for b in batches:
            for own, _, codes in _pieces(b):
                seen[codes[codes < n_targets]] = True
                seen[own[own >= 0]] = True
        yield pa.record_batch({"t": pa.array(np.flatnonzero(seen), pa.int32())})

    return run


def _pieces(b: pa.RecordBatch) -> Iterator[list[np.ndarray]]:
    for row in zip(*(b.column(c) for c in ("own", "sizes", "codes"))):
        yield [np.frombuffer(x.as_buffer(), np.int32) for x in row]


def _stored(uri: str) -> Iterator[list[np.ndarray]]:
    files, folder = fs.FileSystem.from_uri(uri)
    for f in files.get_file_info(fs.FileSelector(folder)):
        if f.is_file and f.base_name.endswith(".parquet"):
            with files.open_input_file(f.path) as file:
                for b in parquet.ParquetFile(file).iter_batches(batch_size=1):
                    yield from _pieces(b)


class _Block:
    """Walks of the sources 0 to n - 1. s, x: their links, by source; nodes next to them have numbers of the block."""

    def __init__(self, s: np.ndarray, codes: np.ndarray, n_codes: int, n_targets: int, width: int):
        near, self.x = np.unique(codes, return_inverse=True)
        self.s, self.codes, self.n_targets = s, codes, n_targets
        self.degrees = np.bincount(s)
        self.begin = np.append(0, np.cumsum(self.degrees))
        self.by_x = np.argsort(self.x, kind="stable")
        self.begin_x = np.append(0, np.cumsum(np.bincount(self.x)))
        self.place = np.full(n_codes, -1, np.int32)
        self.place[near] = np.arange(len(near))
        self.near_degrees = np.zeros(len(near), np.int64)
        # targets get columns as they are met, and pages of memory with them
        self.column, self.target = np.full(n_targets, -1, np.int32), np.zeros(width, np.int32)
        self.n_columns = 0
        self.two, self.three = np.zeros((len(self.degrees), width), np.int32), np.zeros((len(self.degrees), width), np.int64)

    def read(self, pieces: Iterator[list[np.ndarray]]) -> None:
        held, n = [], 0
        for own, sizes, codes in pieces:
            x = self.place[codes]
            used = np.logical_or.reduceat(x >= 0, _starts(sizes))
            if not used.any():
                continue
            kept = np.repeat(used, sizes)
            held.append((own[used], sizes[used], codes[kept], x[kept]))
            n += len(held[-1][2])
            if n >= HELD:
                self._add(*map(np.concatenate, zip(*held)))
                held, n = [], 0
        if held:
            self._add(*map(np.concatenate, zip(*held)))

    def _columns(self, targets: np.ndarray) -> slice | np.ndarray:
        new = targets[self.column[targets] < 0]
        self.column[new] = np.arange(self.n_columns, self.n_columns + len(new))
        self.target[self.n_columns : self.n_columns + len(new)] = new
        self.n_columns += len(new)
        at = self.column[targets]
        return slice(int(at[0]), int(at[-1]) + 1) if len(at) and (np.diff(at) == 1).all() else at

    def _add(self, own: np.ndarray, sizes: np.ndarray, codes: np.ndarray, x: np.ndarray) -> None:
        """Walks over these nodes, each with all its links."""
        row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        near = np.flatnonzero(x >= 0)
        x = x[near]
        order = np.argsort(x)
        y, n_y = row[near[order]], np.bincount(x, minlength=len(self.near_degrees))
        y_first = _starts(n_y)
        self.near_degrees += n_y
        aim = codes < self.n_targets
        t, n_t = codes[aim], np.bincount(row[aim], minlength=len(sizes))
        t_first = _starts(n_t)
        aimed = own >= 0
        seen = np.zeros(self.n_targets, bool)
        seen[t] = seen[own[aimed]] = True
        here = np.flatnonzero(seen)
        at, local = self._columns(here), np.zeros(self.n_targets + 1, np.int32)
        local[here] = np.arange(len(here))
        t, own, twos = local[t], local[own], aimed.any()
        walks = np.bincount(x[order], weights=n_t[y], minlength=len(n_y))

        def counts(y: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
            reached = own[y[aimed[y]]] if twos else None
            return np.bincount(t[_spread(t_first[y], n_t[y])], minlength=len(here)), np.bincount(reached, minlength=len(here)) if twos else None

        by_walk, by_near, n_paths = walks[self.x].sum(), walks.sum() + len(self.x) * len(here), n_y[self.x].sum()
        by_node = n_paths + len(self.degrees) * len(t) / 4
        if by_node < min(by_walk, by_near):  # many ways lead to a node: they are counted first, and added up along its links
            self._along(y, y_first, n_y, row[aim], t, at, len(sizes))
            if twos:
                for i, ys in ((i, y[_spread(y_first[xs], n_y[xs])]) for i, xs in enumerate(np.split(self.x, self.begin[1:-1]))):
                    self.two[i, at] += np.bincount(own[ys[aimed[ys]]], minlength=len(here))
        elif by_walk <= by_near:
            for i in range(len(self.degrees)):
                xs = self.x[self.begin[i] : self.begin[i + 1]]
                for part in np.split(xs, np.flatnonzero(np.diff(np.cumsum(walks[xs]) // WALKS)) + 1):
                    three, two = counts(y[_spread(y_first[part], n_y[part])])
                    self.three[i, at] += three
                    if twos:
                        self.two[i, at] += two
        else:  # sources share their neighbours: each neighbour's walks are counted once and added for its sources
            for k in np.flatnonzero(n_y).tolist():
                three, two = counts(y[y_first[k] : y_first[k] + n_y[k]])
                rows = self.s[self.by_x[self.begin_x[k] : self.begin_x[k + 1]]]
                cells = (rows, at) if isinstance(at, slice) else np.ix_(rows, at)
                self.three[cells] += three
                if twos:
                    self.two[cells] += two

    def _along(self, y: np.ndarray, y_first: np.ndarray, n_y: np.ndarray, row: np.ndarray, t: np.ndarray, at: slice | np.ndarray, n_rows: int) -> None:
        """Walks of three links by the number of ways to each node, for as many sources at once as WALKS holds."""
        order = np.argsort(t, kind="stable")
        row, first = row[order], np.flatnonzero(np.append(True, np.diff(t[order]) > 0))
        size = max(1, WALKS // max(1, n_rows, len(first)))
        for i in range(0, len(self.degrees), size):
            group = range(i, min(i + size, len(self.degrees)))
            ways, sums = np.empty((n_rows, len(group)), np.int64), np.empty((len(first), len(group)), np.int64)
            for k, g in enumerate(group):
                xs = self.x[self.begin[g] : self.begin[g + 1]]
                ways[:, k] = np.bincount(y[_spread(y_first[xs], n_y[xs])], minlength=n_rows)
            # whole targets, some WALKS cells at a time
            cut = np.append(np.flatnonzero(np.append(True, np.diff(first // max(1, WALKS // len(group))) > 0)), len(first))
            for p, q in zip(cut[:-1].tolist(), cut[1:].tolist()):
                begin, end = first[p], first[q] if q < len(first) else len(row)
                sums[p:q] = np.add.reduceat(ways[row[begin:end]], first[p:q] - begin, axis=0)
            cells = self.three[i : i + len(group)]
            reached = t[order[first]]
            cells[:, np.arange(at.start, at.stop)[reached] if isinstance(at, slice) else at[reached]] += sums.T

    def found(self, i: int, own: int) -> tuple[np.ndarray, ...]:
        """t, one, two, three of a source; own: its number as a target. All walks were added: those that pass through an end are taken away."""
        links = slice(self.begin[i], self.begin[i + 1])
        linked = np.flatnonzero(self.codes[links] < self.n_targets) + self.begin[i]
        one, two, three = np.zeros(self.n_columns, np.int64), self.two[i, : self.n_columns].astype(np.int64), self.three[i, : self.n_columns]
        at = self.column[self.codes[linked]]
        one[at] = 1
        # the second node may not be the target nor the third the source; one walk does both
        three[at] -= self.degrees[i] + self.near_degrees[self.x[linked]] - 1
        at = np.flatnonzero(((one + two + three) > 0) & (self.target[: self.n_columns] != own))
        return self.target[at], one[at], two[at], three[at]


def counting(uri: str, n_codes: int, n_targets: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over the links (source, own, code) of a block's sources: source and COUNTS. width: how many targets have links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        first = pa.Table.from_batches(held)
        source = first["source"].combine_chunks().dictionary_encode()
        s, names = np.asarray(source.indices).astype(np.int64), source.dictionary
        order = np.argsort(s, kind="stable")
        own = np.zeros(len(names), np.int64)
        own[s] = first["own"].to_numpy()
        block = _Block(s[order], first["code"].to_numpy()[order], n_codes, n_targets, width)
        block.read(_stored(uri))
        out: list[tuple[np.ndarray, ...]] = []
        n = 0
        for i in range(len(names)):
            rows = block.found(i, int(own[i]))
            out.append((np.full(len(rows[0]), i), *rows))
            n += len(rows[0])
            if n >= 20000 or i == len(names) - 1:
                i, t, one, two, three = map(np.concatenate, zip(*out))
                if n:
                    yield pa.record_batch({"source": names.take(pa.array(i)), "t": pa.array(t, pa.int32()), "one": one, "two": two, "three": three})
                out, n = [], 0

    return run
