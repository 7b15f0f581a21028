"""Growing patterns of concepts where their documents lie: all patterns with one first concept in one task, none of their documents kept.

Concepts have numbers, rare ones first. A class is a first concept with the documents that have it, and of each document only its concepts from there on, so
that frequent concepts, which stand in most documents, come with few others. Entities are bits of a document's own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Documents of classes, and of patterns, that are grown at once.
ROWS = 1 << 16
#: Columns of a class's document, ordered by class, and of a grown pattern.
GIVEN = ("c", "seed", "codes", "scores", "sizes", "bits")
FOUND = "p array<int>, document_count bigint, relevance double, kept boolean, others array<int>"


def _any(bits: np.ndarray) -> np.ndarray:
    return bits[:, 0] != 0 if bits.shape[1] == 1 else bits.any(axis=1)


def _number(bits: np.ndarray) -> np.ndarray:
    n = np.bitwise_count(bits)
    return n[:, 0] if bits.shape[1] == 1 else n.sum(axis=1, dtype=np.int64)


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Where the lists begin and end, and all their values."""
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    offsets = lists.offsets.to_numpy()
    return offsets - offsets[0], lists.flatten().to_numpy()


class _Grown:
    """Patterns of one length: their concepts, whether they are kept, and a row for each document: pattern, document, place of each concept, entities, those of two concepts, score."""

    def __init__(self, p, kept, of, doc, at, seen, twice, score):
        self.p, self.kept, self.of, self.doc, self.at, self.seen, self.twice, self.score = p, kept, of, doc, at, seen, twice, score

    def cut(self, rows: int) -> Iterator[_Grown]:
        """Whole patterns, with so many rows or one pattern more."""
        first = np.searchsorted(self.of, np.arange(len(self.p) + 1))
        a = 0
        while a < len(self.p):
            b = max(a + 1, int(np.searchsorted(first, first[a] + rows, "right")) - 1)
            s = slice(first[a], first[b])
            yield _Grown(self.p[a:b], self.kept[a:b], self.of[s] - a, self.doc[s], self.at[s], self.seen[s], self.twice[s], self.score[s])
            a = b


def _grow(classes: pa.Table, least_docs: int, max_level: int | None) -> Iterator[pa.RecordBatch]:
    """All patterns of two concepts and more that begin with the classes' concepts. classes: whole classes, in their order."""
    first, codes = _lists(classes["codes"])
    codes, scores = codes.astype(np.int64), _lists(classes["scores"])[1]
    sizes, bits = _lists(classes["sizes"])[1], _lists(classes["bits"])[1].astype(np.uint64)
    item = np.repeat(np.arange(len(codes)), sizes)
    mask = np.zeros((len(codes), int(bits.max() // 64) + 1), np.uint64)
    np.bitwise_or.at(mask, (item, (bits // 64).astype(np.int64)), np.uint64(1) << (bits % np.uint64(64)))
    end = first[1:]
    most = _number(np.bitwise_or.reduceat(mask, first[:-1], axis=0))  # no pattern of more concepts is held by the document
    span = int(codes.max()) + 1
    c = classes["c"].to_numpy()
    new = np.append(True, c[1:] != c[:-1])
    start = first[:-1]
    stack = [_Grown(c[new].astype(np.int32)[:, None], classes["seed"].to_numpy()[new], np.cumsum(new) - 1, np.arange(len(c)), start[:, None], mask[start], np.zeros_like(mask[start]), scores[start])]
    while stack:
        x = stack.pop()
        k = x.p.shape[1]
        n = np.where(most[x.doc] > k, end[x.doc] - x.at[:, -1] - 1, 0)
        row = np.repeat(np.arange(len(n)), n)
        if not len(row):
            continue
        place = x.at[row, -1] + 1 + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        key = x.of[row] * span + codes[place]
        order = np.argsort(key)
        key = key[order]
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        count = np.diff(np.append(begin, len(key)))
        enough = count >= least_docs
        if not enough.any():
            continue
        key, count, order = key[begin[enough]], count[enough], order[np.repeat(enough, count)]
        row, place, of = row[order], place[order], np.repeat(np.arange(len(key)), count)
        parent = key // span
        p = np.concatenate([x.p[parent], (key % span).astype(np.int32)[:, None]], axis=1)
        own, before = mask[place], x.seen[row]
        seen, twice = before | own, x.twice[row] | (before & own)
        score, at = x.score[row] + scores[place], np.concatenate([x.at[row], place[:, None]], axis=1)
        docs = lambda which: np.bincount(of[which], minlength=len(p))  # noqa: E731, B023
        entities = _number(seen)
        held = entities > k
        document_count = docs(held)
        relevance = np.bincount(of[held], score[held], len(p))
        kept = x.kept[parent] & (docs(_any(own & ~before) & (_number(before) >= k)) >= least_docs)
        # a pattern that its first concepts don't lead to may come of others: those without one of its concepts
        rest = np.flatnonzero((document_count >= least_docs) & ~kept)
        others = np.zeros((len(p), k + 1), bool)
        if len(rest):
            r = np.flatnonzero(np.isin(of, rest))
            for j in range(k + 1):
                alone = mask[at[r, j]] & seen[r] & ~twice[r]
                comes = _any(alone) & (entities[r] - _number(alone) >= k)
                others[:, j] = np.bincount(of[r[comes]], minlength=len(p)) >= least_docs
            others[kept] = False
        if len(out := np.flatnonzero(kept | others.any(axis=1))):
            lists = lambda values, ends: pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(values, pa.int32()))
            yield pa.record_batch({
                "p": lists(p[out].ravel(), np.arange(1, len(out) + 1) * (k + 1)), "document_count": document_count[out].astype(np.int64), "relevance": relevance[out],
                "kept": kept[out], "others": lists(np.nonzero(others[out])[1], np.cumsum(others[out].sum(axis=1))),
            })
        if max_level and k + 1 >= max_level:
            continue
        on = (most[x.doc[row]] > k + 1) & (place + 1 < end[x.doc[row]])
        on &= (docs(on) >= least_docs)[of]
        if on.any():
            ids, of = np.unique(of[on], return_inverse=True)
            stack += _Grown(p[ids], kept[ids], of, x.doc[row[on]], at[on], seen[on], twice[on], score[on]).cut(ROWS)


def growing(least_docs: int, max_level: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over classes, ordered by class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            c = b.column("c").to_numpy()
            cut = int(np.searchsorted(c, c[-1]))  # where the last class begins
            if held and (cut or held[-1].column("c")[-1].as_py() != c[-1]) and sum(x.num_rows for x in held) + cut >= ROWS:
                yield from _grow(pa.Table.from_batches([*held, b.slice(0, cut)]), least_docs, max_level)
                held = []
                b = b.slice(cut)
            held.append(b)
        if held:
            yield from _grow(pa.Table.from_batches(held), least_docs, max_level)

    return run
