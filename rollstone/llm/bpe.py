"""Problem 7: a whole corpus as token ids of a public byte-level BPE.

Texts are cut into pre-tokens by character classes, a whole batch at once; equal pre-tokens of a batch are encoded once.
A pre-token is encoded by a rank queue: one bucket for each merge rank holds positions of a linked list of parts, a
hierarchical bitmap over the ranks finds the next rank by find-first-set, and stale entries are skipped when met.
A pre-token of n bytes takes O(n) queue operations, so very long ones cost no more a byte than short ones.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..work import local_file, send_file, ship
from .kernel import chunks, classes, running, spans

TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
#: Pre-tokens that a Python worker remembers between batches; when full it starts anew.
MEMORY = 300_000


class RankQueue:
    """Buckets of positions by rank under a bitmap of three levels of 64-bit words."""

    def __init__(self, ranks: int):
        self.low = [0] * (ranks // 64 + 1)
        self.mid = [0] * (len(self.low) // 64 + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        if (bucket := self.buckets.get(rank)) is None:
            self.buckets[rank] = [position]
            a, b = rank >> 6, rank >> 12
            self.low[a] |= 1 << (rank & 63)
            self.mid[b] |= 1 << (a & 63)
            self.top |= 1 << b
        else:
            bucket.append(position)

    def pop(self) -> tuple[int, list[int]] | None:
        """The bucket of the least rank."""
        if not self.top:
            return None
        b = (self.top & -self.top).bit_length() - 1
        word = self.mid[b]
        a = (b << 6) | ((word & -word).bit_length() - 1)
        word = self.low[a]
        rank = (a << 6) | ((word & -word).bit_length() - 1)
        self.low[a] = word = word & (word - 1)
        if not word:
            self.mid[b] &= ~(1 << (a & 63))
            if not self.mid[b]:
                self.top &= ~(1 << b)
        return rank, self.buckets.pop(rank)


class Encoder:
    """Encodes pre-tokens given as UTF-8 bytes. ranks: the id of each token's bytes, in order of the merges."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes = [ranks[bytes([i])] for i in range(256)]
        self.pairs: dict[int, int] = {}
        token = {v: k for k, v in ranks.items()}
        self.queue = RankQueue(max(token) + 1)
        self.ranks, self.token = ranks, token

    def rank(self, left: int, right: int) -> int:
        """The id of the token that the two make, -1 if none."""
        key = left << 32 | right
        if (r := self.pairs.get(key)) is None:
            r = self.pairs[key] = self.ranks.get(self.token[left] + self.token[right], -1)
        return r

    def encode(self, piece: bytes) -> list[int]:
        ids = [self.bytes[b] for b in piece]
        n = len(ids)
        if n < 2:
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue, rank = self.queue, self.rank
        for i in range(n - 1):
            if (r := rank(ids[i], ids[i + 1])) >= 0:
                queue.push(r, i)
        while (least := queue.pop()) is not None:
            r, positions = least
            positions.sort()  # a merge goes from left to right
            for i in positions:
                j = after[i]
                if ids[i] < 0 or j >= n or rank(ids[i], ids[j]) != r:
                    continue  # stale: a part of this pair has been merged since
                ids[i], ids[j] = r, -1
                after[i] = k = after[j]
                if k < n:
                    before[k] = i
                    if (x := rank(r, ids[k])) >= 0:
                        queue.push(x, i)
                if (h := before[i]) >= 0 and (x := rank(ids[h], r)) >= 0:
                    queue.push(x, h)
        return [x for x in ids if x >= 0]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    with open(path, "rb") as f:
        return Encoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


def pretokens(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of the texts put together; the end of one is the start of the next.

    A run of letters, of numbers or of other signs takes one space before it along; of a run of white space the last
    character stands apart when something follows; an apostrophe right at the start of a pre-token takes a short English ending.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[points]
    edge = np.zeros(n + 1, bool)
    edge[offsets[:-1]] = edge[n] = True  # an empty text's offset is that of the next
    border = edge.copy()
    edge[1:n] |= kind[1:] != kind[:-1]
    starts = np.flatnonzero(edge[:n])
    white = kind[starts] == 3
    ends = np.append(starts[1:], n)
    followed = white & ~border[ends]
    keep = np.ones(len(starts), bool)
    # of white space that something follows, the last character is cut off; a space then joins what follows
    last = ends[followed] - 1
    joins = points[last] == 32
    run_after = np.flatnonzero(followed) + 1
    keep[run_after[joins]] = False
    extra = [last]
    # 's 't 're 've 'm 'll 'd: only where the apostrophe is a pre-token's start and letters follow at once
    alone = (points[starts] == 39) & (ends - starts == 1) & keep & ~border[ends]
    for i in np.flatnonzero(alone):
        s = int(starts[i])
        stop = int(ends[i + 1])
        tail = "".join(map(chr, points[s + 1 : min(s + 3, stop)]))
        size = 2 if tail[:2] in ("re", "ve", "ll") else 1 if tail[:1] in ("s", "t", "m", "d") else 0
        if size:
            keep[i + 1] = False
            if s + 1 + size < stop:
                extra.append(np.array([s + 1 + size]))
    return np.unique(np.concatenate([starts[keep], *extra]))


_memory: dict[str, dict[str, np.ndarray]] = {}


def encode_batch(texts: list[str], path: str, count_only: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each part of the texts: the number of ids of each text, and the ids one after the other (none if count_only)."""
    bpe = encoder(path)
    memory = _memory.setdefault(path, {})
    for _, points, offsets in chunks(texts):
        if not len(points):
            yield np.zeros(len(offsets) - 1, np.int64), np.zeros(0, np.int32)
            continue
        start = pretokens(points, offsets)
        end = np.append(start[1:], len(points))
        _, first, which = np.unique(spans(running(points), start, end), return_index=True, return_inverse=True)
        # the hash is a shortcut only: every pre-token is compared with the one encoded in its place
        length = end - start
        twin = first[which]
        shift = np.repeat(start[twin] - start, length)
        if (length != length[twin]).any() or (points[np.arange(len(points)) + shift] != points).any():
            first = which = np.arange(len(start))
        raw = points.tobytes()
        if len(memory) > MEMORY:
            memory.clear()
        found = []
        for a, b in zip((start[first] * 4).tolist(), (end[first] * 4).tolist()):
            word = raw[a:b]
            if (ids := memory.get(word)) is None:
                ids = memory[word] = np.array(bpe.encode(word.decode("utf-32-le", "surrogatepass").encode("utf-8", "replace")), np.int32)
            found.append(ids)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        each = sizes[which]
        sums = np.concatenate(([0], np.cumsum(each)))
        counts = np.diff(sums[np.searchsorted(start, offsets)])
        if count_only:
            yield counts, np.zeros(0, np.int32)
            continue
        flat = np.concatenate(found)
        base = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        yield counts, flat[np.arange(sums[-1]) + np.repeat(base[which] - sums[:-1], each)]


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """One row per row of df: key and ids (array<int>). A null or empty text has the empty list; no row is lost or merged.

    Special tokens are never made: a text that looks like one is ordinary text. No shuffle.
    """
    ship(df.sparkSession)
    name = send_file(df.sparkSession, os.path.join(folder, f"{tokenizer}.tiktoken"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = local_file(name)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            at = 0
            for counts, ids in encode_batch(texts, path):
                offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(counts)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], [key, "ids"])
                at += len(counts)

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def with_token_counts(df: DataFrame, text: str = "text", out: str = "tokens", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """df without its text, with the number of token ids as a column; 0 for null and empty texts."""
    ship(df.sparkSession)
    name = send_file(df.sparkSession, os.path.join(folder, f"{tokenizer}.tiktoken"))
    kept = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = local_file(name)
        for b in batches:
            texts = [t or "" for t in b.column(len(kept)).to_pylist()]
            counts = [np.zeros(0, np.int64), *(c for c, _ in encode_batch(texts, path, True))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(np.concatenate(counts))], [*kept, out])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept)
    return df.select(*kept, text).mapInArrow(run, f"{schema}, `{out}` bigint")
