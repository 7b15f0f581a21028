"""Problem 2: parent-child links to whole hierarchies.

Weighted disjoint-set forests, merged over several levels. Each task unites its own links by size, keeping for every node its offset from the top
of its tree, and finds the cycles that close inside it. Tops whose own link lies elsewhere, as far as another node ends at them, make the
links of the next level: leaves never go up, so a level is much smaller than the one before, and takes fewer tasks, until one task holds what is
left. A node's root and hops are its top's, plus the offset, level by level back down. Where ways have so few branches that a level doesn't
shrink, rounds of pointer doubling by joins end it. Paths are put together the same way, each task following the parents by index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..work import discard, durable

#: Links that one task unites; about 200 bytes each.
UNITED = 500_000


class Forest:
    """Disjoint sets of nodes 0 to n - 1, united by size with path compression. Each set is a tree with a top; a node's offset is its weighted distance from it."""

    def __init__(self, n: int):
        self.up, self.size, self.gap, self.of_rep = list(range(n)), [1] * n, [0] * n, [0] * n
        self.top, self.turns = list(range(n)), [False] * n

    def find(self, x: int) -> tuple[int, int]:
        """The set's representative, and x's offset less the representative's."""
        up, gap = self.up, self.gap
        way = []
        while up[x] != x:
            way.append(x)
            x = up[x]
        total = 0
        for y in reversed(way):
            total += gap[y]
            up[y], gap[y] = x, total
        return x, total

    def link(self, x: int, parent: int, weight: int) -> None:
        """Puts x, the top of its set, under a node; if that node is in the set itself, the way turns in a circle."""
        rx, _ = self.find(x)
        rp, dp = self.find(parent)
        if rx == rp:
            self.turns[rx] = True
            return
        moved = self.of_rep[rx] + weight + self.of_rep[rp] + dp
        big, small = (rp, rx) if self.size[rx] <= self.size[rp] else (rx, rp)
        top, turns, size = self.top[rp], self.turns[rx] or self.turns[rp], self.size[rx] + self.size[rp]
        self.of_rep[rx] = moved
        self.up[small], self.gap[small] = big, self.of_rep[small] - self.of_rep[big]
        self.top[big], self.turns[big], self.size[big] = top, turns, size


def unite(ids: np.ndarray, up: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For links id -> up (-1 at a root) of the given weights: the last node reached, the weight up to it, and whether the way ends in a cycle.

    A node that is no id of these links is the last one reached; ids are distinct.
    """
    n = len(ids)
    order = np.argsort(ids)
    at = order[np.minimum(np.searchsorted(ids[order], up), max(n - 1, 0))] if n else order
    inside = (up >= 0) & (ids[at] == up) if n else np.zeros(0, bool)
    forest = Forest(n)
    rows = np.flatnonzero(inside)
    for x, p, w in zip(rows.tolist(), at[rows].tolist(), weight[rows].tolist()):
        forest.link(x, p, w)
    found = [forest.find(x) for x in range(n)]
    rep = np.fromiter((r for r, _ in found), np.int64, n)
    total = np.fromiter((d for _, d in found), np.int64, n) + np.array(forest.of_rep, np.int64)[rep]
    top = np.array(forest.top, np.int64)[rep]
    leaves = up[top] >= 0
    return np.where(leaves, up[top], ids[top]), total + np.where(leaves, weight[top], 0), np.array(forest.turns, bool)[rep]


def _columns(batches: Iterator[pa.RecordBatch], k: int) -> list[np.ndarray]:
    cols: list[list[np.ndarray]] = [[] for _ in range(k)]
    for b in batches:
        for i in range(k):
            cols[i].append(b.column(i).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64))
    return [np.concatenate([np.zeros(0, np.int64), *c]) for c in cols]


def _unite_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, up, weight = _columns(batches, 3)
    last, total, cyclic = unite(ids, up, weight)
    for a in range(0, len(ids), 100_000):
        s = slice(a, a + 100_000)
        yield pa.RecordBatch.from_arrays([pa.array(ids[s]), pa.array(last[s]), pa.array(total[s]), pa.array(cyclic[s])], ["id", "top", "off", "cyclic"])


def _double(links: DataFrame, rounds: int) -> DataFrame:
    """(id, top, off, cyclic) by pointer doubling: links (id, top, off), a root being its own top with off 0."""
    links = durable(links, "links")
    # by the links as given: after some rounds a node of a cycle may point at itself
    roots = durable(links.where("id = top").select(F.col("id").alias("top"), F.lit(True).alias("root")), "roots")
    for _ in range(rounds):
        on = links.select(F.col("id").alias("top"), F.col("top").alias("t"), F.col("off").alias("o"))
        new = durable(links.join(on, "top").select("id", F.col("t").alias("top"), (F.col("off") + F.col("o")).alias("off")), "links")
        moved = links.withColumnRenamed("top", "old").join(new, "id").where("old <> top").limit(1).count()
        discard(links)
        links = new
        if not moved:
            break
    return links.join(roots, "top", "left").select("id", "top", "off", F.col("root").isNull().alias("cyclic"))


def _least_of_cycles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (id, up, node) whose ways all end in cycles, to (id, root_name): the smallest name on the cycle."""
    ids, ups, names = [], [], []
    for b in batches:
        ids += b.column(0).to_pylist()
        ups += b.column(1).to_pylist()
        names += b.column(2).to_pylist()
    index = {x: i for i, x in enumerate(ids)}
    up = [index[u] for u in ups]
    least: list[str | None] = [None] * len(ids)
    for i in range(len(ids)):
        way, seen = [], {}
        while least[i] is None and i not in seen:
            seen[i] = len(way)
            way.append(i)
            i = up[i]
        name = min(names[j] for j in way[seen[i] :]) if least[i] is None else least[i]
        for j in way:
            least[j] = name
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(least, pa.string())], ["id", "root_name"])


class Hierarchy:
    """Nodes of a table of parent-child rows, with their links.

    name, parent: columns of the names; a null doesn't exist. Nodes are the names and parents of all rows. Of several parents of
    a name the smallest counts. Extra columns are ignored; an empty table has no nodes. united: links that one task unites.
    """

    def __init__(self, df: DataFrame, name: Column, parent: Column, united: int = UNITED):
        self.united = max(united, 1)
        rows = df.select(name.alias("node"), parent.alias("parent")).where("node IS NOT NULL")
        both = rows.union(rows.select(F.col("parent").alias("node"), F.lit(None).cast("string")).where("node IS NOT NULL"))
        self.nodes = durable(both.groupBy("node").agg(F.min("parent").alias("parent")).withColumn("id", F.monotonically_increasing_id()), "nodes")
        ups = self.nodes.select(F.col("node").alias("parent"), F.col("id").alias("up"))
        self.links = durable(self.nodes.join(ups, "parent", "left").select("id", "up", "node"), "links")
        #: Links of each level.
        self.levels: list[int] = []
        self.found = self._resolve()

    def _resolve(self) -> DataFrame:
        """(id, root, hops, cyclic) of all nodes."""
        schema = "id bigint, top bigint, off bigint, cyclic boolean"
        rows = self.links.select("id", "up", F.lit(1).cast("bigint").alias("w"))
        n = self.nodes.count()
        reached: list[DataFrame] = []
        while True:
            self.levels.append(n)
            parts = max(1, -(-n // self.united))
            spread = rows.repartition(parts, F.xxhash64(F.lit(len(self.levels)), "id")) if parts > 1 else rows.coalesce(1)
            level = durable(spread.mapInArrow(_unite_task, schema), "united")
            reached.append(level)
            if parts == 1:
                break
            # links of the next level: the tops that ways of others end at; one on a cycle is its own parent
            tops = level.where("NOT cyclic AND top <> id").select("top").distinct().withColumnRenamed("top", "id")
            up = F.when(F.col("cyclic"), F.col("id")).when(F.col("top") != F.col("id"), F.col("top"))
            rows = durable(level.join(tops, "id", "left_semi").select("id", up.alias("up"), F.when(F.col("cyclic"), 0).otherwise(F.col("off")).cast("bigint").alias("w")), "tops")
            before, n = n, rows.count()
            if n > self.united and n > before * 0.8:
                self.levels.append(n)
                reached.append(self._doubled(rows, n))
                break
        out = reached.pop()
        while reached:
            above = out.select(F.col("id").alias("top"), F.col("top").alias("t"), F.col("off").alias("o"), F.col("cyclic").alias("c"))
            out = reached.pop().join(above, "top", "left").select("id", F.coalesce("t", "top").alias("top"), (F.col("off") + F.coalesce("o", F.lit(0))).alias("off"), (F.col("cyclic") | F.coalesce("c", F.lit(False))).alias("cyclic"))
        return durable(out.select("id", F.col("top").alias("root"), F.col("off").alias("hops"), "cyclic"), "found")

    def _doubled(self, rows: DataFrame, n: int) -> DataFrame:
        """The same for links that no task holds, by pointer doubling; a link to itself is a cycle."""
        # -1 stands for the cycles that are known already
        given = rows.select("id", F.when(F.col("up") == F.col("id"), -1).otherwise(F.coalesce("up", "id")).alias("top"), F.col("w").alias("off"))
        given = given.select("id", "top", F.when(F.col("top") == F.col("id"), 0).otherwise(F.col("off")).cast("bigint").alias("off"))
        ends = rows.sparkSession.createDataFrame([(-1, -1, 0)], "id bigint, top bigint, off bigint")
        out = _double(given.union(ends), n.bit_length() + 1).where("id <> -1")
        return out.select("id", "top", "off", (F.col("cyclic") | (F.col("top") == -1)).alias("cyclic"))

    def _cycles(self) -> DataFrame:
        """(id, root name) of the nodes on or below a cycle: the smallest name on the cycle."""
        caught = durable(self.links.join(self.found.where("cyclic").select("id"), "id", "left_semi").select("id", "up", "node"), "caught")
        n = caught.count()
        if n <= self.united:
            return caught.coalesce(1).mapInArrow(_least_of_cycles, "id bigint, root_name string")
        # by doubling with the smallest name so far
        step = caught.select("id", F.col("up").alias("to"), F.col("node").alias("least"))
        for _ in range(n.bit_length()):
            on = step.select(F.col("id").alias("to"), F.col("to").alias("t"), F.col("least").alias("l"))
            new = durable(step.join(on, "to").select("id", F.col("t").alias("to"), F.least("least", "l").alias("least")), "cycles")
            discard(step)
            step = new
        # after n steps or more every way is on its cycle, and once round it
        return step.select("id", "to").join(step.select(F.col("id").alias("to"), "least"), "to").select("id", F.col("least").alias("root_name"))

    def roots(self) -> DataFrame:
        """name, root, hops of every node; hops -1 and as root the smallest name of the cycle where the way up ends in one."""
        name = self.nodes.select(F.col("id").alias("root"), F.col("node").alias("root_name"))
        fine = self.found.where("NOT cyclic").join(name, "root").select("id", "root_name", "hops")
        caught = self._cycles().withColumn("hops", F.lit(-1).cast("bigint"))
        out = fine.unionByName(caught).join(self.nodes.select("id", "node"), "id")
        return out.select(F.col("node").alias("name"), F.col("root_name").alias("root"), F.col("hops").cast("int").alias("hops"))

    def paths(self) -> DataFrame:
        """name, path (names from the root to the node itself) of the nodes that no cycle holds."""
        free = self.links.join(self.found.where("NOT cyclic").select("id"), "id", "left_semi")

        def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, ups, names = [], [], []
            for b in batches:
                ids += b.column(0).to_pylist()
                ups += b.column(1).to_pylist()
                names += b.column(2).to_pylist()
            index = {x: i for i, x in enumerate(ids)}
            parent = [index.get(u, -1) for u in ups]
            rows, size = [], 0
            for i, x in enumerate(ids):
                part, at = [names[i]], i
                while parent[at] >= 0:
                    at = parent[at]
                    part.append(names[at])
                rows.append((x, ups[at], part[::-1]))
                size += len(part)
                if size > 200_000 or i == len(ids) - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.list_(pa.string())))], ["id", "up", "path"])
                    rows, size = [], 0

        parts = durable(free.select("id", "up", "node").mapInArrow(follow, "id bigint, up bigint, path array<string>"), "parts")
        while parts.where("up IS NOT NULL").limit(1).count():
            # the tops' own parts go in front; each round at least doubles how far a part reaches
            needed = parts.where("up IS NOT NULL").select(F.col("up").alias("id")).distinct()
            front = parts.join(needed, "id", "left_semi").select(F.col("id").alias("up"), F.col("up").alias("u"), F.col("path").alias("p"))
            new = durable(parts.join(front, "up", "left").select("id", F.col("u").alias("up"), F.when(F.col("p").isNull(), F.col("path")).otherwise(F.concat("p", "path")).alias("path")), "parts")
            discard(parts)
            parts = new
        return parts.select(F.element_at("path", -1).alias("name"), "path")

    def descendants(self) -> DataFrame:
        """name, descendant, distance: every node below each node (not itself), cycles left out. As many rows as there are steps in all paths."""
        each = self.paths().select(F.col("name").alias("descendant"), F.size("path").alias("n"), F.posexplode("path").alias("pos", "name"))
        return each.where("pos < n - 1").select("name", "descendant", (F.col("n") - 1 - F.col("pos")).alias("distance"))
