"""Counts of walks in blocks of sources, against all walks, and what they write."""

import random

import pyarrow as pa
import pytest
from pyarrow import parquet

from rollstone.operators import graph, hops
from rollstone.work import durable


def by_listing(links, sources, targets):
    near = {}
    for a, b in links:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out = set()
    for s in sources:
        for t in targets:
            two = [x for x in near.get(s, ()) if x != t and t in near[x]]
            three = [(x, y) for x in near.get(s, ()) if x != t for y in near[x] if y not in (s, t) and t in near[y]]
            n = int(t in near.get(s, ())), len(two), len(three)
            out |= {(s, t, *n)} if s != t and any(n) else set()
    return out


def test_blocks_of_sources(spark, monkeypatch):
    monkeypatch.setattr(graph, "SOURCES", 3)
    r = random.Random(5)
    links = [(r.randrange(30), r.randrange(30)) for _ in range(60)] + [(None, 1), (2, None), (40, 41)]
    links += [(b, a) for a, b in links[:20]] + links[10:20]
    sources, targets = [*range(0, 30, 2), 40, 77, None, 4], [*range(8, 30), 41, 78, None, 9]
    column = lambda c, v: spark.createDataFrame([(x,) for x in v], f"{c} int")
    got = [tuple(x) for x in graph.three_hop_counts(spark.createDataFrame(links, "subject int, object int"), column("source", sources), column("target", targets)).collect()]
    want = by_listing(links, {*sources} - {None}, {*targets} - {None})
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    empty = graph.three_hop_counts(spark.createDataFrame(links, "subject int, object int"), column("source", [77]), column("target", targets))
    assert empty.count() == 0


def test_no_walk_is_written(spark, monkeypatch):
    written = []

    def counted(df, *a):
        out = durable(df, *a)
        written.append(out.count())
        return out

    monkeypatch.setattr(graph, "durable", counted)
    links = [(f"P{p}", f"S{(p * k) % 23}") for p in range(120) for k in range(1, 9)]
    names = lambda c, v: spark.createDataFrame([(x,) for x in v], f"{c} string")
    got = graph.three_hop_counts(spark.createDataFrame(links, "subject string, object string"), names("source", [f"P{p}" for p in range(60)]), names("target", [f"S{k}" for k in range(23)]))
    assert {tuple(x) for x in got.collect()} == by_listing(links, {f"P{p}" for p in range(60)}, {f"S{k}" for k in range(23)})
    assert max(written) <= len(set(links))  # the ends of two links from the sources are several thousands


@pytest.mark.parametrize("kind", ["few ways", "shared neighbours", "many ways"])
def test_runs_of_pieces(kind, tmp_path, monkeypatch):
    """A task holds some links at a time, however many its sources are near to, whichever way it counts."""
    r = random.Random(3)
    n, m, parts, targets = {"few ways": (400, 300, 6, 1), "shared neighbours": (400, 8, 200, 1), "many ways": (60, 300, 3, 1)}[kind]
    ends = [(f"S{x}", x) for x in range(m)]
    links = {(f"P{r.randrange(n)}", f"S{r.randrange(m)}") for _ in range(3000)} | {(f"S{r.randrange(m)}", f"S{r.randrange(m)}") for _ in range(30)}
    sources = [f"P{p}" for p in range(parts)] + ["S3"]
    code = dict(ends)
    both = sorted({(a, b) for x in links for a, b in (x, x[::-1]) if a != b})
    near = sorted({b for a, b in both if a in sources and b not in code})  # parts next to S3
    code |= {b: m + k for k, b in enumerate(near)}
    rows = [(a, code[b], code[a] if a[0] == "S" else -1) for a, b in both if b in code]
    batch = pa.record_batch({"a": [x[0] for x in rows] * 2, "code": pa.array([x[1] for x in rows] * 2, pa.int32()), "own": pa.array([x[2] for x in rows] * 2, pa.int32())})
    monkeypatch.setattr(hops, "PIECE", 200)
    monkeypatch.setattr(hops, "HELD", 600)
    monkeypatch.setattr(hops, "WALKS", 500)
    pieces = list(hops.packing(iter([batch])))
    parquet.write_table(pa.Table.from_batches(pieces), tmp_path / "part-0.parquet")
    held, along = [], []
    add, step = hops._Block._add, hops._Block._along
    monkeypatch.setattr(hops._Block, "_add", lambda self, own, sizes, codes, x: (held.append((len(codes), int(sizes.max()))), add(self, own, sizes, codes, x)))
    monkeypatch.setattr(hops._Block, "_along", lambda self, *a: (along.append(1), step(self, *a)))
    first = [(a, code[a] if a[0] == "S" else -1, code[b]) for a, b in both if a in sources]
    first = pa.record_batch({"source": [x[0] for x in first], "own": pa.array([x[1] for x in first], pa.int32()), "code": pa.array([x[2] for x in first], pa.int32())})
    got = [tuple(x.values()) for b in hops.counting(f"file://{tmp_path}", len(code), m, m)(iter([first])) for x in b.to_pylist()]
    assert len(got) == len(set(got)) and {(s, f"S{t}", *k) for s, t, *k in got} == by_listing(links, sources, [e[0] for e in ends])
    assert len(held) > 1 and all(a < 600 + 200 + b for a, b in held)
    assert along if kind == "many ways" else kind != "few ways" or not along


def test_links_are_written_once(spark, monkeypatch):
    """However many blocks there are, and however many of them a node is near to."""
    packed = []

    def kept(df, name, *a):
        out = durable(df, name, *a)
        if name == "packed":
            packed.append(sum(len(x.codes) // 4 for x in out.collect()))
        return out

    monkeypatch.setattr(graph, "durable", kept)
    monkeypatch.setattr(graph, "CELLS", 40)
    r = random.Random(4)
    links = {(f"P{r.randrange(200)}", f"S{r.randrange(20)}") for _ in range(1500)}
    names = lambda c, v: spark.createDataFrame([(x,) for x in v], f"{c} string")
    sources, targets = [f"P{p}" for p in range(0, 200, 5)], [f"S{k}" for k in range(25)]
    got = graph.three_hop_counts(spark.createDataFrame(sorted(links), "subject string, object string"), names("source", sources), names("target", targets))
    assert {tuple(x) for x in got.collect()} == by_listing(links, sources, targets)
    assert packed == [len(links)]  # the blocks of two sources are near to nearly all nodes
