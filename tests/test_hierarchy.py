"""Hierarchies (problem 2) and components against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollstone.operators.components import components
from rollstone.operators.hierarchy import Hierarchy, unite
from rollstone.operators.numbering import numbered
from rollstone.work import name_form, visible


def brute(links):
    """name -> (root, hops, path or None)."""
    parent = {}
    nodes = set()
    for n, p in links:
        if n is None:
            continue
        nodes.add(n)
        if p is not None:
            nodes.add(p)
            parent[n] = min(p, parent.get(n, p))
    out = {}
    for n in nodes:
        way, seen = [n], {n}
        while way[-1] in parent and parent[way[-1]] not in seen:
            way.append(parent[way[-1]])
            seen.add(way[-1])
        if way[-1] in parent:
            turn = way[way.index(parent[way[-1]]) :]
            out[n] = (min(turn), -1, None)
        else:
            out[n] = (way[-1], len(way) - 1, way[::-1])
    return out


@pytest.fixture(scope="module")
def links():
    r = random.Random(11)
    made = [(f"n{i}", f"n{r.randrange(i)}") for i in range(1, 120)]
    made += [(f"c{i}", f"c{i - 1}") for i in range(1, 90)]  # a long chain
    made += [("k0", "k1"), ("k1", "k2"), ("k2", "k0"), ("t0", "k1"), ("t1", "t0"), ("self", "self"), ("under", "self")]
    made += [(f"b{i}", f"b{(i + 1) % 40}") for i in range(40)] + [("alone", None), (None, "n1"), ("two", "n5"), ("two", "n3")]
    return made + made[:10]


@pytest.mark.parametrize("parts,united", [(1, 10**6), (7, 10**6), (7, 0), (16, 3), (64, 40)])
def test_roots_paths_and_descendants(spark, links, parts, united):
    df = spark.createDataFrame(links, "name string, parent string").withColumn("id", F.lit("clash"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        h = Hierarchy(df, F.col("name"), F.col("parent"), united)
        want = brute(links)
        assert {r.name: (r.root, r.hops) for r in h.roots().collect()} == {n: v[:2] for n, v in want.items()}
        assert {r.name: r.path for r in h.paths().collect()} == {n: v[2] for n, v in want.items() if v[2]}
        down = {(p, n, len(v[2]) - 1 - i) for n, v in want.items() if v[2] for i, p in enumerate(v[2][:-1])}
        assert {tuple(r) for r in h.descendants().collect()} == down
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_no_links(spark):
    h = Hierarchy(spark.createDataFrame([], "name string, parent string"), F.col("name"), F.col("parent"))
    assert h.roots().count() == 0 and h.paths().count() == 0


def test_unite_gives_offsets_and_leaves_at_foreign_tops():
    last, total, cyclic = unite(np.array([5, 1, 9, 4]), np.array([1, 77, 9, -1]), np.array([2, 3, 1, 0]))
    assert last.tolist()[:2] == [77, 77] and total.tolist()[:2] == [5, 3]
    assert cyclic.tolist() == [False, False, True, False] and last[3] == 4 and total[3] == 0


def test_levels_shrink_and_merge_without_adaptive_plans(spark):
    links = [(f"n{i}", f"n{(i - 1) // 3}") for i in range(1, 3000)] + [("n0", None)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", 64)
    try:
        h = Hierarchy(spark.createDataFrame(links, "name string, parent string").repartition(64), F.col("name"), F.col("parent"), 200)
        want = brute(links)
        assert {r.name: (r.root, r.hops) for r in h.roots().collect()} == {n: v[:2] for n, v in want.items()}
        assert len(h.levels) > 2 and all(b < 0.5 * a for a, b in zip(h.levels, h.levels[1:]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_name_form_and_visibility(spark):
    rows = [(" a \t_b_", True), ("__", None), (None, False), ("a b", None)]
    df = spark.createDataFrame(rows, "name string, skip_in_analysis boolean")
    assert [r[0] for r in df.select(name_form("name")).collect()] == ["a_b", None, None, "a_b"]
    assert visible(df).count() == 3


def test_components(spark):
    r = random.Random(2)
    edges = [(f"x{r.randrange(60)}", f"x{r.randrange(60)}") for _ in range(35)] + [(f"y{i}", f"y{i + 1}") for i in range(70)] + [(None, "x1")]
    label = {n: n for e in edges if None not in e for n in e}
    for _ in range(len(label)):
        for a, b in edges:
            if a is not None:
                label[a] = label[b] = min(label[a], label[b])
    got = components(spark.createDataFrame(edges, "a string, b string").repartition(3))
    assert {r.node: r.component for r in got.collect()} == label
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_numbers_are_dense_and_in_order(spark):
    got = numbered(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(5), ["v"]).collect()
    assert {(r.v, r.code) for r in got} == {(i, i) for i in range(1000)}
