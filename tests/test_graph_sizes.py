"""What the graph queries shuffle: paths come out of the last join, walks are numbered where their group lies."""

import re
import time

import pytest
from pyspark.sql import functions as F

from rollstone.operators import graph
from rollstone.work import durable, likely


@pytest.fixture
def shuffled_joins(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def exchanges(df):
    """The columns of each shuffle in the plan."""
    return [set(re.findall(r"(\w+)#\d+", x)) for x in re.findall(r"hashpartitioning\(([^)]*)\)", df._jdf.queryExecution().executedPlan().toString())]


def kg(spark):
    frame = lambda data, cols: spark.createDataFrame(data, cols)
    members = frame([("X", f"m{i}") for i in range(6)] + [("Y", f"m{i}") for i in range(4, 9)], "category string, entity string")
    triples = frame([(f"m{i}", f"h{j}") for i in range(9) for j in range(5) if (i + j) % 3] + [(None, "h1"), ("m1", None)], "subject string, object string")
    links = frame([(f"t{i}", f"h{j}") for i in range(4) for j in range(5) if (i * j) % 2 == 0] + [("t1", "m2"), ("m5", "t0"), ("t0", "t0")], "subject string, object string")
    ctx = frame([(d, c, e) for d, es in {1: ("t0", "t1", "m2"), 2: ("t2", "h0"), 3: ("t3", "m5", "t0")}.items() for c in "XY" for e in es], "doc int, category string, entity string")
    return members, triples, links, ctx


def test_paths_are_not_shuffled(spark, shuffled_joins):
    p = graph.paths(*kg(spark))
    assert not [x for x in exchanges(p) if {"doc", "member"} <= x]
    assert p.count() == p.distinct().count() > 20


def test_sketch_keeps_all_keys_and_few_others(spark):
    keys = spark.range(0, 30000, 3).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("k"))
    rows = spark.range(30000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("c"), "id")
    kept = likely(rows, "c", keys, "k")
    assert kept.columns == ["c", "id"] and kept.where("id % 3 = 0").count() == 10000
    assert kept.count() < 10100 and likely(rows, "c", keys.limit(0), "k").count() == 0


def test_a_working_table_leaves_no_shuffle(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before = blocks.getAllFiles().size()
    kept = durable(spark.range(10000).groupBy((F.col("id") % 1000).alias("k")).count(), "freed")
    for _ in range(20):
        if blocks.getAllFiles().size() <= before:
            break
        time.sleep(0.5)
    assert blocks.getAllFiles().size() <= before
    assert kept.count() == 1000


@pytest.mark.parametrize(("rounds", "batch"), [(1, 10000), (3, 3)])
def test_walks_of_unlisted_trees_are_those_of_listed_paths(spark, monkeypatch, rounds, batch):
    monkeypatch.setattr(graph, "ROUND_BYTES", 10**9 if rounds == 1 else 400)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        parts = kg(spark)
        listed, trees = graph.paths(*parts), graph.PathTrees(*parts)
        assert (trees.rounds > 1) == (rounds > 1)
        rows = lambda df: sorted(map(str, df.collect()))
        for key in (("doc", "category"), ("doc", "category", "target")):
            got = trees.walks(20, 3, key)
            assert rows(got.drop("paths")) == rows(graph.random_walks(listed, 20, 3, key))
            counts = {tuple(r)[:-1]: r["count"] for r in listed.groupBy(*key).count().collect()}
            assert {tuple(r)[:-1]: r["paths"] for r in got.select(*key, "paths").distinct().collect()} == counts
        assert rows(trees.collective(parts[3], 30, 3)) == rows(graph.collective_walks(listed, parts[3], 30, 3))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_walks_shuffle_no_names_of_members(spark, shuffled_joins):
    trees = graph.PathTrees(*kg(spark))
    assert all("member" not in x for x in exchanges(trees.trees(0))) and trees.trees(0).schema["ms"].dataType.simpleString() == "array<bigint>"


def test_counts_for_all_concepts_are_those_listed(spark, shuffled_joins):
    members, triples, links, ctx = kg(spark)
    docs = ctx.select("doc", "entity").union(ctx.select("doc", "entity"))  # repeated rows count once
    got = graph.counted(members, triples, links, docs, ["X", "Y"])
    assert not [x for x in exchanges(got) if {"target", "hop"} <= x]  # no pairs of a document's targets and hops
    rows = lambda df: sorted(map(str, df.collect()))
    want = graph.path_counts(graph.paths(members, triples, links, ctx))
    assert rows(got) == rows(want) and want.where("length = 1").count() and want.where("length = 2").count()
    assert rows(graph.relevance(got, docs, members, ["X", "Y"])) == rows(graph.relevance(want, ctx, members))


def test_edges_of_unlisted_trees_are_those_of_listed_paths(spark, shuffled_joins):
    parts = kg(spark)
    got = graph.PathTrees(*parts).edges()
    assert not [x for x in exchanges(got) if {"dst", "src"} <= x or {"doc", "member"} <= x]
    assert sorted(map(str, got.collect())) == sorted(map(str, graph.tree_edges(graph.paths(*parts)).collect()))
