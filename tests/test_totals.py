"""Totals per key (problem 3) against brute force."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rollstone.operators import keyed_totals
from rollstone.operators.keyed_totals import Accumulator, dense_sums, totals_per_key


def data():
    r = random.Random(1)
    rows = [("hot" if r.random() < 0.4 else f"k{r.randrange(50)}", r.randrange(30), r.choice(["x", "y", None]), r.choice([0.25, 0.5, None])) for _ in range(2000)]
    return rows + [(None, 1, "x", 0.5), ("only nulls", None, None, None)] + rows[:100]


def test_totals_are_those_of_brute_force(spark, monkeypatch):
    rows = data()
    monkeypatch.setattr(keyed_totals, "KEYS", 7)
    df = spark.createDataFrame(rows, "k string, n int, v string, s double").withColumn("rows", F.lit("clash")).withColumn("key", F.lit(0)).repartition(5)
    got = {r.key: (r.rows, r.articles, r["values"], r.score) for r in totals_per_key(df, F.col("k"), {"articles": F.col("n"), "values": F.col("v")}, {"score": F.col("s")}).collect()}
    want = defaultdict(lambda: [0, set(), set(), 0.0])
    for k, n, v, s in rows:
        if k is not None:
            w = want[k]
            w[0] += 1
            w[1] |= {n} - {None}
            w[2] |= {v} - {None}
            w[3] += s or 0
    assert got == {k: (a, len(b), len(c), d) for k, (a, b, c, d) in want.items()}


def test_integers_stay_exact(spark):
    df = spark.createDataFrame([("a", (1 << 53) + 1), ("a", 2), ("b", -1)], "k string, n bigint")
    assert {tuple(r) for r in dense_sums(df, F.col("k"), {"n": F.col("n")}).collect()} == {("a", (1 << 53) + 3), ("b", -1)}


def test_no_rows(spark):
    df = spark.createDataFrame([], "k string, n bigint")
    assert totals_per_key(df, F.col("k"), {"d": F.col("n")}, {"n2": F.col("n")}).count() == 0


def test_accumulator_grows():
    acc = Accumulator([np.int64, np.float64])
    for a in range(0, 5000, 500):
        acc.add(pa.array([str(i) for i in range(a, a + 700)]), [np.ones(700, np.int64), np.full(700, 0.5)])
    keys, (n, s) = acc.result()
    assert len(keys) == 5200 and n.sum() == 7000 and s.sum() == 3500 and dict(zip(keys, n))["600"] == 2
