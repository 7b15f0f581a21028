"""Set joins, co-occurrence and mixtures against brute force."""

import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rollstone.llm import cooccur, mixture, neardup, setjoin
from rollstone.work import name_form


def rows(df):
    return {tuple(r) for r in df.collect()}


@pytest.fixture(scope="module")
def baskets():
    r = random.Random(7)
    hot = [f"hot {k}" for k in range(6)]
    rare = [f"x{k}" for k in range(150)]
    sets = []
    for _ in range(120):
        if sets and r.random() < 0.5:
            s = set(r.choice(sets))
            for _ in range(r.randint(0, 3)):
                s.symmetric_difference_update({r.choice(rare + hot)})
        else:
            s = {h for h in hot if r.random() < 0.8} | set(r.sample(rare, r.randint(0, 25)))
        sets.append(frozenset(s))
    data = [(i, v) for i, s in enumerate(sets) for v in s]
    data += data[:50] + [(3, None), (None, "x1"), (5, " _ "), (6, " hot\t0_")]
    r.shuffle(data)
    return data


def by_id(data):
    out = {}
    for i, v in data:
        v = "_".join(x for x in (v or "").replace("\t", " ").replace("_", " ").split(" ") if x)
        if i is not None and v:
            out.setdefault(i, set()).add(v)
    return out


@pytest.mark.parametrize("limit,least", [(0.75, 5), (0.5, 1), (0.9, 3)])
def test_similar_sets_are_those_of_brute_force(spark, baskets, limit, least):
    df = spark.createDataFrame(baskets, "id int, v string").withColumn("members", F.lit(0)).repartition(3)
    sets, members = setjoin.sets_of(df, "id", name_form("v"), least)
    got = rows(neardup.expand_sets(setjoin.similar_sets(sets, limit), members))
    have = {i: s for i, s in by_id(baskets).items() if len(s) >= least}
    want = {(a, b) for a, b in itertools.combinations(sorted(have), 2) if len(have[a] & have[b]) >= limit * len(have[a] | have[b]) - 1e-9}
    assert want and got == want
    # full sketches, many ranges and signatures in blocks change nothing
    for sizes in ({"load": 10, "range_": 50, "hot": 2}, {"load": 1, "hot": 0}):
        assert rows(neardup.expand_sets(setjoin.similar_sets(sets, limit, **sizes), members)) == want


def test_segments_allow_what_similar_sets_may_differ():
    plan = setjoin.Plan(0.75)
    for r in range(1, 200):
        for s in range(math.ceil(0.75 * r), r + 1):
            m = plan.segments(s)
            q = dict(plan.probes(r))[m]
            assert 2 * q > plan.differ(r, s) and q <= m


def test_no_sets(spark):
    sets, members = setjoin.sets_of(spark.createDataFrame([(1, None)], "id int, v string"), "id", F.col("v"))
    assert neardup.expand_sets(setjoin.similar_sets(sets, 0.5), members).count() == 0


@pytest.mark.parametrize("count,lift", [(8, 3), (1, 0), (2, 1)])
def test_pairs_of_items(spark, baskets, count, lift):
    df = spark.createDataFrame(baskets, "id int, v string").withColumn("n", F.lit(0)).repartition(3)
    have = by_id(baskets)
    n, single = len(have), Counter(v for s in have.values() for v in s)
    both = Counter(p for s in have.values() for p in itertools.combinations(sorted(s), 2))
    want = {(a, b, k, single[a], single[b], n) for (a, b), k in both.items() if k >= count and k * n >= lift * single[a] * single[b]}
    out = cooccur.together(df, "id", name_form("v"), count, lift)
    assert {tuple(r)[:6] for r in out.collect()} == want
    for r in out.limit(5).collect():
        assert r.lift == pytest.approx(r.n_ab * n / (r.n_a * r.n_b))
        assert r.odds_ratio == pytest.approx((r.n_ab + 0.5) * (n - r.n_a - r.n_b + r.n_ab + 0.5) / ((r.n_a - r.n_ab + 0.5) * (r.n_b - r.n_ab + 0.5)))


def test_registered_pairs_have_no_threshold(spark, tmp_path):
    from rollstone.llm import queries

    data = [(1, "a"), (1, "b"), (2, "a"), (2, "c"), (3, "b"), (3, "c"), (4, "b"), (5, "b"), (6, "c"), (7, "c"), (None, "a"), (8, None)]
    spark.createDataFrame(data, "news_analytics int, category string").write.parquet(str(tmp_path / "document_entity_category.parquet"))
    got = {(r.item_a, r.item_b): (r.n_ab, r.n_a, r.n_b, r.n, r.lift) for r in queries.p6_pairs(spark, str(tmp_path)).collect()}
    assert got == {("a", "b"): (1, 2, 4, 7, 0.875), ("a", "c"): (1, 2, 4, 7, 0.875), ("b", "c"): (1, 4, 4, 7, 0.4375)}
    assert queries.p6_found(spark, str(tmp_path)).count() == 0


def test_a_record_with_very_many_items(spark):
    data = [(i, f"v{k:03d}") for i in range(3) for k in range(100)]
    out = cooccur.together(spark.createDataFrame(data, "id int, v string"), "id", F.col("v"), 3, 0, slice_=16)
    assert out.count() == 100 * 99 // 2 and out.agg(F.min("n_ab"), F.max("n_ab")).first() == (3, 3)


def test_no_pairs(spark):
    assert cooccur.together(spark.createDataFrame([], "id int, v string"), "id", F.col("v")).count() == 0


def test_mixture_meets_its_shares(spark):
    r = random.Random(4)
    docs = [(i, " ".join(["word"] * r.randint(1, 40)), r.choice(["a", "A ", "b", "c", "d", None])) for i in range(2000)]
    docs += [(3000, None, "a"), (3001, "", "b"), (None, "word", "a"), (3002, "word " * 50, "tiny")]
    targets = [("a", 0.2, 1), ("b", 0.3, 3), ("c", 0.28, 2), ("tiny", 0.02, 4), ("absent", 0.1, 2), ("d", 0.0, 1), (None, 0.3, 1)]
    d = spark.createDataFrame(docs, "doc_id int, text string, source string").withColumn("tokens", F.lit("clash"))
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    mixed, report = mixture.mix(d, t, block=200)
    got = {x.source: x for x in report.collect()}
    times = Counter((x.doc_id) for x in mixed.collect())
    limit = {s: m for s, _, m in targets}
    source = {i: s.strip().lower() for i, _, s in docs if s and i is not None}
    assert all(n <= limit[source[i]] for i, n in times.items())
    assert rows(mixed.select("doc_id", "repeat")) and mixed.count() == mixed.select("doc_id", "repeat").distinct().count()
    whole = sum(x.tokens for x in got.values())
    total = sum(len((t or "").split()) for _, t, _ in docs)
    for s, share in (("a", 0.2), ("b", 0.3), ("c", 0.28)):
        assert got[s].tokens / got[s].wanted_tokens == pytest.approx(1, abs=0.01) and got[s].short == 0
        assert got[s].wanted_tokens == pytest.approx(share * total, rel=0.02)  # a blank at the end is a token of its own
        assert got[s].actual_share == pytest.approx(got[s].tokens / whole)
    # a source that runs out falls short, and is reported
    assert got["tiny"].tokens == got["tiny"].supply == got["tiny"].wanted_tokens - got["tiny"].short and got["tiny"].short > 0
    assert got["absent"].tokens == 0 and got["absent"].short == got["absent"].wanted_tokens and got["d"].tokens == 0
    # early slots already hold the shares: the schedule is even, and every block has its slot in it
    slots = sum(-(-min(x.wanted_tokens, x.supply) // 200) for x in got.values())
    assert mixed.agg(F.max("slot")).first()[0] < slots
    first = mixed.where(F.col("slot") < slots // 2).groupBy("source").agg(F.sum("tokens").alias("n")).collect()
    half = sum(x.n for x in first)
    assert all(abs(x.n / half - got[x.source].actual_share) < 0.05 for x in first)
    again = mixture.mix(d, t, block=200)[0]
    assert rows(again) == rows(mixed)


@pytest.mark.parametrize("blocks", [{"a": 1}, {"a": 5, "b": 3, "c": 1}, {"a": 100_000, "b": 33_333}])
def test_schedule_gives_every_block_one_slot(spark, blocks):
    got = mixture.schedule(spark, blocks).collect()
    assert sorted(r.slot for r in got) == list(range(sum(blocks.values())))
    for s, n in blocks.items():
        own = sorted((r.slot, r.block) for r in got if r.source == s)
        assert [b for _, b in own] == list(range(n))


def test_mixture_of_nothing(spark):
    d = spark.createDataFrame([], "doc_id int, text string, source string")
    t = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    mixed, report = mixture.mix(d, t)
    assert mixed.count() == 0 and report.first().actual_share == 0


def test_registered_mixture_and_ids_hold_what_they_say(spark):
    import os

    small = "/root/testdata/sf0.001"
    if not os.path.isdir(small):
        pytest.skip("the tables aren't here")
    from rollstone.llm import queries

    docs = {r.doc_id: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    ids = {r.doc_id: r.ids for r in queries.p7_ids(spark, small).collect()}
    assert set(ids) == set(docs) and all(bool(ids[i]) == bool(docs[i].text) for i in docs)
    most = {r.source.strip().lower(): r.max_repeats for r in spark.read.parquet(f"{small}/mixture_targets.parquet").collect()}
    mixed = queries.p8_mix(spark, small).collect()
    times = Counter(r.doc_id for r in mixed)
    assert mixed and all(r.tokens == len(ids[r.doc_id]) and r.source == docs[r.doc_id].source.strip().lower() and times[r.doc_id] <= most[r.source] for r in mixed)
    shares = queries.p8_shares(spark, small).collect()
    assert len(shares) == len(most) and sum(r.tokens for r in shares) == sum(r.tokens for r in mixed)
    assert sum(r.actual_share for r in shares) == pytest.approx(1) and all(r.taken == sum(m.source == r.source for m in mixed) for r in shares)
