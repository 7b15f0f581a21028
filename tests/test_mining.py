"""Mining against the definition, level by level in Python, and what it writes."""

import random
from itertools import combinations

from pyspark.sql import functions as F

from rollstone.operators import mining, patterns
from rollstone.work import durable


def by_definition(data, seeds, least_docs):
    """Pattern to its number of documents."""
    docs = {}
    for doc, entity, category, _ in data:
        docs.setdefault(doc, {}).setdefault(category, set()).add(entity)
    union = lambda d, p: set().union(*(d[c] for c in p))
    hold = lambda p: [d for d in docs.values() if p <= d.keys() and len(union(d, p)) >= len(p)]
    level, out = {frozenset([c]) for c in seeds}, {}
    while level := {p for p in level if len(hold(p)) >= least_docs}:
        out |= {p: len(hold(p)) for p in level}
        grown = set()
        for p in level:
            more = [c for d in hold(p) for c in d.keys() - p if d[c] - union(d, p)]
            grown |= {p | {c} for c in set(more) if more.count(c) >= least_docs}
        level = grown
    return {(",".join(sorted(p)), len(p), n) for p, n in out.items()}


def frame(spark, data):
    return spark.createDataFrame(data, "doc int, entity string, category string, score double")


def mined(spark, data, seeds, least_docs, max_level=None):
    found = patterns.mine(frame(spark, data), spark.createDataFrame([(c,) for c in seeds], "name string"), max_level, least_docs=least_docs).collect()
    assert len({r["name"] for r in found}) == len(found)
    return found


def test_mining_by_definition(spark, monkeypatch):
    for seed, rows in ((1, 1 << 16), (2, 8)):
        monkeypatch.setattr(mining, "ROWS", rows)
        r = random.Random(seed)
        # few entities, so that many concepts of a document stand for the same one
        data = list({(d, f"e{r.randrange(5)}", f"C{int(r.random() ** 1.5 * 9)}"): 0.75 for d in range(25) for _ in range(14)}.items())
        data = [(*k, v) for k, v in data] + [(0, f"f{i}", "C1", 0.5) for i in range(150)]
        every = {x[2] for x in data}
        for seeds in (every, {"C0", "C7", "none"}):
            want = by_definition(data, seeds, 3)
            found = mined(spark, data, seeds, 3)
            assert {(x["name"], x["level"], x["document_count"]) for x in found} == want and len(want) > 40
        assert {(x["name"], x["level"], x["document_count"]) for x in mined(spark, data, every, 3, 2)} == {x for x in by_definition(data, every, 3) if x[1] <= 2}


def test_a_pattern_that_only_comes_of_its_later_concepts(spark):
    # A is the rarest; B stands for an entity of A, so that A,B comes of B only, and A,B,C of A,B or of B,C
    data = [(d, e, c, 0.9) for d in range(3) for e, c in ("xA", "wA", "xB", "yC")] + [(8, "x", "B", 0.9), (8, "y", "C", 0.9), (9, "y", "C", 0.9)]
    want = by_definition(data, "ABC", 3)
    found = mined(spark, data, "ABC", 3)
    assert {(x["name"], x["level"], x["document_count"]) for x in found} == want
    assert {x["name"]: x["relevance"] for x in found if x["level"] > 1} == {"A,B": 8.1, "A,C": 8.1, "B,C": 7.2, "A,B,C": 10.8}


def test_mining_writes_no_documents_of_patterns(spark, monkeypatch):
    written = []

    def counted(df, *a):
        out = durable(df, *a)
        written.append(out.count())
        return out

    monkeypatch.setattr(patterns, "durable", counted)
    data = [(d, f"e{i}", f"C{i}", 0.9) for d in range(12) for i in range(10)]
    found = patterns.mine(frame(spark, data), frame(spark, data).select(F.col("category").alias("name")).distinct())
    assert found.count() == sum(len(list(combinations(range(10), k))) for k in range(1, 11))
    assert max(written) <= 1023 < 12 * 252  # documents of the patterns of five concepts
