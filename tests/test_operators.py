"""Reference operators on literal fixtures, with nulls, ties, repeats and empty tables."""


import pytest
from pyspark.sql import functions as F

from rollstone.operators import evaluation, graph, patterns, scoring, search, upsert
from rollstone.plans.core import QUERIES


def rows(df):
    return {tuple(r) for r in df.collect()}


@pytest.fixture(scope="module")
def dec(spark):
    data = [("d1", "A", "X", 0.9), ("d1", "B", "Y", 0.8), ("d1", "A", "Y", 0.2), ("d2", "A", "X", 0.7), ("d2", "A", "Y", 0.6), ("d3", "C", "X", None), ("d1", "C", "Z", 0.5), ("d1", "A", "Z", 0.4), ("d4", "A", "X", 0.1), ("d4", "B", "Y", 0.1), ("d4", "C", "Z", 0.3)]
    return spark.createDataFrame(data, "doc string, entity string, category string, score double").withColumn("entity_score", F.lit(1.0))


def test_rollup_needs_as_many_entities_as_concepts(dec):
    assert rows(search.rollup(dec, ["X", "Y"])) == {("d1", 2, 2, 1.9), ("d4", 2, 2, 0.2)}
    assert rows(search.rollup(dec, ["X", "Y"], 0.5)) == {("d1", 2, 2, 1.7)}
    assert search.rollup(dec.limit(0), ["X"]).count() == 0


def test_drilldown_leaves_used_entities_out(dec, spark):
    docs = search.rollup(dec, ["X", "Y"])
    stats = spark.createDataFrame([("Z", 2.0, 2, 2), ("Y", 1.0, 1, 5), ("X", None, 9, 9)], "name string, specificity double, kg_count int, corpus_count int")
    got = search.subtopics(search.fresh_rows(dec, docs, ["X", "Y"]), stats).collect()
    assert [(r.category, r.docs, r.coverage, r.n_entities, r.diversity, r.rank_score) for r in got] == [("Z", 2, 0.8, 1, 0.5, 3.3)]
    fresh = search.fresh_rows(dec, docs, ["X"])
    ranked = search.subtopics(fresh, stats)
    # Y has one member in the graph only, so it has no specificity and ranks with 0
    assert {r.category: (r.specificity, r.rank_score) for r in ranked.collect()} == {"Z": (2.0, 3.3), "Y": (None, 0.0)}
    groups = search.overlap_groups(ranked, fresh)
    assert groups.count() == 2
    assert {r.category: r.branch for r in search.group_tree(groups, ranked, fresh).collect()} == {"Z": 1, "Y": 2}
    # a search by entities only leaves no row out
    assert search.fresh_rows(dec, docs, []).count() == dec.where("doc IN ('d1', 'd4') AND score >= 0.01").count()


def test_all_subtopics_are_grouped(spark):
    import random

    r = random.Random(5)
    sets = {f"c{i:03d}": {f"e{r.randrange(900)}" for _ in range(r.randint(1, 3))} for i in range(450)}
    t = spark.createDataFrame([("d", e, c) for c, es in sets.items() for e in es], "doc string, entity string, category string")
    ranked = spark.createDataFrame([(c, float(1000 - i // 2)) for i, c in enumerate(sets)], "category string, rank_score double")
    groups, want = [], set()
    for c, es in sets.items():
        at = next((i for i, g in enumerate(groups) if g & es), len(groups))
        groups += [set()] * (at == len(groups))
        groups[at] = groups[at] | es
        want.add((c, at + 1))
    got = search.overlap_groups(ranked, t)
    assert rows(got) == want and search.group_tree(got, ranked, t).count() == 450
    sizes = sorted(((-(len([1 for x in want if x[1] == i + 1]) + len(g) + 1), i + 1) for i, g in enumerate(groups)))
    branch = {g: k + 1 if k < 4 else 5 for k, (_, g) in enumerate(sizes)}
    assert {r.category: r.branch for r in search.group_tree(got, ranked, t).collect()} == {c: branch[g] for c, g in want}


def test_pages_and_histogram(dec, spark):
    docs = spark.createDataFrame([(i, i % 3 / 1.0) for i in range(25)], "doc int, score double")
    order = [F.desc("score"), F.col("doc")]
    assert search.page(docs, order, 3, 10).count() == 5 and search.page(docs, order, 1, 10).first().score == 2.0
    s = spark.createDataFrame([(0, 0.5), (1, -0.5), (2, 0.0), (3, None)], "doc int, sentiment double")
    assert tuple(search.sentiment_histogram(docs, s).first()) == (25, 1, 1, 23)


def test_excluding_before_or_after_the_limit(spark):
    m = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "a")], "doc int, entity string")
    assert [r.doc for r in search.by_shared_entities(m, ["a", "b"], [1], 2).collect()] == [2, 3]
    assert [r.doc for r in search.by_shared_entities(m, ["a", "b"], [1], 2, exclude_first=False).collect()] == [2]


def kg(spark):
    s = lambda data, cols: spark.createDataFrame(data, cols)
    members = s([("X", "A"), ("X", "B")], "category string, entity string")
    triples = s([("A", "M"), ("B", "N")], "subject string, object string")
    links = s([("M", "T"), ("U", "N")], "subject string, object string")
    return members, triples, links


def test_paths_keep_out_of_the_document(spark):
    members, triples, links = kg(spark)
    ctx = spark.createDataFrame([("d", "X", e) for e in "TUA"], "doc string, category string, entity string")
    p = graph.paths(members, triples, links, ctx)
    assert rows(p) == {("d", "X", "B", "N", "U")}
    assert graph.path_counts(p).agg(graph.path_sum("length", "n")).first()[0] == 0.25
    ctx = spark.createDataFrame([("d", "X", e) for e in "TU"], "doc string, category string, entity string")
    p = graph.paths(members, triples, links, ctx)
    assert rows(graph.relevance(graph.path_counts(p), ctx, members)) == {("d", "X", 0.25, 0.2)}
    assert graph.tree_edges(p).count() == 6
    w = graph.random_walks(p, 30, 1)
    assert rows(w.select("doc", "category", "member", "hop", "target")) <= rows(p)
    assert rows(w) == rows(graph.random_walks(p.repartition(3), 30, 1))
    assert graph.sample_errors(w, graph.path_counts(p)).first().estimate == 2
    t = graph.targeted_walks(p, 4)
    assert t.count() == 8 and t.select("category").distinct().first()[0] == "X"
    # per entity of the context, hit or not
    assert graph.collective_walks(p, ctx, 20).agg(F.sum("hits")).first()[0] == 40
    assert rows(graph.prefixed_walks(p, ["A"], 3).select("member")) == {("A",)} and graph.prefixed_walks(p, ["A"], 3).first().probability == 1.0
    b = graph.blind_walks(members, triples, links, ctx, 40).collect()
    assert len(b) == 40 and any(r.success for r in b) and all(r.probability > 0 or not r.success for r in b)


def test_graph_queries_take_all_documents_and_links(spark, tmp_path):
    brand = {1: "a", 2: "a", 3: "a", 4: "b", 5: "b", 6: "c"}
    line = [(7, 1, 1, 1), (7, 2, 6, 1), (130, 1, 4, 1), (130, 2, 6, 2), (130, 3, 6, 2), (999, 1, 2, 3), (999, 2, 5, 2), (5000, 2, 3, 2), (5000, 3, 1, 3)]
    save = lambda data, cols, name: spark.createDataFrame(data, cols).write.parquet(str(tmp_path / f"{name}.parquet"))
    save(list(brand.items()), "p_partkey int, p_brand string", "part")
    save(line, "l_orderkey int, l_linenumber int, l_partkey int, l_suppkey int", "lineitem")
    save([(1, 0), (2, 0), (3, 1)], "s_suppkey int, s_nationkey int", "supplier")
    supplied = {(p, x) for _, _, p, x in line}
    want = set()
    for doc in {x[0] for x in line}:  # listed by brute force for all documents
        inside = {p for o, _, p, _ in line if o == doc}
        for c in "ab":
            for m in (p for p in brand if brand[p] == c and p not in inside):
                want |= {(doc, f"Category:{c}", f"P{m}", f"S{x}", f"P{t}") for p, x in supplied if p == m for t, y in supplied if y == x and t in inside and brand[t] != c}
    assert {w[0] for w in want} > {130, 5000}
    # listing paths is a search: the documents divisible by 100 against all links; counts are of all documents
    assert rows(QUERIES["graph_paths"](spark, str(tmp_path))) == {w for w in want if w[0] % 100 == 0}
    counts = {}
    for w in want:
        counts[w[0], w[1], w[4]] = counts.get((w[0], w[1], w[4]), 0) + 1
    assert rows(QUERIES["path_counts"](spark, str(tmp_path))) == {(*k, 2, n) for k, n in counts.items()}
    assert {(r.doc, r.category) for r in QUERIES["concept_relevance"](spark, str(tmp_path)).collect()} >= {(w[0], w[1]) for w in want}


def test_counted_paths_are_those_listed(spark):
    import random

    r = random.Random(3)
    node = lambda: f"n{r.randrange(14)}"
    pairs = lambda n: [(node(), node()) for _ in range(n)] + [(None, "n1"), ("n2", None)]
    members = spark.createDataFrame([(c, node()) for c in "XXXXYYYYY"], "category string, entity string")
    triples, links = (spark.createDataFrame(pairs(n), "subject string, object string") for n in (40, 30))
    ctx = spark.createDataFrame([(d, c, node()) for d in range(12) for c in "XY" for _ in range(4)], "doc int, category string, entity string")
    want = rows(graph.path_counts(graph.paths(members, triples, links, ctx)))
    assert any(w[3] == 1 for w in want) and any(w[3] == 2 for w in want)
    assert rows(graph.counted(members, triples, links, ctx)) == want


def test_connectivity_of_small_graphs(spark):
    e = lambda data: spark.createDataFrame(data, "subject int, object int")
    base = [(3, 4)]
    assert not graph.connected(e(base), [1, 2], 2)
    assert not graph.connected(e([*base, (1, 0)]), [1, 2], 2)
    assert graph.connected(e([*base, (1, 0), (2, 0)]), [1, 2], 2)
    assert graph.connected(e(base), [1], 2)


def test_two_and_three_hops(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "c"), (None, "a"), ("a", "a")], "subject string, object string")
    got = graph.three_hop_counts(links, spark.createDataFrame([("a",)], "source string"), spark.createDataFrame([("d",), ("z",)], "target string"))
    assert rows(got) == {("a", "d", 0, 1, 1)}
    nodes = "abcdefg"
    import itertools
    import random

    e = {frozenset(x) for x in (random.Random(8).sample(nodes, 2) for _ in range(12))}
    on = lambda x, y: frozenset((x, y)) in e
    want = set()
    for x, y in itertools.permutations(nodes, 2):
        rest = [v for v in nodes if v not in (x, y)]
        n = (int(on(x, y)), sum(on(x, v) and on(v, y) for v in rest), sum(on(x, v) and on(v, w) and on(w, y) for v in rest for w in rest))
        want |= {(x, y, *n)} if any(n) else set()
    own = spark.createDataFrame([tuple(sorted(x)) for x in e], "subject string, object string")
    ends = lambda c: spark.createDataFrame([(v,) for v in nodes], f"{c} string")
    assert rows(graph.three_hop_counts(own, ends("source"), ends("target"))) == want
    near = graph.reachable(links, spark.createDataFrame([("a",)], "root string"), 5)
    assert {(r.node, r.distance) for r in near.collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}
    assert rows(graph.degrees(links)) == {("a", 2), ("b", 2), ("c", 3), ("d", 1)}
    pairs = spark.createDataFrame([("a", "d"), ("a", "b")], "a string, b string")
    assert rows(graph.common_neighbours(links, pairs)) == {("a", "d", 0, 1), ("a", "b", 1, 1)}


def test_siblings_of_a_large_parent(spark, monkeypatch):
    from rollstone.plans import core

    data = [(f"n{i:02d}", "hot") for i in range(30)] + [("a", "p"), ("b", "p")]
    monkeypatch.setattr(core, "hierarchy", lambda s, d: s.createDataFrame(data, "name string, parent string"))
    got = rows(QUERIES["siblings"](spark, "").select("name", "parent", "siblings"))
    assert got == {(x, p, sum(q == p for _, q in data) - 1) for x, p in data}


def test_running_error(spark):
    s = spark.createDataFrame([("r", 1, 2.0, 4.0), ("r", 2, 6.0, 4.0), ("z", 1, 1.0, 0.0)], "rec string, i int, v double, t double")
    got = {(r.rec, r.i): (r.running_mean, r.running_error) for r in graph.running_error(s, ["rec"], ["i"], "v", "t").collect()}
    assert got == {("r", 1): (2.0, 0.5), ("r", 2): (4.0, 0.0), ("z", 1): (1.0, None)}


def test_tfidf_guards(spark):
    m = spark.createDataFrame([("d1", "e"), ("d2", "e"), ("d1", "f"), ("d3", "g"), (None, "e")], "doc string, entity string")
    t = spark.createDataFrame([("d1", 10), ("d2", 5), ("d3", 0)], "doc string, n_tokens int")
    got = {(r.doc, r.entity): r.tfidf for r in scoring.entity_tfidf(m, t).collect()}
    assert got == {("d1", "e"): 0.018, ("d2", "e"): 0.035, ("d1", "f"): 0.048, ("d3", "g"): None}


def _expanded(spark, dec, hierarchy, scores):
    dec = spark.createDataFrame(dec, "doc string, entity string, category string, concept_score double")
    mentions = dec.select("doc", "entity", F.lit(1.0).alias("tfidf")).distinct()
    h = spark.createDataFrame(hierarchy, "name string, parent string")
    own = spark.createDataFrame(scores, "doc string, category string, concept_score double")
    return scoring.expand_concepts(dec, mentions, h, own).collect()


def test_expansion_scores_anew_and_ends_in_cycles(spark):
    dec = [("d", "e", "a", 0.5), ("d", "f", "z", 0.1), ("q", "e", "a", None)]
    h = [("a", "b"), ("b", "c"), ("c", "a"), ("x", "b"), ("c", "low"), ("low", "never")]
    got = {(r.category, r.step): (r.concept_score, r.routes) for r in _expanded(spark, dec, h, [("d", "b", 0.8), ("d", "c", 0.9), ("d", "low", 0.2)])}
    # b: 0.8 * 0.95 ** 2 isn't below a's 0.5; low is below c, so it isn't lifted again
    assert got == {("a", 0): (0.5, []), ("z", 0): (0.1, []), ("b", 1): (pytest.approx(0.722), ["a"]), ("c", 2): (pytest.approx(0.855), ["a", "b"]), ("low", 3): (pytest.approx(0.19), ["a", "b", "c"])}


def test_expansion_has_no_last_step(spark):
    h = [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(12)]
    got = _expanded(spark, [("d", "e", "c00", 0.5)] + [("d", "f", f"z{i}", 0.01) for i in range(20)], h, [("d", f"c{i:02d}", min(1.0, 0.5 * 1.06**i)) for i in range(13)])
    assert {r.category: r.step for r in got if r.step} == {f"c{i:02d}": i for i in range(1, 13)}


def test_linking(spark):
    m = spark.createDataFrame([("d", "A", "ORG"), ("d", "A", "ACTION"), ("d", "V", "ACTION"), ("d", "N", None), ("d", "T", "DATE"), ("d", "It", "ORG")], "doc string, entity string, label string")
    k = spark.createDataFrame([("A", "Category:x"), ("A", "Category:a_stubs")], "entity string, category string")
    assert rows(scoring.linked_triples(m, k, ["DATE"], ["it"])) == {("d", "A", "Category:x"), ("d", "V", "Action:V"), ("d", "N", "Entity:N")}
    t = spark.createDataFrame([("d", "The new York-times; new york"), ("e", None)], "doc string, text string")
    n = spark.createDataFrame([("New York", "NY"), ("times", "T"), ("", "nothing")], "name string, entity string")
    assert rows(scoring.dictionary_mentions(t, n)) == {("d", "NY", 2), ("d", "T", 4), ("d", "NY", 5)}
    a = spark.createDataFrame([("d", [(0, 3, "run", "VERB"), (4, 6, "it", "NOUN"), (9, 12, "run", "VERB")], [(0, 3, "ORG", "X"), (4, 6, "ORG", None)])], "doc string, tokens array<struct<start int, end int, lemma string, pos string>>, ents array<struct<start int, end int, label string, id string>>")
    e = scoring.mark_actions(a).first().ents
    assert (e[0].label, e[0].lemma, e[0].offsets) == ("ACTION", ["run"], [0, 9]) and (e[1].label, e[1].offsets) == ("ORG", [])


def test_corpus_tfidf_is_normed(spark):
    t = spark.createDataFrame([(1, "cat cat dog the"), (2, "dog bird"), (3, None), (4, "")], "doc int, text string")
    got = scoring.corpus_tfidf(t, ["the"])
    assert all(abs(r[1] - 1) < 1e-5 for r in got.groupBy("doc").agg(F.sum(F.col("weight") ** 2)).collect())
    assert got.where("term = 'the'").count() == 0 and got.select("doc").distinct().count() == 2


def test_types_and_peers(spark):
    a = spark.createDataFrame([("t", "b"), ("t", "a"), ("u", "z"), ("u", None), (None, "a")] + [("big", "h")] * 12, "template string, hypernym string")
    assert rows(scoring.derived_types(a, 10)) == {("t", "a"), ("u", "z"), ("big", "big")}
    t = spark.createDataFrame([("p", "s1", "o"), ("p", "s2", "o"), ("p", "s2", "o")], "predicate string, subject string, object string")
    assert rows(scoring.peer_counts(t)) == {("p", "o", 1)}


def test_patterns(dec, spark):
    p = spark.createDataFrame([("X,Y", ["X", "Y"]), ("X", ["X"])], "name string, categories array<string>")
    c = patterns.covered(p, dec, 0.5)
    assert rows(patterns.coverage(c)) == {("X,Y", 1, 1.7), ("X", 2, 1.6)}
    kids = {(r.parent, r["name"]) for r in patterns.children(p, c, dec, 0.4).collect()}
    assert ("X,Y", "X,Y,Z") in kids
    found = rows(patterns.mine(dec, spark.createDataFrame([("X",), ("Y",), ("Z",)], "name string"), 3, 0.05, 1).select("name", "level", "document_count"))
    assert {("X", 1, 3), ("X,Y", 2, 2), ("X,Y,Z", 3, 2)} <= found
    members = spark.createDataFrame([("A", "X"), ("B", "Y")], "entity string, category string")
    d = {(r["name"], r.category): r.diversity for r in patterns.diversity(p, c, dec, members).collect()}
    assert d[("X", "X")] == 1.0 and d[("X,Y", "Y")] == 1.0
    pairs = patterns.concept_pairs(dec, dec.where("doc = 'd1'").select("doc").distinct())
    assert "X|||Y" in {r.pair for r in pairs.collect()}


def test_mining_is_that_of_brute_force(spark):
    import itertools
    import random

    r = random.Random(1)
    data = {(d, f"e{r.randrange(5)}", f"C{r.randrange(6)}") for d in range(30) for _ in range(7)}
    by = {d: {c: {e for x, e, k in data if x == d and k == c} for c in {k for x, _, k in data if x == d}} for d in range(30)}
    covers = lambda p, d: all(c in by[d] for c in p) and len(set().union(*(by[d][c] for c in p))) >= len(p)
    level, want, k = {(c,) for _, _, c in data}, set(), 1
    while level:
        cov = {p: [d for d in by if covers(p, d)] for p in level}
        cov = {p: ds for p, ds in cov.items() if len(ds) >= 4}
        want |= {(",".join(p), k, len(ds)) for p, ds in cov.items()}
        level, k = set(), k + 1
        for p, ds in cov.items():
            for c in {c for d in ds for c in by[d]} - set(p):
                n = sum(bool(by[d].get(c, set()) - set().union(*(by[d][x] for x in p))) for d in ds)
                level |= {tuple(sorted((*p, c)))} if n >= 4 else set()
    t = spark.createDataFrame([(*x, 0.9) for x in data], "doc int, entity string, category string, score double")
    found = patterns.mine(t, t.select(F.col("category").alias("name")).distinct(), least_docs=4)
    assert k > 3 and rows(found.select("name", "level", "document_count")) == want


def test_refreshed_patterns(dec, spark):
    p = spark.createDataFrame([("X,Y", ["X", "Y"]), ("X", ["X"]), ("Q", ["Q"])], "name string, categories array<string>")
    members = spark.createDataFrame([("A", "X"), ("B", "Y")], "entity string, category string")
    assert rows(patterns.refreshed(p, dec, members, 0.5, 2)) == {("X,Y", 1, 1.7, 1.0, "expanded"), ("X", 2, 1.6, 1.0, "score_updated"), ("Q", 0, 0.0, 0.0, "expanded")}


def test_similar_documents_by_candidate_patterns(spark):
    rows_ = [("d", "a", "X"), ("d", "b", "Y"), ("d", "c", "Z"), ("e", "a", "X"), ("e", "b", "Y"), ("e", "b", "Z"), ("e", "k", "X"), ("f", "a", "X")]
    t = spark.createDataFrame([(*x, 1.0) for x in rows_], "doc string, entity string, category string, score double")
    got = rows(search.similar_by_patterns(t, {"X": "one", "Y": "one", "Z": "two"}, [], 5))
    # in e, b stands for Z only, so that Y isn't found and the patterns are X,Z alone
    assert got == {("d", "X,Z", 2, 2, 2, 218), ("e", "X,Z", 1, 2, 2, 208)}


def test_mining_goes_on_until_a_level_is_empty(spark):
    data = [(d, f"e{i}", f"C{i}", 0.9) for d in range(3) for i in range(4)]
    t = spark.createDataFrame(data, "doc int, entity string, category string, score double")
    found = patterns.mine(t, t.select(F.col("category").alias("name")).distinct(), least_docs=2)
    assert sorted((r.level, r["count"]) for r in found.groupBy("level").count().collect()) == [(1, 4), (2, 6), (3, 4), (4, 1)]


def test_registered_mining_has_no_last_level(spark, monkeypatch):
    from rollstone.plans import core

    data = [(d, f"e{i}", f"C{i}", 0.9) for d in range(5) for i in range(3)]
    monkeypatch.setattr(core, "dec", lambda s, d: s.createDataFrame(data, "doc int, entity string, category string, score double"))
    assert ("C0,C1,C2", 3, 5) in rows(QUERIES["pattern_mining"](spark, "").select("name", "level", "document_count"))


def test_days_around(spark):
    days = spark.createDataFrame([("s", "2024-01-10"), ("s", "2024-03-01")], "symbol string, date string").withColumn("date", F.to_date("date"))
    items = spark.createDataFrame([("2024-01-03", "a"), ("2024-01-02", "b"), ("2024-01-10", "a"), ("2024-01-17", "c"), ("2024-01-18", "c"), (None, "x")], "date string, item string").withColumn("date", F.to_date("date"))
    assert {(str(r.date), r.previous, r.same, r.following) for r in patterns.around_days(days, items).collect()} == {("2024-01-10", 1, 1, 1), ("2024-03-01", 0, 0, 0)}


def test_pair_counts_and_days_take_all_rows(spark, tmp_path, monkeypatch):
    from rollstone.plans import core

    data = [(7, "A", "X"), (7, "B", "Y"), (100, "A", "X"), (100, "B", "Y"), (101, "A", "X"), (101, "A", "Y"), (103, "C", "Y"), (103, "A", "Z")]
    monkeypatch.setattr(core, "dec", lambda s, d: s.createDataFrame(data, "doc int, entity string, category string"))
    assert rows(QUERIES["concept_pair_counts"](spark, "").select("pair", "documents")) == {("X|||Y", 2), ("Y|||Z", 1)}
    o = [(20, "2024-01-10", "F", "1", 1), (21, "2024-01-12", "F", "1", 2), (22, "2024-01-12", "O", "1", 51), (23, "2024-02-20", "P", "2", 3)]
    df = spark.createDataFrame(o, "o_orderkey int, o_orderdate string, o_orderstatus string, o_orderpriority string, o_custkey int")
    df.withColumn("o_orderdate", F.to_date("o_orderdate")).write.parquet(str(tmp_path / "orders.parquet"))
    got = {(r.symbol, str(r.date), r.previous, r.same, r.following) for r in QUERIES["around_days"](spark, str(tmp_path)).collect()}
    assert got == {("F", "2024-01-10", 0, 1, 2), ("F", "2024-01-12", 1, 2, 0), ("O", "2024-01-12", 1, 2, 0), ("P", "2024-02-20", 0, 1, 0)}


def test_upserts(spark):
    t = lambda x: F.lit(x).cast("timestamp")
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, None), (None, 3, "z")], "k string, v int, w string").withColumn("created_at", t("2020-01-01")).withColumn("updated_at", t("2020-01-01"))
    new = spark.createDataFrame([("a", 5), ("a", 4), ("b", 2), ("c", None), (None, 9)], "k string, v int")
    got = {r.k: (r.v, r.w, r.created_at.year, r.updated_at.year) for r in upsert.upsert(old, new, ["k"], t("2021-01-01")).collect()}
    assert got == {"a": (5, "x", 2020, 2021), "b": (2, None, 2020, 2020), "c": (None, None, 2021, 2021), None: (9, "z", 2020, 2021)}
    got = {r.k: r.v for r in upsert.upsert(old, new, ["k"], t("2021-01-01"), only_new=True).collect()}
    assert got == {"a": 1, "b": 2, "c": None, None: 3}
    assert upsert.upsert(old.limit(0), new, ["k"], t("2021-01-01")).count() == 4
    assert upsert.delete_where(old, F.col("w") == "x").count() == 2
    lists = spark.createDataFrame([("p", [1, 2, 2, 3]), ("q", []), ("r", None)], "k string, docs array<int>")
    assert upsert.pull(lists, "docs", F.lit(2)).first().docs == [1, 3]
    keep = spark.createDataFrame([(2,), (3,)], "doc int")
    assert {r.k: r.docs for r in upsert.pull_missing(lists, "k", "docs", keep, "doc").collect()} == {"p": [2, 2, 3], "q": [], "r": None}
    assert upsert.cascade(spark.createDataFrame([(1,), (2,), (None,)], "doc int"), keep, "doc", "doc").count() == 1
    m = spark.createDataFrame([("c", str(i)) for i in (3, 1, 2, 4, 4)] + [("d", "1"), ("d", None)], "k string, m string")
    assert [r.value for r in upsert.export_lines(m, ["k"], "m").collect()] == ["c,1,2,3,4"]


def test_evaluation(spark):
    q = spark.createDataFrame([(f"q{i}",) for i in range(14)], "name string")
    a = spark.createDataFrame([(f"q{i}",) for i in range(14) for _ in range(i)], "name string")
    got = {r["name"]: r.asked for r in evaluation.least_answered(q, a).collect()}
    assert [n for n, x in got.items() if x] and sorted(n for n, x in got.items() if x) == ["q0", "q1", "q2", "q3"]
    r = spark.createDataFrame([("n", "m1", 1, 7), ("n", "m1", 2, 8), ("n", "m2", 1, 7), ("n", "m2", 2, 9)], "name string, method string, place int, doc int")
    assert rows(evaluation.side_by_side(r, ["m1", "m2"])) == {("n", "m1", 1, 7), ("n", "m1", 2, 8), ("n", "m2", 1, 9)}
    e = spark.createDataFrame([("n", [1, 2, 3], {1: 0.5})], "name string, documents array<int>, scores map<int,double>")
    assert evaluation.remaining(e).first().remaining == 2


def test_samples_depend_on_the_seed_alone(spark):
    df = spark.range(100).repartition(5)
    a, b = ({r.id for r in graph.seeded_sample(x, ["id"], 7, 3).collect()} for x in (df, df.repartition(2)))
    assert a == b and len(a) == 7 and a != {r.id for r in graph.seeded_sample(df, ["id"], 7, 4).collect()}




def test_grid(spark):
    from rollstone.operators.grid import chunks, condition, grid

    df = spark.createDataFrame([(1, "Apple", ["x", "y"]), (2, "pear", ["y"]), (3, None, None), (4, "Plum", [])], "id int, name string, tags array<string>")
    ids = lambda *t, **k: [r.id for r in df.where(condition(*t, **k)).orderBy("id").collect()]
    assert ids() == [1, 2, 3, 4] and ids(("name", "nin", ["pear"])) == [1, 3, 4] and ids(("name", "ne", "pear")) == [1, 3, 4]
    assert ids(("name", "icontains", "PL")) == [1, 4] and ids(("tags", "all", ["x", "y"])) == [1] and ids(("tags", "any", ["y"])) == [1, 2]
    assert ids(("name", "null", True), ("id", "lt", 2), any_of=True) == [1, 3] and ids(("tags", "longer", 1)) == [1] and ids(("name", "regex", "^P")) == [4]
    assert [r.id for r in grid(df, [("id", "gte", 1)], ["id"], (["name"], "p"), [("name", True)], "id", 1, 2).collect()] == [2, 4]
    assert {(r.id, r.chunk) for r in chunks(df, ["id"], 3).collect()} == {(1, 0), (2, 0), (3, 0), (4, 1)}


def test_article_cleaning(spark):
    from rollstone.operators import articles as A

    df = spark.createDataFrame([("SHOUT-title - SRC", "title", "l0\nCity - first\nsecond\n" + "\n".join("1234567"))], "title string, short string, body string")
    got = df.select(A.plain_title(F.col("title")).alias("t"), A.trimmed_body(F.col("body")).alias("b"), A.lead_snippet(F.lit("Two Words"), F.lit("two words.")).alias("s"), A.trimmed_body(F.lit("x")).alias("none")).first()
    assert (got.t, got.b, got.s, got.none) == ("title", "first\nsecond", "Two words. ", None)
    text = "One fact. Two facts. Title here. " + "y" * 90 + ". last"
    assert df.select(A.snippet(F.lit("Title here"), F.lit(text))).first()[0].startswith("Title here. One fact. Two facts. yyy")
    assert df.select(A.snippet(F.lit("Only"), F.lit("no period"))).first()[0] == "Only. "
    tok = spark.createDataFrame([("he ran far", [(3, 6, "run"), (0, 2, "he")])], "text string, tokens array<struct<start int, end int, lemma string>>")
    assert tok.select(A.lemma_text("text", "tokens")).first()[0] == "he run far"
    m = spark.createDataFrame([("a<b and c", [(0, 3, "E"), (1, 5, "F")])], "text string, m array<struct<start int, end int, entity string>>")
    assert m.select(A.marked_html(F.col("text"), F.col("m"))).first()[0] == '<mark data-entity="E">a&lt;b</mark> and c'
    s = spark.createDataFrame([("good bad good", None), ("x", 0.5), (None, None)], "text string, sentiment double")
    assert sorted(r.sentiment for r in A.scored_by(s, "text", A.lexicon_scorer({"good": 1.0, "bad": -1.0})).collect()) == [0.0, 1 / 3, 0.5]
    b = spark.createDataFrame([(1, "TOP news"), (2, None), (3, "ok")], "id int, title string")
    assert [r.id for r in A.without_blacklisted(b, {"title": ["top"]}).collect()] == [2, 3]


def test_documents_by_stored_patterns(dec, spark):
    p = spark.createDataFrame([("X", ["X"], ["d1", "d2"]), ("X,Y", ["X", "Y"], ["d1", "d4"]), ("Z", ["Z"], ["d4"])], "name string, categories array<string>, documents array<string>").select("name", "categories", F.explode("documents").alias("doc"))
    assert rows(search.by_stored_patterns(p, dec, "d1", 5)) == {("d4", 1, 2), ("d2", 1, 1)}
    assert search.explained(spark.createDataFrame([("d1",)], "doc string"), dec, spark.createDataFrame([("X",)], "category string")).count() == 1
