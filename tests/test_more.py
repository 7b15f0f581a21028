"""Aliases, the pipeline, term look-up, remembered results and time columns on small fixtures."""

import datetime

from pyspark.sql import functions as F

from rollstone import work
from rollstone.functions import columns as C
from rollstone.operators import aliases as A
from rollstone.operators import pipeline, scoring


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_aliases(spark):
    known = spark.createDataFrame([("A", "Q1", "Company", 3), ("A", "Q0", "Person", 2), ("B", "Q2", "Company", None), (None, "Q9", "x", 1)], "entity string, external_id string, hypernym string, degree int")
    m = spark.createDataFrame([("d", "A", 0.5), ("d", "A", 0.9), ("d", "B", None), ("d", "C", 0.9), ("e", None, 1.0)], "doc string, entity string, tfidf double").withColumn("degree", F.lit("clash"))
    assert rows(A.entity_stats(m, known).select("doc", "entity", "place", "tfidf", "external_id")) == {("d", "A", 1, 0.9, "Q0"), ("d", "C", 2, 0.9, None), ("d", "B", 3, None, "Q2"), ("e", None, 1, 1.0, None)}
    facts = spark.createDataFrame([("A", "B", 1), ("A", "Z", 2), (None, "Z", 3)], "fact string, target string, n int")
    assert rows(A.resolved_facts(facts, known).select("n", "fact_external_id", "target_external_id", "missing")) == {(1, "Q0", "Q2", ""), (2, "Q0", None, "target"), (3, None, None, "fact,target")}
    dec = spark.createDataFrame([("X", "A"), ("X", "B"), ("X", "B"), ("X", "C"), ("Y", "A")], "category string, entity string")
    assert rows(A.pattern_entities(dec, ["X"], known)) == {("X", "A", "Q0"), ("X", "B", "Q2"), ("X", "C", None)}
    p = spark.createDataFrame([("X,Y", ["X", "Y"])], "name string, categories array<string>")
    assert rows(A.pattern_lines(p, dec, known, 2)) == {("X|Y,X,Q0,Q2",)}
    assert rows(A.typed_entities(known, "Company")) == {("Q2", "B", "Company")}
    asked = spark.createDataFrame([("A",), ("C",), ("D",), (None,)], "entity string")
    assert rows(A.filled_degrees(known, asked, spark.createDataFrame([("C", 7), ("A", 1)], "entity string, degree int"))) == {("A", 3, False), ("C", 7, True), ("D", 0, True)}
    assert A.entity_stats(m.limit(0), known).count() == 0


def test_states_and_pipeline(spark):
    a = spark.createDataFrame([("http://x/FILING/1", "t", "raw"), ("http://x/2", " ", "raw"), ("http://x/3", "t", "raw"), (None, None, "raw")], "url string, content string, state string")
    assert [r.state for r in pipeline.source_states(a).collect()] == ["skipped", "empty", "raw", "empty"]
    docs = spark.createDataFrame([(1, "Acme grows", "Acme of York grows."), (2, "Acme grows", "Acme of York grows."), (3, None, None), (4, "York", "Nothing else"), (5, "x", "x y")], "doc int, title string, text string")
    given = {r.doc: (r.content, r.state) for r in pipeline.linker_input(docs).collect()}
    assert given == {1: ("Acme grows. Acme of York grows.", "imported"), 2: ("Acme grows. Acme of York grows.", "analyzed"), 3: ("", "analyze_error"), 4: ("York. Nothing else", "imported"), 5: ("x y", "imported")}
    names = spark.createDataFrame([("acme", "E:Acme"), ("york", "E:York")], "name string, entity string")
    members = spark.createDataFrame([("E:Acme", "Category:firms")], "entity string, category string")
    triples, states, took = pipeline.run(docs, names, members)
    assert rows(states.select("doc", "state", "n_entities")) == {(1, "scored", 2), (2, "analyzed", 0), (3, "analyze_error", 0), (4, "scored", 1), (5, "analyzed", 0)}
    assert {(r.doc, r.entity, r.category) for r in triples.collect()} == {(1, "E:Acme", "Category:firms"), (1, "E:York", "Entity:E:York"), (4, "E:York", "Entity:E:York")}
    assert list(took) == ["input", "linking", "sentiment", "triples", "tfidf", "relevance", "total"] and sorted(took.values()) == list(took.values())
    left = pipeline.unfinished(docs.select("doc"), spark.createDataFrame([(1, 2), (2, 1)], "doc int, version int"), ["doc"], 2)
    assert {r.doc for r in left.collect()} == {2, 3, 4, 5}


def test_terms_are_found_in_four_ways(spark):
    w = spark.createDataFrame([("d", "run", 0.1), ("d", "ran", 0.2), ("d", "new york", 0.3), ("d", "york", 0.4), ("d", "new", 0.4)], "doc string, term string, weight double")
    e = spark.createDataFrame([("d", "E:a", "Run", "ran"), ("d", "E:b", "walks", "RAN "), ("d", "E:New_York", None, None), ("d", "E:York_new_x", "", None), ("d", "E:none", None, "z")], "doc string, entity string, lemma string, surface string")
    assert rows(scoring.term_weights(w, e)) == {("d", "E:a", 0.1, "lemma"), ("d", "E:b", 0.2, "surface"), ("d", "E:New_York", 0.3, "id"), ("d", "E:York_new_x", 0.4, "words"), ("d", "E:none", 0.0, None)}
    t = spark.createDataFrame([("p", "s", "a"), ("p", "s", "b"), ("p", "s", "b"), ("q", "s", "c")], "predicate string, subject string, object string")
    assert rows(scoring.object_counts(t)) == {("s", "p", 1), ("s", "q", 0)} and rows(scoring.frequent_predicates(t, 2)) == {("p", 3)}


def test_remembered_results_age_and_are_forgotten(spark):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    for _ in range(2):
        assert work.remembered(spark, "test key", build).count() == 3
    assert len(built) == 1
    work.remembered(spark, "test key", build, seconds=0)
    assert len(built) == 2
    work.forget(spark, "test key")
    assert work.remembered(spark, "test key", build).count() == 3 and len(built) == 3
    work.forget(spark, "test key")


def test_times_and_ids(spark):
    df = spark.createDataFrame([(datetime.datetime(2024, 1, 2, 3, 4, 5), datetime.datetime(2024, 1, 2, 3, 20, 0)), (None, datetime.datetime(2024, 1, 1))], "a timestamp_ntz, b timestamp_ntz")
    got = df.select(C.format_time("a"), C.format_time("a", True), C.minutes_between("a", "b"), C.is_fresh("a", F.col("b")), C.json_text(F.struct("a"))).collect()
    assert tuple(got[0])[:4] == ("2024-01-02 03:04:05", "2024-01-02", 15, True) and tuple(got[1]) == (None, None, None, False, "{}")
    assert spark.range(5).select(C.session_id().alias("i")).distinct().count() == 5
