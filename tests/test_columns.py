"""Column functions."""

import hashlib

import pytest
from pyspark.sql import functions as F

from rollstone.functions import columns as C


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f("c")).first()[0]


@pytest.mark.parametrize(
    "name,ok",
    [("Category:Articles_containing_image_maps", False), ("Category:Banks", True), ("Category:1900_births", False), ("Category:ARTICLES", False), ("Category:Unknown", True), ("Category:unknown", False), (None, None)],
)
def test_validity(spark, name, ok):
    assert one(spark, name, C.is_valid_concept) is ok


@pytest.mark.parametrize("url,short", [("http://dbpedia.org/ontology/City", "dbo:City"), ("http://dbpedia.org/resource/Category:X", "DBpedia:Category:X"), ("http://a.b/c/d", "other:d"), ("plain", "other:plain"), (None, None)])
def test_short_urls(spark, url, short):
    assert one(spark, url, C.shorten_url) == short


def test_names_and_keys(spark):
    assert one(spark, "Category:Big_banks", C.display_name) == "Big banks"
    assert one(spark, "http://x/New York", lambda c: C.local_id(c, "http://x/")) == "New_York"
    assert one(spark, ["b", "a"], C.set_key, "array<string>") == "a,b"
    got = one(spark, " Category:b | x,, Category:a ", C.split_terms)
    assert (got.concepts, got.entities) == (["Category:a", "Category:b"], ["x"])
    assert one(spark, "UPDATE Two Words", C.sentence_case) == "UPDATE two words" and one(spark, "One", C.sentence_case) == "One"
    assert one(spark, "a,b.c_d", C.no_punctuation) == "a b c d"


def test_numbers(spark):
    assert one(spark, 0, lambda c: C.specificity(c, F.lit(10)), "int") == 0
    assert one(spark, 1, lambda c: C.specificity(c, F.lit(1000)), "int") == 3.0
    assert one(spark, 0.25, C.squash, "double") == pytest.approx(0.2)
    assert one(spark, 0.0, lambda c: C.change_percent(c, F.lit(5.0)), "double") == 0
    assert one(spark, 4.0, lambda c: C.change_percent(c, F.lit(5.0)), "double") == 25
    assert [one(spark, x, C.amount_in_millions) for x in ("$12.5M", "$1.5B", "n/a", None)] == [12.5, 1500.0, None, None]
    assert one(spark, [3.0, 4.0], lambda c: C.cosine(c, F.array(F.lit(4.0), F.lit(3.0))), "array<float>") == pytest.approx(0.96)
    assert one(spark, [0.0], lambda c: C.cosine(c, c), "array<double>") is None
    assert [one(spark, x, lambda c: C.signed_sentiment(c, F.lit(0.5))) for x in ("NEG", "NEU", "POS")] == [-0.5, 0.0, 0.5]


def test_subsets(spark):
    assert one(spark, ["a", "b"], C.subsets, "array<string>") == [[], ["a"], ["b"], ["a", "b"]]
    assert one(spark, [], C.subsets, "array<string>") == [[]]


def test_cutting_and_searching(spark):
    assert one(spark, "Body text. CLICK to subscribe now", lambda c: C.cut_at(c, ["click to", "zzz"])) == "Body text. "
    assert one(spark, "Click to", lambda c: C.cut_at(c, ["click to"])) == "Click to"
    assert one(spark, "ÀB c", lambda c: C.contains_any(c, ["àb"])) is True


def test_digest_and_html(spark):
    assert one(spark, "é", C.sha3_512) == hashlib.sha3_512("é".encode()).hexdigest() and one(spark, None, C.sha3_512) is None
    page = "<div id=main><p>no</p><ul id='list'><li> one </li>\n\n<li>two<br></li></ul> out</div>"
    assert one(spark, page, lambda c: C.html_text(c, "list", "main")) == "one\ntwo"
    assert "out" in one(spark, page, lambda c: C.html_text(c, "absent", "main")) and one(spark, page, lambda c: C.html_text(c, "absent")) is None
