"""The steps of the scoring pipeline in a row, over all documents at once, with the states that documents pass through.

A failing document doesn't stop the others: what can't be processed gets the state analyze_error. Steps are functions from DataFrames to DataFrames.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..work import durable
from . import scoring


def source_states(articles: DataFrame, filing: str = "filing") -> DataFrame:
    """articles with the state of each after a look at what was fetched: skipped for filings (a mark in the address), empty without any content, else as it was."""
    none = F.coalesce(F.trim("content"), F.lit("")) == ""
    new = F.when(F.contains(F.lower("url"), F.lit(filing)), "skipped").when(none, "empty").otherwise(F.col("state"))
    return articles.withColumn("state", F.when(F.col("url").isNull() & none, "empty").otherwise(new))


def linker_input(articles: DataFrame) -> DataFrame:
    """doc, content, state: the title and the text, or the text alone where it holds the title; a title or text given before counts as analysed, nothing at all as analyze_error.

    Of articles with the same title and text the smallest doc is linked.
    """
    title, text = F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))
    content = F.when(F.contains(text, title), text).when(text == "", title).otherwise(F.concat(title, F.lit(". "), text))
    rows = articles.select("doc", content.alias("content"))
    first = rows.where("content <> ''").groupBy(F.md5("content").alias("_h")).agg(F.min("doc").alias("_first"))
    rows = rows.withColumn("_h", F.md5("content")).join(first, "_h", "left")
    state = F.when(F.col("content") == "", "analyze_error").when(F.col("doc") != F.col("_first"), "analyzed").otherwise("imported")
    return rows.select("doc", "content", state.alias("state"))


def run(articles: DataFrame, names: DataFrame, members: DataFrame, sentiment: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame, dict[str, float]]:
    """Linking, sentiment, triples, TF-IDF and relevance of articles (doc, title, text).

    Gives the triples (doc, entity, category, tfidf, concept_score, total), the documents (doc, state, n_entities, sentiment) and the seconds from the
    start to the end of each step. names: name, entity. sentiment: documents (doc, content) to (doc, sentiment); without it sentiments are null.
    """
    began, took = time.monotonic(), {}

    def done(name: str, df: DataFrame) -> DataFrame:
        out = durable(df, name)
        took[name] = round(time.monotonic() - began, 3)
        return out

    given = done("input", linker_input(articles))
    todo = given.where("state = 'imported'").select("doc", F.col("content").alias("text"))
    hits = done("linking", scoring.dictionary_mentions(todo, names))
    feelings = done("sentiment", sentiment(todo.withColumnRenamed("text", "content")) if sentiment else todo.select("doc", F.lit(None).cast("double").alias("sentiment")))
    triples = done("triples", scoring.linked_triples(hits.select("doc", "entity", F.lit(None).cast("string").alias("label")), members))
    tokens = todo.select("doc", F.size(F.filter(F.split("text", "[^\\p{L}\\p{N}]+"), lambda w: w != "")).alias("n_tokens"))
    tfidf = done("tfidf", scoring.entity_tfidf(hits.select("doc", "entity"), tokens))
    relevance = done("relevance", scoring.member_relevance(tfidf, members))
    out = triples.join(tfidf, ["doc", "entity"], "left").join(relevance, ["doc", "category"], "left").withColumn("concept_score", F.coalesce("concept_score", F.lit(0.0)))
    out = done("total", out.select("doc", "entity", "category", "tfidf", "concept_score", F.round(F.col("tfidf") * F.col("concept_score"), 8).alias("total")))
    n = out.groupBy("doc").agg(F.count_distinct("entity").alias("n_entities"))
    docs = given.select("doc", "state").join(n, "doc", "left").join(feelings, "doc", "left")
    state = F.when((F.col("state") == "imported") & (F.coalesce("n_entities", F.lit(0)) > 0), "scored").when(F.col("state") == "imported", "analyzed").otherwise(F.col("state"))
    return out, docs.select("doc", state.alias("state"), F.coalesce("n_entities", F.lit(0)).cast("bigint").alias("n_entities"), "sentiment"), took


def unfinished(records: DataFrame, results: DataFrame, key: list[str], version: int) -> DataFrame:
    """Records that a batch evaluation of this version has no result for yet, or only one of an older version; a repeated call goes on where the last one ended."""
    return records.join(results.where(F.col("version") >= version).select(*key).distinct(), key, "left_anti")
