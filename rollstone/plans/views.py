"""Logical tables over the driver's tables, in Spark and as SQL text for the oracle.

document_entity_category and document_entity hold repeated and late rows; the views keep one row per key, as upserts would.
Names of categories are compared by their name form. A score of -1 means "not scored" and becomes null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..work import name_form, remembered, table, visible

_FORM = "nullif(trim(regexp_replace({0}, '[ \\t_]+', '_', 'g'), '_'), '')"


def documents(spark: SparkSession, d: str) -> DataFrame:
    """doc, source, published, title, text, state, sentiment: the highest version of each article."""
    order = [F.col(c).desc_nulls_last() for c in ("version", "created_at", "processing_state", "sentiment_score")]
    df = table(spark, d, "news_analytics").where("id IS NOT NULL")
    df = df.withColumn("_n", F.row_number().over(W.partitionBy("id").orderBy(*order))).where("_n = 1")
    source = F.lower(F.trim("source"))
    return df.select(F.col("id").alias("doc"), source.alias("source"), F.col("publication_date").alias("published"), "title", "text", F.col("processing_state").alias("state"), F.col("sentiment_score").alias("sentiment"))


def dec(spark: SparkSession, d: str) -> DataFrame:
    """doc, entity, category, score (total), concept_score, entity_score, specificity: one row per key; written once for an application, clustered by document."""
    return remembered(spark, f"dec {d}", lambda: _dec(spark, d))


def _dec(spark: SparkSession, d: str) -> DataFrame:
    known = lambda c: F.max(F.when(F.col(c) != -1, F.col(c)))
    df = table(spark, d, "document_entity_category").select("*", name_form("category").alias("_category"))
    df = df.where("news_analytics IS NOT NULL AND entity IS NOT NULL AND _category IS NOT NULL")
    df = df.repartition("news_analytics")
    return df.groupBy(F.col("news_analytics").alias("doc"), "entity", F.col("_category").alias("category")).agg(
        known("total_relevance_score").alias("score"), known("concept_relevance_score").alias("concept_score"), known("entity_relevance_score").alias("entity_score"), known("category_specificity_score").alias("specificity")
    )


def mentions(spark: SparkSession, d: str) -> DataFrame:
    """doc, entity, entity_type, tfidf: one row per key."""
    df = table(spark, d, "document_entity").where("news_analytics IS NOT NULL AND entity IS NOT NULL")
    return df.groupBy(F.col("news_analytics").alias("doc"), "entity").agg(F.max("entity_type").alias("entity_type"), F.max("entity_tfidf_score").alias("tfidf"))


def members(spark: SparkSession, d: str) -> DataFrame:
    """entity, category: visible membership, distinct."""
    return visible(table(spark, d, "entity_category")).select("entity", name_form("category").alias("category")).where("entity IS NOT NULL AND category IS NOT NULL").distinct()


def hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """name, parent: visible links, distinct."""
    return visible(table(spark, d, "category_hierarchy")).select(name_form("name").alias("name"), name_form("parent").alias("parent")).where("name IS NOT NULL AND parent IS NOT NULL").distinct()


def stats(spark: SparkSession, d: str) -> DataFrame:
    """name, kg_count, corpus_count, specificity of the visible categories: one row per name."""
    df = visible(table(spark, d, "category_stats")).select(name_form("name").alias("name"), "kg_entity_count", "corpus_entity_count", "specificity_score").where("name IS NOT NULL")
    return df.groupBy("name").agg(F.max("kg_entity_count").alias("kg_count"), F.max("corpus_entity_count").alias("corpus_count"), F.max("specificity_score").alias("specificity"))


SQL_VIEWS = f"""documents_ AS (SELECT id AS doc, lower(trim(source, ' ')) AS source, publication_date AS published, title, text, processing_state AS state, sentiment_score AS sentiment FROM news_analytics WHERE id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC NULLS LAST, created_at DESC NULLS LAST, processing_state DESC NULLS LAST, sentiment_score DESC NULLS LAST) = 1),
dec AS (SELECT news_analytics AS doc, entity, {_FORM.format('category')} AS category, max(nullif(total_relevance_score, -1)) AS score, max(nullif(concept_relevance_score, -1)) AS concept_score, max(nullif(entity_relevance_score, -1)) AS entity_score, max(nullif(category_specificity_score, -1)) AS specificity
FROM document_entity_category WHERE news_analytics IS NOT NULL AND entity IS NOT NULL AND {_FORM.format('category')} IS NOT NULL GROUP BY 1, 2, 3),
mentions AS (SELECT news_analytics AS doc, entity, max(entity_type) AS entity_type, max(entity_tfidf_score) AS tfidf FROM document_entity WHERE news_analytics IS NOT NULL AND entity IS NOT NULL GROUP BY 1, 2),
members AS (SELECT DISTINCT entity, {_FORM.format('category')} AS category FROM entity_category WHERE skip_in_analysis IS DISTINCT FROM true AND entity IS NOT NULL AND {_FORM.format('category')} IS NOT NULL),
hierarchy AS (SELECT DISTINCT {_FORM.format('name')} AS name, {_FORM.format('parent')} AS parent FROM category_hierarchy WHERE skip_in_analysis IS DISTINCT FROM true AND {_FORM.format('name')} IS NOT NULL AND {_FORM.format('parent')} IS NOT NULL),
stats AS (SELECT {_FORM.format('name')} AS name, max(kg_entity_count) AS kg_count, max(corpus_entity_count) AS corpus_count, max(specificity_score) AS specificity FROM category_stats WHERE skip_in_analysis IS DISTINCT FROM true AND {_FORM.format('name')} IS NOT NULL GROUP BY 1),
concepts AS (SELECT category FROM dec GROUP BY category ORDER BY count(*) DESC, category LIMIT 2),
entities AS (SELECT entity FROM mentions GROUP BY entity ORDER BY count(*) DESC, entity LIMIT 3)"""


def sql(body: str, recursive: bool = False) -> str:
    """A query over the views; body may begin with further views, each ended by a comma before the last SELECT."""
    return f"WITH {'RECURSIVE ' if recursive else ''}{SQL_VIEWS}{body}"


def top_concepts(dec_: DataFrame, n: int = 2) -> list[str]:
    """The n most frequent concepts: the parameters of the registered queries."""
    return [r.category for r in dec_.groupBy("category").count().orderBy(F.desc("count"), "category").limit(n).collect()]


def top_entities(mentions_: DataFrame, n: int = 3) -> list[str]:
    return [r.entity for r in mentions_.groupBy("entity").count().orderBy(F.desc("count"), "entity").limit(n).collect()]
