"""Joins with the table of entity aliases: external ids, types and degrees of entities.

aliases: entity, external_id, hypernym, degree; of several rows of an entity the one with the smallest external id counts. Entities without a row keep nulls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = ("external_id", "hypernym", "degree")


def _one(aliases: DataFrame) -> DataFrame:
    return aliases.where("entity IS NOT NULL").groupBy("entity").agg(F.min(F.struct(*COLUMNS)).alias("a")).select("entity", "a.*")


def with_alias(rows: DataFrame, aliases: DataFrame, entity: str = "entity", prefix: str = "") -> DataFrame:
    """rows with what is known of an entity column, as columns that begin with prefix; every row stays once."""
    known = _one(aliases).select(F.col("entity").alias(entity), *(F.col(c).alias(prefix + c) for c in COLUMNS))
    return rows.join(known, entity, "left")


def entity_stats(mentions: DataFrame, aliases: DataFrame) -> DataFrame:
    """doc, entity, place, tfidf and the alias columns: each document's entities by tfidf, best first (nulls last; ties by the entity)."""
    rows = mentions.groupBy("doc", "entity").agg(F.max("tfidf").alias("tfidf"))
    # a document's entities as one sorted array, numbered in it: no window over documents
    order = F.struct(F.col("tfidf").isNull().alias("none"), (-F.col("tfidf")).alias("down"), "entity")
    each = rows.groupBy("doc").agg(F.array_sort(F.collect_list(order)).alias("all")).select("doc", F.posexplode("all").alias("at", "e"))
    each = each.select("doc", "e.entity", (F.col("at") + 1).alias("place"), (-F.col("e.down")).alias("tfidf"))
    return with_alias(each, aliases)


def pattern_entities(dec: DataFrame, concepts: list[str], aliases: DataFrame) -> DataFrame:
    """category, entity, external_id of the concepts of a pattern: a row an entity, null where no external id is known."""
    rows = dec.where(F.col("category").isin(concepts)).select("category", "entity").distinct()
    return with_alias(rows, aliases).select("category", "entity", "external_id")


def resolved_facts(facts: DataFrame, aliases: DataFrame) -> DataFrame:
    """facts (fact, target and others) with fact_external_id and target_external_id, and missing: which of the two no alias resolves."""
    out = with_alias(facts, aliases, "fact", "fact_").drop("fact_hypernym", "fact_degree")
    out = with_alias(out, aliases, "target", "target_").drop("target_hypernym", "target_degree")
    gone = F.array_compact(F.array(*(F.when(F.col(f"{c}_external_id").isNull(), F.lit(c)) for c in ("fact", "target"))))
    return out.withColumn("missing", F.array_join(gone, ","))


def pattern_lines(patterns: DataFrame, dec: DataFrame, aliases: DataFrame, least: int = 4) -> DataFrame:
    """value: lines pattern,concept,id,id,... of the external ids of each pattern's concepts, sorted and distinct, where there are least of them. patterns: name, categories."""
    wanted = patterns.select(F.regexp_replace("name", ",", "|").alias("pattern"), F.explode("categories").alias("category"))
    ids = with_alias(dec.select("category", "entity").distinct(), aliases).where("external_id IS NOT NULL").select("category", "external_id")
    per = wanted.join(ids, "category").groupBy("pattern", "category").agg(F.array_sort(F.collect_set("external_id")).alias("ids")).where(F.size("ids") >= least)
    return per.select(F.concat_ws(",", "pattern", "category", F.array_join("ids", ",")).alias("value"))


def typed_entities(aliases: DataFrame, hypernym: str) -> DataFrame:
    """external_id, entity, hypernym of the entities of one type, a row each, as an export reads them."""
    return _one(aliases).where(F.col("hypernym") == hypernym).select("external_id", "entity", "hypernym")


def filled_degrees(known: DataFrame, entities: DataFrame, counted: DataFrame) -> DataFrame:
    """entity, degree, fresh for the asked entities: the stored degree where there is one, else the counted one (0 for none). known, counted: entity, degree."""
    asked = entities.select("entity").where("entity IS NOT NULL").distinct()
    stored = known.groupBy("entity").agg(F.max("degree").cast("bigint").alias("stored"))
    missing = asked.join(stored.where("stored IS NOT NULL"), "entity", "left_anti")
    new = counted.join(missing, "entity", "left_semi").groupBy("entity").agg(F.max("degree").cast("bigint").alias("new"))
    out = asked.join(stored, "entity", "left").join(new, "entity", "left")
    return out.select("entity", F.coalesce("stored", "new", F.lit(0).cast("bigint")).alias("degree"), F.col("stored").isNull().alias("fresh"))
