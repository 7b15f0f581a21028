"""Queries of problems 2 and 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.hierarchy import Hierarchy
from ..operators.keyed_totals import dense_sums, totals_per_key
from ..work import durable, name_form, table, visible
from .registry import QUERIES, SQL


def _hierarchy(spark: SparkSession, d: str) -> Hierarchy:
    return Hierarchy(visible(table(spark, d, "category_hierarchy")), name_form("name"), name_form("parent"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _hierarchy(spark, d).roots()


def p2_paths(spark: SparkSession, d: str) -> DataFrame:
    return _hierarchy(spark, d).paths().select("name", F.array_join("path", " > ").alias("path"), (F.size("path") - 1).alias("hops"))


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    return _hierarchy(spark, d).descendants()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    found = []
    for name in ("document_entity_category", "entity_category"):
        rows = table(spark, d, name)
        rows = visible(rows) if name == "entity_category" else rows
        per_key = durable(dense_sums(rows, name_form("category"), {"n": F.lit(1).cast("bigint")}, "category"), "totals")
        total = per_key.agg(F.sum("n")).first()[0] or 0
        found.append(per_key.where(F.col("n") * 40 >= total).select(F.lit(name).alias("table_name"), "category"))
    return found[0].unionByName(found[1])


def p3_totals(spark: SparkSession, d: str) -> DataFrame:
    score = F.when(F.col("total_relevance_score") != -1, F.col("total_relevance_score"))
    out = totals_per_key(table(spark, d, "document_entity_category"), name_form("category"), {"articles": F.col("news_analytics"), "entities": F.col("entity")}, {"scored": score.isNotNull().cast("bigint"), "score": score}, "category")
    return out.withColumn("score", F.round("score", 4))


def p3_members(spark: SparkSession, d: str) -> DataFrame:
    return totals_per_key(visible(table(spark, d, "entity_category")), name_form("category"), {"entities": F.col("entity")}, None, "category")


QUERIES |= {f.__name__: f for f in (p2_found, p2_paths, p2_descendants, p3_found, p3_totals, p3_members)}

FORM = "nullif(trim(regexp_replace({0}, '[ \\t_]+', '_', 'g'), '_'), '')"
_links = f"""
rows AS (SELECT {FORM.format('name')} AS node, {FORM.format('parent')} AS parent FROM category_hierarchy WHERE skip_in_analysis IS DISTINCT FROM true),
nodes AS (SELECT node, min(parent) AS parent FROM (SELECT node, parent FROM rows WHERE node IS NOT NULL UNION ALL SELECT parent, NULL FROM rows WHERE node IS NOT NULL AND parent IS NOT NULL) GROUP BY node),
above AS (SELECT node, parent AS up FROM nodes WHERE parent IS NOT NULL UNION SELECT a.node, n.parent FROM above a JOIN nodes n ON n.node = a.up WHERE n.parent IS NOT NULL)"""
SQL["p2_found"] = f"""WITH RECURSIVE {_links},
turning AS (SELECT node FROM above WHERE node = up),
caught AS (SELECT node, min(up) AS root FROM above WHERE up IN (FROM turning) GROUP BY node)
SELECT n.node AS name, coalesce(c.root, r.up, n.node) AS root, CAST(CASE WHEN c.root IS NOT NULL THEN -1 ELSE (SELECT count(*) FROM above a WHERE a.node = n.node) END AS INTEGER) AS hops
FROM nodes n LEFT JOIN caught c ON c.node = n.node
LEFT JOIN (SELECT a.node, a.up FROM above a JOIN nodes t ON t.node = a.up WHERE t.parent IS NULL) r ON r.node = n.node"""
SQL["p2_descendants"] = f"""WITH RECURSIVE {_links}, turning AS (SELECT node FROM above WHERE node = up),
free AS (SELECT * FROM above WHERE node NOT IN (SELECT node FROM above WHERE up IN (FROM turning))),
deep AS (SELECT node, count(*) AS hops FROM free GROUP BY node)
SELECT f.up AS name, f.node AS descendant, CAST(d.hops - coalesce(u.hops, 0) AS INTEGER) AS distance FROM free f JOIN deep d ON d.node = f.node LEFT JOIN deep u ON u.node = f.up"""
SQL["p2_paths"] = f"""WITH RECURSIVE {_links},
down AS (SELECT node, node AS path, CAST(0 AS INTEGER) AS hops FROM nodes WHERE parent IS NULL
UNION ALL SELECT n.node, d.path || ' > ' || n.node, d.hops + 1 FROM down d JOIN nodes n ON n.parent = d.node)
SELECT node AS name, path, hops FROM down"""
SQL["p3_found"] = f"""WITH rows AS (
SELECT 'document_entity_category' AS table_name, {FORM.format('category')} AS category FROM document_entity_category
UNION ALL SELECT 'entity_category', {FORM.format('category')} FROM entity_category WHERE skip_in_analysis IS DISTINCT FROM true),
n AS (SELECT table_name, category, count(*) AS n FROM rows WHERE category IS NOT NULL GROUP BY ALL)
SELECT table_name, category FROM n a WHERE n * 40 >= (SELECT sum(n) FROM n b WHERE b.table_name = a.table_name)"""
SQL["p3_totals"] = f"""SELECT {FORM.format('category')} AS category, count(*) AS rows, count(DISTINCT news_analytics) AS articles, count(DISTINCT entity) AS entities,
count(nullif(total_relevance_score, -1)) AS scored, round(coalesce(sum(nullif(total_relevance_score, -1)), 0), 4) AS score
FROM document_entity_category WHERE {FORM.format('category')} IS NOT NULL GROUP BY 1"""
SQL["p3_members"] = f"""SELECT {FORM.format('category')} AS category, count(*) AS rows, count(DISTINCT entity) AS entities
FROM entity_category WHERE skip_in_analysis IS DISTINCT FROM true AND {FORM.format('category')} IS NOT NULL GROUP BY 1"""
