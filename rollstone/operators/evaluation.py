"""Evaluation: answers per question, retrieval methods side by side, remaining work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def least_answered(questions: DataFrame, answers: DataFrame, spread: int = 10) -> DataFrame:
    """name, answers, asked: questions with their number of answers; if most and fewest differ by more than spread, the ten most answered aren't asked."""
    n = questions.select("name").distinct().join(answers.groupBy("name").agg(F.count("*").alias("answers")), "name", "left").withColumn("answers", F.coalesce("answers", F.lit(0)))
    ends = n.agg((F.max("answers") - F.min("answers")).alias("d")).first()["d"] or 0
    if ends <= spread:
        return n.withColumn("asked", F.lit(True))
    most = n.orderBy(F.desc("answers"), "name").limit(10).select("name", F.lit(False).alias("asked"))
    return n.join(most, "name", "left").withColumn("asked", F.coalesce("asked", F.lit(True)))


def side_by_side(results: DataFrame, methods: list[str], top: int = 5) -> DataFrame:
    """name, method, place, doc: each method's first documents, without those that an earlier method shows. results: name, method, place, doc."""
    order = F.array_position(F.array(*map(F.lit, methods)), F.col("method"))
    rows = results.where(F.col("method").isin(methods)).withColumn("_m", order)
    shown = None
    for k, m in enumerate(methods):
        own = rows.where(F.col("method") == m)
        if shown is not None:
            own = own.join(shown.select("name", "doc").distinct(), ["name", "doc"], "left_anti")
        own = own.withColumn("place", F.row_number().over(W.partitionBy("name").orderBy("place", "doc"))).where(F.col("place") <= top).select("name", "method", "place", "doc")
        shown = own if shown is None else shown.unionByName(own)
    return shown


def remaining(evaluations: DataFrame) -> DataFrame:
    """name, remaining: documents (array) that have no score (map) yet."""
    return evaluations.select("name", F.size(F.array_except("documents", F.map_keys("scores"))).alias("remaining"))


def split_names(names: DataFrame, mark: str) -> DataFrame:
    """name, kind: topic where the mark occurs in the name, else group."""
    return names.select("name", F.when(F.contains("name", F.lit(mark)), "topic").otherwise("group").alias("kind"))
