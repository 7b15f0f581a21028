"""Dense numbers in an order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..work import durable


def numbered(df: DataFrame, order: list[str], out: str = "code") -> DataFrame:
    """df with the numbers 0, 1, 2, ... in the given order as a column. One count per partition is broadcast."""
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = durable(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "ordered")
    ahead = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row a partition
    first = ranged.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_first"))
    return ranged.join(F.broadcast(first), "_part").withColumn(out, F.col("_row") + F.col("_first")).drop("_part", "_row", "_first")
