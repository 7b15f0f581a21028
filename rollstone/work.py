"""Working tables in the shared folder, and helpers that the operators have in common."""

from __future__ import annotations

import tempfile
import time
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that a side may have to be broadcast after its rows were counted.
BROADCAST_BYTES = 8 << 20
#: 64-bit words of the sketch that likely() broadcasts, whatever the number of keys.
SKETCH_WORDS = 1 << 19
#: Ends the shuffle files of a write with the write.
_FREES = ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.shuffleDependency.fileCleanup.enabled")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which all executors share.

    Where it is unset, a folder of this machine serves, but only for a local master.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = f"file://{tempfile.mkdtemp(prefix='rollstone-')}"
    spark.conf.set("spark.checkpoint.dir", folder)
    _delete_on_exit(spark, folder)
    return folder


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once for each application; Spark serves the file from the driver."""
    sc = spark.sparkContext
    if getattr(sc, "_rollstone_shipped", False) or not (here := Path(__file__).parent).is_dir():
        return
    path = Path(tempfile.mkdtemp(prefix="rollstone-code-")) / "rollstone.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, Path(here.name) / f.relative_to(here))
    sc.addPyFile(str(path))
    sc._rollstone_shipped = True


def send_file(spark: SparkSession, path: str) -> str:
    """A file of the driver for all executors, served by Spark; gives the name that local_file() finds it by."""
    spark.sparkContext.addFile(path)
    return Path(path).name


def local_file(name: str) -> str:
    """Where send_file() put a file on this executor."""
    return SparkFiles.get(name)


def _delete_on_exit(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)


def drop_table(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def durable(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write a working table to the shared folder and read it back: the lineage ends here and lost executors cost nothing.

    The file goes when the application ends, the shuffle files of the write at its end.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/rollstone-{name}-{uuid.uuid4().hex}"
    known = {k: spark.conf.get(k, None) for k in _FREES}
    try:
        for k in known:
            spark.conf.set(k, "true")
        df.write.option("compression", codec).parquet(path)
    finally:
        for k, v in known.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    _delete_on_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._rollstone_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a working table that nothing reads any more."""
    if path := getattr(df, "_rollstone_path", None):
        drop_table(df.sparkSession, path)


def remembered(spark: SparkSession, key: str, build: Callable[[], DataFrame], seconds: float | None = None) -> DataFrame:
    """A result written once for an application and read again while it is younger than so many seconds (None: until forgotten)."""
    known = spark.sparkContext.__dict__.setdefault("_rollstone_known", {})
    if (entry := known.get(key)) and (seconds is None or time.monotonic() - entry[0] < seconds):
        return entry[1]
    forget(spark, key)
    out = durable(build(), "remembered")
    known[key] = time.monotonic(), out
    return out


def forget(spark: SparkSession, key: str | None = None) -> None:
    """Ends one remembered result, or all of them; nothing may read them any more."""
    known = spark.sparkContext.__dict__.setdefault("_rollstone_known", {})
    for k in list(known) if key is None else [key] if key in known else []:
        discard(known.pop(k)[1])


def maybe_broadcast(df: DataFrame, rows: int, width: int = 64, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only for a side whose counted rows, at width bytes a row in memory, are within the limit; a larger side is joined by shuffle."""
    return F.broadcast(df) if rows * width <= limit else df


def likely(df: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """All rows of df whose column is among the keys, and few others: a sketch of one bit a hash is broadcast, SKETCH_WORDS words at most."""
    word = lambda c: F.pmod(F.xxhash64(c), F.lit(SKETCH_WORDS)).cast("int")
    bit = lambda c: F.shiftrightunsigned(F.xxhash64(c), 58).cast("int")
    bits = keys.select(word(key).alias("_word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit(key)).alias("_bits")).groupBy("_word").agg(F.bit_or("_bits").alias("_bits"))
    near = df.withColumn("_word", word(column)).join(F.broadcast(bits), "_word")
    return near.where(F.getbit("_bits", bit(column)) == 1).drop("_word", "_bits")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def name_form(c: Column | str) -> Column:
    """Blanks, tabs and underscores in a row become one underscore, outer underscores go; null where nothing is left."""
    c = F.col(c) if isinstance(c, str) else c
    form = F.trim(F.regexp_replace(c, "[ \\t_]+", "_"), F.lit("_"))
    return F.when(form != "", form)


def visible(df: DataFrame) -> DataFrame:
    """Rows that aren't marked as skipped; a null mark counts as visible."""
    return df.where(~F.col("skip_in_analysis").eqNullSafe(True))
