"""Problem 8: sources mixed so that each has its target share of all tokens.

Each source's documents are shuffled once for each time they may be taken and cut into blocks of equal tokens. A low-discrepancy
schedule gives every block a slot: with N blocks in all, slot i has the golden-ratio point (i * g mod N) / N, where g is the whole number
next to N divided by the golden ratio that has no factor in common with N. The points of 0 to N - 1 are all different, so each source gets as
many slots as it has blocks when the points are mapped through the cumulative numbers of blocks; a source's nth slot takes its nth block.
Running sums are taken in two levels (hash ranges, then rows of a range), so a source with a third of all rows is spread like any other.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..work import durable
from .bpe import TOKENIZERS, with_token_counts

#: Least tokens of a block, and most blocks (a block grows with the total beyond them); slots made together; documents of a hash range on average; sources with a target.
BLOCK, BLOCKS, CHUNK, RANGE, SOURCES = 1024, 1 << 24, 1 << 16, 20_000, 10_000


def running_before(df: DataFrame, groups: list[str], bucket: Column, order: list[str], value: str, out: str) -> DataFrame:
    """df with the sum of value over the rows before, within groups, ordered by (bucket, order).

    No task gets more than a bucket of one group, or the bucket sums of one group.
    """
    rows = df.withColumn("_bucket", bucket)
    sums = rows.groupBy(*groups, "_bucket").agg(F.sum(value).alias("_sum"))
    ahead = W.partitionBy(*groups).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("_ahead", F.coalesce(F.sum("_sum").over(ahead), F.lit(0))).drop("_sum")
    within = W.partitionBy(*groups, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return rows.join(sums, [*groups, "_bucket"]).withColumn(out, F.col("_ahead") + F.col("_within")).drop("_bucket", "_ahead", "_within")


def _source_form(c: str) -> Column:
    return F.lower(F.trim(F.col(c)))


def golden_step(n: int) -> int:
    """The whole number without a common factor with n that is next to n divided by the golden ratio."""
    near = round(n * (math.sqrt(5) - 1) / 2)
    return next((g for d in range(n) for g in (near - d, near + d) if 0 < g < n and math.gcd(g, n) == 1), 1)


def plan(sizes: dict[str, int], targets: list[tuple[str, float, int]], total: int) -> dict[str, int]:
    """Tokens to take of each source: its share of the total, but at most all its documents as often as they may be taken.

    A source that has too little falls short, and the others aren't changed for it; sources that give nothing are left out.
    """
    able = {s: min(math.floor(share * total), sizes.get(s, 0) * times) for s, share, times in targets if share and times}
    return {s: n for s, n in able.items() if n > 0}


def schedule(spark, blocks: dict[str, int]) -> DataFrame:
    """source, block, slot: every block of every source at its slot, 0 to the sum of the blocks."""
    n = sum(blocks.values())
    g = golden_step(n)
    back = pow(g, -1, n) if n > 1 else 0
    edges, edge = [], 0
    for s in sorted(blocks):
        edges.append((s, edge, edge + blocks[s]))
        edge += blocks[s]
    pieces = spark.createDataFrame(edges, "source string, first long, end long").withColumn("at", F.explode(F.sequence("first", F.col("end") - 1, F.lit(CHUNK).cast("bigint"))))
    points = pieces.repartition("source", "at").select("source", F.explode(F.sequence("at", F.least(F.col("at") + CHUNK, F.col("end")) - 1)).alias("point"))
    # the slot of a point: the inverse of slot * g mod n
    slots = points.select("source", (F.col("point") * back % max(n, 1)).alias("slot"), F.lit(1).cast("bigint").alias("one"))
    return running_before(slots, ["source"], F.floor(F.col("slot") / CHUNK), ["slot"], "one", "block").select("source", "block", "slot")


def mix(docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", total: int | None = None, block: int | None = None, seed: int = 0, tokenizer: str | None = "byte_bpe_50k", folder: str = TOKENIZERS) -> tuple[DataFrame, DataFrame]:
    """The mixture and the report of its shares.

    Each source is wanted with target_share of total; total None means the tokens of all documents, those without a target included.
    Mixture: slot (place of its block in the whole), source, key, repeat (0 for the first time a document is taken) and tokens;
    order by slot, repeat and the key's hash to read it. Report, one row per target: source, target_share, max_repeats, supply (tokens of its documents as
    often as they may be taken), wanted_tokens, documents, taken, tokens, actual_share (of the mixture) and short (tokens that its supply lacks). Sources agree after outer
    spaces and case. A document is taken where at least half of it is within the wanted tokens, so a source is off by half a document at most. Documents with a null
    key, source or without tokens, and those of sources without a target, aren't taken; a target without documents has share 0. Of two targets
    for one source the larger counts. tokenizer None measures characters instead of tokens.
    """
    spark = docs.sparkSession
    named = targets.select(_source_form("source").alias("source"), F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("int").alias("max_repeats")).where("source IS NOT NULL")
    goals = named.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max_by("max_repeats", F.struct("target_share", "max_repeats")).alias("max_repeats")).limit(SOURCES + 1).collect()
    if len(goals) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources have a target")
    goal_rows = [(r.source, r.target_share, r.max_repeats) for r in goals]
    rows = docs.select(F.col(key).alias("doc"), _source_form(source).alias("source"), F.col(text).alias("text"))
    sized = rows.select("doc", "source", F.coalesce(F.char_length("text"), F.lit(0)).cast("bigint").alias("tokens")) if tokenizer is None else with_token_counts(rows, "text", "tokens", tokenizer, folder)
    sized = durable(sized.where("tokens > 0"), "sized")
    total = (sized.agg(F.sum("tokens")).first()[0] or 0) if total is None else total
    wanted_sources = F.broadcast(spark.createDataFrame([(s,) for s, _, _ in goal_rows], "source string"))
    able = sized.where("doc IS NOT NULL").join(wanted_sources, "source", "left_semi")
    stats = {r.source: (r.tokens, r.n) for r in able.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).collect()}  # one row a target at most
    need = plan({s: t for s, (t, _) in stats.items()}, goal_rows, total)
    facts = F.broadcast(spark.createDataFrame([(s, need[s], stats[s][0], need[s] // stats[s][0]) for s in need], "source string, need bigint, size bigint, last bigint"))
    copies = able.join(facts, "source").withColumn("repeat", F.explode(F.sequence(F.lit(0), F.col("last").cast("int"))))
    copies = copies.withColumn("order", F.xxhash64(F.lit(seed), "doc", "repeat"))
    bits = max(0, min(24, math.ceil(math.log2(max([n for _, n in stats.values()], default=1) / RANGE)))) if stats else 0
    bucket = F.shiftrightunsigned("order", 64 - bits) if bits else F.lit(0).cast("bigint")
    placed = running_before(copies, ["source", "repeat"], bucket, ["order", "doc"], "tokens", "before").withColumn("before", F.col("before") + F.col("repeat") * F.col("size"))
    block = max(BLOCK, -(-sum(need.values()) // BLOCKS)) if block is None else block
    taken = placed.where(F.col("before") + F.col("tokens") / 2 <= F.col("need")).withColumn("block", F.floor(F.col("before") / block).cast("bigint"))
    slots = schedule(spark, {s: -(-n // block) for s, n in need.items()})
    out = durable(taken.join(slots, ["source", "block"]).select("slot", "source", F.col("doc").alias(key), "repeat", "tokens"), "mixture")

    got = out.groupBy("source").agg(F.count("*").alias("taken"), F.count_if(F.col("repeat") == 0).alias("documents"), F.sum("tokens").alias("tokens"))
    about = [(s, share, times, stats.get(s, (0, 0))[0] * max(times or 0, 0), math.floor((share or 0) * total)) for s, share, times in goal_rows]
    targets_ = spark.createDataFrame(about, "source string, target_share double, max_repeats int, supply bigint, wanted_tokens bigint")
    whole = out.agg(F.sum("tokens")).first()[0] or 0
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    report = targets_.join(got, "source", "left").select("source", "target_share", "max_repeats", "supply", "wanted_tokens", zero("documents"), zero("taken"), zero("tokens"))
    return out, report.withColumn("actual_share", F.col("tokens") / F.lit(float(max(whole, 1)))).withColumn("short", F.greatest(F.col("wanted_tokens") - F.col("supply"), F.lit(0)))
