"""Concept patterns: coverage, diversity, level-wise drill-down mining, co-occurrence and event windows.

A pattern is a set of concepts, keyed by its sorted names joined by commas. patterns: name, categories (array).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import set_key
from ..work import discard, durable, maybe_broadcast
from . import mining
from .numbering import numbered
from .search import score_sum


def covered(patterns: DataFrame, dec: DataFrame, least_score: float = 0.5) -> DataFrame:
    """name, doc, score: documents with all concepts of a pattern by as many different entities, from triples of at least least_score."""
    wanted = patterns.select("name", F.size("categories").alias("k"), F.explode("categories").alias("category"))
    rows = dec.where(F.col("score") >= least_score).join(wanted, "category")
    per = rows.groupBy("name", "doc").agg(F.max("k").alias("k"), F.size(F.collect_set("category")).alias("nc"), F.size(F.collect_set("entity")).alias("ne"), score_sum().alias("score"))
    return per.where("nc = k AND ne >= k").select("name", "doc", "score")


def coverage(covered_: DataFrame) -> DataFrame:
    """name, document_count, relevance."""
    return covered_.groupBy("name").agg(F.count("*").alias("document_count"), score_sum().alias("relevance"))


def diversity(patterns: DataFrame, covered_: DataFrame, dec: DataFrame, members: DataFrame) -> DataFrame:
    """name, category, n_entities, n_rows, extension, diversity, pattern_diversity.

    Per category the distinct entities of the pattern's documents over the smaller of the graph's members and the documents; where that exceeds 1, over the rows. A pattern's
    diversity is its best category's.
    """
    wanted = patterns.select("name", F.explode("categories").alias("category"))
    rows = covered_.select("name", "doc").join(wanted, "name").join(dec.select("doc", "category", "entity"), ["doc", "category"])
    per = rows.groupBy("name", "category").agg(F.count_distinct("entity").alias("n_entities"), F.count("*").alias("n_rows"))
    docs = covered_.groupBy("name").agg(F.count("*").alias("n_docs"))
    ext = members.groupBy("category").agg(F.count_distinct("entity").alias("extension"))
    per = per.join(docs, "name").join(ext, "category", "left").withColumn("extension", F.coalesce("extension", F.lit(0)))
    least = F.least("extension", "n_docs")
    ratio = F.when(least > 0, F.col("n_entities") / least)
    d = F.round(F.when(ratio <= 1, ratio).otherwise(F.col("n_entities") / F.col("n_rows")), 3)
    per = per.select("name", "category", "n_entities", "n_rows", "extension", d.alias("diversity"))
    best = per.groupBy("name").agg(F.max("diversity").alias("pattern_diversity"))
    return per.join(best, "name")


def children(patterns: DataFrame, covered_: DataFrame, dec: DataFrame, least_score: float = 0.5, least_docs: int = 1) -> DataFrame:
    """parent, category, docs, n_entities, score, name, categories: concepts that occur in a pattern's documents by entities that don't stand for its concepts there."""
    wanted = patterns.select("name", F.explode("categories").alias("category"))
    strong = dec.where(F.col("score") >= least_score)
    in_docs = covered_.select("name", "doc").join(strong.select("doc", "entity", "category", "score"), "doc")
    used = in_docs.join(wanted, ["name", "category"], "left_semi").select("name", "doc", "entity").distinct()
    fresh = in_docs.join(wanted, ["name", "category"], "left_anti").join(used, ["name", "doc", "entity"], "left_anti")
    per = fresh.groupBy("name", "category").agg(F.count_distinct("doc").alias("docs"), F.count_distinct("entity").alias("n_entities"), score_sum().alias("score")).where(F.col("docs") >= least_docs)
    out = per.join(patterns.select("name", "categories"), "name").withColumn("categories", F.array_sort(F.concat("categories", F.array("category"))))
    return out.select(F.col("name").alias("parent"), "category", "docs", "n_entities", "score", set_key("categories").alias("name"), "categories")


def mine(dec: DataFrame, seeds: DataFrame, max_level: int | None = None, least_score: float = 0.5, least_docs: int = 5) -> DataFrame:
    """name, level, document_count, relevance of all patterns with at least least_docs documents, from the seeds on until none grows; max_level, if given, ends it earlier.

    A pattern grows by the concepts that children() would give it: those that occur in least_docs of its documents by an entity that stands for none of its
    concepts there. A document goes to the classes of its concepts with what is needed there, a class's patterns are grown in one task (mining.growing), and only
    patterns come back, never their documents. What the order of the concepts leaves open is found on the patterns alone (_reached).
    """
    spark = dec.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    strong = dec.where(F.col("score") >= least_score).select("doc", "category", F.xxhash64("entity").alias("entity"), "score").repartition("doc")
    per = durable(strong.groupBy("doc", "category").agg(F.collect_set("entity").alias("e"), F.sum("score").alias("score")), "strong")
    single = per.groupBy("category").agg(F.count("*").alias("document_count"), score_sum().alias("relevance")).where(F.col("document_count") >= least_docs)
    single = single.join(seeds.select(F.col("name").alias("category"), F.lit(True).alias("seed")).distinct(), "category", "left").withColumn("seed", F.coalesce("seed", F.lit(False)))
    single = durable(numbered(single, ["document_count", "category"]).withColumn("code", F.col("code").cast("int")), "concepts")
    first = single.where("seed").select(F.col("category").alias("name"), F.lit(1).alias("level"), "document_count", "relevance")
    if max_level == 1:
        return first
    n = single.count()
    codes = maybe_broadcast(single.select("category", "code", "seed"), n)
    items = F.array_sort(F.collect_list(F.struct("code", "seed", "score", "e")))
    profile = durable(per.join(codes, "category").groupBy("doc").agg(items.alias("x")).where("size(x) > 1").withColumn("own", F.array_distinct(F.flatten("x.e"))), "profiles")
    discard(per)
    bits = F.transform("x.e", lambda e: F.transform(e, lambda v: (F.array_position("own", v) - 1).cast("int")))
    profile = profile.select("x", bits.alias("bits"), F.explode(F.sequence(F.lit(1), F.size("x") - 1)).alias("i"))
    rest = lambda c: F.slice(c, F.col("i"), F.size("x"))
    begin = F.get("x", F.col("i") - 1)
    classes = profile.select(begin["code"].alias("c"), begin["seed"].alias("seed"), rest("x.code").alias("codes"), rest("x.score").alias("scores"), F.transform(rest("bits"), F.size).alias("sizes"), F.flatten(rest("bits")).alias("bits"))
    classes = classes.repartition(parts, "c").select(*mining.GIVEN).sortWithinPartitions("c")
    found = durable(classes.mapInArrow(mining.growing(least_docs, max_level), mining.FOUND).withColumn("id", F.monotonically_increasing_id()), "patterns")
    kept = found.where("kept").unionByName(_reached(found, single.where("seed").select(F.array("code").alias("p"))))
    named = kept.select("id", F.size("p").alias("level"), "document_count", "relevance", F.explode("p").alias("code"))
    named = named.join(maybe_broadcast(single.select("code", "category"), n), "code").groupBy("id", "level", "document_count", "relevance").agg(set_key(F.collect_list("category")).alias("name"))
    return first.unionByName(named.select("name", "level", "document_count", F.round("relevance", 6).alias("relevance")))


def _reached(found: DataFrame, single: DataFrame) -> DataFrame:
    """Those of the patterns that aren't kept by themselves which come of a kept one, or of such a pattern: others are the places of concepts without which they may be kept."""
    left = found.where("NOT kept")
    edges = durable(left.select("p", F.explode("others").alias("j")).select("p", F.filter("p", lambda _, i: i != F.col("j")).alias("parent")), "edges")
    wanted = edges.select("parent").distinct()
    known = found.where("kept").select("p").unionByName(single).withColumnRenamed("p", "parent").join(wanted, "parent", "left_semi")
    front = durable(edges.join(known, "parent", "left_semi").select("p").distinct(), "reached")
    reached = [front]
    while front.limit(1).count():  # a pattern is longer than what it comes of, so this ends
        new = edges.join(front.withColumnRenamed("p", "parent"), "parent", "left_semi").select("p").distinct()
        for r in reached:
            new = new.join(r, "p", "left_anti")
        front = durable(new, "reached")
        reached.append(front)
    out = reached[0]
    for r in reached[1:]:
        out = out.unionByName(r)
    return left.join(out, "p", "left_semi")


def refreshed(patterns: DataFrame, dec: DataFrame, members: DataFrame, least_score: float = 0.5, least_docs: int = 5) -> DataFrame:
    """name, document_count, relevance, diversity, state of the given patterns, scored anew.

    state is score_updated for at least least_docs documents (such patterns are to be expanded by children()), else expanded. A pattern without documents has 0 of each.
    """
    cov = covered(patterns, dec, least_score)
    best = diversity(patterns, cov, dec, members).groupBy("name").agg(F.max("pattern_diversity").alias("diversity"))
    out = patterns.select("name").distinct().join(coverage(cov), "name", "left").join(best, "name", "left")
    zero = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    out = out.select("name", zero("document_count", 0), zero("relevance", 0.0), zero("diversity", 0.0))
    return out.withColumn("state", F.when(F.col("document_count") >= least_docs, "score_updated").otherwise("expanded"))


def concept_pairs(dec: DataFrame, docs: DataFrame) -> DataFrame:
    """doc, pair: pairs of different concepts of different entities in the given documents, as one key."""
    rows = dec.join(docs.select("doc"), "doc", "left_semi").select("doc", "entity", "category")
    a, b = (rows.select("doc", *(F.col(c).alias(f"{c}_{s}") for c in ("entity", "category"))) for s in "ab")
    pairs = a.join(b, "doc").where("entity_a < entity_b AND category_a <> category_b")
    return pairs.select("doc", F.concat_ws("|||", F.least("category_a", "category_b"), F.greatest("category_a", "category_b")).alias("pair")).distinct()


def pair_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("pair").agg(F.count("*").alias("documents"))


def around_days(daily: DataFrame, items: DataFrame, before: int = 7, after: int = 7) -> DataFrame:
    """symbol, date, previous, same, following: distinct items (date, item) in the days before, on and after each trading day.

    An interval join made an equi-join: each item goes to the days it is near, at most before + after + 1 rows, and meets the days by equality.
    """
    near = items.where("date IS NOT NULL").select("item", F.explode(F.sequence(F.lit(-after), F.lit(before))).alias("gap"), "date").select("item", "gap", F.date_add("date", F.col("gap")).alias("date")).distinct()
    days = daily.select("date").distinct()
    count = lambda c: F.count_distinct(F.when(c, F.col("item")))
    per = near.join(days, "date", "left_semi").groupBy("date").agg(count(F.col("gap") > 0).alias("previous"), count(F.col("gap") == 0).alias("same"), count(F.col("gap") < 0).alias("following"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return daily.join(per, "date", "left").select("symbol", "date", zero("previous"), zero("same"), zero("following"))


def daily_bars(ticks: DataFrame) -> DataFrame:
    """symbol, date, open, high, low, close, delta from ticks (symbol, ts, value, seq): first and last by time, then seq."""
    order = F.struct("ts", "seq")
    per = ticks.where("symbol IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL").groupBy("symbol", F.to_date("ts").alias("date")).agg(F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"))
    from ..functions.columns import change_percent

    return per.withColumn("delta", F.round(change_percent("open", "close"), 4))
