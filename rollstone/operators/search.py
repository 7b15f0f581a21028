"""Roll-up, drill-down and search.

dec: doc, entity, category, score (see plans.views); one row per key. Lists given as parameters are short query terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import set_key
from ..work import ship


def score_sum(c: str = "score", digits: int = 6) -> Column:
    return F.round(F.coalesce(F.sum(c), F.lit(0.0)), digits)


def rollup(dec: DataFrame, concepts: list[str], least_score: float | None = None) -> DataFrame:
    """doc, n_categories, n_entities, score: documents that have all the concepts by as many different entities at least."""
    k = len(set(concepts))
    rows = dec.where(F.col("category").isin(concepts))
    rows = rows if least_score is None else rows.where(F.col("score") >= least_score)
    # dec has one row per key, so sets of one document are small; one shuffle instead of an expand for two distinct counts
    per_doc = rows.groupBy("doc").agg(F.size(F.collect_set("category")).cast("bigint").alias("n_categories"), F.size(F.collect_set("entity")).cast("bigint").alias("n_entities"), score_sum().alias("score"))
    return per_doc.where((F.col("n_categories") == k) & (F.col("n_entities") >= k))


def rollup_entities(dec: DataFrame, entities: list[str]) -> DataFrame:
    """doc, n_entities: documents that have any of the entities."""
    return dec.where(F.col("entity").isin(entities)).groupBy("doc").agg(F.count_distinct("entity").alias("n_entities"))


def matches(dec: DataFrame, docs: DataFrame, concepts: list[str]) -> DataFrame:
    """doc, category, entities: for each document of the result, which entities stand for which concept (one concept an entity, the largest name)."""
    one = dec.where(F.col("category").isin(concepts)).join(docs.select("doc"), "doc", "left_semi").groupBy("doc", "entity").agg(F.max("category").alias("category"))
    return one.groupBy("doc", "category").agg(F.array_join(F.array_sort(F.collect_list("entity")), "|").alias("entities"))


def page(ranked: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Rows [(number - 1) * size, number * size) in the given total order, with their position from 1."""
    top = ranked.orderBy(*order).limit(number * size)  # bounded by the page asked for
    return top.withColumn("position", F.row_number().over(W.orderBy(*order))).where(F.col("position") > (number - 1) * size)


def sentiment_histogram(docs: DataFrame, sentiment: DataFrame) -> DataFrame:
    """total, positive, negative, neutral of the result; documents without a sentiment are neutral."""
    s = docs.select("doc").join(sentiment.select("doc", "sentiment"), "doc", "left")
    pos, neg = F.count_if(F.col("sentiment") > 0), F.count_if(F.col("sentiment") < 0)
    return s.agg(F.count("*").alias("total"), pos.alias("positive"), neg.alias("negative"), (F.count("*") - pos - neg).alias("neutral"))


def fresh_rows(dec: DataFrame, docs: DataFrame, concepts: list[str], least_score: float = 0.01) -> DataFrame:
    """dec's rows of the result's documents for other concepts than those asked for, by entities that don't stand for an asked one in the same document.

    Without concepts (a search by entities only) all rows of the documents from least_score on count.
    """
    rows = dec.where(F.col("score") >= least_score).join(docs.select("doc"), "doc", "left_semi")
    if not concepts:
        return rows
    used = dec.where(F.col("category").isin(concepts)).select("doc", "entity").distinct()
    return rows.where(~F.col("category").isin(concepts)).join(used, ["doc", "entity"], "left_anti")


def subtopics(fresh: DataFrame, stats: DataFrame, least_docs: int = 2) -> DataFrame:
    """category, docs, coverage, n_entities, diversity, specificity, rank_score of the concepts of fresh_rows in at least least_docs documents.

    Only categories with more than one entity both in the graph and in the corpus have a specificity (0 for a null one); the others rank with 0.
    """
    per = fresh.groupBy("category").agg(F.count_distinct("doc").alias("docs"), score_sum().alias("coverage"), F.count_distinct("entity").alias("n_entities"), F.count("*").alias("n")).where(F.col("docs") >= least_docs)
    general = stats.where("kg_count > 1 AND corpus_count > 1").select(F.col("name").alias("category"), F.coalesce("specificity", F.lit(0.0)).alias("specificity"))
    diversity = F.col("n_entities") / F.col("n")
    rank = F.coalesce(F.round(F.col("coverage") + diversity + F.col("specificity"), 6), F.lit(0.0))
    return per.join(general, "category", "left").select("category", "docs", "coverage", "n_entities", F.round(diversity, 6).alias("diversity"), "specificity", rank.alias("rank_score"))


def overlap_groups(ranked: DataFrame, fresh: DataFrame) -> DataFrame:
    """category, group_no: the ranked concepts in their order, each put to the first group that has an entity of it, or to a new one; groups never merge later.

    The pass depends on the order, so it streams through one task, which holds a number for each entity of the result and nothing else.
    """
    codes = fresh.join(ranked.select("category", "rank_score"), "category").select("rank_score", "category", F.xxhash64("entity").alias("entity")).distinct()

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[int, int] = {}
        groups, now = 0, None
        held: list[int] = []

        def placed() -> int:
            nonlocal groups
            at = min((first[e] for e in held if e in first), default=groups + 1)
            groups = max(groups, at)
            for e in held:
                first[e] = min(first.get(e, at), at)
            return at

        for b in batches:
            names, numbers = [], []
            for category, entity in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                if category != now and held:
                    names.append(now)
                    numbers.append(placed())
                    held = []
                now = category
                held.append(entity)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(numbers, pa.int32())], ["category", "group_no"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.string()), pa.array([placed()], pa.int32())], ["category", "group_no"])

    ship(fresh.sparkSession)
    return codes.coalesce(1).sortWithinPartitions(F.desc("rank_score"), "category").mapInArrow(group, "category string, group_no int")


def group_tree(groups: DataFrame, ranked: DataFrame, fresh: DataFrame, kept: int = 4) -> DataFrame:
    """category, branch, rank_score: the largest groups by the sum of their categories, entities and documents (ties: the earlier group), all others as branch kept + 1."""
    rows = fresh.join(groups, "category")
    size = rows.groupBy("group_no").agg((F.count_distinct("category") + F.count_distinct("entity") + F.count_distinct("doc")).alias("size"))
    top = size.orderBy(F.desc("size"), "group_no").limit(kept).withColumn("branch", F.row_number().over(W.orderBy(F.desc("size"), "group_no"))).select("group_no", "branch")
    named = groups.join(ranked.select("category", "rank_score"), "category").join(F.broadcast(top), "group_no", "left")
    return named.select("category", F.coalesce("branch", F.lit(kept + 1)).alias("branch"), "rank_score")


def entity_search(dec: DataFrame, word: str, least_score: float = 0.1) -> DataFrame:
    """entity, n_chars: entities that contain the word, in any case; order by n_chars, entity."""
    hit = dec.where((F.col("entity_score") > least_score) & F.contains(F.lower("entity"), F.lit(word.lower())))
    return hit.select("entity").distinct().withColumn("n_chars", F.char_length("entity"))


def concept_autocomplete(dec: DataFrame, word: str) -> DataFrame:
    """category, n_chars: concepts that begin with the word, in any case."""
    return dec.where(F.startswith(F.lower("category"), F.lit(word.lower()))).select("category").distinct().withColumn("n_chars", F.char_length("category"))


def entity_or_concept(dec: DataFrame, word: str) -> DataFrame:
    """term: entities that contain the word, and concepts that begin with it."""
    w = F.lit(word.lower())
    e = dec.where(F.contains(F.lower("entity"), w)).select(F.col("entity").alias("term"))
    return e.union(dec.where(F.startswith(F.lower("category"), w)).select("category")).distinct()


def by_shared_entities(mentions: DataFrame, entities: list[str], exclude: list[int], limit: int, exclude_first: bool = True) -> DataFrame:
    """doc, shared, entities: documents by the number of the entities they have. exclude_first False cuts before it excludes."""
    per = mentions.where(F.col("entity").isin(entities)).groupBy("doc").agg(F.count_distinct("entity").alias("shared"), F.array_join(F.array_sort(F.collect_set("entity")), "|").alias("entities"))
    gone = ~F.col("doc").isin(exclude) if exclude else F.lit(True)
    top = lambda df: df.orderBy(F.desc("shared"), "doc").limit(limit)
    return top(per.where(gone)) if exclude_first else top(per).where(gone)


def similar_by_entities(mentions: DataFrame, docs: DataFrame, limit: int = 100) -> DataFrame:
    """doc, other, shared, place: for each document of docs the others by the number of shared entities."""
    mine = mentions.join(docs.select("doc"), "doc", "left_semi").select("doc", "entity")
    other = mentions.select(F.col("doc").alias("other"), "entity")
    per = mine.join(other, "entity").where("doc <> other").groupBy("doc", "other").agg(F.count("*").alias("shared"))
    w = W.partitionBy("doc").orderBy(F.desc("shared"), "other")
    return per.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def _product(lists: Column, more: Column) -> Column:
    """Every list with every one of the values put behind it."""
    return F.flatten(F.transform(lists, lambda p: F.transform(more, lambda c: F.concat(p, F.array(c)))))


def similar_by_patterns(dec: DataFrame, wanted: dict[str, str], exclude: list[int], limit: int) -> DataFrame:
    """doc, pattern (the first), n_patterns, n_concepts, pattern_docs, rank_score: documents that cover all wanted concepts by as many different entities.

    wanted: concept to the original entity it replaces. An entity of a document stands for one concept (the largest name); its candidate patterns are the product,
    over the original entities, of the concepts found for them. rank_score is 10 a pattern and 100 a concept of a pattern, less the number of documents
    that have the first pattern too. The documents of exclude are left out before the limit.
    """
    docs = rollup(dec, list(wanted)).where(~F.col("doc").isin(exclude) if exclude else F.lit(True))
    found = matches(dec, docs, list(wanted)).groupBy("doc").agg(F.collect_set("category").alias("found"))
    made = F.array(F.array().cast("array<string>"))
    for original in sorted(set(wanted.values())):
        own = F.array_intersect("found", F.array(*(F.lit(c) for c in sorted(wanted) if wanted[c] == original)))
        made = F.when(F.size(own) > 0, _product(made, own)).otherwise(made)
    keys = found.select("doc", F.array_sort(F.transform(made, lambda p: set_key(p))).alias("patterns"), F.size(made[0]).cast("bigint").alias("n_concepts"))
    each = keys.select("doc", F.explode("patterns").alias("pattern")).groupBy("pattern").agg(F.count("*").alias("pattern_docs"))
    rows = keys.select("doc", F.element_at("patterns", 1).alias("pattern"), F.size("patterns").cast("bigint").alias("n_patterns"), "n_concepts").join(each, "pattern")
    rank = F.col("n_patterns") * 10 + F.col("n_concepts") * 100 - F.col("pattern_docs")
    return rows.withColumn("rank_score", rank).select("doc", "pattern", "n_patterns", "n_concepts", "pattern_docs", "rank_score").orderBy(F.desc("rank_score"), "doc").limit(limit)


def entity_concepts(members: DataFrame, entities: list[str]) -> DataFrame:
    """entity, categories: what the graph says of the entities."""
    return members.where(F.col("entity").isin(entities)).groupBy("entity").agg(F.array_join(F.array_sort(F.collect_set("category")), "|").alias("categories"))


def concept_entities(dec: DataFrame, concepts: list[str]) -> DataFrame:
    """category, entity, n_docs: the corpus' entities of each concept, a row each, so that no concept's extension meets in one row."""
    return dec.where(F.col("category").isin(concepts)).groupBy("category", "entity").agg(F.count("*").alias("n_docs"))


def document_concepts(dec: DataFrame, stats: DataFrame, docs: DataFrame) -> DataFrame:
    """doc, entity, place, category, score, specificity, kg_count: concepts of each entity of a document by their score."""
    rows = dec.join(docs.select("doc").distinct(), "doc", "left_semi").select("doc", "entity", "category", "score")
    s = stats.select(F.col("name").alias("category"), "specificity", "kg_count")
    w = W.partitionBy("doc", "entity").orderBy(F.col("score").desc_nulls_last(), "category")
    return rows.join(s, "category", "left").withColumn("place", F.row_number().over(w))


def by_stored_patterns(stored: DataFrame, dec: DataFrame, doc: int, limit: int) -> DataFrame:
    """other, n_patterns, n_entities: documents that share a stored pattern with a document, by the number of shared patterns. stored: name, categories (array), doc: a row a pattern and document."""
    own = stored.where(F.col("doc") == doc).select("name")
    each = stored.where(F.col("doc") != doc).join(own, "name", "left_semi")
    hits = each.select("name", "doc", F.explode("categories").alias("category")).join(dec.select("doc", "category", "entity"), ["doc", "category"])
    per = hits.groupBy(F.col("doc").alias("other")).agg(F.count_distinct("name").alias("n_patterns"), F.count_distinct("entity").alias("n_entities"))
    return per.orderBy(F.desc("n_patterns"), F.desc("n_entities"), "other").limit(limit)


def explained(docs: DataFrame, dec: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc, category, entity, score: which entities of the documents stand for which wanted concepts (category)."""
    return dec.join(wanted.select("category").distinct(), "category", "left_semi").join(docs.select("doc").distinct(), "doc", "left_semi").select("doc", "category", "entity", "score")
