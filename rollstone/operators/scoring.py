"""Entity TF-IDF, category specificity, relevance totals, concept expansion and corpus TF-IDF."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import drift, is_valid_concept, specificity, squash
from ..work import discard, durable


def entity_tfidf(mentions: DataFrame, tokens: DataFrame, containing: bool = False) -> DataFrame:
    """doc, entity, tfidf = round(tf / tokens * log10(N / df), 3); mentions: doc, entity, one row a mention; tokens: doc, n_tokens.

    N counts the documents of tokens. A document without tokens gets null. containing: tf counts the document's mentions whose id contains
    the entity's key (what follows its last colon), so that an id within another counts for both.
    """
    n = tokens.agg(F.count("*")).first()[0]
    tf = mentions.where("doc IS NOT NULL AND entity IS NOT NULL").groupBy("doc", "entity").agg(F.count("*").alias("tf"))
    df = tf.groupBy("entity").agg(F.count("*").alias("df"))
    if containing:
        other = tf.select("doc", F.col("entity").alias("id"), F.col("tf").alias("times"))
        tf = tf.join(other, "doc").where(F.contains("id", F.substring_index("entity", ":", -1))).groupBy("doc", "entity").agg(F.sum("times").alias("tf"))
    rows = tf.join(df, "entity").join(tokens.select("doc", "n_tokens"), "doc", "left")
    return rows.select("doc", "entity", F.round(F.when(F.col("n_tokens") > 0, F.col("tf") / F.col("n_tokens") * F.log10(F.lit(n) / F.col("df"))), 3).alias("tfidf"))


def category_specificity(members: DataFrame, categories: DataFrame | None = None) -> DataFrame:
    """category, n_entities, specificity; categories (category) without members have 0."""
    whole = members.select("entity").distinct().count()
    per = members.groupBy("category").agg(F.count_distinct("entity").alias("n_entities"))
    if categories is not None:
        per = categories.join(per, "category", "left").withColumn("n_entities", F.coalesce("n_entities", F.lit(0)))
    return per.withColumn("specificity", specificity("n_entities", F.lit(whole)))


def corpus_entity_counts(dec: DataFrame) -> DataFrame:
    return dec.groupBy("category").agg(F.count_distinct("entity").alias("n_entities"), F.count_distinct("doc").alias("n_docs"))


def totals(dec: DataFrame, mentions: DataFrame, spec: DataFrame) -> DataFrame:
    """doc, entity, category, by_concept (entity * concept score), by_specificity (times the category's specificity, three digits); null where a factor is null."""
    rows = dec.join(mentions.select("doc", "entity", "tfidf"), ["doc", "entity"]).join(spec.select("category", F.col("specificity").alias("category_specificity")), "category", "left")
    return rows.select("doc", "entity", "category", F.round(F.col("tfidf") * F.col("concept_score"), 8).alias("by_concept"), F.round(F.col("tfidf") * F.col("concept_score") * F.col("category_specificity"), 3).alias("by_specificity"))


def backfilled(dec: DataFrame, mentions: DataFrame) -> DataFrame:
    """dec's keys with score, filled by tfidf * concept score where it is null and the concept score positive."""
    rows = dec.join(mentions.select("doc", "entity", "tfidf"), ["doc", "entity"], "left")
    fill = F.round(F.col("tfidf") * F.col("concept_score"), 8)
    return rows.select("doc", "entity", "category", F.when(F.col("score").isNull() & (F.col("concept_score") > 0), fill).otherwise(F.col("score")).alias("score"))


def seeds(totals_: DataFrame, dec: DataFrame, known: DataFrame, least_concept: float = 0.5, least_total: float = 0.05) -> DataFrame:
    """name: categories that become one-concept patterns: a triple with enough concept score and total, and no pattern of the name yet."""
    rows = totals_.join(dec.select("doc", "entity", "category", "concept_score"), ["doc", "entity", "category"])
    return rows.where((F.col("concept_score") > least_concept) & (F.col("by_specificity") >= least_total)).select(F.col("category").alias("name")).distinct().join(known.select("name"), "name", "left_anti")


def expand_concepts(dec: DataFrame, mentions: DataFrame, hierarchy: DataFrame, scores: DataFrame, floor: float = 0.03) -> DataFrame:
    """doc, entity, category, concept_score, routes, step: the scored triples (step 0) with the parents they are lifted to.

    dec: doc, entity, category, concept_score; mentions: doc, entity, tfidf; scores: doc, category, concept_score of any concept in any document (none: 0).
    A document's threshold is the mean of tfidf * concept_score over its triples, but at least floor; triples that reach it are lifted to those parents
    that the document hasn't got yet. A new triple's concept score is its own, by scores, times 0.95 to the power of the parent's number of children; it is lifted
    again if that isn't below the score of the triple it came from. The best of several such triples counts (ties: the smallest). A document gets a
    concept in one step only, so cycles end; a document without scored triples isn't expanded. routes: the concepts it was lifted through.
    """
    links = hierarchy.select("name", "parent").distinct()
    links = durable(links.join(links.groupBy("parent").agg(F.count("*").alias("children")), "parent").select(F.col("name").alias("category"), "parent", "children"), "links")
    base = dec.where("concept_score IS NOT NULL").join(mentions.select("doc", "entity", "tfidf"), ["doc", "entity"]).where("tfidf IS NOT NULL")
    scored = base.select("doc", "entity", "category", "concept_score", (F.col("tfidf") * F.col("concept_score")).alias("weight"))
    limit = scored.groupBy("doc").agg(F.greatest(F.avg("weight"), F.lit(floor)).alias("least"))
    kept = ["doc", "entity", "category", "concept_score", "routes"]
    given = scored.withColumn("routes", F.array().cast("array<string>"))
    parts = [given.select(*kept, F.lit(0).alias("step"))]
    front = durable(given.join(limit, "doc").where("weight >= least").select(*kept), "front")
    have = durable(dec.select("doc", "category").distinct(), "have")
    scores = scores.select("doc", "category", F.col("concept_score").alias("own"))
    for step in count(1):
        up = front.join(links, "category").select("doc", "entity", F.col("parent").alias("category"), "children", F.col("concept_score").alias("child_score"), F.array_append("routes", F.col("category")).alias("routes"))
        up = up.join(have, ["doc", "category"], "left_anti").join(scores, ["doc", "category"], "left")
        score = F.round(F.coalesce("own", F.lit(0.0)) * drift("children"), 8)
        best = F.min(F.struct((-F.col("child_score")).alias("m"), "routes"))
        new = up.withColumn("concept_score", score).groupBy("doc", "entity", "category").agg(F.first("concept_score").alias("concept_score"), best.alias("b"))
        new = durable(new.select("doc", "entity", "category", "concept_score", F.col("b.routes").alias("routes"), (-F.col("b.m")).alias("child_score")), "lifted")
        if not new.limit(1).count():
            break
        parts.append(new.select(*kept, F.lit(step).alias("step")))
        grown = durable(have.unionByName(new.select("doc", "category").distinct()), "have")
        discard(have)
        have, front = grown, new.where("concept_score >= child_score").select(*kept)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def member_relevance(mentions: DataFrame, members: DataFrame) -> DataFrame:
    """doc, category, concept_score: the share of a document's entities that the graph has as members of the concept, squashed."""
    per = mentions.select("doc", "entity").distinct()
    size = per.groupBy("doc").agg(F.count("*").alias("n"))
    hits = per.join(members.select("entity", "category").distinct(), "entity").groupBy("doc", "category").agg(F.count("*").alias("k"))
    return hits.join(size, "doc").select("doc", "category", F.round(squash(F.col("k") / F.col("n")), 8).alias("concept_score"))


def linked_triples(mentions: DataFrame, members: DataFrame, ignored_types: list[str] | None = None, ignored_words: list[str] | None = None) -> DataFrame:
    """doc, entity, category from mentions (doc, entity, label): nouns get the graph's valid concepts, or Entity:x if the graph has none; verbs get Action:x.

    An entity that is a noun once in a document is a noun there. Mentions of ignored types and words are left out.
    """
    rows = mentions.where("doc IS NOT NULL AND entity IS NOT NULL")
    rows = rows.where(~F.lower("entity").isin(ignored_words)) if ignored_words else rows
    rows = rows.where(F.col("label").isNull() | ~F.col("label").isin(ignored_types)) if ignored_types else rows
    per = rows.groupBy("doc", "entity").agg(F.min(F.coalesce(F.col("label"), F.lit("")) == "ACTION").alias("verb"))
    nouns = per.where("NOT verb").select("doc", "entity")
    valid = nouns.join(members.where(is_valid_concept("category")), "entity").select("doc", "entity", "category")
    bare = nouns.join(members.select("entity").distinct(), "entity", "left_anti").select("doc", "entity", F.concat(F.lit("Entity:"), "entity").alias("category"))
    verbs = per.where("verb").select("doc", "entity", F.concat(F.lit("Action:"), "entity").alias("category"))
    return valid.unionByName(bare).unionByName(verbs)


def mark_actions(annotated: DataFrame) -> DataFrame:
    """Annotations (doc, tokens array<struct<start,end,lemma,pos>>, ents array<struct<start,end,label,id>>) with ents completed.

    Each ent gets lemma (lemmas of its tokens), label ACTION if one of them is a verb, and offsets (starts of all tokens with one of these lemmas, if the ent has an id).
    """

    def complete(e):
        own = F.filter("tokens", lambda t: (t["start"] >= e["start"]) & (t["end"] <= e["end"]))
        lemma = F.transform(own, lambda t: t["lemma"])
        offsets = F.transform(F.filter("tokens", lambda t: F.array_contains(lemma, t["lemma"])), lambda t: t["start"])
        label = F.when(F.exists(own, lambda t: t["pos"] == "VERB"), "ACTION").otherwise(e["label"])
        return F.struct(e["start"].alias("start"), e["end"].alias("end"), label.alias("label"), e["id"].alias("id"), lemma.alias("lemma"), F.when(e["id"].isNotNull(), offsets).otherwise(F.array().cast("array<int>")).alias("offsets"))

    return annotated.withColumn("ents", F.transform("ents", complete))


def dictionary_mentions(texts: DataFrame, names: DataFrame, most_words: int = 4) -> DataFrame:
    """doc, entity, start: where names (name, entity) of up to most_words words stand in texts (doc, text), whole words in any case.

    An equi-join on word runs; the names are the side that may be broadcast when Spark knows it to be small.
    """
    words = texts.where("text IS NOT NULL").select("doc", F.filter(F.split(F.lower("text"), "[^\\p{L}\\p{N}]+"), lambda w: w != "").alias("w"))
    runs = None
    for k in range(1, most_words + 1):
        r = words.where(F.size("w") >= k).select("doc", "w", F.explode(F.sequence(F.lit(1), F.size("w") - k + 1)).alias("start")).select("doc", "start", F.array_join(F.slice("w", F.col("start"), k), " ").alias("run"))
        runs = r if runs is None else runs.unionByName(r)
    keys = names.select("entity", F.array_join(F.filter(F.split(F.lower("name"), "[^\\p{L}\\p{N}]+"), lambda w: w != ""), " ").alias("run")).where("run <> ''").distinct()
    return runs.join(keys, "run").select("doc", "entity", "start")


def corpus_tfidf(texts: DataFrame, stop_words: list[str], most_terms: int = 500_000) -> DataFrame:
    """doc, term, weight: tf * (ln((1 + N) / (1 + df)) + 1), divided by the document's norm; terms of two letters or digits at least, lower case.

    The vocabulary is the most_terms most frequent terms (ties by the term), stop words left out; it is a feature of the operator.
    """
    words = texts.where("text IS NOT NULL").select("doc", F.explode(F.split(F.lower("text"), "[^\\p{L}\\p{N}_]+")).alias("term")).where(F.char_length("term") > 1)
    words = words.where(~F.col("term").isin(stop_words)) if stop_words else words
    n = texts.count()
    tf = durable(words.groupBy("doc", "term").agg(F.count("*").alias("tf")), "tf")
    df = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    if df.count() > most_terms:
        df = df.orderBy(F.desc("cf"), "term").limit(most_terms)
    raw = tf.join(df, "term").select("doc", "term", (F.col("tf") * (F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1)).alias("w"))
    norm = raw.groupBy("doc").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "doc").select("doc", "term", F.round(F.col("w") / F.col("norm"), 6).alias("weight"))


def derived_types(alias: DataFrame, own_name_from: int = 1000) -> DataFrame:
    """template, derived: the most frequent hypernym of each template (ties: the smallest); templates of so many rows keep their own name. alias: template, hypernym."""
    per = alias.where("template IS NOT NULL AND hypernym IS NOT NULL").groupBy("template", "hypernym").agg(F.count("*").alias("n"))
    best = per.groupBy("template").agg(F.sum("n").alias("rows"), F.max("n").alias("most"))
    top = per.join(best, "template").where("n = most").groupBy("template").agg(F.min("hypernym").alias("hypernym"), F.max("rows").alias("rows"))
    return top.select("template", F.when(F.col("rows") >= own_name_from, F.col("template")).otherwise(F.col("hypernym")).alias("derived"))


def peer_counts(triples: DataFrame) -> DataFrame:
    """predicate, object, peers: other subjects with the same fact. triples: subject, predicate, object."""
    return triples.groupBy("predicate", "object").agg((F.count_distinct("subject") - 1).alias("peers"))


def object_counts(triples: DataFrame) -> DataFrame:
    """subject, predicate, others: further objects of the same subject and predicate. triples: subject, predicate, object."""
    return triples.groupBy("subject", "predicate").agg((F.count_distinct("object") - 1).alias("others"))


def frequent_predicates(triples: DataFrame, least: int = 10_000) -> DataFrame:
    """predicate, n of the predicates with more than least rows."""
    return triples.groupBy("predicate").agg(F.count("*").alias("n")).where(F.col("n") > least)


def term_weights(weights: DataFrame, entities: DataFrame) -> DataFrame:
    """doc, entity, weight, found_by: each entity's weight in its document by the corpus TF-IDF, by the first of four ways that finds a term.

    weights: doc, term, weight; entities: doc, entity, lemma, surface. The ways are the lemma, the surface form, the id without its prefix, and the id's
    words, of which the one with the greatest weight counts (ties: the smallest). Without any, weight 0 and found_by null.
    """
    form = lambda c: F.lower(F.trim(c))
    name = F.replace(F.substring_index("entity", ":", -1), F.lit("_"), F.lit(" "))
    words = F.filter(F.split(F.lower(name), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    ways = F.concat(F.array(*(F.struct(F.lit(i).alias("way"), form(c).alias("term")) for i, c in enumerate((F.col("lemma"), F.col("surface"), name), 1))), F.transform(words, lambda w: F.struct(F.lit(4).alias("way"), w.alias("term"))))
    rows = entities.select("doc", "entity", "lemma", "surface").distinct()
    hits = rows.select("doc", "entity", F.explode(ways).alias("w")).select("doc", "entity", "w.way", "w.term").join(weights, ["doc", "term"])
    best = hits.groupBy("doc", "entity").agg(F.min(F.struct("way", (-F.col("weight")).alias("down"), "term")).alias("b"))
    named = F.element_at(F.array(*map(F.lit, ("lemma", "surface", "id", "words"))), F.col("b.way"))
    return rows.select("doc", "entity").distinct().join(best, ["doc", "entity"], "left").select("doc", "entity", F.coalesce(-F.col("b.down"), F.lit(0.0)).alias("weight"), F.when(F.col("b").isNotNull(), named).alias("found_by"))
