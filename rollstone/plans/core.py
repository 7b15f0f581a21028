"""Queries over the views, each with SQL that DuckDB runs on the same files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import evaluation, graph, patterns, scoring, search, upsert
from ..operators.components import components
from ..work import durable, table
from .registry import QUERIES, SQL
from .views import dec, documents, hierarchy, members, mentions, sql, stats, top_concepts, top_entities


def query(text: str | None, recursive: bool = False) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if text is not None:
            SQL[f.__name__] = sql(text, recursive)
        return f

    return add


ROLLUP = """,
result AS (SELECT doc, count(DISTINCT category) AS n_categories, count(DISTINCT entity) AS n_entities, round(coalesce(sum(score), 0), 6) AS score FROM dec WHERE category IN (FROM concepts) GROUP BY doc
HAVING count(DISTINCT category) = (SELECT count(*) FROM concepts) AND count(DISTINCT entity) >= (SELECT count(*) FROM concepts))"""


def _result(s, d):
    t = dec(s, d)
    concepts = top_concepts(t)
    return t, concepts, search.rollup(t, concepts)


# --- roll-up and what goes with it


@query(ROLLUP + " SELECT * FROM result")
def rollup_all_match(s, d):
    return _result(s, d)[2]


@query(", result AS (SELECT doc, count(DISTINCT entity) AS n_entities FROM dec WHERE entity IN (FROM entities) GROUP BY doc) SELECT * FROM result")
def rollup_any_entity(s, d):
    return search.rollup_entities(dec(s, d), top_entities(mentions(s, d)))


@query(ROLLUP + ", p AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc) AS position FROM result) SELECT doc, n_categories, n_entities, score, CAST(position AS INTEGER) AS position FROM p WHERE position BETWEEN 11 AND 20")
def rollup_page(s, d):
    return search.page(_result(s, d)[2], [F.desc("score"), F.col("doc")], 2, 10)


@query(ROLLUP + """, one AS (SELECT doc, entity, max(category) AS category FROM dec WHERE category IN (FROM concepts) AND doc IN (SELECT doc FROM result) GROUP BY doc, entity)
SELECT doc, category, string_agg(entity, '|' ORDER BY entity) AS entities FROM one GROUP BY doc, category""")
def rollup_matches(s, d):
    t, concepts, docs = _result(s, d)
    return search.matches(t, docs, concepts)


@query(ROLLUP + """, j AS (SELECT r.doc, sentiment FROM result r LEFT JOIN documents_ USING (doc))
SELECT count(*) AS total, count(*) FILTER (sentiment > 0) AS positive, count(*) FILTER (sentiment < 0) AS negative, count(*) - count(*) FILTER (sentiment > 0) - count(*) FILTER (sentiment < 0) AS neutral FROM j""")
def sentiment_histogram(s, d):
    return search.sentiment_histogram(_result(s, d)[2], documents(s, d))


@query(ROLLUP + " SELECT source, count(*) AS docs, round(sum(score), 6) AS score FROM result JOIN documents_ USING (doc) WHERE published < TIMESTAMP '2023-01-01' GROUP BY source")
def rollup_by_source(s, d):
    docs = documents(s, d).where("published < TIMESTAMP_NTZ '2023-01-01'")
    return _result(s, d)[2].join(docs, "doc").groupBy("source").agg(F.count("*").alias("docs"), F.round(F.sum("score"), 6).alias("score"))


FRESH = """, used AS (SELECT DISTINCT doc, entity FROM dec WHERE category IN (FROM concepts)),
fresh AS (SELECT * FROM dec WHERE score >= 0.01 AND category NOT IN (FROM concepts) AND doc IN (SELECT doc FROM result) AND NOT EXISTS (FROM used u WHERE u.doc = dec.doc AND u.entity = dec.entity))"""
RANKED = """, per AS (SELECT category, count(DISTINCT doc) AS docs, round(coalesce(sum(score), 0), 6) AS coverage, count(DISTINCT entity) AS n_entities, count(*) AS n FROM fresh GROUP BY category HAVING count(DISTINCT doc) >= 2),
general AS (SELECT name, coalesce(specificity, 0) AS specificity FROM stats WHERE kg_count > 1 AND corpus_count > 1),
ranked AS (SELECT category, docs, coverage, n_entities, round(n_entities / n, 6) AS diversity, specificity, coalesce(round(coverage + n_entities / n + specificity, 6), 0) AS rank_score FROM per LEFT JOIN general ON name = category)"""
# the greedy pass as one fold over the ranked lists of entities: g holds the groups' entities, a the group of each concept so far
TREE = """, lists AS (SELECT category, rank_score, list(DISTINCT entity) AS e FROM fresh JOIN ranked USING (category) GROUP BY ALL),
steps AS (SELECT list({'g': [e], 'a': [category], 'n': NULL::INTEGER[]} ORDER BY rank_score DESC, category) AS l FROM lists),
folded AS (SELECT list_reduce(l, lambda acc, x: CASE WHEN list_position(list_transform(acc.g, lambda y: list_has_any(y, x.g[1])), true) IS NULL
THEN {'g': list_append(acc.g, x.g[1]), 'a': list_append(acc.a, x.a[1]), 'n': list_append(acc.n, CAST(len(acc.g) + 1 AS INTEGER))}
ELSE {'g': list_transform(acc.g, lambda y, i: CASE WHEN i = list_position(list_transform(acc.g, lambda z: list_has_any(z, x.g[1])), true) THEN list_distinct(list_concat(y, x.g[1])) ELSE y END),
'a': list_append(acc.a, x.a[1]), 'n': list_append(acc.n, CAST(list_position(list_transform(acc.g, lambda z: list_has_any(z, x.g[1])), true) AS INTEGER))} END,
{'g': []::VARCHAR[][], 'a': []::VARCHAR[], 'n': []::INTEGER[]}) AS f FROM steps),
groups AS (SELECT unnest(f.a) AS category, unnest(f.n) AS group_no FROM folded),
sized AS (SELECT group_no, count(DISTINCT category) + count(DISTINCT entity) + count(DISTINCT doc) AS size FROM fresh JOIN groups USING (category) GROUP BY group_no),
placed AS (SELECT group_no, row_number() OVER (ORDER BY size DESC, group_no) AS place FROM sized)"""


def _fresh(s, d):
    t, concepts, docs = _result(s, d)
    return search.fresh_rows(t, durable(docs.select("doc"), "result"), concepts)


@query(ROLLUP + FRESH + RANKED + " SELECT * FROM ranked")
def drilldown_subtopics(s, d):
    return search.subtopics(_fresh(s, d), stats(s, d))


@query(ROLLUP + FRESH + RANKED + TREE + " SELECT category, CAST(CASE WHEN place <= 4 THEN place ELSE 5 END AS INTEGER) AS branch, rank_score FROM groups JOIN placed USING (group_no) JOIN ranked USING (category)")
def drilldown_tree(s, d):
    fresh = durable(_fresh(s, d), "fresh")
    ranked = durable(search.subtopics(fresh, stats(s, d)), "ranked")
    return search.group_tree(durable(search.overlap_groups(ranked, fresh), "groups"), ranked, fresh)


@query(", result AS (SELECT DISTINCT doc FROM dec WHERE entity IN (FROM entities)), fresh AS (SELECT * FROM dec WHERE score >= 0.01 AND doc IN (SELECT doc FROM result))" + RANKED + " SELECT * FROM ranked")
def drilldown_by_entities(s, d):
    """The branch of a search by entities only: all rows of its documents count."""
    t = dec(s, d)
    return search.subtopics(search.fresh_rows(t, search.rollup_entities(t, top_entities(mentions(s, d))), []), stats(s, d))


@query(", r AS (SELECT DISTINCT entity FROM dec WHERE entity_score > 0.1 AND contains(lower(entity), 'bank')) SELECT entity, CAST(length(entity) AS INTEGER) AS n_chars FROM r")
def entity_search(s, d):
    return search.entity_search(dec(s, d), "Bank")


@query(", r AS (SELECT DISTINCT category FROM dec WHERE starts_with(lower(category), 'category:re')) SELECT category, CAST(length(category) AS INTEGER) AS n_chars FROM r ORDER BY n_chars, category LIMIT 20")
def concept_autocomplete(s, d):
    return search.concept_autocomplete(dec(s, d), "category:Re").orderBy("n_chars", "category").limit(20)


@query(" SELECT entity AS term FROM dec WHERE contains(lower(entity), 'tariff') UNION SELECT category FROM dec WHERE starts_with(lower(category), 'tariff')")
def entity_or_concept_search(s, d):
    return search.entity_or_concept(dec(s, d), "Tariff")


@query(" SELECT doc, count(DISTINCT entity) AS shared, string_agg(DISTINCT entity, '|' ORDER BY entity) AS entities FROM mentions WHERE entity IN (FROM entities) AND doc NOT IN (1, 2, 3) GROUP BY doc ORDER BY shared DESC, doc LIMIT 50")
def docs_by_shared_entities(s, d):
    t = mentions(s, d)
    return search.by_shared_entities(t, top_entities(t), [1, 2, 3], 50)


@query(", top AS (SELECT doc, count(DISTINCT entity) AS shared, string_agg(DISTINCT entity, '|' ORDER BY entity) AS entities FROM mentions WHERE entity IN (FROM entities) GROUP BY doc ORDER BY shared DESC, doc LIMIT 50) SELECT * FROM top WHERE doc % 7 <> 0")
def docs_by_shared_entities_cut_first(s, d):
    t = mentions(s, d)
    return search.by_shared_entities(t, top_entities(t), [], 50).where("doc % 7 <> 0")


SOME_DOCS = ", chosen AS (SELECT doc FROM documents_ WHERE doc % 100 = 0)"


def _some(s, d):
    """A stated set of query documents, against all others."""
    return documents(s, d).where("doc % 100 = 0").select("doc")


@query(SOME_DOCS + """, per AS (SELECT a.doc, b.doc AS other, count(*) AS shared FROM mentions a JOIN mentions b USING (entity) WHERE a.doc IN (FROM chosen) AND a.doc <> b.doc GROUP BY a.doc, b.doc)
SELECT doc, other, shared, CAST(row_number() OVER w AS INTEGER) AS place FROM per WINDOW w AS (PARTITION BY doc ORDER BY shared DESC, other) QUALIFY row_number() OVER w <= 10""")
def similar_docs_by_entities(s, d):
    return search.similar_by_entities(mentions(s, d), _some(s, d), 10)


WANTED = """, three AS (SELECT category, row_number() OVER (ORDER BY count(*) DESC, category) AS i FROM dec GROUP BY category QUALIFY i <= 3), pair AS (SELECT min(entity) AS e1, max(entity) AS e2 FROM (SELECT entity FROM entities LIMIT 2)),
wanted AS (SELECT category, CASE WHEN i < 3 THEN 'first' ELSE 'second' END AS original FROM three),
result AS (SELECT doc FROM dec WHERE category IN (SELECT category FROM wanted) GROUP BY doc HAVING count(DISTINCT category) = 3 AND count(DISTINCT entity) >= 3)"""


@query(WANTED + """, one AS (SELECT doc, entity, max(category) AS category FROM dec WHERE category IN (SELECT category FROM wanted) AND doc IN (SELECT doc FROM result) AND doc NOT IN (4, 9) GROUP BY doc, entity),
found AS (SELECT DISTINCT doc, category, original FROM one JOIN wanted USING (category)),
a AS (SELECT doc, category FROM found WHERE original = 'first'), b AS (SELECT doc, category FROM found WHERE original = 'second'),
p AS (SELECT doc, array_to_string(list_sort([x for x in [a.category, b.category] if x IS NOT NULL]), ',') AS pattern, CASE WHEN a.category IS NULL OR b.category IS NULL THEN 1 ELSE 2 END AS k FROM a FULL JOIN b USING (doc)),
n AS (SELECT pattern, count(*) AS pattern_docs FROM p GROUP BY pattern), q AS (SELECT doc, min(pattern) AS pattern, count(*) AS n_patterns, CAST(max(k) AS BIGINT) AS n_concepts FROM p GROUP BY doc)
SELECT doc, pattern, n_patterns, n_concepts, pattern_docs, n_patterns * 10 + n_concepts * 100 - pattern_docs AS rank_score FROM q JOIN n USING (pattern) ORDER BY rank_score DESC, doc LIMIT 20""")
def similar_docs_by_patterns(s, d):
    t = dec(s, d)
    concepts = top_concepts(t, 3)
    return search.similar_by_patterns(t, dict(zip(concepts, ("first", "first", "second"))), [4, 9], 20)


@query(""", strong AS (SELECT DISTINCT doc, entity, category FROM dec WHERE score >= 0.5), per AS (SELECT category AS name, doc FROM strong GROUP BY ALL), mine AS (SELECT name FROM per WHERE doc = (SELECT min(doc) FROM per)),
hits AS (SELECT p.doc AS other, p.name, d.entity FROM per p JOIN mine USING (name) JOIN dec d ON d.doc = p.doc AND d.category = p.name WHERE p.doc <> (SELECT min(doc) FROM per))
SELECT other, count(DISTINCT name) AS n_patterns, count(DISTINCT entity) AS n_entities FROM hits GROUP BY other ORDER BY n_patterns DESC, n_entities DESC, other LIMIT 30""")
def similar_docs_by_stored_patterns(s, d):
    t, p, cov = _single(s, d)
    stored = cov.join(p, "name").select("name", "categories", "doc")
    first = stored.agg(F.min("doc")).first()[0]
    return search.by_stored_patterns(stored, t, first, 30)


@query(" SELECT entity, string_agg(category, '|' ORDER BY category) AS categories FROM members WHERE entity IN (FROM entities) GROUP BY entity")
def entity_concepts(s, d):
    return search.entity_concepts(members(s, d), top_entities(mentions(s, d)))


@query(" SELECT category, entity, count(*) AS n_docs FROM dec WHERE category IN (FROM concepts) GROUP BY ALL")
def concept_entities(s, d):
    t = dec(s, d)
    return search.concept_entities(t, top_concepts(t))


@query(SOME_DOCS + " SELECT doc, entity, category, score, s.specificity, coalesce(kg_count, 0) AS kg_count, CAST(row_number() OVER (PARTITION BY doc, entity ORDER BY score DESC NULLS LAST, category) AS INTEGER) AS place FROM dec LEFT JOIN stats s ON name = category WHERE doc IN (FROM chosen)")
def document_concepts(s, d):
    return search.document_concepts(dec(s, d), stats(s, d), _some(s, d)).withColumn("kg_count", F.coalesce("kg_count", F.lit(0)))


@query(" SELECT m.doc, m.entity, entity_type, tfidf, coalesce(n_categories, 0) AS n_categories FROM mentions m LEFT JOIN (SELECT entity, count(*) AS n_categories FROM members GROUP BY entity) USING (entity) WHERE m.doc % 100 = 0")
def document_entities(s, d):
    per = members(s, d).groupBy("entity").agg(F.count("*").alias("n_categories"))
    return mentions(s, d).where("doc % 100 = 0").join(per, "entity", "left").withColumn("n_categories", F.coalesce("n_categories", F.lit(0)))


# --- predicates, sets, aggregates, sorting


@query(" SELECT doc, state, sentiment FROM documents_ WHERE (sentiment >= 0.2 AND sentiment < 0.4) OR (state IS NULL AND source = 'brenegate_wire')")
def range_and_null_filter(s, d):
    return documents(s, d).where(((F.col("sentiment") >= 0.2) & (F.col("sentiment") < 0.4)) | (F.col("state").isNull() & (F.col("source") == "brenegate_wire"))).select("doc", "state", "sentiment")


@query(" SELECT doc, source FROM documents_ WHERE source IS NULL OR source NOT IN ('brenegate_wire', 'marneholm_post')")
def not_in_keeps_null(s, d):
    return documents(s, d).where(F.col("source").isNull() | ~F.col("source").isin("brenegate_wire", "marneholm_post")).select("doc", "source")


@query(" SELECT doc, title, contains(lower(text), 'prices for') AS hit, regexp_matches(title, '[0-9]') AS digits FROM documents_ WHERE title IS NOT NULL AND text IS NOT NULL")
def contains_and_regex(s, d):
    return documents(s, d).where("title IS NOT NULL AND text IS NOT NULL").select("doc", "title", C.contains_any("text", ["Prices for"]).alias("hit"), F.col("title").rlike("[0-9]").alias("digits"))


@query(" SELECT doc FROM documents_ WHERE title IS NULL OR NOT (contains(lower(title), 'price') OR contains(lower(title), 'market'))")
def without_blacklisted_titles(s, d):
    return documents(s, d).where(~F.coalesce(C.contains_any("title", ["Price", "Market"]), F.lit(False))).select("doc")


@query(" SELECT DISTINCT source FROM documents_ WHERE source IS NOT NULL")
def distinct_sources(s, d):
    return documents(s, d).select("source").where("source IS NOT NULL").distinct()


@query(" SELECT category, " + " AND ".join([f"NOT contains(category, '{x}')" for x in C.INVALID] + [f"NOT contains(lower(category), '{x}')" for x in C.INVALID_ANY_CASE]) + " AS valid FROM (SELECT DISTINCT category FROM dec)")
def concept_validity(s, d):
    return dec(s, d).select("category").distinct().withColumn("valid", C.is_valid_concept("category"))


@query(" SELECT d.category, count(*) AS routes FROM (SELECT news_analytics, entity, trim(regexp_replace(category, '[ \\t_]+', '_', 'g'), '_') AS category, unnest(expansion_routes) AS route FROM document_entity_category) d WHERE d.category <> '' AND route IS NOT NULL GROUP BY d.category")
def unwound_routes(s, d):
    from ..work import name_form

    t = table(s, d, "document_entity_category").select(name_form("category").alias("category"), F.explode("expansion_routes").alias("route"))
    return t.where("category IS NOT NULL AND route IS NOT NULL").groupBy("category").agg(F.count("*").alias("routes"))


@query(" SELECT doc, list_has_all(l, ['GPE', 'ORG']) AS has_all, list_has_any(l, ['PERSON']) AS has_any, CAST(len(l) AS INTEGER) AS n FROM (SELECT doc, list_distinct(list(entity_type)) AS l FROM mentions GROUP BY doc)")
def array_predicates(s, d):
    per = mentions(s, d).groupBy("doc").agg(F.collect_set("entity_type").alias("l"))
    return per.select("doc", (F.size(F.array_except(F.array(F.lit("GPE"), F.lit("ORG")), "l")) == 0).alias("has_all"), F.arrays_overlap("l", F.array(F.lit("PERSON"))).alias("has_any"), F.size("l").alias("n"))


@query(" SELECT category, count(DISTINCT entity) AS n_entities, count(DISTINCT doc) AS n_docs FROM dec GROUP BY category")
def corpus_entity_count(s, d):
    return scoring.corpus_entity_counts(dec(s, d))


@query(" SELECT category, count(DISTINCT doc) AS docs, count(DISTINCT entity) AS entities, round(coalesce(sum(score), 0), 6) AS score, max(score) AS best FROM dec GROUP BY category HAVING count(DISTINCT doc) >= 3")
def category_summary(s, d):
    return dec(s, d).groupBy("category").agg(F.count_distinct("doc").alias("docs"), F.count_distinct("entity").alias("entities"), search.score_sum().alias("score"), F.max("score").alias("best")).where("docs >= 3")


@query(" SELECT state, count(*) AS n, count(*) FILTER (sentiment > 0) AS positive, round(sum(sentiment), 4) AS total FROM documents_ GROUP BY state")
def state_counts(s, d):
    return documents(s, d).groupBy("state").agg(F.count("*").alias("n"), F.count_if(F.col("sentiment") > 0).alias("positive"), F.round(F.sum("sentiment"), 4).alias("total"))


@query(""", per AS (SELECT entity, entity_type, count(*) AS n FROM mentions WHERE entity_type IS NOT NULL GROUP BY ALL)
SELECT entity, entity_type, n, CASE WHEN row_number() OVER (ORDER BY n DESC, entity, entity_type) <= 4 THEN entity ELSE 'Others' END AS bucket FROM per""")
def top_groups_and_others(s, d):
    per = mentions(s, d).where("entity_type IS NOT NULL").groupBy("entity", "entity_type").agg(F.count("*").alias("n"))
    top = per.orderBy(F.desc("n"), "entity", "entity_type").limit(4).select("entity", "entity_type", F.col("entity").alias("bucket"))
    return per.join(F.broadcast(top), ["entity", "entity_type"], "left").withColumn("bucket", F.coalesce("bucket", F.lit("Others")))


@query(" SELECT doc, entity, category, score FROM dec WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc, entity ORDER BY score DESC, category) = 1")
def top_concept_per_entity(s, d):
    per = dec(s, d).where("score IS NOT NULL").groupBy("doc", "entity").agg(F.min(F.struct((-F.col("score")).alias("m"), "category")).alias("t"))
    return per.select("doc", "entity", "t.category", (-F.col("t.m")).alias("score"))


@query(" SELECT entity FROM mentions WHERE entity_type = 'ORG' INTERSECT SELECT entity FROM members")
def set_intersection(s, d):
    return mentions(s, d).where("entity_type = 'ORG'").select("entity").intersect(members(s, d).select("entity"))


@query(" SELECT entity FROM mentions EXCEPT SELECT entity FROM members")
def set_difference(s, d):
    return mentions(s, d).select("entity").distinct().join(members(s, d).select("entity").distinct(), "entity", "left_anti")


@query(" SELECT category AS name FROM members UNION SELECT name FROM hierarchy UNION SELECT parent FROM hierarchy")
def set_union(s, d):
    h = hierarchy(s, d)
    return members(s, d).select(F.col("category").alias("name")).union(h.select("name")).union(h.select("parent")).distinct()


@query(" SELECT name, parent, count(*) OVER (PARTITION BY parent) - 1 AS siblings FROM hierarchy")
def siblings(s, d):
    """Every link with the number of its parent's other children: a row a link, however many children a parent has."""
    h = hierarchy(s, d)
    return h.join(h.groupBy("parent").agg((F.count("*") - 1).alias("siblings")), "parent").select("name", "parent", "siblings")


# --- scores


@query(""", tokens AS (SELECT doc, CAST(len(list_filter(regexp_split_to_array(text, '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS INTEGER) AS n_tokens FROM documents_ WHERE text IS NOT NULL),
hits AS (SELECT news_analytics AS doc, entity FROM document_entity WHERE news_analytics IS NOT NULL AND entity IS NOT NULL),
tf AS (SELECT doc, entity, count(*) AS tf FROM hits GROUP BY ALL), df AS (SELECT entity, count(*) AS df FROM tf GROUP BY entity)
SELECT doc, entity, CASE WHEN n_tokens > 0 THEN round(tf / n_tokens * log10((SELECT count(*) FROM tokens) / df), 3) END AS tfidf FROM tf JOIN df USING (entity) LEFT JOIN tokens USING (doc)""")
def entity_tfidf(s, d):
    words = F.size(F.filter(F.split("text", "[^\\p{L}\\p{N}]+"), lambda w: w != ""))
    tokens = documents(s, d).where("text IS NOT NULL").select("doc", words.alias("n_tokens"))
    hits = table(s, d, "document_entity").select(F.col("news_analytics").alias("doc"), "entity")
    return scoring.entity_tfidf(hits, tokens)


@query(" SELECT category, count(DISTINCT entity) AS n_entities, CASE WHEN count(DISTINCT entity) = 0 THEN 0.0 ELSE round(-log10(count(DISTINCT entity) / (SELECT count(DISTINCT entity) FROM members)), 3) END AS specificity FROM members GROUP BY category")
def category_specificity(s, d):
    return scoring.category_specificity(members(s, d))


@query(""", tokens AS (SELECT doc, CAST(len(list_filter(regexp_split_to_array(text, '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS INTEGER) AS n_tokens FROM documents_ WHERE text IS NOT NULL),
one AS (SELECT news_analytics AS doc, entity, count(*) AS n FROM document_entity WHERE news_analytics IS NOT NULL AND entity IS NOT NULL GROUP BY ALL),
tf AS (SELECT a.doc, a.entity, sum(b.n) AS tf FROM one a JOIN one b ON a.doc = b.doc AND contains(b.entity, split_part(a.entity, ':', -1)) GROUP BY ALL), df AS (SELECT entity, count(*) AS df FROM one GROUP BY entity)
SELECT doc, entity, CASE WHEN n_tokens > 0 THEN round(tf / n_tokens * log10((SELECT count(*) FROM tokens) / df), 3) END AS tfidf FROM tf JOIN df USING (entity) LEFT JOIN tokens USING (doc)""")
def entity_tfidf_containing(s, d):
    words = F.size(F.filter(F.split("text", "[^\\p{L}\\p{N}]+"), lambda w: w != ""))
    tokens = documents(s, d).where("text IS NOT NULL").select("doc", words.alias("n_tokens"))
    return scoring.entity_tfidf(table(s, d, "document_entity").select(F.col("news_analytics").alias("doc"), "entity"), tokens, True)


TOTALS = """, spec AS (SELECT category, round(-log10(count(DISTINCT entity) / (SELECT count(DISTINCT entity) FROM members)), 3) AS cs FROM members GROUP BY category),
totals AS (SELECT doc, entity, category, concept_score, round(tfidf * concept_score, 8) AS by_concept, round(tfidf * concept_score * cs, 3) AS by_specificity FROM dec JOIN mentions USING (doc, entity) LEFT JOIN spec USING (category))"""


def _totals(s, d):
    return scoring.totals(dec(s, d), mentions(s, d), scoring.category_specificity(members(s, d)))


@query(TOTALS + " SELECT doc, entity, category, by_concept, by_specificity FROM totals")
def total_scores(s, d):
    return _totals(s, d)


@query(" SELECT doc, entity, category, CASE WHEN score IS NULL AND concept_score > 0 THEN round(tfidf * concept_score, 8) ELSE score END AS score FROM dec LEFT JOIN mentions USING (doc, entity)")
def backfilled_scores(s, d):
    return scoring.backfilled(dec(s, d), mentions(s, d))


@query(TOTALS + " SELECT DISTINCT category AS name FROM totals WHERE concept_score > 0.5 AND by_specificity >= 0.05 AND category NOT IN (SELECT name FROM stats)")
def seed_patterns(s, d):
    return scoring.seeds(_totals(s, d), dec(s, d), stats(s, d))


def _steps(n: int) -> str:
    """n steps of lifting; the walk itself goes on until a step is empty."""
    out = """, links AS MATERIALIZED (SELECT name, parent, count(*) OVER (PARTITION BY parent) AS children FROM hierarchy),
rel AS MATERIALIZED (SELECT doc, category, round(1 - 1 / (1 + count(DISTINCT m.entity) / any_value(n)), 8) AS own FROM mentions m JOIN members USING (entity) JOIN (SELECT doc, count(*) AS n FROM mentions GROUP BY doc) USING (doc) GROUP BY doc, category),
scored AS MATERIALIZED (SELECT doc, entity, category, concept_score, tfidf * concept_score AS weight FROM dec JOIN mentions USING (doc, entity) WHERE concept_score IS NOT NULL AND tfidf IS NOT NULL),
least AS (SELECT doc, greatest(avg(weight), 0.03) AS least FROM scored GROUP BY doc), have0 AS MATERIALIZED (SELECT DISTINCT doc, category FROM dec),
front0 AS MATERIALIZED (SELECT doc, entity, category, concept_score, 0 AS n_routes FROM scored JOIN least USING (doc) WHERE weight >= least)"""
    for k in range(1, n + 1):
        out += f""",
up{k} AS (SELECT f.doc, f.entity, l.parent AS category, concept_score AS child_score, n_routes + 1 AS n_routes, round(coalesce(own, 0) * pow(0.95, children), 8) AS score FROM front{k - 1} f JOIN links l ON l.name = f.category LEFT JOIN rel r ON r.doc = f.doc AND r.category = l.parent WHERE (f.doc, l.parent) NOT IN (FROM have{k - 1})),
new{k} AS MATERIALIZED (SELECT doc, entity, category, any_value(score) AS concept_score, max(child_score) AS child_score, max(n_routes) AS n_routes FROM up{k} GROUP BY ALL), have{k} AS MATERIALIZED (FROM have{k - 1} UNION SELECT doc, category FROM new{k}),
front{k} AS MATERIALIZED (SELECT doc, entity, category, concept_score, n_routes FROM new{k} WHERE concept_score >= child_score)"""
    rows = " UNION ALL ".join(f"SELECT doc, entity, category, concept_score, n_routes, {k} AS step FROM new{k}" for k in range(1, n + 1))
    return f"{out} SELECT doc, entity, category, concept_score, 0 AS n_routes, 0 AS step FROM scored UNION ALL {rows}"


@query(_steps(6))
def expanded_concepts(s, d):
    m = mentions(s, d)
    out = scoring.expand_concepts(dec(s, d), m, hierarchy(s, d), durable(scoring.member_relevance(m, members(s, d)), "relevance"))
    return out.select("doc", "entity", "category", "concept_score", F.size("routes").alias("n_routes"), "step")


@query(""", per AS (SELECT news_analytics AS doc, entity, min(CASE WHEN entity_type = 'ACTION' THEN 1 ELSE 0 END) AS verb FROM document_entity WHERE news_analytics IS NOT NULL AND entity IS NOT NULL AND (entity_type IS NULL OR entity_type NOT IN ('DATE', 'TIME')) GROUP BY ALL)
SELECT doc, entity, category FROM per JOIN members USING (entity) WHERE verb = 0 AND """ + " AND ".join([f"NOT contains(category, '{x}')" for x in C.INVALID] + [f"NOT contains(lower(category), '{x}')" for x in C.INVALID_ANY_CASE]) + """
UNION ALL SELECT doc, entity, 'Entity:' || entity FROM per WHERE verb = 0 AND entity NOT IN (SELECT entity FROM members)
UNION ALL SELECT doc, entity, 'Action:' || entity FROM per WHERE verb = 1""")
def linked_triples(s, d):
    hits = table(s, d, "document_entity").select(F.col("news_analytics").alias("doc"), "entity", F.col("entity_type").alias("label"))
    return scoring.linked_triples(hits, members(s, d), ["DATE", "TIME"])


@query(""", t AS (SELECT id AS doc, max(text) AS text FROM news_analytics WHERE id IS NOT NULL GROUP BY id), w AS (SELECT doc, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+')) AS term FROM t WHERE text IS NOT NULL),
tf AS (SELECT doc, term, count(*) AS tf FROM w WHERE length(term) > 1 AND term NOT IN ('the', 'a', 'of', 'and', 'to', 'in') GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
raw AS (SELECT doc, term, tf * (ln((1.0 + (SELECT count(*) FROM t)) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term)), norm AS (SELECT doc, sqrt(sum(w * w)) AS norm FROM raw GROUP BY doc)
SELECT doc, term, round(w / norm, 6) AS weight FROM raw JOIN norm USING (doc)""")
def corpus_tfidf(s, d):
    t = table(s, d, "news_analytics").where("id IS NOT NULL").groupBy("id").agg(F.max("text").alias("text"))
    return scoring.corpus_tfidf(t.select(F.col("id").alias("doc"), "text"), ["the", "a", "of", "and", "to", "in"])


# --- patterns


SEEDS = """, covered AS (SELECT category AS name, doc, round(sum(score), 6) AS score FROM dec WHERE score >= 0.5 GROUP BY ALL),
cov AS (SELECT name, count(*) AS document_count, round(coalesce(sum(score), 0), 6) AS relevance FROM covered GROUP BY name)"""


def _single(s, d):
    t = dec(s, d)
    p = t.where("score >= 0.5").select(F.col("category").alias("name")).distinct().withColumn("categories", F.array("name"))
    return t, p, patterns.covered(p, t)


@query(SEEDS + " SELECT * FROM cov")
def pattern_coverage(s, d):
    return patterns.coverage(_single(s, d)[2])


@query(SEEDS + """, ext AS (SELECT category, count(DISTINCT entity) AS extension FROM members GROUP BY category),
per AS (SELECT name, name AS category, count(DISTINCT entity) AS n_entities, count(*) AS n_rows FROM covered JOIN dec ON dec.doc = covered.doc AND dec.category = name GROUP BY name),
r AS (SELECT name, category, n_entities, n_rows, coalesce(extension, 0) AS extension, n_entities / nullif(least(coalesce(extension, 0), document_count), 0) AS ratio FROM per JOIN cov USING (name) LEFT JOIN ext USING (category)),
v AS (SELECT name, category, n_entities, n_rows, extension, round(CASE WHEN ratio <= 1 THEN ratio ELSE n_entities / n_rows END, 3) AS diversity FROM r)
SELECT *, diversity AS pattern_diversity FROM v""")
def pattern_diversity(s, d):
    t, p, c = _single(s, d)
    return patterns.diversity(p, c, t, members(s, d))


@query(", result AS (SELECT doc FROM dec WHERE category IN (FROM concepts) AND score >= 0.2 GROUP BY doc HAVING count(DISTINCT category) = 2 AND count(DISTINCT entity) >= 2), strong AS (SELECT * FROM dec WHERE score >= 0.2 AND doc IN (FROM result)), used AS (SELECT doc, entity FROM strong WHERE category IN (FROM concepts)), fresh AS (SELECT * FROM strong WHERE category NOT IN (FROM concepts) AND (doc, entity) NOT IN (FROM used)) SELECT category, count(DISTINCT doc) AS docs, count(DISTINCT entity) AS n_entities, round(sum(score), 6) AS score FROM fresh GROUP BY category")
def pattern_children(s, d):
    t = dec(s, d)
    names = sorted(top_concepts(t))
    p = s.createDataFrame([(",".join(names), names)], "name string, categories array<string>")
    return patterns.children(p, patterns.covered(p, t, 0.2), t, 0.2).select("category", "docs", "n_entities", "score")


def _levels(n: int) -> str:
    """n levels of patterns as sorted lists; the search itself goes on until a level is empty."""
    out = """, strong AS MATERIALIZED (SELECT doc, entity, category, score FROM dec WHERE score >= 0.3), sums AS MATERIALIZED (SELECT doc, category, sum(score) AS score, list(DISTINCT entity) AS e FROM strong GROUP BY ALL),
hold1 AS MATERIALIZED (SELECT [category] AS p, doc, score FROM sums)"""
    for k in range(1, n + 1):
        if k > 1:
            out += f""",
used{k} AS MATERIALIZED (SELECT DISTINCT p, doc, entity FROM kept{k - 1} JOIN strong USING (doc) WHERE list_contains(p, category)),
cand{k} AS MATERIALIZED (SELECT DISTINCT list_sort(list_append(p, category)) AS p FROM (SELECT p, category FROM kept{k - 1} h JOIN strong s USING (doc) WHERE NOT list_contains(p, category) AND NOT EXISTS (FROM used{k} u WHERE u.p = h.p AND u.doc = h.doc AND u.entity = s.entity) GROUP BY ALL HAVING count(DISTINCT doc) >= 5)),
hold{k} AS MATERIALIZED (SELECT p, doc, sum(score) AS score FROM (SELECT p, unnest(p) AS category FROM cand{k}) JOIN sums USING (category) GROUP BY ALL HAVING count(*) = {k} AND len(list_distinct(flatten(list(e)))) >= {k})"""
        out += f", kept{k} AS MATERIALIZED (SELECT * FROM hold{k} WHERE p IN (SELECT p FROM hold{k} GROUP BY p HAVING count(*) >= 5))"
    return out + " ".join((" UNION ALL" if k > 1 else "") + f" SELECT array_to_string(p, ',') AS name, {k} AS level, count(*) AS document_count, round(sum(round(score, 6)), 4) AS relevance FROM kept{k} GROUP BY p" for k in range(1, n + 1))


@query(_levels(9))
def pattern_mining(s, d):
    t = dec(s, d)
    found = patterns.mine(t, t.where("score >= 0.3").select(F.col("category").alias("name")).distinct(), least_score=0.3, least_docs=5)
    return found.withColumn("relevance", F.round("relevance", 4))


@query(""", p AS (SELECT DISTINCT doc, least(a.category, b.category) || '|||' || greatest(a.category, b.category) AS pair FROM dec a JOIN dec b USING (doc) WHERE a.entity < b.entity AND a.category <> b.category)
SELECT pair, count(*) AS documents FROM p GROUP BY pair""")
def concept_pair_counts(s, d):
    t = dec(s, d)
    return patterns.pair_counts(patterns.concept_pairs(t, t.select("doc").distinct()))


BARS = """, bars AS (SELECT user_id AS symbol, CAST(ts AS DATE) AS date, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL GROUP BY ALL)"""


def _bars(s, d):
    return patterns.daily_bars(table(s, d, "events").select(F.col("user_id").alias("symbol"), "ts", "value", F.col("event_id").alias("seq")))


@query(BARS + " SELECT *, round(CASE WHEN open > 0 THEN (close - open) / open * 100 ELSE 0 END, 4) AS delta FROM bars")
def daily_delta(s, d):
    return _bars(s, d)


@query(", items AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date, o_orderpriority || (o_custkey % 50) AS item FROM orders), days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date, o_orderstatus AS symbol FROM orders) SELECT symbol, d.date, count(DISTINCT item) FILTER (i.date < d.date) AS previous, count(DISTINCT item) FILTER (i.date = d.date) AS same, count(DISTINCT item) FILTER (i.date > d.date) AS following FROM days d LEFT JOIN items i ON i.date BETWEEN d.date - 7 AND d.date + 7 GROUP BY symbol, d.date")
def around_days(s, d):
    o = table(s, d, "orders").withColumn("date", F.to_date("o_orderdate"))
    items = o.select("date", F.concat("o_orderpriority", (F.col("o_custkey") % 50).cast("string")).alias("item"))
    days = o.select(F.col("o_orderstatus").alias("symbol"), "date").distinct()
    return patterns.around_days(days, items)


# --- graph: parts as members of their brand, orders as documents, suppliers and nations as further nodes


GRAPH = """, gmembers AS MATERIALIZED (SELECT DISTINCT 'Category:' || p_brand AS category, 'P' || p_partkey AS entity FROM part),
glinks AS MATERIALIZED (SELECT DISTINCT 'P' || l_partkey AS subject, 'S' || l_suppkey AS object FROM lineitem), gtriples AS MATERIALIZED (FROM glinks UNION SELECT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier),
gdocs AS (SELECT DISTINCT l_orderkey AS doc, 'P' || l_partkey AS entity FROM lineitem{0}),
gconcepts AS (SELECT category FROM gmembers GROUP BY category ORDER BY count(*) DESC, category LIMIT 2),
context AS MATERIALIZED (SELECT doc, category, entity FROM gdocs, gconcepts),
mem AS MATERIALIZED (SELECT * FROM gmembers WHERE category IN (FROM gconcepts)),
und AS MATERIALIZED (SELECT subject AS a, object AS b FROM glinks UNION SELECT object, subject FROM glinks),
target AS MATERIALIZED (SELECT doc, category, entity FROM context c ANTI JOIN mem m ON m.category = c.category AND m.entity = c.entity),
direct AS (SELECT t.doc, t.category, m.entity AS member, t.entity AS target FROM target t JOIN und ON und.b = t.entity JOIN mem m ON m.category = t.category AND m.entity = und.a ANTI JOIN context x ON x.doc = t.doc AND x.category = t.category AND x.entity = m.entity),
near AS (SELECT t.doc, t.category, und.a AS hop, t.entity AS target FROM target t JOIN und ON und.b = t.entity ANTI JOIN context x ON x.doc = t.doc AND x.category = t.category AND x.entity = und.a),
via AS (SELECT n.doc, n.category, m.entity AS member, n.hop, n.target FROM near n JOIN gtriples g ON g.object = n.hop JOIN mem m ON m.category = n.category AND m.entity = g.subject ANTI JOIN context x ON x.doc = n.doc AND x.category = n.category AND x.entity = m.entity)"""
PATHS = GRAPH.format(" WHERE l_orderkey % 100 = 0") + ", gpaths AS (SELECT doc, category, member, NULL AS hop, target FROM direct UNION ALL SELECT doc, category, member, hop, target FROM via WHERE member <> target)"
COUNTS = GRAPH.format("") + ", gcounts AS (SELECT doc, category, target, 1 AS length, count(*) AS n FROM direct GROUP BY ALL UNION ALL SELECT doc, category, target, 2, count(*) FROM via WHERE member <> target GROUP BY ALL)"


class Graph:
    """The tables of the graph queries, whole: parts as members of their brand, orders as documents, and the links between parts and their suppliers, used both ways.

    chosen: as queries only the documents whose id is divisible by 100, against all members, triples and links; listing paths is a search
    with a document as the query. Counting them isn't, and takes all documents.
    """

    def __init__(self, s: SparkSession, d: str, chosen: bool = True):
        line, part = table(s, d, "lineitem"), table(s, d, "part")
        node = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
        self.members = part.select(F.concat(F.lit("Category:"), "p_brand").alias("category"), node("P", "p_partkey").alias("entity")).distinct()
        self.links = line.select(node("P", "l_partkey").alias("subject"), node("S", "l_suppkey").alias("object"))  # the operators make them distinct
        placed = table(s, d, "supplier").select(node("S", "s_suppkey").alias("subject"), node("N", "s_nationkey").alias("object"))
        self.triples = self.links.union(placed)
        docs = line.where("l_orderkey % 100 = 0") if chosen else line
        docs = docs.select(F.col("l_orderkey").alias("doc"), node("P", "l_partkey").alias("entity"))
        concepts = top_concepts(self.members)
        self.docs, self.concepts = docs, concepts
        self.context = docs.distinct().select("doc", F.explode(F.array(*map(F.lit, concepts))).alias("category"), "entity")
        self.members_of = self.members.where(F.col("category").isin(concepts))

    def paths(self) -> DataFrame:
        return graph.paths(self.members_of, self.triples, self.links, self.context)

    def trees(self) -> graph.PathTrees:
        return graph.PathTrees(self.members_of, self.triples, self.links, self.context)

    def counts(self) -> DataFrame:
        return graph.counted(self.members_of, self.triples, self.links, self.docs, self.concepts)


@query(PATHS + " SELECT * FROM gpaths")
def graph_paths(s, d):
    return Graph(s, d).paths()


@query(PATHS + """ SELECT doc, category, e.src, e.dst, e.place, CAST(CASE WHEN hop IS NULL THEN 1 ELSE 2 END AS INTEGER) AS length, target FROM (
SELECT *, unnest(CASE WHEN hop IS NULL THEN [{'src': category, 'dst': member, 'place': 1}, {'src': member, 'dst': target, 'place': 2}] ELSE [{'src': category, 'dst': member, 'place': 1}, {'src': member, 'dst': hop, 'place': 2}, {'src': hop, 'dst': target, 'place': 3}] END) AS e FROM gpaths) GROUP BY ALL""")
def graph_tree(s, d):
    return Graph(s, d).trees().edges()


@query(COUNTS + " SELECT * FROM gcounts")
def path_counts(s, d):
    return Graph(s, d, False).counts()


@query(COUNTS + """, ctx AS (SELECT doc, category, count(*) AS size FROM target GROUP BY ALL), per AS (SELECT doc, category, sum(pow(0.5, length) * n) AS total FROM gcounts GROUP BY ALL),
c AS (SELECT doc, category, coalesce(total, 0) / size AS c FROM ctx LEFT JOIN per USING (doc, category)) SELECT doc, category, round(c, 6) AS connectivity, round(1 - 1 / (1 + c), 6) AS relevance FROM c""")
def concept_relevance(s, d):
    g = Graph(s, d, False)
    return graph.relevance(g.counts(), g.docs, g.members_of, g.concepts)


_PICK = "CAST(CAST('0x' || substr(md5(concat_ws('|', '0', '{0}', {1}, walk)), 1, 8) AS BIGINT) % {2} + 1 AS BIGINT)"


def _walk_sql(name: str, paths: str, key: str, walks: str) -> str:
    """Walks down the tree of paths (doc, category, member, hop, target): nodes are numbered, and a hash names the number. walks: a number, or a table (key, k) of one for each group."""
    number = lambda of, node: f"row_number() OVER (PARTITION BY {of} ORDER BY {node}) AS i, count(*) OVER (PARTITION BY {of}) AS n"
    groups = f"(SELECT DISTINCT {key} FROM {name}t)" if walks.isdigit() else f"(SELECT DISTINCT {key}, k FROM {name}t JOIN {walks} USING ({key}))"
    out = f""", {name}t AS MATERIALIZED (SELECT doc, category, member, coalesce(hop, '') AS hop, target FROM {paths}),
{name}1 AS MATERIALIZED (SELECT {key}, member, {number(key, 'member')} FROM (SELECT DISTINCT {key}, member FROM {name}t)),
{name}2 AS MATERIALIZED (SELECT {key}, member, hop, {number(key + ', member', 'hop')} FROM (SELECT DISTINCT {key}, member, hop FROM {name}t)),
{name}3 AS MATERIALIZED (SELECT {key}, member, hop, target AS reached, {number(key + ', member, hop', 'target')} FROM (SELECT DISTINCT doc, category, member, hop, target FROM {name}t)),
{name}w0 AS MATERIALIZED (SELECT {key}, CAST(unnest(range(0, {walks if walks.isdigit() else 'k'})) AS INTEGER) AS walk, 1::BIGINT AS all_n FROM {groups})"""
    at = key
    for k, col in ((1, "member"), (2, "hop"), (3, "reached")):
        out += f""",
{name}p{k} AS MATERIALIZED (SELECT {at}, walk, all_n * n AS all_n, {_PICK.format(k, key, 'n')} AS i FROM {name}w{k - 1} JOIN (SELECT DISTINCT {at}, n FROM {name}{k}) USING ({at})),
{name}w{k} AS MATERIALIZED (SELECT {at}, walk, all_n, {col} FROM {name}p{k} JOIN {name}{k} USING ({at}, i))"""
        at += f", {col}"
    target = "" if "target" in key else " reached AS target,"
    return out + f", {name}w AS MATERIALIZED (SELECT {key}, walk, member, nullif(hop, '') AS hop,{target} 1.0::DOUBLE / all_n AS probability, all_n AS estimate FROM {name}w3)"


@query(PATHS + _walk_sql("s", "gpaths", "doc, category", "50") + " SELECT doc, category, walk, member, hop, target, round(probability, 12) AS probability, estimate FROM sw")
def sampled_paths(s, d):
    return Graph(s, d).trees().walks().drop("paths").withColumn("probability", F.round("probability", 12))


@query(PATHS + _walk_sql("s", "(SELECT * FROM gpaths WHERE member = (SELECT min(member) FROM gpaths))", "doc, category", "50") + " SELECT doc, category, walk, member, hop, target, round(probability, 12) AS probability, estimate FROM sw")
def prefixed_paths(s, d):
    p = Graph(s, d).paths()  # listed twice and not kept
    return graph.prefixed_walks(p, [p.agg(F.min("member")).first()[0]]).withColumn("probability", F.round("probability", 12))


def _blind_sql(walks: int) -> str:
    pick = lambda salt, n: _PICK.format(salt, "x.doc, x.category", n)
    numbered = lambda a, b, t: f"SELECT {a} AS at, {b} AS next, row_number() OVER (PARTITION BY {a} ORDER BY {b}) AS i, count(*) OVER (PARTITION BY {a}) AS n FROM (SELECT DISTINCT {a}, {b} FROM {t})"
    return f""", n1 AS ({numbered('category', 'entity', 'mem')}), n2 AS ({numbered('subject', 'object', 'gtriples')}), n3 AS ({numbered('a', 'b', 'und')}),
w0 AS (SELECT doc, category, CAST(unnest(range(0, {walks})) AS INTEGER) AS walk FROM (SELECT DISTINCT doc, category FROM context)),
w1 AS (SELECT x.doc, x.category, walk, next AS node, 1.0::DOUBLE / n AS p FROM w0 x JOIN n1 y ON y.at = x.category AND y.i = {pick(1, 'y.n')}),
w2 AS (SELECT x.doc, x.category, walk, node, p FROM w1 x WHERE {pick(9, '2')} = 1 UNION ALL SELECT x.doc, x.category, walk, next, p / n FROM w1 x JOIN n2 y ON y.at = x.node AND y.i = {pick(2, 'y.n')} WHERE {pick(9, '2')} = 2),
w3 AS (SELECT x.doc, x.category, walk, p / n AS p FROM w2 x JOIN n3 y ON y.at = x.node AND y.i = {pick(3, 'y.n')} JOIN target t ON t.doc = x.doc AND t.category = x.category AND t.entity = y.next)
SELECT doc, category, walk, p IS NOT NULL AS success, round(coalesce(p, 0), 12) AS probability, CAST(coalesce(floor(2 / p + 1e-6), 0) AS BIGINT) AS estimate FROM w0 LEFT JOIN w3 USING (doc, category, walk)"""


@query(GRAPH.format(" WHERE l_orderkey % 100 = 0") + _blind_sql(600))
def blind_walks(s, d):
    g = Graph(s, d)
    return graph.blind_walks(g.members_of, g.triples, g.links, g.context).withColumn("probability", F.round("probability", 12))


@query(PATHS + _walk_sql("s", "gpaths", "doc, category, target", "10") + " SELECT doc, category, target, walk, member, hop, round(probability, 12) AS probability, estimate FROM sw")
def targeted_walks(s, d):
    return Graph(s, d).trees().walks(10, key=("doc", "category", "target")).drop("paths").withColumn("probability", F.round("probability", 12))


@query(PATHS + _walk_sql("s", "gpaths", "doc, category", "(SELECT doc, category, 500 * count(*) AS k FROM context GROUP BY ALL)") + """, t AS (SELECT doc, category, count(*) AS walks FROM sw GROUP BY ALL), h AS (SELECT doc, category, target, count(*) AS hits, sum(estimate) AS weight FROM sw GROUP BY ALL)
SELECT doc, category, entity AS target, walks, coalesce(hits, 0) AS hits, round(coalesce(weight, 0) / walks, 6) AS estimate FROM context JOIN t USING (doc, category) LEFT JOIN h ON h.doc = context.doc AND h.category = context.category AND h.target = entity""")
def collective_walks(s, d):
    g = Graph(s, d)
    return g.trees().collective(g.context).withColumn("estimate", F.round("estimate", 6))


@query(PATHS + _walk_sql("s", "gpaths", "doc, category", "50") + ", truth AS (SELECT doc, category, count(*) AS truth FROM gpaths GROUP BY ALL), mean AS (SELECT doc, category, round(avg(estimate), 6) AS estimate FROM sw GROUP BY ALL) SELECT doc, category, truth, estimate, round(abs(estimate - truth) / truth, 4) AS error FROM truth JOIN mean USING (doc, category)")
def sampling_errors(s, d):
    walks = Graph(s, d).trees().walks()
    out = walks.groupBy("doc", "category").agg(F.first("paths").alias("truth"), F.round(F.avg("estimate"), 6).alias("estimate"))
    return out.withColumn("error", F.round(F.abs(F.col("estimate") - F.col("truth")) / F.col("truth"), 4))


@query(PATHS + _walk_sql("s", "gpaths", "doc, category", "50") + """, truth AS (SELECT doc, category, count(*)::DOUBLE AS truth FROM gpaths GROUP BY ALL),
r AS (SELECT doc, category, walk, truth, count(*) OVER w AS n, round(CAST(sum(estimate) OVER w AS DOUBLE), 2) AS running_sum FROM sw JOIN truth USING (doc, category) WINDOW w AS (PARTITION BY doc, category ORDER BY walk ROWS UNBOUNDED PRECEDING))
SELECT doc, category, walk, truth, running_sum, round(running_sum / n, 6) AS running_mean, round(abs(running_sum / n - truth) / truth, 2) AS running_error FROM r""")
def running_errors(s, d):
    walks = Graph(s, d).trees().walks().withColumn("truth", F.col("paths").cast("double")).withColumn("estimate", F.col("estimate").cast("double"))
    out = graph.running_error(walks, ["doc", "category"], ["walk"], "estimate", "truth")
    return out.select("doc", "category", "walk", "truth", "running_sum", F.round("running_mean", 6).alias("running_mean"), "running_error")


@query(GRAPH.format("") + """, q AS (SELECT DISTINCT 'S' || l_suppkey AS a, 'S' || ((l_suppkey % 5) + 1) AS b FROM lineitem WHERE l_suppkey <> l_suppkey % 5 + 1)
SELECT q.a, q.b, CAST(count(DISTINCT CASE WHEN l.b IS NOT NULL THEN 1 END) AS INTEGER) AS linked, count(DISTINCT y.b) AS common FROM q LEFT JOIN und l ON l.a = q.a AND l.b = q.b LEFT JOIN und x ON x.a = q.a LEFT JOIN und y ON y.a = q.b AND y.b = x.b GROUP BY q.a, q.b""")
def common_neighbours(s, d):
    pairs = table(s, d, "lineitem").where("l_suppkey <> l_suppkey % 5 + 1").select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("a"), F.concat(F.lit("S"), (F.col("l_suppkey") % 5 + 1).cast("string")).alias("b")).distinct()
    return graph.common_neighbours(Graph(s, d).links, pairs)


@query(GRAPH.format("") + """, s AS (SELECT DISTINCT 'P' || p_partkey AS source FROM part WHERE p_partkey % 100 = 0), t AS (SELECT DISTINCT 'S' || s_suppkey AS target FROM supplier),
two AS (SELECT source, y.b AS reached, count(*) AS n FROM s JOIN und x ON x.a = source JOIN und y ON y.a = x.b WHERE y.b <> source GROUP BY ALL),
walks AS (SELECT source, target, 1 AS k, 1 AS n FROM s JOIN und ON a = source JOIN t ON target = b UNION ALL SELECT source, target, 2, n FROM two JOIN t ON target = reached
UNION ALL SELECT source, target, 3, count(*) FROM s JOIN und x ON x.a = source JOIN und y ON y.a = x.b JOIN und z ON z.a = y.b JOIN t ON target = z.b WHERE x.b <> target AND y.b <> source AND y.b <> target AND x.b <> y.b GROUP BY ALL)
SELECT source, target, CAST(sum(CASE k WHEN 1 THEN n ELSE 0 END) AS BIGINT) AS one, CAST(sum(CASE k WHEN 2 THEN n ELSE 0 END) AS BIGINT) AS two, CAST(sum(CASE k WHEN 3 THEN n ELSE 0 END) AS BIGINT) AS three FROM walks GROUP BY source, target""")
def three_hop_counts(s, d):
    node = lambda p, c, o: F.concat(F.lit(p), F.col(c).cast("string")).alias(o)
    sources = table(s, d, "part").where("p_partkey % 100 = 0").select(node("P", "p_partkey", "source"))
    return graph.three_hop_counts(Graph(s, d).links, sources, table(s, d, "supplier").select(node("S", "s_suppkey", "target")))


@query(""", roots AS (SELECT parent AS root FROM hierarchy GROUP BY parent ORDER BY count(*) DESC, parent LIMIT 3), und AS (SELECT name AS a, parent AS b FROM hierarchy WHERE name <> parent UNION SELECT parent, name FROM hierarchy WHERE name <> parent),
walk AS (SELECT root, root AS node, CAST(0 AS INTEGER) AS distance FROM roots UNION SELECT w.root, u.b, w.distance + 1 FROM walk w JOIN und u ON u.a = w.node WHERE w.distance < 4) SELECT root, node, min(distance) AS distance FROM walk GROUP BY root, node""", recursive=True)
def reachable_nodes(s, d):
    h = hierarchy(s, d)
    roots = h.groupBy("parent").count().orderBy(F.desc("count"), "parent").limit(3).select(F.col("parent").alias("root"))
    return graph.reachable(h.select(F.col("name").alias("subject"), F.col("parent").alias("object")), roots, 4)


@query(", und AS (SELECT name AS a, parent AS b FROM hierarchy WHERE name <> parent UNION SELECT parent, name FROM hierarchy WHERE name <> parent) SELECT a AS node, count(*) AS degree FROM und GROUP BY a")
def node_degrees(s, d):
    return graph.degrees(hierarchy(s, d).select(F.col("name").alias("subject"), F.col("parent").alias("object")))


@query(""", und AS MATERIALIZED (SELECT name AS a, parent AS b FROM hierarchy UNION SELECT parent, name FROM hierarchy), walk AS (SELECT a AS node, a AS reached FROM und UNION SELECT w.node, u.b FROM walk w JOIN und u ON u.a = w.reached)
SELECT node, min(reached) AS component FROM walk GROUP BY node""", recursive=True)
def concept_components(s, d):
    return components(hierarchy(s, d), "name", "parent")


@query(", t AS (SELECT l_orderkey AS rec, l_linenumber AS i, l_partkey AS j, l_quantity AS est, o_totalprice / 5000 AS truth FROM lineitem JOIN orders ON o_orderkey = l_orderkey), r AS (SELECT rec, i, j, est, truth, count(*) OVER w AS n, round(sum(est) OVER w, 2) AS running_sum FROM t WINDOW w AS (PARTITION BY rec ORDER BY i, j, est ROWS UNBOUNDED PRECEDING)) SELECT rec, i, j, n, running_sum, running_sum / n AS running_mean FROM r")
def running_mean(s, d):
    t = table(s, d, "lineitem").join(table(s, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("l_orderkey").alias("rec"), F.col("l_linenumber").alias("i"), F.col("l_partkey").alias("j"), F.col("l_quantity").alias("est"), (F.col("o_totalprice") / 5000).alias("truth"))
    return graph.running_error(t, ["rec"], ["i", "j", "est"], "est", "truth").select("rec", "i", "j", "n", "running_sum", "running_mean")


@query(" SELECT round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem")
def correlation(s, d):
    return table(s, d, "lineitem").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"))


# --- types, peers, vectors, names


@query(", a AS (SELECT p_type AS template, split_part(p_name, ' ', -1) AS hypernym FROM part), per AS (SELECT template, hypernym, count(*) AS n FROM a GROUP BY ALL), b AS (SELECT template, sum(n) AS rows, max(n) AS most FROM per GROUP BY template) SELECT template, CASE WHEN max(rows) >= 1000 THEN template ELSE min(hypernym) END AS derived FROM per JOIN b USING (template) WHERE n = most GROUP BY template")
def derived_types(s, d):
    return scoring.derived_types(table(s, d, "part").select(F.col("p_type").alias("template"), F.substring_index("p_name", " ", -1).alias("hypernym")))


@query(" SELECT predicate, object, count(DISTINCT subject) - 1 AS peers FROM (SELECT 'suppliedBy' AS predicate, l_partkey AS subject, 'S' || l_suppkey AS object FROM lineitem UNION ALL SELECT 'locatedIn', s_suppkey, 'N' || s_nationkey FROM supplier) GROUP BY predicate, object")
def peer_counts(s, d):
    a = table(s, d, "lineitem").select(F.lit("suppliedBy").alias("predicate"), F.col("l_partkey").alias("subject"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("object"))
    b = table(s, d, "supplier").select(F.lit("locatedIn").alias("predicate"), F.col("s_suppkey").alias("subject"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("object"))
    return scoring.peer_counts(a.union(b))


@query(", q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT v FROM q)), 4) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 20")
def cosine_topk(s, d):
    e = table(s, d, "embeddings")
    q = e.where("vec_id = 0").first().embedding
    return e.select("vec_id", F.round(C.cosine("embedding", F.array(*map(F.lit, q))), 4).alias("score")).orderBy(F.desc("score"), "vec_id").limit(20)


@query(" SELECT category, replace(split_part(category, ':', -1), '_', ' ') AS shown, CAST(length(category) AS INTEGER) AS n_chars FROM (SELECT DISTINCT category FROM dec)")
def display_names(s, d):
    return dec(s, d).select("category").distinct().select("category", C.display_name("category").alias("shown"), F.char_length("category").alias("n_chars"))


@query(" SELECT doc, string_agg(DISTINCT category, ',' ORDER BY category) AS pattern_key, count(DISTINCT category) AS n, round(log2(count(DISTINCT category) + 0.1) * log10(count(*) + 0.1), 4) AS pattern_score FROM dec GROUP BY doc")
def pattern_keys(s, d):
    per = dec(s, d).groupBy("doc").agg(F.collect_set("category").alias("c"), F.count("*").alias("rows"))
    return per.select("doc", C.set_key("c").alias("pattern_key"), F.size("c").cast("bigint").alias("n"), F.round(C.pattern_score(F.size("c"), "rows"), 4).alias("pattern_score"))


@query(" SELECT doc, CASE WHEN strpos(title, ' ') > 0 THEN substr(title, 1, strpos(title, ' ')) || lower(substr(title, strpos(title, ' ') + 1)) ELSE title END AS shown, regexp_replace(title, '[!-/:-@\\[-`{-~]', ' ', 'g') AS plain FROM documents_ WHERE title IS NOT NULL")
def title_forms(s, d):
    return documents(s, d).where("title IS NOT NULL").select("doc", C.sentence_case("title").alias("shown"), C.no_punctuation("title").alias("plain"))


@query(None)
def text_digests(s, d):
    return documents(s, d).select("doc", C.sha3_512("text").alias("digest"))


# --- writes


@query(", o AS (SELECT name, max(kg_count) AS kg_count FROM stats GROUP BY name), n AS (SELECT category AS name, CAST(count(DISTINCT entity) AS INTEGER) AS kg_count FROM members GROUP BY category) SELECT coalesce(o.name, n.name) AS name, CASE WHEN n.name IS NOT NULL THEN n.kg_count ELSE o.kg_count END AS kg_count, CASE WHEN o.name IS NULL THEN 'new' WHEN n.name IS NULL THEN 'kept' WHEN o.kg_count IS DISTINCT FROM n.kg_count THEN 'changed' ELSE 'same' END AS change FROM o FULL JOIN n ON o.name = n.name")
def upserted_counts(s, d):
    old_time, now = F.lit("2020-01-01").cast("timestamp"), F.lit("2021-01-01").cast("timestamp")
    old = stats(s, d).select("name", "kg_count").withColumn("created_at", old_time).withColumn("updated_at", old_time)
    new = members(s, d).groupBy("category").agg(F.count_distinct("entity").cast("int").alias("kg_count")).withColumnRenamed("category", "name")
    out = upsert.upsert(old, new, ["name"], now)
    return out.join(new.select("name", F.lit(True).alias("given")), "name", "left").select("name", "kg_count", F.when(F.col("created_at") == now, "new").when(F.col("given").isNull(), "kept").when(F.col("updated_at") == now, "changed").otherwise("same").alias("change"))


@query(" SELECT news_analytics, entity, entity_type FROM document_entity WHERE news_analytics IN (SELECT doc FROM documents_) AND NOT (entity_type IS NOT NULL AND entity_type = 'GPE')")
def cascaded_and_deleted(s, d):
    t = upsert.delete_where(table(s, d, "document_entity"), F.col("entity_type") == "GPE")
    return upsert.cascade(t, documents(s, d), "news_analytics", "doc").select("news_analytics", "entity", "entity_type")


@query(" SELECT category || ',' || string_agg(DISTINCT entity, ',' ORDER BY entity) AS value FROM members GROUP BY category HAVING count(DISTINCT entity) >= 4")
def exported_lines(s, d):
    return upsert.export_lines(members(s, d), ["category"], "entity")


@query(" SELECT doc, CASE WHEN sentiment IS NULL THEN 0.0 ELSE sentiment END AS sentiment FROM documents_")
def updated_where(s, d):
    return upsert.update_where(documents(s, d), F.col("sentiment").isNull(), {"sentiment": F.lit(0.0)}).select("doc", "sentiment")


@query(" SELECT source AS name, count(*) AS answers, true AS asked FROM documents_ WHERE source IS NOT NULL GROUP BY source QUALIFY max(count(*)) OVER () - min(count(*)) OVER () <= 10 UNION ALL SELECT name, answers, rn > 10 FROM (SELECT source AS name, count(*) AS answers, row_number() OVER (ORDER BY count(*) DESC, source) AS rn, max(count(*)) OVER () - min(count(*)) OVER () AS spread FROM documents_ WHERE source IS NOT NULL GROUP BY source) WHERE spread > 10")
def least_answered(s, d):
    docs = documents(s, d).where("source IS NOT NULL").select(F.col("source").alias("name"))
    return evaluation.least_answered(docs, docs)


@query(", r AS (SELECT category AS name, 'mean' AS method, doc, row_number() OVER (PARTITION BY category ORDER BY avg(score) DESC NULLS LAST, doc) AS place FROM dec WHERE category IN (FROM concepts) GROUP BY category, doc), q AS (SELECT category AS name, 'rows' AS method, doc, row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, doc) AS place FROM dec WHERE category IN (FROM concepts) GROUP BY category, doc), a AS (SELECT * FROM q WHERE place <= 5) SELECT name, method, doc, CAST(place AS INTEGER) AS place FROM a UNION ALL SELECT name, method, doc, CAST(p AS INTEGER) FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY place, doc) AS p FROM r WHERE (name, doc) NOT IN (SELECT name, doc FROM a)) WHERE p <= 5")
def methods_side_by_side(s, d):
    from pyspark.sql import Window as W

    t = dec(s, d)
    per = t.where(F.col("category").isin(top_concepts(t))).groupBy(F.col("category").alias("name"), "doc").agg(F.avg("score").alias("mean"), F.count("*").alias("rows"))
    ranked = lambda c: per.select("name", F.lit(c).alias("method"), "doc", F.row_number().over(W.partitionBy("name").orderBy(F.col(c).desc_nulls_last(), "doc")).alias("place"))
    return evaluation.side_by_side(ranked("mean").union(ranked("rows")), ["rows", "mean"])


@query(" SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_events(s, d):
    from ..streaming.events import windowed

    return windowed(table(s, d, "events"))
