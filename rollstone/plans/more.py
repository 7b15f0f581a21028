"""Further registered queries: aliases, exports, states, functions on real columns, and readers over feeds written from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import aliases as A
from ..operators import articles, evaluation, graph, grid, patterns, pipeline, scoring, search, upsert
from ..operators.hierarchy import Hierarchy
from ..sources import readers
from ..streaming import events
from ..work import durable, remembered, shared_dir, table
from .core import SEEDS, _bars, _single, query
from .views import dec, documents, hierarchy, members, mentions, stats, top_concepts

# --- aliases: what the graph knows of an entity, made from its membership


ALIASES = ", aliases AS (SELECT entity, 'Q' || (count(*) * 1000 + length(entity)) AS external_id, min(category) AS hypernym, count(*) AS degree FROM members GROUP BY entity)"


def _aliases(s: SparkSession, d: str) -> DataFrame:
    per = members(s, d).groupBy("entity").agg(F.min("category").alias("hypernym"), F.count("*").alias("degree"))
    return per.withColumn("external_id", F.concat(F.lit("Q"), (F.col("degree") * 1000 + F.char_length("entity")).cast("string")))


@query(ALIASES + " SELECT doc, entity, CAST(row_number() OVER (PARTITION BY doc ORDER BY tfidf DESC NULLS LAST, entity) AS INTEGER) AS place, tfidf, external_id, hypernym, degree FROM mentions LEFT JOIN aliases USING (entity)")
def document_entity_stats(s, d):
    return A.entity_stats(mentions(s, d), _aliases(s, d)).select("doc", "entity", "place", "tfidf", "external_id", "hypernym", "degree")


@query(ALIASES + " SELECT DISTINCT category, entity, external_id FROM dec LEFT JOIN aliases USING (entity) WHERE category IN (FROM concepts)")
def pattern_entities(s, d):
    t = dec(s, d)
    return A.pattern_entities(t, top_concepts(t), _aliases(s, d))


@query(ALIASES + """, facts AS (SELECT min(entity) AS fact, max(entity) AS target, count(*) AS n FROM mentions GROUP BY doc)
SELECT fact, target, n, a.external_id AS fact_external_id, b.external_id AS target_external_id, concat_ws(',', CASE WHEN a.external_id IS NULL THEN 'fact' END, CASE WHEN b.external_id IS NULL THEN 'target' END) AS missing
FROM facts LEFT JOIN aliases a ON a.entity = fact LEFT JOIN aliases b ON b.entity = target""")
def resolved_facts(s, d):
    facts = mentions(s, d).groupBy("doc").agg(F.min("entity").alias("fact"), F.max("entity").alias("target"), F.count("*").alias("n")).drop("doc")
    return A.resolved_facts(facts, _aliases(s, d)).select("fact", "target", "n", "fact_external_id", "target_external_id", "missing")


@query(ALIASES + """, ids AS (SELECT DISTINCT category, external_id FROM dec JOIN aliases USING (entity))
SELECT category || ',' || category || ',' || string_agg(external_id, ',' ORDER BY external_id) AS value FROM ids WHERE category IN (SELECT category FROM dec WHERE score >= 0.5) GROUP BY category HAVING count(*) >= 4""")
def exported_patterns(s, d):
    t, p, _ = _single(s, d)
    return A.pattern_lines(p, t, _aliases(s, d))


@query(ALIASES + " SELECT external_id, entity, hypernym FROM aliases WHERE hypernym = (SELECT hypernym FROM aliases GROUP BY hypernym ORDER BY count(*) DESC, hypernym LIMIT 1)")
def typed_entities(s, d):
    a = _aliases(s, d)
    most = a.groupBy("hypernym").count().orderBy(F.desc("count"), "hypernym").first().hypernym
    return A.typed_entities(a, most)


@query(ALIASES + """, known AS (SELECT entity, degree FROM aliases WHERE degree >= 3), counted AS (SELECT entity, count(DISTINCT doc) AS degree FROM mentions GROUP BY entity)
SELECT DISTINCT m.entity, coalesce(k.degree, c.degree) AS degree, k.degree IS NULL AS fresh FROM mentions m LEFT JOIN known k ON k.entity = m.entity LEFT JOIN counted c ON c.entity = m.entity""")
def filled_degrees(s, d):
    m = mentions(s, d)
    return A.filled_degrees(_aliases(s, d).where("degree >= 3"), m, m.groupBy("entity").agg(F.count_distinct("doc").alias("degree")))


# --- aggregates


TRIPLES = """, t AS (SELECT 'suppliedBy' AS predicate, 'P' || l_partkey AS subject, 'S' || l_suppkey AS object FROM lineitem UNION ALL SELECT 'locatedIn', 'S' || s_suppkey, 'N' || s_nationkey FROM supplier UNION ALL SELECT 'orderedBy', 'O' || o_orderkey, 'C' || o_custkey FROM orders)"""


def _triples(s, d):
    pair = lambda name, predicate, p, a, q, b: table(s, d, name).select(F.lit(predicate).alias("predicate"), F.concat(F.lit(p), F.col(a).cast("string")).alias("subject"), F.concat(F.lit(q), F.col(b).cast("string")).alias("object"))
    return pair("lineitem", "suppliedBy", "P", "l_partkey", "S", "l_suppkey").union(pair("supplier", "locatedIn", "S", "s_suppkey", "N", "s_nationkey")).union(pair("orders", "orderedBy", "O", "o_orderkey", "C", "o_custkey"))


@query(TRIPLES + " SELECT subject, predicate, count(DISTINCT object) - 1 AS others FROM t GROUP BY ALL")
def object_counts(s, d):
    return scoring.object_counts(_triples(s, d))


@query(TRIPLES + " SELECT predicate, count(*) AS n FROM t GROUP BY predicate HAVING count(*) > 1000")
def frequent_predicates(s, d):
    return scoring.frequent_predicates(_triples(s, d), 1000)


@query(", per AS (SELECT DISTINCT doc, entity FROM mentions WHERE regexp_matches(entity, '[0-9_]')), l AS (SELECT doc, count(*) AS n FROM per GROUP BY doc) SELECT n, count(*) AS docs FROM l GROUP BY n")
def documents_by_marked_entities(s, d):
    """Grouped twice: entities with a digit or underscore per document, then documents per number of them."""
    per = mentions(s, d).where(F.col("entity").rlike("[0-9_]")).groupBy("doc").agg(F.count_distinct("entity").alias("n"))
    return per.groupBy("n").agg(F.count("*").alias("docs"))


@query(" SELECT doc, round(greatest(avg(score), 0.03), 9) AS least FROM dec WHERE score IS NOT NULL GROUP BY doc")
def mean_with_floor(s, d):
    return dec(s, d).where("score IS NOT NULL").groupBy("doc").agg(F.round(F.greatest(F.avg("score"), F.lit(0.03)), 9).alias("least"))


@query(" SELECT doc, CAST(coalesce(len(routes), 0) AS INTEGER) AS n_routes, count(*) AS rows FROM (SELECT news_analytics AS doc, expansion_routes AS routes FROM document_entity_category) GROUP BY ALL")
def list_sizes(s, d):
    n = F.when(F.col("expansion_routes").isNotNull(), F.size("expansion_routes")).otherwise(0)
    return table(s, d, "document_entity_category").groupBy(F.col("news_analytics").alias("doc"), n.alias("n_routes")).agg(F.count("*").alias("rows"))


@query(", h AS (SELECT name, min(parent) AS parent FROM hierarchy GROUP BY name), roots AS (SELECT DISTINCT parent AS node FROM h WHERE parent NOT IN (SELECT name FROM h)), down AS (SELECT node AS root, node, 0 AS hops FROM roots UNION ALL SELECT w.root, h.name, w.hops + 1 FROM down w JOIN h ON h.parent = w.node) SELECT root, CAST(max(hops) AS INTEGER) AS depth, count(*) AS nodes FROM down GROUP BY root", recursive=True)
def tree_sizes(s, d):
    found = Hierarchy(hierarchy(s, d), F.col("name"), F.col("parent")).roots().where("hops >= 0")
    return found.groupBy("root").agg(F.max("hops").alias("depth"), F.count("*").alias("nodes"))


# --- states, settings, upserts


@query(""", a AS (SELECT doc, CASE WHEN doc % 7 = 0 THEN 'http://x/Filing/' ELSE 'http://x/' END || doc AS url, text AS content, state FROM documents_)
SELECT doc, CASE WHEN contains(lower(url), 'filing') THEN 'skipped' WHEN trim(coalesce(content, ''), ' ') = '' THEN 'empty' ELSE state END AS state FROM a""")
def source_states(s, d):
    a = documents(s, d).select("doc", F.concat(F.when(F.col("doc") % 7 == 0, "http://x/Filing/").otherwise("http://x/"), F.col("doc").cast("string")).alias("url"), F.col("text").alias("content"), "state")
    return pipeline.source_states(a).select("doc", "state")


LINKER = """, c AS (SELECT doc, CASE WHEN contains(x, t) THEN x WHEN x = '' THEN t ELSE t || '. ' || x END AS content FROM (SELECT doc, coalesce(title, '') AS t, coalesce(text, '') AS x FROM documents_)),
linker AS (SELECT doc, content, CASE WHEN content = '' THEN 'analyze_error' WHEN doc <> min(doc) OVER (PARTITION BY content) THEN 'analyzed' ELSE 'imported' END AS state FROM c)"""


@query(LINKER + " SELECT doc, CAST(length(content) AS INTEGER) AS n_chars, state FROM linker")
def linker_input(s, d):
    return pipeline.linker_input(documents(s, d)).select("doc", F.char_length("content").alias("n_chars"), "state")


@query(LINKER + """, names AS (SELECT DISTINCT entity, array_to_string(list_filter(regexp_split_to_array(lower(replace(split_part(entity, ':', -1), '_', ' ')), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''), ' ') AS run FROM members),
w AS (SELECT doc, list_filter(regexp_split_to_array(lower(content), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM linker WHERE state = 'imported'),
runs AS (SELECT doc, i, w[i] AS run FROM w, unnest(range(1, len(w) + 1)) AS r(i) UNION ALL SELECT doc, i, array_to_string(w[i:i + 1], ' ') FROM w, unnest(range(1, len(w))) AS r(i) UNION ALL SELECT doc, i, array_to_string(w[i:i + 2], ' ') FROM w, unnest(range(1, len(w) - 1)) AS r(i) UNION ALL SELECT doc, i, array_to_string(w[i:i + 3], ' ') FROM w, unnest(range(1, len(w) - 2)) AS r(i)),
hits AS (SELECT doc, entity FROM runs JOIN names USING (run) WHERE run <> ''),
n AS (SELECT h.doc, count(DISTINCT h.entity) AS n_entities FROM hits h WHERE h.entity NOT IN (SELECT entity FROM members) OR h.entity IN (SELECT entity FROM members WHERE """ + " AND ".join([f"NOT contains(category, '{x}')" for x in C.INVALID] + [f"NOT contains(lower(category), '{x}')" for x in C.INVALID_ANY_CASE]) + """) GROUP BY h.doc)
SELECT doc, CASE WHEN state = 'imported' AND n_entities > 0 THEN 'scored' WHEN state = 'imported' THEN 'analyzed' ELSE state END AS state, coalesce(n_entities, 0) AS n_entities FROM linker LEFT JOIN n USING (doc)""")
def pipeline_states(s, d):
    """The whole pipeline over all articles: linking by the graph's names, triples, TF-IDF and relevance; here the state and number of entities of each document."""
    m = members(s, d)
    names = m.select("entity").distinct().withColumn("name", C.display_name("entity"))
    return pipeline.run(documents(s, d).select("doc", "title", "text"), names, m)[1].select("doc", "state", "n_entities")


@query(SEEDS + """, ext AS (SELECT category, count(DISTINCT entity) AS extension FROM members GROUP BY category),
per AS (SELECT name, count(DISTINCT entity) AS n_entities, count(*) AS n_rows FROM covered JOIN dec ON dec.doc = covered.doc AND dec.category = name GROUP BY name),
r AS (SELECT name, n_entities, n_rows, n_entities / nullif(least(coalesce(extension, 0), document_count), 0) AS ratio FROM per JOIN cov USING (name) LEFT JOIN ext ON category = name)
SELECT name, document_count, relevance, round(CASE WHEN ratio <= 1 THEN ratio ELSE n_entities / n_rows END, 3) AS diversity, CASE WHEN document_count > 4 THEN 'score_updated' ELSE 'expanded' END AS state FROM cov JOIN r USING (name)""")
def refreshed_patterns(s, d):
    t, p, _ = _single(s, d)
    return patterns.refreshed(p, t, members(s, d))


PAIRS = """, top AS MATERIALIZED (SELECT category FROM dec GROUP BY category ORDER BY count(*) DESC, category LIMIT 12), pair AS (SELECT a.category AS x, b.category AS y FROM top a JOIN top b ON a.category < b.category),
strong AS (SELECT * FROM dec WHERE score >= 0.3), hold AS (SELECT x || ',' || y AS name, x, y, doc, round(sum(score), 6) AS score FROM pair JOIN strong ON category IN (x, y) GROUP BY ALL HAVING count(DISTINCT category) = 2 AND count(DISTINCT entity) >= 2)"""


def _pairs_of_concepts(s, d):
    """All pairs of the twelve most frequent concepts as patterns."""
    t = dec(s, d)
    top = sorted(top_concepts(t, 12))
    two = [(f"{a},{b}", [a, b]) for i, a in enumerate(top) for b in top[i + 1 :]]
    p = s.createDataFrame(two, "name string, categories array<string>")
    return t, p, durable(patterns.covered(p, t, 0.3), "covered")


@query(PAIRS + " SELECT name, count(*) AS document_count, round(sum(score), 4) AS relevance FROM hold GROUP BY name")
def pattern_coverage_of_pairs(s, d):
    return patterns.coverage(_pairs_of_concepts(s, d)[2]).withColumn("relevance", F.round("relevance", 4))


@query(PAIRS + """, ext AS (SELECT category, count(DISTINCT entity) AS extension FROM members GROUP BY category), n AS (SELECT name, count(*) AS n_docs FROM hold GROUP BY name),
per AS (SELECT name, category, count(DISTINCT entity) AS n_entities, count(*) AS n_rows FROM hold JOIN dec ON dec.doc = hold.doc AND category IN (x, y) GROUP BY ALL),
v AS (SELECT name, category, round(CASE WHEN n_entities / nullif(least(coalesce(extension, 0), n_docs), 0) <= 1 THEN n_entities / least(extension, n_docs) ELSE n_entities / n_rows END, 3) AS diversity FROM per JOIN n USING (name) LEFT JOIN ext USING (category))
SELECT name, category, diversity, max(diversity) OVER (PARTITION BY name) AS pattern_diversity FROM v""")
def pattern_diversity_of_pairs(s, d):
    t, p, c = _pairs_of_concepts(s, d)
    return patterns.diversity(p, c, t, members(s, d)).select("name", "category", "diversity", "pattern_diversity")


@query(" SELECT source AS key, CAST(count(*) AS VARCHAR) AS value FROM documents_ WHERE source IS NOT NULL GROUP BY source UNION ALL SELECT 'untouched', 'x'")
def stored_settings(s, d):
    """Settings written by key: a stored value of another key stays, one of the same key is replaced."""
    now = F.lit("2021-01-01").cast("timestamp")
    old = s.createDataFrame([("untouched", "x"), ("brenegate_wire", "old")], "key string, value string").withColumn("created_at", now).withColumn("updated_at", now)
    new = documents(s, d).where("source IS NOT NULL").groupBy(F.col("source").alias("key")).agg(F.count("*").cast("string").alias("value"))
    return upsert.upsert(old, new, ["key"], now).select("key", "value")


@query(""", b AS (SELECT user_id AS symbol, CAST(ts AS DATE) AS date, arg_max(value, (ts, event_id)) AS close FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL GROUP BY ALL)
SELECT symbol, date, CASE WHEN symbol % 2 = 0 THEN close ELSE 0.0 END AS close, symbol % 2 = 0 AND close <> 0.0 AS renewed FROM b""")
def upserted_bars(s, d):
    """Daily bars put into a table that has all days with a close of 0; only even symbols are delivered."""
    t = lambda x: F.lit(x).cast("timestamp")
    bars = _bars(s, d).select("symbol", "date", "close")
    old = bars.withColumn("close", F.lit(0.0)).withColumn("created_at", t("2020-01-01")).withColumn("updated_at", t("2020-01-01"))
    out = upsert.upsert(old, bars.where("symbol % 2 = 0"), ["symbol", "date"], t("2021-01-01"))
    return out.select("symbol", "date", "close", (F.col("updated_at") > t("2020-06-01")).alias("renewed"))


@query(SEEDS + ", l AS (SELECT name, list_sort(list(doc)) AS docs FROM covered GROUP BY name) SELECT name, array_to_string(CASE WHEN name IN (FROM concepts) THEN list_filter(docs, lambda x: x <> m) ELSE docs END, ',') AS docs FROM l, (SELECT min(doc) AS m FROM covered)")
def pulled_documents(s, d):
    """Patterns with the list of their documents, from which one document is pulled where the pattern is one of the two most frequent concepts."""
    t, _, cov = _single(s, d)
    lists = durable(cov.groupBy("name").agg(F.array_sort(F.collect_list("doc")).alias("docs")), "lists")
    first = cov.agg(F.min("doc")).first()[0]
    return upsert.pull(lists, "docs", F.lit(first), F.col("name").isin(top_concepts(t))).select("name", F.array_join(F.col("docs").cast("array<string>"), ",").alias("docs"))


@query(" SELECT doc, source FROM documents_ WHERE contains(lower(title), 'price') OR contains(lower(source), 'price') ORDER BY source DESC NULLS LAST, doc LIMIT 20 OFFSET 20")
def grid_page(s, d):
    return grid.grid(documents(s, d), [], ["doc", "source"], (["title", "source"], "price"), [("source", True)], "doc", 2, 20)


@query(" SELECT doc, CAST(floor((row_number() OVER (ORDER BY doc) - 1) / 100) AS BIGINT) AS chunk FROM documents_")
def chunked_documents(s, d):
    return grid.chunks(documents(s, d).select("doc"), ["doc"], 100)


@query(" SELECT 'documents' AS name, count(*) AS rows FROM documents_ UNION ALL SELECT 'dec', count(*) FROM dec UNION ALL SELECT 'mentions', count(*) FROM mentions UNION ALL SELECT 'members', count(*) FROM members UNION ALL SELECT 'hierarchy', count(*) FROM hierarchy UNION ALL SELECT 'stats', count(*) FROM stats")
def catalog(s, d):
    """The logical tables with their numbers of rows."""
    out = None
    for name, view in (("documents", documents), ("dec", dec), ("mentions", mentions), ("members", members), ("hierarchy", hierarchy), ("stats", stats)):
        one = view(s, d).agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = one if out is None else out.union(one)
    return out


@query(ALIASES + """, chosen AS (SELECT doc FROM documents_ WHERE doc % 100 = 0), c AS (SELECT doc, entity, count(*) AS n_concepts, max(score) AS best FROM dec WHERE doc IN (FROM chosen) GROUP BY ALL)
SELECT m.doc, m.entity, tfidf, external_id, coalesce(n_concepts, 0) AS n_concepts, best, state, sentiment FROM mentions m JOIN chosen USING (doc) JOIN documents_ USING (doc) LEFT JOIN aliases a ON a.entity = m.entity LEFT JOIN c ON c.doc = m.doc AND c.entity = m.entity""")
def document_details(s, d):
    """The page of a document: its state, its entities with what the graph knows of them, and their concepts."""
    docs = documents(s, d).where("doc % 100 = 0").select("doc", "state", "sentiment")
    per = dec(s, d).groupBy("doc", "entity").agg(F.count("*").alias("n_concepts"), F.max("score").alias("best"))
    rows = A.with_alias(mentions(s, d).join(docs, "doc"), _aliases(s, d)).join(per, ["doc", "entity"], "left")
    return rows.select("doc", "entity", "tfidf", "external_id", F.coalesce("n_concepts", F.lit(0)).alias("n_concepts"), "best", "state", "sentiment")


# --- samples and evaluation


@query(", s AS (SELECT name FROM (SELECT DISTINCT category AS name FROM dec) WHERE name NOT IN (FROM concepts) ORDER BY md5(concat_ws('|', '3', name)), name LIMIT 5) SELECT name, false AS fixed FROM s UNION ALL SELECT category, true FROM concepts")
def sampled_patterns(s, d):
    """Two fixed names and five drawn by a seeded hash."""
    t = dec(s, d)
    fixed = top_concepts(t)
    names = t.select(F.col("category").alias("name")).distinct()
    drawn = graph.seeded_sample(names.where(~F.col("name").isin(fixed)), ["name"], 5, 3)
    return drawn.withColumn("fixed", F.lit(False)).union(names.where(F.col("name").isin(fixed)).withColumn("fixed", F.lit(True)))


@query(", n AS (SELECT DISTINCT category AS name FROM dec) SELECT name, CASE WHEN contains(name, '_') THEN 'topic' ELSE 'group' END AS kind FROM n")
def split_names(s, d):
    return evaluation.split_names(dec(s, d).select(F.col("category").alias("name")).distinct(), "_")


@query(", q AS (SELECT doc FROM (SELECT DISTINCT doc FROM dec WHERE category IN (FROM concepts)) ORDER BY md5(concat_ws('|', '7', doc)), doc LIMIT 3) SELECT doc, category, entity, score FROM dec WHERE doc IN (FROM q) AND category IN (FROM concepts)")
def survey_questions(s, d):
    """Documents of a pattern drawn by a seeded hash, with the entities that stand for its concepts."""
    t = dec(s, d)
    concepts = top_concepts(t)
    drawn = graph.seeded_sample(t.where(F.col("category").isin(concepts)).select("doc").distinct(), ["doc"], 3, 7)
    return search.explained(drawn, t, s.createDataFrame([(c,) for c in concepts], "category string"))


@query(", e AS (SELECT category AS name, count(DISTINCT doc) AS docs, count(DISTINCT CASE WHEN score IS NOT NULL THEN doc END) AS done FROM dec GROUP BY category) SELECT name, CAST(docs - done AS INTEGER) AS remaining FROM e")
def remaining_answers(s, d):
    per = dec(s, d).groupBy(F.col("category").alias("name"), "doc").agg(F.max("score").alias("score"))
    lists = per.groupBy("name").agg(F.collect_list("doc").alias("documents"), F.map_from_entries(F.array_compact(F.collect_list(F.when(F.col("score").isNotNull(), F.struct("doc", "score"))))).alias("scores"))
    return evaluation.remaining(lists)


@query(", r AS (SELECT doc, category FROM dec GROUP BY ALL), done AS (SELECT doc, category, max(CASE WHEN score >= 0.5 THEN 2 ELSE 1 END) AS version FROM dec WHERE score IS NOT NULL GROUP BY ALL) SELECT doc, category FROM r WHERE (doc, category) NOT IN (SELECT (doc, category) FROM done WHERE version >= 2)")
def unfinished_records(s, d):
    t = dec(s, d)
    results = t.where("score IS NOT NULL").select("doc", "category", F.when(F.col("score") >= 0.5, 2).otherwise(1).alias("version"))
    return pipeline.unfinished(t.select("doc", "category").distinct(), results, ["doc", "category"], 2)


# --- scalar functions on real columns


@query(""", u AS (SELECT DISTINCT entity, CASE length(entity) % 7 WHEN 0 THEN 'http://dbpedia.org/ontology/' WHEN 1 THEN 'http://dbpedia.org/class/yago/' WHEN 2 THEN 'http://dbpedia.org/resource/' WHEN 3 THEN 'http://www.w3.org/2000/01/rdf-schema#' WHEN 4 THEN 'http://dbpedia.org/property/' ELSE 'http://else/where/' END AS pre FROM mentions)
SELECT entity, CASE length(entity) % 7 WHEN 0 THEN 'dbo:' WHEN 1 THEN 'yago:' WHEN 2 THEN 'DBpedia:' WHEN 3 THEN 'rdfs:' WHEN 4 THEN 'dbp:' ELSE 'other:' END || CASE WHEN length(entity) % 7 > 4 THEN split_part(entity, '/', -1) ELSE entity END AS short, replace(entity, ' ', '_') AS local FROM u""")
def short_addresses(s, d):
    starts = ["http://dbpedia.org/ontology/", "http://dbpedia.org/class/yago/", "http://dbpedia.org/resource/", "http://www.w3.org/2000/01/rdf-schema#", "http://dbpedia.org/property/", "http://else/where/", "http://else/where/"]
    url = F.concat(F.element_at(F.array(*map(F.lit, starts)), F.char_length("entity") % 7 + 1), F.col("entity"))
    rows = mentions(s, d).select("entity").distinct().withColumn("url", url)
    resource = F.concat(F.lit(starts[2]), F.col("entity"))
    return rows.select("entity", C.shorten_url("url").alias("short"), C.local_id(resource, starts[2]).alias("local"))


@query(" SELECT doc, string_agg(DISTINCT entity, '|' ORDER BY entity) AS entities, 'Category:A|Category:B' AS concepts FROM mentions WHERE NOT regexp_matches(entity, '[|,]') AND NOT starts_with(entity, 'Category:') GROUP BY doc")
def split_term_lists(s, d):
    plain = mentions(s, d).where(~F.col("entity").rlike("[|,]") & ~F.startswith("entity", F.lit("Category:")))
    joined = plain.groupBy("doc").agg(F.concat_ws(" | ", F.lit("Category:B"), F.array_join(F.collect_set("entity"), " , "), F.lit(" Category:A ")).alias("terms"))
    out = joined.select("doc", C.split_terms("terms").alias("t"))
    return out.select("doc", F.array_join("t.entities", "|").alias("entities"), F.array_join("t.concepts", "|").alias("concepts"))


@query(" SELECT doc, CASE WHEN least(p, m) < 1000000 THEN substr(text, 1, least(p, m) - 1) ELSE text END AS cut FROM (SELECT doc, text, CASE WHEN strpos(lower(text), 'prices') > 1 THEN strpos(lower(text), 'prices') ELSE 1000000 END AS p, CASE WHEN strpos(lower(text), 'market') > 1 THEN strpos(lower(text), 'market') ELSE 1000000 END AS m FROM documents_ WHERE text IS NOT NULL)")
def cut_texts(s, d):
    return documents(s, d).where("text IS NOT NULL").select("doc", C.cut_at("text", ["Prices", "MARKET"]).alias("cut"))


@query(" SELECT c_custkey AS id, CASE WHEN c_acctbal >= 0 THEN round(floor(c_acctbal) / 10 * CASE WHEN c_custkey % 2 = 0 THEN 1000 ELSE 1 END, 4) END AS millions FROM customer")
def amounts(s, d):
    unit = F.when(F.col("c_custkey") % 2 == 0, "B").otherwise("M")
    text = F.concat(F.lit("$"), (F.floor("c_acctbal") / 10).cast("decimal(12,1)").cast("string"), unit)
    return table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.round(C.amount_in_millions(text), 4).alias("millions"))


@query(" SELECT doc, CASE WHEN sentiment < 0 THEN sentiment WHEN sentiment < 0.1 THEN 0.0 ELSE sentiment END AS signed FROM documents_")
def signed_sentiments(s, d):
    label = F.when(F.col("sentiment") < 0, "NEG").when(F.col("sentiment") < 0.1, "NEU").otherwise("POS")
    return documents(s, d).select("doc", C.signed_sentiment(label, F.abs("sentiment")).alias("signed"))


@query(", l AS (SELECT doc, list_sort(list_distinct(list(entity_type))) AS l FROM mentions WHERE entity_type IS NOT NULL GROUP BY doc) SELECT doc, array_to_string(list_filter(l, lambda x, i: (m >> (i - 1)) & 1 = 1), ',') AS subset FROM l, unnest(range(0, CAST(pow(2, len(l)) AS BIGINT))) AS r(m)")
def type_subsets(s, d):
    per = mentions(s, d).where("entity_type IS NOT NULL").groupBy("doc").agg(F.array_sort(F.collect_set("entity_type")).alias("l"))
    return per.select("doc", F.explode(C.subsets("l")).alias("x")).select("doc", F.array_join("x", ",").alias("subset"))


@query(" SELECT doc, strftime(published, '%Y-%m-%d %H:%M:%S') AS at, strftime(published, '%Y-%m-%d') AS day, CAST(floor((epoch(TIMESTAMP '2024-01-01') - epoch(date_trunc('second', published))) / 60) AS BIGINT) AS minutes, coalesce(floor((epoch(TIMESTAMP '2024-01-01') - epoch(date_trunc('second', published))) / 60) <= 60 * 24 * 365, false) AS fresh, '{\"doc\":' || doc || '}' AS json FROM documents_")
def time_forms(s, d):
    now = F.lit("2024-01-01").cast("timestamp_ntz")
    return documents(s, d).select("doc", C.format_time("published").alias("at"), C.format_time("published", True).alias("day"), C.minutes_between("published", now).alias("minutes"), C.is_fresh("published", now, 60 * 24 * 365).alias("fresh"), C.json_text(F.struct("doc")).alias("json"))


@query(""", h AS (SELECT doc, CASE WHEN strpos(title, ' ') > 0 THEN substr(title, 1, strpos(title, ' ')) || lower(substr(title, strpos(title, ' ') + 1)) ELSE title END || CASE WHEN ends_with(title, '.') THEN ' ' ELSE '. ' END AS head, text FROM documents_ WHERE title IS NOT NULL)
SELECT doc, CASE WHEN contains(lower(head), lower(text)) THEN head ELSE head || coalesce(text, '') END AS lead FROM h""")
def lead_snippets(s, d):
    return documents(s, d).where("title IS NOT NULL").select("doc", articles.lead_snippet(F.col("title"), F.col("text")).alias("lead"))


@query(""", l AS (SELECT doc, string_split(text, chr(10)) AS l FROM documents_ WHERE text IS NOT NULL), k AS (SELECT doc, CASE WHEN len(l) > 3 THEN l[2:len(l) - 2] END AS k FROM l)
SELECT doc, CASE WHEN k IS NOT NULL THEN array_to_string(list_prepend(CASE WHEN strpos(k[1], ' - ') > 0 THEN substr(k[1], strpos(k[1], ' - ') + 3) ELSE '' END, k[2:]), chr(10)) END AS body FROM k""")
def trimmed_bodies(s, d):
    return documents(s, d).where("text IS NOT NULL").select("doc", articles.trimmed_body(F.col("text"), 1, 2).alias("body"))


@query(" SELECT doc, CASE WHEN text IS NULL THEN NULL ELSE 'doc ' || doc END AS inside FROM documents_")
def element_texts(s, d):
    page = F.concat(F.lit("<html><p>no<br>thing</p><div id='main'> doc <b>"), F.col("doc").cast("string"), F.lit("</b>\n </div><i>tail</i></html>"))
    return documents(s, d).select("doc", C.html_text(F.when(F.col("text").isNotNull(), page), "bullets", "main").alias("inside"))


@query(" SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WHERE ts IS NOT NULL)) GROUP BY user_id, run")
def event_sessions(s, d):
    return events.sessions(table(s, d, "events").where("ts IS NOT NULL"))


@query(" SELECT doc, CASE WHEN state IS NULL THEN 'done' ELSE state END AS state, state IS NULL AS stepped FROM documents_")
def queued_work(s, d):
    rows = documents(s, d).select("doc", F.coalesce("state", F.lit("waiting")).alias("state"), F.lit(False).alias("stepped"))
    return events.work_queue(rows, "state", "waiting", lambda x: x.withColumn("stepped", F.lit(True)), "done")


@query(" SELECT date_trunc('hour', ts) AS start, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1")
def streamed_events(s, d):
    """The events read as a stream to its end, each once, and counted by hour from what the sink kept."""
    def build() -> DataFrame:
        base = f"{shared_dir(s)}/rollstone-stream-{uuid.uuid4().hex}"
        table(s, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", "props").write.parquet(f"{base}/in")
        stream = events.read_events(s, f"{base}/in").where("ts IS NOT NULL")
        events.run_to_end(stream, lambda b, i: b.write.mode("overwrite").parquet(f"{base}/out/batch={i}"), f"{base}/checkpoint")
        return s.read.parquet(f"{base}/out").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("start")).agg(F.count("*").alias("n"))

    return remembered(s, f"streamed {d}", build)


# --- readers: feeds written from the tables, and read again


def _folder(s: SparkSession) -> str:
    return f"{shared_dir(s)}/rollstone-feed-{uuid.uuid4().hex}"


def _feed(df: DataFrame) -> str:
    """One JSON object a file, as an API answers; rows of df are the objects."""
    path = _folder(df.sparkSession)
    df.write.option("maxRecordsPerFile", 1).json(path)
    return path


READ = " SELECT doc, title, text FROM documents_ WHERE title IS NOT NULL AND text IS NOT NULL AND text <> ''"


def _for_feed(s, d):
    rows = documents(s, d).where("title IS NOT NULL AND text IS NOT NULL AND text <> ''")
    return rows.select(F.concat(F.lit("http://feed/"), F.col("doc").cast("string")).alias("url"), "title", "text", F.date_format("published", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"), F.col("doc") % 5)


_READ_SQL = ", r AS (" + READ + ") SELECT 'http://feed/' || r.doc AS url, r.title, {0} AS content, date_trunc('second', published) AS published, 'feed' AS source FROM r JOIN documents_ USING (doc) {1}"


def _out(df: DataFrame) -> DataFrame:
    return df.withColumn("published", F.col("published").cast("timestamp_ntz"))


@query(_READ_SQL.format("r.text", "WHERE r.doc % 3 <> 0"))
def read_aggregator(s, d):
    """Addresses carry a query part, which goes; a third of them is known already."""
    rows = _for_feed(s, d).select(F.col("(doc % 5)").alias("g"), F.struct("title", F.col("text").alias("description"), F.concat("url", F.lit("?a=1")).alias("url"), F.col("at").alias("published_at")).alias("x"))
    path = _feed(rows.groupBy("g").agg(F.collect_list("x").alias("data")).select("data"))
    known = documents(s, d).where("doc % 3 = 0").select(F.concat(F.lit("http://feed/"), F.col("doc").cast("string")).alias("url"))
    return _out(readers.aggregator_json(s, path, "feed", known))


@query(_READ_SQL.format("r.text || ' ' || r.title", "WHERE r.doc % 4 <> 0"))
def read_archive(s, d):
    rows = _for_feed(s, d).select(F.col("(doc % 5)").alias("g"), F.struct(F.col("url").alias("web_url"), F.when(F.col("url").rlike("[02468]$") & (F.regexp_extract("url", "([0-9]+)$", 1).cast("bigint") % 4 == 0), "Video").otherwise("News").alias("type_of_material"), F.lit("World").alias("section"), F.col("at").alias("pub_date"), F.col("text").alias("abstract"), F.col("title").alias("lead_paragraph"), F.struct(F.col("title").alias("main")).alias("headline")).alias("x"))
    path = _feed(rows.groupBy("g").agg(F.collect_list("x").alias("docs")).select(F.struct("docs").alias("response")))
    return _out(readers.archive_json(s, path, "feed"))


@query(_READ_SQL.format("r.text", ""))
def read_latest(s, d):
    rows = _for_feed(s, d).select(F.col("(doc % 5)").alias("g"), F.struct("url", F.lit("News").alias("material_type_facet"), F.lit("World").alias("section"), F.col("at").alias("published_date"), F.col("text").alias("abstract"), "title").alias("x"))
    return _out(readers.latest_json(s, _feed(rows.groupBy("g").agg(F.collect_list("x").alias("results")).select("results")), "feed"))


@query(_READ_SQL.format("r.text", ""))
def read_search(s, d):
    rows = _for_feed(s, d).select("url", "title", "text", F.lit(None).cast("string").alias("publishDate"), F.col("at").alias("discoverDate"))
    return _out(readers.search_json(s, _feed(rows), "feed"))


_PLAIN = "trim(regexp_replace({0}, '[\\x00-\\x20]+', ' ', 'g'), ' ')"


@query(", r AS (" + READ + f") SELECT 'http://feed/' || r.doc AS url, {_PLAIN.format('r.title')} AS title, {_PLAIN.format('r.text')} AS content, date_trunc('second', published) AS published, 'feed' AS source FROM r JOIN documents_ USING (doc) WHERE length({_PLAIN.format('r.text')}) >= 200 AND r.doc % 2 = 0")
def read_newswire(s, d):
    """White space is one blank in the feed, as XML doesn't keep line ends as they are."""
    num = F.regexp_extract("url", "([0-9]+)$", 1).cast("bigint")
    plain = lambda c: F.trim(F.regexp_replace(c, "[\\x00-\\x20]+", " ")).alias(c)
    rows = _for_feed(s, d).select("url", plain("title"), plain("text"), "at")
    item = F.struct(F.struct(F.col("title").alias("headline"), F.struct(F.when(num % 2 == 0, "en").otherwise("fr").alias("_tag")).alias("language")).alias("contentMeta"), F.struct(F.struct(F.struct(F.col("text").alias("body")).alias("xhtml")).alias("inlineXML")).alias("contentSet"))
    made = rows.select(F.struct(F.struct(F.col("at").alias("TimeStamp"), F.col("url").alias("Id")).alias("Info")).alias("Header"), F.struct(F.struct(F.struct(item.alias("newsItem")).alias("Data")).alias("ContentItem")).alias("Body"))
    path = _folder(s)
    made.write.format("xml").option("rowTag", "ContentEnvelope").option("rootTag", "all").save(path)
    return _out(readers.newswire_xml(s, path, "feed", [], [], 200))


@query(""", b AS (SELECT user_id AS symbol, CAST(ts AS DATE) AS date, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS volume FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL GROUP BY ALL)
SELECT CAST(symbol AS VARCHAR) AS symbol, date, open, high, low, close, volume, close AS adjusted_close, round(CASE WHEN open > 0 THEN (close - open) / open * 100 ELSE 0 END, 4) AS delta FROM b""")
def read_prices(s, d):
    n = table(s, d, "events").where("user_id IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL").groupBy(F.col("user_id").alias("symbol"), F.to_date("ts").alias("date")).agg(F.count("*").alias("volume"))
    bars = _bars(s, d).drop("delta").join(n, ["symbol", "date"])
    value = F.map_from_arrays(F.array(*map(F.lit, ("1. open", "2. high", "3. low", "4. close", "5. adjusted close", "6. volume"))), F.array(*(F.col(c).cast("string") for c in ("open", "high", "low", "close", "close", "volume"))))
    per = bars.select("symbol", F.col("date").cast("string").alias("date"), value.alias("v")).groupBy("symbol").agg(F.map_from_entries(F.collect_list(F.struct("date", "v"))).alias("Time Series (Daily)"))
    path = _feed(per.select(F.create_map(F.lit("2. Symbol"), F.col("symbol").cast("string")).alias("Meta Data"), "Time Series (Daily)"))
    return readers.daily_prices_json(s, path).select("symbol", "date", "open", "high", "low", "close", "volume", "adjusted_close", F.round("delta", 4).alias("delta"))


@query(" SELECT 'S' || p_partkey AS symbol, p_name AS name, p_brand AS sector, p_type AS industry, CAST(CASE WHEN p_partkey % 3 > 0 THEN 1950 + p_size END AS INTEGER) AS ipo_year, CAST(CASE WHEN p_size > 25 THEN p_size * 1000 ELSE p_size END AS DOUBLE) AS market_cap FROM part")
def read_listing(s, d):
    cap = F.concat(F.lit("$"), F.col("p_size").cast("string"), F.when(F.col("p_size") > 25, "B").otherwise("M"))
    rows = table(s, d, "part").select(F.concat(F.lit("S"), F.col("p_partkey").cast("string")).alias("Symbol"), F.col("p_name").alias("Name"), F.col("p_brand").alias("Sector"), F.col("p_type").alias("industry"), F.when(F.col("p_partkey") % 3 > 0, (1950 + F.col("p_size")).cast("string")).otherwise("n/a").alias("IPOyear"), cap.alias("MarketCap"))
    path = _folder(s)
    grid.export_csv(rows, path)
    return readers.listing_csv(s, path)


@query(" SELECT category AS name, any_value(category) AS category, min(entity) AS target_entity_id, 'member' AS attribute, max(entity) AS fact_id, CAST(count(*) AS INTEGER) AS target_fact_count, 0.5::DOUBLE AS e_score, 1 AS num_peer_has_attribute, 2 AS peer_size, 3 AS fact_space_size FROM members GROUP BY category")
def read_facts(s, d):
    rows = members(s, d).groupBy("category").agg(F.min("entity").alias("target_entity_id"), F.max("entity").alias("fact_id"), F.count("*").alias("n"))
    path = _folder(s)
    grid.export_csv(rows.select(F.col("category").alias("name"), "category", "target_entity_id", F.lit("member").alias("attribute"), "fact_id", F.col("n").alias("target_fact_count"), F.lit(0.5).alias("e_score"), F.lit(1).alias("num_peer_has_attribute"), F.lit(2).alias("peer_size"), F.lit(3).alias("fact_space_size")), path)
    return readers.facts_csv(s, path)


@query(" SELECT source AS key, CAST(date_trunc('second', max(published)) AS TIMESTAMP) AS as_time FROM documents_ WHERE source IS NOT NULL AND published IS NOT NULL GROUP BY source")
def read_settings(s, d):
    rows = documents(s, d).where("source IS NOT NULL AND published IS NOT NULL").groupBy(F.col("source").alias("key")).agg(C.format_time(F.max("published")).alias("value"))
    path = _folder(s)
    rows.write.json(path)
    return readers.settings(s, path).select("key", F.col("as_time").cast("timestamp_ntz").alias("as_time"))
