"""The queries of this package over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..work import name_form, table
from . import bpe, cooccur, lines, mixture, neardup, setjoin, spans


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return lines.repeated_lines(table(spark, d, "news_analytics"))


def p1_clean(spark: SparkSession, d: str) -> DataFrame:
    return lines.without_repeated_lines(table(spark, d, "news_analytics"))


def _content() -> Column:
    return F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("text", F.lit("")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.expand_sets(*neardup.similar_sets(table(spark, d, "news_analytics"), "id", _content(), words=3, similarity=0.6))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.groups(*neardup.similar_sets(table(spark, d, "news_analytics"), "id", _content(), words=3, similarity=0.6))


def _similar_articles(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sets, members = setjoin.sets_of(table(spark, d, "document_entity_category"), "news_analytics", name_form("category"), least=5)
    return setjoin.similar_sets(sets, 0.75), members


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.expand_sets(*_similar_articles(spark, d))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.groups(*_similar_articles(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = cooccur.together(table(spark, d, "document_entity_category"), "news_analytics", name_form("category"), min_count=8, min_lift=3)
    return pairs.select(F.col("item_a").alias("category_a"), F.col("item_b").alias("category_b"))


def p6_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = cooccur.together(table(spark, d, "document_entity_category"), "news_analytics", name_form("category"), min_count=1, min_lift=0)
    return pairs.withColumns({c: F.round(c, 6) for c in ("lift", "odds_ratio")})


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mix(table(spark, d, "documents"), table(spark, d, "mixture_targets"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mix(table(spark, d, "documents"), table(spark, d, "mixture_targets"))[1]


def p8_bounds(spark: SparkSession, d: str) -> DataFrame:
    """The mixture measured in characters, which SQL can count: what is wanted and supplied, and whether each source is off by half its longest document at most."""
    docs = table(spark, d, "documents")
    report = mixture.mix(docs, table(spark, d, "mixture_targets"), tokenizer=None)[1]
    longest = docs.groupBy(F.lower(F.trim("source")).alias("source")).agg(F.max(F.char_length("text")).alias("longest"))
    off = F.abs(F.col("tokens") - F.least("wanted_tokens", "supply")) * 2 <= F.coalesce("longest", F.lit(0))
    return report.join(longest, "source", "left").select("source", "target_share", "max_repeats", "wanted_tokens", "supply", "short", off.alias("within"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_pairs(table(spark, d, "documents"))


def p9_extent(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_extent(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (p1_found, p1_clean, p4_found, p4_groups, p5_found, p5_groups, p6_found, p6_pairs, p7_ids, p8_mix, p8_shares, p8_bounds, p9_found, p9_extent)
    return {f.__name__: f for f in found}


_FORM = "nullif(trim(regexp_replace(category, '[ \\t_]+', '_', 'g'), '_'), '')"
_HAVE = f"have AS (SELECT DISTINCT news_analytics AS id, {_FORM} AS c FROM document_entity_category WHERE news_analytics IS NOT NULL AND {_FORM} IS NOT NULL)"
_PAIRS = f"""WITH {_HAVE}, n AS (SELECT count(DISTINCT id) AS n FROM have), single AS (SELECT c, count(*) AS k FROM have GROUP BY c),
pairs AS (SELECT a.c AS item_a, b.c AS item_b, count(*) AS n_ab FROM have a JOIN have b ON a.id = b.id AND a.c < b.c GROUP BY ALL),
counted AS (SELECT item_a, item_b, n_ab, x.k AS n_a, y.k AS n_b, n FROM pairs JOIN single x ON x.c = item_a JOIN single y ON y.c = item_b, n)"""
_P4 = """w AS (SELECT DISTINCT id, list_filter(regexp_split_to_array(lower(coalesce(title, '') || ' ' || coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM news_analytics WHERE id IS NOT NULL),
g AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w), n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
o AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS o FROM g a JOIN g b ON a.g = b.g AND a.id < b.id GROUP BY ALL),
pairs AS (SELECT id_a, id_b FROM o JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE o * 5 >= 3 * (x.n + y.n - o))"""
_P5 = f"""{_HAVE}, n AS (SELECT id, count(*) AS n FROM have GROUP BY id HAVING count(*) >= 5), h AS (SELECT have.* FROM have JOIN n USING (id)),
o AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS o FROM h a JOIN h b ON a.c = b.c AND a.id < b.id GROUP BY ALL),
pairs AS (SELECT id_a, id_b FROM o JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE o * 4 >= 3 * (x.n + y.n - o))"""


def _groups(pairs: str, ids: str) -> str:
    """The connected groups of the pairs by a recursive walk, and each id's number of pairs."""
    return f"""WITH RECURSIVE {pairs}, e AS MATERIALIZED (SELECT id_a AS a, id_b AS b FROM pairs UNION SELECT id_b, id_a FROM pairs), walk AS (SELECT a AS id, a AS reached FROM e UNION SELECT w.id, e.b FROM walk w JOIN e ON e.a = w.reached)
SELECT i.id, coalesce(w.g, i.id) AS "group", coalesce(k, 0) AS links FROM {ids} i LEFT JOIN (SELECT id, min(reached) AS g FROM walk GROUP BY id) w USING (id) LEFT JOIN (SELECT a AS id, count(*) AS k FROM e GROUP BY a) USING (id)"""


_WHITE = "[ \\t\\r\\n\\f\\v\\x{00A0}]+"


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"""WITH l AS (SELECT id, lower(regexp_replace(source, '^{_WHITE}|{_WHITE}$', '', 'g')) AS s, string_split(text, chr(10)) AS lines FROM news_analytics WHERE id IS NOT NULL AND source IS NOT NULL AND text IS NOT NULL),
e AS (SELECT id, s, unnest(lines) AS line, CAST(generate_subscripts(lines, 1) - 1 AS INTEGER) AS line_no FROM l),
f AS (SELECT id, s, line_no, lower(trim(regexp_replace(replace(line, chr(8217), chr(39)), '{_WHITE}', ' ', 'g'), ' ')) AS form FROM e),
bad AS (SELECT s, form FROM f WHERE form <> '' GROUP BY ALL HAVING count(DISTINCT id) >= 8) SELECT DISTINCT id, line_no FROM f JOIN bad USING (s, form)""",
        "p1_clean": f"""WITH l AS (SELECT row_number() OVER () AS r, id, lower(regexp_replace(source, '^{_WHITE}|{_WHITE}$', '', 'g')) AS s, string_split(text, chr(10)) AS lines FROM news_analytics),
e AS (SELECT r, id, s, unnest(lines) AS line, generate_subscripts(lines, 1) AS line_no FROM l),
f AS (SELECT *, lower(trim(regexp_replace(replace(line, chr(8217), chr(39)), '{_WHITE}', ' ', 'g'), ' ')) AS form FROM e),
bad AS (SELECT s, form, true AS bad FROM f WHERE form <> '' AND s IS NOT NULL GROUP BY ALL HAVING count(DISTINCT id) >= 8),
c AS (SELECT r, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (bad IS NULL), '') AS clean, CAST(count(bad) AS INTEGER) AS removed FROM f LEFT JOIN bad USING (s, form) GROUP BY r)
SELECT id, clean, coalesce(removed, 0) AS removed FROM l LEFT JOIN c USING (r)""",
        "p4_found": f"WITH {_P4} SELECT id_a, id_b FROM pairs",
        "p5_found": f"WITH {_P5} SELECT id_a, id_b FROM pairs",
        "p6_found": _PAIRS + " SELECT item_a AS category_a, item_b AS category_b FROM counted WHERE n_ab >= 8 AND n_ab * n >= 3 * n_a * n_b",
        "p6_pairs": _PAIRS + " SELECT *, round(n_ab * n / (CAST(n_a AS DOUBLE) * n_b), 6) AS lift, round((n_ab + 0.5) * (n - n_a - n_b + n_ab + 0.5) / ((n_a - n_ab + 0.5) * (n_b - n_ab + 0.5)), 6) AS odds_ratio FROM counted",
        "p8_bounds": """WITH n AS (SELECT lower(trim(source, ' ')) AS source, doc_id, length(text) AS n FROM documents WHERE length(text) > 0), t AS (SELECT sum(n) AS total FROM n),
s AS (SELECT source, sum(n) AS n FROM n WHERE source IS NOT NULL AND doc_id IS NOT NULL GROUP BY source)
SELECT m.source, target_share, max_repeats, CAST(floor(target_share * total) AS BIGINT) AS wanted_tokens, CAST(coalesce(s.n, 0) * max_repeats AS BIGINT) AS supply,
CAST(greatest(floor(target_share * total) - coalesce(s.n, 0) * max_repeats, 0) AS BIGINT) AS short, true AS within FROM mixture_targets m LEFT JOIN s ON s.source = m.source, t""",
        "p4_groups": _groups(_P4, "(SELECT id FROM n)"),
        "p5_groups": _groups(_P5, "(SELECT id FROM n)"),
        "p9_extent": """WITH d AS (SELECT doc_id, text, CAST(coalesce(length(text), 0) AS BIGINT) AS n_chars FROM documents), g AS (SELECT doc_id, unnest(range(1, length(text) - 148)) AS i, unnest(list_transform(range(1, length(text) - 148), lambda i: substring(text, i, 150))) AS g FROM d WHERE length(text) >= 150),
k AS (SELECT g FROM g GROUP BY g HAVING count(DISTINCT doc_id) > 1), s AS (SELECT doc_id, least(150, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 150)) AS fresh FROM g SEMI JOIN k USING (g)), c AS (SELECT doc_id, CAST(sum(fresh) AS BIGINT) AS n FROM s GROUP BY doc_id)
SELECT doc_id, n_chars, coalesce(n, 0) AS shared_chars, CASE WHEN n_chars > 0 THEN coalesce(n, 0) / n_chars ELSE 0.0 END AS shared_part FROM d LEFT JOIN c USING (doc_id)""",
        "p9_found": """WITH g AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, length(text) - 148), lambda i: substring(text, i, 150))) AS g FROM documents WHERE length(text) >= 150),
k AS (SELECT g FROM g GROUP BY g HAVING count(*) > 1), s AS (SELECT doc_id, g FROM g SEMI JOIN k USING (g))
SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id""",
    }
