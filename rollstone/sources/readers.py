"""Readers for raw articles and side tables. All take paths or text files and give typed DataFrames; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import amount_in_millions, change_percent

ARTICLE = "url string, title string, content string, published timestamp, source string"


def _fresh(df: DataFrame, known: DataFrame | None, *urls: str) -> DataFrame:
    for u in urls if known is not None else ():
        df = df.join(known.select(F.col("url").alias(u)).distinct(), u, "left_anti")
    return df


def _articles(df: DataFrame, source: str) -> DataFrame:
    return df.select("url", "title", "content", "published", F.lit(source).alias("source"))


def aggregator_json(spark: SparkSession, path: str, source: str, known: DataFrame | None = None) -> DataFrame:
    """Articles of {"data": [{title, description, url, published_at}]}: without those that have no description or whose address, with or without its query part, is known."""
    schema = "data array<struct<title string, description string, url string, published_at string>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("data").alias("d")).select("d.*").where("description <> ''")
    rows = rows.withColumn("full", F.col("url")).withColumn("url", F.split("url", "\\?")[0])
    rows = _fresh(rows, known, "full", "url")
    return _articles(rows.withColumn("content", F.col("description")).withColumn("published", F.try_to_timestamp("published_at")), source)


def archive_json(spark: SparkSession, path: str, source: str, known: DataFrame | None = None, kind: str = "News", left_out: tuple[str, ...] = ("Corrections",)) -> DataFrame:
    """Articles of {"response": {"docs": [...]}}: of the wanted kind, not of the left-out sections; content is abstract and lead."""
    schema = "response struct<docs array<struct<web_url string, type_of_material string, section string, pub_date string, abstract string, lead_paragraph string, headline struct<main string>>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("response.docs").alias("d")).select("d.*")
    rows = rows.where(F.col("type_of_material") == kind).where(F.col("section").isNull() | ~F.col("section").isin(*left_out))
    rows = rows.select(F.col("web_url").alias("url"), F.col("headline.main").alias("title"), F.concat_ws(" ", "abstract", "lead_paragraph").alias("content"), F.try_to_timestamp("pub_date").alias("published"))
    return _articles(_fresh(rows, known, "url"), source)


def latest_json(spark: SparkSession, path: str, source: str, known: DataFrame | None = None, kind: str = "News", left_out: tuple[str, ...] = ("Corrections",)) -> DataFrame:
    """Articles of {"results": [...]} with the names of a latest-news feed."""
    schema = "results array<struct<url string, material_type_facet string, section string, published_date string, abstract string, title string>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("results").alias("d")).select("d.*")
    rows = rows.where(F.col("material_type_facet") == kind).where(F.col("section").isNull() | ~F.col("section").isin(*left_out))
    return _articles(_fresh(rows.select("url", "title", F.col("abstract").alias("content"), F.try_to_timestamp("published_date").alias("published")), known, "url"), source)


def search_json(spark: SparkSession, path: str, source: str, known: DataFrame | None = None) -> DataFrame:
    """Articles of a list of {url, title, text, publishDate, discoverDate}; the date of discovery stands in for a missing one."""
    rows = spark.read.schema("url string, title string, text string, publishDate string, discoverDate string").option("multiLine", True).json(path)
    when = F.coalesce(F.try_to_timestamp("publishDate"), F.try_to_timestamp("discoverDate"), F.try_to_timestamp("discoverDate", F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSZ")))
    return _articles(_fresh(rows.select("url", "title", F.col("text").alias("content"), when.alias("published")), known, "url"), source)


def newswire_xml(spark: SparkSession, path: str, source: str, title_without: list[str], stop_phrases: list[str], least_chars: int = 501, language: str = "en") -> DataFrame:
    """Articles of an archive of ContentEnvelope elements: titles without the given parts, bodies cut at each stop phrase, long enough and of one language."""
    schema = (
        "Header struct<Info: struct<TimeStamp: string, Id: string>>, Body struct<ContentItem: struct<Data: struct<newsItem: struct<contentMeta: struct<headline: string, language: struct<_tag: string>>,"
        "contentSet: struct<inlineXML: struct<xhtml: struct<body: string>>>>>>>"
    )
    item = "Body.ContentItem.Data.newsItem"
    rows = spark.read.format("xml").option("rowTag", "ContentEnvelope").schema(schema).load(path)
    rows = rows.select(F.col("Header.Info.Id").alias("url"), F.col(f"{item}.contentMeta.headline").alias("title"), F.col(f"{item}.contentSet.inlineXML.xhtml.body").alias("content"), F.try_to_timestamp("Header.Info.TimeStamp").alias("published"), F.col(f"{item}.contentMeta.language._tag").alias("lang"))
    for part in title_without:
        rows = rows.where(~F.contains("title", F.lit(part)))
    for phrase in stop_phrases:
        rows = rows.withColumn("content", F.substring_index("content", phrase, 1))
    return _articles(rows.where((F.char_length("content") >= least_chars) & (F.col("lang") == language)), source)


def daily_prices_json(spark: SparkSession, path: str) -> DataFrame:
    """symbol, date, open, high, low, close, volume, adjusted_close, dividend, split, delta (null where the feed lacks it) of {"Meta Data": ..., "Time Series (Daily)": {date: {"1. open": ...}}}."""
    schema = "`Meta Data` map<string,string>, `Time Series (Daily)` map<string,map<string,string>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.element_at("`Meta Data`", "2. Symbol").alias("symbol"), F.explode("`Time Series (Daily)`").alias("date", "v"))
    get = lambda k, t: F.element_at("v", k).cast(t)
    rows = rows.select("symbol", F.to_date("date").alias("date"), *(get(f"{i}. {n}", "double").alias(n) for i, n in enumerate(("open", "high", "low", "close"), 1)), F.coalesce(get("6. volume", "bigint"), get("5. volume", "bigint")).alias("volume"), *(get(k, "double").alias(n) for k, n in (("5. adjusted close", "adjusted_close"), ("7. dividend amount", "dividend"), ("8. split coefficient", "split"))))
    return rows.withColumn("delta", change_percent("open", "close"))


def facts_csv(spark: SparkSession, path: str) -> DataFrame:
    schema = "name string, category string, target_entity_id string, attribute string, fact_id string, target_fact_count int, e_score double, num_peer_has_attribute int, peer_size int, fact_space_size int"
    return spark.read.schema(schema).option("header", True).csv(path)


def listing_csv(spark: SparkSession, path: str) -> DataFrame:
    """symbol, name, sector, industry, ipo_year (null unless a number), market_cap in millions."""
    rows = spark.read.schema("Symbol string, Name string, Sector string, industry string, IPOyear string, MarketCap string").option("header", True).csv(path)
    return rows.select(F.col("Symbol").alias("symbol"), F.col("Name").alias("name"), F.col("Sector").alias("sector"), "industry", F.expr("try_cast(IPOyear AS int)").alias("ipo_year"), amount_in_millions("MarketCap").alias("market_cap"))


def settings(spark: SparkSession, path: str) -> DataFrame:
    """Key-value settings: key, value, as_time (if it is a time), as_map (if it is a JSON object)."""
    rows = spark.read.schema("key string, value string").json(path)
    return rows.withColumn("as_time", F.try_to_timestamp("value")).withColumn("as_map", F.from_json("value", "map<string,string>"))
