"""Readers and streams over small files."""

import json

from pyspark.sql import functions as F

from rollstone.sources import readers
from rollstone.streaming import events


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_json_feeds(spark, tmp_path):
    known = spark.createDataFrame([("http://a/2",)], "url string")
    data = {"data": [{"title": "t", "description": "d", "url": "http://a/1?x=1", "published_at": "2021-10-16T10:50:11+00:00"}, {"title": "t", "description": "", "url": "http://a/3"}, {"title": "t", "description": "d", "url": "http://a/2?y"}]}
    got = readers.aggregator_json(spark, put(tmp_path, "a.json", json.dumps(data)), "s", known).collect()
    assert [(r.url, r.content, str(r.published), r.source) for r in got] == [("http://a/1", "d", "2021-10-16 10:50:11", "s")]
    doc = {"web_url": "u1", "type_of_material": "News", "section": None, "pub_date": "2021-01-02T00:00:00Z", "abstract": "a", "lead_paragraph": "l", "headline": {"main": "h"}}
    docs = {"response": {"docs": [doc, doc | {"web_url": "u2", "section": "Corrections"}, doc | {"web_url": "u3", "type_of_material": "Op-Ed"}]}}
    assert [(r.url, r.title, r.content) for r in readers.archive_json(spark, put(tmp_path, "b.json", json.dumps(docs)), "s").collect()] == [("u1", "h", "a l")]
    late = {"results": [{"url": "u1", "material_type_facet": "News", "section": "World", "published_date": "2021-01-02T00:00:00Z", "abstract": "a", "title": "t"}, {"url": "u2", "material_type_facet": "Video"}]}
    assert readers.latest_json(spark, put(tmp_path, "c.json", json.dumps(late)), "s", known).count() == 1
    found = [{"url": "u1", "title": "t", "text": "x", "publishDate": None, "discoverDate": "2018-03-19T21:39:00.820+0000"}, {"url": "u2", "title": "t", "text": "x", "publishDate": "2018-03-19T19:56:41", "discoverDate": "2018-03-20T19:56:41"}]
    got = {r.url: str(r.published) for r in readers.search_json(spark, put(tmp_path, "d.json", json.dumps(found)), "s").collect()}
    assert got == {"u1": "2018-03-19 21:39:00.820000", "u2": "2018-03-19 19:56:41"}


def test_newswire(spark, tmp_path):
    one = "<ContentEnvelope><Header><Info><TimeStamp>2014-05-01T00:00:00Z</TimeStamp><Id>{i}</Id></Info></Header><Body><ContentItem><Data><newsItem><contentMeta><headline>{t}</headline><language tag='{l}'/></contentMeta><contentSet><inlineXML><xhtml><body>{b}</body></xhtml></inlineXML></contentSet></newsItem></Data></ContentItem></Body></ContentEnvelope>"
    xml = "<all>" + "".join(one.format(i=i, t=t, l=lang, b=b) for i, t, lang, b in [(1, "Good", "en", "x" * 600 + "(Editing by y)"), (2, "TABLE-x", "en", "x" * 600), (3, "Short", "en", "x" * 600 and "STOP" + "x" * 600), (4, "Other", "fr", "x" * 600)]) + "</all>"
    got = readers.newswire_xml(spark, put(tmp_path, "n.xml", xml), "w", ["TABLE"], ["(Editing by", "STOP"]).collect()
    assert [(r.url, len(r.content)) for r in got] == [("1", 600)]


def test_side_tables(spark, tmp_path):
    day = {"1. open": "10", "2. high": "12", "3. low": "9", "4. close": "11", "6. volume": "100"}
    prices = {"Meta Data": {"2. Symbol": "S"}, "Time Series (Daily)": {"2021-01-04": day, "2021-01-05": day | {"1. open": "0"}}}
    got = {str(r.date): (r.symbol, r.volume, r.delta) for r in readers.daily_prices_json(spark, put(tmp_path, "p.json", json.dumps(prices))).collect()}
    assert got == {"2021-01-04": ("S", 100, 10.0), "2021-01-05": ("S", 100, 0.0)}
    listing = "Symbol,Name,Sector,industry,IPOyear,MarketCap\nA,B,C,D,1999,$1.5B\nE,F,G,H,n/a,$20M\n"
    assert {(r.symbol, r.ipo_year, r.market_cap) for r in readers.listing_csv(spark, put(tmp_path, "l.csv", listing)).collect()} == {("A", 1999, 1500.0), ("E", None, 20.0)}
    facts = "name,category,target_entity_id,attribute,fact_id,target_fact_count,e_score,num_peer_has_attribute,peer_size,fact_space_size\nn,c,t,a,f,1,0.5,2,3,4\n"
    assert readers.facts_csv(spark, put(tmp_path, "f.csv", facts)).first().e_score == 0.5
    kv = '{"key":"a","value":"2021-01-01 00:00:00"}\n{"key":"b","value":"{\\"x\\":\\"1\\"}"}\n'
    got = {r.key: (r.as_time is not None, r.as_map) for r in readers.settings(spark, put(tmp_path, "kv.json", kv)).collect()}
    assert got["a"][0] and got["b"] == (False, {"x": "1"})


def test_streams_agree_with_batches(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i % 60:02d}:00", i % 3, "ab"[i % 2], float(i)) for i in range(120)]
    df = spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("props", F.lit("{}"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    got = []
    stream = events.windowed(events.read_events(spark, str(tmp_path / "in"), 1))
    events.run_to_end(stream, lambda d, _: got.extend(d.collect()), str(tmp_path / "check"), "update")
    last = {(r.start, r.event_type): (r.n, r.total) for r in got}
    assert last == {(r.start, r.event_type): (r.n, r.total) for r in events.windowed(df).collect()}
    once = []
    events.run_to_end(events.distinct_events(events.read_events(spark, str(tmp_path / "in"))), lambda d, _: once.append(d.count()), str(tmp_path / "check2"))
    assert sum(once) == 120
    assert events.sessions(df, "30 minutes").agg(F.sum("n")).first()[0] == 120


def test_work_queue(spark):
    df = spark.createDataFrame([(1, "new"), (2, "done"), (3, None)], "id int, state string")
    out = events.work_queue(df, "state", "new", lambda d: d.withColumn("id", F.col("id") * 10), "done")
    assert {tuple(r) for r in out.collect()} == {(10, "done"), (2, "done"), (3, None)}
