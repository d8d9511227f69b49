"""Feeds as data sources against the same answers read from landing files."""

import json

import pytest
from pyspark.sql import functions as F

from emberline.sources import feeds, files, http, xml

POINTS = [[40.0 + i / 10, -3.5] for i in range(7)]
ROADS = {"elements": [{"type": "way", "id": 7, "nodes": [1, 2], "tags": {"highway": "trunk", "ref": ""}, "geometry": [{"lat": 40.1, "lon": -3.7}]}, {"type": "way", "id": 8}]}
CSV = "longitude,latitude,acq_date,frp\n-3.7,40.1,2024-01-15,5.5\n-3.8,40.2,2024-01-15,n/a\n"
XML = '<d:feed xmlns:d="urn:x"><d:situationRecord id="r1"><d:roadName> A-6 </d:roadName><d:latitude>40.1</d:latitude></d:situationRecord><d:other/></d:feed>'


def fakes():
    """Sources of the same names plus _test that are sent to the executors whole."""
    points, roads, table, document = POINTS, json.dumps(ROADS), CSV, XML
    from emberline.sources import feeds, http

    def forecast(lat, lon):
        return {"latitude": lat, "longitude": lon, "elevation": 600.0, "timezone": "UTC", "hourly": None if lat > 40.55 else {"time": ["2024-01-15T00:00", "2024-01-15T01:00"], "temperature_2m": [lat, None], "precipitation": [0.0, 1.5], "relative_humidity_2m": [40]}}

    def transport(method, url, options):
        if url == "down":
            return http.Response(503)
        if "params" in options:
            lat, lon = ([float(x) for x in options["params"][k].split(",")] for k in ("latitude", "longitude"))
            assert len(lat) <= 3
            found = [forecast(a, b) for a, b in zip(lat, lon, strict=True)]
            return http.Response(200, json.dumps(found if len(found) > 1 else found[0]).encode())
        return http.Response(200, {"roads": roads, "fires": table, "traffic": document}[url].encode())

    made = []
    for base in feeds.FEEDS:

        class Fake(base):
            sleep = staticmethod(lambda s: None)
            own = base

            @classmethod
            def name(cls):
                return f"{cls.own.name()}_test"

        Fake.transport = staticmethod(transport)
        made.append(Fake)
    return made, [forecast(*p) for p in points]


def test_feeds_are_what_landing_files_give(spark, tmp_path):
    made, forecasts = fakes()
    for f in made:
        spark.dataSource.register(f)
    now = F.lit("2024-01-16").cast("timestamp_ntz")
    lineage = ["landing_source_file", "landing_source_path", "ingestion_timestamp"]
    rows = lambda df: sorted(map(repr, (json.loads(x) for x in df.toJSON().collect())))
    for folder, name, text in (("w", "w.json", json.dumps(forecasts)), ("t", "t.xml", XML), ("f", "f.csv", CSV), ("r", "r.json", json.dumps(ROADS))):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / name).write_text(text)
    got = spark.read.format("emberline_forecasts_test").option("url", "weather").option("points", json.dumps(POINTS)).option("batch", 3).load()
    assert got.rdd.getNumPartitions() == 3 and rows(got) == rows(files.read_json(spark, f"{tmp_path}/w", now).drop(*lineage))
    got = spark.read.format("emberline_traffic_test").option("url", "traffic").load()
    assert rows(got) == rows(xml.read_xml(spark, f"{tmp_path}/t", now).drop(*lineage)) and got.count() == 1
    text = spark.read.format("emberline_fires_test").option("url", "fires").load()
    typed = files.read_csv(spark, f"{tmp_path}/f", now, schema=files.FIRE_CSV).drop(*lineage)
    assert rows(text.select(*(F.col(f.name).try_cast(f.dataType).alias(f.name) for f in typed.schema))) == rows(typed)
    got = spark.read.format("emberline_roads_test").option("url", "down,roads").load()
    element = F.struct(*got.columns).alias("e")
    assert rows(files.road_rows(got.select(F.array(element).alias("elements")))) == rows(files.read_roads(spark, f"{tmp_path}/r", now).drop(*lineage))
    with pytest.raises(Exception, match="NoAnswer"):
        spark.read.format("emberline_traffic_test").option("url", "down").load().count()


def test_the_rate_is_shared_by_offset():
    reader = feeds._Forecasts({"points": json.dumps([[0, 0]] * 120), "batch": "10", "points_a_minute": "50", "url": "u"}, http.urllib_transport, None)
    parts = reader.partitions()
    first = parts[0].not_before
    assert [round(p.not_before - first) for p in parts] == [0] * 5 + [60] * 5 + [120] * 2 and sum(len(p.points) for p in parts) == 120
    waits = []
    late = feeds._Forecasts({"url": "u"}, lambda *a: http.Response(200, b'{"latitude": 1.0}'), waits.append)
    assert list(late.read(feeds.Batch([[1.0, 2.0]], first + 3600))) == [(1.0, None, None, None, None)] and 3500 < waits[0] < 3700


def test_registering(spark):
    feeds.register(spark)
    assert spark.read.format("emberline_traffic").option("url", "u").load().columns == ["record_id", "values"]
