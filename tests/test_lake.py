"""What a refresh makes of several snapshots, empty and broken files; names and types of
columns that feeds may bring."""

import datetime as dt
import os
import tracemalloc

import pytest
from pyspark.sql import functions as F

from emberline.operators import merge, tables
from emberline.plans import refresh
from emberline.plans.refresh import Lake
from emberline.sources import files, xml

RECORD = '<d:situationRecord id="{}"><d:latitude>40.1</d:latitude><d:longitude>-3.7</d:longitude><d:overallStartTime>2024-01-15T00:30:00</d:overallStartTime></d:situationRecord>'


def feed(path, ids, at):
    path.write_text('<d:feed xmlns:d="urn:x">' + "".join(map(RECORD.format, ids)) + "</d:feed>")
    os.utime(path, (at, at))


def test_each_file_is_a_snapshot(spark, tmp_path):
    landing = tmp_path / "traffic"
    landing.mkdir()
    lake = Lake(spark, f"file://{tmp_path}/lake", clock=lambda: dt.datetime(2024, 2, 1))
    times = lambda: {r.record_id: r.end_timestamp for r in lake.table("silver_traffic").read().collect()}

    def refreshed():
        lake.bronze({"traffic": str(landing)})
        lake.silver()
        return times()

    # the newer file has the earlier name; r3 is gone between two snapshots and back again
    feed(landing / "z.xml", ["r1", "r2", "r3"], 1_000)
    feed(landing / "m.xml", ["r1"], 2_000)
    feed(landing / "a.xml", ["r1", "r3"], 3_000)
    us = lambda n: dt.datetime(2024, 2, 1) + dt.timedelta(microseconds=n)
    assert refreshed() == {"r1": None, "r2": us(1), "r3": None}
    assert refreshed() == {"r1": None, "r2": us(1), "r3": None} and lake.status["raw_traffic"] == "ok"
    feed(landing / "b.xml", [], 4_000)  # a snapshot without records closes what is open
    assert refreshed() == {"r1": us(3), "r2": us(1), "r3": us(3)}
    (landing / "c.xml").write_text("<d:feed><open>")
    os.utime(landing / "c.xml", (5_000, 5_000))
    feed(landing / "d.xml", ["r2"], 6_000)
    assert refreshed() == {"r1": us(3), "r2": None, "r3": us(3)}
    assert "c.xml" in lake.status["raw_traffic"] and lake.status["bronze_traffic"] == "ok"
    ledger = {r.path.rpartition("/")[2]: (r.rows, r.error is None) for r in lake.ledger().read().collect()}
    assert ledger == {"z.xml": (3, True), "m.xml": (1, True), "a.xml": (2, True), "b.xml": (0, True), "c.xml": (0, False), "d.xml": (1, True)}
    before = lake.ledger().table.versions()
    assert refreshed()["r2"] is None and lake.ledger().table.versions() == before  # nothing is read again
    feed(landing / "c.xml", ["r1"], 7_000)
    assert refreshed() == {"r1": None, "r2": us(6), "r3": us(3)} and lake.status["raw_traffic"] == "ok"


def test_broken_json_and_missing_tables(spark, tmp_path):
    for d in ("weather", "roads"):
        (tmp_path / d).mkdir()
    (tmp_path / "weather/w.json").write_text('[{"latitude": 40.1, "longitude": -3.7, "hourly": {"time": ["2024-01-15T00:00"]}}]')
    (tmp_path / "weather/x.json").write_text('[{"latitude": ')
    (tmp_path / "roads/r.json").write_text('{"elements": [')
    lake = Lake(spark, f"file://{tmp_path}/lake")
    lake.bronze({n: str(tmp_path / n) for n in ("weather", "roads")})
    assert "x.json" in lake.status["raw_weather"] and "r.json" in lake.status["raw_roads"]
    assert lake.table("bronze_weather").read().count() == 1 and lake.table("bronze_roads").read() is None
    with pytest.raises(refresh.StagesFailed, match="silver_fires") as e:
        lake.gold(F.lit("2024-01-15 00:00:00").cast("timestamp"))
    assert all(isinstance(x, refresh.MissingTable) for x in e.value.errors.values()) and len(e.value.errors) == 6


def test_a_large_document_takes_no_tree(spark):
    """40 MB of records: no more is held than a part of what the document itself takes."""
    one = '<s:situation xmlns:s="urn:s"><s:note>n</s:note><s:situationRecord id="i{}"><s:a>first</s:a><s:deep><s:a>second</s:a><s:b> {} </s:b></s:deep><s:situationRecordExtension id="e{}"><s:c>x</s:c></s:situationRecordExtension></s:situationRecord></s:situation>'
    many = 160_000
    content = ("<all>" + "".join(one.format(i, "w" * 10, i) for i in range(many)) + "</all>").encode()
    tracemalloc.start()
    seen = 0
    for n, (record, values) in enumerate(xml.records_of(content)):
        if n < 2:
            assert (record, values) == [("i0", {"a": "first", "b": "w" * 10, "c": "x"}), ("e0", {"c": "x"})][n]
        seen += 1
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == 2 * many and peak < len(content) / 4
    assert list(xml.records_of(content[:-3])) == [] and xml.fault_of(content[:-3]) and xml.fault_of(content) is None
    docs = spark.createDataFrame([(1, content[:300].rpartition(b"</s:situation>")[0] + b"</s:situation></all>"), (2, b"<a>"), (3, None)], "k int, c binary")
    got = {(r.k, r.record_id, r.error is None) for r in xml.flatten_xml(docs, "c", ["k"], error="error").collect()}
    assert got == {(1, "i0", True), (1, "e0", True), (2, None, False)}


ODD = "id int, `a.b` string, `sp ace` string, nested struct<m: map<string,int>, list: array<map<string,int>>>, V int"


@pytest.mark.parametrize("operator", ["merge", "lineage", "latest", "union", "sanitise", "optional"])
def test_odd_names_and_types(spark, operator):
    old = spark.createDataFrame([(1, "p", "q", ({"x": 1, "y": 2}, [{"z": 1}]), 1), (2, "r", "s", (None, None), 2), (3, None, None, None, 3)], ODD)
    new = spark.createDataFrame([(1, "P", "q", ({"y": 2, "x": 1}, [{"z": 1}]), 1), (4, "t", "u", None, 4)], ODD.replace("V int", "v int"))
    if operator == "merge":
        got = merge.merge_df(old, new, ["id"])
        assert {r[0]: r[1] for r in got.collect()} == {1: "P", 2: "r", 3: None, 4: "t"} and got.columns == old.columns
    elif operator == "lineage":
        stamp = lambda d, f: d.withColumns({"landing_source_file": F.lit(f), "ingestion_timestamp": F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz")})
        now = F.lit(dt.datetime(2024, 1, 2)).cast("timestamp_ntz")
        first = merge.merge_with_lineage(None, stamp(old, "f"), ["id"], now)
        again = merge.merge_with_lineage(first, stamp(new.withColumn("a.b", F.col("`a.b`")), "g"), ["id"], now)
        assert {r.id: r.updated_source_file for r in again.collect()} == {1: "g", 2: None, 3: None, 4: None}
        same = merge.merge_with_lineage(first, stamp(old.where("id < 3"), "g"), ["id"], now)
        assert {r.updated_source_file for r in same.collect()} == {None}
    elif operator == "latest":
        assert {r.id for r in tables.latest_per_key(old, ["id"], "V").collect()} == {1, 2, 3}
        assert tables.latest_per_key(old.unionAll(new.where("id = 1")), ["V"], "id").count() == 3
    elif operator == "union":
        assert tables.union_by_name(old, new.drop("v")).where("V is null").count() == 2
    elif operator == "sanitise":
        assert tables.sanitise_columns(old).columns == ["id", "a.b", "sp_ace", "nested", "V"]
    else:
        assert tables.with_optional(old, "x.y", "int").columns[-1] == "x.y"
