"""Keyed tables: what merges write, against the same merges of whole tables."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from emberline.operators import keyed
from emberline.operators.keyed import KeyedTable, VersionConflict
from emberline.operators.merge import DuplicateKeys, Merge, lineage_merge, merge_df, snapshot_merge, upsert_merge
from emberline.plans import gold


def stored_bytes(folder):
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if not f.startswith((".", "_"))}


def rows(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("near", [True, False])
def test_a_small_merge_writes_little(spark, tmp_path, near):
    many = 60_000
    base = spark.range(many).select("id", F.sha2(F.col("id").cast("string"), 256).alias("v"))
    table = KeyedTable(spark, f"file://{tmp_path}/t", ["id"], buckets=8)
    table.write(base)
    before = stored_bytes(tmp_path / "t")
    hit = F.col("id") >= many - many // 100 if near else F.col("id") % 100 == 0
    load = base.where(hit).withColumn("v", F.lit("new"))
    table.merge(Merge(load, ["id"]))
    after = stored_bytes(tmp_path / "t")
    assert all(after[f] == n for f, n in before.items())
    assert sum(after.values()) - sum(before.values()) < 0.04 * sum(before.values())
    got = table.read()
    assert got.count() == many and got.where("v = 'new'").count() == many // 100
    assert table.read(0).where("v = 'new'").count() == 0
    assert table.merge(Merge(load.where("false"), ["id"])) == 1 and table.merge(Merge(load, ["id"], update_when=lambda o, n: o("v") != n("v"))) == 1


def test_merges_are_those_of_whole_tables(spark, tmp_path):
    rng = random.Random(5)
    table = KeyedTable(spark, f"file://{tmp_path}/t", ["k", "n"], buckets=3, most_segments=3)
    whole, schema = None, "k string, n int, `a.b` string, landing_source_file string, ingestion_timestamp timestamp_ntz"
    for day in range(6):
        keys = sorted({(rng.choice(["x", "y", "ü", None]), rng.randrange(12)) for _ in range(14)}, key=repr)
        load = spark.createDataFrame([(*k, rng.choice("pq"), f"f{day}", dt.datetime(2024, 1, day + 1)) for k in keys], schema)
        if day == 4:
            load = load.withColumn("more", F.lit(day))
        now = F.lit(dt.datetime(2024, 2, day + 1)).cast("timestamp_ntz")
        made = (lineage_merge if day % 2 else upsert_merge)(load, ["k", "n"], now)
        table.merge(made)
        after = made.applied(whole)
        whole = spark.createDataFrame(after.collect(), after.schema)
        assert rows(table.read()) == rows(whole), day
    assert len(table.manifest().segments) <= 9 and len(table.versions()) == 3
    named = {p.split("/")[0] for v in table.versions() for s in table.manifest(v).segments for p in (s.path, *s.dead)}
    assert named == {f for f in os.listdir(tmp_path / "t") if f != "manifests"}
    table.drop()
    assert table.read() is None


def test_closure_and_faults(spark, tmp_path):
    day = lambda n: dt.datetime(2024, 1, n)
    stamp = lambda n: F.lit(day(n)).cast("timestamp_ntz")
    schema = "record_id string, end_timestamp timestamp_ntz, ingestion_timestamp timestamp_ntz, landing_source_file string"
    seen = spark.createDataFrame([("a", None, day(1), "f"), ("b", None, day(1), "f"), ("c", day(1), day(1), "f")], schema)
    table = KeyedTable(spark, f"file://{tmp_path}/t", ["record_id"], buckets=2)
    ends = lambda: {r.record_id: r.end_timestamp for r in table.read().collect()}
    table.merge(snapshot_merge(seen, seen, "record_id", stamp(1), stamp(1)))
    table.merge(snapshot_merge(seen, seen.where("record_id = 'a'"), "record_id", stamp(2), stamp(2)))
    assert ends() == {"a": None, "b": day(2), "c": day(1)}
    table.merge(snapshot_merge(seen, seen.where("record_id = 'b'"), "record_id", stamp(3), stamp(3)))
    assert ends() == {"a": day(3), "b": None, "c": day(1)}
    with pytest.raises(DuplicateKeys):
        table.merge(Merge(seen.union(seen), ["record_id"]))
    with pytest.raises(ValueError, match="key"):
        table.merge(Merge(seen, ["end_timestamp"]))
    stale = table.manifest(table.versions()[-2])
    with pytest.raises(VersionConflict):
        table._commit(keyed.replace(stale, version=stale.version + 1))
    assert not table.create("record_id string") and ends()["a"] == day(3)
    closed = Merge(seen.where("record_id = 'a'"), ["record_id"], update=None, insert=None, not_matched=(lambda o, n: o("end_timestamp").isNull(), {"end_timestamp": lambda o, n: stamp(9)}))
    table.merge(closed)
    assert ends() == {"a": day(3), "b": day(9), "c": day(1)}
    empty = KeyedTable(spark, f"file://{tmp_path}/e", ["id"])
    assert empty.create("id long, v string") and empty.read().count() == 0
    empty.merge(Merge(spark.createDataFrame([(1, "x"), (None, "y"), (None, "y")], "id int, v string"), ["id"]))
    assert rows(empty.read()) == [(1, "x"), (None, "y"), (None, "y")]


def test_names_of_merged_columns(spark):
    old = spark.createDataFrame([(1, "p", "q")], "id int, `a.b` string, V string")
    new = spark.createDataFrame([(1, "r", "s"), (2, "t", "u")], "ID int, `a.b` string, v string")
    got = merge_df(old, new, ["id"])
    assert got.columns == ["id", "a.b", "V"] and rows(got) == sorted([("s", "r", 1), ("u", "t", 2)], key=repr)


def plans_of(monkeypatch):
    """The plans of what merges write from here on, by name."""
    plans, own = [], keyed.written

    def written(df, name, *more):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return own(df, name, *more)

    monkeypatch.setattr(keyed, "written", written)
    return plans


def test_loads_and_dead_places_are_not_broadcast_by_file_size(spark, tmp_path, monkeypatch):
    many = keyed.FEW_ROWS * 2
    table = KeyedTable(spark, f"file://{tmp_path}/t", ["id"], buckets=2, dead_share=0.9)
    table.write(spark.range(many).select("id", F.lit(0).alias("v")))
    plans = plans_of(monkeypatch)
    load = spark.range(many // 4, many).select("id", F.lit(1).alias("v"))
    assert many // 4 * 3 > keyed.FEW_ROWS
    table.merge(Merge(load, ["id"], update_when=lambda o, n: n("v") > o("v")))
    assert plans and not any("Broadcast" in p for _, p in plans)
    held = table.read()
    assert any(s.dead for s in table.manifest().segments)
    assert "LeftAnti" not in held._jdf.queryExecution().executedPlan().toString()
    assert {r[0]: r[1] for r in held.groupBy("v").count().collect()} == {0: many // 4, 1: many // 4 * 3}
    assert held.where("v = 0").agg(F.max("id")).first()[0] == many // 4 - 1


def test_a_large_load_is_shuffled_once(spark, tmp_path, monkeypatch):
    schema = "k string, n int, v string"
    old = [(f"k{i}", i % 3, "old") for i in range(40)] + [(None, 1, "old"), (None, 1, "old")]
    new = [(f"k{i}", i % 3, "new") for i in range(20, 60)] + [(None, 1, "new"), (None, 1, "new")]
    table = KeyedTable(spark, f"file://{tmp_path}/t", ["k", "n"], buckets=3, rows_a_file=9)
    table.write(spark.createDataFrame(old, schema))
    load = Merge(spark.createDataFrame(new, schema), ["k", "n"], not_matched=(lambda o, n: o("k") == "k3", {"v": lambda o, n: F.lit("gone")}))
    want = rows(load.applied(table.read()))
    plans = plans_of(monkeypatch)
    table.merge(load)
    assert [n for n, _ in plans] == ["source"]  # the rest is written to its place
    assert rows(table.read()) == want and (None, 1, "old") in want and ("k3", 0, "gone") in want
    assert sum(s.rows for s in table.manifest().segments) == len(want) == 64
    folders = sorted(os.listdir(tmp_path / "t"))
    with pytest.raises(DuplicateKeys):
        table.merge(Merge(load.source.union(load.source), ["k", "n"]))
    assert rows(table.read()) == want and sorted(os.listdir(tmp_path / "t")) == folders
    zero = KeyedTable(spark, f"file://{tmp_path}/z", ["x"])
    zero.write(spark.createDataFrame([(0.0, 1), (1.0, 1)], "x double, v int"))
    zero.merge(Merge(spark.createDataFrame([(-0.0, 2)], "x double, v int"), ["x"]))
    assert rows(zero.read()) == [(1, 1.0), (2, 0.0)]


def test_impacts_are_merged_without_broadcasts(spark, tmp_path, monkeypatch):
    found = spark.range(3000).select(F.col("id").cast("string").alias("fire_detection_id"), F.lit("i").alias("traffic_incident_id"), F.col("id").cast("double").alias("distance_km"))
    table = KeyedTable(spark, f"file://{tmp_path}/t", gold.IMPACT_KEYS, buckets=2)
    table.create(gold.TRAFFIC_IMPACT)
    plans, own = plans_of(monkeypatch), KeyedTable._segments
    monkeypatch.setattr(KeyedTable, "_segments", lambda self, df, *more: plans.append(("rows", df._jdf.queryExecution().executedPlan().toString())) or own(self, df, *more))
    table.merge(gold.traffic_impact_merge(found.where("id < 2000")))
    table.merge(gold.traffic_impact_merge(found.where("id >= 1000").withColumn("distance_km", F.lit(-1.0))))
    assert len(plans) > 3 and not any("Broadcast" in p for _, p in plans)
    assert table.read().count() == 3000 and table.read().where("distance_km = -1").count() == 2000
    assert KeyedTable(spark, "t", ["id"]).rows_a_file <= 250_000  # a task sorts a few files' rows
