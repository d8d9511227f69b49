import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from emberline.functions.geo import haversine_km, in_region
from emberline.functions.scoring import at_least, known, severity_label, severity_rank
from emberline.functions.temporal import active_at, detection_time
from emberline.operators import audit, graph, merge, spatial, storage, tables
from emberline.operators.graph import connected_components
from emberline.operators.intervals import stabbing_sums
from emberline.operators.skew import lookup


def test_haversine(spark):
    row = spark.range(1).select(haversine_km(F.lit(40.4168), F.lit(-3.7038), F.lit(41.3874), F.lit(2.1686)).alias("a"), haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)).alias("b")).first()
    assert row.a == pytest.approx(505.4, abs=1) and row.b == pytest.approx(20015.1, abs=0.1)


@pytest.mark.parametrize("box", [spatial.NEAR, spatial.AROUND_ROAD])
def test_box_join_is_brute_force(spark, box):
    rng = random.Random(1)
    edge = [(0.15, 0.21), (0.20, 0.28), (-17.85, -17.85), (-17.5, -17.5)]
    a = [(i, round(rng.uniform(36, 37), 2), round(rng.uniform(-4, -3), 2)) for i in range(150)] + [(1000 + i, *p) for i, p in enumerate(edge)] + [(2000, None, 1.0)]
    b = [(i, round(rng.uniform(36, 37), 2), round(rng.uniform(-4, -3), 2)) for i in range(150)] + [(1000 + i, *p) for i, p in enumerate(edge)]
    left, right = spark.createDataFrame(a, "a int, lat double, lon double"), spark.createDataFrame(b, "b int, rlat double, rlon double")
    got = {(r.a, r.b) for r in spatial.box_join(left, right, box, ("lat", "lon"), ("rlat", "rlon")).collect()}
    want = {(x[0], y[0]) for x in a if x[1] is not None for y in b if x[1] - box.lat <= y[1] <= x[1] + box.lat and x[2] - box.lon <= y[2] <= x[2] + box.lon}
    assert got == want and len(want) > 100


@pytest.mark.parametrize("few", [250_000, 0])
def test_components_are_union_find(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW_EDGES", few)
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)] + [(None, 3), (7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        if u is not None:
            u, v = find(u), find(v)
            root[max(u, v)] = min(u, v)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src int, dst int")).collect()}
    assert got == {x: find(x) for x in root}
    assert connected_components(spark.createDataFrame([], "src int, dst int")).count() == 0


def test_ladders_and_severity(spark):
    df = spark.createDataFrame([(100.0,), (99.99,), (float("nan"),), (None,)], "v double")
    assert [r[0] for r in df.select(at_least(known(F.col("v")), [(100, 3), (50, 2)], 0)).collect()] == [3, 2, 0, 0]
    words = spark.createDataFrame([("critical",), ("Severe",), ("high",), ("medium",), ("highest",), (None,)], "s string")
    assert [r[0] for r in words.select(severity_label(severity_rank(F.col("s")))).collect()] == ["CRITICAL", "CRITICAL", "HIGH", "MEDIUM", "NORMAL", "NORMAL"]


def test_times(spark):
    df = spark.createDataFrame([(5,), (130,), (2359,), (2460,), (None,)], "t int")
    got = [r[0] for r in df.select(detection_time(F.lit("2024-01-15"), F.col("t"))).collect()]
    assert [x and (x.hour, x.minute) for x in got] == [(0, 5), (1, 30), (23, 59), None, None]
    row = spark.sql("select timestamp'2024-01-01 10:00:00' s, cast(null as timestamp) e, timestamp'2024-01-02 00:00:00' t")
    assert row.select(active_at(F.col("s"), F.col("e"), F.col("t"))).first()[0]


def test_region_edges(spark):
    df = spark.createDataFrame([(27.0, 5.0), (44.01, 0.0), (None, 0.0)], "latitude double, longitude double")
    assert in_region(df).count() == 1


def load(spark, rows):
    return spark.createDataFrame(rows, "id int, v string, landing_source_file string, ingestion_timestamp timestamp_ntz")


def test_merge_truth_table(spark):
    t0, t1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    now = F.lit(dt.datetime(2024, 1, 3)).cast("timestamp_ntz")
    old = merge.merge_with_lineage(None, load(spark, [(1, "a", "x", t0), (2, "b", "x", t0), (3, None, "x", t0), (None, "n", "x", t0)]), ["id"], now)
    new = load(spark, [(1, "a", "y", t1), (2, "c", "y", t1), (4, "d", "y", t1)])
    got = {r.id: (r.v, r.landing_source_file, r.updated_source_file) for r in merge.merge_with_lineage(old, new, ["id"], now).collect()}
    assert got == {1: ("a", "x", None), 2: ("c", "x", "y"), 3: (None, "x", None), 4: ("d", "y", None), None: ("n", "x", None)}
    with pytest.raises(merge.DuplicateKeys):
        merge.upsert(old, load(spark, [(1, "p", "y", t1), (1, "q", "y", t1)]), ["id"], now)


def test_close_missing(spark):
    rows = [("a", None, dt.datetime(2024, 1, 1)), ("b", None, dt.datetime(2024, 1, 1)), ("c", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1))]
    df = spark.createDataFrame([(*r, None) for r in rows], "record_id string, end_timestamp timestamp_ntz, ingestion_timestamp timestamp_ntz, updated_timestamp timestamp_ntz")
    late = F.lit(dt.datetime(2024, 1, 5)).cast("timestamp_ntz")
    got = {r.record_id: r.end_timestamp for r in merge.close_missing(df, spark.createDataFrame([("a",)], "record_id string"), "record_id", late, late).collect()}
    assert got == {"a": None, "b": dt.datetime(2024, 1, 5), "c": dt.datetime(2024, 1, 1)}


def test_stabbing_sums_are_brute_force(spark):
    rng = random.Random(3)
    spans = [(rng.choice("ab") if i % 9 else None, s := rng.randrange(100), None if i % 5 == 0 else s + rng.randrange(40), rng.randrange(1, 4)) for i in range(200)]
    points = [(rng.choice("abc") if i % 7 else None, rng.randrange(-5, 150), i, "kept") for i in range(150)]
    df = spark.createDataFrame(points, "k string, at int, lo int, row_ string")
    got = stabbing_sums(df, "k", F.col("at").cast("long"), spark.createDataFrame(spans, "k string, lo long, hi long, w long"), ["w"], spans=5)
    want = {p: sum(w for k, lo, hi, w in spans if k is not None and k == p[0] and lo <= p[1] and (hi is None or p[1] < hi)) for p in points}
    assert {(r.k, r.at, r.lo, r.row_): r.w for r in got.collect()} == want and got.columns == [*df.columns, "w"]
    none = stabbing_sums(df, "k", F.col("at").cast("long"), spark.createDataFrame([], "k string, lo long, hi long, w long"), ["w"])
    assert {r.w for r in none.collect()} == {0}


def test_lookup_splits_hot_keys(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(500)] + [(f"k{i % 40}", i) for i in range(200)], "k string, v int")
    counts = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("top")).where("k <> 'k3'")
    for how, size in (("left", 700), ("inner", 695)):
        out = lookup(rows, counts, ["k"], total=700, how=how)
        got = out.collect()
        assert len(got) == size and out.columns == ["k", "v", "top"] and {r.top for r in got if r.k == "hot"} == {499}
    assert all(r.top is None for r in lookup(rows, counts, ["k"], total=700).where("k = 'k3'").collect())


def test_shared_folder_and_discard(spark, tmp_path):
    kept = storage.written(spark.range(5), "kept")
    gone = storage.written(kept, "gone")
    storage.discard(gone, spark.range(2))
    assert kept.count() == 5 and not os.path.exists(gone._stored_at.removeprefix("file://"))

    class Far:
        master = "spark://host:7077"

    class Session:
        sparkContext = Far

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(storage.NoSharedFolder):
        storage.shared_dir(Session, "x")


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, 5, 7), (1, 6, 8)], "k int, t int, rank int")
    assert [tuple(r) for r in tables.latest_per_key(df, ["k"], "t").collect()] == [(1, 6, 8)]
    assert tables.nearest_per_key(df, ["k"], "t", ["rank"]).columns == ["k", "t", "rank"]
    left = spark.createDataFrame([(40.0, -3.0, 1, 2)], "lat double, lon double, cell int, i int")
    right = spark.createDataFrame([(40.1, -3.1, 3)], "rlat double, rlon double, j int")
    assert [tuple(r) for r in spatial.box_join(left, right, spatial.NEAR, ("lat", "lon"), ("rlat", "rlon")).collect()] == [(40.0, -3.0, 1, 2, 40.1, -3.1, 3)]


def test_audit_sample(spark):
    df = spark.range(10).selectExpr("id", "id as a", "id as b", "id as c", "'f' as landing_source_file")
    got = audit.audit_sample(df)
    assert got.columns == ["id", "a", "b", "landing_source_file"] and got.count() == 3
    few = spark.range(50).selectExpr("id % 3 as few", "id as many", "cast(null as string) as none", "concat('x', id % 5) as five")
    assert {(r.column_name, r.sample) for r in audit.value_samples(few).collect()} == {("few", "0"), ("few", "1"), ("few", "2"), ("five", "x0"), ("five", "x1"), ("five", "x2")}
    assert audit.value_samples(few.select("none")).count() == 0


def test_versioned_table(spark, tmp_path):
    table = merge.VersionedTable(spark, f"file://{tmp_path}/t")
    assert table.read() is None
    table.write(spark.range(3))
    table.merge(spark.range(5), lambda old, new: old.union(new))
    assert table.read().count() == 8
    os.makedirs(tmp_path / "t/v2")  # a write that broke off
    for n in range(4):
        assert table.write(spark.range(n)) == 3 + n
    assert table.read().count() == 3 and table._versions() == [4, 5, 6]


def test_latest_is_order_free(spark):
    rows = [(1, 5, "a"), (1, 5, "b"), (1, None, "c"), (2, None, "d")]
    pick = lambda r: {tuple(x) for x in tables.latest_per_key(spark.createDataFrame(r, "k int, t int, v string"), ["k"], "t").collect()}
    assert pick(rows) == pick(rows[::-1]) and len(pick(rows)) == 2


def test_names_and_unnest(spark):
    assert tables.clean_name(" a  (b)=c;") == "a_b_c"
    df = spark.createDataFrame([(1, ["p", "q"], [1.0]), (2, None, [2.0])], "id int, t array<string>, v array<double>")
    got = tables.unnest_parallel(df, {"t": F.col("t"), "v": F.col("v")}, ["id"], driver="t").collect()
    assert [(r.id, r.t, r.v) for r in got] == [(1, "p", 1.0), (1, "q", None)]
    clash = tables.unnest_parallel(df.withColumn("_t", F.lit(9)), {"t": F.col("t"), "v": F.col("v")}, ["id", "_t"], driver="t")
    assert [(r["_t"], r.t) for r in clash.collect()] == [(9, "p"), (9, "q")]


def test_profile(spark, monkeypatch):
    df = spark.createDataFrame([(1, float("nan")), (2, 3.0), (2, None)], "a int, b double")
    got = {r.column_name: r for r in audit.column_profile(df).collect()}
    assert (got["b"].null_count, got["b"].max_value, got["a"].distinct_count) == (2, "3.0", 2)
    assert audit.column_profile(df.where("false")).select("column_name", "distinct_count").collect() == [("a", 0), ("b", 0)]
    monkeypatch.setattr(audit, "KEPT_VALUES", 7)
    wide = spark.range(500).selectExpr("id % 20 as few", "id as many", "if(id % 3 = 0, null, id % 11) as some", "map('k', id % 5) as m", "if(id % 2 = 0, 0.0d, -0.0d) as zero")
    profile = audit.column_profile(wide)
    assert {r.column_name: r.distinct_count for r in profile.collect()} == {"few": 20, "many": 500, "some": 11, "m": 5, "zero": 1}
    assert "Expand" not in profile._jdf.queryExecution().optimizedPlan().toString()
    assert audit.key_audit(df, ["a"]).first().duplicate_rows == 1
