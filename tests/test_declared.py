"""Declared tables and names in the catalog."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.operators.declared import WrongColumns, as_declared, storable
from emberline.operators.merge import VersionedTable
from emberline.plans import declared


def test_what_can_be_stored(spark):
    ok = [("int", "long"), ("double", "int"), ("timestamp_ntz", "timestamp"), ("date", "timestamp"), ("int", "string"), ("array<int>", "array<double>"), ("struct<a:int>", "struct<b:long>"), ("map<string,int>", "map<string,string>")]
    wrong = [("string", "int"), ("string", "timestamp"), ("int", "timestamp"), ("boolean", "int"), ("array<string>", "array<int>"), ("struct<a:int>", "string"), ("binary", "string"), ("struct<a:int,b:int>", "struct<a:int>")]
    kind = lambda t: T.StructType.fromDDL(f"c {t}")[0].dataType
    assert all(storable(kind(a), kind(b)) for a, b in ok) and not any(storable(kind(a), kind(b)) for a, b in wrong)
    assert storable(T.NullType(), kind("int"))


def test_rows_as_declared(spark):
    df = spark.createDataFrame([(1, "x", 2.0, "more")], "ID int, `a.b` string, v double, other string")
    got = as_declared(df, "v float, id long, named string", {"named": "a.b"})
    assert got.dtypes == [("v", "float"), ("id", "bigint"), ("named", "string")] and tuple(got.first()) == (2.0, 1, "x")
    with pytest.raises(WrongColumns, match="gone is missing; other is string, not int"):
        as_declared(df, "id long, gone int, other int")
    with pytest.raises(WrongColumns, match="fire_detection_id is missing"):
        declared.decision_table("gold_fire_exposure", df)
    assert all(T.StructType.fromDDL(t) for t in declared.TABLES.values())


def test_a_name_follows_the_versions(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t", keep=1, name="emberline_test.some")
    table.write(spark.range(3))
    assert spark.table("emberline_test.some").count() == 3
    table.write(spark.range(5))
    assert spark.sql("SELECT count(*) FROM emberline_test.some").first()[0] == 5
    table.write(spark.range(2).select("id", F.lit("x").alias("more")))
    assert spark.table("emberline_test.some").columns == ["id", "more"] and spark.table("emberline_test.some").count() == 2
    table.drop()
    assert not spark.catalog.tableExists("emberline_test.some")
    spark.sql("DROP DATABASE emberline_test")


def test_versions_are_stored_densely(spark, tmp_path):
    """Digests, which are in every pair of a decision table, take half of their letters."""
    from emberline.operators.merge import VersionedTable

    stored = VersionedTable(spark, f"file://{tmp_path}/t")
    stored.write(spark.range(20_000).selectExpr("sha2(cast(id as string), 256) as fire_id"))
    assert stored.read().count() == 20_000
    assert sum(p.stat().st_size for p in tmp_path.rglob("*.parquet")) < 20_000 * 45
