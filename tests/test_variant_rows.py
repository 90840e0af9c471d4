"""Summary rows stored as VARIANT parts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from flowlib.operators import summary, variant_rows


def test_parts_of_unlike_columns(spark, tmp_path):
    path = str(tmp_path / "rows")
    first = spark.createDataFrame([("a", 1, 2.5, None), ("b", None, float("nan"), "x")], "key string, `odd 'name` int, v double, s string")
    second = spark.createDataFrame([("a", 2**40, dt.datetime(2024, 1, 2), 7)], "key string, `odd 'name` bigint, at timestamp, v int")
    variant_rows.append_rows(first, path, 0)
    variant_rows.append_rows(second, path, 3)
    variant_rows.append_rows(second, path, 3)
    assert variant_rows.layout(spark, path) == [("key", "string"), ("odd 'name", "bigint"), ("v", "double"), ("s", "string"), ("at", "timestamp")]
    got = variant_rows.read_rows(spark, path)
    want = summary.union_summary_rows([first.withColumn("_part", F.lit(0)), second.withColumn("_part", F.lit(3))]).select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert {f.name for f in variant_rows.schema_of_rows(spark, path)} == {"key", "odd 'name", "v", "s", "at"}
    newest = {r.key: r for r in variant_rows.newest_rows(spark, path, ["key"], [F.col("key")]).collect()}
    assert newest["a"]["odd 'name"] == 2**40 and newest["a"].s is None and newest["b"].s == "x"


def test_no_rows(spark, tmp_path):
    path = str(tmp_path / "rows")
    variant_rows.append_rows(spark.createDataFrame([], "key string, n int"), path, 0)
    assert variant_rows.read_rows(spark, path).count() == 0 and variant_rows.newest_rows(spark, path, ["key"]).columns == ["key", "n"]
