from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from flowlib.functions import text, values
from flowlib.operators.quality import ordered_by


def one(spark, column, **cells):
    schema = ", ".join(f"`{k}` {'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'string'}" for k, v in cells.items()) or "x string"
    return spark.createDataFrame([tuple(cells.values()) or (None,)], schema).select(column).first()[0]


@pytest.mark.parametrize("raw, slug", [("New Attack!!", "new_attack"), ("  DoS--Hulk ", "dos_hulk"), ("!!", "unknown"), ("", "unknown"), (None, "unknown"), ("BENIGN", "benign")])
def test_slugify(spark, raw, slug):
    assert one(spark, text.slugify(F.col("x")), x=raw) == slug


@pytest.mark.parametrize("raw, tag, file_tag", [("run 1/a.b", "run_1_a_b", "run_1_a.b"), ("__x__", "x", "__x__"), ("  ", "default", "unknown_run"), ("é-9", "é-9", "é-9"), ("a  b", "a__b", "a__b")])
def test_tags(spark, raw, tag, file_tag):
    assert one(spark, text.safe_tag(F.col("x")), x=raw) == tag
    assert one(spark, text.safe_file_tag(F.col("x")), x=raw) == file_tag


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("14/02/2018 08:31:01", dt.datetime(2018, 2, 14, 8, 31, 1)),
        ("1/3/2018 8:05:09", dt.datetime(2018, 3, 1, 8, 5, 9)),
        (" 2018-02-15 09:00:00 ", dt.datetime(2018, 2, 15, 9, 0, 0)),
        ("2018-02-15T09:00:00.25", dt.datetime(2018, 2, 15, 9, 0, 0, 250000)),
        ("04/25/2018 10:11:12", dt.datetime(2018, 4, 25, 10, 11, 12)),
        ("25/04/2018 10:11", dt.datetime(2018, 4, 25, 10, 11)),
        ("03/04/2018 10:11", dt.datetime(2018, 3, 4, 10, 11)),
        ("2/15/2018 1:02:03 PM", dt.datetime(2018, 2, 15, 13, 2, 3)),
        ("2018/2/15 10:00", dt.datetime(2018, 2, 15, 10, 0)),
        ("15 Feb 2018 10:00:01", dt.datetime(2018, 2, 15, 10, 0, 1)),
        ("Feb 15, 2018", dt.datetime(2018, 2, 15)),
        ("Timestamp", None), ("nan", None), ("NaT", None), ("", None), (None, None), ("32/01/2018 00:00:00", None),
    ],
)
def test_parse_timestamp(spark, raw, expected):
    assert one(spark, values.parse_timestamp(F.col("x")), x=raw) == expected


@pytest.mark.parametrize(
    "raw, expected",
    [("12.5", 12.5), (" 5 ", 5.0), ("Infinity", None), ("-inf", None), ("NaN", None), ("x", None), ("1d", None), ("2F", None), ("0x1p3", None), ("1e3", 1000.0), (None, None), ("", None), (" 7\t", 7.0)],
)
def test_sanitize_number(spark, raw, expected):
    assert one(spark, values.sanitize_number(F.col("x")), x=raw) == expected


def test_infinity_is_a_number_until_sanitized(spark):
    assert one(spark, values.to_number(F.col("x")), x="inf") == math.inf


def test_next_above(spark):
    rng = random.Random(4)
    xs = [0.0, 1.0, -1.0, 0.5, 1 - 2**-53, 1 + 2**-52, 2.0**52, 0.1, 1e300, -1e300]
    xs += [rng.uniform(-1, 1) * 10.0 ** rng.randrange(-280, 290) for _ in range(3000)]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(values.next_above(F.col("x"))).collect()]
    assert got == [math.nextafter(x, math.inf) for x in xs]


@pytest.mark.parametrize("raw, ms", [("1 second", 1000.0), ("500 milliseconds", 500.0), ("2", 2000.0), ("3 m", 180000.0), ("0.5 s", 500.0), ("1 hour", None), ("x second", None), ("", None), (None, None), ("10 MS", 10.0)])
def test_trigger_interval(spark, raw, ms):
    assert one(spark, values.trigger_interval_ms(F.col("x")), x=raw) == ms


@pytest.mark.parametrize("raw, collector, metric", [(None, "measure", "measure"), ("MEASURE", "measure", "measure"), (" Warmup ", "warmup", " warmup "), ("odd", "measure", "odd"), ("post_fault", "post_fault", "post_fault")])
def test_phases(spark, raw, collector, metric):
    assert one(spark, values.collector_phase(F.col("x")), x=raw) == collector
    assert one(spark, values.metric_phase(F.col("x")), x=raw) == metric


@pytest.mark.parametrize("value, decimals, expected", [(12.5, 0, "12"), (13.5, 0, "14"), (0.25, 1, "0.2"), (1234.56, 1, "1234.6"), (2.0, 4, "2.0000"), (None, 1, "NA"), (1e9, 0, "1000000000")])
def test_format_fixed(spark, value, decimals, expected):
    df = spark.createDataFrame([(value,)], "x double")
    assert df.select(text.format_fixed(F.col("x"), decimals)).first()[0] == expected


def test_format_mean_std(spark):
    df = spark.createDataFrame([(1.25, 0.0), (None, None)], "m double, s double").select(text.format_mean_std(F.col("m"), F.col("s"), 2).alias("t"))
    assert [r.t for r in df.collect()] == ["1.25 +/- 0.00", "NA"]


@pytest.mark.parametrize(
    "tag, label",
    [
        ("CapacityCalibration_r1_pass_through_500rps_x", "pass-through 500 rps"), ("capacitycalibration_random_forest_full_600rps_1", "RF-Full 600 rps"),
        ("modelfeaturetradeoff_a_rf-17_500rps_1", "RF-17 500 rps"), ("faultrecovery_r1_20_cold_start_300rps_7", "cold_start_300rps"), ("Other_1", "Other_1"), ("capacitycalibration_x", "capacitycalibration_x"),
    ],
)
def test_short_run_label(spark, tag, label):
    assert one(spark, text.short_run_label(F.col("x")), x=tag) == label


@pytest.mark.parametrize("code, title", [("my_new_model", "My New Model"), ("rf-17x", "Rf-17X"), ("ABC_d", "Abc D"), ("", "")])
def test_title_words_follow_letters(spark, code, title):
    assert one(spark, text.mode_label(F.col("x")), x=code) == title == code.replace("_", " ").title()


def test_first_numeric_and_absent_columns(spark):
    df = spark.createDataFrame([("x", 2.0), ("3", 4.0), (None, float("nan"))], "a string, b double")
    got = df.select(values.first_numeric(df, "a", "gone", "b").alias("v")).collect()
    assert [r.v for r in got] == [2.0, 3.0, None]


def test_ordered_by(spark):
    df = spark.createDataFrame([("b",), ("z",), ("a",)], "x string")
    assert [r[0] for r in df.orderBy(F.asc_nulls_last(ordered_by(F.col("x"), ("a", "b")))).collect()] == ["a", "b", "z"]


def test_content_bucket_is_stable(spark):
    import hashlib

    keys = [f"flow-{i}" for i in range(200)]
    got = spark.createDataFrame([(k,) for k in keys], "k string").select(values.content_bucket(F.col("k"), 10_000)).collect()
    assert [r[0] for r in got] == [int(hashlib.md5(k.encode()).hexdigest()[:8], 16) % 10_000 for k in keys]


def test_key_text_keeps_places(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None)], "x string, y string").select(values.key_text(F.col("x"), F.col("y")).alias("k"))
    assert df.distinct().count() == 2
