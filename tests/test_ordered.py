from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowlib.operators.ordered import in_chunks, with_previous, with_row_number
from flowlib.operators.percentiles import exact_percentiles, with_ordered_bits


@pytest.fixture(scope="module")
def skewed(spark):
    """Half of all rows in one group, many equal times, a null group."""
    rng = random.Random(7)
    data = [(None if i % 97 == 0 else ("hot" if i % 2 else f"g{i % 5}"), rng.randrange(40), i, float(rng.randrange(100))) for i in range(5000)]
    return spark.createDataFrame(data, "g string, t int, id int, v double")


def _expected(df):
    groups = {}
    for r in sorted(df.collect(), key=lambda r: (r.t, r.id)):
        groups.setdefault(r.g, []).append(r)
    return groups


def test_row_number_of_a_hot_group(skewed):
    got = {r.id: (r.n, r.total) for r in with_row_number(skewed, ["g"], ["t", "id"], name="n", total="total").collect()}
    want = {r.id: (i + 1, len(members)) for members in _expected(skewed).values() for i, r in enumerate(members)}
    assert got == want


def test_row_number_without_groups(skewed):
    got = {r.id: r.n for r in with_row_number(skewed, [], [F.desc("t"), "id"], name="n").collect()}
    assert got == {r.id: i + 1 for i, r in enumerate(sorted(skewed.collect(), key=lambda r: (-r.t, r.id)))}


def test_previous_value_crosses_chunks(skewed):
    got = {r.id: (r.pv, r.pt) for r in with_previous(skewed, ["g"], ["t", "id"], {"pv": "v", "pt": "t"}).collect()}
    want = {}
    for members in _expected(skewed).values():
        for i, r in enumerate(members):
            want[r.id] = (members[i - 1].v, members[i - 1].t) if i else (None, None)
    assert got == want


def test_previous_keeps_null_values(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0), (3, None), (4, 1.0)], "t int, v double")
    got = {r.t: r.p for r in with_previous(df, [], ["t"], {"p": "v"}).collect()}
    assert got == {1: None, 2: None, 3: 5.0, 4: None}


def test_a_hot_group_is_spread_over_chunks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        df = spark.range(20_000).select(F.lit("one").alias("g"), F.rand(3).alias("t"), "id")
        sizes = [r["count"] for r in in_chunks(df, ["g"], ["t", "id"]).groupBy("_chunk").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(sizes) >= 6 and max(sizes) < 20_000 / 3


def test_percentiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    data = [(g, float(v), float(w)) for g, n in (("a", 3000), ("b", 1), ("c", 17)) for v, w in zip(rng.lognormal(3, 2, n), rng.integers(-5, 5, n))]
    data += [("a", None, float("nan")), ("d", None, None)]
    df = spark.createDataFrame(data, "g string, v double, w double")
    wanted = {f"{c}{q}": (c, q) for c in "vw" for q in (0.0, 0.5, 0.9, 0.95, 0.99, 1.0)}
    got = {r.g: r.asDict() for r in exact_percentiles(df, ["g"], wanted).collect()}
    for g in "abc":
        for i, c in enumerate("vw"):
            xs = [r[i + 1] for r in data if r[0] == g and r[i + 1] is not None and r[i + 1] == r[i + 1]]
            for q in (0.0, 0.5, 0.9, 0.95, 0.99, 1.0):
                assert got[g][f"{c}{q}"] == pytest.approx(float(np.quantile(xs, q)), rel=1e-12, abs=1e-12)
    assert "d" not in got or set(got["d"].values()) == {"d", None}


def test_nearest_rank_rounds_half_to_even(spark):
    xs = [float(x) for x in range(10)]
    df = spark.createDataFrame([(x,) for x in xs], "v double")
    for n in (2, 3, 4, 6, 10):
        part = df.where(F.col("v") < n)
        got = exact_percentiles(part, [], {"a": ("v", 0.5), "b": ("v", 0.95)}, method="nearest").first()
        assert (got.a, got.b) == (xs[round((n - 1) * 0.5)], xs[round((n - 1) * 0.95)])


@settings(max_examples=6, deadline=None)
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False, width=32), min_size=1, max_size=60), st.sampled_from([0.05, 0.5, 0.95]))
def test_selection_equals_the_built_in(spark, xs, q):
    df = spark.createDataFrame([(float(x),) for x in xs], "v double")
    built_in = df.agg(F.percentile("v", q)).first()[0]
    assert exact_percentiles(df, [], {"p": ("v", q)}).first().p == pytest.approx(built_in, rel=1e-9, abs=1e-30)


def test_close_values_text_and_empty_groups(spark):
    """200,000 distinct values in one narrow range are spread; a group without numbers has nulls."""
    near = spark.range(200_000).select(F.lit("near").alias("g"), F.expr("cast(1000 + id / 1000000D as string)").alias("v"))
    rest = spark.createDataFrame([("none", None), ("none", "NaN"), ("text", "abc"), ("text", "7"), (None, "3")], "g string, v string")
    got = {r.g: (r.a, r.b) for r in exact_percentiles(near.union(rest), ["g"], {"a": ("v", 0.5), "b": ("v", 0.95)}).collect()}
    assert got.pop("near") == (pytest.approx(1000.0999995), pytest.approx(1000 + 0.95 * 0.199999))
    assert got == {"none": (None, None), "text": (7.0, 7.0), None: (3.0, 3.0)}


def test_no_values_at_all(spark):
    empty = spark.createDataFrame([], "g string, v double")
    assert exact_percentiles(empty, ["g"], {"a": ("v", 0.5)}).count() == 0
    assert exact_percentiles(empty, [], {"a": ("v", 0.5)}).first().a is None


def test_selection_without_broadcast_and_without_adaptive_plans(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), F.expr("(id * 7919 % 5003 - 2000) / 7D as v"))
    want = {r.g: (r.a, r.b) for r in df.groupBy("g").agg(F.percentile("v", 0.5).alias("a"), F.percentile("v", 0.99).alias("b")).collect()}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = exact_percentiles(df, ["g"], {"a": ("v", 0.5), "b": ("v", 0.99)})
        assert {r.g: (r.a, r.b) for r in got.collect()} == want
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_infinite_values_have_a_rank(spark):
    df = spark.createDataFrame([(float("-inf"),), (1.0,), (2.0,), (float("inf"),), (float("inf"),)], "v double")
    got = exact_percentiles(df, [], {"a": ("v", 0.5), "b": ("v", 1.0), "c": ("v", 0.0)}).first()
    assert (got.a, got.b, got.c) == (2.0, float("inf"), float("-inf"))


def test_one_value_may_hold_most_rows(spark):
    df = spark.range(9000).select(F.expr("if(id % 3 = 0, id / 7D, 42D)").alias("v"))
    got = exact_percentiles(df, [], {"p": ("v", 0.5), "q": ("v", 0.95)}).first()
    want = df.agg(F.percentile("v", 0.5), F.percentile("v", 0.95)).first()
    assert (got.p, got.q) == (want[0], pytest.approx(want[1]))


def test_bits_order_doubles(spark):
    import struct

    rng = np.random.default_rng(9)
    some = [0.0, -0.0, 5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, float("inf"), 1.0, 0.1, 3.0, 1e22, 4503599627370497.0]
    some += [2.0**e for e in range(-1074, 1024, 7)] + [np.nextafter(2.0**e, d) for e in range(-1070, 1023, 11) for d in (0, np.inf)]
    some += rng.integers(0, 0x7FF0000000000000, 2000).view(np.float64).tolist()
    data = [float(x) for v in some for x in (v, -v)]
    rows = with_ordered_bits(spark.createDataFrame([(v,) for v in data], "v double"), "v", "b").collect()
    plain = lambda v: struct.unpack("<q", struct.pack("<d", abs(v)))[0] * (-1 if v < 0 else 1)
    assert [r.b for r in rows] == [plain(r.v) for r in rows]


@pytest.mark.parametrize("method", ["linear", "nearest"])
def test_percentiles_need_all_rounds_for_close_values(spark, method):
    """Neighbouring doubles, whole numbers beyond 24 bits, infinities, both zeros, and a null group."""
    close = [float(np.nextafter(1.0, 2.0)) + i * 2.0**-52 for i in range(301)]
    data = [("close", v) for v in close] + [(None, float(2**40 + i)) for i in range(200)]
    data += [("odd", v) for v in (float("inf"), float("-inf"), -0.0, 0.0, None, -1e-300, 1e-300)] + [("none", None), ("one", 4.5)]
    df = spark.createDataFrame(data, "g string, v double").repartition(5)
    qs = (0.0, 0.25, 0.5, 0.99, 1.0)
    got = {r.g: [r[f"q{q}"] for q in qs] for r in exact_percentiles(df, ["g"], {f"q{q}": ("v", q) for q in qs}, method).collect()}
    assert set(got) == {"close", None, "odd", "none", "one"} and got["none"] == [None] * 5 and got["one"] == [4.5] * 5
    for g in ("close", None):
        xs = sorted(v for k, v in data if k == g)
        for q, v in zip(qs, got[g]):
            at = q * (len(xs) - 1)
            low, high = (round(at), round(at)) if method == "nearest" else (int(np.floor(at)), int(np.ceil(at)))
            assert xs[low] <= v <= xs[high]
    assert got["odd"][0] == float("-inf") and got["odd"][2] == 0.0 and got["odd"][4] == float("inf")


def test_percentiles_of_nothing(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert exact_percentiles(df, ["g"], {"p": ("v", 0.5)}).collect() == []
    assert [tuple(r) for r in exact_percentiles(df, [], {"p": ("v", 0.5)}).collect()] == [(None,)]
