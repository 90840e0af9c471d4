from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from flowlib.operators import arrivals
from tests.conftest import rows

PLAN = [(100.0, 2.0), (0.0, 3.0), (50.0, 2.0)]


@pytest.mark.parametrize("n, seconds", [(0, 0.0), (1, 0.01), (200, 2.0), (201, 5.02), (300, 7.0), (400, 9.0)])
def test_elapsed_for_rows(spark, n, seconds):
    df = spark.createDataFrame([(n,)], "n long")
    assert df.select(arrivals.elapsed_for_rows(F.col("n"), PLAN)).first()[0] == pytest.approx(seconds)


@pytest.mark.parametrize("seconds, n", [(0.0, 0.0), (1.0, 100.0), (3.0, 200.0), (6.0, 250.0), (7.0, 300.0), (9.0, 400.0)])
def test_rows_for_elapsed(spark, seconds, n):
    df = spark.createDataFrame([(seconds,)], "s double")
    assert df.select(arrivals.rows_for_elapsed(F.col("s"), PLAN)).first()[0] == pytest.approx(n)


def test_plans_without_rate(spark):
    df = spark.createDataFrame([(5, 5.0)], "n long, s double")
    assert df.select(arrivals.elapsed_for_rows(F.col("n"), [(0.0, 4.0)]), arrivals.rows_for_elapsed(F.col("s"), [(0.0, 4.0)])).first() == (4.0, 0.0)


def test_schedule_and_ticks(spark):
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    got = arrivals.arrival_schedule(spark.range(300).withColumnRenamed("id", "row_index"), PLAN, start)
    assert got.where("row_index = 200").first().scheduled_ts == dt.datetime(2024, 1, 1, 0, 0, 5, 20000)
    ticks = arrivals.tick_targets(spark.createDataFrame([(0,), (10,), (1000,)], "tick int"), PLAN, F.lit(250))
    assert [r.target_rows for r in ticks.orderBy("tick").collect()] == [10, 100, 250]


def test_slice_numbers_rows(spark):
    df = spark.range(50).select((50 - F.col("id")).alias("t"), F.lit(dt.datetime(2024, 1, 1)).alias("timestamp"))
    got = arrivals.slice_replay_source(df, ["t"], 10, 5)
    assert rows(got.select("row_index", "t", "flow_id"), "row_index") == [(i, i + 1, f"flow-{i}") for i in range(10, 15)]
    assert "event_time" in got.columns
    assert arrivals.slice_replay_source(df.withColumn("flow_id", F.lit("x")), ["t"], -3).where("flow_id = 'x'").count() == 50


def test_encoded_records(spark):
    df = spark.createDataFrame([("f1", 1.5, dt.datetime(2024, 1, 1, 2, 3, 4)), (None, float("nan"), None), ("", None, None)], "flow_id string, v double, at timestamp")
    df = df.withColumn("row_index", F.lit(4))
    got = [(r.key, json.loads(r.value)) for r in arrivals.encode_records(df, "run", ingest_epoch_ms=F.lit(1700000000123)).collect()]
    assert [k for k, _ in got] == ["f1", "run__row_4", "run__row_4"]
    first, second = got[0][1], got[1][1]
    assert (first["v"], first["at"], first["source_ingest_epoch_ms"], first["source_ingest_ts"]) == (1.5, "2024-01-01T02:03:04.000000", 1700000000123, "2023-11-14T22:13:20.123Z")
    assert (second["v"], second["flow_id"], second["replay_run_tag"], second["replay_row_index"], second["benchmark_phase"]) == (None, None, "run", 4, "measure")


def test_reorder_stays_inside_blocks(spark):
    df = spark.range(103).withColumnRenamed("id", "row_index")
    got = rows(arrivals.reorder_within_blocks(df, 10, 42))
    assert sorted(n for _, n in got) == list(range(103)) and all(i // 10 == n // 10 for i, n in got)
    assert any(i != n for i, n in got) and sorted(got) == sorted(rows(arrivals.reorder_within_blocks(df.repartition(5), 10, 42)))
    assert sorted(got) != sorted(rows(arrivals.reorder_within_blocks(df, 10, 43)))
    assert rows(arrivals.reorder_within_blocks(df, 1, 42)) == [(i, i) for i in range(103)]


def test_late_events_are_exact_in_number_and_bounded(spark):
    df = spark.range(1000).select("id", F.expr("id % 3").alias("b"), F.expr("if(id % 10 = 0, null, timestamp_seconds(1700000000 + id))").alias("event_time"))
    got = arrivals.inject_late_events(df, 0.1, 5.0, 7, "id", ["b"])
    joined = got.join(df.withColumnRenamed("event_time", "was").drop("b"), "id").withColumn("shift", (F.unix_micros("was") - F.unix_micros("event_time")) / 1e6)
    timed = {r.b: r.n for r in df.groupBy("b").agg(F.count("event_time").alias("n")).collect()}
    late = {r.b: r["count"] for r in got.where("is_delayed = 1").groupBy("b").count().collect()}
    assert late == {b: int(n * 0.1) for b, n in timed.items()}
    moved = joined.where("is_delayed = 1").agg(F.min("shift"), F.max("shift")).first()
    assert 0.001 <= moved[0] <= moved[1] <= 5.0
    assert joined.where("is_delayed = 0 and shift <> 0").count() == 0 and joined.where("was is null and event_time is not null").count() == 0
    assert arrivals.inject_late_events(df, 0.0, 5.0, 7, "id").where("is_delayed = 1").count() == 0


def test_rate_plan_summary(spark):
    steps = spark.createDataFrame([("p", 100.0, 2.0), ("p", 0.0, 3.0), ("p", 50.0, 2.0), ("z", 0.0, 0.5)], "plan string, rows_per_sec double, duration_sec double")
    got = {r.plan: (r.expected_rows, r.duration_sec, r.total_seconds, r.peak_rps, r.target_rps) for r in arrivals.rate_plan_summary(steps, ["plan"]).collect()}
    assert got == {"p": (300, 7, 7.0, 100.0, 300 / 7), "z": (1, 1, 0.5, 0.0, 1.0)}


def test_emit_gaps(spark):
    base = dt.datetime(2024, 1, 1)
    times = [0, 10, 30, 60, 100]
    df = spark.createDataFrame([("r", i, base + dt.timedelta(milliseconds=t), base + dt.timedelta(milliseconds=20 * i)) for i, t in enumerate(times)], "run string, row_index int, emit_ts timestamp, due_ts timestamp")
    got = arrivals.emit_gap_stats(df, ["run"]).first()
    # Gaps 10, 20, 30, 40: rank round(1.5) = 2, round(2.85) = 3.
    assert (got.emit_gap_p50_ms, got.emit_gap_p95_ms, got.emit_gap_max_ms) == (30.0, 40.0, 40.0)
    assert (got.tick_lag_max_ms, got.sent_rows, got.actual_rps) == (20.0, 5, 50.0)


def test_sentinel(spark):
    got = arrivals.input_sentinel(spark.createDataFrame([("r", dt.datetime(2024, 1, 1))], "run_tag string, at timestamp")).first()
    assert (got.flow_id, got.is_control_record, got.control_type, got.benchmark_phase, got.label) == ("r__input_sentinel", 1, "input_sentinel", "control", None)
