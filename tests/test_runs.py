"""Latency, backlog, label join, rules and report tables."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from flowlib.operators import labels, lag, latency, rules, summary
from tests.conftest import rows

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


PREDS = "run_tag string, benchmark_phase string, emit_time timestamp, source_to_ingest_ms double, processing_ms double, end_to_end_ms double"


@pytest.fixture(scope="module")
def preds(spark):
    data = [("a", None, at(0), 1.0, 2.0, 10.0), ("a", "MEASURE", at(4), 3.0, None, 30.0), ("a", "warmup", at(-2.5), 9.0, 9.0, 99.0), ("a", "measure", at(4), None, 4.0, 20.0)]
    data += [("flat", "measure", at(1), 1.0, 1.0, 1.0)] * 2 + [("cold", "cold_start", at(0), 1.0, 1.0, 5.0), ("cold", "cold_start", at(2), 1.0, 1.0, None), ("cold", "measure", at(2), 1.0, 1.0, 70.0)]
    return spark.createDataFrame(data, PREDS)


def test_latency_summary(spark, preds):
    runs = spark.createDataFrame([("a",), ("flat",), ("gone",), ("cold",)], "run_tag string")
    got = {r.run_tag: r for r in latency.latency_summary(preds, "measure", runs).collect()}
    a = got["a"]
    assert (a.latency_status, a.rows_total, a.measure_wall_clock_sec, a.drain_rps) == ("ok", 3, 4.0, 0.75)
    assert (a.artifact_e2e_p50_ms, a.artifact_processing_p50_ms) == (20.0, 3.0) and a.artifact_e2e_p95_ms == pytest.approx(29.0)
    assert (got["flat"].measure_wall_clock_sec, got["flat"].drain_rps, got["flat"].rows_total) == (None, None, 2)
    assert (got["gone"].latency_status, got["gone"].artifact_rows_total, got["gone"].rows_total) == ("latency_missing", 0, None)
    only_warm = latency.latency_summary(preds.where("benchmark_phase = 'warmup'"), "measure").first()
    assert (only_warm.latency_status, only_warm.artifact_e2e_p50_ms) == ("no_predictions", None)


def test_blank_phase_keeps_all(preds):
    assert {r.run_tag: r.rows_total for r in latency.latency_summary(preds, "").collect()} == {"a": 4, "flat": 2, "cold": 3}


def test_timeseries_counts_from_the_first_emit_of_any_phase(preds):
    got = {(r.benchmark_phase, r.second): (r.rows, r.e2e_p50_ms) for r in latency.latency_timeseries(preds.where("run_tag = 'a'")).collect()}
    assert got == {("warmup", 0): (1, 99.0), ("measure", 2): (1, 10.0), ("MEASURE", 6): (1, 30.0), ("measure", 6): (1, 20.0)}


def test_fault_phase_summary(spark, preds):
    runs = spark.createDataFrame([("cold", "none"), ("a", "crash")], "run_tag string, fault_kind string")
    # Only the row with a latency is counted, the span is of all rows of the phase.
    assert rows(latency.fault_phase_summary(preds, runs)) == [("cold", 0.5, 5.0)]
    assert rows(summary.join_phase_summary(runs, latency.fault_phase_summary(preds, runs)), "run_tag") == [("a", "crash", None, None), ("cold", "none", 0.5, 5.0)]


def test_distribution_pools_runs_and_drops_null_groups(spark, preds):
    runs = spark.createDataFrame([("a", "m"), ("flat", "m"), ("cold", None)], "run_tag string, mode string")
    got = latency.latency_distribution(preds, runs, ["mode"]).collect()
    assert [(r.mode, r.latency_rows, r.latency_min_ms, r.latency_max_ms) for r in got] == [("m", 5, 1.0, 30.0)]


def test_first_emit_delay(spark, preds):
    start = int(T0.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    starts = spark.createDataFrame([("a", start + 1500), ("cold", start - 500), ("gone", 0)], "run_tag string, since_epoch_ms long")
    got = dict(rows(latency.first_emit_delay(preds, starts, "measure")))
    assert got == {"a": 0.0, "cold": 2.5, "gone": None}


def test_empirical_cdf_has_distinct_heights(spark):
    df = spark.createDataFrame([("x", 1, 5.0), ("x", 2, 5.0), ("x", 3, 1.0), ("y", 4, 2.0), ("y", 5, None)], "k string, id int, v double")
    assert rows(latency.empirical_cdf(df, ["k"], "v", "id"), "k", "cdf") == [("x", 1.0, 1 / 3), ("x", 5.0, 2 / 3), ("x", 5.0, 1.0), ("y", 2.0, 1.0)]


def test_rebase_and_mean(spark):
    series = spark.createDataFrame([("a", "measure_x", 5, 1.0), ("a", "measure", 7, 3.0), ("b", "Measure", 2, 5.0), ("b", "warmup", 0, 9.0), ("b", "measure", 4, None)], "run_tag string, benchmark_phase string, second long, v double")
    got = latency.rebase_latency_series(series, "v")
    assert rows(got, "run_tag", "second") == [("a", 0, 1.0), ("a", 2, 3.0), ("b", 0, 5.0)]
    assert rows(latency.mean_series_by_second(got), "second") == [(0, 3.0), (2, 3.0)]


LAG = "run_tag string, ts_epoch_ms long, phase string, event string, lag_records long, status string"


@pytest.fixture(scope="module")
def samples(spark):
    r = [("r", t * 1000, "measure_replay", "measure_replay_end" if t == 3 else "", v, "ok") for t, v in ((0, 0), (1, 10), (3, 4), (4, 2), (6, 0))]
    r += [("r", 2000, "measure_replay", "", 50, "sample_error:X"), ("r", 500, "warmup", "", 70, "ok"), ("r", 5500, "measure_drain", "", None, "ok")]
    r += [("never", 0, "measure", "measure_replay_end", 5, "ok"), ("never", 1000, "measure", "", 5, "ok")]
    r += [("empty", 0, "measure", "measure_replay_end", 0, "ok")]
    r += [("warm", 0, None, "", 3, "ok")]
    return spark.createDataFrame(r, LAG)


def test_backlog_summary(samples):
    got = {r.run_tag: r for r in lag.backlog_summary(samples).collect()}
    r = got["r"]
    assert (r.kafka_lag_samples, r.kafka_lag_peak_records, r.kafka_lag_peak_phase, r.kafka_lag_at_replay_end_records) == (8, 10, "measure_replay", 4)
    assert (r.kafka_lag_clear_sec, r.kafka_lag_area_records_sec, r.kafka_lag_end_after_drain_records) == (3.0, 28.0, 0)
    assert (got["never"].kafka_lag_clear_sec, got["never"].kafka_lag_area_records_sec) == (None, 5.0)
    assert (got["empty"].kafka_lag_clear_sec, got["empty"].kafka_lag_area_records_sec) == (0.0, None)
    assert (got["warm"].kafka_lag_peak_records, got["warm"].kafka_lag_clear_sec, got["warm"].kafka_lag_samples) == (None, None, 1)


def test_rebased_lag(samples):
    assert [r[1:] for r in rows(lag.rebase_lag_series(samples.where("run_tag = 'never'")), "second")] == [(0, 5.0), (1, 5.0)]


def test_offset_lag_forms(spark):
    preds = spark.createDataFrame([("measure", 0, 7), (None, 0, 5), ("measure", 1, 3), ("warmup", 2, 99), ("measure", None, 4)], "benchmark_phase string, kafka_partition int, kafka_offset long")
    marks = spark.createDataFrame([(0, 0, 10), (1, 0, 4), (2, 0, 100), (3, 5, 9)], "topic_partition int, low long, high long")
    got = lag.offset_lag(preds, marks, "measure", 1).first()
    assert (got.kafka_lag_status, got.kafka_lag_records_raw_end, got.kafka_lag_records_end, got.kafka_lag_partitions) == ("ok", 2, 1, 2)
    live = lag.sampler_lag(preds, marks, 1).first()
    assert (live.raw_lag_records, live.lag_records, live.partition_count, live.processed_offset_max) == (6, 5, 4, 99)
    none = lag.offset_lag(preds.where("false"), marks).first()
    assert (none.kafka_lag_status, none.kafka_lag_records_end, none.kafka_lag_partitions) == ("artifact_offsets_missing", None, 0)
    each = F.explode(F.array(F.lit("a"), F.lit("b"))).alias("run_tag")
    runs = preds.withColumn("run_tag", F.lit("a"))
    got = rows(lag.offset_lag(runs, marks.select("*", each), "measure", 1, ["run_tag"]), "run_tag")
    assert [tuple(r) for r in got] == [("a", "ok", 1, 2, 1, 2, 10), ("b", "artifact_offsets_missing", None, None, None, 0, None)]
    got = rows(lag.sampler_lag(runs, marks.select("*", each), 1, ["run_tag"]).select("run_tag", "raw_lag_records", "partition_count"), "run_tag")
    assert [tuple(r) for r in got] == [("a", 6, 4), ("b", 118, 4)]


def test_collected_runs_hold_their_own_labels(spark):
    preds = spark.createDataFrame(
        [("a", "measure", 0, 1), ("a", None, 0, 2), ("a", "warmup", 0, 3), ("b", "measure", 0, 1), ("c", "measure", 0, 1), (None, "measure", 0, 1), ("a", "measure", None, None)],
        "run_tag string, benchmark_phase string, kafka_partition int, kafka_offset long")
    inputs = spark.createDataFrame([("a", 0, 1, 1, "x"), ("a", 0, 2, 0, "y"), ("b", 0, 2, 1, "z")], "replay_run_tag string, kafka_partition int, kafka_offset long, label_binary int, label string")
    expected = spark.createDataFrame([("a", "measure", 3), ("b", "measure", 2), ("d", "measure", 1), ("a", "post_fault", 0)], "run_tag string, phase string, expected long")
    artifact, barrier = labels.collect_artifacts(preds, inputs, expected)
    got = sorted((r.run_tag, r.kafka_offset or 0, r.label) for r in artifact.collect())
    assert got == [("a", 0, None), ("a", 1, "x"), ("a", 2, "y"), ("b", 1, None)]
    got = [tuple(r) for r in rows(barrier, "run_tag")]
    assert got == [("a", "measure", 3, 3, 0, "ok", 2), ("b", "measure", 2, 1, 1, "incomplete", 0), ("d", "measure", 1, 0, 1, "incomplete", 0)]


def test_label_join_keeps_repeats_and_rows_without_offset(spark):
    preds = spark.createDataFrame([("a", 0, 1), ("a2", 0, 1), ("b", 0, 2), ("c", None, 1), ("d", 1, 1)], "flow_id string, kafka_partition int, kafka_offset long")
    inputs = spark.createDataFrame([(0, 1, 1, "Bot", 0, "r"), (0, 2, 0, "Benign", 1, "r"), (1, 1, 0, "Benign", 0, "other")], "kafka_partition int, kafka_offset long, label_binary int, label string, is_control_record int, replay_run_tag string")
    got = labels.join_labels_by_offset(preds, inputs, "r")
    assert rows(got.select("flow_id", "label"), "flow_id") == [("a", "Bot"), ("a2", "Bot"), ("b", None), ("c", None), ("d", None)]
    assert rows(labels.label_coverage(got)) == [(5, 2)]
    assert rows(labels.semi_join_required_keys(inputs, preds, "r").select("label")) == [("Bot",)]


SLO = "latency_status string, artifact_rows_total string, rows_total string, drain_rps string, artifact_e2e_p50_ms string, artifact_e2e_p95_ms string, replay_status string, target_rps double, rows_expected int, trigger_interval string"


@pytest.mark.parametrize(
    "row, reason",
    [
        (("ok", "100", "100", "95", "100", "900", "ok", 100.0, 100, "1 second"), ""),
        (("", "", "", "", "", "", None, 100.0, 100, ""), "artifact_latency_missing;rows_below_expected;throughput_below_target;latency_missing"),
        (("ok", "94", None, "89", "501", "1501", "unstable", 100.0, 100, "x"), "rows_below_expected;throughput_below_target;p50_e2e_exceeded;p95_e2e_exceeded;load_generator_unstable"),
        (("ok", "100", "0", "95", None, "900", "ok", 100.0, 0, "1"), "latency_missing"),
        (("ok", "100", "100", "95", "100", "900", "ok", 0.0, 100, "1"), "throughput_below_target"),
    ],
)
def test_service_level(spark, row, reason):
    got = rules.evaluate_slo(spark.createDataFrame([row], SLO)).first()
    assert (got.failure_reason, got.slo_status) == (reason, "fail" if reason else "pass")


@pytest.mark.parametrize(
    "ratio, p95, peak, growth, verdict",
    [(None, 1.0, None, None, "artifact_missing"), (0.89, 1.0, 5.0, None, "overloaded"), (1.0, 2001.0, None, None, "overloaded"), (0.9, 2000.0, 1.0, None, "backpressure"), (1.0, 1.0, 0.5, 1.0, "backpressure"), (1.0, 1.0, None, 0.0, "stable")],
)
def test_overload(spark, ratio, p95, peak, growth, verdict):
    df = spark.createDataFrame([(ratio, p95, peak, growth)], "a double, b double, c double, d double")
    assert df.select(rules.classify_overload(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).first()[0] == verdict


def test_overload_ratios_of_zero(spark):
    got = rules.with_overload_ratios(spark.createDataFrame([(0.0, 5.0, 3.0), (10.0, 0.0, 3.0)], "target_rps double, drain_rps double, kafka_lag_peak_records double")).collect()
    assert [(r.drain_throughput_ratio, r.target_to_drain_ratio, r.kafka_lag_peak_ratio) for r in got] == [(None, None, None), (0.0, None, 0.3)]


@pytest.mark.parametrize(
    "row, reason",
    [
        (("ok", 0, "ok", 0), ""), (("ok", 0, None, None), ""), ((None, 0, "ok", 0), "kafka_lag_status=missing"), (("ok", None, "ok", 0), "kafka_lag_records_end=missing"),
        (("ok", 3, "ok", 0), "kafka_lag_records_end=3"), (("ok", 0, "off", 0), "kafka_lag_sampler_status=off"), (("ok", 0, "ok", 2), "kafka_lag_end_after_drain_records=2"),
    ],
)
def test_drain_barrier(spark, row, reason):
    df = spark.createDataFrame([row], "kafka_lag_status string, kafka_lag_records_end int, kafka_lag_sampler_status string, kafka_lag_end_after_drain_records int")
    got = rules.drain_barrier(df).first()
    assert (got.drain_reason, got.drain_status) == (reason, "failed" if reason else "ok")


@pytest.mark.parametrize(
    "row, verdict",
    [
        (("none", 95, 100, None, None, None, None), "ok"), (("none", 94, 100, None, None, None, None), "artifact_incomplete"), (("crash", 10, 100, 100, 100, True, False), "pre_fault_incomplete"),
        (("crash", 100, 100, 94, 100, True, False), "post_fault_incomplete"), (("crash", 100, 100, 95, 100, False, False), "checkpoint_missing"), (("crash", 100, 100, 95, 100, True, True), "checkpoint_missing"),
        (("crash", 100, 100, 95, 100, True, False), "ok"),
    ],
)
def test_recovery(spark, row, verdict):
    df = spark.createDataFrame([row], "k string, a int, b int, c int, d int, e boolean, f boolean")
    assert df.select(rules.recovery_status(*[F.col(c) for c in "kabcdef"])).first()[0] == verdict


def test_source_stability(spark):
    df = spark.createDataFrame([(100.0, 94.0, 1001.0, 5.0, 0), (None, None, None, None, 2), (100.0, 95.0, 1000.0, 1000.0, 0)], "t double, a double, g double, l double, s int")
    got = [r[0] for r in df.select(rules.source_stability(*[F.col(c) for c in "tagls"])).collect()]
    assert got == ["replay_actual_rps_below_target;replay_emit_gap_spike", "replay_producer_buffer_stall", ""]


def test_threshold_lookup_falls_back(spark):
    models = spark.createDataFrame([("a", "full"), ("b", "full"), ("c", "full")], "model string, feature_set string")
    metrics = spark.createDataFrame([(" a ", "full", "0.2", 1), ("a", "full", "0.3", 2), ("b", "full", "x", 1)], "model string, feature_set string, opt_threshold string, version int")
    points = spark.createDataFrame([("a", "full", "0.9"), ("b", "full", "0.7")], "model string, feature_set string, opt_threshold string")
    assert rows(rules.resolve_threshold(models, metrics, points).select("model", "threshold"), "model") == [("a", 0.3), ("b", 0.7), ("c", 0.5)]


def test_upsert_and_union(spark):
    old = spark.createDataFrame([("m", "x", 1, 0.5), ("n", "x", 1, 0.1)], "model string, split string, version int, recall double")
    new = spark.createDataFrame([("m", "x", 0, 0.7, "z")], "model string, split string, version int, recall double, extra string")
    got = summary.upsert_summary(old, new, ["model", "split"], [F.desc("recall")])
    assert [(r.model, r.recall, r.extra) for r in got.collect()] == [("m", 0.7, "z"), ("n", 0.1, None)]
    assert summary.union_summary_rows([old, new]).columns == ["model", "split", "version", "recall", "extra"]


def test_repeats(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "2"), ("a", "4"), ("b", "5"), ("c", ""), (None, "9")], "k string, v string")
    got = {r.k: r for r in summary.mean_std(df, ["k"], ["v", "gone"]).collect()}
    assert set(got) == {"a", "b", "c"}
    assert (got["a"].v_mean, got["a"].v_n) == (pytest.approx(7 / 3), 3) and got["a"].v_std == pytest.approx(1.5275252)
    assert (got["b"].v_std, got["c"].v_mean, got["c"].v_std, got["a"].gone_mean) == (0.0, None, None, None)
    mid = {r.k: (r.v_median, r.v_min, r.v_max, r.repeat_count) for r in summary.median_min_max(df, ["k"], ["v"]).collect()}
    assert mid == {"a": (2.0, 1.0, 4.0, 3), "b": (5.0, 5.0, 5.0, 1), "c": (None, None, None, 1)}


def test_selected_configuration(spark):
    schema = "run_tag string, mode string, target_rps string, trigger_interval string, shuffle_partitions int"
    runs = spark.createDataFrame([("r1", "random_forest_full", "500", None, None), ("r2", "random_forest_full", "500", "2 seconds", 8), ("r0", "pass_through", "500", "9 s", 1)], schema)
    other = spark.createDataFrame([("x", "m", "1", "7 s", 3)], schema)
    got = summary.selected_configuration(runs, other, {"machine": "m1"}).first()
    assert (got.trigger_interval, got.shuffle_partitions, got.spark_master, got.kafka_partitions, got.machine) == ("2 seconds", "8", "local[4]", "1", "m1")
    assert summary.selected_configuration(runs.where("mode = 'pass_through'"), other, {}).first().trigger_interval == "7 s"


def test_summary_csv_keeps_the_union_of_columns(spark, tmp_path):
    frames = [spark.createDataFrame([("a", 1)], "run_tag string, x int"), spark.createDataFrame([("b", 2.5)], "run_tag string, y double")]
    summary.write_summary_rows(summary.union_summary_rows(frames), str(tmp_path / "s"))
    back = spark.read.option("header", "true").csv(str(tmp_path / "s"))
    assert back.columns == ["run_tag", "x", "y"] and rows(back, "run_tag") == [("a", "1", None), ("b", None, "2.5")]


def test_sketched_percentiles_stay_close(spark):
    df = spark.range(20_000).select(F.expr("concat('r', id % 2)").alias("run_tag"), F.lit("measure").alias("benchmark_phase"), F.expr("timestamp_seconds(id)").alias("emit_time"),
                                    *[F.expr("cast(id % 1000 as double)").alias(c) for c in ("source_to_ingest_ms", "processing_ms", "end_to_end_ms")])
    exact = {r.run_tag: r.artifact_e2e_p95_ms for r in latency.latency_summary(df).collect()}
    near = {r.run_tag: r.artifact_e2e_p95_ms for r in latency.latency_summary(df, accuracy=1000).collect()}
    assert all(abs(exact[k] - near[k]) <= 3 for k in exact)


def test_stored_runs_are_pruned_by_run_and_phase(spark, preds, tmp_path):
    from flowlib.sources import tables

    tables.write_run_artifacts(preds, str(tmp_path / "runs"))
    got = tables.read_run_artifacts(spark, str(tmp_path / "runs"), ["a", "cold"], "measure")
    assert got.count() == 4
    filters = got._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("], PushedFilters")[0]
    assert "run_tag" in filters and "benchmark_phase" in filters
