from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from flowlib.functions import timing
from flowlib.streaming import runs, scoring, source, twins
from tests.conftest import rows

FEATURES = ["Flow Byts/s", "b"]
T = dt.datetime(2024, 1, 1, 12)
ENVELOPE = "kafka_timestamp timestamp, kafka_partition int, kafka_offset long, value string"


def record(i, **cells):
    base = {"flow_id": f"f{i}", "replay_run_tag": "r1" if i % 2 else "r2", "event_time": "2024-01-01T11:59:59.500", "source_ingest_epoch_ms": None, "source_ingest_ts": None, "Flow Byts/s": i / 10, "b": 1}
    return (T, 0, i, json.dumps({**base, **cells}))


DATA = [
    record(0), record(1, source_ingest_epoch_ms=1704110399000), record(2, source_ingest_ts="2024-01-01T11:59:58"), record(3, event_time=None), record(4, is_control_record=1),
    record(5, control_type="input_sentinel"), record(6, b="text"), (T, 0, 7, "not json"), record(8, event_time="2024-01-01T12:00:05"),
]


@pytest.fixture(scope="module")
def envelope(spark):
    return spark.createDataFrame(DATA, ENVELOPE)


@pytest.fixture(scope="module")
def folder(spark, envelope, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("in") / "records")
    envelope.repartition(3).write.parquet(path)
    return path


def test_parse(envelope):
    got = {r.kafka_offset: r for r in source.parse_json_flow(envelope, FEATURES).collect()}
    assert len(got) == 9 and got[7].flow_id is None
    assert (got[6].flow_id, got[6].b, got[6]["Flow Byts/s"]) == ("f6", None, 0.6)
    kept = source.parse_json_flow(envelope, FEATURES, drop_malformed=True)
    assert sorted(r.kafka_offset for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 8]


def test_control_records(envelope):
    records = source.parse_json_flow(envelope, FEATURES)
    data, control = source.split_control_data(records)
    assert sorted(r.kafka_offset for r in control.collect()) == [4, 5] and data.count() == 7
    assert rows(source.end_of_input(control)) == [("r1", 1, 5)]
    assert source.filter_run_tag(records, "  ").count() == 9 and source.filter_run_tag(records, "r1").count() == 3


def test_timing(envelope):
    timed = timing.with_source_latency(timing.with_event_lateness(timing.with_event_timing(source.parse_json_flow(envelope, FEATURES))))
    got = {r.kafka_offset: (r.event_lateness_ms, r.is_late_event, r.source_to_ingest_ms) for r in timed.collect()}
    assert got[0] == (500.0, 1, 0.0) and got[1] == (1000.0, 1, 1000.0) and got[2] == (2000.0, 1, 2000.0)
    assert got[3] == (0.0, 0, 0.0) and got[8] == (0.0, 0, 0.0) and got[7] == (0.0, 0, 0.0)


def test_latency_counts_from_stream_start_and_may_be_negative(envelope):
    timed = timing.with_event_timing(source.parse_json_flow(envelope, FEATURES)).withColumn("emit_time", F.lit(T))
    plain = {r.kafka_offset: (r.processing_ms, r.end_to_end_ms) for r in timing.with_processing_latency(timed).collect()}
    assert plain[0] == (0.0, 500.0) and plain[1] == (0.0, 1000.0) and plain[8] == (0.0, -5000.0)
    assert plain[3] == (0.0, float(1704110400000))
    late_start = {r.kafka_offset: (r.processing_ms, r.end_to_end_ms) for r in timing.with_processing_latency(timed, 1704110402000).collect()}
    assert late_start[0] == (-2000.0, -2000.0) and late_start[8] == (-2000.0, -5000.0)


CONFIG = scoring.ScoringConfig(tuple(FEATURES), "m", "full", "live", score="`Flow Byts/s`", threshold=0.3)


def test_stream_equals_batch(spark, envelope, folder, tmp_path):
    emit = F.lit(T)
    out = str(tmp_path / "out")
    stream = scoring.score_pipeline(source.file_envelope(spark, folder, 1), CONFIG, emit)
    runs.drain(runs.prediction_file_writer(stream, out, str(tmp_path / "cp"), "t1"))
    batch = runs.prediction_records(scoring.score_pipeline(envelope, CONFIG, emit))
    assert sorted(rows(spark.read.parquet(out).select("key", "value")), key=str) == sorted(rows(batch.select("key", "value")), key=str)
    typed = {r.kafka_offset: r for r in runs.read_predictions(spark, out).collect()}
    assert (typed[3].prediction_label, typed[2].prediction_label, typed[7].prediction_label, typed[7].prediction_score) == (1, 0, 0, None)


def test_passthrough(envelope):
    plain = scoring.ScoringConfig(tuple(FEATURES), "none", "full", "live")
    got = scoring.score_pipeline(envelope, plain).select("prediction_score", "prediction_label", "threshold_used", "emit_time").first()
    assert got[:3] == (None, None, None) and got.emit_time is not None


def test_restart_equals_one_run(spark, folder, tmp_path):
    inbox, out, cp = (str(tmp_path / n) for n in ("inbox", "out", "cp"))
    data = spark.read.parquet(folder)

    def attempt():
        records = source.parse_json_flow(source.file_envelope(spark, inbox), FEATURES)
        runs.drain(runs.table_writer(records, out, cp, "t2"))
        return spark.read.parquet(out).count()

    data.where("kafka_offset < 4").write.mode("append").parquet(inbox)
    counts = [attempt(), attempt()]
    data.where("kafka_offset >= 4").write.mode("append").parquet(inbox)
    counts.append(attempt())
    assert counts == [4, 4, 9]
    assert spark.read.parquet(out).select("kafka_offset").distinct().count() == 9


def test_reset_begins_anew(spark, folder, tmp_path):
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")

    def attempt():
        records = source.parse_json_flow(source.file_envelope(spark, folder), FEATURES)
        runs.drain(runs.table_writer(records, out, cp, "t10"))
        return spark.read.parquet(out).count()

    assert not runs.checkpoint_present(spark, cp)
    assert (attempt(), runs.checkpoint_present(spark, cp), attempt()) == (9, True, 9)
    runs.reset_run(spark, out, cp, str(tmp_path / "never"))
    assert not runs.checkpoint_present(spark, cp) and attempt() == 9


def test_kafka_sink_is_described_without_starting(spark, folder, tmp_path):
    scored = scoring.score_pipeline(source.file_envelope(spark, folder), CONFIG)
    assert runs.prediction_kafka_writer(scored, "nowhere:1", "t", str(tmp_path / "c"), "t11") is not None
    assert runs.prediction_records(scored).columns == ["key", "value"]


def test_repeated_offsets_can_be_dropped(spark, envelope, tmp_path):
    inbox = str(tmp_path / "in")
    envelope.union(envelope).write.parquet(inbox)
    scored = runs.distinct_offsets(scoring.score_pipeline(source.file_envelope(spark, inbox), CONFIG))
    runs.drain(runs.prediction_file_writer(scored, str(tmp_path / "o"), str(tmp_path / "c"), "t3"))
    assert spark.read.parquet(str(tmp_path / "o")).count() == 7


def test_failed_and_blank_runs(spark, folder, tmp_path):
    broken = source.file_envelope(spark, folder).select(F.raise_error(F.lit("boom")).alias("x"))
    with pytest.raises(Exception, match="boom"):
        runs.drain(runs.table_writer(broken, str(tmp_path / "o"), str(tmp_path / "c"), "t4"))
    with pytest.raises(ValueError):
        runs.processing_trigger(runs.table_writer(source.file_envelope(spark, folder), "o", "c", "t5"), " ")


def test_progress_rows(spark, folder, tmp_path):
    records = source.parse_json_flow(source.file_envelope(spark, folder, 1), FEATURES)
    done = runs.drain(runs.table_writer(records, str(tmp_path / "o"), str(tmp_path / "c"), "t6"))
    got = runs.progress_rows(spark, done).agg(F.sum("input_rows"), F.min("batch_ms")).first()
    assert got[0] == 9 and got[1] >= 0


def test_progress_log_collects_while_running(spark, folder, tmp_path):
    import time

    log, path = runs.ProgressLog(), str(tmp_path / "progress")
    spark.streams.addListener(log)
    try:
        records = source.parse_json_flow(source.file_envelope(spark, folder, 1), FEATURES)
        runs.drain(runs.table_writer(records, str(tmp_path / "o"), str(tmp_path / "c"), "t9"))
        seen, until = 0, time.time() + 20
        while seen < 9 and time.time() < until:
            log.flush(spark, path)
            seen = spark.read.parquet(path).where("query_name = 't9'").agg(F.coalesce(F.sum("input_rows"), F.lit(0))).first()[0] if (tmp_path / "progress").exists() else 0
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(log)
    assert seen == 9 and log.flush(spark, path) == 0


def test_lag_samples_from_kafka_offsets(spark):
    progress = spark.createDataFrame(
        [("q", 3, "2024-01-01T12:00:00.000Z", 5, 1.0, 1, 1, "KafkaV2", "{}", '{"t":{"0":10,"1":4}}', '{"t":{"0":12,"1":4,"2":3}}')], runs.PROGRESS_SCHEMA
    )
    got = runs.lag_samples_from_progress(progress, "r", "t").first()
    assert (got.lag_records, got.high_watermark_max, got.processed_offset_max, got.partition_count, got.status, got.ts_epoch_ms) == (5, 12, 9, 3, "ok", 1704110400000)


def test_stream_label_join_is_bounded(spark, tmp_path):
    base = spark.range(200).select(
        F.expr("concat('f', id)").alias("flow_id"), F.expr("cast(id % 4 as int)").alias("kafka_partition"), "id", F.col("id").alias("kafka_offset"), F.expr("timestamp_seconds(1704110400 + id * 60)").alias("emit_time")
    )
    base.write.parquet(str(tmp_path / "p"))
    inputs = base.where("id % 5 > 0").select("kafka_partition", "kafka_offset", F.expr("emit_time - interval 1 minute").alias("event_time"), F.lit(1).alias("label_binary"), F.lit("Bot").alias("label"))
    inputs.write.parquet(str(tmp_path / "i"))
    read = lambda n: spark.readStream.schema(spark.read.parquet(str(tmp_path / n)).schema).parquet(str(tmp_path / n))
    joined = twins.stream_label_join(read("p"), read("i"))
    runs.drain(runs.table_writer(joined, str(tmp_path / "o"), str(tmp_path / "c"), "t7"))
    got = spark.read.parquet(str(tmp_path / "o"))
    assert got.where("label is not null").count() == 160
    # Unmatched rows older than the watermark have come out without a label, each once.
    unmatched = got.where("label is null")
    assert 0 < unmatched.count() <= 40 and unmatched.where("id % 5 > 0").count() == 0


def test_windowed_twin_in_append_mode(spark, tmp_path):
    data = spark.range(600).select(F.lit("r").alias("run_tag"), F.lit(None).cast("string").alias("benchmark_phase"), F.expr("timestamp_seconds(1704110400 + id div 10)").alias("emit_time"), F.col("id").cast("double").alias("end_to_end_ms"))
    data.write.parquet(str(tmp_path / "p"))
    stream = spark.readStream.schema(data.schema).parquet(str(tmp_path / "p"))
    runs.drain(runs.table_writer(twins.latency_by_window(stream, "1 second", "0 seconds"), str(tmp_path / "o"), str(tmp_path / "c"), "t8"))
    got = spark.read.parquet(str(tmp_path / "o"))
    # The last open window stays in state.
    assert got.count() == 59 and got.where("rows <> 10 or benchmark_phase <> 'measure'").count() == 0


def test_kafka_needs_its_connector(spark):
    with pytest.raises(Exception, match="(?i)kafka"):
        source.kafka_envelope(spark, "nowhere:1", "t")
