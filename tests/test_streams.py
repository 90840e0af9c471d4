"""Streams that close themselves, the record log with capped batches, and observed metrics."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from flowlib.sources import record_log
from flowlib.streaming import closing, observed, runs, twins


def records(spark, offsets: dict[int, range]):
    data = [(p, o, f'{{"flow_id": "{p}-{o}"}}') for p, span in offsets.items() for o in span]
    rows = spark.createDataFrame(data, "kafka_partition int, kafka_offset bigint, value string")
    return rows.withColumn("kafka_timestamp", F.expr("timestamp '2024-01-01 00:00:00.123456' + make_interval(0, 0, 0, 0, 0, 0, kafka_offset)"))


def drained(spark, log, tmp_path, most):
    stream = record_log.log_envelope(spark, log, str(tmp_path / "position"), most)
    runs.until_idle(runs.batch_writer(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"), "log"))
    return sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("batch_id", "kafka_partition", "kafka_offset").collect())


def test_batches_hold_no_more_than_the_cap(spark, tmp_path):
    log = str(tmp_path / "log")
    record_log.append_records(records(spark, {0: range(5, 40), 1: range(0, 7), 2: range(100, 101)}), log, file_rows=9)
    got = drained(spark, log, tmp_path, 9)
    assert [r[1:] for r in sorted(got, key=lambda r: r[1:])] == [(0, o) for o in range(5, 40)] + [(1, o) for o in range(7)] + [(2, 100)]
    sizes = {b: sum(r[0] == b for r in got) for b, *_ in got}
    assert max(sizes.values()) <= 9 and len(sizes) == 12
    # Started again without anything new, nothing comes; then what was appended, from new partitions too.
    assert drained(spark, log, tmp_path, 9) == got
    record_log.append_records(records(spark, {0: range(40, 42), 7: range(3, 5)}), log)
    more = [r for r in drained(spark, log, tmp_path, 2) if r not in got]
    assert sorted(r[1:] for r in more) == [(0, 40), (0, 41), (7, 3), (7, 4)]
    assert max(sum(r[0] == b for r in more) for b, *_ in more) <= 2
    times = spark.read.parquet(str(tmp_path / "out")).where("kafka_partition = 0 and kafka_offset = 6").select(F.unix_micros("kafka_timestamp")).first()[0]
    assert times % 1_000_000 == 123_456


def test_planned_ends_follow_from_the_log_alone(spark, tmp_path):
    log = str(tmp_path / "log")
    record_log.append_records(records(spark, {0: range(10), 1: range(4)}), log)
    reader = record_log.RecordLogReader(log, str(tmp_path / "note"), 4)
    assert reader.initialOffset() == {"0": 0, "1": 0}
    first = reader.latestOffset()
    assert first == {"0": 2, "1": 2} == reader.latestOffset()
    reader.partitions(reader.initialOffset(), first)
    # A reader made anew, as a restart does, goes on from what was planned; planning an old batch again moves nothing back.
    again = record_log.RecordLogReader(log, str(tmp_path / "note"), 4)
    assert again.latestOffset() == {"0": 4, "1": 4}
    again.partitions({"0": 2, "1": 2}, {"0": 4, "1": 4})
    again.partitions({"0": 0, "1": 0}, {"0": 2, "1": 2})
    assert again.latestOffset() == {"0": 6, "1": 4}
    assert json.loads((tmp_path / "note").read_text()) == {"0": 4, "1": 4}
    rows = [b.to_pydict() for part in again.partitions({"0": 3, "1": 3}, {"0": 5, "1": 4}) for b in again.read(part)]
    assert sorted(zip(sum((r["kafka_partition"] for r in rows), []), sum((r["kafka_offset"] for r in rows), []))) == [(0, 3), (0, 4), (1, 3)]
    with pytest.raises(ValueError):
        record_log.RecordLogReader(log, str(tmp_path / "note"), 0)


def test_a_lag_series_from_observed_metrics(spark, tmp_path):
    log, progress = str(tmp_path / "log"), str(tmp_path / "progress")
    record_log.append_records(records(spark, {0: range(5), 3: range(2)}), log)
    assert record_log.log_partitions(spark, log) == [0, 3]
    stream = observed.with_batch_metrics(record_log.log_envelope(spark, log, str(tmp_path / "note"), 4), [0, 3])
    with runs.logged_progress(spark, progress):
        runs.until_idle(runs.table_writer(stream, str(tmp_path / "rows"), str(tmp_path / "checkpoint"), "metrics"))
    series = observed.lag_series(spark.read.schema(runs.LOGGED_SCHEMA).parquet(progress), record_log.high_watermarks(spark, log))
    assert sorted(tuple(r) for r in series.collect()) == [(0, 0, 2, 1, 3), (0, 3, 2, 1, 0), (1, 0, 2, 3, 1), (1, 3, 0, 1, 0), (2, 0, 1, 4, 0), (2, 3, 0, 1, 0)]


def test_a_closed_stream_gives_its_last_windows(spark, tmp_path):
    rows = spark.sql("""SELECT 'r' AS run_tag, CAST(NULL AS STRING) AS benchmark_phase, timestamp '2024-05-01 10:00:00' + make_interval(0, 0, 0, 0, 0, 0, id) AS emit_time, CAST(id AS DOUBLE) AS end_to_end_ms FROM range(10)""")
    path = str(tmp_path / "in")
    closing.write_stream_input(rows, path, "emit_time", "1 hour")
    files = spark.read.parquet(path)
    assert files.where("control_type = 'input_sentinel'").selectExpr("cast(emit_time as string)", "run_tag").collect() == [("2024-05-01 11:00:09", None)]
    stream = spark.readStream.schema(files.schema).parquet(path)
    out = twins.latency_by_window(stream, "4 seconds", "10 seconds", closing=True)
    runs.drain(runs.table_writer(out, str(tmp_path / "out"), str(tmp_path / "checkpoint"), "closed"))
    assert sorted(r.rows for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [2, 4, 4]
    empty = str(tmp_path / "none")
    closing.write_stream_input(rows.where("false"), empty, "emit_time", "1 hour")
    assert spark.read.parquet(empty).count() == 1
