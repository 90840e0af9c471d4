"""Record parsing, timing and streaming queries. Streams read the records as files and run to the end of input."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from flowlib.functions import timing
from flowlib.operators.ordered import with_row_number
from flowlib.plans import views
from flowlib.plans.registry import query
from flowlib.scratch import new_path, stored
from flowlib.sources import record_log
from flowlib.streaming import closing, completion, observed, runs, scoring, source, twins

FEATURES = ["value", "k"]
STARTED_MS = 1704500000000
EMIT = "kafka_timestamp + interval 250 milliseconds"
_FIELDS = ", ".join([*source.ENVELOPE, *source.RECORD_FIELDS, *FEATURES]).replace("timestamp, source", "\"timestamp\", source")


def _batch(spark, sf):
    return spark.read.parquet(views.envelope_files(spark, sf))


def _records(spark, sf):
    return source.parse_json_flow(_batch(spark, sf), FEATURES)


_RECORDS = "(SELECT *, NULL::VARCHAR AS \"timestamp\" FROM timed) AS t"
_CONFIG = scoring.ScoringConfig(
    features=tuple(FEATURES), model_name="ratio", feature_set="full", run_tag="live", score="if(value > 200.0D, 1.0D, value / 200.0D)", threshold=0.3, stream_started_epoch_ms=STARTED_MS
)


def _run(df, spark, name, **how):
    """Append a stream to a table until its input ends, and read the table."""
    path, checkpoint = new_path(spark, name), new_path(spark, f"{name}-checkpoint")
    runs.drain(runs.table_writer(df, path, checkpoint, name), **how)
    return spark.read.schema(df.schema).parquet(path)


@query("parse_json_flow", sql=f"SELECT {_FIELDS} FROM {_RECORDS}")
def parse_json_flow(spark, sf):
    return _records(spark, sf)


@query("parse_json_flow_drop_malformed", sql=f"SELECT {_FIELDS} FROM {_RECORDS} WHERE NOT m")
def parse_json_flow_drop_malformed(spark, sf):
    return source.parse_json_flow(_batch(spark, sf), FEATURES, drop_malformed=True)


@query("filter_run_tag", sql="SELECT flow_id, replay_run_tag FROM records WHERE replay_run_tag = 'run2'")
def filter_run_tag(spark, sf):
    return source.filter_run_tag(source.filter_run_tag(_records(spark, sf), " "), " run2 ").select("flow_id", "replay_run_tag")


@query("split_control_data", sql="SELECT kafka_partition, kafka_offset, CASE WHEN is_control THEN 'control' ELSE 'data' END AS kind FROM timed")
def split_control_data(spark, sf):
    data, control = source.split_control_data(_records(spark, sf))
    cols = ["kafka_partition", "kafka_offset"]
    return data.select(*cols, F.lit("data").alias("kind")).unionByName(control.select(*cols, F.lit("control").alias("kind")))


@query("event_timing", sql="SELECT kafka_partition, kafka_offset, event_time_ts, ingest_time, source_ingest_time_ts, event_reference_time FROM timed")
def event_timing(spark, sf):
    return timing.with_event_timing(_records(spark, sf)).select(
        "kafka_partition", "kafka_offset", "event_time_ts", "ingest_time", "source_ingest_time_ts", "event_reference_time"
    )


@query("event_lateness", sql="SELECT kafka_partition, kafka_offset, event_lateness_ms, (event_lateness_ms > 0)::INT AS is_late_event FROM timed")
def event_lateness(spark, sf):
    timed = timing.with_event_lateness(timing.with_event_timing(_records(spark, sf)))
    return timed.select("kafka_partition", "kafka_offset", "event_lateness_ms", "is_late_event")


@query("source_latency", sql="SELECT kafka_partition, kafka_offset, source_to_ingest_ms FROM timed")
def source_latency(spark, sf):
    timed = timing.with_source_latency(timing.with_event_timing(_records(spark, sf)))
    return timed.select("kafka_partition", "kafka_offset", "source_to_ingest_ms")


_EMIT_MS = "(epoch_us(kafka_timestamp) + 250000) // 1000"
_PROC = f"""({_EMIT_MS} - greatest(epoch_us(ingest_time) // 1000, {STARTED_MS}))::DOUBLE AS processing_ms,
  ({_EMIT_MS} - greatest(coalesce(epoch_us(source_ingest_time_ts) // 1000, epoch_us(event_time_ts) // 1000, {STARTED_MS}), {STARTED_MS}))::DOUBLE AS end_to_end_ms"""


@query("processing_latency", sql=f"SELECT kafka_partition, kafka_offset, {_PROC} FROM timed")
def processing_latency(spark, sf):
    timed = timing.with_event_timing(_records(spark, sf)).withColumn("emit_time", F.expr(EMIT))
    return timing.with_processing_latency(timed, STARTED_MS).select("kafka_partition", "kafka_offset", "processing_ms", "end_to_end_ms")


@query("passthrough_score", sql="""
SELECT flow_id, NULL::DOUBLE AS prediction_score, NULL::INT AS prediction_label, NULL::DOUBLE AS threshold_used, 'none' AS model_name, 'full' AS feature_set, 'live' AS run_tag FROM records""")
def passthrough_score(spark, sf):
    out = scoring.passthrough_score(_records(spark, sf), "none", "full", "live")
    return out.select("flow_id", "prediction_score", "prediction_label", "threshold_used", "model_name", "feature_set", "run_tag")


def _stream(spark, sf):
    return source.file_envelope(spark, views.envelope_files(spark, sf))


def _capped_stream(spark, sf):
    """Several batches, each of a file a core at most."""
    path = views.envelope_files(spark, sf)
    return source.file_envelope(spark, path, source.files_per_batch(spark, path))


@query("read_flow_stream", sql=f"SELECT {_FIELDS} FROM {_RECORDS}")
def read_flow_stream(spark, sf):
    return _run(source.parse_json_flow(_stream(spark, sf), FEATURES), spark, "read")


@query("rate_limited_source", sql=f"SELECT {_FIELDS} FROM {_RECORDS}")
def rate_limited_source(spark, sf):
    return _run(source.parse_json_flow(_capped_stream(spark, sf), FEATURES), spark, "limited")


_PREDICTIONS = f"""SELECT flow_id, 'ratio' AS model_name, 'full' AS feature_set, 'live' AS run_tag, benchmark_phase,
  CASE WHEN value >= 60 THEN 1 ELSE 0 END AS prediction_label, CASE WHEN value > 200 THEN 1.0::DOUBLE ELSE value / 200.0::DOUBLE END AS prediction_score, 0.3::DOUBLE AS threshold_used, kafka_partition, kafka_offset,
  event_time_ts, ingest_time, make_timestamp(epoch_us(kafka_timestamp) + 250000) AS emit_time, source_to_ingest_ms, {_PROC}, event_lateness_ms, (event_lateness_ms > 0)::INT AS is_late_event
FROM timed WHERE NOT is_control"""


def _scored(envelope):
    return scoring.score_pipeline(envelope, _CONFIG, emit=F.expr(EMIT))


@query("score_stream_records", sql=_PREDICTIONS)
def score_stream_records(spark, sf):
    from flowlib.sources.tables import PREDICTION_COLUMNS, artifact_frame

    return _run(artifact_frame(_scored(_stream(spark, sf)), PREDICTION_COLUMNS), spark, "scored")


@query("write_prediction_stream", sql=f"SELECT * REPLACE (date_trunc('milliseconds', event_time_ts) AS event_time_ts, date_trunc('milliseconds', ingest_time) AS ingest_time, date_trunc('milliseconds', emit_time) AS emit_time), flow_id AS key FROM ({_PREDICTIONS}) AS p")
def write_prediction_stream(spark, sf):
    """JSON carries milliseconds."""
    path, checkpoint = new_path(spark, "predictions"), new_path(spark, "predictions-checkpoint")
    runs.drain(runs.prediction_file_writer(_scored(_stream(spark, sf)), path, checkpoint, "predictions"))
    return runs.read_predictions(spark, path)


@query("micro_batch_trigger", sql="SELECT kafka_partition, count(*) AS rows FROM records GROUP BY 1")
def micro_batch_trigger(spark, sf):
    path, checkpoint = new_path(spark, "ticked"), new_path(spark, "ticked-checkpoint")
    records = source.parse_json_flow(_capped_stream(spark, sf), FEATURES)
    running = runs.processing_trigger(runs.table_writer(records, path, checkpoint, "ticked"), "100 milliseconds").start()
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    return spark.read.parquet(path).groupBy("kafka_partition").agg(F.count("*").alias("rows"))


@query("checkpointed_restart", sql="SELECT kafka_partition, count(*) AS rows, count(*) AS distinct_rows, max(kafka_offset) AS max_offset FROM records GROUP BY 1")
def checkpointed_restart(spark, sf):
    """Half the input, a restart with nothing new, then the other half: no row is lost or repeated."""
    inbox, path, checkpoint = (new_path(spark, n) for n in ("inbox", "restarted", "restarted-checkpoint"))
    rows = _batch(spark, sf)

    def attempt():
        records = source.parse_json_flow(source.file_envelope(spark, inbox), FEATURES)
        runs.drain(runs.table_writer(records, path, checkpoint, "restarted"))

    rows.where("kafka_offset % 2 = 0").write.mode("append").parquet(inbox)
    attempt()
    attempt()
    rows.where("kafka_offset % 2 = 1").write.mode("append").parquet(inbox)
    attempt()
    return spark.read.parquet(path).groupBy("kafka_partition").agg(
        F.count("*").alias("rows"), F.count_distinct("kafka_offset").alias("distinct_rows"), F.max("kafka_offset").alias("max_offset")
    )


@query("bounded_drain", sql="SELECT replay_run_tag, count(*) AS rows FROM timed WHERE NOT is_control GROUP BY 1")
def bounded_drain(spark, sf):
    data, _ = source.split_control_data(source.parse_json_flow(_stream(spark, sf), FEATURES))
    return _run(data, spark, "drained", timeout_sec=300).groupBy("replay_run_tag").agg(F.count("*").alias("rows"))


@query("end_of_input_marker", sql="""
SELECT replay_run_tag, count(*) AS sentinels, max(kafka_offset) AS last_offset FROM timed WHERE is_control AND control_type = 'input_sentinel' GROUP BY 1""")
def end_of_input_marker(spark, sf):
    _, control = source.split_control_data(source.parse_json_flow(_stream(spark, sf), FEATURES))
    return source.end_of_input(_run(control, spark, "control"))


@query("input_sentinel", sql="""
SELECT run_tag||'__input_sentinel' AS flow_id, run_tag AS replay_run_tag, 'control' AS benchmark_phase, t AS event_time, t AS source_ingest_ts, ms AS source_ingest_epoch_ms, 1 AS is_control_record, 'input_sentinel' AS control_type
FROM (SELECT 'run'||(event_id % 5) AS run_tag, strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%f')||'Z' AS t, epoch_us(max(ts)) // 1000 AS ms FROM events GROUP BY 1)""")
def input_sentinel(spark, sf):
    from flowlib.operators.arrivals import input_sentinel as sentinel

    ends = views.preds(spark, sf).groupBy("run_tag").agg(F.max("event_time_ts").alias("at"))
    return sentinel(ends).drop("timestamp", "label", "label_binary")


@query("stream_progress_lag", sql="SELECT count(*) AS input_rows, true AS every_batch, true AS timed_batches FROM timed")
def stream_progress_lag(spark, sf):
    """Progress of a running query, logged while it runs: every micro-batch with all its rows."""
    path, checkpoint, progress = (new_path(spark, n) for n in ("watched", "watched-checkpoint", "watched-progress"))
    records = source.parse_json_flow(_capped_stream(spark, sf), FEATURES)
    with runs.logged_progress(spark, progress):
        runs.drain(runs.table_writer(records, path, checkpoint, "watched"))
    seen = spark.read.schema(runs.PROGRESS_SCHEMA).parquet(progress).where("query_name = 'watched'")
    return seen.agg(
        F.sum("input_rows").alias("input_rows"), (F.count_distinct("batch_id") == F.max("batch_id") + 1).alias("every_batch"), (F.min("batch_ms") >= 0).alias("timed_batches")
    )


@query("stream_label_join", sql="SELECT p.event_id, p.kafka_partition, p.kafka_offset, f.label_binary, f.label FROM preds p JOIN flows f USING (kafka_partition, kafka_offset)")
def stream_label_join(spark, sf):
    """The matched part; an unmatched row may stay in state when a bounded run ends."""
    path = new_path(spark, "sent")
    views.preds(spark, sf, offsets=True).select("event_id", "emit_time", "event_time_ts", "kafka_partition", "kafka_offset", "label_binary", "label").write.parquet(path)
    sent = spark.read.parquet(path)
    left = spark.readStream.schema(sent.schema).parquet(path)
    right = left.select("kafka_partition", "kafka_offset", F.col("event_time_ts").alias("event_time"), F.expr("cast(label = 'error' as int)").alias("label_binary"), "label")
    joined = twins.stream_label_join(left.drop("label_binary", "label"), right, how="inner")
    return _run(joined, spark, "late-labels").select("event_id", "kafka_partition", "kafka_offset", "label_binary", "label")


@query("stream_label_join_outer", sql="""
SELECT p.event_id, p.kafka_partition, p.kafka_offset, f.label_binary, f.label FROM preds p LEFT JOIN (SELECT * FROM flows WHERE event_id % 19 <> 0) f USING (kafka_partition, kafka_offset)
WHERE emit_time < TIMESTAMP '2024-01-28'""")
def stream_label_join_outer(spark, sf):
    """The default form: predictions without a label too, once the watermark has passed them; the last days may stay in state."""
    path = new_path(spark, "sent")
    views.preds(spark, sf, offsets=True).select("event_id", "emit_time", "event_time_ts", "kafka_partition", "kafka_offset", "label").write.parquet(path)
    left = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    right = left.where("event_id % 19 <> 0").select("kafka_partition", "kafka_offset", F.col("event_time_ts").alias("event_time"), F.expr("cast(label = 'error' as int)").alias("label_binary"), "label")
    joined = twins.stream_label_join(left.drop("label"), right)
    rows = _run(joined, spark, "outer-labels").where("emit_time < timestamp '2024-01-28'")
    return rows.select("event_id", "kafka_partition", "kafka_offset", "label_binary", "label")


_WINDOW_QUANTILES = ", ".join(f"quantile_disc(end_to_end_ms, {q}::DOUBLE) AS e2e_p{int(q * 100)}_ms" for q in (0.5, 0.95, 0.99))


def _emitted(spark, sf):
    """Predictions as a stream."""
    path = new_path(spark, "window-input")
    views.preds(spark, sf).select("run_tag", "benchmark_phase", "emit_time", "end_to_end_ms").write.parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


@query("latency_by_window", sql=f"""
SELECT run_tag, coalesce(benchmark_phase, 'measure') AS benchmark_phase, date_trunc('hour', emit_time) AS window_start, count(*) AS rows, max(end_to_end_ms) AS e2e_max_ms, {_WINDOW_QUANTILES}
FROM preds GROUP BY 1, 2, 3""")
def latency_by_window(spark, sf):
    """Complete mode, so that the last window is there; percentiles are values of the window by rank."""
    out, rows = new_path(spark, "window-output"), _emitted(spark, sf)
    windows = twins.latency_by_window(rows, "1 hour")

    def replace(batch, _):
        batch.write.mode("overwrite").parquet(out)

    writer = windows.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", new_path(spark, "window-checkpoint")).queryName("windows")
    runs.drain(writer)
    return spark.read.parquet(out)


@query("latency_by_window_append", sql=f"""
SELECT run_tag, coalesce(benchmark_phase, 'measure') AS benchmark_phase, date_trunc('hour', emit_time) AS window_start, count(*) AS rows, max(end_to_end_ms) AS e2e_max_ms, {_WINDOW_QUANTILES}
FROM preds WHERE emit_time < TIMESTAMP '2024-01-28' GROUP BY 1, 2, 3""")
def latency_by_window_append(spark, sf):
    """The bounded form, with a watermark; windows of the last days may still be open when the run ends."""
    windows = twins.latency_by_window(_emitted(spark, sf), "1 hour", "1 hour")
    return _run(windows, spark, "closed-windows").where("window_start < timestamp '2024-01-28'")


@query("stream_label_join_closed", sql="""
SELECT p.event_id, p.kafka_partition, p.kafka_offset, f.label_binary, f.label FROM preds p LEFT JOIN (SELECT * FROM flows WHERE event_id % 19 <> 0) f USING (kafka_partition, kafka_offset)""")
def stream_label_join_closed(spark, sf):
    """Every prediction, with its label or without one: both streams end with a record that closes them."""
    sent, labelled = new_path(spark, "sent"), new_path(spark, "labelled")
    rows = views.preds(spark, sf, offsets=True)
    closing.write_stream_input(rows.select("event_id", "emit_time", "kafka_partition", "kafka_offset"), sent, "emit_time", "1 day")
    inputs = rows.where("event_id % 19 <> 0").select(
        "kafka_partition", "kafka_offset", F.col("event_time_ts").alias("event_time"), F.expr("cast(label = 'error' as int)").alias("label_binary"), "label"
    )
    closing.write_stream_input(inputs, labelled, "event_time", "1 day")
    left, right = (spark.readStream.schema(spark.read.parquet(p).schema).parquet(p) for p in (sent, labelled))
    joined = twins.stream_label_join(left, right, closing=True)
    return _run(joined, spark, "closed-labels").select("event_id", "kafka_partition", "kafka_offset", "label_binary", "label")


@query("latency_by_window_closed", sql=f"""
SELECT run_tag, coalesce(benchmark_phase, 'measure') AS benchmark_phase, date_trunc('hour', emit_time) AS window_start, count(*) AS rows, max(end_to_end_ms) AS e2e_max_ms, {_WINDOW_QUANTILES}
FROM preds GROUP BY 1, 2, 3""")
def latency_by_window_closed(spark, sf):
    """The bounded form with all its windows: the stream ends with a record that closes the last ones."""
    path = new_path(spark, "closing-input")
    rows = views.preds(spark, sf).select("run_tag", "benchmark_phase", "emit_time", "end_to_end_ms")
    closing.write_stream_input(rows, path, "emit_time", "1 day")
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    return _run(twins.latency_by_window(stream, "1 hour", "1 hour", closing=True), spark, "all-windows")


@query("capped_stream", sql="""
SELECT kafka_partition, count(*) AS rows, count(*) AS distinct_rows, max(kafka_offset) AS max_offset, true AS capped, true AS several_batches FROM records GROUP BY 1""")
def capped_stream(spark, sf):
    """A source that takes about a seventh of the records a batch at most, read half, and restarted from its checkpoint when the rest has come."""
    log, out, checkpoint = (new_path(spark, n) for n in ("record-log", "capped", "capped-checkpoint"))
    rows = _batch(spark, sf)
    middle = rows.agg(F.floor(F.avg("kafka_offset"))).first()[0]
    most = max(4, rows.count() // 7)

    def attempt():
        records = source.parse_json_flow(record_log.log_envelope(spark, log, f"{checkpoint}-position", most), FEATURES)
        runs.until_idle(runs.batch_writer(records, out, checkpoint, "capped"))

    record_log.append_records(rows.where(F.col("kafka_offset") < middle), log)
    attempt()
    record_log.append_records(rows.where(F.col("kafka_offset") >= middle), log)
    attempt()
    batches = spark.read.parquet(out)
    most_in_batch = batches.groupBy("batch_id").agg(F.count("*").alias("n")).agg(F.max("n").alias("_most"), F.count("*").alias("_batches"))
    counts = batches.groupBy("kafka_partition").agg(F.count("*").alias("rows"), F.count_distinct("kafka_offset").alias("distinct_rows"), F.max("kafka_offset").alias("max_offset"))
    limits = most_in_batch.first()
    return counts.select("*", F.lit(limits[0] <= most).alias("capped"), F.lit(limits[1] >= 7).alias("several_batches"))


_SHARE = "(SELECT greatest(1, (count(*) // 9) // count(DISTINCT kafka_partition)) FROM records)"


@query("stream_lag_series", sql=f"""
SELECT b AS batch_id, q.kafka_partition, coalesce(rows, 0) AS rows,
  max(top) OVER (PARTITION BY q.kafka_partition ORDER BY b) AS processed_offset_max,
  high - 1 - coalesce(max(top) OVER (PARTITION BY q.kafka_partition ORDER BY b), -1) AS lag_records
FROM (SELECT kafka_partition, max(kafka_offset) + 1 AS high FROM records GROUP BY 1) q
CROSS JOIN (SELECT DISTINCT kafka_offset // {_SHARE} AS b FROM records) n
LEFT JOIN (SELECT kafka_partition, kafka_offset // {_SHARE} AS b, count(*) AS rows, max(kafka_offset) AS top FROM records GROUP BY 1, 2) r USING (kafka_partition, b)""")
def stream_lag_series(spark, sf):
    """Backlog of every partition after every batch, from metrics observed inside the batches of a source capped by records."""
    log, checkpoint, progress = (new_path(spark, n) for n in ("lag-log", "lag-checkpoint", "lag-progress"))
    rows = _batch(spark, sf)
    record_log.append_records(rows, log)
    parts = record_log.log_partitions(spark, log)
    envelope = record_log.log_envelope(spark, log, f"{checkpoint}-position", max(len(parts), rows.count() // 9))
    watched = observed.with_batch_metrics(envelope, parts)
    with runs.logged_progress(spark, progress):
        runs.until_idle(runs.table_writer(source.parse_json_flow(watched, FEATURES), new_path(spark, "lag-rows"), checkpoint, "lag-series"))
    return observed.lag_series(spark.read.schema(runs.LOGGED_SCHEMA).parquet(progress), record_log.high_watermarks(spark, log))


@query("stream_run_completion", sql="""
SELECT replay_run_tag AS run_tag, CASE WHEN k = 0 THEN 'complete' WHEN k = 1 THEN 'gap' ELSE 'no_marker' END AS status, CASE WHEN k = 1 THEN n - 1 ELSE n END AS rows, CAST(CASE WHEN k = 1 THEN 1 ELSE 0 END AS BIGINT) AS missing
FROM (SELECT replay_run_tag, count(*) AS n, (row_number() OVER (ORDER BY replay_run_tag) - 1) % 3 AS k FROM records WHERE replay_run_tag IS NOT NULL GROUP BY 1)""")
def stream_run_completion(spark, sf):
    """Every third run is whole, lacks a record or lacks its end marker; the state of each says so."""
    tagged = _records(spark, sf).where("replay_run_tag is not null")
    numbered = with_row_number(tagged.selectExpr("replay_run_tag as run_tag", "kafka_partition as p", "kafka_offset as o"), ["run_tag"], ["p", "o"], "n", "total")
    rows = stored(numbered.selectExpr("run_tag", "0 as kafka_partition", "cast(n as bigint) - 1 as kafka_offset", "total"), "run-offsets")
    ends = rows.groupBy("run_tag").agg(F.max("total").alias("end_offset")).withColumn("_k", (F.dense_rank().over(Window.orderBy("run_tag")) - 1) % 3)
    kept = rows.join(ends, "run_tag").where("not (_k = 1 and kafka_offset = 0)").selectExpr("run_tag", "kafka_partition", "kafka_offset", "cast(null as bigint) as end_offset", "cast(null as int) as parts")
    marks = ends.where("_k <> 2").selectExpr("run_tag", "0 as kafka_partition", "cast(null as bigint) as kafka_offset", "end_offset", "1 as parts")
    at = F.expr("timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, coalesce(kafka_offset, end_offset) / 1000000)")
    path = new_path(spark, "completion-input")
    closing.write_stream_input(kept.unionByName(marks).withColumn("at", at), path, "at", "1 day")
    stream = closing.until_end(spark.readStream.schema(spark.read.parquet(path).schema).parquet(path), "at", "1 hour")
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, completion.PROVIDER)
    try:
        return _run(completion.run_completion(stream, 60_000), spark, "run-completion")
    finally:
        spark.conf.set(name, before)
