"""Sinks, triggers, bounded and restarted runs, and progress rows of streaming queries."""

from __future__ import annotations

import contextlib
import json
import threading
from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery, StreamingQueryListener

from flowlib.sources.tables import PREDICTION_COLUMNS, artifact_frame

PROGRESS_SCHEMA = (
    "query_name string, batch_id bigint, ts_utc string, input_rows bigint, processed_rows_per_sec double, "
    "batch_ms bigint, add_batch_ms bigint, source string, start_offset string, end_offset string, latest_offset string"
)
#: Logged reports also hold the metrics that a query observed inside its batches, as JSON.
LOGGED_SCHEMA = f"{PROGRESS_SCHEMA}, observed string"


def prediction_records(scored: DataFrame) -> DataFrame:
    """Key (flow id) and JSON value of the fixed response columns; null fields are left out of the JSON."""
    response = artifact_frame(scored, PREDICTION_COLUMNS)
    return response.select(F.col("flow_id").alias("key"), F.to_json(F.struct(*PREDICTION_COLUMNS)).alias("value"))


def distinct_offsets(scored: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Option against repeated sink writes: one row per (partition, offset) within the watermark."""
    return scored.withWatermark("ingest_time", delay).dropDuplicatesWithinWatermark(["kafka_partition", "kafka_offset"])


def _append(df: DataFrame, checkpoint: str, name: str) -> DataStreamWriter:
    return df.writeStream.outputMode("append").option("checkpointLocation", checkpoint).queryName(name)


def prediction_kafka_writer(scored: DataFrame, servers: str, topic: str, checkpoint: str, name: str) -> DataStreamWriter:
    """Predictions to a topic. Delivery is at least once. Needs the Kafka connector on the class path."""
    writer = _append(prediction_records(scored), checkpoint, name)
    return writer.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)


def prediction_file_writer(scored: DataFrame, path: str, checkpoint: str, name: str) -> DataStreamWriter:
    """The same key and value rows to parquet files, exactly once."""
    return _append(prediction_records(scored), checkpoint, name).format("parquet").option("path", path)


def table_writer(df: DataFrame, path: str, checkpoint: str, name: str) -> DataStreamWriter:
    return _append(df, checkpoint, name).format("parquet").option("path", path)


def batch_writer(df: DataFrame, path: str, checkpoint: str, name: str) -> DataStreamWriter:
    """Every micro-batch under its own number, ``batch_id``: a batch that is tried again replaces what it wrote before."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={number}")

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).queryName(name)


def processing_trigger(writer: DataStreamWriter, interval: str) -> DataStreamWriter:
    """Fixed micro-batch interval; a blank one is an error."""
    interval = str(interval).strip()
    if not interval:
        raise ValueError("trigger interval must not be blank")
    return writer.trigger(processingTime=interval)


def drain(writer: DataStreamWriter, timeout_sec: float = 600.0) -> StreamingQuery:
    """Process all input available now and stop; an error if the query fails or runs out of time."""
    query = writer.trigger(availableNow=True).start()
    if not query.awaitTermination(int(timeout_sec)):
        query.stop()
        raise TimeoutError(f"stream {query.name} did not finish within {timeout_sec} s")
    failure = query.exception()
    if failure is not None:
        raise RuntimeError(f"stream {query.name} failed: {failure}")
    return query


def until_idle(writer: DataStreamWriter) -> StreamingQuery:
    """Process batch after batch until the source has nothing new, and stop: for sources that cap their batches themselves."""
    query = writer.start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return query


def _file_system(spark: SparkSession, path: str):
    """Hadoop path and its file system, so that any shared storage works."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def checkpoint_present(spark: SparkSession, checkpoint: str) -> bool:
    """Whether a checkpoint folder exists and holds anything, that is, whether a restart would go on from it."""
    target, fs = _file_system(spark, checkpoint)
    return bool(fs.exists(target)) and len(fs.listStatus(target)) > 0


def reset_run(spark: SparkSession, *paths: str) -> None:
    """Delete the named checkpoint and output folders, so that the next start begins anew. Restarts must not call this."""
    for path in paths:
        target, fs = _file_system(spark, path)
        if fs.exists(target):
            fs.delete(target, True)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Written prediction records as typed columns."""
    schema = ", ".join(f"{n} {k}" for n, k in PREDICTION_COLUMNS.items())
    return spark.read.parquet(path).select("key", F.from_json("value", schema).alias("_r")).select("key", "_r.*")


def _progress_cells(report) -> list[tuple]:
    """Rows of one progress report, one per source."""
    data = report if isinstance(report, dict) else json.loads(report.json)
    took = data.get("durationMs", {})
    return [
        (
            data.get("name"), int(data.get("batchId", 0)), data.get("timestamp"), int(source.get("numInputRows", 0)),
            float(source.get("processedRowsPerSecond") or 0.0), int(took.get("triggerExecution", 0)), int(took.get("addBatch", 0)),
            source.get("description"), *[json.dumps(source.get(k)) for k in ("startOffset", "endOffset", "latestOffset")],
            json.dumps({name: row.asDict() if isinstance(row, Row) else row for name, row in data.get("observedMetrics", {}).items()}),
        )
        for source in data.get("sources", [])
    ]


def progress_rows(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """One row per source and micro-batch of a short run.

    Spark keeps a limited number of reports; a run that has reached it may have lost some, which is an error here.
    Use :func:`logged_progress` for such runs.
    """
    reports, kept = query.recentProgress, int(spark.conf.get("spark.sql.streaming.numRecentProgressUpdates", "100"))
    if len(reports) >= kept:
        raise RuntimeError(f"only the last {kept} progress reports are kept: log them while the query runs")
    return spark.createDataFrame([cells for report in reports for cells in _progress_cells(report)], LOGGED_SCHEMA)


class ProgressLog(StreamingQueryListener):
    """Progress of all queries of a session while they run; ``flush`` appends what has come in to a table.

    Register with ``spark.streams.addListener``. A report is one short row per source. With a session and a path the
    log flushes by itself at ``limit`` rows, so what it holds is bounded however long a query runs.
    """

    def __init__(self, session: SparkSession | None = None, path: str | None = None, limit: int = 1000) -> None:
        self._rows: deque[tuple] = deque()
        self._session, self._path, self._limit = session, path, limit
        self.ended = threading.Event()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self._rows.extend(_progress_cells(event.progress))
        if self._path and len(self._rows) >= self._limit:
            self.flush(self._session, self._path)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended.set()

    def flush(self, spark: SparkSession, path: str) -> int:
        """Append the buffered rows to ``path``; the number of rows written."""
        taken = [self._rows.popleft() for _ in range(len(self._rows))]
        if taken:
            spark.createDataFrame(taken, LOGGED_SCHEMA).write.mode("append").parquet(path)
        return len(taken)


@contextlib.contextmanager
def logged_progress(spark: SparkSession, path: str, limit: int = 1000) -> Iterator[ProgressLog]:
    """Log to ``path`` every progress report of the one query that starts and ends inside the block."""
    log = ProgressLog(spark, path, limit)
    spark.streams.addListener(log)
    try:
        yield log
        # Reports arrive in order and late: the end of the query is the last of them.
        if not log.ended.wait(60):
            raise TimeoutError("the end of the query was not reported")
    finally:
        spark.streams.removeListener(log)
        log.flush(spark, path)


def lag_samples_from_progress(progress: DataFrame, run_tag: str, topic: str, phase: str = "measure") -> DataFrame:
    """Backlog samples: rows available less rows taken, from offsets ``{topic: {partition: offset}}`` of a Kafka source."""
    kind = "map<string,map<string,bigint>>"
    end, latest = F.from_json("end_offset", kind), F.from_json("latest_offset", kind)
    parts = F.coalesce(latest[topic], end[topic])
    done = end[topic]
    gaps = F.transform(F.map_entries(parts), lambda e: F.greatest(e["value"] - F.coalesce(F.element_at(done, e["key"]), F.lit(0)), F.lit(0)))
    lag = F.aggregate(gaps, F.lit(0).cast("bigint"), lambda a, x: a + x)
    at = F.to_timestamp("ts_utc")
    return progress.select(
        "ts_utc", F.unix_millis(at).alias("ts_epoch_ms"), F.lit(run_tag).alias("run_tag"), F.lit(topic).alias("topic"),
        F.lit(phase).alias("phase"), F.lit("").alias("event"), lag.alias("lag_records"), lag.alias("raw_lag_records"),
        F.lit(0).alias("control_tail_records"), F.array_max(F.map_values(parts)).alias("high_watermark_max"),
        (F.array_max(F.map_values(done)) - 1).alias("processed_offset_max"), F.size(parts).alias("partition_count"),
        F.when(parts.isNotNull(), F.lit("ok")).otherwise(F.lit("topic_partitions_missing")).alias("status"),
    )
