"""Label join and artifact queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from flowlib.operators import labels
from flowlib.plans import views
from flowlib.plans.registry import query
from flowlib.scratch import new_path
from flowlib.sources import bucketed, tables
from flowlib.sources.tables import ARTIFACT_COLUMNS

# Predictions of the join: every 13th is sent twice, every 17th has no offset.
_SENT = """(SELECT event_id, run_tag, kafka_partition, CASE WHEN event_id % 17 <> 0 THEN kafka_offset END AS kafka_offset FROM preds
  UNION ALL SELECT event_id, run_tag, kafka_partition, CASE WHEN event_id % 17 <> 0 THEN kafka_offset END FROM preds WHERE event_id % 13 = 0) AS s"""
# Input records: every 19th is a control record.
_INPUT = "(SELECT kafka_partition, kafka_offset, label_binary, label FROM flows WHERE event_id % 19 <> 0) AS i"


def _sent(spark, sf):
    rows = views.preds(spark, sf, offsets=True).withColumn("kafka_offset", F.expr("case when event_id % 17 <> 0 then kafka_offset end"))
    return rows.unionByName(rows.where("event_id % 13 = 0"))


def _inputs(spark, sf):
    return views.flows(spark, sf, offsets=True).withColumn("is_control_record", F.expr("cast(event_id % 19 = 0 as int)"))


@query("join_labels_by_offset", sql=f"SELECT event_id, run_tag, s.kafka_partition, s.kafka_offset, i.label_binary, i.label FROM {_SENT} LEFT JOIN {_INPUT} USING (kafka_partition, kafka_offset)")
def join_labels_by_offset(spark, sf):
    joined = labels.join_labels_by_offset(_sent(spark, sf), _inputs(spark, sf))
    return joined.select("event_id", "run_tag", "kafka_partition", "kafka_offset", "label_binary", "label")


@query("label_coverage", sql=f"""SELECT run_tag, count(*) AS artifact_collect_rows, count(i.label_binary) AS artifact_collect_labeled_rows
FROM {_SENT} LEFT JOIN {_INPUT} USING (kafka_partition, kafka_offset) GROUP BY 1""")
def label_coverage(spark, sf):
    return labels.label_coverage(labels.join_labels_by_offset(_sent(spark, sf), _inputs(spark, sf)), ["run_tag"])


def _stored_by_offset(spark, rows, name):
    table = f"{name}_{uuid.uuid4().hex}"
    bucketed.store_by_offset(rows, table, new_path(spark, name), 8)
    return table


@query("join_labels_bucketed", sql=f"SELECT event_id, run_tag, s.kafka_partition, s.kafka_offset, i.label_binary, i.label FROM {_SENT} LEFT JOIN {_INPUT} USING (kafka_partition, kafka_offset)")
def join_labels_bucketed(spark, sf):
    """The same join over tables stored in buckets: no shuffle on either side."""
    preds, inputs = _stored_by_offset(spark, _sent(spark, sf), "sent"), _stored_by_offset(spark, _inputs(spark, sf), "inputs")
    return bucketed.join_labels_stored(spark, preds, inputs).select("event_id", "run_tag", "kafka_partition", "kafka_offset", "label_binary", "label")


@query("semi_join_bucketed", sql="""
SELECT event_id, kafka_partition, kafka_offset FROM flows WHERE event_id % 19 <> 0 AND (kafka_partition, kafka_offset) IN (SELECT (kafka_partition, kafka_offset) FROM preds WHERE run_tag = 'run2')""")
def semi_join_bucketed(spark, sf):
    preds = _stored_by_offset(spark, views.preds(spark, sf, offsets=True).where("run_tag = 'run2'"), "needed")
    inputs = _stored_by_offset(spark, _inputs(spark, sf), "inputs")
    return bucketed.needed_inputs_stored(spark, preds, inputs).select("event_id", "kafka_partition", "kafka_offset")


@query("semi_join_required_keys", sql="""
SELECT event_id, kafka_partition, kafka_offset FROM flows WHERE event_id % 19 <> 0 AND (kafka_partition, kafka_offset) IN (SELECT (kafka_partition, kafka_offset) FROM preds WHERE run_tag = 'run2')""")
def semi_join_required_keys(spark, sf):
    inputs = _inputs(spark, sf)
    sent = views.preds(spark, sf, offsets=True).where("run_tag = 'run2'")
    return labels.semi_join_required_keys(inputs, sent).select("event_id", "kafka_partition", "kafka_offset")


def _layout_sql():
    have = {"event_time_ts", "ingest_time", "emit_time", "flow_id", "model_name", "feature_set", "run_tag", "benchmark_phase", "prediction_label", "prediction_score",
            "threshold_used", "source_to_ingest_ms", "processing_ms", "end_to_end_ms", "kafka_partition", "label_binary", "label"}
    kinds = {"int": "INTEGER", "double": "DOUBLE", "bigint": "BIGINT"}
    return ", ".join(c if c in have else f"NULL::{kinds[k]} AS {c}" for c, k in ARTIFACT_COLUMNS.items())


@query("write_prediction_artifact", sql=f"SELECT {_layout_sql()} FROM preds")
def write_prediction_artifact(spark, sf):
    path = new_path(spark, "artifact")
    tables.write_prediction_artifact(views.preds(spark, sf), path)
    return tables.read_table(spark, path)


@query("collect_artifact", sql="""
SELECT 'run3' AS run_tag, benchmark_phase, count(*) AS rows, count(label_binary) AS labeled, sum(kafka_offset)::BIGINT AS offsets FROM (
  SELECT CASE WHEN p.benchmark_phase = 'post_fault' THEN 'post_fault' ELSE 'measure' END AS benchmark_phase, f.label_binary, p.kafka_offset FROM preds p
  LEFT JOIN (SELECT * FROM flows WHERE event_id % 19 <> 0) f USING (kafka_partition, kafka_offset) WHERE run_tag = 'run3') GROUP BY 2""")
def collect_artifact(spark, sf):
    inputs = _inputs(spark, sf).withColumn("replay_run_tag", F.expr("concat('run', event_id % 5)"))
    out = labels.collect_artifact(views.preds(spark, sf, offsets=True), inputs, "run3", ["measure", "post_fault"])
    return out.groupBy("run_tag", "benchmark_phase").agg(F.count("*").alias("rows"), F.count("label_binary").alias("labeled"), F.sum("kafka_offset").alias("offsets"))


# All runs: labels come from the run's own input records; odd runs expect one row more than there is.
_ALL_RUNS = """(SELECT p.event_id, p.run_tag, CASE WHEN p.benchmark_phase IN ('warmup', 'post_fault') THEN p.benchmark_phase ELSE 'measure' END AS phase, p.kafka_offset, f.label_binary
  FROM preds p LEFT JOIN (SELECT *, 'run'||(event_id % 5) AS run_tag FROM flows WHERE event_id % 19 <> 0) f USING (run_tag, kafka_partition, kafka_offset) WHERE coalesce(p.benchmark_phase, '') <> 'cold_start') AS c"""


def _collected(spark, sf):
    inputs = _inputs(spark, sf).withColumn("replay_run_tag", F.expr("concat('run', event_id % 5)"))
    preds = views.preds(spark, sf, offsets=True)
    phase = F.expr("case when benchmark_phase in ('warmup', 'post_fault') then benchmark_phase else 'measure' end")
    seen = preds.where("coalesce(benchmark_phase, '') <> 'cold_start'").groupBy("run_tag", phase.alias("phase"))
    expected = seen.agg((F.count("*") + F.max(F.expr("event_id % 5 % 2"))).alias("expected"))
    return labels.collect_artifacts(preds.where("coalesce(benchmark_phase, '') <> 'cold_start'"), inputs, expected)


@query("collect_artifacts", sql=f"SELECT run_tag, phase AS benchmark_phase, count(*) AS rows, count(label_binary) AS labeled, sum(kafka_offset)::BIGINT AS offsets FROM {_ALL_RUNS} GROUP BY 1, 2")
def collect_artifacts(spark, sf):
    """The stored form of all runs from one pass, by run and phase."""
    out, _ = _collected(spark, sf)
    return out.groupBy("run_tag", "benchmark_phase").agg(F.count("*").alias("rows"), F.count("label_binary").alias("labeled"), F.sum("kafka_offset").alias("offsets"))


@query("collect_artifacts_barrier", sql=f"""
SELECT run_tag, phase, count(*) + max(event_id % 5 % 2) AS expected, count(*) AS actual, max(event_id % 5 % 2) AS missing, CASE WHEN max(event_id % 5 % 2) = 0 THEN 'ok' ELSE 'incomplete' END AS status,
  count(label_binary) AS artifact_collect_labeled_rows FROM {_ALL_RUNS} GROUP BY 1, 2""")
def collect_artifacts_barrier(spark, sf):
    return _collected(spark, sf)[1]


@query("save_scored_split", sql="SELECT model, split, label, label_binary, score FROM scored")
def save_scored_split(spark, sf):
    path = new_path(spark, "scored")
    rows = views.scored(spark, sf)
    for model in ("m0", "m1"):
        tables.save_scored_split(rows.where(F.col("model") == model), path, model, "calibration")
    tables.save_scored_split(rows.where("model = 'm1'"), path, "m1", "calibration")
    return spark.read.parquet(path)


@query("input_manifest", sql="""
SELECT role, sum(n)::BIGINT AS rows, 1::BIGINT AS files, 'ok' AS status FROM (SELECT 'events' AS role, count(*) AS n FROM events UNION ALL SELECT 'lineitem', count(*) FROM lineitem) GROUP BY 1""")
def input_manifest(spark, sf):
    manifest = tables.input_manifest(spark, {"events": f"{sf}/events.parquet", "lineitem": f"{sf}/lineitem.parquet"})
    return manifest.groupBy("role", "status").agg(F.sum("rows").alias("rows"), F.count("*").alias("files"))


@query("latest_file", sql="""
SELECT 'events' AS role, 'events.parquet' AS name, count(*) AS rows FROM events UNION ALL SELECT 'orders', 'orders.parquet', count(*) FROM orders""")
def latest_file(spark, sf):
    """Name and rows of the newest file of each role; its time depends on the copy."""
    manifest = tables.input_manifest(spark, {"events": f"{sf}/events.parquet", "orders": f"{sf}/orders.parquet"})
    newest = tables.latest_file(manifest).join(manifest.select("role", "path", "rows"), ["role", "path"])
    return newest.select("role", F.element_at(F.split("path", "/"), -1).alias("name"), "rows")
