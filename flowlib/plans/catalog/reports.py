"""Rules, run summaries and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlib.operators import rules, summary, variant_rows
from flowlib.operators.lag import backlog_summary
from flowlib.operators.threshold import operating_points
from flowlib.plans import views
from flowlib.plans.catalog.arrivals import GAP_SQL
from flowlib.plans.catalog.latency import AREA_SQL, CLEAR_SQL, FAULT_SQL, LAG_SQL, LATENCY_FLOATS, LATENCY_SQL, RUN_LAG_SQL, per_run
from flowlib.plans.catalog.quality import POINTS_SQL, QUALITY_SQL
from flowlib.plans.registry import query
from flowlib.scratch import new_path, stored

_QUALITY = QUALITY_SQL.format(phase="measure")

# The wide run row as SQL: settings, latency, quality, backlog, service level, overload verdict.
RUNS_SQL = f"""
SELECT *, CASE WHEN failure_reason = '' THEN 'pass' ELSE 'fail' END AS slo_status,
  CASE WHEN drain_throughput_ratio IS NULL OR p95_e2e_ms IS NULL THEN 'artifact_missing' WHEN drain_throughput_ratio < 0.9::DOUBLE OR p95_e2e_ms > 2000 THEN 'overloaded'
    WHEN kafka_lag_peak_ratio >= 1 THEN 'backpressure' ELSE 'stable' END AS degradation_status,
  CASE WHEN latency_status = 'ok' THEN 'ok' ELSE 'artifact_missing' END AS status
FROM (SELECT *, drain_rps AS actual_rps, drain_rps / offered_rps AS throughput_ratio, drain_rps / offered_rps AS drain_throughput_ratio, offered_rps / drain_rps AS target_to_drain_ratio,
    kafka_lag_peak_records / offered_rps AS kafka_lag_peak_ratio, artifact_e2e_p50_ms AS p50_e2e_ms, artifact_e2e_p95_ms AS p95_e2e_ms, artifact_e2e_p99_ms AS p99_e2e_ms,
    CASE WHEN trigger_interval = '1 second' THEN 1000::DOUBLE ELSE 500::DOUBLE END AS trigger_interval_ms,
    concat_ws(';', CASE WHEN latency_status <> 'ok' OR artifact_rows_total = 0 THEN 'artifact_latency_missing' END,
      CASE WHEN rows_total < rows_expected * 0.95::DOUBLE THEN 'rows_below_expected' END,
      CASE WHEN drain_rps IS NULL OR drain_rps / offered_rps < 0.9::DOUBLE THEN 'throughput_below_target' END,
      CASE WHEN artifact_e2e_p50_ms IS NULL OR artifact_e2e_p95_ms IS NULL THEN 'latency_missing' END,
      CASE WHEN artifact_e2e_p50_ms > 500 THEN 'p50_e2e_exceeded' END, CASE WHEN artifact_e2e_p95_ms > 1500 THEN 'p95_e2e_exceeded' END) AS failure_reason
  FROM base_runs JOIN ({LATENCY_SQL}) AS a USING (run_tag) JOIN (SELECT run_tag, quality_status, precision, recall, f1, fpr, fnr FROM ({_QUALITY}) AS q0) AS q USING (run_tag)
    JOIN ({LAG_SQL}) AS l USING (run_tag) JOIN ({CLEAR_SQL}) AS c USING (run_tag) JOIN ({AREA_SQL}) AS z USING (run_tag))"""

_SHOWN = [
    "run_tag", "mode", "latency_status", "artifact_rows_total", "rows_total", "measure_wall_clock_sec", "drain_rps", "throughput_ratio", "p50_e2e_ms", "p95_e2e_ms",
    "p99_e2e_ms", "quality_status", "precision", "recall", "f1", "fpr", "fnr", "kafka_lag_samples", "kafka_lag_peak_records", "kafka_lag_peak_phase",
    "kafka_lag_at_replay_end_records", "kafka_lag_clear_sec", "kafka_lag_area_records_sec", "kafka_lag_end_after_drain_records", "trigger_interval_ms", "failure_reason",
    "slo_status", "drain_throughput_ratio", "target_to_drain_ratio", "kafka_lag_peak_ratio", "degradation_status", "status",
]
_RUN_FLOATS = (
    "measure_wall_clock_sec drain_rps throughput_ratio p50_e2e_ms p95_e2e_ms p99_e2e_ms precision recall f1 fpr fnr kafka_lag_area_records_sec "
    "drain_throughput_ratio target_to_drain_ratio kafka_lag_peak_ratio"
)


def runs(spark, sf):
    """Run summary as reports read it: a stored table."""
    rows = summary.run_summary(views.preds(spark, sf), views.lag_samples(spark, sf), views.base_runs(spark, sf), target_rps="offered_rps")
    return stored(rows, "run-summary")


_SHOWN_SQL = ", ".join("kafka_lag_peak_records::DOUBLE AS kafka_lag_peak_records" if c == "kafka_lag_peak_records" else c for c in _SHOWN)


# What the topic, the row counts and the source add to a run row.
_END_LAG = ["kafka_lag_status", "kafka_lag_records_end", "kafka_lag_records_raw_end", "kafka_lag_partitions", "drain_status", "drain_reason"]
_BARRIER = [f"{p}_artifact_{c}" for p in ("warmup", "measure") for c in ("rows_expected", "rows_actual", "barrier_status")]
_SOURCE = ["replay_status", "replay_failure_reason", "replay_target_rps", "replay_actual_rps", "replay_actual_elapsed_sec", "replay_emit_gap_p95_ms", "replay_emit_gap_p99_ms",
           "replay_emit_gap_max_ms", "replay_tick_lag_p95_ms", "replay_tick_lag_max_ms"]
_BARRIER_SQL = """
SELECT run_tag, nullif(w, 0) AS warmup_artifact_rows_expected, nullif(w, 0) AS warmup_artifact_rows_actual, CASE WHEN w > 0 THEN 'ok' END AS warmup_artifact_barrier_status, m + odd AS measure_artifact_rows_expected,
  m AS measure_artifact_rows_actual, CASE WHEN odd = 0 THEN 'ok' ELSE 'incomplete' END AS measure_artifact_barrier_status
FROM (SELECT run_tag, count(*) FILTER (event_id % 20 = 0) AS w, count(*) FILTER (event_id % 20 NOT IN (0, 3, 4)) AS m, max(event_id % 5 % 2) AS odd FROM preds GROUP BY 1)"""
_PACE_SQL = GAP_SQL.format(emits="""SELECT 'run'||event_id % 5 AS run_tag, event_id, make_timestamp(t) AS e, make_timestamp(t - event_id % 100 * (event_id % 5 + 1) * 4000) AS d
  FROM (SELECT event_id, 1704067200000000 + event_id * (100 + 50 * (event_id % 5)) * 1000 AS t FROM events)""")
_FULL_SQL = f"""
SELECT {', '.join(c for c in _SHOWN_SQL.split(', ') if c not in ('failure_reason', 'slo_status'))}, {', '.join([*_END_LAG, *_BARRIER, *_SOURCE])}, reason AS failure_reason, CASE WHEN reason = '' THEN 'pass' ELSE 'fail' END AS slo_status
FROM (SELECT *, CASE WHEN drain_reason = '' THEN 'ok' ELSE 'failed' END AS drain_status, concat_ws(';', nullif(failure_reason, ''), CASE WHEN replay_status = 'unstable' THEN 'load_generator_unstable' END) AS reason
  FROM (SELECT *, CASE WHEN kafka_lag_records_end <> 0 THEN 'kafka_lag_records_end='||kafka_lag_records_end
      WHEN coalesce(kafka_lag_end_after_drain_records, -1) <> 0 THEN 'kafka_lag_end_after_drain_records='||coalesce(kafka_lag_end_after_drain_records::VARCHAR, 'missing') ELSE '' END AS drain_reason,
      CASE WHEN replay_failure_reason = '' THEN 'ok' ELSE 'unstable' END AS replay_status
    FROM ({RUNS_SQL}) AS r JOIN ({RUN_LAG_SQL}) AS k USING (run_tag) JOIN ({_BARRIER_SQL}) AS b USING (run_tag) JOIN (
      SELECT g.run_tag, offered_rps AS replay_target_rps, actual_rps AS replay_actual_rps, actual_elapsed_sec AS replay_actual_elapsed_sec, emit_gap_p95_ms AS replay_emit_gap_p95_ms,
        emit_gap_p99_ms AS replay_emit_gap_p99_ms, emit_gap_max_ms AS replay_emit_gap_max_ms, tick_lag_p95_ms AS replay_tick_lag_p95_ms, tick_lag_max_ms AS replay_tick_lag_max_ms,
        concat_ws(';', CASE WHEN actual_rps < offered_rps * 0.95::DOUBLE THEN 'replay_actual_rps_below_target' END, CASE WHEN emit_gap_max_ms > 1000 THEN 'replay_emit_gap_spike' END,
          CASE WHEN tick_lag_max_ms > 1000 THEN 'replay_tick_lag_spike' END) AS replay_failure_reason FROM ({_PACE_SQL}) AS g JOIN base_runs USING (run_tag)) AS s USING (run_tag)))"""


@query("run_summary_row", sql=_FULL_SQL, floats=_RUN_FLOATS + " replay_target_rps replay_actual_rps replay_actual_elapsed_sec")
def run_summary_row(spark, sf):
    """The whole run row: end lag over each run's own topic, a row barrier that odd runs miss, a source that some runs drive too slowly."""
    rows, marks = per_run(spark, sf)
    odd = F.max(F.expr("event_id % 5 % 2"))
    expected = rows.groupBy("run_tag").agg(F.count_if(F.expr("event_id % 20 = 0")).alias("w"), (F.count_if(F.expr("event_id % 20 not in (0, 3, 4)")) + odd).alias("m"))
    expected = expected.selectExpr("run_tag", "stack(2, 'warmup', w, 'measure', m) as (phase, expected)")
    emits = views.table(spark, sf, "events").selectExpr("event_id", "1704067200000000 + event_id * (100 + 50 * (event_id % 5)) * 1000 as t").selectExpr(
        "concat('run', event_id % 5) as run_tag", "event_id as row_index", "timestamp_micros(t) as emit_ts", "timestamp_micros(t - event_id % 100 * (event_id % 5 + 1) * 4000) as due_ts"
    )
    wide = summary.run_summary(
        rows, views.lag_samples(spark, sf), views.base_runs(spark, sf), target_rps="offered_rps", watermarks=marks, expected=expected, emits=emits
    )
    return wide.select(*_SHOWN, *_END_LAG, *_BARRIER, *_SOURCE)


_MF_SHOWN = [
    "run_tag", "candidate_label", "feature_set", "latency_status", "artifact_rows_total", "drain_rps", "rows", "source_p95_ms", "source_p99_ms", "proc_p95_ms", "proc_p99_ms",
    "e2e_p95_ms", "e2e_p99_ms", "quality_status", "precision", "recall", "f1", "fpr", "fnr", "scored_rows_total", "avg_prediction_score", "attack_ratio", "kafka_lag_samples", "status",
]


@query("model_feature_run_summary", sql=f"""
SELECT run_tag, candidate_label, feature_set, latency_status, artifact_rows_total, drain_rps, rows_total AS rows, artifact_source_p95_ms AS source_p95_ms, artifact_source_p99_ms AS source_p99_ms,
  artifact_processing_p95_ms AS proc_p95_ms, artifact_processing_p99_ms AS proc_p99_ms, artifact_e2e_p95_ms AS e2e_p95_ms, artifact_e2e_p99_ms AS e2e_p99_ms, quality_status, precision, recall, f1,
  fpr, fnr, scored_rows_total, avg_prediction_score_weighted AS avg_prediction_score, attack_ratio_weighted AS attack_ratio, kafka_lag_samples, 'ok' AS status
FROM base_runs JOIN ({LATENCY_SQL}) AS a USING (run_tag) JOIN ({_QUALITY}) AS q USING (run_tag) JOIN ({LAG_SQL}) AS l USING (run_tag)""",
       floats="drain_rps source_p95_ms source_p99_ms proc_p95_ms proc_p99_ms e2e_p95_ms e2e_p99_ms precision recall f1 fpr fnr avg_prediction_score attack_ratio")
def model_feature_run_summary(spark, sf):
    return summary.model_feature_run_summary(views.preds(spark, sf), views.lag_samples(spark, sf), views.base_runs(spark, sf)).select(*_MF_SHOWN)


_FAULT_RUN_SHOWN = [
    "run_tag", "scenario", "initial_rows", "post_fault_rows", "drain_rps_after_fault", "proc_p95_ms_after_fault", "e2e_p95_ms_after_fault", "startup_seconds", "recovery_seconds",
    "checkpoint_reused", "kafka_lag_samples", "status", "notes",
]


@query("fault_run_summary", sql="""
SELECT *, CASE status WHEN 'artifact_incomplete' THEN 'cold_start_rows='||initial_rows||' expected='||ie WHEN 'pre_fault_incomplete' THEN 'pre_fault_rows='||initial_rows||' expected='||ie
  WHEN 'post_fault_incomplete' THEN 'post_fault_rows='||post_fault_rows||' expected='||pe WHEN 'checkpoint_missing' THEN 'checkpoint was not present before restart' ELSE '' END AS notes
FROM (SELECT *, CASE WHEN scenario LIKE 'cold%' THEN CASE WHEN initial_rows < ie * 0.95::DOUBLE THEN 'artifact_incomplete' ELSE 'ok' END WHEN initial_rows < ie * 0.95::DOUBLE THEN 'pre_fault_incomplete'
    WHEN post_fault_rows < pe * 0.95::DOUBLE THEN 'post_fault_incomplete' WHEN NOT checkpoint_reused THEN 'checkpoint_missing' ELSE 'ok' END AS status
  FROM (SELECT run_tag, scenario, n0 AS initial_rows, CASE WHEN i <> 4 THEN n1 END AS post_fault_rows, CASE WHEN i <> 4 THEN n1 / span END AS drain_rps_after_fault, CASE WHEN i <> 4 THEN p END AS proc_p95_ms_after_fault,
      CASE WHEN i <> 4 THEN e END AS e2e_p95_ms_after_fault, CASE WHEN i = 4 THEN greatest((f0 - 1704067200000) / 1000.0::DOUBLE, 0) END AS startup_seconds,
      CASE WHEN i <> 4 THEN greatest((f1 - 1704153600000) / 1000.0::DOUBLE, 0) END AS recovery_seconds, CASE WHEN i <> 4 THEN i <> 2 END AS checkpoint_reused, s AS kafka_lag_samples, ie, pe
    FROM (SELECT run_tag, repeat_index AS i, scenario, count(*) FILTER (ph IN ('cold_start', 'pre_fault')) AS n0, count(*) FILTER (ph = 'post_fault') AS n1,
        (epoch_us(max(emit_time) FILTER (ph = 'post_fault')) - epoch_us(min(emit_time) FILTER (ph = 'post_fault'))) / 1e6::DOUBLE AS span,
        quantile_cont(processing_ms, 0.95::DOUBLE) FILTER (ph = 'post_fault') AS p, quantile_cont(end_to_end_ms, 0.95::DOUBLE) FILTER (ph = 'post_fault') AS e,
        epoch_us(min(emit_time) FILTER (ph = 'cold_start')) // 1000 AS f0, epoch_us(min(emit_time) FILTER (ph = 'post_fault')) // 1000 AS f1,
        any_value(floor(initial_expected_rows * (20 + repeat_index) / 100))::BIGINT AS ie, any_value(floor(initial_expected_rows * (28 - repeat_index) / 100))::BIGINT AS pe
      FROM (SELECT run_tag, emit_time, processing_ms, end_to_end_ms, CASE event_id % 4 WHEN 0 THEN CASE WHEN run_tag = 'run4' THEN 'cold_start' ELSE 'pre_fault' END WHEN 1 THEN 'post_fault' ELSE 'measure' END AS ph FROM preds)
      JOIN base_runs USING (run_tag) GROUP BY 1, 2, 3) JOIN (SELECT run_tag, count(*) AS s FROM lag_samples GROUP BY 1) USING (run_tag)))""".replace("SELECT *, CASE status", "SELECT * EXCLUDE (ie, pe), CASE status", 1),
       floats="drain_rps_after_fault proc_p95_ms_after_fault e2e_p95_ms_after_fault")
def fault_run_summary(spark, sf):
    phase = F.expr("case event_id % 4 when 0 then if(run_tag = 'run4', 'cold_start', 'pre_fault') when 1 then 'post_fault' else 'measure' end")
    preds = views.preds(spark, sf).withColumn("benchmark_phase", phase)
    declared = views.base_runs(spark, sf).selectExpr(
        "run_tag", "scenario", "fault_kind", "floor(initial_expected_rows * (20 + repeat_index) / 100) as initial_expected_rows",
        "floor(initial_expected_rows * (28 - repeat_index) / 100) as post_fault_expected_rows", "1704067200000 as started_epoch_ms", "1704153600000 as restarted_epoch_ms",
        "repeat_index <> 2 as checkpoint_present_before_restart", "false as reset_outputs",
    )
    return summary.fault_run_summary(preds, views.lag_samples(spark, sf), declared).select(*_FAULT_RUN_SHOWN)


def _hourly(spark, sf):
    """A small run per user: its rows, rate and latencies, to exercise the rules on many rows."""
    rows = views.table(spark, sf, "events").groupBy("user_id").agg(
        F.count("*").alias("rows_total"), F.max("value").alias("top"), F.avg(F.expr("cast(value * 100 as bigint)")).alias("_a")
    )
    return rows.selectExpr(
        "user_id", "case when user_id % 9 > 0 then 'ok' else 'latency_missing' end as latency_status", "case when user_id % 9 > 0 then rows_total else 0 end as artifact_rows_total",
        "rows_total", "case when user_id % 7 > 0 then rows_total * 1D end as drain_rps", "rows_total * (80D + user_id % 40) / 100 as target_rps",
        "rows_total + user_id % 20 as rows_expected", "case when user_id % 11 > 0 then top * 2 end as artifact_e2e_p50_ms", "top * 6 as artifact_e2e_p95_ms", "top * 7 as artifact_e2e_p99_ms",
        "user_id % 5 * 30 as kafka_lag_peak_records", "case when user_id % 13 = 0 then 'unstable' else 'ok' end as replay_status", "concat(user_id % 10, ' ms') as trigger_interval",
    )


_HOURLY = """(SELECT user_id, CASE WHEN user_id % 9 > 0 THEN 'ok' ELSE 'latency_missing' END AS latency_status, CASE WHEN user_id % 9 > 0 THEN n ELSE 0 END AS artifact_rows_total, n AS rows_total,
  CASE WHEN user_id % 7 > 0 THEN n::DOUBLE END AS drain_rps, n * (80::DOUBLE + user_id % 40) / 100 AS target_rps, n + user_id % 20 AS rows_expected,
  CASE WHEN user_id % 11 > 0 THEN top * 2 END AS p50, top * 6 AS p95, top * 7 AS p99, user_id % 5 * 30 AS peak, user_id % 13 = 0 AS unstable
  FROM (SELECT user_id, count(*) AS n, max(value) AS top FROM events GROUP BY 1)) AS h"""


@query("evaluate_slo", sql=f"""
SELECT user_id, preset, throughput_ratio, trigger_interval_ms, failure_reason, CASE WHEN failure_reason = '' THEN 'pass' ELSE 'fail' END AS slo_status FROM (
SELECT user_id, preset, drain_rps / target_rps AS throughput_ratio, (user_id % 10)::DOUBLE AS trigger_interval_ms, concat_ws(';', CASE WHEN latency_status <> 'ok' OR artifact_rows_total = 0 THEN 'artifact_latency_missing' END,
  CASE WHEN rows_total < rows_expected * min_rows THEN 'rows_below_expected' END, CASE WHEN drain_rps IS NULL OR drain_rps / target_rps < min_ratio THEN 'throughput_below_target' END,
  CASE WHEN p50 IS NULL OR p95 IS NULL THEN 'latency_missing' END, CASE WHEN p50 IS NOT NULL AND p50 > max_p50 THEN 'p50_e2e_exceeded' END,
  CASE WHEN p50 IS NOT NULL AND p95 > max_p95 THEN 'p95_e2e_exceeded' END, CASE WHEN unstable THEN 'load_generator_unstable' END) AS failure_reason
  FROM {_HOURLY}, (VALUES ('strict', 0.9::DOUBLE, 0.95::DOUBLE, 500, 1500), ('practical', 0.9::DOUBLE, 0.95::DOUBLE, 2000, 2000), ('smoke', 0.5::DOUBLE, 1.0::DOUBLE, 2000, 3000)) AS l(preset, min_ratio, min_rows, max_p50, max_p95))""", floats="throughput_ratio")
def evaluate_slo(spark, sf):
    """Every run against the three presets of limits."""
    presets = {"strict": rules.STRICT_SLO, "practical": rules.PRACTICAL_SLO, "smoke": rules.SMOKE_SLO}
    judged = [rules.evaluate_slo(_hourly(spark, sf), limits).withColumn("preset", F.lit(name)) for name, limits in presets.items()]
    return summary.union_summary_rows(judged).select("user_id", "preset", "throughput_ratio", "trigger_interval_ms", "failure_reason", "slo_status")


_OVER = f"""SELECT user_id, drain_rps / target_rps AS drain_throughput_ratio, target_rps / drain_rps AS target_to_drain_ratio, peak / target_rps AS kafka_lag_peak_ratio, p95 FROM {_HOURLY}"""


@query("overload_ratios", sql=f"SELECT * EXCLUDE (p95) FROM ({_OVER}) AS o", floats="drain_throughput_ratio target_to_drain_ratio kafka_lag_peak_ratio")
def overload_ratios(spark, sf):
    return rules.with_overload_ratios(_hourly(spark, sf)).select("user_id", "drain_throughput_ratio", "target_to_drain_ratio", "kafka_lag_peak_ratio")


@query("classify_overload", sql=f"""
SELECT user_id, CASE WHEN drain_throughput_ratio IS NULL THEN 'artifact_missing' WHEN drain_throughput_ratio < 0.9::DOUBLE OR p95 > 2000 THEN 'overloaded'
  WHEN kafka_lag_peak_ratio >= 1 OR user_id % 4 = 1 THEN 'backpressure' ELSE 'stable' END AS degradation_status FROM ({_OVER}) AS o""")
def classify_overload(spark, sf):
    rows = rules.with_overload_ratios(_hourly(spark, sf))
    growth = F.expr("case user_id % 4 when 1 then 5D when 2 then 0D end")
    verdict = rules.classify_overload(F.col("drain_throughput_ratio"), F.col("artifact_e2e_p95_ms"), F.col("kafka_lag_peak_ratio"), growth)
    return rows.select("user_id", verdict.alias("degradation_status"))


@query("drain_barrier", sql="""
SELECT user_id, CASE WHEN reason = '' THEN 'ok' ELSE 'failed' END AS drain_status, reason AS drain_reason FROM (SELECT user_id, CASE
  WHEN user_id % 5 = 0 THEN 'kafka_lag_status=missing' WHEN user_id % 5 = 1 THEN 'kafka_lag_status=artifact_offsets_missing' WHEN n % 3 <> 0 THEN 'kafka_lag_records_end='||n % 3
  WHEN user_id % 4 = 1 THEN 'kafka_lag_sampler_status=stopped' WHEN user_id % 4 = 2 AND n % 2 <> 0 THEN 'kafka_lag_end_after_drain_records='||n % 2 ELSE '' END AS reason
  FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1))""")
def drain_barrier(spark, sf):
    rows = views.table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n")).selectExpr(
        "user_id", "case user_id % 5 when 0 then ' ' when 1 then 'artifact_offsets_missing' else 'ok' end as kafka_lag_status", "n % 3 as kafka_lag_records_end",
        "case user_id % 4 when 1 then 'stopped' when 2 then 'ok' end as kafka_lag_sampler_status", "n % 2 as kafka_lag_end_after_drain_records",
    )
    return rules.drain_barrier(rows).select("user_id", "drain_status", "drain_reason")


@query("source_stability", sql=f"""
SELECT user_id, concat_ws(';', CASE WHEN user_id % 3 > 0 AND (drain_rps IS NULL OR drain_rps < target_rps * 0.95::DOUBLE) THEN 'replay_actual_rps_below_target' END,
  CASE WHEN p95 > 1000 THEN 'replay_emit_gap_spike' END, CASE WHEN p99 > 1000 THEN 'replay_tick_lag_spike' END, CASE WHEN user_id % 6 > 0 THEN 'replay_producer_buffer_stall' END) AS failure_reason FROM {_HOURLY}""")
def source_stability(spark, sf):
    reason = rules.source_stability(
        F.expr("case when user_id % 3 > 0 then target_rps end"), F.col("drain_rps"), F.col("artifact_e2e_p95_ms"), F.col("artifact_e2e_p99_ms"), F.expr("user_id % 6")
    )
    return _hourly(spark, sf).select("user_id", reason.alias("failure_reason"))


@query("recovery_status", sql=f"""
SELECT user_id, CASE WHEN user_id % 3 = 0 THEN CASE WHEN rows_total < rows_expected * 0.95::DOUBLE THEN 'artifact_incomplete' ELSE 'ok' END
  WHEN rows_total < rows_expected * 0.95::DOUBLE THEN 'pre_fault_incomplete' WHEN coalesce(drain_rps, 0) < target_rps * 0.95::DOUBLE THEN 'post_fault_incomplete'
  WHEN user_id % 4 = 1 OR user_id % 8 = 2 THEN 'checkpoint_missing' ELSE 'ok' END AS status FROM {_HOURLY}""")
def recovery_status(spark, sf):
    kind = F.expr("case when user_id % 3 = 0 then 'none' else 'crash' end")
    verdict = rules.recovery_status(
        kind, F.col("rows_total"), F.col("rows_expected"), F.col("drain_rps"), F.col("target_rps"), F.expr("user_id % 4 <> 1"), F.expr("user_id % 8 = 2")
    )
    return _hourly(spark, sf).select("user_id", verdict.alias("status"))


def _threshold_inputs(spark, sf):
    points = operating_points(views.scored(spark, sf), ["model"])
    metrics = points.where("point = 'fpr_3pct'").selectExpr(
        "concat(' ', model, ' ') as model", "'full' as feature_set", "case when model = 'm0' then cast(threshold as string) else 'n/a' end as opt_threshold", "1 as version"
    )
    held = points.where("point = 'fpr_5pct'").select("model", F.lit("full").alias("feature_set"), F.col("threshold").cast("string").alias("opt_threshold"))
    return metrics, held


@query("resolve_threshold", sql=f"""
SELECT m.model, m.feature_set, coalesce(CASE WHEN m.model = 'm0' AND m.feature_set = 'full' THEN a.threshold END, CASE WHEN m.feature_set = 'full' THEN b.threshold END, 0.5::DOUBLE) AS threshold
FROM (SELECT DISTINCT 'm'||l_linenumber % 3 AS model, CASE WHEN l_linenumber % 4 = 0 THEN 'reduced' ELSE 'full' END AS feature_set FROM flows_li) m
LEFT JOIN (SELECT model, threshold FROM ({POINTS_SQL}) AS p WHERE point = 'fpr_3pct') a USING (model) LEFT JOIN (SELECT model, threshold FROM ({POINTS_SQL}) AS p WHERE point = 'fpr_5pct') b USING (model)""")
def resolve_threshold(spark, sf):
    metrics, held = _threshold_inputs(spark, sf)
    models = views.flows_li(spark, sf).selectExpr("concat('m', l_linenumber % 3) as model", "case when l_linenumber % 4 = 0 then 'reduced' else 'full' end as feature_set").distinct()
    return rules.resolve_threshold(models, metrics, held)


@query("union_summary_rows", sql=f"""
SELECT run_tag, mode, target_rps, kafka_lag_samples, kafka_lag_peak_records FROM (SELECT run_tag, mode, target_rps FROM base_runs
  UNION ALL BY NAME SELECT run_tag, kafka_lag_samples, kafka_lag_peak_records FROM ({LAG_SQL}) AS l)""")
def union_summary_rows(spark, sf):
    first = views.base_runs(spark, sf).select("run_tag", "mode", "target_rps")
    second = backlog_summary(views.lag_samples(spark, sf)).select("run_tag", "kafka_lag_samples", "kafka_lag_peak_records")
    return summary.union_summary_rows([first, second])


@query("upsert_summary", sql="""
SELECT user_id, last(value ORDER BY part, event_id) AS value, max(part)::INT AS part FROM (SELECT user_id, event_id, value, CASE WHEN event_id % 3 = 0 AND user_id % 2 = 0 THEN 1 ELSE 0 END AS part FROM events) GROUP BY 1""")
def upsert_summary(spark, sf):
    rows = views.table(spark, sf, "events").selectExpr("user_id", "event_id as version", "value", "cast(event_id % 3 = 0 and user_id % 2 = 0 as int) as part")
    merged = summary.upsert_summary(rows.where("part = 0"), rows.where("part = 1"), ["user_id"], [F.desc("value")])
    return merged.select("user_id", "value", "part")


@query("union_summary_variant", sql=f"""
SELECT run_tag, mode, target_rps, kafka_lag_samples, kafka_lag_peak_records FROM (SELECT run_tag, mode, target_rps FROM base_runs
  UNION ALL BY NAME SELECT run_tag, kafka_lag_samples, kafka_lag_peak_records FROM ({LAG_SQL}) AS l)""")
def union_summary_variant(spark, sf):
    """The same union over stored parts, each a VARIANT column of its own cells."""
    path = new_path(spark, "variant-rows")
    variant_rows.append_rows(views.base_runs(spark, sf).select("run_tag", "mode", "target_rps"), path, 0)
    variant_rows.append_rows(backlog_summary(views.lag_samples(spark, sf)).select("run_tag", "kafka_lag_samples", "kafka_lag_peak_records"), path, 1)
    return variant_rows.read_rows(spark, path).drop("_part")


@query("upsert_summary_variant", sql="""
SELECT user_id, last(value ORDER BY part, event_id) AS value, max(part)::INT AS part FROM (SELECT user_id, event_id, value, CASE WHEN event_id % 3 = 0 AND user_id % 2 = 0 THEN 1 ELSE 0 END AS part FROM events) GROUP BY 1""")
def upsert_summary_variant(spark, sf):
    path = new_path(spark, "variant-history")
    rows = views.table(spark, sf, "events").selectExpr("user_id", "event_id as version", "value", "cast(event_id % 3 = 0 and user_id % 2 = 0 as int) as part")
    for part in (0, 1):
        variant_rows.append_rows(rows.where(F.col("part") == part), path, part)
    return variant_rows.newest_rows(spark, path, ["user_id"], [F.desc("value")]).select("user_id", "value", "part")


_METRICS = ["n_chars"]


@query("mean_std", sql="""
SELECT lang, avg(n_chars) AS n_chars_mean, CASE WHEN count(n_chars) = 1 THEN 0 ELSE stddev_samp(n_chars) END AS n_chars_std, count(n_chars) AS n_chars_n FROM documents WHERE lang IS NOT NULL GROUP BY 1""", floats="n_chars_mean n_chars_std")
def mean_std(spark, sf):
    return summary.mean_std(views.table(spark, sf, "documents"), ["lang"], ["n_chars"])


@query("mean_std_by_run", sql=f"""
SELECT mode, scenario, avg(drain_rps) AS drain_rps_mean, CASE WHEN count(*) = 1 THEN 0 ELSE stddev_samp(drain_rps) END AS drain_rps_std, count(*) AS drain_rps_n FROM ({RUNS_SQL}) AS r GROUP BY 1, 2""", floats="drain_rps_mean drain_rps_std")
def mean_std_by_run(spark, sf):
    return summary.mean_std(runs(spark, sf), ["mode", "scenario"], ["drain_rps"])


@query("median_min_max", sql=f"""
SELECT mode, median(drain_rps) AS drain_rps_median, min(drain_rps) AS drain_rps_min, max(drain_rps) AS drain_rps_max, median(kafka_lag_peak_records)::DOUBLE AS kafka_lag_peak_records_median,
  min(kafka_lag_peak_records)::DOUBLE AS kafka_lag_peak_records_min, max(kafka_lag_peak_records)::DOUBLE AS kafka_lag_peak_records_max, count(*) AS repeat_count FROM ({RUNS_SQL}) AS r GROUP BY 1""",
       floats="drain_rps_median drain_rps_min drain_rps_max kafka_lag_peak_records_median")
def median_min_max(spark, sf):
    return summary.median_min_max(runs(spark, sf), ["mode"], ["drain_rps", "kafka_lag_peak_records"])


@query("format_mean_std", sql="SELECT lang, printf('%.1f +/- %.1f', avg(n_chars), stddev_samp(n_chars)) AS chars FROM documents GROUP BY 1")
def format_mean_std(spark, sf):
    from flowlib.functions.text import format_mean_std as text

    stats = summary.mean_std(views.table(spark, sf, "documents"), ["lang"], ["n_chars"])
    return stats.select("lang", text(F.col("n_chars_mean"), F.col("n_chars_std")).alias("chars"))


def _texts(metrics):
    return ", ".join(
        f"CASE WHEN count({c}) = 0 THEN 'NA' ELSE printf('%.{d}f +/- %.{d}f', avg({c}), CASE WHEN count({c}) = 1 THEN 0 ELSE stddev_samp({c}) END) END AS {n}_mean_std" for n, (c, d) in metrics.items()
    )


_DIST_TEXT = "latency_rows, e2e_latency_avg_ms, e2e_latency_min_ms, e2e_latency_max_ms, e2e_latency_q90_ms, e2e_latency_q95_ms, e2e_latency_q99_ms"


def _pooled(keys, phase="'measure'"):
    pick = "printf('%.1f', {})"
    cells = [pick.format(f"{f}(end_to_end_ms)") + f" AS e2e_latency_{f}_ms" for f in ("avg", "min", "max")]
    cells += [pick.format(f"quantile_cont(end_to_end_ms, {q}::DOUBLE)") + f" AS e2e_latency_q{int(q * 100)}_ms" for q in (0.9, 0.95, 0.99)]
    return f"""(SELECT {keys}, count(*)::VARCHAR AS latency_rows, {', '.join(cells)} FROM (SELECT run_tag, benchmark_phase, end_to_end_ms FROM preds) AS p JOIN base_runs USING (run_tag)
  WHERE lower(coalesce(benchmark_phase, 'measure')) = {phase} GROUP BY {keys}) AS d"""


_CAPACITY = {"p95_latency_ms": ("p95_e2e_ms", 1), "p99_latency_ms": ("p99_e2e_ms", 1), "drain_rps": ("drain_rps", 1), "throughput_ratio": ("throughput_ratio", 3), "kafka_lag_peak": ("kafka_lag_peak_records", 0)}


@query("capacity_summary", sql=f"""
SELECT CASE WHEN mode = 'pass_through' THEN 'Đi qua' ELSE 'RF-Full' END AS mode, printf('%.0f', target_rps) AS target_rps, * EXCLUDE (mode, target_rps)
FROM (SELECT mode, target_rps, {_texts(_CAPACITY)} FROM ({RUNS_SQL}) AS r GROUP BY 1, 2) JOIN {_pooled('mode, target_rps')} USING (mode, target_rps)""")
def capacity_summary(spark, sf):
    return summary.capacity_summary(runs(spark, sf), views.preds(spark, sf))


_MODEL = {"p95_latency_ms": ("p95_e2e_ms", 1), "p99_latency_ms": ("p99_e2e_ms", 1), "drain_rps": ("drain_rps", 1), "kafka_lag_peak": ("kafka_lag_peak_records", 0), "precision": ("precision", 4), "recall": ("recall", 4), "f1": ("f1", 4)}


@query("model_feature_summary", sql=f"""
SELECT candidate_label AS candidate, feature_set, printf('%.0f', target_rps) AS target_rps, * EXCLUDE (candidate_label, feature_set, target_rps)
FROM (SELECT candidate_label, feature_set, target_rps, {_texts(_MODEL)} FROM ({RUNS_SQL}) AS r GROUP BY 1, 2, 3) JOIN {_pooled('candidate_label, feature_set, target_rps')} USING (candidate_label, feature_set, target_rps)""")
def model_feature_summary(spark, sf):
    rows = runs(spark, sf).withColumnsRenamed({"p95_e2e_ms": "e2e_p95_ms", "p99_e2e_ms": "e2e_p99_ms"})
    return summary.model_feature_summary(rows, views.preds(spark, sf))


_FAULT = {
    "rows_expected": ("coalesce(post_fault_expected_rows, initial_expected_rows)", 0), "rows_observed": ("coalesce(post_fault_rows, initial_rows)", 0),
    "startup_or_recovery_sec": ("coalesce(startup_seconds, recovery_seconds)", 1), "phase_p95_latency_ms": ("phase_e2e_p95_ms", 1), "phase_drain_rps": ("phase_output_rps", 1),
    "kafka_lag_peak": ("kafka_lag_peak_records", 0), "kafka_lag_clear_sec": ("kafka_lag_clear_sec", 1),
}


@query("fault_recovery_summary", sql=f"""
SELECT scenario, printf('%.0f', target_rps) AS target_rps, * EXCLUDE (scenario, target_rps, {_DIST_TEXT}), {', '.join(f"coalesce({c}, 'NA') AS {c}" for c in _DIST_TEXT.split(', '))}
FROM (SELECT scenario, target_rps, {_texts(_FAULT)}, count(*) FILTER (checkpoint_reused = 'true')||'/'||count(*) AS checkpoint_reused
  FROM ({RUNS_SQL}) AS r LEFT JOIN ({FAULT_SQL}) AS f USING (run_tag) GROUP BY 1, 2)
LEFT JOIN {_pooled('scenario, target_rps', "CASE WHEN fault_kind = 'none' THEN 'cold_start' ELSE 'post_fault' END")} USING (scenario, target_rps)""")
def fault_recovery_summary(spark, sf):
    return summary.fault_recovery_summary(runs(spark, sf), views.preds(spark, sf))


_OVERLOAD = {"p95_latency_ms": ("p95_e2e_ms", 1), "p99_latency_ms": ("p99_e2e_ms", 1), "drain_rps": ("drain_rps", 1), "target_to_drain_ratio": ("target_to_drain_ratio", 3), "kafka_lag_peak": ("kafka_lag_peak_records", 0), "kafka_lag_clear_sec": ("kafka_lag_clear_sec", 1)}


@query("overload_summary", sql=f"""
SELECT printf('%.0f', target_rps) AS target_rps, * EXCLUDE (target_rps) FROM (SELECT target_rps, count(*) FILTER (degradation_status = 'overloaded')||'/'||count(*) AS overloaded, {_texts(_OVERLOAD)},
  max(kafka_lag_peak_records)::VARCHAR AS kafka_lag_peak_max FROM ({RUNS_SQL}) AS r GROUP BY 1) JOIN {_pooled('target_rps')} USING (target_rps)""")
def overload_summary(spark, sf):
    return summary.overload_summary(runs(spark, sf), views.preds(spark, sf))


@query("selected_configuration", sql="""
SELECT 'local[4]' AS spark_master, first(trigger_interval ORDER BY run_tag) AS trigger_interval, first(max_offsets_per_trigger ORDER BY run_tag)::VARCHAR AS max_offsets_per_trigger,
  coalesce(first(shuffle_partitions ORDER BY run_tag) FILTER (shuffle_partitions IS NOT NULL)::VARCHAR, '4') AS shuffle_partitions, '1' AS kafka_partitions, 'RF-Full' AS main_model, '500' AS operating_rps FROM base_runs WHERE mode = 'random_forest_full' AND target_rps = 500""")
def selected_configuration(spark, sf):
    rows = views.base_runs(spark, sf)
    return summary.selected_configuration(rows, rows.where("mode = 'pass_through'"), {"main_model": "RF-Full", "operating_rps": "500"})
