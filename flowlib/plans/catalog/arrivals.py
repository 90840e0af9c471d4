"""Replay queries: slices, encoded records, schedules, reordering, late events, emit gaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlib.operators import arrivals
from flowlib.plans import views
from flowlib.plans.registry import query

PLAN = [(100.0, 20.0), (0.0, 3.0), (50.0, 20.0)]


@query("slice_replay_source", sql="""
SELECT event_id, 'flow-'||rn AS flow_id, rn AS row_index FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS rn FROM events) WHERE rn >= 100""")
def slice_replay_source(spark, sf):
    rows = views.table(spark, sf, "events").select("event_id", "ts", "value")
    return arrivals.slice_replay_source(rows, ["ts", "event_id"], offset=100).select("event_id", "flow_id", "row_index")


@query("encode_records", sql="""
SELECT CASE WHEN event_id % 10 = 0 THEN 'runx__row_'||event_id ELSE flow_id END AS key, event_id AS replay_row_index, 'runx' AS replay_run_tag, 'measure' AS benchmark_phase,
  CASE WHEN event_id % 7 > 0 THEN value END AS value, strftime(event_time, '%Y-%m-%dT%H:%M:%S.%f') AS event_time, 1700000000000 + event_id AS source_ingest_epoch_ms,
  strftime(make_timestamp((1700000000000 + event_id) * 1000), '%Y-%m-%dT%H:%M:%S.%g')||'Z' AS source_ingest_ts, event_id % 7 = 0 AS value_is_null FROM flows""")
def encode_records(spark, sf):
    rows = views.flows(spark, sf).selectExpr(
        "event_id", "case when event_id % 10 = 0 then null else flow_id end as flow_id", "event_time", "case when event_id % 7 = 0 then double('NaN') else value end as value"
    )
    encoded = arrivals.encode_records(rows, "runx", "event_id", ingest_epoch_ms=F.col("event_id") + F.lit(1700000000000))
    back = F.from_json("value", "replay_row_index bigint, replay_run_tag string, benchmark_phase string, value double, event_time string, source_ingest_epoch_ms bigint, source_ingest_ts string")
    return encoded.select("key", back.alias("_r"), F.col("value").contains('"value":null').alias("value_is_null")).select("key", "_r.*", "value_is_null")


_ELAPSED = "CASE WHEN r <= 2000 THEN r / 100.0::DOUBLE WHEN r <= 3000 THEN 23 + (r - 2000) / 50.0::DOUBLE ELSE 23 + (r - 2000) / 50.0::DOUBLE END"


@query("arrival_schedule", sql=f"""
SELECT event_id, elapsed_sec, make_timestamp(1704067200000000 + round(elapsed_sec * 1e6)::BIGINT) AS scheduled_ts FROM (SELECT event_id, {_ELAPSED} AS elapsed_sec FROM (SELECT event_id, event_id + 1 AS r FROM events))""",
       floats="elapsed_sec")
def arrival_schedule(spark, sf):
    rows = views.table(spark, sf, "events").select("event_id")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return arrivals.arrival_schedule(rows, PLAN, start, "event_id").select("event_id", "elapsed_sec", "scheduled_ts")


@query("tick_targets", sql="""
SELECT event_id, elapsed_sec, least((SELECT count(*) FROM events), floor(CASE WHEN elapsed_sec <= 20 THEN elapsed_sec * 100 WHEN elapsed_sec <= 23 THEN 2000 WHEN elapsed_sec <= 43 THEN 2000 + (elapsed_sec - 23) * 50
  ELSE 3000 + (elapsed_sec - 43) * 50 END))::BIGINT AS target_rows FROM (SELECT event_id, greatest(event_id, 1) * 0.125::DOUBLE AS elapsed_sec FROM events)""")
def tick_targets(spark, sf):
    rows = views.table(spark, sf, "events").select("event_id")
    return arrivals.tick_targets(rows, PLAN, F.lit(rows.count()), 0.125, "event_id")


@query("rate_plan_summary", sql="""
SELECT event_type, greatest(floor(sum(rows_per_sec * duration_sec)), 1)::BIGINT AS expected_rows, greatest(floor(sum(duration_sec)), 1)::BIGINT AS duration_sec, sum(duration_sec) AS total_seconds,
  max(rows_per_sec) AS peak_rps, greatest(floor(sum(rows_per_sec * duration_sec)), 1)::BIGINT / greatest(floor(sum(duration_sec)), 1)::BIGINT AS target_rps
FROM (SELECT event_type, day(ts) AS d, count(*) / 64.0::DOUBLE AS rows_per_sec, 32.0::DOUBLE AS duration_sec FROM events GROUP BY 1, 2) GROUP BY 1""", floats="target_rps")
def rate_plan_summary(spark, sf):
    steps = views.table(spark, sf, "events").groupBy("event_type", F.dayofmonth("ts").alias("d")).agg((F.count("*") / 64.0).alias("rows_per_sec"), F.lit(32.0).alias("duration_sec"))
    return arrivals.rate_plan_summary(steps, ["event_type"])


@query("reorder_within_blocks", sql="""
SELECT event_id, event_id // 50 * 50 + row_number() OVER (PARTITION BY event_id // 50 ORDER BY md5('7|'||event_id), event_id) - 1 AS new_index FROM events""")
def reorder_within_blocks(spark, sf):
    rows = views.table(spark, sf, "events").select("event_id")
    return arrivals.reorder_within_blocks(rows, 50, 7, "event_id").select("event_id", "new_index")


@query("inject_late_events", sql="""
SELECT event_id, (rn <= floor(n * 0.1::DOUBLE) AND t IS NOT NULL)::INT AS is_delayed, CASE WHEN t IS NOT NULL AND rn <= floor(n * 0.1::DOUBLE)
  THEN make_timestamp(epoch_us(t) - round((0.001::DOUBLE + ('0x'||substr(h, 17, 8))::BIGINT / 4294967296.0::DOUBLE * (30.0::DOUBLE - 0.001::DOUBLE)) * 1e6)::BIGINT) ELSE t END AS event_time
FROM (SELECT *, row_number() OVER (PARTITION BY user_id % 3, t IS NULL ORDER BY h, event_id) AS rn, count(t) OVER (PARTITION BY user_id % 3) AS n
  FROM (SELECT event_id, user_id, md5('11|'||event_id) AS h, CASE WHEN event_id % 23 > 0 THEN ts END AS t FROM events))""")
def inject_late_events(spark, sf):
    rows = views.table(spark, sf, "events").selectExpr("event_id", "user_id % 3 as batch", "case when event_id % 23 > 0 then ts end as event_time")
    return arrivals.inject_late_events(rows, 0.1, 30.0, 11, "event_id", ["batch"]).select("event_id", "is_delayed", "event_time")


_NEAREST = "max({v}) FILTER ({r} = round_even(({c} - 1) * {q}::DOUBLE, 0) + 1) AS {n}"
_GAP_PICKS = ", ".join(
    [_NEAREST.format(v="gap", r="gr", c="gc", q=q, n=f"emit_gap_p{int(q * 100)}_ms") for q in (0.5, 0.95, 0.99)] + [_NEAREST.format(v="late", r="lr", c="lc", q=0.95, n="tick_lag_p95_ms")]
)


# Pace per run of ``emits(run_tag, event_id, e, d)``: emit and due time.
GAP_SQL = f"""
SELECT run_tag, count(*) AS sent_rows, (max(epoch_us(e)) - min(epoch_us(d))) / 1e6::DOUBLE AS actual_elapsed_sec, max(gap) AS emit_gap_max_ms, max(late) AS tick_lag_max_ms,
  count(*) / ((max(epoch_us(e)) - min(epoch_us(d))) / 1e6::DOUBLE) AS actual_rps, {_GAP_PICKS}
FROM (SELECT *, row_number() OVER (PARTITION BY run_tag ORDER BY gap NULLS LAST) AS gr, count(gap) OVER (PARTITION BY run_tag) AS gc, row_number() OVER (PARTITION BY run_tag ORDER BY late) AS lr,
    count(late) OVER (PARTITION BY run_tag) AS lc
  FROM (SELECT *, (epoch_us(e) - lag(epoch_us(e)) OVER (PARTITION BY run_tag ORDER BY e, event_id)) / 1000.0::DOUBLE AS gap, greatest((epoch_us(e) - epoch_us(d)) / 1000.0::DOUBLE, 0) AS late
    FROM ({{emits}}))) GROUP BY 1"""


@query("emit_gap_stats", sql=GAP_SQL.format(emits="""
SELECT 'run'||user_id % 5 AS run_tag, event_id, ts AS e, make_timestamp(epoch_us(ts) + CAST((value - 20) * 1000 AS BIGINT)) AS d FROM events"""), floats="actual_elapsed_sec actual_rps")
def emit_gap_stats(spark, sf):
    rows = views.table(spark, sf, "events").selectExpr(
        "concat('run', user_id % 5) as run_tag", "event_id", "ts as emit_ts", "timestamp_micros(unix_micros(ts) + cast(round((value - 20) * 1000) as bigint)) as due_ts"
    )
    return arrivals.emit_gap_stats(rows, ["run_tag"], unique="event_id")
