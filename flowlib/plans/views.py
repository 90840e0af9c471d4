"""Binding views: the shared tables seen as flows, scores, predictions, backlog samples and runs.

``SQL_VIEWS`` holds the same views as SQL for the comparison engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlib.functions.values import key_text
from flowlib.operators.ordered import with_row_number
from flowlib.scratch import new_path
from flowlib.sources.tables import read_table

EVENT_MONTH = "2024-01"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf}/{name}.parquet")


def flows(spark: SparkSession, sf: str, offsets: bool = False) -> DataFrame:
    """Events as flow records; with ``offsets``, numbered inside four partitions by time."""
    df = table(spark, sf, "events").select(
        F.expr("concat('flow-', event_id)").alias("flow_id"),
        "event_id",
        "user_id",
        F.col("ts").alias("event_time"),
        F.col("event_type").alias("label"),
        F.expr("cast(event_type = 'error' as int)").alias("label_binary"),
        F.expr("cast(user_id % 4 as int)").alias("kafka_partition"),
        "value",
        F.expr("cast(get_json_object(props, '$.k') as double)").alias("k"),
    )
    if not offsets:
        return df
    return with_row_number(df, ["kafka_partition"], ["event_time", "event_id"], name="_rn").withColumn(
        "kafka_offset", F.col("_rn") - 1
    ).drop("_rn")


def flows_li(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate as event_time", "l_returnflag as label",
        "cast(l_returnflag = 'R' as int) as label_binary", "concat('f', l_suppkey % 4) as source_file",
        "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    )


def content_key():
    """Key of a line: integers, text and epoch micros only, so that every engine builds the same text."""
    return key_text(
        F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber"),
        F.expr("cast(l_quantity as bigint)"), F.expr("cast(round(l_extendedprice * 100) as bigint)"), F.unix_micros("event_time"),
    )


def scored(spark: SparkSession, sf: str, rounded: bool = True) -> DataFrame:
    """Lines with a score; rounded to 4 decimals it has many ties."""
    score = "floor(l_extendedprice / 12.0D + 0.5D) / 10000.0D" if rounded else "l_extendedprice / 120000.0D"
    return flows_li(spark, sf).selectExpr(
        "concat('m', l_linenumber % 2) as model", "'calibration' as split", "label", "label_binary", f"{score} as score"
    )


def preds(spark: SparkSession, sf: str, offsets: bool = False) -> DataFrame:
    score = "least(value / 200.0D, 1.0D)"
    return flows(spark, sf, offsets).selectExpr(
        "flow_id", "event_id", "user_id", "concat('m', event_id % 3) as model_name", "'full' as feature_set",
        "concat('run', event_id % 5) as run_tag",
        "case event_id % 20 when 0 then 'warmup' when 1 then null when 2 then 'MEASURE' when 3 then 'post_fault' "
        "when 4 then 'cold_start' else 'measure' end as benchmark_phase",
        f"case when event_id % 50 <> 0 then cast({score} >= 0.3D as int) end as prediction_label",
        f"{score} as prediction_score", "0.3D as threshold_used", "kafka_partition",
        *(["kafka_offset"] if offsets else []),
        "event_time as event_time_ts", "event_time as ingest_time", "date_trunc('second', event_time) as emit_time",
        "value as source_to_ingest_ms", "value * 3 as processing_ms", "value * 4 as end_to_end_ms",
        "case when event_id % 77 <> 0 then label_binary end as label_binary", "label",
    )


def lag_samples(spark: SparkSession, sf: str) -> DataFrame:
    """One backlog sample per run and hour."""
    hours = table(spark, sf, "events").groupBy(
        F.expr("concat('run', user_id % 5)").alias("run_tag"), F.date_trunc("hour", "ts").alias("h")
    ).agg(F.expr("greatest(count(*) - 2, 0)").alias("lag_records"))
    ends = hours.where("day(h) <= 20").groupBy("run_tag").agg(F.max("h").alias("end_h"))
    return hours.join(ends, "run_tag", "left").selectExpr(
        "run_tag", "unix_millis(h) as ts_epoch_ms", "'flows' as topic",
        "case when day(h) <= 2 then 'warmup' when day(h) <= 20 then 'measure_replay' else 'measure_drain' end as phase",
        "case when h = end_h then 'measure_replay_end' else '' end as event",
        "lag_records", "case when hour(h) = 17 then 'sample_error:X' else 'ok' end as status",
    )


def base_runs(spark: SparkSession, sf: str) -> DataFrame:
    """One row per run with its declared settings."""
    seen = table(spark, sf, "events").groupBy(F.expr("cast(event_id % 5 as int)").alias("i")).agg(F.count("*").alias("n"))
    return seen.selectExpr(
        "concat('run', i) as run_tag", "i as repeat_index",
        "case when i % 2 = 0 then 'random_forest_full' else 'pass_through' end as mode",
        "case when i % 2 = 0 then 'RF-Full' else 'RF-17' end as candidate_label",
        "case when i % 2 = 0 then 'full' else 'reduced' end as feature_set",
        "case when i % 2 = 0 then 'random_forest' else 'pass_through' end as model",
        "case when i % 2 = 0 then 500D else 750D end as target_rps",
        "n / 2592000D * (8 + i) / 10 as offered_rps",
        "cast(floor(n * (80 + 5 * i) / 100) as bigint) as rows_expected",
        "case when i = 4 then 'none' else 'spark_process_crash' end as fault_kind",
        "case when i = 4 then 'cold_start_300rps' else 'spark_process_crash_300rps' end as scenario",
        "case when i % 2 = 0 then '1 second' else '500 milliseconds' end as trigger_interval",
        "cast(n as double) as initial_expected_rows", "case when i <> 4 then n * 0.05D end as post_fault_expected_rows",
        "n - i * 10.0D as initial_rows", "case when i <> 4 then n * 0.05D - i end as post_fault_rows",
        "case when i = 4 then 1.5D end as startup_seconds", "case when i <> 4 then 2.0D + i end as recovery_seconds",
        "case when i <> 4 then cast(i % 2 = 0 as string) end as checkpoint_reused",
        "i * 1000 as max_offsets_per_trigger", "cast(case when i <> 0 then 4 end as int) as shuffle_partitions",
    )


_V = "cast(cast(value as decimal(18,2)) as string)"


def dirty(spark: SparkSession, sf: str) -> DataFrame:
    """Events as messy text rows of two captures: mixed formats, sentinels, odd numbers, repeats."""
    base = table(spark, sf, "events").selectExpr(
        "event_id", "cast(event_id % 2 as int) as f",
        "case when event_id % 97 = 0 then 'Timestamp' when event_id % 89 = 0 then '01/01/1970 00:00:00' "
        "when event_id % 83 = 0 then 'nan' when event_id % 10 = 1 then date_format(ts, 'yyyy-MM-dd HH:mm:ss') "
        "when event_id % 10 = 2 then date_format(ts, 'd/M/yyyy H:m:s') "
        "when event_id % 10 = 3 then date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\") "
        "when event_id % 10 = 4 then concat('  ', date_format(ts, 'dd/MM/yyyy HH:mm:ss'), ' ') "
        "else date_format(ts, 'dd/MM/yyyy HH:mm:ss') end as timestamp",
        "case when event_id % 53 = 0 then 'nan' when event_id % 59 = 0 then '  ' when event_id % 61 = 0 then ' <NA> ' "
        "when event_type = 'click' then 'Benign' when event_type = 'view' then 'BENIGN' "
        "when event_type = 'error' then ' DoS attacks-Hulk ' when event_type = 'signup' then 'Infilteration' "
        "else 'New Attack!!' end as label",
        f"case when event_id % 41 = 0 then 'Infinity' when event_id % 43 = 0 then 'nan' when event_id % 47 = 0 then 'x' "
        f"when event_id % 37 = 0 then '-inf' when event_id % 29 = 0 then concat(' ', {_V}, ' ') "
        f"when event_id % 31 = 0 then concat({_V}, 'd') else {_V} end as byts",
        "get_json_object(props, '$.k') as pkts",
    )
    copies = F.expr(
        "filter(array(struct(0 as copy, f as file), if(event_id % 11 = 0, struct(1 as copy, f as file), null), "
        "if(event_id % 101 = 0, struct(2 as copy, 1 - f as file), null)), x -> x is not null)"
    )
    return base.select("*", F.explode(copies).alias("_c")).selectExpr(
        "event_id", "_c.copy as copy", "_c.file as f", "timestamp", "label", "byts", "pkts",
        "case when _c.file = 1 then cast(event_id % 7 as string) end as extra",
    )


_DIRTY_PATHS: dict[tuple[str, str], str] = {}


def dirty_csv(spark: SparkSession, sf: str) -> str:
    """Folder with the messy rows as two CSV captures of different layout; written once per application."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _DIRTY_PATHS:
        path = new_path(spark, "dirty-csv")
        for f in _LAYOUTS:
            write_capture(spark, sf, f, path)
        _DIRTY_PATHS[key] = path
    return _DIRTY_PATHS[key]


_LAYOUTS = {
    0: {" Timestamp ": "timestamp", "Label": "label", "Flow Byts/s": "byts", "Flow Pkts/s": "pkts"},
    1: {"Flow Pkts/s": "pkts", "TIMESTAMP": "timestamp", " Flow Byts/s": "byts", " label": "label", "Extra": "extra"},
}


def write_capture(spark: SparkSession, sf: str, f: int, folder: str) -> None:
    """The messy rows of one capture as CSV of its layout below ``folder``."""
    part = dirty(spark, sf).where(F.col("f") == f).select(*[F.col(c).alias(h) for h, c in _LAYOUTS[f].items()])
    part.write.option("header", "true").option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(f"{folder}/capture-{f}.csv")


def envelope(spark: SparkSession, sf: str) -> DataFrame:
    """Events as topic records: JSON text with odd, malformed and control records, and the envelope columns."""
    iso = "date_format(event_time, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\")"
    record = flows(spark, sf, offsets=True).selectExpr(
        "event_id", "event_time as _at", "kafka_partition", "kafka_offset", "k as _k", "flow_id", "concat('run', event_id % 5) as replay_run_tag", "'measure' as benchmark_phase",
        "case when event_id % 41 = 0 then 1 when event_id % 2 = 0 then 0 end as is_control_record",
        "case when event_id % 43 = 0 then 'input_sentinel' when event_id % 3 = 0 then '' end as control_type",
        f"if(event_id % 29 = 0, 'junk', {iso}) as event_time", f"if(event_id % 14 = 0, null, {iso}) as source_ingest_ts",
        "if(event_id % 7 > 0, unix_millis(event_time) + event_id % 50, null) as source_ingest_epoch_ms", "label_binary", "label",
        "if(event_id % 37 = 0, 'abc', null) as _text", "value", "k",
    )
    hidden = ("event_id", "_at", "kafka_partition", "kafka_offset", "_k", "_text", "value")
    cells = [c for c in record.columns if c not in hidden]
    # A wrong type for the feature is written by naming a text cell like the number.
    good = F.to_json(F.struct(*cells, "value"), {"ignoreNullFields": "false"})
    bad = F.to_json(F.struct(*cells, F.col("_text").alias("value")), {"ignoreNullFields": "false"})
    text = F.when(F.expr("event_id % 31 = 0"), F.lit("not json")).when(F.col("_text").isNotNull(), bad).otherwise(good)
    return record.select(
        "event_id", F.expr("timestamp_micros(unix_micros(_at) + cast((_k - 20) * 10000 as bigint))").alias("kafka_timestamp"),
        "kafka_partition", "kafka_offset", text.alias("value"),
    )


_ENVELOPE_PATHS: dict[tuple[str, str], str] = {}


def envelope_files(spark: SparkSession, sf: str) -> str:
    """Folder of envelope files, as a file stream reads them; written once per application."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _ENVELOPE_PATHS:
        path = new_path(spark, "envelope")
        envelope(spark, sf).drop("event_id").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "kafka_offset").write.parquet(path)
        _ENVELOPE_PATHS[key] = path
    return _ENVELOPE_PATHS[key]


SQL_VIEWS = {
    "flows": """
SELECT 'flow-'||event_id AS flow_id, event_id, user_id, ts AS event_time, event_type AS label,
  (event_type = 'error')::INT AS label_binary, (user_id % 4)::INT AS kafka_partition, value,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
  row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id) - 1 AS kafka_offset
FROM events""",
    "flows_li": """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate AS event_time, l_returnflag AS label,
  (l_returnflag = 'R')::INT AS label_binary, 'f'||(l_suppkey % 4) AS source_file,
  l_quantity, l_extendedprice, l_discount, l_tax,
  concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity::BIGINT,
    round(l_extendedprice * 100)::BIGINT, epoch_us(l_shipdate)) AS content_key
FROM lineitem""",
    "scored": """
SELECT 'm'||(l_linenumber % 2) AS model, 'calibration' AS split, label, label_binary,
  floor(l_extendedprice / 12.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE AS score, l_extendedprice / 120000.0::DOUBLE AS raw_score
FROM flows_li""",
    "preds": """
SELECT flow_id, event_id, user_id, 'm'||(event_id % 3) AS model_name, 'full' AS feature_set, 'run'||(event_id % 5) AS run_tag,
  CASE event_id % 20 WHEN 0 THEN 'warmup' WHEN 1 THEN NULL WHEN 2 THEN 'MEASURE' WHEN 3 THEN 'post_fault'
    WHEN 4 THEN 'cold_start' ELSE 'measure' END AS benchmark_phase,
  CASE WHEN event_id % 50 <> 0 THEN (least(value / 200.0::DOUBLE, 1.0::DOUBLE) >= 0.3::DOUBLE)::INT END AS prediction_label,
  least(value / 200.0::DOUBLE, 1.0::DOUBLE) AS prediction_score, 0.3::DOUBLE AS threshold_used, kafka_partition, kafka_offset,
  event_time AS event_time_ts, event_time AS ingest_time, date_trunc('second', event_time) AS emit_time,
  value AS source_to_ingest_ms, value * 3 AS processing_ms, value * 4 AS end_to_end_ms,
  CASE WHEN event_id % 77 <> 0 THEN label_binary END AS label_binary, label
FROM flows""",
    "lag_hours": """
SELECT 'run'||(user_id % 5) AS run_tag, date_trunc('hour', ts) AS h, greatest(count(*) - 2, 0) AS lag_records
FROM events GROUP BY 1, 2""",
    "lag_samples": """
SELECT a.run_tag, epoch_us(a.h) // 1000 AS ts_epoch_ms, 'flows' AS topic,
  CASE WHEN day(a.h) <= 2 THEN 'warmup' WHEN day(a.h) <= 20 THEN 'measure_replay' ELSE 'measure_drain' END AS phase,
  CASE WHEN a.h = b.end_h THEN 'measure_replay_end' ELSE '' END AS event, a.lag_records,
  CASE WHEN hour(a.h) = 17 THEN 'sample_error:X' ELSE 'ok' END AS status
FROM lag_hours a LEFT JOIN (SELECT run_tag, max(h) AS end_h FROM lag_hours WHERE day(h) <= 20 GROUP BY 1) b USING (run_tag)""",
    "base_runs": """
SELECT 'run'||i AS run_tag, i AS repeat_index,
  CASE WHEN i % 2 = 0 THEN 'random_forest_full' ELSE 'pass_through' END AS mode,
  CASE WHEN i % 2 = 0 THEN 'RF-Full' ELSE 'RF-17' END AS candidate_label,
  CASE WHEN i % 2 = 0 THEN 'full' ELSE 'reduced' END AS feature_set,
  CASE WHEN i % 2 = 0 THEN 'random_forest' ELSE 'pass_through' END AS model,
  CASE WHEN i % 2 = 0 THEN 500::DOUBLE ELSE 750::DOUBLE END AS target_rps,
  n / 2592000::DOUBLE * (8 + i) / 10 AS offered_rps,
  floor(n * (80 + 5 * i) / 100)::BIGINT AS rows_expected,
  CASE WHEN i = 4 THEN 'none' ELSE 'spark_process_crash' END AS fault_kind,
  CASE WHEN i = 4 THEN 'cold_start_300rps' ELSE 'spark_process_crash_300rps' END AS scenario,
  CASE WHEN i % 2 = 0 THEN '1 second' ELSE '500 milliseconds' END AS trigger_interval,
  n::DOUBLE AS initial_expected_rows, CASE WHEN i <> 4 THEN n * 0.05::DOUBLE END AS post_fault_expected_rows,
  n - i * 10.0::DOUBLE AS initial_rows, CASE WHEN i <> 4 THEN n * 0.05::DOUBLE - i END AS post_fault_rows,
  CASE WHEN i = 4 THEN 1.5::DOUBLE END AS startup_seconds, CASE WHEN i <> 4 THEN 2.0::DOUBLE + i END AS recovery_seconds,
  CASE WHEN i <> 4 THEN CASE WHEN i % 2 = 0 THEN 'true' ELSE 'false' END END AS checkpoint_reused,
  i * 1000 AS max_offsets_per_trigger, CASE WHEN i <> 0 THEN 4 END AS shuffle_partitions
FROM (SELECT (event_id % 5)::INT AS i, count(*) AS n FROM events GROUP BY 1)""",
    "dirty": """
SELECT event_id, copy, CASE WHEN copy = 2 THEN 1 - f ELSE f END AS f, timestamp, label, byts, pkts,
  CASE WHEN (CASE WHEN copy = 2 THEN 1 - f ELSE f END) = 1 THEN (event_id % 7)::VARCHAR END AS extra
FROM (SELECT event_id, (event_id % 2)::INT AS f,
    CASE WHEN event_id % 97 = 0 THEN 'Timestamp' WHEN event_id % 89 = 0 THEN '01/01/1970 00:00:00'
      WHEN event_id % 83 = 0 THEN 'nan' WHEN event_id % 10 = 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
      WHEN event_id % 10 = 2 THEN day(ts)||'/'||month(ts)||'/'||year(ts)||' '||hour(ts)||':'||minute(ts)||':'||second(ts)
      WHEN event_id % 10 = 3 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
      WHEN event_id % 10 = 4 THEN '  '||strftime(ts, '%d/%m/%Y %H:%M:%S')||' '
      ELSE strftime(ts, '%d/%m/%Y %H:%M:%S') END AS timestamp,
    CASE WHEN event_id % 53 = 0 THEN 'nan' WHEN event_id % 59 = 0 THEN '  ' WHEN event_id % 61 = 0 THEN ' <NA> '
      WHEN event_type = 'click' THEN 'Benign' WHEN event_type = 'view' THEN 'BENIGN'
      WHEN event_type = 'error' THEN ' DoS attacks-Hulk ' WHEN event_type = 'signup' THEN 'Infilteration'
      ELSE 'New Attack!!' END AS label,
    CASE WHEN event_id % 41 = 0 THEN 'Infinity' WHEN event_id % 43 = 0 THEN 'nan' WHEN event_id % 47 = 0 THEN 'x'
      WHEN event_id % 37 = 0 THEN '-inf' WHEN event_id % 29 = 0 THEN ' '||value::DECIMAL(18,2)::VARCHAR||' '
      WHEN event_id % 31 = 0 THEN value::DECIMAL(18,2)::VARCHAR||'d' ELSE value::DECIMAL(18,2)::VARCHAR END AS byts,
    json_extract_string(props, '$.k') AS pkts FROM events)
  JOIN (VALUES (0), (1), (2)) c(copy) ON copy = 0 OR (copy = 1 AND event_id % 11 = 0) OR (copy = 2 AND event_id % 101 = 0)""",
    "label_map": """
SELECT * FROM (VALUES ('Benign','benign'), ('DoS attacks-Hulk','dos_attacks_hulk'), ('Infilteration','infiltration')) t(raw_label, normalized_label)""",
    "checked": """
SELECT *, CASE WHEN ts IS NULL OR ts < TIMESTAMP '2018-01-01' THEN 'timestamp'
    WHEN label_text IS NULL OR label_text IN ('', 'nan', 'None', '<NA>') THEN 'label' ELSE 'kept' END AS rule,
  coalesce(m.normalized_label, coalesce(nullif(trim(regexp_replace(lower(label_text), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'unknown')) AS label_norm,
  m.normalized_label IS NULL AS unmapped
FROM (SELECT *, 'capture-'||f||'.csv' AS source_file, trim(label) AS label_text,
    coalesce(try_strptime(trim(timestamp), ['%d/%m/%Y %H:%M:%S', '%Y-%m-%d %H:%M:%S']),
      CASE WHEN trim(timestamp) LIKE '____-__-__T%' THEN try_cast(trim(timestamp) AS TIMESTAMP) END) AS ts,
    CASE WHEN isfinite(try_cast(trim(byts) AS DOUBLE)) THEN try_cast(trim(byts) AS DOUBLE) END AS byts_num,
    try_cast(pkts AS DOUBLE) AS pkts_num, try_cast(extra AS DOUBLE) AS extra_num FROM dirty)
LEFT JOIN label_map m ON m.raw_label = label_text""",
    "records": """
SELECT make_timestamp(epoch_us(event_time) + ((k - 20) * 10000)::BIGINT) AS kafka_timestamp, kafka_partition, kafka_offset, event_id, m,
  CASE WHEN NOT m THEN flow_id END AS flow_id, CASE WHEN NOT m THEN 'run'||(event_id % 5) END AS replay_run_tag, CASE WHEN NOT m THEN 'measure' END AS benchmark_phase,
  CASE WHEN m THEN NULL WHEN event_id % 41 = 0 THEN 1 WHEN event_id % 2 = 0 THEN 0 END AS is_control_record,
  CASE WHEN m THEN NULL WHEN event_id % 43 = 0 THEN 'input_sentinel' WHEN event_id % 3 = 0 THEN '' END AS control_type,
  CASE WHEN m THEN NULL WHEN event_id % 29 = 0 THEN 'junk' ELSE strftime(event_time, '%Y-%m-%dT%H:%M:%S.%f') END AS event_time,
  CASE WHEN NOT m AND event_id % 14 > 0 THEN strftime(event_time, '%Y-%m-%dT%H:%M:%S.%f') END AS source_ingest_ts,
  CASE WHEN NOT m AND event_id % 7 > 0 THEN (epoch_us(event_time) // 1000 + event_id % 50)::DOUBLE END AS source_ingest_epoch_ms,
  CASE WHEN NOT m THEN label_binary END AS label_binary, CASE WHEN NOT m THEN label END AS label,
  CASE WHEN NOT m AND event_id % 37 > 0 THEN value END AS value, CASE WHEN NOT m THEN k END AS k,
  CASE WHEN NOT m AND event_id % 29 > 0 THEN event_time END AS event_time_ts,
  CASE WHEN m THEN NULL WHEN event_id % 7 > 0 THEN make_timestamp((epoch_us(event_time) // 1000 + event_id % 50) * 1000) WHEN event_id % 14 > 0 THEN event_time END AS source_ingest_time_ts
FROM (SELECT *, event_id % 31 = 0 AS m FROM flows)""",
    "timed": """
SELECT *, kafka_timestamp AS ingest_time, coalesce(source_ingest_time_ts, event_time_ts) AS event_reference_time,
  CASE WHEN coalesce(source_ingest_time_ts, event_time_ts) IS NULL THEN 0::DOUBLE
    ELSE greatest(0, epoch_us(kafka_timestamp) // 1000 - epoch_us(coalesce(source_ingest_time_ts, event_time_ts)) // 1000)::DOUBLE END AS event_lateness_ms,
  CASE WHEN source_ingest_time_ts IS NULL THEN 0::DOUBLE ELSE greatest(0, epoch_us(kafka_timestamp) // 1000 - epoch_us(source_ingest_time_ts) // 1000)::DOUBLE END AS source_to_ingest_ms,
  coalesce(is_control_record, 0) <> 0 OR coalesce(control_type, '') <> '' AS is_control
FROM records""",
}
