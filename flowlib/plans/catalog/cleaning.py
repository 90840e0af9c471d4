"""Raw CSV, cleaning and text queries."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from flowlib.functions import text, values
from flowlib.operators import clean
from flowlib.plans import views
from flowlib.plans.registry import query
from flowlib.scratch import new_path
from flowlib.sources import flow_csv
from flowlib.sources.lookups import FULL_FEATURES, label_mapping
from flowlib.streaming import captures

_NA = "('', '#N/A', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null', '<NA>')"


def _raw_cells(*names):
    return ", ".join(f"CASE WHEN {c} NOT IN {_NA} THEN {c} END AS {c}" for c in names)


@query("scan_flow_csv", sql=f"""
SELECT {_raw_cells('timestamp', 'label', 'byts', 'pkts')}, extra, 'capture-'||f||'.csv' AS source_file FROM dirty""")
def scan_flow_csv(spark, sf):
    raw = flow_csv.scan_flow_csv(spark, views.dirty_csv(spark, sf))
    return raw.withColumnsRenamed({"Flow Byts/s": "byts", "Flow Pkts/s": "pkts", "Extra": "extra"})


@query("union_file_schemas", sql="""
SELECT source_file, count(*) AS rows, count(extra) AS extra_present, count(DISTINCT pkts) AS distinct_pkts
FROM (SELECT 'capture-0.csv' AS source_file, pkts FROM dirty WHERE f = 0
  UNION ALL BY NAME SELECT extra, pkts, 'capture-1.csv' AS source_file FROM dirty WHERE f = 1) GROUP BY 1""")
def union_file_schemas(spark, sf):
    raw = flow_csv.scan_flow_csv(spark, views.dirty_csv(spark, sf), encoding="UTF-8")
    return raw.groupBy("source_file").agg(
        F.count("*").alias("rows"), F.count("Extra").alias("extra_present"), F.countDistinct("Flow Pkts/s").alias("distinct_pkts")
    )


def _clean(spark, sf):
    return clean.clean_flows(flow_csv.scan_flow_csv(spark, views.dirty_csv(spark, sf), encoding="UTF-8"), label_mapping(spark))


_CLEAN = """SELECT DISTINCT ts AS timestamp, label_text AS label, label_norm, (label_norm <> 'benign')::INT AS label_binary,
  extra_num AS extra, byts_num AS byts, pkts_num AS pkts, source_file FROM checked WHERE rule = 'kept'"""


@query("write_silver", sql=f"SELECT *, strftime(timestamp, '%Y-%m-%d') AS day FROM ({_CLEAN}) AS c")
def write_silver(spark, sf):
    path = new_path(spark, "silver")
    flow_csv.write_silver(_clean(spark, sf), path, compact=True)
    back = flow_csv.read_silver(spark, path).withColumnsRenamed({"Flow Byts/s": "byts", "Flow Pkts/s": "pkts", "Extra": "extra"})
    return back.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("incremental_silver", sql=_CLEAN)
def incremental_silver(spark, sf):
    """Two rounds of captures, the second tried again after it had written its rows: the silver rows of one full run."""
    inbox, silver, checkpoint = (new_path(spark, n) for n in ("captures", "silver", "captures-checkpoint"))
    stops = iter([False, True, False])

    def stop_once() -> None:
        if next(stops):
            raise RuntimeError("stopped after the rows were written")

    for f in (0, 1):
        views.write_capture(spark, sf, f, inbox)
        for _ in range(2):
            try:
                captures.take_captures(spark, inbox, silver, checkpoint, label_mapping(spark), encoding="UTF-8", after_write=stop_once)
            except StreamingQueryException:
                continue
            break
    back = captures.read_taken(spark, silver)
    return back.withColumnsRenamed({"Flow Byts/s": "byts", "Flow Pkts/s": "pkts", "Extra": "extra"})


@query("dedup_within_file", sql=f"SELECT source_file, count(*) AS rows, count(byts) AS numbers, sum(label_binary)::BIGINT AS attacks FROM ({_CLEAN}) AS c GROUP BY 1")
def dedup_within_file(spark, sf):
    return _clean(spark, sf).groupBy("source_file").agg(
        F.count("*").alias("rows"), F.count("Flow Byts/s").alias("numbers"), F.sum("label_binary").alias("attacks")
    )


@query("dedup_by_digest", sql=_CLEAN)
def dedup_by_digest(spark, sf):
    """Every clean row once; only rows whose digest repeats were moved whole."""
    raw = flow_csv.scan_flow_csv(spark, views.dirty_csv(spark, sf), encoding="UTF-8")
    kept = clean.clean_flows(raw, label_mapping(spark), by_digest=True)
    return kept.withColumnsRenamed({"Flow Byts/s": "byts", "Flow Pkts/s": "pkts", "Extra": "extra"})


_STATS = """
SELECT coalesce(a.source_file, '*') AS source_file, sum(a.rows_raw)::BIGINT AS rows_raw, sum(b.rows_kept)::BIGINT AS rows_kept,
  sum(a.dropped_timestamp)::BIGINT AS dropped_timestamp, sum(a.dropped_null_label)::BIGINT AS dropped_null_label,
  sum(a.passed - b.rows_kept)::BIGINT AS dropped_duplicates, sum(a.unmapped_labels)::BIGINT AS unmapped_labels
FROM (SELECT source_file, count(*) AS rows_raw, count(*) FILTER (rule = 'timestamp') AS dropped_timestamp,
    count(*) FILTER (rule = 'label') AS dropped_null_label, count(*) FILTER (rule = 'kept') AS passed,
    count(*) FILTER (rule = 'kept' AND unmapped) AS unmapped_labels FROM checked GROUP BY 1) a
JOIN (SELECT source_file, count(*) AS rows_kept FROM (SELECT DISTINCT source_file, ts, label_text, label_norm, byts_num, pkts_num, extra_num
    FROM checked WHERE rule = 'kept') GROUP BY 1) b ON a.source_file = b.source_file
GROUP BY ROLLUP (a.source_file)"""


@query("cleaning_stats_by_digest", sql=_STATS)
def cleaning_stats_by_digest(spark, sf):
    return clean.cleaning_stats(flow_csv.scan_flow_csv(spark, views.dirty_csv(spark, sf), encoding="UTF-8"), label_mapping(spark), by_digest=True)


@query("cleaning_stats", sql=_STATS)
def cleaning_stats(spark, sf):
    return clean.cleaning_stats(flow_csv.scan_flow_csv(spark, views.dirty_csv(spark, sf), encoding="UTF-8"), label_mapping(spark))


@query("parse_timestamps", sql="SELECT event_id, copy, ts AS parsed FROM checked")
def parse_timestamps(spark, sf):
    return views.dirty(spark, sf).select("event_id", "copy", values.parse_timestamp(F.col("timestamp")).alias("parsed"))


@query("filter_timestamp_floor", sql="SELECT event_id, copy, ts FROM checked WHERE ts >= TIMESTAMP '2018-01-01'")
def filter_timestamp_floor(spark, sf):
    parsed = views.dirty(spark, sf).withColumn("ts", values.parse_timestamp(F.col("timestamp")))
    return parsed.where(values.is_valid_timestamp(F.col("ts"))).select("event_id", "copy", "ts")


@query("filter_null_labels", sql="SELECT event_id, copy, label_text AS label FROM checked WHERE label_text NOT IN ('', 'nan', 'None', '<NA>')")
def filter_null_labels(spark, sf):
    rows = views.dirty(spark, sf).where(~values.is_missing_label(F.col("label")))
    return rows.select("event_id", "copy", text.strip(F.col("label")).alias("label"))


@query("normalize_labels", sql="""
SELECT event_id, copy, coalesce(normalized_label, CASE WHEN label_text IN ('', 'nan', 'None', '<NA>') THEN 'unknown' ELSE label_norm END) AS label_norm,
  (unmapped AND label_text NOT IN ('', 'nan', 'None', '<NA>')) AS is_unmapped FROM checked""")
def normalize_labels(spark, sf):
    named = clean.normalize_labels(views.dirty(spark, sf), label_mapping(spark))
    return named.select("event_id", "copy", "label_norm", "is_unmapped")


@query("unmapped_labels", sql="""
SELECT label_text AS label, count(*) AS rows FROM checked WHERE unmapped AND label_text NOT IN ('', 'nan', 'None', '<NA>') GROUP BY 1""")
def unmapped_labels(spark, sf):
    return clean.unmapped_labels(views.dirty(spark, sf), label_mapping(spark))


@query("join_lookup", sql="SELECT event_id, copy, normalized_label AS mapped FROM checked")
def join_lookup(spark, sf):
    return clean.join_label_mapping(views.dirty(spark, sf), label_mapping(spark)).select("event_id", "copy", "mapped")


@query("load_label_mapping", sql="""
SELECT m.raw_label, m.normalized_label, count(*) AS rows FROM checked JOIN label_map m ON label_text = m.raw_label GROUP BY 1, 2""")
def load_label_mapping(spark, sf):
    names = label_mapping(spark)
    rows = views.dirty(spark, sf).join(names, text.strip(F.col("label")) == F.col("raw_label"))
    return rows.groupBy("raw_label", "normalized_label").agg(F.count("*").alias("rows"))


@query("slugify", sql="""
SELECT doc_id, coalesce(nullif(trim(regexp_replace(lower(trim(source||' / '||lang||' #'||doc_id)), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'unknown') AS slug FROM documents""")
def slugify(spark, sf):
    raw = F.concat("source", F.lit(" / "), "lang", F.lit(" #"), F.col("doc_id").cast("string"))
    return views.table(spark, sf, "documents").select("doc_id", text.slugify(raw).alias("slug"))


@query("binary_label", sql="SELECT event_id, copy, (label_norm <> 'benign')::INT AS label_binary FROM checked WHERE rule = 'kept'")
def binary_label(spark, sf):
    rows = clean.checked_rows(views.dirty(spark, sf).withColumn("source_file", F.lit("all")), label_mapping(spark))
    # event_id and copy are treated as features here, so they come back as doubles.
    return rows.where("_rule = 'kept'").selectExpr("cast(event_id as bigint) as event_id", "cast(copy as int) as copy", "label_binary")


@query("sanitize_numeric", sql="SELECT event_id, copy, byts_num AS byts, pkts_num AS pkts, extra_num AS extra FROM checked")
def sanitize_numeric(spark, sf):
    rows = views.dirty(spark, sf).select("event_id", "copy", "byts", "pkts", "extra")
    return clean.sanitize_numeric(rows, ["byts", "pkts", "extra"])


@query("safe_tag", sql=r"""
SELECT page_id, coalesce(nullif(trim(regexp_replace(trim(url), '[^\p{L}\p{N}_-]', '_', 'g'), '_'), ''), 'default') AS tag,
  coalesce(nullif(regexp_replace(trim(url), '[^\p{L}\p{N}._-]', '_', 'g'), ''), 'unknown_run') AS file_tag FROM pages""")
def safe_tag(spark, sf):
    return views.table(spark, sf, "pages").select(
        "page_id", text.safe_tag(F.col("url")).alias("tag"), text.safe_file_tag(F.col("url")).alias("file_tag")
    )


_UNITS = ["milliseconds", "ms", "second", "s", "minutes", "m", "hours", ""]


@query("trigger_interval_ms", sql="""
SELECT event_id, CASE WHEN u IN ('milliseconds', 'ms') THEN k WHEN u IN ('second', 's', '') THEN k * 1000 WHEN u IN ('minutes', 'm') THEN k * 60000 END AS ms
FROM (SELECT event_id, k, (['milliseconds', 'ms', 'second', 's', 'minutes', 'm', 'hours', ''])[event_id % 8 + 1] AS u FROM flows)""")
def trigger_interval_ms(spark, sf):
    unit = F.get(F.array(*[F.lit(u) for u in _UNITS]), F.expr("cast(event_id % 8 as int)"))
    written = F.concat(F.lit(" "), F.expr("cast(cast(k as int) as string)"), F.lit("  "), F.upper(unit))
    return views.flows(spark, sf).select("event_id", values.trigger_interval_ms(written).alias("ms"))


_TAGS = ["concat('CapacityCalibration_r1_pass_through_', n, 'rps_7')", "concat('capacitycalibration_r2_random_forest_full_', n, 'rps_8')",
         "concat('modelfeaturetradeoff_x_rf_17_', n, 'rps_1')", "concat('faultrecovery_r1_2_cold_start_', n, 'rps_99')",
         "concat('modelfeaturetradeoff_x_lr_', n, 'rps_1')", "concat('Other-', n)"]


@query("short_run_label", sql="""
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'pass-through '||n||' rps' WHEN 1 THEN 'RF-Full '||n||' rps' WHEN 2 THEN 'RF-17 '||n||' rps'
  WHEN 3 THEN 'cold_start_'||n||'rps' WHEN 4 THEN 'modelfeaturetradeoff_x_lr_'||n||'rps_1' ELSE 'Other-'||n END AS label
FROM (SELECT event_id, k::INT AS n FROM flows)""")
def short_run_label(spark, sf):
    tag = F.expr("case event_id % 6 " + " ".join(f"when {i} then {t}" for i, t in enumerate(_TAGS)) + " end")
    rows = views.flows(spark, sf).selectExpr("event_id", "cast(cast(k as int) as string) as n").withColumn("tag", tag)
    return rows.select("event_id", text.short_run_label(F.col("tag")).alias("label"))


_CODES = {
    "mode": ["pass_through", "random_forest_full", "gradient_boost_2x", None],
    "profile": ["runtime_sensitivity_balanced_1s_1000offsets", "runtime_candidate_batch_2s_2000offsets", "runtime_candidate_other", None],
    "scenario": ["cold_start_300rps", "spark_process_crash_500rps", "disk_full", None],
    "model": ["random_forest", "logistic_regression", "my_net", None],
    "split": ["calibration", "test_rare_web", "train_fit", None],
}


@query("display_labels", sql="""
SELECT event_id, (['Đi qua', 'RF-Full', 'Gradient Boost 2X', ''])[i] AS mode, (['1 s / 1000', '2 s / 2000', 'other', ''])[i] AS profile,
  (['Khởi động 300', 'Lỗi Spark 500', 'disk full', ''])[i] AS scenario,
  CASE WHEN i = 1 AND event_id % 3 = 0 THEN 'RF-17' ELSE (['RF-Full', 'LR-Full', 'My Net', ''])[i] END AS model,
  (['Hiệu chỉnh', 'Test Web hiếm', 'train fit', ''])[i] AS split FROM (SELECT event_id, event_id % 4 + 1 AS i FROM events)""")
def display_labels(spark, sf):
    code = {c: F.get(F.array(*[F.lit(v) for v in vs]), F.expr("cast(event_id % 4 as int)")) for c, vs in _CODES.items()}
    return views.flows(spark, sf).select(
        "event_id", text.mode_label(code["mode"]).alias("mode"), text.profile_label(code["profile"]).alias("profile"),
        text.scenario_label(code["scenario"]).alias("scenario"),
        text.model_label(code["model"], F.col("event_id") % 3 == 0).alias("model"), text.split_label(code["split"]).alias("split"),
    )


@query("run_label", sql="""
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'Đi qua' WHEN event_id % 3 = 0 THEN 'cand' WHEN event_id % 5 = 0 THEN 'sc' ELSE 'run'||(event_id % 5) END AS label FROM events""")
def run_label(spark, sf):
    rows = views.preds(spark, sf).selectExpr(
        "event_id", "if(event_id % 2 = 0, 'pass_through', null) as mode", "if(event_id % 3 = 0, 'cand', null) as candidate_label",
        "if(event_id % 5 = 0, 'sc', null) as scenario", "run_tag",
    )
    return rows.select("event_id", text.run_label(rows.columns).alias("label"))


@query("first_numeric", sql="SELECT event_id, copy, coalesce(byts_num, pkts_num) AS first FROM checked")
def first_numeric(spark, sf):
    rows = views.dirty(spark, sf)
    rows = rows.withColumn("byts", values.sanitize_number(F.col("byts")))
    return rows.select("event_id", "copy", values.first_numeric(rows, "byts", "pkts").alias("first"))


@query("numeric_or_null", sql="""
SELECT event_id, copy, CASE WHEN NOT isnan(try_cast(trim(byts) AS DOUBLE)) THEN try_cast(trim(byts) AS DOUBLE) END AS byts, NULL::DOUBLE AS absent FROM dirty""")
def numeric_or_null(spark, sf):
    rows = views.dirty(spark, sf)
    return rows.select("event_id", "copy", values.numeric_or_null(rows, "byts").alias("byts"), values.numeric_or_null(rows, "gone").alias("absent"))


@query("normalize_phase", sql="""
SELECT event_id, CASE WHEN lower(trim(p)) IN ('warmup', 'cold_start', 'pre_fault', 'post_fault') THEN lower(trim(p)) ELSE 'measure' END AS collector_phase,
  lower(coalesce(p, 'measure')) AS metric_phase FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN ' Pre_Fault ' WHEN event_id % 13 = 0 THEN 'odd' ELSE benchmark_phase END AS p FROM preds)""")
def normalize_phase(spark, sf):
    p = F.expr("case when event_id % 7 = 0 then ' Pre_Fault ' when event_id % 13 = 0 then 'odd' else benchmark_phase end")
    return views.preds(spark, sf).select(
        "event_id", values.collector_phase(p).alias("collector_phase"), values.metric_phase(p).alias("metric_phase")
    )


@query("select_feature_set", sql="SELECT label, value AS \"Flow Byts/s\", k AS \"Tot Fwd Pkts\" FROM flows")
def select_feature_set(spark, sf):
    from flowlib.sources.tables import select_features

    rows = views.flows(spark, sf).withColumnsRenamed({"value": "Flow Byts/s", "k": "Tot Fwd Pkts"})
    features = [f for f in FULL_FEATURES if f in rows.columns]
    return select_features(rows, features, keep=("label",))
