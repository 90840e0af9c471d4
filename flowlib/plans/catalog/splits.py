"""Split queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlib.operators import split
from flowlib.plans import views
from flowlib.plans.registry import query
from flowlib.scratch import new_path
from flowlib.sources.lookups import day_roles
from flowlib.sources.tables import scan_modeling_split

# Roles of the shared event days; 2024-01-25 and later are unknown days.
ROLES = {
    **{f"{views.EVENT_MONTH}-{d:02d}": "train_pool" for d in range(1, 19)},
    "2024-01-19": "test_rare_web",
    **{f"{views.EVENT_MONTH}-{d:02d}": "test_seen_temporal" for d in range(20, 23)},
    **{f"{views.EVENT_MONTH}-{d:02d}": "test_unseen_family" for d in range(23, 25)},
}
FEATURES = ["value", "k"]


def _assigned(spark, sf):
    return split.assign_splits(views.flows(spark, sf), day_roles(spark, ROLES), F.col("flow_id"), "event_time")


_ASSIGNED = """
SELECT *, CASE WHEN d <= 18 THEN CASE WHEN b < 7000 THEN 'train_fit' WHEN b < 8500 THEN 'feature_select' ELSE 'calibration' END
  WHEN d = 19 THEN 'test_rare_web' WHEN d <= 22 THEN 'test_seen_temporal' WHEN d <= 24 THEN 'test_unseen_family' END AS split
FROM (SELECT *, day(event_time) AS d, ('0x'||substr(md5(flow_id), 1, 8))::BIGINT % 10000 AS b FROM flows)"""
_COMBINED = f"""
SELECT * FROM ({_ASSIGNED}) AS x WHERE split IS NOT NULL
UNION ALL SELECT * REPLACE ('test' AS split) FROM ({_ASSIGNED}) AS y WHERE split IN ('test_seen_temporal', 'test_unseen_family')"""


@query("hash_split", sql="""
SELECT split, count(*) AS rows, sum(l_linenumber)::BIGINT AS lines FROM (SELECT l_linenumber,
  CASE WHEN b < 7000 THEN 'train_fit' WHEN b < 8500 THEN 'feature_select' ELSE 'calibration' END AS split
  FROM (SELECT *, ('0x'||substr(md5(content_key), 1, 8))::BIGINT % 10000 AS b FROM flows_li)) GROUP BY 1""")
def hash_split(spark, sf):
    rows = views.flows_li(spark, sf).withColumn("split", split.pool_split(views.content_key()))
    return rows.groupBy("split").agg(F.count("*").alias("rows"), F.sum("l_linenumber").alias("lines"))


@query("hash_split_fast", sql="""
SELECT count(*) AS rows, sum(l_linenumber)::BIGINT AS lines, 3::BIGINT AS splits, true AS near_shares FROM flows_li""")
def hash_split_fast(spark, sf):
    """Spark's own 64-bit hash: no row is lost, and each split is within five standard errors of its share."""
    rows = views.flows_li(spark, sf)
    parts = rows.withColumn("split", split.pool_split_fast(*rows.columns)).groupBy("split").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("l"))
    shares = parts.withColumn("share", F.expr("case split when 'train_fit' then 0.7D else 0.15D end")).agg(
        F.sum("n").alias("rows"), F.sum("l").alias("lines"), F.count("*").alias("splits"), F.collect_list(F.struct("n", "share")).alias("parts")
    )
    near = F.forall("parts", lambda p: F.abs(p["n"] - p["share"] * F.col("rows")) <= 5 * F.sqrt(F.col("rows") * p["share"] * (1 - p["share"])))
    return shares.select("rows", "lines", "splits", near.alias("near_shares"))


@query("temporal_split", sql=f"SELECT flow_id, split FROM ({_ASSIGNED}) AS a")
def temporal_split(spark, sf):
    return _assigned(spark, sf).select("flow_id", "split")


@query("skipped_rows", sql=f"SELECT count(*) AS rows_total, count(*) FILTER (split IS NULL) AS rows_skipped FROM ({_ASSIGNED}) AS a")
def skipped_rows(spark, sf):
    return split.skipped_rows(_assigned(spark, sf))


@query("union_test_splits", sql=f"SELECT flow_id, split FROM ({_COMBINED}) AS a")
def union_test_splits(spark, sf):
    return split.with_combined_test(_assigned(spark, sf)).select("flow_id", "split")


@query("day_profile", sql="""
SELECT strftime(event_time, '%Y-%m-%d') AS day, count(*) AS rows, sum(label_binary)::BIGINT AS attack_rows,
  round(sum(label_binary) * 100.0::DOUBLE / count(*), 4) AS attack_pct,
  CASE WHEN any_value(day(event_time)) <= 18 THEN 'train_pool' WHEN any_value(day(event_time)) = 19 THEN 'test_rare_web'
    WHEN any_value(day(event_time)) <= 22 THEN 'test_seen_temporal' WHEN any_value(day(event_time)) <= 24 THEN 'test_unseen_family' END AS role
FROM flows GROUP BY 1""")
def day_profile(spark, sf):
    profile = split.day_profile(views.flows(spark, sf), day_roles(spark, ROLES), "event_time")
    return profile.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("split_metadata", sql=f"""
WITH c AS ({_COMBINED}), t AS (SELECT split, count(*) AS n, min(event_time) AS a, max(event_time) AS b FROM c GROUP BY 1)
SELECT split, 'rows' AS item, '' AS name, n AS count, NULL::DOUBLE AS ratio FROM t
UNION ALL SELECT split, 'min_epoch_ms', '', epoch_us(a) // 1000, NULL FROM t
UNION ALL SELECT split, 'max_epoch_ms', '', epoch_us(b) // 1000, NULL FROM t
UNION ALL SELECT split, 'class', label_binary::VARCHAR, count(*), round(count(*) / any_value(n), 6) FROM c JOIN t USING (split) GROUP BY split, label_binary
UNION ALL SELECT split, 'family', label, count(*), NULL FROM c WHERE label_binary = 1 GROUP BY split, label""")
def split_metadata(spark, sf):
    return split.split_metadata(split.with_combined_test(_assigned(spark, sf)), "event_time")


@query("split_rows", sql=f"SELECT split, count(*) AS rows, min(event_time) AS min_ts, max(event_time) AS max_ts FROM ({_COMBINED}) AS c GROUP BY 1")
def split_rows(spark, sf):
    return split.split_rows(split.with_combined_test(_assigned(spark, sf)), "event_time")


@query("split_classes", sql=f"""
SELECT split, label_binary, count(*) AS count, round(count(*) / sum(count(*)) OVER (PARTITION BY split)::DOUBLE, 6) AS ratio
FROM ({_COMBINED}) AS c GROUP BY 1, 2""")
def split_classes(spark, sf):
    return split.split_classes(split.with_combined_test(_assigned(spark, sf)), "event_time")


@query("split_families", sql="""
SELECT source_file AS split, label, count(*) AS count, row_number() OVER (PARTITION BY source_file ORDER BY count(*) DESC, label)::INT AS rank
FROM flows_li WHERE label <> 'N' GROUP BY 1, 2""")
def split_families(spark, sf):
    rows = views.flows_li(spark, sf).withColumns({"split": F.col("source_file"), "label_binary": F.expr("cast(label <> 'N' as int)")})
    return split.split_families(rows, "event_time")


@query("scan_modeling_split", sql=f"SELECT value, k, label_binary, label FROM ({_ASSIGNED}) AS a WHERE split = 'calibration'")
def scan_modeling(spark, sf):
    path = new_path(spark, "splits")
    split.write_splits(_assigned(spark, sf).where("split is not null"), path)
    return scan_modeling_split(spark, path, "calibration", FEATURES, attack_label="label")
