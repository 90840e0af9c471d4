"""Physical plans of the operators that must hold at any size."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from flowlib.operators import clean, labels, quality, split
from flowlib.operators.ordered import with_row_number
from flowlib.operators.percentiles import exact_percentiles
from flowlib.operators.threshold import roc_auc
from flowlib.plans import views
from flowlib.sources.lookups import day_roles, label_mapping

SF = "/root/testdata/sf0.01"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return re.findall(r"Exchange (\w+)", plan(df))


def test_metrics_read_only_their_columns(spark):
    df = quality.prediction_quality(views.preds(spark, SF))
    read = re.findall(r"ReadSchema: struct<([^>]*)>", plan(df))
    assert len(read) == 1 and "props" not in read[0] and "user_id" not in read[0]
    assert exchanges(df) == ["hashpartitioning"]


def test_day_filter_reaches_the_scan(spark):
    df = views.flows(spark, SF).where("event_type = 'error'") if "event_type" in views.flows(spark, SF).columns else views.flows(spark, SF).where("label = 'error'")
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,error)]" in plan(df)


def test_lookups_are_broadcast_and_rows_stay_put(spark):
    flows = views.flows(spark, SF)
    splits = split.assign_splits(flows, day_roles(spark), F.col("flow_id"), "event_time")
    assert "BroadcastHashJoin" in plan(splits) and set(exchanges(splits)) <= {"HashedRelationBroadcastMode"}
    named = clean.normalize_labels(flows, label_mapping(spark))
    assert "BroadcastHashJoin" in plan(named) and "hashpartitioning" not in plan(named)


def test_split_metadata_combines_before_the_shuffle(spark):
    rows = split.assign_splits(views.flows(spark, SF), day_roles(spark), F.col("flow_id"), "event_time").where("split is not null")
    text = plan(split.split_rows(rows, "event_time"))
    first = text.rindex("partial_count(1)")
    assert "Exchange" not in text[first:].split("FileScan")[0].replace("BroadcastExchange", "")
    # All profiles of the metadata read the small stored table, not the rows.
    assert "event_type" not in plan(split.split_metadata(rows, "event_time"))


def test_row_numbers_broadcast_chunks_only(spark):
    df = with_row_number(views.flows(spark, SF), ["kafka_partition"], ["event_time", "event_id"])
    assert "BroadcastHashJoin" in plan(df) and "hashpartitioning" not in plan(df) and "SinglePartition" not in plan(df)


def test_selected_percentiles_never_gather_a_group(spark):
    df = exact_percentiles(views.preds(spark, SF), ["run_tag"], {"p": ("end_to_end_ms", 0.95)})
    text = plan(df)
    assert "percentile(" not in text and "collect_list" not in text and "ObjectHashAggregate" not in text
    # Values are only counted by buckets: no range partition, and no window over values.
    assert "rangepartitioning" not in text and "SinglePartition" not in text and "_v#" not in text.split("Window", 1)[0]
    assert not re.findall(r"Window \[[^\]]*\], \[[^\]]*\], \[_v", text)


def test_scores_are_ordered_inside_chunks(spark):
    text = plan(roc_auc(views.scored(spark, SF), ["model"]))
    ordered = re.findall(r"Window \[.*?\], \[([^\]]*)\], \[([^\]]*)\]", text)
    assert ordered and all("_at" in keys and order.startswith("_position") for keys, order in ordered)


def test_label_join_is_one_equi_join(spark):
    flows = views.flows(spark, SF, offsets=True)
    text = plan(labels.join_labels_by_offset(views.preds(spark, SF, offsets=True), flows))
    assert "NestedLoop" not in text and text.count("Join") >= 1
