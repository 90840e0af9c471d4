from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from flowlib.operators import clean, split
from flowlib.sources import flow_csv, lookups, tables
from tests.conftest import rows

CAPTURE_1 = """ Timestamp ,Label,Flow Byts/s,Zeta
14/02/2018 08:31:01,Benign,12.5,1
2018-02-15 09:00:00, DoS attacks-Hulk ,Infinity,1
2018-02-15 09:00:00, DoS attacks-Hulk ,Infinity,1
1/3/2018 8:05:09,Infilteration,NaN,1
14/02/2018 08:31:02,BENIGN,1,1
14/02/2018 08:31:03,New Attack!!,x,1
Timestamp,Label,Flow Byts/s,Zeta
01/01/1970 00:00:00,Benign,1,1
14/02/2018 08:31:04,nan,1,1
14/02/2018 08:31:05,,1,1
"""
CAPTURE_2 = "LABEL,timestamp, Flow Byts/s,Alpha\nBenign,14/02/2018 08:31:01,12.5,7\nCaf\xe9,14/02/2018 08:31:06,2,7\n"


@pytest.fixture(scope="module")
def raw_dir(tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    (root / "day-1.csv").write_text(CAPTURE_1, encoding="utf-8")
    (root / "day 2+.csv").write_bytes(CAPTURE_2.encode("latin1"))
    return str(root)


@pytest.fixture(scope="module")
def mapping(spark):
    return lookups.label_mapping(spark)


def test_scan_reads_layouts_by_name_and_latin1(spark, raw_dir):
    raw = flow_csv.scan_flow_csv(spark, raw_dir)
    assert set(raw.columns) == {"timestamp", "label", "Flow Byts/s", "Zeta", "Alpha", "source_file"}
    second = raw.where("source_file = 'day 2+.csv'").select("label", "Alpha", "Zeta")
    assert rows(second, "label") == [("Benign", "7", None), ("Café", "7", None)]


def test_scan_needs_the_two_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Timestamp,x\n1,2\n")
    with pytest.raises(ValueError, match="label"):
        flow_csv.scan_flow_csv(spark, str(tmp_path))


def test_scan_of_nothing(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        flow_csv.scan_flow_csv(spark, str(tmp_path))


def test_parts_of_one_capture_share_its_header(spark, tmp_path):
    (tmp_path / "c.csv").mkdir()
    (tmp_path / "c.csv" / "part-0.csv").write_text("Timestamp,Label,a\n14/02/2018 08:31:01,Benign,1\n")
    (tmp_path / "c.csv" / "part-1.csv").write_text("Timestamp,Label,b\n14/02/2018 08:31:01,Benign,1\n")
    with pytest.raises(Exception, match="(?i)header|schema"):
        flow_csv.scan_flow_csv(spark, str(tmp_path)).collect()


def test_jobs_do_not_grow_with_files(spark, tmp_path):
    counts = []
    for n in (40, 80):
        folder = tmp_path / f"files-{n}"
        folder.mkdir()
        for i in range(n):
            (folder / f"day-{i:02}.csv").write_text(f"\nTimestamp,Label,x\n14/02/2018 08:31:01,Benign,{i}\n")
        spark.sparkContext.setJobGroup(f"scan-{n}", "scan")
        raw = flow_csv.scan_flow_csv(spark, str(folder))
        counts.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"scan-{n}")))
        assert raw.count() == n and raw.select("source_file").distinct().count() == n
    assert counts[0] == counts[1]


def test_clean_rows(spark, raw_dir, mapping):
    got = clean.clean_flows(flow_csv.scan_flow_csv(spark, raw_dir), mapping)
    assert got.columns == ["timestamp", "label", "label_norm", "label_binary", "Alpha", "Flow Byts/s", "Zeta", "source_file"]
    day = dt.datetime(2018, 2, 14, 8, 31, 1)
    assert rows(got.select("timestamp", "label", "label_norm", "label_binary", "Flow Byts/s", "source_file"), "timestamp", "source_file") == [
        (day, "Benign", "benign", 0, 12.5, "day 2+.csv"),
        (day, "Benign", "benign", 0, 12.5, "day-1.csv"),
        (day.replace(second=2), "BENIGN", "benign", 0, 1.0, "day-1.csv"),
        (day.replace(second=3), "New Attack!!", "new_attack", 1, None, "day-1.csv"),
        (day.replace(second=6), "Café", "caf", 1, 2.0, "day 2+.csv"),
        (dt.datetime(2018, 2, 15, 9), "DoS attacks-Hulk", "dos_attacks_hulk", 1, None, "day-1.csv"),
        (dt.datetime(2018, 3, 1, 8, 5, 9), "Infilteration", "infiltration", 1, None, "day-1.csv"),
    ]


def test_cleaning_stats_count_in_order(spark, raw_dir, mapping):
    stats = clean.cleaning_stats(flow_csv.scan_flow_csv(spark, raw_dir), mapping)
    got = {r.source_file: (r.rows_raw, r.rows_kept, r.dropped_timestamp, r.dropped_null_label, r.dropped_duplicates, r.unmapped_labels) for r in stats.collect()}
    assert got == {"day-1.csv": (10, 5, 2, 2, 1, 2), "day 2+.csv": (2, 2, 0, 0, 0, 1), "*": (12, 7, 2, 2, 1, 3)}


def test_unmapped_labels(spark, raw_dir, mapping):
    raw = flow_csv.scan_flow_csv(spark, raw_dir)
    assert rows(clean.unmapped_labels(raw.where("timestamp like '14/%'"), mapping), "label") == [("BENIGN", 1), ("Café", 1), ("New Attack!!", 1)]


@pytest.mark.parametrize("compact", [False, True])
def test_silver_is_partitioned_by_day(spark, raw_dir, mapping, tmp_path, compact):
    path = str(tmp_path / "silver")
    flow_csv.write_silver(clean.clean_flows(flow_csv.scan_flow_csv(spark, raw_dir), mapping), path, compact)
    back = flow_csv.read_silver(spark, path)
    assert back.count() == 7
    one_day = back.where("day = date'2018-02-15'")
    assert one_day.count() == 1
    assert "PartitionFilters: [isnotnull(day" in one_day._jdf.queryExecution().executedPlan().toString()


def test_lookups_reject_empty():
    with pytest.raises(ValueError):
        lookups.clean_mapping({" ": "x", "a": ""})
    with pytest.raises(ValueError):
        lookups.feature_list(["", "  "])
    assert lookups.clean_mapping({" a ": " b "}) == {"a": "b"}
    assert len(lookups.FULL_FEATURES) == len(set(lookups.FULL_FEATURES)) == 78
    assert set(lookups.REDUCED_FEATURES) <= set(lookups.FULL_FEATURES) and len(lookups.REDUCED_FEATURES) == 9


def _pool(spark, n=4000):
    days = ["2018-02-14", "2018-02-23", "2018-03-01", "2018-03-02", "2018-02-17"]
    cells = F.element_at(F.array(*[F.lit(d) for d in days]), F.expr("cast(case when id < 3000 then 1 else id % 5 + 1 end as int)"))
    return spark.range(n).select(
        "id", F.to_timestamp(cells).alias("timestamp"), F.expr("if(id % 3 = 0, 'Bot', 'Benign')").alias("label"), F.expr("cast(id % 3 = 0 as int)").alias("label_binary")
    )


def test_splits_are_disjoint_and_complete(spark):
    df = _pool(spark)
    got = split.assign_splits(df, lookups.day_roles(spark), F.col("id").cast("string"))
    assert got.count() == 4000 and got.select("id").distinct().count() == 4000
    counts = {r.split: r["count"] for r in got.groupBy("split").count().collect()}
    pool = counts["train_fit"] + counts["feature_select"] + counts["calibration"]
    assert counts[None] == 200 and pool == 3200
    assert abs(counts["train_fit"] / pool - 0.70) < 0.03 and abs(counts["calibration"] / pool - 0.15) < 0.03
    assert rows(split.skipped_rows(got)) == [(4000, 200)]
    again = split.assign_splits(df.repartition(7), lookups.day_roles(spark), F.col("id").cast("string"))
    assert got.exceptAll(again).count() == 0


def test_combined_test_and_profiles(spark):
    got = split.with_combined_test(split.assign_splits(_pool(spark), lookups.day_roles(spark), F.col("id").cast("string")))
    sizes = {r.split: r.rows for r in split.split_rows(got).collect()}
    assert sizes["test"] == sizes["test_seen_temporal"] + sizes["test_unseen_family"]
    assert sum(r.ratio for r in split.split_classes(got).where("split = 'test'").collect()) == pytest.approx(1.0)
    family = split.split_families(got).where("split = 'test'").collect()
    assert [(r.label, r.rank) for r in family] == [("Bot", 1)]
    meta = {(r.item, r.name): r["count"] for r in split.split_metadata(got).where("split = 'test'").collect()}
    assert meta[("rows", "")] == sizes["test"] and meta[("family", "Bot")] == family[0]["count"]
    profile = {str(r.day): (r.rows, r.role) for r in split.day_profile(_pool(spark), lookups.day_roles(spark)).collect()}
    assert profile["2018-02-17"] == (200, None) and profile["2018-02-14"] == (3200, "train_pool")


def test_split_scan_prunes_files_and_columns(spark, tmp_path):
    path = str(tmp_path / "splits")
    got = split.assign_splits(_pool(spark), lookups.day_roles(spark), F.col("id").cast("string")).where("split is not null")
    split.write_splits(got.withColumn("f", F.col("id").cast("float")), path)
    one = tables.scan_modeling_split(spark, path, "calibration", ["f"], attack_label="label")
    assert dict(one.dtypes) == {"f": "double", "label_binary": "int", "label": "string"}
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert " = calibration)], PushedFilters" in plan and "timestamp" not in plan.split("ReadSchema")[1]
    with pytest.raises(ValueError, match="missing"):
        tables.scan_modeling_split(spark, path, "calibration", ["f", "gone"])


def test_artifact_layout(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "flow_id string, kafka_offset int")
    tables.write_prediction_artifact(df, str(tmp_path / "a"))
    back = spark.read.parquet(str(tmp_path / "a"))
    assert back.columns == list(tables.ARTIFACT_COLUMNS) and dict(back.dtypes)["kafka_offset"] == "bigint"
    assert back.first().label is None


def test_latest_file_and_manifest(spark, tmp_path):
    for i in range(3):
        spark.range(i + 1).coalesce(1).write.mode("append").parquet(str(tmp_path / "m"))
    manifest = tables.input_manifest(spark, {"m": str(tmp_path / "m")})
    assert sorted(r.rows for r in manifest.collect()) == [1, 2, 3]
    newest = tables.latest_file(manifest).first()
    best = max(manifest.collect(), key=lambda r: (r.modified, r.path))
    assert (newest.path, newest.modified) == (best.path, best.modified)


def test_fast_split_has_the_same_shares_and_repeats(spark):
    df = spark.range(20_000).withColumn("s", split.pool_split_fast("id"))
    counts = {r.s: r["count"] for r in df.groupBy("s").count().collect()}
    assert abs(counts["train_fit"] / 20_000 - 0.70) < 0.02 and abs(counts["feature_select"] / 20_000 - 0.15) < 0.02
    assert df.exceptAll(spark.range(20_000).repartition(9).withColumn("s", split.pool_split_fast("id"))).count() == 0
