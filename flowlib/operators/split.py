"""Train, calibration and test sets by day and by row content, and their profile tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlib.functions.values import content_bucket
from flowlib.scratch import small_side

# Shares of the training pool.
HASH_BUCKETS = 10_000
TRAIN_FIT_CUTOFF = 7_000
FEATURE_SELECT_CUTOFF = 8_500
TRAIN_POOL = "train_pool"
TEST_SPLITS = ("test_seen_temporal", "test_unseen_family", "test_rare_web")
COMBINED_TEST = ("test_seen_temporal", "test_unseen_family")


def pool_split(key: Column) -> Column:
    """70/15/15 split name from a text key of the row's content; the same row always lands in the same split."""
    return split_of_bucket(content_bucket(key, HASH_BUCKETS))


def pool_split_fast(*columns: str | Column) -> Column:
    """As :func:`pool_split` from the columns' 64-bit hash: no text is built, but only Spark can repeat it."""
    return split_of_bucket(F.pmod(F.xxhash64(*columns), F.lit(HASH_BUCKETS)))


def split_of_bucket(bucket: Column) -> Column:
    return (
        F.when(bucket < TRAIN_FIT_CUTOFF, F.lit("train_fit"))
        .when(bucket < FEATURE_SELECT_CUTOFF, F.lit("feature_select"))
        .otherwise(F.lit("calibration"))
    )


def with_day_role(df: DataFrame, roles: DataFrame, timestamp: str = "timestamp") -> DataFrame:
    """Add ``role`` of the row's calendar day (null for an unknown day)."""
    days = roles.select(F.col("day").alias("_day"), "role")
    return df.join(days, F.to_date(timestamp) == F.col("_day"), "left").drop("_day")


def assign_splits(df: DataFrame, roles: DataFrame, key: Column, timestamp: str = "timestamp") -> DataFrame:
    """Add ``split``; rows of unknown days are kept with a null split so that they can be counted."""
    placed = with_day_role(df, roles, timestamp)
    split = F.when(F.col("role") == TRAIN_POOL, pool_split(key)).otherwise(F.col("role"))
    return placed.withColumn("split", split).drop("role")


def with_combined_test(df: DataFrame) -> DataFrame:
    """Rows of the two main test splits a second time under ``test``; rows without a split are dropped."""
    names = F.when(F.col("split").isin(*COMBINED_TEST), F.array(F.col("split"), F.lit("test"))).otherwise(F.array("split"))
    others = [F.col(f"`{c}`") for c in df.columns if c != "split"]
    return df.where("split is not null").select(*others, F.explode(names).alias("split"))


def write_splits(df: DataFrame, path: str) -> None:
    """One table partitioned by ``split``, so that reading one split touches only its files."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def skipped_rows(df: DataFrame) -> DataFrame:
    """Total rows and rows of unknown days."""
    return df.agg(F.count("*").alias("rows_total"), F.count_if(F.col("split").isNull()).alias("rows_skipped"))


def day_profile(df: DataFrame, roles: DataFrame, timestamp: str = "timestamp", label: str = "label_binary") -> DataFrame:
    """Rows, attack rows, attack percentage and role of each day."""
    days = df.groupBy(F.to_date(timestamp).alias("day")).agg(
        F.count("*").alias("rows"), F.sum(F.col(label).cast("long")).alias("attack_rows")
    )
    pct = F.round(F.col("attack_rows") * 100.0 / F.col("rows"), 4)
    return days.withColumn("attack_pct", pct).join(roles, "day", "left")


def _cells(df: DataFrame, timestamp: str) -> DataFrame:
    """One row per (split, class, label): all split profiles are sums over this small table."""
    return df.groupBy("split", "label_binary", "label").agg(
        F.count("*").alias("rows"), F.min(timestamp).alias("min_ts"), F.max(timestamp).alias("max_ts")
    )


def split_rows(df: DataFrame, timestamp: str = "timestamp") -> DataFrame:
    """Rows and time range of each split."""
    return _cells(df, timestamp).groupBy("split").agg(
        F.sum("rows").alias("rows"), F.min("min_ts").alias("min_ts"), F.max("max_ts").alias("max_ts")
    )


def split_classes(df: DataFrame, timestamp: str = "timestamp") -> DataFrame:
    """Count and share (6 decimals) of each class per split."""
    classes = _cells(df, timestamp).groupBy("split", "label_binary").agg(F.sum("rows").alias("count"))
    share = F.expr("round(count / greatest(sum(count) over (partition by split), 1), 6)")
    return classes.withColumn("ratio", share)


def split_families(df: DataFrame, timestamp: str = "timestamp") -> DataFrame:
    """Attack rows per label and split, with the label's rank by falling count."""
    cells = _cells(df, timestamp).where("label_binary = 1")
    return cells.groupBy("split", "label").agg(F.sum("rows").alias("count")).withColumn(
        "rank", F.expr("row_number() over (partition by split order by count desc, label)")
    )


def split_metadata(df: DataFrame, timestamp: str = "timestamp") -> DataFrame:
    """All split profiles as one long table ``(split, item, name, count, ratio)`` from a single pass."""
    cells = small_side(_cells(df, timestamp), "split-cells")
    totals = cells.groupBy("split").agg(
        F.sum("rows").alias("_total"), F.unix_millis(F.min("min_ts")).alias("_min"), F.unix_millis(F.max("max_ts")).alias("_max")
    )
    ranges = totals.selectExpr(
        "split", "stack(3, 'rows', '', _total, 'min_epoch_ms', '', _min, 'max_epoch_ms', '', _max) as (item, name, count)"
    )
    classes = cells.groupBy("split", F.lit("class").alias("item"), F.col("label_binary").cast("string").alias("name")).agg(F.sum("rows").alias("count"))
    families = cells.where("label_binary = 1").groupBy("split", F.lit("family").alias("item"), F.col("label").alias("name")).agg(F.sum("rows").alias("count"))
    share = F.when(F.col("item") == "class", F.round(F.col("count") / F.greatest(F.col("_total"), F.lit(1)), 6))
    return (
        ranges.unionByName(classes).unionByName(families)
        .join(totals.select("split", "_total"), "split")
        .select("split", "item", "name", "count", share.alias("ratio"))
    )
