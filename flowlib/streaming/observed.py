"""Metrics observed inside micro-batches: rows and highest offset per partition, and the backlog series made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

METRICS = "batch_metrics"


def with_batch_metrics(records: DataFrame, partitions: list[int]) -> DataFrame:
    """The same records; each batch reports rows and highest offset of every partition with its progress.

    They are counted where the records pass by, without a job or a shuffle of their own: two numbers a partition.
    """
    metrics = []
    for p in partitions:
        mine = F.col("kafka_partition") == p
        metrics += [F.count_if(mine).alias(f"rows_{p}"), F.max(F.when(mine, F.col("kafka_offset"))).alias(f"top_{p}")]
    return records.observe(METRICS, *metrics)


def lag_series(progress: DataFrame, watermarks: DataFrame) -> DataFrame:
    """batch_id, kafka_partition, rows, processed_offset_max and lag_records after every logged batch.

    ``watermarks`` has ``kafka_partition`` and ``high``, the offset behind the last record.
    """
    kind = "map<string,map<string,bigint>>"
    entries = F.map_entries(F.from_json("observed", kind)[METRICS])
    cells = progress.where("input_rows > 0").select("batch_id", F.explode(entries).alias("_e"))
    name = F.split(F.col("_e.key"), "_")
    rows = cells.select("batch_id", name[0].alias("_name"), name[1].cast("int").alias("kafka_partition"), F.col("_e.value").alias("_v"))
    value = {n: F.max(F.when(F.col("_name") == n, F.col("_v"))) for n in ("rows", "top")}
    seen = rows.groupBy("batch_id", "kafka_partition").agg(F.coalesce(value["rows"], F.lit(0)).alias("rows"), value["top"].alias("_top"))
    top = F.max("_top").over(Window.partitionBy("kafka_partition").orderBy("batch_id"))
    placed = seen.withColumn("processed_offset_max", top).join(watermarks, "kafka_partition")
    lag = F.col("high") - 1 - F.coalesce("processed_offset_max", F.lit(-1))
    return placed.select("batch_id", "kafka_partition", "rows", "processed_offset_max", lag.alias("lag_records"))
