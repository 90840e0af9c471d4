"""Inputs and predictions stored in buckets of (partition, offset), so that labels are joined again and again without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlib.operators.labels import OFFSET_KEYS

BUCKETS = 64


def store_by_offset(df: DataFrame, table: str, path: str, buckets: int = BUCKETS) -> None:
    """Store ``df`` as the table ``table`` below ``path``: one sorted file per bucket of (partition, offset).

    Rows without a partition or an offset match nothing and would all share a bucket; they are kept apart in ``table_unplaced``.
    Choose ``buckets`` so that one holds a few hundred MB; tables that are joined need the same number.
    """
    placed = F.col("kafka_partition").isNotNull() & F.col("kafka_offset").isNotNull()
    spread = df.where(placed).repartition(buckets, *OFFSET_KEYS)
    spread.write.mode("overwrite").bucketBy(buckets, *OFFSET_KEYS).sortBy(*OFFSET_KEYS).option("path", f"{path}/placed").saveAsTable(table)
    df.where(~placed).write.mode("overwrite").option("path", f"{path}/unplaced").saveAsTable(f"{table}_unplaced")


def join_labels_stored(spark: SparkSession, preds: str, inputs: str) -> DataFrame:
    """Every prediction of the stored table ``preds`` with the label of its record in ``inputs``, null where there is none.

    Both sides are read bucket by bucket in their order: the merge join has no exchange on either side.
    """
    labels = spark.table(inputs)
    if "is_control_record" in labels.columns:
        labels = labels.where(F.coalesce("is_control_record", F.lit(0)) == 0)
    labels = labels.select(*OFFSET_KEYS, "label_binary", "label")
    placed, unplaced = (spark.table(t).drop("label_binary", "label") for t in (preds, f"{preds}_unplaced"))
    joined = placed.hint("merge").join(labels.hint("merge"), OFFSET_KEYS, "left").select(*placed.columns, "label_binary", "label")
    bare = unplaced.withColumns({c: F.lit(None).cast(kind) for c, kind in labels.dtypes if c not in OFFSET_KEYS})
    return joined.unionByName(bare)


def needed_inputs_stored(spark: SparkSession, preds: str, inputs: str) -> DataFrame:
    """Input records of the stored table that some prediction needs, without control records and without a shuffle."""
    rows = spark.table(inputs)
    if "is_control_record" in rows.columns:
        rows = rows.where(F.coalesce("is_control_record", F.lit(0)) == 0)
    return rows.hint("merge").join(spark.table(preds).select(*OFFSET_KEYS).hint("merge"), OFFSET_KEYS, "left_semi")
