"""Captures taken up as they come: cleaned batch by batch into silver, with a manifest of what has been taken.

Each batch of new files is one stored part of silver and one of the manifest, both under the batch's number. A batch that
failed half way is tried again under the same number with the same files and replaces what it had written, so rows are neither repeated
nor lost. A file that the manifest knows by path, length and time is left out even by a stream that starts anew; one that has changed
since is an error, as its old rows are in silver already. Duplicates are dropped inside a capture, so all parts of a
capture must come in one batch: move finished captures into the folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlib.operators import clean
from flowlib.scratch import stored
from flowlib.sources import flow_csv
from flowlib.streaming import runs

MANIFEST_SCHEMA = "path string, length bigint, modificationTime timestamp, batch_id bigint"
#: Files of one batch at most: their names are what reaches the driver.
MAX_FILES = 10_000


def read_manifest(spark: SparkSession, silver: str) -> DataFrame:
    """Files taken so far: path, length, time and batch."""
    if not runs.checkpoint_present(spark, f"{silver}/manifest"):
        return spark.createDataFrame([], MANIFEST_SCHEMA)
    return spark.read.schema(MANIFEST_SCHEMA).parquet(f"{silver}/manifest")


def read_taken(spark: SparkSession, silver: str) -> DataFrame:
    """Silver rows of all batches; a column that some captures lack is null there."""
    return spark.read.option("mergeSchema", "true").parquet(f"{silver}/rows").drop("batch_id", "day")


def take_captures(
    spark: SparkSession, folder: str, silver: str, checkpoint: str, mapping: DataFrame, encoding: str | None = None, by_digest: bool = False,
    max_files: int = MAX_FILES, after_write: Callable[[], None] | None = None,
) -> None:
    """Clean all captures that have come since the last call. ``after_write`` is called when a batch's rows are written and not yet in the manifest."""

    def take(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        files = stored(batch.select("path", "length", "modificationTime"), "capture_files")
        known = read_manifest(session, silver).where(F.col("batch_id") != number).drop("batch_id")
        both = files.join(known.withColumnsRenamed({"length": "_length", "modificationTime": "_time"}), "path")
        if both.where("length <> _length or modificationTime <> _time").limit(1).count():
            raise ValueError("a capture has changed since it was taken")
        paths = [r.path for r in files.join(known, "path", "left_anti").select("path").collect()]
        if paths:
            raw = flow_csv.scan_flow_csv(session, paths, encoding)
            flow_csv.write_silver(clean.clean_flows(raw, mapping, by_digest=by_digest), f"{silver}/rows/batch_id={number}")
            if after_write:
                after_write()
            fresh = files.join(known, "path", "left_anti")
            fresh.write.mode("overwrite").parquet(f"{silver}/manifest/batch_id={number}")

    # The contents are never selected, so listing reads no file.
    files = "path string, modificationTime timestamp, length bigint, content binary"
    found = spark.readStream.format("binaryFile").schema(files).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").option("maxFilesPerTrigger", str(max_files)).load(folder)
    writer = found.select("path", "length", "modificationTime").writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).queryName("captures")
    runs.drain(writer)
