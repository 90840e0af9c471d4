"""Flow records as a stream: Kafka, or files with the same columns and the same plan after the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Fields every record may carry, besides its features.
RECORD_FIELDS = {
    "flow_id": "string",
    "replay_run_tag": "string",
    "benchmark_phase": "string",
    "is_control_record": "int",
    "control_type": "string",
    "event_time": "string",
    "timestamp": "string",
    "source_ingest_ts": "string",
    "source_ingest_epoch_ms": "double",
    "label_binary": "int",
    "label": "string",
}
ENVELOPE = ("kafka_timestamp", "kafka_partition", "kafka_offset")


def record_schema(features: list[str]) -> StructType:
    """Schema of the JSON value: the fixed fields and one double per feature."""
    fields = [f"`{n}` {k}" for n, k in RECORD_FIELDS.items()] + [f"`{f}` double" for f in features]
    return StructType.fromDDL(", ".join(fields))


def kafka_envelope(
    spark: SparkSession, servers: str, topic: str, starting_offsets: str = "earliest", fail_on_data_loss: bool = False,
    max_offsets_per_trigger: int = 20_000, batch: bool = False,
) -> DataFrame:
    """Envelope columns and JSON text of a topic. Needs the Kafka connector on the class path."""
    reader = spark.read if batch else spark.readStream
    reader = reader.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    reader = reader.option("startingOffsets", starting_offsets).option("failOnDataLoss", str(fail_on_data_loss).lower())
    if not batch:
        reader = reader.option("maxOffsetsPerTrigger", str(max_offsets_per_trigger))
    raw = reader.load()
    return raw.select(
        F.col("timestamp").alias("kafka_timestamp"), F.col("partition").alias("kafka_partition"),
        F.col("offset").alias("kafka_offset"), F.col("value").cast("string").alias("value"),
    )


def file_envelope(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The same columns from a growing folder of parquet files."""
    schema = "kafka_timestamp timestamp, kafka_partition int, kafka_offset bigint, value string"
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.parquet(path)


def files_per_batch(spark: SparkSession, path: str, batches: int = 4) -> int:
    """A cap for ``file_envelope``: one file for each core, so that no batch leaves cores idle, in ``batches`` batches at least.

    The number of batches follows from files and cores, not from rows: a batch costs its rows over the cores and a fixed time.
    """
    files = len(spark.read.schema("value string").parquet(path).inputFiles())
    return max(1, min(spark.sparkContext.defaultParallelism, files // batches))


def parse_json_flow(envelope: DataFrame, features: list[str], drop_malformed: bool = False) -> DataFrame:
    """Typed columns from the JSON text.

    A text that is no JSON object gives an all-null record, which is kept unless ``drop_malformed``; a field
    of the wrong type, or a missing one, is null and the record stays.
    """
    schema = record_schema(features)
    if drop_malformed:
        envelope = envelope.where(F.from_json("value", "map<string,string>").isNotNull())
    return envelope.select(*ENVELOPE, F.from_json("value", schema).alias("_r")).select(*ENVELOPE, "_r.*")


def filter_run_tag(df: DataFrame, run_tag: str) -> DataFrame:
    """Records of one run; a blank tag keeps all."""
    tag = run_tag.strip()
    return df.where(F.col("replay_run_tag") == tag) if tag else df


def is_control():
    flagged = F.coalesce(F.col("is_control_record"), F.lit(0)) != 0
    return flagged | (F.coalesce(F.col("control_type"), F.lit("")) != "")


def split_control_data(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(data records, control records)."""
    return df.where(~is_control()), df.where(is_control())


def end_of_input(control: DataFrame) -> DataFrame:
    """Runs whose end-of-input record has arrived, with how many and the last offset."""
    ends = control.where(F.col("control_type") == "input_sentinel")
    return ends.groupBy("replay_run_tag").agg(F.count("*").alias("sentinels"), F.max("kafka_offset").alias("last_offset"))
