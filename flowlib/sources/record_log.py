"""A log of records in a folder, read as a stream with a limit on the records of a batch, like a topic without a broker.

Records lie in Parquet files by partition, sorted by offset, and an index beside them names each file's partition, first and
last offset. Offsets of the stream are ``{partition: next offset}``; a batch takes the same number of offsets of every
partition, in all no more than the limit, so which records it holds follows from the log alone. Tasks read their files
from the shared folder directly and only the rows of their range.

Spark's Python sources aren't told where a restarted stream stands when they are asked for the next end, so the reader
writes down the end of every batch that is planned. Spark plans a batch only after it has logged its end, and plans it anew
after a failure, so the note is never ahead of that log and never behind it when the next end is asked for.
"""

from __future__ import annotations

import json
import posixpath
import uuid

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "kafka_timestamp timestamp, kafka_partition int, kafka_offset bigint, value string"
COLUMNS = ["kafka_timestamp", "kafka_partition", "kafka_offset", "value"]
FORMAT = "flow_record_log"
#: Rows of one file, so that a task reads little beside its range.
FILE_ROWS = 100_000


def append_records(records: DataFrame, folder: str, file_rows: int = FILE_ROWS) -> None:
    """Add records to the log; their offsets must lie behind those of their partition that are there already.

    Files count from when their index rows are written: what a failed attempt leaves behind is never read.
    """
    spark, batch = records.sparkSession, uuid.uuid4().hex
    data = f"{folder}/data/{batch}"
    kept = records.select(*COLUMNS).repartitionByRange("kafka_partition", "kafka_offset").sortWithinPartitions("kafka_partition", "kafka_offset")
    kept.write.option("maxRecordsPerFile", str(file_rows)).parquet(data)
    # A file may hold the end of one partition and the beginning of the next.
    name = F.concat(F.lit(f"{batch}/"), F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)$", 1)).alias("file")
    found = spark.read.schema(SCHEMA).parquet(data).groupBy(name, "kafka_partition")
    found.agg(F.min("kafka_offset").alias("first"), F.max("kafka_offset").alias("last"), F.count("*").alias("rows")).write.mode("append").parquet(f"{folder}/index")


def high_watermarks(spark: SparkSession, folder: str) -> DataFrame:
    """kafka_partition and ``high``, the offset behind its last record."""
    return spark.read.parquet(f"{folder}/index").groupBy("kafka_partition").agg((F.max("last") + 1).alias("high"))


def log_partitions(spark: SparkSession, folder: str) -> list[int]:
    return sorted(r.kafka_partition for r in high_watermarks(spark, folder).collect())


def log_envelope(spark: SparkSession, folder: str, position: str, max_records: int) -> DataFrame:
    """Stream of the log with ``max_records`` records a batch at most. ``position`` is a file for this stream alone, kept with its checkpoint."""
    spark.dataSource.register(RecordLog)
    return spark.readStream.format(FORMAT).options(folder=folder, position=position, max_records=str(max_records)).load()


class Range(InputPartition):
    """Offsets ``first`` to ``end - 1`` of one partition in one file."""

    def __init__(self, file: str, partition: int, first: int, end: int):
        super().__init__((file, partition, first, end))


class RecordLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return RecordLogReader(self.options["folder"], self.options["position"], int(self.options["max_records"]))


class RecordLogReader(DataSourceStreamReader):
    def __init__(self, folder: str, position: str, most: int):
        if most < 1:
            raise ValueError("a batch must be allowed one record at least")
        self.folder, self.position, self.most = folder, position, most

    def _index(self, columns: list[str], condition=None) -> pa.Table:
        store, path = fs.FileSystem.from_uri(_uri(f"{self.folder}/index"))
        return ds.dataset(path, filesystem=store, format="parquet").to_table(columns, filter=condition)

    def initialOffset(self) -> dict:  # noqa: N802
        found = self._index(["kafka_partition", "first"]).group_by("kafka_partition").aggregate([("first", "min")])
        return {str(p): o for p, o in sorted(zip(found["kafka_partition"].to_pylist(), found["first_min"].to_pylist()))}

    def latestOffset(self) -> dict:  # noqa: N802
        start = self._noted()
        found = self._index(["kafka_partition", "first", "last"]).group_by("kafka_partition").aggregate([("first", "min"), ("last", "max")])
        rows = {str(p): (a, b + 1) for p, a, b in zip(*(found[c].to_pylist() for c in ("kafka_partition", "first_min", "last_max")))}
        # A partition that is new since the start begins at its first record.
        at = {p: start.get(p, a) for p, (a, _) in rows.items()}
        going = [p for p, (_, end) in rows.items() if at[p] < end]
        if not going:
            return dict(sorted(at.items()))
        share = self.most // len(rows)
        if share:
            return {p: min(rows[p][1], at[p] + share) for p in sorted(rows, key=int)}
        # Fewer records than partitions: those that are least far take one each.
        chosen = set(sorted(going, key=lambda p: (at[p] - rows[p][0], int(p)))[: self.most])
        return {p: at[p] + (p in chosen) for p in sorted(rows, key=int)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self._note(end)
        wanted = [p for p in end if end[p] > start.get(p, -1)]
        if not wanted:
            return []
        low = min(start.get(p, 0) for p in wanted)
        found = self._index(["file", "kafka_partition", "first", "last"], (ds.field("kafka_partition").isin([int(p) for p in wanted])) & (ds.field("last") >= low))
        out = []
        for file, part, first, last in zip(*(found[c].to_pylist() for c in ("file", "kafka_partition", "first", "last"))):
            a, b = max(first, start.get(str(part), first)), min(last + 1, end[str(part)])
            if a < b:
                out.append(Range(file, part, a, b))
        return out

    def read(self, partition: Range):
        file, part, first, end = partition.value
        store, path = fs.FileSystem.from_uri(_uri(f"{self.folder}/data/{file}"))
        offset = ds.field("kafka_offset")
        condition = (ds.field("kafka_partition") == part) & (offset >= first) & (offset < end)
        for batch in ds.dataset(path, filesystem=store, format="parquet").to_batches(columns=COLUMNS, filter=condition, batch_size=8192):
            if len(batch):
                times = batch.column(0).cast(pa.timestamp("us", "UTC"))
                yield pa.RecordBatch.from_arrays([times, *batch.columns[1:]], COLUMNS)

    def _noted(self) -> dict:
        store, path = fs.FileSystem.from_uri(_uri(self.position))
        if store.get_file_info(path).type == fs.FileType.NotFound:
            return {}
        with store.open_input_stream(path) as stream:
            return json.loads(stream.read())

    def _note(self, end: dict) -> None:
        known = self._noted()
        text = json.dumps({**known, **{p: max(o, known.get(p, o)) for p, o in end.items()}})
        store, path = fs.FileSystem.from_uri(_uri(self.position))
        store.create_dir(posixpath.dirname(path), recursive=True)
        with store.open_output_stream(f"{path}.new") as stream:
            stream.write(text.encode())
        store.move(f"{path}.new", path)


def _uri(path: str) -> str:
    """``file:/x`` and ``/x`` as the form that all stores take."""
    if "://" in path:
        return path
    return "file://" + (path[5:] if path.startswith("file:") else path)
