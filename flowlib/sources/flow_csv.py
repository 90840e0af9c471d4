"""Raw flow CSV in, silver parquet out."""

from __future__ import annotations

import functools
import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from flowlib.functions.text import CSV_NULL_CELLS

META_COLUMNS = ("timestamp", "label", "label_norm", "label_binary", "source_file")
SOURCE_FILE = "source_file"


def source_name():
    """Name of the capture a row came from: the first path part ending in ``.csv`` (a file, or a folder of parts)."""
    return F.url_decode(F.regexp_extract(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")), r"/([^/]+\.csv)(?:/|$)", 1))


def normalize_header(names: list[str]) -> list[str]:
    """Strip names and find the timestamp and label columns in any case; missing ones are an error."""
    stripped = [n.strip() for n in names]
    lower = [n.lower() for n in stripped]
    for wanted in ("timestamp", "label"):
        if wanted not in lower:
            raise ValueError(f"no {wanted} column among {stripped}")
        stripped[lower.index(wanted)] = wanted
    return stripped


def _plain(uri: str) -> str:
    """File name as a reader takes it: unescaped, with one slash after the scheme of local files."""
    return re.sub(r"^file:/+", "file:/", unquote(uri))


def csv_layouts(spark: SparkSession, path: str | list[str], glob: str = "*.csv") -> DataFrame:
    """One row per distinct layout: ``latin`` (some line is no valid UTF-8), ``sample`` (a file with the header) and its ``files``.

    One pass over the text, whatever the number of files: a file's header is its first line that isn't blank, in the
    split that begins the file. A capture has the header of its first part that has one (Spark may write an empty
    part), and is Latin-1 as a whole if any of its parts is.
    """
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path)
    lines = text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"), "value",
    )
    begins = (F.col("start") == 0) & (F.trim("value") != "")
    files = lines.groupBy("file").agg(
        F.min(F.when(begins, F.struct("at", F.md5("value").alias("header")))).alias("first"), F.bool_or(~F.is_valid_utf8("value")).alias("latin")
    )
    # A capture is a file, or the folder named .csv whose part a file is.
    capture = F.coalesce(F.nullif(F.regexp_extract("file", r"^(.*?\.csv)(?:/|$)", 1), F.lit("")), F.col("file"))
    named = F.when(F.col("first").isNotNull(), F.col("file"))
    captures = files.groupBy(capture.alias("capture")).agg(
        F.min_by("first.header", named).alias("header"), F.min(named).alias("sample"), F.bool_or("latin").alias("latin"), F.collect_list("file").alias("files")
    )
    return captures.where("header is not null").groupBy("header", "latin").agg(F.min("sample").alias("sample"), F.flatten(F.collect_list("files")).alias("files"))


def union_schemas(frames: list[DataFrame]) -> DataFrame:
    """Stack frames whose columns differ; a column a frame lacks is null there."""
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def scan_flow_csv(spark: SparkSession, path: str | list[str], encoding: str | None = None) -> DataFrame:
    """All CSV files under ``path`` (a folder, or files) as text columns with ``timestamp``, ``label`` and ``source_file``.

    One pass over the text finds the layouts; captures sharing a header and an encoding form one scan, so plan
    and jobs grow with the number of layouts, not of files. A part whose header differs from its capture's fails
    the scan. Without ``encoding``, captures that are no valid UTF-8 are read as Latin-1.
    """
    groups: dict[tuple, list[str]] = {}
    for row in csv_layouts(spark, path).collect():
        charset = encoding or ("ISO-8859-1" if row["latin"] else "UTF-8")
        header = tuple(spark.read.option("header", "true").option("encoding", charset).csv(_plain(row["sample"])).columns)
        groups.setdefault((header, charset), []).extend(sorted(_plain(f) for f in row["files"]))
    if not groups:
        raise FileNotFoundError(f"no CSV files with a header under {path}")
    frames = []
    for (header, charset), members in groups.items():
        schema = StructType([StructField(n, StringType()) for n in header])
        reader = spark.read.schema(schema).option("header", "true").option("enforceSchema", "false")
        raw = reader.option("encoding", charset).csv(members).select("*", source_name().alias("_file"))
        cells = [
            F.when(~F.col(f"`{h}`").isin(*CSV_NULL_CELLS), F.col(f"`{h}`")).alias(n)
            for h, n in zip(header, normalize_header(list(header)))
        ]
        frames.append(raw.select(*cells, F.col("_file").alias(SOURCE_FILE)))
    return union_schemas(frames)


def silver_columns(names: list[str]) -> list[str]:
    """Meta columns first, features by name, ``source_file`` last."""
    first = [c for c in META_COLUMNS if c != SOURCE_FILE]
    return [*first, *sorted(c for c in names if c not in META_COLUMNS), SOURCE_FILE]


def write_silver(df: DataFrame, path: str, compact: bool = False) -> None:
    """Silver parquet partitioned by day, so later day filters read only their days.

    By default rows keep the tasks they are in and each task writes one file per day it holds, without a
    shuffle. ``compact`` rebalances rows by day first, which splits hot days and merges small ones; it is
    worth its shuffle when the tasks hold little data each.
    """
    ordered = df.select(*[F.col(f"`{c}`") for c in silver_columns(df.columns)]).withColumn("day", F.to_date("timestamp"))
    out = ordered.hint("rebalance", "day") if compact else ordered
    out.write.mode("overwrite").partitionBy("day").parquet(path)


def read_silver(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
