"""Raw rows to clean rows: checks in a fixed order, label names, numbers, duplicates and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlib.operators.digests import distinct_rows, row_copies
from flowlib.functions.text import blank_to_null, strip
from flowlib.functions.values import (
    TIMESTAMP_FLOOR,
    binary_label,
    finite_or_null,
    is_missing_label,
    is_valid_timestamp,
    normalize_label,
    parse_number,
    parse_timestamp,
)
from flowlib.sources.flow_csv import META_COLUMNS, SOURCE_FILE, silver_columns

RULE = "_rule"
UNMAPPED = "_unmapped"


def join_label_mapping(df: DataFrame, mapping: DataFrame, label: str = "label") -> DataFrame:
    """Add ``mapped`` from the label table by exact match of the trimmed label."""
    names = mapping.select(F.col("raw_label").alias("_raw"), F.col("normalized_label").alias("mapped"))
    return df.join(names, blank_to_null(F.col(label)) == F.col("_raw"), "left").drop("_raw")


def normalize_labels(df: DataFrame, mapping: DataFrame, label: str = "label") -> DataFrame:
    """Add ``label_norm`` and the flag ``is_unmapped`` (a present label the table does not name)."""
    joined = join_label_mapping(df, mapping, label)
    return joined.withColumns(
        {
            "label_norm": normalize_label(F.col(label), F.col("mapped")),
            "is_unmapped": blank_to_null(F.col(label)).isNotNull() & F.col("mapped").isNull(),
        }
    ).drop("mapped")


def unmapped_labels(df: DataFrame, mapping: DataFrame, label: str = "label") -> DataFrame:
    """Each present label the table does not name, with its row count."""
    named = normalize_labels(df, mapping, label).where("is_unmapped")
    return named.groupBy(blank_to_null(F.col(label)).alias("label")).agg(F.count("*").alias("rows"))


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.lower() not in META_COLUMNS and c not in (RULE, UNMAPPED)]


def sanitize_numeric(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Text to double; text that is no number, NaN and infinities become null.

    Three plain projections, so that trimming and parsing happen once per cell.
    """
    columns = feature_columns(df) if columns is None else columns
    kinds = dict(df.dtypes)
    texts = [c for c in columns if kinds[c] == "string"]

    def step(frame: DataFrame, names: list[str], change) -> DataFrame:
        return frame.withColumns({c: change(F.col(f"`{c}`")) for c in names}) if names else frame

    parsed = step(step(df, texts, strip), texts, parse_number)
    return step(step(parsed, [c for c in columns if c not in texts], lambda c: c.cast("double")), columns, finite_or_null)


def checked_rows(raw: DataFrame, mapping: DataFrame, floor: str = TIMESTAMP_FLOOR) -> DataFrame:
    """Clean values plus the first rule each row fails: ``timestamp``, then ``label``, else ``kept``."""
    parsed = raw.withColumns({"timestamp": parse_timestamp(F.col("timestamp")), "label": strip(F.col("label"))})
    rule = (
        F.when(~is_valid_timestamp(F.col("timestamp"), floor), F.lit("timestamp"))
        .when(is_missing_label(F.col("label")), F.lit("label"))
        .otherwise(F.lit("kept"))
    )
    named = normalize_labels(parsed.withColumn(RULE, rule), mapping).withColumnRenamed("is_unmapped", UNMAPPED)
    cleaned = sanitize_numeric(named.withColumn("label_binary", binary_label(F.col("label_norm"))))
    return cleaned.select(*[F.col(f"`{c}`") for c in silver_columns([c for c in cleaned.columns if c not in (RULE, UNMAPPED)])], RULE, UNMAPPED)


def dedup_within_file(df: DataFrame, by_digest: bool = False) -> DataFrame:
    """Drop exact duplicates of a row inside its own source file; copies in other files stay.

    ``by_digest`` reads the input twice and moves whole only rows that may have a copy (see ``digests``): for wide rows of few copies.
    """
    return distinct_rows(df) if by_digest else df.dropDuplicates()


def clean_flows(raw: DataFrame, mapping: DataFrame, floor: str = TIMESTAMP_FLOOR, by_digest: bool = False) -> DataFrame:
    """Silver rows of a raw scan."""
    kept = checked_rows(raw, mapping, floor).where(F.col(RULE) == "kept").drop(RULE, UNMAPPED)
    return dedup_within_file(kept, by_digest)


def cleaning_stats(raw: DataFrame, mapping: DataFrame, floor: str = TIMESTAMP_FLOOR, by_digest: bool = False) -> DataFrame:
    """Per file and in total (``source_file`` = ``*``): raw, kept, dropped per rule, duplicates, unmapped labels.

    One pass: rows are counted per distinct clean row, dropped rows collapse to one key per rule and file
    before the shuffle, and the counts of counts give kept rows and duplicates. ``by_digest`` counts digests first and
    moves whole only rows that may have a copy.
    """
    rows = checked_rows(raw, mapping, floor)
    content = [c for c in rows.columns if c not in (SOURCE_FILE, RULE, UNMAPPED)]
    keep = F.col(RULE) == "kept"
    keyed = rows.select(
        SOURCE_FILE, RULE, (keep & F.col(UNMAPPED)).alias(UNMAPPED), *[F.when(keep, F.col(f"`{c}`")).alias(c) for c in content]
    )
    by_rows = keyed.groupBy(*[F.col(f"`{c}`") for c in keyed.columns])
    copies = row_copies(keyed, "_copies") if by_digest else by_rows.agg(F.count("*").alias("_copies"))
    n = F.col("_copies")
    stats = [
        F.sum(n).alias("rows_raw"),
        F.count_if(keep).alias("rows_kept"),
        F.sum(F.when(F.col(RULE) == "timestamp", n).otherwise(0)).alias("dropped_timestamp"),
        F.sum(F.when(F.col(RULE) == "label", n).otherwise(0)).alias("dropped_null_label"),
        F.sum(F.when(keep, n - 1).otherwise(0)).alias("dropped_duplicates"),
        F.sum(F.when(F.col(UNMAPPED), n).otherwise(0)).alias("unmapped_labels"),
    ]
    per_file = copies.groupBy(SOURCE_FILE).agg(*stats)
    sums = [F.sum(c).alias(c) for c in per_file.columns if c != SOURCE_FILE]
    return per_file.unionByName(per_file.agg(*sums).withColumn(SOURCE_FILE, F.lit("*")))
