"""Duplicates found by digest first: rows are counted by 128 bits, and only those whose digest repeats move whole.

A shuffle by all columns carries whole wide rows although few of them repeat. Here one pass shuffles two numbers a row,
combined before the shuffle; the digests that occur twice are stored, measured, and sent to the rows while they are few
(``MAX_REPEATED``; beyond that whole rows are shuffled, as without digests). Rows of other digests stay where they are; the rest are compared in
full, so rows that only share a digest are never taken for copies. The input is read twice: store it first where that costs more than its
shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlib.scratch import stored

DIGEST = ("_digest_a", "_digest_b")
#: Repeated digests that are sent to all tasks at most: 16 bytes each, 64 MB in all.
MAX_REPEATED = 4_000_000


def with_digest(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Adds two 64-bit hashes of the columns (all by default), chained in opposite orders from different seeds."""
    cells = [F.col(f"`{c}`") for c in (df.columns if columns is None else columns)]
    return df.withColumns({DIGEST[0]: F.xxhash64(*cells), DIGEST[1]: F.xxhash64(F.lit(0x5DEECE66D), *reversed(cells))})


def repeated_digests(tagged: DataFrame, most: int = MAX_REPEATED) -> DataFrame | None:
    """Stored digests of more than one row; none where they are more than ``most``."""
    counts = tagged.groupBy(*DIGEST).agg(F.count("*").alias("_n")).where("_n > 1").select(*DIGEST)
    found = stored(counts, "repeated_digests")
    return found if found.count() <= most else None


def split_by_digest(tagged: DataFrame, repeated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of a digest of their own, rows whose digest repeats); neither is shuffled."""
    few = F.broadcast(repeated)
    return tagged.join(few, list(DIGEST), "left_anti"), tagged.join(few, list(DIGEST), "left_semi")


def distinct_rows(df: DataFrame, most: int = MAX_REPEATED) -> DataFrame:
    """The rows of ``df`` once each, as ``dropDuplicates`` gives them."""
    tagged = with_digest(df)
    repeated = repeated_digests(tagged, most)
    if repeated is None:
        return df.dropDuplicates()
    once, more = split_by_digest(tagged, repeated)
    return once.drop(*DIGEST).union(more.drop(*DIGEST).dropDuplicates())


def row_copies(df: DataFrame, name: str, most: int = MAX_REPEATED) -> DataFrame:
    """The distinct rows of ``df`` with the number of their copies in the column ``name``."""
    tagged = with_digest(df)
    repeated = repeated_digests(tagged, most)
    if repeated is None:
        return df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count("*").alias(name))
    once, more = split_by_digest(tagged, repeated)
    whole = more.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count("*").alias(name))
    return once.drop(*DIGEST).withColumn(name, F.lit(1).cast("bigint")).union(whole)
