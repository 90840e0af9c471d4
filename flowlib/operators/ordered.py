"""Row numbers and previous-row values over groups of any size.

A window over one large group sorts it in one task. Here rows are range-partitioned by the full sort
key, so a group that holds a third of all rows is spread over many tasks, and only one small row per
(group, chunk) is ordered by a plain window. Chunks come from sampled ranges, so the tagged rows are
written once to the shared folder; every later step reads that fixed table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlib.scratch import small_side, stored

CHUNK = "_chunk"
POSITION = "_position"


def join_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on null-safe equality of ``keys``; key columns appear once."""
    renamed = right.select(*[F.col(f"`{k}`").alias(f"_r_{i}") for i, k in enumerate(keys)],
                           *[F.col(f"`{c}`") for c in right.columns if c not in keys])
    condition = None
    for i, key in enumerate(keys):
        one = left[f"`{key}`"].eqNullSafe(renamed[f"_r_{i}"])
        condition = one if condition is None else condition & one
    return left.join(renamed, condition, how).drop(*[f"_r_{i}" for i in range(len(keys))])


def in_chunks(df: DataFrame, keys: list[str], order: list[str | Column], name: str = "ordered") -> DataFrame:
    """Rows tagged with a chunk and a position that follow (keys, order); ``order`` should end in a unique column."""
    by = [*[F.col(k) for k in keys], *[F.col(o) if isinstance(o, str) else o for o in order]]
    tagged = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_mid", F.monotonically_increasing_id())
    tagged = tagged.withColumns(
        {CHUNK: F.shiftright("_mid", 33).cast("int"), POSITION: F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))}
    ).drop("_mid")
    return stored(tagged, name)


def with_row_number(
    df: DataFrame, keys: list[str], order: list[str | Column], name: str = "row_number", total: str | None = None
) -> DataFrame:
    """``row_number() over (partition by keys order by order)``; ``total`` adds the group's row count."""
    rows = in_chunks(df, keys, order)
    chunks = rows.groupBy(*keys, CHUNK).agg(F.count("*").alias("_n"), F.min(POSITION).alias("_first"))
    per_key = Window.partitionBy(*keys) if keys else Window.partitionBy()
    before = F.sum("_n").over(per_key.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1))
    starts = chunks.select(
        *keys,
        CHUNK,
        (F.coalesce(before, F.lit(0)) - F.col("_first") + 1).alias("_start"),
        *([F.sum("_n").over(per_key).alias(total)] if total else []),
    )
    # With the few chunk rows broadcast, the numbered rows are not shuffled again.
    numbered = join_same(rows, small_side(starts), [*keys, CHUNK], "inner")
    return numbered.withColumn(name, F.col(POSITION) + F.col("_start")).drop("_start", CHUNK, POSITION)


def with_previous(df: DataFrame, keys: list[str], order: list[str | Column], columns: dict[str, str]) -> DataFrame:
    """For each ``new: old`` pair, ``lag(old)`` over (keys, order)."""
    rows = in_chunks(df, keys, order)
    fields = F.struct(*[F.col(old).alias(new) for new, old in columns.items()])
    ends = small_side(rows.groupBy(*keys, CHUNK).agg(F.max(POSITION).alias("_end")))
    tagged = rows.select(*keys, CHUNK, POSITION, fields.alias("_last"))
    last = join_same(tagged, ends, [*keys, CHUNK], "inner").where(F.col(POSITION) == F.col("_end"))
    per_key = Window.partitionBy(*keys) if keys else Window.partitionBy()
    carried = last.select(*keys, CHUNK, F.lag("_last").over(per_key.orderBy(CHUNK)).alias("_carried"))
    inside = F.lag(fields).over(Window.partitionBy(*keys, CHUNK).orderBy(POSITION))
    joined = join_same(rows.withColumn("_inside", inside), small_side(carried), [*keys, CHUNK], "inner")
    previous = F.coalesce(F.col("_inside"), F.col("_carried"))
    return joined.withColumns({new: previous[new] for new in columns}).drop("_inside", "_carried", CHUNK, POSITION)
