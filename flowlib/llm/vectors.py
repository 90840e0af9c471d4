"""Vectors as matrices inside tasks, and query rows in numbered blocks of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlib.operators.ordered import with_row_number
from flowlib.scratch import stored

#: Bytes of the query vectors that one pass over the rows sends to all tasks, and the most rows of them.
GROUP_BYTES, GROUP_ROWS = 16 << 20, 2048


def usable_vectors(table: DataFrame, keep: list[Column], vector: str = "embedding") -> DataFrame:
    """``keep`` columns and ``values`` (doubles) of rows whose vector is neither null nor empty and holds finite numbers only."""
    rows = table.select(*keep, F.col(vector).cast("array<double>").alias("values"))
    finite = F.forall("values", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    return rows.where((F.size("values") > 0) & finite)


def matrices(column: pa.ListArray, kind: type = np.float64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for every length that occurs in a list column without nulls."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    offsets = column.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    lengths = np.diff(offsets)
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        yield at, values[offsets[at][:, None] + np.arange(d)[None, :]]


def in_groups(queries: DataFrame, order: list[str], name: str) -> tuple[DataFrame, int]:
    """Stored query rows numbered by ``query``, with a ``group`` of bounded rows and bytes, and the number of groups."""
    numbered = stored(with_row_number(queries, [], order, "query"), f"{name}_numbered")
    most, longest = numbered.agg(F.max("query"), F.max(F.size("values"))).first()
    if not most:
        return numbered.withColumn("group", F.lit(0)), 0
    each = max(1, min(GROUP_ROWS, GROUP_BYTES // (8 * longest)))
    return numbered.withColumn("group", F.floor((F.col("query") - 1) / each).cast("int")), -(-most // each)


def by_group(queries: DataFrame, groups: int, search: Callable[[DataFrame], DataFrame], name: str, empty: DataFrame) -> DataFrame:
    """What ``search`` finds for each group of queries, stored group by group: each meets all rows in one pass."""
    found = empty
    for group in range(groups):
        found = found.unionByName(stored(search(queries.where(F.col("group") == group)), name))
    return found


def first_of(rows: DataFrame, keys: list[str], order: list[Column], count: int) -> DataFrame:
    """Distinct rows numbered by ``rank`` from 1 to ``count`` in each key; tasks cut their own lists before the shuffle."""
    ranked = rows.distinct().withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("rank") <= count)


def best_per_slot(slot: np.ndarray, better: np.ndarray, ids: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first ``count`` entries per slot (small ``better`` first, then small id), once each, and their ranks from 0."""
    order = np.lexsort((ids, better, slot))
    s, b, i = slot[order], better[order], ids[order]
    fresh = np.ones(len(s), bool)
    fresh[1:] = (s[1:] != s[:-1]) | (b[1:] != b[:-1]) | (i[1:] != i[:-1])
    order, s = order[fresh], s[fresh]
    starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    rank = np.arange(len(s)) - np.repeat(starts, np.diff(np.append(starts, len(s))))
    return order[rank < count], rank[rank < count]
