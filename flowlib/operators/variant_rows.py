"""Summary rows of unlike columns as one VARIANT column, so that history grows without a schema union.

A stored part holds the rows of one summary: ``part`` and ``position`` say when it came and ``row`` holds its cells with their types. Beside it
lies a layout, one row per column of the part, so that columns keep the order in which they were first seen. Adding
a part reads nothing that is there; the schema of all parts is found by an aggregate over the rows when they are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS = "part bigint, row variant"
LAYOUT = "part bigint, ordinal int, name string, kind string"


def append_rows(df: DataFrame, path: str, part: int) -> None:
    """Store one summary as part number ``part``; a part that is written again replaces the earlier try."""
    spark = df.sparkSession
    cells = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    df.select(F.to_variant_object(cells).alias("row")).write.mode("overwrite").parquet(f"{path}/rows/part={part}")
    layout = [(i, name, kind) for i, (name, kind) in enumerate(df.dtypes)]
    spark.createDataFrame(layout, "ordinal int, name string, kind string").coalesce(1).write.mode("overwrite").parquet(f"{path}/layout/part={part}")


def layout(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """Columns of all parts in first-seen order, each of the one type that holds all of its parts' types."""
    seen: dict[str, str] = {}
    # One row per column name and type: as many as unlike columns, however many parts there are.
    rows = spark.read.schema(LAYOUT).parquet(f"{path}/layout").groupBy("name", "kind").agg(F.min(F.struct("part", "ordinal")).alias("at"))
    for r in rows.orderBy("at").collect():
        seen[r.name] = r.kind if r.name not in seen else _wider(seen[r.name], r.kind)
    return list(seen.items())


_NUMBERS = ["tinyint", "smallint", "int", "bigint", "double"]


def _wider(a: str, b: str) -> str:
    if a == b or b == "void":
        return a
    if a == "void":
        return b
    if a in _NUMBERS and b in _NUMBERS:
        return _NUMBERS[max(_NUMBERS.index(a), _NUMBERS.index(b))]
    return "string"


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """All rows with all columns; a cell that a part lacks is null. ``_part`` numbers the parts."""
    rows = spark.read.schema(ROWS).parquet(f"{path}/rows")
    cells = [F.variant_get("row", _path(name), "string" if kind == "void" else kind).alias(name) for name, kind in layout(spark, path)]
    return rows.select(*cells, F.col("part").alias("_part"))


def _path(name: str) -> str:
    quote = "'" if "'" not in name else '"'
    if quote in name:
        raise ValueError(f"a column name with both kinds of quotes can't be read from a VARIANT: {name}")
    return f"$[{quote}{name}{quote}]"


def schema_of_rows(spark: SparkSession, path: str) -> T.StructType:
    """Columns and types as the stored values themselves have them, found by one aggregate."""
    found = spark.read.schema(ROWS).parquet(f"{path}/rows").agg(F.schema_of_variant_agg("row")).first()[0]
    return T.StructType.fromDDL(found.removeprefix("OBJECT<").removesuffix(">")) if found.startswith("OBJECT<") else T.StructType()


def newest_rows(spark: SparkSession, path: str, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """The last row per key: of the latest part, then the highest ``version`` where there is one, then the largest row."""
    rows = read_rows(spark, path)
    columns = [c for c in rows.columns if c not in (*keys, "_part")]
    age = F.struct("_part", *([F.col("version")] if "version" in columns else []), *[F.col(f"`{c}`") for c in columns])
    cells = F.struct(*[F.col(f"`{c}`") for c in columns])
    newest = rows.groupBy(*keys).agg(F.max_by(cells, age).alias("_row")).select(*keys, "_row.*")
    return newest.orderBy(*order) if order else newest
