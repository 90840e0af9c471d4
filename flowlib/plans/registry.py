"""Registry of checked queries: a Spark callable and, where SQL can say the same, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlib.plans.views import SQL_VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DECIMALS = 6


def with_views(body: str, views: dict[str, str] = SQL_VIEWS) -> str:
    ctes = ",\n".join(f"{name} AS ({text})" for name, text in views.items())
    return f"WITH {ctes}\n{body}"


def query(name: str, sql: str | None = None, floats: str = ""):
    """Register a query. ``floats`` names columns rounded on both sides, where the order of additions may differ."""
    rounded = floats.split()

    def register(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            out = build(spark, sf.rstrip("/"))
            out = out.withColumns({c: F.round(F.col(f"`{c}`"), DECIMALS) for c in rounded}) if rounded else out
            naive = {c: F.col(f"`{c}`").cast("timestamp_ntz") for c, kind in out.dtypes if kind == "timestamp"}
            return out.withColumns(naive) if naive else out

        run.__name__ = name
        run.__doc__ = build.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql:
            body = sql.strip()
            if body.startswith("WITH"):
                body = f"SELECT * FROM (\n{body}\n) AS inner_answer"
            if rounded:
                cells = ", ".join(f'round("{c}", {DECIMALS}) AS "{c}"' for c in rounded)
                body = f"SELECT * REPLACE ({cells}) FROM (\n{body}\n) AS answer"
            ORACLES[name] = with_views(body)
        return build

    return register
