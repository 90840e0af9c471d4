"""Labelled network-flow analytics on PySpark: cleaning, splits, scoring, quality, latency, backlog and reports.

Every public operator takes DataFrames (or Columns) and returns a DataFrame (or Column). The caller owns
the session. Naive timestamps are read as UTC, so run with ``spark.sql.session.timeZone=UTC``.
"""

__version__ = "0.1.0"
