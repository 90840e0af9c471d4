"""Streams of files under a cap: a batch keeps all cores busy, and there are several batches."""

from __future__ import annotations

import glob

import pytest
from pyspark.sql import functions as F

from flowlib.plans import views
from flowlib.plans.catalog import streams
from flowlib.streaming import runs, source

FILES = 40


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """400 events whose envelope comes in ``FILES`` files at most."""
    sf = str(tmp_path_factory.mktemp("capped"))
    rows = spark.range(400).selectExpr(
        "id as event_id", "timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id) as ts", "id % 7 as user_id", "'view' as event_type",
        "cast(id as double) as value", "concat('{\"k\": ', id % 40, '}') as props",
    )
    rows.write.parquet(f"{sf}/events.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", FILES)
    path = views.envelope_files(spark, sf)
    spark.conf.set("spark.sql.shuffle.partitions", before)
    return sf, len(glob.glob(f"{path.removeprefix('file://')}/*.parquet"))


@pytest.fixture
def batches(monkeypatch):
    """Rows of every micro-batch of the streams that are drained."""
    seen, drain = [], runs.drain

    def kept(*args, **how):
        query = drain(*args, **how)
        seen.extend(p["numInputRows"] for p in query.recentProgress if p["numInputRows"])
        return query

    monkeypatch.setattr(runs, "drain", kept)
    return seen


def expected(spark, files):
    return -(-files // min(spark.sparkContext.defaultParallelism, files // 4))


def test_cap_is_a_file_a_core_in_four_batches_at_least(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    for files, cap in [(1, 1), (3, 1), (4, 1), (8, 2), (4 * cores + 4, cores)]:
        path = str(tmp_path / str(files))
        spark.range(0, files, 1, files).select(F.col("id").cast("string").alias("value")).write.parquet(path)
        assert source.files_per_batch(spark, path) == min(cap, cores)


def test_progress_of_batches_that_fill_the_cores(spark, events, batches):
    sf, files = events
    got = streams.stream_progress_lag(spark, sf).first()
    assert tuple(got) == (400, True, True)
    assert sum(batches) == 400 and len(batches) == expected(spark, files)


@pytest.mark.parametrize("name", ["rate_limited_source", "micro_batch_trigger"])
def test_rate_limited_batches_fill_the_cores(spark, events, batches, monkeypatch, name):
    sf, files = events
    trigger = runs.processing_trigger

    class Started:
        """Starts the writer and keeps the batches when it stops."""

        def __init__(self, writer):
            self.writer = writer

        def start(self):
            self.query = self.writer.start()
            self.processAllAvailable = self.query.processAllAvailable
            return self

        def stop(self):
            batches.extend(p["numInputRows"] for p in self.query.recentProgress if p["numInputRows"])
            self.query.stop()

    monkeypatch.setattr(runs, "processing_trigger", lambda *a: Started(trigger(*a)))
    got = getattr(streams, name)(spark, sf)
    assert (got.count() if name == "rate_limited_source" else got.agg(F.sum("rows")).first()[0]) == 400
    assert sum(batches) == 400 and len(batches) == expected(spark, files)
