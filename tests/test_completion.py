"""State that knows when a run is complete."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from flowlib.streaming import closing, completion, runs


def test_intervals():
    draw = random.Random(2)
    for _ in range(50):
        offsets = [draw.randrange(30) for _ in range(25)]
        spans: list = []
        for o in offsets:
            spans = completion.joined(spans, o)
        assert sorted(x for a, b in spans for x in range(a, b)) == sorted(set(offsets))
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_complete_gap_and_missing_marker(spark, tmp_path):
    rows = [("whole", p, o, None) for p in (0, 1) for o in range(20)] + [("whole", 0, None, 20), ("whole", 1, None, 20)]
    rows += [("gap", 0, o, None) for o in range(20) if o not in (3, 7, 8)] + [("gap", 0, None, 20), ("gap", 0, 5, None)]
    rows += [("open", 0, o, None) for o in range(6)] + [("half", 0, 0, None), ("half", 1, 0, None), ("half", 0, None, 1), ("empty", 2, None, 0)]
    table = spark.createDataFrame(rows, "run_tag string, kafka_partition int, kafka_offset bigint, end_offset bigint")
    parts = F.when(F.col("end_offset").isNotNull(), F.when(F.col("run_tag").isin("whole", "half"), 2).otherwise(1))
    table = table.withColumn("parts", parts).withColumn("at", F.expr("timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, coalesce(kafka_offset, end_offset))")).repartition(3)
    path = str(tmp_path / "in")
    closing.write_stream_input(table, path, "at", "1 day")
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", "2").parquet(path)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", completion.PROVIDER)
    try:
        out = completion.run_completion(closing.until_end(stream, "at", "1 hour"), 60_000)
        runs.drain(runs.table_writer(out, str(tmp_path / "out"), str(tmp_path / "checkpoint"), "completion"))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = sorted(tuple(r) for r in spark.read.schema(completion.OUTPUT).parquet(str(tmp_path / "out")).collect())
    assert got == [("empty", "complete", 0, 0), ("gap", "gap", 17, 3), ("half", "no_marker", 2, 0), ("open", "no_marker", 6, 0), ("whole", "complete", 40, 0)]
