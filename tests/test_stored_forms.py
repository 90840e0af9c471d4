"""Duplicates by digest, captures taken in rounds, labels joined by bucket, merged sketches."""

from __future__ import annotations

import datetime as dt
import uuid

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from flowlib.operators import clean, digests, labels, sketches
from flowlib.plans import views
from flowlib.sources import bucketed, flow_csv, lookups
from flowlib.streaming import captures
from tests.conftest import rows

SF = "/root/testdata/sf0.001"


def shuffled_bytes(spark, run) -> int:
    """Bytes that the shuffles of ``run`` wrote."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def total():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = total()
    run()
    return total() - before


@pytest.fixture(scope="module")
def odd(spark):
    """Rows with nulls, NaN, both zeros and copies; the first two pairs share a digest, as hashes pass over nulls."""
    data = [(1, None, 2.0, "a"), (None, 1, 2.0, "a"), (1, None, 2.0, "a"), (None, 1, 2.0, "a"), (3, 3, float("nan"), None), (3, 3, float("nan"), None), (4, 4, 0.0, ""), (4, 4, -0.0, ""), (5, 5, 1.0, "x")]
    return spark.createDataFrame(data, "`a b` bigint, b bigint, v double, s string").repartition(3)


@pytest.mark.parametrize("most", [1000, 0])
def test_distinct_rows_by_digest(odd, most):
    assert odd.transform(digests.with_digest).where("b = 1 or `a b` = 1").select(*digests.DIGEST).distinct().count() <= 2
    got = digests.distinct_rows(odd, most)
    assert got.columns == odd.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, odd.dropDuplicates().collect()))
    counts = {str(r[:4]): r["copies here"] for r in digests.row_copies(odd, "copies here", most).collect()}
    assert sorted(counts.values()) == [1, 2, 2, 2, 2]
    assert digests.distinct_rows(odd.where("false"), most).count() == 0


def test_wide_rows_of_few_copies_are_hardly_shuffled(spark):
    wide = spark.range(20_000).select(*[F.xxhash64("id", F.lit(i)).cast("double").alias(f"c{i}") for i in range(80)])
    wide = wide.union(wide.limit(40))
    whole = shuffled_bytes(spark, lambda: wide.dropDuplicates().write.format("noop").mode("overwrite").save())
    kept = []
    lean = shuffled_bytes(spark, lambda: kept.append(digests.distinct_rows(wide).count()))
    assert kept == [20_000] and lean * 10 < whole
    print(f"shuffled {whole} bytes by whole rows, {lean} by digest")


def test_captures_in_rounds_with_a_retry(spark, tmp_path):
    folder, silver, checkpoint = (str(tmp_path / n) for n in ("in", "silver", "checkpoint"))
    mapping = lookups.label_mapping(spark)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a b.csv").write_text("Timestamp,Label,X\n14/02/2018 08:31:01,Benign,1\n14/02/2018 08:31:01,Benign,1\n")
    captures.take_captures(spark, folder, silver, checkpoint, mapping)
    assert [(r.X, r.source_file) for r in captures.read_taken(spark, silver).collect()] == [(1.0, "a b.csv")]
    (tmp_path / "in" / "c.csv").write_text("Label,Timestamp,Y\nBenign,14/02/2018 08:31:02,2\nBenign,14/02/2018 08:31:02,2\n")

    def fail():
        raise RuntimeError("after writing")

    with pytest.raises(StreamingQueryException):
        captures.take_captures(spark, folder, silver, checkpoint, mapping, after_write=fail)
    assert captures.read_manifest(spark, silver).count() == 1
    captures.take_captures(spark, folder, silver, checkpoint, mapping)
    captures.take_captures(spark, folder, silver, checkpoint, mapping)
    columns = ["source_file", "X", "Y", "label_norm"]
    got = sorted(map(str, captures.read_taken(spark, silver).select(*columns).collect()))
    full = clean.clean_flows(flow_csv.scan_flow_csv(spark, folder), mapping)
    assert got == sorted(map(str, full.select(*columns).collect())) and len(got) == 2
    # A stream that starts anew takes nothing twice, and a changed capture is an error.
    captures.take_captures(spark, folder, silver, checkpoint + "-new", mapping)
    assert sorted(map(str, captures.read_taken(spark, silver).select(*columns).collect())) == got
    assert sorted(r.batch_id for r in captures.read_manifest(spark, silver).collect()) == [0, 1]
    (tmp_path / "in" / "c.csv").write_text("Label,Timestamp,Y\nBenign,14/02/2018 08:31:03,3\n")
    with pytest.raises(StreamingQueryException, match="has changed"):
        captures.take_captures(spark, folder, silver, checkpoint + "-third", mapping)


def test_bucketed_label_join_has_no_exchange(spark, tmp_path):
    preds = views.preds(spark, SF, offsets=True).withColumn("kafka_offset", F.expr("case when event_id % 17 <> 0 then kafka_offset end"))
    preds = preds.unionByName(preds.where("event_id % 13 = 0")).select("event_id", "run_tag", "kafka_partition", "kafka_offset")
    inputs = views.flows(spark, SF, offsets=True).withColumn("is_control_record", F.expr("cast(event_id % 19 = 0 as int)"))
    left, right = f"p_{uuid.uuid4().hex}", f"i_{uuid.uuid4().hex}"
    bucketed.store_by_offset(preds, left, str(tmp_path / "p"), 4)
    bucketed.store_by_offset(inputs.select("kafka_partition", "kafka_offset", "is_control_record", "label_binary", "label"), right, str(tmp_path / "i"), 4)
    joined = bucketed.join_labels_stored(spark, left, right)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan, plan
    assert sorted(map(str, joined.collect())) == sorted(map(str, labels.join_labels_by_offset(preds, inputs).collect()))
    needed = bucketed.needed_inputs_stored(spark, left, right)
    plan = needed._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert needed.count() == labels.semi_join_required_keys(inputs, preds).count()
    for table in (left, right):
        spark.sql(f"DROP TABLE {table}")
        spark.sql(f"DROP TABLE {table}_unplaced")


def test_merged_sketches_stay_within_their_bound(spark):
    start = dt.datetime(2024, 1, 1)
    df = spark.range(40_000).select(
        F.concat(F.lit("r"), F.col("id") % 4).alias("run_tag"), F.lit(None).cast("string").alias("benchmark_phase"),
        (F.lit(start) + F.make_dt_interval(secs=F.col("id") / 1000)).alias("emit_time"), F.exp(F.randn(5)).alias("source_to_ingest_ms"),
        F.when(F.col("id") % 4 != 3, F.col("id") % 7).cast("double").alias("processing_ms"), F.rand(6).alias("end_to_end_ms"),
    )
    kept = sketches.latency_sketches(df)
    assert kept.count() == 160
    merged = sketches.merged_latencies(kept, ["run_tag"])
    for name, column in sketches.LATENCIES.items():
        error = sketches.observed_rank_error(df, ["run_tag"], column, merged, f"{name}_q95_ms", 0.95).where("rank_error is not null")
        assert error.agg(F.max("rank_error")).first()[0] <= 3 * sketches.rank_error()
    got = {r.run_tag: r for r in merged.collect()}
    assert got["r3"].processing_n == 0 and got["r3"].processing_q50_ms is None and got["r0"].rows == 10_000 and got["r0"].processing_max_ms == 6.0
    exact = df.where("run_tag = 'r1'").agg(F.avg("end_to_end_ms")).first()[0]
    assert got["r1"].e2e_avg_ms == pytest.approx(exact)
    assert rows(sketches.merged_latencies(kept.where("false"), ["run_tag"])) == []
