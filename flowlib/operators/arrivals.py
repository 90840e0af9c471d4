"""Replay of a table as arrivals: slices, schedules, reordering, late events, encoded records, emit gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlib.functions.values import key_text, span_seconds
from flowlib.operators.ordered import join_same, with_previous, with_row_number
from flowlib.operators.percentiles import exact_percentiles
from flowlib.scratch import small_side, stored

# A rate plan is a short list of (rows per second, seconds) steps; a constant rate is one step of 0 seconds.
RatePlan = list[tuple[float, float]]


def slice_replay_source(df: DataFrame, order: list[str], offset: int = 0, limit: int | None = None) -> DataFrame:
    """Rows ``offset .. offset+limit`` in the given order with ``row_index``; adds ``flow_id`` and ``event_time`` if absent."""
    first = max(int(offset), 0)
    rows = with_row_number(df, [], order, name="_rn").withColumn("row_index", F.col("_rn") - 1).drop("_rn")
    kept = F.col("row_index") >= first
    if limit is not None:
        kept = kept & (F.col("row_index") < first + max(int(limit), 0))
    out = rows.where(kept)
    if "flow_id" not in out.columns:
        out = out.withColumn("flow_id", F.concat(F.lit("flow-"), F.col("row_index").cast("string")))
    if "event_time" not in out.columns and "timestamp" in out.columns:
        out = out.withColumn("event_time", F.col("timestamp"))
    return out


def encode_records(
    df: DataFrame, run_tag: str, row_index: str = "row_index", phase: str = "measure", ingest_epoch_ms: Column | None = None
) -> DataFrame:
    """Key and JSON value of each row: key is ``flow_id`` or ``<run>__row_<i>``; NaN is null, times are ISO text."""
    ingest = F.unix_millis(F.current_timestamp()) if ingest_epoch_ms is None else ingest_epoch_ms
    added = df.withColumns(
        {
            "source_ingest_ts": F.date_format(F.timestamp_millis(ingest), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"),
            "source_ingest_epoch_ms": ingest,
            "replay_run_tag": F.lit(run_tag),
            "replay_row_index": F.col(row_index).cast("long"),
            "benchmark_phase": F.lit(phase),
        }
    )
    cells = []
    for name, kind in added.dtypes:
        cell = F.col(f"`{name}`")
        if kind in ("double", "float"):
            cell = F.when(~F.isnan(cell), cell)
        elif kind.startswith("timestamp"):
            cell = F.date_format(cell, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        cells.append(cell.alias(name))
    fallback = F.concat(F.lit(f"{run_tag}__row_"), F.col("replay_row_index").cast("string"))
    flow_id = F.when(F.col("flow_id") != "", F.col("flow_id")) if "flow_id" in df.columns else F.lit(None)
    value = F.to_json(F.struct(*cells), {"ignoreNullFields": "false"})
    return added.select(F.coalesce(flow_id, fallback).alias("key"), value.alias("value"))


def input_sentinel(df: DataFrame, run_tag: str = "run_tag", at: str = "at") -> DataFrame:
    """End-of-input record for each row of ``(run_tag, at)``."""
    text = F.date_format(F.col(at), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    return df.select(
        F.concat(F.col(run_tag), F.lit("__input_sentinel")).alias("flow_id"),
        F.col(run_tag).alias("replay_run_tag"),
        F.lit("control").alias("benchmark_phase"),
        text.alias("event_time"),
        text.alias("timestamp"),
        text.alias("source_ingest_ts"),
        F.unix_millis(F.col(at)).alias("source_ingest_epoch_ms"),
        F.lit(None).cast("int").alias("label_binary"),
        F.lit(None).cast("string").alias("label"),
        F.lit(1).alias("is_control_record"),
        F.lit("input_sentinel").alias("control_type"),
    )


def elapsed_for_rows(rows: Column, plan: RatePlan) -> Column:
    """Seconds after which ``rows`` rows have been sent; zero-rate steps only take time, the last rate goes on."""
    sent, waited, last = 0.0, 0.0, 0.0
    chain = F.when(rows <= 0, F.lit(0.0))
    for rate, seconds in plan:
        if rate == 0:
            waited += seconds
            continue
        last = rate
        chain = chain.when(rows <= sent + rate * seconds, F.lit(waited) + (rows - F.lit(sent)) / F.lit(rate))
        sent += rate * seconds
        waited += seconds
    rest = F.lit(waited) if last == 0 else F.lit(waited) + (rows - F.lit(sent)) / F.lit(last)
    return chain.otherwise(rest)


def rows_for_elapsed(seconds: Column, plan: RatePlan) -> Column:
    """Rows due after ``seconds``; the rate of the last step goes on."""
    sent, waited, last = 0.0, 0.0, 0.0
    chain = F.when(seconds <= 0, F.lit(0.0))
    for rate, length in plan:
        last = max(rate, 0.0)
        chain = chain.when(seconds <= waited + length, F.lit(sent) + (seconds - F.lit(waited)) * F.lit(last))
        sent += last * length
        waited += length
    return chain.otherwise(F.lit(sent) + (seconds - F.lit(waited)) * F.lit(last))


def rate_for_rows(rows: Column, plan: RatePlan) -> Column:
    """Mean rate at which the plan sends ``rows`` rows; null for a plan that takes no time."""
    elapsed = elapsed_for_rows(rows, plan)
    return F.when(elapsed > 0, rows / elapsed)


def arrival_schedule(df: DataFrame, plan: RatePlan, start: Column, row_index: str = "row_index") -> DataFrame:
    """Add ``elapsed_sec`` and ``scheduled_ts`` at which each row (0-based index) is due."""
    elapsed = elapsed_for_rows(F.col(row_index) + 1, plan)
    due = F.timestamp_micros(F.unix_micros(start) + F.round(elapsed * 1e6).cast("long"))
    return df.withColumns({"elapsed_sec": elapsed, "scheduled_ts": due})


def tick_targets(ticks: DataFrame, plan: RatePlan, total_rows: Column, interval_sec: float = 0.1, tick: str = "tick") -> DataFrame:
    """Rows that must have been sent at each tick."""
    elapsed = F.greatest(F.col(tick), F.lit(1)) * F.lit(max(float(interval_sec), 0.001))
    due = F.floor(rows_for_elapsed(elapsed, plan))
    return ticks.withColumns({"elapsed_sec": elapsed, "target_rows": F.least(total_rows.cast("long"), due)})


def rate_plan_summary(steps: DataFrame, keys: list[str]) -> DataFrame:
    """Expected rows, seconds, mean and peak rate of each plan of ``(keys, rows_per_sec, duration_sec)`` steps."""
    sums = steps.groupBy(*keys).agg(
        F.sum(F.col("rows_per_sec") * F.col("duration_sec")).alias("_rows"),
        F.sum("duration_sec").alias("total_seconds"),
        F.max("rows_per_sec").alias("peak_rps"),
    )
    out = sums.withColumns(
        {
            "expected_rows": F.greatest(F.floor("_rows"), F.lit(1)),
            "duration_sec": F.greatest(F.floor("total_seconds"), F.lit(1)),
        }
    )
    return out.withColumn("target_rps", F.col("expected_rows") / F.col("duration_sec")).drop("_rows")


def reorder_within_blocks(df: DataFrame, window_size: int, seed: int, row_index: str = "row_index", batch: list[str] | None = None) -> DataFrame:
    """Add ``new_index``: rows shuffled by a seeded hash inside blocks of ``window_size`` rows of each batch."""
    if window_size <= 1:
        return df.withColumn("new_index", F.col(row_index))
    keys = ", ".join([*(batch or []), "_block"])
    mixed = df.withColumns(
        {
            "_block": F.floor(F.col(row_index) / F.lit(window_size)),
            "_hash": F.md5(key_text(F.lit(seed), F.col(row_index))),
        }
    )
    place = F.expr(f"row_number() over (partition by {keys} order by _hash, `{row_index}`)")
    return mixed.withColumn("new_index", F.col("_block") * window_size + place - 1).drop("_block", "_hash")


def inject_late_events(
    df: DataFrame, ratio: float, max_delay_sec: float, seed: int, unique: str, batch: list[str] | None = None, time: str = "event_time"
) -> DataFrame:
    """Move ``time`` back by a hash-derived delay for exactly ``int(n * ratio)`` of the timed rows of each batch.

    The rows with the smallest hashes are taken. Hashes are even, so their first 16 bits cut a batch of any
    size into small equal parts: only part counts are summed in order, and only inside a part are rows sorted.
    """
    keys = list(batch or [])
    if ratio <= 0 or max_delay_sec <= 0:
        return df.withColumn("is_delayed", F.lit(0))
    digest = F.md5(key_text(F.lit(seed), F.col(unique)))
    rows = df.withColumns(
        {
            "_hash": digest,
            "_part": F.when(F.col(time).isNotNull(), F.conv(F.substring(digest, 1, 4), 16, 10).cast("int")),
            "_share": F.conv(F.substring(digest, 17, 8), 16, 10).cast("double") / F.lit(4294967296.0),
        }
    )
    parts = rows.where("_part is not null").groupBy(*keys, "_part").agg(F.count("*").alias("_c"))
    by = ", ".join(keys) or "1"
    parts = parts.selectExpr(
        *keys, "_part",
        f"sum(_c) over (partition by {by} order by _part rows unbounded preceding) - _c as _before",
        f"sum(_c) over (partition by {by}) as _n",
    )
    placed = join_same(rows, small_side(parts), [*keys, "_part"], "left")
    inner = ", ".join([*keys, "_part"])
    # Rows without a time never compete; spread them by their hash so that they are not one group.
    rank = F.expr(f"row_number() over (partition by {inner}, case when _part is null then _hash end order by _hash, `{unique}`)")
    late = (F.col("_part").isNotNull() & (F.col("_before") + rank <= F.floor(F.col("_n") * F.lit(ratio)))).cast("int")
    delay = F.lit(0.001) + F.col("_share") * F.lit(max_delay_sec - 0.001)
    moved = F.timestamp_micros(F.unix_micros(time) - F.round(F.col("_delay") * 1e6).cast("long"))
    out = placed.withColumns({"is_delayed": late, "_delay": delay})
    out = out.withColumn(time, F.when(F.col("is_delayed") == 1, moved).otherwise(F.col(time)))
    return out.drop("_hash", "_part", "_share", "_before", "_n", "_delay")


def emit_gap_stats(
    emits: DataFrame, keys: list[str], emitted: str = "emit_ts", due: str = "due_ts", unique: str = "row_index"
) -> DataFrame:
    """Gaps between consecutive emits and delay against schedule per run, by nearest rank, and the actual rate."""
    narrow = emits.select(*keys, emitted, due, unique)
    steps = with_previous(narrow, keys, [emitted, unique], {"_prev": emitted}).select(
        *keys,
        emitted,
        due,
        ((F.unix_micros(emitted) - F.unix_micros("_prev")) / 1000.0).alias("_gap"),
        F.greatest((F.unix_micros(emitted) - F.unix_micros(due)) / 1000.0, F.lit(0.0)).alias("_late"),
    )
    # Counts and percentiles pass over the steps several times; the ordered window runs once.
    steps = stored(steps, "emit-steps")
    # Elapsed time runs from the first due time to the last emit.
    elapsed = F.greatest(span_seconds(F.min(due), F.max(emitted)), F.lit(0.0))
    sums = steps.groupBy(*keys).agg(
        F.count("*").alias("sent_rows"),
        elapsed.alias("actual_elapsed_sec"),
        F.max("_gap").alias("emit_gap_max_ms"),
        F.max("_late").alias("tick_lag_max_ms"),
    )
    sums = sums.withColumn("actual_rps", F.when(F.col("actual_elapsed_sec") > 0, F.col("sent_rows") / F.col("actual_elapsed_sec")))
    wanted = {f"emit_gap_p{int(q * 100)}_ms": ("_gap", q) for q in (0.50, 0.95, 0.99)}
    wanted["tick_lag_p95_ms"] = ("_late", 0.95)
    return join_same(sums, exact_percentiles(steps, keys, wanted, method="nearest"), keys, "left")
