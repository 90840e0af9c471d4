"""Whether a run is complete, kept as state per run: its end marker has come and every offset before it was seen.

Only three numbers of a record go through the state: run, partition and offset. Offsets seen are kept as intervals, so a run that
arrives in order holds one per partition. A run that completes gives its row at once and lets go of its state; one that
doesn't gives a row when the watermark has passed its last record by the delay: ``gap`` with the number of missing offsets, or
``no_marker``. State and timers are Spark's own (``transformWithState``, event time); repeated records change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "run_tag string, status string, rows bigint, missing bigint"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def joined(spans: list[list[int]], offset: int) -> list[list[int]]:
    """Sorted disjoint intervals [first, end) with one more offset in them."""
    out: list[list[int]] = []
    new = [offset, offset + 1]
    for span in spans:
        if span[1] < new[0] or span[0] > new[1]:
            out.append(span)
        else:
            new = [min(span[0], new[0]), max(span[1], new[1])]
    return sorted([*out, new])


class Completion(StatefulProcessor):
    """State of one run: intervals of seen offsets and the end of each partition that has had its marker."""

    def __init__(self, delay_ms: int):
        self.delay_ms = delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spans = handle.getListState("spans", "part int, first bigint, end bigint")
        self.ends = handle.getMapState("ends", "part int", "end bigint")
        self.parts = handle.getValueState("parts", "parts int")
        self.last = handle.getValueState("last", "at_ms bigint")
        self.done = handle.getValueState("done", "done boolean")

    def _seen(self) -> dict[int, list[list[int]]]:
        seen: dict[int, list[list[int]]] = {}
        for part, first, end in self.spans.get() if self.spans.exists() else ():
            seen.setdefault(part, []).append([first, end])
        return seen

    def _ends(self) -> dict[int, int]:
        return {key[0]: value[0] for key, value in self.ends.iterator()} if self.ends.exists() else {}

    def _missing(self, seen: dict[int, list[list[int]]], ends: dict[int, int]) -> int:
        return sum(end - sum(max(0, min(b, end) - a) for a, b in seen.get(part, [])) for part, end in ends.items())

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802
        if self.done.exists():
            return
        seen, ends = self._seen(), self._ends()
        last = self.last.get()[0] if self.last.exists() else 0
        parts = self.parts.get()[0] if self.parts.exists() else None
        for row in rows:
            last = max(last, row.at_ms)
            if row.end_offset is not None:
                ends[row.kafka_partition] = row.end_offset
                self.ends.updateValue((row.kafka_partition,), (row.end_offset,))
                parts = row.parts
                self.parts.update((parts,))
            else:
                seen[row.kafka_partition] = joined(seen.get(row.kafka_partition, []), row.kafka_offset)
        # All partitions of the run must have ended, and hold all offsets before their ends.
        if len(ends) == parts and self._missing(seen, ends) == 0:
            # That the run is done is all that stays: late repeats must not begin it anew.
            self.spans.clear()
            self.ends.clear()
            self.last.clear()
            self.parts.clear()
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.done.update((True,))
            yield Row(run_tag=key[0], status="complete", rows=sum(ends.values()), missing=0)
            return
        self.spans.put([(part, a, b) for part, spans in seen.items() for a, b in spans])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.last.update((last,))
        self.handle.registerTimer(last + self.delay_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        seen, ends = self._seen(), self._ends()
        status = "gap" if self.parts.exists() and len(ends) == self.parts.get()[0] else "no_marker"
        held = sum(b - a for spans in seen.values() for a, b in spans)
        self.spans.clear()
        self.ends.clear()
        self.last.clear()
        self.parts.clear()
        self.done.update((True,))
        yield Row(run_tag=key[0], status=status, rows=held, missing=self._missing(seen, ends))

    def close(self) -> None:
        pass


def run_completion(records: DataFrame, delay_ms: int) -> DataFrame:
    """One row per run: ``complete``, ``gap`` or ``no_marker``, the offsets held and those missing.

    ``records`` is a stream with a watermark on ``at``, the time of a record: run_tag, kafka_partition, kafka_offset, ``end_offset`` and ``parts``. Only the
    end marker of a run's partition has the last two, the offset behind the partition's last record and the number of the run's
    partitions. Offsets begin at 0 in each of them. Needs the RocksDB state store (``PROVIDER``).
    """
    numbers = {"kafka_partition": "int", "kafka_offset": "bigint", "end_offset": "bigint", "parts": "int"}
    rows = records.select("run_tag", *[F.col(c).cast(kind).alias(c) for c, kind in numbers.items()], "at", F.unix_millis("at").alias("at_ms"))
    return rows.groupBy("run_tag").transformWithState(Completion(delay_ms), OUTPUT, "Append", "EventTime")
