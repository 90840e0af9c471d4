"""Words, hashes and shingles of whole Arrow text columns, without a Python loop over words.

Every operator that reads text inside tasks uses the same three steps: cut a batch into slices of a few
megabytes (a longer text is a slice of its own), view the slice as one byte array, and work on that with numpy.
A word is a maximal run of bytes other than 00-2F, 3A-60 and 7B-7F after A-Z became a-z; since every byte above
7F belongs to a word, this is the same on bytes as on characters. Null texts count as empty texts.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 1 << 19
SHINGLE_WORDS = 5
FILTER_BITS = 22

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"): ord("Z") + 1] += 32
IS_WORD = np.ones(256, bool)
IS_WORD[0x00:0x30] = IS_WORD[0x3A:0x61] = IS_WORD[0x7B:0x80] = False

_MULTIPLIER = 0x9E3779B97F4A7C15
_WRAP = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULTIPLIER))
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash base and of its inverse modulo 2**64, kept between calls."""
    if len(_POWERS["up"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _MULTIPLIER), ("down", pow(_MULTIPLIER, -1, 1 << 64))):
            run = np.full(size, base, np.uint64)
            run[0] = 1
            _POWERS[name] = np.multiply.accumulate(run)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def release() -> None:
    """Give memory that is free back to the system: a worker outlives its tasks and would hold on to it."""
    for name, run in _POWERS.items():
        _POWERS[name] = run[: 1 << 16].copy()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator]) -> Callable[[Iterator[pa.RecordBatch]], Iterator]:
    """The batch function ``run``, which gives free memory back when its task has ended."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def rolling(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which :func:`span_hashes` reads the hash of any span of ``data``."""
    up, _ = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * up[: len(data)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal bytes have equal hashes wherever they stand."""
    _, down = powers(len(sums))
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offset of each text; null is an empty text."""
    plain = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "").cast(pa.large_binary())
    _, offsets, data = plain.buffers()
    at = np.frombuffer(offsets, np.int64)[plain.offset: plain.offset + len(plain) + 1] if len(plain) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0]: at[-1]], at - at[0]


def byte_slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch whose texts hold ``limit`` bytes at most; a longer text is a part of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


class Words:
    """Words of every text of a column: where they stand, which text they belong to, and their hashes."""

    def __init__(self, column: pa.Array):
        self.raw, self.offsets = text_bytes(column)
        self.lower = LOWER[self.raw]
        word = IS_WORD[self.lower]
        first = np.zeros(len(word) + 1, bool)
        first[self.offsets] = True
        before = np.zeros(len(word), bool)
        before[1:] = word[:-1]
        self.starts = np.flatnonzero(word & (~before | first[:-1]))
        after = np.zeros(len(word), bool)
        after[:-1] = word[1:]
        self.ends = np.flatnonzero(word & (~after | first[1:])) + 1
        #: Words of text i are self.of[i] to self.of[i + 1].
        self.of = np.searchsorted(self.starts, self.offsets)
        self._hashes: np.ndarray | None = None

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.of)

    @property
    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            self._hashes = span_hashes(rolling(self.lower), self.starts, self.ends)
        return self._hashes

    def shingles(self, k: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of all runs of ``k`` words, their offsets per text, and their first words.

        A text of fewer words, but not none, has one shingle of all its words.
        """
        counts = self.counts
        each = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
        of = np.concatenate([[0], np.cumsum(each)]).astype(np.int64)
        first = np.arange(of[-1]) + np.repeat(self.of[:-1] - of[:-1], each)
        return shingle_hashes(self.hashes, first, np.repeat(np.minimum(counts, k), each), k), of, first

    def text(self, first: int, last: int) -> str:
        """Lower-case words ``first`` to ``last - 1``, joined by one space."""
        return b" ".join(self.lower[a:b].tobytes() for a, b in zip(self.starts[first:last], self.ends[first:last])).decode("utf-8", "replace")


def shingle_hashes(words: np.ndarray, first: np.ndarray, lengths: np.ndarray, k: int) -> np.ndarray:
    """Hashes of word runs that begin at ``first``, of ``lengths`` words (``k`` at most)."""
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    weights = mix64(np.arange(1, k + 2, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
    total = lengths.astype(np.uint64) * weights[k]
    short = len(lengths) > 0 and int(lengths.min()) < k
    for j in range(k):
        part = padded[first + j] * weights[j]
        if short:
            part[lengths <= j] = 0
        total += part
    return mix64(total)


def text_key(column: Column) -> Column:
    """16 bytes that identify a text; null and the empty text share them."""
    return F.unhex(F.md5(F.coalesce(column, F.lit("")).cast("binary")))


def bitmap(tokens: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A filter of fixed size over a column ``token``: at most 2**bits / 64 rows reach the driver."""
    place = F.col("token").bitwiseAND(F.lit((1 << bits) - 1))
    rows = tokens.groupBy(F.shiftright(place, 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(token & 63 as int))")).alias("mask")).toArrow()
    filled = np.zeros(1 << (bits - 6), np.uint64)
    filled[rows["word"].to_numpy()] = rows["mask"].to_numpy().astype(np.int64).view(np.uint64)
    return np.unpackbits(filled.view(np.uint8), bitorder="little").view(bool)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Let an Arrow batch hold fewer rows than Spark's 10,000, unless the user chose a number: rows here are whole texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, str(rows))


def map_texts(
    docs: DataFrame,
    keep: list[Column],
    text: Column,
    outputs: str,
    compute: Callable[[pa.Array], list],
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """``keep`` columns and what ``compute`` returns for each text, one output row per input row.

    Rows stay where they are: no shuffle. Memory is bounded by ``slice_bytes`` or by the longest text.
    """
    frame = docs.select(*keep, text.cast("string").alias("__text"))
    kept = frame.schema.fields[:-1]
    made = T.StructType.fromDDL(outputs).fields
    schema = T.StructType(kept + made)
    names, at = [f.name for f in schema.fields], len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, at, slice_bytes):
                arrays = [part.column(i) for i in range(at)] + [x if isinstance(x, pa.Array) else pa.array(x) for x in compute(part.column(at))]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return frame.mapInArrow(released(run), schema)


def list_array(values, offsets: np.ndarray) -> pa.Array:
    """An Arrow list column from flat values and offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values if isinstance(values, pa.Array) else pa.array(values))


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64)
