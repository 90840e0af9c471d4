"""Token ids in training order: fixed-stride binary shards, ordered by a keyed permutation.

Documents become token ids (16 bits) with one end token after each, cut into sequences of ``LENGTH`` ids; the last one of a
document is padded with end tokens. A record is 2 * LENGTH + 16 bytes: doc_id (int64), number of the sequence in its document (uint32),
ids in use (uint16), a zero byte, the ids (uint16 each), and a line break; all little-endian.

Order: every document gets a run of numbers that is long enough for any encoding of its bytes (a byte gives one id at
most), by a first pass over lengths alone. A keyed Feistel network with cycle-walking permutes that whole range, so
each sequence has a number of its own in it without a second pass over the tokens; the range is dealt out in equal
parts, one shard each, and inside a shard the numbers are sorted. A sequence's global slot is its place in that order,
0 to N - 1. One shuffle moves the records; Spark's text writer, whose commits make lost executors harmless, writes them
(the line break of a record is the writer's line end), so shards can go to any store that Spark writes to.

Both passes must see the same rows in the same order, as a scan of stored files gives; the second verifies a checksum
of each partition's ids and texts in their order and fails instead of writing a wrong order. A reader needs only the shards that its slots lie in.

Defined results: null and empty texts give one sequence that holds the end token alone; repeated rows give sequences of
their own; a null doc_id is written as -2**63; no documents give no shards; ids that don't fit 16 bits are an error, and the
end token is a parameter (``END`` is that of one public vocabulary). A corpus has ``MAX_SHARDS`` shards at most: from 16 TB of
records on, shards grow instead, and with them what a reading task holds.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlib.llm.arrays import byte_slices, mix64, released, text_bytes
from flowlib.llm.tokens import SLICE_BYTES, encoder

LENGTH = 512
ROUNDS = 6
SEED = 20240607
SHARD_BYTES = 16 << 20
MAX_SHARDS = 1_000_000
END = 50256
NO_ID = -(1 << 63)


def record_type(length: int = LENGTH) -> np.dtype:
    return np.dtype([("doc_id", "<i8"), ("sequence", "<u4"), ("used", "<u2"), ("zero", "u1"), ("ids", "<u2", (length,)), ("end", "u1")])


def permuted(numbers: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """A keyed permutation of 0 to n - 1: a balanced Feistel network, repeated until the number is in range."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = mix64(np.array([(r + seed * 0x9E3779B97F4A7C15) % (1 << 64) for r in range(1, ROUNDS + 1)], np.uint64))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for key in keys:
            left, right = right, left ^ (mix64(right + key) & mask)
        return (left << shift) | right

    out = once(numbers.astype(np.uint64))
    outside = np.flatnonzero(out >= np.uint64(n))
    while len(outside):
        out[outside] = once(out[outside])
        outside = outside[out[outside] >= np.uint64(n)]
    return out.astype(np.int64)


def _rooms(column: pa.Array, length: int) -> np.ndarray:
    """Sequences that a text can have at most."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return sizes // length + 1


class Checksum:
    """A running checksum of ids and texts in their order, the same however the rows are cut into slices."""

    def __init__(self) -> None:
        self.rows, self.bytes = hashlib.blake2b(), hashlib.blake2b()

    def add(self, ids: pa.Array, texts: pa.Array) -> None:
        data, offsets = text_bytes(texts)
        numbers = pc.fill_null(ids, NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
        self.rows.update(np.stack([numbers, np.diff(offsets)], axis=1).tobytes())
        self.bytes.update(np.ascontiguousarray(data))

    def value(self) -> int:
        return int.from_bytes(hashlib.blake2b(self.rows.digest() + self.bytes.digest(), digest_size=8).digest(), "little", signed=True)


def _records(docs: DataFrame, path: str, end: int, length: int, shards_for: int, seed: int) -> tuple[DataFrame, int]:
    frame = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def measure(batches):
        rooms, check = 0, Checksum()
        for batch in batches:
            for part in byte_slices(batch, 1):
                rooms += int(_rooms(part.column(1), length).sum())
                check.add(part.column(0), part.column(1))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([rooms], pa.int64()), pa.array([check.value()], pa.int64())], ["part", "rooms", "seen"])

    # One row of three numbers per input partition.
    rows = sorted(tuple(r) for r in frame.mapInArrow(released(measure), "part int, rooms bigint, seen bigint").collect())
    begins, total = {}, 0
    for part, rooms, check in rows:
        begins[part] = (total, check)
        total += rooms
    shards = min(MAX_SHARDS, max(1, -(-total * record_type(length).itemsize // shards_for)))
    shared = docs.sparkSession.sparkContext.broadcast(begins)

    def encode(batches):
        begin, expected = shared.value[TaskContext.get().partitionId()]
        check = Checksum()
        for batch in batches:
            for part in byte_slices(batch, 1, SLICE_BYTES):
                rooms = _rooms(part.column(1), length)
                check.add(part.column(0), part.column(1))
                base = begin + np.cumsum(rooms) - rooms
                begin += int(rooms.sum())
                slot, out = sequences(part.column(0), part.column(1), base, path, end, length, total, seed)
                shard = (slot // -(-total // shards)).astype(np.int32)
                payload = np.ascontiguousarray(out).view(np.uint8).reshape(len(out), -1)[:, :-1]
                size = payload.shape[1]
                flat = pa.py_buffer(np.ascontiguousarray(payload))
                binary = pa.BinaryArray.from_buffers(pa.binary(), len(out), [None, pa.py_buffer((np.arange(len(out) + 1) * size).astype(np.int32)), flat])
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(slot), binary], ["shard", "number", "record"])
        encoder(path, "ids").forget()  # the worker goes on to other work
        if check.value() != expected:
            raise RuntimeError("documents came with other content or in another order than in the first pass; store them before writing shards")

    return frame.mapInArrow(released(encode), "shard int, number bigint, record binary"), shards


def sequences(ids: pa.Array, texts: pa.Array, base: np.ndarray, path: str, end: int, length: int, total: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Permuted numbers and records of all sequences of a slice."""
    tokens, of = encoder(path, "ids").encode(texts)
    if max(int(tokens.max(initial=0)), end) > 0xFFFF:
        raise ValueError("an id over 65,535 doesn't fit the 16 bits of a record: this format is for vocabularies of 65,536 entries at most")
    sizes = np.diff(of) + 1
    parts = -(-sizes // length)
    out = np.zeros(int(parts.sum()), record_type(length))
    first = np.cumsum(parts) - parts
    doc = np.repeat(np.arange(len(parts)), parts)
    number = np.arange(len(out)) - np.repeat(first, parts)
    out["doc_id"] = pc.fill_null(ids, NO_ID).to_numpy(zero_copy_only=False)[doc]
    out["sequence"] = number
    out["used"] = np.minimum(length, sizes[doc] - number * length)
    out["end"] = 0x0A
    grid = np.full((len(out), length), end, np.uint16)
    flat = np.arange(len(tokens)) - np.repeat(of[:-1] - first * length, np.diff(of))
    grid.ravel()[flat] = tokens
    out["ids"] = grid
    return permuted(base[doc] + number, total, seed), out


def write_shards(docs: DataFrame, target: str, path: str, end: int = END, length: int = LENGTH, shard_bytes: int = SHARD_BYTES, seed: int = SEED) -> None:
    """Write the shards of ``docs`` to the new folder ``target``; file part-N holds shard N."""
    records, shards = _records(docs, path, end, length, shard_bytes, seed)
    ordered = records.repartitionById(shards, F.col("shard")).sortWithinPartitions("number")
    ordered.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\n").text(target)


def manifest(spark: SparkSession, target: str, length: int = LENGTH) -> DataFrame:
    """(shard, path, first_slot, sequences): one row per file, from the files' lengths."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(target)
    sized = files.select(F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("shard"), "path", (F.col("length") / record_type(length).itemsize).cast("bigint").alias("sequences")).where("sequences > 0")
    before = F.sum("sequences").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    return sized.select("shard", "path", F.coalesce(before, F.lit(0)).alias("first_slot"), "sequences")


def read_shards(spark: SparkSession, target: str, length: int = LENGTH, first: int = 0, last: int | None = None) -> DataFrame:
    """(slot, shard, place, doc_id, sequence, n_ids, ids) of the slots ``first`` to ``last - 1``; ids as stored, 2 bytes each.

    Only files that hold such slots are read; inside a file every record is found by its stride.
    """
    wanted = manifest(spark, target, length).where(F.col("first_slot") + F.col("sequences") > first)
    wanted = wanted.where(F.col("first_slot") < last) if last is not None else wanted
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(target).select(F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("shard"), "content")
    # Two numbers per shard, and MAX_SHARDS at most: the files' contents aren't shuffled.
    rows = files.join(F.broadcast(wanted.select("shard", "first_slot")), "shard").select("content", "shard", "first_slot")
    kind = record_type(length)

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                found = np.frombuffer(batch.column(0)[i].as_buffer(), kind)
                if not (found["end"] == 0x0A).all():
                    raise ValueError("a record doesn't end where its stride does")
                slot = batch.column(2)[i].as_py() + np.arange(len(found))
                for a in range(0, len(found), 2000):
                    part, at = found[a: a + 2000], slot[a: a + 2000]
                    ids = [r["ids"][: r["used"]].tobytes() for r in part]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(at), pa.array(np.full(len(part), batch.column(1)[i].as_py()), pa.int32()), pa.array(np.arange(a, a + len(part))),
                         pa.array(part["doc_id"].astype(np.int64), mask=part["doc_id"] == NO_ID), pa.array(part["sequence"].astype(np.int64)), pa.array(part["used"].astype(np.int64)), pa.array(ids, pa.binary())],
                        ["slot", "shard", "place", "doc_id", "sequence", "n_ids", "ids"],
                    )

    out = rows.mapInArrow(released(run), "slot bigint, shard int, place bigint, doc_id bigint, sequence bigint, n_ids bigint, ids binary")
    out = out.where(F.col("slot") >= first)
    return out.where(F.col("slot") < last) if last is not None else out
