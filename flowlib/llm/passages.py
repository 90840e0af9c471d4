"""Removal of repeated passages: every byte covered by a string of ``LENGTH`` bytes that also starts elsewhere.

1. Rows of one text become a node. Each window of LENGTH bytes is assigned to the leftmost smallest hash of its strings of
   ``GRAM`` bytes (its anchor). Equal windows have equal anchors at the same place, so windows of different anchors
   need never meet. Per node only anchors, the ranges of window starts they own and digests of those segments are
   kept: no text moves yet.
2. Segments (an owned range and the LENGTH - 1 bytes after it) are counted by anchor and digest, combined before the shuffle;
   anchors that occur once are done. Of each distinct segment one occurrence is read from its document.
3. Blocks of whole anchor groups, of a few megabytes, get a suffix array by two-stage sorting and common prefixes of
   neighbours. Windows of a run of prefixes of LENGTH or more are repeated if they occur twice, by segments' counts.
   An anchor of more than ``HOT_SEGMENTS`` distinct segments isn't put in one block: its windows are counted by digest,
   combined before the shuffle. Both ways give the same answer.
4. Repeated ranges go back to all occurrences by digest; the documents concerned are read again and cut.

Texts that occur in more than one row are repeated as a whole, if they have LENGTH bytes.

Defined results: null is the empty text; texts under LENGTH bytes are never cut; removal is by bytes, so what is left may
end or begin inside a character; strings are judged on the input, not on what is left; repeated rows are copies.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlib.llm.arrays import FILTER_BITS, bitmap, byte_slices, list_array, map_texts, released, rolling, signed, span_hashes, text_bytes, text_key
from flowlib.llm.neardup import whole_blocks
from flowlib.llm.suffixes import common_prefixes, suffix_array, words_at
from flowlib.scratch import stored

LENGTH, GRAM = 400, 128
BLOCK_BYTES = 2 << 20
HOT_SEGMENTS = 8192


def owned_ranges(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, first and last window start and segment hash of every owned range of all texts."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none.astype(np.uint64), none, none, none.astype(np.uint64)
    width, grams = length - gram + 1, len(data) - gram + 1
    sums = rolling(data)
    hashes = span_hashes(sums, np.arange(grams), np.arange(gram, len(data) + 1))
    # Hash above, place below: the smallest of a window is its leftmost smallest hash.
    keyed = np.full(-(-grams // width) * width, np.iinfo(np.uint64).max)
    keyed[:grams] = (hashes >> np.uint64(32) << np.uint64(32)) | np.arange(grams, dtype=np.uint64)
    rows = keyed.reshape(-1, width)
    upto = np.minimum.accumulate(rows, axis=1).ravel()
    onward = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = len(data) - length + 1
    anchor = (np.minimum(onward[:windows], upto[width - 1: width - 1 + windows]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    ends = np.repeat(offsets[1:], np.diff(offsets))[:windows]
    start = np.flatnonzero(ends - np.arange(windows) >= length)
    if not len(start):
        return none.astype(np.uint64), none, none, none.astype(np.uint64)
    owner = anchor[start]
    first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1)]))
    low, high = start[first], start[np.append(first[1:], len(start)) - 1]
    return hashes[owner[first]], low, high, span_hashes(sums, low, high + length)


def text_nodes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One stored row per distinct text: node, key, rep, copies, n_bytes and its segments."""

    def compute(column: pa.Array) -> list:
        data, offsets = text_bytes(column)
        anchor, low, high, digest = owned_ranges(data, offsets, length, gram)
        of = np.searchsorted(low, offsets)
        base = np.repeat(offsets[:-1], np.diff(of))
        rows = pa.StructArray.from_arrays([pa.array(signed(anchor)), pa.array(signed(digest)), pa.array((low - base).astype(np.int32)), pa.array((high - base).astype(np.int32))], ["h", "g", "low", "high"])
        return [pa.array(np.diff(offsets)), list_array(rows, of)]

    rows = map_texts(
        docs.select("doc_id", "text", text_key(F.col("text")).alias("key")),
        [F.col("doc_id"), F.col("key")], F.col("text"),
        "n_bytes bigint, segments array<struct<h: bigint, g: bigint, low: int, high: int>>", compute,
    )
    nodes = rows.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n_bytes").alias("n_bytes"), F.first("segments").alias("segments"))
    return stored(nodes.withColumn("node", F.monotonically_increasing_id()), "passage_nodes")


def with_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` rows (with __rep and __key) joined with one text each; other texts are left out before the shuffle."""
    mask = (1 << FILTER_BITS) - 1
    place = F.conv(F.substring(F.hex("__key"), 1, 8), 16, 10).cast("bigint").bitwiseAND(F.lit(mask))
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(wanted.select(place.alias("token")).distinct(), FILTER_BITS))
    frame = docs.select(F.col("doc_id").alias("__doc"), text_key(F.col("text")).alias("__text_key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def likely(batches):
        for batch in batches:
            first = np.array([int.from_bytes(k[:4], "big") for k in batch.column(1).to_pylist()], np.int64) & mask
            yield batch.filter(pa.array(shared.value[first]))

    return frame.mapInArrow(released(likely), frame.schema).join(wanted, F.col("__doc").eqNullSafe(F.col("__rep")) & (F.col("__text_key") == F.col("__key")))


def segment_texts(docs: DataFrame, nodes: DataFrame, distinct: DataFrame, length: int) -> DataFrame:
    """(h, g, c, text) of every distinct segment, read from the occurrence that stands for it."""
    lists = distinct.groupBy("node").agg(F.collect_list(F.struct("h", "g", "c", "low", "high")).alias("list"))
    wanted = nodes.select("node", F.col("rep").alias("__rep"), F.col("key").alias("__key")).join(lists, "node")

    def run(batches):
        for batch in batches:
            for part in byte_slices(batch, 0):
                data, offsets = text_bytes(part.column(0))
                lists = part.column(1)
                rows = lists.flatten()
                at = np.repeat(offsets[:-1], np.diff(lists.offsets.to_numpy()))
                low, high = (rows.field(i).to_numpy() + at for i in (3, 4))
                texts = pa.array([data[a:b].tobytes() for a, b in zip(low, high + length)], pa.binary())
                yield pa.RecordBatch.from_arrays([rows.field(0), rows.field(1), rows.field(2), texts], ["h", "g", "c", "text"])

    return with_texts(docs, wanted).select("text", "list").mapInArrow(released(run), "h bigint, g bigint, c bigint, text binary")


def repeated_windows(texts: list[bytes], counts: np.ndarray, length: int) -> list[np.ndarray]:
    """For each segment which of its window starts hold a string that occurs twice in all, ``counts`` times each."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(x for t in texts for x in (t, b"\xff")), np.uint8)
    begins = np.cumsum(sizes + 1) - (sizes + 1)
    segment = np.repeat(np.arange(len(texts)), sizes + 1)
    whole = (np.repeat(begins + sizes, sizes + 1) - np.arange(len(data))) >= length
    words = words_at(data)
    order = suffix_array(data, words)
    same = common_prefixes(data, words, order, length, whole) >= length
    run = np.cumsum(~same)
    weight = np.where(whole[order], counts[segment[order]], 0)
    total = np.bincount(run, weights=weight)
    repeated = np.zeros(len(data), bool)
    repeated[order] = whole[order] & (total[run] >= 2)
    return [repeated[a: a + n - length + 1] for a, n in zip(begins, sizes)]


def ranges(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and last place of every run of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist()))


def repeated_in_blocks(segments: DataFrame, blocks: int, length: int) -> DataFrame:
    """(h, g, a, b): repeated window starts inside segments, by suffix arrays of blocks of whole anchor groups."""
    rows = segments.select(F.pmod(F.xxhash64("h"), F.lit(blocks)).alias("block"), "h", "g", "c", "text").repartition(max(1, blocks), "block").sortWithinPartitions("block")

    def run(batches):
        for table in whole_blocks(batches):
            block = table["block"].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            for a, b in zip(starts, np.append(starts[1:], len(block))):
                part = table.slice(a, b - a)
                h, g = part["h"].to_numpy(), part["g"].to_numpy()
                flags = repeated_windows(part["text"].to_pylist(), part["c"].to_numpy(), length)
                out = [(i, x, y) for i, f in enumerate(flags) for x, y in ranges(f)]
                at = np.array([o[0] for o in out], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h[at]), pa.array(g[at]), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.int32())], ["h", "g", "a", "b"])

    return rows.mapInArrow(released(run), "h bigint, g bigint, a int, b int")


def repeated_by_digest(segments: DataFrame, length: int) -> DataFrame:
    """The same for anchors of very many distinct segments: windows counted by digest, combined before the shuffle."""

    def run(batches):
        for batch in batches:
            for part in byte_slices(batch, 3, 64 << 10):
                h, g, c, texts = (part.column(i).to_pylist() for i in range(4))
                rows = [(h[i], g[i], c[i], a, hashlib.blake2b(t[a: a + length], digest_size=16).digest()) for i, t in enumerate(texts) for a in range(len(t) - length + 1)]
                columns = list(zip(*rows)) if rows else [[]] * 5
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], ["h", "g", "c", "a", "window"])

    windows = segments.mapInArrow(released(run), "h bigint, g bigint, c bigint, a int, window binary")
    counted = windows.groupBy("h", "window").agg(F.sum("c").alias("n")).where("n > 1")
    return windows.join(counted, ["h", "window"]).select("h", "g", "a", F.col("a").alias("b"))


def repeated_ranges(docs: DataFrame, nodes: DataFrame, length: int = LENGTH, hot: int = HOT_SEGMENTS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(node, low, high): ranges of window starts that hold repeated strings, of texts that occur in one row."""
    spread = nodes.select("node", "copies", F.inline("segments"))
    each = spread.groupBy("h", "g").agg(F.count("*").alias("c"), F.min(F.struct("node", "low", "high")).alias("one"))
    groups = each.groupBy("h").agg(F.sum("c").alias("n"), F.count("*").alias("kinds")).where("n > 1")
    distinct = stored(each.join(groups, "h").select("h", "g", "c", "kinds", "one.*"), "passage_segments")
    bytes_in_all = distinct.where(F.col("kinds") <= hot).agg(F.sum(F.col("high") - F.col("low") + length)).first()[0] or 0
    texts = segment_texts(docs, nodes, distinct.where(F.col("kinds") <= hot), length)
    found = repeated_in_blocks(texts, int(bytes_in_all // block_bytes) + 1, length)
    if distinct.where(F.col("kinds") > hot).limit(1).count():
        found = found.union(repeated_by_digest(segment_texts(docs, nodes, distinct.where(F.col("kinds") > hot), length), length))
    found = stored(found, "passage_repeats")
    return spread.where("copies = 1").join(found, ["h", "g"]).select("node", (F.col("low") + F.col("a")).alias("low"), (F.col("low") + F.col("b")).alias("high"))


def cut(text: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> tuple[bytes, int, int]:
    """What is left of a text, the number of removed bytes and of removed runs."""
    change = np.zeros(len(text) + 1, np.int32)
    np.add.at(change, low, 1)
    np.add.at(change, high + length, -1)
    gone = np.cumsum(change[:-1]) > 0
    return text[~gone].tobytes(), int(gone.sum()), int(np.count_nonzero(np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1))


def cut_nodes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT_SEGMENTS) -> DataFrame:
    """(key, n_removed, n_spans, kept): every distinct text that loses bytes, with what is left of it."""
    nodes = text_nodes(docs, length, gram)
    lists = repeated_ranges(docs, nodes, length, hot).groupBy("node").agg(F.collect_list(F.struct("low", "high")).alias("list"))
    wanted = nodes.select("node", F.col("rep").alias("__rep"), F.col("key").alias("__key")).join(lists, "node")

    def run(batches):
        for batch in batches:
            for part in byte_slices(batch, 0):
                data, offsets = text_bytes(part.column(0))
                rows, of = part.column(1).flatten(), part.column(1).offsets.to_numpy()
                of = of - of[0]
                low, high = rows.field(0).to_numpy(), rows.field(1).to_numpy()
                done = [cut(data[a:b], low[x:y], high[x:y], length) for a, b, x, y in zip(offsets[:-1], offsets[1:], of[:-1], of[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column(2), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64()), pa.array([d[0] for d in done], pa.binary())],
                    ["key", "n_removed", "n_spans", "kept"],
                )

    partly = with_texts(docs, wanted).select("text", "list", F.col("__key").alias("key")).mapInArrow(released(run), "key binary, n_removed bigint, n_spans bigint, kept binary")
    copies = nodes.where((F.col("copies") > 1) & (F.col("n_bytes") >= length)).select("key", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("bigint").alias("n_spans"), F.lit(b"").alias("kept"))
    return partly.union(copies)


def removal(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT_SEGMENTS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and ``cut`` (whether it lost bytes) of every document."""
    found = cut_nodes(docs, length, gram, hot).select(F.col("key").alias("__key"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", F.octet_length(text).cast("bigint").alias("n_bytes"), F.sha2(text, 256).alias("whole"), text_key(F.col("text")).alias("__text"))
    none = F.lit(0).cast("bigint")
    return rows.join(found, F.col("__text") == F.col("__key"), "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"),
        (F.coalesce("n_removed", none) > 0).alias("cut"),
    )
