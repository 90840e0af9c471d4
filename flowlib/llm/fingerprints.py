"""Document fingerprints by one-permutation MinHash with optimal densification and b-bit values.

Shingles of five words are hashed once; the leading bits name one of ``BINS`` bins, and each bin keeps its smallest
hash. An empty bin borrows from a bin chosen by a hash of (bin, attempt), attempt after attempt, until that one wasn't
empty: every text probes in the same order, so equal borrowings stay equal and two texts' bins agree with the
probability of their Jaccard similarity. Only the ``BITS`` low-order bits of a bin are stored, packed; two unequal bins
agree by chance once in 2**BITS, which :func:`likeness` takes out again.

:func:`edited_fingerprints` also builds, for each document, the text whose last half is replaced by the beginning of
the next document, in descending order of doc_id. Texts are range-partitioned and sorted once; inside a partition each
row meets its successor, and only one first and one last row per partition meet in a join.

Defined results: a text of fewer than five words has one shingle of all its words, and one without words (empty, null)
is its own shingle; null is the empty text; equal doc_ids are ordered by a digest of the text, null ids come last; a
single document is its own successor.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlib.llm.arrays import Words, byte_slices, map_texts, mix64, released, rolling, span_hashes, text_key
from flowlib.scratch import stored

BIN_BITS = 8
BINS = 1 << BIN_BITS
BITS = 4
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def _probe(bins: np.ndarray, attempt: int) -> np.ndarray:
    return (mix64(bins.astype(np.uint64) * np.uint64(1 << 32) + np.uint64(attempt + 1)) >> np.uint64(64 - BIN_BITS)).astype(np.int64)


def densified(bins: np.ndarray) -> np.ndarray:
    """A (texts, BINS) matrix of smallest hashes with its empty bins filled."""
    filled = bins != _EMPTY
    row, column = np.nonzero(~filled)
    attempt = 0
    while len(row):
        source = _probe(column, attempt)
        hit = filled[row, source]
        bins[row[hit], column[hit]] = bins[row[hit], source[hit]]
        row, column, attempt = row[~hit], column[~hit], attempt + 1
    return bins


def signatures(column: pa.Array) -> np.ndarray:
    """Packed fingerprints, one row of BINS * BITS / 8 bytes per text."""
    words = Words(column)
    hashes, of, _ = words.shingles()
    bare = np.flatnonzero(words.counts == 0)
    whole = span_hashes(rolling(words.raw), words.offsets[bare], words.offsets[bare + 1])
    owner = np.concatenate([np.repeat(np.arange(len(column)), np.diff(of)), bare])
    hashes = np.concatenate([hashes, whole])
    shift = np.uint64(64 - BIN_BITS)
    bins = np.full(len(column) * BINS, _EMPTY, np.uint64)
    np.minimum.at(bins, owner * BINS + (hashes >> shift).astype(np.int64), hashes & ((np.uint64(1) << shift) - np.uint64(1)))
    low = (densified(bins.reshape(-1, BINS)) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    return low[:, 0::2] << 4 | low[:, 1::2]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of packed fingerprints, row by row, without chance agreements; 0 to 1."""
    same = ((a >> 4) == (b >> 4)).sum(axis=1) + ((a & 15) == (b & 15)).sum(axis=1)
    chance = 1 / (1 << BITS)
    return np.clip((same / BINS - chance) / (1 - chance), 0.0, 1.0)


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns but the text, then ``fingerprint`` (binary); no shuffle."""
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in (text, "fingerprint")]
    return map_texts(docs, keep, F.col(f"`{text}`"), "fingerprint binary", lambda column: [binary_column(signatures(column))])


def binary_column(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


MADE = "n_chars bigint, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _compared(texts: pa.Array, following: pa.Array) -> list[pa.Array]:
    a, b = texts.to_pylist(), following.to_pylist()
    changed = [edited(x, y) for x, y in zip(a, b)]
    own, new, after = signatures(texts), signatures(pa.array(changed, pa.large_string())), signatures(following)
    return [
        pa.array([len(x) for x in a], pa.int64()),
        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed], pa.string()),
        binary_column(own), binary_column(new), pa.array(likeness(own, new)), pa.array(likeness(own, after)),
    ]


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints and their likenesses; one row per document."""
    order = [F.col("doc_id").desc_nulls_last(), F.col("key").desc()]
    sorted_docs = (
        docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), text_key(F.col("text")).alias("key"))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text")
    )
    id_field = sorted_docs.schema.fields[0]
    made = T.StructType.fromDDL(MADE).fields
    schema = T.StructType([id_field, *made, T.StructField("edge", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("text", T.StringType())])
    names = [f.name for f in schema.fields]

    def edge_row(kind: str, part: int, ids: pa.Array, text: pa.Array, types: list[pa.DataType]) -> pa.RecordBatch:
        blanks = [pa.nulls(1, t) for t in types]
        return pa.RecordBatch.from_arrays([ids, *blanks, pa.array([kind]), pa.array([part], pa.int32()), text], names)

    types = [pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]

    def run(batches):
        part, pending = TaskContext.get().partitionId(), None
        for batch in batches:
            for piece in byte_slices(batch, 1):
                ids, texts = piece.column(0), piece.column(1).cast(pa.string())
                if pending is None:
                    yield edge_row("first", part, ids[:1], texts[:1], types)
                else:
                    ids, texts = pa.concat_arrays([pending[0], ids]), pa.concat_arrays([pending[1], texts])
                n = len(ids) - 1
                if n:
                    none = pa.nulls(n, pa.string())
                    yield pa.RecordBatch.from_arrays([ids[:n], *_compared(texts[:n], texts[1:]), none, pa.nulls(n, pa.int32()), none], names)
                pending = pa.concat_arrays([ids[n:]]), pa.concat_arrays([texts[n:]])
        if pending is not None:
            yield edge_row("last", part, pending[0], pending[1], types)

    rows = stored(sorted_docs.mapInArrow(released(run), schema), "fingerprints")
    inner = rows.where("edge is null").select("doc_id", *[f.name for f in made])
    # One first and one last row per partition; only their numbers are ordered in one place.
    firsts = rows.where("edge = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("following"))
    lasts = rows.where("edge = 'last'").select("doc_id", "part", "text")
    ring = Window.orderBy("part")
    successor = F.coalesce(F.lead("part").over(ring), F.min("part").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    pairs = lasts.join(lasts.select("part").select(F.col("part"), successor.alias("next_part")), "part").join(firsts, "next_part").select("doc_id", "text", "following")

    def finish(batches):
        for batch in batches:
            for piece in byte_slices(batch, 1):
                texts, following = piece.column(1).cast(pa.string()), piece.column(2).cast(pa.string())
                yield pa.RecordBatch.from_arrays([piece.column(0), *_compared(texts, following)], names[: 1 + len(made)])

    return inner.unionByName(pairs.mapInArrow(released(finish), T.StructType([id_field, *made])))
