"""Near-duplicate classes by DartMinHash signatures, banded joining and an exact check.

An element of weight w owns the region [0, w) x [0, infinity) of positions and ranks. Darts fall on the plane of every
element as a Poisson process that depends on the element alone: arrival after arrival, each with a rank, a position
and a coordinate, all hashed. A set throws the darts that hit its regions below a rank bound at which about K ln K + 4 K
are expected in all, whatever the number of elements, and keeps the earliest per coordinate; sets that left a
coordinate empty go on to a higher bound. Two sets agree in a coordinate with the probability of their weighted Jaccard
similarity. Elements are shingles of five words, of weight 1 or weighted by their occurrences.

1. Rows of the same text become one node; its signature of ``K`` darts makes ``BANDS`` band hashes of ``ROWS`` darts.
2. Nodes that share a band hash meet in a task with one byte per dart, where those of estimated similarity
   ``ESTIMATE`` or more are linked (7 standard errors under the threshold), and stars of the linked are the output.
   Buckets over ``BLOCK`` nodes are dealt out as pairs of parts, so that any two still meet.
3. Components of these links are small groups of similar texts. A group's texts meet in a task (large groups again as
   pairs of parts) and all pairs that aren't yet connected are compared exactly; components of the true links are the
   classes. Pairs are compared inside tasks and never written.

Two texts of similarity 0.8 are missed by the bands with probability (1 - 0.8 ** 6) ** 40 = 5e-6, others less.

Defined results: null is the empty text; texts without words are near copies of equal texts only; a text of fewer
than five words has one shingle; class_id is the smallest doc_id of the class (null if it has none); repeated rows are
members like others; extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlib.llm.arrays import FILTER_BITS, Words, bitmap, byte_slices, list_array, map_texts, mix64, released, signed, text_key
from flowlib.llm.components import components
from flowlib.scratch import stored

THRESHOLD = 0.8
ESTIMATE = 0.62
BANDS, ROWS = 40, 6
K = BANDS * ROWS
BLOCK = 1024

_ARRIVAL = np.uint64(0xA24BAED4963EE407)
_LAYER = np.uint64(0x9FB21C651E98DF25)


def _uniform(x: np.ndarray) -> np.ndarray:
    """Hashes to numbers in (0, 1]."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * (1.0 / (1 << 53))


def _throw(seed: np.ndarray, width: np.ndarray, low: np.ndarray, weight: np.ndarray, bound: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All darts that hit regions below their rank bound: cell (row, coordinate), rank and identity."""
    cells, ranks, names = [], [], []
    reached, drawn, block = np.zeros(len(seed)), 0, 1
    while len(seed):
        number = np.arange(drawn + 1, drawn + block + 1, dtype=np.uint64)
        dart = mix64(seed[:, None] + number[None, :] * _ARRIVAL)
        rank = reached[:, None] + np.cumsum(-np.log(_uniform(dart)) / width[:, None], axis=1)
        name = mix64(dart)
        hit = (rank < bound[:, None]) & (low[:, None] + width[:, None] * _uniform(mix64(name)) < weight[:, None] + 1e-12)
        at, _ = np.nonzero(hit)
        chosen = name[hit]
        cells.append(row[at] * k + ((chosen >> np.uint64(32)) % np.uint64(k)).astype(np.int64))
        ranks.append(rank[hit])
        names.append(chosen)
        more = rank[:, -1] < bound
        seed, width, low, weight, bound, row, reached = seed[more], width[more], low[more], weight[more], bound[more], row[more], rank[more, -1]
        drawn, block = drawn + block, min(512, block * 4)
    return np.concatenate(cells), np.concatenate(ranks), np.concatenate(names)


def dart_signatures(elements: np.ndarray, weights: np.ndarray, of: np.ndarray, k: int = K) -> np.ndarray:
    """(sets, k) matrix of dart identities; set i has elements of[i]:of[i + 1]. Empty sets have zeros.

    An element that is listed twice with one weight counts once.
    """
    out = np.zeros((len(of) - 1, k), np.uint64)
    sizes = np.diff(of)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    total = np.bincount(owner, weights=weights, minlength=len(sizes))
    # Layer 0 holds positions under 1, layer v those from 2 ** (v - 1) to 2 ** v.
    layers = np.maximum(0, np.ceil(np.log2(np.maximum(weights, 1e-300)))).astype(np.int64) + 1 if len(weights) else np.zeros(0, np.int64)
    which = np.repeat(np.arange(len(elements)), layers)
    layer = np.arange(len(which)) - np.repeat(np.cumsum(layers) - layers, layers)
    low = np.where(layer == 0, 0.0, 2.0 ** (layer - 1))
    width = np.where(layer == 0, 1.0, low)
    seed = mix64(elements[which] + (layer + 1).astype(np.uint64) * _LAYER)
    heavy, set_of = weights[which], owner[which]
    bound = k * (np.log(k) + 4) / np.maximum(total, 1e-300)
    open_sets = np.flatnonzero(sizes)
    while len(open_sets):
        row = np.full(len(sizes), -1)
        row[open_sets] = np.arange(len(open_sets))
        mine = row[set_of] >= 0
        at = row[set_of[mine]]
        cell, rank, name = _throw(seed[mine], width[mine], low[mine], heavy[mine], bound[set_of[mine]], at, k)
        earliest = np.full(len(open_sets) * k, np.inf)
        np.minimum.at(earliest, cell, rank)
        kept = np.zeros(len(earliest), np.uint64)
        won = rank == earliest[cell]
        kept[cell[won]] = name[won]
        full = np.isfinite(earliest).reshape(-1, k).all(axis=1)
        out[open_sets[full]] = kept.reshape(-1, k)[full]
        open_sets = open_sets[~full]
        bound[open_sets] *= 2
    return out


def text_signatures(column: pa.Array, k: int = K, weighting: str = "set") -> tuple[np.ndarray, np.ndarray]:
    """Signatures of a text column, and which texts have words."""
    words = Words(column)
    hashes, of, _ = words.shingles()
    # Darts are thrown for distinct shingles: repeats would cost memory in each of the sets' rounds.
    owner = np.repeat(np.arange(len(column)), np.diff(of))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    fresh = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])]) if len(hashes) else np.zeros(0, bool)
    starts = np.flatnonzero(fresh)
    weights = np.diff(np.append(starts, len(hashes))).astype(np.float64) if weighting == "count" else np.ones(len(starts))
    hashes, owner = hashes[starts], owner[starts]
    of = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(column)))])
    return dart_signatures(hashes, weights, of, k), words.counts > 0


def band_hashes(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """(sets, bands) hashes of consecutive coordinates, different for each band."""
    weights = mix64(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
    parts = signatures[:, : bands * rows].reshape(-1, bands, rows)
    return mix64((parts * weights).sum(axis=2, dtype=np.uint64) + mix64(np.arange(1000, 1000 + bands, dtype=np.uint64)))


def signature_nodes(docs: DataFrame, weighting: str = "set") -> DataFrame:
    """One stored row per distinct text: node, key, rep (smallest doc_id), copies, bands and one byte per dart."""

    def compute(column: pa.Array) -> list:
        signatures, worded = text_signatures(column, weighting=weighting)
        of = np.concatenate([[0], np.cumsum(np.where(worded, BANDS, 0))])
        small = (signatures & np.uint64(0xFF)).astype(np.uint8)
        return [list_array(signed(band_hashes(signatures[worded]).ravel()), of), pa.array([r.tobytes() for r in small], pa.binary())]

    rows = map_texts(
        docs.select("doc_id", "text", text_key(F.col("text")).alias("key")), [F.col("doc_id"), F.col("key")], F.col("text"), "bands array<bigint>, darts binary", compute
    )
    nodes = rows.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("darts").alias("darts"))
    return stored(nodes.withColumn("node", F.monotonically_increasing_id()), "dart_nodes")


def in_blocks(rows: DataFrame, group: str, size: Column, block: int = BLOCK) -> DataFrame:
    """Rows with a ``block``: a group over ``block`` rows is cut in parts, and every two parts meet in one block."""
    parts = F.ceil(size / block).cast("int")
    placed = rows.withColumns({"__parts": parts}).withColumn("__own", F.pmod(F.xxhash64("node"), F.col("__parts")).cast("int"))
    placed = placed.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)))
    name = F.least("__own", "__other") * F.col("__parts") + F.greatest("__own", "__other")
    return placed.withColumn("block", F.xxhash64(F.col(group), name)).drop("__parts", "__own", "__other")


def whole_blocks(batches: Iterator[pa.RecordBatch], limit: int = 50_000) -> Iterator[pa.Table]:
    """Tables in which every block (sorted, first column) is whole."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        block = batch.column(0).to_numpy()
        cut = int(np.flatnonzero(block != block[-1])[-1] + 1) if block[0] != block[-1] else 0
        if held and (cut or held[-1].column(0)[-1].as_py() != block[0]):
            # What is held ends with the block that this batch begins with, or before it.
            if held[-1].column(0)[-1].as_py() == block[0]:
                first = int(np.flatnonzero(block != block[0])[0])
                held.append(batch.slice(0, first))
                batch, cut = batch.slice(first), cut - first
            yield pa.Table.from_batches(held)
            held = []
        if cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def linked_by_darts(darts: np.ndarray, block: np.ndarray, least: float) -> np.ndarray:
    """For each row the row of its block whose star it joins (itself, if none); rows of a block stand together."""
    starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    ends = np.append(starts[1:], len(block))
    root = np.repeat(starts, ends - starts)
    need = least * darts.shape[1]
    same = np.empty(len(block), np.int64)
    for a in range(0, len(block), 65536):
        same[a: a + 65536] = (darts[a: a + 65536] == darts[root[a: a + 65536]]).sum(axis=1)
    alone = same < need
    for a, b in zip(starts[np.logical_or.reduceat(alone, starts)], ends[np.logical_or.reduceat(alone, starts)]):
        # Not all are like the first: follow links until none is left to follow.
        left = np.arange(a, b)
        while len(left):
            head, front, left = left[0], [left[0]], left[1:]
            root[head] = head
            while front and len(left):
                near = (darts[left] == darts[front.pop()]).sum(axis=1) >= need
                root[left[near]] = head
                front.extend(left[near].tolist())
                left = left[~near]
    return root


def candidate_links(nodes: DataFrame, block: int = BLOCK, least: float = ESTIMATE) -> DataFrame:
    """Stored stars (u, v) of nodes that share a band and whose darts agree often enough."""
    spread = nodes.select("node", F.explode("bands").alias("band"))
    shared = spread.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    members = in_blocks(spread.join(shared, "band"), "band", F.col("n"), block).select("block", "node")
    rows = members.join(nodes.select("node", "darts"), "node").select("block", "node", "darts").repartition("block").sortWithinPartitions("block")

    def run(batches):
        for table in whole_blocks(batches):
            node = table["node"].to_numpy()
            darts = np.frombuffer(b"".join(table["darts"].to_pylist()), np.uint8).reshape(len(node), -1)
            root = linked_by_darts(darts, table["block"].to_numpy(), least)
            linked = np.flatnonzero(node[root] != node)
            pairs = np.unique(np.stack([node[linked], node[root[linked]]], axis=1), axis=0) if len(linked) else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

    return rows.mapInArrow(released(run), "u bigint, v bigint")


class Sets:
    """Distinct shingles of texts, numbered across the texts, with the texts that hold each."""

    def __init__(self, column: pa.Array):
        hashes, of, _ = Words(column).shingles()
        owner = np.repeat(np.arange(len(column)), np.diff(of))
        _, number = np.unique(hashes, return_inverse=True)
        pair = np.unique(owner.astype(np.int64) << 32 | number)
        self.owner, self.number = pair >> 32, pair & 0xFFFFFFFF
        self.sizes = np.bincount(self.owner, minlength=len(column))
        self.of = np.concatenate([[0], np.cumsum(self.sizes)])
        order = np.argsort(self.number, kind="stable")
        self.holders = self.owner[order]
        counts = np.bincount(self.number, minlength=int(self.number.max()) + 1 if len(self.number) else 0)
        self.holders_of = np.concatenate([[0], np.cumsum(counts)])

    def shared(self, i: int) -> np.ndarray:
        """Shingles that text i has in common with each text."""
        mine = self.number[self.of[i]: self.of[i + 1]]
        begin, size = self.holders_of[mine], self.holders_of[mine + 1] - self.holders_of[mine]
        at = np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)
        return np.bincount(self.holders[at], minlength=len(self.sizes))


def linked_exactly(column: pa.Array, threshold: float) -> np.ndarray:
    """For each text of a group the first text of its component of true links."""
    sets = Sets(column)
    label = np.arange(len(sets.sizes))
    for i in range(len(label)):
        if (label == label[i]).all():
            break
        common = sets.shared(i)
        near = (common >= threshold * (sets.sizes[i] + sets.sizes - common)) & (common > 0)
        near &= label != label[i]
        if near.any():
            joined = np.unique(np.append(label[near], label[i]))
            label[np.isin(label, joined)] = joined[0]
    return label


def true_links(docs: DataFrame, nodes: DataFrame, groups: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Stars (u, v) of nodes whose shingle sets reach the threshold; ``groups`` says which nodes to compare."""
    sizes = groups.groupBy("root").agg(F.count("*").alias("n"))
    wanted = nodes.select("node", F.col("rep").alias("__rep"), F.col("key").alias("__key")).join(groups, "node").join(sizes, "root")
    mask = (1 << FILTER_BITS) - 1
    place = F.conv(F.substring(F.hex("__key"), 1, 8), 16, 10).cast("bigint").bitwiseAND(F.lit(mask))
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(wanted.select(place.alias("token")).distinct(), FILTER_BITS))
    frame = docs.select(F.col("doc_id").alias("__doc"), text_key(F.col("text")).alias("__text_key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def likely(batches):
        for batch in batches:
            first = np.array([int.from_bytes(k[:4], "big") for k in batch.column(1).to_pylist()], np.int64) & mask
            yield batch.filter(pa.array(shared.value[first]))

    texts = frame.mapInArrow(released(likely), frame.schema).join(wanted, F.col("__doc").eqNullSafe(F.col("__rep")) & (F.col("__text_key") == F.col("__key")))
    rows = in_blocks(texts.select("root", "n", "node", "text"), "root", F.col("n"), block).select("block", "node", "text")

    def run(batches):
        for table in whole_blocks(small for batch in batches for small in byte_slices(batch, 2)):
            block_of, node, text = table["block"].to_numpy(), table["node"].to_numpy(), table["text"].combine_chunks()
            starts = np.flatnonzero(np.concatenate([[True], block_of[1:] != block_of[:-1]]))
            u, v = [], []
            for a, b in zip(starts, np.append(starts[1:], len(node))):
                if b - a > 1:
                    label = linked_exactly(text.slice(a, b - a), threshold)
                    u.append(node[a:b])
                    v.append(node[a + label])
            pairs = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (u, v)]
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["u", "v"])

    return rows.repartition("block").sortWithinPartitions("block").mapInArrow(released(run), "u bigint, v bigint")


def node_classes(docs: DataFrame, threshold: float = THRESHOLD, weighting: str = "set") -> DataFrame:
    """Stored rows (key, rep, copies, root): every distinct text with the root of its class."""
    nodes = signature_nodes(docs, weighting)
    groups = components(candidate_links(nodes))
    links = components(true_links(docs, nodes, groups, threshold))
    return stored(nodes.select("node", "key", "rep", "copies").join(links, "node", "left").select("key", "rep", "copies", F.coalesce("root", "node").alias("root")), "dart_classes")


def classes(docs: DataFrame, threshold: float = THRESHOLD, weighting: str = "set") -> DataFrame:
    """doc_id, class_id and class_size of every document."""
    found = node_classes(docs, threshold, weighting)
    whole = found.groupBy("root").agg(F.min("rep").alias("class_id"), F.sum("copies").alias("class_size"))
    named = found.join(whole, "root").select(F.col("key").alias("__key"), "class_id", "class_size")
    rows = docs.select("doc_id", text_key(F.col("text")).alias("__text"))
    return rows.join(named, F.col("__text") == F.col("__key")).select("doc_id", "class_id", "class_size")


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD, weighting: str = "set") -> DataFrame:
    """One document of each class (that of the smallest doc_id), with all its columns."""
    found = node_classes(docs, threshold, weighting)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), F.col("rep"), F.col("key"))).alias("first"))
    kept = first.select(F.col("first.rep").alias("__rep"), F.col("first.key").alias("__key"))
    packed = docs.select(F.struct("*").alias("__row"), F.col("doc_id").alias("__doc"), text_key(F.col("text")).alias("__text"))
    rows = packed.join(kept, (F.col("__text") == F.col("__key")) & F.col("__doc").eqNullSafe(F.col("__rep")), "left_semi")
    # Rows of one doc_id and one text: any is as good as another.
    once = F.row_number().over(Window.partitionBy("__text", "__doc").orderBy(F.lit(1)))
    return rows.withColumn("__n", once).where("__n = 1").select("__row.*")
