"""Quality classifier: learned hashed word and character n-gram vectors, averaged per document, softmax on top.

A document's features are its words (runs without white space, as they are written), pairs of neighbouring words (hashed
by the difference of their hashes, so that all repetitions of a word share a bucket) and the runs of 3 and 4 bytes
inside a word or over one of its edges, each hashed to one of ``BUCKETS`` vectors. The mean of the vectors goes through
a linear layer of two outputs and a softmax; vectors and layer are learned together by stochastic gradient descent in
numpy, one document a step, with a falling rate.

Learning uses a bounded sample: the ``max_rows`` labelled ids (half of them of each class at most) with the
smallest seeded hash of doc_id, each with one label and one text whatever its number of rows. Only bucket counts of these rows reach the driver, so what it holds doesn't grow with
the corpus. The sample's balance is corrected by the classes' shares among all labelled ids.

Scoring reads every text whole. As averaging and the linear layer commute, the trained model is one number per bucket,
and a score is the logistic function of their mean: no matrix is built per document.

Defined results: null and empty texts have one feature of their own; without labelled rows, or with one class only,
every score is the (smoothed) share of class 1; labels other than 0 and 1 and null doc_ids aren't learned from;
an id labelled more than once has its most frequent label (0, if both are as frequent), and one with several texts is
learned from by that of the smallest text key;
repeated rows are scored each for itself; extra columns pass through, and one named like a result is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlib.llm.arrays import byte_slices, list_array, map_texts, mix64, release, released, rolling, span_hashes, text_bytes, text_key

BUCKET_BITS = 17
BUCKETS = 1 << BUCKET_BITS
DIMENSIONS = 16
GRAMS = (3, 4)
MAX_ROWS = 4000
EPOCHS = 4
RATE = 0.5
SEED = 11
THRESHOLD = 0.7

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_EMPTY = 0


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of all features of all texts, and their offsets per text; every text has one at least."""
    data, offsets = text_bytes(column)
    space = SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = space[:-1]
    starts = np.flatnonzero(~space & (edge[:-1] | first[:-1]))
    edge[:-1] = space
    ends = np.flatnonzero(~space & (edge[1:] | first[1:])) + 1
    rank = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)).astype(np.int32)
    words = span_hashes(rolling(data), starts, ends)
    pairs = np.flatnonzero(rank[starts[1:]] == rank[starts[:-1]])
    owners = [rank[starts], rank[starts[pairs]]]
    buckets = [words, mix64(words[pairs + 1] - words[pairs] + np.uint64(1))]
    wide = np.where(space, np.uint8(0x20), data).astype(np.uint32)
    for n in GRAMS:
        if len(data) < n:
            continue
        size = len(data) - n + 1
        code = np.full(size, n, np.uint64) << np.uint64(40)
        for j in range(n):
            code |= wide[j: j + size].astype(np.uint64) << np.uint64(8 * j)
        inner = np.zeros(size, bool)
        for j in range(1, n - 1):
            inner |= space[j: j + size]
        at = np.flatnonzero(~inner & ~(space[:size] & space[n - 1:]) & (rank[:size] == rank[n - 1:]))
        owners.append(rank[at])
        buckets.append(mix64(code[at]))
    empty = np.flatnonzero(np.bincount(owners[0], minlength=len(offsets) - 1) == 0).astype(np.int32)
    owners.append(empty)
    owner = np.concatenate(owners)
    bucket = np.concatenate([(b >> np.uint64(64 - BUCKET_BITS)).astype(np.int32) for b in buckets] + [np.full(len(empty), _EMPTY, np.int32)])
    order = np.argsort(owner, kind="stable")
    return bucket[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(offsets) - 1))]).astype(np.int64)


@dataclass
class Model:
    """What scoring needs: one weight per bucket and the bias of class 1 against class 0."""

    weights: np.ndarray
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        buckets, of = features(column)
        run = np.concatenate([[0.0], np.cumsum(self.weights[buckets], dtype=np.float64)])
        mean = (run[of[1:]] - run[of[:-1]]) / np.diff(of)
        return 1 / (1 + np.exp(-np.clip(mean + self.bias, -40, 40)))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], share: float, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    """Learn from (buckets, shares of the text, label) rows; ``share`` is class 1's share among all labelled ids."""
    labels = np.array([r[2] for r in rows], np.int64)
    prior = float(np.log(share / (1 - share)))
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(BUCKETS, np.float32), prior)
    draw = np.random.default_rng(seed)
    vectors = draw.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    layer, bias = np.zeros((DIMENSIONS, 2), np.float32), np.zeros(2, np.float32)
    steps, step = epochs * len(rows), 0
    for _ in range(epochs):
        for i in draw.permutation(len(rows)):
            buckets, parts_of, _ = rows[i]
            mean = parts_of @ vectors[buckets]
            logits = mean @ layer + bias
            chance = np.exp(logits - logits.max())
            chance /= chance.sum()
            chance[labels[i]] -= 1
            pace = np.float32(rate * (1 - step / steps))
            back = layer @ chance
            layer -= pace * np.outer(mean, chance)
            bias -= pace * chance
            vectors[buckets] -= (pace * parts_of[:, None]) * (back * len(buckets) ** 0.5)
            step += 1
    sample = float(labels.mean())
    towards = layer[:, 1] - layer[:, 0]
    return Model(vectors @ towards, float(bias[1] - bias[0]) + prior - float(np.log(sample / (1 - sample))))


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of doc_id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS) -> Model:
    """Learn ``label`` from a bounded sample of the labelled documents that aren't held out."""
    marked = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y"))
    usable = marked.where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id")))
    # One label per id, the more frequent one.
    usable = usable.groupBy("id").agg((2 * F.sum("y") > F.count("*")).cast("int").alias("y")).join(docs.select(F.col("doc_id").alias("id")).distinct(), "id", "left_semi")
    order = [F.md5(F.concat(F.lit(f"{SEED}:"), F.col("id").cast("string"))), "id"]
    counts = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = (counts.get(1, 0) + 1) / (counts.get(0, 0) + counts.get(1, 0) + 2)
    chosen = usable.where("y = 0").orderBy(*order).limit(max_rows // 2).union(usable.where("y = 1").orderBy(*order).limit(max_rows // 2))
    # The sample has max_rows ids at most; its size is what makes the broadcast safe. One text per id reaches the driver.
    named = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    sample = named.groupBy("id", "y").agg(F.min_by("text", text_key(F.col("text"))).alias("text"))

    def counted(column: pa.Array) -> list:
        buckets, of = features(column)
        pairs = [np.unique(buckets[a:b], return_counts=True) for a, b in zip(of[:-1], of[1:])]
        at = np.concatenate([[0], np.cumsum([len(b) for b, _ in pairs])])
        flat = [np.concatenate([p[0] for p in pairs]).astype(np.int32), np.concatenate([(n / n.sum()).astype(np.float32) for _, n in pairs])]
        return [list_array(pa.array(flat[0]), at), list_array(pa.array(flat[1]), at)]

    collected = map_texts(sample, [F.col("id"), F.col("y")], F.col("text"), "buckets array<int>, shares array<float>", counted).toArrow()
    # Rows in the order of ids, as views: the sample is in the driver once.
    order = pc.sort_indices(collected["id"]).to_pylist()
    rows = [(collected["buckets"][i].values.to_numpy(), collected["shares"][i].values.to_numpy(), collected["y"][i].as_py()) for i in order]
    model = train(rows, share)
    del collected, rows
    release()
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns but the text, then ``score``; no shuffle. The model travels as one broadcast of fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute(column: pa.Array) -> list:
        return [pa.array(shared.value.scores(column))]

    return map_texts(docs, [F.col(f"`{c}`") for c in docs.columns if c not in (text, "score")], F.col(f"`{text}`"), "score double", compute)


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for part in byte_slices(batch, at):
                yield part.filter(pa.array(shared.value.scores(part.column(at)) >= threshold))

    return docs.mapInArrow(released(run), docs.schema)
