"""Hard negatives for anchors, by rotated one-bit codes whose intervals say which rows must be scored.

1. A row's whole-number vector is turned by a fixed random rotation (signs and Hadamard steps, so lengths and products
   stay). Its code is the sign of every coordinate, one bit each; the unit vector x of those signs is the code vector. Stored
   beside it are the row's length and the alignment a, its cosine with x.
2. A turned anchor q is rounded to ``BITS`` bits a coordinate. Bit counts of the code and each bit plane add up to s = <x, q>
   exactly. The rest of the row is orthogonal to x, so by Cauchy and Schwarz the product lies within
   length * (a s +- sqrt(1 - a a) sqrt(qq - ss) +- rounding), always and not just likely.
3. A row is scored in whole numbers when its interval reaches what an anchor still looks for: above the fifth best so far,
   or between the bounds of a positive's score. Others can't be in the answer. Tasks read the rows once per group of
   anchors (bounded, see ``vectors``), first for positives and then for negatives, and return five rows an anchor or pair at most.

Defined results: rows with a null id, label, vector or component, a component that is not finite or an empty vector take no
part; rows of an anchor id that differ count as one anchor, that of the smallest label and vector; rows with the anchor's own
id are never its positive or negative; rows of one id and one score count once for an anchor and side; rows whose
vector is of another length than the anchor's aren't compared with it; an anchor without positives, or a pair without
negatives, has no row. Vectors so long that a score could leave 64 bits are an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlib.llm.arrays import mix64, released
from flowlib.llm.vectors import best_per_slot, by_group, first_of, in_groups, matrices, usable_vectors
from flowlib.scratch import stored

BITS = 6
POSITIVES, NEGATIVES = 5, 5
LOWEST, HIGHEST = 80, 100
SCALE = 256
#: Rows and anchors that are held against each other at a time; a task's first rows come in few, to find bounds for the rest.
ROWS, ANCHORS, FIRST_ROWS = 2048, 256, 64
SLACK = 1e-9

SQL = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS c
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), a AS (
  SELECT vec_id, label, c FROM v WHERE vec_id % 100 = 0
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY label, c) = 1
), s AS (
  SELECT DISTINCT a.vec_id AS anchor_id, a.label = v.label AS same, v.vec_id, CAST(list_inner_product(a.c, v.c) AS BIGINT) AS score
  FROM a JOIN v ON a.vec_id <> v.vec_id AND len(a.c) = len(v.c)
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}
)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id, p.positive_score ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND {LOWEST} * p.positive_score <= 100 * s.score AND 100 * s.score <= {HIGHEST} * p.positive_score
QUALIFY rank <= {NEGATIVES}
"""


def rotate(x: np.ndarray) -> np.ndarray:
    """Rows turned by one fixed rotation, in as many dimensions as the next power of two, 64 at least."""
    size = max(64, 1 << int(x.shape[1] - 1).bit_length())
    out = np.zeros((len(x), size))
    out[:, : x.shape[1]] = x
    for turn in range(3):
        signs = mix64(np.arange(turn * size, (turn + 1) * size, dtype=np.uint64) + np.uint64(0x5EED0011))
        out *= np.where(signs >> np.uint64(63), 1.0, -1.0)
        step = 1
        while step < size:
            pairs = out.reshape(len(x), -1, 2, step)
            out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), size)
            step *= 2
        out /= np.sqrt(size)
    return out


def bit_codes(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code words, length and alignment of turned rows."""
    positive = turned >= 0
    words = np.packbits(positive, axis=1, bitorder="little").view(np.uint64)
    length = np.linalg.norm(turned, axis=1)
    along = np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])
    return words, length, np.minimum(1.0, along / np.where(length > 0, length, 1.0))


class Anchors:
    """Anchors of one length, turned and cut in bit planes."""

    def __init__(self, query: np.ndarray, label: np.ndarray, ids: np.ndarray, whole: np.ndarray):
        self.query, self.label, self.ids, self.whole = query, label, ids, whole
        turned = rotate(whole.astype(np.float64))
        self.low = turned.min(axis=1)
        spread = turned.max(axis=1) - self.low
        self.step = np.where(spread > 0, spread, 1.0) / ((1 << BITS) - 1)
        units = np.rint((turned - self.low[:, None]) / self.step[:, None]).astype(np.int64)
        near = self.low[:, None] + self.step[:, None] * units
        self.rounding = np.linalg.norm(turned - near, axis=1)
        self.sum, self.square = near.sum(axis=1), (near ** 2).sum(axis=1)
        self.length = np.linalg.norm(turned, axis=1)
        self.planes = np.stack([np.packbits((units >> b & 1).astype(bool), axis=1, bitorder="little").view(np.uint64) for b in range(BITS)], axis=1)

    def intervals(self, part: slice, code: np.ndarray, length: np.ndarray, align: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the products of every coded row with the anchors of ``part``."""
        counts = np.zeros((len(code), len(self.query[part])), np.float64)
        ones = np.zeros(len(code))
        for w in range(code.shape[1]):
            ones += np.bitwise_count(code[:, w])
            for b in range(BITS):
                counts += np.bitwise_count(code[:, w, None] & self.planes[part, b, w][None, :]) * float(1 << b)
        s = (2 * (self.low[part][None, :] * ones[:, None] + self.step[part][None, :] * counts) - self.sum[part][None, :]) / np.sqrt(64 * code.shape[1])
        rest = np.sqrt(np.maximum(0.0, 1 - align ** 2))[:, None] * np.sqrt(np.maximum(0.0, self.square[part][None, :] - s * s))
        middle = align[:, None] * s
        wide = rest + self.rounding[part][None, :] + SLACK * self.length[part][None, :]
        return length[:, None] * (middle - wide), length[:, None] * (middle + wide)


def coded_rows(vectors: DataFrame) -> DataFrame:
    """Stored rows vec_id, label, whole (numbers of the scaled vector), code, length and align of all usable vectors."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("bigint")
    usable = usable_vectors(vectors.where("vec_id is not null and label is not null"), [F.col("vec_id").cast("bigint").alias("vec_id"), label.alias("label")])

    def run(batches):
        for batch in batches:
            for at, matrix in matrices(batch.column(2)):
                whole = np.floor(SCALE * matrix)
                if (np.abs(whole) >= 2.0 ** 31).any() or ((whole ** 2).sum(axis=1) >= 2.0 ** 62).any():
                    raise ArithmeticError("a vector is too long for 64-bit scores")
                code, length, align = bit_codes(rotate(whole))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * whole.shape[1]), pa.array(whole.astype(np.int32).ravel()))
                where = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(where), batch.column(1).take(where), flat, pa.array([r.tobytes() for r in code], pa.binary()), pa.array(length), pa.array(align)],
                    ["vec_id", "label", "values", "code", "length", "align"],
                )

    return stored(usable.mapInArrow(released(run), "vec_id bigint, label bigint, values array<int>, code binary, length double, align double"), "coded_vectors")


def anchor_groups(coded: DataFrame, every: int = 100) -> tuple[DataFrame, int]:
    """Anchors (one per id) in numbered groups, and the number of groups."""
    one = coded.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("label", "values")).alias("one"))
    return in_groups(one.select("vec_id", "one.*"), ["vec_id"], "anchors")


def scored(coded: DataFrame, anchors: DataFrame, wanted: dict[int, list[tuple[int, int]]] | None, count: int) -> DataFrame:
    """(query, ceiling, vec_id, score): per task the first ``count`` rows of every slot of the anchors of one group.

    Without ``wanted``, a slot is an anchor and takes rows of its label. Else ``wanted`` lists scores (floor, ceiling) per
    anchor, each a slot that takes rows of other labels with scores between them.
    """
    table = anchors.select("query", "label", "vec_id", "values").toArrow()
    sent = []
    for at, matrix in matrices(table["values"].combine_chunks(), np.int64) if len(table) else []:
        query, label, ids = (table[c].to_numpy()[at] for c in ("query", "label", "vec_id"))
        bounds = [wanted.get(q, []) for q in query.tolist()] if wanted is not None else [[(-(1 << 62), 1 << 62)]] * len(query)
        width = max((len(b) for b in bounds), default=0)
        # Slots that an anchor doesn't use have a floor that no score reaches.
        floors = np.array([[f for f, _ in b] + [1 << 62] * (width - len(b)) for b in bounds], np.int64).reshape(len(query), width)
        ceilings = np.array([[c for _, c in b] + [-(1 << 62)] * (width - len(b)) for b in bounds], np.int64).reshape(len(query), width)
        sent.append((Anchors(query, label, ids, matrix), floors, ceilings))
    shared = coded.sparkSession.sparkContext.broadcast(sent)
    same = wanted is None

    def run(batches):
        lists = {a.whole.shape[1]: Lists(a, f, c, same, count) for a, f, c in shared.value if f.shape[1]}
        seen = 0
        for batch in batches:
            start = 0
            while start < len(batch):
                part = batch.slice(start, min(ROWS, max(FIRST_ROWS, seen)))
                start, seen = start + len(part), seen + len(part)
                for at, matrix in matrices(part.column(2), np.int64):
                    if matrix.shape[1] in lists:
                        code = np.frombuffer(b"".join(part.column(3).take(pa.array(at)).to_pylist()), np.uint64).reshape(len(at), -1)
                        ids, label, length, align = (part.column(i).to_numpy()[at] for i in (0, 1, 4, 5))
                        lists[matrix.shape[1]].take(ids, label, matrix, code, length, align)
        for one in lists.values():
            yield one.rows()

    return coded.select("vec_id", "label", "values", "code", "length", "align").mapInArrow(released(run), "query bigint, ceiling bigint, vec_id bigint, score bigint")


class Lists:
    """The best rows of every slot so far, and the least score that still enters each."""

    def __init__(self, anchors: Anchors, floors: np.ndarray, ceilings: np.ndarray, same: bool, count: int):
        self.anchors, self.floors, self.ceilings, self.same, self.count = anchors, floors.copy(), ceilings, same, count
        self.slot = self.score = self.ids = np.zeros(0, np.int64)

    def take(self, ids, label, whole, code, length, align) -> None:
        width = self.floors.shape[1]
        slots, scores, names = [self.slot], [self.score], [self.ids]
        for a in range(0, len(self.anchors.query), ANCHORS):
            part = slice(a, a + ANCHORS)
            low, high = self.anchors.intervals(part, code, length, align)
            least, most = self.floors[part].min(axis=1), self.ceilings[part].max(axis=1)
            open_ = (high >= least[None, :]) & (low <= most[None, :])
            open_ &= ((label[:, None] == self.anchors.label[part][None, :]) == self.same) & (ids[:, None] != self.anchors.ids[part][None, :])
            row, anchor = np.nonzero(open_)
            step = max(1, (1 << 22) // whole.shape[1])
            for i in range(0, len(row), step):
                r, q = row[i: i + step], anchor[i: i + step] + a
                score = np.einsum("ij,ij->i", whole[r], self.anchors.whole[q])
                for j in range(width):
                    fits = (score >= self.floors[q, j]) & (score <= self.ceilings[q, j])
                    slots.append(q[fits] * width + j)
                    scores.append(score[fits])
                    names.append(ids[r[fits]])
        slot, score, ids = (np.concatenate(x) for x in (slots, scores, names))
        kept, rank = best_per_slot(slot, -score, ids, self.count)
        self.slot, self.score, self.ids = slot[kept], score[kept], ids[kept]
        last = rank == self.count - 1
        self.floors.ravel()[self.slot[last]] = self.score[last]

    def rows(self) -> pa.RecordBatch:
        at = self.slot // self.floors.shape[1]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (self.anchors.query[at], self.ceilings.ravel()[self.slot], self.ids, self.score)], ["query", "ceiling", "vec_id", "score"])


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, lowest: int = LOWEST, highest: int = HIGHEST) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of every anchor's hard negatives.

    Anchors are ids divisible by ``every``; a negative scores between ``lowest`` and ``highest`` hundredths of its positive.
    """
    coded = coded_rows(vectors)
    anchors, groups = anchor_groups(coded, every)
    order = [F.col("score").desc(), F.col("vec_id")]
    none = coded.sparkSession.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")

    def search(group: DataFrame) -> DataFrame:
        found = stored(first_of(scored(coded, group, None, positives).drop("ceiling"), ["query"], order, positives), "positives")
        # At most ``positives`` scores an anchor, and a group has a bounded number of anchors.
        wanted: dict[int, list[tuple[int, int]]] = {}
        for q, p in found.select("query", "score").distinct().collect():
            if lowest * p <= highest * p:
                wanted.setdefault(q, []).append((-(-lowest * p // 100), highest * p // 100))
        return pairs(found, group, wanted)

    def pairs(found: DataFrame, group: DataFrame, wanted: dict) -> DataFrame:
        ceiling = F.expr(f"{highest} * score div 100")
        left = found.select("query", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), ceiling.alias("ceiling"))
        right = first_of(scored(coded, group, wanted, negatives), ["query", "ceiling"], order, negatives).select("query", "ceiling", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        named = group.select("query", F.col("vec_id").alias("anchor_id"))
        return left.join(right, ["query", "ceiling"]).join(named, "query").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

    return by_group(anchors, groups, search, "hard_negatives", none)
