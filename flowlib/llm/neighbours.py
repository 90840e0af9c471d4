"""Nearest neighbours by a few stable projections in kd-trees, verified until a chi-square test lets the search stop.

A vector's ``M`` projections on fixed Gaussian directions have a squared distance that is the true one times a chi-square
variable of M degrees of freedom. So once all rows within a projected distance t of the query have been verified, a row not
yet seen is nearer than the k-th best distance d with a probability of at most 1 - F(t * t / (d * d)), and the search stops
when F reaches ``SURE``.

1. Every row goes into the index: tasks pack their rows in blocks of ``BLOCK`` rows (or ``BLOCK_BYTES``) with projections, vectors and a kd-tree
   over the projections (halved at the median of the widest dimension down to ``LEAF`` rows).
2. Queries in groups of bounded size meet all blocks. In each, nodes are taken by their distance from the projected query;
   rows nearer than every open node are verified with their whole vectors. What a task knows of a query's best goes
   from block to block, so the bound gets tighter; it is never tighter than the bound over all rows, so splitting rows
   over blocks and tasks only adds to what is verified.
3. The best of all tasks are merged. There is no limit on verified rows.

Defined results: rows with a null id, vector or component, a component that is not finite, an empty or a zero vector
take no part; rows with the query's own id aren't its neighbours; rows of one id and one distance count once; query rows of
one id are one query, of the smallest vector; rows whose vector is of another length aren't compared; fewer than k
candidates are all returned.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlib.llm.arrays import mix64, released
from flowlib.llm.vectors import best_per_slot, by_group, first_of, in_groups, matrices, usable_vectors
from flowlib.scratch import stored

M = 8
SURE = 0.95
BLOCK, BLOCK_BYTES, LEAF = 8192, 16 << 20, 64


def directions(d: int, m: int = M) -> np.ndarray:
    """(d, m) fixed Gaussian numbers, the same on every machine."""
    u = (mix64(np.arange(1, 2 * d * m + 1, dtype=np.uint64) + np.uint64(0x57AB1E)) >> np.uint64(11)).astype(np.float64) + 0.5
    u = (u / (1 << 53)).reshape(2, d, m)
    return np.sqrt(-2 * np.log(u[0])) * np.cos(2 * np.pi * u[1])


def chi_square(x: float, m: int) -> float:
    """Distribution function for an even number of degrees of freedom."""
    term, total = 1.0, 1.0
    for i in range(1, m // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def stop_factor(sure: float = SURE, m: int = M) -> float:
    """The squared projected distance, in squared k-th best distances, from which the test holds."""
    low, high = 0.0, 1.0
    while chi_square(high, m) < sure:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, m) < sure else (low, middle)
    return high


def kd_tree(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row order, and split dimension and value of the inner nodes of a complete tree (children of i: 2 i + 1 and 2 i + 2)."""
    depth = max(0, math.ceil(math.log2(max(1, len(points)) / leaf)))
    order = np.arange(len(points))
    dims, cuts = np.zeros((1 << depth) - 1, np.int32), np.zeros((1 << depth) - 1)
    parts = [order]
    for level in range(depth):
        halves = []
        for i, part in enumerate(parts):
            own = points[part]
            dim = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
            middle = len(part) // 2
            part = part[np.argpartition(own[:, dim], middle)]
            node = (1 << level) - 1 + i
            dims[node], cuts[node] = dim, points[part[middle], dim]
            halves += [part[:middle], part[middle:]]
        parts = halves
    return np.concatenate(parts), dims, cuts


def leaf_starts(n: int, leaves: int) -> np.ndarray:
    """Where the leaves begin in the row order, as halving makes them, and the end."""
    sizes = [n]
    while len(sizes) < leaves:
        sizes = [x for s in sizes for x in (s // 2, s - s // 2)]
    return np.concatenate([[0], np.cumsum(sizes)])


class Block:
    """One block of the index, ready to be searched."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, points: np.ndarray, dims: np.ndarray, cuts: np.ndarray):
        self.ids, self.vectors, self.points = ids, vectors, points
        self.dims, self.cuts = dims.tolist(), cuts.tolist()
        self.starts = leaf_starts(len(ids), len(dims) + 1).tolist()

    def search(self, own: int, query: np.ndarray, point: np.ndarray, best: tuple[np.ndarray, np.ndarray], k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """The k best (score, id), given the best so far."""
        score, names = best
        limit = factor * score[-1] ** 2 if len(score) == k else math.inf
        inner, place, slack = len(self.dims), point.tolist(), 1e-12 * float(point @ point)
        nodes = [(0.0, 0, (0.0,) * len(place))]
        ahead, waiting = np.zeros(0), np.zeros(0, np.int64)
        while True:
            front = nodes[0][0] if nodes else math.inf
            ready = ahead <= front
            if ready.any():
                rows = waiting[ready]
                ahead, waiting = ahead[~ready], waiting[~ready]
                rows = rows[self.ids[rows] != own]
                far = np.sqrt(((self.vectors[rows] - query) ** 2).sum(axis=1))
                if len(score) == k:
                    near = far <= score[-1]
                    rows, far = rows[near], far[near]
                if len(rows):
                    score, names = np.concatenate([score, far]), np.concatenate([names, self.ids[rows]])
                    kept, _ = best_per_slot(np.zeros(len(score), np.int8), score, names, k)
                    score, names = score[kept], names[kept]
                    limit = factor * score[-1] ** 2 if len(score) == k else math.inf
            # Rows as far as the front may tie with one another, so it must lie beyond the limit, and beyond rounding.
            if not nodes or front > limit + slack:
                return score, names
            away, node, offsets = heapq.heappop(nodes)
            while node < inner:
                dim = self.dims[node]
                side = place[dim] - self.cuts[node]
                near, other = (2 * node + 1, 2 * node + 2) if side < 0 else (2 * node + 2, 2 * node + 1)
                beyond = max(away, away - offsets[dim] ** 2 + side * side)
                heapq.heappush(nodes, (beyond, other, offsets[:dim] + (abs(side),) + offsets[dim + 1:]))
                node = near
            a, b = self.starts[node - inner], self.starts[node - inner + 1]
            ahead = np.concatenate([ahead, ((self.points[a:b] - point) ** 2).sum(axis=1)])
            waiting = np.concatenate([waiting, np.arange(a, b)])


def build_index(vectors: DataFrame, block: int = BLOCK, leaf: int = LEAF, m: int = M) -> DataFrame:
    """Stored index: one row per block of at most ``block`` usable vectors of one length, with ids, vectors, projections and tree."""
    usable = usable_vectors(vectors.where("vec_id is not null"), [F.col("vec_id").cast("bigint").alias("vec_id")]).where(F.exists("values", lambda x: x != 0))

    def packed(ids: np.ndarray, matrix: np.ndarray) -> pa.RecordBatch:
        points = matrix @ directions(matrix.shape[1], m)
        order, dims, cuts = kd_tree(points, leaf)
        small = matrix.astype(np.float32)
        kind = "f4" if (small == matrix).all() else "f8"
        cells = [len(ids), matrix.shape[1], kind, ids[order].tobytes(), (small if kind == "f4" else matrix)[order].tobytes(), points[order].tobytes(), dims.tobytes(), cuts.tobytes()]
        kinds = [pa.int32(), pa.int32(), pa.string(), *[pa.binary()] * 5]
        return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, kinds)], ["n", "d", "kind", "ids", "vectors", "points", "dims", "cuts"])

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for at, matrix in matrices(batch.column(1)):
                rows = held.setdefault(matrix.shape[1], [])
                rows.append((ids[at], matrix))
                most = max(1, min(block, BLOCK_BYTES // (8 * matrix.shape[1])))
                while sum(len(i) for i, _ in rows) >= most:
                    names, whole = np.concatenate([i for i, _ in rows]), np.concatenate([x for _, x in rows])
                    yield packed(names[:most], whole[:most])
                    rows[:] = [(names[most:], whole[most:])]
        for rows in held.values():
            if sum(len(i) for i, _ in rows):
                yield packed(np.concatenate([i for i, _ in rows]), np.concatenate([x for _, x in rows]))

    return stored(usable.mapInArrow(released(run), "n int, d int, kind string, ids binary, vectors binary, points binary, dims binary, cuts binary"), "neighbour_index")


def searched(index: DataFrame, queries: DataFrame, k: int, sure: float, m: int = M) -> DataFrame:
    """(query, vec_id, score): per task the k best rows of every query of one group."""
    table = queries.select("query", "vec_id", "values").toArrow()
    sent = {}
    for at, matrix in matrices(table["values"].combine_chunks()) if len(table) else []:
        sent[matrix.shape[1]] = (table["query"].to_numpy()[at], table["vec_id"].to_numpy()[at], matrix, matrix @ directions(matrix.shape[1], m))
    shared = index.sparkSession.sparkContext.broadcast(sent)
    factor = stop_factor(sure, m)

    def run(batches):
        best: dict[int, tuple] = {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["d"] not in shared.value:
                    continue
                n, d = row["n"], row["d"]
                vectors = np.frombuffer(row["vectors"], row["kind"]).reshape(n, d).astype(np.float64)
                block = Block(np.frombuffer(row["ids"], np.int64), vectors, np.frombuffer(row["points"]).reshape(n, m), np.frombuffer(row["dims"], np.int32), np.frombuffer(row["cuts"]))
                for query, own, vector, point in zip(*shared.value[d]):
                    best[query] = block.search(own, vector, point, best.get(query, (np.zeros(0), np.zeros(0, np.int64))), k, factor)
        if best:
            sizes = [len(s) for s, _ in best.values()]
            arrays = [np.repeat(np.array(list(best), np.int64), sizes), np.concatenate([i for _, i in best.values()]), np.concatenate([s for s, _ in best.values()])]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["query", "vec_id", "score"])

    return index.mapInArrow(released(run), "query bigint, vec_id bigint, score double")


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, sure: float = SURE, block: int = BLOCK, index: DataFrame | None = None) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of the k nearest rows found for ids divisible by ``every``."""
    index = build_index(vectors, block) if index is None else index
    asked = usable_vectors(vectors.where(F.col("vec_id") % every == 0), [F.col("vec_id").cast("bigint").alias("vec_id")]).where(F.exists("values", lambda x: x != 0))
    queries, groups = in_groups(asked.groupBy("vec_id").agg(F.min("values").alias("values")), ["vec_id"], "queries")
    none = index.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")

    def search(group: DataFrame) -> DataFrame:
        found = first_of(searched(index, group, k, sure), ["query"], [F.col("score"), F.col("vec_id")], k)
        return found.join(group.select("query", F.col("vec_id").alias("query_id")), "query").select("query_id", "rank", "vec_id", "score")

    return by_group(queries, groups, search, "neighbours", none)
