"""Hard negatives, spelling variants and nearest neighbours against plain versions."""

from __future__ import annotations

import collections
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowlib.llm import negatives, neighbours, spelling
from tests.llm import plain
from tests.llm.test_operators import frame

SF = "/root/testdata/sf0.01"
INF, NAN = float("inf"), float("nan")
SCHEMA = "vec_id bigint, embedding array<double>, label int"


def vector_frame(spark, rows, kind="array<double>"):
    table = spark.createDataFrame(rows, SCHEMA.replace("array<double>", kind))
    return table.withColumns({"score": F.lit("mine"), "rank": F.lit(1), "query": F.lit(2), "values": F.lit("x"), "group": F.lit(0)})


def vector_rows(seed: int, n: int, d: int, step: int = 10):
    """Rows around a few centres, with copies of whole vectors, odd rows and repeated rows."""
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(6, d))
    rows = [(i * step, (centres[i % 6] + 0.7 * draw.normal(size=d)).astype(np.float32).astype(float).tolist(), int(draw.integers(0, 10))) for i in range(n)]
    rows += [(7 * n * step + i, rows[i % 3][1], rows[i][2]) for i in range(40)]
    rows += [rows[0], rows[0], rows[5], (rows[10][0], rows[11][1], rows[10][2])]
    odd = [(None, rows[0][1], 1), (1000 * n, None, 1), (1000 * n + 100, [], 1), (1000 * n + 200, [0.0] * d, 2), (1000 * n + 300, [None] + [1.0] * (d - 1), 1)]
    odd += [(1000 * n + 400, [NAN] * d, 1), (1000 * n + 500, [INF] + [0.5] * (d - 1), 1), (1000 * n + 600, rows[1][1], None), (-100, rows[2][1], -3), (1000 * n + 700, [1.0, 2.0], 1), (1000 * n + 707, [1.5, 2.0], 1), (1000 * n + 800, [1.0, 2.5], 1)]
    return rows + odd


def plain_vectors(rows, zero: bool):
    return [(i, v, y) for i, v, y in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))]


def plain_negatives(rows) -> list[tuple]:
    label = lambda i, y: int(math.fmod(y + 1, 10)) if i % 7 == 0 else y
    table = [(i, label(i, y), [math.floor(256 * x) for x in v]) for i, v, y in plain_vectors(rows, True) if y is not None]
    anchors = {}
    for i, y, v in sorted(table, key=lambda r: (r[0], r[1], r[2])):
        if i % 100 == 0:
            anchors.setdefault(i, (y, v))
    out = []
    for a, (y, v) in anchors.items():
        found = {True: set(), False: set()}
        for i, z, w in table:
            if i != a and len(w) == len(v):
                found[z == y].add((-sum(p * q for p, q in zip(v, w)), i))
        for p, i in sorted(found[True])[:5]:
            kept = [(s, j) for s, j in sorted(found[False]) if 80 * -p <= 100 * -s <= 100 * -p][:5]
            out += [(a, i, k + 1, j, -p, -s) for k, (s, j) in enumerate(kept)]
    return sorted(out)


def plain_nearest(rows, k: int = 10) -> dict:
    table = plain_vectors(rows, False)
    queries = {}
    for i, v, _ in sorted(table, key=lambda r: (r[0], r[1])):
        if i % 100 == 0:
            queries.setdefault(i, v)
    out = {}
    for q, v in queries.items():
        found = {(math.dist(v, w), i) for i, w, _ in table if i != q and len(w) == len(v)}
        out[q] = sorted(found)[:k]
    return out


@pytest.mark.parametrize(("d", "n"), [(3, 150), (64, 400), (70, 120)])
def test_hard_negatives(spark, d, n):
    rows = vector_rows(d, n, d)
    table = vector_frame(spark, rows)
    got = negatives.hard_negatives(table)
    assert sorted(tuple(r) for r in got.collect()) == plain_negatives(rows)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in negatives.hard_negatives(table.repartition(5)).collect()) == plain_negatives(rows)
    assert negatives.hard_negatives(table.where("false")).count() == 0
    assert negatives.hard_negatives(table.where("vec_id = 0")).count() == 0


def test_hard_negatives_in_several_groups(spark, monkeypatch):
    from flowlib.llm import vectors

    monkeypatch.setattr(vectors, "GROUP_ROWS", 7)
    rows = vector_rows(5, 300, 20)
    assert sorted(tuple(r) for r in negatives.hard_negatives(vector_frame(spark, rows)).collect()) == plain_negatives(rows)
    want = plain_nearest(rows)
    got = collections.Counter(r.query_id for r in neighbours.nearest(vector_frame(spark, rows), sure=1 - 1e-12).collect())
    assert got == {q: len(v) for q, v in want.items() if v}


def test_too_long_vectors_are_an_error(spark):
    table = vector_frame(spark, [(0, [1e30, 0.0], 1), (3, [1.0, 1.0], 1)])
    with pytest.raises(Exception, match="too long for 64-bit scores"):
        negatives.hard_negatives(table).count()


def test_intervals_hold_the_true_product():
    draw = np.random.default_rng(3)
    for d in (1, 5, 64, 100, 200):
        rows = np.floor(256 * draw.normal(size=(300, d)) * draw.choice([0.0, 1e-3, 1.0, 50.0], size=(300, 1)))
        query = np.floor(256 * draw.normal(size=(40, d)) * draw.choice([0.0, 1.0, 9.0], size=(40, 1)))
        anchors = negatives.Anchors(np.arange(40), np.zeros(40), np.arange(40), query)
        low, high = anchors.intervals(slice(0, 40), *negatives.bit_codes(negatives.rotate(rows)))
        true = rows @ query.T
        assert (low <= true).all() and (true <= high).all()
        assert np.allclose(np.linalg.norm(negatives.rotate(rows), axis=1), np.linalg.norm(rows, axis=1))
    # The intervals also decide: rows along an anchor and against it don't overlap.
    along = negatives.bit_codes(negatives.rotate(np.concatenate([query[-1:], -query[-1:]])))
    low, high = anchors.intervals(slice(39, 40), *along)
    assert low[0, 0] > high[1, 0] or not query[-1].any()


def test_hard_negatives_equal_their_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.execute(f"SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ({negatives.SQL})").fetchall()
    got = negatives.hard_negatives(spark.read.parquet(f"{SF}/embeddings.parquet"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and want


@pytest.mark.parametrize(("d", "kind"), [(2, "array<double>"), (32, "array<float>")])
def test_nearest(spark, d, kind):
    rows = vector_rows(d + 1, 500, d)
    table = vector_frame(spark, rows, kind)
    want = plain_nearest(rows)
    got: dict = {}
    for r in sorted(neighbours.nearest(table, block=90).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(got[r.query_id])
    assert got.keys() == {q for q, v in want.items() if v}
    hits = sum(len({i for _, i in got[q]} & {i for _, i in v}) for q, v in want.items() if v)
    assert hits >= 0.9 * sum(len(v) for v in want.values())
    every = plain_nearest(rows, 10**6)
    for q, found in got.items():
        assert all(any(i == j and math.isclose(s, t, rel_tol=1e-12, abs_tol=1e-12) for t, j in every[q]) for s, i in found)
        assert found == sorted(found)
    # A test that must be all but certain verifies everything that matters.
    exact: dict = {}
    for r in neighbours.nearest(table, sure=1 - 1e-12).collect():
        exact.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert {q: [i for _, i in sorted(v)] for q, v in exact.items()} == {q: [i for _, i in v] for q, v in want.items() if v}
    assert neighbours.nearest(table.where("false")).count() == 0
    assert neighbours.nearest(table.where("vec_id = 0")).count() == 0


def test_chi_square_and_tree():
    # Median and upper quantile of 8 degrees of freedom, from tables.
    assert abs(neighbours.stop_factor(0.5, 8) - 7.344) < 1e-3 and abs(neighbours.stop_factor(0.95, 8) - 15.507) < 1e-3
    draw = np.random.default_rng(1)
    for n in (1, 63, 64, 65, 1000):
        points = np.round(draw.normal(size=(n, 4)), 1)
        order, dims, cuts = neighbours.kd_tree(points, 8)
        starts = neighbours.leaf_starts(n, len(dims) + 1)
        assert sorted(order) == list(range(n)) and starts[-1] == n and np.diff(starts).max() <= 16
    points = draw.normal(size=(4000, 64)) @ neighbours.directions(64)
    assert abs(points.var() / 64 - 1) < 0.1


def test_neighbours_of_the_given_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in table.collect()]
    want = plain_nearest(rows)
    got = collections.defaultdict(set)
    for r in neighbours.nearest(table).collect():
        got[r.query_id].add(r.vec_id)
    assert sum(len(got[q] & {i for _, i in v}) for q, v in want.items()) >= 0.9 * 10 * len(want)


RUN = re.compile("[A-Za-zÀ-ÿ]+")


def plain_words(rows) -> dict:
    counts = collections.Counter()
    for d, t in rows:
        for run in RUN.findall(t or ""):
            run = run.translate(plain.UPPER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def plain_variants(words: dict) -> list[tuple]:
    """By all deletions of one letter: near words share one, and differ by one edit."""
    held = collections.defaultdict(set)
    for w in words:
        for v in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))}:
            held[v].add(w)
    about = {w: set() for w in words}
    for group in held.values():
        for a in group:
            about[a] |= {b for b in group if b != a and edit_distance(a, b) == 1}
    form = {}
    for w, others in about.items():
        if others:
            best = min(others, key=lambda o: (-words[o], o))
            if words[best] >= 2 * words[w]:
                form[w] = best
    out = []
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, words[w], len(about[w]), words.get(form.get(w))))
    return sorted(out)


def edit_distance(a: str, b: str) -> int:
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1]


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(3)
    stems = ["".join(draw.choice("abcdeé") for _ in range(draw.randrange(4, 9))) for _ in range(120)]
    words = list(stems)
    for _ in range(500):
        w = list(draw.choice(stems))
        at = draw.randrange(len(w))
        kind = draw.randrange(3)
        if kind == 0:
            w[at] = draw.choice("abcdeéÿ×")
        elif kind == 1:
            w.insert(at, draw.choice("abcx"))
        else:
            del w[at]
        words.append("".join(w))
    rows = [(i, " ".join(draw.choice(words[: 10 + i * 8]) for _ in range(200))) for i in range(80)]
    rows += [(900, "q" * 700 + " " + "q" * 700), (901, "q" * 700 + "-" + "q" * 699 + " " + ("q" * 699 + ",") * 2), (902, "ÀÉ naïve NAÏVE naïve-naive naive naivesΔ naives ābcdefg"), (902, None), (None, None), (903, "")]
    rows += [(904, " ".join("z" * 70 + c for c in "aabbccdd") + " " + ("z" * 70 + "a ") * 3), (None, "no id ids names namess names names namess namess"), (905, "12 !! ××××× ÷")]
    rows += [(906, "chainxx " * 80 + "chainxy " * 40 + "chainzy " * 20 + "chaizzy " * 10)]
    return rows + rows[:3]


def test_spelling_variants(spark, texts):
    docs = frame(spark, [(d, t, "s") for d, t in texts]).withColumns({"word": F.lit(1), "n": F.lit(2), "form": F.lit("x")})
    want = plain_variants(plain_words(texts))
    got = spelling.variants(docs)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted((tuple(r) for r in got.collect())) == want
    assert sum(r[1] is not None for r in want) > 50 and any(r[1] not in (None, r[2]) for r in want)
    # Small thresholds lengthen most grams, small blocks cut every list in parts.
    for index in ({"least": 2, "block": 7}, {"least": 20, "qmin": 3, "qmax": 6}, {"least": 10**6}, {"most": 3, "least": 1, "qmax": 3}):
        assert sorted(tuple(r) for r in spelling.variants(docs, **index).collect()) == want, index
    assert spelling.variants(docs.where("false")).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(docs, letters=1)


def test_one_edit_leaves_the_grams_it_should():
    """The bound on affected grams against real edits, over dictionaries of many shapes."""
    draw = random.Random(11)
    for _ in range(400):
        letters = "ab" if draw.random() < 0.5 else "abcd"
        vocabulary = ["".join(draw.choice(letters) for _ in range(draw.randrange(2, 9))) for _ in range(30)]
        tally = collections.Counter(f"^{w}$"[i: i + q] for w in vocabulary for q in (2, 3, 4) for i in range(len(w) + 3 - q))
        limit = draw.randrange(1, 12)
        grams = spelling.Grams({g: n for g, n in tally.items() if n > limit}, 2, 4)
        for a in vocabulary[:8]:
            w, at = list(a), draw.randrange(len(a))
            kind = draw.randrange(3)
            if kind == 0:
                w[at] = draw.choice(letters)
            elif kind == 1:
                w.insert(draw.randrange(len(a) + 1), draw.choice(letters))
            else:
                del w[at]
            b = "".join(w)
            if b == a or not b:
                continue
            x, y = f"^{a}$", f"^{b}$"
            mine, other = grams.cut(x), grams.cut(y)
            left, right = {(p, x[p:e]) for p, e in mine}, {(p, y[p:e]) for p, e in other}
            ends = {(len(x) - p, g) for p, g in left} & {(len(y) - p, g) for p, g in right}
            shared = len((left & right) | {(len(x) - p, g) for p, g in ends})
            assert shared >= len(mine) - grams.affected(x, mine), (a, b)


def test_checksums_match_the_library():
    texts = ["plain words", "é" * 40 + " b " + "c" * 900, None, "", "A-b Cd"]
    data, starts, ends, owner = spelling.letter_runs(pa.array(texts))
    prefixes = [f"{i}:".encode() for i in range(len(texts))]
    got = spelling.checksums(prefixes, owner, data, starts, ends)
    want = [zlib.crc32(f"{i}:{w.translate(plain.UPPER)}".encode()) for i, t in enumerate(texts) for w in RUN.findall(t or "")]
    assert got.tolist() == want
