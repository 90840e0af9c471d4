"""Mixing sources to target weights by capped water-filling.

Every source asks for a share of the whole size in proportion to its weight, but may be repeated ``max_epochs``
times at most. Sources whose share is more than that are clamped, and what they can't use is shared by the others
in proportion to their weights until none is above. Filling all sources to one common level per weight gives the
same result as those rounds: ordered by the level at which each one is full, the clamped ones come first.

A source whose target is r times its size takes each document floor(r) times, and documents in the order of a
seeded hash of doc_id once more until the target is met, to half a document. The order is never sorted as a whole:
sizes are summed by the leading bits of the hash, then by the next bits inside the one range that holds the
boundary, so no task holds more than a source's share of one in 16 million. What remains is one boundary hash per
source, and the choice is a filter on the documents.

Defined results: a null text has size 0; null is a source of its own, the last; documents with equal doc_id share
a hash and are taken alike; a source of size 0 has target 0; no documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlib.scratch import stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
HASH_BITS, LEVEL_BITS = 60, 12


def text_size(text: Column) -> Column:
    """Number of runs without ASCII white space; null is 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def seeded_hash(doc_id: Column, seed: str = SEED) -> Column:
    """A number of 60 bits from doc_id and seed."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 15), 16, 10).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) to (source, source_size, target); one row per source, so these windows are small."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weighted = sizes.withColumn("w", F.get(F.array(*[F.lit(w).cast("bigint") for w in weights]), turn)).withColumn("cap", F.col("source_size") * max_epochs)
    by_level = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = weighted.select(
        "*",
        F.row_number().over(by_level).alias("place"),
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("left"),
        F.sum("w").over(onward).alias("open"),
    )
    free = (F.col("cap").cast("double") * F.col("open") > F.col("w").cast("double") * F.col("left")).alias("free")
    first = F.min(F.when(F.col("free"), F.struct("place", "left", "open"))).over(everything)
    level = filled.withColumn("free", free).withColumn("first", first)
    uncapped = (F.col("w") * F.col("first.left")).cast("double") / F.col("first.open").cast("double")
    target = F.when(F.col("first").isNull() | (F.col("place") < F.col("first.place")), F.col("cap").cast("double")).otherwise(uncapped)
    return level.select("source", "source_size", target.alias("target"))


def _boundary(rows: DataFrame, key: Column) -> DataFrame:
    """Per source the range of hashes that holds the boundary: rows (source, need, below, at)."""
    sums = rows.groupBy("source", "need", "below", key.alias("at")).agg(F.sum("size").alias("mass"))
    run = F.sum("mass").over(Window.partitionBy("source").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    placed = sums.withColumn("low", F.col("below") + F.coalesce(run, F.lit(0)))
    return placed.where((F.col("low") <= F.col("need")) & (F.col("need") < F.col("low") + F.col("mass"))).select("source", "need", F.col("low").alias("below"), "at")


def plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """From rows (source, size, h) one row per source: source_size, target, whole repetitions, last hash of one more."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    targets = stored(targets.withColumn("whole", whole).withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")), "mix_targets")
    needs = targets.where("need > 0").select(F.col("source").alias("s"), "need", F.lit(0).cast("bigint").alias("below"))

    def inside(found: DataFrame, shift: int | None) -> DataFrame:
        same = F.col("source").eqNullSafe(F.col("s"))
        if shift is not None:
            same = same & (F.shiftright("h", shift) == F.col("at"))
        return sized.join(found, same).select("source", "size", "h", "need", "below")

    high = _boundary(inside(needs, None), F.shiftright("h", HASH_BITS - LEVEL_BITS))
    low = _boundary(inside(high.withColumnRenamed("source", "s"), HASH_BITS - LEVEL_BITS), F.shiftright("h", HASH_BITS - 2 * LEVEL_BITS))
    low = stored(low, "mix_boundary")
    groups = inside(low.withColumnRenamed("source", "s"), HASH_BITS - 2 * LEVEL_BITS).groupBy("source", "need", "below", "h").agg(F.sum("size").alias("mass"))
    upto = F.col("below") + F.sum("mass").over(Window.partitionBy("source").orderBy("h").rowsBetween(Window.unboundedPreceding, 0))
    taken = groups.withColumn("upto", upto).where(2 * F.col("upto") - F.col("mass") <= 2 * F.col("need"))
    last = taken.groupBy(F.col("source").alias("s1")).agg(F.max("h").alias("inside_last"))
    floor = low.select(F.col("source").alias("s2"), (F.shiftleft("at", HASH_BITS - 2 * LEVEL_BITS) - 1).alias("range_start"))
    source = F.col("source")
    ends = targets.join(floor, source.eqNullSafe(F.col("s2")), "left").join(last, source.eqNullSafe(F.col("s1")), "left")
    found = ends.select("source", "source_size", "target", "whole", F.coalesce("inside_last", "range_start", F.lit(-1).cast("bigint")).alias("last"))
    # Stored, its size is known: while it is small the planner sends it to the documents, and no document moves.
    return stored(found, "mix_plan")


def size_rows(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """Narrow rows (doc_id, source, size, h), stored once: every later step reads these, not the texts."""
    return stored(
        docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), text_size(F.col("text")).alias("size"), seeded_hash(F.col("doc_id"), seed).alias("h")),
        "mix_sizes",
    )


def mix_counts(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, repetitions and taken words of every document."""
    sized = size_rows(docs, seed)
    chosen = plan(sized, weights, max_epochs).withColumnRenamed("source", "s")
    repeats = F.col("whole") + (F.col("h") <= F.col("last")).cast("bigint")
    return sized.join(chosen, F.col("source").eqNullSafe(F.col("s")), "left").select(
        "doc_id", "source", "size", "source_size", "target", repeats.alias("repetitions"), (F.col("size") * repeats).alias("taken")
    )


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs`` only; texts aren't shuffled."""
    chosen = plan(size_rows(docs, seed), weights, max_epochs).withColumnRenamed("source", "__s")
    rows = docs.select(F.struct("*").alias("__row"), F.col("source").cast("string").alias("__source"), seeded_hash(F.col("doc_id"), seed).alias("__h"))
    joined = rows.join(chosen, F.col("__source").eqNullSafe(F.col("__s")))
    repeats = (F.col("whole") + (F.col("__h") <= F.col("last")).cast("bigint")).cast("int")
    return joined.where(repeats > 0).select("__row", F.explode(F.sequence(F.lit(1), repeats)).alias("__copy")).select("__row.*")


SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         ('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15))::BIGINT AS h
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, 3 * source_size AS cap,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM sources),
filled AS (
  SELECT *, row_number() OVER o AS place, (SELECT sum(source_size) FROM sources) - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
         sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
  FROM weighted WINDOW o AS (ORDER BY cap / w, source NULLS LAST)),
turn AS (
  SELECT place, remaining, open_weight FROM filled WHERE cap * open_weight > w * remaining ORDER BY place LIMIT 1),
targets AS (
  SELECT f.source, f.source_size,
         CASE WHEN t.place IS NULL OR f.place < t.place THEN CAST(f.cap AS DOUBLE)
              ELSE CAST(f.w * t.remaining AS DOUBLE) / CAST(t.open_weight AS DOUBLE) END AS target
  FROM filled f LEFT JOIN turn t ON true),
needs AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM targets),
groups AS (
  SELECT source, h, sum(size) AS mass, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto FROM sized GROUP BY source, h)
SELECT d.doc_id, d.size, n.source_size, n.target,
       CAST(d.size * (n.whole + CASE WHEN n.target - n.whole * n.source_size > 0 AND 2 * g.upto - g.mass <= 2 * (n.target - n.whole * n.source_size) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized d
JOIN needs n ON d.source IS NOT DISTINCT FROM n.source
JOIN groups g ON d.source IS NOT DISTINCT FROM g.source AND d.h = g.h
"""
