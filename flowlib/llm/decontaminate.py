"""Benchmark decontamination as a prefix-filtered set join.

Every benchmark item is cut into windows of ``WINDOW`` consecutive words (an item of fewer, but not none, is one window).
The join elements of a window are its shingles of five words (or all its words, if fewer). Elements are ordered by
rarity: how often they occur in the documents, counted over all of them. A window occurs in a document only if all
its elements do, so the necessary prefix is its rarest element alone; windows whose rarest element occurs nowhere
are dropped. Documents yield a candidate only where a prefix element stands, with the few words around it. A
candidate must leave room for the window before and after the element (positional bound) within the document's words
(length bound), and counts only if the window's words are the same, word by word.

Documents are read twice, and neither texts nor all their words are shuffled. What documents are tested with is a
bitmap of fixed size (``FILTER_BITS``), whatever the benchmark's; elements that pass it by chance fail the join.

Defined results: null, empty and wordless texts have no words and no hits; an empty benchmark hits nothing; rows with
equal item_id are one item, a null item_id is the item ``null``; repeated documents are judged each for itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlib.llm.arrays import FILTER_BITS, SHINGLE_WORDS, Words, bitmap, byte_slices, list_array, map_texts, released, shingle_hashes, signed, text_key
from flowlib.scratch import stored

WINDOW = 10
CANDIDATE = pa.struct([("token", pa.int64()), ("at", pa.int32()), ("from", pa.int32()), ("words", pa.string())])


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows (item, words, n, tokens): each window of each item with its elements in order."""

    def compute(column: pa.Array) -> list:
        words = Words(column)
        lines, sizes, tokens, of = [], [], [], [0]
        for first, last in zip(words.of[:-1], words.of[1:]):
            n = min(window, last - first)
            starts = range(first, last - n + 1) if n else ()
            for start in starts:
                lines.append(words.text(start, start + n))
                sizes.append(n)
                k = min(SHINGLE_WORDS, n)
                at = np.arange(start, start + n - k + 1)
                tokens.append(signed(shingle_hashes(words.hashes, at, np.full(len(at), k), SHINGLE_WORDS)))
            of.append(len(lines))
        inner = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]) if tokens else np.zeros(1, np.int64)
        flat = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
        rows = pa.StructArray.from_arrays([pa.array(lines, pa.string()), pa.array(sizes, pa.int32()), list_array(pa.array(flat, pa.int64()), inner)], ["words", "n", "tokens"])
        return [list_array(rows, np.array(of))]

    item = F.coalesce(F.col("item_id").cast("string"), F.lit("null"))
    made = map_texts(benchmark, [item.alias("item")], F.col("text"), "windows array<struct<words: string, n: int, tokens: array<bigint>>>", compute)
    return stored(made.select("item", F.inline("windows")).distinct(), "bench_windows")


def elements(words: Words, lengths: list[int], allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Elements that pass the filter: hashes, first words, and the texts they stand in."""
    found, places, owners = [], [], []
    text_of = np.repeat(np.arange(len(words.counts)), words.counts)
    left = np.repeat(words.of[1:], words.counts) - np.arange(len(text_of))
    for k in lengths:
        at = np.flatnonzero(left >= k)
        hashes = shingle_hashes(words.hashes, at, np.full(len(at), k), SHINGLE_WORDS)
        passed = allowed[(hashes & np.uint64(len(allowed) - 1)).astype(np.int64)]
        found.append(hashes[passed])
        places.append(at[passed])
        owners.append(text_of[at[passed]])
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(places), np.concatenate(owners)


def element_counts(docs: DataFrame, tokens: DataFrame, lengths: list[int]) -> DataFrame:
    """(token, occurrences) over all documents, for the benchmark's elements; 0 where it occurs nowhere."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(tokens))

    def run(batches):
        for batch in batches:
            for part in byte_slices(batch, 0):
                hashes, _, _ = elements(Words(part.column(0)), lengths, shared.value)
                token, times = np.unique(hashes, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(token)), pa.array(times.astype(np.int64))], ["token", "times"])

    seen = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(released(run), "token bigint, times bigint").groupBy("token").agg(F.sum("times").alias("times"))
    return tokens.join(seen, "token", "left").select("token", F.coalesce("times", F.lit(0)).alias("times"))


def prefixes(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(token, words, n, offset): each distinct window under its rarest element, unless that occurs nowhere."""
    distinct = windows.groupBy("words").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"))
    placed = distinct.select("words", "n", F.posexplode("tokens").alias("offset", "token")).join(counts, "token")
    rarest = placed.groupBy("words", "n").agg(F.min(F.struct("times", "token", "offset")).alias("rarest"))
    return rarest.where("rarest.times > 0").select("rarest.token", "words", "n", F.col("rarest.offset").alias("offset"))


def candidates(docs: DataFrame, prefix: DataFrame, lengths: list[int], window: int = WINDOW) -> DataFrame:
    """One stored row per document: row, doc_id, key, n_words and the places of prefix elements with the words around."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(prefix.select("token").distinct()))

    def compute(column: pa.Array) -> list:
        words = Words(column)
        hashes, at, owner = elements(words, lengths, shared.value)
        order = np.lexsort((at, owner))
        hashes, at, owner = hashes[order], at[order], owner[order]
        first = np.maximum(at - window + 1, words.of[owner]) if len(at) else at
        last = np.minimum(at + window, words.of[owner + 1]) if len(at) else at
        base = words.of[owner] if len(at) else at
        lines = [words.text(a, b) for a, b in zip(first, last)]
        rows = pa.StructArray.from_arrays(
            [pa.array(signed(hashes)), pa.array((at - base).astype(np.int32)), pa.array((first - base).astype(np.int32)), pa.array(lines, pa.string())],
            fields=list(CANDIDATE),
        )
        of = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(column)))])
        return [pa.array(words.counts.astype(np.int64)), list_array(rows, of)]

    outputs = "n_words bigint, found array<struct<token: bigint, at: int, `from`: int, words: string>>"
    made = map_texts(docs.select("doc_id", "text", text_key(F.col("text")).alias("key")), [F.col("doc_id"), F.col("key")], F.col("text"), outputs, compute)
    return stored(made.withColumn("row", F.monotonically_increasing_id()), "bench_candidates")


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (row, doc_id, key, n_words), occurrences (row, words, start, n) and windows (item, words)."""
    windows = benchmark_windows(benchmark, window)
    lengths = sorted(r[0] for r in windows.select(F.least("n", F.lit(SHINGLE_WORDS))).distinct().collect())
    tokens = windows.select(F.explode("tokens").alias("token")).distinct()
    prefix = stored(prefixes(windows, element_counts(docs, tokens, lengths)), "bench_prefixes")
    rows = candidates(docs, prefix, lengths, window)
    placed = rows.where(F.size("found") > 0).select("row", "n_words", F.inline("found")).withColumnRenamed("words", "around")
    start = F.col("at") - F.col("offset")
    joined = placed.join(prefix, "token").where((start >= 0) & (start + F.col("n") <= F.col("n_words")) & (start >= F.col("from")))
    same = F.array_join(F.slice(F.split("around", " "), start - F.col("from") + 1, F.col("n")), " ") == F.col("words")
    return rows, joined.where(same).select("row", "words", start.alias("start"), "n"), windows.select("item", "words")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, key, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    rows, found, items = hits(docs, benchmark, window)
    found = stored(found.distinct(), "bench_hits")
    reach = F.max(F.col("start") + F.col("n")).over(Window.partitionBy("row").orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("start") + F.col("n") - F.greatest(F.col("start"), F.coalesce(reach, F.lit(0))))
    covered = found.select("row", "start", "n").distinct().select("row", fresh.alias("fresh")).groupBy("row").agg(F.sum("fresh").alias("hit"))
    named = found.select("row", "words").distinct().join(items, "words").select("row", "item").distinct()
    listed = named.groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    out = rows.select("row", "doc_id", "key", "n_words").join(covered, "row", "left").join(listed, "row", "left")
    none: Column = F.expr("cast(array() as array<string>)")
    n_hit = F.coalesce("hit", F.lit(0).cast("bigint"))
    listing = F.coalesce("items", none)
    return out.select(
        "doc_id", "key", "n_words", n_hit.alias("n_hit"), F.size(listing).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(listing, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents in which no window occurs, with all their columns."""
    rows, found, _ = hits(docs, benchmark, window)
    bad = stored(rows.join(found.select("row").distinct(), "row", "left_semi").select(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).distinct(), "bench_bad")
    packed = docs.select(F.struct("*").alias("__row"), F.col("doc_id").alias("__doc"), text_key(F.col("text")).alias("__text"))
    return packed.join(bad, F.col("__doc").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__key")), "left_anti").select("__row.*")


SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w,
         row_number() OVER () AS rid
  FROM documents),
item_words AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
item_windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM item_words WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
  SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, sizes WHERE len(w) >= n)),
found AS (SELECT d.rid, d.i, d.n, m.item FROM doc_windows d JOIN item_windows m USING (n, win)),
covered AS (SELECT rid, count(DISTINCT p) AS hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM found) GROUP BY rid),
listed AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM found GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(hit, 0) > 0 AS contaminated
FROM words LEFT JOIN covered USING (rid) LEFT JOIN listed USING (rid)
"""
