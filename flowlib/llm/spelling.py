"""Spelling variants: words at one edit from each other, found by an index of grams of variable length.

1. Words (maximal letter runs, A-Z made lower) are counted over all documents; a run whose checksum with its document asks for it loses one
   letter. Frequent words of some length form the vocabulary, each bracketed by two marks.
2. Gram dictionary, pruned by frequency: a gram of ``QMIN`` letters is lengthened, letter by letter up to ``QMAX``, as long as
   more than a threshold of vocabulary words' places hold it. Only the grams above the threshold need to be known (the rest of
   the dictionary follows from them). The threshold is so chosen that they are ``FREQUENT`` per length at most.
3. A word is cut at every place into the dictionary's gram there; grams inside an earlier one are left out. Per word the
   most grams that one edit can affect is bounded: those that touch the edited letter, and those behind it that a gram
   reaching over the edit could swallow (it must be frequent up to its last letter). Grams before the edit stay.
4. A word shares all its unaffected grams with a near word, at the same place from the start or from the end. So of its grams in
   order of rarity only as many lists as can be affected, and one more, are merged: two near words meet in the list of
   one gram, length and place. Long lists are cut in parts that meet in pairs. All pairs of a list are verified in the task
   and only the near ones are written.
5. Two words of which every gram can be affected share no list for certain. They, and only they, meet once more in an index
   whose dictionary has grams of ``QMIN`` letters alone, of which an edit affects two: words have two letters at least.
6. Forms point to more frequent words; pointers are doubled until none moves.

Defined results: null texts have no words, a null doc_id is an empty one in the checksum; a run of one letter can be
deleted whole and is no word then; repeated rows count again; extra columns don't matter. Words of one letter aren't offered.
"""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlib.llm.arrays import LOWER, byte_slices, released, text_bytes
from flowlib.llm.neardup import in_blocks, whole_blocks
from flowlib.scratch import small_side, stored

EVERY = 97
LEAST_LETTERS, LEAST_COUNT = 5, 3
QMIN, QMAX = 2, 4
#: Places of the vocabulary that a gram must exceed to be lengthened, at least, and the most grams of one length above it.
LONG_LIST, FREQUENT = 64, 1 << 16
BLOCK = 1024
#: Longer words are verified one by one, shorter ones in matrices of this many letters; pairs looked at in one step.
WIDE, PAIRS = 64, 1 << 18

_TABLE = np.zeros(256, np.uint32)
for _i in range(256):
    _c = _i
    for _ in range(8):
        _c = _c >> 1 ^ (0xEDB88320 if _c & 1 else 0)
    _TABLE[_i] = _c


def letter_runs(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of a text column, and start, end and text of every maximal run of letters.

    Letters are A-Z, a-z and U+00C0 to U+00FF, which are those of two bytes that begin with C3.
    """
    raw, offsets = text_bytes(column)
    data = LOWER[raw]
    letter = ((data >= 97) & (data <= 122)) | (data == 0xC3)
    letter[1:] |= data[:-1] == 0xC3
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = letter[:-1], letter[1:]
    starts = np.flatnonzero(letter & (~before | first[:-1]))
    ends = np.flatnonzero(letter & (~after | first[1:])) + 1
    return data, starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def checksums(prefixes: list[bytes], owner: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of each run behind its owner's prefix, all runs a byte at a time."""
    state = np.array([zlib.crc32(p) for p in prefixes], np.uint32)[owner] ^ np.uint32(0xFFFFFFFF)
    order = np.argsort(starts - ends, kind="stable")
    lengths = (ends - starts)[order]
    for j in range(int(lengths[0]) if len(lengths) else 0):
        live = order[: np.searchsorted(-lengths, -j, side="left")]
        if j and len(live) < 8:
            # A few very long runs: the library's own loop.
            for i in live:
                state[i] = zlib.crc32(data[starts[i] + j: ends[i]].tobytes(), int(state[i] ^ 0xFFFFFFFF)) ^ 0xFFFFFFFF
            break
        now = state[live]
        state[live] = _TABLE[(now ^ data[starts[live] + j]) & 0xFF] ^ (now >> np.uint32(8))
    return state ^ np.uint32(0xFFFFFFFF)


def counted_words(docs: DataFrame, letters: int = LEAST_LETTERS, every: int = EVERY) -> DataFrame:
    """word and n over all documents, of at least ``letters`` letters after the deletion."""
    frame = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.col("text").cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            for part in byte_slices(batch, 1):
                data, starts, ends, owner = letter_runs(part.column(1))
                prefixes = [f"{d}:".encode() for d in part.column(0).to_pylist()]
                sums = checksums(prefixes, owner, data, starts, ends)
                edited = sums % np.uint32(every) == 0
                changed = []
                for i in np.flatnonzero(edited):
                    word = data[starts[i]: ends[i]].tobytes().decode()
                    at = int(sums[i]) % len(word)
                    changed.append(word[:at] + word[at + 1:])
                second = np.concatenate([[0], np.cumsum(data == 0xC3)])
                keep = ~edited & (ends - starts - (second[ends] - second[starts]) >= letters)
                starts, ends = starts[keep], ends[keep]
                inside = np.zeros(len(data) + 1, np.int8)
                inside[starts] += 1
                inside[ends] -= 1
                of = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
                plain = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(of), pa.py_buffer(data[np.cumsum(inside[:-1], dtype=np.int8) > 0]))
                tally = pc.value_counts(plain)
                rest = Counter(w for w in changed if len(w) >= letters)
                words = pa.concat_arrays([tally.field(0).cast(pa.string()), pa.array(list(rest), pa.string())])
                yield pa.RecordBatch.from_arrays([words, pa.concat_arrays([tally.field(1), pa.array(list(rest.values()), pa.int64())])], ["word", "n"])

    return frame.mapInArrow(released(run), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_grams(words: DataFrame, qmin: int = QMIN, qmax: int = QMAX, least: int = LONG_LIST, most: int = FREQUENT) -> dict[str, int]:
    """Grams of ``qmin`` to ``qmax`` letters that stand at more places of the vocabulary than the threshold, with their number.

    All places of one length are fewer than the vocabulary's letters, so ``most`` grams of one length at most exceed it.
    """
    letters = words.agg(F.sum(F.length("word") + 2)).first()[0] or 0
    threshold = max(least, -(-letters // most))

    def run(batches):
        for batch in batches:
            for a in range(0, len(batch), 4096):
                tally: Counter = Counter()
                for word in batch.column(0)[a: a + 4096].to_pylist():
                    marked = f"^{word}$"
                    for q in range(qmin, qmax + 1):
                        tally.update(marked[i: i + q] for i in range(len(marked) - q + 1))
                yield pa.RecordBatch.from_arrays([pa.array(list(tally), pa.string()), pa.array(list(tally.values()), pa.int64())], ["gram", "n"])

    grams = words.select("word").mapInArrow(released(run), "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r.gram: r.n for r in grams.where(F.col("n") > threshold).collect()}


class Grams:
    """The dictionary: how a marked word is cut, and how many of its grams one edit can affect."""

    def __init__(self, frequent: dict[str, int], qmin: int = QMIN, qmax: int = QMAX):
        self.frequent, self.qmin, self.qmax = frequent, qmin, qmax
        #: Ends of grams that could be lengthened: what may stand between an edit and the last letter of a swallowing gram.
        self.tails = {g[i:] for g in frequent if len(g) < qmax for i in range(1, len(g))}

    def cut(self, marked: str) -> list[tuple[int, int]]:
        """(start, end) of the word's grams, in order."""
        out, reach, n = [], 0, len(marked)
        for p in range(n - self.qmin + 1):
            end = p + self.qmin
            while end < n and end - p < self.qmax and marked[p:end] in self.frequent:
                end += 1
            if end > reach:
                out.append((p, end))
                reach = end
        return out

    def affected(self, marked: str, grams: list[tuple[int, int]]) -> int:
        """The most grams that one deleted, replaced or inserted letter can change or let go."""
        change = [0] * (len(marked) + 1)
        for p, end in grams:
            # Edits at p to end - 1 touch it; from further left it can be swallowed.
            low = p
            while low > 0 and end - low < self.qmax and marked[low: end - 1] in self.tails:
                low -= 1
            change[low] += 1
            change[end] -= 1
        return max(accumulate(change[: len(marked) - 1]))

    def lists(self, word: str) -> tuple[list[tuple[int, str]], bool]:
        """Place and text of the grams whose lists the word is in, rare ones first, and whether some gram stays in any case."""
        marked = f"^{word}$"
        grams = self.cut(marked)
        most = self.affected(marked, grams)
        rare = sorted([(self.frequent.get(marked[p:end], 0), marked[p:end], p) for p, end in grams])
        return [(p, gram) for _, gram, p in rare[: most + 1]], most < len(grams)


def word_lists(words: DataFrame, grams: Grams, name: str) -> DataFrame:
    """Stored words with the places and grams of the lists that each is in, and whether some gram of it stays in any case."""
    shared = words.sparkSession.sparkContext.broadcast(grams)

    def run(batches):
        for batch in batches:
            found = [shared.value.lists(word) for word in batch.column(0).to_pylist()]
            of = np.concatenate([[0], np.cumsum([len(f) for f, _ in found])]).astype(np.int32)
            cells = pa.StructArray.from_arrays([pa.array([p for f, _ in found for p, _ in f], pa.int32()), pa.array([g for f, _ in found for _, g in f], pa.string())], ["p", "g"])
            lists = pa.ListArray.from_arrays(pa.array(of), cells)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists, pa.array([c for _, c in found], pa.bool_())], ["word", "n", "lists", "sure"])

    return stored(words.select("word", "n").mapInArrow(released(run), "word string, n bigint, lists array<struct<p: int, g: string>>, sure boolean"), name)


def list_members(lists: DataFrame) -> DataFrame:
    """(key, longer, word, n): each word in its lists, as one of the list's length and, one letter shorter, as a longer one."""
    own = "struct(xxhash64(length(word), l.p, l.g) as key, false as longer)"
    other = "struct(xxhash64(length(word) - 1, l.p - {0}, l.g) as key, true as longer)"
    # Lists that share a hash are read as one: their words are verified all the same.
    return lists.select("word", "n", F.inline(F.expr(f"flatten(transform(lists, l -> array({own}, {other.format(0)}, {other.format(1)})))")))


def near_in_matrix(short: np.ndarray, other: np.ndarray, sizes: np.ndarray, other_sizes: np.ndarray) -> np.ndarray:
    """Which pairs of zero-padded letter rows differ by one replaced letter, or by one inserted into the first."""
    width = short.shape[1] - 1
    inside = np.arange(width)[None, :] < sizes[:, None]
    same = (short[:, :width] == other[:, :width]) | ~inside
    replaced = (other_sizes == sizes) & ((~same).sum(axis=1) == 1)
    shifted = (short[:, :width] == other[:, 1:]) | ~inside
    front = np.minimum(np.where(same.all(axis=1), width, np.argmin(same, axis=1)), sizes)
    back = np.where(shifted.all(axis=1), sizes, sizes - width + np.argmin(shifted[:, ::-1], axis=1))
    return replaced | ((other_sizes == sizes + 1) & (front + back >= sizes))


def near(a: str, b: str) -> bool:
    """One inserted, deleted or replaced letter between two words."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def letter_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of words as zero-padded rows of one byte each (none of words over ``WIDE``), their numbers, and their letters as a set of 64 bits."""
    data, offsets = text_bytes(column)
    second = np.zeros(len(data), bool)
    second[1:] = data[:-1] == 0xC3
    flat = np.where(second, data + np.uint8(0x40), data)[data != 0xC3]
    starts = offsets - np.concatenate([[0], np.cumsum(data == 0xC3)])[offsets]
    size = np.diff(starts)
    held = np.bitwise_or.reduceat(np.uint64(1) << (flat & 63).astype(np.uint64), starts[:-1]) if len(size) else np.zeros(0, np.uint64)
    short = size <= WIDE
    letters = np.zeros((len(size), int(size[short].max(initial=0)) + 2), np.uint8)
    wanted = np.repeat(short, size)
    row = np.repeat(np.arange(len(size)), size)
    letters[row[wanted], (np.arange(len(flat)) - starts[row])[wanted]] = flat[wanted]
    return letters, size, held


def near_pairs(column: pa.Array, longer: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of near words of one block, i of the list's length; rows of a block stand together."""
    letters, size, held = letter_rows(column)
    starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    ends = np.append(starts[1:], len(block))
    base = np.flatnonzero(~longer)
    counts = (np.repeat(ends, ends - starts) - np.repeat(starts, ends - starts))[base]
    begin = np.repeat(starts, ends - starts)[base]
    left, right = [], []
    # A row of the list's length meets each such row behind it and all longer rows of its block.
    upto = np.concatenate([[0], np.cumsum(counts)])
    a = 0
    while a < len(base):
        b = max(a + 1, int(np.searchsorted(upto, upto[a] + PAIRS, side="right")) - 1)
        i = np.repeat(base[a:b], counts[a:b])
        j = np.arange(len(i)) + np.repeat(begin[a:b] - (upto[a:b] - upto[a]), counts[a:b])
        # One edit takes a letter from the set, adds one, or both.
        like = np.flatnonzero(np.bitwise_count(held[i] ^ held[j]) <= 2)
        i, j = i[like], j[like]
        meet = longer[j] | (j > i)
        i, j = i[meet], j[meet]
        fast = (size[i] <= WIDE) & (size[j] <= WIDE)
        x, y = i[fast], j[fast]
        good = near_in_matrix(letters[x], letters[y], size[x], size[y])
        i, j = i[~fast], j[~fast]
        slow = np.array([near(column[p].as_py(), column[q].as_py()) for p, q in zip(i.tolist(), j.tolist())], bool)
        left += [x[good], i[slow]]
        right += [y[good], j[slow]]
        a = b
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def merged_lists(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n, other, other_n) of near words that meet in a list, both ways."""
    # Only long lists are cut; they are so few that the rows needn't be shuffled to learn which they are.
    long = small_side(members.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > block), "long_lists")
    sized = members.join(long, "key", "left").select("key", "longer", "word", "n", F.coalesce("size", F.lit(1)).alias("size"), F.xxhash64("word").alias("node"))
    rows = in_blocks(sized, "key", F.col("size"), block).select("block", "longer", "word", "n")

    def run(batches):
        for table in whole_blocks(batches):
            names, n = table["word"].combine_chunks(), table["n"].to_numpy()
            i, j = near_pairs(names, table["longer"].to_numpy(), table["block"].to_numpy())
            both, back = np.concatenate([i, j]), np.concatenate([j, i])
            yield pa.RecordBatch.from_arrays([names.take(pa.array(both)), pa.array(n[both]), names.take(pa.array(back)), pa.array(n[back])], ["word", "n", "other", "other_n"])

    return rows.repartition("block").sortWithinPartitions("block").mapInArrow(released(run), "word string, n bigint, other string, other_n bigint")


def near_words(words: DataFrame, qmin: int = QMIN, qmax: int = QMAX, least: int = LONG_LIST, most: int = FREQUENT, block: int = BLOCK) -> DataFrame:
    """Stored distinct near pairs (word, n, other, other_n) of a vocabulary, both ways."""
    lists = word_lists(words, Grams(frequent_grams(words, qmin, qmax, least, most), qmin, qmax), "word_lists")
    again = word_lists(lists.where("not sure"), Grams({}, qmin, qmin), "open_word_lists")
    found = merged_lists(list_members(lists), block).union(merged_lists(list_members(again), block))
    return stored(found.distinct(), "near_words")


def followed(forms: DataFrame) -> DataFrame:
    """(word, root): pointers (word, form) followed to their ends; a chain of any length takes rounds of its logarithm."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = now.select(F.col("word").alias("__at"), F.col("root").alias("__next"))
        moved = stored(now.join(step, F.col("root") == F.col("__at"), "left").select("word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("moved")), "roots")
        if not moved.where("moved").limit(1).count():
            return moved.select("word", "root")
        now = moved.select("word", "root")


def vocabulary(docs: DataFrame, letters: int = LEAST_LETTERS, count: int = LEAST_COUNT) -> DataFrame:
    """Stored words of at least ``letters`` letters (two or more) that occur ``count`` times or more, with n."""
    if letters < 2:
        raise ValueError("words of one letter have no gram that an edit leaves")
    return stored(counted_words(docs, letters).where(F.col("n") >= count), "vocabulary")


def variants(docs: DataFrame, letters: int = LEAST_LETTERS, count: int = LEAST_COUNT, factor: int = 2, **index) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the vocabulary."""
    words = vocabulary(docs, letters, count)
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("word")))
    about = near_words(words, **index).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    much: Column = -F.col("best.less") >= factor * F.col("n")
    rows = stored(
        words.join(about, "word", "left").select(
            "word", F.when(much, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(much, -F.col("best.less")).alias("form_n")
        ),
        "word_forms",
    )
    roots = followed(rows.where("form is not null"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
