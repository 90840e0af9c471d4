"""Token counts of whole texts: Arrow batches in, lengths out; token ids never leave the task that counts them.

A batch is cut into slices of equal bytes. A long text is no special case: with byte-level BPE every text is cut at
safe boundaries, places where the tokenizer's own splitting rule always ends one piece and begins the next whatever
stands around them. Here these are: a visible ASCII character other than white space, then a space and an ASCII
letter; or an ASCII letter, then one of ``, . ; : ! ? )``. Tokens of a text are then the sum over its units, so equal
units of a slice are encoded once, in one batch call, and units seen before by this worker aren't encoded again
(``CACHE_UNITS`` at most are remembered; those met in few slices are forgotten first). No special token holds such a boundary, which is checked on loading.
Other tokenizers (sentencepiece, word BPE) get whole texts in batches of equal bytes.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows are counted each for itself; strings
of special tokens inside a text are read as the library does by default; extra columns pass through, and one that is
named like a result is replaced by it.
"""

from __future__ import annotations

import base64
import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlib.llm.arrays import map_texts, text_bytes

SLICE_BYTES = 2 << 20
CACHE_UNITS = 500_000
BATCH_UNITS = 5_000

LETTER = np.zeros(256, bool)
LETTER[ord("A"): ord("Z") + 1] = LETTER[ord("a"): ord("z") + 1] = True
VISIBLE = np.zeros(256, bool)
VISIBLE[0x21:0x7F] = True
STOP = np.zeros(256, bool)
STOP[list(b",.;:!?)")] = True
SAFE = re.compile(r"[\x21-\x7E] [A-Za-z]|[A-Za-z][,.;:!?)]")
#: Fixed value: the splitting rule of byte-level BPE that the rank files are read with.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def unit_bounds(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Offsets of all units of a slice: texts cut at every safe boundary."""
    cut = np.zeros(len(data) + 1, bool)
    if len(data) > 2:
        letter = LETTER[data]
        cut[1:-2] = VISIBLE[data[:-2]] & (data[1:-1] == 0x20) & letter[2:]
        cut[1:-1] |= letter[:-1] & STOP[data[1:]]
    cut[offsets] = True
    return np.flatnonzero(cut)


class Encoder:
    """One tokenizer file, with what is known of units already encoded by this worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        kind = os.path.splitext(path)[1]
        self.safe, self.narrow = False, False
        if kind == ".json":
            from tokenizers import Tokenizer

            rules = json.load(open(path, encoding="utf-8"))
            library = Tokenizer.from_file(path)
            library.no_truncation()
            library.no_padding()
            self.narrow = library.get_vocab_size() <= 1 << 16
            self.ids = lambda texts: [x.ids for x in library.encode_batch_fast(texts, add_special_tokens=False)]
            self.lengths = lambda texts: [len(x) for x in library.encode_batch_fast(texts, add_special_tokens=False)]
            split = rules.get("pre_tokenizer") or {}
            added = rules.get("added_tokens") or []
            self.safe = (
                rules.get("normalizer") is None
                and split.get("type") == "ByteLevel"
                and split.get("use_regex", True)
                and not split.get("add_prefix_space")
                and not any(SAFE.search(t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] or t["content"][:1] in " ,.;:!?)" or t["content"][-1:].isalpha() for t in added)
            )
        elif kind == ".tiktoken":
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
            library = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
            self.narrow = max(ranks.values()) < 1 << 16
            self.ids = lambda texts: [library.encode_ordinary(t) for t in texts]
            self.lengths = lambda texts: [len(library.encode_ordinary(t)) for t in texts]
            self.safe = True
        else:
            import sentencepiece

            library = sentencepiece.SentencePieceProcessor(model_file=path)
            self.ids = lambda texts: library.encode(texts, num_threads=1) if texts else []
            self.lengths = lambda texts: [len(x) for x in self.ids(texts)]
        self.forget()

    def forget(self, least: int | None = None) -> None:
        """Forget all units, or those met in fewer than ``least`` slices."""
        if least is None:
            self.known = pa.array([], pa.large_binary())
            self.known_lengths, self.slices = np.zeros(0, np.int32), np.zeros(0, np.int32)
            self.known_ids = np.zeros(0, np.uint16 if self.narrow else np.int32)
            return
        kept = self.slices >= least
        if len(self.known_ids):
            self.known_ids = self.known_ids[np.repeat(kept, self.known_lengths)]
        self.known = self.known.filter(pa.array(kept))
        self.known_lengths, self.slices = self.known_lengths[kept], self.slices[kept]

    def units(self, column: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
        """Units of a slice as a dictionary column, and the units' offsets per text."""
        data, offsets = text_bytes(column)
        bounds = unit_bounds(data, offsets) if self.safe else np.unique(offsets)
        parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        return np.searchsorted(bounds, offsets), parts.dictionary_encode()

    def learn(self, units: pa.Array, with_ids: bool) -> np.ndarray:
        """Places of the units among the known ones; new ones are encoded in batches."""
        least = 2
        while len(self.known) and len(self.known) + len(units) > CACHE_UNITS:
            self.forget(least)
            least *= 2
        place = pc.index_in(units, value_set=self.known)
        if place.null_count:
            new = pc.is_null(place)
            fresh = units.filter(new)
            lengths, ids = [self.known_lengths], [self.known_ids]
            for start in range(0, len(fresh), BATCH_UNITS):
                texts = fresh.slice(start, BATCH_UNITS).cast(pa.large_string()).to_pylist()
                if with_ids:
                    rows = self.ids(texts)
                    lengths.append(np.fromiter(map(len, rows), np.int32, len(rows)))
                    ids.append(np.fromiter((i for r in rows for i in r), self.known_ids.dtype, int(lengths[-1].sum())))
                else:
                    lengths.append(np.array(self.lengths(texts), np.int32))
            known = len(self.known)
            self.known = pa.concat_arrays([self.known, fresh])
            self.known_lengths, self.known_ids = np.concatenate(lengths), np.concatenate(ids)
            self.slices = np.concatenate([self.slices, np.zeros(len(fresh), np.int32)])
            at = pc.fill_null(place, 0).to_numpy(zero_copy_only=False).astype(np.int64)
            at[new.to_numpy(zero_copy_only=False)] = np.arange(known, len(self.known))
        else:
            at = place.to_numpy(zero_copy_only=False).astype(np.int64)
        self.slices[at] += 1
        return at

    def counts(self, column: pa.Array) -> np.ndarray:
        """Number of tokens of each text."""
        of, units = self.units(column)
        if not len(units):
            return np.zeros(len(column), np.int64)
        places = self.learn(units.dictionary, False)
        run = np.concatenate([[0], np.cumsum(self.known_lengths[places][units.indices.to_numpy()], dtype=np.int64)])
        return run[of[1:]] - run[of[:-1]]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts on end, and their offsets per text."""
        of, units = self.units(column)
        if not len(units):
            return np.zeros(0, self.known_ids.dtype), np.zeros(len(column) + 1, np.int64)
        places = self.learn(units.dictionary, True)[units.indices.to_numpy()]
        lengths = self.known_lengths[places]
        begins = (np.cumsum(self.known_lengths, dtype=np.int64) - self.known_lengths)[places]
        run = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        ids = self.known_ids[np.arange(run[-1]) + np.repeat(begins - run[:-1], lengths)]
        return ids, run[of]


@lru_cache(maxsize=4)
def encoder(path: str, use: str = "lengths") -> Encoder:
    """The worker's encoder for a file; one that counts and one that encodes are kept apart."""
    return Encoder(path)


def count_tokens(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """All columns but the text, then n_bytes and n_tokens; one row per row of ``docs``, without a shuffle."""

    def compute(column: pa.Array) -> list:
        return [pc.fill_null(pc.binary_length(column), 0).cast(pa.int64()), pa.array(encoder(path).counts(column), pa.int64())]

    keep = [F.col(f"`{c}`") for c in docs.columns if c not in (text, "n_bytes", "n_tokens")]
    return map_texts(docs, keep, F.col(f"`{text}`"), "n_bytes bigint, n_tokens bigint", compute, SLICE_BYTES)
