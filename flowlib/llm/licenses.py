"""License scans: ordered signature rules behind a keyword prefilter, overlaps resolved by priority and containment.

A text becomes lower-case words joined by single spaces. A rule is tried only where all its keywords are among the
text's words, which most texts fail at once. Each match is a detection: first word, last word, label, strength.
Detections are then taken in order of strength, length, position and label, and one whose words all lie within those
of a detection already taken is suppressed. Base phrases, which a caller may add, are rules of full strength that are
never suppressed.

Defined results: null, empty and wordless texts have 0 words, no detections and score 0; repeated rows are scanned
each for itself; extra columns pass through, and one named like a result is replaced by it.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlib.llm.arrays import IS_WORD, LOWER, map_texts, text_bytes
from flowlib.llm.license_rules import parsed

#: Lower-case bytes of words; all other bytes become spaces.
AS_WORDS = np.where(IS_WORD[LOWER], LOWER, np.uint8(0x20)).tobytes()
SPELLINGS = {b"licence": b"license", b"licences": b"licenses", b"licenced": b"licensed"}
OUTPUTS = (
    "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, "
    "detections array<struct<first: bigint, last: bigint, label: string, strength: int>>"
)


class Scanner:
    """All rules compiled, by keyword."""

    def __init__(self, base: tuple[tuple[str, str], ...]):
        self.rules = [
            (label, strength, frozenset(w.encode() for w in words), re.compile(rb"(?<![^ ])(?:" + text.encode() + rb")(?![^ ])"), False)
            for label, strength, words, text in parsed()
        ]
        for phrase, label in base:
            # Looking ahead finds every place, also ones that overlap.
            words = phrase.encode().split()
            self.rules.append((label, 100, frozenset(words), re.compile(rb"(?<![^ ])(?=(" + re.escape(b" ".join(words)) + rb")(?![^ ]))"), True))
        self.keywords = frozenset(w for r in self.rules for w in r[2]) | frozenset(SPELLINGS)

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int, str, int, bool]]]:
        """Number of words and the surviving detections, by place."""
        words = text.translate(AS_WORDS).split()
        present = self.keywords.intersection(words)
        if not present:
            return len(words), []
        present = present | {SPELLINGS[w] for w in present if w in SPELLINGS}
        tried = [r for r in self.rules if r[2] <= present]
        if not tried:
            return len(words), []
        line = b" ".join(words)
        spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 0x20)
        found = []
        for label, strength, _, expression, base in tried:
            for match in expression.finditer(line):
                a, b = match.span(1) if base else match.span()
                first, last = np.searchsorted(spaces, [a, b]).tolist()
                found.append((first, last, label, strength, base))
        return len(words), suppressed(found, len(words))


def suppressed(found: list[tuple[int, int, str, int, bool]], n_words: int) -> list[tuple[int, int, str, int, bool]]:
    """What remains when every detection inside a stronger (or as strong, but longer or earlier) one goes."""
    kept: list[tuple[int, int, str, int, bool]] = []
    furthest = [-1] * (n_words + 1)  # a tree of prefix maxima: the last word of detections that begin at a word or before
    for d in sorted(set(found), key=lambda d: (-d[3], d[0] - d[1], d[0], d[2], not d[4])):
        first, last, _, _, base = d
        at, reach = first + 1, -1
        while at:
            reach, at = max(reach, furthest[at]), at & (at - 1)
        if base or reach < last:
            kept.append(d)
            at = first + 1
            while at <= n_words:
                furthest[at] = max(furthest[at], last)
                at += at & -at
    return sorted(kept)


@lru_cache(maxsize=4)
def scanner(base: tuple[tuple[str, str], ...]) -> Scanner:
    return Scanner(base)


def scan_licenses(docs: DataFrame, base: tuple[tuple[str, str], ...] = (), text: str = "text") -> DataFrame:
    """All columns but the text, then word counts, labels, score and the detections; no shuffle."""

    def compute(column: pa.Array) -> list:
        data, offsets = text_bytes(column)
        rules = scanner(base)
        rows = [rules.scan(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
        own = [[d for d in found if d[4]] for _, found in rows]
        return [
            pa.array([n for n, _ in rows], pa.int64()),
            pa.array([len(b) for b in own], pa.int64()),
            pa.array([min(d[0] for d in b) if b else None for b in own], pa.int64()),
            pa.array([max(d[0] for d in b) if b else None for b in own], pa.int64()),
            pa.array([",".join(sorted({d[2] for d in b})) for b in own], pa.string()),
            pa.array([",".join(sorted({d[2] for d in found})) for _, found in rows], pa.string()),
            pa.array([max((d[3] for d in found), default=0) / 100 for _, found in rows], pa.float64()),
            pa.array(
                [[{"first": d[0], "last": d[1], "label": d[2], "strength": d[3]} for d in found] for _, found in rows],
                pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("label", pa.string()), ("strength", pa.int32())])),
            ),
        ]

    made = [x.split()[0] for x in OUTPUTS.split(", ") if x.split()[0] in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")]
    keep = [F.col(f"`{c}`") for c in docs.columns if c != text and c not in made]
    return map_texts(docs, keep, F.col(f"`{text}`"), OUTPUTS, compute)
