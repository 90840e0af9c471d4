"""Suffix arrays by two-stage sorting, in numpy, for blocks of a few megabytes.

A suffix that is smaller than its successor is sorted directly; all others follow from those by one scan over the
buckets of first bytes: when a suffix is met, the one that begins a byte earlier, if it is larger than its successor,
takes the next free place of its bucket. Buckets are scanned in waves of whole arrays, not entry by entry.
"""

from __future__ import annotations

import numpy as np


def words_at(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as one number that sorts like the bytes; zeros follow the end."""
    padded = np.concatenate([text, np.zeros(16, np.uint8)]).astype(np.uint64)
    n = len(text) + 8
    out = np.zeros(n, np.uint64)
    for j in range(8):
        out |= padded[j: j + n] << np.uint64(56 - 8 * j)
    return out


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one that begins a byte later (the empty suffix is the smallest)."""
    n = len(text)
    turns = np.flatnonzero(text[:-1] != text[1:])
    rises = np.concatenate([text[turns] < text[turns + 1], [False]])
    return np.repeat(rises, np.diff(np.concatenate([[-1], turns, [n - 1]])))


def sorted_directly(text: np.ndarray, words: np.ndarray, some: np.ndarray) -> np.ndarray:
    """The suffixes ``some`` in order. Tied groups are compared 8 bytes further, all at once, until none is left."""
    order = some[np.argsort(words[some], kind="stable")]
    first = words[order]
    fresh = np.concatenate([[True], first[1:] != first[:-1]])
    group = np.cumsum(fresh) - 1
    size = np.bincount(group)
    place = np.flatnonzero(size[group] > 1)
    group = np.cumsum(fresh[place]) - 1 if len(place) else place
    depth = 8
    last = len(words) - 1
    while len(place):
        at = order[place]
        value = words[np.minimum(at + depth, last)]
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        differs = np.maximum.reduceat(value, starts) != np.minimum.reduceat(value, starts)
        moved = differs[group]
        if moved.any():
            turn = np.lexsort((value[moved], group[moved]))
            order[place[moved]] = at[moved][turn]
            value[moved] = value[moved][turn]
        fresh = np.concatenate([[True], (group[1:] != group[:-1]) | (value[1:] != value[:-1])])
        group = np.cumsum(fresh) - 1
        tied = np.bincount(group)[group] > 1
        place, fresh = place[tied], fresh[tied]
        group = np.cumsum(fresh) - 1
        depth += 8
        if depth > len(text) + 8:
            # Only suffixes that end in zero bytes are still tied: the shorter is the smaller.
            order[place] = order[place][np.lexsort((-order[place], group))]
            break
    return order


def suffix_array(text: np.ndarray, words: np.ndarray | None = None) -> np.ndarray:
    """Positions of all suffixes of a byte array in order."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    words = words_at(text) if words is None else words
    direct = smaller_than_next(text)
    counts = np.bincount(text, minlength=256)
    end = np.cumsum(counts)
    head = end - counts
    chosen = np.flatnonzero(direct)
    ordered = sorted_directly(text, words, chosen)
    direct_counts = np.bincount(text[chosen], minlength=256)
    out = np.empty(n, np.int64)
    taken = 0
    for c in range(256):
        size = direct_counts[c]
        out[end[c] - size: end[c]] = ordered[taken: taken + size]
        taken += size
    start = head.copy()

    def induce(met: np.ndarray) -> None:
        before = met - 1
        before = before[before >= 0]
        before = before[~direct[before]]
        if not len(before):
            return
        byte = text[before]
        turn = np.argsort(byte, kind="stable")
        before, byte = before[turn], byte[turn]
        each = np.bincount(byte, minlength=256)
        out[head[byte] + np.arange(len(before)) - (np.cumsum(each) - each)[byte]] = before
        head[:] += each

    # The empty suffix comes before all and is met first.
    out[head[text[n - 1]]] = n - 1
    head[text[n - 1]] += 1
    for c in np.flatnonzero(counts):
        done = start[c]
        while done < head[c]:
            upto = head[c]
            induce(out[done:upto])
            done = upto
        induce(out[end[c] - direct_counts[c]: end[c]])
    return out


def common_prefixes(text: np.ndarray, words: np.ndarray, order: np.ndarray, limit: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Common prefix of each suffix and the one before it in ``order``, ``limit`` at most; 0 where not ``wanted``."""
    out = np.zeros(len(order), np.int64)
    left = np.arange(1, len(order))
    if wanted is not None:
        left = left[wanted[order[1:]] & wanted[order[:-1]]]
    depth, last, n = 0, len(words) - 1, len(text)
    while len(left) and depth < limit:
        a, b = order[left - 1], order[left]
        differ = words[np.minimum(a + depth, last)] ^ words[np.minimum(b + depth, last)]
        stop = differ != 0
        # The first byte that differs, from the highest bit that is set; halves are exact as floats.
        high, low = (differ[stop] >> np.uint64(32)).astype(np.float64), (differ[stop] & np.uint64(0xFFFFFFFF)).astype(np.float64)
        same = depth + (64 - np.where(high > 0, np.frexp(high)[1] + 32, np.frexp(low)[1])) // 8
        out[left[stop]] = np.minimum(np.minimum(same, n - np.maximum(a[stop], b[stop])), limit)
        left, depth = left[~stop], depth + 8
        if len(left):
            over = np.maximum(order[left - 1], order[left]) + depth >= n
            out[left[over]] = np.minimum(n - np.maximum(order[left[over] - 1], order[left[over]]), limit)
            left = left[~over]
    out[left] = limit
    return out
