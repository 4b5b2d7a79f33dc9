"""Suffix arrays of byte buffers in numpy."""

from __future__ import annotations

import numpy as np

WORD = 8


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place as one big-endian number, so numbers
    compare as bytes do; zeros follow the end."""
    x = np.concatenate((data, np.zeros(WORD, np.uint8))).astype(np.uint64)
    for width in (1, 2, 4):
        x = (x[:-width] << np.uint64(8 * width)) | x[width:]
    return x[: len(data)]


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first ``depth`` bytes at least, by
    Larsson-Sadakane refinement: suffixes are sorted by eight bytes, then groups
    of equal ones by the rank of the suffix h places on, with h doubling;
    groups of one are never touched again.  Zeros follow the end, so suffixes
    that differ only in trailing zero bytes may come in any order."""
    n = len(data)
    words = words_at(data)
    order = np.argsort(words)
    ranked = words[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(n, 1), bool), ranked[1:] != ranked[:-1])))
    sizes = np.diff(np.append(first, n))
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.repeat(first, sizes)
    rank[n] = -1
    places = np.flatnonzero(np.repeat(sizes, sizes) > 1)  # where the order is still open
    h = WORD
    while h < depth and len(places):
        at = order[places]
        key = rank[at] * (n + 2) + rank[np.minimum(at + h, n)] + 1
        inner = np.argsort(key)
        at, key = at[inner], key[inner]
        order[places] = at
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.append(starts, len(places)))
        rank[at] = np.repeat(places[starts], sizes)
        places = places[np.repeat(sizes, sizes) > 1]
        h *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, cap: int, step: int = 16) -> np.ndarray:
    """Common prefix of every suffix with the one before it in ``order``:
    ``cap`` where that many bytes agree, else a multiple of eight below it.

    Kasai's rule: a suffix shares at most one byte less with its predecessor
    than the suffix one place earlier does with its own.  Every ``step``-th
    suffix is compared from the start, the others from what the rule grants.
    It grants nothing past a suffix that agrees up to the cap: the order need
    not go on beyond that."""
    n = len(data)
    words = np.concatenate((words_at(data), np.zeros(cap + WORD, np.uint64)))
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    agree = np.zeros(n, np.int64)
    whole = cap // WORD * WORD

    def extend(at: np.ndarray) -> None:
        live = at[before[at] >= 0]
        while len(live):
            same = words[live + agree[live]] == words[before[live] + agree[live]]
            live = live[same]
            agree[live] += WORD
            live = live[agree[live] < whole]

    base = np.arange(0, n, step)
    extend(base)
    rest = np.flatnonzero(np.arange(n) % step)
    known = agree[rest // step * step]
    agree[rest] = np.where(known < cap // WORD * WORD, np.maximum(known - rest % step, 0) // WORD * WORD, 0)
    agree[before < 0] = 0
    extend(rest)
    last = np.flatnonzero(agree >= whole)
    full = words[last + cap - WORD] == words[before[last] + cap - WORD]
    agree[last[full]] = cap
    # Reading on past the end of the buffer compares zeros with zeros.
    room = n - np.maximum(np.arange(n), before)
    return np.minimum(agree, room)[order]
