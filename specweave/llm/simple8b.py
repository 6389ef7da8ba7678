"""Simple-8b: word-aligned coding of ids, coded and decoded with whole arrays.

A 64-bit word holds a selector in its top four bits and, in the other 60,
as many ids as the selector says.  Selectors 0 and 1 are escapes for ids of
more than 60 bits: 0 holds the low 60 bits of one id, a following 1 its top
four.  Every word so tells its own meaning, and a block of words decodes
without looking at its neighbours.  Blocks restart the coding.
"""

from __future__ import annotations

import numpy as np

#: Fixed values of the format: ids a word and bits an id, by selector from 2.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
FIRST = 2
BLOCK = 256
_MASK = np.uint64((1 << 60) - 1)


def _classes(v: np.ndarray) -> np.ndarray:
    """Index of the least width that holds each id; one more than all for escapes."""
    if len(v) and int(v.max()) < len(_SMALL):
        return _SMALL[v.astype(np.int64)]
    return np.searchsorted(_LIMITS, v, "right").astype(np.uint8)


_LIMITS = np.array([1 << w for w in WIDTHS], np.uint64)
_SMALL = np.searchsorted(_LIMITS, np.arange(1 << 16, dtype=np.uint64), "right").astype(np.uint8)


def _choices(v: np.ndarray) -> np.ndarray:
    """At each place the selector that takes the most ids from there on."""
    n = len(v)
    need = _classes(v)
    choice = np.full(n, FIRST + len(COUNTS) - 1, np.uint8)
    least = int(need.min()) if n else 0
    widest, size = need, 1  # widest class among the ``size`` ids from each place on
    for k in range(len(COUNTS) - 2, least - 1, -1):
        count = COUNTS[k]
        if count > n:
            break
        widest = np.maximum(widest[: n - count + 1], widest[count - size :][: n - count + 1])
        size = count
        np.copyto(choice[: n - count + 1], FIRST + k, where=widest <= k)
    choice[need == len(WIDTHS)] = 0
    return choice


def encode(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of each block and the end) of unsigned ``ids``."""
    v = np.ascontiguousarray(ids, np.uint64)
    n = len(v)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    choice = _choices(v)
    taken = np.array((1, 1, *COUNTS), np.int64)[choice]
    # ids that the chosen word takes must not pass the block's end: there, the widest selector that fits
    starts = np.arange(0, n, block)
    ends = np.minimum(starts + block, n)
    fit = np.searchsorted(-np.array(COUNTS), -np.arange(block + 1), "left")  # least selector with at most so many ids
    at, live, firsts, kinds, owners = starts.copy(), np.arange(len(starts)), [], [], []
    while len(live):
        here = at[live]
        room = ends[live] - here
        kind = choice[here].astype(np.int64)
        over = taken[here] > room
        if over.any():
            kind[over] = np.maximum(kind[over], FIRST + fit[room[over]])
        step = np.where(kind == 0, 1, np.array((1, 1, *COUNTS))[kind])
        firsts.append(here)
        kinds.append(kind)
        owners.append(live)
        at[live] = here + step
        live = live[at[live] < ends[live]]
    first, kind = np.concatenate(firsts), np.concatenate(kinds)
    order = np.argsort(first, kind="stable")
    first, kind, owner = first[order], kind[order], np.concatenate(owners)[order]
    size = np.where(kind == 0, 2, 1)
    place = np.concatenate(([0], np.cumsum(size)))
    words = np.zeros(place[-1], np.uint64)
    for k in np.unique(kind):
        sel = np.flatnonzero(kind == k)
        if k == 0:
            words[place[sel]] = v[first[sel]] & _MASK
            words[place[sel] + 1] = (np.uint64(1) << np.uint64(60)) | (v[first[sel]] >> np.uint64(60))
            continue
        count, width = COUNTS[k - FIRST], WIDTHS[k - FIRST]
        word = np.full(len(sel), np.uint64(k) << np.uint64(60))
        for j in range(count):
            word |= v[first[sel] + j] << np.uint64(j * width)
        words[place[sel]] = word
    heads = np.searchsorted(owner, np.arange(len(starts)))
    return words, np.concatenate((place[heads], [len(words)]))


def decode(words: np.ndarray) -> np.ndarray:
    """The ids of whole blocks."""
    words = np.ascontiguousarray(words, np.uint64)
    kind = (words >> np.uint64(60)).astype(np.int64)
    place = np.concatenate(([0], np.cumsum(np.array((1, 0, *COUNTS))[kind])))
    out = np.zeros(place[-1], np.uint64)
    for k in np.unique(kind):
        sel = np.flatnonzero(kind == k)
        body = words[sel] & _MASK
        if k == 0:
            out[place[sel]] = body
        elif k == 1:
            continue
        else:
            count, width = COUNTS[k - FIRST], WIDTHS[k - FIRST]
            mask = np.uint64((1 << width) - 1)
            for j in range(count):
                out[place[sel] + j] = (body >> np.uint64(j * width)) & mask
    high = np.flatnonzero(kind == 1)
    out[place[high] - 1] |= (words[high] & np.uint64(15)) << np.uint64(60)
    return out
