"""Vectorised word splitting and hashing over Arrow text columns.

Texts are handled as UTF-8 bytes.  All separators used here are ASCII, so
splitting bytes equals splitting characters.  A word's hash takes its bytes
eight at a time, each eight mixed in, words over ``LONG`` bytes by BLAKE2; words of
eight bytes or fewer and one length never share a hash.  Sets of words and
shingles are compared by these 64-bit hashes.  Nothing loops over words in Python
but over those longer than ``LONG``.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18

#: ASCII upper case to lower case, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words of everything but ASCII white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: Words of ASCII letters, digits and all bytes of non-ASCII characters.
ALPHANUMERIC = np.zeros(256, bool)
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    ALPHANUMERIC[_a:_b] = True

#: Longest word that is hashed eight bytes at a time.
LONG = 256
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words with full avalanche."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    n, at = len(column), column.offset
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64, n + 1, at * 8) if n else np.zeros(1, np.int64)
    lo = int(offsets[0])
    body = np.frombuffer(data, np.uint8, int(offsets[-1]) - lo, lo) if data is not None else np.zeros(0, np.uint8)
    return body, offsets - lo


def chunks(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` bytes each, one row at least."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, min(end, n)
        row = end


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word ``data[start:end]``."""
    left = end - start
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eights = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    out = mix64(left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (eights[start] & _FIRST[np.minimum(left, 8)]))
    todo = np.flatnonzero((left > 8) & (left <= LONG))
    at = 8
    while len(todo):
        part = eights[start[todo] + at] & _FIRST[np.minimum(left[todo] - at, 8)]
        out[todo] = mix64(out[todo] * np.uint64(0x9FB21C651E98DF25) + mix64(part + np.uint64(at)))
        at += 8
        todo = todo[left[todo] > at]
    for i in np.flatnonzero(left > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8).digest(), "little")
    return out


class Words:
    """Words of a range of texts: hash, byte span and, by text, word ranges."""

    def __init__(self, body: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, hashes: bool = True):
        self.bytes = LOWER[body]
        n = len(body)
        inside = is_word[body]
        before = np.zeros(n, bool)
        after = np.zeros(n, bool)
        if n:
            before[1:] = inside[:-1]
            after[:-1] = inside[1:]
            first = offsets[:-1][offsets[:-1] < n]
            before[first] = False
            after[first[first > 0] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        #: texts' ranges of words: text i has words at[i] to at[i + 1]
        self.at = np.searchsorted(self.start, offsets)
        if hashes:
            self.hash = word_hashes(self.bytes, self.start, self.end)


def words_of(body: np.ndarray, offsets: np.ndarray, lo: int, hi: int, is_word: np.ndarray) -> Words:
    a, b = int(offsets[lo]), int(offsets[hi])
    return Words(body[a:b], offsets[lo : hi + 1] - a, is_word)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words that starts at a word, for all but the last k - 1."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[k - 1 :].copy()
    for j in range(k - 2, -1, -1):
        out = mix64(out * np.uint64(0x9FB21C651E98DF25) + words[j : j + n])
    return out


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct shingles of one text; fewer words than ``k`` make one shingle, none make none."""
    if 0 < len(words) < k:
        whole = shingle_hashes(words, len(words))
        return mix64(whole + np.uint64(len(words)))
    return np.unique(shingle_hashes(words, k))


#: What operators keep in a worker between tasks; those that don't use it empty it.
KEPT_IN_WORKER: list[dict] = []


def _drop_kept() -> None:
    for held in KEPT_IN_WORKER:
        held.clear()


def tidy(run, every: int = 8, keep: bool = False):
    """``run`` for mapInArrow, giving freed memory back to the system now and then: workers outlive their tasks.

    Unless ``keep``, what other operators left in the worker goes first.
    """

    def give_back() -> None:
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # other C libraries have no such call
            pass

    def tidied(batches):
        if not keep:
            _drop_kept()  # by name: closures travel with copies of what they refer to
        try:
            for n, out in enumerate(run(batches), 1):
                yield out
                if n % every == 0:
                    give_back()
        finally:
            give_back()

    return tidied
