"""Benchmark decontamination by latent semantic retrieval.

Texts and benchmark items are windows of words (runs of ASCII letters, digits
and all non-ASCII characters, lower-cased) in a hashed TF-IDF space; document
frequencies are counted over all documents.  A distributed randomised SVD of
the passages of all texts and of all items, which weigh as much together as the texts'
passages do (more, if they are more), gives a latent space.  Each word has a latent
vector, so the vector of any window is a difference of running sums, and every
window of a document meets the items by cosine, in blocks.  Besides, windows around
runs of ``SHORT`` words of an item (of all its words, if they are fewer) are
candidates whatever their cosine, so that no verbatim copy is missed.  Candidates are
verified on whole words: a window leaks an item if their longest common
subsequence covers ``COPY`` of the item's words, or ``PARAPHRASE`` of them
while the item's answer is there too.

The answer is the column ``answer`` of the benchmark where it has one, else the
item's last sentence.

One pass over the documents serves any number of items: executors write the items, equal ones
once, as blocks of about ``ITEM_BLOCK`` in the shared folder, and a task reads them in turn,
holding ``HELD_BLOCKS``.  What is broadcast is the latent space, 2**BITS x RANK numbers at most.
Texts are searched in stretches of ``STRETCH`` words.  No texts are shuffled; the fit stages two bytes
a word and sends a table of all slots from each of its tasks, whose number follows the cores.

Defined cases: null and empty texts leak nothing; items that are null or
without words match nothing; items of fewer than five words match only where
their words stand consecutively; rows repeated with one doc_id or item_id
count one by one; an empty table gives no rows; extra columns are ignored by
``find_leaks`` and kept by ``keep_clean``, whatever their names.
"""

from __future__ import annotations

import pickle
import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytewords import ALPHANUMERIC, Words, chunks, mix64, text_bytes, tidy, words_of
from .common import filter_texts, fresh_path, staged, table

BITS = 15
SLOTS = 1 << BITS
RANK = 64
OVERSAMPLE = 8
WINDOW = 32
#: Passages that meet the space at a time.
PASSAGES = 4096
#: Slots whose sums travel together.
BLOCK = 1 << 10
COSINE = 0.45
#: Least share of an item's TF-IDF weight in a window that is verified.
LEXICAL = 0.35
COPY = 0.8
PARAPHRASE = 0.6
ITEM_BLOCK = 4096
#: Blocks of items that a task holds at a time.
HELD_BLOCKS = 4
#: Words of a text that are searched at a time.
STRETCH = 1 << 15
#: Bits that tell which words an item may hold, by the last bits of their slots.
HELD_BITS = 4096
SHORT = 5
_SENTENCE = re.compile(r"[.!?]+\s+")


def runs_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words."""
    out = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for j in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + len(out)]
    return mix64(out)


def slots_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def text_words(text: str | None) -> np.ndarray:
    body = np.frombuffer((text or "").encode(), np.uint8)
    return Words(body, np.array([0, len(body)]), ALPHANUMERIC).hash


def word_slots(texts: DataFrame) -> DataFrame:
    """(slots, size) of ``texts`` (text), staged: one row a run of texts, the slots of their words and each text's number of them."""

    def run(batches):
        for batch in batches:
            body, offsets = text_bytes(batch.column("text"))
            slots, size = [], []
            for lo, hi in chunks(offsets):
                w = words_of(body, offsets, lo, hi, ALPHANUMERIC)
                slots.append(slots_of(w.hash).astype("<u2").tobytes())
                size.append(np.diff(w.at).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(x)], pa.binary()) for x in (slots, size)], ["slots", "size"])

    return staged(texts.select(F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), "slots binary, size binary"), "slots")


def _runs(batches):
    """(slots, size, weight) of each row of ``word_slots``."""
    for batch in batches:
        weights = batch.column("weight").to_pylist() if "weight" in batch.schema.names else [1.0] * len(batch)
        for slots, size, weight in zip(batch.column("slots"), batch.column("size"), weights):
            yield np.frombuffer(slots.as_py(), "<u2").astype(np.int32), np.frombuffer(size.as_py(), "<i8"), weight


def _counted(rows: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct pairs of a row and a slot as one number, how often each is there); ``rows`` ascend."""
    few = not len(rows) or rows[-1] < 1 << 31 - BITS
    key = np.sort(rows.astype(np.int32 if few else np.int64) << BITS | slots)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return key[first], np.diff(first, append=len(key))


def word_frequencies(words: DataFrame, width: int = WINDOW) -> tuple[np.ndarray, int]:
    """(inverse document frequencies of all slots, number of passages), counted over all of ``words`` (``word_slots``)."""

    def run(batches):
        total = np.zeros(SLOTS + 2, np.int64)
        for slots, size, _ in _runs(batches):
            total[SLOTS] += len(size)
            total[SLOTS + 1] += int((-(-size // width)).sum())
            total[:SLOTS] += np.bincount(_counted(np.repeat(np.arange(len(size)), size), slots)[0] & SLOTS - 1, minlength=SLOTS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["slot", "n"])

    got = words.mapInArrow(tidy(run), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(SLOTS + 2)
    n[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    return np.log((1.0 + n[SLOTS]) / (1.0 + n[:SLOTS])) + 0.1, int(n[SLOTS + 1])


def _passages(slots: np.ndarray, size: np.ndarray, idf: np.ndarray, width: int):
    """(passage of each word, slot of each word, one over the length of each passage's row) of consecutive windows of all texts, in blocks."""
    count = -(-size // width)
    n = int(count.sum())
    first = np.cumsum(count) - count
    passage = np.repeat((first * width - np.cumsum(size) + size).astype(np.int32), size)
    passage += np.arange(len(slots), dtype=np.int32)
    passage //= width
    many = -(-n // max(1, -(-n // PASSAGES)))
    for lo in range(0, n, max(1, many)):
        a, b = np.searchsorted(passage, (lo, lo + many))
        row, slot = passage[a:b] - lo, slots[a:b]
        key, times = _counted(row, slot)
        yield row, slot, 1.0 / np.sqrt(np.bincount(key >> BITS, (times * idf[key & SLOTS - 1]) ** 2))


def _add_rows(out: np.ndarray, at: np.ndarray, rows: np.ndarray, of: np.ndarray) -> None:
    """Adds the rows ``of`` of ``rows`` to those of ``out`` that the ascending ``at`` names."""
    for lo in range(0, len(at), 1024):
        own = at[lo : lo + 1024]
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        out[own[first]] += np.add.reduceat(rows[of[lo : lo + 1024]], first, axis=0)


def _sketch(words: DataFrame, idf: np.ndarray, test: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(Y'Y, A'Y) of the passages A and Y = A ``test``: each task adds up its own, sums are added by blocks of slots.

    Slots that are frequent in a block of passages meet as a dense matrix, the others row by row.
    """
    l = test.shape[1]  # noqa: E741
    spark = words.sparkSession
    shared = spark.sparkContext.broadcast((idf, (idf[:, None] * test).astype(np.float32)))

    def run(batches):
        idf, test = shared.value
        gram, back = np.zeros((l, l)), np.zeros((SLOTS, l))
        for slots, size, weight in _runs(batches):
            for row, slot, scale in _passages(slots, size, idf, width):
                n, scale = len(scale), (weight * scale).astype(np.float32)[:, None]
                often = np.flatnonzero(np.bincount(slot, minlength=SLOTS) > n // 32)
                column = np.full(SLOTS, -1)
                column[often] = np.arange(len(often))
                own = column[slot]
                dense = np.bincount(row[own >= 0] * len(often) + own[own >= 0], minlength=n * len(often)).reshape(n, len(often)).astype(np.float32)
                row, slot = row[own < 0], slot[own < 0]
                y = dense @ test[often]
                _add_rows(y, row, test, slot)
                y *= scale
                gram += (wide := y.astype(np.float64)).T @ wide
                y *= scale
                back[often] += dense.T @ y
                order = np.argsort(slot.astype(np.uint16), kind="stable")
                _add_rows(back, slot[order], y, row[order])
        back *= idf[:, None]
        for k in range(0, SLOTS, BLOCK):
            yield pa.RecordBatch.from_arrays([pa.array([k // BLOCK], pa.int32()), pa.array([back[k : k + BLOCK].astype("<f4").tobytes()], pa.binary())], ["block", "sums"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([gram.astype("<f8").tobytes()], pa.binary())], ["block", "sums"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, sums in zip(batch.column("block").to_pylist(), batch.column("sums")):
                part = np.frombuffer(sums.as_py(), "<f4" if k >= 0 else "<f8")
                total[k] = total[k] + part if k in total else part.astype(np.float64)
        for k, sums in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([sums.tobytes()], pa.binary())], ["block", "sums"])

    # every task gives a table of all slots, so its tasks are few
    few = words.coalesce(max(8, 2 * spark.sparkContext.defaultParallelism))
    schema = "block int, sums binary"
    got = few.mapInArrow(tidy(run), schema).repartition("block").mapInArrow(tidy(add), schema).toArrow()
    shared.destroy()
    gram, back = np.zeros((l, l)), np.zeros((SLOTS, l))
    for k, sums in zip(got.column("block").to_pylist(), got.column("sums")):
        if k < 0:
            gram[:] = np.frombuffer(sums.as_py(), "<f8").reshape(l, l)
        else:
            back[k * BLOCK : (k + 1) * BLOCK] = np.frombuffer(sums.as_py(), "<f8").reshape(-1, l)
    return gram, back


def randomised_svd(words: DataFrame, idf: np.ndarray, rank: int = RANK, power: int = 1, width: int = WINDOW, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right vectors) of the TF-IDF passages of ``words`` (``word_slots`` and maybe a weight), to about ``rank``.

    Halko, Martinsson and Tropp's range finder with ``power`` power steps; Q stays
    implicit: Q = Y V L^-1/2 with Y'Y = V L V', so B = L^-1/2 V' Y'A.
    """
    test = np.random.default_rng(seed).standard_normal((SLOTS, rank + OVERSAMPLE))
    for _ in range(power):
        _, back = _sketch(words, idf, test, width)
        test = np.linalg.qr(back)[0]
    gram, back = _sketch(words, idf, test, width)
    # columns of no weight: there are fewer passages than columns
    weight, vectors = np.linalg.eigh((gram + gram.T) / 2)
    some = weight > max(1e-10 * weight[-1], 1e-12)
    if not some.any():
        return np.zeros(0), np.zeros((SLOTS, 0))
    b = (back @ (vectors[:, some] / np.sqrt(weight[some]))).T
    values, left = np.linalg.eigh(b @ b.T)
    values, left = np.sqrt(np.maximum(values[::-1][:rank], 0)), left[:, ::-1][:, :rank]
    good = values > 1e-6 * max(values[0], 1e-12)
    return values[good], (b.T @ left[:, good]) / values[good]


class Item:
    """A benchmark item ready for verification."""

    def __init__(self, item_id: int | None, text: str | None, answer: str | None = None):
        self.item_id = item_id
        self.words = text_words(text)
        self.n = len(self.words)
        if answer is None:
            parts = [p for p in _SENTENCE.split(text or "") if p.strip()]
            answer = parts[-1] if parts else ""
        self.answer = text_words(answer)

    def common(self, region: list[int]) -> int:
        """Length of the longest common subsequence with ``region`` (bit-parallel)."""
        masks: dict[int, int] = {}
        for i, w in enumerate(self.words.tolist()):
            masks[w] = masks.get(w, 0) | 1 << i
        full = (1 << self.n) - 1
        v, get = full, masks.get
        for w in region:
            m = get(w)
            if m:
                u = v & m
                v = (v + u | v - u) & full
        return self.n - v.bit_count()

    def leak(self, region: np.ndarray) -> tuple[str, int] | None:
        """(kind, common words) if ``region`` leaks this item."""
        if self.n < SHORT:
            at = np.flatnonzero(region[: max(0, len(region) - self.n + 1)] == self.words[0])
            return ("copy", self.n) if any((region[i : i + self.n] == self.words).all() for i in at) else None
        lcs = self.common(region.tolist())
        if lcs >= COPY * self.n:
            return "copy", lcs
        if lcs >= PARAPHRASE * self.n and len(self.answer) and np.isin(self.answer, region).mean() >= COPY:
            return "paraphrase", lcs
        return None


class Space:
    """The latent space: weights and vectors of all word slots, and of one more, empty slot that fills texts up."""

    def __init__(self, idf: np.ndarray, values: np.ndarray, right: np.ndarray):
        self.idf = np.append(idf, 0.0).astype(np.float32)
        #: a row for each slot, so that a word's vector is one stretch of memory
        self.rows = np.zeros((SLOTS + 1, max(1, len(values))), np.float32)
        if len(values):
            self.rows[:SLOTS] = idf[:, None] * right / np.maximum(values, 1e-9)


def running_sums(rows: np.ndarray) -> np.ndarray:
    """Sums of the rows before each place, from none to all: within blocks of 64 side by side, then over the blocks."""
    n, wide = rows.shape
    out = np.zeros((-(-(n + 1) // 64) * 64, wide))
    out[1 : n + 1] = rows
    blocks = out.reshape(-1, 64, wide)
    for j in range(1, 64):
        blocks[:, j] += blocks[:, j - 1]
    blocks[1:] += np.cumsum(blocks[:-1, -1], axis=0)[:, None]
    return out[: n + 1]


class LatentIndex:
    """A block of items in the latent space, by window width.

    Windows start at every fourth word at most; sums of four words carry all of them.
    """

    def __init__(self, items: list[Item], space: Space, cosine: float = COSINE):
        self.items = [i for i in items if i.n]
        self.space, self.cosine = space, cosine
        held = np.zeros((len(self.items), HELD_BITS), bool)
        for k, i in enumerate(self.items):
            held[k, slots_of(i.words) % HELD_BITS] = True
        self.held = np.packbits(held, axis=1, bitorder="little")
        self.weight = np.array([space.idf[slots_of(i.words)].sum() for i in self.items], np.float32)
        self.scales: list[tuple[int, np.ndarray, np.ndarray]] = []
        widths = np.array([max(4, 1 << round(float(np.log2(i.n)))) for i in self.items], int)
        self.vectors = np.zeros((len(self.items), space.rows.shape[1]), np.float32)
        for width in sorted(set(widths.tolist())):
            own = np.flatnonzero(widths == width)
            x = np.array([space.rows[slots_of(self.items[k].words)].sum(axis=0) for k in own])
            self.vectors[own] = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
            self.scales.append((width, own))

        # by length: hashes of the heaviest run of each eight of an item, in order, with item and place in it
        self.runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        found: dict[int, list[tuple[int, int, int]]] = {}
        for k, i in enumerate(self.items):
            n = min(SHORT, i.n)
            run, weight = runs_of(i.words, n), np.convolve(space.idf[slots_of(i.words)], np.ones(n), "valid")
            places = [lo + int(weight[lo : lo + 8].argmax()) for lo in range(0, len(run), 8)]
            found.setdefault(n, []).extend((int(run[p]), k, p) for p in places)
        for n, rows in found.items():
            rows.sort()
            key = np.array([r[0] for r in rows], np.uint64)
            some = np.zeros(1 << 18, bool)
            some[key >> np.uint64(46)] = True
            self.runs[n] = np.packbits(some, bitorder="little"), key, np.array([r[1] for r in rows]), np.array([r[2] for r in rows])

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "space"}

    def copies(self, hashes: np.ndarray, at: np.ndarray):
        """(text, item, first word in the text, width, cosine) of windows that share a run of words with an item."""
        for n, (some, key, items, places) in self.runs.items():
            run = runs_of(hashes, n)
            top = (run >> np.uint64(46)).astype(np.int64)
            first = np.flatnonzero(some[top >> 3] >> (top & 7).astype(np.uint8) & 1)
            text = np.searchsorted(at, first, "right") - 1
            inside = first + n <= at[text + 1]
            first, text = first[inside], text[inside]
            lo, hi = np.searchsorted(key, run[first], "left"), np.searchsorted(key, run[first], "right")
            for j in np.flatnonzero(hi > lo).tolist():
                t = int(text[j])
                size = int(at[t + 1] - at[t])
                for e in range(lo[j], hi[j]):
                    k = int(items[e])
                    start = min(max(0, int(first[j] - at[t]) - int(places[e])), size - 1)
                    x = self.space.rows[slots_of(hashes[at[t] + start : at[t] + min(size, start + self.items[k].n)])].sum(axis=0)
                    yield t, k, start, self.items[k].n, float(self.vectors[k] @ x / max(float(np.linalg.norm(x)), 1e-9))

    def candidates(self, hashes: np.ndarray, at: np.ndarray):
        """Arrays (text, item, first word in the text, width, cosine) of windows near an item.

        Texts have words at[i] to at[i + 1].  Long ones are cut into stretches that overlap by
        the widest window.
        """
        overlap = max((width for width, _ in self.scales), default=0)
        size = np.diff(at)
        if not len(size) or size.max() <= STRETCH + overlap:
            yield from self._near(hashes, at)
            return
        whole = np.flatnonzero(size <= STRETCH + overlap)
        pieces = [(t, 0, int(size[t])) for t in whole.tolist()]
        pieces += [(t, lo, min(lo + STRETCH + overlap, int(size[t]))) for t in np.flatnonzero(size > STRETCH + overlap).tolist() for lo in range(0, int(size[t]), STRETCH)]
        while pieces:
            n, words = 0, 0
            while n < len(pieces) and (not n or words < STRETCH):
                words += pieces[n][2] - pieces[n][1]
                n += 1
            now, pieces = pieces[:n], pieces[n:]
            some = np.concatenate([hashes[at[t] + a : at[t] + b] for t, a, b in now])
            places = np.concatenate(([0], np.cumsum([b - a for _, a, b in now])))
            text, lo = np.array([t for t, _, _ in now]), np.array([a for _, a, _ in now])
            for own, item, first, width, cosine in self._near(some, places):
                yield text[own], item, first + lo[own], width, cosine

    def _near(self, hashes: np.ndarray, at: np.ndarray):
        """Near: by cosine in the latent space, and then by the share of the item's
        TF-IDF weight that the window's words hold."""
        idf, vectors = self.space.idf, self.space.rows
        size = np.diff(at)
        fours = -(-size // 4)
        base = np.concatenate(([0], np.cumsum(fours)))
        slots = np.full(4 * base[-1], SLOTS, np.int64)
        slots[np.arange(len(hashes)) + np.repeat(4 * base[:-1] - at[:-1], size)] = slots_of(hashes)
        sums = vectors[slots[0::4]]
        for j in (1, 2, 3):
            sums += vectors[slots[j::4]]
        total = running_sums(sums)
        del sums
        for width, own in self.scales:
            step, wide = max(1, width // 16), width // 4
            # windows every step fours and one at the text's end
            count = np.where(fours > wide, -(-(fours - wide) // step) + 1, (fours > 0).astype(int))
            text = np.repeat(np.arange(len(size)), count)
            nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
            start = base[:-1][text] + np.minimum(nth * step, np.maximum(fours[text] - wide, 0))
            end = np.minimum(start + wide, base[1:][text])
            inside = np.arange(width)
            many = max(1, (1 << 19) // width)
            for lo in range(0, len(start), 4096):
                part = slice(lo, lo + 4096)
                x = (total[end[part]] - total[start[part]]).astype(np.float32)
                x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-9)[:, None]
                for b in range(0, len(own), 512):
                    cosine = self.vectors[own[b : b + 512]] @ x.T
                    k, i = np.divmod(np.flatnonzero(cosine >= self.cosine), len(x))
                    for c in range(0, len(k), many):
                        kk, ii = k[c : c + many], i[c : c + many]
                        item, first = own[b + kk], start[lo + ii]
                        words = slots[np.minimum(4 * first[:, None] + inside, len(slots) - 1)]
                        words[inside[None, :] >= 4 * (end[lo + ii] - first)[:, None]] = SLOTS
                        bit = words % HELD_BITS
                        share = ((self.held[item[:, None], bit >> 3] >> (bit & 7).astype(np.uint8) & 1) * idf[words]).sum(axis=1)
                        good = share >= LEXICAL * self.weight[item]
                        if good.any():
                            t = text[lo + ii[good]]
                            yield t, item[good], 4 * (first[good] - base[t]), width, cosine[kk[good], ii[good]]

    def leaks(self, hashes: np.ndarray, at: np.ndarray):
        """(text, item, first word of the region, common words, kind, cosine): the nearest verified window of each pair."""
        by_pair: dict[tuple[int, int], list[tuple[float, int, int]]] = {}
        for text, item, start, width, cosine in self.candidates(hashes, at):
            for t, k, s, c in zip(text.tolist(), item.tolist(), start.tolist(), cosine.tolist()):
                by_pair.setdefault((t, k), []).append((-c, s, width))
        for t, k, s, width, c in self.copies(hashes, at):
            by_pair.setdefault((t, k), []).append((-c, s, width))
        for (text, k), windows in sorted(by_pair.items()):
            item, n = self.items[k], int(at[text + 1] - at[text])
            for cosine, start, width in sorted(windows):
                more = item.n // 2 + width // 4
                lo, hi = max(0, start - more), min(n, start + width + more)
                found = item.leak(hashes[at[text] + lo : at[text] + hi])
                if found:
                    yield text, item, lo, found[1], found[0], -cosine
                    break


def fit_space(docs: DataFrame, benchmark: DataFrame, sample: int | None = None) -> Space:
    """The latent space of all items and all texts of ``docs``, or of about ``sample`` distinct texts if asked for."""
    own = docs.select(F.col("text").cast("string").alias("text")).where("text is not null")
    words = word_slots(own)
    items = word_slots(benchmark.where("text is not null"))
    (idf, many), (_, few) = word_frequencies(words), word_frequencies(items)
    if sample is not None:
        words = word_slots(own.where((F.shiftrightunsigned(F.xxhash64("text"), 11) / F.lit(float(1 << 53))) < min(1.0, sample / max(1, own.count()))).distinct())
        _, many = word_frequencies(words)
    fit_on = words.withColumn("weight", F.lit(1.0)).unionByName(items.withColumn("weight", F.lit(max(1.0, many / max(1, few)) ** 0.5)))
    return Space(idf, *randomised_svd(fit_on, idf))


class Search:
    """The items of ``benchmark`` (item_id, text and maybe answer), ready to be searched for."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, sample: int | None = None, cosine: float = COSINE, block: int = ITEM_BLOCK):
        spark = docs.sparkSession
        answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
        self.listed = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"), answer.alias("answer"))
        own = self.listed.select("text", "answer").where("text is not null").distinct()
        #: (k, text, answer): items that differ, numbered
        self.items = staged(own.withColumn("k", F.monotonically_increasing_id()), "items")
        space = fit_space(docs, benchmark, sample)
        self.folder, self.shared = fresh_path(spark, "item-blocks"), spark.sparkContext.broadcast(space)
        self.paths = self._write(cosine, block)

    def _write(self, cosine: float, block: int) -> list[str]:
        folder, shared = self.folder, self.shared

        def run(batches):
            fs, root = pafs.FileSystem.from_uri(folder)
            fs.create_dir(root, recursive=True)
            rows: list[tuple] = []

            def put() -> str:
                path = f"{root}/{uuid.uuid4().hex}"
                with fs.open_output_stream(path, compression=None) as out:
                    out.write(pickle.dumps(LatentIndex([Item(*r) for r in rows], shared.value, cosine)))
                rows.clear()
                return path

            for batch in batches:
                for r in zip(*(batch.column(c).to_pylist() for c in ("k", "text", "answer"))):
                    rows.append(r)
                    if len(rows) == block:
                        yield pa.RecordBatch.from_arrays([pa.array([put()])], ["path"])
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([put()])], ["path"])

        n = max(1, -(-self.items.count() // block))
        done = staged(self.items.repartition(n).mapInArrow(tidy(run), "path string"), "item-manifest")
        return sorted(r["path"] for r in done.collect())  # one row a block

    def found(self, batches):
        """(batch, (row, item, first word, common words, kind, cosine) of each leak) for batches with ``text``; for tasks."""
        fs, _ = pafs.FileSystem.from_uri(self.folder)
        held: dict[str, LatentIndex] = {}
        for batch in batches:
            body, offsets = text_bytes(batch.column("text"))
            parts = [(lo, (w := words_of(body, offsets, lo, hi, ALPHANUMERIC)).hash, w.at) for lo, hi in chunks(offsets)]
            out = []
            for path in self.paths:
                if path not in held:
                    while len(held) >= HELD_BLOCKS:
                        held.pop(next(iter(held)))
                    with fs.open_input_stream(path, compression=None) as source:
                        held[path] = pickle.loads(source.read())
                    held[path].space = self.shared.value
                out += [(lo + t, *leak) for lo, hashes, at in parts for t, *leak in held[path].leaks(hashes, at)]
            yield batch, out

    def __getstate__(self):
        return {"folder": self.folder, "shared": self.shared, "paths": self.paths}


def find_leaks(docs: DataFrame, benchmark: DataFrame, sample: int | None = None, cosine: float = COSINE, block: int = ITEM_BLOCK) -> DataFrame:
    """(doc_id, item_id, first_word, item_words, common_words, kind, cosine): one row for each document and item it leaks."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, k long, first_word long, item_words long, common_words long, kind string, cosine double"
    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.int64()] * 5 + [pa.string(), pa.float64()]
    search = Search(docs, benchmark, sample, cosine, block)

    def run(batches):
        for batch, leaks in search.found(batches):
            ids = batch.column("doc_id").to_pylist()
            found = [(ids[row], i.item_id, first, i.n, lcs, kind, cos) for row, i, first, lcs, kind, cos in leaks]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names)

    # each item that differs stands for all benchmark rows equal to it
    same = [search.listed["text"].eqNullSafe(search.items["text"]), search.listed["answer"].eqNullSafe(search.items["answer"])]
    members = search.listed.join(search.items, same).select("k", "item_id")
    return rows.mapInArrow(tidy(run), schema).join(members, "k").select("doc_id", "item_id", *names[2:])


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that leak no item."""
    search = Search(docs, benchmark)

    def judge(batches):
        for batch, leaks in search.found(batches):
            keep = np.ones(len(batch), bool)
            keep[[row for row, *_ in leaks]] = False
            yield keep

    return filter_texts(docs, judge)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
