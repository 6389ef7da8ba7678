"""Near-duplicate documents by circulant MinHash.

Two permutations make all coordinates of a signature: the first scatters the
shingles over 32-bit positions, the second is applied after a circular shift
by 1, 2, ... K positions (Li and Li, "C-MinHash").  Bands of coordinates give
candidate pairs; a pair is linked only by exact Jaccard on full shingle sets.

Equal sets are folded into one class first, so copies cost nothing later.  In
a bucket all classes are compared with the one that meets the most others in all
buckets (a star, not all pairs): it stands near the middle of its group and links most of it.
Where that leaves a bucket in several components, its classes go through an
exact prefix and positional join that finds every link between different
components; links inside a component can't change the result.

Defined cases: a null or blank text has no shingles and no links; a text of
fewer than ``k`` words has one shingle, the whole sequence; rows repeated with
one doc_id are judged by their own texts; a null doc_id is never the least of
a component unless it has no other; an empty table gives no rows; extra columns are
ignored, and kept by ``keep_one``, whatever their names.  Sets are compared by
64-bit hashes of their shingles, so a link is exact but for clashes of hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .bytewords import NOT_SPACE, chunks, mix64, shingle_set, text_bytes, tidy, words_of
from .common import discard, staged
from .components import connected_components

COORDINATES = 256
#: Largest chance that a pair at the threshold shares no band.
MISS = 5e-5
#: Tasks that the partners of one class are dealt to, and partners of one task at most, about.
BLOCKS, PARTNERS = 16, 20_000


def banding(threshold: float, coordinates: int = COORDINATES, miss: float = MISS) -> tuple[int, int]:
    """(bands, rows): the most rows a band that still keep the miss rate at the threshold."""
    rows = max((r for r in range(1, 17) if (1 - threshold**r) ** (coordinates // r) <= miss), default=1)
    return coordinates // rows, rows


def _second(x: np.ndarray) -> np.ndarray:
    """The second permutation of 32-bit positions (in place)."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def signature(shingles: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """Minima of the second permutation over the scattered shingles, shifted once for each coordinate."""
    first = (mix64(shingles ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)
    out = np.empty(coordinates, np.uint32)
    step = max(1, min(coordinates, (1 << 15) // max(1, len(first))))
    for k in range(0, coordinates, step):
        shift = np.arange(k + 1, min(k + step, coordinates) + 1, dtype=np.uint32)
        out[k : k + step] = _second(first[None, :] + shift[:, None]).min(axis=1)
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = sig[: bands * rows].astype(np.uint64).reshape(bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for j in range(rows):
        key = mix64(key ^ mix64(parts[:, j] + np.uint64(j + 1)))
    return key.view(np.int64)


def class_id(shingles: np.ndarray) -> bytes:
    """128-bit name of a set: two mixed sums over its elements."""
    a = mix64(shingles + np.uint64(0x1234567)).sum(dtype=np.uint64)
    b = mix64(shingles ^ np.uint64(0xABCDEF0123456789)).sum(dtype=np.uint64)
    return int(a).to_bytes(8, "big") + int(b).to_bytes(8, "big")


def _sets(batch: pa.RecordBatch, k: int):
    body, offsets = text_bytes(batch.column("text"))
    for lo, hi in chunks(offsets):
        words = words_of(body, offsets, lo, hi, NOT_SPACE)
        for i in range(hi - lo):
            yield shingle_set(words.hash[words.at[i] : words.at[i + 1]], k)


def signatures(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, h, n_shingles, cls, keys) for each row; h is the text's hash, cls and keys are null without words."""

    def run(batches):
        for batch in batches:
            n, cls, keys = [], [], []
            memo: dict[bytes, np.ndarray] = {}
            for s in _sets(batch, k):
                n.append(len(s))
                if not len(s):
                    cls.append(None)
                    keys.append(None)
                    continue
                c = class_id(s)
                if c not in memo:
                    memo[c] = band_keys(signature(s, bands * rows), bands, rows)
                cls.append(c)
                keys.append(memo[c])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("h"), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "h", "n_shingles", "cls", "keys"],
            )

    return docs.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(tidy(run), "doc_id long, h long, n_shingles long, cls binary, keys array<long>")


def shingle_table(docs: DataFrame, k: int) -> DataFrame:
    """(cls, shingles) for each text with words: the full set as little-endian 64-bit words."""

    def run(batches):
        for batch in batches:
            sets = [s for s in _sets(batch, k) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([class_id(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["cls", "shingles"])

    return docs.select("text").mapInArrow(tidy(run), "cls binary, shingles binary")


#: Counters of the sketch that puts rare shingles first; any counts give right results.
SKETCH = 1 << 20


def _rarity(sets: DataFrame) -> np.ndarray:
    """Counts of shingles, folded to ``SKETCH`` counters whatever the input."""

    def count(batches):
        total = np.zeros(SKETCH, np.int64)
        for batch in batches:
            for s in batch.column("shingles"):
                np.add.at(total, (np.frombuffer(s.as_buffer(), np.uint64) % np.uint64(SKETCH)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        for lo in range(0, len(at), 1 << 16):
            part = at[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(total[part], pa.int64())], ["slot", "n"])

    got = sets.select("shingles").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SKETCH, np.int64)
    out[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    return out


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(c, root, n, pos, shingle): the rarest shingles of (c, root, n, shingles), as many as a link must touch."""
    rarity = sets.sparkSession.sparkContext.broadcast(_rarity(sets))

    def run(batches):
        count = rarity.value
        for batch in batches:
            cols: list[list[np.ndarray]] = [[], [], [], [], []]
            for c, root, s in zip(batch.column("c").to_pylist(), batch.column("root").to_pylist(), batch.column("shingles")):
                s = np.frombuffer(s.as_buffer(), np.uint64)
                n = len(s)
                most = n - -(-n * percent // 100) + 1
                first = s[np.lexsort((s, count[(s % np.uint64(SKETCH)).astype(np.int64)]))[:most]]
                for col, values in zip(cols, (np.full(len(first), c), np.full(len(first), root), np.full(len(first), n), np.arange(len(first)), first.view(np.int64))):
                    col.append(values)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in cols], ["c", "root", "n", "pos", "shingle"])

    out = staged(sets.select("c", "root", "shingles").mapInArrow(tidy(run), "c long, root long, n long, pos long, shingle long"), "prefixes")
    rarity.destroy()
    return out


def overlap_table(pairs: DataFrame) -> DataFrame:
    """(a, b, inter, total) of (a, b, sa, sb): exact sizes of intersection and union."""

    def run(batches):
        for batch in batches:
            inter, total = [], []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = len(y) - 1
                both = int((y[at] == x).sum())
                inter.append(both)
                total.append(len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(inter, pa.int64()), pa.array(total, pa.int64())], ["a", "b", "inter", "total"])

    return pairs.select("a", "b", "sa", "sb").mapInArrow(tidy(run), "a long, b long, inter long, total long")


def _linked(percent: int) -> Column:
    return F.col("inter") * 100 >= F.col("total") * percent


class NearDuplicates:
    """Links and components of ``docs`` (doc_id, text) at Jaccard >= ``percent`` / 100.

    ``k``: words a shingle.  ``rows``: (doc_id, n_shingles, cls) for each row;
    ``classes``: (c, cls, rep, n) for each distinct set; ``links``: pairs (a, b)
    of class numbers c.
    """

    def __init__(self, docs: DataFrame, k: int = 5, percent: int = 80):
        self.k, self.percent = k, percent
        bands, rows = banding(percent / 100)
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.rows = staged(signatures(self.docs, k, bands, rows), "signatures")
        own = self.rows.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"))
        # the number is written with the row, so it stays the same whoever reads it
        self.classes = staged(own.withColumn("c", F.monotonically_increasing_id()), "classes")
        self.links = self._all_links()

    def _all_links(self) -> DataFrame:
        members = self.classes.select("c", F.explode("keys").alias("key"))
        sizes = members.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
        met = staged(members.join(sizes, "key"), "buckets")
        # the class that meets the most others stands nearest to the middle of its group and links most of it
        weighed = met.join(met.groupBy("c").agg(F.sum("m").alias("met")), "c")
        pivots = weighed.groupBy("key").agg(F.max(F.struct("met", "c"))["c"].alias("pivot"))
        shared = staged(met.select("key", "c").join(pivots, "key"), "pivots")
        discard(met)
        star = staged(shared.where("c <> pivot").select(F.col("pivot").alias("a"), F.col("c").alias("b")).distinct(), "star")
        sets = self._sets_of(star.select(F.col("a").alias("c")).union(star.select("b")).distinct())
        links = staged(self._verified(star, sets), "links")
        # classes of one bucket that the star left in different components
        roots = connected_components(links).select(F.col("node").alias("c"), "root")
        left = shared.select("key", "c").join(roots, "c", "left").withColumn("root", F.coalesce("root", "c"))
        left = staged(left.join(self.classes.select("c", "n"), "c"), "members")
        several = left.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("key")
        open_ = left.join(several, "key").select("c", "n", "root").distinct()
        pairs, used = self._across(open_, sets)
        pairs = staged(pairs.join(star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), "pairs")
        out = staged(links.unionByName(self._verified(pairs, sets)), "links")
        discard(shared, star, sets, links, left, pairs, *used)
        return out

    def _across(self, open_: DataFrame, sets: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
        """Pairs (a, b) of open classes in different components that may be linked, and the tables that they come from.

        Exact prefix, length and positional filters: with each set in one global order,
        rare shingles first, the first shingle that two linked sets share stands so early
        in both that what follows can still make up the intersection they need.
        """
        own = staged(open_.join(sets, "c"), "open")
        front = prefixes(own, self.percent)
        # in each shingle's list the largest component needs no comparison with itself
        main = front.groupBy("shingle", "root").agg(F.count("*").alias("m")).groupBy("shingle").agg(F.count("*").alias("roots"), F.max_by("root", "m").alias("main"))
        rows = front.join(main.where("roots > 1").select("shingle", "main"), "shingle")
        x, y = rows.where("root <> main").alias("x"), rows.alias("y")
        fits = f"least(x.n - x.pos, y.n - y.pos) * {100 + self.percent} >= {self.percent} * (x.n + y.n)"
        met = x.join(y, F.expr(f"x.shingle = y.shingle and x.root <> y.root and {fits}"))
        return met.select(F.least("x.c", "y.c").alias("a"), F.greatest("x.c", "y.c").alias("b")).distinct(), [own, front]

    def _sets_of(self, wanted: DataFrame) -> DataFrame:
        """(c, shingles) of the classes in ``wanted``, made anew from the texts of their least documents."""
        reps = staged(wanted.join(self.classes.select("c", "cls", "rep"), "c").select("c", "cls", F.xxhash64("rep").alias("h")), "reps")
        n = bloom.blocks_for(reps.count())
        near = bloom.probe(self.docs.withColumn("h", F.xxhash64("doc_id")), "h", bloom.build(reps, "h", n), n).where("maybe")
        # rows repeated with one doc_id may differ: the set itself tells its class
        texts = near.select("h", "text").join(reps.select("h"), "h", "left_semi").groupBy("h", "text").agg(F.count("*")).select("text")
        found = shingle_table(texts, self.k).join(reps.select("c", "cls"), "cls").select("c", "shingles")
        out = staged(found, "sets")
        discard(reps)
        return out

    def _verified(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The linked ones of ``pairs`` (a, b), a staged table.

        The partners of a class are dealt to ``BLOCKS`` tasks, or as many more as leave it
        ``PARTNERS`` a task if all pairs were its own.
        """
        blocks = max(BLOCKS, -(-pairs.count() // PARTNERS))
        dealt = pairs.withColumn("block", F.pmod(F.xxhash64("b"), F.lit(blocks)).cast("int"))
        firsts = dealt.select("a", "block").distinct().join(sets.select(F.col("c").alias("a"), F.col("shingles").alias("sa")), "a")
        with_b = dealt.join(sets.select(F.col("c").alias("b"), F.col("shingles").alias("sb")), "b")
        return overlap_table(with_b.join(firsts, ["a", "block"])).where(_linked(self.percent)).select("a", "b").distinct()

    def named_classes(self) -> DataFrame:
        """(cls, component_id, root) of all classes; root numbers the component."""
        roots = connected_components(self.links).select(F.col("node").alias("c"), "root")
        of = self.classes.select("c", "cls", "rep").join(roots, "c", "left").withColumn("root", F.coalesce("root", "c"))
        least = of.groupBy("root").agg(F.min("rep").alias("component_id"))
        return of.join(least, "root").select("cls", "component_id", "root")

    def members(self) -> DataFrame:
        """(doc_id, h, n_shingles, cls, component_id, root, kept) for each row of the input."""
        own = F.coalesce("component_id", "doc_id")
        out = self.rows.join(self.named_classes(), "cls", "left")
        return out.select("doc_id", "h", "n_shingles", "cls", own.alias("component_id"), "root", own.eqNullSafe(F.col("doc_id")).alias("kept"))

    def components(self) -> DataFrame:
        """(doc_id, n_shingles, component_id, kept) for each row of the input."""
        return self.members().select("doc_id", "n_shingles", "component_id", "kept")


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs``, all columns, with one document of each component: that with the least doc_id, of
    several such rows one whose text's hash is least.

    Only rows that a bounded Bloom filter can't clear are shuffled.  Rows travel as one
    struct, so their columns may have any names.
    """
    near = NearDuplicates(docs, k, percent)
    rows = near.members().where("cls is not null")
    each = staged(rows.groupBy("doc_id", "h", "root").agg(F.max("kept").alias("kept"), F.count("*").alias("n")), "documents")
    discard(near.rows, near.classes, near.links)
    kept = each.where("kept")
    first = kept.groupBy("root").agg(F.min(F.struct("doc_id", "h")).alias("first"))
    kept = kept.join(first, "root").withColumn("stays", F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.h") == F.col("h"))).drop("first")
    marks = kept.unionByName(each.where("not kept").withColumn("stays", F.lit(False))).where("not stays or n > 1")
    marks = marks.groupBy("doc_id", "h").agg(F.max("stays").alias("stays"))
    marks = staged(marks.select("doc_id", "h", "stays", F.xxhash64("doc_id", "h").alias("key")), "marks")
    discard(each)
    n = bloom.blocks_for(marks.count())
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    own = docs.select(row, F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("h"))
    tried = bloom.probe(own.withColumn("key", F.xxhash64("doc_id", "h")), "key", bloom.build(marks, "key", n), n)
    named = marks.select("key", F.col("doc_id").alias("d"), F.col("h").alias("g"), "stays")
    same = F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("g") == F.col("h"))
    rest = tried.where("maybe").join(named, "key", "left").withColumn("stays", F.when(same, F.col("stays")))
    once = rest.where("stays").dropDuplicates(["key", "h"])
    return tried.where("not maybe").select("row").union(rest.where("stays is null").select("row")).union(once.select("row")).select("row.*")


def op6_minhash(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return NearDuplicates(table(spark, sf_dir, "documents"), k=3, percent=85).components()
