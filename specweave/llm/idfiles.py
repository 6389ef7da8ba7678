"""Files of token ids in Simple-8b, written in document order and read back.

A file: magic, a table that gives frequent ids small codes (from the first
part of the file, so it costs one look), sections of coded ids, an index
(documents with their lengths; sections with their byte offsets and block
offsets) and the index's place.  Writers range-partition by doc_id, so files
follow each other in ascending order; totals of files, not of documents, give
the driver each file's first position.  Files of failed attempts are in no
manifest and are never read.

Defined cases: null text is empty and gives the end id alone; null doc_ids come
first; rows repeated with one doc_id are ordered by their text's hash; an empty
table gives no files and no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import simple8b
from .bytewords import tidy
from .common import fresh_path, staged, table
from .tokens import Encoder, default_path

MAGIC = b"SWIDS001"
SECTION = 1 << 19
END_ID = 1
SLICE = 200


class IdFileWriter:
    """Appends documents' ids to one file."""

    def __init__(self, stream):
        self.out, self.at = stream, 0
        self.code: np.ndarray | None = None
        self.parts: list[bytes] = []
        self.waiting = 0
        self.n_ids = 0
        self.docs: list[int] = []
        self.nulls: list[int] = []
        self.lengths: list[int] = []
        self.sections: list[tuple[int, int, int]] = []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if doc_id is None:
            self.nulls.append(len(self.docs))
        self.docs.append(doc_id or 0)
        self.lengths.append(len(ids) // 4)
        self.parts.append(ids)
        self.waiting += len(ids) // 4
        if self.waiting >= SECTION:
            self._flush()

    def _flush(self) -> None:
        ids = np.frombuffer(b"".join(self.parts), "<u4")
        if self.code is None:
            top = int(ids.max()) + 1 if len(ids) else 1
            names = np.argsort(-np.bincount(ids, minlength=top), kind="stable").astype("<u4")
            self.code = np.empty(top, np.uint32)
            self.code[names] = np.arange(top, dtype=np.uint32)
            self._put(MAGIC + struct.pack("<I", top) + names.tobytes())
        known = ids < len(self.code)
        codes = np.where(known, self.code[np.where(known, ids, 0)], ids)
        words, offsets = simple8b.encode(codes)
        place = self.at
        self._put(struct.pack("<II", len(words), len(offsets)) + offsets.astype("<u4").tobytes() + words.astype("<u8").tobytes())
        self.sections.append((place, len(ids), len(words)))
        self.n_ids += len(ids)
        self.parts, self.waiting = [], 0

    def close(self) -> None:
        if self.waiting or self.code is None:
            self._flush()
        place = self.at
        self._put(np.array(self.docs, "<i8").tobytes() + np.array(self.lengths, "<i8").tobytes())
        tail = json.dumps({"docs": len(self.docs), "nulls": self.nulls, "sections": self.sections, "index": place}).encode()
        self._put(tail + struct.pack("<I", len(tail)) + MAGIC)
        self.out.close()


class IdFileReader:
    """Documents of one file, in order; ids come section by section."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - 12)
        n, magic = struct.unpack("<I8s", source.read(12))
        if magic != MAGIC:
            raise ValueError("not a file of ids")
        source.seek(size - 12 - n)
        tail = json.loads(source.read(n))
        self.sections = tail["sections"]
        source.seek(tail["index"])
        both = np.frombuffer(source.read(16 * tail["docs"]), "<i8")
        self.doc_ids, self.lengths = both[: tail["docs"]], both[tail["docs"] :]
        self.nulls = set(tail["nulls"])
        source.seek(len(MAGIC))
        (top,) = struct.unpack("<I", source.read(4))
        self.names = np.frombuffer(source.read(4 * top), "<u4")

    def section(self, k: int) -> np.ndarray:
        """Ids of section ``k`` alone."""
        place, n, _ = self.sections[k]
        self.source.seek(place)
        n_words, n_offsets = struct.unpack("<II", self.source.read(8))
        self.source.read(4 * n_offsets)
        codes = simple8b.decode(np.frombuffer(self.source.read(8 * n_words), "<u8"))
        if len(codes) != n:
            raise ValueError("a section holds another number of ids than its index says")
        return np.where(codes < len(self.names), self.names[np.minimum(codes, len(self.names) - 1).astype(np.int64)], codes).astype("<u4")

    def block(self, k: int, b: int) -> np.ndarray:
        """Ids of block ``b`` of section ``k``, found by its offset."""
        place, _, _ = self.sections[k]
        self.source.seek(place)
        n_words, n_offsets = struct.unpack("<II", self.source.read(8))
        offsets = np.frombuffer(self.source.read(4 * n_offsets), "<u4")
        self.source.seek(place + 8 + 4 * n_offsets + 8 * int(offsets[b]))
        codes = simple8b.decode(np.frombuffer(self.source.read(8 * int(offsets[b + 1] - offsets[b])), "<u8"))
        return np.where(codes < len(self.names), self.names[np.minimum(codes, len(self.names) - 1).astype(np.int64)], codes).astype("<u4")

    def documents(self) -> Iterator[tuple[int | None, int, Iterator[bytes]]]:
        """(doc_id, length, pieces of its ids as bytes); read each document's pieces before the next."""
        k, have, at = 0, np.zeros(0, "<u4"), 0
        for i, (doc_id, length) in enumerate(zip(self.doc_ids.tolist(), self.lengths.tolist())):

            def pieces(left=length):
                nonlocal k, have, at
                while left:
                    if at == len(have):
                        have, at, k = self.section(k), 0, k + 1
                    part = have[at : at + left]
                    at += len(part)
                    left -= len(part)
                    yield part.tobytes()

            yield None if i in self.nulls else doc_id, length, pieces()


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Writes the ids of ``docs`` (doc_id, text); gives the manifest (part, path, docs, ids) in file order."""
    spark = docs.sparkSession
    end = struct.pack("<I", end_id)

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        coder = Encoder.of(tokenizer)
        path, writer = f"{root}/{uuid.uuid4().hex}.ids", None
        for batch in batches:
            for lo in range(0, len(batch), SLICE):
                part = batch.slice(lo, SLICE)
                if writer is None:
                    writer = IdFileWriter(fs.open_output_stream(path, compression=None))
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), coder.batch(part.column("text").to_pylist())):
                    writer.add(doc_id, ids + end)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([x]) for x in (TaskContext.get().partitionId(), path, len(writer.docs), writer.n_ids)], ["part", "path", "docs", "ids"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    return staged(ranged.mapInArrow(tidy(run, keep=True), "part long, path string, docs long, ids long"), "id-manifest")


def read_ids(spark: SparkSession, manifest: DataFrame, folder: str, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32 and, if asked for, ids) of all documents in the files."""
    files, start = [], 0
    for r in manifest.orderBy("part").collect():  # one row a file
        files.append((r["path"], start))
        start += r["ids"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if ids else "")

    def run(batches):
        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                with fs.open_input_file(path) as source:
                    rows: list[tuple] = []
                    kept = 0
                    for doc_id, length, pieces in IdFileReader(source).documents():
                        crc, own = 0, []
                        for p in pieces:
                            crc = zlib.crc32(p, crc)
                            if ids:
                                own.append(p)
                        rows.append((doc_id, first, length, crc, *([np.frombuffer(b"".join(own), "<u4").astype(np.int64)] if ids else [])))
                        first += length
                        kept += length if ids else 8
                        if kept > 1 << 19:
                            yield _rows(rows, ids)
                            rows, kept = [], 0
                    if rows:
                        yield _rows(rows, ids)

    todo = spark.createDataFrame(files, "path string, start long").repartition(max(1, len(files)))
    return todo.mapInArrow(tidy(run), schema)


def _rows(rows: list[tuple], ids: bool) -> pa.RecordBatch:
    cols = list(zip(*rows))
    arrays = [pa.array(c, pa.int64()) for c in cols[:4]]
    if ids:
        arrays.append(pa.array(list(cols[4]), pa.list_(pa.int64())))
    return pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(arrays)])


def op9_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "ids")
    manifest = write_ids(table(spark, sf_dir, "documents"), folder, default_path("word_bpe_49k.json"))
    return read_ids(spark, manifest, folder, ids=False)
