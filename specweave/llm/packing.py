"""Packing by power-of-two decomposition.

A document of n ids is cut into as many pieces of the longest sequence length
as fit and then one piece for each bit of the rest, long ones first.  Every
piece is a sequence of its own whose length is a power of two, so nothing is
padded, no sequence crosses documents, and equal lengths form the buckets that
training batches are drawn from.  No rows move between tasks.

Defined cases: null text is empty and gives one piece of the end id; rows
repeated with one doc_id are packed one by one; a null doc_id stays null; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytewords import tidy
from .common import table
from .tokens import KEPT, Encoder, default_path

LONGEST = 2048
END_ID = 1
SLICE = 200


def piece_lengths(n: int, longest: int = LONGEST) -> list[int]:
    """Binary pieces of ``n``: full sequences, then the powers of two in the rest."""
    whole, rest = divmod(n, longest)
    return [longest] * whole + [1 << k for k in range(longest.bit_length() - 2, -1, -1) if rest >> k & 1]


def pack(docs: DataFrame, tokenizer: str, longest: int = LONGEST, end_id: int = END_ID, ids: bool = True, kept: int = KEPT) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids) for each piece.

    The length is the bucket.  ``sequence_id`` is the task's number and a count within it.
    """
    if longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")
    end = struct.pack("<I", end_id)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        coder = Encoder.of(tokenizer, kept)
        sequence = TaskContext.get().partitionId() << 33
        for batch in batches:
            for lo in range(0, len(batch), SLICE):
                part = batch.slice(lo, SLICE)
                rows, own = [], []
                for doc_id, body in zip(part.column("doc_id").to_pylist(), coder.batch(part.column("text").to_pylist())):
                    body += end
                    n, start = len(body) // 4, 0
                    for length in piece_lengths(n, longest):
                        piece = body[4 * start : 4 * (start + length)]
                        rows.append((doc_id, start, length, zlib.crc32(piece), n, sequence, 0))
                        if ids:
                            own.append(np.frombuffer(piece, "<u4").astype(np.int32))
                        start += length
                        sequence += 1
                arrays = [pa.array(c, pa.int64()) for c in zip(*rows)]
                yield pa.RecordBatch.from_arrays(arrays + ([pa.array(own, pa.list_(pa.int32()))] if ids else []), names + ["ids"] * ids)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(run, keep=True), ", ".join(f"{c} long" for c in names) + (", ids array<int>" if ids else ""))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Sequences (with ids) in one Parquet folder for each length; batches drawn from a folder need no padding."""
    pieces.write.partitionBy("length").parquet(path)


def batches(spark: SparkSession, path: str, size: int) -> Iterator[list[list[int]]]:
    """Batches of ``size`` sequences of one length, bucket by bucket; the last of a bucket may be smaller.

    Rows stream to the caller, a partition at a time.
    """
    buckets = spark.read.parquet(path)
    for (length,) in sorted(buckets.select("length").distinct().collect()):  # a power of two each
        batch = []
        for r in buckets.where(F.col("length") == length).select("ids").toLocalIterator():
            batch.append(r["ids"])
            if len(batch) == size:
                yield batch
                batch = []
        if batch:
            yield batch


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_path("byte_bpe_50k.json"), ids=False)
