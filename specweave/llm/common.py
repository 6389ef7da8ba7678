"""Session plumbing shared by the training-data operators.

Intermediate tables go to the folder named by ``spark.checkpoint.dir`` as
Parquet: that cuts the lineage, survives the loss of executors (files are
committed by Spark's writer) and is visible to every machine.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sessions
from ..sessions import discard, fresh_path, shared_dir
from .bytewords import tidy

__all__ = ["bounded_batches", "discard", "filter_texts", "fresh_path", "held_out", "id_bucket", "shared_dir", "staged", "table"]


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back."""
    bounded_batches(df.sparkSession)
    return sessions.staged(df, label)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of bounded size, so that a worker's memory doesn't follow the length of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_bucket(column: str | Column, n: int = 3) -> Column:
    """crc32 of the id as text, modulo ``n``; null ids count as the text ''."""
    col = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


def held_out(column: str | Column = "doc_id") -> Column:
    """Rows that no classifier may learn from."""
    return id_bucket(column) == 1


def filter_texts(docs: DataFrame, judge: Callable[[Iterator[pa.RecordBatch]], Iterator]) -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, that ``judge`` keeps.

    ``judge`` runs in tasks: it gets batches with the one column ``text`` and yields a truth value for each row of each.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index("text")]

    def run(batches):
        waiting: deque = deque()

        def texts():
            for batch in batches:
                waiting.append(batch)
                yield pa.RecordBatch.from_arrays([batch.column(text).cast(pa.string())], ["text"])

        for keep in judge(texts()):
            yield waiting.popleft().filter(pa.array(keep, pa.bool_()))

    plain = docs.toDF(*names)
    return plain.mapInArrow(tidy(run), plain.schema).toDF(*docs.columns)
