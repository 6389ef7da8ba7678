"""Files to trace tables: one tagged table from the parsers, split by kind."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.analysis import PHASES, Trace, tag_filter
from ..sessions import staged
from ..sources.grammars import SPEC_EXTENSIONS
from ..sources.tree import absolute, collect_files, decode, extension, relative
from .code_scan import parse_code
from .markdown_scan import parse_markdown

SCHEMA = "file_seq long, file string, nth long, kind string, item long, ord long, id string, ref string, origin string, title string, line int, character int, message string, tags array<string>, description array<string>"
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]


def parse(file: str, text: str) -> list[dict]:
    """Rows of one file by its role."""
    ext = extension(file)
    return parse_markdown(file, text) if ext in SPEC_EXTENSIONS else parse_code(file, ext, text)


class ReadError(Exception):
    """A file that can't be read."""


def _texts(batch: pa.RecordBatch):
    """(file_seq, path, file, text, what went wrong) of each file of a batch, read where its text is null."""
    for seq, path, file, text in zip(*(batch.column(c).to_pylist() for c in ("file_seq", "path", "file", "text"))):
        wrong = None
        if text is None:
            try:
                with open(path, "rb") as f:
                    text = decode(f.read())
            except OSError as e:
                text, wrong = "", f"cannot read {path}: {e.strerror} (os error {e.errno})"
        yield seq, path, file, text, wrong


def parsed(files: DataFrame) -> DataFrame:
    """Tagged rows of ``files`` (file_seq, path, file, and text or null to read the path); files that can't be read give a row of kind error."""

    def run(batches):
        for batch in batches:
            rows = []
            for seq, path, file, text, wrong in _texts(batch):
                found = [{"kind": "error", "message": wrong}] if wrong else parse(path, text)
                rows += [r | {"file_seq": seq, "file": file, "nth": n} for n, r in enumerate(found)]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], t) for c, t in zip(_NAMES, _TYPES)], _NAMES)

    return files.select("file_seq", "path", "file", "text").mapInArrow(run, SCHEMA)


_ARROW = {"string": pa.string(), "int": pa.int32()}


def with_text(files: DataFrame, look, schema: str) -> DataFrame:
    """(file_seq, file and ``schema``): what ``look(path, text)`` finds in each file; columns of strings and ints."""
    columns = [c.split() for c in schema.split(", ")]
    types = [pa.int64(), pa.string(), *(_ARROW[t] for _, t in columns)]
    names = ["file_seq", "file", *(c for c, _ in columns)]

    def run(batches):
        for batch in batches:
            rows = []
            for seq, path, file, text, wrong in _texts(batch):
                if wrong:
                    raise ReadError(wrong)
                rows += [(seq, file, *r) for r in look(path, text)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return files.select("file_seq", "path", "file", "text").mapInArrow(run, f"file_seq long, file string, {schema}")


def files_frame(spark: SparkSession, paths: list[str], cwd: str | None = None) -> DataFrame:
    """(file_seq, path, file, text null) of all files below ``paths``; executors read them."""
    cwd = absolute(".", cwd)
    rows = [(i, p, relative(p, cwd), None) for i, p in enumerate(collect_files(paths, cwd))]
    out = spark.createDataFrame(rows, "file_seq long, path string, file string, text string")
    return out.repartition(max(1, min(len(rows), spark.sparkContext.defaultParallelism)))


def trace_of(files: DataFrame, tags: list[str] | None = None) -> Trace:
    """The trace of ``files``; tags filter items before the analysis."""
    rows = staged(parsed(files), "parsed")
    wrong = rows.where("kind = 'error'").agg(F.min(F.struct("file_seq", "message"))["message"]).first()[0]
    if wrong:
        raise ReadError(wrong)
    found = rows.where("kind = 'item'")
    # the file and the rank within it give the global order without one big sort
    own = found.withColumn("r", F.row_number().over(Window.partitionBy("file_seq").orderBy("line", "character")))
    seq = (F.col("file_seq") * (1 << 32) + F.col("r")).alias("item_seq")
    items = tag_filter(own.select(seq, "file_seq", "item", "id", "origin", "file", "line", "character", "title", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.coalesce("description", F.array().cast("array<string>")).alias("description")), tags)
    items = staged(items, "items")
    key = items.select("file_seq", "item", "item_seq")
    child = lambda kind: rows.where(F.col("kind") == kind).drop("id").join(key, ["file_seq", "item"])
    edges = lambda kind: child(kind).select("item_seq", "ord", "ref")
    led = rows.where("kind = 'forward'").withColumn("r", F.row_number().over(Window.partitionBy("file_seq").orderBy("line", "character")))
    forwards = led.select((F.col("file_seq") * (1 << 32) + F.col("r")).alias("fwd_seq"), F.col("id").alias("from"), F.col("ref").alias("to"), "file", "line", "character")
    loc = F.struct("file", "line", "character")
    defects = child("defect").select("item_seq", F.lit(PHASES["invalid-reference"]).alias("phase"), "ord", F.lit("invalid-reference").alias("kind"), "ref", "message", loc.alias("location"), F.lit(None).cast("array<string>").alias("existing_revisions"))
    problems = rows.where("kind = 'problem'").select("file_seq", "nth", "message", loc.alias("location"))
    return Trace(items, edges("need"), edges("cover"), forwards, defects, problems)
