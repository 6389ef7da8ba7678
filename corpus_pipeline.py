"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

1. quality: documents that the discriminant rejects go (score under 0.5).
2. language: documents in no learned language go: no text, no letter, or too little
   evidence for any language (``langid``).
3. near_dedup: one document of each near-duplicate component stays (shingles of
   five words, Jaccard 0.8 or more).
4. decontaminate: documents that hold a benchmark item go.
5. packing: the rest becomes sequences, one row each.

Stages 1 to 4 return the columns they got.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from specweave.llm import decontaminate, langid, minhash, packing, quality
from specweave.llm.common import staged, table
from specweave.llm.tokens import default_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs, k=5, percent=80)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # workers that also ran the other stages keep a smaller table of known pieces
    return packing.pack(docs, default_path("byte_bpe_50k.json"), ids=False, kept=50_000)


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("packing", packing_stage),
]

#: No SQL says what the classifiers decide; tests/llm holds every stage and run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
