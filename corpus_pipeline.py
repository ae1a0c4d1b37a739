"""A corpus pipeline: language ID, quality, near duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; run() writes
each result as Parquet to the shared folder and reads it again as the next one's
docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from lorekeep.llm import decontam, jaccard, langid, packing, quality
from lorekeep.llm.queries import byte_bpe
from lorekeep.llm.session import bounded_batches
from lorekeep.sources.shared import stored

#: Bytes of an Arrow batch in the pipeline: stage after stage runs in the same executors, which keep the memory that one
#: has taken, and a batch is held several times over in the JVM and in Python.
BATCH_BYTES = 2 << 20

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def small_batches(stage: Stage) -> Stage:
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bounded_batches(spark, BATCH_BYTES)
        return stage(spark, docs, sf_dir)

    return run


@small_batches
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told: no letter, or a score under 0.5."""
    return langid.keep(docs, langid.train(docs))


@small_batches
def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose quality score is under 0.5."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep(docs, quality.train(docs, labels))


@small_batches
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row, of the smallest doc_id, of each group linked by five-word shingles at Jaccard 0.8."""
    return jaccard.keep_one(docs, jaccard.Rule(words=5, percent=80), with_null_ids=True)


@small_batches
def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that a ten-word benchmark window occurs in."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@small_batches
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every document in a length bucket and a batch."""
    return packing.pack(docs, byte_bpe())


STAGES = [
    ("language_id", language),
    ("quality", good),
    ("near_duplicates", near_duplicates),
    ("decontamination", uncontaminated),
    ("packing", packed),
]

#: Models are fitted on the way, which SQL can't express; the operators of the stages are tested in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
