"""A corpus from raw documents to training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the columns of the
documents they were given. ``run`` writes each stage as Parquet and reads it back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailpack.llm.common import stored, with_package
from trailpack.llm.decontamination import without_contained
from trailpack.llm.line_dedup import dedup_lines
from trailpack.llm.near_copies import without_near_copies
from trailpack.llm.packing import pack
from trailpack.llm.simhash import one_of_each
from trailpack.llm.toxicity import without_toxic
from trailpack.plans.testbed import table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples call toxic go."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that five or more documents have stay in one; n_chars, where present, follows the text."""
    kept = dedup_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast(kept.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: by SimHash, then by word fingerprints and exact shingles.

    Rows with a null doc_id stay. An empty table stays empty.
    """
    return without_near_copies(one_of_each(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain an item of the benchmark go."""
    return without_contained(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents in sequences of 1024 tokens."""
    return pack(docs)


STAGES = [
    (stage.__name__, with_package(stage)) for stage in (toxicity, line_dedup, near_dedup, decontamination, packing)
]

#: SQL can express neither the toxicity scores nor the tokenizer; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
