"""Helpers that several of the operators share: intermediate tables and connected components."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z only; other letters stay. ``lower`` does the same where there are no others, and faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def with_package(query: Callable) -> Callable:
    """``query``, with this package on the path of the Python workers of its session (its first argument).

    Their functions are found by name. A session that was started elsewhere would look in its own folder only; on a cluster,
    ``--py-files`` brings the package and this path is of no use and no harm.
    """

    @functools.wraps(query)
    def run(spark: SparkSession, *args):
        environment = spark.sparkContext.environment
        paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
        root = str(Path(__file__).resolve().parents[2])
        if root not in paths:
            environment["PYTHONPATH"] = os.pathsep.join([root, *paths])
        return query(spark, *args)

    return run


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, removed when the driver ends.

    Where the setting is missing, a local session gets a temporary folder; a cluster must set it, since its
    executors share no local disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="trailpack-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def stored(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read from there: later steps neither repeat nor lose them."""
    path = scratch_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, component) for an undirected graph of ``edges`` (a, b); component is the least node of it.

    Every round lowers each label to the least of its neighbours' labels, then lets it jump to the label of
    its label; long chains shrink by halves. Nothing but the number of moved labels reaches the driver. Joins
    shuffle both sides, so that Spark splits a hub's rows over tasks.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(both.where("a <> b").distinct())
    label = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label")))
    for _ in range(most_rounds):
        near = (
            both.join(label.select(F.col("node").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("least"))
        )
        lowered = stored(label.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "least").alias("label")))
        jump = lowered.select(F.col("node").alias("label"), F.col("label").alias("further"))
        after = stored(lowered.join(jump, "label").select("node", F.col("further").alias("label"), (F.col("further") < F.col("old")).alias("moved")))
        label = after.select("node", "label")
        if after.where("moved").limit(1).count() == 0:
            return label.withColumnRenamed("label", "component")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
