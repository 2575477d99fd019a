"""Parquet runs and rejected records.

A published run is a folder of its own below ``<out>/_runs``; the small file ``<out>/_CURRENT`` names the one that counts. A new run is
moved there whole and then named, by one atomic replacement, so whoever reads finds the old run or the new one, whatever fails in
between. The run before it stays for those who have begun to read it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..schemas import training_output_schema

# Names that Spark's readers pass over.
RUNS, POINTER = "_runs", "_CURRENT"


def write_parquet(
    df: DataFrame,
    out_path: str,
    *,
    mode: str = "overwrite",
    partition_by: list[str] | None = None,
    rebalance: bool = False,
    compression: str = "zstd",
) -> None:
    """Write Parquet, partitioned by ``partition_by``.

    ``rebalance`` shuffles on those columns first, so that a task holds few of their values and
    writes few files; AQE splits a large value over many tasks and merges small ones.
    """
    keys = partition_by or []
    if rebalance and keys:
        df = df.hint("rebalance", *keys)
    df.write.mode(mode).option("compression", compression).partitionBy(*keys).parquet(out_path)


def current_run(spark: SparkSession, out_dir: str) -> str | None:
    """The number of the published run, None where nothing has been published."""
    files, at = _file_system(spark, f"{out_dir.rstrip('/')}/{POINTER}")
    if not files.exists(at):
        return None
    opened = files.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(opened, "UTF-8").strip()
    finally:
        opened.close()


def run_path(out_dir: str, run: str) -> str:
    return f"{out_dir.rstrip('/')}/{RUNS}/{run}"


def read_run(
    spark: SparkSession, path: str, schema: T.StructType = training_output_schema
) -> DataFrame:
    """A written run, or the one published there. With the schema given, an empty run reads as an empty table."""
    run = current_run(spark, path)
    return spark.read.schema(schema).parquet(run_path(path, run) if run else path)


def quarantine_path(out_dir: str, name: str, run: str) -> str:
    """Next to the runs, not inside them: a run that fails leaves its rejects, and touches no other's."""
    return f"{out_dir.rstrip('/')}_quarantine/{run}/{name}"


def write_quarantine(df: DataFrame | None, out_dir: str, name: str, run: str) -> None:
    if df is not None:
        df.write.mode("overwrite").json(quarantine_path(out_dir, name, run))


def new_run_dir(spark: SparkSession, otherwise: str | None) -> str:
    """A new folder for intermediate tables, in the shared folder of ``spark.checkpoint.dir`` if set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or otherwise
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{base.rstrip('/')}/run-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read from there, until the driver ends.

    What has been computed once is neither computed again differently nor lost with an executor. Only a local session may do
    without ``spark.checkpoint.dir``.
    """
    spark = df.sparkSession
    local = spark.sparkContext.master.split("[")[0] == "local"
    path = new_run_dir(spark, otherwise=tempfile.gettempdir() if local else None)
    files, at = _file_system(spark, path)
    files.deleteOnExit(at)
    write_parquet(df, path)
    return spark.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm_path


def remove(spark: SparkSession, path: str) -> None:
    files, at = _file_system(spark, path)
    files.delete(at, True)


def _replace_pointer(spark: SparkSession, out_dir: str, run: str) -> None:
    """One rename that puts the new pointer in the place of the old."""
    jvm = spark.sparkContext._jvm
    files, new = _file_system(spark, f"{out_dir}/{POINTER}.{run}")
    written = files.create(new, True)
    written.write(bytearray(f"{run}\n".encode()))
    written.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(context.makeQualified(new), context.makeQualified(_file_system(spark, f"{out_dir}/{POINTER}")[1]), overwrite)


def publish(spark: SparkSession, written: str, out_dir: str, run: str) -> None:
    """Make a run that was written elsewhere on the same file system the current one of ``out_dir``."""
    out_dir = out_dir.rstrip("/")
    before = current_run(spark, out_dir)
    files, source = _file_system(spark, written)
    _, target = _file_system(spark, run_path(out_dir, run))
    files.mkdirs(target.getParent())
    if not files.rename(source, target):
        raise OSError(f"could not move {written} to {target}")
    _replace_pointer(spark, out_dir, run)
    _forget(spark, out_dir, {run, before})


def _forget(spark: SparkSession, out_dir: str, kept: set[str | None]) -> None:
    """Remove all runs and rejects but those of ``kept``."""
    for folder in (f"{out_dir}/{RUNS}", f"{out_dir}_quarantine"):
        files, at = _file_system(spark, folder)
        for entry in files.listStatus(at) if files.exists(at) else ():
            if entry.getPath().getName() not in kept:
                files.delete(entry.getPath(), True)
