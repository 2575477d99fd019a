"""The batch job: load, slice, check, build, write, report. Run it with spark-submit.

    spark-submit --py-files trailpack.zip run_job.py \\
        --impressions-path ... --clicks-path ... --atc-path ... --orders-path ... --out ...
"""

from __future__ import annotations

import argparse
import sys
import uuid
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import leaks, quality
from ..operators.actions import atc_actions, click_actions, order_actions
from ..operators.histories import EARLY_LIMIT
from ..operators.impressions import normalize_impressions, slice_impressions_last_n_days
from ..schemas import (
    DEFAULT_LOOKBACK_DAYS,
    DEFAULT_MAX_ACTIONS,
    DEFAULT_TRAIN_DAYS,
    FEED_SCHEMAS,
)
from ..sinks.writers import new_run_dir, publish, quarantine_path, remove, write_parquet, write_quarantine
from ..sources.demo import demo_inputs
from ..sources.readers import BAD_FIELDS, FEED_TIMES, LAYOUTS, flag_times, good_rows, read_feed, read_flagged, rejected_rows
from .training import finish_inputs, unpadded_inputs

FEEDS = tuple(FEED_SCHEMAS)
_TYPED = {
    "impressions": normalize_impressions,
    "clicks": click_actions,
    "atc": atc_actions,
    "orders": order_actions,
}


class LeakError(RuntimeError):
    """The histories keep actions of the day itself, or others outside their window."""


class RejectError(ValueError):
    """Records were rejected in a strict run."""


@dataclass(frozen=True)
class JobConfig:
    out: str
    demo: bool = False
    paths: dict[str, str] = field(default_factory=dict)
    layout: str = "lines"
    strict: bool = False
    max_actions: int = DEFAULT_MAX_ACTIONS
    lookback_days: int = DEFAULT_LOOKBACK_DAYS
    train_days: int = DEFAULT_TRAIN_DAYS
    explode: bool = False
    fail_on_same_day_leak: bool = False
    upstream_scan: bool = False
    check_quality: bool = True
    count_duplicates: bool = False
    allow_future_actions: int = 0
    on_check_error: str = "raise"
    staging: str | None = None
    keep_staging: bool = False
    shuffle_partitions: int = 0
    demo_day: date | None = None

    def __post_init__(self):
        if self.on_check_error not in ("raise", "warn"):
            raise ValueError("on_check_error must be 'raise' or 'warn'")
        missing = [f for f in FEEDS if not self.paths.get(f)]
        if not self.demo and missing:
            raise ValueError(f"no path for: {', '.join(missing)}")


@dataclass
class JobReport:
    run: str = ""
    rows: int = 0
    records: int = 0
    first_day: date | None = None
    last_day: date | None = None
    leaks: int | None = None
    kept_outside_window: int = 0
    upstream_same_day: bool | None = None
    quality: dict[str, int | None] | None = None
    rejects: dict[str, int] = field(default_factory=dict)
    # Impressions without a day are in no train window.
    undated_impressions: int = 0
    warnings: list[str] = field(default_factory=list)


def configure(spark: SparkSession, config: JobConfig) -> None:
    """Session settings the job relies on; everything else is the cluster's."""
    conf = spark.conf
    conf.set("spark.sql.session.timeZone", "UTC")
    conf.set("spark.sql.adaptive.enabled", "true")
    # Keeps the per-task limit ahead of the first shuffle for any history length.
    conf.set(EARLY_LIMIT, str(max(int(conf.get(EARLY_LIMIT)), config.max_actions)))
    # Rows reach the packing aggregate sorted by customer: take one customer at a time, with no second
    # sort and no map of many customers' lists on the heap.
    conf.set("spark.sql.execution.useObjectHashAggregateExec", "false")
    # After the rebalance a task holds few days: one open file each, instead of sorting wide rows.
    conf.set("spark.sql.maxConcurrentOutputFileWriters", "16")
    if config.shuffle_partitions > 0:
        conf.set("spark.sql.shuffle.partitions", str(config.shuffle_partitions))


# The column by which each typed feed is pruned later.
_PRUNED_BY = {"impressions": "as_of_date", "clicks": "occurred_at", "atc": "occurred_at", "orders": "occurred_at"}


def _load_json(
    spark: SparkSession, config: JobConfig, report: JobReport, staging: str
) -> dict[str, DataFrame]:
    """Parse each JSON feed once, into typed Parquet with its rejects in a partition of their own.

    Later passes read columns of the good partition with pushed-down filters; a task's rows are sorted by
    time, so that the bounds skip row groups. The stage is a written table in shared storage, so a
    lost executor costs no second parse.
    """
    loaded = {}
    for name in FEEDS:
        flagged = read_flagged(
            spark, config.paths[name], FEED_SCHEMAS[name], layout=config.layout, times=FEED_TIMES[name]
        )
        typed = _TYPED[name](flagged, keep=("_raw", BAD_FIELDS))
        counts = Observation(f"{name}-{uuid.uuid4().hex}")
        staged = typed.withColumn("rejected", F.size(BAD_FIELDS) > 0).observe(
            counts, F.count_if("rejected").alias("rejected")
        )
        staged = staged.sortWithinPartitions("rejected", _PRUNED_BY[name])
        write_parquet(staged, f"{staging}/{name}", partition_by=["rejected"])
        back = spark.read.schema(staged.schema).parquet(f"{staging}/{name}")
        report.rejects[name] = counts.get.get("rejected", 0)
        write_quarantine(rejected_rows(back.where("rejected")), config.out, name, report.run)
        loaded[name] = back.where("NOT rejected").drop("rejected", "_raw", BAD_FIELDS)
    return loaded


def _load_parquet(spark: SparkSession, config: JobConfig, report: JobReport) -> dict[str, DataFrame]:
    """Typed feeds where they are; only days and times are checked, in one narrow pass."""
    loaded = {}
    for name, schema in FEED_SCHEMAS.items():
        feed, _ = read_feed(spark, config.paths[name], schema, layout="parquet")
        flagged = flag_times(feed, FEED_TIMES[name])
        rejected = rejected_rows(flagged)
        report.rejects[name] = rejected.count()
        write_quarantine(rejected, config.out, name, report.run)
        loaded[name] = _TYPED[name](good_rows(flagged))
    return loaded


def _load(
    spark: SparkSession, config: JobConfig, report: JobReport, staging: str
) -> dict[str, DataFrame]:
    if config.demo:
        return {n: _TYPED[n](feed) for n, feed in demo_inputs(spark, config.demo_day).items()}
    load = _load_parquet(spark, config, report) if config.layout == "parquet" else _load_json(spark, config, report, staging)
    if config.strict and any(report.rejects.values()):
        raise RejectError(f"rejected records: {report.rejects}, in {quarantine_path(config.out, '', report.run)}")
    return load


def _check(config: JobConfig, report: JobReport, actions: DataFrame, impressions: DataFrame) -> None:
    """Quality gate and upstream scan on the inputs, before anything is built."""
    try:
        if config.upstream_scan and not config.demo:
            report.upstream_same_day = leaks.has_upstream_same_day(actions, impressions)
        if config.check_quality:
            counted = quality.actions_quality_report(actions, duplicates=config.count_duplicates)
            report.quality = counted.as_dict()
            quality.assert_quality_or_fail(counted, allow_future_actions=config.allow_future_actions)
    except Exception as error:
        if config.on_check_error == "raise":
            raise
        report.warnings.append(str(error))


def _write(
    config: JobConfig, report: JobReport, impressions: DataFrame, actions: DataFrame, path: str
) -> None:
    """One pass: the rows are written and, on the way, counted and audited.

    The rebalance by day moves unpadded, unexploded rows; padding and exploding follow in the writing
    tasks.
    """
    unpadded = unpadded_inputs(
        impressions,
        actions,
        max_actions=config.max_actions,
        lookback_days=config.lookback_days,
        keep_days=True,
    )
    day, longest = F.col("as_of_date"), F.greatest(F.size("actions"), F.size("action_types"))
    leaks_day = F.col("newest_day") >= day
    outside = (
        leaks_day
        | (F.col("oldest_day") < F.date_sub(day, config.lookback_days))
        | (longest > config.max_actions)
    )
    rows = F.greatest(F.size("impressions"), F.lit(0)) if config.explode else F.lit(1)
    seen = Observation(f"run-{uuid.uuid4().hex}")
    observed = unpadded.hint("rebalance", "as_of_date").observe(
        seen,
        F.count(F.lit(1)).alias("records"),
        F.sum(rows).alias("rows"),
        F.min("as_of_date").alias("first_day"),
        F.max("as_of_date").alias("last_day"),
        F.count_if(leaks_day).alias("leaks"),
        F.count_if(outside).alias("kept_outside_window"),
    )
    finished = finish_inputs(
        observed.drop("newest_day", "oldest_day"), config.max_actions, config.explode
    )
    write_parquet(finished, path, partition_by=["as_of_date"])
    for name, value in seen.get.items():
        setattr(report, name, value if value is not None else getattr(report, name))
    if report.kept_outside_window and config.fail_on_same_day_leak:
        raise LeakError(f"{report.kept_outside_window} histories reach outside their window, {report.leaks} into the day itself")


def run_job(spark: SparkSession, config: JobConfig) -> JobReport:
    """The run is written next to ``out`` and becomes its current one only when all checks have passed."""
    configure(spark, config)
    report = JobReport(run=uuid.uuid4().hex)
    out = config.out.rstrip("/")
    staging = config.staging.rstrip("/") if config.staging else new_run_dir(spark, otherwise=f"{out}_staging")
    unpublished = f"{out}_unpublished-{report.run}"
    try:
        feeds = _load(spark, config, report, staging)
        report.undated_impressions = feeds["impressions"].where("as_of_date IS NULL").count()
        impressions = slice_impressions_last_n_days(feeds["impressions"], config.train_days)
        actions = feeds["clicks"].unionByName(feeds["atc"]).unionByName(feeds["orders"])
        _check(config, report, actions, impressions)
        _write(config, report, impressions, actions, unpublished)
        publish(spark, unpublished, out, report.run)
    finally:
        remove(spark, unpublished)
        if not config.staging and not config.keep_staging:
            remove(spark, staging)
    return report


def parse_args(argv: list[str] | None = None) -> JobConfig:
    p = argparse.ArgumentParser(description="Build training inputs from impressions and actions")
    # The names of the flags.
    p.add_argument("--out", required=True)
    p.add_argument("--demo", action="store_true")
    p.add_argument("--data", help="folder with one subfolder per feed")
    for name in FEEDS:
        p.add_argument(f"--{name}-path")
    p.add_argument("--layout", default="lines", choices=LAYOUTS)
    p.add_argument("--strict", action="store_true", help="fail if any record is rejected")
    p.add_argument("--max-actions", type=int, default=DEFAULT_MAX_ACTIONS)
    p.add_argument("--lookback-days", type=int, default=DEFAULT_LOOKBACK_DAYS)
    p.add_argument("--train-days", type=int, default=DEFAULT_TRAIN_DAYS)
    p.add_argument("--explode", action="store_true")
    p.add_argument("--fail-on-same-day-leak", action="store_true")
    p.add_argument("--external-upstream-scan", action="store_true")
    p.add_argument("--skip-quality", action="store_true")
    p.add_argument("--allow-future-actions", type=int, default=0)
    p.add_argument("--on-check-error", default="raise", choices=("raise", "warn"))
    p.add_argument("--staging", help="folder of the typed feeds; it is kept")
    p.add_argument("--keep-staging", action="store_true")
    p.add_argument("--count-duplicates", action="store_true")
    p.add_argument("--shuffle-partitions", type=int, default=0)
    a = p.parse_args(argv)
    paths = {n: getattr(a, f"{n}_path") or (f"{a.data}/{n}" if a.data else None) for n in FEEDS}
    try:
        return JobConfig(
            out=a.out,
            demo=a.demo,
            paths=paths,
            layout=a.layout,
            strict=a.strict,
            max_actions=a.max_actions,
            lookback_days=a.lookback_days,
            train_days=a.train_days,
            explode=a.explode,
            fail_on_same_day_leak=a.fail_on_same_day_leak,
            upstream_scan=a.external_upstream_scan,
            check_quality=not a.skip_quality,
            allow_future_actions=a.allow_future_actions,
            on_check_error=a.on_check_error,
            staging=a.staging,
            keep_staging=a.keep_staging,
            count_duplicates=a.count_duplicates,
            shuffle_partitions=a.shuffle_partitions,
        )
    except ValueError as error:
        p.error(str(error))


def main(argv: list[str] | None = None) -> int:
    config = parse_args(argv)
    spark = SparkSession.builder.appName("trailpack").getOrCreate()
    try:
        report = run_job(spark, config)
    except LeakError as error:
        print(error, file=sys.stderr)
        return 2
    finally:
        spark.stop()
    print(report)
    return 0
