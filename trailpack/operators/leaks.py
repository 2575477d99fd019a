"""Checks that histories hold what they should and nothing from the day itself.

All of them work on actions counted per (customer, day), never on action-context pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import DEFAULT_MAX_ACTIONS
from .actions import daily_action_counts
from .histories import packed_histories
from .impressions import contexts_of


def candidate_counts(
    actions: DataFrame, contexts: DataFrame, lookback_days: int | None = None
) -> DataFrame:
    """Per context, the number of actions before its day, back to ``lookback_days`` if given.

    A sum over a range frame of the daily counts; one customer has one row per calendar day there.
    """

    def day_number(column: str):
        return F.datediff(F.col(column), F.lit("1970-01-01").cast("date"))

    start = Window.unboundedPreceding if lookback_days is None else -lookback_days
    before = (
        Window.partitionBy("customer_id").orderBy("day").rangeBetween(start, -1)
    )
    counted = daily_action_counts(actions).select(
        F.lit(None).cast("date").alias("as_of_date"),
        "customer_id",
        day_number("action_date").alias("day"),
        "n",
        F.lit(False).alias("asked"),
    )
    asked = contexts_of(contexts).select(
        "as_of_date",
        "customer_id",
        day_number("as_of_date").alias("day"),
        F.lit(0).cast("bigint").alias("n"),
        F.lit(True).alias("asked"),
    )
    return (
        counted.unionByName(asked)
        .withColumn("candidates", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .where("asked")
        .select("as_of_date", "customer_id", "candidates")
    )


def same_day_leaks(histories: DataFrame) -> DataFrame:
    """One row: the kept actions that fall on their context's own day, in histories built with ``keep_times``."""
    same_day = F.filter("action_times", lambda t: F.to_date(t) == F.col("as_of_date"))
    leaks = F.coalesce(F.sum(F.size(same_day)), F.lit(0).cast("bigint"))
    return histories.agg(leaks.alias("leaks"))


def check_no_same_day_leak_strict(
    actions_union_df: DataFrame,
    impressions_ctx_df: DataFrame,
    *,
    lookback_days: int,
    max_actions: int = DEFAULT_MAX_ACTIONS,
) -> int:
    """Builds the histories and counts what they keep of the day itself."""
    built = packed_histories(
        actions_union_df,
        impressions_ctx_df,
        max_actions=max_actions,
        lookback_days=lookback_days,
        keep_times=True,
    )
    return same_day_leaks(built).first()["leaks"]


def upstream_same_day(actions: DataFrame, contexts: DataFrame) -> DataFrame:
    """One row: input actions on a day their customer is asked for, and the contexts hit."""
    counts = daily_action_counts(actions).withColumnRenamed("action_date", "as_of_date")
    hit = counts.join(contexts_of(contexts), ["as_of_date", "customer_id"])
    return hit.agg(
        F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("same_day_actions"),
        F.count(F.lit(1)).alias("contexts_hit"),
    )


def has_upstream_same_day(actions: DataFrame, contexts: DataFrame) -> bool:
    """Is there any such action?"""
    days = contexts_of(contexts).withColumnRenamed("as_of_date", "action_date")
    hit = daily_action_counts(actions).join(days, ["action_date", "customer_id"], "left_semi")
    return not hit.isEmpty()


def audit_histories(
    histories: DataFrame,
    actions: DataFrame,
    contexts: DataFrame,
    *,
    max_actions: int,
    lookback_days: int,
) -> DataFrame:
    """Per context asked for, what was kept and how often each rule is broken (all zero when right).

    Takes unpadded histories built with ``keep_times``. ``missing`` compares with the candidates
    counted independently from the actions; ``absent`` is 1 for a context that has no history at all, and then
    all its candidates are missing.
    """
    times = F.col("action_times")
    as_of = F.col("as_of_date")
    expected = candidate_counts(actions, contexts, lookback_days).alias("e")

    def count_days(rule):
        return F.size(F.filter(times, lambda t: rule(F.to_date(t))))

    kept = F.arrays_zip("action_times", "action_types", "actions")
    newer = F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))
    older = F.slice(kept, 2, F.greatest(F.size(kept) - 1, F.lit(0)))
    rising = F.zip_with(newer, older, lambda a, b: a < b)

    measured = histories.select(
        "as_of_date",
        "customer_id",
        F.size("actions").alias("kept"),
        F.get(times, F.lit(0)).alias("newest_at"),
        F.try_element_at(times, F.lit(-1)).alias("oldest_at"),
        count_days(lambda day: day >= as_of).alias("not_before"),
        count_days(lambda day: day < F.date_sub(as_of, lookback_days)).alias("too_old"),
        F.greatest(F.size("actions") - F.lit(max_actions), F.lit(0)).alias("over_limit"),
        F.size(F.filter(rising, lambda r: r)).alias("out_of_order"),
    )
    # Keys may be null on both sides.
    same = F.lit(True)
    for key in ("as_of_date", "customer_id"):
        same = same & F.col(f"e.{key}").eqNullSafe(F.col(f"m.{key}"))
    found = F.col("m.found")
    counts = [c for c in measured.columns if c not in ("as_of_date", "customer_id", "newest_at", "oldest_at")]
    wanted = F.least(F.col("candidates"), F.lit(max_actions))
    return expected.join(measured.withColumn("found", F.lit(True)).alias("m"), same, "left").select(
        "e.as_of_date",
        "e.customer_id",
        "newest_at",
        "oldest_at",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
        (wanted - F.coalesce("kept", F.lit(0))).alias("missing"),
        F.when(found, 0).otherwise(1).alias("absent"),
    )
