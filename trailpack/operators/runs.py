"""Histories without consecutive duplicates: of a run of actions with the same item and type, the newest stays.

A run is a matter of neighbours, so a task that holds some of a day's actions cannot tell what ends it. What can be collapsed where:

1. equal actions are neighbours wherever they are: they become one inside the map tasks, before any shuffle.
2. a day is cut into slices of time. A (customer, day, slice) has all its actions in order, so its runs collapse to their heads, and
   its newest N heads are enough: whoever sees the slice sees the whole day. A hot day is ``slices`` groups.
3. by customer, heads are stitched: one that repeats the action before it is dropped if that is of the same day. If that is of a later
   day it is kept and marked, since a context between the two days starts with it. A day has one such mark at most.

A context's history is then cut out of the customer's heads as for plain histories, its first entry taken in any case and marked
ones left out after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .histories import DEFAULT_SALTS, RECENCY, age_of

_SAME = ("item_id", "action_type")
_SECONDS = 86_400


def _slice(slices: int) -> Column:
    at = F.col("occurred_at")
    second = F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)
    return F.floor(second * F.lit(slices) / F.lit(_SECONDS))


def newest_heads(actions: DataFrame, max_actions: int, slices: int = DEFAULT_SALTS) -> DataFrame:
    """The heads of the newest ``max_actions`` runs per (customer, day, slice)."""
    newest_first = Window.partitionBy("customer_id", "day", "slice").orderBy(*[F.desc(c) for c in RECENCY])
    action = F.struct(*_SAME)
    return (
        actions.select("customer_id", *RECENCY)
        .distinct()
        .withColumn("day", F.to_date("occurred_at"))
        .withColumn("slice", _slice(slices))
        .withColumn("repeats", action.eqNullSafe(F.lag(action).over(newest_first)))
        .where("NOT repeats")
        .withColumn("nth", F.row_number().over(newest_first))
        .where(F.col("nth") <= max_actions)
        .drop("nth", "slice", "repeats")
    )


def stitched_timelines(
    heads: DataFrame, contexts: DataFrame, max_actions: int, lookback_days: int, carry: tuple[str, ...] = ()
) -> DataFrame:
    """As ``customer_timelines``, over heads; each entry says whether it ``continues`` the newer entry of a later day."""
    columns = (*RECENCY, *carry)
    acted = heads.select(
        "customer_id", age_of(F.col("day")).alias("age"), *columns, F.lit(None).cast("date").alias("as_of_date"), F.lit(1).alias("acted")
    )
    markers = contexts.distinct().select(
        "customer_id",
        age_of(F.col("as_of_date")).alias("age"),
        *[F.lit(None).cast(heads.schema[c].dataType).alias(c) for c in columns],
        "as_of_date",
        F.lit(0).alias("acted"),
    )
    is_action = F.col("acted") == 1
    # Markers have no action, so they sort behind the actions of their day.
    in_order = Window.partitionBy("customer_id").orderBy("age", *[F.desc(c) for c in RECENCY])
    passed = in_order.rowsBetween(Window.unboundedPreceding, -1)
    by_age = Window.partitionBy("customer_id").orderBy("age")
    until_day = by_age.rangeBetween(Window.unboundedPreceding, 0)
    until_oldest = by_age.rangeBetween(Window.unboundedPreceding, lookback_days)
    in_day = Window.partitionBy("customer_id", "age").orderBy(*[F.desc(c) for c in RECENCY])
    action = F.struct(*_SAME)
    newer = F.last(F.when(is_action, F.struct(action.alias("action"), "age")), ignorenulls=True).over(passed)
    counted = (
        acted.unionByName(markers)
        .repartition("customer_id")
        .withColumn("newer", newer)
        .withColumn("continues", is_action & F.coalesce(action.eqNullSafe(F.col("newer.action")) & F.col("newer").isNotNull(), F.lit(False)))
        .where(~F.col("continues") | (F.col("newer.age") < F.col("age")))
        .withColumn("nth", F.row_number().over(in_day))
        .where(~is_action | (F.col("nth") <= max_actions))
        .withColumn("heads", F.sum(F.when(is_action & ~F.col("continues"), 1).otherwise(0)).over(in_order))
        .withColumn("seen_from", F.max(F.when(~is_action, F.col("heads"))).over(passed))
        .where(~is_action | (F.col("heads") - F.col("seen_from") <= max_actions))
        .withColumn("skip", F.sum("acted").over(until_day).cast("int"))
        .withColumn("until", F.sum("acted").over(until_oldest).cast("int"))
    )
    # One entry of a day can be left out, so the history ends among these.
    reach = F.least(F.col("until") - F.col("skip"), F.lit(max_actions + lookback_days + 1)).alias("length")
    return (
        counted.groupBy("customer_id")
        .agg(
            F.collect_list(F.when(is_action, F.struct(*columns, "continues"))).alias("entries"),
            F.collect_list(F.when(~is_action, F.struct("as_of_date", "skip", reach))).alias("asked"),
        )
        .where(F.size("asked") > 0)
        .withColumn("entries", F.sort_array("entries", asc=False))
    )


def cut_runs(timelines: DataFrame, max_actions: int) -> DataFrame:
    """(customer_id, as_of_date, kept): the entries of each context's history, newest first."""
    opened = timelines.select("customer_id", "entries", F.inline("asked"))
    seen = F.slice("entries", F.col("skip") + 1, F.col("length"))
    kept = F.filter(seen, lambda entry, i: (i == 0) | ~entry["continues"])
    return opened.select("customer_id", "as_of_date", F.slice(kept, 1, max_actions).alias("kept"))
