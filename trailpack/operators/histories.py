"""The last N actions before each (day, customer), packed into two parallel arrays.

A look-back window holds whole days, so no context can need more than the newest N actions of any
one day. That bounds exactly what has to be gathered per customer, however many actions there are:

0. actions of customers that no context asks for are dropped in the scan's own stage, by a filter over the asked
   customers that grows with their number (``asked.py``).
1. newest N per (customer, day, salt): limited once inside each map task, before the shuffle, and
   once after it. The salt is the number of the map task modulo ``salts``: what one task holds of a
   day stays together, and a day with a third of all actions spreads over ``salts`` reducers.
2. by customer, together with one marker row per day asked for: the salted pieces of a day merge to
   its newest N, and running counts over the days give each marker where its window starts and ends
   in the customer's actions, newest first.
3. actions more than N behind the latest marker before them are in no history and go; the others make one array per
   customer, of at most N per day asked for, and every marker cuts its slice out of it.

Actions are never paired with contexts. One sort by customer and day serves all of steps 2 and 3.
"""

from __future__ import annotations

import warnings
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import pad_array
from ..schemas import ACTION_MISSING, DEFAULT_LOOKBACK_DAYS, DEFAULT_MAX_ACTIONS
from .asked import of_asked_customers
from .item_index import with_item_index

# A day with rows in M map tasks gives its first reducers about N*M/salts rows each and its last one
# at most N*salts. 32 keeps both in the tens of millions for N = 1000 and M = 800 000.
DEFAULT_SALTS = 32

# Spark limits rows per window group ahead of a shuffle up to this limit only.
EARLY_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"

# Newest first; nulls last within ties, which DESC and sort_array(asc=False) both do.
RECENCY = ("occurred_at", "action_type", "item_id")


def actions_in_reach(
    actions: DataFrame,
    contexts: DataFrame,
    lookback_days: int,
    as_of_range: tuple[date, date] | None = None,
) -> DataFrame:
    """Actions that at least one context day could see, judged by first and last context day.

    Without ``as_of_range`` both days are scalar subqueries over the context days. Written on the
    timestamp, so that the bounds reach a typed Parquet scan.
    """
    if as_of_range is None:
        first = contexts.agg(F.min("as_of_date")).scalar()
        last = contexts.agg(F.max("as_of_date")).scalar()
    else:
        first, last = (F.lit(day) for day in as_of_range)
    return actions.where(
        F.col("customer_id").isNotNull()
        & (F.col("occurred_at") >= F.date_sub(first, lookback_days).cast("timestamp"))
        & (F.col("occurred_at") < last.cast("timestamp"))
    )


def newest_per_day(actions: DataFrame, max_actions: int, salts: int = DEFAULT_SALTS) -> DataFrame:
    """At most ``max_actions`` rows per (customer, day, salt), the newest ones."""
    if max_actions > int(actions.sparkSession.conf.get(EARLY_LIMIT)):
        warnings.warn(
            f"{EARLY_LIMIT} is below max_actions={max_actions}: days are cut to it only after the "
            "shuffle. Raise the setting before running.",
            stacklevel=2,
        )
    newest_first = Window.partitionBy("customer_id", "day", "salt").orderBy(
        *[F.desc(c) for c in RECENCY]
    )
    return (
        actions.select(
            "customer_id",
            *RECENCY,
            F.to_date("occurred_at").alias("day"),
            (F.spark_partition_id() % F.lit(salts)).alias("salt"),
        )
        .withColumn("nth", F.row_number().over(newest_first))
        .where(F.col("nth") <= max_actions)
        .drop("nth", "salt")
    )


def age_of(day: Column) -> Column:
    """Ascending from the newest day to the oldest."""
    return -F.unix_date(day)


def customer_timelines(
    newest: DataFrame, contexts: DataFrame, max_actions: int, lookback_days: int, carry: tuple[str, ...] = ()
) -> DataFrame:
    """One row per customer asked for: ``entries``, newest first, and ``asked``. ``carry`` names further columns of an entry.

    ``asked`` holds the days with ``skip``, the entries on or after the day, and ``length``, how many
    of the following ones belong to its history. ``entries`` has at most ``max_actions`` per day asked for.
    """
    columns = (*RECENCY, *carry)
    acted = newest.select(
        "customer_id",
        age_of(F.col("day")).alias("age"),
        *columns,
        F.lit(None).cast("date").alias("as_of_date"),
        F.lit(1).alias("acted"),
    )
    markers = contexts.distinct().select(
        "customer_id",
        age_of(F.col("as_of_date")).alias("age"),
        *[F.lit(None).cast(newest.schema[c].dataType).alias(c) for c in columns],
        "as_of_date",
        F.lit(0).alias("acted"),
    )
    in_day = Window.partitionBy("customer_id", "age").orderBy(*[F.desc(c) for c in RECENCY])
    by_age = Window.partitionBy("customer_id").orderBy("age")
    until_day = by_age.rangeBetween(Window.unboundedPreceding, 0)
    until_oldest = by_age.rangeBetween(Window.unboundedPreceding, lookback_days)
    is_action = F.col("acted") == 1

    # Markers sort behind the actions of their day, so they take no rank away from them.
    passed = by_age.rangeBetween(Window.unboundedPreceding, -1)
    counted = (
        acted.unionByName(markers)
        .repartition("customer_id")
        .withColumn("nth", F.row_number().over(in_day))
        .where(~is_action | (F.col("nth") <= max_actions))
        .withColumn("skip", F.sum("acted").over(until_day))
        .withColumn("newer", F.coalesce(F.sum("acted").over(passed), F.lit(0)))
        # How many actions are as new as the latest marker passed; null before the first one.
        .withColumn("seen_from", F.max(F.when(~is_action, F.col("skip"))).over(passed))
        .where(~is_action | (F.col("newer") + F.col("nth") - F.col("seen_from") <= max_actions))
        # Counted again among those that are left: what a marker sees has stayed whole.
        .withColumn("skip", F.sum("acted").over(until_day).cast("int"))
        .withColumn("until", F.sum("acted").over(until_oldest).cast("int"))
    )
    length = F.least(F.col("until") - F.col("skip"), F.lit(max_actions)).alias("length")
    return (
        counted.groupBy("customer_id")
        .agg(
            F.collect_list(F.when(is_action, F.struct(*columns))).alias("entries"),
            F.collect_list(F.when(~is_action, F.struct("as_of_date", "skip", length))).alias("asked"),
        )
        .where(F.size("asked") > 0)
        .withColumn("entries", F.sort_array("entries", asc=False))
    )


def packed_histories(
    actions_union_df: DataFrame,
    contexts_df: DataFrame,
    *,
    max_actions: int = DEFAULT_MAX_ACTIONS,
    lookback_days: int = DEFAULT_LOOKBACK_DAYS,
    salts: int = DEFAULT_SALTS,
    as_of_range: tuple[date, date] | None = None,
    keep_times: bool = False,
    keep_days: bool = False,
    drop_repeats: bool = False,
    item_index: DataFrame | None = None,
) -> DataFrame:
    """Histories before padding: (as_of_date, customer_id, actions, action_types).

    One row per distinct context, with empty arrays where nothing is in reach. This is the form to
    shuffle; padding belongs after the last exchange. For audits, ``keep_times`` adds the times of
    the kept actions and ``keep_days`` the days of the newest and the oldest of them. ``drop_repeats`` keeps the newest of
    consecutive actions with the same item and type. ``item_index`` (item_id, item_index) puts its numbers in the place of item
    ids, in the same order.
    """
    from .runs import cut_runs, newest_heads, stitched_timelines  # built on this module

    contexts = contexts_df.select("as_of_date", "customer_id")
    reach = actions_in_reach(actions_union_df, contexts, lookback_days, as_of_range)
    reach = of_asked_customers(reach, contexts)
    limited = newest_heads(reach, max_actions, salts) if drop_repeats else newest_per_day(reach, max_actions, salts)
    carry = ()
    if item_index is not None:
        # After the limit: no more than N rows of a day and salt are looked up.
        limited, carry = with_item_index(limited, item_index), ("item_index",)
    item = carry[0] if carry else "item_id"
    if drop_repeats:
        opened = cut_runs(stitched_timelines(limited, contexts, max_actions, lookback_days, carry), max_actions)
        opened = opened.select(
            "as_of_date",
            "customer_id",
            F.col(f"kept.{item}").alias("items"),
            F.col("kept.action_type").alias("codes"),
            F.col("kept.occurred_at").alias("times"),
            F.lit(0).alias("skip"),
            F.size("kept").alias("length"),
        )
    else:
        opened = customer_timelines(limited, contexts, max_actions, lookback_days, carry).select(
            "customer_id",
            F.col(f"entries.{item}").alias("items"),
            F.col("entries.action_type").alias("codes"),
            F.col("entries.occurred_at").alias("times"),
            F.inline("asked"),
        )
    skip, length = F.col("skip"), F.col("length")

    def cut(column: str, name: str) -> Column:
        return F.slice(column, skip + 1, length).alias(name)

    extra = []
    if keep_times:
        extra.append(cut("times", "action_times"))
    if keep_days:
        any_kept = length > 0
        extra += [
            F.to_date(F.when(any_kept, F.get("times", skip))).alias("newest_day"),
            F.to_date(F.when(any_kept, F.get("times", skip + length - 1))).alias("oldest_day"),
        ]
    return opened.select(
        "as_of_date", "customer_id", cut("items", "actions"), cut("codes", "action_types"), *extra
    )


def pad_histories(df: DataFrame, max_actions: int) -> DataFrame:
    """Both arrays with zeros up to ``max_actions``; null arrays stay null."""
    return df.withColumns(
        {
            "actions": pad_array(F.col("actions"), max_actions, 0),
            "action_types": pad_array(F.col("action_types"), max_actions, ACTION_MISSING),
        }
    )


def build_histories_for_impressions(
    actions_union_df: DataFrame,
    impressions_ctx_df: DataFrame,
    *,
    max_actions: int = DEFAULT_MAX_ACTIONS,
    lookback_days: int = DEFAULT_LOOKBACK_DAYS,
    salts: int = DEFAULT_SALTS,
    as_of_range: tuple[date, date] | None = None,
    drop_repeats: bool = False,
    item_index: DataFrame | None = None,
) -> DataFrame:
    """Fixed-length histories, one row per distinct (as_of_date, customer_id)."""
    packed = packed_histories(
        actions_union_df,
        impressions_ctx_df,
        max_actions=max_actions,
        lookback_days=lookback_days,
        salts=salts,
        as_of_range=as_of_range,
        drop_repeats=drop_repeats,
        item_index=item_index,
    )
    return pad_histories(packed, max_actions)


def ranked_actions(histories: DataFrame) -> DataFrame:
    """Kept actions in long form, rank 1 the newest. Needs histories built with ``keep_times``."""
    return histories.select(
        "as_of_date",
        "customer_id",
        F.posexplode(F.arrays_zip("actions", "action_types", "action_times")).alias("pos", "kept"),
    ).select(
        "as_of_date",
        "customer_id",
        (F.col("pos") + 1).alias("action_rank"),
        F.col("kept.actions").alias("item_id"),
        F.col("kept.action_types").alias("action_type"),
        F.col("kept.action_times").alias("occurred_at"),
    )
