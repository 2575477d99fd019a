"""Every operator as a query over the driver's tables."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from datetime import date
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import action_type_name, pad_array
from ..operators import histories as H
from ..operators import impressions as I
from ..operators import consistency, item_index, leaks, profile, quality, time_order
from ..operators.actions import atc_actions, build_actions_union, click_actions, order_actions
from ..operators.examples import build_training_examples
from ..operators.sampling import sample_per_day
from ..sinks.writers import new_run_dir, read_run, write_parquet
from ..sources.readers import BAD_FIELDS, flag_rejects
from ..sources.synthetic import synthetic_feeds
from .testbed import event_feeds, order_feeds, table
from .training import build_training_inputs

# Small N and L: truncation, padding and empty histories all occur in the tables.
N, L = 10, 7
SEED = 11
NOW = "2024-01-20 00:00:00"

Query = Callable[[SparkSession, str], DataFrame]


def _comparable(field: T.StructField) -> Column:
    column, dtype = F.col(field.name), field.dataType
    if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.StructType):
        column = F.array_join(
            F.transform(
                column,
                lambda x: F.concat(
                    x["item_id"].cast("string"), F.when(x["is_order"], "+").otherwise("-")
                ),
            ),
            ",",
        )
    elif isinstance(dtype, T.ArrayType):
        column = F.array_join(column, ",")
    elif isinstance(dtype, T.TimestampType):
        column = F.unix_micros(column)
    elif isinstance(dtype, T.DoubleType):
        column = F.round(column, 6)
    return column.alias(field.name)


def comparable(df: DataFrame) -> DataFrame:
    """Arrays as text, times as epoch micros, averages rounded: values that engines agree on."""
    return df.select([_comparable(field) for field in df.schema])


def _parts(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(actions, normalised impressions)"""
    feeds = event_feeds(spark, sf_dir)
    actions = build_actions_union(feeds["clicks"], feeds["atc"], feeds["orders"])
    return actions, I.normalize_impressions(feeds["impressions"])


def _inputs(feeds: dict[str, DataFrame], **options) -> DataFrame:
    return build_training_inputs(
        feeds["impressions"], feeds["clicks"], feeds["atc"], feeds["orders"], **options
    )


# Feeds, actions, impressions ---------------------------------------------------------------------


def clicks_norm(spark, sf_dir):
    return click_actions(event_feeds(spark, sf_dir)["clicks"])


def atc_norm(spark, sf_dir):
    return atc_actions(event_feeds(spark, sf_dir)["atc"])


def orders_norm(spark, sf_dir):
    return order_actions(event_feeds(spark, sf_dir)["orders"])


def actions_union(spark, sf_dir):
    return _parts(spark, sf_dir)[0]


def normalize_impressions_raw(spark, sf_dir):
    return I.normalize_impressions(event_feeds(spark, sf_dir)["impressions"])


def normalize_impressions_idem(spark, sf_dir):
    return I.normalize_impressions(normalize_impressions_raw(spark, sf_dir))


def contexts(spark, sf_dir):
    return I.contexts_of(normalize_impressions_raw(spark, sf_dir))


def train_window(spark, sf_dir):
    raw = event_feeds(spark, sf_dir)["impressions"]
    return I.slice_impressions_last_n_days(raw, 14).select("dt", "ranking_id", "customer_id")


def impression_items(spark, sf_dir):
    return I.explode_impressions(event_feeds(spark, sf_dir)["impressions"])


def pad_arrays(spark, sf_dir):
    """Item lists of the impressions cut or filled to three."""
    items = F.col("impressions")["item_id"]
    padded = pad_array(items, 3, 0).alias("padded")
    return normalize_impressions_raw(spark, sf_dir).select("ranking_id", padded)


# Histories and examples --------------------------------------------------------------------------


def histories(spark, sf_dir):
    return H.build_histories_for_impressions(
        *_parts(spark, sf_dir), max_actions=N, lookback_days=L
    )


def histories_orders(spark, sf_dir):
    feeds = order_feeds(spark, sf_dir)
    return H.build_histories_for_impressions(
        build_actions_union(feeds["clicks"], feeds["atc"], feeds["orders"]),
        I.normalize_impressions(feeds["impressions"]),
        max_actions=N,
        lookback_days=365,
    )


def _item_index(actions, impressions):
    shown = I.explode_items(impressions).withColumnRenamed("impression_item_id", "item_id")
    return item_index.build_item_index(item_index.item_frequencies(actions, shown))


def item_indices(spark, sf_dir):
    """All items acted on or shown."""
    return _item_index(*_parts(spark, sf_dir))


def histories_indexed(spark, sf_dir):
    actions, impressions = _parts(spark, sf_dir)
    index = _item_index(actions, impressions)
    return H.build_histories_for_impressions(actions, impressions, max_actions=N, lookback_days=L, item_index=index)


def histories_deduped(spark, sf_dir, items=3):
    """Items of one of few groups, so that there are runs of them."""
    actions, impressions = _parts(spark, sf_dir)
    grouped = actions.withColumn("item_id", F.col("item_id") % F.lit(items))
    return H.build_histories_for_impressions(grouped, impressions, max_actions=N, lookback_days=L, drop_repeats=True)


def _timed_histories(actions, impressions):
    return H.packed_histories(
        actions, impressions, max_actions=N, lookback_days=L, keep_times=True
    )


def topn_actions(spark, sf_dir):
    return H.ranked_actions(_timed_histories(*_parts(spark, sf_dir)))


def candidates_before(spark, sf_dir):
    return leaks.candidate_counts(*_parts(spark, sf_dir))


def candidates_window(spark, sf_dir):
    return leaks.candidate_counts(*_parts(spark, sf_dir), L)


def examples(spark, sf_dir, explode):
    actions, impressions = _parts(spark, sf_dir)
    built = H.build_histories_for_impressions(
        actions, impressions, max_actions=N, lookback_days=L
    )
    return build_training_examples(impressions, built, explode=explode)


def training_inputs(spark, sf_dir, explode=False):
    return _inputs(event_feeds(spark, sf_dir), max_actions=N, lookback_days=L, explode=explode)


def training_inputs_default(spark, sf_dir):
    """The default size: 1000 actions, 365 days."""
    return _inputs(event_feeds(spark, sf_dir))


def training_inputs_train_window(spark, sf_dir):
    """The job's plan: newest 14 days of impressions, histories over all actions."""
    feeds = event_feeds(spark, sf_dir)
    feeds["impressions"] = I.slice_impressions_last_n_days(feeds["impressions"], 14)
    return _inputs(feeds, max_actions=N, lookback_days=L)


def training_inputs_orders(spark, sf_dir):
    return _inputs(order_feeds(spark, sf_dir), max_actions=N, lookback_days=365)


# Quality and leaks -------------------------------------------------------------------------------


def quality_report(spark, sf_dir):
    return quality.quality_counters(actions_union(spark, sf_dir), F.lit(NOW).cast("timestamp"))


def duplicate_groups(spark, sf_dir):
    return quality.duplicate_groups(actions_union(spark, sf_dir))


def leak_count(spark, sf_dir):
    return leaks.same_day_leaks(_timed_histories(*_parts(spark, sf_dir)))


def history_audit(spark, sf_dir):
    actions, impressions = _parts(spark, sf_dir)
    return leaks.audit_histories(
        _timed_histories(actions, impressions),
        actions,
        impressions,
        max_actions=N,
        lookback_days=L,
    )


def upstream_same_day(spark, sf_dir):
    return leaks.upstream_same_day(*_parts(spark, sf_dir))


def time_order_report(spark, sf_dir):
    """Orders as they stand in their file, by their days."""
    return time_order.time_order_report(
        table(spark, sf_dir, "orders"), customer="o_custkey", time="o_orderdate", piece_rows=1000
    )


def signs_before_orders(spark, sf_dir):
    return consistency.signs_before_orders(*_parts(spark, sf_dir))


def orders_without_prior_action(spark, sf_dir):
    return consistency.orders_without_prior_action(*_parts(spark, sf_dir))


# Sources and sinks -------------------------------------------------------------------------------


def reject_split(spark, sf_dir):
    """Events as a text feed whose ``k`` does not parse from 90 on; both sides in one result."""
    k = F.get_json_object("props", "$.k")
    raw = table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("event_id"),
        F.col("user_id").cast("string").alias("customer_id"),
        F.when(k.cast("int") >= 90, F.concat(F.lit("x"), k)).otherwise(k).alias("item_id"),
    )
    schema = T.StructType(
        [
            T.StructField("event_id", T.LongType()),
            T.StructField("customer_id", T.LongType()),
            T.StructField("item_id", T.IntegerType()),
        ]
    )
    return flag_rejects(raw, schema).select(
        "event_id",
        "item_id",
        F.col("_raw.item_id").alias("rejected_value"),
        F.col(BAD_FIELDS).alias("bad_fields"),
    )


def reject_times(spark, sf_dir):
    """Events as a text feed, with days and times that do not parse in two of five rows."""
    at, nth = F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.col("event_id") % 5
    day = F.substring(at, 1, 10)
    raw = table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("event_id"),
        F.when(nth == 1, F.lit("2024-13-45")).when(nth == 2, F.lit(None)).when(nth == 3, F.concat(F.lit("dt="), day)).otherwise(day).alias("dt"),
        F.when(nth == 4, F.concat(at, F.lit(" or so"))).when(nth == 2, F.lit(None)).otherwise(at).alias("click_time"),
    )
    schema = T.StructType(
        [T.StructField("event_id", T.LongType()), T.StructField("dt", T.StringType()), T.StructField("click_time", T.StringType())]
    )
    return flag_rejects(raw, schema, times=("dt", "click_time")).select(
        "event_id", "dt", "click_time", F.col("_raw.dt").alias("rejected_dt"), F.col("_raw.click_time").alias("rejected_time"), BAD_FIELDS
    ).withColumnRenamed(BAD_FIELDS, "bad_fields")


def write_read_roundtrip(spark, sf_dir):
    # Only a local session can read back what it writes to a local folder.
    local = spark.sparkContext.master.startswith("local[")
    path = new_run_dir(spark, otherwise=tempfile.gettempdir() if local else None)
    run = training_inputs(spark, sf_dir)
    write_parquet(run, path, partition_by=["as_of_date"], rebalance=True)
    return read_run(spark, path)


def synthetic(spark, sf_dir):
    """The four generated feeds under each other."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_id"))
    feeds = synthetic_feeds(customers, first_day=date(2024, 1, 1), days=3, items=200, seed=SEED)

    def rows(feed: str, time: str, item: str | None) -> DataFrame:
        shown = feeds["impressions"].schema["impressions"].dataType
        return feeds[feed].select(
            F.lit(feed).alias("feed"),
            "customer_id",
            F.col(time).alias("event_time"),
            (F.col(item) if item else F.lit(None).cast("int")).alias("item_id"),
            (F.lit(None).cast(shown) if item else F.col("impressions")).alias("shown"),
        )

    return (
        rows("impressions", "dt", None)
        .unionByName(rows("clicks", "click_time", "item_id"))
        .unionByName(rows("atc", "occurred_at", "config_id"))
        .unionByName(rows("orders", "order_date", "config_id"))
    )


def daily_sample(spark, sf_dir):
    """Twenty shown items of every day."""
    shown = impression_items(spark, sf_dir)
    return sample_per_day(shown, 20, SEED, key=("ranking_id", "customer_id", "impression_item_id"))


# Run profile -------------------------------------------------------------------------------------


def size_preview(spark, sf_dir):
    return profile.size_preview(training_inputs(spark, sf_dir))


def run_summary(spark, sf_dir):
    return profile.run_summary(training_inputs(spark, sf_dir))


def padding_stats(spark, sf_dir):
    return profile.padding_stats(training_inputs(spark, sf_dir))


def sample_customers(spark, sf_dir):
    return profile.sample_customers(normalize_impressions_raw(spark, sf_dir), 10, SEED)


def customer_snapshot(spark, sf_dir):
    return profile.customer_snapshot(training_inputs(spark, sf_dir), 10, SEED)


def action_tokens(spark, sf_dir):
    return profile.action_tokens(training_inputs(spark, sf_dir), head=5)


def action_names(spark, sf_dir):
    name = action_type_name(F.col("action_type")).alias("action_name")
    return actions_union(spark, sf_dir).groupBy(name).agg(F.count(F.lit(1)).alias("actions"))


def sample_rows(spark, sf_dir):
    return profile.sample_rows(training_inputs(spark, sf_dir), 10, SEED)


def sample_items(spark, sf_dir):
    return profile.sample_items(normalize_impressions_raw(spark, sf_dir), 10, SEED)


# With Spark's own types.
NATIVE: dict[str, Query] = {
    "clicks_norm": clicks_norm,
    "atc_norm": atc_norm,
    "orders_norm": orders_norm,
    "actions_union": actions_union,
    "normalize_impressions_raw": normalize_impressions_raw,
    "normalize_impressions_idem": normalize_impressions_idem,
    "contexts": contexts,
    "train_window": train_window,
    "impression_items": impression_items,
    "pad_array": pad_arrays,
    "histories": histories,
    "histories_orders": histories_orders,
    "item_index": item_indices,
    "histories_indexed": histories_indexed,
    "histories_deduped": histories_deduped,
    "topn_actions": topn_actions,
    "candidates_before": candidates_before,
    "candidates_window": candidates_window,
    "examples_nested": partial(examples, explode=False),
    "examples_exploded": partial(examples, explode=True),
    "training_inputs": training_inputs,
    "training_inputs_exploded": partial(training_inputs, explode=True),
    "training_inputs_default": training_inputs_default,
    "training_inputs_train_window": training_inputs_train_window,
    "training_inputs_orders": training_inputs_orders,
    "quality_report": quality_report,
    "duplicate_groups": duplicate_groups,
    "leak_count": leak_count,
    "history_audit": history_audit,
    "upstream_same_day": upstream_same_day,
    "time_order_report": time_order_report,
    "signs_before_orders": signs_before_orders,
    "orders_without_prior_action": orders_without_prior_action,
    "reject_split": reject_split,
    "reject_times": reject_times,
    "sample_per_day": daily_sample,
    "write_read_roundtrip": write_read_roundtrip,
    "synthetic_feeds": synthetic,
    "size_preview": size_preview,
    "run_summary": run_summary,
    "padding_stats": padding_stats,
    "sample_customers": sample_customers,
    "customer_snapshot": customer_snapshot,
    "action_tokens": action_tokens,
    "action_names": action_names,
    "sample_rows": sample_rows,
    "sample_items": sample_items,
}


def _compared(query: Query) -> Query:
    return lambda spark, sf_dir: comparable(query(spark, sf_dir))


QUERIES: dict[str, Query] = {name: _compared(query) for name, query in NATIVE.items()}
