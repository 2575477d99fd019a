"""Declared schemas of the raw feeds and of the tables derived from them."""

from __future__ import annotations

from pyspark.sql import types as T

# The action coding shared by every table.
ACTION_MISSING = 0
ACTION_CLICK = 1
ACTION_ATC = 2
ACTION_ORDER = 3

DEFAULT_MAX_ACTIONS = 1000
DEFAULT_LOOKBACK_DAYS = 365
DEFAULT_TRAIN_DAYS = 14


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in columns.items()])


_text, _id, _int, _day = T.StringType(), T.LongType(), T.IntegerType(), T.DateType()
_ints = T.ArrayType(_int)
_shown = T.ArrayType(_table(item_id=_int, is_order=T.BooleanType()))

# Raw feeds. Event times stay text here and are parsed when actions are built.
impressions_schema = _table(dt=_text, ranking_id=_text, customer_id=_id, impressions=_shown)
clicks_schema = _table(dt=_text, customer_id=_id, item_id=_int, click_time=_text)
atc_schema = _table(
    dt=_text, customer_id=_id, config_id=_int, simple_id=_text, occurred_at=_text
)
orders_schema = _table(order_date=_text, customer_id=_id, config_id=_int)

FEED_SCHEMAS = {
    "impressions": impressions_schema,
    "clicks": clicks_schema,
    "atc": atc_schema,
    "orders": orders_schema,
}

# Derived tables.
actions_union_schema = _table(
    customer_id=_id,
    item_id=_int,
    occurred_at=T.TimestampType(),
    action_type=_int,
    source=_text,
    action_date=_day,
)
histories_schema = _table(as_of_date=_day, customer_id=_id, actions=_ints, action_types=_ints)
# A run directory is partitioned by day, so the day comes back as the last column.
training_output_schema = _table(
    ranking_id=_text,
    customer_id=_id,
    impressions=_shown,
    actions=_ints,
    action_types=_ints,
    as_of_date=_day,
)
exploded_output_schema = _table(
    ranking_id=_text,
    customer_id=_id,
    impression_item_id=_int,
    is_order=T.BooleanType(),
    actions=_ints,
    action_types=_ints,
    as_of_date=_day,
)
