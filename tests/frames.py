"""Small frames for tests, and a brute-force model of histories in plain Python."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from trailpack.operators.impressions import normalize_impressions
from trailpack.schemas import (
    actions_union_schema,
    atc_schema,
    clicks_schema,
    impressions_schema,
    orders_schema,
)


def at(text: str) -> datetime:
    return datetime.fromisoformat(text)


def actions_df(spark, rows):
    """rows: (customer, item, type, time)"""
    sources = {1: "clicks", 2: "atc", 3: "orders"}
    full = [
        (c, i, t, a, sources[a], t.date() if t else None) for c, i, a, t in rows
    ]
    return spark.createDataFrame(full, actions_union_schema)


def contexts_df(spark, rows):
    return spark.createDataFrame(rows, "as_of_date date, customer_id bigint")


def feeds(spark, impressions=(), clicks=(), atc=(), orders=()):
    return (
        spark.createDataFrame(list(impressions), impressions_schema),
        spark.createDataFrame(list(clicks), clicks_schema),
        spark.createDataFrame(list(atc), atc_schema),
        spark.createDataFrame(list(orders), orders_schema),
    )


def normalised(spark, rows):
    return normalize_impressions(spark.createDataFrame(rows, impressions_schema))


def _recency(action):
    _, item, kind, when = action
    return (when, kind, item is not None, item or 0)


def model_histories(actions, contexts, n, days):
    """{(day, customer): (items, types)}, padded."""
    out = {}
    for day, customer in set(contexts):
        seen = [
            a
            for a in actions
            if day is not None
            and customer is not None
            and a[0] == customer
            and a[3] is not None
            and day - timedelta(days=days) <= a[3].date() < day
        ]
        kept = sorted(seen, key=_recency, reverse=True)[:n]
        items = [a[1] for a in kept] + [0] * (n - len(kept))
        types = [a[2] for a in kept] + [0] * (n - len(kept))
        out[(day, customer)] = (items, types)
    return out


def collected(histories):
    rows = histories.collect()
    out = {(r.as_of_date, r.customer_id): (r.actions, r.action_types) for r in rows}
    assert len(out) == len(rows), "a context has more than one row"
    return out


D = date
