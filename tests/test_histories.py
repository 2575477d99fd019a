import random
from datetime import date, datetime, timedelta

import pytest
from frames import actions_df, at, collected, contexts_df, model_histories
from pyspark.sql import functions as F

from trailpack.operators.histories import (
    build_histories_for_impressions,
    newest_per_day,
    packed_histories,
    ranked_actions,
)
from trailpack.functions.arrays import pad_array

DAY = date(2025, 8, 15)


def built(spark, actions, contexts, n, days, **options):
    return collected(
        build_histories_for_impressions(
            actions_df(spark, actions),
            contexts_df(spark, contexts),
            max_actions=n,
            lookback_days=days,
            **options,
        )
    )


def test_columns_and_types(spark):
    out = build_histories_for_impressions(
        actions_df(spark, []), contexts_df(spark, []), max_actions=2, lookback_days=1
    )
    assert out.dtypes == [
        ("as_of_date", "date"),
        ("customer_id", "bigint"),
        ("actions", "array<int>"),
        ("action_types", "array<int>"),
    ]
    assert out.count() == 0


def test_order_over_days_types_and_missing_items(spark):
    """Newest first over three days; carts before clicks of one time; a null item counts; the day itself and what is too old do not."""
    actions = [
        (8, 310, 1, at("2024-02-29 23:59:59")),
        (8, 322, 2, at("2024-03-01 07:30")),
        (8, 305, 1, at("2024-03-01 07:30")),
        (8, None, 1, at("2024-02-28 12:00")),
        (8, 377, 2, at("2024-02-26 00:00")),  # the oldest day that counts
        (8, 378, 3, at("2024-02-25 23:59")),
        (8, 399, 2, at("2024-03-02 00:00")),
    ]
    assert built(spark, actions, [(date(2024, 3, 2), 8)], 6, 5) == {
        (date(2024, 3, 2), 8): ([322, 305, 310, None, 377, 0], [2, 1, 1, 1, 2, 0])
    }


@pytest.mark.parametrize(
    "when, seen",
    [
        ("2025-08-15 00:00:00", False),
        ("2025-08-14 23:59:59.999999", True),
        ("2025-08-08 00:00:00", True),  # exactly L days back
        ("2025-08-07 23:59:59.999999", False),
        ("2025-08-16 00:00:00", False),
    ],
)
def test_day_bounds(spark, when, seen):
    got = built(spark, [(1, 5, 1, at(when))], [(DAY, 1)], 2, 7)
    assert got == {(DAY, 1): ([5, 0], [1, 0]) if seen else ([0, 0], [0, 0])}


def test_bounds_hold_per_context(spark):
    # The range over all contexts is wide; each context still has its own window.
    actions = [(1, d, 1, datetime(2025, 8, d, 12)) for d in range(1, 31)]
    contexts = [(date(2025, 8, d), 1) for d in (3, 10, 31)]
    assert built(spark, actions, contexts, 4, 2) == model_histories(actions, contexts, 4, 2)


def test_ties(spark):
    t = at("2025-08-14 00:00")
    actions = [
        (1, 7, 1, t),
        (1, 9, 3, t),
        (1, 8, 3, t),
        (1, 5, 2, t),
        (1, 9, 3, t),
        (1, None, 3, t),
        (1, 1, 1, at("2025-08-14 00:00:01")),
    ]
    assert built(spark, actions, [(DAY, 1)], 7, 7) == {
        (DAY, 1): ([1, 9, 9, 8, None, 5, 7], [1, 3, 3, 3, 3, 2, 1])
    }


@pytest.mark.parametrize("count", [0, 2, 3, 4])
def test_around_the_limit(spark, count):
    actions = [(1, i + 1, 1, at("2025-08-10 00:00") + timedelta(hours=i)) for i in range(count)]
    want = model_histories(actions, [(DAY, 1)], 3, 30)
    assert built(spark, actions, [(DAY, 1)], 3, 30) == want


def test_null_keys_keep_a_row_of_zeros(spark):
    actions = [(1, 5, 1, at("2025-08-14 10:00")), (None, 6, 1, at("2025-08-14 10:00")), (1, 7, 1, None)]
    got = built(spark, actions, [(DAY, 1), (DAY, None), (None, 1), (None, None)], 2, 7)
    assert got == {
        (DAY, 1): ([5, 0], [1, 0]),
        (DAY, None): ([0, 0], [0, 0]),
        (None, 1): ([0, 0], [0, 0]),
        (None, None): ([0, 0], [0, 0]),
    }


def test_repeated_contexts_give_one_row(spark):
    got = built(spark, [], [(DAY, 1)] * 3, 1, 1)
    assert got == {(DAY, 1): ([0], [0])}


def random_case(seed):
    rng = random.Random(seed)
    start = datetime(2025, 8, 1)
    actions = [
        (
            rng.choice([1, 1, 1, 1, 2, 3, None]),
            rng.choice([None, *range(1, 30)]),
            rng.randint(1, 3),
            start + timedelta(hours=6 * rng.randint(0, 90)),
        )
        for _ in range(400)
    ]
    contexts = [
        (date(2025, 8, 1) + timedelta(days=rng.randint(0, 25)), rng.choice([1, 2, 3, 4]))
        for _ in range(40)
    ]
    return actions, contexts


@pytest.mark.parametrize(
    "seed, n, days, salts", [(1, 1, 30, 32), (2, 5, 3, 1), (3, 40, 10, 3), (4, 1000, 365, 32)]
)
def test_random_cases_match_the_model(spark, seed, n, days, salts):
    actions, contexts = random_case(seed)
    want = model_histories(actions, contexts, n, days)
    assert built(spark, actions, contexts, n, days, salts=salts) == want


def test_given_range_equals_looked_up_range(spark):
    actions, contexts = random_case(5)
    days = [c[0] for c in contexts]
    want = model_histories(actions, contexts, 8, 6)
    assert built(spark, actions, contexts, 8, 6, as_of_range=(min(days), max(days))) == want


def test_customer_with_a_third_of_all_rows(spark):
    """A hot customer with hot days: whole result, and no reducer sees more than its bound."""
    n, salts, parts = 5, 4, 16
    hot = spark.range(60_000).select(
        F.lit(7).cast("bigint").alias("customer_id"),
        (F.col("id") % 1000 + 1).cast("int").alias("item_id"),
        F.timestamp_seconds(F.lit(1754870400) + (F.col("id") * 7919) % (3 * 86400)).alias("occurred_at"),
        F.lit(1).alias("action_type"),
    )
    cold = spark.range(120_000).select(
        (F.col("id") % 5000 + 100).alias("customer_id"),
        (F.col("id") % 1000 + 1).cast("int").alias("item_id"),
        F.timestamp_seconds(F.lit(1754870400) + (F.col("id") * 7919) % (3 * 86400)).alias("occurred_at"),
        F.lit(2).alias("action_type"),
    )
    actions = hot.unionByName(cold).repartition(parts)
    kept = newest_per_day(actions, n, salts)
    per_day = kept.where("customer_id = 7").groupBy("day").count().collect()
    assert len(per_day) == 3
    assert all(r["count"] <= n * salts for r in per_day)

    contexts = contexts_df(spark, [(date(2025, 8, d), c) for d in (12, 13, 14) for c in (7, 100, 101)])
    rows = [
        (r.customer_id, r.item_id, r.action_type, r.occurred_at)
        for r in actions.where("customer_id IN (7, 100, 101)").collect()
    ]
    want = model_histories(rows, [tuple(r) for r in contexts.collect()], n, 2)
    got = build_histories_for_impressions(actions, contexts, max_actions=n, lookback_days=2, salts=salts)
    assert collected(got) == want


def test_copies_of_one_action_are_kept(spark):
    t = at("2025-08-14 10:00")
    got = built(spark, [(1, 5, 1, t)] * 500, [(DAY, 1)], 6, 7)
    assert got == {(DAY, 1): ([5] * 6, [1] * 6)}


def test_packed_form_is_not_padded(spark):
    packed = packed_histories(
        actions_df(spark, [(1, 5, 1, at("2025-08-14 10:00"))]),
        contexts_df(spark, [(DAY, 1), (DAY, 2)]),
        max_actions=9,
        lookback_days=7,
        keep_days=True,
    )
    got = {r.customer_id: tuple(r) for r in packed.collect()}
    assert got == {
        1: (DAY, 1, [5], [1], date(2025, 8, 14), date(2025, 8, 14)),
        2: (DAY, 2, [], [], None, None),
    }


def test_ranked_actions(spark):
    packed = packed_histories(
        actions_df(spark, [(1, 5, 1, at("2025-08-14 10:00")), (1, 6, 2, at("2025-08-13 10:00"))]),
        contexts_df(spark, [(DAY, 1), (DAY, 2)]),
        max_actions=9,
        lookback_days=7,
        keep_times=True,
    )
    assert [tuple(r) for r in ranked_actions(packed).orderBy("action_rank").collect()] == [
        (DAY, 1, 1, 5, 1, at("2025-08-14 10:00")),
        (DAY, 1, 2, 6, 2, at("2025-08-13 10:00")),
    ]


def test_session_zone_decides_the_day(spark):
    """Same instants, other zone, other days."""
    actions = actions_df(spark, [(1, 5, 1, at("2025-08-14 20:00")), (1, 6, 1, at("2025-08-14 01:00"))])
    instants = actions.select("*", F.unix_micros("occurred_at").alias("us"))
    fixed = spark.createDataFrame(
        [(r.customer_id, r.item_id, r.action_type, r.us) for r in instants.collect()],
        "customer_id bigint, item_id int, action_type int, us bigint",
    ).withColumn("occurred_at", F.timestamp_micros("us"))
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        got = collected(
            build_histories_for_impressions(
                fixed, contexts_df(spark, [(DAY, 1), (date(2025, 8, 16), 1)]), max_actions=2, lookback_days=1
            )
        )
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    # 20:00 UTC on the 14th is the 15th in Tokyo.
    assert got == {(DAY, 1): ([6, 0], [1, 0]), (date(2025, 8, 16), 1): ([5, 0], [1, 0])}


def test_pad_array(spark):
    df = spark.createDataFrame(
        [(1, [1, 2]), (2, [1, 2, 3, 4]), (3, []), (4, None), (5, [None, 7])], "id int, a array<int>"
    )
    got = {r.id: r.p for r in df.select("id", pad_array(F.col("a"), 3, 0).alias("p")).collect()}
    assert got == {1: [1, 2, 0], 2: [1, 2, 3], 3: [0, 0, 0], 4: None, 5: [None, 7, 0]}
