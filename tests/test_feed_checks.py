import random
from collections import defaultdict
from datetime import date, datetime, timedelta

import pytest
from frames import actions_df, at, normalised
from pyspark.sql import functions as F

from trailpack.operators.consistency import orders_without_prior_action, signs_before_orders
from trailpack.operators.time_order import judged_rows, segments, time_order_report, placed

# Time order --------------------------------------------------------------------------------------

START = datetime(2025, 8, 1)


def feed(spark, rows):
    """rows: (file, row, customer, time)"""
    return spark.createDataFrame(rows, "file string, row bigint, customer_id bigint, at timestamp")


def report(spark, rows, piece_rows, parts=3):
    found = time_order_report(
        feed(spark, rows).repartition(parts), customer="customer_id", time="at", position=(F.col("file"), F.col("row")), piece_rows=piece_rows
    )
    return {r.customer_id: tuple(r)[1:] for r in found.collect()}


def model(rows):
    out = defaultdict(lambda: [0, 0, 0, 0, 0])
    reached, ended = {}, {}
    for _, _, customer, when in sorted(rows, key=lambda r: r[:2]):
        own = out[customer]
        own[0] += 1
        if when is None:
            own[1] += 1
            continue
        if customer in reached and when < reached[customer]:
            own[2] += 1
            own[4] = max(own[4], (reached[customer] - when) // timedelta(microseconds=1))
        own[3] += customer in ended and when < ended[customer]
        reached[customer] = max(when, reached.get(customer, when))
        ended[customer] = when
    return {c: tuple(v) for c, v in out.items() if v[1] or v[2]}


@pytest.mark.parametrize("piece_rows", [1, 3, 7, 1000])
def test_any_cut_into_pieces_gives_the_same_report(spark, piece_rows):
    rng = random.Random(piece_rows)
    rows, clock = [], 0
    for file in ("a", "b", "c"):
        for row in range(80):
            clock += rng.choice([0, 1, 1, -4 if rng.random() < 0.2 else 2])
            when = None if rng.random() < 0.05 else START + timedelta(seconds=clock)
            rows.append((file, row, rng.choice([1, 1, 1, 2, 3, None]), when))
    rows += [("d", i, 9, START + timedelta(seconds=i)) for i in range(10)]  # in order
    found = report(spark, rows, piece_rows)
    assert found == model(rows) and 9 not in found and None in found


def test_rows_are_judged_one_by_one(spark):
    rows = [("a", 0, 1, START), ("a", 1, 1, START + timedelta(hours=2)), ("b", 0, 1, START + timedelta(hours=1)), ("b", 1, 1, START + timedelta(hours=1, seconds=1))]
    judged = judged_rows(feed(spark, rows), customer="customer_id", time="at", position=(F.col("file"), F.col("row")), piece_rows=1)
    got = {(r.piece.file, r.row): (r.late_micros, r.steps_back) for r in judged.collect()}
    assert got == {("a", 0): (None, False), ("a", 1): (None, False), ("b", 0): (3_600_000_000, True), ("b", 1): (3_599_000_000, False)}


def test_files_are_read_in_their_own_order(spark, tmp_path):
    data = feed(spark, [("x", 0, 1, START + timedelta(hours=h)) for h in (1, 3, 2, 4)]).coalesce(1)
    data.write.parquet(str(tmp_path / "feed"))
    found = time_order_report(spark.read.parquet(str(tmp_path / "feed")), customer="customer_id", time="at").collect()
    assert [tuple(r) for r in found] == [(1, 4, 0, 1, 1, 3_600_000_000)]
    assert time_order_report(spark.read.parquet(str(tmp_path / "feed")).where("false"), customer="customer_id", time="at").collect() == []


def test_a_hot_customer_is_one_segment_per_piece(spark):
    hot = spark.range(10_000).select(F.lit("f").alias("file"), F.col("id").alias("row"), F.lit(1).alias("customer_id"), F.timestamp_seconds("id").alias("at"))
    rows = placed(hot, "customer_id", "at", (F.col("file"), F.col("row")), 1000)
    assert segments(rows).count() == 10


# Orders and what came before them ----------------------------------------------------------------


def shown_rows(spark, rows):
    """rows: (day, customer, item)"""
    return normalised(spark, [(d, f"r{i}", c, [(item, False)]) for i, (d, c, item) in enumerate(rows)])


def test_latest_sign_per_feed(spark):
    actions = actions_df(
        spark,
        [(1, 5, 3, at("2025-08-15 00:00"))] * 2
        + [(1, 5, 1, at("2025-08-10 09:00")), (1, 5, 1, at("2025-08-13 09:00")), (1, 5, 1, at("2025-08-16 09:00"))]
        + [(1, 5, 2, at("2025-08-15 23:00")), (1, 6, 1, at("2025-08-14 09:00")), (2, 5, 1, at("2025-08-14 09:00"))],
    )
    got = signs_before_orders(actions, shown_rows(spark, [("2025-08-01", 1, 5)])).collect()
    assert [tuple(r) for r in got] == [(1, 5, date(2025, 8, 15), 2, 2, 0, 14, 0)]


def test_orders_without_keys_are_missing_and_signs_without_keys_are_none(spark):
    actions = actions_df(
        spark,
        [(None, 5, 3, at("2025-08-15 00:00")), (1, None, 3, at("2025-08-15 00:00")), (1, 5, 3, None), (1, 7, 3, at("2025-08-15 00:00"))]
        + [(None, 5, 1, at("2025-08-14 00:00")), (1, None, 1, at("2025-08-14 00:00")), (1, 5, 1, at("2025-08-14 00:00"))],
    )
    shown = shown_rows(spark, [("2025-08-15", None, 5)])
    assert {r.lag_days for r in signs_before_orders(actions, shown).collect()} == {None}
    got = {r.day: (r.orders, r.without_prior, r.same_day, r.longest_lag) for r in orders_without_prior_action(actions, shown).collect()}
    assert got == {date(2025, 8, 15): (3, 3, 0, None), None: (1, 1, 0, None)}


def test_no_orders_no_rows(spark):
    actions = actions_df(spark, [(1, 5, 1, at("2025-08-14 00:00"))])
    assert orders_without_prior_action(actions, shown_rows(spark, [("2025-08-15", 1, 5)])).collect() == []


def test_a_hot_pair_is_one_row_per_day(spark):
    from test_plans import plan

    actions = actions_df(spark, [(1, 5, 1, at("2025-08-14 00:00"))])
    text = plan(signs_before_orders(actions, shown_rows(spark, [("2025-08-15", 1, 5)])))
    assert text.index("Window") < text.index("HashAggregate") and "Join" not in text
