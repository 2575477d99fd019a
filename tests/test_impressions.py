from datetime import date

import pytest
from frames import feeds

from trailpack.operators.impressions import (
    contexts_of,
    explode_impressions,
    normalize_impressions,
    slice_impressions_last_n_days,
)

ITEMS = [(10, True), (11, None)]


def test_both_forms_of_dt(spark):
    raw, *_ = feeds(
        spark,
        impressions=[
            ("2025-08-15", "a", 1, ITEMS),
            ("dt=2025-08-16", "b", 2, ITEMS),
            ("nonsense", "c", 3, None),
            (None, "d", 4, []),
        ],
    )
    out = normalize_impressions(raw)
    assert out.columns == ["as_of_date", "ranking_id", "customer_id", "impressions"]
    assert {r.ranking_id: r.as_of_date for r in out.collect()} == {
        "a": date(2025, 8, 15),
        "b": date(2025, 8, 16),
        "c": None,
        "d": None,
    }
    again = normalize_impressions(out)
    assert again.schema == out.schema
    assert sorted(map(str, again.collect())) == sorted(map(str, out.collect()))


def test_as_of_date_wins_and_is_coerced(spark):
    df = spark.sql(
        "SELECT '2025-01-01' AS dt, '2025-08-15' AS as_of_date, 5 AS ranking_id, '7' AS customer_id, "
        "array(named_struct('item_id', 1, 'is_order', true)) AS impressions"
    )
    out = normalize_impressions(df)
    assert out.dtypes[:3] == [("as_of_date", "date"), ("ranking_id", "string"), ("customer_id", "bigint")]
    assert tuple(out.first())[:3] == (date(2025, 8, 15), "5", 7)


def test_neither_column(spark):
    df = spark.createDataFrame([("r", 1)], "ranking_id string, customer_id int")
    with pytest.raises(ValueError, match="expected either 'dt' or 'as_of_date'"):
        normalize_impressions(df)


def test_strict_raises_on_bad_day(spark):
    raw, *_ = feeds(spark, impressions=[("nonsense", "c", 3, None)])
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        normalize_impressions(raw, strict=True).collect()


def test_explode(spark):
    raw, *_ = feeds(
        spark,
        impressions=[
            ("2025-08-15", "a", 1, ITEMS),
            ("2025-08-15", "b", 1, []),
            ("2025-08-15", "c", 1, None),
            ("2025-08-15", "d", None, [None]),
        ],
    )
    out = explode_impressions(raw)
    assert out.dtypes[3:] == [("impression_item_id", "int"), ("is_order", "boolean")]
    assert sorted((r.ranking_id, r.impression_item_id, r.is_order) for r in out.collect() if r.ranking_id == "a") == [
        ("a", 10, True),
        ("a", 11, None),
    ]
    assert [(r.ranking_id, r.impression_item_id) for r in out.where("ranking_id <> 'a'").collect()] == [("d", None)]


def test_contexts_are_distinct(spark):
    raw, *_ = feeds(
        spark, impressions=[("2025-08-15", "a", 1, ITEMS), ("dt=2025-08-15", "b", 1, ITEMS), (None, "c", 1, [])]
    )
    got = contexts_of(normalize_impressions(raw)).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(date(2025, 8, 15), 1), (None, 1)], key=str)


@pytest.mark.parametrize("days, kept", [(1, {"d"}), (2, {"c", "d"}), (5, {"b", "c", "d"}), (6, {"a", "b", "c", "d"})])
def test_last_days(spark, days, kept):
    raw, *_ = feeds(
        spark,
        impressions=[
            ("2025-08-10", "a", 1, ITEMS),
            ("dt=2025-08-11", "b", 1, ITEMS),
            ("2025-08-14", "c", 1, ITEMS),
            ("dt=2025-08-15", "d", 1, ITEMS),
            ("nonsense", "e", 1, ITEMS),
        ],
    )
    out = slice_impressions_last_n_days(raw, days)
    assert out.columns == raw.columns
    assert {r.ranking_id for r in out.collect()} == kept
    again = slice_impressions_last_n_days(normalize_impressions(raw), days)
    assert {r.ranking_id for r in again.collect()} == kept


def test_last_days_of_nothing(spark):
    raw, *_ = feeds(spark)
    assert slice_impressions_last_n_days(raw, 3).count() == 0
