from datetime import date

from frames import feeds

from trailpack import build_training_inputs
from trailpack.operators.examples import build_training_examples, join_impressions_with_histories
from trailpack.operators.impressions import normalize_impressions

NESTED = ["as_of_date", "ranking_id", "customer_id", "impressions", "actions", "action_types"]
EXPLODED = [*NESTED[:3], "impression_item_id", "is_order", *NESTED[4:]]


def case(spark):
    return feeds(
        spark,
        impressions=[
            ("2025-08-15", "a", 1, [(10, True), (11, False)]),
            ("dt=2025-08-15", "b", 1, [(12, False)]),
            ("2025-08-15", "c", 2, []),
            ("2025-08-15", "d", None, [(13, False)]),
            ("bad", "e", 1, [(14, False)]),
            ("2025-08-14", "f", 1, None),
        ],
        clicks=[("", 1, 5, "2025-08-14 10:00:00"), ("", None, 6, "2025-08-14 10:00:00")],
        orders=[("2025-08-13", 1, 7)],
    )


def test_nested(spark):
    out = build_training_inputs(*case(spark), max_actions=3, lookback_days=7)
    assert out.columns == NESTED
    got = {r.ranking_id: (r.as_of_date, r.actions, r.action_types) for r in out.collect()}
    day = date(2025, 8, 15)
    assert got == {
        "a": (day, [5, 7, 0], [1, 3, 0]),
        "b": (day, [5, 7, 0], [1, 3, 0]),
        "c": (day, [0, 0, 0], [0, 0, 0]),
        # No day or no customer: nothing to join on, so null arrays rather than zeros.
        "d": (day, None, None),
        "e": (None, None, None),
        "f": (date(2025, 8, 14), [7, 0, 0], [3, 0, 0]),
    }


def test_exploded(spark):
    out = build_training_inputs(*case(spark), max_actions=2, lookback_days=7, explode=True)
    assert out.columns == EXPLODED
    got = sorted((r.ranking_id, r.impression_item_id, r.is_order, r.actions) for r in out.collect())
    assert got == [
        ("a", 10, True, [5, 7]),
        ("a", 11, False, [5, 7]),
        ("b", 12, False, [5, 7]),
        ("d", 13, False, None),
        ("e", 14, False, None),
    ]


def test_defaults(spark):
    out = build_training_inputs(*case(spark))
    assert {len(r.actions) for r in out.where("customer_id = 1 AND as_of_date IS NOT NULL").collect()} == {1000}


def test_given_histories(spark):
    raw, *_ = case(spark)
    histories = spark.createDataFrame(
        [(date(2025, 8, 15), 1, [9], [2])],
        "as_of_date date, customer_id bigint, actions array<int>, action_types array<int>",
    )
    for impressions in (raw, normalize_impressions(raw)):
        out = join_impressions_with_histories(impressions, histories)
        assert out.columns == NESTED
        assert {r.ranking_id: r.actions for r in out.collect()} == {
            "a": [9], "b": [9], "c": None, "d": None, "e": None, "f": None,
        }
    exploded = build_training_examples(raw, histories, explode=True)
    assert exploded.columns == EXPLODED
    assert exploded.count() == 5


def test_as_of_date_only_passes_through(spark):
    """Without dt the impressions are taken as normalised already."""
    histories = spark.sql(
        "SELECT DATE '2025-08-15' AS as_of_date, 1L AS customer_id, array(9) AS actions, array(2) AS action_types"
    )
    impressions = spark.sql(
        "SELECT DATE '2025-08-15' AS as_of_date, 77 AS ranking_id, 1 AS customer_id, 'any' AS impressions"
    )
    for day in ("as_of_date", "CAST(as_of_date AS STRING) AS as_of_date"):
        typed = impressions.selectExpr(day, "ranking_id", "customer_id", "impressions")
        row = join_impressions_with_histories(typed, histories).first()
        assert (row.ranking_id, row.impressions, row.actions) == (77, "any", [9])
