import random
from datetime import date, datetime, timedelta

import pytest
from frames import actions_df, at, collected, contexts_df, model_histories

from trailpack.operators.histories import build_histories_for_impressions, packed_histories
from trailpack.operators.runs import newest_heads

DAY = date(2025, 8, 15)


def model(actions, contexts, n, days):
    """Runs collapsed in each context's whole window, then the newest N."""
    out = {}
    for key, (items, types) in model_histories(actions, contexts, 10_000, days).items():
        kept = []
        for pair in zip(items, types, strict=True):
            if pair[1] and (not kept or kept[-1] != pair):
                kept.append(pair)
        kept = kept[:n] + [(0, 0)] * (n - len(kept))
        out[key] = ([i for i, _ in kept], [t for _, t in kept])
    return out


def built(spark, actions, contexts, n, days, parts=1, **options):
    frame = actions_df(spark, actions).repartition(parts)
    got = build_histories_for_impressions(
        frame, contexts_df(spark, contexts), max_actions=n, lookback_days=days, drop_repeats=True, **options
    )
    return collected(got)


def test_newest_of_a_run_stays_and_types_tell_runs_apart(spark):
    actions = [(1, 5, 1, at("2025-08-14 09:00")), (1, 5, 1, at("2025-08-14 08:00")), (1, 5, 2, at("2025-08-14 07:00"))]
    actions += [(1, 5, 1, at("2025-08-14 06:00")), (1, None, 1, at("2025-08-14 05:00")), (1, None, 1, at("2025-08-14 04:00"))]
    assert built(spark, actions, [(DAY, 1)], 5, 7) == {(DAY, 1): ([5, 5, 5, None, 0], [1, 2, 1, 1, 0])}
    timed = packed_histories(
        actions_df(spark, actions), contexts_df(spark, [(DAY, 1)]), max_actions=5, lookback_days=7, drop_repeats=True, keep_times=True
    ).first()
    assert [t.hour for t in timed.action_times] == [9, 7, 6, 5]


def test_a_run_across_days_starts_anew_for_each_context(spark):
    actions = [(1, 5, 1, datetime(2025, 8, d, 10)) for d in (10, 11, 12)] + [(1, 6, 1, at("2025-08-09 10:00"))]
    contexts = [(date(2025, 8, d), 1) for d in (11, 12, 13, 20)]
    assert built(spark, actions, contexts, 3, 30) == dict.fromkeys([(d, 1) for d, _ in contexts], ([5, 6, 0], [1, 1, 0]))


def test_copies_of_one_action_are_one(spark):
    actions = [(1, 5, 1, at("2025-08-14 10:00"))] * 500 + [(1, 6, 1, at("2025-08-14 09:00"))]
    heads = newest_heads(actions_df(spark, actions), 3)
    assert heads.count() == 2
    assert built(spark, actions, [(DAY, 1)], 3, 7, parts=5) == {(DAY, 1): ([5, 6, 0], [1, 1, 0])}


@pytest.mark.parametrize("seed", range(6))
def test_random_cases(spark, seed):
    """Runs across map tasks, slices of a day and days, at every length of history."""
    rng = random.Random(seed)
    start = datetime(2025, 8, 1)
    actions = []
    for _ in range(400):
        customer = rng.choice([1, 1, 1, 2, 3])
        when = start + timedelta(minutes=rng.choice([0, 30, 719, 720, 1439]) if seed % 2 else rng.randrange(1440), days=rng.randrange(9))
        actions.append((customer, rng.choice([7, 7, 7, 8, None]), rng.choice([1, 1, 1, 3]), when))
    contexts = [(date(2025, 8, d), c) for d in range(1, 12) for c in (1, 2, 3) if rng.random() < 0.8]
    n, days = rng.choice([(1, 3), (2, 20), (4, 2), (7, 5), (60, 9)])
    want = model(actions, contexts, n, days)
    assert built(spark, actions, contexts, n, days, parts=4, salts=rng.choice([1, 3, 32])) == want
