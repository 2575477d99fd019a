"""The flagship plan: four feeds in, training inputs out."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame

from ..operators.actions import build_actions_union
from ..operators.examples import attach_histories
from ..operators.histories import DEFAULT_SALTS, packed_histories, pad_histories
from ..operators.impressions import explode_items, normalize_impressions
from ..schemas import DEFAULT_LOOKBACK_DAYS, DEFAULT_MAX_ACTIONS


def unpadded_inputs(
    impressions: DataFrame,
    actions: DataFrame,
    *,
    max_actions: int,
    lookback_days: int,
    salts: int = DEFAULT_SALTS,
    as_of_range: tuple[date, date] | None = None,
    keep_days: bool = False,
) -> DataFrame:
    """Normalised impressions with arrays as long as the history is: cheap to shuffle."""
    histories = packed_histories(
        actions,
        impressions,
        max_actions=max_actions,
        lookback_days=lookback_days,
        salts=salts,
        as_of_range=as_of_range,
        keep_days=keep_days,
    )
    return attach_histories(impressions, histories)


def finish_inputs(unpadded: DataFrame, max_actions: int, explode: bool) -> DataFrame:
    """Pad and, if asked for, give one row per item: both without a shuffle."""
    padded = pad_histories(unpadded, max_actions)
    return explode_items(padded, "actions", "action_types") if explode else padded


def build_training_inputs(
    impressions_df: DataFrame,
    clicks_df: DataFrame,
    atc_df: DataFrame,
    orders_df: DataFrame,
    *,
    max_actions: int = DEFAULT_MAX_ACTIONS,
    lookback_days: int = DEFAULT_LOOKBACK_DAYS,
    explode: bool = False,
    salts: int = DEFAULT_SALTS,
    as_of_range: tuple[date, date] | None = None,
    strict: bool = False,
) -> DataFrame:
    """Impressions with the last ``max_actions`` actions of the ``lookback_days`` days before.

    ``as_of_range`` is the first and last impression day, if the caller knows them; otherwise they
    are looked up in the impressions when the plan runs. ``strict`` raises on values that do not
    parse, where the default makes them null.
    """
    unpadded = unpadded_inputs(
        normalize_impressions(impressions_df, strict=strict),
        build_actions_union(clicks_df, atc_df, orders_df, strict=strict),
        max_actions=max_actions,
        lookback_days=lookback_days,
        salts=salts,
        as_of_range=as_of_range,
    )
    return finish_inputs(unpadded, max_actions, explode)
