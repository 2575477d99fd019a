"""Sequence features on Spark: action histories packed on to impressions."""

from .plans.training import build_training_inputs

__all__ = ["build_training_inputs"]
