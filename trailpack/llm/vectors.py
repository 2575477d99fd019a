"""Vectors as whole numbers, in blocks of rows: what the operators over embeddings share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole_numbers(vector: Column, scale: int, shift: int = 0) -> Column:
    """floor(scale * c) + shift for each component c, taken as double."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(scale)) + F.lit(shift))


def all_finite(vector: Column) -> Column:
    """A vector with at least one component, and none null, infinite or no number."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite, F.lit(False))


def of_full_length(rows: DataFrame, column: str = "x") -> DataFrame:
    """The rows with as many components as the longest vector; one number reaches the plan, as a subquery."""
    longest = rows.agg(F.max(F.size(column))).scalar()
    return rows.where(F.size(column) == longest)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal lists of long as one matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def summed(df: DataFrame, partial: Callable[[Iterator[pa.RecordBatch]], np.ndarray], parts: int, combine=np.add, fan: int = 256) -> np.ndarray:
    """The sum (or what ``combine`` makes) of ``partial`` over the ``parts`` partitions of ``df``, an array of doubles of bounded size.

    Each task sends one row. They are added up ``fan`` at a time by tasks, and the driver gets one.
    """

    def first(batches):
        found = partial(batches)
        yield pa.record_batch([pa.array([np.ascontiguousarray(found, "<f8").tobytes()], pa.binary())], ["cells"])

    def more(batches):
        total = None
        for batch in batches:
            for cells in batch.column(0):
                cells = np.frombuffer(cells.as_py(), "<f8")
                total = cells if total is None else combine(total, cells)
        if total is not None:
            yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["cells"])

    made = df.mapInArrow(first, "cells binary")
    while parts > 1:
        parts = -(-parts // fan)
        made = made.repartition(parts).mapInArrow(more, "cells binary")
    # Not first(): a limit would end the workers of every pass.
    return np.frombuffer(made.collect()[0]["cells"], "<f8")
