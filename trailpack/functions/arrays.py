"""Array expressions: fixed-length padding and readable action tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels by action code.
ACTION_LABELS = {0: "pad", 1: "click", 2: "atc", 3: "order"}
UNKNOWN_LABEL = "unk"
TOKEN_WIDTH = 12


def pad_array(arr: Column, size: int, fill_value) -> Column:
    """Cut or right-pad an array to exactly ``size`` elements; a null array stays null."""
    missing = F.lit(size) - F.size(arr)
    filled = F.concat(arr, F.array_repeat(F.lit(fill_value), missing))
    return F.when(missing > 0, filled).otherwise(F.slice(arr, 1, size))


def action_type_name(code: Column) -> Column:
    label = F.lit(UNKNOWN_LABEL)
    for value, name in ACTION_LABELS.items():
        label = F.when(code == F.lit(value), F.lit(name)).otherwise(label)
    return label


def action_token(item: Column, code: Column, width: int = TOKEN_WIDTH) -> Column:
    """``1585:click``, filled with blanks to ``width`` characters."""
    return F.rpad(F.concat(item.cast("string"), F.lit(":"), action_type_name(code)), width, " ")
