"""Rounding of binary fractions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hundredths(value: Column) -> Column:
    """``value`` to two places by what the double really holds, as Python's ``round`` does; a true tie goes to the even digit.

    2.675 is stored a little below itself and gives 2.67. The distance to the tie is exact: the value is split where both halves times
    200 fit a double.
    """
    low = F.floor(value * 100)
    high_half = F.floor(value * 2**20) / 2**20
    over = (high_half * 200 - (2 * low + 1)) + (value - high_half) * 200
    return (low + F.when(over > 0, 1).when(over < 0, 0).otherwise(low % 2)) / F.lit(100.0)
