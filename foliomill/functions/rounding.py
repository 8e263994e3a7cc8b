"""Rounding as Python does it: on the exact binary value, ties to even. Columns only, no UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = 134217729.0  # 2**27 + 1


def _halves(x: Column) -> tuple[Column, Column]:
    big = x * _SPLIT
    high = big - (big - x)
    return high, x - high


def py_round_once(x: Column, places: int) -> Column:
    """As `py_round`, for an x that costs more than an operation or two: it is computed once, not at each place that the formula names it."""
    return F.get(F.transform(F.array(x.cast("double")), lambda v: py_round(v, places)), F.lit(0))


def py_round(x: Column, places: int) -> Column:
    """Python's round(x, places) for |x| below about 1e9.

    Half-up rounding of the shortest decimal form is right unless that form ends in a 5 just after the last
    place. There the exact product with a power of ten (Dekker's two-product) tells on which side of the tie the value lies.
    """
    x = x.cast("double")
    scale = float(10 ** (places + 1))
    product = x * scale
    xh, xl = _halves(x)
    sh, sl = _halves(F.lit(scale))
    error = ((xh * sh - product) + xh * sl + xl * sh) + xl * sl
    near = F.rint(product)
    gap = (product - near) + error
    low, high = (near - 5) / 10, (near + 5) / 10
    tie = (F.abs(gap) < 1e-6) & (F.abs(near % 10) == 5)
    whole = F.when(gap < 0, low).when(gap > 0, high).when(low % 2 == 0, low).otherwise(high)
    return F.when(tie, whole / float(10**places)).otherwise(F.round(x, places))
