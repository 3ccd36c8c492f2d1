"""Rounding of doubles by their exact binary value, ties to even, with built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Splits a double into two halves of 26 bits.
SPLIT = float((1 << 27) + 1)


def round_exact(x: Column, digits: int = 3) -> Column:
    """The double nearest to ``x`` rounded to ``digits`` decimals; of two equally near ones that with an even last digit.

    Half a unit above a candidate is compared with x without an error: x is split into halves whose products with a small
    whole number are exact, and so is their sum's sign. Infinite values, NaN, null and values whose neighbours lie
    farther apart than a unit stay.
    """
    if not 0 <= digits <= 6:
        raise ValueError("digits must be 0 to 6")
    scale = float(10**digits)
    a = F.abs(x)
    high = a * SPLIT - (a * SPLIT - a)
    low = a - high
    n = F.floor(a * scale).cast("double")
    over = (high * (2 * scale) - 2 * n - 1) + low * (2 * scale)
    up = (over > 0) | ((over == 0) & (F.pmod(n, F.lit(2.0)) == 1))
    near = F.when(up, n + 1).otherwise(n) / scale
    return F.when(a < float(1 << 53) / scale, F.when(F.signum(x) < 0, -near).otherwise(near)).otherwise(x)
