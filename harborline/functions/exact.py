"""Sums and means that do not depend on the order of the rows.

Floating-point sums differ in their last digits with partitioning and retries.
These add fixed-point decimals, so any plan gives the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

FIXED = "decimal(18,6)"


def fixed(c: Column) -> Column:
    return c.cast(FIXED)


def exact_sum(c: Column) -> Column:
    return F.sum(fixed(c)).cast("double")


def wide_mean(c: Column) -> Column:
    """Mean of values of any size, infinite ones included.

    Values that all fit the fixed-point type are added exactly; else the sum is a
    plain one of doubles, where an infinite value makes the mean infinite.
    """
    fits = F.coalesce(F.max(F.abs(c)) < 1e12, F.lit(True))
    exact = F.sum(c.try_cast(FIXED)).cast("double")
    return F.try_divide(F.when(fits, exact).otherwise(F.sum(c)), F.count(c))


def exact_mean(c: Column) -> Column:
    """Mean over the non-NULL values; NULL when there are none."""
    return F.try_divide(exact_sum(c), F.count(c))


def rounded(c: Column, digits: int) -> Column:
    """Round half away from zero on the decimal value, free of binary noise at ties.

    Values beyond the decimal's range have no such digits in a double and stay as they are.
    """
    return F.coalesce(F.round(c.try_cast("decimal(28,10)"), digits).cast("double"), c.cast("double"))


def share(cond: Column) -> Column:
    """Share of rows for which the condition is true; NULL counts as false."""
    return F.count_if(cond) / F.count(F.lit(1))
