"""Column helpers shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-9
MONEY = "decimal(28,8)"
#: Amounts of this size and more are invalid: sums of smaller ones fit MONEY.
MOST_AMOUNT = 1e15

MINUTE_US = 60 * 1_000_000
HOUR_US = 60 * MINUTE_US
DAY_US = 24 * HOUR_US


def valid_number(value: Column) -> Column:
    """`value`, null if it is NaN, infinite or too large to be summed exactly."""
    return F.when(F.abs(value) < MOST_AMOUNT, value)  # NaN is more than any number


def money_sum(amount: Column, when: Column | None = None) -> Column:
    """Order-independent sum of an amount column, returned as double.

    Summing decimals makes the result identical whatever the partitioning or
    task retries; a double sum would change in its last bits.
    """
    exact = amount.cast(MONEY)
    if when is not None:
        exact = F.when(when, exact)
    return F.coalesce(F.sum(exact).cast("double"), F.lit(0.0))


def ratio(num: Column, den: Column) -> Column:
    """num / (den + eps), the division every feature formula uses."""
    return num.cast("double") / (den.cast("double") + F.lit(EPS))


def safe_div(num: Column, den: Column) -> Column:
    """num / den, 0 where the denominator is 0."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high)))


def flag(cond: Column) -> Column:
    return F.when(cond, F.lit(1)).otherwise(F.lit(0)).cast("int")


def normal_sf2(z: Column) -> Column:
    """Two-sided normal tail probability of |z| (Abramowitz & Stegun 7.1.26).

    Spark SQL has no erf; the absolute error of this rational form is < 1.5e-7.
    """
    x = F.abs(z) / F.lit(2.0**0.5)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.3275911) * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)
