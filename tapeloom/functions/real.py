"""Division and logarithm as IEEE 754 has them: a price of zero gives an infinity or NaN, not a missing value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY, NAN = float("inf"), float("nan")


def _c(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("double")


def divide(a: Column | str, b: Column | str) -> Column:
    """a / b; over zero an infinity of a's sign, 0 / 0 is NaN. Null only where a or b is."""
    a, b = _c(a), _c(b)
    undefined = (a == 0) | F.isnan(a)
    over_zero = F.when(undefined, NAN).when(a > 0, INFINITY).when(a < 0, -INFINITY)
    return F.when(b == 0, over_zero).otherwise(F.try_divide(a, b))


def ln_ratio(a: Column | str, b: Column | str) -> Column:
    """Natural logarithm of a / b: minus infinity where that is zero, infinite over zero, NaN below zero.

    Give plain columns: each is written several times.
    """
    a, b = _c(a), _c(b)
    return (
        F.when(F.isnan(a) | F.isnan(b), NAN)
        .when(((a > 0) & (b > 0)) | ((a < 0) & (b < 0)), F.log(F.try_divide(a, b)))
        .when((a > 0) & (b == 0), INFINITY)
        .when((a == 0) & (b != 0), -INFINITY)
        .when(a.isNotNull() & b.isNotNull(), NAN)
    )


def rounded(value: Column | str, digits: int) -> Column:
    """``value`` to so many decimals as the SQL rounds: scaled, half away from zero, scaled back.

    Spark's own ``round`` reads the number's shortest decimal instead, so a double just beside a tie may go the other way.
    """
    scale = float(10**digits)
    return F.round(_c(value) * scale) / scale


def sign(value: Column | str) -> Column:
    """-1, 0 or 1; 0 for NaN."""
    v = _c(value)
    return F.when(F.isnan(v), 0.0).otherwise(F.signum(v))
