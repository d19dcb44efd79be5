"""Statistics with the small-sample corrections Spark's own aggregates leave out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(x: Column, digits: int) -> Column:
    """Rounded to ``digits``, halves to the even neighbour of the scaled value."""
    return F.rint(x * 10.0 ** digits) / 10.0 ** digits


def steady_avg(x: Column) -> Column:
    """The average by an exact sum of ten decimal digits, which no order of the rows changes in its last bits.

    Where a value doesn't fit (1e18 and more, not finite) it is the plain average.
    """
    exact = x.try_cast("decimal(28,10)")
    return F.when(F.count(exact) == F.count(x), F.try_sum(exact).cast("double") / F.count(x)).otherwise(F.avg(x))


def sample_skewness(x: Column) -> Column:
    n = F.count(x).cast("double")
    return F.when(n > 2, F.coalesce(F.skewness(x), F.lit(0.0)) * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(x: Column) -> Column:
    """Excess kurtosis (a normal sample gives about 0, a constant column exactly 0)."""
    n = F.count(x).cast("double")
    value = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6)
    return F.when(n > 3, F.coalesce(value, F.lit(0.0)))


def pearson_kurtosis(x: Column) -> Column:
    return sample_kurtosis(x) + 3


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation over rows with both values; NULL where either is constant (``corr`` fails there)."""
    px, py = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(px) * F.stddev_pop(py))


def ks_pvalue(d: Column, n: Column, m: Column) -> Column:
    """Asymptotic two-sample p-value with Stephens' small-sample correction.

    An approximation of the exact distribution, which needs path counting per (n, m).
    """
    e = F.sqrt(n * m / (n + m))
    lam = (e + F.lit(0.12) + F.lit(0.11) / e) * d
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)),
        F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(F.lit(-2.0) * k * k * lam * lam),
    )
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series * 2)))


def r_squared(err_sq: Column, centred_sq: Column) -> Column:
    """1 - SSE/SST; a constant target scores 1 when hit exactly, else 0."""
    return F.when(centred_sq > 0, 1 - err_sq / centred_sq).otherwise(F.when(err_sq == 0, 1.0).otherwise(0.0))
