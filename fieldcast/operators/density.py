"""Log likelihood and log prior of draws as column expressions and sums."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F


def log_factorial(y: Column) -> Column:
    """``ln(y!)``: a product up to 20, the Stirling series beyond."""
    n = y.cast("double")
    series = (
        n * F.log(n)
        - n
        + 0.5 * F.log(2.0 * math.pi * n)
        + 1.0 / (12.0 * n)
        - 1.0 / (360.0 * n * n * n)
        + 1.0 / (1260.0 * F.pow(n, F.lit(5.0)))
    )
    return F.when(y <= 20, F.log(F.factorial(F.least(y, F.lit(20)).cast("int")))).otherwise(
        series
    )


def poisson_log_density(y: Column, log_rate: Column) -> Column:
    """Poisson log density with a log link; null counts contribute nothing."""
    return F.when(
        y.isNotNull(), y * log_rate - F.exp(log_rate) - log_factorial(y)
    ).otherwise(0.0)


def log_likelihood(rows: DataFrame, keys: list[str], y: str, log_rate: str) -> DataFrame:
    """Summed log likelihood per key; partial sums are combined map side."""
    return rows.groupBy(*keys).agg(
        F.sum(poisson_log_density(F.col(y), F.col(log_rate))).alias("loglik")
    )


def student_t_log_density(x: Column, df: float, scale: float = 1.0) -> Column:
    constant = (
        math.lgamma((df + 1) / 2)
        - math.lgamma(df / 2)
        - 0.5 * math.log(df * math.pi)
        - math.log(scale)
    )
    z = x / scale
    return F.lit(constant) - (df + 1) / 2 * F.log1p(z * z / df)


def normal_log_density(x: Column) -> Column:
    return F.lit(-0.5 * math.log(2.0 * math.pi)) - 0.5 * x * x


def scalar_log_prior(scale_df: float) -> Column:
    """Prior of the six scalars: t for the scales (5 or 3 degrees of freedom),
    t(3, 0, 1) for the slope, t(3, 0, 10) for the intercept."""
    total = student_t_log_density(F.col("b_ar"), 3.0) + student_t_log_density(
        F.col("intercept"), 3.0, 10.0
    )
    for s in ("s_z", "s_s", "s_r", "s_t"):
        total = total + student_t_log_density(F.col(s), scale_df)
    return total


def innovation_log_prior(*arrays: str) -> Column:
    """Standard normal density summed over innovation arrays of one row."""
    total = F.lit(0.0)
    for name in arrays:
        total = total + F.aggregate(
            F.col(name), F.lit(0.0), lambda acc, e: acc + normal_log_density(e)
        )
    return total
