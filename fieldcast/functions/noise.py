"""Counter-based random numbers.

A variate is a pure function of (seed, identifying parts), so a forecast does
not depend on partitioning, row order, task retries or a lost executor.  Each
md5 digest yields disjoint 48-bit lanes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

LANE_DIGITS = 12
LANE_SPAN = float(2**48)


def digest(seed: int, *parts: Column) -> Column:
    text = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.md5(text)


def lane(hexdigest: Column, index: int = 0) -> Column:
    """Uniform in (0, 1) from lane 0 or 1 of a digest."""
    digits = F.substring(hexdigest, 1 + LANE_DIGITS * index, LANE_DIGITS)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / LANE_SPAN


def uniform(seed: int, *parts: Column) -> Column:
    return lane(digest(seed, *parts))


def normal_from_digest(hexdigest: Column) -> Column:
    """Standard normal (Box-Muller) from the two lanes of one digest."""
    radius = F.sqrt(F.lit(-2.0) * F.log(lane(hexdigest, 0)))
    return radius * F.cos(F.lit(2.0 * math.pi) * lane(hexdigest, 1))


def normal(seed: int, *parts: Column) -> Column:
    return normal_from_digest(digest(seed, *parts))


def poisson_from_uniform(rate: Column, u: Column) -> Column:
    """Poisson count by inverting the distribution function at ``u``, for rates up to a few hundred.

    The fold runs far enough into the tail that the missing mass is below one
    lane step; its length grows with the rate.
    """
    # the rate and the uniform ride in the accumulator: inside the fold they
    # would be evaluated again at every step
    start = F.struct(
        F.exp(-rate).alias("p"),
        F.exp(-rate).alias("cum"),
        F.lit(0).alias("count"),
        rate.alias("rate"),
        u.alias("u"),
    )
    last = F.ceil(rate + 10.0 * F.sqrt(rate) + 20.0).cast("int")

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * acc["rate"] / k
        return F.struct(
            p.alias("p"),
            (acc["cum"] + p).alias("cum"),
            (acc["count"] + (acc["cum"] < acc["u"]).cast("int")).alias("count"),
            acc["rate"].alias("rate"),
            acc["u"].alias("u"),
        )

    return F.aggregate(
        F.sequence(F.lit(1), last),
        start,
        step,
        lambda acc: acc["count"].cast("bigint"),
    )


# Constants of the transformed rejection with squeeze for Poisson
# variates (W. Hoermann, 1993), valid from a rate of 10 on.
WIDTH = (0.931, 2.53)
HEIGHT = (-0.059, 0.02483)
INVERSE_ALPHA = (1.1239, 1.1328, 3.4)
SQUEEZE = (0.9277, 3.6224, 2.0)
CENTRE = 0.43
INSIDE, CORNER = 0.07, 0.013

#: rates below are inverted, others drawn by rejection
REJECTION_FROM = 10.0
#: proposals of one count; each is taken with a chance of 0.8 at least
PROPOSALS = 60
#: counts of larger rates don't fit a long
LARGEST = 9.0e18
#: counts up to here have their factorial, others the Stirling series
EXACT_FACTORIAL = 20


def poisson_log_mass(count: Column, rate: Column) -> Column:
    """Log probability of a count, without cancellation where both are large."""
    above = count - rate
    deviance = count * F.log1p(above / rate) - above
    series = 1.0 / (12.0 * count) - 1.0 / (360.0 * count * count * count)
    few = F.least(count, F.lit(float(EXACT_FACTORIAL))).cast("int")
    return F.when(
        count <= EXACT_FACTORIAL, count * F.log(rate) - rate - F.log(F.factorial(few))
    ).otherwise(-deviance - series - 0.5 * F.log(2.0 * math.pi * count))


def _inner(value: Column, function) -> Column:
    """``function(value)``, with the value evaluated once."""
    return F.element_at(F.transform(F.array(value), function), 1)


def _poisson_by_rejection(rate: Column, seed: int, *ids: Column) -> Column:
    """Proposals from a transformed uniform until one is taken; the work doesn't depend on the rate."""
    width = F.lit(WIDTH[0]) + WIDTH[1] * F.sqrt(rate)
    start = F.struct(F.lit(None).cast("double").alias("count"), rate.alias("rate"), width.alias("b"))

    def propose(acc: Column, number: Column) -> Column:
        b, mu = acc["b"], acc["rate"]
        a = F.lit(HEIGHT[0]) + HEIGHT[1] * b

        def judge(p: Column) -> Column:
            us, v, k = p["us"], p["v"], p["k"]
            squeezed = (us >= INSIDE) & (v <= F.lit(SQUEEZE[0]) - F.lit(SQUEEZE[1]) / (b - SQUEEZE[2]))
            outside = (k < 0) | ((us < CORNER) & (v > us))
            hat = F.log(v) + F.log(F.lit(INVERSE_ALPHA[0]) + F.lit(INVERSE_ALPHA[1]) / (b - INVERSE_ALPHA[2]))
            under = hat - F.log(a / (us * us) + b) <= poisson_log_mass(k, mu)
            return F.when(squeezed, k).when(~outside & under, k)

        def place(p: Column) -> Column:
            us = F.lit(0.5) - F.abs(p["u"])
            k = F.floor((2.0 * a / us + b) * p["u"] + mu + CENTRE).cast("double")
            return _inner(F.struct(us.alias("us"), p["v"].alias("v"), k.alias("k")), judge)

        def lanes(hexdigest: Column) -> Column:
            pair = F.struct((lane(hexdigest, 0) - 0.5).alias("u"), lane(hexdigest, 1).alias("v"))
            return _inner(pair, place)

        proposal = _inner(digest(seed, *ids, F.lit("y"), number), lanes)
        taken = F.struct(proposal.alias("count"), mu.alias("rate"), b.alias("b"))
        return F.when(acc["count"].isNotNull(), acc).otherwise(taken)

    return F.aggregate(
        F.sequence(F.lit(0), F.lit(PROPOSALS - 1)),
        start,
        propose,
        lambda acc: F.coalesce(acc["count"], F.raise_error(F.lit("no proposal was taken")).cast("double")).cast("bigint"),
    )


def poisson(rate: Column, seed: int, *ids: Column) -> Column:
    """Exact Poisson count of any rate, in time that doesn't grow with the rate.

    Null and NaN rates give null, and so do infinite ones and those whose
    counts don't fit a long.  Beyond 2**53 counts have the spacing of doubles.
    """
    known = F.when(~F.isnan(rate) & (rate < LARGEST), rate)
    small = F.when(known < REJECTION_FROM, known)
    large = F.when(known >= REJECTION_FROM, known)
    return F.when(
        known < REJECTION_FROM,
        poisson_from_uniform(small, lane(digest(seed, *ids, F.lit("y")), 0)),
    ).when(known >= REJECTION_FROM, _poisson_by_rejection(large, seed, *ids))


# Published rational approximation of the normal quantile
# (P. J. Acklam), relative error below 1.15e-9.
CENTRAL_NUM = (
    -3.969683028665376e01,
    2.209460984245205e02,
    -2.759285104469687e02,
    1.383577518672690e02,
    -3.066479806614716e01,
    2.506628277459239e00,
)
CENTRAL_DEN = (
    -5.447609879822406e01,
    1.615858368580409e02,
    -1.556989798598866e02,
    6.680131188771972e01,
    -1.328068155288572e01,
    1.0,
)
TAIL_NUM = (
    -7.784894002430293e-03,
    -3.223964580411365e-01,
    -2.400758277161838e00,
    -2.549732539343734e00,
    4.374664141464968e00,
    2.938163982698783e00,
)
TAIL_DEN = (
    7.784695709041462e-03,
    3.224671290700398e-01,
    2.445134137142996e00,
    3.754408661907416e00,
    1.0,
)
TAIL_START = 0.02425


def horner(x: Column, coefficients: tuple[float, ...]) -> Column:
    total = F.lit(coefficients[0])
    for c in coefficients[1:]:
        total = total * x + F.lit(c)
    return total


def normal_quantile(p: Column) -> Column:
    """Inverse of the standard normal distribution function."""
    q = p - 0.5
    central = q * horner(q * q, CENTRAL_NUM) / horner(q * q, CENTRAL_DEN)
    low = F.sqrt(-2.0 * F.log(p))
    high = F.sqrt(-2.0 * F.log(1.0 - p))
    return (
        F.when(p < TAIL_START, horner(low, TAIL_NUM) / horner(low, TAIL_DEN))
        .when(p > 1.0 - TAIL_START, -horner(high, TAIL_NUM) / horner(high, TAIL_DEN))
        .otherwise(central)
    )
