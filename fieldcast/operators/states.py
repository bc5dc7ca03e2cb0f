"""State reconstruction and component decomposition.

Input is one row per (draw, series) with the scalar parameters
``intercept, b_ar, s_z, s_s, s_r, s_t`` and the standardised innovations
``mu_err, b_ope_err, r_raw`` (length T) and ``gamma_err`` (length T - 6), plus
the observed base ``num`` (length T).  Everything stays inside the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldcast.functions import recursions as rec

STATE = ("mu", "b_ope", "gamma", "tvc", "r", "lambda")


def reconstruct(params: DataFrame, variant: str = "smooth") -> DataFrame:
    """Adds ``states``: an array over time of ``mu, b_ope, gamma, tvc, r,
    lambda, delta``.  ``delta`` is the level change, null at the first point.

    ``smooth``  second-order level, all innovations scaled;
    ``ar1``     first-order level, the initial seasonal values and the first
                base coefficient enter unscaled.
    """
    smooth = variant == "smooth"
    level = rec.level_second_order if smooth else rec.level_first_order
    mu = level(F.col("mu_err"), F.col("intercept"), F.col("b_ar"), F.col("s_z"))
    b_ope = rec.random_walk(F.col("b_ope_err"), F.col("s_t"), smooth)
    gamma = rec.seasonal_week(F.col("gamma_err"), F.col("s_s"), smooth)
    r = F.transform("r_raw", lambda e: F.col("s_r") * e)

    def assemble(z: Column) -> Column:
        def at(s: Column, i: Column) -> Column:
            tvc = s["b_ope"] * s["num"]
            return F.struct(
                s["mu"].alias("mu"),
                s["b_ope"].alias("b_ope"),
                s["gamma"].alias("gamma"),
                tvc.alias("tvc"),
                s["r"].alias("r"),
                (s["mu"] + s["gamma"] + tvc + s["r"]).alias("lambda"),
                F.when(i >= 1, s["mu"] - F.get(z, i - 1)["mu"]).alias("delta"),
            )

        return F.transform(z, at)

    parts = F.arrays_zip(
        mu.alias("mu"), b_ope.alias("b_ope"), gamma.alias("gamma"), r.alias("r"),
        F.col("num").alias("num"),
    ).cast(
        "array<struct<mu:double,b_ope:double,gamma:double,r:double,num:double>>"
    )
    return params.withColumn("states", rec.let(parts, assemble))


def explode_states(states: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, t, mu, b_ope, gamma, tvc, r, lambda, delta), one row per time.

    The outer form keeps the optimizer from adding a filter on ``states``,
    which would reconstruct them twice.
    """
    return states.select(*keys, F.posexplode_outer("states").alias("__i", "__s")).select(
        *keys,
        (F.col("__i") + 1).alias("t"),
        *[F.col("__s")[s].alias(s) for s in (*STATE, "delta")],
    )


DRIFT_FROM = 32


def components(rows: DataFrame, keys: list[str], n_max: Column) -> DataFrame:
    """The thirteen published components of each (draw, series, time).

    The drift ratio exists from the 32nd time point on.
    """
    mu, gamma, r, tvc = (F.col(c) for c in ("mu", "gamma", "r", "tvc"))
    per_unit = F.col("b_ope") / n_max
    return rows.select(
        *keys,
        "t",
        F.exp("lambda").alias("lambda_exp"),
        F.exp(mu + gamma).alias("mu_gamma_exp"),
        F.exp(mu + r).alias("mu_r_exp"),
        F.exp(mu + tvc).alias("mu_tvc_exp"),
        F.exp(mu).alias("mu_exp"),
        F.exp(gamma).alias("gamma_exp"),
        F.when(F.col("t") >= DRIFT_FROM, F.exp("delta")).alias("delta_exp"),
        F.exp(r).alias("r_exp"),
        F.exp(tvc).alias("tvc_exp"),
        F.exp(mu + per_unit).alias("mu_tvc_1_exp"),
        (mu + per_unit).alias("mu_tvc_1"),
        F.exp(per_unit).alias("tvc_1_exp"),
        per_unit.alias("tvc_1"),
    )


COMPONENTS = (
    "lambda_exp",
    "mu_gamma_exp",
    "mu_r_exp",
    "mu_tvc_exp",
    "mu_exp",
    "gamma_exp",
    "delta_exp",
    "r_exp",
    "tvc_exp",
    "mu_tvc_1_exp",
    "mu_tvc_1",
    "tvc_1_exp",
    "tvc_1",
)


# The same recursions over exploded rows (one row per time), for states that
# are stored long.  Each window holds one (draw, series) trajectory.


def _trajectory(keys: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy("t")


def walk_rows(rows: DataFrame, keys: list[str], error: str, scale: Column) -> DataFrame:
    window = _trajectory(keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("b", F.sum(scale * F.col(error)).over(window))


def seasonal_rows(rows: DataFrame, keys: list[str], error: str, scale: Column) -> DataFrame:
    """Closed form of the weekly recursion over long rows.

    From the seventh point on ``g_t = g_{t-7} + w_t - w_{t-1}`` with ``w_t``
    the scaled innovation six positions earlier, so ``g`` is a running sum
    inside each residue class modulo 7.
    """
    order = _trajectory(keys)
    scaled = rows.withColumn("__e", scale * F.col(error))
    shifted = scaled.withColumn("__w", F.lag("__e", 6).over(order)).withColumn(
        "__w_before", F.lag("__e", 7).over(order)
    )
    first_six = F.sum(F.when(F.col("t") <= 6, F.col("__e"))).over(
        order.rowsBetween(-6, -1)
    )
    change = (
        F.when(F.col("t") <= 6, F.col("__e"))
        .when(F.col("t") == 7, -first_six + F.col("__w"))
        .otherwise(F.col("__w") - F.col("__w_before"))
    )
    residue = (
        Window.partitionBy(*keys, F.pmod(F.col("t"), F.lit(7)))
        .orderBy("t")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        shifted.withColumn("__c", change)
        .withColumn("gamma", F.sum("__c").over(residue))
        .drop("__e", "__w", "__w_before", "__c")
    )


def rolling_six(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Sum of the six previous values, null before the seventh point."""
    window = _trajectory(keys).rowsBetween(-6, -1)
    return rows.withColumn(
        "sum6", F.when(F.col("t") >= 7, F.sum(value).over(window))
    )


def drift_rows(rows: DataFrame, keys: list[str], level: str) -> DataFrame:
    """Level ratio to the previous point, from the 32nd point on."""
    before = F.lag(level).over(_trajectory(keys))
    return rows.withColumn("delta_exp", F.exp(F.col(level) - before)).where(
        F.col("t") >= DRIFT_FROM
    )
