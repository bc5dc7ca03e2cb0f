"""Horizon simulation, draw by draw.

One parameter row per (draw, series) becomes an array of future steps inside
the row: no shuffle after the parameter join, no Python worker, and the same
numbers whatever the partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fieldcast.functions.noise import digest, normal_from_digest, poisson
from fieldcast.functions.recursions import let, scan

SCALES = ("s_z", "s_s", "s_r", "s_t")
STATES = (
    "intercept",
    "b_ar",
    "mu_prev",
    "mu_last",
    "b_last",
    "g1",
    "g2",
    "g3",
    "g4",
    "g5",
    "g6",
    "num_last",
)
STEP_TYPE = (
    "struct<step:int,mu:double,b_ope:double,gamma:double,num:double,"
    "tvc:double,r:double,lambda:double,delta:double>"
)


def spread(
    params: DataFrame, keys: list[str] | None = None, partitions: int | None = None
) -> DataFrame:
    """Distribute compact parameter rows before they expand into steps.

    Parameter rows are small and the simulation is the expensive part, so the
    exchange pays for itself; an explicit partition count keeps the adaptive
    coalescing from folding the work into one task.
    """
    n = partitions or int(params.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return params.repartition(n, *(keys or ["draw", "series"]))


def transfer(states: DataFrame, scales: DataFrame, series_map: DataFrame | None = None) -> DataFrame:
    """Successor states with predecessor innovation scales, draw by draw.

    ``series_map`` (series, donor) names the predecessor series each successor
    series borrows from; without it series with equal ids are paired.
    """
    donors = scales.select("draw", F.col("series").alias("donor"), *SCALES)
    own = states.drop(*SCALES)
    if series_map is None:
        own = own.withColumn("donor", F.col("series"))
    else:
        own = own.join(series_map, "series")
    return own.join(donors, ["draw", "donor"]).drop("donor")


def horizon(
    params: DataFrame, steps: int, gain: Column, seed: int = 1234, variant: str = "smooth"
) -> DataFrame:
    """Adds ``path``: the simulated steps 1..``steps`` as an array of structs.

    The level continues by its second-order recursion (``smooth``) or its
    first-order one (``ar1``).

    ``params`` has ``draw, series``, the state columns and the four scales;
    base counts and ``gain`` must be in the same unit.
    """
    draw, series = F.col("draw"), F.col("series")

    def digests(i: Column) -> Column:
        return F.struct(
            i.alias("step"),
            *[
                digest(seed, draw, series, F.lit(c), i).alias(c)
                for c in ("mu", "b", "g", "r")
            ],
        )

    noise = F.transform(
        F.transform(F.sequence(F.lit(1), F.lit(steps)), digests),
        lambda h: F.struct(
            h["step"].alias("step"),
            *[normal_from_digest(h[c]).alias(c) for c in ("mu", "b", "g", "r")],
        ),
    )
    carried = ("m1", "m2", "b", "g1", "g2", "g3", "g4", "g5", "g6", "num")
    start = ("mu_last", "mu_prev", "b_last", "g1", "g2", "g3", "g4", "g5", "g6", "num_last")
    initial = F.struct(
        *[F.col(c).cast("double").alias(name) for c, name in zip(start, carried)]
    )

    def emit(s: Column, z: Column) -> Column:
        pull = 2.0 * s["m1"] - s["m2"] if variant == "smooth" else s["m1"]
        mu = F.col("intercept") + F.col("b_ar") * pull + F.col("s_z") * z["mu"]
        b = s["b"] + F.col("s_t") * z["b"]
        total = s["g1"] + s["g2"] + s["g3"] + s["g4"] + s["g5"] + s["g6"]
        return let(
            F.struct(
                mu.alias("mu"),
                b.alias("b"),
                (-total + F.col("s_s") * z["g"]).alias("gamma"),
                (s["num"] + gain).alias("num"),
                (F.col("s_r") * z["r"]).alias("r"),
            ),
            lambda n: F.struct(
                z["step"].alias("step"),
                n["mu"].alias("mu"),
                n["b"].alias("b_ope"),
                n["gamma"].alias("gamma"),
                n["num"].alias("num"),
                (n["b"] * n["num"]).alias("tvc"),
                n["r"].alias("r"),
                (n["mu"] + n["gamma"] + n["b"] * n["num"] + n["r"]).alias("lambda"),
                (n["mu"] - s["m1"]).alias("delta"),
            ),
        )

    def advance(s: Column, out: Column) -> Column:
        return F.struct(
            out["mu"].alias("m1"),
            s["m1"].alias("m2"),
            out["b_ope"].alias("b"),
            *[s[f"g{i + 1}"].alias(f"g{i}") for i in range(1, 6)],
            out["gamma"].alias("g6"),
            out["num"].alias("num"),
        )

    return params.withColumn("path", scan(noise, initial, emit, advance, STEP_TYPE))


def explode_path(simulated: DataFrame, keys: tuple[str, ...] = ("draw", "series")) -> DataFrame:
    """One row per step.

    The outer form matters: the inner one makes the optimizer add a filter on
    the path, which would run the whole simulation a second time.
    """
    return simulated.select(*keys, F.inline_outer("path"))


ROW = ("mu", "b_ope", "gamma", "tvc", "r", "lambda", "delta")


def timeline(
    fitted: DataFrame, keys: list[str], steps: int, gain: Column, seed: int = 1234,
    variant: str = "smooth",
) -> DataFrame:
    """Observed states followed by the simulated horizon, one row per time.

    ``fitted`` has compact draws with ``series`` and the columns of the last
    states (``mu_last`` and so on); both spans leave the same row, so nothing
    is joined or shuffled.
    """
    simulated = horizon(fitted, steps, gain, seed, variant)

    def observed(z: Column) -> Column:
        return F.transform(
            z,
            lambda s, i: F.struct(
                (i + 1).alias("t"),
                s["mu"].alias("mu"),
                s["b_ope"].alias("b_ope"),
                s["gamma"].alias("gamma"),
                (s["b_ope"] * s["num"]).alias("tvc"),
                s["r"].alias("r"),
                s["lambda"].alias("lambda"),
                F.when(i >= 1, s["mu"] - F.get(z, i - 1)["mu"]).alias("delta"),
            ),
        )

    past = let(F.arrays_zip("mu", "b_ope", "gamma", "r", "lambda", "num"), observed)
    future = F.transform(
        "path",
        lambda s: F.struct((F.size("mu") + s["step"]).alias("t"), *[s[c].alias(c) for c in ROW]),
    )
    return simulated.select(*keys, F.inline_outer(F.concat(past, future)))


def predictive_counts(rows: DataFrame, log_rate: Column, seed: int, *ids: Column) -> DataFrame:
    """Poisson counts given the log rate of each row."""
    return rows.withColumn("y_pred", poisson(F.exp(log_rate), seed, *ids))


def project_base(last: DataFrame, gains: Column, steps: int) -> DataFrame:
    """Linear projection of the base: ``num_last + i * gain``."""
    return last.select(
        "series",
        F.col("num_last"),
        gains.alias("gain"),
        F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"),
    ).select("series", "step", (F.col("num_last") + F.col("step") * F.col("gain")).alias("num"))
