"""Compact posterior draws: one row per draw and series, states as arrays with one element per day.

Draws come from any sampler (``sources.draw_files``) with the scalars below
and the arrays ``mu, b_ope, gamma, r, lambda, num``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SCALAR_NAMES = ("intercept", "b_ar", "s_z", "s_s", "s_r", "s_t")


def horizon_parameters(
    fitted: DataFrame, series: str = "series", keep: list[str] | None = None
) -> DataFrame:
    """Last states and scalars of compact draws, as the simulation expects."""

    def last(name: str, back: int = 1):
        return F.element_at(F.col(name), -back)

    return fitted.select(
        "draw",
        F.col(series).alias("series"),
        *SCALAR_NAMES,
        last("mu", 2).alias("mu_prev"),
        last("mu").alias("mu_last"),
        last("b_ope").alias("b_last"),
        *[last("gamma", 7 - i).alias(f"g{i}") for i in range(1, 7)],
        last("num").alias("num_last"),
        *(keep or []),
    )


def long_draws(fitted: DataFrame, keys: list[str]) -> DataFrame:
    """Compact draws as the long table; ``i1`` is null for scalars."""
    scalars = [
        F.struct(
            F.lit(s).alias("variable"),
            F.lit(None).cast("int").alias("i1"),
            F.col(s).alias("value"),
        )
        for s in SCALAR_NAMES
    ]

    def indexed(name: str) -> Column:
        return F.transform(
            name,
            lambda v, i: F.struct(
                F.lit(name).alias("variable"), (i + 1).alias("i1"), v.alias("value")
            ),
        )

    arrays = [indexed(a) for a in ("mu", "b_ope", "gamma", "r", "lambda")]
    return fitted.select(
        *keys, "chain", "iteration", "draw", F.inline_outer(F.concat(F.array(*scalars), *arrays))
    )
