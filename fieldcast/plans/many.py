"""Many short count series with gaps: monthly intervals of given draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fieldcast.operators.ranking import exact_quantiles
from fieldcast.operators.reports import dated
from fieldcast.operators.draws import INTERVAL


def series_slice(series: DataFrame, order: str, start: int, end: int) -> DataFrame:
    """Series ``start`` to ``end`` of the input order, clipped to what exists."""
    return series.where(F.col(order).between(start, end))


def many_report(draws: DataFrame, key: str, start: Column) -> DataFrame:
    """(key, item, date, lwr, fit, upr) from given draws: one row per draw with
    the arrays ``lambda`` (log rates) and ``r`` (effects), one value per month.

    The draws may come from any sampler (``sources.draw_files``).
    """
    paths = draws.select(key, F.col("lambda").alias("log_rate"), F.col("r").alias("effect"))
    items = F.transform(
        F.arrays_zip("log_rate", "effect"),
        lambda z, i: F.array(
            F.struct(F.lit("y_probs").alias("item"), (i + 1).alias("t"), F.exp(z["log_rate"]).alias("value")),
            F.struct(F.lit("r_probs").alias("item"), (i + 1).alias("t"), z["effect"].alias("value")),
        ),
    )
    long = paths.select(key, F.inline_outer(F.flatten(items)))
    cuts = exact_quantiles(long, [key, "item", "t"], "value", INTERVAL)
    return dated(cuts, start, "t", "month").select(key, "item", "date", "lwr", "fit", "upr")
