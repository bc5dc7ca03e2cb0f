"""Actual daily counts against stored prediction intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BREACH = ["series", "date", "em", "lwr", "fit", "upr", "breach"]


def outside() -> Column:
    return (F.col("em") < F.col("lwr")) | (F.col("em") > F.col("upr"))


def as_of(forecasts: DataFrame) -> DataFrame:
    """For each series and day the interval of the newest run made before that day.

    ``forecasts`` holds all runs (``sources.products.read_forecasts``); of runs
    made on one day the largest id counts.  Days that no earlier run reaches
    have no row.  One aggregation; runs never meet each other.
    """
    newest = F.max_by(F.struct("run_id", "made", "lwr", "fit", "upr"), F.struct("made", "run_id"))
    before = forecasts.where(F.col("made") < F.col("date"))
    return before.groupBy("series", "date").agg(newest.alias("run")).select("series", "date", "run.*")


def overlay(actuals: DataFrame, forecast: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Each judged day with its interval and a breach flag.

    ``actuals`` is a zero-filled panel, so days without any event are judged
    too.  Days without a stored interval are not judged.
    """
    joined = actuals.join(forecast, on or ["series", "date"])
    return joined.withColumn("breach", outside())


def breaches(actuals: DataFrame, forecast: DataFrame, on: list[str] | None = None) -> DataFrame:
    return overlay(actuals, forecast, on).where(F.col("breach"))


def split_groups(rows: DataFrame, groups: dict[str, list[str]], by: str = "series") -> DataFrame:
    """Adds ``grp``: the family group of each row; ungrouped rows are dropped."""
    label = F.coalesce(
        *[F.when(F.col(by).isin(members), F.lit(name)) for name, members in groups.items()]
    )
    return rows.withColumn("grp", label).where(F.col("grp").isNotNull())
