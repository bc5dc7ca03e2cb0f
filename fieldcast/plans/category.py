"""One failure category on the main body: panel, horizon and component report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fieldcast.operators import panel as P, reports as R, simulate, states
from fieldcast.operators.compact import horizon_parameters

ALL = "all"


def failure_code_share(
    events: DataFrame,
    locations: list[str],
    attachment: str,
    by: str = "Working_month",
    min_count: int = 10,
) -> DataFrame:
    """Failure-code share of one attachment at given locations, by a chosen column."""
    rows = events.where(
        F.col("Treatment_location").isin(locations) & (F.col("Peripheral_name") == attachment)
    )
    return R.code_share(rows, F.col(by), "SC_name", min_count).withColumnRenamed("period", by)


def category_panel(
    events: DataFrame,
    machines: DataFrame,
    index: int,
    calendar_start: Column,
    calendar_end: Column,
    machine: str = "機種機番",
    delivery_day: str = "納品年月日",
) -> DataFrame:
    """Daily panel of the ``index``-th most frequent phenomenon, 0 for all."""
    chosen = R.nth_category(events, "Phenomenon", index)
    name = chosen or ALL
    counts = P.main_body_daily(
        events, "Peripheral_name", "Maintenance_date", "Phenomenon", chosen
    ).withColumn("series", F.lit(name))
    base = P.daily_distinct(machines, delivery_day, machine).select(
        F.lit(name).alias("series"), F.col(delivery_day).alias("date"), "n"
    )
    one = events.sparkSession.range(0, 1, 1, 1)
    return P.daily_panel(P.calendar(one, calendar_start, calendar_end), counts, base, [name])


def category_report(
    panel: DataFrame,
    given: DataFrame,
    start: str,
    end: str,
    gain: float,
    steps: int = 30,
    seed: int = 1234,
) -> DataFrame:
    """(series, component, date, lwr, fit, upr, em, is_future).

    ``gain`` is in machines per day.  ``given`` are first-order draws from any
    sampler, one row per draw and series (``operators.compact``).
    """
    first, last = (F.lit(d).cast("date") for d in (start, end))
    window = panel.where(F.col("date").between(first, last))
    scaled = P.scale_by_max(window, "mif_cum")
    arrays = ["mu", "b_ope", "gamma", "r", "lambda", "num"]
    draws = horizon_parameters(given, keep=arrays)
    # one row per series
    limits = scaled.groupBy("series").agg(F.max("n_max").cast("double").alias("n_max"))
    rows = draws.join(limits, "series")
    per_day = F.when(F.col("n_max") > 0, F.lit(float(gain)) / F.col("n_max")).otherwise(F.lit(0.0))
    times = simulate.timeline(rows, ["draw", "series", "n_max"], steps, per_day, seed, "ar1")
    counts = simulate.predictive_counts(
        times, F.col("lambda"), seed, F.col("draw"), F.col("series"), F.col("t")
    )
    parts = states.components(counts, ["draw", "series", "y_pred"], F.col("n_max"))
    observed = window.select("series", "date", "em")
    return R.component_report(parts, ["series"], first, True, observed, last)
