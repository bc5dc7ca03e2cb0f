"""Ingested events -> panels -> draws -> transferred forecast -> intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fieldcast import schemas as S
from fieldcast.operators import panel as P
from fieldcast.operators.draws import interval_quantiles
from fieldcast.operators.compact import horizon_parameters
from fieldcast.operators.reports import dated
from fieldcast.operators.simulate import (
    explode_path, horizon, predictive_counts, spread, transfer,
)


def generation_panel(
    events: DataFrame,
    deliveries: DataFrame,
    routing: DataFrame,
    tokens: dict[str, str],
    calendar_start: str,
    calendar_end: str | None,
    name,
    delivery_day: str = "納品年月日",
) -> DataFrame:
    """Daily panel of one generation.

    ``deliveries`` is pre-aggregated by day and name.  Without an end day the
    calendar runs to the last routed event.
    """
    counts = P.routed_daily(
        events, routing, "Peripheral_name", "Treatment_location", "Maintenance_date"
    ).where(F.col("date").isNotNull())
    base = P.token_base(deliveries, delivery_day, name, tokens)
    bounds = counts.agg(F.max("date").alias("end"))
    end = F.col("end") if calendar_end is None else F.lit(calendar_end).cast("date")
    dates = P.calendar(bounds, F.lit(calendar_start).cast("date"), end)
    return P.daily_panel(dates, counts, base, list(tokens))


def predecessor_panel(events: DataFrame, machines: DataFrame, start: str = "2019-01-01",
                      end: str = "2023-03-31", old_locations: bool = False) -> DataFrame:
    deliveries = P.daily_deliveries(machines, "納品年月日", ["ADF", "フィニッシャー"])
    name = F.concat_ws("_", F.coalesce("ADF", F.lit("NA")), F.coalesce("フィニッシャー", F.lit("NA")))
    routing = S.routing(events.sparkSession, "A", old_locations)
    return generation_panel(events, deliveries, routing, S.PREDECESSOR_TOKENS, start, end, name)


def successor_panel(events: DataFrame, machines: DataFrame, start: str = "2023-02-01",
                    end: str | None = None, old_locations: bool = False) -> DataFrame:
    owned = machines.where(F.col("周辺機分類").isin(S.FEEDER_CLASS, S.FINISHER_CLASS))
    deliveries = P.daily_deliveries(owned, "納品年月日", ["周辺機名"])
    routing = S.routing(events.sparkSession, "B", old_locations)
    return generation_panel(
        events, deliveries, routing, S.SUCCESSOR_TOKENS, start, end, F.col("周辺機名")
    )


def model_input(panel: DataFrame, start: str, end: str | None = None) -> DataFrame:
    """One row per series: scaled arrays over the sampling window."""
    rows = panel.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        rows = rows.where(F.col("date") <= F.lit(end).cast("date"))
    return P.series_arrays(P.scale_by_max(rows, "mif_cum"))


def transferred_forecast(
    draws_a: DataFrame,
    draws_b: DataFrame,
    inputs_b: DataFrame,
    series_map: DataFrame,
    gains: DataFrame,
    steps: int = 30,
    seed: int = 1234,
) -> DataFrame:
    """(series, date, lwr, fit, upr, is_future) over the observed and future span.

    ``gains`` is (series, gain) in units per day; it is divided by the scale
    of the base, so both are in the unit the draws were fitted in.
    """
    scaled_gain = gains.join(inputs_b.select("series", "n_max", "start", "t"), "series").select(
        "series",
        "start",
        "t",
        F.when(F.col("n_max") > 0, F.col("gain") / F.col("n_max")).otherwise(F.lit(0.0)).alias("gain"),
    )
    scales = horizon_parameters(draws_a)
    states = horizon_parameters(draws_b)
    params = transfer(states, scales, series_map).join(scaled_gain, "series")
    future = explode_path(
        horizon(spread(params), steps, F.col("gain"), seed), ("draw", "series", "start", "t")
    ).select("draw", "series", "start", (F.col("t") + F.col("step")).alias("i2"), "lambda",
             F.lit(True).alias("is_future"))
    observed = draws_b.join(inputs_b.select("series", "start"), "series").select(
        "draw", "series", "start", F.posexplode_outer("lambda").alias("i2", "lambda")
    ).select("draw", "series", "start", (F.col("i2") + 1).alias("i2"), "lambda",
             F.lit(False).alias("is_future"))
    counts = predictive_counts(
        observed.unionByName(future), F.col("lambda"), seed, F.col("draw"), F.col("series"), F.col("i2")
    )
    cuts = interval_quantiles(counts, ["series", "start", "i2", "is_future"], "y_pred")
    return dated(cuts, F.col("start"), "i2").select(
        "series", "date", "lwr", "fit", "upr", "is_future"
    )


def forecast(
    panel_b: DataFrame,
    series_map: DataFrame,
    gains: DataFrame,
    start_b: str,
    draws: tuple[DataFrame, DataFrame],
    steps: int = 30,
    seed: int = 1234,
) -> DataFrame:
    """Forecast the successor from the draws of both generations.

    ``draws`` are those of the predecessor and the successor, one row per draw
    and series (``operators.compact``), from any sampler; ``model_input`` gives
    the arrays that a sampler takes.
    """
    return transferred_forecast(*draws, model_input(panel_b, start_b), series_map, gains, steps, seed)
