"""Stored products: forecasts and run records."""

from __future__ import annotations

import os
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fieldcast.schemas import RUNS
from fieldcast.sources.manifest import read_run, read_runs, write_run

FORECAST_COLUMNS = ["run_id", "series", "date", "lwr", "fit", "upr", "is_future", "made"]


def write_forecast(forecast: DataFrame, path: str, run_id: str, made: Column | None = None) -> None:
    """Store the forecast of a run, made on the day ``made`` (today without it); see ``manifest``."""
    day = F.current_date() if made is None else made
    dated = forecast.withColumn("made", day)
    write_run(dated.select(*FORECAST_COLUMNS[1:]), path, run_id)


def read_forecast(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    return read_run(spark, path, run_id).select(*FORECAST_COLUMNS)


def read_forecasts(spark: SparkSession, path: str) -> DataFrame:
    """The forecasts of all runs, each run once."""
    return read_runs(spark, path).select(*FORECAST_COLUMNS)


@contextmanager
def recorded_run(spark: SparkSession, path: str, run_id: str, title: str):
    """Store one row with the run times of the enclosed block."""
    before = os.times()
    yield
    after = os.times()
    row = (run_id, title, after.user - before.user, after.system - before.system, after.elapsed - before.elapsed)
    write_run(spark.createDataFrame([row], RUNS).drop("run_id"), path, run_id)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per recorded run."""
    return read_runs(spark, path).select(*RUNS.fieldNames())
