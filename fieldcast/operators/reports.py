"""Reports: shares, top lists, interval tables, report windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldcast.operators.draws import interval_quantiles
from fieldcast.operators.states import COMPONENTS

OTHER = "other"


def code_share(
    events: DataFrame,
    period: Column,
    code: str,
    min_count: int,
    other: str = OTHER,
) -> DataFrame:
    """Failure-code share per period, rare codes lumped.

    Events are counted by (period, code) first; the period total is a window
    over those counts, so a period occupies one row per code, not per event.
    A null code stays its own group unless it is rare.
    """
    counts = events.groupBy(period.alias("period"), F.col(code).alias("code")).agg(
        F.count(F.lit(1)).alias("n")
    )
    whole = F.sum("n").over(Window.partitionBy("period"))
    lumped = counts.withColumn("n_period", whole).withColumn(
        "code", F.when(F.col("n") < min_count, F.lit(other)).otherwise(F.col("code"))
    )
    return (
        lumped.groupBy("period", "code")
        .agg(F.sum("n").alias("n_code"), F.max("n_period").alias("n_period"))
        .withColumn("share", F.col("n_code") / F.col("n_period"))
    )


def top_categories(events: DataFrame, column: str, n: int = 15) -> DataFrame:
    """Most frequent values, nulls excluded, ties by name."""
    return (
        events.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), F.col(column))
        .limit(n)
    )


def nth_category(events: DataFrame, column: str, index: int) -> str | None:
    """Name of the ``index``-th most frequent value; 0 stands for all."""
    if index == 0:
        return None
    top = top_categories(events, column, index).collect()
    return top[index - 1][column] if len(top) >= index else None


def top_days(counts: DataFrame, n: int) -> DataFrame:
    """Days with most events, ties by date."""
    return counts.orderBy(F.col("em").desc(), F.col("date")).limit(n)


def dated(rows: DataFrame, start: Column, step: str, freq: str = "day") -> DataFrame:
    """Calendar label of a 1-based step counted from ``start``."""
    if freq == "month":
        label = F.add_months(start, F.col(step) - 1)
    else:
        label = F.date_add(start, F.col(step) - 1)
    return rows.withColumn("date", label)


def interval_table(
    draws: DataFrame,
    value: str,
    start: Column,
    step: str = "i2",
    series: str = "series",
    freq: str = "day",
    observed: DataFrame | None = None,
) -> DataFrame:
    """(series, date, lwr, fit, upr), with ``obs`` when observations are given."""
    cuts = interval_quantiles(draws.select(series, step, value), [series, step], value)
    table = dated(cuts, start, step, freq).select(series, "date", "lwr", "fit", "upr")
    if observed is not None:
        table = table.join(observed, [series, "date"], "left")
    return table


def component_report(
    components: DataFrame,
    keys: list[str],
    start: Column,
    predicted: bool = False,
    observed: DataFrame | None = None,
    end: Column | None = None,
) -> DataFrame:
    """All component intervals in one long table (keys, component, date, ...).

    With ``end``, the last observed day, rows are marked observed or future.

    ``keys`` identify the series; ``t`` is the 1-based day.  Components that
    do not exist yet (the drift before its first day) give no row.
    """
    names = list(COMPONENTS) + (["y_pred"] if predicted else [])
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("component"), F.col(c).cast("double").alias("value"))
            for c in names
        ]
    )
    long = components.select(*keys, "t", F.inline(pairs)).where(F.col("value").isNotNull())
    cuts = interval_quantiles(long, [*keys, "component", "t"])
    table = dated(cuts, start, "t").drop("t")
    if observed is not None:
        table = table.join(observed, [*keys, "date"], "left")
    if end is not None:
        table = table.withColumn("is_future", F.col("date") > end)
    return table


def report_window(
    panel: DataFrame,
    end: Column,
    horizon: int,
    days_back: int = 182,
    start: Column | None = None,
) -> DataFrame:
    """Rows from half a year before ``end`` (or a given start) to the horizon,
    marked as observed or future."""
    first = F.date_sub(end, days_back) if start is None else start
    return panel.where(F.col("date").between(first, F.date_add(end, horizon))).withColumn(
        "is_future", F.col("date") > end
    )


def series_label(means: DataFrame, digits: int = 3) -> DataFrame:
    """Legend text: position, name and mean autoregressive coefficient."""
    text = F.concat(
        F.col("ord").cast("string"),
        F.lit("."),
        F.col("series"),
        F.lit(" (b_ar = "),
        F.format_string(f"%.{digits}f", F.bround("b_ar", digits)),
        F.lit(")"),
    )
    return means.select("series", text.alias("label"))
