"""Daily panels: routed counts, deliveries, calendars, cumulative base."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldcast.functions.dates import day_index
from fieldcast.functions.text import contains_token, strip_prefix


def route(events: DataFrame, routing: DataFrame, attachment: str, location: str) -> DataFrame:
    """Keep events whose (attachment, location) has a family.

    The routing table comes from the caller; Spark broadcasts it when it is
    small.
    """
    rules = routing.select(
        F.col("attachment").alias(attachment),
        F.col("location").alias(location),
        "family",
    )
    return events.join(rules, [attachment, location])


def routed_daily(
    events: DataFrame, routing: DataFrame, attachment: str, location: str, day: str
) -> DataFrame:
    """(series, date, em): events per family and day."""
    return (
        route(events, routing, attachment, location)
        .groupBy(F.col("family").alias("series"), F.col(day).alias("date"))
        .agg(F.count(F.lit(1)).alias("em"))
    )


def daily_deliveries(machines: DataFrame, day: str, by: list[str]) -> DataFrame:
    return machines.groupBy(day, *by).agg(F.count(F.lit(1)).alias("n"))


def daily_distinct(machines: DataFrame, day: str, machine: str) -> DataFrame:
    """Distinct machines per delivery day; a null machine counts as one."""
    pairs = machines.select(day, machine).distinct()
    return pairs.groupBy(day).agg(F.count(F.lit(1)).alias("n"))


def token_base(
    deliveries: DataFrame, day: str, name: Column, tokens: dict[str, str]
) -> DataFrame:
    """(series, date, n): deliveries whose name contains the family's token.

    Stays in long form: counts are pre-aggregated by day and name, and each
    pair is emitted once for every token it contains.
    """
    matches = F.filter(
        F.array(
            *[
                F.when(contains_token(name, token), F.lit(family))
                for family, token in tokens.items()
            ]
        ),
        lambda f: f.isNotNull(),
    )
    return (
        deliveries.select(
            F.col(day).alias("date"), "n", F.explode(matches).alias("series")
        )
        .groupBy("series", "date")
        .agg(F.sum("n").alias("n"))
    )


def main_body_daily(
    events: DataFrame,
    attachment: str,
    day: str,
    phenomenon: str | None = None,
    chosen: str | None = None,
) -> DataFrame:
    """Daily events on the main body, for one phenomenon or for all."""
    rows = events.where(F.col(attachment).isNull())
    if chosen is not None:
        rows = rows.where(F.col(phenomenon) == chosen)
    return rows.groupBy(F.col(day).alias("date")).agg(F.count(F.lit(1)).alias("em"))


def calendar(bounds: DataFrame, start: Column, end: Column) -> DataFrame:
    """Daily dates between two bounds of a one-row frame, both inclusive."""
    return bounds.select(
        F.explode(F.sequence(start, end, F.expr("interval 1 day"))).alias("date")
    )


def spine(dates: DataFrame, series: list[str]) -> DataFrame:
    """Every date with every family; the families are a fixed short list."""
    families = F.array(*[F.lit(s) for s in series])
    return dates.select(F.explode(families).alias("series"), "date")


def _running_base(order: list) -> Column:
    window = (
        Window.partitionBy("series")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return F.sum("__n").over(window)


def daily_panel(
    dates: DataFrame,
    counts: DataFrame,
    base: DataFrame,
    series: list[str],
    carry_in: bool = False,
) -> DataFrame:
    """(series, date, em, mif_cum) for every day and family of the calendar.

    Missing days and families are zero.  The base is cumulated inside the
    calendar; ``carry_in`` adds the deliveries before its first day.
    """
    full = spine(dates, series)
    panel = (
        full.join(counts.select("series", "date", "em"), ["series", "date"], "left")
        .join(
            base.select("series", "date", F.col("n").alias("__n")),
            ["series", "date"],
            "left",
        )
        .fillna(0, subset=["em", "__n"])
    )
    if carry_in:
        first = dates.agg(F.min("date"))
        earlier = (
            base.where(F.col("date") < first.scalar())
            .groupBy("series")
            .agg(F.sum("n").alias("__seed"))
        )
        panel = panel.join(earlier, "series", "left").fillna(0, subset=["__seed"])
    else:
        panel = panel.withColumn("__seed", F.lit(0))
    cum = _running_base(["date"]) + F.col("__seed")
    return panel.select("series", "date", "em", cum.cast("bigint").alias("mif_cum"))


def full_panel(
    dates: DataFrame, counts: DataFrame, base: DataFrame, series: list[str]
) -> DataFrame:
    """Full-outer variant: days outside the calendar are kept.

    They follow the calendar, first the delivery days and then the event-only
    days, and the base keeps cumulating in that order.
    """
    keys = (
        dates.select("date", F.lit(0).alias("part"))
        .unionByName(base.select("date", F.lit(1).alias("part")))
        .unionByName(counts.select("date", F.lit(2).alias("part")))
        .groupBy("date")
        .agg(F.min("part").alias("part"))
    )
    families = F.array(*[F.lit(s) for s in series])
    full = keys.select(F.explode(families).alias("series"), "date", "part")
    panel = (
        full.join(counts.select("series", "date", "em"), ["series", "date"], "left")
        .join(
            base.select("series", "date", F.col("n").alias("__n")),
            ["series", "date"],
            "left",
        )
        .fillna(0, subset=["em", "__n"])
    )
    cum = _running_base(["part", "date"])
    return panel.select(
        "series", "date", "em", cum.cast("bigint").alias("mif_cum"), "part"
    )


def window_slice(panel: DataFrame, start: Column, end: Column) -> DataFrame:
    """Days between two bounds with their 1-based index."""
    return panel.where(F.col("date").between(start, end)).withColumn(
        "t", day_index(F.col("date"), start)
    )


def pivot_counts(counts: DataFrame, series: list[str], prefix: str = "EM_") -> DataFrame:
    """One row per day, one zero-filled column per family."""
    wide = (
        counts.groupBy("date")
        .pivot("series", series)
        .agg(F.sum("em"))
        .fillna(0, subset=series)
    )
    return wide.withColumnsRenamed({s: prefix + s for s in series})


def unpivot_counts(wide: DataFrame, prefix: str = "EM_") -> DataFrame:
    """Back to long form, names without the metric prefix."""
    columns = [c for c in wide.columns if c.startswith(prefix)]
    return wide.unpivot(["date"], columns, "series", "em").withColumn(
        "series", strip_prefix(F.col("series"), len(prefix))
    )


def scale_by_max(panel: DataFrame, column: str, by: str = "series") -> DataFrame:
    """``column / max(column)`` per family, zero when the maximum is zero.

    The maximum is a pre-aggregated row per family that is joined back, so a
    large family is not gathered in one task.
    """
    top = panel.groupBy(by).agg(F.max(column).alias("n_max"))
    ratio = F.when(F.col("n_max") > 0, F.col(column) / F.col("n_max")).otherwise(0.0)
    return panel.join(top, by).withColumn("num", ratio.cast("double"))


def series_arrays(panel: DataFrame, by: str = "series") -> DataFrame:
    """One row per family: ``y`` and ``num`` in date order, with ``t`` and ``n_max``.

    Expects the scaled panel.  A family holds one element per calendar day.
    """
    ordered = F.array_sort(
        F.collect_list(F.struct("date", F.col("em").cast("int").alias("em"), "num"))
    )
    rows = panel.groupBy(by).agg(
        ordered.alias("__rows"), F.max("n_max").cast("double").alias("n_max")
    )
    return rows.select(
        by,
        F.col("__rows")[0]["date"].alias("start"),
        F.size("__rows").alias("t"),
        F.col("__rows.em").alias("y"),
        F.col("__rows.num").alias("num"),
        "n_max",
    )


def observed_cells(series: DataFrame, by: str, y: str) -> DataFrame:
    """Observed cells per series: their number and positions, plus the total."""
    positions = F.filter(
        F.transform(F.col(y), lambda v, i: F.when(v.isNotNull(), i + 1)),
        lambda i: i.isNotNull(),
    )
    rows = series.select(by, positions.alias("obs_no")).withColumn(
        "len_obs", F.size("obs_no").cast("bigint")
    )
    return rows.withColumn("total_obs", rows.agg(F.sum("len_obs")).scalar())


def measured_and_future(
    dates: DataFrame, counts: DataFrame, base: DataFrame, end: Column
) -> DataFrame:
    """Zero-filled up to ``end``, left null after it."""
    joined = dates.join(base, "date", "left").join(counts, "date", "left")
    measured = joined.where(F.col("date") <= end).fillna(0, subset=["n", "em"])
    future = joined.where(F.col("date") > end)
    return measured.unionByName(future)
