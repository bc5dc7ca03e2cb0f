"""Incremental interval monitor: the streaming twin of the batch overlay.

Days are judged whether or not anything happened: every (series, day) of the
stored forecast comes as a row of weight 0 on a second stream, and the events
as rows of weight 1. Both are counted in windows of a day, so a window is
emitted, with its count or with 0, once the watermark of the events has passed
its end. The state is one number per open (series, day).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fieldcast.operators.monitor import outside

FORECAST = "series string, date date, lwr double, fit double, upr double"
DAY_SECONDS = 86_400


def expected_days(spark: SparkSession, path: str) -> DataFrame:
    """Stream of (series, date) of a stored forecast; ``path`` is the folder of its files."""
    return spark.readStream.schema(FORECAST).option("recursiveFileLookup", "true").parquet(path).select("series", "date")


def wall_time(time: Column) -> Column:
    """The session's wall time, written as if it were UTC, so that day windows begin at its midnights."""
    return F.from_utc_timestamp(time, F.current_timezone())


def daily_counts(
    events: DataFrame,
    event_key: list[str],
    time: str,
    series: str,
    expected: DataFrame | None = None,
    delay: str = "3 days",
) -> DataFrame:
    """Finished daily counts per series from a stream of routed events.

    An event that comes again, with the same key on the same day, counts once.
    A day is emitted when the watermark, ``delay`` behind the newest event, has
    passed its end; events of emitted days are late and left out. ``expected``
    is a stream of (series, date): these days are emitted even without events.
    """
    at, day = "__at", "__day"
    timed = events.withColumn(at, wall_time(F.col(time))).withWatermark(at, delay)
    timed = timed.withColumn(day, F.to_date(time))
    rows = timed.dropDuplicatesWithinWatermark([*event_key, day]).select(
        at, F.col(series).alias("series"), F.lit(1).alias("weight")
    )
    if expected is not None:
        midnight = F.timestamp_seconds(F.unix_date("date") * DAY_SECONDS)
        # no watermark of its own: only the events say how far time is
        marks = expected.withColumn(at, midnight)
        rows = rows.unionByName(marks.select(at, "series", F.lit(0).alias("weight")))
    counts = rows.groupBy(F.window(at, "1 day").alias("w"), "series").agg(F.sum("weight").alias("em"))
    date = F.date_from_unix_date((F.unix_seconds("w.start") / DAY_SECONDS).cast("int"))
    return counts.select("series", date.alias("date"), "em")


def breaches(counts: DataFrame, forecast: DataFrame) -> DataFrame:
    """Stream-static join with the stored intervals."""
    return counts.join(forecast, ["series", "date"]).where(outside())


def start(breach_stream: DataFrame, path: str, checkpoint: str):
    """Append breaches to a table; ``checkpoint`` must be on shared storage."""
    return (
        breach_stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
