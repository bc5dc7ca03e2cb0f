"""Cleaning of raw extracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Remove columns without a single value.

    The schema depends on the data, so this runs one aggregation; its single
    result row is all that reaches the driver.
    """
    filled = df.agg(
        *[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)]
    ).first()
    keep = [c for i, c in enumerate(df.columns) if filled[i] > 0]
    return df.select(*[F.col(f"`{c}`") for c in keep])


def null_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: number of nulls in each required column."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])


def keep_emergencies(df: DataFrame, flag: str, mode: str = "EM") -> DataFrame:
    """Mode switch: emergencies only, or every call."""
    if mode == "EM":
        return df.where(F.col(flag).cast("int") == 1)
    return df


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first in the declared order; nulls of the order come last.

    An aggregation that is combined before the shuffle, so a key with very
    many rows costs one row per task.
    """
    place = F.struct(
        *[x for c in order for x in (F.col(c).isNull().alias(f"null_{c}"), F.col(c).alias(c))]
    )
    others = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*[F.col(f"`{c}`") for c in others]), place).alias("__first")
    return df.groupBy(*keys).agg(first).select(*[c if c in keys else F.col("__first")[c].alias(c) for c in df.columns])


def column_maxima(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, name, maximum) of all numeric columns at once, in one aggregation."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in by]
    pairs = F.array(
        *[F.struct(F.lit(c).alias("name"), F.max(c).cast("double").alias("maximum")) for c in numeric]
    )
    return df.groupBy(*by).agg(pairs.alias("__pairs")).select(*by, F.inline("__pairs"))


def missing_levels(present: DataFrame, expected: DataFrame, on: list[str]) -> DataFrame:
    """Expected categories that never occur."""
    return expected.join(present.select(*on).distinct(), on, "left_anti")


def distinct_levels(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, level) pairs of the chosen columns in one pass."""
    pairs: Column = F.array(
        *[
            F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("level"))
            for c in columns
        ]
    )
    return df.select(F.inline(pairs)).distinct()
