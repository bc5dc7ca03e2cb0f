"""Posterior draws in long form: quantiles, means, samples, coefficients.

A draw table has the columns ``chain, iteration, draw, variable, i1, i2,
value``.  Filter by ``variable`` before summarising: stored draws are
partitioned by it, so the filter prunes files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldcast.functions.noise import digest
from fieldcast.functions.text import rounded_label
from fieldcast.operators.keys import join_null_safe
from fieldcast.operators.ranking import exact_quantiles

INTERVAL = {"lwr": 0.025, "fit": 0.5, "upr": 0.975}


def interval_quantiles(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """2.5 %, 50 % and 97.5 % quantiles per key."""
    return exact_quantiles(df, keys, value, INTERVAL)


def means(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Mean, and the mean of a log-scale value brought back with ``exp``."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean")).withColumn(
        "mean_exp", F.exp("mean")
    )


def histogram(df: DataFrame, value: str, width: float) -> DataFrame:
    """Counts in bins of equal width, labelled by the bin number."""
    return df.groupBy(F.floor(F.col(value) / width).cast("bigint").alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )


def sample_ids(ids: DataFrame, column: str, n: int, seed: int) -> DataFrame:
    """``n`` ids without replacement, all of them when there are fewer.

    The order is a hash of the id, so the sample is exact in size and the same
    on every run.
    """
    order = digest(seed, F.col(column))
    return ids.select(column).distinct().orderBy(order, F.col(column)).limit(n)


def sample_draws(
    df: DataFrame, n: int, seed: int, column: str = "draw"
) -> DataFrame:
    """Rows of ``n`` sampled draws."""
    return df.join(sample_ids(df, column, n, seed), column, "left_semi")


def rescale(df: DataFrame, scales: DataFrame, term: str = "term") -> DataFrame:
    """Divide each coefficient by the maximum its predictor was scaled with.

    Matched by name; terms without a scale keep their value.
    """
    joined = join_null_safe(df, scales.select(term, "scale_max"), [term], "left")
    return joined.withColumn(
        "value", F.col("value") / F.coalesce(F.col("scale_max"), F.lit(1.0))
    ).drop("scale_max")


def with_mean_row(sampled: DataFrame, averaged: DataFrame, columns: list[str]) -> DataFrame:
    """Sampled rows tagged ``data`` followed by the mean rows tagged ``mean``."""
    data = sampled.select(
        F.col("draw").cast("string").alias("iter"), F.lit("data").alias("mean"), *columns
    )
    mean = averaged.select(
        F.lit("mean").alias("iter"), F.lit("mean").alias("mean"), *columns
    )
    return data.unionByName(mean)


def _two_parts(df: DataFrame, keys: list[str], first: str, second: str) -> DataFrame:
    """Part 1 and part 2 of the same key side by side, by conditional sums."""
    part = F.col("part")
    return df.groupBy(*keys).agg(
        F.max(F.when(part == 1, F.col("value"))).alias(first),
        F.max(F.when(part == 2, F.col("value"))).alias(second),
    )


def coef_long(coefs: DataFrame, n: int, seed: int) -> DataFrame:
    """(iter, mean, term, probability, count) of sampled draws plus the mean.

    ``coefs`` has ``draw, part, term, value`` with part 1 for the probability
    and part 2 for the count.  The mean row is over all draws.
    """
    sampled = _two_parts(
        sample_draws(coefs, n, seed), ["draw", "term"], "probability", "count"
    )
    averaged = _two_parts(
        coefs.groupBy("part", "term").agg(F.avg("value").alias("value")),
        ["term"],
        "probability",
        "count",
    )
    return with_mean_row(sampled, averaged, ["term", "probability", "count"])


def entity_long(
    values: DataFrame, n_draws: int, n_entities: int, seed: int
) -> DataFrame:
    """(iter, mean, entity, q, lambda) for sampled draws and entities.

    ``values`` has ``draw, part, entity, value``: part 1 is q, part 2 the log
    rate.  The mean row averages the log rate before ``exp``.
    """
    chosen = sample_draws(values, n_entities, seed, "entity")
    averaged = _two_parts(
        chosen.groupBy("part", "entity").agg(F.avg("value").alias("value")),
        ["entity"],
        "q",
        "lambda",
    )
    draws = sample_ids(values, "draw", n_draws, seed)
    sampled = _two_parts(
        chosen.join(draws, "draw", "left_semi"), ["draw", "entity"], "q", "lambda"
    )
    out = with_mean_row(sampled, averaged, ["entity", "q", "lambda"])
    return out.withColumn("lambda", F.exp("lambda"))


def coef_summary(
    coefs: DataFrame,
    levels: DataFrame,
    digits: int = 2,
    selected: list[str] | None = None,
) -> DataFrame:
    """Interval, type and label per term and part.

    ``levels`` is (term, term_ord), the declared order of the terms.
    """
    rows = coefs if selected is None else coefs.where(F.col("term").isin(selected))
    cuts = interval_quantiles(rows, ["part", "term"])
    named = cuts.withColumn(
        "type", F.when(F.col("part") == 1, "probability").otherwise("count")
    )
    return join_null_safe(named, levels, ["term"]).select(
        "term",
        "term_ord",
        "type",
        "lwr",
        "fit",
        "upr",
        rounded_label(F.col("fit"), digits).alias("label"),
    )


def coef_order(summary_rows: DataFrame, by_probability: bool = False) -> DataFrame:
    """Terms ranked by the median of one type, largest first.

    One row per term, so the ranking window spans the terms only.
    """
    chosen = "probability" if by_probability else "count"
    rank: Column = F.row_number().over(
        Window.partitionBy("type").orderBy(F.col("fit").desc(), "term")
    )
    return (
        summary_rows.where(F.col("type") == chosen)
        .select("term", "type", "fit", rank.alias("position"))
    )
