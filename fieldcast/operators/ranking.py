"""Exact quantiles and ranks of groups of any size.

``percentile`` and ``row_number() over (partition by group order by value)``
both gather a whole group in one task, which fails when one group owns a large
share of the rows.  Here (group, value) pairs are counted first, with map-side
combining, so repeated values collapse before the shuffle.  A value is then
read as three digits that order doubles lexicographically: sign, exponent and
eight bits of the fraction, then twice 22 bits.  Counts of the first digit give
the ranks before each first digit; inside one, counts of the second digit; and
inside both, the counts of the values.  Every window holds one digit's values
(a few million short rows at most, whatever the group's size), and quantiles
go down only into digits with a wanted rank.  All groups take this one path.

Order and rules: minus infinity, finite values, infinity, NaN, as Spark orders
doubles; the two zeros are one value; nulls are ignored.  A quantile between
two equal values, or exactly at a value, is that value; between others it is
interpolated as doubles are, so next to an infinity it is infinite or NaN.

The group key and the digits are carried as structs: their equality treats
null like any other value, so null keys form a group, joins stay plain equi
joins, and no filter on them is pushed to the input, whose counts all uses
share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

KEY = "__k"
FRACTION_BITS = 52
DIGIT_BITS = 22
EXPONENT_SHIFT = 1100
INFINITE, NOT_A_NUMBER = 1 << 40, 1 << 41


def _value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    v = F.col(value).cast("double")
    key = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(1))
    return (
        df.where(v.isNotNull())
        .select(key.alias(KEY), (v + F.lit(0.0)).alias("__v"))
        .groupBy(KEY, "__v")
        .agg(F.count(F.lit(1)).alias("__n"))
    )


def _with_digits(counts: DataFrame) -> DataFrame:
    """``__b1`` and ``__b2``: the group with one and with two digits; ``__d1`` to ``__d3``."""
    v = F.col("__v")
    size = F.abs(v)
    plain = (size > 0) & (size < float("inf"))
    safe = F.when(plain, size).otherwise(F.lit(1.0))
    # a power of two divides exactly, so the significand is exact even where
    # the logarithm rounds to the neighbouring exponent
    exponent = F.floor(F.log2(safe))
    whole = (safe / F.pow(F.lit(2.0), exponent) * float(1 << FRACTION_BITS)).cast("bigint")
    sign = F.when(v < 0, F.lit(-1)).otherwise(F.lit(1))
    low = F.lit((1 << DIGIT_BITS) - 1)
    first = (exponent + EXPONENT_SHIFT) * 1024 + F.shiftright(whole, 2 * DIGIT_BITS)
    first = (
        F.when(F.isnan(v), F.lit(NOT_A_NUMBER))
        .when(size == float("inf"), F.lit(INFINITE))
        .when(size == 0, F.lit(0))
        .otherwise(first)
    )
    digits = [
        first * sign,
        F.when(plain, F.shiftright(whole, DIGIT_BITS).bitwiseAND(low)).otherwise(F.lit(0)) * sign,
        F.when(plain, whole.bitwiseAND(low)).otherwise(F.lit(0)) * sign,
    ]
    named = counts.select("*", *[d.cast("bigint").alias(f"__d{i + 1}") for i, d in enumerate(digits)])
    return named.withColumns(
        {"__b1": F.struct(KEY, "__d1"), "__b2": F.struct(KEY, "__d1", "__d2")}
    )


def _before(count: str, inside: str, digit: str) -> Column:
    """Sum of ``count`` over smaller digits inside the same ``inside``."""
    window = Window.partitionBy(inside).orderBy(digit)
    return F.sum(count).over(
        window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ) - F.col(count)


def _first_digits(cells: DataFrame) -> DataFrame:
    """Per group and first digit: values before it in the group, and the group's size."""
    counted = cells.groupBy(KEY, "__d1").agg(F.sum("__n").alias("__c"))
    return counted.select(
        F.struct(KEY, "__d1").alias("__b1"),
        "__c",
        _before("__c", KEY, "__d1").alias("__before1"),
        F.sum("__c").over(Window.partitionBy(KEY)).alias("__size"),
    )


def _second_digits(cells: DataFrame, first: DataFrame) -> DataFrame:
    """Per group and two digits: values before them in the group, and the group's size."""
    joined = cells.join(first.drop("__c"), "__b1")
    counted = joined.groupBy("__b1", "__d2").agg(
        F.sum("__n").alias("__c"),
        F.max("__before1").alias("__before1"),
        F.max("__size").alias("__size"),
    )
    key, digit = F.col("__b1")[KEY], F.col("__b1")["__d1"]
    return counted.select(
        F.struct(key.alias(KEY), digit.alias("__d1"), "__d2").alias("__b2"),
        "__c",
        (F.col("__before1") + _before("__c", "__b1", "__d2")).alias("__before2"),
        "__size",
    )


def _values(cells: DataFrame, second: DataFrame) -> DataFrame:
    """Values with ``__start``, the number of smaller ones in the group."""
    joined = cells.select(KEY, "__v", "__n", "__b2", "__d3").join(second.drop("__c"), "__b2")
    return joined.withColumn("__start", F.col("__before2") + _before("__n", "__b2", "__d3"))


def _ranks(p: float, size: Column) -> tuple[Column, Column, Column]:
    position = F.lit(p) * (size - 1)
    low = F.floor(position)
    return low, F.ceil(position), position - low


def _wanted(rows: DataFrame, before: str, probs: list[float]) -> DataFrame:
    """Rows whose ``__c`` values from ``before`` on hold a wanted rank."""
    ranks = F.array(*[r for p in probs for r in _ranks(p, F.col("__size"))[:2]])
    return rows.where(
        F.exists(ranks, lambda r: (r >= F.col(before)) & (r < F.col(before) + F.col("__c")))
    )


def exact_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    probs: dict[str, float],
) -> DataFrame:
    """Linear-interpolation quantiles per group.

    ``probs`` maps output column to probability.  Null values are ignored; a
    null key is a group of its own; no keys means one group of everything.
    """
    points = list(probs.values())
    cells = _with_digits(_value_counts(df, keys, value))
    first = _wanted(_first_digits(cells), "__before1", points)
    second = _wanted(_second_digits(cells, first), "__before2", points)
    values = _values(cells, second)

    def at(rank: Column) -> Column:
        hit = (rank >= F.col("__start")) & (rank < F.col("__start") + F.col("__n"))
        return F.max(F.when(hit, F.col("__v")))

    picks = [F.max("__size").alias("__size")]
    for i, p in enumerate(points):
        low, high, _ = _ranks(p, F.col("__size"))
        picks += [at(low).alias(f"__lo{i}"), at(high).alias(f"__hi{i}")]
    cuts = []
    for i, p in enumerate(points):
        low, high = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        between = low + (high - low) * _ranks(p, F.col("__size"))[2]
        cuts.append(F.when(low == high, low).otherwise(between))
    found = values.groupBy(KEY).agg(*picks)
    return found.select(
        *[F.col(KEY)[k].alias(k) for k in keys],
        *[cut.alias(name) for name, cut in zip(probs, cuts)],
    )


def average_ranks(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value) -> 1-based average rank within the group, and group size.

    One row per distinct value; join back on (keys, value).
    """
    cells = _with_digits(_value_counts(df, keys, value))
    values = _values(cells, _second_digits(cells, _first_digits(cells)))
    return values.select(
        *[F.col(KEY)[k].alias(k) for k in keys],
        F.col("__v").alias(value),
        (F.col("__start") + (F.col("__n") + 1) / 2).alias("rank"),
        F.col("__size").alias("group_size"),
    )


def bounded_quantiles(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """Same result for groups whose size is bounded by construction
    (days of a window, draws of a run with a declared length)."""
    wanted = F.percentile(F.col(value), F.array(*[F.lit(p) for p in probs.values()]))
    out = df.groupBy(*keys).agg(wanted.alias("__q"))
    return out.select(
        *keys, *[F.col("__q")[i].alias(name) for i, name in enumerate(probs)]
    )
