"""Ranks of counted values by one range sort, for groups of any size.

(group, value) pairs come counted, so repeated values are one row. They are
dealt to partitions by ranges of (group, value), which splits a large group
into several, and stored once with the number of the partition. Inside a
partition a running sum gives the rank; the sums of the partitions before it,
one short row for each group and partition, are added. Several counts of the
same values (all draws, draws of the half chains) are ranked by the same sort.

The group is a struct, whose equality treats null like any other value.
Values are ordered as Spark orders doubles, NaN last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldcast.operators.stored import stored

KEY = "__k"


def key_struct(keys: list[str]) -> Column:
    return (F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(1))).alias(KEY)


def ordered(counts: DataFrame, value: str, columns: list[str]) -> DataFrame:
    """Adds ``c_before`` (sum of ``c`` over smaller values of the group) and ``c_size`` for each count ``c``.

    ``counts`` has one row for each (KEY, value). The result is a stored table.
    """
    part = "__part"
    dealt = counts.repartitionByRange(KEY, value).sortWithinPartitions(KEY, value)
    dealt = stored(dealt.withColumn(part, F.spark_partition_id()), "dealt")
    sums = dealt.groupBy(KEY, part).agg(*[F.sum(c).alias(c) for c in columns])
    group = Window.partitionBy(KEY)
    so_far = group.orderBy(part).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = sums.select(
        KEY,
        part,
        *[(F.sum(c).over(so_far) - F.col(c)).alias(f"{c}_offset") for c in columns],
        *[F.sum(c).over(group).alias(f"{c}_size") for c in columns],
    )
    inside = (
        Window.partitionBy(KEY, part)
        .orderBy(value)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranked = dealt.join(offsets, [KEY, part]).select(
        KEY,
        value,
        *columns,
        *[(F.col(f"{c}_offset") + F.sum(c).over(inside) - F.col(c)).alias(f"{c}_before") for c in columns],
        *[f"{c}_size" for c in columns],
    )
    return stored(ranked, "ordered")


def average_rank(count: str) -> Column:
    """1-based rank of the values of a row of ``ordered``, ties averaged."""
    return F.col(f"{count}_before") + (F.col(count) + 1) / 2


def picks(ranked: DataFrame, value: str, wanted: dict[str, tuple[float, str]]) -> DataFrame:
    """Interpolated quantiles per KEY: ``wanted`` has (probability, count) by output column; one pass."""
    aggregates, cuts = [], []
    for name, (p, c) in wanted.items():
        position = F.lit(p) * (F.col(f"{c}_size") - 1)
        for end, rank in (("low", F.floor(position)), ("high", F.ceil(position))):
            hit = (rank >= F.col(f"{c}_before")) & (rank < F.col(f"{c}_before") + F.col(c))
            aggregates.append(F.max(F.when(hit, F.col(value))).alias(f"{name}_{end}"))
        aggregates.append(F.max(position - F.floor(position)).alias(f"{name}_share"))
        low, high = F.col(f"{name}_low"), F.col(f"{name}_high")
        between = low + (high - low) * F.col(f"{name}_share")
        cuts.append(F.when(low == high, low).otherwise(between).alias(name))
    return ranked.groupBy(KEY).agg(*aggregates).select(KEY, *cuts)
