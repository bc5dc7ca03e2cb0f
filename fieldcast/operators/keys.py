"""Join helpers shared by the operators."""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import DataFrame, functions as F, types as T


def join_null_safe(
    left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner"
) -> DataFrame:
    """Equi join on same-named keys in which null matches null.

    Only the left copy of the keys is kept.
    """
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    condition = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    )
    return left.join(renamed, condition, how).drop(*[f"__r_{k}" for k in keys])


def left_join(
    left: DataFrame, right: DataFrame, keys: list[str], null_safe: bool = False
) -> DataFrame:
    """Left equi join; nulls match only when ``null_safe`` is set."""
    if null_safe:
        return join_null_safe(left, right, keys, "left")
    return left.join(right, keys, "left")


#: a key with a larger share of the rows is joined in pieces
HEAVY_SHARE = 1 / 64


def heavy_keys(rows: DataFrame, keys: list[str], share: float = HEAVY_SHARE) -> DataFrame | None:
    """(keys, pieces) of the keys that own more than ``share`` of the rows; none if there are none.

    Fewer than 1 / ``share`` keys can, so their table is small whatever the
    data.  Counts are combined before their shuffle.
    """
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    total = rows.count()
    found = counts.where(F.col("__n") > share * total).collect()
    if not found:
        return None
    kinds = [(k, rows.schema[k].dataType) for k in keys] + [("__pieces", T.IntegerType())]
    table = [(*(r[k] for k in keys), ceil(r["__n"] / (share * total))) for r in found]
    return rows.sparkSession.createDataFrame(table, T.StructType([T.StructField(*k) for k in kinds]))



def salted_left_join(
    left: DataFrame, right: DataFrame, keys: list[str], share: float = HEAVY_SHARE
) -> DataFrame:
    """Left equi join in which no key brings more than about ``share`` of the left rows to one task.

    Heavy keys of the left are found by counting. Their rows are dealt to
    pieces by a hash of the row, and the right rows of those keys are repeated
    once per piece; all other rows join as they are. Keys with a null match nothing.
    """
    complete = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    heavy = heavy_keys(left.where(complete), keys, share)
    if heavy is None:
        return left.join(right, keys, "left")
    heavy = F.broadcast(heavy)  # fewer than 1 / share rows
    salt = "__salt"
    dealt = left.join(heavy, keys, "left").withColumn(
        salt, F.coalesce(F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.col("__pieces")).cast("int"), F.lit(0))
    )
    repeated = right.join(heavy, keys, "left").withColumn(
        salt, F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__pieces") - 1, F.lit(0))))
    )
    return dealt.drop("__pieces").join(repeated.drop("__pieces"), [*keys, salt], "left").drop(salt)
