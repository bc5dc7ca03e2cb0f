"""Joins between events, attachments, the attachment master and machines.

None of the sides carries a broadcast hint: the master and the standard
configuration are small today, but their size is checked by Spark's own
statistics (static and adaptive) and a shuffle join takes over beyond the
threshold.  A machine that owns a large share of the events is joined in
salted pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fieldcast.functions.text import composite_key, first_digit, strip_blanks
from fieldcast.operators.keys import left_join, salted_left_join


def name_attachments(
    attachments: DataFrame,
    master: DataFrame,
    code: str,
    master_code: str,
    machine_parts: list[str],
    machine_key: str,
    null_text: str | None = None,
    null_safe: bool = False,
) -> DataFrame:
    """Clean the device code, look up the master and build the machine key."""
    cleaned = attachments.withColumn(code, strip_blanks(F.col(code).cast("string")))
    keyed = master.withColumn(master_code, F.col(master_code).cast("string"))
    named = left_join(
        cleaned, keyed.withColumnRenamed(master_code, code), [code], null_safe
    )
    key = composite_key(*[F.col(c) for c in machine_parts], null_text=null_text)
    return named.withColumn(machine_key, key).distinct()


def attach_to_events(
    events: DataFrame,
    attachments: DataFrame,
    key: str | list[str],
    columns: list[str],
    null_safe: bool = False,
) -> DataFrame:
    """Every event with every attachment of its machine.

    Events without an attachment stay, with nulls.  Events whose key has a
    null match nothing (unless ``null_safe``) and stay out of the shuffle of
    the join, where they would all meet in one partition.  Both sides are reduced to
    distinct rows first, so a machine contributes (its distinct events) x (its
    distinct attachments), which is the result itself; no larger intermediate
    arises.  A machine with a large share of the events is joined in pieces.
    """
    keys = [key] if isinstance(key, str) else key
    right = attachments.select(*keys, *columns).distinct()
    rows = events.distinct()
    if null_safe:
        return left_join(rows, right, keys, null_safe)
    incomplete = F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))
    joined = salted_left_join(rows.where(~incomplete), right, keys)
    return joined.unionByName(rows.where(incomplete), allowMissingColumns=True)


def apply_standard_configuration(
    machines: DataFrame,
    standard: DataFrame,
    model: str,
    serial: str,
    attachment_class: str,
    attachment_name: str,
    feeder_class: str,
    standard_model: str,
    standard_digit: str,
    standard_name: str,
) -> DataFrame:
    """Unify feeder names with the standard equipment of (model, first digit).

    The recorded name is replaced only for feeders of a known configuration.
    """
    lookup = standard.select(
        F.col(standard_model).alias(model),
        F.col(standard_digit).cast("double").alias("__digit"),
        F.col(standard_name).alias("__standard"),
    )
    joined = machines.withColumn("__digit", first_digit(F.col(serial))).join(
        lookup, [model, "__digit"], "left"
    )
    override: Column = (F.col(attachment_class) == feeder_class) & F.col(
        "__standard"
    ).isNotNull()
    return (
        joined.withColumn(
            attachment_name,
            F.when(override, F.col("__standard")).otherwise(F.col(attachment_name)),
        )
        .drop("__digit", "__standard")
        .distinct()
    )
