"""Date expressions.

All date logic is day grained.  Text that is not a valid date becomes null:
``try_to_date`` is used everywhere because ANSI casts would abort the job on
the first malformed record.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def parse_month(text: Column) -> Column:
    """``YYYYMM`` -> first day of that month."""
    return F.try_to_date(text, "yyyyMM")


def parse_day(text: Column) -> Column:
    """``YYYYMMDD`` -> date."""
    return F.try_to_date(text, "yyyyMMdd")


def parse_compact_date(text: Column) -> Column:
    """Date from 8 or 6 digits, decided value by value (null stays null)."""
    text = text.cast("string")
    return (
        F.when(F.length(text) == 8, parse_day(text))
        .when(F.length(text) == 6, parse_month(text))
    )


def month_start(day: Column) -> Column:
    return F.trunc(day, "MM")


def month_span(start: Column, end: Column) -> Column:
    """Whole months from ``start`` to ``end`` counted along a month sequence.

    The sequence keeps the day of month and lets it overflow into the next
    month (31 Jan + 1 month = 3 Mar), so element k is "first of the k-th month
    plus day - 1".  Only the last two candidate elements can lie beyond
    ``end``.  ``end`` before ``start`` gives -1.
    """
    first = F.trunc(start, "MM")
    shift = F.dayofmonth(start) - 1

    def element(k: Column) -> Column:
        return F.date_add(F.add_months(first, k), shift)

    k0 = (
        (F.year(end) - F.year(start)) * 12 + (F.month(end) - F.month(start))
    ).cast("int")
    over = (element(k0) > end).cast("int")
    over_before = ((k0 >= 1) & (element(k0 - 1) > end)).cast("int")
    return (
        F.when(start.isNull() | end.isNull(), F.lit(None).cast("int"))
        .when(end < start, F.lit(-1))
        .otherwise(k0 - over - over_before)
    )


def day_index(day: Column, start: Column) -> Column:
    """1-based position of ``day`` on a calendar that begins at ``start``."""
    return F.datediff(day, start) + 1
