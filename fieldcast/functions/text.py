"""Text expressions: keys, flags, codes and indexed parameter names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The spellings accepted as a logical constant.
TRUE_WORDS = ("T", "TRUE", "true", "True")
FALSE_WORDS = ("F", "FALSE", "false", "False")

INDEXED_NAME = r"^(\w+)\[(\d+)(?:,(\d+))?\]$"


def composite_key(*parts: Column, null_text: str | None = None) -> Column:
    """Concatenate the parts.

    A null part makes the key null; with ``null_text`` it is written as that
    text instead.
    """
    parts = tuple(p.cast("string") for p in parts)
    if null_text is not None:
        parts = tuple(F.coalesce(p, F.lit(null_text)) for p in parts)
    return F.concat(*parts)


def strip_blanks(text: Column) -> Column:
    """Remove every blank and tab."""
    return F.translate(text, " \t", "")


def to_boolean(text: Column) -> Column:
    """Logical from text; anything that is not a logical word becomes null."""
    text = text.cast("string")
    return F.when(text.isin(*TRUE_WORDS), F.lit(True)).when(
        text.isin(*FALSE_WORDS), F.lit(False)
    )


def first_digit(serial: Column) -> Column:
    """Leading character of a serial as a number, null when it is no digit."""
    return F.substring(serial.cast("string"), 1, 1).try_cast("double")


def contains_token(name: Column, token: str) -> Column:
    """Substring match that ignores case."""
    return F.contains(F.lower(name), F.lower(F.lit(token)))


def strip_prefix(name: Column, width: int) -> Column:
    """Drop the first ``width`` characters."""
    return F.substr(name, F.lit(width + 1))


def indexed_name(variable: Column, i1: Column, i2: Column | None = None) -> Column:
    """``name[i]`` or ``name[i,j]``."""
    if i2 is None:
        return F.concat(variable, F.lit("["), i1.cast("string"), F.lit("]"))
    inner = F.concat_ws(",", i1.cast("string"), i2.cast("string"))
    return F.concat(variable, F.lit("["), inner, F.lit("]"))


def parse_indexed(name: Column) -> tuple[Column, Column, Column]:
    """Split ``name[i,j]`` into (variable, i1, i2); scalars have null indexes."""
    has_index = name.rlike(INDEXED_NAME)
    variable = F.when(has_index, F.regexp_extract(name, INDEXED_NAME, 1)).otherwise(name)
    i1 = F.when(has_index, F.regexp_extract(name, INDEXED_NAME, 2)).try_cast("int")
    i2 = F.when(has_index, F.regexp_extract(name, INDEXED_NAME, 3)).try_cast("int")
    return variable, i1, i2


def rounded_label(value: Column, digits: int) -> Column:
    """Half-even rounding, the convention of the published labels."""
    return F.bround(value, digits)
