"""Ordered recursions over array columns.

One row holds one (draw, series); its innovations are an array over time.  The
recursions run inside the row, so they need neither a shuffle nor a Python
worker.  A naive fold that appends one element per step copies the whole
output at every step; ``scan`` works in blocks so that a series of length T
costs about T * sqrt(T) element copies instead of T * T.

An expression that appears inside a lambda is evaluated for every element, and
the optimizer may inline a computed column there.  ``let`` pins such a value:
it is evaluated once and the body refers to the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

BLOCK = 32


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` applied to ``value``, which is evaluated exactly once."""
    return F.transform(F.array(value), body)[0]


def scan(
    items: Column,
    initial: Column,
    emit: Callable[[Column, Column], Column],
    advance: Callable[[Column, Column], Column],
    out_type: str,
    block: int = BLOCK,
) -> Column:
    """Array of outputs of a left fold.

    ``emit(state, item)`` is the output of a step, of type ``out_type``;
    ``advance(state, output)`` is the next state, with the type of ``initial``.
    """
    empty = F.array().cast(f"array<{out_type}>")
    empty_blocks = F.array().cast(f"array<array<{out_type}>>")

    def inner(acc: Column, item: Column) -> Column:
        return let(
            emit(acc["state"], item),
            lambda out: F.struct(
                advance(acc["state"], out).alias("state"),
                F.array_append(acc["out"], out).alias("out"),
            ),
        )

    def outer(acc: Column, start: Column) -> Column:
        done = F.aggregate(
            F.slice(acc["items"], start, F.lit(block)),
            F.struct(acc["state"].alias("state"), empty.alias("out")),
            inner,
        )
        return let(
            done,
            lambda d: F.struct(
                acc["items"].alias("items"),
                d["state"].alias("state"),
                F.array_append(acc["out"], d["out"]).alias("out"),
            ),
        )

    def run(xs: Column) -> Column:
        starts = F.when(
            F.size(xs) > 0, F.sequence(F.lit(1), F.size(xs), F.lit(block))
        ).otherwise(F.array().cast("array<int>"))
        first = F.struct(
            xs.alias("items"), initial.alias("state"), empty_blocks.alias("out")
        )
        return F.aggregate(starts, first, outer, lambda acc: F.flatten(acc["out"]))

    return let(items, run)


def running_sum(items: Column, start: float = 0.0) -> Column:
    initial = F.struct(F.lit(float(start)).alias("total"))
    return scan(
        items,
        initial,
        lambda state, item: state["total"] + item,
        lambda state, total: F.struct(total.alias("total")),
        "double",
    )


def random_walk(errors: Column, scale: Column, scale_first: bool = True) -> Column:
    """``x_t = x_{t-1} + scale * e_t`` from zero.

    With ``scale_first=False`` the first innovation enters unscaled.
    """
    if scale_first:
        steps = F.transform(errors, lambda e: scale * e)
    else:
        steps = F.transform(
            errors, lambda e, i: F.when(i == 0, e).otherwise(scale * e)
        )
    return running_sum(steps)


def level_second_order(
    errors: Column, intercept: Column, slope: Column, scale: Column
) -> Column:
    """``m_t = c + b (2 m_{t-1} - m_{t-2}) + s e_t``.

    The first point has no autoregressive part, the second only ``b m_1``.
    """
    initial = F.struct(
        F.lit(0.0).alias("m1"), F.lit(0.0).alias("m2"), F.lit(0).alias("t")
    )

    def emit(state: Column, e: Column) -> Column:
        pull = F.when(state["t"] >= 2, 2.0 * state["m1"] - state["m2"]).otherwise(
            state["m1"]
        )
        return intercept + slope * pull + scale * e

    def advance(state: Column, m: Column) -> Column:
        return F.struct(
            m.alias("m1"), state["m1"].alias("m2"), (state["t"] + 1).alias("t")
        )

    return scan(errors, initial, emit, advance, "double")


def level_first_order(
    errors: Column, intercept: Column, slope: Column, scale: Column
) -> Column:
    """``m_t = c + b m_{t-1} + s e_t`` with first point ``c + b e_1``."""
    initial = F.struct(F.lit(0.0).alias("m1"), F.lit(0).alias("t"))

    def emit(state: Column, e: Column) -> Column:
        return F.when(state["t"] == 0, intercept + slope * e).otherwise(
            intercept + slope * state["m1"] + scale * e
        )

    def advance(state: Column, m: Column) -> Column:
        return F.struct(m.alias("m1"), (state["t"] + 1).alias("t"))

    return scan(errors, initial, emit, advance, "double")


def seasonal_week(errors: Column, scale: Column, scale_first: bool = True) -> Column:
    """Seven-day pattern from T - 6 innovations.

    The first six values are the scaled first six innovations (unscaled with
    ``scale_first=False``); from then on each value is minus the sum of the six
    before it plus a scaled innovation, where innovations are read from the
    start again.
    """
    def head_of(xs: Column) -> Column:
        return F.transform(F.slice(xs, 1, 6), lambda e: scale * e if scale_first else e)

    def emit(state: Column, e: Column) -> Column:
        total = state["g0"]
        for i in range(1, 6):
            total = total + state[f"g{i}"]
        return -total + scale * e

    def advance(state: Column, g: Column) -> Column:
        return F.struct(
            *[state[f"g{i + 1}"].alias(f"g{i}") for i in range(5)], g.alias("g5")
        )

    def run(pair: Column) -> Column:
        head = pair["head"]
        initial = F.struct(*[F.get(head, i).alias(f"g{i}") for i in range(6)])
        return F.concat(head, scan(pair["errors"], initial, emit, advance, "double"))

    return let(
        errors,
        lambda xs: let(F.struct(xs.alias("errors"), head_of(xs).alias("head")), run),
    )
