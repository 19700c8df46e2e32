"""Numeric guards, predicates and reducers.

Spark orders NaN above every number and calls NaN equal to NaN, so each comparison
with a threshold carries an explicit NaN guard.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")
INF = float("inf")


def finite(value: Column) -> Column:
    """True for a number that is neither null, NaN nor infinite (NaN sorts above infinity)."""
    return F.coalesce(F.abs(value) < F.lit(INF), F.lit(False))


def at_least(value: Column, threshold: Column | float) -> Column:
    """``value >= threshold`` with NaN and null comparing false."""
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return F.coalesce(~F.isnan(value) & (value >= limit), F.lit(False))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient that is null on a zero denominator (ANSI division would raise)."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


# --- predicates -------------------------------------------------------------

PredicateFn = Callable[[Column, Column], Column]

# The six comparison operators of a rule predicate.
PREDICATES: dict[str, PredicateFn] = {
    ">": lambda v, t: v > t,
    ">=": lambda v, t: v >= t,
    "<": lambda v, t: v < t,
    "<=": lambda v, t: v <= t,
    "==": lambda v, t: v == t,
    "!=": lambda v, t: v != t,
}


def register_predicate(symbol: str, fn: PredicateFn) -> None:
    PREDICATES[symbol] = fn


def predicate_holds(value: Column, op: Column | str, threshold: Column | float) -> Column:
    """``value op threshold``; a missing value or an unknown operator never holds."""
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    has_nan = F.isnan(value) | F.isnan(limit)

    def guarded(symbol: str) -> Column:
        plain = PREDICATES[symbol](value, limit)
        return F.when(has_nan, F.lit(symbol == "!=")).otherwise(plain)

    if isinstance(op, str):
        held = guarded(op)
    else:
        held = F.lit(False)
        for symbol in PREDICATES:
            held = F.when(op == symbol, guarded(symbol)).otherwise(held)
    return F.coalesce(held, F.lit(False))


# --- reducers over the cells of a region --------------------------------------

ReducerFn = Callable[[Column, Column], Column]


def _nan_aware_min(value: Column, _threshold: Column) -> Column:
    return F.when(F.bool_or(F.isnan(value)), F.lit(NAN)).otherwise(F.min(value))


REDUCERS: dict[str, ReducerFn] = {
    "max": lambda v, _t: F.max(v),
    "mean": lambda v, _t: F.avg(v),
    "min": _nan_aware_min,
    "count_ge": lambda v, t: F.count_if(at_least(v, t)).cast("double"),
}


def register_reducer(name: str, fn: ReducerFn) -> None:
    """Add a reducer ``(value, threshold) -> aggregate`` usable by name in polygon reads."""
    REDUCERS[name] = fn


def reduced_value(reducer: Column, value: Column, threshold: Column, names: list[str] | None = None) -> Column:
    """Value of the reducer each row asks for; all are computed in the same partial aggregate.

    ``reducer`` and ``threshold`` must be grouping columns.
    """
    out = F.lit(None).cast("double")
    for name in names or list(REDUCERS):
        out = F.when(reducer == name, REDUCERS[name](value, threshold)).otherwise(out)
    return out
