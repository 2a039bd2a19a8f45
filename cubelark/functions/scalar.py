"""Operators of `evaluate`, as Spark expressions.

A missing value is NULL.  Operators follow the left operand: where it is missing
the result is missing.  A missing right operand counts as zero or false for
logic and comparison, and makes arithmetic missing.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import Interval, TimeBounds

NAN = float("nan")


def known(value: Column) -> Column:
    """NaN, which functions outside their domain give, is missing."""
    return F.when(~F.isnan(value), value)


def truth(value: Column) -> Column:
    return value.cast("double") != 0


def flag(condition: Column) -> Column:
    return condition.cast("int")


def _inverse(value: Column) -> Column:
    return F.try_divide(F.lit(1.0), value)


def _compare(test: Callable[[Column, Column], Column], if_missing: bool) -> Callable[[Column, Column], Column]:
    return lambda x, y: F.when(x.isNotNull(), flag(F.coalesce(test(x, y), F.lit(if_missing))))


def _logic(test: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    return lambda x, y: F.when(x.isNotNull(), flag(test(truth(x), F.coalesce(truth(y), F.lit(False)))))


#: One operand.  Double results stay double, flags are 0 or 1.
UNARY: dict[str, Callable[[Column], Column]] = {
    "not": lambda x: flag(~truth(x)),
    "is_missing": lambda x: flag(x.isNull()),
    "not_missing": lambda x: flag(x.isNotNull()),
    "absolute": F.abs,
    "ceiling": lambda x: F.ceil(x).cast("double"),
    "floor": lambda x: F.floor(x).cast("double"),
    "cosine": F.cos,
    "cosecant": lambda x: _inverse(F.sin(x)),
    "cotangent": lambda x: _inverse(F.tan(x)),
    "cube_root": F.cbrt,
    "exponential": F.exp,
    "natural_logarithm": F.ln,
    "secant": lambda x: _inverse(F.cos(x)),
    "sine": F.sin,
    "square_root": lambda x: F.when(x >= 0, F.sqrt(x)),
    "tangent": F.tan,
    "to_degrees": F.degrees,
    "to_radians": F.radians,
}

#: Two operands, both expressions.
BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "add": lambda x, y: x + y,
    "subtract": lambda x, y: x - y,
    "multiply": lambda x, y: x * y,
    "divide": lambda x, y: F.try_divide(x.cast("double"), y.cast("double")),
    "power": lambda x, y: known(F.pow(x.cast("double"), y.cast("double"))),
    "normalized_difference": lambda x, y: F.try_divide((x - y).cast("double"), (x + y).cast("double")),
    "and": _logic(lambda x, y: x & y),
    "or": _logic(lambda x, y: x | y),
    "exclusive_or": _logic(lambda x, y: x != y),
    "equal": _compare(lambda x, y: x == y, False),
    "not_equal": _compare(lambda x, y: x != y, True),
    "greater": _compare(lambda x, y: x > y, False),
    "greater_equal": _compare(lambda x, y: x >= y, False),
    "less": _compare(lambda x, y: x < y, False),
    "less_equal": _compare(lambda x, y: x <= y, False),
}

#: Two operands, the second a set, interval, geometry, times or an array as a whole.
MEMBERSHIP = ("in", "not_in")
TEMPORAL = ("after", "before", "during")
SPATIAL = ("intersects",)
NAMES = (*UNARY, *BINARY, *MEMBERSHIP, *TEMPORAL, *SPATIAL)


def member(name: str, x: Column, y: object) -> Column:
    """`in` and `not_in` with a set or a closed interval; missing members of a set are ignored."""
    if isinstance(y, Interval):
        inside = x.between(F.lit(y.lower), F.lit(y.upper))
    else:
        members = [v for v in (y if isinstance(y, (list, tuple, set, frozenset)) else [y]) if v is not None and not (isinstance(v, float) and math.isnan(v))]
        inside = x.isin(*members) if members else F.lit(False)
    return F.when(x.isNotNull(), flag(inside if name == "in" else ~inside))


def temporal(name: str, x: Column, bounds: TimeBounds) -> Column:
    """Position of a time relative to a closed interval; an instant is an interval of no length."""
    low, high = bounds.columns()
    test = {"after": x > high, "before": x < low, "during": (x >= low) & (x <= high)}[name]
    return F.when(x.isNotNull(), flag(F.coalesce(test, F.lit(False))))


def assign(x: Column, y: Column) -> Column:
    """`y` where `x` is present."""
    return F.when(x.isNotNull(), y)


def assign_at(x: Column, y: Column, at: Column) -> Column:
    """`y` where `at` is true, also on missing cells, else `x`."""
    return F.when(F.coalesce(truth(at), F.lit(False)), y).otherwise(x)
