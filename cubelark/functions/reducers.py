"""Reducers of `reduce`, `smooth` and `merge`, as Spark aggregates.

Missing values are ignored.  Where all are missing the result is missing, but
for `n`, which is zero.  `first` and `last` go by an explicit order column.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import flag, truth

#: (value, order, over) -> result.  `over` turns each aggregate into a window function where the
#: reducer runs in a window; in a grouped aggregation it changes nothing.
Reducer = Callable[..., Column]


def plain(aggregate: Column) -> Column:
    return aggregate


def _one(aggregate: Callable[[Column], Column]) -> Reducer:
    return lambda v, order, over=plain: over(aggregate(v))


def time_range(v: Column, order: Column, over: Callable[[Column], Column] = plain) -> Column:
    """Nanoseconds between the first and the last time."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(over(F.max(v))) - micros(over(F.min(v)))) * 1000


def _end(pick: Callable) -> Reducer:
    # rows whose order is missing don't take part
    return lambda v, order, over=plain: over(pick(v, F.when(v.isNotNull(), order)))


REDUCERS: dict[str, Reducer] = {
    "mean": _one(F.avg),
    "median": _one(lambda v: F.percentile(v.cast("double"), F.lit(0.5))),
    "mode": _one(lambda v: F.mode(v, True)),
    "max": _one(F.max),
    "min": _one(F.min),
    "range": lambda v, order, over=plain: over(F.max(v)) - over(F.min(v)),
    "n": _one(F.count),
    "product": _one(lambda v: F.product(v.cast("double"))),
    "standard_deviation": _one(lambda v: F.stddev_pop(v.cast("double"))),
    "sum": _one(F.sum),
    "variance": _one(lambda v: F.var_pop(v.cast("double"))),
    "all": lambda v, order, over=plain: flag(over(F.bool_and(truth(v)))),
    "any": lambda v, order, over=plain: flag(over(F.bool_or(truth(v)))),
    "none": lambda v, order, over=plain: flag(~over(F.bool_or(truth(v)))),
    "count": _one(lambda v: F.sum(truth(v).cast("bigint"))),
    "percentage": lambda v, order, over=plain: over(F.avg(truth(v).cast("int"))) * 100,
    "first": _end(F.min_by),
    "last": _end(F.max_by),
}

#: These combine from partial results along one axis after the other, so a square window can be two line windows.
SEPARABLE = ("sum", "n", "max", "min", "all", "any", "none", "count")
