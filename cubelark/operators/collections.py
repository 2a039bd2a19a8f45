"""Verbs that make one array out of a collection."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce as fold

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import types
from ..errors import InvalidValueTypeError, MissingDimensionError, ReservedDimensionError
from ..functions.scalar import flag, truth
from ..model import GROUP, RESERVED, VALUE, Axis, CubeArray, CubeCollection
from . import verbs

ORDER = "__ord"


def _one_type(collection: CubeCollection, track: bool, only: str | None = None) -> str | None:
    known = {a.vtype for a in (collection.elements or [collection.first])}
    if not track:
        return known.pop() if len(known) == 1 else None
    if only and known - {only, None}:
        raise InvalidValueTypeError(f"all arrays must be {only}, not {sorted(map(str, known))}")
    if len(known) > 1:
        raise InvalidValueTypeError(f"arrays of different value types: {sorted(map(str, known))}")
    return known.pop()


def _shared(elements: tuple[CubeArray, ...]) -> bool:
    return len({(a.token, a.dims) for a in elements}) == 1


def _stacked(elements: tuple[CubeArray, ...]) -> DataFrame:
    """All cells of all arrays, told apart by their place in the collection.  Arrays on one frame are read once."""
    first = elements[0]
    if _shared(elements):
        parts = F.array(*[F.struct(F.lit(i).alias(ORDER), a.expr.alias(VALUE)) for i, a in enumerate(elements)])
        return first.base.select(*first.dims, F.explode(parts).alias("__p")).select(*first.dims, f"__p.{ORDER}", f"__p.{VALUE}")
    frames = [a.df.withColumn(ORDER, F.lit(i)) for i, a in enumerate(elements)]
    return fold(lambda a, b: a.unionByName(b), frames)


def _axes(elements: tuple[CubeArray, ...]) -> dict[str, Axis]:
    """Indexes of the union: of arrays on one frame those of the first, else all coordinates."""
    first = elements[0]
    if _shared(elements):
        return dict(first.axes)
    return {d: Axis(d, fold(lambda a, b: a.unionByName(b), [a.axis(d).frame.select(d) for a in elements]).distinct(), first.axis(d).descending) for d in first.dims}


def compose(collection: CubeCollection, *, track_types: bool = True) -> CubeArray:
    """Number of the first array, from 1, that is true; missing where none is."""
    _one_type(collection, track_types, types.BINARY)
    if collection.grouped is not None:
        g = collection.grouped
        ranks = g.base.select(GROUP).distinct().withColumn("__r", F.row_number().over(_by(GROUP)))
        names = {r["__r"]: str((g.group_names or {}).get(r[GROUP], r[GROUP])) for r in ranks.collect()}  # one row a group
        dims = tuple(d for d in g.dims if d != GROUP)
        frame = g.df.join(ranks, GROUP).groupBy(*dims).agg(F.min(F.when(truth(F.col(VALUE)), F.col("__r"))).alias(VALUE))
        return g.with_frame(frame, dims, vtype=types.NOMINAL, labels=names, fixed=())
    elements = collection.elements
    labels = {i: a.name or str(i) for i, a in enumerate(elements, 1)}
    if _shared(elements):
        expr: Column = F.when(truth(elements[0].expr), 1)
        for i, a in enumerate(elements[1:], 2):
            expr = expr.when(truth(a.expr), i)
        return elements[0].with_expr(expr, vtype=types.NOMINAL, labels=labels, name=None)
    frame = _stacked(elements).groupBy(*elements[0].dims).agg((F.min(F.when(truth(F.col(VALUE)), F.col(ORDER))) + 1).alias(VALUE))
    return elements[0].with_frame(frame, vtype=types.NOMINAL, labels=labels, name=None, axes=_axes(elements))


def _by(column: str):
    from pyspark.sql import Window

    return Window.orderBy(column)


def _merged_labels(elements: tuple[CubeArray, ...]) -> Mapping | None:
    if not all(a.labels for a in elements):
        return None
    merged: dict = {}
    for a in elements:
        merged = dict(a.labels) | merged
    return merged


def concatenate(collection: CubeCollection, dimension: str, vtype: str = types.NOMINAL, *, track_types: bool = True) -> CubeArray:
    """One array along a new dimension labelled by the arrays' names, or along one that all have.

    Along an existing dimension, of cells that several arrays have the first value counts.
    """
    kind = _one_type(collection, track_types)
    if collection.grouped is not None:
        return _concatenate_groups(collection.grouped, dimension)
    elements = collection.elements
    have = [dimension in a.dims for a in elements]
    if any(have) and not all(have):
        raise MissingDimensionError(f"not all arrays have the dimension {dimension!r}")
    first = elements[0]
    labels = _merged_labels(elements)
    if all(have):
        pick = F.min_by(VALUE, F.when(F.col(VALUE).isNotNull(), F.col(ORDER)))
        frame = _stacked(elements).groupBy(*first.dims).agg(pick.alias(VALUE))
        return first.with_frame(frame, vtype=kind, labels=labels, axes=_axes(elements))
    if dimension in RESERVED:
        raise ReservedDimensionError(f"{dimension!r} can't name a new dimension")
    names = [a.name or str(i) for i, a in enumerate(elements, 1)]
    label = F.get(F.array(*map(F.lit, names)), F.col(ORDER))
    frame = _stacked(elements).withColumn(dimension, label).drop(ORDER)
    index = first.base.sparkSession.createDataFrame([(n,) for n in names], f"`{dimension}` string")
    axes = _axes(elements) | {dimension: Axis(dimension, index)}
    return first.with_frame(frame, (dimension, *first.dims), vtype=kind, labels=labels, axes=axes, name=None)


def _concatenate_groups(g: CubeArray, dimension: str) -> CubeArray:
    dims = tuple(d for d in g.dims if d != GROUP)
    axes = {d: Axis(d, a.frame.select(d).distinct(), a.descending, tuple(b for b in a.by if b != GROUP)) for d, a in g.axes.items()}
    fixed = tuple(d for d in g.fixed if d != GROUP)
    if dimension in dims:  # a cell is in one group only, so dropping the group puts the parts together again
        pick = F.min_by(VALUE, F.when(F.col(VALUE).isNotNull(), F.col(GROUP)))
        coords = [c for c in g.coords]
        return g.with_frame(g.cells().groupBy(*dims, *coords).agg(pick.alias(VALUE)), dims, fixed=fixed, axes=axes, group_names=None)
    if dimension in RESERVED:
        raise ReservedDimensionError(f"{dimension!r} can't name a new dimension")
    key = verbs.named(F.col(GROUP), g.group_names) if g.group_names else F.col(GROUP)
    frame = g.cells().withColumn(dimension, key).drop(GROUP)
    return g.with_frame(frame, (dimension, *dims), fixed=fixed, axes=axes | {dimension: Axis(dimension, frame.select(dimension).distinct())}, group_names=None, name=None)


#: Reducers over arrays on one frame, as row expressions: (values, numbers of those present) -> result.
_ROW = {
    "any": lambda vs: F.greatest(*[flag(truth(v)) for v in vs]),
    "all": lambda vs: F.least(*[flag(truth(v)) for v in vs]),
    "none": lambda vs: 1 - F.greatest(*[flag(truth(v)) for v in vs]),
    "max": lambda vs: F.greatest(*vs),
    "min": lambda vs: F.least(*vs),
    "first": lambda vs: F.coalesce(*vs),
    "last": lambda vs: F.coalesce(*vs[::-1]),
    "n": lambda vs: _present(vs),
    "count": lambda vs: F.when(_present(vs) > 0, _total([truth(v).cast("bigint") for v in vs])),
    "sum": lambda vs: F.when(_present(vs) > 0, _total(vs)),
    "mean": lambda vs: F.when(_present(vs) > 0, _total(vs) / _present(vs)),
    "percentage": lambda vs: F.when(_present(vs) > 0, _total([truth(v).cast("bigint") for v in vs]) * 100 / _present(vs)),
}


def _present(vs: list[Column]) -> Column:
    return fold(lambda a, b: a + b, [v.isNotNull().cast("bigint") for v in vs])


def _total(vs: list[Column]) -> Column:
    return fold(lambda a, b: a + b, [F.coalesce(v, F.lit(0)) for v in vs])


def merge(collection: CubeCollection, reducer: str, *, track_types: bool = True, custom: Mapping | None = None, manual: dict | None = None, **kwargs) -> CubeArray:
    """Reduces the values that the arrays have for a cell."""
    _one_type(collection, track_types)
    first = collection.first
    call = verbs.reducer_of(reducer, first, custom)
    vtype, labels = verbs.typed(reducer, first, track=track_types, manual=manual, custom=custom)
    if collection.grouped is not None:
        dims = tuple(d for d in first.dims if d != GROUP)
        axes = {d: Axis(d, a.frame.select(d).distinct(), a.descending, tuple(b for b in a.by if b != GROUP)) for d, a in first.axes.items()}
        frame = first.base.groupBy(*dims, *first.coords).agg(call(first.expr, F.col(GROUP), **kwargs).alias(VALUE))
        return first.with_frame(frame, dims, vtype=vtype, labels=labels, fixed=tuple(d for d in first.fixed if d != GROUP), axes=axes, group_names=None)
    elements = collection.elements
    if _shared(elements) and reducer in _ROW and reducer not in (custom or {}):
        values = [a.expr for a in elements]
        expr = _ROW[reducer](values) if len(values) > 1 or reducer not in ("any", "all", "none", "max", "min") else (flag(truth(values[0])) if reducer in ("any", "all") else 1 - flag(truth(values[0])) if reducer == "none" else values[0])
        return first.with_expr(expr, vtype=vtype, labels=labels, name=None)
    frame = _stacked(elements).groupBy(*first.dims).agg(call(F.col(VALUE), F.col(ORDER), **kwargs).alias(VALUE))
    return first.with_frame(frame, vtype=vtype, labels=labels, name=None, axes=_axes(elements), absent=0 if reducer == "n" else None)
