"""Verbs on single arrays that look at one cell, or at one group of cells, at a time."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import types
from ..errors import InvalidValueTypeError, MissingDimensionError, MixedDimensionsError, UnknownComponentError, UnknownDimensionError, UnknownOperatorError, UnknownReducerError
from ..functions import components, geometry, projection, scalar
from ..functions.reducers import REDUCERS, Reducer, time_range
from ..functions.values import Interval, TimeBounds
from ..model import GROUP, SPACE, TIME, VALUE, Axis, CubeArray, CubeCollection, X, Y, fresh, possible_types


def typed(function: str, x: CubeArray, *others: object, track: bool = True, manual: dict | None = None, custom: Mapping | None = None) -> tuple[str | None, Mapping | None]:
    """Value type and labels of a result; checks the operands if types are tracked.

    Custom functions are checked only if `manual` has rules for them.
    """
    if not track or function in (custom or {}) and function not in (manual or {}):
        return None, None
    operands = [possible_types(x.vtype)]
    for y in others:
        if isinstance(y, CubeArray):
            operands.append(possible_types(y.vtype))
        elif isinstance(y, Interval):
            operands.append(types.candidates([y.lower, y.upper]))
        elif isinstance(y, TimeBounds):
            operands.append((types.DATETIME,))
        elif isinstance(y, geometry.Geometry):
            operands.append((types.GEOMETRY,))
        else:
            operands.append(types.candidates(y))
    result, keep = types.resolve(function, *operands, manual=manual)
    second = others[0].labels if others and isinstance(others[0], CubeArray) else None
    return result, {types.NO_LABELS: None, types.FIRST_LABELS: x.labels, types.SECOND_LABELS: second}[keep]


def evaluate(x: CubeArray, operator: str, y: object = None, *, track_types: bool = True, custom: Mapping | None = None, manual: dict | None = None, **kwargs) -> CubeArray:
    """Applies an operator to every cell; an array as second operand is aligned to the first."""
    custom = custom or {}
    if operator not in custom and operator not in scalar.NAMES:
        raise UnknownOperatorError(f"there is no operator {operator!r}")
    vtype, labels = typed(operator, x, *([] if y is None else [y]), track=track_types, manual=manual, custom=custom)
    if operator in custom:
        call = custom[operator]
        if isinstance(y, CubeArray):
            x, y = x.aligned(y)
        elif y is not None:
            y = F.lit(y)
        expr = call(x.expr, **kwargs) if y is None else call(x.expr, y, **kwargs)
        return x.with_expr(expr, vtype=vtype or x.vtype, labels=labels)
    if operator in ("is_missing", "not_missing"):
        x = x if x.of is not None else x.densify()
    if operator in scalar.UNARY:
        return x.with_expr(scalar.UNARY[operator](x.expr), vtype=vtype, labels=labels, of=x.of)
    if operator in scalar.SPATIAL:
        return _intersects(x, y, vtype)
    if operator in scalar.TEMPORAL:
        x, bounds = _bounds(x, y)
        return x.with_expr(scalar.temporal(operator, x.expr, bounds), vtype=vtype, labels=labels, of=x.of if not isinstance(y, CubeArray) else None)
    if operator in scalar.MEMBERSHIP:
        if isinstance(y, CubeArray):
            return _member_of_array(x, operator, y, vtype)
        return x.with_expr(scalar.member(operator, x.expr, y), vtype=vtype, labels=labels, of=x.of)
    if isinstance(y, CubeArray):
        x, right = x.aligned(y)
        of = None if x.of is None or y.of is None else tuple(dict.fromkeys((*x.of, *y.of)))
    else:
        right, of = F.lit(y), x.of
    return x.with_expr(scalar.BINARY[operator](x.expr, right), vtype=vtype, labels=labels, of=of)


def _bounds(x: CubeArray, y: object) -> tuple[CubeArray, TimeBounds]:
    if isinstance(y, TimeBounds):
        return x, y
    if isinstance(y, CubeArray):
        ends = y.df.agg(F.min(VALUE).alias("__low"), F.max(VALUE).alias("__high"))  # one row
        return replace(x, base=x.base.crossJoin(F.broadcast(ends)), token=fresh()), TimeBounds(F.col("__low"), F.col("__high"))
    return x, TimeBounds(y, y)


def _member_of_array(x: CubeArray, operator: str, y: CubeArray, vtype: str | None) -> CubeArray:
    """Membership in all values of another array: an existence join, the array is not aligned."""
    values = y.df.where(F.col(VALUE).isNotNull()).select(F.col(VALUE).alias("__m")).distinct().withColumn("__in", F.lit(True))
    left = x.base.withColumn("__x", x.expr)
    joined = left.join(values, F.col("__x") == F.col("__m"), "left")
    inside = F.coalesce(F.col("__in"), F.lit(False))
    frame = joined.withColumn(VALUE, F.when(F.col("__x").isNotNull(), scalar.flag(inside if operator == "in" else ~inside))).drop("__x", "__m", "__in")
    return x.with_frame(frame.select(*x.dims, *x.coords, VALUE), vtype=vtype, labels=None, absent=None)


def _intersects(x: CubeArray, y: object, vtype: str | None) -> CubeArray:
    """Whether each cell's point lies in a geometry, or in the bounding box of another array's valid cells."""
    if any(d not in x.dims for d in (Y, X)):
        raise MissingDimensionError("intersects needs the dimensions y and x")
    if isinstance(y, CubeArray):
        box = y.df.where(F.col(VALUE).isNotNull()).agg(*[f(c).alias(f"__{n}_{c}") for c in (X, Y) for n, f in (("low", F.min), ("high", F.max))])  # one row
        base = x.base.crossJoin(F.broadcast(box))
        inside = F.col(X).between(F.col("__low_x"), F.col("__high_x")) & F.col(Y).between(F.col("__low_y"), F.col("__high_y"))
        x = replace(x, base=base, token=fresh())
    else:
        inside = geometry.contains(y, F.col(X), F.col(Y))
    return x.with_expr(scalar.flag(F.coalesce(inside, F.lit(False))), vtype=vtype, labels=None)


def extract(x: CubeArray, dimension: str, component: str | None = None) -> CubeArray:
    """A dimension's coordinates, or a component of them, as an array over that dimension."""
    if dimension == SPACE:
        if any(d not in x.dims for d in (Y, X)):
            raise UnknownDimensionError(f"there is no dimension {SPACE!r} among {x.dims}")
        if component is None:
            grid = x.axis(Y).frame.select(Y).distinct().crossJoin(x.axis(X).frame.select(X).distinct())
            return CubeArray(grid, F.struct(Y, X), (Y, X), {d: x.axis(d) for d in (Y, X)}, vtype=types.COORDS, of=(Y, X), features=x.features, feature_labels=x.feature_labels, tz=x.tz, crs=x.crs)
        if component == "feature":
            if x.features is None:
                raise UnknownComponentError("the space dimension has no features")
            of = ("feature",)
            own = x.features.join(x.axis(Y).frame.select(Y).distinct(), Y, "left_semi").join(x.axis(X).frame.select(X).distinct(), X, "left_semi")
            return CubeArray(own, F.col("feature"), (Y, X), {d: x.axis(d) for d in (Y, X)}, vtype=types.NOMINAL, labels=x.feature_labels, of=of, coords=of, features=x.features, feature_labels=x.feature_labels, tz=x.tz, crs=x.crs)
        if component not in (X, Y):
            raise UnknownComponentError(f"the space dimension has no component {component!r}")
        return _coordinate(x, component, F.col(component), types.CONTINUOUS, None)
    if dimension not in x.dims:
        raise UnknownDimensionError(f"there is no dimension {dimension!r} among {x.dims}")
    if dimension == TIME:
        expr, vtype, labels = components.time_component(component, F.col(TIME))
        return _coordinate(x, TIME, expr, vtype, labels)
    if component is not None:
        raise UnknownComponentError(f"dimension {dimension!r} has no component {component!r}")
    known = dict(x.base.dtypes)[dimension]
    return _coordinate(x, dimension, F.col(dimension), types.CONTINUOUS if dimension in (X, Y) else types.NOMINAL if known == "string" else None, None)


def _coordinate(x: CubeArray, dim: str, expr: Column, vtype: str | None, labels: Mapping | None) -> CubeArray:
    axis = x.axis(dim)
    return CubeArray(axis.frame.select(*axis.by, dim).distinct(), expr, (*axis.by, dim), {dim: axis}, vtype=vtype, labels=labels, of=(dim,), fixed=axis.by, tz=x.tz, crs=x.crs, features=x.features, feature_labels=x.feature_labels)


def filter(x: CubeArray, filterer: CubeArray, *, track_types: bool = True) -> CubeArray:
    """Keeps cells where the filterer is true; the others, and those without a filterer value, become missing."""
    if track_types and filterer.vtype not in (None, types.BINARY):
        raise InvalidValueTypeError(f"a filterer must be binary, not {filterer.vtype}")
    aligned, keep = x.aligned(filterer)
    of = None if x.of is None or filterer.of is None else tuple(dict.fromkeys((*x.of, *filterer.of)))
    return aligned.with_expr(F.when(F.coalesce(scalar.truth(keep), F.lit(False)), aligned.expr), of=of)


def assign(x: CubeArray, y: object, at: CubeArray | None = None, *, track_types: bool = True) -> CubeArray:
    """New values for the cells that have one, or, with `at`, for the cells where that is true."""
    if at is None:
        vtype, labels = typed("assign", x, y, track=track_types)
        if isinstance(y, CubeArray):
            x, value = x.aligned(y)
        else:
            value = F.lit(y)
        return x.with_expr(scalar.assign(x.expr, value), vtype=vtype, labels=labels)
    if track_types and at.vtype not in (None, types.BINARY):
        raise InvalidValueTypeError(f"where to assign must be binary, not {at.vtype}")
    vtype, labels = typed("assign_at", x, y, track=track_types)
    x = x.densify()
    if isinstance(y, CubeArray):
        x, value = x.aligned(y)
    else:
        value = F.lit(y)
    x, where = x.aligned(at)
    return x.with_expr(scalar.assign_at(x.expr, value, where), vtype=vtype, labels=labels)


def groupby(x: CubeArray, grouper: CubeArray | list[CubeArray] | CubeCollection, labels_as_names: bool = True) -> CubeCollection:
    """Splits an array by the values of a grouper.  The groups stay one frame, told apart by a column.

    Several groupers split by their combinations.  Cells without a group are dropped.
    """
    groupers = list(grouper.elements) if isinstance(grouper, CubeCollection) else list(grouper) if isinstance(grouper, (list, tuple)) else [grouper]
    if any(not g.dims for g in groupers):
        raise MissingDimensionError("a grouper must have at least one dimension")
    if len({g.dims for g in groupers}) > 1:
        raise MixedDimensionsError("groupers must have the same dimensions")
    extra = [d for d in groupers[0].dims if d not in x.dims]
    if extra:
        raise UnknownDimensionError(f"dimensions {extra} of the grouper are not among {x.dims}")
    keys = []
    for g in groupers:
        x, key = x.aligned(g)
        keys.append(named(key, g.labels) if labels_as_names and g.labels and len(groupers) > 1 else key)
    key = keys[0] if len(keys) == 1 else F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)])
    present = keys[0].isNotNull()
    for k in keys[1:]:
        present &= k.isNotNull()
    frame = x.base.withColumn(VALUE, x.expr).withColumn(GROUP, key).where(present)
    axes = dict(x.axes)
    source = {c for g in groupers for c in (g.of or ("",))}
    if len(source) == 1 and (dim := next(iter(source))) in x.dims and dim not in x.fixed:  # groups divide the coordinates of one dimension
        axis = x.axis(dim)
        axes[dim] = Axis(dim, axis.frame.withColumn(GROUP, key), axis.descending, (*axis.by, GROUP))
    names = groupers[0].labels if len(groupers) == 1 and labels_as_names else None
    grouped = x.with_frame(frame.select(GROUP, *x.dims, *x.coords, VALUE), (GROUP, *x.dims), fixed=(GROUP, *x.fixed), axes=axes, group_names=names, dense=False)
    return CubeCollection(grouped=grouped)


def named(key: Column, labels: Mapping) -> Column:
    """Labels instead of values, where there is one."""
    expr = None
    for value, label in labels.items():
        expr = F.when(key == F.lit(value), F.lit(label)) if expr is None else expr.when(key == F.lit(value), F.lit(label))
    return expr.otherwise(key.cast("string"))


def reducer_of(name: str, x: CubeArray, custom: Mapping[str, Reducer] | None = None) -> Reducer:
    if custom and name in custom:
        return custom[name]
    if name not in REDUCERS:
        raise UnknownReducerError(f"there is no reducer {name!r}")
    return time_range if name == "range" and x.vtype == types.DATETIME else REDUCERS[name]


def reduce(x: CubeArray, reducer: str, dimension: str | None = None, *, track_types: bool = True, custom: Mapping | None = None, manual: dict | None = None, keep_attrs: bool = True, **kwargs) -> CubeArray:
    """Collapses a dimension, `space`, or all dimensions."""
    gone = x.spatial(dimension)
    call = reducer_of(reducer, x, custom)
    vtype, labels = typed(reducer, x, track=track_types, manual=manual, custom=custom)
    keep = tuple(d for d in x.dims if d not in gone)
    coords = tuple(c for c in x.coords if Y in keep and X in keep)
    order = x.order_of(tuple(d for d in x.dims if d in gone))
    value = call(x.expr, order, **kwargs) if kwargs else call(x.expr, order)
    frame = x.base.groupBy(*keep, *coords).agg(value.alias(VALUE)) if keep else x.base.agg(value.alias(VALUE))
    return x.with_frame(frame, keep, vtype=vtype or (x.vtype if reducer in (custom or {}) else None), labels=labels if keep_attrs else None, absent=0 if reducer == "n" else None, dense=x.dense)


def reduce_many(x: CubeArray, reducers: list[str], dimension: str | None = None, custom: Mapping | None = None) -> DataFrame:
    """Several reducers over the same dimension in one aggregation: the kept dimensions and one column each."""
    gone = x.spatial(dimension)
    keep = [d for d in x.dims if d not in gone]
    order = x.order_of(tuple(d for d in x.dims if d in gone))
    for r in reducers:
        typed(r, x)
    values = [reducer_of(r, x, custom)(x.expr, order).alias(r) for r in reducers]
    return x.base.groupBy(*keep).agg(*values) if keep else x.base.agg(*values)


def name(x: CubeArray, value: str) -> CubeArray:
    return replace(x, name=value)


def trim(x: CubeArray, dimension: str | None = None) -> CubeArray:
    """Drops coordinates without any value: of y and x at the edges only, of other dimensions everywhere."""
    dims = x.spatial(dimension)
    space = [d for d in dims if d in (Y, X)]
    frame, axes = x.cells(), dict(x.axes)
    valid = frame.where(F.col(VALUE).isNotNull())
    for dim in (d for d in dims if d not in (Y, X)):
        keep = valid.select(*x.fixed, dim).distinct()
        frame = frame.join(keep, [*x.fixed, dim], "left_semi")
        axis = x.axis(dim)
        axes[dim] = Axis(dim, axis.frame.join(keep.select(*axis.by, dim).distinct(), [*axis.by, dim], "left_semi"), axis.descending, axis.by)
    for dim in space:
        ends = valid.groupBy(*x.fixed).agg(F.min(dim).alias("__low"), F.max(dim).alias("__high"))
        inside = F.col(dim).between(F.col("__low"), F.col("__high"))
        bounded = frame.join(ends, list(x.fixed)) if x.fixed else frame.crossJoin(F.broadcast(ends))
        frame = bounded.where(inside).drop("__low", "__high")
        axis = x.axis(dim)
        total = valid.agg(F.min(dim).alias("__low"), F.max(dim).alias("__high"))
        axes[dim] = Axis(dim, axis.frame.crossJoin(F.broadcast(total)).where(inside).drop("__low", "__high"), axis.descending, axis.by)
    return x.with_frame(frame, axes=axes)


def regularize(x: CubeArray) -> CubeArray:
    """Fills the gaps of y and x, so that either advances by the resolution."""
    if x.resolution is None:
        raise UnknownDimensionError("the array has no spatial resolution")
    axes = dict(x.axes)
    for dim, step in zip((Y, X), x.resolution, strict=True):
        axis = x.axis(dim)
        size = abs(step)
        ends = axis.frame.agg(F.min(dim).alias("a"), F.max(dim).alias("b"))
        filled = ends.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.round((F.col("b") - F.col("a")) / size).cast("bigint"))).alias("i"), "a").select((F.col("a") + F.col("i") * size).cast(dict(axis.frame.dtypes)[dim]).alias(dim))
        axes[dim] = Axis(dim, filled, axis.descending)
    return replace(x, axes=axes, dense=False)


def tz_convert(x: CubeArray, tz: str) -> CubeArray:
    """Times in another zone."""
    if TIME not in x.dims:
        return replace(x, tz=tz)
    moved = F.convert_timezone(F.lit(x.tz or "UTC"), F.lit(tz), F.col(TIME))
    axis = x.axis(TIME)
    axes = dict(x.axes) | {TIME: Axis(TIME, axis.frame.withColumn(TIME, moved), axis.descending, axis.by)}
    return x.with_frame(x.cells().withColumn(TIME, moved), axes=axes, tz=tz, dense=x.dense)


def rename_dims(x: CubeArray, mapping: Mapping[str, str]) -> CubeArray:
    dims = tuple(mapping.get(d, d) for d in x.dims)
    frame = x.cells().withColumnsRenamed(dict(mapping))
    axes = {mapping.get(d, d): Axis(mapping.get(d, d), a.frame.withColumnsRenamed(dict(mapping)), a.descending, a.by) for d, a in x.axes.items()}
    return x.with_frame(frame, dims, axes=axes, dense=x.dense)


def reproject(x: CubeArray, crs: str, resolution: tuple[float, float] | None = None) -> CubeArray:
    """The array on a grid of another reference system; each new cell has the value of the cell its centre lies in.

    The grid covers the transformed outline of the old one.  Without a (y, x)
    `resolution` its cells are squares, as many along the diagonal as before.
    The old grid must be regular; an array without y and x, or without a
    reference system, stays as it is but for the system's name.  Runs a small job for the grid's size.
    """
    if projection.same(x.crs, crs) or not {Y, X} <= set(x.dims):
        return replace(x, crs=crs)
    x = write_spatial_resolution(x if x.absent is None else x.densify())
    step = {d: abs(float(v)) or 1.0 for d, v in zip((Y, X), x.resolution, strict=True)}
    least, count = {}, {}
    for d in (Y, X):
        low, high = x.axis(d).frame.agg(F.min(d), F.max(d)).first()
        if low is None:
            return replace(x, crs=crs)
        least[d], count[d] = float(low), round((float(high) - float(low)) / step[d]) + 1
    edge = {d: (least[d] - step[d] / 2, least[d] + (count[d] - 0.5) * step[d]) for d in (Y, X)}
    x0, y0, x1, y1 = projection.project_bounds((edge[X][0], edge[Y][0], edge[X][1], edge[Y][1]), x.crs, crs)
    if resolution is None:
        (ax, bx), (ay, by) = projection.project_points(edge[X], edge[Y][::-1], x.crs, crs)
        size = math.hypot(bx - ax, by - ay) / math.hypot(count[X], count[Y])
        resolution = (-size, size)
    dy, dx = (abs(float(v)) for v in resolution)
    rows, columns = max(1, round((y1 - y0) / dy)), max(1, round((x1 - x0) / dx))
    spark = x.base.sparkSession
    new_y, new_x = (F.lit(y1) - (F.col("id") + 0.5) * dy).alias(Y), (F.lit(x0) + (F.col("id") + 0.5) * dx).alias(X)
    ys, xs = spark.range(rows).select(new_y), spark.range(columns).select(new_x)
    place = F.floor(F.col("id") / columns)
    cells = spark.range(rows * columns).select((F.lit(y1) - (place + 0.5) * dy).alias(Y), (F.lit(x0) + (F.col("id") % columns + 0.5) * dx).alias(X))
    here = projection.project(cells, crs, x.crs, X, Y, ("__sx", "__sy"))
    index = lambda c, d: F.floor((c - edge[d][0]) / step[d])
    here = here.select(Y, X, index(F.col("__sy"), Y).alias("__iy"), index(F.col("__sx"), X).alias("__ix"))
    here = here.where(F.col("__iy").between(0, count[Y] - 1) & F.col("__ix").between(0, count[X] - 1))
    old = x.cells().withColumns({"__iy": index(F.col(Y), Y), "__ix": index(F.col(X), X)}).drop(Y, X)
    joined = old.join(here, ["__iy", "__ix"]).drop("__iy", "__ix")
    axes = dict(x.axes) | {Y: Axis(Y, ys, resolution[0] < 0), X: Axis(X, xs, resolution[1] < 0)}
    return x.with_frame(joined, axes=axes, crs=crs, resolution=tuple(resolution), features=None, dense=False)


def write_crs(x: CubeArray, crs: str) -> CubeArray:
    return replace(x, crs=crs)


def write_tz(x: CubeArray, tz: str) -> CubeArray:
    return replace(x, tz=tz)


def write_spatial_resolution(x: CubeArray, resolution: tuple[float, float] | None = None, recompute: bool = False) -> CubeArray:
    """Sets the (y, x) step, or derives it from the coordinates, which runs a job."""
    if resolution is None and (recompute or x.resolution is None):
        steps = []
        for dim in (Y, X):
            axis = x.axis(dim)
            gap = F.lead(dim).over(Window.orderBy(dim)) - F.col(dim)
            step = axis.frame.select(dim).distinct().select(gap.alias("g")).agg(F.min("g")).first()[0] or 0
            steps.append(float(-step if axis.descending else step))
        resolution = tuple(steps)
    return replace(x, resolution=resolution or x.resolution)


def grid_points(x: CubeArray) -> DataFrame:
    """y, x and the point of each cell of space, as well-known text."""
    grid = x.axis(Y).frame.select(Y).distinct().crossJoin(x.axis(X).frame.select(X).distinct())
    return grid.withColumn("geometry", F.format_string("POINT (%s %s)", F.col(X).cast("string"), F.col(Y).cast("string")))
