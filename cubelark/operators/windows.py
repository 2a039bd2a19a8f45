"""Verbs along an axis: shift, smooth, fill."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.reducers import REDUCERS, SEPARABLE
from ..functions.scalar import truth
from ..model import SPACE, VALUE, CubeArray, X, Y
from .verbs import reducer_of, typed


def positioned(x: CubeArray, frame: DataFrame, dim: str) -> DataFrame:
    """`frame` with the position of each row along `dim`, by a join with the small index."""
    axis = x.axis(dim)
    return frame.join(axis.positions(), [*axis.by, dim])


def shift(x: CubeArray, dimension: str, steps: int) -> CubeArray:
    """Moves values by `steps` positions; vacated cells are missing, what leaves the grid is lost.

    Rows get the coordinate that lies `steps` further in the index, so nothing
    but the index is joined or sorted.  Along `space` cells move through the
    grid row by row.
    """
    dims = x.spatial(dimension)
    if dimension != SPACE:
        axis = x.axis(dimension)
        pos = f"pos_{dimension}"
        index = axis.positions()
        target = index.select(*axis.by, (F.col(pos) - steps).alias(pos), F.col(dimension).alias("__to"))
        moved = x.df.join(index, [*axis.by, dimension]).join(target, [*axis.by, pos])
        frame = moved.select(*[F.col("__to").alias(d) if d == dimension else F.col(d) for d in x.dims], VALUE)
        return _restored(x, frame)
    rows, columns = x.axis(Y).positions(), x.axis(X).positions()
    width = columns.agg(F.count("*").alias("__width"))
    frame = positioned(x, positioned(x, x.df, Y), X).drop(*dims).crossJoin(F.broadcast(width))
    flat = F.col("pos_y") * F.col("__width") + F.col("pos_x") + steps
    frame = frame.withColumn("__flat", flat).where("__flat >= 0").withColumns({"pos_y": F.floor(F.col("__flat") / F.col("__width")).cast("int"), "pos_x": F.pmod("__flat", F.col("__width")).cast("int")})
    frame = frame.join(rows, [*x.axis(Y).by, "pos_y"]).join(columns, [*x.axis(X).by, "pos_x"])
    return _restored(x, frame.select(*x.dims, VALUE))


def _restored(x: CubeArray, frame: DataFrame) -> CubeArray:
    """Features belong to the coordinates, so they come back from the extent."""
    if "feature" in x.coords and x.features is not None:
        frame = frame.join(x.features.select(Y, X, "feature"), [Y, X], "left")
    return x.with_frame(frame)


def smooth(x: CubeArray, reducer: str, dimension: str, size: int, limit: int = 2, fill: bool = False, *, track_types: bool = True, custom: Mapping | None = None, manual: dict | None = None) -> CubeArray:
    """Reduces a centred window of 2 x `size` + 1 positions (a square one along `space`).

    The result is missing where the window has fewer than `limit` values, and,
    unless `fill`, where the cell itself is missing.  Only positions count, so
    cells without a row need not be there unless they are to be filled.
    """
    x.spatial(dimension)
    call = reducer_of(reducer, x, custom)
    vtype, labels = typed(reducer, x, track=track_types, manual=manual, custom=custom)
    if dimension == SPACE:
        return _smooth_space(x, reducer, call, size, limit, fill).with_expr(F.col(VALUE), vtype=vtype, labels=labels)
    source = x.densify() if fill else x
    frame = positioned(x, source.cells(), dimension)
    pos = F.col(f"pos_{dimension}")
    around = Window.partitionBy(*[d for d in x.dims if d != dimension]).orderBy(pos).rangeBetween(-size, size)
    value = _windowed(call, F.col(VALUE), pos, around)
    result = F.when(F.count(VALUE).over(around) >= limit, value)
    if not fill:
        result = F.when(F.col(VALUE).isNotNull(), result)
    frame = frame.withColumn("__s", result).drop(VALUE, f"pos_{dimension}").withColumnRenamed("__s", VALUE)
    return x.with_frame(frame, vtype=vtype, labels=labels, dense=source.dense)


def _windowed(call, value: Column, order: Column, window) -> Column:
    """A reducer over a window.  Custom reducers that don't know of windows must be one aggregate."""
    import inspect

    if "over" in inspect.signature(call).parameters:
        return call(value, order, over=lambda aggregate: aggregate.over(window))
    return call(value, order).over(window)


def _parts(reducer: str) -> dict[str, str] | None:
    """For reducers that two passes can compute: which separable aggregates they are made of."""
    made = {"mean": {"s": "sum", "c": "n"}, "percentage": {"s": "count", "c": "n"}}
    if reducer in made:
        return made[reducer]
    return {"s": reducer} if reducer in SEPARABLE else None


_PASS = {
    "sum": (lambda v: v, F.sum),
    "n": (lambda v: v.isNotNull().cast("bigint"), F.sum),
    "count": (lambda v: F.when(v.isNotNull(), truth(v).cast("bigint")), F.sum),
    "max": (lambda v: v, F.max),
    "min": (lambda v: v, F.min),
    "all": (lambda v: truth(v).cast("int"), F.min),
    "any": (lambda v: truth(v).cast("int"), F.max),
    "none": (lambda v: truth(v).cast("int"), F.max),
}


def _smooth_space(x: CubeArray, reducer: str, call, size: int, limit: int, fill: bool) -> CubeArray:
    parts = _parts(reducer) if call is REDUCERS.get(reducer) else None
    dense = x.densify() if fill or parts else x
    frame = positioned(x, positioned(x, dense.cells(), Y), X)
    others = [d for d in x.dims if d not in (Y, X)]
    if parts:  # two passes of a line window
        along_x = Window.partitionBy(*others, "pos_y").orderBy("pos_x").rangeBetween(-size, size)
        along_y = Window.partitionBy(*others, "pos_x").orderBy("pos_y").rangeBetween(-size, size)
        needed = dict(parts) | {"c": "n"}
        frame = frame.withColumns({f"__{k}": _PASS[r][1](_PASS[r][0](F.col(VALUE))).over(along_x) for k, r in needed.items()})
        frame = frame.withColumns({f"__{k}2": _PASS[r][1](f"__{k}").over(along_y) for k, r in needed.items()})
        s, c = F.col("__s2"), F.col("__c2")
        value = {"mean": s / c, "percentage": s / c * 100, "none": (s == 0).cast("int")}.get(reducer, s)
        result = F.when((c >= limit) & ((c > 0) | F.lit(reducer == "n")), value)
        frame = frame.withColumn("__result", result)
        if not fill:  # cells that only the passes needed
            frame = frame.where(F.col(VALUE).isNotNull())
        frame = frame.select(*x.dims, *[k for k in x.coords if k in frame.columns], F.col("__result").alias(VALUE))
        return x.with_frame(frame, dense=fill)
    # every value goes to all windows that it lies in
    offsets = [(dy, dx) for dy in range(-size, size + 1) for dx in range(-size, size + 1)]
    sent = frame.where(F.col(VALUE).isNotNull()).withColumn("__o", F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in offsets])))
    order = F.struct(F.col("pos_y").alias("o0"), F.col("pos_x").alias("o1"))
    windows = (
        sent.withColumns({"__ty": F.col("pos_y") + F.col("__o.dy"), "__tx": F.col("pos_x") + F.col("__o.dx")})
        .groupBy(*others, "__ty", "__tx")
        .agg(call(F.col(VALUE), order).alias("__s"), F.count(VALUE).alias("__n"))
        .where(F.col("__n") >= limit)
        .select(*others, F.col("__ty").alias("pos_y"), F.col("__tx").alias("pos_x"), "__s")
    )
    joined = frame.join(windows, [*others, "pos_y", "pos_x"], "left")
    result = F.col("__s") if fill else F.when(F.col(VALUE).isNotNull(), F.col("__s"))
    return x.with_frame(joined.select(*x.dims, *[k for k in x.coords if k in frame.columns], result.alias(VALUE)), dense=dense.dense)


def fill(x: CubeArray, dimension: str, method: str = "nearest", extrapolate: bool = True, *, track_types: bool = True) -> CubeArray:
    """Interpolates missing cells along a dimension, by its coordinates.

    `nearest` (of two equally near the earlier one) and `linear` are window
    expressions; `cubic` is a not-a-knot spline and `space` the nearest valid
    cell of the plane, both by slice in Python.  Without `extrapolate` cells
    beyond the outermost values stay missing.
    """
    if method not in ("nearest", "linear", "cubic"):
        raise ValueError(f"unknown method {method!r}")
    x.spatial(dimension)
    dense = x.densify()
    if dimension == SPACE:
        if method != "nearest":
            raise NotImplementedError("along space only the nearest cell is filled in")
        return x.with_frame(_fill_plane(x, dense.df), dense=True)
    if method == "cubic":
        return x.with_frame(_fill_cubic(x, dense.df, dimension, extrapolate), dense=True)
    at = _number(F.col(dimension), dict(dense.base.dtypes)[dimension])
    frame = dense.df.withColumn("__at", at)
    slices = Window.partitionBy(*[d for d in x.dims if d != dimension]).orderBy("__at")
    before, after = slices.rowsBetween(Window.unboundedPreceding, 0), slices.rowsBetween(0, Window.unboundedFollowing)
    whole = slices.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    here = F.when(F.col(VALUE).isNotNull(), F.struct(F.col("__at").alias("at"), F.col(VALUE).alias("v")))
    frame = frame.withColumn("__p", here).withColumns({"__a": F.last("__p", True).over(before), "__b": F.first("__p", True).over(after)})
    a, b, t = F.col("__a"), F.col("__b"), F.col("__at")
    inner = a.isNotNull() & b.isNotNull()
    if method == "nearest":
        between = F.when(t - a["at"] <= b["at"] - t, a["v"]).otherwise(b["v"])
        outer = F.coalesce(a["v"], b["v"])
    else:
        line = lambda p, q: p["v"] + (q["v"] - p["v"]) * (t - p["at"]) / (q["at"] - p["at"])
        between = F.when(a["at"] == b["at"], a["v"]).otherwise(line(a, b))
        frame = frame.withColumns({
            "__f1": F.first("__p", True).over(whole), "__f2": F.nth_value("__p", 2, True).over(whole),
            "__l1": F.last("__p", True).over(whole),
        }).withColumn("__l2", F.last(F.when(F.col("__at") < F.col("__l1.at"), F.col("__p")), True).over(whole))
        outer = F.when(F.col("__f2").isNull(), None).when(b.isNotNull(), line(F.col("__f1"), F.col("__f2"))).otherwise(line(F.col("__l2"), F.col("__l1")))
    value = F.when(F.col(VALUE).isNotNull(), F.col(VALUE)).when(inner, between)
    if extrapolate:
        value = value.otherwise(outer)
    return x.with_frame(frame.select(*x.dims, value.alias(VALUE)), dense=True, coords=())


def _number(column: Column, dtype: str) -> Column:
    """A coordinate as a number: seconds for times."""
    if dtype in ("timestamp_ntz", "timestamp", "date"):
        return F.unix_micros(column.cast("timestamp")) / 1e6
    return column.cast("double")


def spline(at: np.ndarray, value: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Interpolating cubic with not-a-knot ends; of lower degree if there are fewer than four points."""
    n = len(at)
    if n < 4:
        return np.polyval(np.polyfit(at - at[0], value, n - 1), where - at[0]) if n > 1 else np.full(len(where), value[0] if n else np.nan)
    h, slope = np.diff(at), np.diff(value) / np.diff(at)
    # second derivatives m: three bands, from which the end conditions take the outermost unknowns
    lower, middle, upper, right = h[:-1].copy(), 2 * (h[:-1] + h[1:]), h[1:].copy(), 6 * np.diff(slope)
    middle[0] += h[0] * (h[0] + h[1]) / h[1]
    upper[0] -= h[0] ** 2 / h[1]
    middle[-1] += h[-1] * (h[-1] + h[-2]) / h[-2]
    lower[-1] -= h[-1] ** 2 / h[-2]
    for j in range(1, n - 2):
        factor = lower[j] / middle[j - 1]
        middle[j] -= factor * upper[j - 1]
        right[j] -= factor * right[j - 1]
    m = np.zeros(n)
    m[n - 2] = right[-1] / middle[-1]
    for j in range(n - 4, -1, -1):
        m[j + 1] = (right[j] - upper[j] * m[j + 2]) / middle[j]
    m[0] = ((h[0] + h[1]) * m[1] - h[0] * m[2]) / h[1]
    m[-1] = ((h[-1] + h[-2]) * m[-2] - h[-1] * m[-3]) / h[-2]
    i = np.clip(np.searchsorted(at, where) - 1, 0, n - 2)
    d = where - at[i]
    return value[i] + d * (slope[i] - h[i] * (2 * m[i] + m[i + 1]) / 6) + d**2 * m[i] / 2 + d**3 * (m[i + 1] - m[i]) / (6 * h[i])


def _slices(x: CubeArray, frame: DataFrame, others: list[str], work) -> DataFrame:
    """Runs `work` on each slice; one slice is one line, or one plane, of the grid."""
    schema = ", ".join(f"`{c}` {t}" for c, t in frame.dtypes)
    if others:
        return frame.groupBy(*others).applyInPandas(work, schema)

    def all_rows(frames: Iterator) -> Iterator:
        import pandas as pd

        yield work(pd.concat(list(frames)))

    return frame.repartition(1).mapInPandas(all_rows, schema)


def _fill_cubic(x: CubeArray, frame: DataFrame, dimension: str, extrapolate: bool) -> DataFrame:
    frame = frame.withColumn("__at", _number(F.col(dimension), dict(frame.dtypes)[dimension])).withColumn(VALUE, F.col(VALUE).cast("double"))

    def work(rows):
        rows = rows.sort_values("__at").copy()
        valid = rows[VALUE].notna().to_numpy()
        if valid.any() and not valid.all():
            at, value = rows["__at"].to_numpy(), rows[VALUE].to_numpy(dtype=float, copy=True)
            filled = spline(at[valid], value[valid], at[~valid])
            if not extrapolate:
                filled[(at[~valid] < at[valid][0]) | (at[~valid] > at[valid][-1])] = np.nan
            value[~valid] = filled
            rows[VALUE] = [None if np.isnan(v) else v for v in value]
        return rows

    return _slices(x, frame, [d for d in x.dims if d != dimension], work).drop("__at")


def nearest_valid(ys: np.ndarray, xs: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the nearest valid cell for each cell of a grid; of equally near ones the first by row, then column.

    First the nearest one of each column, then the best of all columns, row by row.
    """
    rows, columns = valid.shape
    at = np.arange(rows)[:, None]
    above = np.maximum.accumulate(np.where(valid, at, -1), axis=0)
    below = np.minimum.accumulate(np.where(valid, at, rows)[::-1], axis=0)[::-1]
    far = lambda i: np.where((i >= 0) & (i < rows), np.abs(ys[np.clip(i, 0, rows - 1)] - ys[:, None]), np.inf)
    up, down = far(above), far(below)
    first = (up < down) | ((up == down) & (ys[np.clip(above, 0, rows - 1)] <= ys[np.clip(below, 0, rows - 1)]))
    own = np.where(first, above, below)
    gap = np.where(first, up, down) ** 2
    across = (xs[:, None] - xs[None, :]) ** 2
    found = np.empty((rows, columns), dtype=int)
    for r in range(rows):
        total = gap[r] + across
        order = np.lexsort((xs, ys[np.clip(own[r], 0, rows - 1)]))
        found[r] = order[total[:, order].argmin(axis=1)]
    return np.take_along_axis(own, found, axis=1), found


def _fill_plane(x: CubeArray, frame: DataFrame) -> DataFrame:
    """Nearest valid cell of the plane; of equally near ones the first by row, then column."""

    def work(rows):
        rows = rows.copy()
        valid = rows[VALUE].notna().to_numpy()
        if valid.any() and not valid.all():
            (ys, i), (xs, j) = (np.unique(rows[d].to_numpy(dtype=float), return_inverse=True) for d in (Y, X))
            grid, place = np.zeros((len(ys), len(xs)), dtype=bool), np.zeros((len(ys), len(xs)), dtype=int)
            grid[i, j], place[i, j] = valid, np.arange(len(rows))
            near = nearest_valid(ys, xs, grid)
            rows[VALUE] = rows[VALUE].to_numpy()[place[near][i, j]]
        return rows

    return _slices(x, frame, [d for d in x.dims if d not in (Y, X)], work)
