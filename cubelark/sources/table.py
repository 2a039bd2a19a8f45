"""Layers in wide tables: a row per cell, a column per layer."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import types
from ..errors import EmptyDataError
from ..functions.projection import project, project_bounds, same
from ..model import TIME, Axis, CubeArray, X, Y, canonical, fresh
from .base import CubeSource, Extent

#: Aggregates of resampling to larger cells.
AGGREGATES = {
    "average": F.avg,
    "mode": lambda c: F.mode(c, True),
    "max": F.max,
    "min": F.min,
    "med": F.median,
    "q1": lambda c: F.percentile(c, F.lit(0.25)),
    "q3": lambda c: F.percentile(c, F.lit(0.75)),
}


def _cubic(t: Column) -> Column:
    near, far = (1.5 * t - 2.5) * t * t + 1, ((-0.5 * t + 2.5) * t - 4) * t + 2
    return F.when(t <= 1, near).when(t < 2, far).otherwise(0.0)


def _spline(t: Column) -> Column:
    rest = 2 - t
    return F.when(t <= 1, 2 / 3 - t * t + t * t * t / 2).when(t < 2, rest * rest * rest / 6).otherwise(0.0)


def _lanczos(t: Column) -> Column:
    a = t * math.pi
    return F.when(t < 1e-9, 1.0).when(t < 3, 3 * F.sin(a) * F.sin(a / 3) / (a * a)).otherwise(0.0)


#: Kernels of interpolation: reach in cells, and weight by distance.
KERNELS = {"bilinear": (1, lambda t: F.greatest(1 - t, F.lit(0.0))), "cubic": (2, _cubic), "cubic_spline": (2, _spline), "lanczos": (3, _lanczos)}


class TableCube(CubeSource):
    """Layers that are columns of tables with the columns time, y and x.

    A layout entry names its `table` (a key of `tables`, else a catalog name or
    a Parquet path) and `column` (else the last part of the reference), and
    perhaps an `na_value`.  All layers of a table share one frame within an
    extent, so arrays from them combine without a join and one scan reads just
    the columns in use.  Extents become plain predicates, which reach the scan.

    `native` is the tables' own grid: centre of the first cell and step, as
    (y0, dy, x0, dx).  With it, an extent with a resolution resamples by the
    method for each layer's type: `nearest`, or `average`, `mode`, `max`, `min`,
    `med`, `q1`, `q3` of the cells whose centres lie in the new cell, or by
    interpolation (`bilinear`, `cubic`, `cubic_spline`, `lanczos`), whose kernel
    widens with larger cells and leaves missing values out.  `crs` is the
    tables' reference system if queries may be in another one; their cells are
    then looked up in the tables' system.

    `check` runs a small job to raise EmptyDataError for extents without rows.
    """

    def __init__(self, layout: dict, tables: dict[str, DataFrame | Callable[[SparkSession, Extent], DataFrame]] | None = None, *, descending: tuple[str, ...] = (), check: bool = False, group_by_solar_day: bool = False, native: tuple[float, float, float, float] | None = None, crs: str | None = None, **config):
        super().__init__(layout, **config)
        self.native, self.crs = native, crs
        self.tables, self.descending, self.check, self.by_day = dict(tables or {}), descending, check, group_by_solar_day
        self._frames: dict[tuple, tuple[DataFrame, int]] = {}

    def table(self, spark: SparkSession, name: str, extent: Extent) -> DataFrame:
        """A table as it is; one given as a function gets the extent, to cut before it makes cells."""
        found = self.tables.get(name)
        if found is None:
            return spark.read.parquet(name) if "/" in name else spark.read.table(name)
        return found(spark, extent) if callable(found) else found

    def frame(self, name: str, extent: Extent) -> tuple[DataFrame, int]:
        """The table within the extent, one frame (and identity) for all its layers."""
        key = (name, extent.key)
        if key not in self._frames:
            self._frames[key] = (self._cut(self.table(extent.spark, name, extent), extent, name), fresh())
        return self._frames[key]

    def _native(self, spark: SparkSession, name: str) -> tuple[float, float, float, float] | None:
        return self.native

    def _methods(self, name: str) -> dict[str, str]:
        """How each column of a table is resampled."""
        entries = {r: self.lookup(*r) for r in self.layers()}
        own = {r: m for r, m in entries.items() if m.get("table", r[0]) == name}
        return {m.get("column", r[-1]): self.resamplers.get(self.vtype(m), "nearest") for r, m in own.items()}

    def _resampled(self, frame: DataFrame, cells: DataFrame, extent: Extent, native: tuple, methods: dict[str, str]) -> DataFrame:
        """The frame on the extent's cells.  Cells and source are matched by whole numbers of steps."""
        y0, dy, x0, dx = native
        index = lambda c, first, step: F.round((F.col(c) - first) / step).cast("bigint")
        unknown = set(methods.values()) - {"nearest"} - set(AGGREGATES) - set(KERNELS)
        if unknown:
            raise NotImplementedError(f"resampling methods {sorted(unknown)}")
        times = [c for c in (TIME,) if c in frame.columns]
        ty, tx = (abs(v) for v in extent.resolution)
        found: DataFrame | None = None
        for group in ({"nearest"}, set(AGGREGATES), *({k} for k in KERNELS)):
            own = {c: m for c, m in methods.items() if m in group}
            if not own:
                continue
            if group == {"nearest"}:
                here = self._placed(cells, extent).select(*cells.columns, index("__sy", y0, dy).alias("__iy"), index("__sx", x0, dx).alias("__ix"))
                part = frame.select(*times, *own, index(Y, y0, dy).alias("__iy"), index(X, x0, dx).alias("__ix")).join(here, ["__iy", "__ix"]).drop("__iy", "__ix")
            elif group <= set(AGGREGATES):
                cell = lambda c, step: F.floor(F.col(c) / step)
                here = cells.withColumns({"__iy": cell(Y, ty), "__ix": cell(X, tx)})
                moved = frame if same(self.crs, extent.crs) else project(frame, self.crs, extent.crs)
                means = moved.groupBy(*times, cell(Y, ty).alias("__iy"), cell(X, tx).alias("__ix")).agg(*[AGGREGATES[m](c).alias(c) for c, m in own.items()])
                part = means.join(here, ["__iy", "__ix"]).drop("__iy", "__ix")
            else:
                part = self._interpolated(frame.select(*times, Y, X, *own), cells, extent, native, *KERNELS[group.pop()], times, list(own))
            found = part if found is None else found.join(part.drop("feature"), [*times, Y, X], "full").join(cells.select(Y, X, F.col("feature").alias("__feature")), [Y, X]).withColumn("feature", F.col("__feature")).drop("__feature")
        return found

    def _masked(self, frame: DataFrame, name: str) -> DataFrame:
        """The frame with each column's `na_value` missing, so that no mean takes it in."""
        for reference in self.layers():
            meta = self.lookup(*reference)
            column = meta.get("column", reference[-1])
            if meta.get("table", reference[0]) == name and meta.get("na_value") is not None and column in frame.columns:
                frame = frame.withColumn(column, F.when(F.col(column) != F.lit(meta["na_value"]), F.col(column)))
        return frame

    def _placed(self, cells: DataFrame, extent: Extent) -> DataFrame:
        """Cells with their centres in the tables' reference system, __sx and __sy."""
        return project(cells, extent.crs if self.crs else None, self.crs, X, Y, ("__sx", "__sy"))

    def _steps(self, extent: Extent) -> tuple[float, float]:
        """The size (y, x) of the extent's cells in the tables' reference system, measured at the centre of the bounds."""
        ty, tx = (abs(v) for v in extent.resolution)
        if same(self.crs, extent.crs) or extent.bounds is None:
            return ty, tx
        x, y = (extent.bounds[0] + extent.bounds[2]) / 2, (extent.bounds[1] + extent.bounds[3]) / 2
        a, b, c, d = project_bounds((x - tx / 2, y - ty / 2, x + tx / 2, y + ty / 2), extent.crs, self.crs)
        return d - b, c - a

    def _interpolated(self, frame: DataFrame, cells: DataFrame, extent: Extent, native: tuple, reach: int, weight: Callable[[Column], Column], times: list[str], columns: list[str]) -> DataFrame:
        """Weighted means of the cells within reach.  A new cell needs a row, if of a missing value, where its centre lies."""
        y0, dy, x0, dx = native
        wide_y, wide_x = (max(1.0, step / abs(own)) for step, own in zip(self._steps(extent), (dy, dx), strict=True))
        at = self._placed(cells, extent).withColumns({"__u": (F.col("__sy") - y0) / dy, "__v": (F.col("__sx") - x0) / dx})
        reached = lambda c, wide: F.sequence(F.ceil(F.col(c) - reach * wide).cast("bigint"), F.floor(F.col(c) + reach * wide).cast("bigint"))
        at = at.withColumn("__iy", F.explode(reached("__u", wide_y))).withColumn("__ix", F.explode(reached("__v", wide_x)))
        product = weight(F.abs(F.col("__iy") - F.col("__u")) / wide_y) * weight(F.abs(F.col("__ix") - F.col("__v")) / wide_x)
        centre = (F.col("__iy") == F.round("__u").cast("bigint")) & (F.col("__ix") == F.round("__v").cast("bigint"))
        at = at.select(*cells.columns, "__iy", "__ix", product.alias("__w"), centre.alias("__centre")).where("__w != 0 OR __centre")
        index = lambda c, first, step: F.round((F.col(c) - first) / step).cast("bigint")
        near = frame.select(*times, *columns, index(Y, y0, dy).alias("__iy"), index(X, x0, dx).alias("__ix")).join(at, ["__iy", "__ix"])
        valid = lambda c: canonical(F.col(c).cast("double"), "double")
        sums = {}
        for c in columns:
            sums[f"__s_{c}"] = F.sum(valid(c) * F.col("__w"))
            sums[f"__w_{c}"] = F.sum(F.when(valid(c).isNotNull(), F.col("__w")))
        means = near.groupBy(*times, *cells.columns).agg(*[v.alias(k) for k, v in sums.items()], F.max("__centre").alias("__centre")).where("__centre")
        return means.select(*times, *cells.columns, *[F.when(F.col(f"__w_{c}") > 1e-6, F.col(f"__s_{c}") / F.col(f"__w_{c}")).alias(c) for c in columns])

    def _cut(self, frame: DataFrame, extent: Extent, name: str) -> DataFrame:
        columns = frame.columns
        if TIME in columns and extent.time is not None:
            own = extent.time.tz_convert(self.tz)
            frame = frame.where(F.col(TIME).between(F.lit(own.start).cast("timestamp_ntz"), F.lit(own.end).cast("timestamp_ntz")))
        if TIME in columns and extent.tz != self.tz:
            frame = frame.withColumn(TIME, F.convert_timezone(F.lit(self.tz), F.lit(extent.tz), F.col(TIME)))
        if X in columns and Y in columns:
            if extent.bounds is not None:
                x0, y0, x1, y1 = extent.bounds
                native = self._native(extent.spark, name) if extent.resolution else None  # before `crs` is looked at: a file may tell it
                my, mx = self._steps(extent) if extent.resolution else (0.0, 0.0)
                if not same(self.crs, extent.crs):
                    x0, y0, x1, y1 = project_bounds((x0, y0, x1, y1), extent.crs, self.crs)
                    my, mx = my + (y1 - y0) / 50, mx + (x1 - x0) / 50  # edges that bend between the points looked at
                # so much more that cells at the edge still find all that they are made of
                reach = max((KERNELS[m][0] for m in self._methods(name).values() if m in KERNELS), default=1)
                if native is not None:
                    my, mx = reach * max(my, abs(native[1])), reach * max(mx, abs(native[3]))
                frame = frame.where(F.col(X).between(x0 - mx, x1 + mx) & F.col(Y).between(y0 - my, y1 + my))
            if extent.space is not None:
                cells = extent.space.where(F.col("feature").isNotNull())
                kinds = dict(frame.dtypes)
                native = self._native(extent.spark, name) if extent.resolution is not None else None
                if native is None and not same(self.crs, extent.crs):
                    raise ValueError(f"cells in {extent.crs} of tables in {self.crs} need `native`, the tables' own grid")
                if native is not None:
                    frame = self._masked(frame, name)
                    frame = self._resampled(frame, cells, extent, native, self._methods(name))
                else:
                    cells = cells.select(F.col(Y).cast(kinds[Y]).alias(Y), F.col(X).cast(kinds[X]).alias(X), "feature")
                    frame = frame.join(cells, [Y, X])
        if self.by_day and TIME in columns:
            frame = self._mosaic(frame)
        return frame

    def _mosaic(self, frame: DataFrame) -> DataFrame:
        """One observation a day: of each column the first value present that day."""
        day = F.date_trunc("day", F.col(TIME)).cast("timestamp_ntz")
        keys = [c for c in (Y, X, "feature") if c in frame.columns]
        values = [c for c in frame.columns if c not in (TIME, *keys)]
        return frame.groupBy(day.alias("__day"), *keys).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(TIME))).alias(c) for c in values]).withColumnRenamed("__day", TIME)

    def retrieve(self, *reference: str, extent: Extent) -> CubeArray:
        meta = self.lookup(*reference)
        frame, token = self.frame(meta.get("table", reference[0]), extent)
        column, vtype = meta.get("column", reference[-1]), self.vtype(meta)
        value = canonical(F.col(column), dict(frame.dtypes)[column])
        if meta.get("na_value") is not None:
            value = F.when(F.col(column) != F.lit(meta["na_value"]), value)
        if vtype in (types.CONTINUOUS, types.DISCRETE):
            value = value.cast("double")
        dims = tuple(d for d in (TIME, Y, X) if d in frame.columns)
        if self.check and frame.isEmpty():
            raise EmptyDataError(f"layer {reference!r} has no data within the extent")
        present = frame.where(value.isNotNull()) if self.trim else frame
        axes = {d: Axis(d, present.select(d).distinct(), d in self.descending) for d in dims}
        coords = ("feature",) if "feature" in frame.columns and {Y, X} <= set(dims) else ()
        return CubeArray(frame, value, dims, axes, vtype=vtype, labels=meta["labels"], name=reference[-1], token=token, coords=coords, features=extent.space, feature_labels=extent.feature_labels, tz=extent.tz, crs=extent.crs if extent.space is not None or self.crs is None else self.crs, resolution=extent.resolution)
