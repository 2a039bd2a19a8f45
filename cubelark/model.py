"""Labelled arrays in long form.

A `CubeArray` is a frame with one row per cell, the names of its dimensions and
an expression for the value.  Verbs that don't change the grid only change the
expression, so arrays from one layer table share a frame and combine without a
join; an array that is a function of its coordinates alone is never joined at
all.  Cells without a row are missing (or `absent`, where a reducer says so).
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import types
from .errors import AlignmentError, UnknownDimensionError

TIME, SPACE, X, Y = "time", "space", "x", "y"
RESERVED = (TIME, SPACE, X, Y)
GROUP = "__group"
VALUE = "v"

_tokens = itertools.count()


def fresh() -> int:
    """A new identity for a frame."""
    return next(_tokens)


@dataclass(frozen=True)
class Axis:
    """Coordinates of a dimension: a frame with a column of that name, their order, and what they are kept apart by."""

    name: str
    frame: DataFrame
    descending: bool = False
    by: tuple[str, ...] = ()

    def order(self) -> Column:
        return F.desc(self.name) if self.descending else F.asc(self.name)

    def positions(self) -> DataFrame:
        """The coordinates with their position from 0, column `pos_<name>`.

        An index is as long as one side of the grid, so numbering it in one task is cheap.
        """
        window = Window.partitionBy(*self.by).orderBy(self.order()) if self.by else Window.orderBy(self.order())
        return self.frame.select(*self.by, self.name).distinct().withColumn(f"pos_{self.name}", F.row_number().over(window) - 1)


@dataclass(frozen=True)
class CubeArray:
    base: DataFrame
    expr: Column
    dims: tuple[str, ...]
    axes: Mapping[str, Axis] = field(default_factory=dict)
    vtype: str | None = None
    labels: Mapping[object, str] | None = None
    name: str | None = None
    token: int = field(default_factory=lambda: next(_tokens))
    #: Columns of the frame that coordinates determine, kept while y and x are.
    coords: tuple[str, ...] = ()
    #: Set where the value is a function of these columns alone.
    of: tuple[str, ...] | None = None
    #: (y, x, feature) of the extent, labels of the features.
    features: DataFrame | None = None
    feature_labels: Mapping[object, str] | None = None
    #: Dimensions that verbs keep apart, such as the group of a grouped collection.
    fixed: tuple[str, ...] = ()
    #: Value of a cell without a row; None is missing.
    absent: object = None
    dense: bool = False
    #: Members of `labels` that name the groups.
    group_names: Mapping[object, str] | None = None
    tz: str | None = None
    crs: str | None = None
    resolution: tuple[float, float] | None = None

    @property
    def df(self) -> DataFrame:
        """One row per cell: the dimensions, then the value `v`."""
        return self.base.select(*self.dims, self.expr.alias(VALUE))

    @property
    def free(self) -> tuple[str, ...]:
        """Dimensions that verbs may work along."""
        return tuple(d for d in self.dims if d not in self.fixed)

    def with_expr(self, expr: Column, **changes) -> CubeArray:
        """Another value on the same grid; the frame, and with it the chance to combine without a join, stays."""
        return replace(self, expr=expr, **({"of": None, "absent": None} | changes))

    def with_frame(self, frame: DataFrame, dims: tuple[str, ...] | None = None, **changes) -> CubeArray:
        """Another frame with the value in column `v`."""
        dims = self.dims if dims is None else dims
        coords = tuple(c for c in self.coords if c in frame.columns)
        return replace(self, base=frame, expr=F.col(VALUE), dims=dims, token=next(_tokens), **({"of": None, "coords": coords, "axes": {d: a for d, a in self.axes.items() if d in dims}} | changes))

    def cells(self, extra: tuple[str, ...] = ()) -> DataFrame:
        """Dimensions, determined coordinates and value."""
        return self.base.select(*self.dims, *[c for c in self.coords if c not in extra], *extra, self.expr.alias(VALUE))

    def spatial(self, dimension: str | None) -> tuple[str, ...]:
        """The dimensions that a name stands for."""
        if dimension is None:
            return self.free
        named = (Y, X) if dimension == SPACE else (dimension,)
        if any(d not in self.free for d in named):
            raise UnknownDimensionError(f"there is no dimension {dimension!r} among {self.free}")
        return named

    def order_of(self, dims: tuple[str, ...]) -> Column:
        """A value that sorts cells along `dims` as the index does."""
        parts = [-F.col(d) if d in self.axes and self.axes[d].descending else F.col(d) for d in dims]
        return F.struct(*[p.alias(f"o{i}") for i, p in enumerate(parts)]) if parts else F.lit(0)

    def axis(self, dim: str) -> Axis:
        return self.axes.get(dim) or Axis(dim, self.base.select(*self.fixed, dim).distinct(), by=self.fixed)

    def grid(self) -> DataFrame:
        """All cells of the grid: the product of the indexes, which is what a dense array is."""
        frame: DataFrame | None = None
        for dim in self.free:
            axis = self.axis(dim)
            index = axis.frame.select(*axis.by, dim).distinct()
            if frame is None:
                frame = index
            elif axis.by and set(axis.by) <= set(frame.columns):
                frame = frame.join(index, list(axis.by))
            else:
                frame = frame.crossJoin(index)
        missing = [d for d in self.fixed if frame is None or d not in frame.columns]
        if missing:
            groups = self.base.select(*missing).distinct()
            frame = groups if frame is None else frame.crossJoin(groups)
        return frame

    def densify(self) -> CubeArray:
        """The same array with a row for every cell of its grid."""
        if self.dense or not self.dims:
            return self
        value = F.when(F.col("__here"), F.col(VALUE)).otherwise(F.lit(self.absent)) if self.absent is not None else F.col(VALUE)
        frame = self.grid().join(self.df.withColumn("__here", F.lit(True)), list(self.dims), "left").select(*self.dims, value.alias(VALUE))
        return self.with_frame(frame, dense=True, coords=())

    def aligned(self, other: CubeArray) -> tuple[CubeArray, Column]:
        """This array on a frame that also holds `other`'s value for each cell, and that value's expression."""
        extra = [d for d in other.dims if d not in self.dims]
        if extra:
            raise AlignmentError(f"dimensions {extra} of the second array are not among {self.dims}")
        if other.token == self.token and other.dims == self.dims:
            return self, other.expr
        if other.of is not None and set(other.of) <= set(self.base.columns):
            return self, other.expr
        column = f"__y{next(_tokens)}"
        right = other.df.withColumnRenamed(VALUE, column)
        if not other.dims:  # one value for all cells
            return replace(self, base=self.base.crossJoin(F.broadcast(right.limit(1))), token=next(_tokens)), F.col(column)
        return replace(self, base=self.base.join(right, list(other.dims), "left"), token=next(_tokens)), F.col(column)

    def to_dataframe(self, dense: bool = False) -> DataFrame:
        return (self.densify() if dense else self).df

    def transform(self, verb: Callable[..., CubeArray], *args, **kwargs) -> CubeArray:
        return verb(self, *args, **kwargs)

    def is_empty(self) -> bool:
        """Whether no cell has a value.  This runs a job."""
        return self.df.where(F.col(VALUE).isNotNull()).isEmpty()


def array(frame: DataFrame, dims: tuple[str, ...] | list[str], value: str = VALUE, *, vtype: str | None = None, descending: tuple[str, ...] = (), **meta) -> CubeArray:
    """A cube array from a frame in long form; the indexes are the frame's own coordinates."""
    axes = {d: Axis(d, frame.select(d).distinct(), d in descending) for d in dims}
    return CubeArray(frame, canonical(F.col(value), dict(frame.dtypes)[value]), tuple(dims), axes, vtype=vtype or types_of(dict(frame.dtypes)[value]), **meta)


def canonical(value: Column, dtype: str) -> Column:
    """NaN is missing."""
    return F.when(~F.isnan(value), value) if dtype in ("double", "float") else value


def types_of(dtype: str) -> str | None:
    """The value type of a column without a declared one, where its storage type leaves no choice."""
    return {"double": types.CONTINUOUS, "float": types.CONTINUOUS, "boolean": types.BINARY, "timestamp_ntz": types.DATETIME, "timestamp": types.DATETIME, "date": types.DATETIME}.get(dtype)


def possible_types(vtype: str | None) -> tuple[str, ...]:
    return (vtype,) if vtype else types.ALL


@dataclass(frozen=True)
class CubeCollection:
    """An ordered list of arrays, or one grouped array that still is a single frame."""

    elements: tuple[CubeArray, ...] = ()
    grouped: CubeArray | None = None

    def map(self, verb: Callable[[CubeArray], CubeArray]) -> CubeCollection:
        if self.grouped is not None:
            return replace(self, grouped=verb(self.grouped))
        return CubeCollection(tuple(verb(a) for a in self.elements))

    @property
    def first(self) -> CubeArray:
        return self.grouped if self.grouped is not None else self.elements[0]

    def split(self) -> list[CubeArray]:
        """The members as separate arrays.  For a grouped array this lists the groups, which runs a job."""
        if self.grouped is None:
            return list(self.elements)
        g = self.grouped
        dims = tuple(d for d in g.dims if d != GROUP)
        out = []
        for row in g.base.select(GROUP).distinct().orderBy(GROUP).collect():
            key = row[0]
            label = (g.group_names or {}).get(key, key)
            frame = g.cells().where(F.col(GROUP) == F.lit(key)).drop(GROUP)
            out.append(g.with_frame(frame, dims, fixed=(), name=str(label), group_names=None))
        return out
