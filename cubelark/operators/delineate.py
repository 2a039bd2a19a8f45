"""Objects: connected true cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import types
from ..errors import InvalidValueTypeError, MissingDimensionError, TooManyDimensionsError
from ..functions.scalar import truth
from ..model import TIME, VALUE, CubeArray, X, Y
from ..plans.components import connected_components, written
from .windows import positioned


def delineate(x: CubeArray, *, track_types: bool = True) -> CubeArray:
    """Numbers the connected regions of true cells from 1; false cells are 0, missing ones stay missing.

    In space a cell touches its eight neighbours, in time the same place one
    step before and after.  Numbers follow the regions' first cells in the
    order of the grid.
    """
    if track_types and x.vtype not in (None, types.BINARY):
        raise InvalidValueTypeError(f"only binary arrays can be delineated, not {x.vtype}")
    dims = x.free
    if len(dims) > 3:
        raise TooManyDimensionsError(f"can't delineate {len(dims)} dimensions")
    if len(dims) == 3 and not {TIME, Y, X} <= set(dims) or len(dims) == 2 and not {Y, X} <= set(dims):
        raise MissingDimensionError("regions over several dimensions need y and x, and time as a third")
    dims = tuple(d for d in (TIME, Y, X) if d in dims) if len(dims) > 1 else dims
    frame = x.cells()
    for d in dims:
        frame = positioned(x, frame, d)
    frame = written(frame, "cells")
    pos = [f"pos_{d}" for d in dims]
    true = frame.where(truth(F.col(VALUE)))
    regions = _runs(x, true, pos[0]) if len(dims) == 1 else _regions(x, true, dims, pos)
    joined = frame.join(regions, [*x.fixed, *pos], "left")
    value = F.when(F.col(VALUE).isNotNull(), F.coalesce(F.col("__region"), F.lit(0)).cast("int"))
    out = joined.select(*x.dims, *[c for c in x.coords if c in frame.columns], value.alias("__v")).withColumnRenamed("__v", VALUE)
    return x.with_frame(out, vtype=types.ORDINAL, labels=None, dense=x.dense)


def _runs(x: CubeArray, true: DataFrame, pos: str) -> DataFrame:
    """Along one dimension regions are runs: a position minus its rank is constant within a run.

    The array is one line of cells, as short as its index.
    """
    line = Window.partitionBy(*x.fixed).orderBy(pos)
    starts = true.withColumn("__run", F.col(pos) - F.row_number().over(line))
    return starts.select(*x.fixed, pos, F.dense_rank().over(Window.partitionBy(*x.fixed).orderBy("__run")).alias("__region"))


def _regions(x: CubeArray, true: DataFrame, dims: tuple[str, ...], pos: list[str]) -> DataFrame:
    sizes = [x.axis(d).frame.select(d).distinct().count() for d in dims]  # scalars: lengths of the indexes
    cell = F.lit(0).cast("bigint")
    for p, size in zip(pos, sizes, strict=True):
        cell = cell * size + F.col(p)
    true = true.select(*x.fixed, *pos, cell.alias("__cell"))
    if x.fixed:  # cells of different groups are different nodes
        groups = true.select(*x.fixed).distinct().withColumn("__g", F.row_number().over(Window.orderBy(*x.fixed)).cast("bigint"))
        total = 1
        for s in sizes:
            total *= s
        true = true.join(groups, list(x.fixed)).withColumn("__cell", F.col("__cell") + F.col("__g") * total)
    space = [(0, 1), (1, -1), (1, 0), (1, 1)]
    steps = [(*(0,) * (len(dims) - 2), dy, dx) for dy, dx in space] + ([(1, 0, 0)] if len(dims) == 3 else [])
    sent = true.withColumn("__s", F.explode(F.array(*[F.struct(*[F.lit(v).alias(p) for v, p in zip(s, pos, strict=True)]) for s in steps])))
    moved = sent.select(*x.fixed, *[(F.col(p) + F.col(f"__s.{p}")).alias(p) for p in pos], F.col("__cell").alias("__from"))
    edges = moved.join(true, [*x.fixed, *pos]).select(F.col("__from").alias("u"), F.col("__cell").alias("v"))
    components = connected_components(edges)
    named = true.join(components, F.col("__cell") == F.col("node"), "left").select(*x.fixed, *pos, F.coalesce("component", "__cell").alias("__root"))
    numbers = numbered(named.select(*x.fixed, "__root").distinct(), x.fixed)
    return named.join(numbers, [*x.fixed, "__root"]).drop("__root")


def numbered(roots: DataFrame, fixed: tuple[str, ...]) -> DataFrame:
    """Consecutive numbers from 1 in the order of `__root`, within each of `fixed`.

    Roots are range-partitioned and numbered within their range; ranges add the
    number of roots before them, so no task sees them all.
    """
    ranged = written(roots.repartitionByRange(*fixed, "__root").withColumn("__range", F.spark_partition_id()), "roots")
    counts = ranged.groupBy(*fixed, "__range").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*fixed).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*fixed, "__range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*fixed, "__range").orderBy("__root")
    return ranged.join(offsets, [*fixed, "__range"]).select(*fixed, "__root", (F.row_number().over(inside) + F.col("__before")).alias("__region"))
