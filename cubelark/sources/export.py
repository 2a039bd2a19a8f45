"""Sinks: frames, CSV, Parquet, dense numpy arrays, GeoTIFF."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import TooManyDimensionsError
from ..functions.geometry import crs_name
from ..functions.projection import project
from ..model import VALUE, CubeArray, X, Y


def inf_as_null(value: Column) -> Column:
    """Infinite values are missing."""
    return F.when(F.abs(value) != float("inf"), value)


def null_as_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def datetime_as_unix(value: Column) -> Column:
    """Seconds since 1970."""
    return F.unix_seconds(value.cast("timestamp"))


def to_dataframe(x: CubeArray, dense: bool = True) -> DataFrame:
    """One row per cell: the dimensions and a column named after the array."""
    return x.to_dataframe(dense).withColumnRenamed(VALUE, x.name or VALUE)


def to_geodataframe(x: CubeArray, output_crs: str | None = None, dense: bool = True) -> DataFrame:
    """The same with each cell's point as well-known text, in `output_crs` if there is one, and its reference system."""
    crs = output_crs if output_crs is not None and x.crs is not None else x.crs
    point = F.format_string("POINT (%s %s)", F.col("__px").cast("string"), F.col("__py").cast("string"))
    frame = project(to_dataframe(x, dense), x.crs, crs, X, Y, ("__px", "__py")).withColumn("geometry", point)
    return frame.drop("__px", "__py").withColumn("crs", F.lit(crs_name(crs) if crs else None).cast("string"))


def to_csv(x: CubeArray, path: str, dense: bool = True) -> None:
    """A folder of CSV files, with a header unless the array has no dimensions."""
    to_dataframe(x, dense).write.mode("overwrite").csv(path, header=bool(x.dims))


def to_parquet(x: CubeArray, path: str, dense: bool = False) -> None:
    to_dataframe(x, dense).write.mode("overwrite").parquet(path)


def to_numpy(x: CubeArray) -> tuple[np.ndarray, dict[str, list]]:
    """The dense grid as an array, and the coordinates of each dimension in index order.

    For results that fit the driver, such as maps and series to plot.
    """
    frame = x.df.toPandas()
    coords = {}
    for d in x.dims:
        axis = x.axis(d)
        coords[d] = [r[0] for r in axis.frame.select(d).distinct().orderBy(axis.order()).collect()]
    place = [{c: i for i, c in enumerate(coords[d])} for d in x.dims]
    kind = object if frame[VALUE].dtype == object and frame[VALUE].map(lambda v: isinstance(v, str)).any() else float
    grid = np.full([len(coords[d]) for d in x.dims], None if kind is object else np.nan, dtype=kind)
    values = frame[VALUE] if kind is object or frame[VALUE].dtype.kind != "M" else frame[VALUE].map(lambda t: t.timestamp() if t == t else np.nan)
    keys = zip(*[[p[v] for v in frame[d]] for d, p in zip(x.dims, place, strict=True)], strict=True) if x.dims else [()] * len(frame)
    for key, value in zip(keys, values, strict=True):
        if value is not None and value == value and key is not None:
            grid[key] = value
    return grid, coords


def to_geotiff(x: CubeArray, path: str, compress: bool | str = True, output_crs: str | None = None, dtype: str = "float64") -> None:
    """A GeoTIFF with one band per coordinate of a third dimension.

    Infinite values are missing, times Unix seconds.  `compress` is "deflate"
    (or True), "lzw" or False; `output_crs` warps to another reference system;
    cells missing in an integer `dtype` hold the value declared as nodata.
    """
    from ..operators.verbs import reproject
    from .geotiff import write_geotiff

    if output_crs is not None and x.crs is not None:
        x = reproject(x, output_crs)

    if not {Y, X} <= set(x.dims) or len(x.dims) > 3:
        raise TooManyDimensionsError(f"a GeoTIFF has y, x and at most one more dimension, not {x.dims}")
    grid, coords = to_numpy(x)
    third = [d for d in x.dims if d not in (Y, X)]
    grid = np.transpose(grid.astype(float), [x.dims.index(d) for d in (*third, Y, X)])
    grid = np.where(np.isinf(grid), np.nan, grid)
    write_geotiff(path, grid if third else grid[None], coords[Y], coords[X], crs=x.crs, compress=compress, dtype=dtype)
