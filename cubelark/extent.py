"""Where and when a query looks: spatial and temporal extents."""

from __future__ import annotations

import datetime as dt
import json
import math
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import MixedTimeZonesError
from .functions import geometry, projection
from .functions.values import parse_time


class SpatialExtent:
    """Named areas on a plane."""

    def __init__(self, obj: object, crs: str | None = None):
        if isinstance(obj, str) and not obj.lstrip().startswith("{"):
            with open(obj, encoding="utf-8") as file:
                obj = json.load(file)
        parts = obj if isinstance(obj, list) else geometry.features(obj)
        self.features: list[tuple[geometry.Geometry, dict]] = parts
        self.crs = geometry.crs_name(crs or next((g.crs for g, _ in parts if g.crs), None) or "EPSG:4326")

    @classmethod
    def from_geojson(cls, obj: dict | str, crs: str | None = None) -> SpatialExtent:
        """A feature collection, a feature or a geometry."""
        return cls(obj, crs)

    from_featurecollection = from_feature = from_geometry = from_geojson

    @property
    def labels(self) -> dict[int, str]:
        """Names of the features by their number, from 1."""
        return {i: str(p.get("name", f"feature_{i}")) for i, (_, p) in enumerate(self.features, 1)}

    @property
    def geometry(self) -> geometry.Geometry:
        return geometry.union(g for g, _ in self.features)

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        """Least x, least y, greatest x, greatest y."""
        return self.geometry.bounds

    def to_crs(self, crs: str | None) -> SpatialExtent:
        """The same areas in another reference system."""
        if projection.same(crs, self.crs):
            return self
        return SpatialExtent([(projection.project_geometry(g, self.crs, crs), p) for g, p in self.features], crs)

    def rasterize(self, spark: SparkSession, resolution: tuple[float, float], crs: str | None = None) -> DataFrame:
        """(y, x, feature) of all cells of the grid over the bounds; outside the features it is missing.

        `resolution` is (y, x), negative for an axis that falls.  Centres lie
        half a step inside the bounds, snapped to multiples of the step.  Of
        overlapping features the later one counts.  The cells are made and
        tested on the executors.  With a `crs` the grid is in that system.
        """
        if not projection.same(crs, self.crs):
            return self.to_crs(crs).rasterize(spark, resolution)
        dy, dx = (abs(float(v)) for v in resolution)
        x0, y0, x1, y1 = self.bounds
        first_y, first_x = math.floor(y0 / dy), math.floor(x0 / dx)
        rows, columns = math.ceil(y1 / dy) - first_y, math.ceil(x1 / dx) - first_x
        place = lambda first, at, step: (at.cast("double") + F.lit(first + 0.5)) * F.lit(step)
        row = F.floor(F.col("id") / columns)
        return self._marked(spark.range(rows * columns).select(place(first_y, row, dy).alias("y"), place(first_x, F.col("id") % columns, dx).alias("x")))

    def over(self, spark: SparkSession, ys: list[float], xs: list[float]) -> DataFrame:
        """The same for given coordinates, two lists of the driver's."""
        y, x = (spark.createDataFrame([(float(v),) for v in values], f"{name} double") for name, values in (("y", ys), ("x", xs)))
        return self._marked(y.crossJoin(F.broadcast(x)))

    def _marked(self, cells: DataFrame) -> DataFrame:
        inside = [F.when(geometry.contains(g, F.col("x"), F.col("y")), i) for i, (g, _) in enumerate(self.features, 1)]
        return cells.withColumn("feature", F.coalesce(*reversed(inside), F.lit(None)).cast("int"))


@dataclass
class TemporalExtent:
    """An instant or a closed interval, in one time zone (UTC unless given)."""

    start: dt.datetime
    end: dt.datetime
    tz: str = "UTC"

    def __init__(self, *bounds: object, tz: str | None = None):
        if not 1 <= len(bounds) <= 2:
            raise ValueError("a temporal extent has one or two bounds")
        zones = {_zone(b) for b in bounds} - {None}
        if len(zones) > 1:
            raise MixedTimeZonesError(f"bounds in different time zones: {sorted(zones)}")
        own = zones.pop() if zones else None
        self.tz = tz or own or "UTC"
        self.start, self.end = (parse_time(b, own or self.tz, self.tz) for b in (bounds[0], bounds[-1]))

    def tz_convert(self, tz: str) -> TemporalExtent:
        return TemporalExtent(*(parse_time(b, self.tz, tz) for b in (self.start, self.end)), tz=tz)

    def discretize(self, spark: SparkSession, resolution: str | None = None, tz: str | None = None) -> DataFrame:
        """The bounds, or the times from the start to the end in steps such as "1 day"."""
        own = self.tz_convert(tz) if tz and tz != self.tz else self
        if resolution is None:
            return spark.createDataFrame([(t,) for t in dict.fromkeys((own.start, own.end))], "time timestamp_ntz")
        step = _step(resolution)
        return spark.sql(f"SELECT explode(sequence(TIMESTAMP_NTZ'{own.start}', TIMESTAMP_NTZ'{own.end}', INTERVAL {step})) AS time")


#: Fixed: abbreviations of steps.
_STEPS = {"D": "day", "d": "day", "H": "hour", "h": "hour", "min": "minute", "T": "minute", "S": "second", "s": "second", "W": "week", "MS": "month", "M": "month", "YS": "year", "Y": "year"}


def _step(resolution: str) -> str:
    match = re.fullmatch(r"\s*(\d*)\s*([A-Za-z]+?)s?\s*", resolution) if resolution not in _STEPS else re.fullmatch(r"()(\w+)", resolution)
    if not match:
        raise ValueError(f"unknown temporal resolution {resolution!r}")
    return f"{match[1] or 1} {_STEPS.get(match[2], match[2])}"


def _zone(bound: object) -> str | None:
    zone = getattr(bound, "tzinfo", None)
    if zone is None and isinstance(bound, str):
        zone = dt.datetime.fromisoformat(bound.replace("Z", "+00:00")).tzinfo
    if zone is None:
        return None
    name = getattr(zone, "key", None) or str(zone)
    return "UTC" if name == "UTC+00:00" else name
