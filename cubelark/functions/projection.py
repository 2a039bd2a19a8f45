"""Coordinates from one reference system to another, on numpy arrays, which columns reach in Arrow batches.

Known are longitude and latitude (EPSG:4326, 4258), web Mercator (3857),
universal transverse Mercator (326zz, 327zz, 258zz) and the European equal-area
grid (3035).  WGS 84 and ETRS89 count as one datum, as is usual for maps.

A first form in column expressions did not get through a query with joins in
minutes: each step uses the one before several times, and filters moved below
them probably copy the steps into one another.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .geometry import Geometry, crs_name

#: Fixed: half-axis and flattening of the ellipsoids.
WGS84 = (6378137.0, 1 / 298.257223563)
GRS80 = (6378137.0, 1 / 298.257222101)

Pair = tuple[Any, Any]


class Geographic:
    """Degrees east and north."""

    def forward(self, lon: Any, lat: Any) -> Pair:
        return lon * (180 / math.pi), lat * (180 / math.pi)

    def inverse(self, x: Any, y: Any) -> Pair:
        return x * (math.pi / 180), y * (math.pi / 180)


class WebMercator:
    """Mercator's projection of the sphere; without the poles."""

    radius = WGS84[0]

    def forward(self, lon: Any, lat: Any) -> Pair:
        return lon * self.radius, np.arcsinh(np.tan(lat)) * self.radius

    def inverse(self, x: Any, y: Any) -> Pair:
        return x / self.radius, np.arctan(np.sinh(y / self.radius))


class TransverseMercator:
    """Krüger's series in the third flattening, to its fourth power: below a millimetre within a zone."""

    def __init__(self, ellipsoid: tuple[float, float], meridian: float, north: float, east: float = 500_000.0, scale: float = 0.9996):
        a, f = ellipsoid
        n = f / (2 - f)
        self.e = math.sqrt(f * (2 - f))
        self.meridian, self.north, self.east = math.radians(meridian), north, east
        self.radius = scale * a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
        self.there = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
        self.back = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)

    def forward(self, lon: Any, lat: Any) -> Pair:
        away, s = lon - self.meridian, np.sin(lat)
        t = np.sinh(np.arctanh(s) - np.arctanh(s * self.e) * self.e)  # tangent of the conformal latitude
        u, v = np.arctan2(t, np.cos(away)), np.arcsinh(np.sin(away) / np.sqrt(t * t + np.cos(away) * np.cos(away)))
        x = v + sum(np.cos(u * 2 * j) * np.sinh(v * 2 * j) * c for j, c in enumerate(self.there, 1))
        y = u + sum(np.sin(u * 2 * j) * np.cosh(v * 2 * j) * c for j, c in enumerate(self.there, 1))
        return x * self.radius + self.east, y * self.radius + self.north

    def inverse(self, x: Any, y: Any) -> Pair:
        v, u = (x - self.east) / self.radius, (y - self.north) / self.radius
        eta = v - sum(np.cos(u * 2 * j) * np.sinh(v * 2 * j) * c for j, c in enumerate(self.back, 1))
        xi = u - sum(np.sin(u * 2 * j) * np.cosh(v * 2 * j) * c for j, c in enumerate(self.back, 1))
        conformal = np.arcsin(np.sin(xi) / np.cosh(eta))
        q = np.arcsinh(np.tan(conformal))
        s = np.sin(conformal)
        for _ in range(4):  # isometric to geographic latitude; each step gains more than two digits
            s = np.tanh(q + np.arctanh(s * self.e) * self.e)
        return np.arctan2(np.sinh(eta), np.cos(xi)) + self.meridian, np.arcsin(s)


class AzimuthalEqualArea:
    """Lambert's projection of the ellipsoid, oblique, away from the poles."""

    def __init__(self, ellipsoid: tuple[float, float], lon: float, lat: float, east: float, north: float):
        a, f = ellipsoid
        self.e2, self.east, self.north, self.lon = f * (2 - f), east, north, math.radians(lon)
        self.e = math.sqrt(self.e2)
        s = math.sin(math.radians(lat))
        self.polar = self._q(1.0)
        authalic = math.asin(self._q(s) / self.polar)
        self.sin0, self.cos0 = math.sin(authalic), math.cos(authalic)
        self.radius = a * math.sqrt(self.polar / 2)
        self.stretch = a * math.cos(math.radians(lat)) / math.sqrt(1 - self.e2 * s * s) / (self.radius * self.cos0)

    def _q(self, s: Any) -> Any:
        """Grows with the area south of a latitude, of which `s` is the sine."""
        return (s / (1 - s * s * self.e2) + np.arctanh(s * self.e) / self.e) * (1 - self.e2)

    def forward(self, lon: Any, lat: Any) -> Pair:
        away = lon - self.lon
        s = self._q(np.sin(lat)) / self.polar
        c = np.sqrt(1 - s * s)
        b = np.sqrt(2 / (s * self.sin0 + c * np.cos(away) * self.cos0 + 1)) * self.radius
        return b * c * np.sin(away) * self.stretch + self.east, b / self.stretch * (s * self.cos0 - c * np.cos(away) * self.sin0) + self.north

    def inverse(self, x: Any, y: Any) -> Pair:
        dx, dy = (x - self.east) / self.stretch, (y - self.north) * self.stretch
        half = np.sqrt(dx * dx + dy * dy) / (2 * self.radius)
        # sine and cosine of the arc c, with sin(c) / rho written so that the origin is no special case
        cos_c, over = 1 - half * half * 2, np.sqrt(1 - half * half) / self.radius
        s = cos_c * self.sin0 + dy * over * self.cos0
        lon = np.arctan2(dx * over, cos_c * self.cos0 - dy * over * self.sin0) + self.lon
        q, lat = s * self.polar, np.arcsin(s)
        for _ in range(3):  # Newton's method from the authalic latitude
            p = np.sin(lat)
            w = 1 - p * p * self.e2
            lat = lat + (q - self._q(p)) * w * w / (np.cos(lat) * (2 * (1 - self.e2)))
        return lon, lat


def projection(crs: object) -> Any:
    """The projection of a reference system."""
    name = crs_name(crs)
    if name in ("EPSG:4326", "EPSG:4258", "OGC:CRS84"):
        return Geographic()
    if name == "EPSG:3857":
        return WebMercator()
    if name == "EPSG:3035":
        return AzimuthalEqualArea(GRS80, 10, 52, 4_321_000, 3_210_000)
    if (zone := re.fullmatch(r"EPSG:(326|327|258)(\d\d)", name)) and 1 <= int(zone[2]) <= 60:
        return TransverseMercator(GRS80 if zone[1] == "258" else WGS84, 6 * int(zone[2]) - 183, 10_000_000.0 if zone[1] == "327" else 0.0)
    raise NotImplementedError(f"the reference system {crs} is not known here")


def same(a: object, b: object) -> bool:
    """Whether nothing has to be done between two reference systems; an unknown one is taken as the other."""
    return a is None or b is None or crs_name(a) == crs_name(b)


def _moved(x: np.ndarray, y: np.ndarray, source: object, target: object) -> Pair:
    return projection(target).forward(*projection(source).inverse(x, y))


def project(frame: DataFrame, source: object, target: object, x: str = "x", y: str = "y", to: tuple[str, str] | None = None) -> DataFrame:
    """A frame with its points in another reference system, in place or in the two columns `to`; without a coordinate they are missing."""
    new_x, new_y = to or (x, y)
    if same(source, target):
        return frame.withColumns({new_x: F.col(x), new_y: F.col(y)})
    projection(source), projection(target)  # unknown ones raise here

    def work(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
        px, py = _moved(xs.to_numpy(dtype=float), ys.to_numpy(dtype=float), source, target)
        return pd.DataFrame({"x": px, "y": py})

    # not said to be deterministic, so no filter is moved below it to compute it a second time
    move = F.pandas_udf(work, "x double, y double").asNondeterministic()
    moved = frame.withColumn("__moved", move(F.col(x).cast("double"), F.col(y).cast("double")))
    return moved.withColumns({new_x: F.col("__moved.x"), new_y: F.col("__moved.y")}).drop("__moved")


def project_points(xs: Any, ys: Any, source: object, target: object) -> tuple[np.ndarray, np.ndarray]:
    """The same for a few points on the driver."""
    xs, ys = np.asarray(xs, dtype=float), np.asarray(ys, dtype=float)
    return (xs, ys) if same(source, target) else _moved(xs, ys, source, target)


def project_geometry(geometry: Geometry, source: object, target: object) -> Geometry:
    """Polygons with their corners in another reference system; edges stay straight lines."""
    move: Callable = lambda ring: tuple(zip(*(v.tolist() for v in project_points(*zip(*ring, strict=True), source, target)), strict=True))
    return Geometry(tuple(tuple(move(r) for r in rings) for rings in geometry.polygons), crs_name(target))


def project_bounds(bounds: tuple[float, float, float, float], source: object, target: object, steps: int = 21) -> tuple[float, float, float, float]:
    """Bounds of a rectangle in another reference system, by points along its edges."""
    x0, y0, x1, y1 = bounds
    xs, ys = np.linspace(x0, x1, steps), np.linspace(y0, y1, steps)
    px = np.concatenate([xs, xs, np.full(steps, x0), np.full(steps, x1)])
    py = np.concatenate([np.full(steps, y0), np.full(steps, y1), ys, ys])
    px, py = project_points(px, py, source, target)
    return float(px.min()), float(py.min()), float(px.max()), float(py.max())
