"""Polygons on a plane: parsing, containment, rasterising."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Ring = tuple[tuple[float, float], ...]


@dataclass(frozen=True)
class Geometry:
    """A set of polygons, each an outer ring followed by its holes."""

    polygons: tuple[tuple[Ring, ...], ...]
    crs: str | None = None

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        points = np.array([p for rings in self.polygons for p in rings[0]])
        return (*points.min(axis=0).tolist(), *points.max(axis=0).tolist())


def crs_name(crs: object) -> str:
    text = str(crs).upper()
    return text if text.startswith("EPSG:") else f"EPSG:{text}" if text.isdigit() else text


def _polygons(geometry: dict) -> Iterable[tuple[Ring, ...]]:
    kind = geometry["type"]
    ring = lambda r: tuple((float(p[0]), float(p[1])) for p in r)
    if kind == "Polygon":
        yield tuple(ring(r) for r in geometry["coordinates"])
    elif kind == "MultiPolygon":
        for part in geometry["coordinates"]:
            yield tuple(ring(r) for r in part)
    elif kind == "GeometryCollection":
        for part in geometry["geometries"]:
            yield from _polygons(part)
    else:
        raise ValueError(f"geometries of type {kind!r} have no area")


def features(obj: dict | str) -> list[tuple[Geometry, dict]]:
    """Geometry and properties of all features of a GeoJSON object."""
    if isinstance(obj, str):
        obj = json.loads(obj)
    kind = obj["type"]
    crs = (obj.get("crs") or {}) if isinstance(obj.get("crs"), dict) else {"name": obj.get("crs")}
    crs = crs.get("name") or crs.get("properties", {}).get("name")
    if kind == "FeatureCollection":
        return [(Geometry(g.polygons, g.crs or crs), p) for part in obj["features"] for g, p in features(part)]
    if kind == "Feature":
        return [(Geometry(tuple(_polygons(obj["geometry"])), crs), dict(obj.get("properties") or {}))]
    return [(Geometry(tuple(_polygons(obj)), crs), {})]


def union(parts: Iterable[Geometry]) -> Geometry:
    parts = list(parts)
    return Geometry(tuple(p for g in parts for p in g.polygons), parts[0].crs if parts else None)


def contains(geometry: Geometry, x: Column, y: Column) -> Column:
    """Whether a point lies in one of the polygons, as an expression: even-odd crossings, points on an edge count.

    One term for each edge, so it is meant for the polygons of a query, not for a layer of them.
    """
    inside = F.lit(False)
    for rings in geometry.polygons:
        crossings, on_edge = F.lit(0), F.lit(False)
        for ring in rings:
            closed = ring if ring[0] == ring[-1] else (*ring, ring[0])
            for (xa, ya), (xb, yb) in zip(closed, closed[1:], strict=False):
                side = (x - xa) * (yb - ya) - (y - ya) * (xb - xa)
                on_edge |= (side == 0) & x.between(min(xa, xb), max(xa, xb)) & y.between(min(ya, yb), max(ya, yb))
                if ya != yb:
                    low, high = (ya, yb) if ya < yb else (yb, ya)
                    left = side < 0 if yb > ya else side > 0
                    crossings += F.when((y >= low) & (y < high) & left, 1).otherwise(0)
        inside |= on_edge | (crossings % 2 == 1)
    x0, y0, x1, y1 = geometry.bounds
    return x.between(x0, x1) & y.between(y0, y1) & inside


def contains_points(geometry: Geometry, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """The same for many points at once, on the driver."""
    inside = np.zeros(xs.shape, dtype=bool)
    for rings in geometry.polygons:
        crossings, on_edge = np.zeros(xs.shape, dtype=int), np.zeros(xs.shape, dtype=bool)
        for ring in rings:
            closed = ring if ring[0] == ring[-1] else (*ring, ring[0])
            for (xa, ya), (xb, yb) in zip(closed, closed[1:], strict=False):
                side = (xs - xa) * (yb - ya) - (ys - ya) * (xb - xa)
                on_edge |= (side == 0) & (xs >= min(xa, xb)) & (xs <= max(xa, xb)) & (ys >= min(ya, yb)) & (ys <= max(ya, yb))
                if ya != yb:
                    low, high = (ya, yb) if ya < yb else (yb, ya)
                    crossings += (ys >= low) & (ys < high) & (side < 0 if yb > ya else side > 0)
        inside |= on_edge | (crossings % 2 == 1)
    return inside
