"""Cube sources: a layout that describes layers, and how to retrieve one."""

from __future__ import annotations

import itertools
from abc import ABC, abstractmethod
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .. import types
from ..errors import UnknownLayerError
from ..extent import SpatialExtent, TemporalExtent
from ..model import CubeArray

#: Names of resampling methods that a layout may ask for.  Fixed values.
RESAMPLERS = ("nearest", "average", "bilinear", "cubic", "cubic_spline", "lanczos", "mode", "gauss", "max", "min", "med", "q1", "q3")


@dataclass
class Extent:
    """What a query looks at: the cells of space with their features, and closed bounds in time."""

    spark: SparkSession
    space: DataFrame | None = None  # (y, x, feature); None is everywhere
    bounds: tuple[float, float, float, float] | None = None  # least x, least y, greatest x, greatest y of the cells
    time: TemporalExtent | None = None
    tz: str = "UTC"
    crs: str | None = None
    resolution: tuple[float, float] | None = None
    feature_labels: dict[int, str] | None = None
    spatial: SpatialExtent | None = None
    #: Tells extents apart for as long as a source lives, whatever becomes of their frames.
    key: int = field(default_factory=itertools.count().__next__, init=False, compare=False)


class CubeSource(ABC):
    """A cube with a layout of layers.

    The layout is a nested dictionary; a leaf has `type`, usually `values` and
    `description`, and what the source needs to find the layer.
    """

    value_types = {t: t for t in (types.BINARY, types.CONTINUOUS, types.DISCRETE, types.ORDINAL, types.NOMINAL, types.DATETIME, types.COORDS)}

    def __init__(self, layout: dict, tz: str = "UTC", trim: bool = True, resamplers: dict[str, str] | None = None, value_type_mapping: dict[str, str] | None = None):
        self.layout, self.tz, self.trim = layout, tz, trim
        self.resamplers = {t: "nearest" for t in self.value_types} | (resamplers or {})
        self.value_types = self.value_types | (value_type_mapping or {})
        unknown = set(self.resamplers.values()) - set(RESAMPLERS)
        if unknown:
            raise ValueError(f"unknown resampling methods: {sorted(unknown)}")

    def lookup(self, *reference: str) -> dict:
        """Metadata of a layer: its layout entry with `reference`, `labels` and `descriptions`."""
        entry: object = self.layout
        for part in reference:
            if not isinstance(entry, dict) or part not in entry:
                raise UnknownLayerError(f"there is no layer {reference!r}")
            entry = entry[part]
        if not isinstance(entry, dict) or not isinstance(entry.get("type"), str):
            raise UnknownLayerError(f"{reference!r} is not a layer")
        values = entry.get("values")
        listed = values if isinstance(values, list) else []
        return entry | {
            "reference": tuple(reference),
            "labels": {v["id"]: v["label"] for v in listed if "label" in v} or None,
            "descriptions": {v["id"]: v.get("description") for v in listed} or None,
        }

    def layers(self) -> Iterator[tuple[str, ...]]:
        """References of all layers."""

        def walk(node: dict, path: tuple[str, ...]) -> Iterator[tuple[str, ...]]:
            if isinstance(node.get("type"), str):
                yield path
            else:
                for key, child in node.items():
                    if isinstance(child, dict):
                        yield from walk(child, (*path, key))

        return walk(self.layout, ())

    def vtype(self, meta: dict) -> str | None:
        return self.value_types.get(meta["type"], meta["type"])

    @abstractmethod
    def retrieve(self, *reference: str, extent: Extent) -> CubeArray:
        """A layer within an extent."""
