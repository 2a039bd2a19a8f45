"""From recipes to plans.

The processor resolves blocks to arrays: concepts are inlined by the mapping,
layers of one table share a frame, results are resolved once and shared,
`self` is the array that the surrounding verb is applied to.  What comes out are
DataFrames; Catalyst does the rest.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession

from ..errors import InvalidBuildingBlockError, RecursiveResultError, UnknownLabelError, UnknownOperatorError, UnknownReducerError, UnknownResultError, UnknownVerbError
from ..extent import SpatialExtent, TemporalExtent
from ..functions import geometry, projection, scalar
from ..functions.reducers import REDUCERS
from ..functions.values import Interval, TimeBounds, parse_time
from ..model import CubeArray, CubeCollection
from ..operators import collections, verbs, windows
from ..operators.delineate import delineate
from ..sources.base import CubeSource, Extent


class Response(dict):
    """Arrays by result name."""

    def frames(self, dense: bool = False) -> dict[str, Any]:
        return {k: v.to_dataframe(dense) for k, v in self.items()}


def parse_extent(spark: SparkSession, space: SpatialExtent | None, time: TemporalExtent | None, spatial_resolution: tuple[float, float] | None = None, crs: str | None = None, tz: str | None = None, preview: bool = False) -> Extent:
    """Cells of space and bounds of time; a preview has five cells a side over the bounds.

    Without a spatial extent a query looks everywhere; without a resolution the
    bounds only cut, and cells have no features.
    """
    tz = tz or (time.tz if time is not None else "UTC")
    if space is None:
        return Extent(spark, time=time, tz=tz, crs=crs, resolution=spatial_resolution)
    space = space.to_crs(crs)
    x0, y0, x1, y1 = space.bounds
    if preview:
        sign = spatial_resolution or (-1, 1)
        spatial_resolution = ((y1 - y0) / 5 * (1 if sign[0] > 0 else -1), (x1 - x0) / 5 * (1 if sign[1] > 0 else -1))
    if spatial_resolution is None:
        return Extent(spark, bounds=space.bounds, time=time, tz=tz, crs=crs or space.crs, spatial=space)
    cells = space.rasterize(spark, spatial_resolution, crs)
    return Extent(spark, cells, space.bounds, time, tz, crs or space.crs, spatial_resolution, space.labels, space)


@dataclass
class QueryProcessor:
    recipe: Mapping[str, Any]
    datacube: CubeSource
    mapping: Any
    extent: Extent
    custom_verbs: dict[str, Callable] = field(default_factory=dict)
    custom_operators: dict[str, Callable] = field(default_factory=dict)
    custom_reducers: dict[str, Callable] = field(default_factory=dict)
    track_types: bool = True
    manual: dict | None = None
    #: Persist layer tables that several results read.
    cache: bool = False
    #: Raise for results without any value; this runs a job for each.
    check_empty: bool = False
    response: Response = field(default_factory=Response)
    layers_used: list[tuple[str, ...]] = field(default_factory=list)

    def __post_init__(self):
        self._active: list[CubeArray | CubeCollection] = []
        self._open: list[str] = []

    @classmethod
    def parse(cls, recipe: Mapping[str, Any], datacube: CubeSource, mapping: Any, space: SpatialExtent | None = None, time: TemporalExtent | None = None, *, spark: SparkSession | None = None, spatial_resolution: tuple[float, float] | None = None, crs: str | None = None, tz: str | None = None, preview: bool = False, extent: Extent | None = None, **config: Any) -> QueryProcessor:
        spark = spark or SparkSession.getActiveSession()
        extent = extent or parse_extent(spark, space, time, spatial_resolution, crs, tz, preview)
        return cls(recipe, datacube, mapping, extent, **config)

    def optimize(self) -> QueryProcessor:
        """Cube-level rewrites happen while blocks are resolved; here layer tables with several readers are persisted if asked for."""
        if self.cache:
            used = [self.datacube.lookup(*r).get("table", r[0]) for r in self.dry_run()]
            for name in {t for t in used if used.count(t) > 1}:
                if hasattr(self.datacube, "frame"):
                    self.datacube.frame(name, self.extent)[0].persist()
        return self

    def execute(self) -> Response:
        for name in self.recipe:
            self.result(name)
        return self.response

    def dry_run(self) -> list[tuple[str, ...]]:
        """References of the layers that the recipe reads, in order and with repeats; nothing is read."""
        found: list[tuple[str, ...]] = []

        def walk(block: Any) -> None:
            if isinstance(block, (list, tuple)):
                for part in block:
                    walk(part)
            elif isinstance(block, dict):
                kind = block.get("type")
                if kind == "layer":
                    found.append(tuple(block["reference"]))
                elif kind == "concept":
                    rules = self.mapping.lookup(*block["reference"])
                    walk([rules[block["property"]]] if block.get("property") else list(rules.values()))
                else:
                    walk(list(block.values()))

        walk(list(self.recipe.values()))
        return found

    # ---- blocks

    def resolve(self, block: Any) -> Any:
        """An array, a collection or a value."""
        if not isinstance(block, dict) or "type" not in block:
            raise InvalidBuildingBlockError(f"not a block: {block!r}")
        handler = getattr(self, f"_{block['type']}", None) if block["type"] in BLOCKS else None
        if handler is None:
            raise InvalidBuildingBlockError(f"unknown kind of block: {block['type']!r}")
        try:
            return handler(block)
        except KeyError as missing:
            raise InvalidBuildingBlockError(f"{block['type']} lacks {missing}") from missing

    def array(self, block: Any) -> CubeArray:
        found = self.resolve(block)
        if not isinstance(found, CubeArray):
            raise InvalidBuildingBlockError(f"{block.get('type')} is not an array")
        return found

    def operand(self, value: Any) -> Any:
        """Blocks are resolved, other values stand for themselves."""
        return self.resolve(value) if isinstance(value, dict) and "type" in value else value

    @property
    def active(self) -> CubeArray | CubeCollection:
        if not self._active:
            raise InvalidBuildingBlockError("self is used outside of a verb")
        return self._active[-1]

    def _concept(self, block: dict) -> CubeArray:
        return self.mapping.translate(*block["reference"], property=block.get("property"), processor=self)

    def _layer(self, block: dict) -> CubeArray:
        reference = tuple(block["reference"])
        self.layers_used.append(reference)
        return self.datacube.retrieve(*reference, extent=self.extent)

    def _result(self, block: dict) -> CubeArray | CubeCollection:
        return self.result(block["name"])

    def result(self, name: str) -> CubeArray | CubeCollection:
        """A result of the recipe, resolved once."""
        if name in self.response:
            return self.response[name]
        if name not in self.recipe:
            raise UnknownResultError(f"there is no result {name!r}")
        if name in self._open:
            raise RecursiveResultError(f"result {name!r} refers to itself: {' > '.join([*self._open, name])}")
        self._open.append(name)
        outer, self._active = self._active, []
        found = self.resolve(self.recipe[name])
        self._active = outer
        self._open.pop()
        if isinstance(found, CubeArray):
            found = verbs.name(found, name)
            if self.check_empty and found.is_empty():
                import warnings

                warnings.warn(f"result {name!r} has no values", stacklevel=2)
        self.response[name] = found
        return found

    def _self(self, block: dict) -> CubeArray | CubeCollection:
        return self.active

    def _collection(self, block: dict) -> CubeCollection:
        return CubeCollection(tuple(self.array(e) for e in block["elements"]))

    def _processing_chain(self, block: dict) -> Any:
        self._active.append(self.resolve(block["with"]))
        try:
            for verb in block["do"]:
                self._active[-1] = self.verb(self._active[-1], verb)
            return self._active[-1]
        finally:
            self._active.pop()

    def _label(self, block: dict) -> Any:
        x = self.active.first if isinstance(self.active, CubeCollection) else self.active
        found = [v for v, name in (x.labels or {}).items() if name == block["content"]]
        if not found:
            raise UnknownLabelError(f"no value of the array has the label {block['content']!r}")
        return found[0]

    def _set(self, block: dict) -> list:
        return [self.operand(m) for m in block["content"]]

    def _interval(self, block: dict) -> Interval:
        return Interval(*(self.operand(v) for v in block["content"]))

    def _geometry(self, block: dict) -> geometry.Geometry:
        found = geometry.union(g for g, _ in geometry.features(block["content"]))
        return found if projection.same(found.crs, self.extent.crs) else projection.project_geometry(found, found.crs, self.extent.crs)

    def _time_instant(self, block: dict) -> TimeBounds:
        content = block["content"]
        at = parse_time(content["start"], content.get("tz"), self.extent.tz)
        return TimeBounds(at, at)

    def _time_interval(self, block: dict) -> TimeBounds:
        content = block["content"]
        return TimeBounds(*(parse_time(content[k], content.get("tz"), self.extent.tz) for k in ("start", "end")))

    # ---- verbs

    def verb(self, obj: CubeArray | CubeCollection, block: dict) -> CubeArray | CubeCollection:
        if not isinstance(block, dict) or block.get("type") != "verb":
            raise InvalidBuildingBlockError(f"not a verb: {block!r}")
        name, params = block["name"], dict(block.get("params", {}))
        if name not in VERBS:
            raise InvalidBuildingBlockError(f"unknown verb: {name!r}")
        if name in ("compose", "concatenate", "merge"):
            if not isinstance(obj, CubeCollection):
                raise InvalidBuildingBlockError(f"{name} works on collections")
            return getattr(self, f"_verb_{name}")(obj, **params)
        if isinstance(obj, CubeCollection):
            if name == "groupby":
                raise InvalidBuildingBlockError("a collection can't be grouped")
            return obj.map(lambda x: self._on_element(x, name, params))
        return getattr(self, f"_verb_{name}")(obj, **params)

    def _on_element(self, x: CubeArray, name: str, params: dict) -> CubeArray:
        """A verb on one member of a collection; `self` is that member."""
        self._active.append(x)
        try:
            return getattr(self, f"_verb_{name}")(x, **params)
        finally:
            self._active.pop()

    @property
    def _types(self) -> dict[str, Any]:
        return {"track_types": self.track_types}

    def _reducer(self, name: str) -> None:
        if name not in self.custom_reducers and name not in REDUCERS:
            raise UnknownReducerError(f"there is no reducer {name!r}")

    def _verb_evaluate(self, x: CubeArray, operator: str, y: Any = None, **kwargs: Any) -> CubeArray:
        if operator not in self.custom_operators and operator not in scalar.NAMES:
            raise UnknownOperatorError(f"there is no operator {operator!r}")
        return verbs.evaluate(x, operator, self.operand(y), custom=self.custom_operators, manual=self.manual, **self._types, **kwargs)

    def _verb_extract(self, x: CubeArray, dimension: str, component: str | None = None) -> CubeArray:
        return verbs.extract(x, dimension, component)

    def _verb_filter(self, x: CubeArray, filterer: dict) -> CubeArray:
        return verbs.filter(x, self.array(filterer), **self._types)

    def _verb_assign(self, x: CubeArray, y: Any, at: dict | None = None) -> CubeArray:
        return verbs.assign(x, self.operand(y), None if at is None else self.array(at), **self._types)

    def _verb_groupby(self, x: CubeArray, grouper: dict, labels_as_names: bool = True) -> CubeCollection:
        return verbs.groupby(x, self.resolve(grouper), labels_as_names)

    def _verb_reduce(self, x: CubeArray, reducer: str, dimension: str | None = None, **kwargs: Any) -> CubeArray:
        self._reducer(reducer)
        return verbs.reduce(x, reducer, dimension, custom=self.custom_reducers, manual=self.manual, **self._types, **kwargs)

    def _verb_shift(self, x: CubeArray, dimension: str, steps: int) -> CubeArray:
        return windows.shift(x, dimension, steps)

    def _verb_smooth(self, x: CubeArray, reducer: str, dimension: str, size: int, limit: int = 2, fill: bool = False) -> CubeArray:
        self._reducer(reducer)
        return windows.smooth(x, reducer, dimension, size, limit, fill, custom=self.custom_reducers, manual=self.manual, **self._types)

    def _verb_trim(self, x: CubeArray, dimension: str | None = None) -> CubeArray:
        return verbs.trim(x, dimension)

    def _verb_delineate(self, x: CubeArray) -> CubeArray:
        return delineate(x, **self._types)

    def _verb_fill(self, x: CubeArray, dimension: str, method: str = "nearest", extrapolate: bool = True) -> CubeArray:
        return windows.fill(x, dimension, method, extrapolate, **self._types)

    def _verb_name(self, x: CubeArray, value: str) -> CubeArray:
        return verbs.name(x, value)

    def _verb_apply_custom(self, x: CubeArray, verb: str, **kwargs: Any) -> CubeArray:
        if verb not in self.custom_verbs:
            raise UnknownVerbError(f"there is no custom verb {verb!r}")
        return self.custom_verbs[verb](x, **kwargs)

    def _verb_compose(self, c: CubeCollection) -> CubeArray:
        return collections.compose(c, **self._types)

    def _verb_concatenate(self, c: CubeCollection, dimension: str, vtype: str = "nominal") -> CubeArray:
        return collections.concatenate(c, dimension, vtype, **self._types)

    def _verb_merge(self, c: CubeCollection, reducer: str, **kwargs: Any) -> CubeArray:
        self._reducer(reducer)
        return collections.merge(c, reducer, custom=self.custom_reducers, manual=self.manual, **self._types, **kwargs)

    # ---- extension

    def add_custom_verb(self, name: str, function: Callable) -> None:
        self.custom_verbs[name] = function

    def add_custom_operator(self, name: str, function: Callable) -> None:
        self.custom_operators[name] = function

    def add_custom_reducer(self, name: str, function: Callable) -> None:
        self.custom_reducers[name] = function


#: Fixed: kinds of blocks and names of verbs.
BLOCKS = ("concept", "layer", "result", "self", "collection", "processing_chain", "label", "set", "interval", "geometry", "time_instant", "time_interval")
VERBS = ("evaluate", "extract", "filter", "assign", "groupby", "reduce", "shift", "smooth", "trim", "delineate", "fill", "name", "apply_custom", "compose", "concatenate", "merge")
