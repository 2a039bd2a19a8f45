"""Fluent builders of recipes.

Everything is a dictionary that JSON can hold: a reference or value, or a chain
of verbs applied to one.
"""

from __future__ import annotations

import builtins
import json
from typing import Any

from ..errors import InvalidIntervalError
from ..extent import _zone


def _plain(value: Any) -> Any:
    """What a chain stands for in a recipe."""
    return value.block if isinstance(value, Chain) else value


def _second(value: Any) -> Any:
    """A list, tuple or set as second operand is a set of values."""
    if isinstance(value, (builtins.list, builtins.tuple, builtins.set, builtins.frozenset)):
        return set(*value)
    return _plain(value)


class Chain(dict):
    """A block with verbs to apply to it.  It is the block's dictionary itself."""

    def __init__(self, start: dict, verbs: tuple[dict, ...] = ()):
        self.start, self.verbs = start, verbs
        super().__init__(start if not verbs else {"type": "processing_chain", "with": start, "do": builtins.list(verbs)})

    @property
    def block(self) -> dict:
        return dict(self)

    def _then(self, verb: str, /, **params: Any) -> Any:
        given = {k: v for k, v in params.items() if v is not None}
        return type(self)(self.start, (*self.verbs, {"type": "verb", "name": verb, "params": given}))

    def to_json(self) -> str:
        return json.dumps(self.block, default=str)


class _Shared(Chain):
    """Verbs that arrays and collections share."""

    def evaluate(self, operator: str, y: Any = None, **kwargs: Any):
        return self._then("evaluate", operator=operator, y=_second(y), **kwargs)

    def extract(self, dimension: str, component: str | None = None, **kwargs: Any):
        return self._then("extract", dimension=dimension, component=component, **kwargs)

    def filter(self, filterer: Any, **kwargs: Any):
        return self._then("filter", filterer=_plain(filterer), **kwargs)

    def filter_time(self, *condition: Any, **kwargs: Any):
        return self.filter(_condition("time", condition), **kwargs)

    def filter_space(self, *condition: Any, **kwargs: Any):
        return self.filter(_condition("space", condition), **kwargs)

    def assign(self, y: Any, at: Any = None, **kwargs: Any):
        return self._then("assign", y=_plain(y), at=_plain(at), **kwargs)

    def assign_time(self, component: str | None = None, **kwargs: Any):
        return self.assign(self_().extract("time", component), **kwargs)

    def assign_space(self, component: str | None = None, **kwargs: Any):
        return self.assign(self_().extract("space", component), **kwargs)

    def reduce(self, reducer: str, dimension: str | None = None, **kwargs: Any):
        return self._then("reduce", reducer=reducer, dimension=dimension, **kwargs)

    def shift(self, dimension: str, steps: int, **kwargs: Any):
        return self._then("shift", dimension=dimension, steps=steps, **kwargs)

    def smooth(self, reducer: str, dimension: str, size: int, limit: int = 2, fill: bool = False, **kwargs: Any):
        return self._then("smooth", reducer=reducer, dimension=dimension, size=size, limit=limit, fill=fill, **kwargs)

    def trim(self, dimension: str | None = None, **kwargs: Any):
        return self._then("trim", dimension=dimension, **kwargs)

    def delineate(self, **kwargs: Any):
        return self._then("delineate", **kwargs)

    def fill(self, dimension: str, method: str = "nearest", extrapolate: bool = True, **kwargs: Any):
        return self._then("fill", dimension=dimension, method=method, extrapolate=extrapolate, **kwargs)

    def name(self, value: str, **kwargs: Any):
        return self._then("name", value=value, **kwargs)

    def apply_custom(self, verb: str, **kwargs: Any):
        return self._then("apply_custom", verb=verb, **kwargs)


class CollectionChain(_Shared):
    """Verbs on a collection."""

    def compose(self, **kwargs: Any) -> ArrayChain:
        return ArrayChain(self.start, self._then("compose", **kwargs).verbs)

    def concatenate(self, dimension: str, vtype: str = "nominal", **kwargs: Any) -> ArrayChain:
        return ArrayChain(self.start, self._then("concatenate", dimension=dimension, vtype=vtype, **kwargs).verbs)

    def merge(self, reducer: str, **kwargs: Any) -> ArrayChain:
        return ArrayChain(self.start, self._then("merge", reducer=reducer, **kwargs).verbs)


class ArrayChain(_Shared):
    """Verbs on one array."""

    def groupby(self, grouper: Any, labels_as_names: bool = True, **kwargs: Any) -> CollectionChain:
        return CollectionChain(self.start, self._then("groupby", grouper=_plain(grouper), labels_as_names=labels_as_names, **kwargs).verbs)

    def groupby_time(self, component: Any = None, **kwargs: Any) -> CollectionChain:
        return self.groupby(_groupers("time", component), **kwargs)

    def groupby_space(self, component: Any = None, **kwargs: Any) -> CollectionChain:
        return self.groupby(_groupers("space", component), **kwargs)


def _groupers(dimension: str, component: Any) -> Chain:
    if isinstance(component, (builtins.list, builtins.tuple)):
        return collection(*[self_().extract(dimension, c) for c in component])
    return self_().extract(dimension, component)


def _condition(dimension: str, parts: tuple) -> Chain:
    """(operator, y) on the coordinates or (component, operator, y) on a component of them."""
    if len(parts) == 2:
        return self_().extract(dimension).evaluate(*parts)
    if len(parts) == 3:
        return self_().extract(dimension, parts[0]).evaluate(*parts[1:])
    raise ValueError("a condition is (operator, y) or (component, operator, y)")


def concept(*reference: str, property: str | None = None) -> ArrayChain:
    """A concept of the mapping; `property` asks for one of its properties only."""
    block = {"type": "concept", "reference": builtins.list(reference)}
    return ArrayChain(block | ({"property": property} if property is not None else {}))


def entity(*reference: str, property: str | None = None) -> ArrayChain:
    return concept("entity", *reference, property=property)


def event(*reference: str, property: str | None = None) -> ArrayChain:
    return concept("event", *reference, property=property)


def layer(*reference: str) -> ArrayChain:
    """A layer of the source."""
    return ArrayChain({"type": "layer", "reference": builtins.list(reference)})


def appearance(*reference: str) -> ArrayChain:
    return layer("appearance", *reference)


def artifacts(*reference: str) -> ArrayChain:
    return layer("artifacts", *reference)


def atmosphere(*reference: str) -> ArrayChain:
    return layer("atmosphere", *reference)


def reflectance(*reference: str) -> ArrayChain:
    return layer("reflectance", *reference)


def topography(*reference: str) -> ArrayChain:
    return layer("topography", *reference)


def result(name: str) -> ArrayChain:
    """Another result of the same recipe."""
    return ArrayChain({"type": "result", "name": name})


def self_() -> ArrayChain:
    """The array that the verb around is applied to."""
    return ArrayChain({"type": "self"})


def collection(*elements: Any) -> CollectionChain:
    return CollectionChain({"type": "collection", "elements": [_plain(e) for e in elements]})


def label(content: str) -> dict:
    """A value of the active array, by its label."""
    return {"type": "label", "content": content}


def set(*members: Any) -> dict:  # noqa: A001
    """Values, labels among them, to test membership in."""
    return {"type": "set", "content": [_plain(m) for m in members]}


def interval(a: Any, b: Any) -> dict:
    """A closed interval."""
    if not isinstance(a, dict) and not isinstance(b, dict) and b < a:
        raise InvalidIntervalError(f"upper bound {b!r} is below lower bound {a!r}")
    return {"type": "interval", "content": [a, b]}


def geometry(content: Any, crs: str | None = None) -> dict:
    """Areas, as GeoJSON."""
    if isinstance(content, str):
        content = json.loads(content)
    return {"type": "geometry", "content": dict(content) | ({"crs": crs} if crs else {})}


def time_instant(value: Any, tz: str | None = None) -> dict:
    return {"type": "time_instant", "content": {"type": "TemporalExtent", "start": _iso(value), "tz": tz or _zone(value) or "UTC"}}


def time_interval(a: Any, b: Any, tz: str | None = None) -> dict:
    return {"type": "time_interval", "content": {"type": "TemporalExtent", "start": _iso(a), "end": _iso(b), "tz": tz or _zone(a) or "UTC"}}


def _iso(value: Any) -> str:
    return value if isinstance(value, str) else value.isoformat()
