"""Ontologies: what concepts mean in terms of layers."""

from __future__ import annotations

from abc import abstractmethod
from typing import TYPE_CHECKING

from ..errors import UnknownConceptError
from ..model import CubeArray, CubeCollection
from ..operators.collections import merge

if TYPE_CHECKING:
    from .processor import QueryProcessor


class Mapping(dict):
    """Nested dictionaries: category, concept, property, rule."""

    def lookup(self, *reference: str) -> dict:
        """The ruleset of a concept."""
        found: object = self
        for part in reference:
            if not isinstance(found, dict) or part not in found:
                raise UnknownConceptError(f"there is no concept {reference!r}")
            found = found[part]
        if not isinstance(found, dict):
            raise UnknownConceptError(f"{reference!r} is not a concept")
        return found

    @abstractmethod
    def translate(self, *reference: str, property: str | None = None, processor: QueryProcessor) -> CubeArray:
        """A concept as an array."""


class Ontology(Mapping):
    """Rules are blocks of the query language; a concept with several properties holds where all of them do."""

    def translate(self, *reference: str, property: str | None = None, processor: QueryProcessor) -> CubeArray:
        rules = self.lookup(*reference)
        if property is not None:
            if property not in rules:
                raise UnknownConceptError(f"concept {reference!r} has no property {property!r}")
            return processor.array(rules[property])
        properties = tuple(processor.array(rule) for rule in rules.values())
        if len(properties) == 1:
            return properties[0]
        return merge(CubeCollection(properties), "all", track_types=processor.track_types)
