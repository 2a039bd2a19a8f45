"""Recipes: named results, each a block."""

from __future__ import annotations

import json
from typing import Any

from .processor import QueryProcessor, Response


class QueryRecipe(dict):
    """Instructions by result name, in order.  JSON round trips."""

    def execute(self, datacube: Any, mapping: Any, space: Any = None, time: Any = None, **config: Any) -> Response:
        """Resolves all results within an extent.  They are plans; nothing runs until a result is used."""
        return QueryProcessor.parse(self, datacube, mapping, space, time, **config).optimize().execute()

    def to_json(self) -> str:
        return json.dumps(self, default=str)

    @classmethod
    def from_json(cls, text: str) -> QueryRecipe:
        return cls(json.loads(text))

    def tree(self) -> str:
        """The recipe as an indented outline."""
        lines: list[str] = []
        for name, block in self.items():
            lines.append(name)
            _outline(block, 1, lines)
        return "\n".join(lines)


def _outline(block: Any, depth: int, lines: list[str]) -> None:
    pad = "  " * depth
    if not isinstance(block, dict):
        lines.append(f"{pad}{block!r}")
    elif block.get("type") == "processing_chain":
        _outline(block["with"], depth, lines)
        for verb in block["do"]:
            plain = {k: v for k, v in verb["params"].items() if not isinstance(v, dict)}
            lines.append(f"{pad}.{verb['name']}({', '.join(f'{k}={v!r}' for k, v in plain.items())})")
            for value in verb["params"].values():
                if isinstance(value, dict):
                    _outline(value, depth + 2, lines)
    elif block.get("type") == "collection":
        lines.append(f"{pad}collection")
        for element in block["elements"]:
            _outline(element, depth + 1, lines)
    else:
        lines.append(pad + " ".join(str(v) for v in block.values()))


