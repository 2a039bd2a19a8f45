"""Catalogues of items: each has a time, a bounding box and files per band."""

from __future__ import annotations

import copy
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..functions.values import parse_time
from .base import Extent
from .geotiff import SCHEMA, tiff_cells
from .table import TableCube


class ItemCube(TableCube):
    """A cube over catalogue items (GeoJSON features with `assets`), whose GeoTIFF assets Spark can read.

    A layout entry's `name` is the asset key.  Items are filtered by time and
    box before any file is opened; files are read by the executors, one a task.
    An item may carry a key property that has to match the layout's `key`.
    With `group_by_solar_day` the items of a day are mosaicked, first valid value first.
    """

    def __init__(self, layout: dict, src: list[dict] | str, key: str | None = None, **config):
        super().__init__(copy.deepcopy(layout), descending=("y",), **config)
        if isinstance(src, str):
            with open(src, encoding="utf-8") as file:
                src = json.load(file)["features"]
        self.items, self.key = src, key

    def within(self, extent: Extent) -> list[dict]:
        """Items that meet the extent; its bounds in time are closed."""
        found = []
        for item in self.items:
            at = parse_time(item["properties"]["datetime"], "UTC", self.tz)
            if extent.time is not None:
                own = extent.time.tz_convert(self.tz)
                if not own.start <= at <= own.end:
                    continue
            if extent.bounds is not None and "bbox" in item:
                x0, y0, x1, y1 = item["bbox"]
                a0, b0, a1, b1 = extent.bounds
                if x1 < a0 or x0 > a1 or y1 < b0 or y0 > b1:
                    continue
            found.append(item)
        return found

    def table(self, spark: SparkSession, name: str, extent: Extent) -> DataFrame:
        rows = [(parse_time(i["properties"]["datetime"], "UTC", self.tz), i["assets"][name]["href"]) for i in self.within(extent) if name in i.get("assets", {}) and (self.key is None or i["properties"].get(self.key) == self.layout.get(self.key))]
        if not rows:
            return spark.createDataFrame([], SCHEMA)
        times: dict[str, np.datetime64] = {_plain(href): np.datetime64(at) for at, href in rows}

        def read(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in files:
                for path, content in zip(batch["path"], batch["content"], strict=True):
                    yield tiff_cells(content, [times[_plain(path)]])

        return spark.read.format("binaryFile").load([href for _, href in rows]).select("path", "content").mapInPandas(read, SCHEMA)

    def retrieve(self, *reference: str, extent: Extent):
        meta = self.lookup(*reference)
        node = self.layout
        for part in reference:
            node = node[part]
        node.setdefault("table", meta["name"])
        node.setdefault("column", "v")
        return super().retrieve(*reference, extent=extent)


def _plain(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")
