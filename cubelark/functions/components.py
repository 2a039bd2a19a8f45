"""Components of the time and space dimensions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import UnknownComponentError
from ..types import CONTINUOUS, DATETIME, DISCRETE, NOMINAL, ORDINAL


def _season(t: Column) -> Column:
    """1 spring (March to May), 2 summer, 3 autumn, 4 winter, as months go on the northern half."""
    quarter = F.floor((F.month(t) % 12) / 3).cast("int")
    return F.when(quarter == 0, 4).otherwise(quarter)


#: Fixed: time components, their value types and labels.
TIME: dict[str, tuple[Callable[[Column], Column], str]] = {
    "year": (F.year, DISCRETE),
    "quarter": (F.quarter, ORDINAL),
    "month": (F.month, ORDINAL),
    "week": (F.weekofyear, DISCRETE),
    "day": (F.dayofmonth, DISCRETE),
    "dayofweek": (F.weekday, ORDINAL),
    "dayofyear": (F.dayofyear, DISCRETE),
    "hour": (F.hour, DISCRETE),
    "minute": (F.minute, DISCRETE),
    "second": (lambda t: F.second(t), DISCRETE),
    "season": (_season, ORDINAL),
}
ALIASES = {"day_of_week": "dayofweek", "day_of_year": "dayofyear"}
LABELS: dict[str, dict[int, str]] = {
    "dayofweek": dict(enumerate(["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"])),
    "month": dict(enumerate(["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"], 1)),
    "quarter": {1: "January, February, March", 2: "April, May, June", 3: "July, August, September", 4: "October, November, December"},
    "season": {1: "March, April, May", 2: "June, July, August", 3: "September, October, November", 4: "December, January, February"},
}
SPACE = {"x": CONTINUOUS, "y": CONTINUOUS, "feature": NOMINAL}


def time_component(name: str | None, t: Column) -> tuple[Column, str, dict[int, str] | None]:
    """Expression, value type and labels of a component of a time."""
    if name is None:
        return t, DATETIME, None
    name = ALIASES.get(name, name)
    if name not in TIME:
        raise UnknownComponentError(f"the time dimension has no component {name!r}")
    make, kind = TIME[name]
    return make(t), kind, LABELS.get(name)
