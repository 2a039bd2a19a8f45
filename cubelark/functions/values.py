"""Values that recipes hold besides plain constants."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidIntervalError


@dataclass(frozen=True)
class Interval:
    """A closed interval."""

    lower: object
    upper: object

    def __post_init__(self):
        if self.upper < self.lower:
            raise InvalidIntervalError(f"upper bound {self.upper!r} is below lower bound {self.lower!r}")


@dataclass(frozen=True)
class TimeBounds:
    """First and last time of an instant, an interval or an array, as constants or as expressions."""

    low: object
    high: object

    def columns(self) -> tuple[Column, Column]:
        return tuple(v if isinstance(v, Column) else F.lit(v).cast("timestamp_ntz") for v in (self.low, self.high))


def zone_of(name: str) -> dt.tzinfo:
    """A named zone, or a fixed offset such as UTC+02:00."""
    if name.startswith("UTC") and len(name) > 3:
        return dt.datetime.fromisoformat(f"2000-01-01T00:00:00{name[3:]}").tzinfo
    return ZoneInfo(name)


def parse_time(value: object, tz_from: str | None = None, tz_to: str | None = None) -> dt.datetime:
    """A naive time in `tz_to`; a value without offset is taken to be in `tz_from`."""
    if isinstance(value, str):
        value = dt.datetime.fromisoformat(value.replace("Z", "+00:00"))
    elif isinstance(value, dt.date) and not isinstance(value, dt.datetime):
        value = dt.datetime(value.year, value.month, value.day)
    elif hasattr(value, "to_pydatetime"):
        value = value.to_pydatetime()
    if value.tzinfo is None:
        value = value.replace(tzinfo=zone_of(tz_from or "UTC"))
    return value.astimezone(zone_of(tz_to or tz_from or "UTC")).replace(tzinfo=None)
