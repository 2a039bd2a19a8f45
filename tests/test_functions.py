"""Operators and reducers against hand-written scalar models of the missing-value rules."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cubelark import types
from cubelark.errors import InvalidIntervalError, InvalidValueTypeError
from cubelark.functions import scalar
from cubelark.functions.reducers import REDUCERS
from cubelark.functions.values import Interval

VALUES = [None, 0.0, 1.0, 2.0, -3.0]


def near(a, b):
    if a is None or b is None:
        return a is None and b is None
    return math.isclose(float(a), float(b), rel_tol=1e-9, abs_tol=1e-12)


UNARY = {
    "not": lambda x: x == 0,
    "absolute": abs,
    "ceiling": math.ceil,
    "floor": math.floor,
    "cosine": math.cos,
    "sine": math.sin,
    "tangent": math.tan,
    "cosecant": lambda x: 1 / math.sin(x) if math.sin(x) else None,
    "secant": lambda x: 1 / math.cos(x),
    "cotangent": lambda x: 1 / math.tan(x) if math.tan(x) else None,
    "cube_root": lambda x: math.copysign(abs(x) ** (1 / 3), x),
    "exponential": math.exp,
    "natural_logarithm": lambda x: math.log(x) if x > 0 else None,
    "square_root": lambda x: math.sqrt(x) if x >= 0 else None,
    "to_degrees": math.degrees,
    "to_radians": math.radians,
}


def _power(x, y):
    try:
        value = x**y
    except ZeroDivisionError:
        return math.inf
    return None if isinstance(value, complex) else value


ARITHMETIC = {
    "add": lambda x, y: x + y,
    "subtract": lambda x, y: x - y,
    "multiply": lambda x, y: x * y,
    "divide": lambda x, y: x / y if y else None,
    "power": _power,
    "normalized_difference": lambda x, y: (x - y) / (x + y) if x + y else None,
}
COMPARISON = {
    "and": lambda x, y: bool(x) and bool(y or 0),
    "or": lambda x, y: bool(x) or bool(y or 0),
    "exclusive_or": lambda x, y: bool(x) != bool(y or 0),
    "equal": lambda x, y: x == y,
    "not_equal": lambda x, y: x != y,
    "greater": lambda x, y: y is not None and x > y,
    "greater_equal": lambda x, y: y is not None and x >= y,
    "less": lambda x, y: y is not None and x < y,
    "less_equal": lambda x, y: y is not None and x <= y,
}


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame([(x, y) for x in VALUES for y in VALUES], "x double, y double").cache()


def test_all_operators_have_a_model():
    assert set(UNARY) | {"is_missing", "not_missing"} == set(scalar.UNARY)
    assert set(ARITHMETIC) | set(COMPARISON) == set(scalar.BINARY)
    assert len(scalar.NAMES) == 39


def test_unary_operators(pairs):
    exprs = [f(F.col("x")).alias(k) for k, f in scalar.UNARY.items()]
    for row in pairs.select("x", *exprs).distinct().collect():
        for name, model in UNARY.items():
            assert near(row[name], None if row.x is None else model(row.x)), (name, row.x)
        assert row["is_missing"] == int(row.x is None) == 1 - row["not_missing"]


def test_binary_operators(pairs):
    exprs = [f(F.col("x"), F.col("y")).alias(k) for k, f in scalar.BINARY.items()]
    for row in pairs.select("x", "y", *exprs).collect():
        for name, model in ARITHMETIC.items():
            assert near(row[name], None if row.x is None or row.y is None else model(row.x, row.y)), (name, row.x, row.y)
        for name, model in COMPARISON.items():
            assert near(row[name], None if row.x is None else model(row.x, row.y)), (name, row.x, row.y)


def test_membership_and_assignment(pairs):
    x, y = F.col("x"), F.col("y")
    cases = {
        "in_set": (scalar.member("in", x, [1, None, 2]), lambda x: x in (1, 2)),
        "not_in_set": (scalar.member("not_in", x, [1, None, 2]), lambda x: x not in (1, 2)),
        "empty": (scalar.member("in", x, []), lambda x: False),
        "in_interval": (scalar.member("in", x, Interval(0, 1)), lambda x: 0 <= x <= 1),
        "not_in_interval": (scalar.member("not_in", x, Interval(0, 1)), lambda x: not 0 <= x <= 1),
    }
    rows = pairs.select("x", "y", *[c.alias(k) for k, (c, _) in cases.items()], scalar.assign(x, y).alias("a"), scalar.assign_at(x, F.lit(9.0), y).alias("b")).collect()
    for row in rows:
        for name, (_, model) in cases.items():
            assert near(row[name], None if row.x is None else model(row.x))
        assert near(row.a, None if row.x is None else row.y)
        assert near(row.b, 9.0 if row.y else row.x)
    with pytest.raises(InvalidIntervalError):
        Interval(2, 1)


GROUPS = {"mix": [3, None, 1, 1, 3, 0], "null": [None, None], "zeros": [0, 0, None], "one": [None, 7], "neg": [-2, 5, None, -2, 5, 4], "true": [1, None, 2]}


def model(name, values):
    v = [x for x in values if x is not None]
    if name == "n":
        return len(v)
    if not v:
        return None
    mean = sum(v) / len(v)
    variance = sum((x - mean) ** 2 for x in v) / len(v)
    s = sorted(v)
    counts = Counter(v)
    return {
        "mean": mean, "median": (s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2, "mode": min(x for x in counts if counts[x] == max(counts.values())),
        "max": max(v), "min": min(v), "range": max(v) - min(v), "product": math.prod(v), "standard_deviation": math.sqrt(variance), "sum": sum(v), "variance": variance,
        "all": all(v), "any": any(v), "none": not any(v), "count": sum(x != 0 for x in v), "percentage": 100 * sum(x != 0 for x in v) / len(v), "first": v[0], "last": v[-1],
    }[name]


def test_reducers(spark):
    rows = [(g, i, None if x is None else float(x)) for g, values in GROUPS.items() for i, x in enumerate(values)]
    frame = spark.createDataFrame(rows, "g string, pos int, v double").repartition(3)
    got = frame.groupBy("g").agg(*[f(F.col("v"), F.col("pos")).alias(k) for k, f in REDUCERS.items()]).collect()
    assert len(REDUCERS) == 18
    for row in got:
        for name in REDUCERS:
            assert near(row[name], model(name, GROUPS[row.g])), (row.g, name)


def test_promotion():
    assert types.resolve("add", ["binary"], ["binary"])[0] == "discrete"
    assert types.resolve("add", ["discrete"], ["continuous"])[0] == "continuous"
    assert types.resolve("sum", ["binary"])[0] == "binary"
    assert types.resolve("percentage", ["binary"])[0] == "continuous"
    assert types.resolve("range", ["datetime"])[0] == "continuous"
    assert types.resolve("assign", ["ordinal"], ["datetime"]) == ("datetime", types.SECOND_LABELS)
    assert types.resolve("equal", ["ordinal"], types.candidates(2))[0] == "binary"
    assert types.resolve("anything", ["binary"], manual={"anything": ({("binary",): "ordinal"}, 0)})[0] == "ordinal"
    rejected = [("add", "nominal", "nominal"), ("and", "continuous", "binary"), ("greater", "nominal", "nominal"), ("after", "discrete", "datetime"), ("mean", "ordinal"), ("count", "discrete"), ("first", "coords"), ("assign_at", "nominal", "binary"), ("intersects", "continuous", "geometry")]
    for function, *operands in rejected:
        with pytest.raises(InvalidValueTypeError):
            types.resolve(function, *[[o] for o in operands])
