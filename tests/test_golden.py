"""A 3 x 4 x 4 cube of categories with six known results."""

import datetime as dt

import pytest

from cubelark.model import Axis, array
from cubelark.plans import blocks as q
from cubelark.plans.mapping import Ontology
from cubelark.plans.recipe import QueryRecipe
from cubelark.sources.table import TableCube

#: The cube, by time, row, column, and what is known of it.
CUBE = [
    [[29, 29, 29, 29], [29, 29, 29, 29], [29, 29, 28, 29], [29, 29, 29, 29]],
    [[4, 4, 1, 2], [1, 1, 8, 4], [6, 1, 21, 4], [2, 28, 3, 4]],
    [[21, 4, 27, 4], [5, 3, 28, 21], [21, 28, 28, 30], [6, 28, 27, 4]],
]
TIMES = [dt.datetime(2019, 12, 15), dt.datetime(2020, 9, 5), dt.datetime(2020, 12, 19)]
BLUE_MAP = [[1, 0, 0, 0], [0, 0, 0, 1], [1, 0, 1, 0], [0, 0, 0, 0]]
GREEN_MAP = [[1, 2, 1, 2], [2, 2, 0, 1], [1, 1, 0, 1], [2, 0, 1, 2]]
BLUE_CURVE, GREEN_CURVE = [0, 1, 3], [0, 13, 6]
BLUE_STAT, GREEN_STAT = 4, 19


@pytest.fixture(scope="module")
def cube(spark):
    rows = [(TIMES[t], y, x, CUBE[t][y][x]) for t in range(3) for y in range(4) for x in range(4)]
    frame = spark.createDataFrame(rows, "time timestamp_ntz, y int, x int, colortype int").cache()
    layout = {"appearance": {"colortype": {"type": "ordinal", "table": "cube", "values": [{"id": i, "label": f"c{i}"} for i in range(1, 33)]}}}
    return TableCube(layout, {"cube": frame})


@pytest.fixture(scope="module")
def mapping():
    kind = q.appearance("colortype")
    return Ontology({"entity": {
        "water": {"color": kind.evaluate("in", [21, 22, 23, 24])},
        "vegetation": {"color": kind.evaluate("in", [q.label(f"c{i}") for i in range(1, 7)])},
        "snow": {"color": kind.evaluate("in", [29, 30])},
    }})


def test_six_results(spark, cube, mapping):
    recipe = QueryRecipe()
    for color, concept in (("blue", "water"), ("green", "vegetation")):
        recipe[f"{color}_map"] = q.entity(concept).reduce("count", "time")
        recipe[f"{color}_curve"] = q.entity(concept).reduce("count", "space")
        recipe[f"{color}_stat"] = q.result(f"{color}_curve").reduce("sum", "time")
    response = QueryRecipe.from_json(recipe.to_json()).execute(cube, mapping, spark=spark)
    for color, known in (("blue", BLUE_MAP), ("green", GREEN_MAP)):
        assert {(r.y, r.x): r.v for r in response[f"{color}_map"].df.collect()} == {(y, x): known[y][x] for y in range(4) for x in range(4)}
        assert response[f"{color}_map"].vtype == "discrete"
    for color, known in (("blue", BLUE_CURVE), ("green", GREEN_CURVE)):
        assert [r.v for r in response[f"{color}_curve"].df.orderBy("time").collect()] == known
    assert response["blue_stat"].df.first().v == BLUE_STAT and response["green_stat"].df.first().v == GREEN_STAT


def test_extract_by_dimension(spark):
    x = array(spark.createDataFrame([("a", 0, 1), ("a", 1, 2), ("b", 0, 3), ("b", 1, 4)], "foo string, bar int, v int"), ("foo", "bar"))
    from cubelark.operators.verbs import extract

    assert {tuple(r) for r in extract(x, "foo").df.collect()} == {("a", "a"), ("b", "b")}
    assert {tuple(r) for r in extract(x, "bar").df.collect()} == {(0, 0), (1, 1)}


def grid(spark, rows):
    frame = spark.createDataFrame([(i, j, v) for i, row in enumerate(rows) for j, v in enumerate(row)], "d0 int, d1 int, v double")
    return array(frame, ("d0", "d1"))


def cells(x):
    return {(r.d0, r.d1): r.v for r in x.df.collect()}


def test_filter_regular_aligned_and_by_itself(spark):
    from cubelark.operators.verbs import filter

    x = grid(spark, [[1.0, 2.0], [3.0, 4.0]])
    assert cells(filter(x, grid(spark, [[1.0, 0.0], [0.0, 1.0]]), track_types=False)) == {(0, 0): 1, (0, 1): None, (1, 0): None, (1, 1): 4}
    line = array(spark.createDataFrame([(0, 1.0), (1, 0.0)], "d0 int, v double"), ("d0",))
    assert cells(filter(x, line, track_types=False)) == {(0, 0): 1, (0, 1): 2, (1, 0): None, (1, 1): None}
    short = array(spark.createDataFrame([(0, 1.0)], "d0 int, v double"), ("d0",))  # a coordinate without a filterer is dropped
    assert cells(filter(x, short, track_types=False)) == {(0, 0): 1, (0, 1): 2, (1, 0): None, (1, 1): None}
    y = grid(spark, [[1.0, 0.0], [0.0, 1.0]])
    assert cells(filter(y, y, track_types=False)) == {(0, 0): 1, (0, 1): None, (1, 0): None, (1, 1): 1}


def test_order_follows_the_index(spark):
    from cubelark.operators.verbs import reduce
    from cubelark.operators.windows import shift

    frame = spark.createDataFrame([(y, 10.0 * y) for y in range(3)], "y int, v double")
    x = array(frame, ("y",), descending=("y",))
    assert reduce(x, "first", "y").df.first().v == 20
    assert {r.y: r.v for r in shift(x, "y", 1).df.collect()} == {1: 20, 0: 10}
    assert x.axes["y"] == Axis("y", x.axes["y"].frame, True)
