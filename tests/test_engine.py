"""Recipes, collections, windows, objects, extents and errors."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cubelark import errors
from cubelark.extent import SpatialExtent, TemporalExtent
from cubelark.functions import geometry
from cubelark.model import CubeCollection, array
from cubelark.operators import collections, verbs, windows
from cubelark.operators.delineate import delineate
from cubelark.plans import blocks as q
from cubelark.plans.components import connected_components
from cubelark.plans.mapping import Ontology
from cubelark.plans.processor import QueryProcessor, parse_extent
from cubelark.plans.recipe import QueryRecipe
from cubelark.sources.table import TableCube

DAYS = [dt.datetime(2024, 1, 1) + dt.timedelta(days=i) for i in range(4)]


@pytest.fixture(scope="module")
def cube(spark):
    rows = [(DAYS[t], float(y), float(x), 1 + (t + y + x) % 4, None if (t, y, x) == (1, 1, 1) else float(10 * t + 3 * y + x)) for t in range(4) for y in range(3) for x in range(3) if (t, y, x) != (2, 0, 0)]
    frame = spark.createDataFrame(rows, "time timestamp_ntz, y double, x double, kind int, value double").cache()
    layout = {"appearance": {"kind": {"type": "nominal", "table": "t", "values": [{"id": i, "label": f"k{i}"} for i in range(1, 5)]}}, "reflectance": {"value": {"type": "continuous", "table": "t"}}}
    return TableCube(layout, {"t": frame})


MAPPING = Ontology({"entity": {"one": {"kind": q.appearance("kind").evaluate("equal", 1)}, "both": {"a": q.appearance("kind").evaluate("in", [1, 2]), "b": q.reflectance("value").evaluate("greater", 5)}}})
KIND, VALUE, ONE = q.appearance("kind"), q.reflectance("value"), q.entity("one")


def run(spark, cube, block, **config):
    return QueryProcessor.parse({"r": block}, cube, MAPPING, spark=spark, **config).optimize().execute()["r"]


def rows(x, dense=False):
    return {tuple(r)[:-1]: r.v for r in x.to_dataframe(dense).collect()}


def test_arrays_of_one_table_combine_without_a_join(spark, cube):
    x = run(spark, cube, q.entity("both").evaluate("or", VALUE.evaluate("less", 2)))
    plan = x.df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    assert len(rows(x)) == 35


def test_group_reduce_concatenate_is_one_aggregation_a_step(spark, cube):
    x = run(spark, cube, VALUE.groupby_time("day").reduce("mean", "space").concatenate("day"))
    plan = x.df._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("Aggregate") == 1
    assert rows(x)[(1, DAYS[0])] == 4.0


def test_merge_properties(spark, cube):
    a, b = KIND.evaluate("equal", 1), VALUE.evaluate("greater", 5)
    either = rows(run(spark, cube, a.evaluate("or", b)))
    merged = rows(run(spark, cube, q.collection(a, b).merge("any")))
    assert merged == either
    for reducer in ("sum", "mean", "max", "first", "last", "n", "range", "median"):
        elements = tuple(run(spark, cube, VALUE.evaluate("multiply", k)) for k in (1, 2, 3))
        apart = rows(collections.merge(CubeCollection(elements), reducer))  # three frames: stacked
        fused = rows(run(spark, cube, q.collection(*[VALUE.evaluate("multiply", k) for k in (1, 2, 3)]).merge(reducer)))
        assert apart == fused, reducer


def test_sparse_and_dense_agree(spark, cube):
    x = run(spark, cube, VALUE)
    for verb in (lambda a: verbs.reduce(a, "mean", "time"), lambda a: windows.smooth(a, "mean", "time", 1), lambda a: windows.smooth(a, "sum", "space", 1), lambda a: windows.smooth(a, "median", "space", 1), lambda a: windows.shift(a, "time", 1)):
        sparse, dense = ({k: v for k, v in rows(verb(a)).items() if v is not None} for a in (x, x.densify()))
        assert sparse == dense


def test_two_pass_smoothing_equals_sending(spark, cube):
    x = run(spark, cube, VALUE)
    for reducer in ("mean", "sum", "n", "max", "min"):
        fast = rows(windows.smooth(x, reducer, "space", 1))
        slow = rows(windows.smooth(x, "own", "space", 1, custom={"own": lambda v, order, r=reducer: {"mean": F.avg, "sum": F.sum, "n": F.count, "max": F.max, "min": F.min}[r](v)}, track_types=False))
        assert {k: v for k, v in fast.items() if v is not None} == {k: v for k, v in slow.items() if v is not None}


def test_fill(spark):
    at = [DAYS[0] + dt.timedelta(days=d) for d in range(7)]
    known = {1: 1.0, 3: 9.0, 4: 16.0, 5: 25.0}
    x = array(spark.createDataFrame([(t, known.get(i)) for i, t in enumerate(at)], "time timestamp_ntz, v double"), ("time",))
    line = lambda *a, **k: [r.v for r in windows.fill(x, "time", *a, **k).df.orderBy("time").collect()]
    assert line("nearest") == [1, 1, 1, 9, 16, 25, 25]
    assert line("linear", extrapolate=False) == [None, 1, 5, 9, 16, 25, None]
    assert line("linear") == [-3, 1, 5, 9, 16, 25, 34]
    assert np.allclose(line("cubic"), [0, 1, 4, 9, 16, 25, 36])
    plane = array(spark.createDataFrame([(0, 0, 1.0), (0, 2, 5.0), (2, 2, 7.0)], "y int, x int, v double"), ("y", "x"))
    full = {(r.y, r.x): r.v for r in windows.fill(plane, "space").df.collect()}
    assert full == {(0, 0): 1, (0, 2): 5, (2, 0): 1, (2, 2): 7}


def brute_objects(true):
    """Numbers of connected cells (t, y, x), in the order of the first cell."""
    number, left = {}, sorted(true)
    for cell in left:
        if cell in number:
            continue
        todo, own = [cell], max(number.values(), default=0) + 1
        while todo:
            c = todo.pop()
            if c in number or c not in true:
                continue
            number[c] = own
            t, y, x = c
            todo += [(t, y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)] + [(t - 1, y, x), (t + 1, y, x)]
    return number


def test_objects(spark):
    rng = np.random.default_rng(5)
    for density in (0.2, 0.45):
        true = rng.random((3, 9, 9)) < density
        frame = spark.createDataFrame([(DAYS[t], y, x, int(true[t, y, x])) for t in range(3) for y in range(9) for x in range(9)], "time timestamp_ntz, y int, x int, v int")
        got = {(DAYS.index(r.time), r.y, r.x): r.v for r in delineate(array(frame, ("time", "y", "x"), vtype="binary")).df.collect()}
        want = brute_objects({tuple(map(int, c)) for c in np.argwhere(true)})
        assert got == {(t, y, x): want.get((t, y, x), 0) for t in range(3) for y in range(9) for x in range(9)}
    line = array(spark.createDataFrame([(DAYS[i], v) for i, v in enumerate([1, 0, 1, 1])], "time timestamp_ntz, v int"), ("time",), vtype="binary")
    assert [r.v for r in delineate(line).df.orderBy("time").collect()] == [1, 0, 2, 2]


def test_components(spark):
    rng = np.random.default_rng(7)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1100)]
    parent = {n: n for e in edges for n in e}
    find = lambda n: n if parent[n] == n else find(parent[n])
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {n: find(n) for e in edges for n in e if e[0] != e[1]}
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == want


def test_spatial_extent_and_features(spark, cube):
    parcels = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"name": "west"}, "geometry": {"type": "Polygon", "coordinates": [[[-0.5, -0.5], [0.5, -0.5], [0.5, 2.5], [-0.5, 2.5], [-0.5, -0.5]]]}},
        {"type": "Feature", "properties": {}, "geometry": {"type": "Polygon", "coordinates": [[[1.5, -0.5], [2.5, -0.5], [2.5, 2.5], [1.5, 2.5], [1.5, -0.5]]]}},
    ]}
    space = SpatialExtent(parcels, crs="EPSG:3035")
    assert space.labels == {1: "west", 2: "feature_2"} and space.bounds == (-0.5, -0.5, 2.5, 2.5)
    cells = space.over(spark, [0, 1, 2], [0, 1, 2])
    extent = parse_extent(spark, space, TemporalExtent("2024-01-01", "2024-01-02"))
    extent.space, extent.feature_labels = cells, space.labels
    x = run(spark, cube, VALUE.groupby_space("feature").reduce("max", "space").concatenate("parcel"), extent=extent)
    got = rows(x)
    assert set(got) == {("west", DAYS[0]), ("feature_2", DAYS[0]), ("west", DAYS[1]), ("feature_2", DAYS[1])}
    assert got[("west", DAYS[0])] == 6 and got[("feature_2", DAYS[1])] == 18
    raster = {(r.y, r.x): r.feature for r in space.rasterize(spark, (-1, 1)).collect()}
    assert raster[(0.5, 2.5)] == 2 and raster[(0.5, 0.5)] == 1 and raster[(0.5, 1.5)] in (2, None)
    preview = parse_extent(spark, space, None, (-0.1, 0.1), preview=True)
    assert preview.space.count() == 25 or preview.resolution == (-0.6, 0.6)


def test_point_in_polygon(spark):
    hole = {"type": "Polygon", "coordinates": [[[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]], [[4, 4], [6, 4], [6, 6], [4, 6], [4, 4]]]}
    g = geometry.features(hole)[0][0]
    points = [(x + 0.5, y + 0.5) for x in range(-1, 11) for y in range(-1, 11)] + [(0.0, 5.0), (10.0, 10.0), (5.0, 0.0)]
    frame = spark.createDataFrame(points, "x double, y double").withColumn("inside", F.coalesce(geometry.contains(g, F.col("x"), F.col("y")), F.lit(False)))
    xs, ys = (np.array([p[i] for p in points]) for i in (0, 1))
    assert [r.inside for r in frame.collect()] == geometry.contains_points(g, xs, ys).tolist()
    inside = dict(zip(points, geometry.contains_points(g, xs, ys).tolist()))
    assert inside[(0.5, 0.5)] and inside[(0.0, 5.0)] and not inside[(5.5, 5.5)] and not inside[(-0.5, 3.5)]


def test_time_zones():
    t = TemporalExtent("2024-01-01T12:00:00+02:00", "2024-01-02T12:00:00+02:00")
    assert t.tz_convert("UTC").start == dt.datetime(2024, 1, 1, 10)
    assert TemporalExtent("2024-01-01").tz == "UTC" and TemporalExtent("2024-01-01").start == TemporalExtent("2024-01-01").end
    with pytest.raises(errors.MixedTimeZonesError):
        TemporalExtent("2024-01-01T00:00:00+01:00", "2024-01-02T00:00:00+02:00")


def test_discretize(spark):
    t = TemporalExtent("2024-01-01", "2024-01-10")
    assert t.discretize(spark).count() == 2 and t.discretize(spark, "3D").count() == 4 and t.discretize(spark, "1 day").count() == 10


def test_recipes_are_json(spark, cube):
    recipe = QueryRecipe(a=ONE.filter_time("day", "greater", 1).reduce("count", "time"), b=q.result("a").evaluate("add", 1))
    again = QueryRecipe.from_json(recipe.to_json())
    assert again == json.loads(recipe.to_json()) and "concept" in recipe.tree()
    response = again.execute(cube, MAPPING, spark=spark)
    assert {k: v + 1 for k, v in rows(response["a"]).items()} == rows(response["b"])
    processor = QueryProcessor.parse(again, cube, MAPPING, spark=spark)
    assert processor.dry_run() == [("appearance", "kind")]


def test_custom_functions(spark, cube):
    x = run(spark, cube, VALUE.evaluate("half"), custom_operators={"half": lambda v: v / 2})
    assert rows(x)[(DAYS[1], 0.0, 0.0)] == 5
    x = run(spark, cube, VALUE.apply_custom("double"), custom_verbs={"double": lambda a: a.with_expr(a.expr * 2)})
    assert rows(x)[(DAYS[1], 0.0, 0.0)] == 20
    x = run(spark, cube, VALUE.evaluate("multiply", "x"), custom_operators={"multiply": lambda v, y: F.lit(1)})  # custom names come first
    assert set(rows(x).values()) == {1}


CASES = [
    (errors.UnknownLayerError, q.layer("no", "layer")),
    (errors.UnknownConceptError, q.entity("nothing")),
    (errors.UnknownConceptError, q.entity("one", property="nothing")),
    (errors.UnknownResultError, q.result("nothing")),
    (errors.RecursiveResultError, q.result("r").evaluate("add", 1)),
    (errors.UnknownOperatorError, VALUE.evaluate("nothing")),
    (errors.UnknownReducerError, VALUE.reduce("nothing")),
    (errors.UnknownReducerError, q.collection(ONE, ONE).merge("or")),
    (errors.UnknownVerbError, VALUE.apply_custom("nothing")),
    (errors.UnknownDimensionError, VALUE.reduce("mean", "z")),
    (errors.UnknownDimensionError, VALUE.reduce("mean", "time").extract("time")),
    (errors.UnknownComponentError, VALUE.extract("time", "nothing")),
    (errors.UnknownComponentError, VALUE.extract("space", "z")),
    (errors.UnknownLabelError, KIND.evaluate("equal", q.label("nothing"))),
    (errors.InvalidValueTypeError, KIND.evaluate("add", 1)),
    (errors.InvalidValueTypeError, VALUE.filter(VALUE)),
    (errors.InvalidValueTypeError, VALUE.delineate()),
    (errors.InvalidValueTypeError, q.collection(VALUE, ONE).merge("first")),
    (errors.InvalidValueTypeError, q.collection(VALUE, VALUE).compose()),
    (errors.AlignmentError, VALUE.reduce("mean", "time").evaluate("add", VALUE)),
    (errors.MissingDimensionError, VALUE.groupby(VALUE.reduce("mean"))),
    (errors.MissingDimensionError, q.collection(VALUE, VALUE.reduce("mean", "time")).concatenate("time")),
    (errors.MixedDimensionsError, VALUE.groupby(q.collection(q.self_().extract("time"), q.self_().extract("space", "x")))),
    (errors.ReservedDimensionError, q.collection(VALUE.reduce("mean", "time"), VALUE.reduce("max", "time")).concatenate("time")),
    (errors.MissingDimensionError, ONE.reduce("any", "y").delineate()),
    (errors.InvalidBuildingBlockError, {"type": "nothing"}),
    (errors.InvalidBuildingBlockError, {"type": "layer"}),
    (errors.InvalidBuildingBlockError, 5),
]


@pytest.mark.parametrize("error,block", CASES, ids=[f"{i}-{e.__name__}" for i, (e, _) in enumerate(CASES)])
def test_errors(spark, cube, error, block):
    with pytest.raises(error):
        run(spark, cube, block)


def test_more_errors(spark, cube):
    with pytest.raises(errors.InvalidIntervalError):
        q.interval(2, 1)
    with pytest.raises(ValueError):
        VALUE.filter_time("day")
    with pytest.raises(errors.EmptyDataError):
        checked = TableCube(cube.layout, cube.tables, check=True)
        run(spark, checked, VALUE, time=TemporalExtent("1990-01-01", "1990-01-02"))
    four = array(spark.createDataFrame([(1, 1, 1, 1, 1)], "a int, time int, y int, x int, v int"), ("a", "time", "y", "x"), vtype="binary")
    with pytest.raises(errors.TooManyDimensionsError):
        delineate(four)
    assert rows(run(spark, cube, KIND.evaluate("greater", 1), track_types=False))
