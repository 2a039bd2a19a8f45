import zipfile

import numpy as np
import pytest

from cubelark.extent import SpatialExtent
from cubelark.functions import projection
from cubelark.model import array
from cubelark.operators import verbs
from cubelark.plans import blocks as q
from cubelark.plans.mapping import Ontology
from cubelark.plans.processor import QueryProcessor
from cubelark.sources import export
from cubelark.sources.geotiff import GeotiffArchive, read_geotiff, write_geotiff

#: Published examples: longitude, latitude, system, east, north, tolerance.
POINTS = [
    (5.0, 50.0, "EPSG:3035", 3962799.45, 2999718.85, 0.01),
    (10.0, 52.0, "EPSG:3035", 4321000.0, 3210000.0, 1e-6),
    (-100.33333333333333, 24.381786944444446, "EPSG:3857", -11169055.58, 2800000.0, 0.01),
    (-79.387139, 43.642567, "EPSG:32617", 630084.0, 4833438.0, 1.0),
]


@pytest.mark.parametrize("lon, lat, crs, east, north, off", POINTS)
def test_known_points(lon, lat, crs, east, north, off):
    x, y = projection.project_points([lon], [lat], "EPSG:4326", crs)
    assert x[0] == pytest.approx(east, abs=off) and y[0] == pytest.approx(north, abs=off)


def test_there_and_back():
    rng = np.random.default_rng(0)
    for crs, lons, lats in ((3035, (-9, 30), (36, 70)), (32633, (11, 19), (0, 80)), (32733, (11, 19), (-80, 0)), (25832, (5, 13), (40, 60)), (3857, (-180, 180), (-84, 84))):
        lon, lat = rng.uniform(*lons, 500), rng.uniform(*lats, 500)
        back = projection.project_points(*projection.project_points(lon, lat, 4326, crs), crs, 4326)
        assert np.abs(back[0] - lon).max() < 1e-9 and np.abs(back[1] - lat).max() < 1e-9
    with pytest.raises(NotImplementedError):
        projection.projection("EPSG:31287")


def test_columns_agree_with_arrays(spark):
    points = [(9.5 + i, 46.0 + 2 * i) for i in range(4)]
    frame = spark.createDataFrame([*points, (None, None)], "x double, y double").withColumn("value", projection.F.lit(1))
    for source, target in (("EPSG:4326", "EPSG:3035"), ("EPSG:4326", "EPSG:32632"), ("EPSG:4326", "EPSG:3857")):
        there = projection.project(frame, source, target)
        assert there.columns == ["x", "y", "value"]
        rows = [r for r in there.collect() if r.x is not None]
        xs, ys = projection.project_points(*zip(*points, strict=True), source, target)
        assert np.allclose([r.x for r in rows], xs, rtol=0, atol=1e-6) and np.allclose([r.y for r in rows], ys, rtol=0, atol=1e-6) and len(rows) == 4
        back = [r for r in projection.project(there, target, source).collect() if r.x is not None]
        assert np.allclose([(r.x, r.y) for r in back], points, rtol=0, atol=1e-9)


def test_footprint_in_degrees(spark, tmp_path):
    """A footprint in longitude and latitude, a query and layers on the European grid."""
    x0, y0 = 4_500_000.0, 2_700_000.0
    xs, ys = [x0 + 10 * i + 5 for i in range(20)], [y0 + 200 - 10 * i - 5 for i in range(20)]
    bands = np.arange(400, dtype=float).reshape(1, 20, 20)
    write_geotiff(str(tmp_path / "b.tif"), bands, ys, xs, crs="EPSG:3035")
    with zipfile.ZipFile(tmp_path / "layers.zip", "w") as archive:
        archive.write(tmp_path / "b.tif", "b.tif")
    layout = {"reflectance": {"band": {"type": "continuous", "file": "b.tif", "times": ["2024-01-01"]}}}
    corners = [(x0 + 40, y0 + 40), (x0 + 160, y0 + 40), (x0 + 160, y0 + 160), (x0 + 40, y0 + 160), (x0 + 40, y0 + 40)]
    lon, lat = projection.project_points(*zip(*corners, strict=True), "EPSG:3035", "EPSG:4326")
    space = SpatialExtent({"type": "Polygon", "coordinates": [list(zip(lon.tolist(), lat.tolist(), strict=True))]})
    assert space.crs == "EPSG:4326" and np.allclose(space.to_crs("EPSG:3035").bounds, (x0 + 40, y0 + 40, x0 + 160, y0 + 160), atol=1e-6)
    cube = lambda: GeotiffArchive(layout, str(tmp_path / "layers.zip"))
    run = lambda **c: QueryProcessor.parse({"r": q.reflectance("band").reduce("max", "time")}, cube(), Ontology(), space, spark=spark, **c).execute()["r"]
    got = {(r.y, r.x): r.v for r in run(crs="EPSG:3035", spatial_resolution=(-10, 10)).df.collect()}
    assert got == {(y, x): bands[0, i, j] for i, y in enumerate(ys) for j, x in enumerate(xs) if y0 + 40 < y < y0 + 160 and x0 + 40 < x < x0 + 160}
    # the query in another system than the layers: each cell takes the value of the layer's cell that it lies in
    warped = run(crs="EPSG:32633", spatial_resolution=(-10, 10))
    rows = warped.df.collect()
    sx, sy = projection.project_points([r.x for r in rows], [r.y for r in rows], "EPSG:32633", "EPSG:3035")
    assert len(rows) > 100 and warped.crs == "EPSG:32633"
    assert all(r.v == bands[0, int((y0 + 200 - b) // 10), int((a - x0) // 10)] for r, a, b in zip(rows, sx, sy, strict=True))


def test_reproject(spark, tmp_path):
    rows = [(100.0 * i + 2_700_050, 100.0 * j + 4_500_050, float(10 * i + j)) for i in range(10) for j in range(10) if (i, j) != (0, 0)]
    x = array(spark.createDataFrame(rows, "y double, x double, v double"), ("y", "x"), descending=("y",), crs="EPSG:3035", name="layer")
    assert verbs.reproject(x, "EPSG:3035").df.count() == 99
    for crs in ("EPSG:32633", "EPSG:4326", "EPSG:3857"):
        new = verbs.reproject(x, crs)
        cells = new.df.collect()
        sx, sy = projection.project_points([r.x for r in cells], [r.y for r in cells], crs, "EPSG:3035")
        known = {(round((a - 50) / 100), round((b - 50) / 100)): v for a, b, v in rows}
        assert 70 < len(cells) < 200 and new.crs == crs
        assert all(r.v == known[(int(b // 100), int(a // 100))] for r, a, b in zip(cells, sx, sy, strict=True))
        # no new cell that lies in an old one is left out
        grid = new.grid().collect()
        gx, gy = projection.project_points([r.x for r in grid], [r.y for r in grid], crs, "EPSG:3035")
        assert len(cells) == sum((int(b // 100), int(a // 100)) in known for a, b in zip(gx, gy, strict=True))
    export.to_geotiff(x, str(tmp_path / "x.tif"), compress="lzw", output_crs="EPSG:32633", dtype="int32")
    back = read_geotiff((tmp_path / "x.tif").read_bytes())
    assert back["crs"] == "EPSG:32633" and (back["bands"] != back["nodata"]).sum() == verbs.reproject(x, "EPSG:32633").df.count()
    points = export.to_geodataframe(x, "EPSG:4326", dense=False).collect()
    assert {r.crs for r in points} == {"EPSG:4326"} and points[0].geometry.startswith("POINT (12.")


def test_reproject_leaves_what_has_no_place(spark):
    x = array(spark.createDataFrame([(1, 2.0)], "time int, v double"), ("time",), crs="EPSG:3035")
    assert verbs.reproject(x, "EPSG:4326").df.collect() == x.df.collect()
    none = array(spark.createDataFrame([], "y double, x double, v double"), ("y", "x"), crs="EPSG:3035")
    assert verbs.reproject(none, "EPSG:4326").df.count() == 0
