import datetime as dt
import struct
import zipfile

import numpy as np
import pytest

from cubelark.extent import SpatialExtent, TemporalExtent
from cubelark.model import array
from cubelark.plans import blocks as q
from cubelark.plans.mapping import Ontology
from cubelark.plans.processor import QueryProcessor
from cubelark.sources import export
from cubelark.sources.geotiff import GeotiffArchive, lzw, read_geotiff, unlzw, write_geotiff
from cubelark.sources.stac import ItemCube
from cubelark.streaming.ingest import ingest, layer_table


def test_geotiff_round_trip(tmp_path):
    bands = np.arange(24, dtype=float).reshape(2, 3, 4)
    bands[0, 0, 0] = np.nan
    for compress in (True, False):
        write_geotiff(str(tmp_path / "a.tif"), bands, [20.0, 10.0, 0.0], [5.0, 15.0, 25.0, 35.0], crs="EPSG:3035", compress=compress)
        back = read_geotiff((tmp_path / "a.tif").read_bytes())
        assert np.array_equal(back["bands"], bands, equal_nan=True)
        assert back["y"].tolist() == [20, 10, 0] and back["x"].tolist() == [5, 15, 25, 35] and back["crs"] == "EPSG:3035"


def test_geotiff_forms(tmp_path):
    # codes 256 7 258 8 8 258 6 6 257 in nine bits each
    packed = int("".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 258, 6, 6, 257)).ljust(88, "0"), 2).to_bytes(11, "big")
    assert unlzw(packed) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6]) and lzw(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == packed
    rng = np.random.default_rng(0)
    for n in (0, 1, 254, 255, 256, 765, 3836, 3837, 3838, 3839, 50_000):
        for high in (2, 256):
            data = rng.integers(0, high, n, dtype=np.uint8).tobytes()
            assert unlzw(lzw(data)) == data
    bands = rng.integers(0, 200, (2, 30, 40)).astype(float)
    bands[1, 2, 3] = np.nan
    for compress in ("lzw", "deflate", False):
        for dtype, missing in (("uint8", 255), ("int16", -32768), ("float32", None)):
            write_geotiff(str(tmp_path / "a.tif"), bands, list(range(30, 0, -1)), list(range(40)), compress=compress, dtype=dtype)
            back = read_geotiff((tmp_path / "a.tif").read_bytes())
            expected = bands if missing is None else np.where(np.isnan(bands), missing, bands)
            assert back["bands"].dtype == dtype and np.array_equal(back["bands"], expected, equal_nan=True)
            assert missing is None or back["nodata"] == missing


def test_big_geotiff():
    values = np.arange(6, dtype="<u2").tobytes()
    strip = bytes([3, *values[:4], 1, *values[4:6], 128, 5, *values[6:12]])  # literal runs and one code without a meaning
    entries = [(256, 3, (3,)), (257, 3, (2,)), (258, 3, (16,)), (259, 3, (32773,)), (273, 16, (16,)), (277, 3, (1,)), (278, 3, (2,)), (279, 16, (len(strip),))]
    forms = {3: "H", 16: "Q"}
    directory = struct.pack("<Q", len(entries)) + b"".join(struct.pack("<HHQ", t, k, len(v)) + struct.pack("<" + forms[k] * len(v), *v).ljust(8, b"\0") for t, k, v in entries) + struct.pack("<Q", 0)
    file = b"II+\0" + struct.pack("<HHQ", 8, 0, 16 + len(strip)) + strip + directory
    assert read_geotiff(file)["bands"].tolist() == [[[0, 1, 2], [3, 4, 5]]]


def test_archive(spark, tmp_path):
    bands = np.arange(24, dtype=float).reshape(2, 3, 4)
    write_geotiff(str(tmp_path / "b.tif"), bands, [20.0, 10.0, 0.0], [5.0, 15.0, 25.0, 35.0])
    with zipfile.ZipFile(tmp_path / "layers.zip", "w") as archive:
        archive.write(tmp_path / "b.tif", "b.tif")
    layout = {"reflectance": {"band": {"type": "continuous", "file": "b.tif", "times": ["2024-01-01", "2024-02-01"]}}}
    cube = GeotiffArchive(layout, str(tmp_path / "layers.zip"))
    x = QueryProcessor.parse({"r": q.reflectance("band").reduce("max", "space")}, cube, Ontology(), spark=spark, time=TemporalExtent("2024-01-15", "2024-03-01")).execute()["r"]
    assert [tuple(r) for r in x.df.collect()] == [(dt.datetime(2024, 2, 1), 23.0)]
    y = QueryProcessor.parse({"r": q.reflectance("band").reduce("first", "space")}, cube, Ontology(), spark=spark).execute()["r"]
    assert [r.v for r in y.df.orderBy("time").collect()] == [0, 12]  # y falls along the index
    assert "table" not in layout["reflectance"]["band"]
    with pytest.raises(ValueError):
        GeotiffArchive(layout, "layers.tar")


def _cubic(t):
    return 1.5 * t**3 - 2.5 * t**2 + 1 if t <= 1 else -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2 if t < 2 else 0.0


def _spline(t):
    return sum((-1) ** k * n * max(0.0, 2 - t - k) ** 3 for k, n in enumerate((1, 4, 6, 4, 1))) / 6


KERNEL = {"bilinear": (lambda t: max(0.0, 1 - t), 1), "cubic": (_cubic, 2), "cubic_spline": (_spline, 2), "lanczos": (lambda t: float(np.sinc(t) * np.sinc(t / 3)) if t < 3 else 0.0, 3)}


def test_resampling(spark, tmp_path):
    bands = np.arange(16, dtype=float).reshape(1, 4, 4)
    write_geotiff(str(tmp_path / "b.tif"), bands, [3.5, 2.5, 1.5, 0.5], [0.5, 1.5, 2.5, 3.5])
    with zipfile.ZipFile(tmp_path / "layers.zip", "w") as archive:
        archive.write(tmp_path / "b.tif", "b.tif")
    layout = {"reflectance": {"band": {"type": "continuous", "file": "b.tif", "times": ["2024-01-01"]}}}
    space = SpatialExtent({"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]]}, crs="EPSG:3035")

    def run(method, step):
        cube = GeotiffArchive(layout, str(tmp_path / "layers.zip"), resamplers={"continuous": method})
        x = QueryProcessor.parse({"r": q.reflectance("band").reduce("max", "time")}, cube, Ontology(), space, spark=spark, spatial_resolution=(-step, step)).execute()["r"]
        return {(r.y, r.x): r.v for r in x.df.collect()}

    assert run("nearest", 1) == {(3.5 - i, 0.5 + j): bands[0, i, j] for i in range(4) for j in range(4)}
    assert run("average", 2) == {(3.0, 1.0): 2.5, (3.0, 3.0): 4.5, (1.0, 1.0): 10.5, (1.0, 3.0): 12.5}
    assert run("max", 2)[(1.0, 3.0)] == 15
    # halfway between four cells, and on a cell of its own size
    assert run("bilinear", 1) == run("nearest", 1) and run("cubic", 1) == run("nearest", 1)
    for method in ("bilinear", "cubic", "cubic_spline", "lanczos"):
        half = run(method, 0.5)
        kernel, reach = KERNEL[method]
        for (y, x), v in half.items():
            u, w = (y - 3.5) / -1, (x - 0.5) / 1
            near = [(kernel(abs(i - u)) * kernel(abs(j - w)), bands[0, i, j]) for i in range(4) for j in range(4) if abs(i - u) <= reach and abs(j - w) <= reach]
            assert v == pytest.approx(sum(k * b for k, b in near) / sum(k for k, _ in near)), (method, y, x)
        assert len(half) == 64
    assert run("bilinear", 2)[(3.0, 1.0)] == pytest.approx(np.average(bands[0, :3, :3], weights=np.outer([0.75, 0.75, 0.25], [0.75, 0.75, 0.25])))
    with pytest.raises(NotImplementedError):
        run("gauss", 2)
    with pytest.raises(ValueError):
        GeotiffArchive(layout, "a.zip", resamplers={"continuous": "nothing"})


def test_items(spark, tmp_path):
    items = []
    for i, (at, box) in enumerate([("2024-01-01T08:00:00Z", 0), ("2024-01-01T10:00:00Z", 0), ("2024-01-02T08:00:00Z", 0), ("2024-01-03T08:00:00Z", 900)]):
        path = str(tmp_path / f"{i}.tif")
        bands = np.full((1, 2, 2), float(i))
        if i == 0:
            bands[0, 0, 0] = np.nan
        write_geotiff(path, bands, [box + 1.0, box + 0.0], [box + 0.0, box + 1.0])
        items.append({"properties": {"datetime": at}, "bbox": [box - 0.5, box - 0.5, box + 1.5, box + 1.5], "assets": {"b": {"href": path}}})
    layout = {"reflectance": {"b": {"type": "continuous", "name": "b"}}}
    space = SpatialExtent({"type": "Polygon", "coordinates": [[[-1, -1], [2, -1], [2, 2], [-1, 2], [-1, -1]]]})
    run = lambda **c: QueryProcessor.parse({"r": q.reflectance("b")}, ItemCube(layout, items, **c), Ontology(), space, spark=spark).execute()["r"]
    assert run().df.count() == 12
    got = {(r.time.day, r.y, r.x): r.v for r in run(group_by_solar_day=True).df.collect()}
    assert got[(1, 1.0, 0.0)] == 1 and got[(1, 0.0, 0.0)] == 0 and got[(2, 0.0, 0.0)] == 2 and len(got) == 8


def test_sinks(spark, tmp_path):
    frame = spark.createDataFrame([(1, 0, float("inf")), (1, 1, 2.0), (0, 0, 3.0)], "y int, x int, v double")
    x = array(frame, ("y", "x"), descending=("y",), name="layer")
    assert export.to_dataframe(x).count() == 4 and export.to_dataframe(x).columns == ["y", "x", "layer"]
    assert {r.geometry for r in export.to_geodataframe(x).collect()} == {"POINT (0 1)", "POINT (1 1)", "POINT (0 0)", "POINT (1 0)"}
    export.to_csv(x, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 4
    export.to_parquet(x, str(tmp_path / "pq"))
    assert spark.read.parquet(str(tmp_path / "pq")).count() == 3
    export.to_geotiff(x, str(tmp_path / "x.tif"))
    assert np.array_equal(read_geotiff((tmp_path / "x.tif").read_bytes())["bands"][0], [[np.nan, 2], [3, np.nan]], equal_nan=True)
    row = frame.select(export.inf_as_null(frame.v).alias("a"), export.null_as_zero(export.inf_as_null(frame.v)).alias("b")).first()
    assert row.a is None and row.b == 0


def test_streaming_ingest(spark, tmp_path):
    def arrive(n, value):
        spark.createDataFrame([(dt.datetime(2024, 1, 1), 0, n, value)], "time timestamp_ntz, y int, x int, v double").write.parquet(str(tmp_path / "in" / str(n)))

    arrive(0, 1.0)
    arrive(1, 2.0)
    stream = spark.readStream.schema("time timestamp_ntz, y int, x int, v double").parquet(str(tmp_path / "in" / "*"))
    ingest(stream, lambda batch: batch, str(tmp_path / "layer"), str(tmp_path / "state")).awaitTermination(60)
    assert {(r.x, r.v) for r in layer_table(spark, str(tmp_path / "layer")).collect()} == {(0, 1.0), (1, 2.0)}
