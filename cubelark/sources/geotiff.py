"""GeoTIFF files and archives of them, without a raster library.

Reads what most tools write: classic or big files, strips or tiles, plain or
compressed by deflate, LZW or PackBits, with or without a predictor, of integers
or floats; writes strips.  Archives are read file by file on the executors and
kept as long-form tables.
"""

from __future__ import annotations

import copy
import io
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..errors import EmptyDataError
from .base import Extent
from .table import TableCube

#: Fixed: TIFF tags and field types.
WIDTH, HEIGHT, BITS, COMPRESSION, OFFSETS, SAMPLES, ROWS, COUNTS, PLANAR, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, FORMAT = 322, 323, 324, 325, 339
SCALE, TIE, TRANSFORM, KEYS, NODATA = 33550, 33922, 34264, 34735, 42113
FIELD = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
#: Fixed: numbers of the compressions, and the codes of LZW that stand for no bytes.
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
CLEAR, END = 256, 257
GEOGRAPHIC_KEY, PROJECTED_KEY = 2048, 3072


def read_geotiff(data: bytes) -> dict:
    """bands (band, row, column), y and x of the cell centres, nodata, crs."""
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    tags = _tags(data, order)
    one = lambda tag, default=None: tags.get(tag, (default,))[0]
    width, height, samples = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    kind = {1: "u", 2: "i", 3: "f"}[one(FORMAT, 1)]
    dtype = np.dtype(f"{order}{kind}{one(BITS, 8) // 8}")
    compression, predictor, chunky = one(COMPRESSION, 1), one(PREDICTOR, 1), one(PLANAR, 1) == 1
    unpack = {PLAIN: bytes, LZW: unlzw, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress, PACKBITS: _unpackbits}.get(compression)
    if unpack is None:
        raise NotImplementedError(f"TIFF compression {compression}")
    tiled = TILE_OFFSETS in tags
    block_h, block_w = (one(TILE_HEIGHT), one(TILE_WIDTH)) if tiled else (min(one(ROWS, height), height), width)
    across, down = -(-width // block_w), -(-height // block_h)
    out = np.zeros((samples, height, width), dtype=dtype.newbyteorder("="))
    for n, (start, size) in enumerate(zip(tags[TILE_OFFSETS if tiled else OFFSETS], tags[TILE_COUNTS if tiled else COUNTS], strict=True)):
        raw = unpack(data[start : start + size])
        band, place = (0, n) if chunky else divmod(n, across * down)
        r, c = divmod(place, across)
        rows = block_h if tiled else min(block_h, height - r * block_h)
        depth = samples if chunky else 1
        block = _unpredicted(raw, dtype, predictor, rows, block_w, depth)
        h, w = min(rows, height - r * block_h), min(block_w, width - c * block_w)
        area = (slice(r * block_h, r * block_h + h), slice(c * block_w, c * block_w + w))
        for s in range(depth):
            out[(band + s, *area)] = block[:h, :w, s]
    if TRANSFORM in tags:
        m = tags[TRANSFORM]
        x0, dx, y0, dy = m[3], m[0], m[7], m[5]
    else:
        scale, tie = tags.get(SCALE, (1.0, 1.0, 0.0)), tags.get(TIE, (0.0,) * 6)
        x0, dx, y0, dy = tie[3] - tie[0] * scale[0], scale[0], tie[4] + tie[1] * scale[1], -scale[1]
    nodata = b"".join(tags[NODATA]).rstrip(b"\0").decode() if NODATA in tags else None
    keys = tags.get(KEYS, ())
    codes = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4)}
    code = codes.get(PROJECTED_KEY) or codes.get(GEOGRAPHIC_KEY)
    return {
        "bands": out,
        "y": y0 + (np.arange(height) + 0.5) * dy,
        "x": x0 + (np.arange(width) + 0.5) * dx,
        "nodata": float(nodata) if nodata else None,
        "crs": f"EPSG:{code}" if code else None,
    }


def _tags(data: bytes, order: str) -> dict[int, tuple]:
    magic = struct.unpack(order + "H", data[2:4])[0]
    if magic not in (42, 43):
        raise ValueError("not a TIFF file")
    # where the first directory's place stands, forms of a place and of the number of entries
    head, place, number = (4, "I", "H") if magic == 42 else (8, "Q", "Q")
    wide = struct.calcsize("<" + place)
    at = struct.unpack_from(order + place, data, head)[0]
    count = struct.unpack_from(order + number, data, at)[0]
    at += struct.calcsize("<" + number)
    tags = {}
    for entry in range(at, at + count * (4 + 2 * wide), 4 + 2 * wide):
        tag, kind, n = struct.unpack_from(order + "HH" + place, data, entry)
        if kind not in FIELD:
            continue
        form = order + FIELD[kind] * n
        here = entry + 4 + wide
        tags[tag] = struct.unpack_from(form, data, here if struct.calcsize(form) <= wide else struct.unpack_from(order + place, data, here)[0])
    return tags


def unlzw(data: bytes) -> bytes:
    """LZW as TIFF has it: codes from the high bits on, one code early wider."""
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    out, table, previous = bytearray(), list(base), None
    held = bits = 0
    width = 9
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & (1 << bits) - 1
        if code == END:
            break
        if code == CLEAR:
            table, previous, width = list(base), None, 9
            continue
        if previous is not None:
            table.append(previous + (table[code] if code < len(table) else previous)[:1])
            if len(table) >= (1 << width) - 1 and width < 12:
                width += 1
        previous = table[code]
        out += previous
    return bytes(out)


def lzw(data: bytes) -> bytes:
    """The same, packed."""
    out, table, found = bytearray(), {}, b""
    held = bits = 0
    width, following = 9, 258

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1

    code_of = lambda part: part[0] if len(part) == 1 else table[part]
    put(CLEAR)
    for i in range(len(data)):
        longer = found + data[i : i + 1]
        if len(longer) == 1 or longer in table:
            found = longer
            continue
        put(code_of(found))
        table[longer], found, following = following, data[i : i + 1], following + 1
        if following >= 1 << width and width < 12:
            width += 1
        if following == 4094:
            put(CLEAR)
            table, width, following = {}, 9, 258
    if found:
        put(code_of(found))
        width += following + 1 >= 1 << width and width < 12
    put(END)
    if bits:
        out.append(held << 8 - bits & 255)
    return bytes(out)


def _unpackbits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


def _unpredicted(raw: bytes, dtype: np.dtype, predictor: int, rows: int, width: int, depth: int) -> np.ndarray:
    if predictor == 3:  # bytes of the floats of a row, most significant first, as differences
        planes = np.frombuffer(raw, dtype=np.uint8).reshape(rows, -1)
        planes = np.cumsum(planes, axis=1, dtype=np.uint8) if depth == 1 else np.cumsum(planes.reshape(rows, -1, depth), axis=1, dtype=np.uint8).reshape(rows, -1)
        whole = planes.reshape(rows, dtype.itemsize, width * depth).transpose(0, 2, 1).copy()
        return whole.view(dtype.newbyteorder(">")).reshape(rows, width, depth)
    block = np.frombuffer(raw, dtype=dtype, count=rows * width * depth).reshape(rows, width, depth)
    return np.cumsum(block, axis=1, dtype=block.dtype) if predictor == 2 else block


def write_geotiff(path: str, bands: np.ndarray, ys: list[float], xs: list[float], crs: str | None = None, compress: bool | str = True, dtype: str = "float64") -> None:
    """Writes (band, row, column), one strip a band, tied to the cells' outer corner.

    Missing cells are NaN in a file of floats, else the least value of a signed type and the greatest of an unsigned one.
    """
    pack = {False: bytes, True: zlib.compress, "deflate": zlib.compress, "lzw": lzw}[compress if isinstance(compress, bool) else compress.lower()]
    code_of_pack = {bytes: PLAIN, zlib.compress: DEFLATE, lzw: LZW}[pack]
    kind = np.dtype(dtype).newbyteorder("<")
    nodata = float("nan") if kind.kind == "f" else np.iinfo(kind).max if kind.kind == "u" else np.iinfo(kind).min
    n, height, width = bands.shape
    dx = float(xs[1] - xs[0]) if width > 1 else 1.0
    dy = float(ys[1] - ys[0]) if height > 1 else -1.0
    if dy > 0:
        bands, ys, dy = bands[:, ::-1], ys[::-1], -dy
    strips = [pack(np.where(np.isnan(band), nodata, band).astype(kind).tobytes()) for band in bands]
    body, offsets = bytearray(), []
    for s in strips:
        offsets.append(8 + len(body))
        body += s + b"\0" * (len(s) % 2)
    code = int(str(crs).rpartition(":")[2]) if crs and str(crs).rpartition(":")[2].isdigit() else None
    fields: list[tuple[int, int, tuple]] = [
        (WIDTH, 4, (width,)), (HEIGHT, 4, (height,)), (BITS, 3, (8 * kind.itemsize,) * n), (COMPRESSION, 3, (code_of_pack,)), (262, 3, (1,)),
        (OFFSETS, 4, tuple(offsets)), (SAMPLES, 3, (n,)), (ROWS, 4, (height,)), (COUNTS, 4, tuple(map(len, strips))), (PLANAR, 3, (2,)), (FORMAT, 3, ({"u": 1, "i": 2, "f": 3}[kind.kind],) * n),
        (SCALE, 12, (abs(dx), abs(dy), 0.0)), (TIE, 12, (0.0, 0.0, 0.0, float(xs[0]) - dx / 2, float(ys[0]) - dy / 2, 0.0)),
    ]
    if code:
        projected = not 4000 <= code < 5000
        fields.append((KEYS, 3, (1, 1, 0, 2, 1024, 0, 1, 1 if projected else 2, PROJECTED_KEY if projected else GEOGRAPHIC_KEY, 0, 1, code)))
    text = (f"{nodata}" + "\0").encode()
    fields.append((NODATA, 2, tuple(bytes([b]) for b in text)))
    fields.sort()
    at = 8 + len(body)
    extra_at, extra, entries = at + 2 + 12 * len(fields) + 4, bytearray(), bytearray()
    for tag, form, values in fields:
        packed = struct.pack("<" + FIELD[form] * len(values), *values)
        if len(packed) <= 4:
            entries += struct.pack("<HHI", tag, form, len(values)) + packed.ljust(4, b"\0")
        else:
            entries += struct.pack("<HHII", tag, form, len(values), extra_at + len(extra))
            extra += packed + b"\0" * (len(packed) % 2)
    with open(path, "wb") as file:
        file.write(b"II*\0" + struct.pack("<I", at) + body + struct.pack("<H", len(fields)) + entries + struct.pack("<I", 0) + extra)


def tiff_cells(data: bytes, times: list | None = None) -> pd.DataFrame:
    """A file's cells in long form: time (or band), y, x, v; nodata cells are missing."""
    tiff = read_geotiff(data)
    bands, ys, xs = tiff["bands"], tiff["y"], tiff["x"]
    values = bands.astype(float)
    if tiff["nodata"] is not None and tiff["nodata"] == tiff["nodata"]:
        values[bands == tiff["nodata"]] = np.nan
    n = len(ys) * len(xs)
    first = list(times) if times is not None else list(range(len(bands)))
    return pd.DataFrame({
        "time": np.repeat(np.array(first, dtype="datetime64[us]" if times is not None else int), n),
        "y": np.tile(np.repeat(ys, len(xs)), len(bands)),
        "x": np.tile(np.tile(xs, len(ys)), len(bands)),
        "v": [None if v != v else v for v in values.ravel()],
    })


SCHEMA = "time timestamp_ntz, y double, x double, v double"


class GeotiffArchive(TableCube):
    """A zip archive of GeoTIFF files, one for each layer (`file` in the layout), bands being times.

    `times` gives a file's times; by default they are read from the layout entry's `times`.
    A file is unpacked by one task; layers are tables from then on, cut by the extent.
    """

    def __init__(self, layout: dict, src: str, times: Callable[[str], list] | None = None, **config):
        if not src.endswith(".zip"):
            raise ValueError("the source must be a .zip archive")
        super().__init__(copy.deepcopy(layout), descending=("y",), **config)
        self.src, self.times = src, times

    def table(self, spark: SparkSession, name: str, extent: Extent) -> DataFrame:
        src, times = self.src, self._times(name)

        def unpack(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in files:
                for content in batch["content"]:
                    with zipfile.ZipFile(io.BytesIO(content)) as archive:
                        yield tiff_cells(archive.read(name), times)

        found = spark.read.format("binaryFile").load(src).select("content")
        if found.isEmpty():
            raise EmptyDataError(f"there is no archive {src}")
        return found.mapInPandas(unpack, SCHEMA)

    def _native(self, spark: SparkSession, name: str) -> tuple[float, float, float, float]:
        """The file's own grid, read from it with its reference system by a small job."""
        if self.native is None:

            def steps(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for batch in files:
                    for content in batch["content"]:
                        with zipfile.ZipFile(io.BytesIO(content)) as archive:
                            tiff = read_geotiff(archive.read(name))
                        step = lambda v, one: float(v[1] - v[0]) if len(v) > 1 else one
                        yield pd.DataFrame([(tiff["y"][0], step(tiff["y"], -1.0), tiff["x"][0], step(tiff["x"], 1.0), tiff["crs"])], columns=["y0", "dy", "x0", "dx", "crs"])

            found = spark.read.format("binaryFile").load(self.src).select("content").mapInPandas(steps, "y0 double, dy double, x0 double, dx double, crs string").first()
            self.native, self.crs = tuple(found[:4]), self.crs or found[4]
        return self.native

    def _times(self, file: str) -> list:
        if self.times is not None:
            return self.times(file)
        for reference in self.layers():
            meta = self.lookup(*reference)
            if meta.get("file") == file and meta.get("times"):
                return [np.datetime64(t) for t in meta["times"]]
        raise EmptyDataError(f"no times are known for {file}")

    def retrieve(self, *reference: str, extent: Extent):
        meta = self.lookup(*reference)
        node = self.layout
        for part in reference:
            node = node[part]
        node.setdefault("table", meta["file"])
        node.setdefault("column", "v")
        return super().retrieve(*reference, extent=extent)
