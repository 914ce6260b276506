"""Raster files to bands of rows: .hgt grids, baseline GeoTIFF, zip archives.

Files are read by Spark's binary source, so any store that Spark reads will do; a file is decoded
once, by the task that read it, and given on band by band.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import FOOT
from ..operators.bands import cut, unpacked
from ..operators.raster import super_sample

EXTENSIONS = ("hgt", "tif", "tiff")


class RasterError(ValueError):
    """A file that can't be taken for a raster."""


def binary(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)


def hgt_grid(content: bytes) -> np.ndarray:
    """A square of big-endian 16-bit samples, north first."""
    side = round((len(content) // 2) ** 0.5)
    if side * side * 2 != len(content) or side < 2:
        raise RasterError(f"{len(content)} bytes are no square grid of 16-bit samples")
    return np.frombuffer(content, ">i2").reshape(side, side)


# Fixed values of the TIFF format: tags, and the size and struct code of field types.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, BANDS, ROWS_PER_STRIP, STRIP_BYTES, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, FORMAT = 256, 257, 258, 259, 273, 277, 278, 279, 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, MATRIX, GEO_KEYS = 33550, 33922, 34264, 34735
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
GEOGRAPHIC, PROJECTED, WEB_MERCATOR, WGS84 = 2048, 3072, 3857, 4326


@dataclass
class Place:
    """Size of a raster, its projection, and where its samples' centres lie in it."""

    rows: int
    cols: int
    epsg: int
    origin: tuple[float, float]  # of the first sample
    step: tuple[float, float]

    def box(self) -> tuple[float, float, float, float]:
        """Centres of the outermost samples."""
        (x, y), (dx, dy) = self.origin, self.step
        return x, y + (self.rows - 1) * dy, x + (self.cols - 1) * dx, y


def _tags(data: bytes) -> tuple[dict[int, tuple], str]:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise RasterError("no TIFF file")
    at = struct.unpack(order + "I", data[4:8])[0]
    out = {}
    for k in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        tag, kind, n, _ = struct.unpack(order + "HHII", data[at + 2 + 12 * k : at + 14 + 12 * k])
        if kind not in TYPES:
            continue
        code = order + (f"{n}s" if TYPES[kind] == "s" else TYPES[kind] * n)
        size = struct.calcsize(code)
        place = at + 10 + 12 * k if size <= 4 else struct.unpack(order + "I", data[at + 10 + 12 * k : at + 14 + 12 * k])[0]
        out[tag] = struct.unpack(code, data[place : place + size])
    return out, order


def _unpackbits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            out += data[at + 1 : at + 2] * (257 - n if n > 128 else 0)
            at += 2 if n > 128 else 1
    return bytes(out)


def unlzw(data: bytes) -> bytes:
    """LZW as in TIFF: codes of 9 to 12 bits, high bits first; 256 starts anew, 257 ends; codes grow
    by a bit when all but one of a width are taken."""
    out, table, width, held, bits = bytearray(), [], 9, 0, 0
    last = b""
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes((k,)) for k in range(256)] + [b"", b""], 9, b""
            continue
        if code < len(table):
            word = table[code]
        elif last and code == len(table):
            word = last + last[:1]
        else:
            raise RasterError("a bad code in LZW data")
        out += word
        if last:
            table.append(last + word[:1])
        last = word
        width = min(12, max(9, (len(table) + 1).bit_length()))
    return bytes(out)


def tiff_grid(data: bytes) -> np.ndarray:
    """Band 1 of a TIFF: strips or tiles; plain, LZW, deflate or PackBits; with or without
    horizontal differencing."""
    tags, order = _tags(data)
    one = lambda tag, default=None: tags.get(tag, (default,))[0]
    cols, rows, bits, bands = one(WIDTH), one(HEIGHT), one(BITS, 1), one(BANDS, 1)
    kind = {1: "u", 2: "i", 3: "f"}.get(one(FORMAT, 1))
    if kind is None or bits not in (8, 16, 32, 64) or (kind == "f" and bits < 32):
        raise RasterError(f"samples of {bits} bits in format {one(FORMAT, 1)} can't be read")
    dtype = np.dtype(f"{order}{kind}{bits // 8}")
    unpack = {1: bytes, 8: zlib.decompress, 32946: zlib.decompress, 32773: _unpackbits, 5: unlzw}.get(one(COMPRESSION, 1))
    if unpack is None or one(PREDICTOR, 1) not in (1, 2):
        raise RasterError(f"compression {one(COMPRESSION)} with predictor {one(PREDICTOR, 1)} can't be read")
    wide, high, places, sizes = (one(TILE_WIDTH), one(TILE_HEIGHT), tags[TILES], tags[TILE_BYTES]) if TILES in tags else (cols, min(one(ROWS_PER_STRIP, rows), rows), tags[STRIPS], tags.get(STRIP_BYTES, (len(data),)))
    grid = np.empty((rows, cols), dtype.newbyteorder("="))
    across = -(-cols // wide)
    for k, (at, size) in enumerate(zip(places, sizes, strict=True)):
        top, left = k // across * high, k % across * wide
        if top >= rows:
            break
        raw = np.frombuffer(unpack(data[at : at + size]), dtype)
        part = raw[: len(raw) // (wide * bands) * wide * bands].reshape(-1, wide, bands)[:high, :, 0]
        if one(PREDICTOR, 1) == 2:
            part = part.cumsum(axis=1, dtype=dtype.newbyteorder("="))
        grid[top : top + high, left : left + wide] = part[: rows - top, : cols - left]
    return grid


def tiff_place(data: bytes) -> Place:
    """Where a GeoTIFF lies, by its tags alone. Rotated rasters are refused."""
    tags, _ = _tags(data)
    if MATRIX in tags:
        m = tags[MATRIX]
        if m[1] or m[4]:
            raise RasterError("rotated rasters can't be read")
        corner, step = (m[3], m[7]), (m[0], m[5])
    elif PIXEL_SCALE in tags:
        i, j, _, x, y, _ = tags[TIE_POINT][:6]
        step = (tags[PIXEL_SCALE][0], -tags[PIXEL_SCALE][1])
        corner = (x - i * step[0], y - j * step[1])
    else:
        raise RasterError("the file doesn't say where it lies")
    keys = tags.get(GEO_KEYS, ())
    named = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4)}
    epsg = named.get(PROJECTED) or named.get(GEOGRAPHIC) or WGS84
    return Place(tags[HEIGHT][0], tags[WIDTH][0], epsg, (corner[0] + step[0] / 2, corner[1] + step[1] / 2), step)


def grid_of(path: str, content: bytes) -> np.ndarray:
    extension = path.rsplit(".", 1)[-1].lower()
    if extension == "hgt":
        return hgt_grid(content)
    if extension in ("tif", "tiff"):
        return tiff_grid(content)
    raise RasterError(f"unknown extension {extension!r}")


def zoomed(n: int, zoom: float) -> int:
    return n if zoom == 1 else round(n * zoom)


def place_of(path: str, content: bytes, corrx: float = 0.0, corry: float = 0.0, zoom: float = 1.0) -> Place:
    """Where a file's samples lie once zoomed; corrx and corry are added to positions in degrees."""
    if path.lower().endswith(".hgt"):
        lon, lat = cell_of(path)
        n = zoomed(hgt_grid(content).shape[0], zoom)
        return Place(n, n, WGS84, (lon + corrx, lat + 1 + corry), (1 / (n - 1), -1 / (n - 1)))
    found = tiff_place(content)
    x0, y1, x1, y0 = found.box()
    rows, cols = zoomed(found.rows, zoom), zoomed(found.cols, zoom)
    if found.epsg == WGS84:
        x0, x1, y0, y1 = x0 + corrx, x1 + corrx, y0 + corry, y1 + corry
    return Place(rows, cols, found.epsg, (x0, y0), ((x1 - x0) / max(1, cols - 1), (y1 - y0) / max(1, rows - 1)))


def heights(path: str, content: bytes, void_max: int, zoom: float, feet: bool) -> np.ndarray:
    """A file's samples, NaN for void. Samples at or under void_max are void before smoothing; then, if
    asked for, a cubic zoom and feet."""
    grid = grid_of(path, content).astype(np.float64)
    void = grid <= void_max
    if zoom != 1:
        grid, void = super_sample(grid, void, zoom)
    return np.where(void, np.nan, grid * FOOT if feet else grid)


BANDS = "path string, n_rows long, n_cols long, epsg long, x0 double, y0 double, dx double, dy double, own long, top long, z binary"


def bands(files: DataFrame, void_max: int = -32_768, zoom: float = 1.0, feet: bool = False, corrx: float = 0.0, corry: float = 0.0) -> DataFrame:
    """Bands of rows (see operators.bands) of files (path, content), each with its file's header."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                data = bytes(content)
                at = place_of(path, data, corrx, corry, zoom)
                for own, top, part in cut(heights(path, data, void_max, zoom, feet)):
                    row = (path, at.rows, at.cols, at.epsg, *at.origin, *at.step, own, top, part.tobytes())
                    yield pd.DataFrame([row], columns=[f.split()[0] for f in BANDS.split(", ")])

    return files.select("path", "content").mapInPandas(run, BANDS)


def samples(files: DataFrame, void_max: int = -32_768, zoom: float = 1.0, feet: bool = False) -> DataFrame:
    """Long rows (path, i, j, z) of files (path, content)."""
    own = bands(files, void_max, zoom, feet).select(F.col("path").alias("cell"), F.lit(0).cast("long").alias("file_seq"), "own", "top", "n_cols", "z")
    return unpacked(own).select(F.col("cell").alias("path"), "i", "j", "z")


HEADER = "path string, n_rows long, n_cols long, epsg long, x0 double, y0 double, dx double, dy double"


def headers(files: DataFrame, corrx: float = 0.0, corry: float = 0.0, zoom: float = 1.0) -> DataFrame:
    """A row for each file: size, projection, centre of the first sample, increments (dy < 0). No sample is decoded."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                at = place_of(path, bytes(content), corrx, corry, zoom)
                out.append((path, at.rows, at.cols, at.epsg, *at.origin, *at.step))
            yield pd.DataFrame(out, columns=[f.split()[0] for f in HEADER.split(", ")])

    return files.select("path", "content").mapInPandas(run, HEADER)


def cell_of(path: str) -> tuple[int, int]:
    """Longitude and latitude of the lower left corner by a file's name."""
    m = re.match(r"([NS])(\d\d)([EW])(\d\d\d)", path.rsplit("/", 1)[-1].upper())
    if not m:
        raise RasterError(f"no cell in file name {path.rsplit('/', 1)[-1]}")
    return (-1 if m[3] == "W" else 1) * int(m[4]), (-1 if m[1] == "S" else 1) * int(m[2])


def zip_members(archives: DataFrame, pattern: str = r"\.hgt$") -> DataFrame:
    """path (archive/name, without folders) and content of the members whose name matches, in any case."""
    wanted = re.compile(pattern, re.IGNORECASE)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                    for name in z.namelist():
                        if wanted.search(name):
                            yield pd.DataFrame({"path": [f"{path}/{name.rsplit('/', 1)[-1]}"], "content": [z.read(name)]})

    return archives.select("path", "content").mapInPandas(run, "path string, content binary")


def polygons(lines: DataFrame) -> DataFrame:
    """file, ring, seq, x, y of polygon files as lines (file, no, line): `end` closes a ring, two
    numbers are a vertex, other lines and bad numbers are passed over."""
    from pyspark.sql import Window

    text = F.lower(F.trim("line"))
    w = Window.partitionBy("file").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    parts = F.split(text, r"\s+")
    placed = lines.select("file", "no", parts.alias("p"), F.sum((text == "end").cast("long")).over(w).alias("ring")).where("size(p) = 2")
    points = placed.select("file", "ring", "no", F.col("p")[0].try_cast("double").alias("x"), F.col("p")[1].try_cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    return points.select("file", "ring", F.row_number().over(Window.partitionBy("file", "ring").orderBy("no")).cast("long").alias("seq"), "x", "y")


def extent(rings: DataFrame) -> DataFrame:
    """The area "left:bottom:right:top" of each file's rings."""
    from ..functions.scalars import fixed

    box = rings.groupBy("file").agg(F.min("x").alias("l"), F.min("y").alias("b"), F.max("x").alias("r"), F.max("y").alias("t"))
    return box.select("file", F.concat_ws(":", *[fixed(F.col(c), 7) for c in ("l", "b", "r", "t")]).alias("area"))


def kml_rings(documents: DataFrame) -> DataFrame:
    """ring, seq, x, y of every <coordinates> of every Polygon in documents (kml)."""
    texts = documents.select(F.posexplode(F.expr("xpath(kml, '//Polygon//coordinates/text()')")).alias("ring", "c"))
    points = texts.select(F.col("ring").cast("long").alias("ring"), F.posexplode(F.split(F.trim(F.regexp_replace("c", r"\s+", " ")), " ")).alias("seq", "p"))
    part = lambda k: F.split("p", ",")[k].cast("double")
    return points.where("p <> ''").select("ring", F.col("seq").cast("long").alias("seq"), part(0).alias("x"), part(1).alias("y"))
