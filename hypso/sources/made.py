"""Raster and polygon files made from tables: inputs for queries and tests."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

VOID = -32_768


def grid_from(pdf: pd.DataFrame, n: int) -> np.ndarray:
    grid = np.full((n, n), VOID, np.int64)
    known = pdf[pdf["z"].notna()]
    grid[known["i"], known["j"]] = known["z"].astype(int)
    return grid


def hgt_bytes(grid: np.ndarray) -> bytes:
    return grid.astype(">i2").tobytes()


def tiff_bytes(grid: np.ndarray, corner: tuple[float, float], step: tuple[float, float], epsg: int = 4326, code: str = "i2", deflate: bool = True, predict: bool = False, rows: int = 16, order: str = "<") -> bytes:
    """A GeoTIFF of one band in strips; corner: of the first pixel; step: pixel size, both positive."""
    dtype = np.dtype(order + code)
    strips = []
    for low in range(0, len(grid), rows):
        part = grid[low : low + rows].astype(dtype)
        if predict:
            part = np.concatenate([part[:, :1], np.diff(part, axis=1)], axis=1).astype(dtype)
        strips.append(zlib.compress(part.tobytes()) if deflate else part.tobytes())
    keys = (1, 1, 0, 2, 1024, 0, 1, 2 if epsg == 4326 else 1, 2048 if epsg == 4326 else 3072, 0, 1, epsg)
    entries = [
        (256, "I", (grid.shape[1],)), (257, "I", (grid.shape[0],)), (258, "H", (dtype.itemsize * 8,)), (259, "H", (8 if deflate else 1,)), (273, "I", (0,) * len(strips)),
        (277, "H", (1,)), (278, "I", (rows,)), (279, "I", tuple(map(len, strips))), (317, "H", (2 if predict else 1,)), (339, "H", ({"u": 1, "i": 2, "f": 3}[code[0]],)),
        (33550, "d", (*step, 0.0)), (33922, "d", (0.0, 0.0, 0.0, *corner, 0.0)), (34735, "H", keys),
    ]
    at = 8 + 2 + 12 * len(entries) + 4
    places, extra = {}, b""
    for tag, kind, values in entries:
        if struct.calcsize(order + kind * len(values)) > 4:
            places[tag] = at + len(extra)
            extra += struct.pack(order + kind * len(values), *values)
    first = at + len(extra)
    starts = [first + sum(map(len, strips[:k])) for k in range(len(strips))]
    out = (b"II" if order == "<" else b"MM") + struct.pack(order + "HIH", 42, 8, len(entries))
    for tag, kind, values in entries:
        if tag == 273:
            values = tuple(starts)
            if tag in places:
                low = places[tag] - at
                extra = extra[:low] + struct.pack(order + "I" * len(values), *values) + extra[low + 4 * len(values) :]
        number = {"H": 3, "I": 4, "d": 12}[kind]
        own = struct.pack(order + "I", places[tag]) if tag in places else struct.pack(order + kind * len(values), *values).ljust(4, b"\0")
        out += struct.pack(order + "HHI", tag, number, len(values)) + own
    return out + struct.pack(order + "I", 0) + extra + b"".join(strips)


def zip_bytes(members: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in members.items():
            z.writestr(name, content)
    return out.getvalue()


def files_of(dem: DataFrame, n: int, kind: str) -> DataFrame:
    """path and content: a file for each cell of the long form; kind: hgt, tif, mercator or zip."""
    import math

    from ..functions.scalars import EARTH

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cell, grid = pdf["cell"].iloc[0], grid_from(pdf, n)
        lat, lon = int(cell[1:3]), int(cell[4:])
        if kind == "hgt":
            content = hgt_bytes(grid)
        elif kind == "zip":
            content = zip_bytes({f"deep/{cell}.HGT": hgt_bytes(grid), "readme.txt": b"no raster"})
        elif kind == "tif":
            step = 1 / (n - 1)
            content = tiff_bytes(grid, (lon - step / 2, lat + 1 + step / 2), (step, step), predict=True)
        else:
            x, y = (lambda o: o * math.pi / 180 * EARTH), (lambda a: math.log(math.tan(math.pi / 4 + a * math.pi / 360)) * EARTH)
            dx, dy = (x(lon + 1) - x(lon)) / (n - 1), (y(lat + 1) - y(lat)) / (n - 1)
            content = tiff_bytes(grid, (x(lon) - dx / 2, y(lat + 1) + dy / 2), (dx, dy), epsg=3857, deflate=False)
        return pd.DataFrame({"path": [f"{cell}.{'tif' if kind == 'mercator' else kind}"], "content": [content]})

    return dem.groupBy("cell").applyInPandas(run, "path string, content binary")
