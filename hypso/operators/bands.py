"""Rasters as bands of rows: the form in which contours are made.

A band is a row (cell, file_seq, own, top, n_cols, z): z has the samples as doubles, row by row,
NaN for void, of the raster rows from `top` on; the band's own rows start at `own`, the row above
them (top = own - 1) is the border with the band before. So every step between samples and
every square of four is within one band: what needs neighbours needs no shuffle, a sample costs
eight bytes, and a task holds one band at a time however large a raster is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BAND = 64
SCHEMA = "cell string, file_seq long, own long, top long, n_cols long, z binary"
COSTS = "cell string, file_seq long, i long, n long, dx double, dy double, low double, high double"
SEGMENTS = "cell string, file_seq long, tile_seq long, level long, i long, j long, seg long, k1 long, x1 double, y1 double, k2 long, x2 double, y2 double"
#: Edges of a square as in its segments' ends; the diagonal is a triangle's.
N, W, S, E, D = range(5)


def cut(grid: np.ndarray, rows: int = BAND) -> Iterator[tuple[int, int, np.ndarray]]:
    """own, top and samples of each band of a grid."""
    for own in range(0, len(grid), rows):
        top = max(own - 1, 0)
        yield own, top, grid[top : own + rows]


def grid_of(z: bytes, n_cols: int) -> np.ndarray:
    return np.frombuffer(z, np.float64).reshape(-1, n_cols)


def owners(i: Column, rows: int = BAND) -> Column:
    """The bands (by their first own row) that a raster row is in: its own and, if it is the border, the next."""
    own = F.floor(i / rows) * rows
    return F.when(i % rows == rows - 1, F.array(own, own + rows)).otherwise(F.array(own))


def packed(dem: DataFrame, n: int, rows: int = BAND) -> DataFrame:
    """Bands from the long form (cell, file_seq, i, j, z) of n columns; what is missing is void."""
    sent = dem.withColumn("own", F.explode(owners(F.col("i"), rows)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = int(pdf["own"].iloc[0])
        top, last = max(own - 1, 0), int(pdf["i"].max())
        if last < own:  # only the row above is there
            return pd.DataFrame(columns=["cell", "file_seq", "own", "top", "n_cols", "z"])
        grid = np.full((last - top + 1, n), np.nan)
        grid[pdf["i"].to_numpy() - top, pdf["j"].to_numpy()] = pdf["z"].to_numpy(np.float64, na_value=np.nan)
        return pd.DataFrame({"cell": [pdf["cell"].iloc[0]], "file_seq": [pdf["file_seq"].iloc[0]], "own": [own], "top": [top], "n_cols": [n], "z": [grid.tobytes()]})

    return sent.select("cell", "file_seq", "own", "i", "j", "z").groupBy("cell", "own").applyInPandas(run, SCHEMA)


def bounded(pdf: pd.DataFrame) -> Iterator[tuple[pd.Series, np.ndarray]]:
    """Each band with its samples; where the rows say i0, i1, j0, j1, the samples beyond are void."""
    for r in pdf.itertuples(index=False):
        grid = grid_of(r.z, r.n_cols)
        if hasattr(r, "i0"):
            grid = grid.copy()
            grid[: max(0, r.i0 - r.top)] = np.nan
            grid[max(0, r.i1 + 1 - r.top) :] = np.nan
            grid[:, : r.j0] = np.nan
            grid[:, r.j1 + 1 :] = np.nan
        yield r, grid


def unpacked(bands: DataFrame) -> DataFrame:
    """The long form of the own rows, voids as nulls."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r, grid in bounded(pdf):
                part = grid[r.own - r.top :]
                i, j = np.indices(part.shape)
                z = part.ravel()
                yield pd.DataFrame({"cell": r.cell, "file_seq": r.file_seq, "i": i.ravel() + r.own, "j": j.ravel(), "z": pd.arrays.FloatingArray(np.nan_to_num(z), np.isnan(z))})

    return bands.mapInPandas(run, "cell string, file_seq long, i long, j long, z double")


def costs(bands: DataFrame) -> DataFrame:
    """For each raster row: samples, absolute steps along it and to the row above, least and greatest
    sample. A step from or to a void doesn't count. Rows outside of bounds (i0, i1) have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r, grid in bounded(pdf):
                skip = r.own - r.top
                own = grid[skip:]
                down = np.abs(np.diff(grid, axis=0))
                down = down if skip else np.vstack([np.full((1, grid.shape[1]), np.nan), down])
                void = np.isnan(own)
                out = {"cell": r.cell, "file_seq": r.file_seq, "i": np.arange(r.own, r.own + len(own)), "n": (~void).sum(1), "dx": np.nansum(np.abs(np.diff(own, axis=1)), 1), "dy": np.nansum(down, 1)}
                out |= {"low": np.where(void, np.inf, own).min(1), "high": np.where(void, -np.inf, own).max(1)}
                rows = pd.DataFrame(out)
                yield rows[(rows["i"] >= r.i0) & (rows["i"] <= r.i1)] if hasattr(r, "i0") else rows

    return bands.mapInPandas(run, COSTS)


def leveled(grid: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and level of each square of a grid and each level that crosses it, for squares
    with three known corners at least. A sample on a level counts as below it."""
    corners = np.stack([grid[:-1, :-1], grid[:-1, 1:], grid[1:, :-1], grid[1:, 1:]])
    low, high = np.fmin.reduce(corners), np.fmax.reduce(corners)
    known = (~np.isnan(corners)).sum(0) >= 3
    first, last = np.ceil(np.where(known, low, 0) / step), np.ceil(np.where(known, high, 0) / step)
    i, j = np.nonzero(known & (last > first))
    n = (last - first)[i, j].astype(np.int64)
    at = np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    return i[at], j[at], (first[i, j].astype(np.int64)[at] + nth) * step


def crossings(grid: np.ndarray, i: np.ndarray, j: np.ndarray, level: np.ndarray, top: int = 0) -> dict[str, np.ndarray]:
    """Segments of squares and levels: which of these (at), seg, row and column, and both ends with place
    (x along columns, y along rows from top on) and edge. A saddle has two, which pair by the mean of
    its corners."""
    nw, ne, sw, se = grid[i, j], grid[i, j + 1], grid[i + 1, j], grid[i + 1, j + 1]
    a, b, c, d = (z > level for z in (nw, ne, sw, se))  # void: false, and masked where it matters
    gone = [np.isnan(z) for z in (nw, ne, sw, se)]
    cn, cw = (a != b) & ~gone[0] & ~gone[1], (a != c) & ~gone[0] & ~gone[2]
    cs, ce = (c != d) & ~gone[2] & ~gone[3], (b != d) & ~gone[1] & ~gone[3]
    rising = gone[0] | gone[3]  # the triangle's diagonal runs from sw to ne
    cd = np.where(rising, b != c, (gone[1] | gone[2]) & (a != d))
    saddle = cn & cw & cs & ce
    joined = (nw + ne + sw + se > 4 * level) == a
    one = np.select([cn, cw, cs], [N, W, S], E)
    two = np.select([saddle & joined, saddle, cd, ce, cs], [E, W, D, E, S], W)
    again = np.flatnonzero(saddle)
    pick = np.concatenate([np.arange(len(i)), again])
    seg = np.concatenate([np.zeros(len(i), np.int64), np.ones(len(again), np.int64)])
    one = np.concatenate([one, np.where(joined[again], W, S)])
    two = np.concatenate([two, np.where(joined[again], S, E)])
    i, j, level, nw, ne, sw, se, rising = (v[pick] for v in (i, j, level, nw, ne, sw, se, rising))
    with np.errstate(all="ignore"):
        part = lambda p, q: (level - p) / (q - p)
        north, south, west, east = part(nw, ne), part(sw, se), part(nw, sw), part(ne, se)
        across = np.where(rising, part(sw, ne), part(nw, se))
    i = i + top
    out = {"at": pick, "i": i, "j": j, "level": level, "seg": seg}
    for name, edge in (("1", one), ("2", two)):
        out[f"x{name}"] = np.select([edge == N, edge == S, edge == W, edge == E], [j + north, j + south, j * 1.0, j + 1.0], j + across)
        out[f"y{name}"] = np.select([edge == N, edge == S, edge == W, edge == E], [i * 1.0, i + 1.0, i + west, i + east], np.where(rising, i + 1 - across, i + across))
        out[f"e{name}"] = edge
    return out


def edge_keys(edge: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """A number for an edge, the same from both squares that have it: kind (0 horizontal, 1 vertical,
    2 diagonal), row and column, the latter two of 24 bits."""
    kind = np.select([(edge == N) | (edge == S), edge == D], [0, 2], 1).astype(np.int64)
    return (kind << 48) | ((i + (edge == S)).astype(np.int64) << 24) | (j + (edge == E))


def key_text(key):
    """An edge's number as text, for reports: H, V or D, row and column."""
    part = lambda shift: F.shiftright(key, shift).bitwiseAND((1 << 24) - 1).cast("string")
    kind = F.substring(F.lit("HVD"), F.shiftright(key, 48).cast("int") + 1, F.lit(1))
    return F.concat(kind, part(24), F.lit("_"), part(0))


def segments(bands: DataFrame, step: int) -> DataFrame:
    """Contour segments with edge keys: those of all squares and levels, or, of bands that have
    `tiles` (array of tile_seq, lo, hi, first, last: rows and levels of a file's tiles, last left out),
    the ones of the tiles. Needs no shuffle and no join with levels."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r, grid in bounded(pdf):
                if hasattr(r, "rings") and r.rings is not None:
                    grid = np.where(outside(r, grid.shape), np.nan, grid)
                if len(grid) < 2 or np.isnan(grid).all():
                    continue
                i, j, level = leveled(grid, step)
                seq = np.zeros(len(i), np.int64)
                if hasattr(r, "tiles"):
                    lows = np.array([t["lo"] for t in r.tiles] or [0])
                    order = np.argsort(lows)
                    own = order[np.maximum(np.searchsorted(lows[order], i + r.top, side="right") - 1, 0)]
                    at = lambda name: np.array([t[name] for t in r.tiles] or [0])[own]  # noqa: B023, E731
                    good = (i + r.top >= at("lo")) & (i + r.top < at("hi")) & (level >= at("first")) & (level < at("last")) & (len(r.tiles) > 0)
                    i, j, level, seq = i[good], j[good], level[good], at("tile_seq")[good]
                if not len(i):
                    continue
                found = crossings(grid, i, j, level, r.top)
                out = {"cell": r.cell, "file_seq": r.file_seq, "tile_seq": seq[found["at"]], **{c: found[c] for c in ("level", "i", "j", "seg")}}
                for k in "12":
                    out |= {f"k{k}": edge_keys(found[f"e{k}"], found["i"], found["j"]), f"x{k}": found[f"x{k}"], f"y{k}": found[f"y{k}"]}
                yield pd.DataFrame(out)

    return bands.mapInPandas(run, SEGMENTS)


def outside(r, shape: tuple[int, int]) -> np.ndarray:
    """Which samples of a band no ring has: r.rings lists (i, xs) for raster rows and rings, with the
    sorted places at which a ring's edges cross the row, r.lons the samples' places. A
    sample is in a ring if an odd number of crossings lies beyond it."""
    out = np.ones(shape, bool)
    lons = np.asarray(r.lons)
    for hit in r.rings:
        at = hit["i"] - r.top
        if 0 <= at < shape[0]:
            xs = np.sort(np.asarray(hit["xs"]))
            out[at] &= (len(xs) - np.searchsorted(xs, lons, side="right")) % 2 == 0
    return out
