"""Raster operators over the long form: masks, crops, statistics, chopping."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import FOOT


def void_mask(dem: DataFrame, void_max: int) -> DataFrame:
    """Samples at or under void_max become void."""
    return dem.withColumn("z", F.when(F.col("z") > void_max, F.col("z")))


def in_feet(dem: DataFrame) -> DataFrame:
    return dem.withColumn("z", F.col("z") * FOOT)


def crop_bounds(header: DataFrame, left: Column, bottom: Column, right: Column, top: Column) -> DataFrame:
    """header with i0, i1, j0, j1: the first and last rows and columns of an area, in the file's own
    projection. All sides go outward to the next sample, but not beyond the raster; left > right
    crosses the antimeridian. An area apart from the raster leaves i1 < i0 or j1 < j0.

    header: n_rows, n_cols, min_x, min_y, max_x, max_y, inc_x, inc_y (positive).
    """
    c = F.col
    east = (c("min_x") < 0) | (c("min_x") < right)  # of an area across: the part after the antimeridian
    left, right = F.when((left > right) & east, c("min_x")).otherwise(left), F.when((left > right) & ~east, c("max_x")).otherwise(right)
    inward = lambda d, inc: F.floor(d / inc)
    return header.withColumns(
        {
            "j0": inward(F.greatest(left, "min_x") - c("min_x"), c("inc_x")),
            "j1": c("n_cols") - 1 - inward(c("max_x") - F.least(right, "max_x"), c("inc_x")),
            "i0": inward(c("max_y") - F.least(top, "max_y"), c("inc_y")),
            "i1": c("n_rows") - 1 - inward(F.greatest(bottom, "min_y") - c("min_y"), c("inc_y")),
        }
    )


def area_crop(dem: DataFrame, header: DataFrame, left: float, bottom: float, right: float, top: float) -> DataFrame:
    """The samples of the area, by index bounds from the header: filters on i and j that a scan
    of stored rasters can push down."""
    square = header.select("file_seq", F.col("n").alias("n_rows"), F.col("n").alias("n_cols"), *[F.col(f"{m}_{d}").alias(f"{m}_{x}") for m in ("min", "max") for d, x in (("lon", "x"), ("lat", "y"))], F.col("inc").alias("inc_x"), F.col("inc").alias("inc_y"))
    at = crop_bounds(square, *map(F.lit, (left, bottom, right, top))).select("file_seq", "i0", "i1", "j0", "j1")
    return dem.join(at, "file_seq").where("i BETWEEN i0 AND i1 AND j BETWEEN j0 AND j1").select(*dem.columns)


def tile_stats(dem: DataFrame) -> DataFrame:
    """Rows, columns, range and number of samples of each tile; voids don't count."""
    return dem.groupBy("cell").agg(
        F.countDistinct("i").alias("n_rows"), F.countDistinct("j").alias("n_cols"), F.min("z").cast("long").alias("min_ele"), F.max("z").cast("long").alias("max_ele"), F.count("z").alias("n_samples")
    )


def node_estimate(costs: DataFrame, step: int) -> DataFrame:
    """Contour nodes to expect of each tile: steps over the contour interval."""
    return costs.groupBy("cell").agg(F.floor((F.sum("dx") + F.sum("dy")) / F.lit(float(step))).alias("estimate"))


TILES = "cell string, file_seq long, path string, lo long, hi long, estimate long, low double, high double"


def chopped(n: np.ndarray, dx: np.ndarray, dy: np.ndarray, step: int, budget: int) -> list[tuple[str, int, int, float]]:
    """path, first and last row and estimate of the tiles that a raster's rows are halved into, until
    each is within the budget (0: none). Halves share their border row, the southern one comes
    first (path 0); tiles without a sample go at every level. Rows are counted from 0."""
    sums = [np.concatenate([[0], np.cumsum(v)]) for v in (n, dx, dy)]
    out, stack = [], [("", 0, len(n) - 1)]
    while stack:
        path, lo, hi = stack.pop()
        samples, along, down = (v[hi + 1] - v[lo] for v in sums)
        if not samples:
            continue
        estimate = (along + down - dy[lo]) / step
        if not budget or estimate <= budget or hi - lo < 2:
            out.append((path, lo, hi, estimate))
            continue
        middle = lo + (hi - lo + 1) // 2
        stack += [(path + "1", lo, middle), (path + "0", middle, hi)]
    return out


def chop(costs: DataFrame, step: int, budget: int) -> DataFrame:
    """Tiles of each raster by chopped(), with rows and least and greatest sample. One shuffle of a row
    for each raster row; a task has the rows of one raster at a time."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        i, low, high = (pdf[c].to_numpy() for c in ("i", "low", "high"))
        found = chopped(*(pdf[c].to_numpy() for c in ("n", "dx", "dy")), step, budget)
        rows = [(pdf["cell"].iloc[0], pdf["file_seq"].iloc[0], path, i[lo], i[hi], int(e // 1), low[lo : hi + 1].min(), high[lo : hi + 1].max()) for path, lo, hi, e in found]
        return pd.DataFrame(rows, columns=[f.split()[0] for f in TILES.split(", ")])

    return costs.groupBy("cell", "file_seq").applyInPandas(run, TILES)


def spline_coefficients(values: np.ndarray) -> np.ndarray:
    """Coefficients of the cubic B-spline through values along axis 0, mirrored at the ends: a
    causal and an anticausal recursion with the pole sqrt(3) - 2."""
    n, pole = len(values), 3**0.5 - 2
    if n < 2:
        return values.astype(np.float64)
    c = values.astype(np.float64) * 6.0
    reach = min(n, 60)  # the pole's powers vanish beyond
    powers = pole ** np.arange(reach)
    if reach < n:
        c[0] = np.tensordot(powers, c[:reach], 1)
    else:  # the mirrored sequence has the period 2n - 2
        weights = pole ** np.arange(n) + np.r_[0, pole ** (2 * n - 2 - np.arange(1, n - 1)), 0]
        c[0] = np.tensordot(weights, c, 1) / (1 - pole ** (2 * n - 2))
    for k in range(1, n):
        c[k] += pole * c[k - 1]
    c[-1] = (pole / (pole * pole - 1)) * (c[-1] + pole * c[-2])
    for k in range(n - 2, -1, -1):
        c[k] = pole * (c[k + 1] - c[k])
    return c


def _stretched(values: np.ndarray, size: int) -> np.ndarray:
    """The spline along axis 0 at size places from the first value to the last."""
    n = len(values)
    c = spline_coefficients(values)
    at = np.linspace(0, n - 1, size)
    low = np.minimum(np.floor(at).astype(int), max(n - 2, 0))
    t = (at - low)[:, None]
    mirrored = lambda k: np.where(k < 0, -k, np.where(k > n - 1, 2 * (n - 1) - k, k))
    take = lambda d: c[mirrored(low + d)]
    return ((1 - t) ** 3 * take(-1) + (3 * t**3 - 6 * t**2 + 4) * take(0) + (-3 * t**3 + 3 * t**2 + 3 * t + 1) * take(1) + t**3 * take(2)) / 6


def super_sample(grid: np.ndarray, void: np.ndarray, zoom: float) -> tuple[np.ndarray, np.ndarray]:
    """A raster with zoom times the rows and columns: samples by a cubic spline, rounded half to
    even; voids from the nearest sample."""
    rows, cols = (round(n * zoom) for n in grid.shape)
    out = np.rint(_stretched(_stretched(grid, rows).T, cols).T) + 0.0  # no negative zero
    near = lambda n, size: np.floor(np.linspace(0, n - 1, size) + 0.5).astype(int)
    return out, void[np.ix_(near(grid.shape[0], rows), near(grid.shape[1], cols))]
