"""Contour operators: levels; segments (see bands) stitched to lines, simplified and split."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import next_multiple

#: Points between a chord's ends from which on distances are taken all at once.
WIDE = 24


def level_range(low: Column, high: Column, step: int) -> tuple[Column, Column]:
    """The first level of whole heights from low to high, and the one that is left out after the last."""
    return next_multiple(low, step), next_multiple(high, step)


def levels(stats: DataFrame, step: int, low: int | None = None, high: int | None = None, zero: bool = True) -> DataFrame:
    """The levels of each tile (cell, min_ele, max_ele): multiples of step from the least on, the
    greatest rounded up left out. A bound of 0 counts as none."""
    first, last = level_range(F.lit(low).cast("long") if low else F.col("min_ele"), F.lit(high).cast("long") if high else F.col("max_ele"), step)
    out = stats.select("cell", F.explode(F.when(first < last, F.sequence(first, last - step, F.lit(step).cast("long")))).alias("level"))
    return out if zero else out.where("level <> 0")


def stitched(pdf: pd.DataFrame) -> list[tuple[bool, np.ndarray, np.ndarray]]:
    """Lines (closed or not, xs, ys) from the segments of one tile and level. Those with ends first,
    from the least key; what is left are rings, which repeat their first point at the end.

    A segment has two sides, k and k + n; sides on one edge are mates. A walk goes to a side's other
    side, then to that one's mate.
    """
    n = len(pdf)
    keys, edge, many = np.unique(np.concatenate([pdf["k1"], pdf["k2"]]), return_inverse=True, return_counts=True)
    x, y = (np.concatenate([pdf[f"{c}1"], pdf[f"{c}2"]]) for c in "xy")
    order = np.argsort(edge, kind="stable")
    first = order[np.cumsum(many) - many]
    mates = np.full(2 * n, -1)
    both = order[np.flatnonzero(edge[order[1:]] == edge[order[:-1]])], order[1 + np.flatnonzero(edge[order[1:]] == edge[order[:-1]])]
    mates[both[0]], mates[both[1]] = both[1], both[0]
    mate, used, out = mates.tolist(), bytearray(n), []
    for start in [*first[many == 1].tolist(), *first[many > 1].tolist()]:
        if used[start % n]:
            continue
        side, walk = start, [start]
        while side >= 0 and not used[side % n]:
            used[side % n] = 1
            side = side + n if side < n else side - n
            walk.append(side)
            side = mate[side]
        out.append((side == start, x[walk], y[walk]))
    return out


LINES_SCHEMA = "cell string, level long, line long, closed boolean, xs array<double>, ys array<double>"


def lines(segments_: DataFrame) -> DataFrame:
    """Stitched lines of each tile and level, numbered."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cell, level = pdf["cell"].iloc[0], pdf["level"].iloc[0]
        found = [(cell, level, k, closed, xs, ys) for k, (closed, xs, ys) in enumerate(stitched(pdf))]
        return pd.DataFrame(found, columns=["cell", "level", "line", "closed", "xs", "ys"])

    return segments_.groupBy("cell", "level").applyInPandas(run, LINES_SCHEMA)


def simplified(xs: list[float], ys: list[float], epsilon: float | None) -> list[int]:
    """Indices that remain of a path: ends stay; where the farthest point is more than epsilon from
    the chord, the path is parted there. None keeps all."""
    n = len(xs)
    if epsilon is None or n < 3:
        return list(range(n))
    keep = [False] * n
    keep[0] = keep[-1] = True
    x, y = np.asarray(xs), np.asarray(ys)
    stack = [(0, n - 1)]
    while stack:
        a, b = stack.pop()
        dx, dy = xs[b] - xs[a], ys[b] - ys[a]
        size = (dx * dx + dy * dy) ** 0.5
        best, at = -1.0, -1
        if b - a > WIDE:
            px, py = x[a + 1 : b] - xs[a], y[a + 1 : b] - ys[a]
            d = np.abs(dx * py - dy * px) / size if size else np.sqrt(px * px + py * py)
            at = int(d.argmax())
            best, at = float(d[at]), at + a + 1
        else:
            for k in range(a + 1, b):
                px, py = xs[k] - xs[a], ys[k] - ys[a]
                d = abs(dx * py - dy * px) / size if size else (px * px + py * py) ** 0.5
                if d > best:
                    best, at = d, k
        if best > epsilon:
            keep[at] = True
            stack += [(a, at), (at, b)]
    return [k for k in range(n) if keep[k]]


def rdp(lines_: DataFrame, epsilon: float | None) -> DataFrame:
    """Simplified lines, in Arrow batches."""
    if epsilon is None:
        return lines_

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = [simplified(list(x), list(y), epsilon) for x, y in zip(pdf["xs"], pdf["ys"], strict=True)]
            yield pdf.assign(xs=[[x[k] for k in ks] for x, ks in zip(pdf["xs"], keep, strict=True)], ys=[[y[k] for k in ks] for y, ks in zip(pdf["ys"], keep, strict=True)])

    return lines_.mapInPandas(run, lines_.schema)


def split(lines_: DataFrame, limit: int) -> DataFrame:
    """Lines in pieces of at most `limit` points that share their border point; under two points
    they go; 0 leaves them whole. A ring that is split becomes open pieces."""
    n = F.size("xs")
    whole = lines_.where(n >= 2)
    if not limit:
        return whole.withColumn("piece", F.lit(0).cast("long"))
    starts = F.sequence(F.lit(0), n - 2, F.lit(limit - 1))
    parts = whole.select("*", F.posexplode(starts).alias("piece", "_at"))
    cut = lambda c: F.slice(c, F.col("_at") + 1, limit)
    parts = parts.withColumn("xs", cut(F.col("xs"))).withColumn("ys", cut(F.col("ys")))
    closed = (F.element_at("xs", 1) == F.element_at("xs", -1)) & (F.element_at("ys", 1) == F.element_at("ys", -1))
    return parts.withColumn("closed", closed).withColumn("piece", F.col("piece").cast("long")).drop("_at")


def counts(lines_: DataFrame) -> DataFrame:
    """Nodes and ways of each tile and level; a ring's last point is its first node."""
    return lines_.groupBy("cell", "level").agg(F.sum(F.size("xs") - F.col("closed").cast("int")).alias("nodes"), F.count(F.lit(1)).alias("ways"))
