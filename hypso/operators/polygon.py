"""Polygon operators: edges, masks, cells that a polygon crosses, files that an area needs.

Rings are tables (ring, seq, x, y), closed: the last vertex is the first. A point is in a ring
if a ray to the east crosses its edges an odd number of times (an edge has its lower end, not
its upper one); several rings are or-ed, holes included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import cell_name, whole_numbers


def edges(rings: DataFrame) -> DataFrame:
    """ring, x1, y1, x2, y2 of consecutive vertices."""
    w = Window.partitionBy("ring").orderBy("seq")
    return rings.select("ring", F.lag("x").over(w).alias("x1"), F.lag("y").over(w).alias("y1"), F.col("x").alias("x2"), F.col("y").alias("y2")).where("x1 IS NOT NULL")


def row_crossings(edges_: DataFrame, header: DataFrame) -> DataFrame:
    """For each raster row and ring the longitudes at which the ring's edges cross the row:
    file_seq, i, xs. An edge goes to the rows between its ends only, so the work is in proportion to
    crossings, and samples need no join with edges at all."""
    top, bottom = F.greatest("y1", "y2"), F.least("y1", "y2")
    # Edges and files meet in whole degrees of latitude; edges to the west of a file are on no ray from it.
    lowest = F.col("max_lat") - (F.col("n") - 1) * F.col("inc")
    bands = header.withColumn("band", F.explode(F.sequence(F.floor(lowest), F.floor("max_lat"))))
    by_row = edges_.withColumn("band", F.explode(F.sequence(F.floor(bottom), F.floor(top)))).join(bands, "band").where("greatest(x1, x2) >= min_lon")
    first = F.greatest(F.floor((F.col("max_lat") - top) / F.col("inc")) - 1, F.lit(0))
    last = F.least(F.ceil((F.col("max_lat") - bottom) / F.col("inc")) + 1, (F.col("n") - 1).cast("long"))
    rows = by_row.withColumn("i", F.explode(F.when(first <= last, F.sequence(first, last)))).withColumn("lat", F.col("max_lat") - F.col("i") * F.col("inc")).where(F.floor("lat") == F.col("band"))
    return _crossed(rows)


def line_crossings(edges_: DataFrame, rows: DataFrame) -> DataFrame:
    """The same for rows (file_seq, i, lat) at any latitudes."""
    spans = edges_.withColumn("band", F.explode(F.sequence(F.floor(F.least("y1", "y2")), F.floor(F.greatest("y1", "y2")))))
    return _crossed(rows.withColumn("band", F.floor("lat")).join(spans, "band"))


def _crossed(rows: DataFrame) -> DataFrame:
    at = (F.col("x2") - F.col("x1")) * (F.col("lat") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")
    return rows.where("(y1 > lat) <> (y2 > lat)").groupBy("file_seq", "i", "ring").agg(F.collect_list(at).alias("xs")).select("file_seq", "i", "xs")


def inside(rings: Column, lon: Column) -> Column:
    return F.coalesce(F.exists(rings, lambda xs: F.size(F.filter(xs, lambda x: lon < x)) % 2 == 1), F.lit(False))


def polygon_mask(dem: DataFrame, header: DataFrame, rings: DataFrame) -> DataFrame:
    """dem with `outside`: true where no ring has the sample. The raster is joined with its rows'
    crossings by an equi-join on the row; it isn't multiplied by edges."""
    crossed = row_crossings(edges(rings), header).groupBy("file_seq", "i").agg(F.collect_list("xs").alias("rings"))
    placed = dem.join(header.select("file_seq", "min_lon", "inc"), "file_seq").join(crossed, ["file_seq", "i"], "left")
    return placed.withColumn("outside", ~inside(F.col("rings"), F.col("min_lon") + F.col("j") * F.col("inc"))).select(*dem.columns, "outside")


def tile_state(masked: DataFrame) -> DataFrame:
    """all: drop the tile; none: drop the polygon; mixed: mask its samples."""
    out = masked.groupBy("cell").agg(F.sum(F.col("outside").cast("long")).alias("n_outside"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("state", F.when(F.col("n_outside") == 0, "none").when(F.col("n_outside") == F.col("n"), "all").otherwise("mixed"))


def crossed_cells(rings: DataFrame) -> DataFrame:
    """Cells that ring edges touch: a vertex's own cell and the cells on both sides of every
    meridian and parallel that an edge crosses. Each edge yields its cells; no join."""
    e = edges(rings)
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    pair = lambda x, y: F.struct(F.floor(x).cast("long").alias("lon"), F.floor(y).cast("long").alias("lat"))
    slope = (y2 - y1) / F.when(x2 != x1, x2 - x1)
    base = y1 - x1 * slope
    oblique = (x1 != x2) & (y1 != y2)
    xs, ys = whole_numbers(F.least(x1, x2), F.greatest(x1, x2)), whole_numbers(F.least(y1, y2), F.greatest(y1, y2))
    at_x = F.flatten(F.transform(xs, lambda x: F.array(pair(x - 1, slope * x + base), pair(x, slope * x + base))))
    at_y = F.flatten(F.transform(ys, lambda y: F.array(pair((y - base) / F.when(slope != 0, slope), y - 1), pair((y - base) / F.when(slope != 0, slope), y))))
    straight = F.when(x1 == x2, F.transform(ys, lambda y: pair(x2, y))).otherwise(F.transform(xs, lambda x: pair(x, y2)))
    cells = F.concat(F.array(pair(x2, y2)), F.when(oblique, F.concat(at_x, at_y)).otherwise(straight))
    return e.select("ring", F.explode(cells).alias("c")).select("ring", "c.lon", "c.lat").distinct().withColumn("cell", cell_name(F.col("lat"), F.col("lon")))


def filled_cells(rings: DataFrame) -> DataFrame:
    """ring, cell: cells whose middle is in a ring. Edges go to the middle latitudes that they cross, so the
    work is in proportion to crossings and cells, not to their product."""
    low, high = F.ceil(F.least("y1", "y2") - 0.5), F.floor(F.greatest("y1", "y2") - 0.5)
    rows = edges(rings).withColumn("row", F.explode(F.when(low <= high, F.sequence(low, high)))).withColumn("lat", F.col("row") + 0.5).where("(y1 > lat) <> (y2 > lat)")
    at = (F.col("x2") - F.col("x1")) * (F.col("lat") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")
    crossed = rows.groupBy("ring", "row").agg(F.collect_list(at).alias("xs"))
    cells = crossed.withColumn("lon", F.explode(F.sequence(F.floor(F.array_min("xs")), F.ceil(F.array_max("xs")))))
    inside_ = cells.where(F.size(F.filter("xs", lambda x: x > F.col("lon") + 0.5)) % 2 == 1)
    return inside_.select("ring", cell_name(F.col("row"), F.col("lon")).alias("cell"))


def files_needed(boxes: DataFrame, rings: DataFrame) -> DataFrame:
    """The cells of each ring's box (ring, left, bottom, right, top) that are needed, and whether
    their samples must be checked: crossed ones are; others by their corners (all in: needed,
    unchecked; some: checked; none: not needed)."""
    span = lambda a, b: F.when(a < b, F.sequence(a, b - 1))
    cells = boxes.select("ring", F.explode(span(F.col("left"), F.col("right"))).alias("lon"), "bottom", "top").withColumn("lat", F.explode(span(F.col("bottom"), F.col("top")))).select("ring", "lon", "lat")
    crossed = crossed_cells(rings).select("ring", "lon", "lat", F.lit(True).alias("crossed"))
    known = cells.join(crossed, ["ring", "lon", "lat"], "left")
    corners = known.where("crossed IS NULL").select("ring", "lon", "lat", F.explode(F.array(*[F.struct((F.col("lon") + a).alias("x"), (F.col("lat") + b).alias("y")) for a in (0, 1) for b in (0, 1)])).alias("p"))
    cut = edges(rings).join(corners, "ring")
    hits = cut.where("(y1 > p.y) <> (y2 > p.y) AND p.x < (x2 - x1) * (p.y - y1) / (y2 - y1) + x1").groupBy("ring", "lon", "lat", "p").agg((F.count(F.lit(1)) % 2).alias("odd"))
    n_in = hits.groupBy("ring", "lon", "lat").agg(F.sum("odd").alias("n_in"))
    out = known.join(n_in, ["ring", "lon", "lat"], "left").withColumn("n_in", F.coalesce("n_in", F.lit(0)))
    out = out.where("crossed OR n_in > 0").withColumn("check", F.coalesce("crossed", F.lit(False)) | (F.col("n_in") < 4))
    return out.select("ring", cell_name(F.col("lat"), F.col("lon")).alias("cell"), "check")


Point = tuple[float, float]


def _half(points: list[Point], axis: int, bound: float, sign: int) -> list[list[Point]]:
    """The parts of a ring on one side of a line. Where the ring leaves that side it comes back at the
    neighbouring cut, as along the line the ring's inside and outside take turns."""
    inside = [sign * (p[axis] - bound) >= 0 for p in points]
    if all(inside):
        return [points]
    if not any(inside):
        return []

    def cut(p: Point, q: Point) -> Point:
        t = (bound - p[axis]) / (q[axis] - p[axis])
        out = [p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])]
        out[axis] = bound
        return out[0], out[1]

    first = next(k for k in range(len(points)) if not inside[k - 1] and inside[k])
    chains: list[list[Point]] = []
    for step in range(len(points)):
        k = (first + step) % len(points)
        if inside[k] and not inside[k - 1]:
            chains.append([cut(points[k - 1], points[k])])
        if inside[k]:
            chains[-1].append(points[k])
        elif inside[k - 1]:
            chains[-1].append(cut(points[k - 1], points[k]))
    if inside[(first - 1) % len(points)]:  # the last chain is still open
        chains[-1].append(cut(points[first - 2], points[first - 1]))
    # Cuts in the order of the line: each chain's end goes on with the start beside it.
    cuts = sorted([(c[0][1 - axis], True, n) for n, c in enumerate(chains)] + [(c[-1][1 - axis], False, n) for n, c in enumerate(chains)])
    after: dict[int, int] = {}
    while cuts:
        _, entry, n = cuts.pop(0)
        other = next(k for k, c in enumerate(cuts) if c[1] != entry)
        m = cuts.pop(other)[2]
        after[m if entry else n] = n if entry else m
    out, left = [], set(after)
    while left:
        n = start = min(left)
        ring: list[Point] = []
        while True:
            ring += chains[n]
            left.discard(n)
            n = after[n]
            if n == start:
                break
        out.append(ring)
    return out


def area_of(ring: list[Point]) -> float:
    return sum(ring[k - 1][0] * ring[k][1] - ring[k][0] * ring[k - 1][1] for k in range(len(ring))) / 2


def clip_ring(xs: list[float], ys: list[float], box: tuple[float, float, float, float]) -> list[list[Point]]:
    """The parts of a ring within a rectangle (left, bottom, right, top), each closed by its first
    point; parts without an area are left out. A ring that leaves the rectangle and comes back
    gives several."""
    points: list[Point] = []
    for p in zip(xs, ys, strict=True):
        if not points or p != points[-1]:
            points.append(p)
    if len(points) > 1 and points[0] == points[-1]:
        points = points[:-1]
    rings = [points] if points else []
    for axis, bound, sign in ((0, box[0], 1), (1, box[1], 1), (0, box[2], -1), (1, box[3], -1)):
        rings = [part for ring in rings for part in _half(ring, axis, bound, sign)]
    return [[*ring, ring[0]] for ring in rings if len(ring) > 2 and abs(area_of(ring)) > 1e-18]
