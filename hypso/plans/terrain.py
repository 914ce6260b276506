"""Queries over the derived raster, with SQL that states the same for another engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import bands, contour, raster
from ..sources.dem import SIDE, dem, dem_sql, header

STEP, BUDGET, VOID_MAX = 20, 20_000, -400
W = f"WITH {dem_sql()}"


def dem_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dem(spark, sf_dir)
    return d.join(F.broadcast(header(d)), ["cell", "file_seq"]).select("cell", "file_seq", "i", "j", F.col("z").cast("double").alias("z"), F.floor((F.col("min_lon") + F.col("j") * F.col("inc")) * 1e6).alias("lon_e6"), F.floor((F.col("max_lat") - F.col("i") * F.col("inc")) * 1e6).alias("lat_e6"))


def void_mask(spark, sf_dir):
    d = raster.void_mask(dem(spark, sf_dir), VOID_MAX)
    return d.select("cell", "i", "j", F.col("z").cast("double").alias("z"), F.col("z").isNull().alias("masked"))


def feet_levels(spark, sf_dir):
    return raster.in_feet(dem(spark, sf_dir)).select("cell", "i", "j", F.floor(F.col("z") * 1e6).cast("double").alias("feet_e6"))


def tile_stats(spark, sf_dir):
    t = raster.tile_stats(dem(spark, sf_dir))
    said = F.concat_ws(" ", "cell", F.concat(F.col("n_rows"), F.lit("x"), F.col("n_cols")), F.concat(F.col("min_ele"), F.lit(".."), F.col("max_ele")))
    return t.withColumn("said", said)


def _bands(spark, sf_dir, n=SIDE):
    """Bands of 16 rows, so that small rasters have borders between bands, too."""
    return bands.packed(dem(spark, sf_dir, n), n, 16)


def node_estimate(spark, sf_dir):
    return raster.node_estimate(bands.costs(_bands(spark, sf_dir)), STEP)


def area_crop(spark, sf_dir):
    d = dem(spark, sf_dir)
    return raster.area_crop(d, header(d), 6.25, 43.3, 7.4, 44.125).groupBy("cell").agg(F.min("i").alias("i0"), F.max("i").alias("i1"), F.min("j").alias("j0"), F.max("j").alias("j1"), F.count(F.lit(1)).alias("samples"), F.sum("z").alias("sum_z"))


def void_tile_discard(spark, sf_dir):
    d = raster.void_mask(dem(spark, sf_dir), 0).withColumn("ti", F.expr("i div 2")).withColumn("tj", F.expr("j div 2"))
    return d.groupBy("cell", "ti", "tj").agg(F.count("z").alias("samples")).where("samples > 0")


def chop_tiles(spark, sf_dir):
    return raster.chop(bands.costs(_bands(spark, sf_dir)), STEP, BUDGET).select("cell", "path", "lo", "hi", "estimate")


def contour_levels(spark, sf_dir):
    return contour.levels(raster.tile_stats(dem(spark, sf_dir)), STEP, zero=False)


def _segments(spark, sf_dir, n=SIDE):
    return bands.segments(_bands(spark, sf_dir, n), STEP)


def contour_segments(spark, sf_dir):
    e6 = lambda c: F.floor(F.col(c) * 1e6).alias(f"{c}_e6")
    key = lambda c: bands.key_text(F.col(c)).alias(c)
    return _segments(spark, sf_dir).select("cell", "level", "i", "j", "seg", key("k1"), key("k2"), e6("x1"), e6("y1"), e6("x2"), e6("y2"))


def contour_rollup(spark, sf_dir):
    return _segments(spark, sf_dir).rollup("cell", "level").agg(F.count(F.lit(1)).alias("n_segments")).withColumn("level", F.col("level").cast("double"))


def elev_class(spark, sf_dir):
    out = _segments(spark, sf_dir).groupBy("cell", "level").agg(F.count(F.lit(1)).alias("n_segments"))
    return out.withColumn("class", S.level_class(F.col("level")))


def slice_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: grid, levels, segments, class, on a coarse grid."""
    out = _segments(spark, sf_dir, 32).groupBy("cell", F.col("level").alias("elevation")).agg(F.count(F.lit(1)).alias("n_segments"))
    return out.withColumn("class", S.level_class(F.col("elevation")))


def contour_lines(spark, sf_dir):
    return contour.lines(_segments(spark, sf_dir)).select("cell", "level", "line", "closed", F.size("xs").cast("long").alias("points"), F.floor(F.col("xs")[0] * 1e6).alias("x_e6"), F.floor(F.col("ys")[0] * 1e6).alias("y_e6"))


def contour_counts(spark, sf_dir):
    """Segments in total, and nodes of unsplit lines, must agree: each segment adds one node but for open lines' first."""
    found = contour.lines(_segments(spark, sf_dir))
    return found.groupBy("cell", "level").agg(F.sum(F.size("xs") - 1).alias("n_segments"))


def rdp_simplify(spark, sf_dir):
    found = contour.rdp(contour.lines(_segments(spark, sf_dir)), 0.1)
    return contour.counts(contour.split(found, 2000))


def _paths(spark, sf_dir):
    """A path for each order: its parts' keys as points, closed if the status is F."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy((F.col("l_orderkey") % 500).alias("line")).agg(F.sort_array(F.collect_set(F.col("l_partkey") % 97)).alias("a"))
    ring = F.when(F.col("line") % 3 == 0, F.concat("a", F.slice("a", 1, 1))).otherwise(F.col("a"))
    return items.select("line", ring.alias("xs"), F.transform(ring, lambda x: x * 2).alias("ys"), (F.col("line") % 3 == 0).alias("closed"))


def split_ways(spark, sf_dir):
    out = contour.split(_paths(spark, sf_dir), 7)
    return out.select("line", "piece", F.size("xs").cast("long").alias("points"), F.element_at("xs", 1).alias("first_x"), F.element_at("xs", -1).alias("last_x"), "closed")


def xyz_dump(spark, sf_dir):
    d = dem(spark, sf_dir).where("z IS NOT NULL")
    d = d.join(F.broadcast(header(d)), ["cell", "file_seq"])
    return d.select("cell", F.concat_ws(" ", S.fixed(F.col("min_lon") + F.col("j") * F.col("inc"), 7), S.fixed(F.col("max_lat") - F.col("i") * F.col("inc"), 7), F.col("z").cast("string")).alias("line"))


def reproject_points(spark, sf_dir):
    d = dem(spark, sf_dir).where("z IS NOT NULL")
    d = d.join(F.broadcast(header(d)), ["cell", "file_seq"])
    lon, lat = F.col("min_lon") + F.col("j") * F.col("inc"), F.col("max_lat") - F.col("i") * F.col("inc")
    x, y = S.mercator_x(lon), S.mercator_y(lat)
    near = lambda c: F.floor(c * 1e3 + 0.5)
    return d.select("cell", "i", "j", near(x).alias("x_mm"), near(y).alias("y_mm"), F.floor(S.unmercator_lon(x) * 1e7 + 0.5).alias("lon_e7"), F.floor(S.unmercator_lat(y) * 1e7 + 0.5).alias("lat_e7"))


def reproject_bbox(spark, sf_dir):
    h = header(dem(spark, sf_dir))
    x0, x1, y0, y1 = S.mercator_x(F.col("min_lon")), S.mercator_x(F.col("max_lon")), S.mercator_y(F.col("min_lat")), S.mercator_y(F.col("max_lat"))
    near = lambda c: F.floor(c * 1e3 + 0.5)
    return h.select("cell", near(F.least(x0, x1)).alias("min_x_mm"), near(F.least(y0, y1)).alias("min_y_mm"), near(F.greatest(x0, x1)).alias("max_x_mm"), near(F.greatest(y0, y1)).alias("max_y_mm"))


QUERIES = {f.__name__: f for f in (dem_scan, void_mask, feet_levels, tile_stats, node_estimate, area_crop, void_tile_discard, chop_tiles, contour_levels, contour_segments, contour_rollup, elev_class, slice_segments, contour_lines, contour_counts, rdp_simplify, split_ways, xyz_dump, reproject_points, reproject_bbox)}

_N1 = SIDE - 1
_LON, _LAT = f"(6.0::DOUBLE + file_seq % 2 + j * (1.0::DOUBLE / {_N1}))", f"(44.0::DOUBLE + file_seq // 2 - i * (1.0::DOUBLE / {_N1}))"
_COSTS = f"""{W}, steps AS (SELECT *, abs(z - lag(z) OVER (PARTITION BY cell, i ORDER BY j)) AS dx, abs(z - lag(z) OVER (PARTITION BY cell, j ORDER BY i)) AS dy FROM dem)"""


#: SQL from squares (cell, i, j, nw, ne, sw, se) and levels to segments, for the other engine alone.
#: An end lies on edge N, W, S, E or D (the diagonal of a triangle) of its square.
CROSSED = """SELECT cell, i, j, level, nw, ne, sw, se,
  coalesce((nw > level) <> (ne > level), false) AS cn, coalesce((nw > level) <> (sw > level), false) AS cw,
  coalesce((sw > level) <> (se > level), false) AS cs, coalesce((ne > level) <> (se > level), false) AS ce,
  CASE WHEN nw IS NULL OR se IS NULL THEN coalesce((sw > level) <> (ne > level), false)
    WHEN ne IS NULL OR sw IS NULL THEN coalesce((nw > level) <> (se > level), false) ELSE false END AS cd,
  (nw > level) <> (ne > level) AND (nw > level) <> (sw > level) AND (sw > level) <> (se > level) AS saddle,
  (nw + ne + sw + se > 4 * level) = (nw > level) AS joined FROM leveled"""
CHOSEN = """SELECT *,
  CASE WHEN saddle AND seg = 1 THEN (CASE WHEN joined THEN 'W' ELSE 'S' END) WHEN cn THEN 'N' WHEN cw THEN 'W' WHEN cs THEN 'S' ELSE 'E' END AS e1,
  CASE WHEN saddle AND seg = 1 THEN (CASE WHEN joined THEN 'S' ELSE 'E' END) WHEN saddle THEN (CASE WHEN joined THEN 'E' ELSE 'W' END)
    WHEN cd THEN 'D' WHEN ce THEN 'E' WHEN cs THEN 'S' ELSE 'W' END AS e2 FROM doubled"""


def _end_sql(e: str, axis: str) -> str:
    """x (columns) or y (rows) of the end on edge e: interpolated west to east or north to south."""
    t = lambda a, b: f"(CAST(level - {a} AS DOUBLE) / ({b} - {a}))"
    if axis == "x":
        return f"""CASE {e} WHEN 'N' THEN j + {t('nw', 'ne')} WHEN 'S' THEN j + {t('sw', 'se')} WHEN 'W' THEN CAST(j AS DOUBLE) WHEN 'E' THEN CAST(j + 1 AS DOUBLE)
    ELSE CASE WHEN nw IS NULL OR se IS NULL THEN j + {t('sw', 'ne')} ELSE j + {t('nw', 'se')} END END"""
    return f"""CASE {e} WHEN 'N' THEN CAST(i AS DOUBLE) WHEN 'S' THEN CAST(i + 1 AS DOUBLE) WHEN 'W' THEN i + {t('nw', 'sw')} WHEN 'E' THEN i + {t('ne', 'se')}
    ELSE CASE WHEN nw IS NULL OR se IS NULL THEN i + 1 - {t('sw', 'ne')} ELSE i + {t('nw', 'se')} END END"""


def _key_sql(e: str) -> str:
    """Name of the edge, the same from both squares that have it."""
    return f"""CASE {e} WHEN 'N' THEN concat('H', i, '_', j) WHEN 'S' THEN concat('H', i + 1, '_', j) WHEN 'W' THEN concat('V', i, '_', j) WHEN 'E' THEN concat('V', i, '_', j + 1) ELSE concat('D', i, '_', j) END"""


SEGMENTS = f"""SELECT cell, level, i, j, seg, {_key_sql('e1')} AS k1, {_end_sql('e1', 'x')} AS x1, {_end_sql('e1', 'y')} AS y1, {_key_sql('e2')} AS k2, {_end_sql('e2', 'x')} AS x2, {_end_sql('e2', 'y')} AS y2 FROM chosen"""


def segments_sql(n: int = SIDE) -> str:
    up = lambda x: f"(CASE WHEN ({x}) % {STEP} = 0 THEN ({x}) ELSE CAST(floor(({x}) / {STEP}.0::DOUBLE) AS BIGINT) * {STEP} + {STEP} END)"
    return f"""WITH {dem_sql(n)},
quads AS (SELECT a.cell, a.i, a.j, a.z AS nw, b.z AS ne, c.z AS sw, d.z AS se FROM dem a
  JOIN dem b ON a.cell = b.cell AND b.i = a.i AND b.j = a.j + 1 JOIN dem c ON a.cell = c.cell AND c.i = a.i + 1 AND c.j = a.j JOIN dem d ON a.cell = d.cell AND d.i = a.i + 1 AND d.j = a.j + 1),
ranges AS (SELECT *, {up('least(nw, ne, sw, se)')} AS lo, {up('greatest(nw, ne, sw, se)')} - {STEP} AS hi FROM quads
  WHERE (nw IS NOT NULL)::INT + (ne IS NOT NULL)::INT + (sw IS NOT NULL)::INT + (se IS NOT NULL)::INT >= 3),
leveled AS (SELECT * EXCLUDE (lo, hi), unnest(range(lo, hi + 1, {STEP})) AS level FROM ranges WHERE lo <= hi),
crossed AS ({CROSSED}),
doubled AS (SELECT * REPLACE (coalesce(saddle, false) AS saddle), unnest(CASE WHEN saddle THEN [0, 1] ELSE [0] END) AS seg FROM crossed),
chosen AS ({CHOSEN}),
segments AS ({SEGMENTS})"""


_SEG = segments_sql()
_CLASS = "CASE WHEN {0} % 200 = 0 THEN 'elevation_major' WHEN {0} % 100 = 0 THEN 'elevation_medium' ELSE 'elevation_minor' END AS class"
_X, _Y = f"({_LON} * (pi() / 180.0) * 6378137.0)", f"(ln(tan(pi() / 4 + {_LAT} * (pi() / 360.0))) * 6378137.0)"
_near = "CAST(floor({0} + 0.5) AS BIGINT)"
_NUMBER = "(CASE {0}[1] WHEN 'H' THEN 0 WHEN 'V' THEN 1 ELSE 2 END::BIGINT * 281474976710656 + string_split({0}[2:], '_')[1]::BIGINT * 16777216 + string_split({0}[2:], '_')[2]::BIGINT)"
# Lines by walking from segment to segment: open ones from their ends, rings from each of their edges.
_LINES = f"""{_SEG.replace('WITH', 'WITH RECURSIVE', 1)},
numbered AS (SELECT cell, level, {_NUMBER.format('k1')} AS k1, {_NUMBER.format('k2')} AS k2, x1, y1, x2, y2, row_number() OVER () AS s FROM segments),
ways AS (SELECT cell, level, s, k1 AS f, k2 AS t, x1 AS x, y1 AS y FROM numbered UNION ALL SELECT cell, level, s, k2, k1, x2, y2 FROM numbered),
degrees AS (SELECT cell, level, f AS k, count(*) AS d, min(x) AS x, min(y) AS y FROM ways GROUP BY ALL),
walk AS (SELECT w.cell, w.level, w.f AS start, w.s AS s0, w.s, w.t AS k, 2 AS points FROM ways w JOIN degrees d ON d.cell = w.cell AND d.level = w.level AND d.k = w.f AND d.d = 1
  UNION ALL SELECT w.cell, w.level, a.start, a.s0, w.s, w.t, a.points + 1 FROM walk a JOIN ways w ON w.cell = a.cell AND w.level = a.level AND w.f = a.k AND w.s <> a.s),
ends AS (SELECT * FROM walk JOIN degrees d USING (cell, level, k) WHERE d.d = 1),
open_keys AS (SELECT DISTINCT cell, level, k FROM walk),
turn AS (SELECT w.cell, w.level, w.f AS start, w.s AS s0, w.s, w.t AS k, 2 AS points FROM ways w LEFT JOIN open_keys o ON o.cell = w.cell AND o.level = w.level AND o.k = w.f WHERE o.k IS NULL AND w.f < w.t
  UNION ALL SELECT w.cell, w.level, a.start, a.s0, w.s, w.t, a.points + 1 FROM turn a JOIN ways w ON w.cell = a.cell AND w.level = a.level AND w.f = a.k AND w.s <> a.s WHERE a.k <> a.start AND w.t >= a.start),
found AS (SELECT cell, level, false AS closed, start, s0, points FROM ends WHERE start < k UNION ALL SELECT cell, level, true, start, min(s0), points FROM turn WHERE k = start GROUP BY cell, level, start, points)"""
_AWAY = """list_transform(range({a} + 1, {b}), lambda k: CASE WHEN xs[{a}] = xs[{b}] AND ys[{a}] = ys[{b}] THEN sqrt((xs[k] - xs[{a}]) * (xs[k] - xs[{a}]) + (ys[k] - ys[{a}]) * (ys[k] - ys[{a}]))
  ELSE abs((xs[{b}] - xs[{a}]) * (ys[k] - ys[{a}]) - (ys[{b}] - ys[{a}]) * (xs[k] - xs[{a}])) / sqrt((xs[{b}] - xs[{a}]) * (xs[{b}] - xs[{a}]) + (ys[{b}] - ys[{a}]) * (ys[{b}] - ys[{a}])) END)"""
ORACLE = {
    "dem_scan": f"{W} SELECT cell, file_seq, i, j, z::DOUBLE AS z, CAST(floor({_LON} * 1e6) AS BIGINT) AS lon_e6, CAST(floor({_LAT} * 1e6) AS BIGINT) AS lat_e6 FROM dem",
    "void_mask": f"{W} SELECT cell, i, j, CASE WHEN z > {VOID_MAX} THEN z::DOUBLE END AS z, coalesce(z <= {VOID_MAX}, true) AS masked FROM dem",
    "feet_levels": f"{W} SELECT cell, i, j, floor(z * (1.0::DOUBLE / 0.3048::DOUBLE) * 1e6)::DOUBLE AS feet_e6 FROM dem",
    "tile_stats": f"{W}, t AS (SELECT cell, count(DISTINCT i) AS n_rows, count(DISTINCT j) AS n_cols, min(z) AS min_ele, max(z) AS max_ele, count(z) AS n_samples FROM dem GROUP BY cell) SELECT *, cell || ' ' || n_rows || 'x' || n_cols || ' ' || min_ele || '..' || max_ele AS said FROM t",
    "node_estimate": f"{_COSTS} SELECT cell, CAST(floor((sum(dx) + sum(dy)) / {STEP}.0::DOUBLE) AS BIGINT) AS estimate FROM steps GROUP BY cell",
    "area_crop": f"""{W}, f AS (SELECT DISTINCT cell, 6.0::DOUBLE + file_seq % 2 AS w, 43.0::DOUBLE + file_seq // 2 AS s, 1.0::DOUBLE / {_N1} AS inc FROM dem),
b AS (SELECT cell, trunc((greatest(6.25, w) - w) / inc) AS j0, {_N1} + trunc((least(7.4, w + 1) - (w + 1)) / inc) AS j1, trunc((s + 1 - least(44.125, s + 1)) / inc) AS i0, {_N1} - trunc((greatest(43.3, s) - s) / inc) AS i1 FROM f)
SELECT cell, min(i) AS i0, max(i) AS i1, min(j) AS j0, max(j) AS j1, count(*) AS samples, sum(z)::BIGINT AS sum_z FROM dem JOIN b USING (cell) WHERE i BETWEEN b.i0 AND b.i1 AND j BETWEEN b.j0 AND b.j1 GROUP BY cell""",
    "void_tile_discard": f"{W} SELECT cell, i // 2 AS ti, j // 2 AS tj, count(*) FILTER (WHERE z > 0) AS samples FROM dem GROUP BY ALL HAVING samples > 0",
    "chop_tiles": f"""{_COSTS.replace('WITH', 'WITH RECURSIVE', 1)},
rows_ AS (SELECT cell, i, count(z) AS n, coalesce(sum(dx), 0) AS dx, coalesce(sum(dy), 0) AS dy FROM steps GROUP BY cell, i),
pre AS (SELECT cell, i, n, dx, sum(n) OVER w AS pn, sum(dx) OVER w AS px, sum(dy) OVER w AS py FROM rows_ WINDOW w AS (PARTITION BY cell ORDER BY i)),
tiles AS (SELECT cell, '' AS path, 0::BIGINT AS lo, {_N1}::BIGINT AS hi, (SELECT sum(dx) + sum(dy) FROM rows_ r WHERE r.cell = c.cell) / {STEP}.0::DOUBLE AS e FROM (SELECT DISTINCT cell FROM dem) c
  UNION ALL SELECT t.cell, t.path || h.p, b.lo, b.hi, (ph.px - pl.px + pl.dx + ph.py - pl.py) / {STEP}.0::DOUBLE
  FROM tiles t, (VALUES ('0'), ('1')) h(p), LATERAL (SELECT CASE WHEN h.p = '0' THEN t.lo + (t.hi - t.lo + 1) // 2 ELSE t.lo END AS lo, CASE WHEN h.p = '0' THEN t.hi ELSE t.lo + (t.hi - t.lo + 1) // 2 END AS hi) b
  JOIN pre pl ON pl.cell = t.cell AND pl.i = b.lo JOIN pre ph ON ph.cell = t.cell AND ph.i = b.hi
  WHERE t.e > {BUDGET} AND t.hi - t.lo >= 2 AND ph.pn - pl.pn + pl.n > 0)
SELECT cell, path, lo, hi, CAST(floor(e) AS BIGINT) AS estimate FROM tiles WHERE e <= {BUDGET} OR hi - lo < 2""",
    "contour_levels": f"{W}, t AS (SELECT cell, min(z) AS a, max(z) AS b FROM dem GROUP BY cell), l AS (SELECT cell, unnest(range(CAST(ceil(a / {STEP}.0::DOUBLE) AS BIGINT) * {STEP}, CAST(ceil(b / {STEP}.0::DOUBLE) AS BIGINT) * {STEP}, {STEP})) AS level FROM t) SELECT cell, level FROM l WHERE level <> 0",
    "contour_segments": f"{_SEG} SELECT cell, level, i, j, seg, k1, k2, CAST(floor(x1 * 1e6) AS BIGINT) AS x1_e6, CAST(floor(y1 * 1e6) AS BIGINT) AS y1_e6, CAST(floor(x2 * 1e6) AS BIGINT) AS x2_e6, CAST(floor(y2 * 1e6) AS BIGINT) AS y2_e6 FROM segments",
    "contour_rollup": f"{_SEG} SELECT cell, level::DOUBLE AS level, n_segments FROM (SELECT cell, level, count(*) AS n_segments FROM segments GROUP BY ROLLUP (cell, level))",
    "elev_class": f"{_SEG} SELECT cell, level, count(*) AS n_segments, {_CLASS.format('level')} FROM segments GROUP BY cell, level",
    "slice_segments": f"{segments_sql(32)} SELECT cell, level AS elevation, count(*) AS n_segments, {_CLASS.format('level')} FROM segments GROUP BY cell, level",
    "contour_counts": f"{_SEG} SELECT cell, level, count(*) AS n_segments FROM segments GROUP BY cell, level",
    "split_ways": """WITH a AS (SELECT l_orderkey % 500 AS line, list_sort(list_distinct(list(l_partkey % 97))) AS a FROM lineitem GROUP BY 1),
p AS (SELECT line, CASE WHEN line % 3 = 0 THEN list_concat(a, a[1:1]) ELSE a END AS xs FROM a),
s AS (SELECT line, xs, unnest(range(0, len(xs) - 1, 6)) AS p0 FROM p WHERE len(xs) >= 2),
c AS (SELECT line, p0 // 6 AS piece, xs[p0 + 1:p0 + 7] AS part FROM s)
SELECT line, piece, len(part) AS points, part[1] AS first_x, part[-1] AS last_x, part[1] = part[-1] AS closed FROM c""",
    "xyz_dump": f"{W} SELECT cell, printf('%.7f %.7f %d', {_LON}, {_LAT}, z) AS line FROM dem WHERE z IS NOT NULL",
    "reproject_points": f"{W} SELECT cell, i, j, {_near.format(_X + ' * 1e3')} AS x_mm, {_near.format(_Y + ' * 1e3')} AS y_mm, {_near.format(_LON + ' * 1e7')} AS lon_e7, {_near.format(_LAT + ' * 1e7')} AS lat_e7 FROM dem WHERE z IS NOT NULL",
    "reproject_bbox": f"{W}, b AS (SELECT DISTINCT cell, 6.0::DOUBLE + file_seq % 2 AS a, 43.0::DOUBLE + file_seq // 2 AS c FROM dem) SELECT cell, "
    + ", ".join(f"{_near.format(e)} AS {n}" for n, e in (("min_x_mm", "a * (pi() / 180.0) * 6378137.0 * 1e3"), ("min_y_mm", "ln(tan(pi() / 4 + c * (pi() / 360.0))) * 6378137.0 * 1e3"), ("max_x_mm", "(a + 1) * (pi() / 180.0) * 6378137.0 * 1e3"), ("max_y_mm", "ln(tan(pi() / 4 + (c + 1) * (pi() / 360.0))) * 6378137.0 * 1e3")))
    + " FROM b",
    "contour_lines": f"""{_LINES}
SELECT f.cell, f.level, row_number() OVER (PARTITION BY f.cell, f.level ORDER BY closed, start) - 1 AS line, closed, points::BIGINT AS points, CAST(floor(d.x * 1e6) AS BIGINT) AS x_e6, CAST(floor(d.y * 1e6) AS BIGINT) AS y_e6
FROM found f JOIN degrees d ON d.cell = f.cell AND d.level = f.level AND d.k = f.start""",
    # Each stretch with the point farthest from its chord; stretches where that is too far are parted there.
    "rdp_simplify": f"""{_LINES},
stops AS (SELECT w.cell, w.level, w.start, w.s0, w.k, w.points AS n FROM walk w SEMI JOIN found f ON f.cell = w.cell AND f.level = w.level AND f.start = w.start AND f.s0 = w.s0 AND NOT f.closed
  UNION ALL SELECT w.cell, w.level, w.start, w.s0, w.k, w.points FROM turn w SEMI JOIN found f ON f.cell = w.cell AND f.level = w.level AND f.start = w.start AND f.s0 = w.s0 AND f.closed
  UNION ALL SELECT cell, level, start, s0, start, 1 FROM found),
shapes AS (SELECT p.cell, p.level, p.start, list(d.x ORDER BY n) AS xs, list(d.y ORDER BY n) AS ys FROM stops p JOIN degrees d ON d.cell = p.cell AND d.level = p.level AND d.k = p.k GROUP BY ALL),
numbered_shapes AS (SELECT *, row_number() OVER () AS id FROM shapes),
parts AS (SELECT id, xs, ys, 1::BIGINT AS a, len(xs)::BIGINT AS b, {_AWAY.format(a='1', b='len(xs)')} AS d FROM numbered_shapes
  UNION ALL SELECT id, xs, ys, a2, b2, {_AWAY.format(a='a2', b='b2')} FROM (
    SELECT id, xs, ys, CASE WHEN h = 0 THEN a ELSE a + list_position(d, list_max(d)) END AS a2, CASE WHEN h = 0 THEN a + list_position(d, list_max(d)) ELSE b END AS b2 FROM parts, (VALUES (0), (1)) v(h) WHERE list_max(d) > 0.1) halves),
kept AS (SELECT id, count(*) + 1 AS n FROM parts WHERE coalesce(list_max(d), 0) <= 0.1 GROUP BY id)
SELECT cell, level, CAST(sum(n - CASE WHEN xs[1] = xs[-1] AND ys[1] = ys[-1] THEN 1 ELSE 0 END) AS BIGINT) AS nodes, count(*) AS ways FROM numbered_shapes JOIN kept USING (id) GROUP BY cell, level""",
}
