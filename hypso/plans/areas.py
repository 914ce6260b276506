"""Queries on polygons, cell names, bounding boxes and source catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import polygon
from ..sources import catalog, connectors
from ..sources.dem import dem, dem_sql, header

R = "(0.10::DOUBLE + (n_nationkey % 5) * 0.05::DOUBLE)"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_rings(spark, sf_dir):
    """A diamond for each nation within the derived raster."""
    return _rings(spark, sf_dir, "6.0D + (n_nationkey * 37 % 100) / 50.0D", "43.0D + (n_nationkey * 53 % 100) / 50.0D", "0.10D + (n_nationkey % 5) * 0.05D")


def large_rings(spark, sf_dir):
    """A diamond of some degrees for each nation."""
    return _rings(spark, sf_dir, "(n_nationkey * 37 % 60) - 30 + 0.25D", "(n_nationkey * 53 % 60) - 30 + 0.5D", "1.3D + n_nationkey % 4")


def _rings(spark, sf_dir, x, y, r):
    base = _table(spark, sf_dir, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS ring", f"{x} AS cx", f"{y} AS cy", f"{r} AS r")
    points = base.selectExpr("ring", "posexplode(array(struct(cx - r AS x, cy AS y), struct(cx AS x, cy + r AS y), struct(cx + r AS x, cy AS y), struct(cx AS x, cy - r AS y), struct(cx - r AS x, cy AS y))) AS (seq, p)")
    return points.select("ring", F.col("seq").cast("long").alias("seq"), F.col("p.x").cast("double").alias("x"), F.col("p.y").cast("double").alias("y"))


def _masked(spark, sf_dir):
    d = dem(spark, sf_dir)
    return polygon.polygon_mask(d, header(d), small_rings(spark, sf_dir))


def polygon_mask(spark, sf_dir):
    return _masked(spark, sf_dir).select("cell", "i", "j", "outside")


def polygon_tile_state(spark, sf_dir):
    return polygon.tile_state(_masked(spark, sf_dir))


def polygon_cells(spark, sf_dir):
    return polygon.crossed_cells(large_rings(spark, sf_dir)).select("ring", "cell")


def files_needed(spark, sf_dir):
    rings = large_rings(spark, sf_dir)
    boxes = rings.groupBy("ring").agg(F.floor(F.min("x")).alias("left"), F.floor(F.min("y")).alias("bottom"), F.ceil(F.max("x")).alias("right"), F.ceil(F.max("y")).alias("top"))
    return polygon.files_needed(boxes, rings)


def _places(spark, sf_dir):
    """A latitude and a longitude for each customer."""
    return _table(spark, sf_dir, "customer").selectExpr("c_custkey AS k", "c_custkey * 7 % 180 - 90 AS lat", "c_custkey * 13 % 360 - 180 AS lon", "c_acctbal / 50.0D AS v")


def cell_names(spark, sf_dir):
    name = S.cell_name(F.col("lat"), F.col("lon"))
    return _places(spark, sf_dir).select("k", name.alias("cell"), S.cell_lat(name).alias("lat"), S.cell_lon(F.lower(name)).alias("lon"))


def hgt_name_bbox(spark, sf_dir):
    p = _places(spark, sf_dir).select("k", F.concat(F.when(F.col("k") % 2 == 0, F.lower(S.cell_name(F.col("lat"), F.col("lon")))).otherwise(S.cell_name(F.col("lat"), F.col("lon"))), F.lit(".hgt")).alias("file"))
    return p.select("k", "file", *catalog.name_bbox(F.col("file")))


def hgt_area(spark, sf_dir):
    p = hgt_name_bbox(spark, sf_dir)
    return p.agg(F.min("min_lon").alias("min_lon"), F.min("min_lat").alias("min_lat"), F.max("max_lon").alias("max_lon"), F.max("max_lat").alias("max_lat"))


def int_rounding(spark, sf_dir):
    v = F.col("v")
    return _places(spark, sf_dir).select("k", S.low_int(v).alias("low"), S.high_int(v).alias("high"), S.close_int(v).alias("close"), F.size(S.whole_numbers(F.least(v, v / 2), F.greatest(v, v / 2))).cast("long").alias("n_range"), S.floor_multiple(F.col("lat"), 5).alias("five"), S.close_int(F.col("lat") / 2.0).alias("half"))


def calc_bbox(spark, sf_dir):
    p = _places(spark, sf_dir).withColumn("area", F.concat_ws(":", S.fixed(F.col("v"), 4), S.fixed(F.col("v") / 3, 4), S.fixed(F.col("v") + 1.5, 4), S.fixed(F.col("v") / 3 + 2, 4)))
    return p.select("k", "area", *catalog.whole_bbox(F.col("area"), 0.25, -0.125))


def alos_url(spark, sf_dir):
    return _places(spark, sf_dir).select("k", catalog.grouped_url(S.cell_name(F.col("lat"), F.col("lon"))).alias("url"))


def output_names(spark, sf_dir):
    s = _table(spark, sf_dir, "supplier")
    lon, lat = F.col("s_suppkey") % 300 - 150 + (F.col("s_suppkey") % 8) / 8.0, F.col("s_suppkey") % 120 - 60 + (F.col("s_suppkey") % 16) / 16.0
    sources = F.array_distinct(F.array(F.when(F.col("s_suppkey") % 2 == 0, "view1").otherwise("sonn3"), F.when(F.col("s_suppkey") % 3 == 0, "srtm3").otherwise("view3")))
    name = catalog.output_name(F.lit("out_"), lon, lat, lon + 1, lat + 0.25, sources, F.array(F.lit("view3"), F.lit("view1"), F.lit("srtm3"), F.lit("sonn3")), ".osm.pbf")
    return s.select("s_suppkey", name.alias("name"))


def bounds_tag(spark, sf_dir):
    s = _table(spark, sf_dir, "supplier")
    lon, lat = F.col("s_suppkey") % 300 - 150 + F.col("s_suppkey") / 7.0, F.col("s_suppkey") % 120 - 60 + F.col("s_suppkey") / 9.0
    return s.select("s_suppkey", catalog.bounds_tag(lon, lat, lon + 1.0, lat + 1.0).alias("tag"))


def _wanted(spark, sf_dir):
    return spark.range(0, 400).select(F.concat(F.lit("N"), F.format_string("%02d", (F.col("id") / 20).cast("long") + 30), F.lit("E"), F.format_string("%03d", F.col("id") % 20)).alias("cell"), F.col("id").alias("n"))


def _held(spark, sf_dir):
    """What each source has: (nick, cell)."""
    s = _table(spark, sf_dir, "supplier")
    nick = F.element_at(F.array(*map(F.lit, connectors.NICKS)), (F.col("s_suppkey") % len(connectors.NICKS) + 1).cast("int"))
    at = (F.col("s_suppkey") * 31 + F.col("s_nationkey") * 7) % 400
    return s.select(nick.alias("nick"), F.concat(F.lit("N"), F.format_string("%02d", (at / 20).cast("long") + 30), F.lit("E"), F.format_string("%03d", at % 20)).alias("cell")).distinct()


def source_preference(spark, sf_dir):
    return catalog.preferred(_wanted(spark, sf_dir).select("cell"), _held(spark, sf_dir), ["view1", "sonn3", "srtm3"])


def source_options(spark, sf_dir):
    return connectors.options(spark)


def index_lookup(spark, sf_dir):
    index = _held(spark, sf_dir).select(F.concat(F.lit("http://host/"), "nick", F.lit("/"), F.substring("cell", 1, 3), F.lit(".zip")).alias("url"), "cell")
    return catalog.lookup(_wanted(spark, sf_dir).select("cell"), index).withColumn("urls", F.array_join("urls", " "))


def cache_validate(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(3).cast("long").alias("resolution"), F.when(F.col("o_orderkey") % 5 == 0, 7).otherwise(0).alias("d"), F.when(F.col("o_orderkey") % 7 == 0, "tif").otherwise("hgt").alias("ext"))
    size = catalog.raster_bytes(F.col("resolution")) - F.col("d")
    return o.select("o_orderkey", "resolution", "ext", size.alias("bytes"), catalog.valid_cache(F.col("ext"), size, F.col("resolution")).alias("valid"))


def _index_text(spark, sf_dir):
    """Index files as lines, one for each region: a comment, headers and cells."""
    n = _table(spark, sf_dir, "nation")
    lines = F.concat(F.array(F.concat(F.lit("[http://host/"), "n_name", F.lit("]"))), F.transform(F.sequence(F.lit(0), (F.col("n_nationkey") % 4).cast("int")), lambda k: F.concat(F.lit("N"), F.format_string("%02d", k + 40), F.lit("E"), F.format_string("%03d", F.col("n_nationkey")))), F.array(F.lit("# end"), F.lit("")))
    return n.select(F.col("n_regionkey").cast("long").alias("file"), F.col("n_nationkey").alias("part"), F.posexplode(lines).alias("at", "line")).select("file", (F.col("part") * 100 + F.col("at")).cast("long").alias("no"), "line")


def index_sections(spark, sf_dir):
    return catalog.sections(_index_text(spark, sf_dir))


def index_diff(spark, sf_dir):
    a = catalog.sections(_index_text(spark, sf_dir)).select("header", "entry")
    b = a.select("header", F.when(F.col("header").endswith("N_1]") | F.col("header").contains("1"), F.concat("entry", F.lit("x"))).otherwise(F.col("entry")).alias("entry"))
    return catalog.index_diff(a, b)


def coverage_parity(spark, sf_dir):
    hits = _table(spark, sf_dir, "orders").select(S.cell_name(F.col("o_orderkey") % 60 - 30, F.col("o_custkey") % 90 - 45).alias("cell"))
    return catalog.odd_ones(hits)


def imagemap_index(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages")
    area = F.concat(F.lit('<area shape="rect" coords="'), F.concat_ws(",", F.col("page_id") % 1700, F.col("page_id") % 850, F.col("page_id") % 1700 + 40, F.col("page_id") % 850 + 20), F.lit('" href="http://host/m'), (F.col("page_id") % 17).cast("string"), F.lit('.zip">'))
    return catalog.image_map(pages.select(F.concat("html", area).alias("html"))).select("url", "cell")


def page_links(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages")
    return pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"]*)"'), F.lit(1))).alias("href")).groupBy("href").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("page_id").alias("pages"))


QUERIES = {f.__name__: f for f in (polygon_mask, polygon_tile_state, polygon_cells, files_needed, cell_names, hgt_name_bbox, hgt_area, int_rounding, calc_bbox, alos_url, output_names, bounds_tag, source_preference, source_options, index_lookup, cache_validate, index_sections, index_diff, coverage_parity, imagemap_index, page_links)}


def rings_sql(x: str, y: str, r: str) -> str:
    points = ", ".join(f"({k}, {a}, {b})" for k, a, b in ((0, "-1", "0"), (1, "0", "1"), (2, "1", "0"), (3, "0", "-1"), (4, "-1", "0")))
    return f"""c AS (SELECT n_nationkey::BIGINT AS ring, ({x})::DOUBLE AS cx, ({y})::DOUBLE AS cy, ({r})::DOUBLE AS r FROM nation),
rings AS (SELECT ring, seq, cx + dx * r AS x, cy + dy * r AS y FROM c, (VALUES {points}) v(seq, dx, dy)),
edges AS (SELECT * FROM (SELECT ring, lag(x) OVER w AS x1, lag(y) OVER w AS y1, x AS x2, y AS y2 FROM rings WINDOW w AS (PARTITION BY ring ORDER BY seq)) WHERE x1 IS NOT NULL)"""


_SMALL = rings_sql("6.0 + (n_nationkey * 37 % 100) / 50.0::DOUBLE", "43.0 + (n_nationkey * 53 % 100) / 50.0::DOUBLE", "0.10 + (n_nationkey % 5) * 0.05::DOUBLE")
_LARGE = rings_sql("(n_nationkey * 37 % 60) - 30 + 0.25", "(n_nationkey * 53 % 60) - 30 + 0.5", "1.3 + n_nationkey % 4")
_LON, _LAT = "(6.0::DOUBLE + file_seq % 2 + j * (1.0::DOUBLE / 63))", "(44.0::DOUBLE + file_seq // 2 - i * (1.0::DOUBLE / 63))"
_MASK = f"""WITH {dem_sql()}, {_SMALL},
points AS (SELECT cell, i, j, {_LON} AS px, {_LAT} AS py FROM dem),
hits AS (SELECT cell, i, j, ring FROM points JOIN edges ON (y1 > py) <> (y2 > py) AND px < (x2 - x1) * (py - y1) / (y2 - y1) + x1 GROUP BY cell, i, j, ring HAVING count(*) % 2 = 1),
masked AS (SELECT p.cell, p.i, p.j, h.cell IS NULL AS outside FROM points p LEFT JOIN (SELECT DISTINCT cell, i, j FROM hits) h ON p.cell = h.cell AND p.i = h.i AND p.j = h.j)"""


def name_sql(lat: str, lon: str) -> str:
    return f"(CASE WHEN {lat} < 0 THEN 'S' ELSE 'N' END || printf('%02d', abs({lat})::BIGINT) || CASE WHEN {lon} < 0 THEN 'W' ELSE 'E' END || printf('%03d', abs({lon})::BIGINT))"


_CELLS = f"""{_LARGE},
e AS (SELECT *, CASE WHEN x1 <> x2 THEN (y2 - y1) / (x2 - x1) END AS s FROM edges), eo AS (SELECT *, y1 - x1 * s AS o FROM e),
gx AS (SELECT *, unnest(range(ceil(least(x1, x2))::BIGINT, ceil(greatest(x1, x2))::BIGINT)) AS g FROM eo WHERE x1 <> x2 AND y1 <> y2),
gy AS (SELECT *, unnest(range(ceil(least(y1, y2))::BIGINT, ceil(greatest(y1, y2))::BIGINT)) AS g FROM eo WHERE x1 <> x2 AND y1 <> y2),
crossed AS (SELECT ring, floor(x2)::BIGINT AS lon, floor(y2)::BIGINT AS lat FROM eo
  UNION SELECT ring, g + d, floor(s * g + o)::BIGINT FROM gx, (VALUES (-1), (0)) v(d) UNION SELECT ring, floor((g - o) / s)::BIGINT, g + d FROM gy, (VALUES (-1), (0)) v(d))"""
_PLACES = "p AS (SELECT c_custkey AS k, c_custkey * 7 % 180 - 90 AS lat, c_custkey * 13 % 360 - 180 AS lon, c_acctbal / 50.0::DOUBLE AS v FROM customer)"
_NAMES = f"{_PLACES}, f AS (SELECT k, CASE WHEN k % 2 = 0 THEN lower({name_sql('lat', 'lon')}) ELSE {name_sql('lat', 'lon')} END || '.hgt' AS file, lon::DOUBLE AS min_lon, lat::DOUBLE AS min_lat, lon + 1.0::DOUBLE AS max_lon, lat + 1.0::DOUBLE AS max_lat FROM p)"
_NICK = "['alos1', 'sonn1', 'sonn3', 'srtm1', 'srtm3', 'view1', 'view3'][s_suppkey % 7 + 1]"
_AT = "(s_suppkey * 31 + s_nationkey * 7) % 400"
_HELD = f"held AS (SELECT DISTINCT {_NICK} AS nick, 'N' || printf('%02d', {_AT} // 20 + 30) || 'E' || printf('%03d', {_AT} % 20) AS cell FROM supplier), wanted AS (SELECT 'N' || printf('%02d', x // 20 + 30) || 'E' || printf('%03d', x % 20) AS cell FROM range(400) t(x))"
_INDEX = """lines AS (SELECT n_regionkey::BIGINT AS file, n_nationkey * 100 + k AS no, CASE WHEN k = 0 THEN '[http://host/' || n_name || ']' ELSE 'N' || printf('%02d', k - 1 + 40) || 'E' || printf('%03d', n_nationkey) END AS line
  FROM nation, range(5) t(k) WHERE k <= n_nationkey % 4 + 1),
filled AS (SELECT file, line, last_value(CASE WHEN line[1] = '[' THEN line END IGNORE NULLS) OVER (PARTITION BY file ORDER BY no) AS header FROM lines),
sections AS (SELECT file, header, line AS entry FROM filled WHERE line[1] <> '[')"""
_BB = "concat('_lon', {0}, '_', {1}, 'lat', {2}, '_', {3})"
_SLON, _SLAT = "(s_suppkey % 300 - 150 + (s_suppkey % 8) / 8.0::DOUBLE)", "(s_suppkey % 120 - 60 + (s_suppkey % 16) / 16.0::DOUBLE)"
_SOURCES = "['view1', 'view3', 'srtm3', 'sonn3']"
_TLON, _TLAT = "(s_suppkey % 300 - 150 + s_suppkey / 7.0::DOUBLE)", "(s_suppkey % 120 - 60 + s_suppkey / 9.0::DOUBLE)"
ORACLE = {
    "polygon_mask": f"{_MASK} SELECT cell, i, j, outside FROM masked",
    "polygon_tile_state": f"{_MASK}, t AS (SELECT cell, count(*) FILTER (WHERE outside) AS n_outside, count(*) AS n FROM masked GROUP BY cell) SELECT *, CASE WHEN n_outside = 0 THEN 'none' WHEN n_outside = n THEN 'all' ELSE 'mixed' END AS state FROM t",
    "polygon_cells": f"WITH {_CELLS} SELECT DISTINCT ring, {name_sql('lat', 'lon')} AS cell FROM crossed",
    "files_needed": f"""WITH {_CELLS},
boxes AS (SELECT ring, floor(min(x))::BIGINT AS l, floor(min(y))::BIGINT AS b, ceil(max(x))::BIGINT AS r, ceil(max(y))::BIGINT AS t FROM rings GROUP BY ring),
lons AS (SELECT ring, unnest(range(l, r)) AS lon, b, t FROM boxes), cells AS (SELECT ring, lon, unnest(range(b, t)) AS lat FROM lons),
corners AS (SELECT ring, lon, lat, lon + dx AS px, lat + dy AS py FROM cells, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(dx, dy)),
ins AS (SELECT ring, lon, lat, px, py FROM corners JOIN edges USING (ring) WHERE (y1 > py) <> (y2 > py) AND px < (x2 - x1) * (py - y1) / (y2 - y1) + x1 GROUP BY ALL HAVING count(*) % 2 = 1),
n AS (SELECT ring, lon, lat, count(*) AS k FROM ins GROUP BY ALL)
SELECT c.ring, {name_sql('c.lat', 'c.lon')} AS cell, x.ring IS NOT NULL OR coalesce(n.k, 0) < 4 AS "check" FROM cells c LEFT JOIN (SELECT DISTINCT ring, lon, lat FROM crossed) x ON c.ring = x.ring AND c.lon = x.lon AND c.lat = x.lat
LEFT JOIN n ON c.ring = n.ring AND c.lon = n.lon AND c.lat = n.lat WHERE x.ring IS NOT NULL OR n.k > 0""",
    "cell_names": f"WITH {_PLACES} SELECT k, {name_sql('lat', 'lon')} AS cell, lat, lon FROM p",
    "hgt_name_bbox": f"WITH {_NAMES} SELECT * FROM f",
    "hgt_area": f"WITH {_NAMES} SELECT min(min_lon) AS min_lon, min(min_lat) AS min_lat, max(max_lon) AS max_lon, max(max_lat) AS max_lat FROM f",
    "int_rounding": f"WITH {_PLACES} SELECT k, floor(v)::BIGINT AS low, ceil(v)::BIGINT AS high, (CASE WHEN ceil(v) - v < v - floor(v) THEN ceil(v) ELSE floor(v) END)::BIGINT AS close, greatest(0, ceil(greatest(v, v / 2)) - ceil(least(v, v / 2)))::BIGINT AS n_range, (floor(lat / 5.0::DOUBLE) * 5)::BIGINT AS five, (CASE WHEN lat % 2 = 0 THEN lat / 2.0 ELSE (lat - 1) / 2.0 END)::BIGINT AS half FROM p",
    "calc_bbox": f"WITH {_PLACES}, a AS (SELECT k, printf('%.4f', v) || ':' || printf('%.4f', v / 3) || ':' || printf('%.4f', v + 1.5) || ':' || printf('%.4f', v / 3 + 2) AS area FROM p), b AS (SELECT *, string_split(area, ':') AS q FROM a) SELECT k, area, floor(q[1]::DOUBLE - 0.25)::BIGINT AS min_lon, floor(q[2]::DOUBLE + 0.125)::BIGINT AS min_lat, ceil(q[3]::DOUBLE - 0.25)::BIGINT AS max_lon, ceil(q[4]::DOUBLE + 0.125)::BIGINT AS max_lat FROM b",
    "alos_url": f"WITH {_PLACES}, g AS (SELECT k, lat, lon, (floor(lat / 5.0::DOUBLE) * 5)::BIGINT AS a, (floor(lon / 5.0::DOUBLE) * 5)::BIGINT AS o FROM p) SELECT k, 'https://tiles.example/' || {name_sql('a', 'o').replace('%02d', '%03d')} || '/' || {name_sql('lat', 'lon').replace('%02d', '%03d')} || '.zip' AS url FROM g",
    "output_names": f"SELECT s_suppkey, 'out_lon' || printf('%.2f', {_SLON}) || '_' || printf('%.2f', {_SLON} + 1) || 'lat' || printf('%.2f', {_SLAT}) || '_' || printf('%.2f', {_SLAT} + 0.25) || '_' || array_to_string(list_filter(['view3', 'view1', 'srtm3', 'sonn3'], lambda s: list_contains([CASE WHEN s_suppkey % 2 = 0 THEN 'view1' ELSE 'sonn3' END, CASE WHEN s_suppkey % 3 = 0 THEN 'srtm3' ELSE 'view3' END], s)), ',') || '.osm.pbf' AS name FROM supplier",
    "bounds_tag": "SELECT s_suppkey, '<bounds minlat=\"' || printf('%.7f', {1}) || '\" minlon=\"' || printf('%.7f', {0}) || '\" maxlat=\"' || printf('%.7f', {1} + 1.0) || '\" maxlon=\"' || printf('%.7f', {0} + 1.0) || '\"/>' AS tag FROM supplier".format(_TLON, _TLAT),
    "source_preference": f"WITH {_HELD}, pref AS (SELECT * FROM (VALUES ('view1', 1), ('sonn3', 2), ('srtm3', 3)) v(nick, p)), best AS (SELECT cell, arg_min(nick, p) AS nick FROM held JOIN pref USING (nick) GROUP BY cell) SELECT cell, nick FROM wanted LEFT JOIN best USING (cell)",
    "source_options": "SELECT * FROM (VALUES ('alos', 1::BIGINT, 'alos1'), ('sonn', 1, 'sonn1'), ('sonn', 3, 'sonn3'), ('srtm', 1, 'srtm1'), ('srtm', 3, 'srtm3'), ('view', 1, 'view1'), ('view', 3, 'view3')) v(nick, resolution, option)",
    "index_lookup": f"WITH {_HELD}, idx AS (SELECT 'http://host/' || nick || '/' || cell[1:3] || '.zip' AS url, cell FROM held) SELECT cell, string_agg(DISTINCT url, ' ' ORDER BY url) AS urls, min(url) AS first_url, count(DISTINCT url) AS n_urls FROM wanted JOIN idx USING (cell) GROUP BY cell",
    "cache_validate": "WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 3 END::BIGINT AS resolution, CASE WHEN o_orderkey % 5 = 0 THEN 7 ELSE 0 END AS d, CASE WHEN o_orderkey % 7 = 0 THEN 'tif' ELSE 'hgt' END AS ext FROM orders), b AS (SELECT *, 2 * (3600 // resolution + 1) * (3600 // resolution + 1) AS full_ FROM o) SELECT o_orderkey, resolution, ext, (full_ - d)::BIGINT AS bytes, ext <> 'hgt' OR d = 0 AS valid FROM b",
    "index_sections": f"WITH {_INDEX} SELECT file, header, entry FROM sections",
    "index_diff": f"WITH {_INDEX} SELECT header, NOT contains(header, '1') AS same FROM (SELECT DISTINCT header FROM sections)",
    "coverage_parity": f"WITH h AS (SELECT {name_sql('(o_orderkey % 60 - 30)', '(o_custkey % 90 - 45)')} AS cell FROM orders) SELECT cell, count(*) AS n FROM h GROUP BY cell HAVING count(*) % 2 = 1",
    "imagemap_index": f"WITH a AS (SELECT DISTINCT 'http://host/m' || page_id % 17 || '.zip' AS url, page_id % 1700 AS l, page_id % 850 AS t FROM pages), b AS (SELECT url, trunc(l / 5.0 + 0.5)::BIGINT - 180 AS w, trunc((l + 40) / 5.0 + 0.5)::BIGINT - 180 AS e, 90 - trunc((t + 20) / 5.0 + 0.5)::BIGINT AS s, 90 - trunc(t / 5.0 + 0.5)::BIGINT AS n FROM a), c AS (SELECT url, unnest(range(w, e)) AS lon, s, n FROM b), d AS (SELECT url, lon, unnest(range(s, n)) AS lat FROM c) SELECT DISTINCT url, {name_sql('lat', 'lon')} AS cell FROM d",
    "page_links": "WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1)) AS href FROM pages) SELECT href, count(*) AS n, count(DISTINCT page_id) AS pages FROM l GROUP BY href",
}
