"""Queries on map elements and files, with SQL that states the same for another engine.

The lines are the contour segments of the coarse derived grid: open ways of two points, or rings
of two nodes where i + j is a multiple of five.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from .. import sinks
from ..functions import scalars as S
from ..operators import bands, osm, polygon
from ..sinks import counts, o5m, pbf
from ..sources import made, rasters
from ..sources.dem import SIDE, dem, dem_sql, header
from .areas import _SMALL, small_rings
from .terrain import STEP, segments_sql

N, GENERATOR = 32, "hypso"


def _pieces(spark, sf_dir):
    d = dem(spark, sf_dir, N)
    at = bands.segments(bands.packed(d, N), STEP).drop("file_seq").join(F.broadcast(header(d, N)), "cell")
    lon, lat = (lambda x: F.col("min_lon") + F.col(x) * F.col("inc")), (lambda y: F.col("max_lat") - F.col(y) * F.col("inc"))
    closed = (F.col("i") + F.col("j")) % 5 == 0
    ends = lambda a, b: F.when(closed, F.array(a, b, a)).otherwise(F.array(a, b))
    line = ((F.col("i") * N + F.col("j")) * 2 + F.col("seg")).alias("line")
    return at.select(F.col("file_seq").alias("tile_seq"), "level", line, F.lit(0).cast("long").alias("piece"), closed.alias("closed"), ends(lon("x1"), lon("x2")).alias("lons"), ends(lat("y1"), lat("y2")).alias("lats"))


def _ways(spark, sf_dir):
    return osm.ways(_pieces(spark, sf_dir))


def id_allocation(spark, sf_dir):
    return osm.tile_starts(_pieces(spark, sf_dir))


def osm_nodes(spark, sf_dir):
    return osm.nodes(_ways(spark, sf_dir)).select("node_id", F.floor(F.col("lon") * 1e6).alias("lon_e6"), F.floor(F.col("lat") * 1e6).alias("lat_e6"))


def osm_ways(spark, sf_dir):
    return _ways(spark, sf_dir).select("way_id", "first_node", "n_nodes", "closed", "level", S.level_class(F.col("level")).alias("class"), F.array_join(osm.refs().cast("array<string>"), ",").alias("refs"))


def osm_xml_nodes(spark, sf_dir):
    return osm.nodes(_ways(spark, sf_dir)).select("node_id", osm.node_xml().alias("xml"))


def osm_xml_ways(spark, sf_dir):
    return _ways(spark, sf_dir).select("way_id", osm.way_xml().alias("xml"))


def osm_elements(spark, sf_dir):
    return osm.elements(_ways(spark, sf_dir)).select("tile_seq", F.col("kind").cast("long").alias("kind"), "id", F.md5("xml").alias("digest"))


def osm_stats(spark, sf_dir):
    return osm.stats(osm.elements(_ways(spark, sf_dir))).withColumn("kind", F.when(F.col("kind") == 0, "node").otherwise("way"))


def coord_quantise(spark, sf_dir):
    return osm.nodes(_ways(spark, sf_dir)).select("node_id", S.quantised(F.col("lon")).alias("lon_units"), S.quantised(F.col("lat")).alias("lat_units"), S.fixed(F.col("lon"), 7).alias("lon_text"), S.fixed(F.col("lat"), 7).alias("lat_text"))


def varint_encode(spark, sf_dir):
    n = F.col("event_id") * 7919 - F.col("user_id") * 31
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", n.alias("n"))
    return e.select("event_id", S.varint_hex(S.zigzag(F.col("n"))).alias("signed_hex"), S.varint_hex(F.abs("n")).alias("unsigned_hex"))


def o5m_node_deltas(spark, sf_dir):
    from pyspark.sql import Window

    units = osm.nodes(_ways(spark, sf_dir)).select("tile_seq", "node_id", S.quantised(F.col("lon")).alias("x"), S.quantised(F.col("lat")).alias("y"))
    w = Window.partitionBy("tile_seq").orderBy("node_id")
    step = lambda c: S.varint_hex(S.zigzag(F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0))))
    return units.select("node_id", step("node_id").alias("id_hex"), step("x").alias("lon_hex"), step("y").alias("lat_hex"))


def osm_timestamp(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", S.osm_timestamp(F.col("ts")).alias("stamp"))


def _files(spark, sf_dir, kind):
    boxes = header(dem(spark, sf_dir, N), N).withColumnRenamed("file_seq", "tile_seq")
    return sinks.files(_ways(spark, sf_dir), boxes, kind, generator=GENERATOR)


def xml_sink(spark, sf_dir):
    """Whole files, by their digests."""
    return _files(spark, sf_dir, "xml").select("tile_seq", F.length("content").cast("long").alias("bytes"), F.md5("content").alias("digest"))


def _decoded(spark, sf_dir, kind):
    read = {"pbf": pbf.decode, "o5m": o5m.decode}[kind]

    def run(batches):
        for pdf in batches:
            out = []
            for seq, content in zip(pdf["tile_seq"], pdf["content"], strict=True):
                nodes, ways, _ = read(bytes(content))
                out.append((seq, len(nodes), len(ways), sum(nodes), sum(ways), sum(sum(refs) for refs, _ in ways.values()), sum(int(tags[0][1]) for _, tags in ways.values()), sum(tags[2][1] == "elevation_major" for _, tags in ways.values())))
            yield pd.DataFrame(out, columns=["tile_seq", "nodes", "ways", "node_ids", "way_ids", "refs", "levels", "major"])

    return _files(spark, sf_dir, kind).mapInPandas(run, "tile_seq long, nodes long, ways long, node_ids long, way_ids long, refs long, levels long, major long")


def pbf_sink(spark, sf_dir):
    """Files written and read again."""
    return _decoded(spark, sf_dir, "pbf")


def o5m_sink(spark, sf_dir):
    return _decoded(spark, sf_dir, "o5m")


def file_counts(spark, sf_dir):
    """Elements of whole files of each kind, read again."""
    named = lambda kind: _files(spark, sf_dir, kind).select(F.concat(F.col("tile_seq").cast("string"), F.lit(sinks.SUFFIX[kind])).alias("path"), "content")
    return counts.counted(named("xml").union(named("pbf")).union(named("o5m")))


def o5m_string_table(spark, sf_dir):
    """What stands for each of a sequence of strings, in hex."""
    def run(batches):
        table = o5m.Strings()  # one for all batches of the one partition
        for pdf in batches:
            yield pd.DataFrame({"k": pdf["k"], "hex": [table.add(s.encode()).hex() for s in pdf["s"]]})

    words = spark.range(0, 2000, 1, 1).select(F.col("id").alias("k"), F.concat(F.lit("s"), F.col("id") * F.col("id") % 97).alias("s"))
    return words.mapInPandas(run, "k long, hex string")


def _scanned(spark, sf_dir, files):
    at = rasters.samples(files).join(rasters.headers(files), "path")
    e6 = lambda x: F.floor(F.round(x * 1e6, 3) + 0.5).cast("long")
    return at.select(F.substring("path", 1, 7).alias("cell"), "i", "j", F.coalesce("z", F.lit(-9999.0)).cast("long").alias("z"), e6(F.col("x0") + F.col("j") * F.col("dx")).alias("lon_e6"), e6(F.col("y0") + F.col("i") * F.col("dy")).alias("lat_e6"))


def hgt_scan(spark, sf_dir):
    return _scanned(spark, sf_dir, made.files_of(dem(spark, sf_dir), SIDE, "hgt"))


def geotiff_scan(spark, sf_dir):
    return _scanned(spark, sf_dir, made.files_of(dem(spark, sf_dir), SIDE, "tif"))


def geotiff_bbox(spark, sf_dir):
    """Boxes of files in metres, turned back into degrees."""
    h = rasters.headers(made.files_of(dem(spark, sf_dir), SIDE, "mercator"))
    e7 = lambda x: F.floor(x * 1e7 + 0.5)
    lon, lat = (lambda k: S.unmercator_lon(F.col("x0") + F.col("dx") * k)), (lambda k: S.unmercator_lat(F.col("y0") + F.col("dy") * k))
    return h.select(F.substring("path", 1, 7).alias("cell"), "epsg", e7(lon(F.lit(0))).alias("min_lon_e7"), e7(lat(F.col("n_rows") - 1)).alias("min_lat_e7"), e7(lon(F.col("n_cols") - 1)).alias("max_lon_e7"), e7(lat(F.lit(0))).alias("max_lat_e7"))


def zip_members(spark, sf_dir):
    found = rasters.zip_members(made.files_of(dem(spark, sf_dir), SIDE, "zip"))
    z = rasters.samples(found.select(F.lower("path").alias("path"), "content"))
    sums = z.groupBy("path").agg(F.count("z").alias("samples"), F.sum("z").cast("long").alias("sum_z"))
    return sums.withColumn("path", F.upper("path"))


def supersample(spark, sf_dir):
    files = made.files_of(dem(spark, sf_dir, N), N, "hgt")
    return rasters.samples(files, void_max=-1_000, zoom=(2 * N - 1) / N)


def supersample_knots(spark, sf_dir):
    """Where the finer grid has the points of the coarse one, it has their samples."""
    return supersample(spark, sf_dir).where("i % 2 = 0 AND j % 2 = 0 AND z IS NOT NULL").select(F.substring("path", 1, 7).alias("cell"), (F.col("i") / 2).cast("long").alias("i"), (F.col("j") / 2).cast("long").alias("j"), F.col("z").cast("long").alias("z"))


def poly_scan(spark, sf_dir):
    """Areas of polygon files, one for each region, with a ring for each nation."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    point = lambda x, y: F.format_string("   %.6E   %.6E", F.lit(0.0) + x, F.lit(0.0) + y)
    k = F.col("n_nationkey")
    lines = F.array(k.cast("string"), point(k - 12, k * 2 - 20), point(k - 10, k * 2 - 19), F.lit("   bad 7"), point(k - 11, k * 2 - 17), F.lit("END"))
    rows = n.select(F.col("n_regionkey").cast("long").alias("file"), "n_nationkey", F.posexplode(lines).alias("at", "line")).select("file", (F.col("n_nationkey") * 10 + F.col("at")).cast("long").alias("no"), "line")
    return rasters.extent(rasters.polygons(rows))


def kml_polygons(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    k = F.col("n_nationkey").cast("string")
    text = F.concat(F.lit('<kml xmlns="http://www.opengis.net/kml/2.2"><Placemark><Polygon><outerBoundaryIs><LinearRing><coordinates>\n 1.5,'), k, F.lit(",0 2.5,"), k, F.lit(",0\n 2.5,9,0 </coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark></kml>"))
    rings = rasters.kml_rings(n.select("n_nationkey", text.alias("kml")).select("kml"))
    return rings.groupBy("seq").agg(F.sum("x").alias("sum_x"), F.sum("y").alias("sum_y"), F.count(F.lit(1)).alias("n"))


CLIP = (6.4, 43.3, 7.6, 44.5)


def polygon_clip(spark, sf_dir):
    """The corners of the rings' parts within a rectangle, in millionths of a degree."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        found = {p for part in polygon.clip_ring(pdf["x"].tolist(), pdf["y"].tolist(), CLIP) for p in part}
        return pd.DataFrame({"ring": pdf["ring"].iloc[0], "x": [p[0] for p in found], "y": [p[1] for p in found]})

    e6 = lambda c: F.floor(F.col(c) * 1e6 + 0.5).alias(f"{c}_e6")
    return small_rings(spark, sf_dir).groupBy("ring").applyInPandas(run, "ring long, x double, y double").select("ring", e6("x"), e6("y")).distinct()


QUERIES = {f.__name__: f for f in (id_allocation, osm_nodes, osm_ways, osm_xml_nodes, osm_xml_ways, osm_elements, osm_stats, coord_quantise, varint_encode, o5m_node_deltas, osm_timestamp, xml_sink, pbf_sink, o5m_sink, file_counts, o5m_string_table, hgt_scan, geotiff_scan, geotiff_bbox, zip_members, supersample, supersample_knots, poly_scan, kml_polygons, polygon_clip)}

_LON, _LAT = (f"(6.0::DOUBLE + t.file_seq % 2 + {{}} * (1.0::DOUBLE / {N - 1}))", f"(44.0::DOUBLE + t.file_seq // 2 - {{}} * (1.0::DOUBLE / {N - 1}))")
_PIECES = f"""{segments_sql(N)},
tiles AS (SELECT DISTINCT cell, file_seq FROM dem),
pieces AS (SELECT t.file_seq AS tile_seq, s.level, (s.i * {N} + s.j) * 2 + s.seg AS line, (s.i + s.j) % 5 = 0 AS closed,
  {_LON.format('s.x1')} AS lon1, {_LAT.format('s.y1')} AS lat1, {_LON.format('s.x2')} AS lon2, {_LAT.format('s.y2')} AS lat2 FROM segments s JOIN tiles t ON s.cell = t.cell),
ways AS (SELECT *, 10000000 + row_number() OVER (ORDER BY tile_seq, level, line) - 1 AS way_id, 10000000 + 2 * (row_number() OVER (ORDER BY tile_seq, level, line) - 1) AS first_node,
  CASE WHEN level % 200 = 0 THEN 'elevation_major' WHEN level % 100 = 0 THEN 'elevation_medium' ELSE 'elevation_minor' END AS class FROM pieces),
nodes AS (SELECT tile_seq, first_node AS node_id, lon1 AS lon, lat1 AS lat FROM ways UNION ALL SELECT tile_seq, first_node + 1, lon2, lat2 FROM ways),
xml_nodes AS (SELECT tile_seq, node_id, printf('<node id="%d" lat="%.7f" lon="%.7f" version="1"/>', node_id, lat, lon) AS xml FROM nodes),
xml_ways AS (SELECT tile_seq, way_id, '<way id="' || way_id || '" version="1"><nd ref="' || first_node || '"/>' || chr(10) || '<nd ref="' || (first_node + 1) || '"/>' || chr(10)
  || CASE WHEN closed THEN '<nd ref="' || first_node || '"/>' || chr(10) ELSE '' END || '<tag k="ele" v="' || level || '"/><tag k="contour" v="elevation"/><tag k="contour_ext" v="' || class || '"/></way>' AS xml FROM ways),
elements AS (SELECT tile_seq, 0 AS kind, node_id AS id, xml FROM xml_nodes UNION ALL SELECT tile_seq, 1, way_id, xml FROM xml_ways)"""
_UNITS = "CAST(trunc({0} * 1e7) AS BIGINT)"
_ZIGZAG = "(CASE WHEN {0} >= 0 THEN {0} * 2 ELSE -{0} * 2 - 1 END)"
_HEX = "array_to_string([printf('%02x', (({0}) >> (7 * k)) % 128 + CASE WHEN (({0}) >> (7 * k + 7)) > 0 THEN 128 ELSE 0 END) FOR k IN [0, 1, 2, 3, 4, 5, 6, 7] IF k = 0 OR (({0}) >> (7 * k)) > 0], '')"
_hex = lambda n: _HEX.format(f"CAST({_ZIGZAG.format(n)} AS BIGINT)")
_READ = f"{_PIECES} SELECT tile_seq, 2 * count(*) AS nodes, count(*) AS ways, CAST(sum(2 * first_node + 1) AS BIGINT) AS node_ids, CAST(sum(way_id) AS BIGINT) AS way_ids, CAST(sum(2 * first_node + 1 + CASE WHEN closed THEN first_node ELSE 0 END) AS BIGINT) AS refs, CAST(sum(level) AS BIGINT) AS levels, count(*) FILTER (WHERE class = 'elevation_major') AS major FROM ways GROUP BY tile_seq"
_SCAN = f"WITH {dem_sql(SIDE)} SELECT cell, i, j, coalesce(z, -9999) AS z, CAST(floor(round((6 + file_seq % 2 + j / {SIDE - 1}.0::DOUBLE) * 1e6, 3) + 0.5) AS BIGINT) AS lon_e6, CAST(floor(round((44 + file_seq // 2 - i / {SIDE - 1}.0::DOUBLE) * 1e6, 3) + 0.5) AS BIGINT) AS lat_e6 FROM dem"
ORACLE = {
    "id_allocation": f"{_PIECES} SELECT tile_seq, 2 * count(*) AS nodes, count(*) AS ways, min(first_node) AS first_node, min(way_id) AS first_way FROM ways GROUP BY tile_seq",
    "osm_nodes": f"{_PIECES} SELECT node_id, CAST(floor(lon * 1e6) AS BIGINT) AS lon_e6, CAST(floor(lat * 1e6) AS BIGINT) AS lat_e6 FROM nodes",
    "osm_ways": f"{_PIECES} SELECT way_id, first_node, 2::BIGINT AS n_nodes, closed, level, class, first_node || ',' || (first_node + 1) || CASE WHEN closed THEN ',' || first_node ELSE '' END AS refs FROM ways",
    "osm_xml_nodes": f"{_PIECES} SELECT node_id, xml FROM xml_nodes",
    "osm_xml_ways": f"{_PIECES} SELECT way_id, xml FROM xml_ways",
    "osm_elements": f"{_PIECES} SELECT tile_seq, kind::BIGINT AS kind, id, md5(xml) AS digest FROM elements",
    "osm_stats": f"{_PIECES} SELECT CASE WHEN kind = 0 THEN 'node' ELSE 'way' END AS kind, count(*) AS n, min(id) AS first_id, max(id) AS last_id, CAST(sum(strlen(xml) + 1) AS BIGINT) AS bytes FROM elements GROUP BY ALL",
    "coord_quantise": f"{_PIECES} SELECT node_id, {_UNITS.format('lon')} AS lon_units, {_UNITS.format('lat')} AS lat_units, printf('%.7f', lon) AS lon_text, printf('%.7f', lat) AS lat_text FROM nodes",
    "varint_encode": f"WITH e AS (SELECT event_id, event_id * 7919 - user_id * 31 AS n FROM events) SELECT event_id, {_hex('n')} AS signed_hex, {_HEX.format('abs(n)')} AS unsigned_hex FROM e",
    "o5m_node_deltas": f"{_PIECES}, units AS (SELECT tile_seq, node_id, {_UNITS.format('lon')} AS x, {_UNITS.format('lat')} AS y FROM nodes), steps AS (SELECT node_id, node_id - lag(node_id, 1, 0) OVER w AS a, x - lag(x, 1, 0) OVER w AS b, y - lag(y, 1, 0) OVER w AS c FROM units WINDOW w AS (PARTITION BY tile_seq ORDER BY node_id)) SELECT node_id, {_hex('a')} AS id_hex, {_hex('b')} AS lon_hex, {_hex('c')} AS lat_hex FROM steps",
    "osm_timestamp": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM events",
    "xml_sink": f"""{_PIECES}, bodies AS (SELECT tile_seq, string_agg(xml, chr(10) ORDER BY kind, id) AS body FROM elements GROUP BY tile_seq),
whole AS (SELECT b.tile_seq, '<?xml version="1.0" encoding="utf-8"?>' || chr(10) || '<osm version="0.6" generator="{GENERATOR}">' || chr(10)
  || printf('<bounds minlat="%.7f" minlon="%.7f" maxlat="%.7f" maxlon="%.7f"/>', 43.0 + b.tile_seq // 2, 6.0 + b.tile_seq % 2, 44.0 + b.tile_seq // 2, 7.0 + b.tile_seq % 2) || chr(10) || body || chr(10) || '</osm>' || chr(10) AS text FROM bodies b)
SELECT tile_seq, strlen(text) AS bytes, md5(text) AS digest FROM whole""",
    "pbf_sink": _READ,
    "o5m_sink": _READ,
    "hgt_scan": _SCAN,
    "geotiff_scan": _SCAN,
    "geotiff_bbox": f"WITH {dem_sql(SIDE)} SELECT DISTINCT cell, 3857::BIGINT AS epsg, (6 + file_seq % 2) * 10000000 AS min_lon_e7, (43 + file_seq // 2) * 10000000 AS min_lat_e7, (7 + file_seq % 2) * 10000000 AS max_lon_e7, (44 + file_seq // 2) * 10000000 AS max_lat_e7 FROM dem",
    "zip_members": f"WITH {dem_sql(SIDE)} SELECT cell || '.ZIP/' || cell || '.HGT' AS path, count(z) AS samples, CAST(sum(z) AS BIGINT) AS sum_z FROM dem GROUP BY cell",
    "supersample_knots": f"WITH {dem_sql(N)} SELECT cell, i, j, z FROM dem WHERE z IS NOT NULL",
    "poly_scan": "SELECT n_regionkey::BIGINT AS file, printf('%.7f:%.7f:%.7f:%.7f', min(n_nationkey - 12)::DOUBLE, min(n_nationkey * 2 - 20)::DOUBLE, max(n_nationkey - 10)::DOUBLE, max(n_nationkey * 2 - 17)::DOUBLE) AS area FROM nation GROUP BY n_regionkey",
    "kml_polygons": "SELECT s AS seq, CAST(sum(CASE WHEN s = 0 THEN 1.5 ELSE 2.5 END) AS DOUBLE) AS sum_x, CAST(sum(CASE WHEN s = 2 THEN 9 ELSE n_nationkey END) AS DOUBLE) AS sum_y, count(*) AS n FROM nation, range(3) t(s) GROUP BY s",
    "o5m_string_table": "WITH w AS (SELECT x AS k, 's' || (x * x % 97) AS s FROM range(2000) t(x)), f AS (SELECT s, min(k) AS first FROM w GROUP BY s), o AS (SELECT s, row_number() OVER (ORDER BY first) AS place, first FROM f) SELECT w.k, CASE WHEN w.k = o.first THEN lower(hex(w.s)) ELSE lower(printf('%02x', (SELECT count(*) FROM f WHERE f.first < w.k) - o.place + 1)) END AS hex FROM w JOIN o USING (s)",
    # A diamond and a rectangle, both convex: corners of either within the other, and where their edges meet.
    "polygon_clip": f"""WITH {_SMALL}, box AS (SELECT {CLIP[0]}::DOUBLE AS l, {CLIP[1]}::DOUBLE AS b, {CLIP[2]}::DOUBLE AS r, {CLIP[3]}::DOUBLE AS t),
corners AS (SELECT ring, x, y FROM c, LATERAL (SELECT unnest([l, l, r, r]) AS x, unnest([b, t, b, t]) AS y FROM box) k WHERE abs(x - cx) + abs(y - cy) <= c.r),
own AS (SELECT ring, x, y FROM rings, box WHERE x BETWEEN l AND box.r AND y BETWEEN b AND t),
upright AS (SELECT ring, v AS x, y1 + (v - x1) / (x2 - x1) * (y2 - y1) AS y FROM edges, LATERAL (SELECT unnest([l, r]) AS v, b, t FROM box) k WHERE (x1 < v) <> (x2 < v)),
level AS (SELECT ring, x1 + (v - y1) / (y2 - y1) * (x2 - x1) AS x, v AS y FROM edges, LATERAL (SELECT unnest([b, t]) AS v FROM box) k WHERE (y1 < v) <> (y2 < v)),
found AS (SELECT * FROM corners UNION ALL SELECT * FROM own UNION ALL SELECT upright.* FROM upright, box WHERE y BETWEEN b AND t UNION ALL SELECT level.* FROM level, box WHERE x BETWEEN l AND r)
SELECT DISTINCT ring, CAST(floor(x * 1e6 + 0.5) AS BIGINT) AS x_e6, CAST(floor(y * 1e6 + 0.5) AS BIGINT) AS y_e6 FROM found""",
    # The spline's coefficients are sums of mirrored samples whose weights fall by the pole; at most four of them make a value.
    "supersample": f"""WITH {dem_sql(N)}, g AS (SELECT cell, i, j, coalesce(z, -32768)::DOUBLE AS z FROM dem),
taps AS (SELECT k, CASE WHEN q > {N - 1} THEN {2 * N - 2} - q ELSE q END AS m, sum(w) AS w FROM (SELECT a.x AS k, (a.x + l.x + {8 * (2 * N - 2)}) % {2 * N - 2} AS q, pow(sqrt(3.0::DOUBLE) - 2, abs(l.x)) * sqrt(3.0::DOUBLE) AS w FROM range({N}) a(x), range(-60, 61) l(x)) GROUP BY ALL),
places AS (SELECT x AS p, least(floor(x / 2.0::DOUBLE), {N - 2})::BIGINT AS low, x / 2.0::DOUBLE - least(floor(x / 2.0::DOUBLE), {N - 2}) AS t, floor(x / 2.0::DOUBLE + 0.5)::BIGINT AS near FROM range({2 * N - 1}) r(x)),
bases AS (SELECT p, CASE WHEN low + d < 0 THEN -(low + d) WHEN low + d > {N - 1} THEN {2 * N - 2} - (low + d) ELSE low + d END AS m,
  CASE d WHEN -1 THEN (1 - t) ** 3 WHEN 0 THEN 3 * t ** 3 - 6 * t ** 2 + 4 WHEN 1 THEN -3 * t ** 3 + 3 * t ** 2 + 3 * t + 1 ELSE t ** 3 END / 6 AS w FROM places, (VALUES (-1), (0), (1), (2)) v(d)),
whole AS (SELECT p, taps.m AS m, sum(bases.w * taps.w) AS w FROM bases JOIN taps ON bases.m = taps.k GROUP BY ALL),
down AS (SELECT cell, p AS i, j, sum(w * z) AS z FROM g JOIN whole ON g.i = whole.m GROUP BY ALL),
fine AS (SELECT cell, i, p AS j, sum(w * z) AS z FROM down JOIN whole ON down.j = whole.m GROUP BY ALL)
SELECT f.cell || '.hgt' AS path, f.i, f.j, CASE WHEN g.z > -1000 THEN round_even(f.z, 0) + 0.0 END AS z FROM fine f JOIN places a ON a.p = f.i JOIN places b ON b.p = f.j JOIN g ON g.cell = f.cell AND g.i = a.near AND g.j = b.near""",
    "file_counts": f"{_PIECES} SELECT tile_seq || x.s AS path, 2 * count(*) AS nodes, count(*) AS ways, 0::BIGINT AS relations FROM ways, (VALUES ('.osm'), ('.osm.pbf'), ('.o5m')) x(s) GROUP BY tile_seq, x.s",
}
