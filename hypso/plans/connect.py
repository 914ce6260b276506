"""Queries on indices, listings and addresses of sources, with SQL that states the same for another engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import polygon
from ..sources import catalog
from .areas import _HELD, _held, _table, _wanted, large_rings, name_sql, rings_sql


def _archives(spark, sf_dir):
    """A continents' index: archives of the cells that sources hold, some of them misspelt."""
    own = _held(spark, sf_dir)
    faulty = F.substring("cell", 3, 1) == "3"
    name = F.concat("cell", F.when(faulty, "hgt.zip").otherwise(".hgt.zip"))
    return own.select(F.substring("nick", 1, 4).alias("header"), name.alias("entry")).distinct()


def nasa_lookup(spark, sf_dir):
    """Address of each wanted cell in an index by continents."""
    return catalog.by_continent(_wanted(spark, sf_dir).select("cell"), _archives(spark, sf_dir), "http://host/v2")


def nasa_coverage(spark, sf_dir):
    """Address of each wanted cell that a coverage index lists."""
    listed = _held(spark, sf_dir).select(F.concat(F.lower("cell"), F.lit(".any")).alias("entry"))
    return catalog.by_coverage(_wanted(spark, sf_dir).select("cell"), listed, "http://host/{}V3/EE")


def index_save(spark, sf_dir):
    """The lines of an index as it is put down."""
    return catalog.index_lines(_archives(spark, sf_dir), "SRTM3v2.1", 2)


def index_update(spark, sf_dir):
    """An index in which one header's archives were seen, and another's are gone."""
    index = _archives(spark, sf_dir)
    found = index.where("header = 'view' AND endswith(entry, '.hgt.zip')").unionByName(spark.createDataFrame([("alos", None)], "header string, entry string"))
    return catalog.index_updated(index, found)


def index_version(spark, sf_dir):
    """Versions of index files, one for each region; those of even regions have none."""
    n = _table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("file"), F.col("n_nationkey").cast("long").alias("no"), "n_name")
    line = F.when(F.col("file") % 2 == 0, F.col("n_name")).otherwise(F.concat(F.lit("# index of "), "n_name", F.lit(", VERSION="), (F.col("no") % 7).cast("string"), F.lit(" ")))
    return catalog.index_versions(n.select("file", "no", line.alias("line")))


def directory_listing(spark, sf_dir):
    """Archives that pages link to, by continent."""
    p = _table(spark, sf_dir, "pages")
    k = (F.col("page_id") % 90).cast("string")
    links = F.concat(F.lit('<A HREF="x'), k, F.lit('"> N'), k, F.lit("E006.hgt.zip </A><a href='y.txt'>readme.txt</a><a name=z>N"), k, F.lit("W007hgt.zip</a>"))
    found = catalog.listing(p.select(F.concat(F.lit("Region_"), (F.col("page_id") % 5).cast("string")).alias("continent"), F.concat("html", links).alias("html")))
    return found.groupBy("continent", "file").agg(F.count(F.lit(1)).alias("n"))


def url_safety(spark, sf_dir):
    """Which addresses may be fetched."""
    p = _table(spark, sf_dir, "pages")
    url = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("file:///"), "url")).when(F.col("page_id") % 7 == 0, F.regexp_replace("url", "^https?", "ftp")).when(F.col("page_id") % 11 == 0, None).otherwise(F.col("url"))
    return p.select("page_id", catalog.is_safe_url(url).alias("safe"))


def coverage_cells(spark, sf_dir):
    """Cells whose middle lies in an odd number of rings."""
    return catalog.odd_ones(polygon.filled_cells(large_rings(spark, sf_dir)))


def aligned_boxes(spark, sf_dir):
    """Whether four corners make an upright rectangle."""
    o = _table(spark, sf_dir, "orders")
    x, y, off = F.col("o_custkey") / 7.0, F.col("o_orderkey") / 9.0, F.when(F.col("o_orderkey") % 4 == 0, 1e-6).otherwise(1e-12)
    corner = lambda a, b: F.struct(F.lit(a).alias("lon") if isinstance(a, float) else a.alias("lon"), b.alias("lat"))
    return o.select("o_orderkey", S.aligned(corner(x, y), corner(x, y + 1), corner(x + 1, y + 1 + off), corner(x + 1, y)).alias("aligned"))


QUERIES = {f.__name__: f for f in (nasa_lookup, nasa_coverage, index_save, index_update, index_version, directory_listing, url_safety, coverage_cells, aligned_boxes)}

_ARCHIVES = f"""{_HELD}, archives AS (SELECT DISTINCT nick[1:4] AS header, cell || CASE WHEN cell[3] = '3' THEN 'hgt.zip' ELSE '.hgt.zip' END AS entry, cell FROM held)"""
_LARGE = rings_sql("(n_nationkey * 37 % 60) - 30 + 0.25", "(n_nationkey * 53 % 60) - 30 + 0.5", "1.3 + n_nationkey % 4")
ORACLE = {
    "nasa_lookup": f"WITH {_ARCHIVES} SELECT cell, 'http://host/v2/' || min(header) || '/' || min(entry) AS url FROM wanted JOIN archives USING (cell) GROUP BY cell",
    "nasa_coverage": f"WITH {_HELD} SELECT cell, 'http://host/' || cell || 'V3/EE' AS url FROM wanted WHERE cell IN (SELECT cell FROM held)",
    "index_save": f"WITH {_ARCHIVES}, rows_ AS (SELECT header, 1 AS kind, entry FROM archives UNION ALL SELECT DISTINCT header, 0, '' FROM archives) SELECT row_number() OVER (ORDER BY header, kind, entry) AS no, CASE WHEN kind = 0 THEN '[' || header || ']' ELSE entry END AS line FROM rows_ UNION ALL SELECT 0, '# SRTM3v2.1 index file, VERSION=2'",
    "index_update": f"WITH {_ARCHIVES} SELECT header, entry FROM archives WHERE header NOT IN ('view', 'alos') OR header = 'view' AND entry LIKE '%.hgt.zip'",
    "index_version": "SELECT n_regionkey::BIGINT AS file, CASE WHEN n_regionkey % 2 = 0 THEN 1 ELSE min(n_nationkey) % 7 END::BIGINT AS version FROM nation GROUP BY n_regionkey",
    "directory_listing": "WITH k AS (SELECT 'Region_' || page_id % 5 AS continent, page_id % 90 AS k FROM pages), f AS (SELECT continent, 'N' || k || 'E006.hgt.zip' AS file FROM k UNION ALL SELECT continent, 'N' || k || 'W007hgt.zip' FROM k) SELECT continent, file, count(*) AS n FROM f GROUP BY ALL",
    "url_safety": "SELECT page_id, page_id % 3 <> 0 AND page_id % 7 <> 0 AND page_id % 11 <> 0 AND (url LIKE 'http:%' OR url LIKE 'https:%') AS safe FROM pages",
    # A diamond holds a point if its distances along both axes add up to no more than its radius.
    "coverage_cells": f"""WITH {_LARGE}, m AS (SELECT ring, cx, cy, r, unnest(range(floor(cx - r)::BIGINT, ceil(cx + r)::BIGINT)) AS lon FROM c), p AS (SELECT *, unnest(range(floor(cy - r)::BIGINT, ceil(cy + r)::BIGINT)) AS lat FROM m),
h AS (SELECT {name_sql('lat', 'lon')} AS cell FROM p WHERE abs(lon + 0.5 - cx) + abs(lat + 0.5 - cy) < r) SELECT cell, count(*) AS n FROM h GROUP BY cell HAVING count(*) % 2 = 1""",
    "aligned_boxes": "SELECT o_orderkey, o_orderkey % 4 <> 0 OR 1e-6 <= 1e-9 * (o_orderkey / 9.0::DOUBLE + 1) AS aligned FROM orders",
}
