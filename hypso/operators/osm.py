"""Map elements: identifiers, nodes, ways and their XML text, from pieces of contour lines.

Pieces are rows (tile_seq, level, line, piece, closed, lons, lats). Identifiers follow the order
(tile_seq, level, line, piece): totals of tiles are summed over a table of one row a tile, and
places inside a tile by a window in the tile, which the node budget bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import fixed, level_class
from ..sinks import xml

FIRST_ID = 10_000_000
ORDER = ("level", "line", "piece")


def piece_nodes() -> Column:
    """Nodes of a piece: a ring's last point is its first node."""
    return F.size("lons") - F.col("closed").cast("int")


def tile_starts(pieces: DataFrame, node: int = FIRST_ID, way: int = FIRST_ID) -> DataFrame:
    """tile_seq, nodes, ways, first_node, first_way: contiguous ranges, tile after tile."""
    totals = pieces.groupBy("tile_seq").agg(F.sum(piece_nodes()).cast("long").alias("nodes"), F.count(F.lit(1)).alias("ways"))
    before = Window.orderBy("tile_seq").rowsBetween(Window.unboundedPreceding, -1)  # a row for each tile
    start = lambda c, first: (F.coalesce(F.sum(c).over(before), F.lit(0)) + first).cast("long")
    return totals.withColumn("first_node", start("nodes", node)).withColumn("first_way", start("ways", way))


def ways(pieces: DataFrame, node: int = FIRST_ID, way: int = FIRST_ID) -> DataFrame:
    """pieces with way_id, first_node and n_nodes."""
    starts = tile_starts(pieces, node, way).select("tile_seq", F.col("first_node").alias("_node"), "first_way")
    w = Window.partitionBy("tile_seq").orderBy(*ORDER)
    inside = pieces.withColumn("n_nodes", piece_nodes().cast("long"))
    inside = inside.withColumn("_before", F.coalesce(F.sum("n_nodes").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_k", F.row_number().over(w) - 1)
    placed = inside.join(starts, "tile_seq")
    return placed.withColumn("way_id", F.col("first_way") + F.col("_k")).withColumn("first_node", F.col("_node") + F.col("_before")).drop("_before", "_k", "_node", "first_way")


def refs() -> Column:
    """A way's node ids; a ring names its first node again."""
    ids = F.sequence(F.col("first_node"), F.col("first_node") + F.col("n_nodes") - 1)
    return F.when(F.col("closed"), F.concat(ids, F.array("first_node"))).otherwise(ids)


def nodes(ways_: DataFrame) -> DataFrame:
    """tile_seq, node_id, lon, lat for each node of ways()."""
    places = F.arrays_zip(F.slice("lons", F.lit(1), F.col("n_nodes").cast("int")).alias("lon"), F.slice("lats", F.lit(1), F.col("n_nodes").cast("int")).alias("lat"))
    out = ways_.select("tile_seq", "first_node", F.posexplode(places).alias("pos", "p"))
    return out.select("tile_seq", (F.col("first_node") + F.col("pos")).alias("node_id"), F.col("p")["lon"].alias("lon"), F.col("p")["lat"].alias("lat"))


def node_xml(osm_version: float = 0.6, stamp: str = "") -> Column:
    return F.format_string(xml.NODE, F.col("node_id").cast("string"), fixed(F.col("lat"), 7), fixed(F.col("lon"), 7), F.lit(xml.version(osm_version, stamp)))


def way_xml(major: int = 200, medium: int = 100, osm_version: float = 0.6, stamp: str = "") -> Column:
    listed = F.array_join(F.transform(refs(), lambda r: F.format_string(xml.REF, r.cast("string"))), "")
    level = F.col("level").cast("long")
    return F.format_string(xml.WAY, F.col("way_id").cast("string"), F.lit(xml.version(osm_version, stamp)), listed, level.cast("string"), level_class(F.col("level"), major, medium))


def elements(ways_: DataFrame, **style) -> DataFrame:
    """tile_seq, kind (0: node, 1: way), id, xml: in the order (tile_seq, kind, id) the body of a file."""
    version = {k: v for k, v in style.items() if k in ("osm_version", "stamp")}
    a = nodes(ways_).select("tile_seq", F.lit(0).alias("kind"), F.col("node_id").alias("id"), node_xml(**version).alias("xml"))
    return a.unionAll(ways_.select("tile_seq", F.lit(1).alias("kind"), F.col("way_id").alias("id"), way_xml(**style).alias("xml")))


def stats(elements_: DataFrame) -> DataFrame:
    """How many elements of each kind, and bytes of text."""
    return elements_.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.sum(F.octet_length("xml") + 1).alias("bytes"))
