"""From raster files to map files: the whole run as one plan.

files -> bands (void mask, smoothing, feet) -> crop -> costs of rows -> tiles -> segments within
polygons -> lines -> degrees -> simplified -> split -> ids -> encoded files

Bands are kept, as costs and segments both read them; ways are kept, as identifiers, files and
names do.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import NamedTuple

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import sinks
from .functions import scalars as S
from .operators import bands, contour, osm, polygon, raster
from .options import Options
from .sources import catalog, connectors, rasters


class Projection(NamedTuple):
    """Expressions from and to degrees. Each axis is on its own, so that boxes stay upright."""

    lon: Callable[[Column], Column]
    lat: Callable[[Column], Column]
    x: Callable[[Column], Column]
    y: Callable[[Column], Column]


#: Projections of rasters by EPSG code; more may be added.
PROJECTIONS = {
    rasters.WGS84: Projection(*[lambda c: c] * 4),
    rasters.WEB_MERCATOR: Projection(S.unmercator_lon, S.unmercator_lat, S.mercator_x, S.mercator_y),
}


def _by_epsg(c: Column, epsg: Column, axis: str) -> Column:
    out = F.raise_error(F.concat(F.lit("no way to reproject EPSG:"), epsg)).cast("double")
    for code, projection in PROJECTIONS.items():
        out = F.when(epsg == code, getattr(projection, axis)(c)).otherwise(out)
    return out


def lon_of(x: Column, epsg: Column) -> Column:
    return _by_epsg(x, epsg, "lon")


def lat_of(y: Column, epsg: Column) -> Column:
    return _by_epsg(y, epsg, "lat")


def numbered(headers: DataFrame, area: tuple | None = None) -> DataFrame:
    """Headers, a row a file, with file_seq, the file's box, and the rows and columns within the area."""
    h = headers.withColumn("file_seq", (F.row_number().over(Window.orderBy("path")) - 1).cast("long"))
    h = h.withColumns({"min_x": F.col("x0"), "max_x": F.col("x0") + (F.col("n_cols") - 1) * F.col("dx"), "min_y": F.col("y0") + (F.col("n_rows") - 1) * F.col("dy"), "max_y": F.col("y0"), "inc_x": F.col("dx"), "inc_y": -F.col("dy")})
    if area is None:
        return h.withColumns({"i0": F.lit(0).cast("long"), "i1": F.col("n_rows") - 1, "j0": F.lit(0).cast("long"), "j1": F.col("n_cols") - 1})
    left, bottom, right, top = map(F.lit, area)
    epsg = F.col("epsg")
    x, y = (lambda v: _by_epsg(v, epsg, "x")), (lambda v: _by_epsg(v, epsg, "y"))
    return raster.crop_bounds(h, x(left), y(bottom), x(right), y(top)).where("i0 <= i1 AND j0 <= j1")


def tiles(bands_: DataFrame, o: Options) -> DataFrame:
    """tile_seq, file_seq, lo, hi, first, last, estimate: files chopped to the node budget, in the order
    of ids, and the levels of their samples (last left out), polygons or not."""
    cut = raster.chop(bands.costs(bands_), o.step, o.max_nodes_per_tile)
    first, last = contour.level_range(F.col("low").cast("long"), F.col("high").cast("long"), o.step)
    # one row a tile; southern halves first, halves of a half together
    seq = (F.row_number().over(Window.orderBy("file_seq", "path")) - 1).cast("long")
    return cut.select(seq.alias("tile_seq"), "file_seq", "lo", "hi", first.alias("first"), last.alias("last"), "estimate")


def crossings(rings: DataFrame, headers: DataFrame) -> DataFrame:
    """file_seq, own and rings: for the raster rows of each band, (i, xs): longitudes at which the edges of a
    ring (ring, seq, x, y in degrees) cross them."""
    edges = polygon.edges(rings)
    geographic = headers.where(F.col("epsg") == rasters.WGS84).select("file_seq", F.col("n_rows").alias("n"), F.col("min_x").alias("min_lon"), F.col("max_y").alias("max_lat"), F.col("dx").alias("inc"))
    found = polygon.row_crossings(edges, geographic)
    # Rows of other projections have latitudes of their own.
    other = headers.where(F.col("epsg") != rasters.WGS84).select("file_seq", "y0", "dy", "epsg", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_rows") - 1)).alias("i"))
    found = found.unionByName(polygon.line_crossings(edges, other.select("file_seq", "i", lat_of(F.col("y0") + F.col("i") * F.col("dy"), F.col("epsg")).alias("lat"))))
    sent = found.withColumn("own", F.explode(bands.owners(F.col("i"))))
    return sent.groupBy("file_seq", "own").agg(F.collect_list(F.struct("i", "xs")).alias("rings"))


def lines(bands_: DataFrame, headers: DataFrame, tiles_: DataFrame, o: Options, rings: DataFrame | None = None) -> DataFrame:
    """tile_seq, level, line, piece, closed, lons, lats, in degrees."""
    own = tiles_.groupBy("file_seq").agg(F.collect_list(F.struct("tile_seq", "lo", "hi", "first", "last")).alias("tiles"))  # no more than a raster's rows
    placed = bands_.join(own, "file_seq")
    if rings is not None:
        place = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n_cols") - 1), lambda j: lon_of(F.col("x0") + j * F.col("dx"), F.col("epsg")))
        none = F.array().cast("array<struct<i: bigint, xs: array<double>>>")
        placed = placed.join(crossings(rings, headers), ["file_seq", "own"], "left").withColumns({"lons": place, "rings": F.coalesce("rings", none)})
    found = bands.segments(placed, o.step)
    if o.no_zero:
        found = found.where("level <> 0")
    stitched = contour.lines(found.select(F.concat_ws("/", "file_seq", "tile_seq").alias("cell"), "level", "k1", "x1", "y1", "k2", "x2", "y2"))
    stitched = stitched.withColumns({"file_seq": F.split("cell", "/")[0].cast("long"), "tile_seq": F.split("cell", "/")[1].cast("long")})
    at = stitched.join(headers.select("file_seq", "epsg", "x0", "dx", "y0", "dy"), "file_seq")
    at = at.withColumns({"xs": F.transform("xs", lambda x: lon_of(F.col("x0") + x * F.col("dx"), F.col("epsg"))), "ys": F.transform("ys", lambda y: lat_of(F.col("y0") + y * F.col("dy"), F.col("epsg")))})
    simple = contour.rdp(at.select("cell", "tile_seq", "level", "line", "closed", "xs", "ys"), o.epsilon)
    return contour.split(simple, o.max_nodes_per_way).select("tile_seq", "level", "line", "piece", "closed", F.col("xs").alias("lons"), F.col("ys").alias("lats"))


def boxes(tiles_: DataFrame, headers: DataFrame) -> DataFrame:
    """The bounding box of each tile in degrees."""
    at = tiles_.join(headers.select("file_seq", "path", "epsg", "x0", "dx", "y0", "dy", "j0", "j1"), "file_seq")
    lon, lat = (lambda j: lon_of(F.col("x0") + F.col(j) * F.col("dx"), F.col("epsg"))), (lambda i: lat_of(F.col("y0") + F.col(i) * F.col("dy"), F.col("epsg")))
    return at.select("tile_seq", "path", lon("j0").alias("min_lon"), lat("hi").alias("min_lat"), lon("j1").alias("max_lon"), lat("lo").alias("max_lat"))


def names(boxes_: DataFrame, o: Options) -> DataFrame:
    """tile_seq and name of the output file."""
    used, asked = F.substring(F.lower(F.element_at(F.split("path", "/"), -2)), 1, 5), o.source or []
    if o.files:
        used, asked = F.lit("local-source"), ["local-source"]
    prefix = F.lit(f"{o.output_prefix}_" if o.output_prefix else "")
    box = [F.col(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")]
    return boxes_.select("tile_seq", catalog.output_name(prefix, *box, F.array(used), F.array(*map(F.lit, asked)).cast("array<string>"), sinks.SUFFIX[o.kind]).alias("name"))


def read(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path and content of raster files; of zip archives, of the .hgt files in them."""
    load = lambda some: spark.read.format("binaryFile").load(some).select("path", "content")
    zips = [p for p in paths if p.lower().endswith(".zip")]
    rest = [p for p in paths if not p.lower().endswith(".zip")]
    if not zips:
        return load(rest)
    found = rasters.zip_members(load(zips))
    return found.union(load(rest)) if rest else found


def inputs(spark: SparkSession, o: Options, rings: DataFrame | None = None) -> DataFrame:
    """path and content of the raster files: those named, or for each cell of the area (and, where there
    are rings, that they touch) the one of the first source that has it."""
    if o.files:
        return read(spark, list(o.files))
    left, bottom, right, top = o.area
    spans = [(left, right)] if left < right else [(left, 180.0), (-180.0, right)]
    wanted = None
    for a, b in spans:
        box = spark.sql("SELECT 1").select(*catalog.whole_bbox(F.lit(f"{a}:{bottom}:{b}:{top}"), o.corrx, o.corry))
        cells = box.select(F.explode(F.sequence("min_lon", F.col("max_lon") - 1)).alias("lon"), "min_lat", "max_lat").select("lon", F.explode(F.sequence("min_lat", F.col("max_lat") - 1)).alias("lat"))
        own = cells.select(S.cell_name(F.col("lat"), F.col("lon")).alias("cell"))
        wanted = own if wanted is None else wanted.union(own)
    if rings is not None:
        all_boxes = rings.groupBy("ring").agg(F.floor(F.min("x")).alias("left"), F.floor(F.min("y")).alias("bottom"), F.ceil(F.max("x")).alias("right"), F.ceil(F.max("y")).alias("top"))
        touched = polygon.files_needed(all_boxes, rings.select("ring", "seq", "x", "y")).select("cell").distinct()
        wanted = wanted.join(touched, "cell", "left_semi")
    left, paths = wanted.distinct(), []
    for option in o.source:  # what one source has isn't asked of the next
        origin = connectors.source(option, o.hgtdir)
        origin.configure(o)
        resolution = int(option[4:])
        if o.rewrite_indices and isinstance(origin, connectors.Indexed):
            origin.index(spark, resolution, anew=True)
        found = origin.files(spark, resolution).join(left, "cell", "left_semi") if o.offline else origin.ensured(spark, left, resolution)
        here = found.groupBy("cell").agg(F.min("path").alias("path")).collect()  # a row a cell of the area
        if here:
            paths += [r["path"] for r in here]
            left = left.join(spark.createDataFrame([(r["cell"],) for r in here], "cell string"), "cell", "left_anti")
    if not paths:
        raise FileNotFoundError(f"no source of {', '.join(o.source)} has a file for the area in {o.hgtdir}")
    return read(spark, paths)


@contextmanager
def kept(*frames: DataFrame) -> Iterator[None]:
    """The frames stay in memory, else on disk, until the end; a lost executor's part is made again."""
    try:
        for f in frames:
            f.persist(StorageLevel.MEMORY_AND_DISK)
        yield
    finally:
        for f in frames:
            f.unpersist()


def polygons(spark: SparkSession, o: Options) -> DataFrame | None:
    """The rings of the polygon file, whose extent is the area if there is none."""
    if not o.polygon:
        return None
    text = spark.read.text(o.polygon, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("no", "line")).select(F.lit(0).alias("file"), F.col("no").cast("long").alias("no"), "line")
    rings = rasters.polygons(text)
    if o.area is None:
        o.area = tuple(map(float, rasters.extent(rings).first()["area"].split(":")))
    return rings


@contextmanager
def made(spark: SparkSession, o: Options, files: DataFrame | None = None) -> Iterator[tuple[DataFrame, DataFrame]]:
    """Ways with ids, and boxes of their tiles; both are kept while they are used."""
    rings = polygons(spark, o)
    files = inputs(spark, o, rings) if files is None else files
    raw = rasters.bands(files, o.void_range_max, o.smooth, o.feet, o.corrx, o.corry)
    with kept(raw):
        headers = numbered(raw.where("own = 0").drop("own", "top", "z"), o.area)
        with kept(headers):
            inside = raw.select("path", "own", "top", "z").join(headers.select("path", "file_seq", "n_cols", "i0", "i1", "j0", "j1", "x0", "dx", "epsg"), "path")
            inside = inside.where("top <= i1 AND own + %d > i0" % bands.BAND).withColumn("cell", F.col("file_seq").cast("string"))
            tiles_ = tiles(inside, o)
            with kept(tiles_):
                pieces = lines(inside, headers, tiles_, o, rings)
                out = boxes(tiles_, headers)
                if not o.max_nodes_per_tile:  # one output for all; the order of ids stays
                    pieces = pieces.withColumn("line", F.col("tile_seq") * (1 << 32) + F.col("line")).withColumn("tile_seq", F.lit(0).cast("long"))
                    out = out.agg(F.lit(0).cast("long").alias("tile_seq"), F.min("path").alias("path"), *[f(c).alias(c) for f, c in ((F.min, "min_lon"), (F.min, "min_lat"), (F.max, "max_lon"), (F.max, "max_lat"))])
                ways_ = osm.ways(pieces, o.start_node_id, o.start_way_id)
                with kept(ways_, out):
                    yield ways_, out


def run(spark: SparkSession, o: Options, files: DataFrame | None = None) -> tuple[list[str], int, int]:
    """Write the map files; gives their names in order, and the node and way ids that come next. With plot,
    the samples, too."""
    if o.download_only:
        inputs(spark, o, polygons(spark, o)) if files is None else files
        return [], o.start_node_id, o.start_way_id
    if o.plot:
        plot(spark, o, files)
    now = int(time.time())
    stamp = time.strftime(' timestamp="%Y-%m-%dT%H:%M:%SZ"', time.gmtime(now)) if o.write_timestamp else ""
    with made(spark, o, files) as (found, tiles_):
        content = sinks.files(found, tiles_, o.kind, *o.line_cat, gzip_level=o.gzip or 9, osm_version=o.osm_version, stamp=stamp, time=now, with_time=o.write_timestamp)
        sinks.register(spark)
        content.join(names(tiles_, o), "tile_seq").select("name", "content").write.format("mapfiles").mode("append").save(sinks.uri(o.output))
        ends = found.agg(F.max(F.col("first_node") + F.col("n_nodes")).alias("node"), (F.max("way_id") + 1).alias("way")).first()
        written = names(tiles_.join(found.select("tile_seq").distinct(), "tile_seq", "left_semi"), o)
        said = [r["name"] for r in written.orderBy("tile_seq").collect()]  # a name a file
    return said, ends["node"] or o.start_node_id, ends["way"] or o.start_way_id


def plot(spark: SparkSession, o: Options, files: DataFrame | None = None) -> None:
    """Samples as text: longitude, latitude, whole height."""
    files = inputs(spark, o, polygons(spark, o)) if files is None else files
    raw = rasters.bands(files, o.void_range_max, o.smooth, o.feet, o.corrx, o.corry)
    headers = numbered(rasters.headers(files, o.corrx, o.corry, o.smooth), o.area).select("path", "file_seq", "i0", "i1", "j0", "j1", "x0", "dx", "y0", "dy", "epsg")
    own = raw.select("path", "own", "top", "n_cols", "z").join(headers, "path").withColumn("cell", F.col("path"))
    at = bands.unpacked(own).where("z IS NOT NULL").join(headers, "file_seq")
    lon, lat = lon_of(F.col("x0") + F.col("j") * F.col("dx"), F.col("epsg")), lat_of(F.col("y0") + F.col("i") * F.col("dy"), F.col("epsg"))
    text = F.concat_ws(" ", S.fixed(lon, 7), S.fixed(lat, 7), F.col("z").cast("long").cast("string")).alias("value")
    at.select(text).write.mode("overwrite").text(f"{sinks.uri(o.output)}/{o.plot}.xyz")
