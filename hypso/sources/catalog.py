"""Source catalogue as plans: cell and file names, indices, listings, preferences, output names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sinks import xml


def raster_bytes(resolution: Column) -> Column:
    side = F.floor(F.lit(3600) / resolution) + 1
    return (side * side * 2).cast("long")


def valid_cache(extension: Column, size: Column, resolution: Column) -> Column:
    """A cached raster has the size its resolution asks for; other kinds need only be there."""
    return (extension != "hgt") | (size == raster_bytes(resolution))


def name_bbox(file: Column, corrx: float = 0.0, corry: float = 0.0) -> list[Column]:
    """Bounding box columns of a file by its name; names that code no cell raise."""
    lat, lon = S.cell_lat(file), S.cell_lon(file)
    sure = lambda x: F.coalesce(x, F.raise_error(F.concat(F.lit("no cell in file name "), file)).cast("long"))
    low = {"min_lon": sure(lon) + F.lit(corrx), "min_lat": sure(lat) + F.lit(corry)}
    return [low["min_lon"].alias("min_lon"), low["min_lat"].alias("min_lat"), (low["min_lon"] + 1).alias("max_lon"), (low["min_lat"] + 1).alias("max_lat")]


def whole_bbox(area: Column, corrx: float = 0.0, corry: float = 0.0) -> list[Column]:
    """The whole-degree box around "left:bottom:right:top", corrections taken off first."""
    part = lambda k, c: F.split(area, ":")[k].cast("double") - F.lit(c)
    return [F.floor(part(0, corrx)).alias("min_lon"), F.floor(part(1, corry)).alias("min_lat"), F.ceil(part(2, corrx)).alias("max_lon"), F.ceil(part(3, corry)).alias("max_lat")]


def grouped_url(cell: Column, base: str = "https://tiles.example/") -> Column:
    """Tiles are kept by groups of five degrees; latitudes have three digits."""
    lat, lon = S.cell_lat(cell), S.cell_lon(cell)
    name = lambda a, o: F.concat(F.when(a < 0, "S").otherwise("N"), F.format_string("%03d", F.abs(a)), F.when(o < 0, "W").otherwise("E"), F.format_string("%03d", F.abs(o)))
    return F.concat(F.lit(base), name(S.floor_multiple(lat, 5), S.floor_multiple(lon, 5)), F.lit("/"), name(lat, lon), F.lit(".zip"))


def output_name(prefix: Column, left: Column, bottom: Column, right: Column, top: Column, used: Column, asked: Column, suffix: str) -> Column:
    """lonL_RlatB_T_sources after a prefix: the asked sources that were used, in their order."""
    box = F.concat(prefix, F.lit("lon"), S.fixed(left, 2), F.lit("_"), S.fixed(right, 2), F.lit("lat"), S.fixed(bottom, 2), F.lit("_"), S.fixed(top, 2))
    named = F.array_join(F.array_intersect(asked, used), ",")
    return F.concat(box, F.when(named == "", "").otherwise(F.concat(F.lit("_"), named)), F.lit(suffix))


def bounds_tag(left: Column, bottom: Column, right: Column, top: Column) -> Column:
    return F.format_string(xml.BOUNDS, *[S.fixed(x, 7) for x in (bottom, left, top, right)])


def preferred(wanted: DataFrame, held: DataFrame, order: list[str]) -> DataFrame:
    """For each wanted cell the first source in order that has it; null if none has. The least
    rank combines on the map side, so a popular cell is no hot key."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("nick"))
    best = held.withColumn("rank", rank).where("rank > 0").groupBy("cell").agg(F.min("rank").alias("rank"))
    named = best.select("cell", F.element_at(F.array(*map(F.lit, order)), F.col("rank").cast("int")).alias("nick"))
    return wanted.join(named, "cell", "left").select("cell", "nick")


def lookup(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """Candidate archives of each wanted cell, in the order of their names: urls, the first, and how many.
    A cell is in a few archives."""
    listed = wanted.join(index, "cell").groupBy("cell").agg(F.sort_array(F.collect_set("url")).alias("urls"))
    return listed.select("cell", "urls", F.col("urls")[0].alias("first_url"), F.size("urls").cast("long").alias("n_urls"))


def sections(lines: DataFrame) -> DataFrame:
    """file, header, entry of index lines (file, no, line): comments and blank lines go, the last
    header before an entry is its own; an entry before any header raises."""
    real = lines.where("line <> '' AND NOT startswith(line, '#')")
    w = Window.partitionBy("file").orderBy("no")
    head = F.last(F.when(F.col("line").startswith("["), F.col("line")), ignorenulls=True).over(w)
    out = real.withColumn("header", head).where("NOT startswith(line, '[')")
    return out.select("file", F.coalesce("header", F.raise_error(F.lit("an entry before any header")).cast("string")).alias("header"), F.col("line").alias("entry"))


def index_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """For each header of two indices whether they have the same entries, in any order."""
    one = lambda x, name: x.groupBy("header").agg(F.sort_array(F.collect_set("entry")).alias(name))
    return one(a, "x").join(one(b, "y"), "header", "full").select("header", F.coalesce(F.col("x") == F.col("y"), F.lit(False)).alias("same"))


def index_lines(index: DataFrame, title: str, version: int) -> DataFrame:
    """no, line: the text of an index (header, entry): a comment with the version, then each header with its
    entries, in order. A row a line; the world has under 65,000 cells."""
    rows = index.select("header", F.lit(1).alias("kind"), "entry").union(index.select("header", F.lit(0), F.lit("")).distinct())
    line = F.when(F.col("kind") == 0, F.concat(F.lit("["), "header", F.lit("]"))).otherwise(F.col("entry"))
    own = rows.select((F.row_number().over(Window.orderBy("header", "kind", "entry"))).cast("long").alias("no"), line.alias("line"))
    return index.sparkSession.createDataFrame([(0, f"# {title} index file, VERSION={version}")], "no long, line string").union(own)


def index_versions(lines: DataFrame) -> DataFrame:
    """file, version: what the first comment of each index (file, no, line) ends with; 1 if it has none."""
    first = lines.groupBy("file").agg(F.min_by("line", F.when(F.col("line").startswith("#"), F.col("no"))).alias("comment"))
    return first.select("file", F.coalesce(F.regexp_extract(F.trim("comment"), r"(\d+)$", 1).try_cast("long"), F.lit(1).cast("long")).alias("version"))


def index_updated(index: DataFrame, found: DataFrame) -> DataFrame:
    """An index (header, entry) in which the headers of found (header, entry) have what was found; entry null: nothing."""
    return index.join(found.select("header").distinct(), "header", "left_anti").select("header", "entry").union(found.where("entry IS NOT NULL").select("header", "entry"))


def listing(pages: DataFrame) -> DataFrame:
    """continent, file: the archives that directory pages (continent, html) link to, by the text of the links."""
    texts = pages.select("continent", F.explode(F.regexp_extract_all("html", F.lit(r"(?is)<a\b[^>]*>(.*?)</a>"), F.lit(1))).alias("text"))
    return texts.select("continent", F.trim("text").alias("file")).where("endswith(file, 'hgt.zip')")


def by_continent(wanted: DataFrame, index: DataFrame, server: str) -> DataFrame:
    """cell, url of the wanted cells in an index of archives (header: continent, entry): <cell>.hgt.zip, else the
    misspelt <cell>hgt.zip that some are named."""
    named = index.select("header", "entry", F.regexp_extract("entry", r"^(.*?)\.?hgt\.zip$", 1).alias("cell"), (~F.col("entry").endswith(".hgt.zip")).alias("faulty"))
    best = named.where("cell <> ''").groupBy("cell").agg(F.min(F.struct("faulty", "entry", "header")).alias("b"))
    return wanted.join(best, "cell").select("cell", F.concat_ws("/", F.lit(server), "b.header", "b.entry").alias("url"))


def by_coverage(wanted: DataFrame, index: DataFrame, pattern: str) -> DataFrame:
    """cell, url of the wanted cells that an index (entry) lists, in any case and with any extension; pattern
    has {} for the cell."""
    known = index.select(F.upper(F.split("entry", r"\.")[0]).alias("_known")).distinct()
    return wanted.join(known, F.upper("cell") == F.col("_known")).select("cell", F.replace(F.lit(pattern), F.lit("{}"), F.col("cell")).alias("url"))


def is_safe_url(url: Column) -> Column:
    return F.coalesce(url.startswith("http:") | url.startswith("https:"), F.lit(False))


def safe_url(url: Column) -> Column:
    """The address, if it is one of the web; others (files, other schemes) raise."""
    return F.when(is_safe_url(url), url).otherwise(F.raise_error(F.concat(F.lit("not an address to fetch: "), F.coalesce(url, F.lit("null")))).cast("string"))


def odd_ones(hits: DataFrame) -> DataFrame:
    """Cells that are hit an odd number of times (holes cancel), in order."""
    return hits.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1").orderBy("cell")


def image_map(pages: DataFrame) -> DataFrame:
    """url, cell for each <area> of pages (html): a map of 5 pixels a degree."""
    areas = pages.select(F.explode(F.regexp_extract_all("html", F.lit("<area [^>]*>"), F.lit(0))).alias("tag"))
    number = lambda k: F.split(F.regexp_extract("tag", 'coords="([^"]*)"', 1), ",")[k].cast("int")
    degree = lambda k: (number(k) / 5.0 + 0.5).cast("long")
    boxes = areas.select(F.regexp_extract("tag", 'href="([^"]*)"', 1).alias("url"), (degree(0) - 180).alias("w"), (degree(2) - 180).alias("e"), (90 - degree(3)).alias("s"), (90 - degree(1)).alias("n")).where("w < e AND s < n")
    lons = boxes.select("url", F.explode(F.sequence("w", F.col("e") - 1)).alias("lon"), "s", "n")
    cells = lons.select("url", "lon", F.explode(F.sequence("s", F.col("n") - 1)).alias("lat"))
    return cells.select("url", S.cell_name(F.col("lat"), F.col("lon")).alias("cell")).distinct()
