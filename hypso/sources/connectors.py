"""Connectors: caches of raster files, and where missing ones come from.

A connector's cache is a folder that driver and executors share. `ensured()` is the whole of it: of the
cells that are wanted, those that the cache has and that are valid stay; for the others their candidate
archives are fetched in turn, each archive once and by a task of its own, and put into the cache.
Addresses are plans (cell, url), so that any number of cells is one join with an index.
"""

from __future__ import annotations

import io
import logging
import urllib.request
import zipfile
from argparse import ArgumentParser
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import sinks
from ..operators import polygon
from . import catalog, rasters

log = logging.getLogger(__name__)
Fetch = Callable[[str], bytes]


def over_http(url: str) -> bytes:
    """What is at an address of the web."""
    if not url.startswith(("http:", "https:")):
        raise ValueError(f"not an address to fetch: {url}")
    with urllib.request.urlopen(url, timeout=120) as answer:  # noqa: S310
        return answer.read()


class Source:
    """A connector. Subclasses register themselves by their four-letter nick, and may add options of
    their own to the command line."""

    registry: dict[str, type[Source]] = {}
    nick = ""
    resolutions: tuple[int, ...] = (1, 3)
    extension = "hgt"
    banner = ""

    def __init_subclass__(cls) -> None:
        if "nick" not in cls.__dict__:  # a class for others to build on, or one that workers get by value
            return
        if len(cls.nick) != 4 or cls.nick in Source.registry:
            raise ValueError(f"a source needs a nick of four letters that is its own: {cls.nick!r}")
        Source.registry[cls.nick] = cls

    def __init__(self, folder: str, fetch: Fetch = over_http):
        if self.registry.get(self.nick) is not type(self):
            raise ValueError(f"{type(self).__name__} is no registered source")
        self.folder, self.fetch = folder, fetch
        self._greeted = False

    @staticmethod
    def add_options(parser: ArgumentParser) -> None:
        """Options of this source; none by default."""

    def configure(self, options) -> None:
        """Take what concerns this source from a run's options; nothing by default."""

    @classmethod
    def options(cls) -> list[str]:
        return [f"{cls.nick}{r}" for r in cls.resolutions]

    def cache(self, resolution: int) -> str:
        return f"{self.folder}/{self.nick.upper()}{resolution}"

    def prepare(self, resolution: int) -> None:
        """Make the cache's folder."""
        store, root = sinks.opened(self.cache(resolution))
        store.create_dir(root, recursive=True)

    def files(self, spark: SparkSession, resolution: int) -> DataFrame:
        """(cell, path, bytes) of what the cache holds; a listing, no file is opened."""
        self.prepare(resolution)
        reader = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{self.extension}")
        found = reader.load(sinks.uri(self.cache(resolution))).select("path", "length")
        name = F.element_at(F.split("path", "/"), -1)
        found = found.select(F.upper(F.substring(name, 1, 7)).alias("cell"), "path", F.col("length").alias("bytes"))
        return found.where(catalog.valid_cache(F.lit(self.extension), F.col("bytes"), F.lit(resolution)))

    def urls(self, spark: SparkSession, wanted: DataFrame, resolution: int) -> DataFrame:
        """(cell, url): candidate archives or files of the wanted cells; none by default."""
        return spark.createDataFrame([], "cell string, url string")

    def members(self, url: str, data: bytes) -> dict[str, bytes]:
        """The files of a download, by the names they get in the cache: of an archive its rasters,
        without folders; of several of one name the last."""
        if not zipfile.is_zipfile(io.BytesIO(data)):
            return {url.rsplit("/", 1)[-1]: data}
        out = {}
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for name in z.namelist():
                stem, _, extension = name.rsplit("/", 1)[-1].rpartition(".")
                if stem and extension.lower() == self.extension:
                    out[f"{stem.upper()}.{self.extension}"] = z.read(name)
        return out

    def learned(self, spark: SparkSession, found: DataFrame, resolution: int) -> None:
        """Take note of what archives (header: url, entry: cell or null) really held; nothing by default."""

    def fetched(self, urls: DataFrame, resolution: int) -> DataFrame:
        """Fetch each url (once, repeats don't count) into the cache: url, cell (null: nothing came), why."""
        fetch, members, target = self.fetch, self.members, self.cache(resolution)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for url in pdf["url"]:
                    rows = []
                    try:
                        files = members(url, fetch(url))
                        sinks.put(files.items(), target)
                        rows = [(url, name.rsplit(".", 1)[0], None) for name in files]
                    except Exception as e:  # the next candidate may have it
                        rows = [(url, None, str(e))]
                    yield pd.DataFrame(rows or [(url, None, "no raster in it")], columns=["url", "cell", "why"])

        one_each = urls.select("url").distinct().repartition("url")
        return one_each.mapInPandas(run, "url string, cell string, why string")

    def ensured(self, spark: SparkSession, wanted: DataFrame, resolution: int) -> DataFrame:
        """(cell, path, bytes) of the wanted cells (cell) that this source has, fetched if need be."""
        def missing() -> DataFrame:
            return wanted.select("cell").distinct().join(self.files(spark, resolution).select("cell"), "cell", "left_anti")

        left = missing()
        if not left.isEmpty():
            place = F.row_number().over(Window.partitionBy("cell").orderBy("url"))
            try:
                found = self.urls(spark, left, resolution)
            except OSError as e:  # no index here, and none to be had
                log.warning("%s: %s", self.nick, e)
                found = spark.createDataFrame([], "cell string, url string")
            candidates = found.select("cell", "url").distinct().withColumn("turn", place).cache()
            for turn in range(1, (candidates.agg(F.max("turn")).first()[0] or 0) + 1):
                own = candidates.where(F.col("turn") == turn).join(missing(), "cell")
                if own.isEmpty():
                    continue
                if not self._greeted:
                    log.info(self.banner)
                    self._greeted = True
                rows = self.fetched(own, resolution).collect()  # a row a raster fetched
                for r in rows:
                    if r["why"]:
                        log.warning("%s: %s", r["url"], r["why"])
                came = [(r["url"], r["cell"]) for r in rows if not r["why"] or r["why"] == "no raster in it"]
                if came:
                    self.learned(spark, spark.createDataFrame(came, "header string, entry string"), resolution)
            candidates.unpersist()
        return self.files(spark, resolution).join(wanted.select("cell").distinct(), "cell", "left_semi")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, no, line of a text file."""
    text = spark.read.text(sinks.uri(path), wholetext=True)
    return text.select(F.lit(0).cast("long").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("no", "line")).select("file", F.col("no").cast("long").alias("no"), F.trim("line").alias("line"))


class Indexed(Source):
    """A source with an index file in its folder, which is made from the web when it isn't there, or is of
    another version."""

    def index_file(self, resolution: int) -> str:
        raise NotImplementedError

    def index_title(self, resolution: int) -> tuple[str, int]:
        """Title and version of the index."""
        raise NotImplementedError

    def index_made(self, spark: SparkSession, resolution: int) -> DataFrame:
        """(header, entry) from the web."""
        raise NotImplementedError

    def index(self, spark: SparkSession, resolution: int, anew: bool = False) -> DataFrame:
        """(header, entry)."""
        store, path = sinks.opened(f"{self.folder}/{self.index_file(resolution)}")
        if store.get_file_info(path).is_file and not anew:
            lines = read_lines(spark, f"{self.folder}/{self.index_file(resolution)}")
            if catalog.index_versions(lines).first()["version"] == self.index_title(resolution)[1]:
                headed = lines.union(spark.createDataFrame([(0, -1, "[]")], "file long, no long, line string"))
                return catalog.sections(headed).select(F.regexp_extract("header", r"^\[(.*)\]$", 1).alias("header"), "entry")
        return self.saved(spark, self.index_made(spark, resolution), resolution)

    def saved(self, spark: SparkSession, index: DataFrame, resolution: int) -> DataFrame:
        rows = [(r["header"], r["entry"]) for r in index.select("header", "entry").distinct().collect()]  # of the world's cells
        index = spark.createDataFrame(rows, "header string, entry string")
        lines = catalog.index_lines(index, *self.index_title(resolution)).orderBy("no").collect()
        text = "".join(f"{r['line']}\n" for r in lines if r["line"] != "[]")
        sinks.put([(self.index_file(resolution), text.encode())], self.folder)
        return index

    def page(self, spark: SparkSession, url: str) -> DataFrame:
        return spark.createDataFrame([(self.fetch(url).decode("utf-8", "replace"),)], "html string")


class ViewFinder(Indexed):
    nick = "view"
    banner = "Tiles come from viewfinderpanoramas.org; please visit http://viewfinderpanoramas.org/dem3.html to support their author."
    # Addresses, file names and versions of that source's indices.
    maps = {r: f"http://viewfinderpanoramas.org/Coverage%20map%20viewfinderpanoramas_org{r}.htm" for r in (1, 3)}
    versions = {1: 2, 3: 4}

    def index_file(self, resolution: int) -> str:
        return f"viewfinderHgtIndex_{resolution}.txt"

    def index_title(self, resolution: int) -> tuple[str, int]:
        return f"VIEW{resolution}", self.versions[resolution]

    def index_made(self, spark: SparkSession, resolution: int) -> DataFrame:
        return catalog.image_map(self.page(spark, self.maps[resolution])).select(F.trim("url").alias("header"), F.col("cell").alias("entry"))

    def urls(self, spark: SparkSession, wanted: DataFrame, resolution: int) -> DataFrame:
        index = self.index(spark, resolution).select(F.col("header").alias("url"), F.col("entry").alias("cell"))
        return catalog.lookup(wanted, index).select("cell", F.explode("urls").alias("url"))

    def learned(self, spark: SparkSession, found: DataFrame, resolution: int) -> None:
        """Maps promise whole zones; what an archive held replaces its entries."""
        index = self.index(spark, resolution)
        own = index.join(found.select("header").distinct(), "header", "left_semi")
        if not catalog.index_diff(own, found.where("entry IS NOT NULL")).where("NOT same").isEmpty():
            self.saved(spark, catalog.index_updated(index, found), resolution)


class Sonny(Source):
    """A folder that its user fills: there is nothing to fetch without an account."""

    nick = "sonn"


class Alos(Source):
    nick, resolutions, extension = "alos", (1,), "tif"
    banner = "Tiles come from ALOS World 3D; please visit https://www.eorc.jaxa.jp/ALOS/en/dataset/aw3d30/aw3d30_e.htm."
    # Fixed value: where that source keeps its tiles.
    base = "https://www.eorc.jaxa.jp/ALOS/aw3d30/data/release_v2303/"

    def urls(self, spark: SparkSession, wanted: DataFrame, resolution: int) -> DataFrame:
        return wanted.select("cell", catalog.grouped_url(F.col("cell"), self.base).alias("url"))

    def members(self, url: str, data: bytes) -> dict[str, bytes]:
        """The archive's surface model, under the cell's name."""
        cell = url.rsplit("/", 1)[-1].split(".")[0]
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            found = [n for n in z.namelist() if n.upper().endswith("_DSM.TIF")]
            return {f"{cell[0]}{cell[2:]}.tif": z.read(found[0])} if found else {}


class Srtm(Indexed):
    """NASA's tiles: version 2.1 by continents, version 3.0 by a coverage map."""

    nick = "srtm"
    # Addresses and continents of that source, versions of its indices.
    old = "https://dds.cr.usgs.gov/srtm/version2_1/SRTM{}"
    continents = {1: [f"Region_0{k}" for k in range(1, 8)], 3: ["Africa", "Australia", "Eurasia", "Islands", "North_America", "South_America"]}
    coverage = "https://dds.cr.usgs.gov/ee-data/coveragemaps/kml/ee/srtm_v3_srtmgl{}.kml"
    new = {1: "https://earthexplorer.usgs.gov/download/5e83a3efe0103743/SRTM1{}V3/EE", 3: "https://earthexplorer.usgs.gov/download/5e83a43cb348f8ec/SRTM3{}V2/EE"}
    versions = {(1, 2.1): 1, (3, 2.1): 2, (1, 3.0): 2, (3, 3.0): 2}
    version = 3.0

    def configure(self, options) -> None:
        self.version = options.srtm_version

    def cache(self, resolution: int) -> str:
        return f"{self.folder}/SRTM{resolution}v{self.version:.1f}"

    def prepare(self, resolution: int) -> None:
        """The folder and the index of version 2.1 once had no version in their names; they are taken over."""
        if self.version == 2.1:
            for old, new in ((f"SRTM{resolution}", self.cache(resolution)), (f"hgtIndex_{resolution}.txt", f"{self.folder}/{self.index_file(resolution)}")):
                store, before = sinks.opened(f"{self.folder}/{old}")
                after = sinks.opened(new)[1]
                kinds = store.get_file_info([before, after])
                if kinds[0].type.value and not kinds[1].type.value:  # 0: nothing of that name
                    store.move(before, after)
        super().prepare(resolution)

    def index_file(self, resolution: int) -> str:
        return f"hgtIndex_{resolution}_v{self.version:.1f}.txt"

    def index_title(self, resolution: int) -> tuple[str, int]:
        return f"SRTM{resolution}v{self.version:.1f}", self.versions[resolution, self.version]

    def index_made(self, spark: SparkSession, resolution: int) -> DataFrame:
        if self.version == 2.1:
            pages = None
            for continent in self.continents[resolution]:
                own = self.page(spark, f"{self.old.format(resolution)}/{continent}").withColumn("continent", F.lit(continent))
                pages = own if pages is None else pages.union(own)
            return catalog.listing(pages).select(F.col("continent").alias("header"), F.col("file").alias("entry"))
        rings = rasters.kml_rings(self.page(spark, self.coverage.format(resolution)).select(F.col("html").alias("kml")))
        cells = polygon.filled_cells(rings)
        return catalog.odd_ones(cells).select(F.lit("").alias("header"), F.col("cell").alias("entry"))

    def urls(self, spark: SparkSession, wanted: DataFrame, resolution: int) -> DataFrame:
        index = self.index(spark, resolution)
        if self.version == 2.1:
            return catalog.by_continent(wanted, index, self.old.format(resolution))
        return catalog.by_coverage(wanted, index, self.new[resolution])


NICKS = tuple(sorted(o for s in Source.registry.values() for o in s.options()))
_made: dict[tuple[str, str], Source] = {}


def source(option: str, folder: str) -> Source:
    """The instance for an option such as view1, made once for a folder."""
    nick = option[:4]
    if nick not in Source.registry or option not in Source.registry[nick].options():
        raise ValueError(f"unknown source {option!r}; there are {', '.join(NICKS)}")
    if (nick, folder) not in _made:
        _made[nick, folder] = Source.registry[nick](folder)
    return _made[nick, folder]


def options(spark: SparkSession) -> DataFrame:
    rows = [(s.nick, r, f"{s.nick}{r}") for s in Source.registry.values() for r in s.resolutions]
    return spark.createDataFrame(rows, "nick string, resolution long, option string")
