"""Writers of map files: encoders for a tile's elements, and a data source that puts files down.

An encoder is a function of a File, which holds a tile's header and its ways in order; it
gives the whole file as bytes. A tile is bounded by the node budget, so are its bytes.
"""

from __future__ import annotations

import gzip
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import o5m, pbf, xml


@dataclass
class Way:
    way_id: int
    first_node: int
    closed: bool
    level: int
    kind: str
    lons: list[float]
    lats: list[float]  # of the nodes: a ring's first point isn't repeated


@dataclass
class File:
    box: tuple[float, float, float, float]
    generator: str = "hypso"
    osm_version: float = 0.6
    stamp: str = ""
    time: int = 0
    with_time: bool = False
    ways: list[Way] = field(default_factory=list)


ENCODERS: dict[str, Callable[[File], bytes]] = {"xml": xml.encode, "pbf": pbf.encode, "o5m": o5m.encode}
SUFFIX = {"xml": ".osm", "gzip": ".osm.gz", "pbf": ".osm.pbf", "o5m": ".o5m"}


def encode(file: File, kind: str, level: int = 9) -> bytes:
    """kind: xml, gzip (xml compressed), pbf or o5m."""
    if kind == "gzip":
        return gzip.compress(xml.encode(file), level, mtime=0)
    return ENCODERS[kind](file)


def classify(level: int, major: int, medium: int) -> str:
    return "elevation_major" if level % major == 0 else "elevation_medium" if level % medium == 0 else "elevation_minor"


def files(ways: DataFrame, boxes: DataFrame, kind: str, major: int = 200, medium: int = 100, gzip_level: int = 9, **header) -> DataFrame:
    """tile_seq, content: a file for each tile that has ways. boxes: tile_seq and the tile's
    min_lon, min_lat, max_lon, max_lat."""
    rows = ways.select("tile_seq", "way_id", "first_node", "closed", F.col("level").cast("long").alias("level"), "n_nodes", "lons", "lats").join(boxes.select("tile_seq", "min_lon", "min_lat", "max_lon", "max_lat"), "tile_seq")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("way_id")
        first = pdf.iloc[0]
        out = File((first["min_lon"], first["min_lat"], first["max_lon"], first["max_lat"]), **header)
        for r in pdf.itertuples(index=False):
            out.ways.append(Way(int(r.way_id), int(r.first_node), bool(r.closed), int(r.level), classify(int(r.level), major, medium), list(r.lons)[: r.n_nodes], list(r.lats)[: r.n_nodes]))
        return pd.DataFrame({"tile_seq": [int(first["tile_seq"])], "content": [encode(out, kind, gzip_level)]})

    return rows.groupBy("tile_seq").applyInPandas(run, "tile_seq long, content binary")


def uri(folder: str) -> str:
    """A folder as a URI; a path, relative ones too, is one of the local file system (on a cluster, name a shared one)."""
    return folder if "://" in folder else Path(folder).absolute().as_uri()


def opened(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri(path))


def put(rows: Iterable[tuple[str, bytes]], folder: str) -> int:
    """Write (name, content) rows into a folder given as a URI or path; a file appears under its
    name only when it is whole, so a task that runs again leaves one copy."""
    import uuid

    store, root = opened(folder)
    store.create_dir(root, recursive=True)
    n = 0
    for name, content in rows:
        part = f"{root}/.{name}.{uuid.uuid4().hex}"
        with store.open_output_stream(part) as out:
            out.write(content)
        store.move(part, f"{root}/{name}")
        n += 1
    return n


def register(spark) -> None:
    """The data source `mapfiles`: df(name, content).write.format("mapfiles").mode("append").save(folder)."""
    from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

    class Done(WriterCommitMessage):
        def __init__(self, n: int):
            self.n = n

    class Writer(DataSourceWriter):
        def __init__(self, folder: str, names: list[str]):
            self.folder, self.name, self.content = folder, names.index("name"), names.index("content")

        def write(self, iterator):
            return Done(put(((r[self.name], bytes(r[self.content])) for r in iterator), self.folder))

        def commit(self, messages):
            pass

        def abort(self, messages):
            pass

    class MapFiles(DataSource):
        @classmethod
        def name(cls):
            return "mapfiles"

        def writer(self, schema, overwrite):
            return Writer(self.options["path"], schema.names)

    spark.dataSource.register(MapFiles)
