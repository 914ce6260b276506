"""Counts of map files: nodes, ways and relations, by reading them again."""

from __future__ import annotations

import gzip
import io
import struct
import sys
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from . import pbf
from .o5m import END, NODE, RESET, WAY, read_unsigned

#: Fixed value of the o5m format: the kind of a relation.
RELATION = 0x12


def _xml(data: bytes) -> list[int]:
    out = {"node": 0, "way": 0, "relation": 0}
    for _, element in ET.iterparse(io.BytesIO(data)):
        if element.tag in out:
            out[element.tag] += 1
        element.clear()
    return list(out.values())


def _pbf(data: bytes) -> list[int]:
    out, at = [0, 0, 0], 0
    while at < len(data):
        size = struct.unpack(">i", data[at : at + 4])[0]
        about = dict(pbf.fields(data[at + 4 : at + 4 + size]))
        at += 4 + size
        body = dict(pbf.fields(data[at : at + about[3]]))
        at += about[3]
        if about[1] != b"OSMData":
            continue
        message = zlib.decompress(body[3]) if 3 in body else body[1]
        for field, group in pbf.fields(message):
            if field != 2:
                continue
            for kind, value in pbf.fields(group):  # nodes one by one, dense nodes, ways, relations
                if kind == 2:
                    out[0] += sum(b < 128 for b in dict(pbf.fields(value))[1])
                elif kind in (1, 3, 4):
                    out[{1: 0, 3: 1, 4: 2}[kind]] += 1
    return out


def _o5m(data: bytes) -> list[int]:
    out, at = [0, 0, 0], 0
    while at < len(data) and data[at] != END:
        kind, at = data[at], at + 1
        if kind == RESET:
            continue
        size, at = read_unsigned(data, at)
        at += size
        if kind in (NODE, WAY, RELATION):
            out[(NODE, WAY, RELATION).index(kind)] += 1
    return out


def elements(path: str, content: bytes) -> tuple[int, int, int]:
    """Nodes, ways and relations of a file, by its extension: .osm, .osm.gz, .osm.pbf or .o5m."""
    name = path.lower()
    if name.endswith(".gz"):
        name, content = name[:-3], gzip.decompress(content)
    count = _pbf if name.endswith(".pbf") else _o5m if name.endswith(".o5m") else _xml
    return tuple(count(content))


def counted(files: DataFrame) -> DataFrame:
    """path, nodes, ways and relations of map files (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, *elements(p, bytes(c))) for p, c in zip(pdf["path"], pdf["content"], strict=True)]
            yield pd.DataFrame(rows, columns=["path", "nodes", "ways", "relations"])

    return files.select("path", "content").mapInPandas(run, "path string, nodes long, ways long, relations long")


def main(argv: list[str]) -> int:
    """python -m hypso.sinks.counts file...: a line for each file, and the sums."""
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("hypso-counts").getOrCreate()
    total = [0, 0, 0]
    for r in counted(spark.read.format("binaryFile").load(argv).select("path", "content")).orderBy("path").collect():  # a row a file
        print(f"{r['path']}: {r['nodes']} nodes, {r['ways']} ways, {r['relations']} relations")
        total = [a + b for a, b in zip(total, r[1:], strict=True)]
    print("{} nodes, {} ways, {} relations".format(*total))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
