"""OSM XML: all nodes, then all ways."""

from __future__ import annotations

# The text of the format. The last part of a node and of a way's start is version and stamp.
HEAD = '<?xml version="1.0" encoding="utf-8"?>\n<osm version="%.1f" generator="%s">'
BOUNDS = '<bounds minlat="%s" minlon="%s" maxlat="%s" maxlon="%s"/>'
NODE = '<node id="%s" lat="%s" lon="%s"%s/>'
WAY = '<way id="%s"%s>%s<tag k="ele" v="%s"/><tag k="contour" v="elevation"/><tag k="contour_ext" v="%s"/></way>'
REF = '<nd ref="%s"/>\n'
FOOT = "</osm>\n"


def version(osm_version: float, stamp: str) -> str:
    return (' version="1"' if osm_version > 0.5 else "") + stamp


def encode(file) -> bytes:
    west, south, east, north = (f"{x:.7f}" for x in file.box)
    said = version(file.osm_version, file.stamp)
    out = [HEAD % (file.osm_version, file.generator), BOUNDS % (south, west, north, east)]
    for way in file.ways:
        for k, (lon, lat) in enumerate(zip(way.lons, way.lats, strict=True)):
            out.append(NODE % (way.first_node + k, f"{lat:.7f}", f"{lon:.7f}", said))
    for way in file.ways:
        ids = [*range(way.first_node, way.first_node + len(way.lons)), *[way.first_node] * way.closed]
        out.append(WAY % (way.way_id, said, "".join(REF % i for i in ids), way.level, way.kind))
    return "\n".join([*out, FOOT]).encode()
