"""Connectors against a made-up web: indices, candidates in turn, caches, options of their own."""

from __future__ import annotations

import functools
import http.server
import threading

import numpy as np
import pytest

from hypso import engine, options
from hypso.sources import connectors, made

FLAT = made.hgt_bytes(np.zeros((1201, 1201), int))


def web(pages: dict[str, bytes]):
    """Pages by address; what isn't there fails as the web does. A function within one, which workers get by value."""

    def fetch(url: str) -> bytes:
        if url not in pages:
            raise OSError(f"404: {url}")
        return pages[url]

    return fetch


def cells(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "cell string")


def found(df) -> dict[str, str]:
    return {r["cell"]: r["path"].rsplit("/", 1)[-1] for r in df.collect()}


def area(west: int, south: int, east: int, north: int, url: str) -> str:
    """Five pixels a degree, from 180 W and 90 N."""
    box = ",".join(str(5 * v) for v in (west + 180, 90 - north, east + 180, 90 - south))
    return f'<area shape="rect" coords="{box}" href="{url}">'


def test_viewfinder(spark, tmp_path):
    """The map promises four cells in one archive and two in another, which overlap; the first has one."""
    a, b, gone = "http://x.example/A.zip", "http://x.example/B.zip", "http://x.example/0.zip"
    pages = {
        connectors.ViewFinder.maps[3]: ("<map>" + area(5, 43, 7, 45, a) + area(6, 43, 7, 45, b) + area(6, 43, 7, 44, gone) + "</map>").encode(),
        a: made.zip_bytes({"A/n43e005.HGT": FLAT, "A/readme.txt": b"-"}),
        b: made.zip_bytes({"B/N43E006.hgt": FLAT, "B/N44E006.hgt": b"cut off"}),
    }
    source = connectors.ViewFinder(str(tmp_path), web(pages))
    assert found(source.ensured(spark, cells(spark, "N43E005", "N43E006", "N44E006", "N10E010"), 3)) == {"N43E005": "N43E005.hgt", "N43E006": "N43E006.hgt"}
    text = (tmp_path / "viewfinderHgtIndex_3.txt").read_text().splitlines()
    assert text == ["# VIEW3 index file, VERSION=4", f"[{gone}]", "N43E006", f"[{a}]", "N43E005", f"[{b}]", "N43E006", "N44E006"]
    assert sorted(p.name for p in (tmp_path / "VIEW3").iterdir()) == ["N43E005.hgt", "N43E006.hgt", "N44E006.hgt"]
    again = connectors.ViewFinder(str(tmp_path), web({}))  # from the cache and the saved index alone
    assert found(again.ensured(spark, cells(spark, "N43E005", "N43E006"), 3)) == {"N43E005": "N43E005.hgt", "N43E006": "N43E006.hgt"}
    (tmp_path / "viewfinderHgtIndex_3.txt").write_text("# VIEW3 index file, VERSION=3\n[http://old.example/x.zip]\nN00E000\n")
    assert {r["header"] for r in source.index(spark, 3).collect()} == {a, b, gone}  # of an old version: made anew


def test_nasa_by_continents(spark, tmp_path):
    root = connectors.Srtm.old.format(3)
    pages = {f"{root}/{c}": b"<a href='/'>up</a>" for c in connectors.Srtm.continents[3]}
    pages[f"{root}/Africa"] = b"<a href='N10E010.hgt.zip'>N10E010.hgt.zip</a> <a href='N11E010hgt.zip'> N11E010hgt.zip</a> <a>N12E010.jpg</a>"
    pages |= {f"{root}/Africa/N10E010.hgt.zip": made.zip_bytes({"N10E010.hgt": FLAT}), f"{root}/Africa/N11E010hgt.zip": made.zip_bytes({"N11E010.hgt": FLAT})}
    (tmp_path / "SRTM3").mkdir()
    (tmp_path / "SRTM3" / "N00E000.hgt").write_bytes(FLAT)
    source = connectors.Srtm(str(tmp_path), web(pages))
    source.configure(options.parse(["--srtm-version", "2.1", "x.hgt"], {}))
    assert set(found(source.ensured(spark, cells(spark, "N10E010", "N11E010", "N12E010", "N00E000"), 3))) == {"N10E010", "N11E010", "N00E000"}
    assert (tmp_path / "SRTM3v2.1").is_dir() and not (tmp_path / "SRTM3").exists()  # an old cache is taken over
    assert (tmp_path / "hgtIndex_3_v2.1.txt").read_text().splitlines() == ["# SRTM3v2.1 index file, VERSION=2", "[Africa]", "N10E010.hgt.zip", "N11E010hgt.zip"]


def test_nasa_by_coverage(spark, tmp_path):
    """Two degrees by two, with a hole of one."""
    ring = lambda w, s, e, n: " ".join(f"{x},{y},0" for x, y in ((w, s), (e, s), (e, n), (w, n), (w, s)))
    kml = "<kml><Placemark><Polygon>" + "".join(f"<LinearRing><coordinates>{c}</coordinates></LinearRing>" for c in (ring(6, 43, 8, 45), ring(7, 44, 8, 45))) + "</Polygon></Placemark></kml>"
    pages = {connectors.Srtm.coverage.format(1): kml.encode(), connectors.Srtm.new[1].format("N43E007"): b"no archive"}
    source = connectors.Srtm(str(tmp_path), web(pages))
    assert found(source.ensured(spark, cells(spark, "N43E007", "N44E007"), 1)) == {}
    assert (tmp_path / "hgtIndex_1_v3.0.txt").read_text().splitlines() == ["# SRTM1v3.0 index file, VERSION=2", "N43E006", "N43E007", "N44E006"]
    assert [r["url"] for r in source.urls(spark, cells(spark, "N43E007", "N44E007"), 1).collect()] == [connectors.Srtm.new[1].format("N43E007")]


def test_alos(spark, tmp_path):
    url = connectors.Alos.base + "N040E005/N043E006.zip"
    tif = made.tiff_bytes(np.zeros((5, 5), int), (6, 44), (0.25, 0.25))
    source = connectors.Alos(str(tmp_path), web({url: made.zip_bytes({"N043E006/ALPSMLC30_N043E006_DSM.tif": tif, "N043E006/ALPSMLC30_N043E006_MSK.tif": b"x"})}))
    assert found(source.ensured(spark, cells(spark, "N43E006", "N44E006"), 1)) == {"N43E006": "N43E006.tif"}
    assert (tmp_path / "ALOS1" / "N43E006.tif").read_bytes() == tif


def test_over_http(spark, tmp_path):
    """A real server on this machine; other schemes are refused."""
    (tmp_path / "web").mkdir()
    (tmp_path / "web" / "N43E006.zip").write_bytes(made.zip_bytes({"N43E006.hgt": FLAT}))
    handler = functools.partial(http.server.SimpleHTTPRequestHandler, directory=str(tmp_path / "web"))
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        base = f"http://127.0.0.1:{server.server_port}"
        urls = spark.createDataFrame([(f"{base}/N43E006.zip",), (f"{base}/nothing.zip",), ("file:///etc/passwd",)], "url string")
        rows = {r["url"].rsplit("/", 1)[-1]: (r["cell"], bool(r["why"])) for r in connectors.Sonny(str(tmp_path)).fetched(urls, 3).collect()}
    finally:
        server.shutdown()
    assert rows == {"N43E006.zip": ("N43E006", False), "nothing.zip": (None, True), "passwd": (None, True)}


def test_a_source_of_ones_own(spark, tmp_path):
    """Registered by its class, with an option; the engine asks it for what the one before hasn't."""

    class Mine(connectors.Source):
        nick, resolutions = "mine", (3,)

        @staticmethod
        def add_options(parser):
            parser.add_argument("--mine-base", default="http://nowhere.example")

        def configure(self, o):
            self.base = o.more["mine_base"]

        def urls(self, spark, wanted, resolution):
            from pyspark.sql import functions as F

            return wanted.select("cell", F.concat(F.lit(self.base + "/"), "cell", F.lit(".hgt")).alias("url"))

    try:
        with pytest.raises(ValueError):
            type("Other", (connectors.Source,), {"nick": "mine"})
        connectors._made["mine", str(tmp_path)] = Mine(str(tmp_path), web({"http://m.example/N43E007.hgt": FLAT}))
        (tmp_path / "SONN3").mkdir()
        (tmp_path / "SONN3" / "N43E006.hgt").write_bytes(FLAT)
        o = options.parse(["-a", "6.1:43.1:8.9:43.9", "--mine-base", "http://m.example", "--hgtdir", str(tmp_path)], {})
        o.source = ["sonn3", "mine3"]
        assert sorted(r["path"].rsplit("/", 2)[-2:] for r in engine.inputs(spark, o).select("path").collect()) == [["MINE3", "N43E007.hgt"], ["SONN3", "N43E006.hgt"]]
    finally:
        del connectors.Source.registry["mine"]
