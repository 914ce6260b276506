"""All options of a run, from the command line, the environment, a configuration file or defaults."""

from __future__ import annotations

import argparse
import json
import os
from dataclasses import dataclass, field, fields
from pathlib import Path

#: Prefix of environment variables: HYPSO_STEP=10.
ENVIRONMENT = "HYPSO_"
FORMATS = ("gzip", "pbf", "o5m")
VERSIONS, RESOLUTIONS = (2.1, 3.0), (1, 3)


class OptionError(ValueError):
    """Options that can't go together or have no such value."""


def _pair(text: str) -> tuple[int, int]:
    major, medium = (int(x) for x in str(text).split(","))
    if major <= 0 or medium <= 0:
        raise OptionError("line categories are two positive numbers")
    return major, medium


def _sources(text: str) -> list[str]:
    from .sources.connectors import NICKS

    out = [x.strip().lower() for x in text.split(",") if x.strip()]
    for x in out:
        if x not in NICKS:
            raise OptionError(f"unknown source {x!r}; there are {', '.join(NICKS)}")
    return out


def _area(text: str) -> tuple[float, float, float, float]:
    try:
        left, bottom, right, top = map(float, text.split(":"))
    except ValueError:
        raise OptionError(f"an area is left:bottom:right:top, not {text!r}") from None
    if bottom >= top or left == right:
        raise OptionError(f"the area {text!r} is empty")
    return left, bottom, right, top


def _option(default, parse, flags: str, text: str, **more):
    return field(default=default, metadata={"parse": parse, "flags": flags.split(), "help": text, **more})


@dataclass
class Options:
    area: tuple | None = _option(None, _area, "-a --area", "left:bottom:right:top in degrees")
    polygon: str | None = _option(None, str, "--polygon", "a polygon file that limits the output; its extent is the area if none is given")
    download_only: bool = _option(False, bool, "--download-only", "only see that the files are there")
    step: int = _option(20, int, "-s --step", "difference between contour levels, in metres or feet")
    feet: bool = _option(False, bool, "-f --feet", "levels in feet")
    no_zero: bool = _option(False, bool, "-0 --no-zero-contour", "no level 0")
    output_prefix: str = _option("", str, "-o --output-prefix", "prefix of output names")
    plot: str = _option("", str, "-p --plot", "write samples as longitude latitude height under this prefix")
    line_cat: tuple[int, int] = _option((200, 100), _pair, "-c --line-cat", "multiples that are major and medium levels")
    jobs: int = _option(1, int, "-j --jobs", "taken for compatibility: Spark schedules tasks")
    osm_version: float = _option(0.6, float, "--osm-version", "OSM API version")
    write_timestamp: bool = _option(False, bool, "--write-timestamp", "time stamps in the output")
    start_node_id: int = _option(10_000_000, int, "--start-node-id", "first node id")
    start_way_id: int = _option(10_000_000, int, "--start-way-id", "first way id")
    max_nodes_per_tile: int = _option(1_000_000, int, "--max-nodes-per-tile", "node budget of a tile; 0: one output for all")
    max_nodes_per_way: int = _option(2000, int, "--max-nodes-per-way", "longer ways are split; 0: never")
    epsilon: float | None = _option(0.0, float, "--simplifyContoursEpsilon", "how far lines may be off when simplified")
    disable_rdp: bool = _option(False, bool, "--disableRDP", "don't simplify at all")
    smooth: float = _option(1.0, float, "--smooth", "zoom of rasters by a cubic spline")
    gzip: int = _option(0, int, "--gzip", "compress XML, level 1 to 9")
    pbf: bool = _option(False, bool, "--pbf", "write PBF")
    o5m: bool = _option(False, bool, "--o5m", "write o5m")
    srtm: int = _option(3, int, "--srtm", "resolution in arc seconds, 1 or 3")
    srtm_version: float = _option(3.0, float, "--srtm-version", "2.1 or 3.0")
    source: list = _option(None, _sources, "--data-source --source", "sources in the order of preference")
    corrx: float = _option(0.0, float, "--corrx", "added to longitudes")
    corry: float = _option(0.0, float, "--corry", "added to latitudes")
    hgtdir: str = _option("hgt", str, "--hgtdir", "folder of cached tiles")
    rewrite_indices: bool = _option(False, bool, "--rewrite-indices", "make the indices again")
    void_range_max: int = _option(-0x8000, int, "--void-range-max", "samples at or under it are void")
    earthexplorer_user: str = _option("", str, "--earthexplorer-user", "kept for sources that ask for it")
    earthexplorer_password: str = _option("", str, "--earthexplorer-password", "kept for sources that ask for it")
    viewfinder_mask: int = _option(0, int, "--viewfinder-mask", "prefer this source, of resolution 1 or 3, before all others")
    log: str = _option("WARNING", str, "-l --log", "log level")
    output: str = _option(".", str, "--output-dir", "folder of the output")
    offline: bool = _option(False, bool, "--offline", "take cached tiles only, fetch nothing")
    files: list = _option((), list, "files", "raster files, or zip archives of them")
    more: dict = field(default_factory=dict)  # options that sources have added

    @property
    def kind(self) -> str:
        return "pbf" if self.pbf else "o5m" if self.o5m else "gzip" if self.gzip else "xml"

    def checked(self) -> Options:
        if sum(map(bool, (self.gzip, self.pbf, self.o5m))) > 1:
            raise OptionError("only one of gzip, pbf and o5m")
        if self.srtm not in RESOLUTIONS or self.viewfinder_mask not in (0, *RESOLUTIONS):
            raise OptionError("resolutions are 1 and 3")
        if self.srtm_version not in VERSIONS:
            raise OptionError("versions are 2.1 and 3.0")
        if not 0 <= self.gzip <= 9 or self.step <= 0 or self.smooth <= 0:
            raise OptionError("gzip goes from 1 to 9; step and smooth are positive")
        if self.max_nodes_per_way == 1:
            raise OptionError("a way needs two nodes")
        if not self.files and self.area is None and self.polygon is None:
            raise OptionError("nothing to do: no files, no area, no polygon")
        if self.polygon and "://" not in self.polygon and not Path(self.polygon).is_file():
            raise OptionError(f"there is no polygon file {self.polygon}")
        if self.source is None:
            self.source = [f"srtm{self.srtm}"]
        if self.viewfinder_mask:
            self.source = [f"view{self.viewfinder_mask}", *self.source]
        if self.disable_rdp:
            self.epsilon = None
        self.files = [f for f in self.files if f.rsplit(".", 1)[-1].lower() in ("hgt", "tif", "tiff", "zip")]
        return self


def _value(f, text):
    parse = f.metadata["parse"]
    if parse is bool and isinstance(text, str):
        return text.lower() in ("1", "true", "yes", "on")
    return parse(text) if isinstance(text, str) or parse not in (_area, _pair, _sources) else text


def parse(argv: list[str], environ: dict | None = None) -> Options:
    """Options from argv, else HYPSO_<NAME> in the environment, else a JSON file named by
    --config or HYPSO_CONFIG, else defaults."""
    from .sources.connectors import Source

    environ = dict(os.environ if environ is None else environ)
    parser = argparse.ArgumentParser(prog="hypso", description="Contour lines from elevation rasters.")
    parser.add_argument("--version", action="version", version="hypso 1")
    parser.add_argument("--config")
    own = [f for f in fields(Options) if f.metadata]
    for f in own:
        flags = f.metadata["flags"]
        if f.name == "files":
            parser.add_argument("files", nargs="*", help=f.metadata["help"])
        elif f.metadata["parse"] is bool:
            parser.add_argument(*flags, dest=f.name, action="store_true", default=None, help=f.metadata["help"])
        elif f.name == "gzip":
            parser.add_argument(*flags, dest="gzip", nargs="?", const="9", help=f.metadata["help"])
        else:
            parser.add_argument(*flags, dest=f.name, help=f.metadata["help"])
    for kind in Source.registry.values():
        kind.add_options(parser)
    given = vars(parser.parse_args(argv))
    path = given.pop("config") or environ.get(f"{ENVIRONMENT}CONFIG")
    stored = json.loads(Path(path).read_text()) if path else {}
    out = Options(more={k: v for k, v in given.items() if k not in {f.name for f in own}})
    for f in own:
        for value in (given[f.name] or None, environ.get(ENVIRONMENT + f.name.upper()), stored.get(f.name)):
            if value is not None:
                setattr(out, f.name, _value(f, value))
                break
    return out.checked()
