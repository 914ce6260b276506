"""Scalar functions as column expressions: cell names, rounding, classes, codecs, projections."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH = 6378137.0
FOOT = 1.0 / 0.3048


def cell_name(lat: Column, lon: Column, pad: int = 2) -> Column:
    """[NS]YY[EW]XXX of the lower left corner; pad: digits of the latitude."""
    side = lambda x, plus, minus, digits: F.concat(F.when(x < 0, minus).otherwise(plus), F.format_string(f"%0{digits}d", F.abs(x)))
    return F.concat(side(lat, "N", "S", pad), side(lon, "E", "W", 3))


def cell_lat(name: Column) -> Column:
    """Latitude of a cell name; null if it is none."""
    number = F.regexp_extract(name, "^[NSns]([0-9]+)", 1).try_cast("long")
    return F.when(F.upper(F.substring(name, 1, 1)) == "S", -number).otherwise(number)


def cell_lon(name: Column) -> Column:
    number = F.regexp_extract(name, "^[NSns][0-9]+[EWew]([0-9]+)", 1).try_cast("long")
    return F.when(F.upper(F.regexp_extract(name, "^[NSns][0-9]+([EWew])", 1)) == "W", -number).otherwise(number)


def low_int(x: Column) -> Column:
    return F.floor(x)


def high_int(x: Column) -> Column:
    return F.ceil(x)


def close_int(x: Column) -> Column:
    """The nearest whole number, the lower one of two."""
    return F.when(F.ceil(x) - x < x - F.floor(x), F.ceil(x)).otherwise(F.floor(x))


def whole_numbers(a: Column, b: Column) -> Column:
    """Whole numbers from ceil(a) up to but not including ceil(b); empty if there are none."""
    return F.when(F.ceil(a) < F.ceil(b), F.sequence(F.ceil(a), F.ceil(b) - 1)).otherwise(F.array().cast("array<bigint>"))


def floor_multiple(x: Column, m: int) -> Column:
    return (F.floor(x / m) * m).cast("long")


def next_multiple(x: Column, step: int) -> Column:
    """The least multiple of step that isn't below x; for negatives, too."""
    return x + F.pmod(-x, F.lit(step))


def level_class(level: Column, major: int = 200, medium: int = 100) -> Column:
    return F.when(level % major == 0, "elevation_major").when(level % medium == 0, "elevation_medium").otherwise("elevation_minor")


def fixed(x: Column, digits: int) -> Column:
    """Decimal text rounded half to even on the exact value, without grouping."""
    return F.replace(F.format_number(x, digits), F.lit(","), F.lit(""))


def quantised(x: Column) -> Column:
    """1e-7 degrees, cut off towards zero."""
    return (x * 1e7).cast("long")


def zigzag(n: Column) -> Column:
    """Sign in the lowest bit."""
    return F.when(n >= 0, F.shiftleft(n, 1)).otherwise(F.shiftleft(-n - 1, 1).bitwiseOR(F.lit(1)))


def varint_hex(n: Column) -> Column:
    """Groups of seven bits, lowest first, in hex; the high bit says that more follow. n >= 0."""
    groups = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda k: F.call_function("shiftrightunsigned", n, (k * 7).cast("int")))
    used = F.filter(groups, lambda x, k: (x > 0) | (k == 0))
    byte = F.transform(used, lambda x, k: F.lower(F.lpad(F.hex(x % 128 + F.when(k + 1 < F.size(used), 128).otherwise(0)), 2, "0")))
    return F.array_join(byte, "")


def mercator_x(lon: Column) -> Column:
    return lon * (math.pi / 180.0) * EARTH


def mercator_y(lat: Column) -> Column:
    return F.log(F.tan(F.lit(math.pi / 4) + lat * (math.pi / 360.0))) * EARTH


def unmercator_lon(x: Column) -> Column:
    return x / EARTH * (180.0 / math.pi)


def unmercator_lat(y: Column) -> Column:
    return (F.atan(F.exp(y / EARTH)) * 2.0 - F.lit(math.pi / 2)) * (180.0 / math.pi)


def osm_timestamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def close(a: Column, b: Column) -> Column:
    """Whether two numbers differ by a billionth of the larger one at most."""
    return F.abs(a - b) <= F.greatest(F.abs(a), F.abs(b)) * 1e-9


def aligned(low_left: Column, high_left: Column, high_right: Column, low_right: Column) -> Column:
    """Whether four corners (structs of lon and lat) make a rectangle along meridians and parallels."""
    return close(low_left["lat"], low_right["lat"]) & close(low_left["lon"], high_left["lon"]) & close(high_left["lat"], high_right["lat"]) & close(high_right["lon"], low_right["lon"])
