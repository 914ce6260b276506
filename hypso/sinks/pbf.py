"""The PBF format: dense nodes, then ways, in compressed blobs of protocol-buffer messages."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from .o5m import read_unsigned, unsigned

# Fixed values of the format: units of 1e-7 degrees (boxes: 1e-9), elements in a block.
UNIT, BOX_UNIT, IN_BLOCK = 10_000_000, 1_000_000_000, 8_000


def zigzag(n: int) -> int:
    return 2 * n if n >= 0 else -2 * n - 1


def unzigzag(n: int) -> int:
    return -(n + 1) // 2 if n % 2 else n // 2


def number(field: int, n: int) -> bytes:
    return unsigned(field * 8) + unsigned(n)


def block(field: int, data: bytes) -> bytes:
    return unsigned(field * 8 + 2) + unsigned(len(data)) + data


def varints(values: np.ndarray) -> bytes:
    """Numbers of up to 64 bits (uint64), seven bits a byte, low ones first, all at once."""
    wide = max(1, -(-int(values.max(initial=0)).bit_length() // 7))
    left = values[:, None] >> (7 * np.arange(wide, dtype=np.uint64))
    there = left > 0
    there[:, 0] = True
    more = np.zeros_like(there)
    more[:, :-1] = there[:, 1:]
    return ((left & np.uint64(127)).astype(np.uint8) | (more.astype(np.uint8) << 7))[there].tobytes()


def packed(field: int, values: np.ndarray) -> bytes:
    return block(field, varints(values))


def deltas(values: np.ndarray) -> np.ndarray:
    """Each number less the one before, signs folded in."""
    step = np.diff(values.astype(np.int64), prepend=np.int64(0))
    return ((step << 1) ^ (step >> 63)).astype(np.uint64)


def blob(kind: str, message: bytes) -> bytes:
    body = number(2, len(message)) + block(3, zlib.compress(message, 9))
    head = block(1, kind.encode()) + number(3, len(body))
    return struct.pack(">i", len(head)) + head + body


def header(file) -> bytes:
    west, south, east, north = (zigzag(round(x * UNIT) * (BOX_UNIT // UNIT)) for x in file.box)
    box = number(1, west) + number(2, east) + number(3, north) + number(4, south)
    needs = b"".join(block(4, x) for x in (b"OsmSchema-V0.6", b"DenseNodes"))
    return blob("OSMHeader", block(1, box) + needs + block(16, file.generator.encode()))


def data_block(strings: list[str], group: bytes) -> bytes:
    return blob("OSMData", block(1, b"".join(block(1, s.encode()) for s in ["", *strings])) + block(2, group))


def encode(file) -> bytes:
    out = [header(file)]
    if file.ways:
        ids = np.concatenate([w.first_node + np.arange(len(w.lons)) for w in file.ways])
        lons, lats = (np.rint(np.concatenate([getattr(w, c) for w in file.ways]) * UNIT) for c in ("lons", "lats"))
        for low in range(0, len(ids), IN_BLOCK):
            part = slice(low, low + IN_BLOCK)
            out.append(data_block([], block(2, packed(1, deltas(ids[part])) + packed(8, deltas(lats[part])) + packed(9, deltas(lons[part])))))
    for low in range(0, len(file.ways), IN_BLOCK):
        names: dict[str, int] = {}
        group = []
        for w in file.ways[low : low + IN_BLOCK]:
            tags = (("ele", str(w.level)), ("contour", "elevation"), ("contour_ext", w.kind))
            place = [names.setdefault(x, len(names) + 1) for tag in tags for x in tag]
            refs = np.append(w.first_node + np.arange(len(w.lons)), [w.first_node] * w.closed)
            group.append(block(3, number(1, w.way_id) + packed(2, np.array(place[0::2], np.uint64)) + packed(3, np.array(place[1::2], np.uint64)) + packed(8, deltas(refs))))
        out.append(data_block(list(names), b"".join(group)))
    return b"".join(out)


def fields(data: bytes) -> list[tuple[int, int | bytes]]:
    """The fields of a message: numbers, or bytes of what is nested."""
    out, at = [], 0
    while at < len(data):
        key, at = read_unsigned(data, at)
        value, at = read_unsigned(data, at)
        if key % 8 == 2:
            value, at = data[at : at + value], at + value
        out.append((key // 8, value))
    return out


def unpacked(data: bytes) -> list[int]:
    out, at = [], 0
    while at < len(data):
        n, at = read_unsigned(data, at)
        out.append(n)
    return out


def _sums(data: bytes) -> list[int]:
    total, out = 0, []
    for n in unpacked(data):
        total += unzigzag(n)
        out.append(total)
    return out


def decode(data: bytes) -> tuple[dict[int, tuple[int, int]], dict[int, tuple[list[int], list[tuple[str, str]]]], dict]:
    """Nodes (in 1e-7 degrees: lon, lat), ways (refs and tags) and the header's box and generator."""
    nodes, ways, head, at = {}, {}, {}, 0
    while at < len(data):
        size = struct.unpack(">i", data[at : at + 4])[0]
        about = dict(fields(data[at + 4 : at + 4 + size]))
        at += 4 + size
        message = zlib.decompress(dict(fields(data[at : at + about[3]]))[3])
        at += about[3]
        found = fields(message)
        if about[1] == b"OSMHeader":
            box = dict(fields(dict(found)[1]))
            head = {"box": [unzigzag(box[k]) for k in (1, 4, 2, 3)], "generator": dict(found)[16].decode()}
            continue
        strings = [s.decode() for _, s in fields(dict(found)[1])]
        for kind, body in fields(dict(found)[2]):
            parts = dict(fields(body))
            if kind == 2:
                nodes |= dict(zip(_sums(parts[1]), zip(_sums(parts[9]), _sums(parts[8]), strict=True), strict=True))
            else:
                tags = [(strings[k], strings[v]) for k, v in zip(unpacked(parts[2]), unpacked(parts[3]), strict=True)]
                ways[parts[1]] = (_sums(parts[8]), tags)
    return nodes, ways, head
