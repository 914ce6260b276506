"""Media columns: chroma fingerprints of audio, and recordings aligned by them.

A recording is unsigned 8-bit mono sound in a binary column. Frames of its spectrum are
folded to twelve pitch classes; over the image that these form in time, sixteen filters
(differences of rectangle sums, read from an integral image) give two bits each, packed
into a 32-bit integer for every frame. Two recordings are aligned at the offsets that many
of their common integers vote for, and match if many integers are equal and few bits differ
at one of them.

The first candidates come from sketches of RUN consecutive integers, in the buckets-and-hubs way of
neardup.linked_classes(): equal recordings are one node, and no pairs are listed. A pair of
integers is shared by chance between many recordings of a large table, a run of three seldom.
Matching recordings that share no such run are found by single integers at its end.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import exact, small_batches, table
from .neardup import _LAST, Common, linked_classes, shingles, sketches


class Tuning(NamedTuple):
    """Samples a second; samples in a frame and from one frame to the next; frames under the filters."""

    rate: int = 8000
    frame: int = 2048
    hop: int = 512
    span: int = 16


#: For bytes of text taken as samples, which are too few for long frames.
TEXT = Tuning(8000, 256, 32, 16)
#: Bits that may differ, integers that must be equal, and the part of the longer recording that must overlap.
ERRORS, EQUAL, OVERLAP = 0.15, 0.4, 0.8
#: Equal integers at one offset are, each with its occurrence number, common to both.
INTEGERS = Common(lambda codes: shingles(np.frombuffer(codes, np.uint32), 1), EQUAL * OVERLAP, lambda x, y: F.greatest(x, y) * (EQUAL * OVERLAP), OVERLAP)
#: Consecutive integers in a sketch, and sketches.
RUN, SKETCHES = 3, 20
#: Two rounds with all hubs that a node meets: the least and the greatest node of each bucket, which
#: makes all pairs of buckets of up to three; then another one.
ROUNDS = ((1, 0, 0), (1, -1, 0), (1, 1, 0))
#: Offsets, of the most votes, that are looked at.
PEAKS = 5
#: Filters: kind, first pitch class, classes, frames.
FILTERS = (
    (0, 0, 12, 16), (1, 0, 12, 16), (2, 0, 12, 16), (3, 0, 12, 16),
    (1, 0, 6, 12), (1, 6, 6, 12), (2, 0, 6, 12), (2, 6, 6, 12),
    (1, 2, 4, 8), (1, 8, 4, 8), (2, 3, 4, 8), (2, 7, 4, 8),
    (3, 0, 6, 8), (3, 6, 6, 8), (4, 0, 12, 12), (4, 3, 6, 16),
)
#: Bounds between the four levels of a filter.
LEVELS = (-0.12, 0.0, 0.12)
_GRAY = np.array([0, 1, 3, 2], np.uint32)
_BLOCK = 8192


@lru_cache
def folding(tuning: Tuning) -> np.ndarray:
    """Spectrum bins x pitch classes. A bin counts from where it is no wider than a semitone, so
    that every class above has bins of its own, up to the seventh octave of the piano."""
    bins = np.arange(tuning.frame // 2 + 1)
    pitch = bins * tuning.rate / tuning.frame
    used = (bins * (2 ** (1 / 12) - 1) >= 1) & (pitch <= 4200)
    out = np.zeros((len(bins), 12), np.float32)
    out[bins[used], np.round(12 * np.log2(pitch[used] / 440)).astype(int) % 12] = 1
    return out


def chroma(sound: bytes, tuning: Tuning = Tuning()) -> np.ndarray:  # noqa: B008
    """Frames x 12 pitch classes, each frame of unit length."""
    x = (np.frombuffer(sound, np.uint8).astype(np.float32) - 128) / 128
    n = (len(x) - tuning.frame) // tuning.hop + 1
    if n <= 0:
        return np.zeros((0, 12), np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(x, tuning.frame)[:: tuning.hop]
    hann, fold = np.hanning(tuning.frame).astype(np.float32), folding(tuning)
    out = np.empty((n, 12), np.float32)
    for low in range(0, n, _BLOCK):  # memory is bounded whatever the length
        part = frames[low : low + _BLOCK]
        power = np.abs(np.fft.rfft((part - part.mean(1, keepdims=True)) * hann, axis=1)) ** 2
        out[low : low + _BLOCK] = power @ fold
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def fingerprint(sound: bytes | None, tuning: Tuning = Tuning()) -> np.ndarray:  # noqa: B008
    """A 32-bit integer for each frame that has `span` frames from it on; none for shorter sound."""
    image = chroma(sound or b"", tuning)
    n = len(image) - tuning.span + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    total = np.zeros((len(image) + 1, 13))
    total[1:, 1:] = image.astype(np.float64).cumsum(0).cumsum(1)

    def rect(t: int, wide: int, c: int, high: int) -> np.ndarray:
        return total[t + wide : t + wide + n, c + high] - total[t : t + n, c + high] - total[t + wide : t + wide + n, c] + total[t : t + n, c]

    out = np.zeros(n, np.uint32)
    for kind, c, high, wide in FILTERS:
        h, w = high // 2, wide // 2
        if kind == 0:  # against the first class
            a, b = rect(0, wide, c + 1, high - 1) / (high - 1), rect(0, wide, c, 1)
        elif kind == 1:
            a, b = rect(0, wide, c + h, h), rect(0, wide, c, h)
        elif kind == 2:
            a, b = rect(w, w, c, high), rect(0, w, c, high)
        elif kind == 3:
            a, b = rect(0, w, c + h, h) + rect(w, w, c, h), rect(0, w, c, h) + rect(w, w, c + h, h)
        else:
            third = high // 3
            a, b = rect(0, wide, c + third, third) * 2, rect(0, wide, c, third) + rect(0, wide, c + 2 * third, third)
        level = np.searchsorted(LEVELS, np.log((1 + a) / (1 + b)))
        out = (out << np.uint32(2)) | _GRAY[level]
    return out


def votes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The offset histogram: for each offset of y in x, from 1 - len(y) on, how many integers are equal
    there, recurring ones included. Pairs of equal integers are counted; those of integers that recur
    so often that it would take longer are correlated. Memory is linear in the lengths."""
    n = len(x) + len(y) - 1
    size = 1 << (n - 1).bit_length()
    out = np.zeros(n, np.int64)
    in_x, in_y = np.argsort(x, kind="stable"), np.argsort(y, kind="stable")
    _, at_x, many_x = np.unique(x[in_x], return_index=True, return_counts=True)
    values, at_y, many_y = np.unique(y[in_y], return_index=True, return_counts=True)
    _, kx, ky = np.intersect1d(x[in_x[at_x]], values, assume_unique=True, return_indices=True)
    at_x, many_x, at_y, many_y = at_x[kx], many_x[kx], at_y[ky], many_y[ky]
    pairs = many_x * many_y
    often = pairs > 16 * size
    if often.any():
        both = np.zeros(size // 2 + 1, complex)
        for k in np.flatnonzero(often):
            sides = np.zeros((2, size))
            sides[0, in_x[at_x[k] : at_x[k] + many_x[k]]] = 1
            sides[1, in_y[at_y[k] : at_y[k] + many_y[k]]] = 1
            one, other = np.fft.rfft(sides, axis=1)
            both += one * np.conj(other)
        heard = np.rint(np.fft.irfft(both, size)).astype(np.int64)
        out += np.concatenate([heard[size - len(y) + 1 :], heard[: len(x)]])
    few = np.flatnonzero(~often)
    part = np.cumsum(pairs[few]) // (16 * size)
    for own in np.split(few, np.flatnonzero(np.diff(part)) + 1) if len(few) else ():
        many, end = pairs[own], np.cumsum(pairs[own])
        within = np.arange(end[-1]) - np.repeat(end - many, many)
        wide = np.repeat(many_y[own], many)
        where = in_x[np.repeat(at_x[own], many) + within // wide] - in_y[np.repeat(at_y[own], many) + within % wide]
        out += np.bincount(where + len(y) - 1, minlength=n)
    return out


def offsets(x: np.ndarray, y: np.ndarray, overlap: int = 1) -> list[int]:
    """Where y may start in x: the PEAKS offsets of most votes that leave an overlap of so many integers."""
    if not len(x) or not len(y):
        return []
    where = np.arange(1 - len(y), len(x))
    shared = np.minimum(len(x), len(y) + where) - np.maximum(0, where)
    heard = np.where(shared >= overlap, votes(x, y), -np.inf)
    best = np.argsort(-heard, kind="stable")[:PEAKS]
    return where[best[np.isfinite(heard[best])]].tolist()


def bit_errors(x: np.ndarray, y: np.ndarray, offset: int) -> tuple[int, int]:
    """Differing bits and integers that overlap when y starts at offset in x."""
    low, high = max(0, offset), min(len(x), len(y) + offset)
    if high <= low:
        return 0, 0
    return int(np.bitwise_count(x[low:high] ^ y[low - offset : high - offset]).sum()), high - low


def equal_integers(x: np.ndarray, y: np.ndarray, offset: int) -> int:
    low, high = max(0, offset), min(len(x), len(y) + offset)
    return int((x[low:high] == y[low - offset : high - offset]).sum()) if high > low else 0


def same_recording(a: bytes, b: bytes) -> bool:
    """Whether two fingerprints match at any offset at which enough of them overlaps."""
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    if not len(x) or not len(y):
        return False
    least = int(np.ceil(OVERLAP * max(len(x), len(y)) - 1e-9))
    if min(len(x), len(y)) < least:
        return False
    where = np.arange(1 - len(y), len(x))
    overlap = np.minimum(len(x), len(y) + where) - np.maximum(0, where)
    heard = votes(x, y)
    likely = np.flatnonzero((overlap >= least) & (heard >= EQUAL * overlap))
    for k in likely[np.argsort(-heard[likely], kind="stable")].tolist():
        bits, shared = bit_errors(x, y, int(where[k]))
        if bits <= ERRORS * 32 * shared:
            return True
    return False


def recordings(media: DataFrame, key: str, sound: Column, tuning: Tuning = Tuning()) -> DataFrame:  # noqa: B008
    """_doc, _t, class_id and n_links for each row of media: the class
    of recordings that align with each other, named by its least key.

    Recordings match if the best offset overlaps OVERLAP of the longer one, EQUAL of the integers are
    equal there, and at most ERRORS of the bits differ; so a clip of less than that is no match.

    Null sound is a class of its own and has no frames; sound too short for a fingerprint
    equals only its exact copies. Long sound is read whole, in blocks. Repeated rows are in
    one class; an empty table gives an empty result; other columns are not looked at.
    """
    small_batches(media.sparkSession)
    rows = media.select(F.coalesce(exact(key).cast("long"), F.lit(_LAST)).alias("_doc"), F.unhex(F.md5(sound)).alias("_t"), sound.alias("_sound"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, words = [], []
            for value in batch.column("_sound").to_pylist():
                codes = fingerprint(value, tuning)
                words.append(codes.tobytes())
                keys.append(sketches(shingles(codes, RUN), 1, SKETCHES))
            yield pa.RecordBatch.from_arrays([batch.column("_doc"), batch.column("_t"), pa.array(keys, pa.list_(pa.int64())), pa.array(words, pa.binary())], names=["_doc", "_t", "_keys", "_words"])

    found = rows.mapInArrow(run, "_doc long, _t binary, _keys array<long>, _words binary")
    return linked_classes(found, same_recording, INTEGERS, ROUNDS, ratio=OVERLAP)


def text_as_sound(text: Column) -> Column:
    """The bytes of a text taken as samples: a recording for tables that have none."""
    return F.encode(text, "UTF-8")


def op9_chroma_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of all documents' texts, taken as recordings; see recordings()."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = recordings(docs, "doc_id", text_as_sound(F.col("text")), TEXT)
    restored = lambda c: F.when(F.col(c) < _LAST, F.col(c))
    return found.select(restored("_doc").alias("doc_id"), restored("class_id").alias("class_id"), "n_links", F.lower(F.hex("_t")).alias("sound_md5"))
