"""Repeated passages: sliding sentence spans (substring dedup) and winnowed lines (line dedup).

Both cut a text into units, take runs of consecutive units and delete what a run covers if
the same run occurs earlier: in the text itself, or in a document of lower doc_id. Units keep
their separators, so a text is the concatenation of its units and what is left of it is the
concatenation of the units that are left.

Runs are compared by 128 bits of hashes. Globally, only the lowest doc_id of each is looked up
(an aggregate with map-side combining), then joined back to the runs; no group of equal runs
is ever gathered, and no pairs within one are made. Runs carry their places (units, and bytes
of the text), so the text itself is joined once, at the end, and cut by SQL functions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import BLANKS, exact, small_batches, table, written

#: A sentence span: at least so many sentences, and so many words.
SENTENCES, WORDS = 2, 8
#: Lines in a window: every repeated run of so many lines has a common fingerprint.
LINES = 2
#: Words from which on a line is a window by itself.
LONG = 8

_LAST = (1 << 63) - 1
_END = re.compile(r"[.!?][\"')\]|]*\s+|\n\s*")
_ADDED = ("clean_text", "n_removed", "removed")
_PLACE = "_from int, _to int, _first int, _end int"


class Run(NamedTuple):
    """Units from first to before end, a hash of what they say, and whether the text has it before."""

    first: int
    end: int
    hash: bytes
    again: bool


def sentences(text: str) -> list[str]:
    """Sentences with the blanks after them: one ends after a full stop, question or exclamation
    mark with its closing marks before a blank, and at a line end. In work linear in the text."""
    units, at = [], 0
    for found in _END.finditer(text):
        units.append(text[at : found.end()])
        at = found.end()
    return [*units, text[at:]] if at < len(text) else units


def sentence_spans(text: str, count: int = SENTENCES, words: int = WORDS) -> tuple[list[str], list[Run]]:
    """Units, and the shortest runs of at least `count` units and `words` words, one from each start
    and one to each end that has any. Which they are depends on their own units alone."""
    units = sentences(text)
    sizes, hashes = [], []
    for u in units:
        bare = u.split()
        sizes.append(len(bare))
        hashes.append(xxhash.xxh3_128_digest(" ".join(bare)))
    total = [0]
    for size in sizes:
        total.append(total[-1] + size)
    places, high = set(), 0
    for low in range(len(units)):
        while high < len(units) and (high - low < count or total[high] - total[low] < words):
            high += 1
        if high - low < count or total[high] - total[low] < words:
            break
        places.add((low, high))
    low = 0
    for high in range(count, len(units) + 1):
        while high - low - 1 >= count and total[high] - total[low + 1] >= words:
            low += 1
        if total[high] - total[low] >= words:
            places.add((low, high))
    out, seen = [], set()
    for first, end in sorted(places):
        h = xxhash.xxh3_128_digest(b"".join(hashes[first:end]))
        out.append(Run(first, end, h, h in seen))
        seen.add(h)
    return units, out


def line_prints(text: str, count: int = LINES, long: int = LONG) -> tuple[list[str], list[tuple[int, list[Run]]]]:
    """Units (lines with their line end), and the fingerprints: for each line that some window
    selects, in order, its hash and the windows that selected it.

    A window is `count` lines in a row that have a word, or one line of `long` or more words. It selects
    the line of least hash, of several the last one, so equal windows select the same line of theirs.
    Neighbouring windows mostly select the same line and so are one fingerprint.
    """
    units = text.split("\n")
    units = [u + "\n" for u in units[:-1]] + ([units[-1]] if units[-1] else [])
    real = [(k, b) for k, u in enumerate(units) if (b := u.strip(BLANKS))]
    digests = [xxhash.xxh3_128_digest(b) for _, b in real]
    prints = [int.from_bytes(d[:8], "little", signed=True) for d in digests]
    alone = [len(b.encode().split(None, long)) >= long for _, b in real]
    chosen: list[list[tuple[int, int]]] = [[(k, k + 1)] if one and count > 1 else [] for k, one in enumerate(alone)]
    for low in range(len(real) - count + 1):
        least = min(range(low, low + count), key=lambda k: (prints[k], -k))
        chosen[least].append((low, low + count))
    out, seen = [], set()
    for at, windows in enumerate(chosen):
        runs = []
        for low, high in windows:
            h = xxhash.xxh3_64_digest(b"".join(digests[low:high]))
            runs.append(Run(real[low][0], real[high - 1][0] + 1, h, (prints[at], h) in seen))
            seen.add((prints[at], h))
        if runs:
            out.append((prints[at], runs))
    return units, out


def _place(key: str, text: str) -> list[Column]:
    """`_doc`, the document's place in the order: its doc_id, null last and by a hash of the text, and
    `_salt`, which tells texts of one doc_id apart."""
    own = F.xxhash64(exact(text))
    return [F.coalesce(exact(key).cast("long"), F.lit(_LAST) - F.shiftrightunsigned(own, 2)).alias("_doc"), own.alias("_salt")]


def _mapped(docs: DataFrame, key: str, text: str, rows_of: Callable[[str], list[tuple]], schema: str) -> DataFrame:
    """_doc, _salt and the fields of schema for each tuple that rows_of finds in a text."""
    small_batches(docs.sparkSession)
    rows = docs.select(*_place(key, text), exact(text).alias("_text"))
    kinds = to_arrow_schema(StructType.fromDDL(f"_doc long, _salt long, {schema}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, salt, value in zip(*(batch.column(c).to_pylist() for c in ("_doc", "_salt", "_text")), strict=True):
                out += [(doc, salt, *own) for own in rows_of(value)] if value else []
                if len(out) >= 50_000:
                    yield _batch(out, kinds)
                    out = []
            if out:
                yield _batch(out, kinds)

    return rows.mapInArrow(run, f"_doc long, _salt long, {schema}")


def _batch(rows: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)


def _ends(units: list[str]) -> list[int]:
    """Bytes of the text before each unit, and all of them."""
    out = [0]
    for u in units:
        out.append(out[-1] + len(u.encode("utf-8", "surrogatepass")))
    return out


def _later(runs: DataFrame, by: list[str]) -> DataFrame:
    """_doc, _salt and place of the runs that are equal `by` some columns to one of a document before."""
    first = runs.groupBy(*by).agg(F.min("_doc").alias("_least"), F.max("_doc").alias("_most")).where("_least < _most").select(*by, "_least")
    # Written, so that the join doesn't take over the aggregate's partitions and can split a common run.
    found = runs.where("NOT _again").join(written(first), by).where("_doc > _least")
    columns = ["_doc", "_salt", "_from", "_to", "_first", "_end"]
    return found.select(*columns).union(runs.where("_again").select(*columns))


def _spans(later: DataFrame) -> DataFrame:
    """For each text with later runs, _spans: what they cover, as stretches that don't touch, in order."""
    own = Window.partitionBy("_doc", "_salt").orderBy("_from", "_to")
    before = F.max("_to").over(own.rowsBetween(Window.unboundedPreceding, -1))
    opened = later.withColumn("_new", F.coalesce(F.col("_from") > before, F.lit(True)).cast("int"))
    placed = opened.withColumn("_span", F.sum("_new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    spans = placed.groupBy("_doc", "_salt", "_span").agg(*[F.min(c).alias(c) for c in ("_from", "_first")], *[F.max(c).alias(c) for c in ("_to", "_end")])
    return spans.groupBy("_doc", "_salt").agg(F.sort_array(F.collect_list(F.struct("_from", "_to", "_first", "_end"))).alias("_spans"))


def _rewritten(docs: DataFrame, later: DataFrame, key: str, text: str, keep: list[str]) -> DataFrame:
    """The columns `keep` with clean_text, n_removed and removed ("first-end" of stretches of units)."""
    row = F.struct(*[exact(c) for c in keep] or [F.lit(0).alias("_none")]).alias("_row")
    rows = docs.select(row, *_place(key, text), exact(text).alias("_text")).join(written(_spans(later)), ["_doc", "_salt"], "left")
    some = F.col("_spans").isNotNull()
    rows = rows.select("_row", "_text", "_spans", F.when(some, F.col("_text").cast("binary")).alias("_bytes"))
    part = lambda a, b: F.substring("_bytes", a + 1, b - a).cast("string")
    following = lambda k: F.coalesce(F.get("_spans", k + 1)["_from"], F.octet_length("_text"))
    parts = F.concat(F.array(part(F.lit(0), F.get("_spans", F.lit(0))["_from"])), F.transform("_spans", lambda s, k: part(s["_to"], following(k))))
    return rows.select(
        *[F.col("_row")[c].alias(c) for c in keep],
        F.when(some, F.array_join(parts, "")).otherwise(F.col("_text")).alias("clean_text"),
        F.coalesce(F.aggregate("_spans", F.lit(0), lambda n, s: n + s["_end"] - s["_first"]), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.array_join(F.transform("_spans", lambda s: F.concat_ws("-", s["_first"], s["_end"])), ","), F.lit("")).alias("removed"),
    )


def _others(docs: DataFrame, text: str, keep: list[str] | None) -> list[str]:
    return [c for c in ([c for c in docs.columns if c != text] if keep is None else keep) if c not in _ADDED]


def without_repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: list[str] | None = None, count: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """Substring dedup: the columns `keep` (all but the text by default) with clean_text,
    n_removed (sentences) and removed ("first-end" of each stretch of them, from 0).

    Every run of `count` or more whole sentences with `words` or more words, as short as that allows
    from its first sentence on or back from its last one, is hashed; sentences that a run covers which
    occurs earlier are removed. One sentence by itself is no run however long, nor are sentences of
    fewer words, and of a passage put into the midst of another sentence the first and last one stay.

    "Earlier" is further up in the text, or in a document of lower doc_id. Documents without
    doc_id come last, in an order of their texts' hashes. Rows that share a doc_id count as one document
    (those without: if their texts are equal): what they have in common stays in each. A null text stays
    null; an empty one has no sentences. Very long texts are read whole. An empty table gives an
    empty result. Extra columns pass through; those with names of added columns are replaced.
    """

    def runs_of(value: str) -> list[tuple]:
        units, runs = sentence_spans(value, count, words)
        ends = _ends(units)
        return [(int.from_bytes(r.hash[:8], "little", signed=True), int.from_bytes(r.hash[8:], "little", signed=True), ends[r.first], ends[r.end], r.first, r.end, r.again) for r in runs]

    runs = written(_mapped(docs, key, text, runs_of, f"_a long, _b long, {_PLACE}, _again boolean"))
    return _rewritten(docs, _later(runs, ["_a", "_b"]), key, text, _others(docs, text, keep))


def without_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: list[str] | None = None, count: int = LINES, long: int = LONG) -> DataFrame:
    """Line dedup by winnowing: the columns `keep` (all but the text by default) with
    clean_text, n_removed (lines) and removed.

    Each window of `count` lines that have a word, and each line of `long` or more words, selects the
    least of its line hashes as its fingerprint. Positions of equal fingerprints are joined, those that
    only one document has are dropped. A match is extended both ways to the windows that selected the
    line, compared with the earliest document that has the same window around the same
    fingerprint; where the next line goes on to match, its own fingerprint carries the match further. So
    a repeated run goes from its first line to its last, blank lines within it included. A run of fewer
    than `count` lines without a long one stays.

    Order, nulls, shared doc_ids, long and empty texts, empty tables and extra columns: as in
    without_repeated_spans().
    """

    fields = ("_window", "_from", "_to", "_first", "_end", "_again")

    def prints_of(value: str) -> list[tuple]:
        units, prints = line_prints(value, count, long)
        ends = _ends(units)
        window = lambda r: (int.from_bytes(r.hash, "little", signed=True), ends[r.first], ends[r.end], r.first, r.end, r.again)
        return [(p, [dict(zip(fields, window(r), strict=True)) for r in runs]) for p, runs in prints]

    prints = written(_mapped(docs, key, text, prints_of, f"_print long, _windows array<struct<_window long, {_PLACE}, _again boolean>>"))
    shared = prints.groupBy("_print").agg(F.count(F.lit(1)).alias("_many")).where("_many > 1").select("_print")
    matched = prints.join(written(shared), "_print")
    windows = written(matched.select("_doc", "_salt", "_print", F.inline("_windows")))
    return _rewritten(docs, _later(windows, ["_print", "_window"]), key, text, _others(docs, text, keep))


def line_stage(docs: DataFrame) -> DataFrame:
    """Documents without repeated runs of lines, n_chars counted anew; those of which no word is left go.

    A text that had no word to begin with stays as it is, null ones too. Order, ties, repeated rows, long
    texts, empty tables and extra columns: as in without_repeated_lines(), whose added columns
    are not among the result's; columns of such names keep their values.
    """
    row = F.struct(*[exact(c) for c in docs.columns]).alias("_row")
    found = without_repeated_lines(docs.select(row, "doc_id", "text"), keep=["_row"])
    body = F.col("clean_text")
    left = found.where((F.length(F.translate(body, BLANKS, "")) > 0) | (F.col("n_removed") == 0))
    own = lambda c: F.length(body).cast(docs.schema[c].dataType) if c == "n_chars" else body if c == "text" else F.col("_row")[c]
    return left.select(*[own(c).alias(c) for c in docs.columns])


def op4_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substring dedup of all documents; see without_repeated_spans()."""
    found = without_repeated_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_removed", "removed", F.col("clean_text").alias("text"))


def op7_line_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line dedup of all documents; see without_repeated_lines()."""
    found = without_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_removed", "removed", F.col("clean_text").alias("text"))
