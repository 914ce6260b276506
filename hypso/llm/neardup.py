"""Near-duplicates by Order MinHash, verified by banded alignment.

A text is its sequence of five-word shingles, each labelled with its occurrence number, so
that all are different. A sketch takes the SAMPLED least labelled shingles under one random
order and keeps them in text order: two texts agree on it only if they share these shingles
in the same order, which makes it sensitive to edit similarity. Texts that agree on one of
SKETCHES sketches are candidates. They are linked if an alignment of their shingle
sequences, within the band that the threshold leaves, matches m of their n1 and n2 shingles
with m / (n1 + n2 - m) of at least SIMILAR. Labels don't count there: a repeated shingle may match any
of the same words.

Exact copies are one node from the start. In a bucket of equal sketches every node may be
aligned with the bucket's hub only, one of its nodes. In the first rounds a node is aligned with
the one or two hubs that it meets most often; rounds differ in their hubs and may differ in what makes a bucket:
equal sketches, or runs of them. In the last two rounds a node is aligned with the hubs of all its
buckets: the least node of each, then the greatest. A round is linear in the number of texts that share
anything; pairs within a bucket are never listed.

What the rounds leave is finished exactly, whether it shares a sketch or not. Nodes that may have a similar
partner are found first: of its first shingles in one random order, a text of a similar pair has a number in common
with the other's. Those in different classes are then joined by their rarest shingles: two texts with enough
shingles in common have one of them in a place, by how common they are, from which on there are as many. So every
similar pair ends in one class, and texts that share but a crowd's passage don't meet, as its shingles are the most common.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import exact, scratch, small_batches, table, written
from .graph import components

SHINGLE, SIMILAR = 5, 0.8
SKETCHES, SAMPLED = 32, 4
#: Rounds: consecutive sketches that make a bucket, the seed by which its hub is chosen (0: the least
#: node, -1: the greatest), and hubs that a node is aligned with (0: all it meets).
ROUNDS = ((1, 0, 1), (1, 1, 2), (1, 0, 0), (1, -1, 0))
_LAST = (1 << 63) - 1
#: Rows of one or two numbers up to which a side is broadcast: 16 bytes each.
SMALL = 100_000

_random = np.random.Generator(np.random.PCG64(7))
_XOR, _TIMES = _random.integers(0, 1 << 63, (2, 64), dtype=np.uint64) | np.uint64(1)
#: Shingles that are ranked at once.
_PART = 1 << 14
_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _P2
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """32 bits for each word (runs of other than ASCII white space)."""
    words = text.encode("utf-8", "surrogatepass").split()
    if not words:
        return np.zeros(0, np.uint32)
    return (pd.util.hash_array(np.array(words, dtype=object), categorize=False) >> np.uint64(32)).astype(np.uint32)


def shingles(words: np.ndarray, size: int = SHINGLE, labels: bool = True) -> np.ndarray:
    """Occurrence-labelled shingles, 64 bits each, all different (without labels: equal ones are equal).
    A text of fewer words is one shingle."""
    if not len(words):
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - size + 1)
    out = np.full(n, min(len(words), size), np.uint64)
    for k in range(min(size, len(words))):
        out = _mix(out * _P1 + words[k : k + n])
    if not labels:
        return out
    order = np.argsort(out, kind="stable")
    run = out[order]
    again = np.flatnonzero(run[1:] == run[:-1]) + 1
    if len(again):
        first = np.arange(n)
        first[again] = 0
        count = np.arange(n) - np.maximum.accumulate(first)
        label = np.empty(n, np.uint64)
        label[order] = count.astype(np.uint64)
        out = np.where(label > 0, _mix(out + label * _P1), out)
    return out


def sketches(labelled: np.ndarray, sampled: int = SAMPLED, count: int = SKETCHES) -> np.ndarray:
    """One 64-bit key for each of count (at most 64) sketches: the hash of the sampled shingles in text order."""
    n = len(labelled)
    if not n:
        return np.zeros(0, np.int64)
    key = _mix(np.arange(1, count + 1, dtype=np.uint64) * _P1)
    chosen = np.broadcast_to(np.arange(min(n, sampled)), (count, min(n, sampled)))
    for low in range(0, n, _PART) if n > sampled else ():  # memory is bounded whatever the length
        part = np.concatenate([chosen, np.broadcast_to(np.arange(max(low, sampled), min(low + _PART, n)), (count, max(0, min(low + _PART, n) - max(low, sampled))))], axis=1)
        ranks = (labelled[part] ^ _XOR[:count, None]) * _TIMES[:count, None]
        chosen = np.take_along_axis(part, np.argpartition(ranks, sampled - 1, axis=1)[:, :sampled], axis=1)
    chosen = np.sort(chosen, axis=1)
    for k in range(chosen.shape[1]):
        key = _mix(key * _P1 + labelled[chosen[:, k]])
    return key.astype(np.int64)


def chain(x: np.ndarray, y: np.ndarray) -> int:
    """The length of the longest common subsequence, whatever recurs: a bit for each place of x, a step for each of y."""
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    head = int(differ[0]) if len(differ) else n
    x, y, n = x[head:], y[head:], n - head
    differ = np.flatnonzero(x[len(x) - n :] != y[len(y) - n :])
    tail = n - 1 - int(differ[-1]) if len(differ) else n
    x, y = x[: len(x) - tail], y[: len(y) - tail]
    _, code = np.unique(np.concatenate([x, y]), return_inverse=True)
    places: dict[int, list[int]] = {}
    for k, c in enumerate(code[: len(x)].tolist()):
        places.setdefault(c, []).append(k)
    masks = {}
    for c in set(places).intersection(code[len(x) :].tolist()):
        bits = np.zeros(len(x), np.uint8)
        bits[places[c]] = 1
        masks[c] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    full = (1 << len(x)) - 1
    free = full
    for c in code[len(x) :].tolist():
        if c in masks:
            met = free & masks[c]
            free = (free + met | free - met) & full
    return head + tail + len(x) - free.bit_count()


def aligned(x: np.ndarray, y: np.ndarray, similar: float = SIMILAR, plain: Callable[[], tuple[np.ndarray, np.ndarray]] | None = None) -> bool:
    """True if a banded alignment of two labelled shingle sequences reaches the similarity, or one of
    the plain() sequences does, in which repeats have no labels."""
    need = int(np.ceil(similar / (1 + similar) * (len(x) + len(y)) - 1e-9))
    if min(len(x), len(y)) < need or not need:
        return False
    band = max(len(x), len(y)) - need
    order = np.argsort(x)
    at = np.minimum(np.searchsorted(x, y, sorter=order), len(x) - 1)
    place = order[at]
    hit = x[place] == y
    if hit.sum() < need:  # labels don't change how many both have
        return False
    place = place[hit & (np.abs(place - np.arange(len(y))) <= band)]
    if len(place) >= need:
        if (place[1:] > place[:-1]).all():
            return True
        tails: list[int] = []  # longest chain of matches in the same order
        for p in place.tolist():
            k = bisect_left(tails, p)
            tails[k : k + 1] = [p]
        if len(tails) >= need:
            return True
    if plain is None:
        return False
    x, y = plain()
    return (len(np.unique(x)) < len(x) or len(np.unique(y)) < len(y)) and chain(x, y) >= need


def _sketched(docs: DataFrame, key: str, text: str) -> DataFrame:
    """_doc, _t (128 bits of the text; null for null), _keys and _words."""
    small_batches(docs.sparkSession)
    body = exact(text)
    rows = docs.select(F.coalesce(exact(key).cast("long"), F.lit(_LAST)).alias("_doc"), F.unhex(F.md5(body)).alias("_t"), body.alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, words = [], []
            for value in batch.column("_text").to_pylist():
                own = word_hashes(value or "")
                words.append(own.tobytes())
                keys.append(sketches(shingles(own)))
            yield pa.RecordBatch.from_arrays([batch.column("_doc"), batch.column("_t"), pa.array(keys, pa.list_(pa.int64())), pa.array(words, pa.binary())], names=["_doc", "_t", "_keys", "_words"])

    return rows.mapInArrow(run, "_doc long, _t binary, _keys array<long>, _words binary")


def similar_texts(a: bytes, b: bytes) -> bool:
    """aligned() for the stored words of two texts, with labels and without; the latter one is prepared once in a row."""
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    return aligned(shingles(x), _prepared(b), plain=lambda: (shingles(x, labels=False), shingles(y, labels=False)))


@lru_cache(4)
def _prepared(words: bytes) -> np.ndarray:
    return shingles(np.frombuffer(words, np.uint32))


def _few(rows: DataFrame) -> DataFrame:
    """Materialised rows of one or two numbers, marked for a broadcast if they are few."""
    return F.broadcast(rows) if rows.count() <= SMALL else rows


def _verified(pairs: DataFrame, texts: DataFrame, similar: Callable[[bytes, bytes], bool]) -> DataFrame:
    """The pairs (a, b) whose _words are similar. pairs is materialised."""
    one = texts.select(F.col("node").alias("a"), F.col("_words").alias("_wa")).join(_few(pairs), "a")
    both = one.join(texts.select(F.col("node").alias("b"), F.col("_words").alias("_wb")), "b").select("a", "b", "_wa", "_wb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [similar(a, b) for a, b in zip(batch.column("_wa").to_pylist(), batch.column("_wb").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def _buckets(run: int) -> Column:
    """The buckets of a node by its `_keys`: each run of so many sketches, the first following the last."""
    if run == 1:
        return F.col("_keys")
    wrapped = F.concat("_keys", F.slice("_keys", 1, run - 1))
    return F.transform(F.sequence(F.lit(1), F.size("_keys")), lambda k: F.xxhash64(k, F.slice(wrapped, k, run)))


def _pairs(active: DataFrame, labels: DataFrame | None, run: int, seed: int, hubs: int, ratio: float) -> DataFrame:
    """a, b: for each node the hubs of other components, and of a size that can match, that it
    meets in most buckets."""
    own = active.withColumn("label", F.col("node")) if labels is None else active.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    sizes = ["_size"] if ratio else []
    members = own.select("node", "label", *sizes, F.explode(_buckets(run)).alias("bucket"))
    place = F.xxhash64("node", F.lit(seed)) if seed > 0 else F.col("node") * (1 if seed == 0 else -1)
    of_hub = [F.min_by(c, place).alias(f"hub{c}") for c in sizes]
    several = members.groupBy("bucket").agg(F.min_by("node", place).alias("hub"), F.min_by("label", place).alias("hub_label"), *of_hub, F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").drop("x", "y")
    # Written, so that the join doesn't take over the aggregate's partitions and can split a bucket.
    met = members.join(written(several), "bucket").where("label <> hub_label")
    if ratio:
        met = met.where(F.least("_size", "hub_size") >= F.greatest("_size", "hub_size") * ratio)
    met = met.groupBy("node").agg(F.collect_list("hub").alias("met"))  # no more than its sketches
    if not hubs:
        return met.select(F.col("node").alias("a"), F.explode(F.array_distinct("met")).alias("b"))
    often = F.transform(F.array_distinct("met"), lambda h: F.struct(F.size(F.filter("met", lambda g: g == h)).alias("n"), h.alias("h")))
    return met.select(F.col("node").alias("a"), F.explode(F.slice(F.sort_array(often, asc=False), 1, hubs)).alias("h")).select("a", F.col("h")["h"].alias("b"))


class Common(NamedTuple):
    """What similar texts have in common, at the least."""

    #: Different numbers that stand for a text, by its _words.
    tokens: Callable[[bytes], np.ndarray]
    #: The part of a text's numbers that any similar text has.
    share: float
    #: How many numbers two texts of so many are to share.
    needed: Callable[[Column, Column], Column]
    #: The part of the longer text's numbers that the shorter one of a similar pair has, at the least.
    ratio: float


SIGNS = ("s0", "s1", "s2", "s3")
SHINGLES = Common(lambda words: shingles(np.frombuffer(words, np.uint32)), SIMILAR, lambda x, y: (x + y) * (SIMILAR / (1 + SIMILAR)), SIMILAR)


def _spared(n: int, common: Common) -> tuple[int, int]:
    """Of n numbers: how many a similar text may lack, and how many more are looked at in a prefix."""
    lacking = n - int(np.ceil(common.share * n - 1e-9))
    return lacking, max(1, min(n - lacking, lacking // 2))


def prefix(tokens: np.ndarray, common: Common) -> tuple[np.ndarray, int]:
    """The first of a text's numbers in one random order, and how many of them are, at the least,
    in the prefix of any similar text: as many as the shorter text's prefix has beyond what it may lack."""
    n = len(tokens)
    if not n:
        return tokens, 1
    first = sum(_spared(n, common))
    if first < n:
        tokens = tokens[np.argpartition(_mix(tokens * _P1), first - 1)[:first]]
    return tokens, _spared(int(np.ceil(common.ratio * n - 1e-9)), common)[1]


def _sparing(common: Common) -> bool:
    """Whether a prefix is less than the whole text: else looking for it costs as much as the end that it is to spare."""
    return sum(_spared(1000, common)) < 1000


def _flat(rows: DataFrame, tokens: Callable[[bytes], tuple[np.ndarray, int]]) -> DataFrame:
    """For each row of rows (longs and, last, _words) a row for each of its numbers: the longs, `n` and `token`."""
    longs = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = [batch.column(c).to_numpy() for c in longs]
            found: list[tuple[np.ndarray, int]] = []
            size, low = 0, 0
            for k, words in enumerate(batch.column("_words").to_pylist()):
                found.append(tokens(words))
                size += len(found[-1][0])
                if size >= _PART or k + 1 == batch.num_rows:
                    counts = [len(t) for t, _ in found]
                    columns = [np.repeat(c[low : k + 1], counts) for c in given]
                    columns += [np.repeat(np.array([n for _, n in found], np.int64), counts), np.concatenate([t for t, _ in found]).view(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[*longs, "n", "token"])
                    found, size, low = [], 0, k + 1

    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in [*longs, "n", "token"]))


def _signed(texts: DataFrame, common: Common) -> DataFrame:
    """node, how many numbers it has (n), and SIGNS, 256 bits: of each the parity of how many of the text's numbers
    fall on it. Two texts differ in no more bits than there are numbers that only one of them has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits, many = np.zeros((batch.num_rows, 256), np.uint8), np.zeros(batch.num_rows, np.int64)
            for k, words in enumerate(batch.column("_words").to_pylist()):
                found = common.tokens(words)
                many[k] = len(found)
                bits[k] = np.bincount((_mix(found * _P1) >> np.uint64(56)).astype(np.intp), minlength=256) & 1
            signs = np.packbits(bits, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(many), *[pa.array(np.ascontiguousarray(signs[:, k])) for k in range(4)]], names=["node", "n", *SIGNS])

    return texts.select("node", "_words").mapInArrow(run, ", ".join(f"{c} long" for c in ("node", "n", *SIGNS)))


def _hopeful(rows: DataFrame, common: Common) -> DataFrame:
    """_r of the rows that may have a similar text: those whose prefix has enough numbers in others' prefixes."""
    own = rows.where("_t IS NOT NULL").select("_r", F.xxhash64("_t").alias("_text"), "_words")
    own = _flat(own, lambda words: prefix(common.tokens(words), common))
    same = Window.partitionBy("token")
    shared = own.withColumns({"x": F.min("_text").over(same), "y": F.max("_text").over(same)}).where("x < y")
    return shared.groupBy("_r").agg(F.count(F.lit(1)).alias("many"), F.first("n").alias("n")).where("many >= n").select("_r")


def _left(texts: DataFrame, labels: DataFrame | None, common: Common) -> DataFrame:
    """a, b: all pairs of nodes that may be similar and are of different components.

    A node's numbers are put in order from the most common to the rarest. The rarest one that two
    similar texts share comes, in both, not before as many as they share. Numbers that only one
    component has count for nothing, and no pair of that component is listed, nor one whose SIGNS
    differ in more bits than similar texts have numbers of their own. Only what the order needs is
    shuffled with each number, as these rows are the most."""
    nodes = texts.select("node")
    nodes = nodes.withColumn("label", F.col("node")) if labels is None else nodes.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    nodes = written(nodes)
    signed = written(_signed(texts, common))
    sizes = written(signed.select("node", "n").join(nodes, "node"))

    def tokens(words: bytes) -> tuple[np.ndarray, int]:
        found = common.tokens(words)
        return found, len(found)

    # Most labels are the node itself: a distance of 0 takes no room.
    own = _flat(texts.join(_few(nodes), "node").select("node", (F.col("label") - F.col("node")).alias("off"), "_words"), tokens).drop("n")
    same = Window.partitionBy("token")
    label = F.col("node") + F.col("off")
    shared = own.withColumns({"many": F.count(F.lit(1)).over(same), "x": F.min(label).over(same), "y": F.max(label).over(same)}).where("x < y").drop("x", "y", "off")
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("many"), "token"))
    ranked = shared.withColumn("place", place).join(sizes, "node")
    rare = written(ranked.where(F.col("place") >= F.col("n") * common.share - 1e-6).select("token", "node", "label", "n", "place"))
    # Of a number's components the largest is met by the others only, so its own pairs aren't listed.
    counts = rare.groupBy("token", "label").agg(F.count(F.lit(1)).alias("many"))
    largest = counts.groupBy("token").agg(F.max_by("label", F.struct("many", "label")).alias("largest"), F.count(F.lit(1)).alias("labels")).where("labels > 1").drop("labels")
    met = written(rare.join(written(largest), "token").join(signed.drop("n"), "node"))
    one = met.where("label <> largest").select("token", *[F.col(c).alias(f"_{c}") for c in ("node", "label", "n", "place", *SIGNS)])
    pairs = one.join(met, "token").where("_label <> label AND (label = largest OR _node < node)")
    needed = common.needed(F.col("_n"), F.col("n"))
    differ = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"_{c}"))) for c in SIGNS), F.lit(0))
    pairs = pairs.where((F.least("_place", "place") >= needed - 1e-6) & (F.least("_n", "n") >= F.greatest("_n", "n") * common.ratio - 1e-6) & (differ <= F.col("_n") + F.col("n") - needed * 2 + 1e-6))
    return pairs.select(F.col("_node").alias("a"), F.col("node").alias("b")).distinct()


def linked_classes(rows: DataFrame, similar: Callable[[bytes, bytes], bool], common: Common, rounds: tuple = ROUNDS, ratio: float = 0.0) -> DataFrame:
    """_doc, _t, class_id, n_links and _class for each row of rows (_doc, _t, _keys and _words); equal _t
    are one node, null _t a class for each row. _class is the class's own number (null for null _t), as
    unlike texts of one doc_id may share a class_id. ratio: words of sizes in a lesser ratio are never
    similar, so such pairs need no alignment. All similar pairs are in one class, whether they
    share a key or not; n_links counts the links that were needed to find that."""
    links: DataFrame | None = None
    labels: DataFrame | None = None  # of linked nodes: the least node that one is linked to
    with scratch():  # what the end needs
        with scratch():  # what the rounds need
            with scratch():
                given = written(rows.withColumns({"_r": F.monotonically_increasing_id(), "_size": F.octet_length("_words")}))
                # A node has the keys of any of its rows, as they are equal, and the words of one, `pick`.
                nodes = given.where("_t IS NOT NULL").groupBy("_t").agg(F.min("_doc").alias("rep"), F.min("_r").alias("pick"), F.first("_size").alias("_size"), F.first("_keys").alias("_keys"))
                keyed = written(nodes.withColumn("node", F.monotonically_increasing_id()))
                active = keyed
                if _sparing(common):
                    hopeful = written(_hopeful(given, common))  # the others have no similar text
                    active = keyed.join(_few(hopeful.withColumnRenamed("_r", "pick")), "pick")
                active = written(active.select("node", "pick", "_size", "_keys"), outer=1)
                texts = written(given.select("_r", "_words").join(_few(active.select("node", F.col("pick").alias("_r"))), "_r").select("node", "_words"), outer=2)
                nodes = written(keyed.select("node", "_t", "rep"), outer=2)
                rows = written(given.select("_doc", "_t"), outer=2)
            active = active.select("node", "_size", "_keys")
            for how in rounds:
                with scratch():
                    pairs = written(_pairs(active, labels, *how, ratio))
                    if pairs.isEmpty():
                        continue
                    found = written(_verified(pairs, texts, similar), outer=2)
                    links = found if links is None else links.union(found)
                    both = links.union(links.select("b", "a"))
                    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")), outer=1)

        labels = None if links is None else components(links)
        with scratch():
            pairs = written(_left(texts, labels, common))
            if not pairs.isEmpty():
                found = written(_verified(pairs, texts, similar), outer=1)
                links = found if links is None else links.union(found)
                labels = None
        if links is not None:
            labels = components(links) if labels is None else labels
            least = nodes.join(labels, "node").groupBy("label").agg(F.min("rep").alias("class_id"))
            classes = labels.join(least, "label").select("node", "label", "class_id")
            degree = links.select(F.col("a").alias("node")).union(links.select("b")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
            named = nodes.join(classes, "node", "left").join(degree, "node", "left").select("_t", F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("label", "node").alias("_class"))
        else:
            named = nodes.select("_t", F.col("rep").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("node").alias("_class"))
        # Only this is needed further on: the words of all texts, keys and links are removed.
        return written(rows.select("_doc", "_t").join(written(named), "_t", "left").select("_doc", "_t", F.coalesce("class_id", "_doc").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "_class"), outer=True)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """_doc (doc_id; null as the last of numbers), _t, class_id (least doc_id of the class),
    n_links (verified links of its text) and _class (the class's own number): a row for each row of docs,
    those with null texts included.

    Rows of equal text are one class, whatever their doc_ids; a class is a connected component
    of similar texts. A null text, and so its row, is a class of its own; empty texts and ones
    without a word are equal only to the same. Texts of under five words are one shingle.
    Very long texts are sketched and aligned whole. Ties go to the lower doc_id. An empty table
    gives an empty result; other columns are not looked at.
    """
    return linked_classes(_sketched(docs, key, text), similar_texts, SHINGLES)


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each class: the one of least doc_id (null last; of several texts of one doc_id
    the one of least digest), and rows of null text as they are. Repeated rows are one class. Empty texts, long
    ones and ties: as in near_duplicates(). An empty table gives an empty one; all columns stay,
    whatever their names."""
    found = near_duplicates(docs, key, text)
    # Two texts of one doc_id may both carry the least doc_id of one class: the lower digest stays.
    kept = found.where("_t IS NOT NULL").groupBy("_class").agg(F.min(F.struct("_doc", "_t")).alias("least")).select("least._doc", "least._t")
    row = F.struct(*[exact(c) for c in docs.columns]).alias("_row")
    rows = docs.select(row, F.coalesce(exact(key).cast("long"), F.lit(_LAST)).alias("_doc"), F.unhex(F.md5(exact(text))).alias("_t"))
    out = rows.join(kept, ["_doc", "_t"], "left_semi").dropDuplicates(["_doc", "_t"])
    return out.select("_row").union(rows.where("_t IS NULL").select("_row")).select("_row.*")


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    restored = lambda c: F.when(F.col(c) < _LAST, F.col(c))
    return found.select(restored("_doc").alias("doc_id"), restored("class_id").alias("class_id"), "n_links")
