"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Every row gets a global number r in 0..n-1 by (doc_id, crc32, size) order. A keyed
generalised Feistel network permutes Z_a x Z_b, the smallest grid a*b >= n with at most
SLACK cells too many; cells at or beyond n are walked until they fall inside, so the
result p is a permutation of 0..n-1 and needs at most SLACK + 1 applications. Then
shard = p mod shards and slot = p div shards: shard sizes differ by one row at most,
slots have no gaps, and where a row goes follows from (r, n, seed) alone - see
`position()`, which needs no Spark.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import exact, table, written

#: Cells of the grid beyond n, at most; bounds the cycle walk.
SLACK = 15
PRIME = (1 << 31) - 1
MULTIPLIERS = (1_103_515_245, 1_664_525 * 613 % PRIME)
ROUNDS = 4
SHARDS = 40


def grid(n: int) -> tuple[int, int, int]:
    """(a, b, steps): a*b >= n >= 1, and steps applications always end inside n."""
    a = max(1, math.isqrt(n))
    best = None
    for side in range(a, 8 * a + 16):
        spare = -n % side
        if best is None or spare < best[0]:
            best = (spare, side)
        if spare <= SLACK:
            break
    spare, side = best
    return side, -(-n // side), spare + 1


def round_keys(seed: int) -> list[int]:
    keys, x = [], (seed * 2_654_435_761 + 1) % PRIME
    for _ in range(2 * ROUNDS):
        x = (x * 48_271 + 11) % PRIME
        keys.append(x)
    return keys


def _mix(x, key, floor_div):
    """A keyed round function; works on Python ints and on columns (all values stay under 2^63)."""
    x = (x * MULTIPLIERS[0] + key) % PRIME
    x = (x + floor_div(x, 1 << 13)) % PRIME
    x = (x * MULTIPLIERS[1] + key) % PRIME
    return x + floor_div(x, 1 << 15)


def position(r: int, n: int, seed: int = 0) -> int:
    """Where row number r of n goes, in plain Python."""
    a, b, _ = grid(n)
    keys = round_keys(seed)
    div = lambda x, d: x // d
    while True:
        left, right = r % a, r // a
        for i in range(ROUNDS):
            left = (left + _mix(right, keys[2 * i], div)) % a
            right = (right + _mix(left, keys[2 * i + 1], div)) % b
        r = left + a * right
        if r < n:
            return r


def _permuted(r: Column, n: int, seed: int) -> Column:
    a, b, steps = grid(n)
    keys = F.array(*[F.struct(F.lit(x).cast("long").alias("x"), F.lit(y).cast("long").alias("y")) for x, y in zip(*[iter(round_keys(seed))] * 2, strict=True)])
    div = lambda x, d: F.shiftright(x, d.bit_length() - 1)  # noqa: E731  d is a power of two
    side = F.lit(a).cast("long")

    def one_round(acc: Column, key: Column) -> Column:
        left = (acc["l"] + _mix(acc["r"], key["x"], div)) % side
        return F.struct(left.alias("l"), ((acc["r"] + _mix(left, key["y"], div)) % F.lit(b).cast("long")).alias("r"))

    def once(x: Column) -> Column:
        start = F.struct((x % side).alias("l"), ((x - x % side) / side).cast("long").alias("r"))
        return F.aggregate(keys, start, one_round, lambda acc: acc["l"] + acc["r"] * side)

    first = once(r)
    if steps == 1:
        return first
    return F.aggregate(F.sequence(F.lit(2), F.lit(steps)), first, lambda p, _: F.when(p < n, p).otherwise(once(p)))


def feistel_shards(docs: DataFrame, shards: int = SHARDS, seed: int = 0, text: str = "text", key: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all by default) with size, text_crc32, row_number, position,
    shard and slot added.

    Nulls: a null text has no bytes (size 16, crc 0); null keys come first in the row
    order. Very long texts are sized and summed whole. Repeated rows are separate rows
    with separate slots; which of two identical rows gets which is immaterial. An empty
    table gives an empty result. Extra columns pass through; one that has the name of an
    added column is replaced.
    """
    keep = docs.columns if keep is None else keep
    added = ["size", "text_crc32", "row_number", "position", "shard", "slot"]
    body = exact(text)
    base = docs.select(
        F.struct(*[exact(c) for c in keep if c not in added] or [F.lit(None).alias("_none")]).alias("_row"),
        exact(key).alias("_k"),
        (F.coalesce(F.octet_length(body), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(body), F.lit(0)).cast("long").alias("text_crc32"),
        F.monotonically_increasing_id().alias("_tie"),
    )
    order = ["_k", "text_crc32", "size", "_tie"]  # the last parts the copies of a row that occurs very often
    ranged = base.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = written(ranged.withColumn("_m", F.monotonically_increasing_id()))  # partition and place, fixed from here on
    rows = rows.withColumn("_p", F.shiftright("_m", 33))
    counts = rows.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))  # one row for each partition
    before = F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_p", F.coalesce(before, F.lit(0)).alias("_before"))
    n = max(1, rows.count())
    numbered = rows.join(F.broadcast(offsets), "_p").withColumn("row_number", F.col("_before") + F.col("_m").bitwiseAND((1 << 33) - 1))
    placed = numbered.withColumn("position", _permuted(F.col("row_number"), n, seed))
    shard = (F.col("position") % shards).cast("int")
    slot = ((F.col("position") - F.col("position") % shards) / shards).cast("long")
    return placed.select(*[F.col("_row")[c].alias(c) for c in keep if c not in added], "size", "text_crc32", "row_number", "position", shard.alias("shard"), slot.alias("slot"))


def op3_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = feistel_shards(docs, keep=["doc_id"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number", "position")
