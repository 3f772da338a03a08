"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns many points of a ring; a key belongs to the arc that ends at the next point
clockwise. A shard takes no more keys than its bound; the keys of an arc beyond it continue
clockwise to the next shard that has room. The bounds differ by one row at most and add up to the
number of keys, so every shard is exactly full and balance is guaranteed. Because arcs keep their
places when a shard comes or goes, most keys stay where they were.

Only the counts of the arcs are needed to decide this: a fixed number of them, whatever the
input. The driver walks the ring once and says for every arc which run of its keys goes to which
shard, as (arc, from, to, shard, first slot). Keys are ranked within their arc by hash, in small
buckets whose number grows with the input, so that no window holds more than a bounded share.

Defined results: a null id is a key like any other; equal rows are separate keys, next to each
other; ties of hashes are broken by id, text and size; a null or empty text has the size 1, a long one
its whole length; an empty table has no rows; columns of the input other than doc_id and text give
way. The law that holds is ``rows``.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.common import digits
from evidentia.plans.staging import staged

#: Parts in which rows alike in id and text are counted.
PARTS = 64


@dataclass(frozen=True)
class Ring:
    """shards with ``points`` virtual nodes each; rows that one window ranks, about."""

    shards: int = 8
    points: int = 64
    rows_per_bucket: int = 20_000

    def nodes(self) -> list[tuple[int, int]]:
        """(position, shard) of every virtual node, clockwise. A shard's points depend on it alone."""
        at = lambda s, v: int.from_bytes(hashlib.sha256(f"shard {s} point {v}".encode()).digest()[:4]) >> 1
        return sorted((at(s, v), s) for s in range(self.shards) for v in range(self.points))


@dataclass
class Run:
    arc: int
    start: int
    stop: int
    shard: int
    slot: int


def walk(counts: dict[int, int], nodes: list[tuple[int, int]], shards: int) -> list[Run]:
    """Who takes which keys of each arc, given how many keys the arcs have.

    First every shard fills from its own arcs, clockwise; then the keys left over in an arc
    continue clockwise from there, arc by arc, to the next shard that still has room."""
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used, taken, runs = [0] * shards, [0] * len(nodes), []

    def take(arc: int, shard: int, n: int) -> None:
        if n:
            runs.append(Run(arc, taken[arc], taken[arc] + n, shard, used[shard]))
            taken[arc] += n
            used[shard] += n

    for arc, (_, shard) in enumerate(nodes):
        take(arc, shard, min(counts.get(arc, 0), room[shard] - used[shard]))
    for arc in range(len(nodes)):
        step = arc
        while taken[arc] < counts.get(arc, 0):
            step = (step + 1) % len(nodes)
            shard = nodes[step][1]
            take(arc, shard, min(counts[arc] - taken[arc], room[shard] - used[shard]))
    return runs


def arc_of(place: Column, positions: list[int]) -> Column:
    """The index of the first position at or past ``place``, or 0 past the last: a binary search."""

    def between(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low % len(positions))
        middle = (low + high) // 2
        return F.when(place <= positions[middle], between(low, middle)).otherwise(between(middle + 1, high))

    return between(0, len(positions))


def shard_rows(documents: DataFrame, ring: Ring = Ring()) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row."""
    spark = documents.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    nodes = ring.nodes()
    # A key's place on the ring comes from the id alone, so other columns never move it.
    key = digits(F.col("doc_id"))
    place = F.shiftrightunsigned(F.xxhash64(key), 33)
    keys = documents.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        place.alias("place"), F.xxhash64(key, text, F.lit("order")).alias("order"),
    )
    keys = keys.withColumn("arc", arc_of(F.col("place"), [p for p, _ in nodes])).drop("place")
    # Rows that are alike in id and text are one row with a count, in a few parts; which of them takes
    # which place makes no difference. So one id, or one text, never fills a task.
    keys = keys.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)))
    keys = staged(keys.groupBy(*keys.columns).agg(F.count("*").alias("n")), "shard_keys")

    total = keys.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    fine = max(1, -(-total // (len(nodes) * ring.rows_per_bucket)))
    keys = keys.withColumn("fine", F.pmod(F.shiftrightunsigned("order", 20), F.lit(fine)).cast("int"))
    sizes = staged(keys.groupBy("arc", "fine").agg(F.sum("n").alias("n")), "shard_buckets")
    counts = {r["arc"]: r["n"] for r in sizes.groupBy("arc").agg(F.sum("n").alias("n")).collect()}
    runs = walk(counts, nodes, ring.shards)

    before = Window.partitionBy("arc").orderBy("fine").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).select("arc", "fine", "offset")
    within = Window.partitionBy("arc", "fine").orderBy("order", "doc_id", "text_crc32", "size", "part").rowsBetween(Window.unboundedPreceding, -1)
    ranked = keys.withColumn("rank", F.coalesce(F.sum("n").over(within), F.lit(0))).join(offsets, ["arc", "fine"])
    ranked = ranked.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).withColumn("rank", F.col("rank") + F.col("offset") + F.col("i"))
    # At most a run for each arc and shard, whatever the input.
    plan = spark.createDataFrame([(r.arc, r.start, r.stop, r.shard, r.slot) for r in runs], "of int, start long, stop long, shard int, first long")
    placed = ranked.join(F.broadcast(plan), (F.col("arc") == F.col("of")) & (F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("stop")))
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("rank") - F.col("start")).alias("slot"))
