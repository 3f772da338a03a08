"""SimHash near-duplicates: fingerprints a few bits apart, found by chains around a ring of segments.

A fingerprint is cut into one segment more than the bits that may differ, laid out as a ring. If
two fingerprints differ in at most d of their bits, then somewhere on the ring starts a chain of
consecutive segments of which the first l together differ in at most l * d / (d + 1) bits, for
every l (the pigeonring principle, stronger than the pigeonhole one, which asks this of the first
segment alone). With d + 1 segments that is: the first agrees, two differ in one bit at most, three
in two, and so on around.

The first two conditions make the keys by which candidates meet: the whole first segment and all
but one part of the second, for an error of one bit lies in one part. With 64 bits, d = 4 and four
parts a fingerprint has 20 keys of about 23 bits. Candidates that share a key are tested along
the chain, one segment more at a time, and only those whose chain holds all the way get the full
Hamming distance.

Documents with the same fingerprint are one class from the start, and only classes meet. Keys of
one class are dropped before anything travels further. Keys with more classes than a block holds
are cut into blocks, and the pairs of blocks go to different tasks. In a task a search spreads
from one class over those not reached yet, so a dense crowd costs a few passes, not its square,
and what leaves is one link for each class to the least it reaches. Connected components of these
links hold every link.

Defined results: null and empty texts and those of white space have the fingerprint zero and are
linked like any other; one to three words are one shingle; a bit set in exactly half the hashes is
zero; repeated shingles count each time; very long texts are hashed in portions; repeated rows
share their fingerprint; a component is named by its least id, which is null only if all its ids
are; an empty table has no rows; columns other than doc_id and text give way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import bounded_batches
from evidentia.llm.components import connected_components
from evidentia.plans.staging import staged

BITS = 64
#: Shingles whose bits are spread out at a time.
PORTION = 1 << 16


@dataclass(frozen=True)
class SimHash:
    """words in a shingle; bits that linked fingerprints may differ in; parts of a chain's second
    segment; classes in a block; comparisons that a step holds in memory."""

    words: int = 4
    distance: int = 4
    parts: int = 4
    block: int = 1 << 14
    at_once: int = 1 << 20

    def segments(self) -> list[int]:
        """A mask for each segment of the ring, from the lowest bits up; widths differ by one at most."""
        m = self.distance + 1
        ends = [BITS * k // m for k in range(m + 1)]
        return [(1 << b) - (1 << a) for a, b in zip(ends, ends[1:])]

    def keys(self) -> list[tuple[int, int]]:
        """(chain, mask): chain k starts at segment k; a mask leaves out one part of the next segment."""
        ring = self.segments()
        if len(ring) < 2:
            return []
        found = []
        for k, own in enumerate(ring):
            after = ring[(k + 1) % len(ring)]
            low, width = (after & -after).bit_length() - 1, after.bit_count()
            ends = [low + width * p // self.parts for p in range(self.parts + 1)]
            found += [(k, own | (after & ~((1 << b) - (1 << a)))) for a, b in zip(ends, ends[1:])]
        return found

    def prefixes(self, chain: int) -> list[tuple[int, int]]:
        """(mask, most): of the chain's first l segments together, from two on, at most l * d / (d + 1) bits differ."""
        ring, mask, found = self.segments(), 0, []
        for length in range(1, len(ring) + 1):
            mask |= ring[(chain + length - 1) % len(ring)]
            found.append((mask, length * self.distance // len(ring)))
        return found[1:]


def fingerprint(text: str | None, words: int = 4) -> int:
    """The bits set in more than half the hashes of a text's shingles, as a signed 64-bit number."""
    own = (text or "").encode().lower().split()  # of bytes: A to Z, and just space and tab to carriage return
    if not own:
        return 0
    joined = b" ".join(own)
    sizes = np.fromiter(map(len, own), np.int64, len(own))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    last = ends[words - 1 :] if len(own) >= words else ends[-1:]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for k in range(0, len(last), PORTION):
        spans = zip(starts[k : k + PORTION].tolist(), last[k : k + PORTION].tolist())
        hashes = np.array([digest(joined[a:b], 42) for a, b in spans], ">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(last)).view(">i8")[0])


def _signed(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(text.as_py(), words) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return run


def near(left: np.ndarray, right: np.ndarray, chain: list[tuple[int, int]]) -> np.ndarray:
    """Which pairs hold along the chain; its last prefix is the whole ring, so the full distance."""
    difference = left ^ right
    mask, most = chain[0]
    holds = np.bitwise_count(difference & np.uint64(mask)) <= most
    for mask, most in chain[1:]:
        at = np.nonzero(holds)
        holds[at] = np.bitwise_count(difference[at] & np.uint64(mask)) <= most
    return holds


def reached(fps: np.ndarray, chain: list[tuple[int, int]], at_once: int = 1 << 20) -> np.ndarray:
    """For each fingerprint the index of the first one that it reaches over pairs of ``near``."""
    label = np.arange(len(fps))
    rest = np.arange(len(fps))
    while len(rest) > 1:
        first, rest = rest[0], rest[1:]
        front = np.array([first])
        while len(front) and len(rest):
            some = max(1, at_once // len(rest))
            now, front = front[:some], front[some:]
            hit = near(fps[now][:, None], fps[rest][None, :], chain).any(0)
            label[rest[hit]] = first
            front, rest = np.concatenate([front, rest[hit]]), rest[~hit]
    return label


def _links(rule: SimHash):
    """(mask, key, low, high, fp), in order -> links (a, b) of fingerprints."""
    prefixes = [rule.prefixes(k) for k, _ in rule.keys()]
    names = ["mask", "key", "low", "high", "fp"]

    def joined(held: list[pa.RecordBatch]) -> tuple[list[np.ndarray], np.ndarray]:
        columns = [np.concatenate([b.column(k).to_numpy() for b in held]) for k in range(len(names))]
        new = np.zeros(len(columns[0]), bool)
        new[:1] = True
        for c in columns[:4]:
            new[1:] |= c[1:] != c[:-1]
        return columns, np.flatnonzero(new)

    def within(columns: list[np.ndarray], starts: np.ndarray, stop: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        mask, fps = columns[0], columns[4].view(np.uint64)
        sizes = np.diff(starts, append=stop)
        for k, prefix in enumerate(prefixes):  # pairs, by far the most groups, all at once
            at = starts[(sizes == 2) & (mask[starts] == k)]
            at = at[near(fps[at], fps[at + 1], prefix)]
            yield fps[at], fps[at + 1]
        for at, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            own = fps[at : at + size]
            label = reached(own, prefixes[mask[at]], rule.at_once)
            later = np.flatnonzero(label != np.arange(size))
            yield own[label[later]], own[later]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if len(held) > 1 and all(held[0].column(k)[0] == batch.column(k)[batch.num_rows - 1] for k in range(4)):
                continue  # still one group
            columns, starts = joined(held)
            tail = int(starts[-1])
            for a, b in within(columns, starts[:-1], tail):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])
            held = [pa.RecordBatch.from_arrays([pa.array(c[tail:]) for c in columns], names)]
        if held:
            columns, starts = joined(held)
            for a, b in within(columns, starts, len(columns[0])):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return run


def near_links(classes: DataFrame, rule: SimHash = SimHash()) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of ``fp`` within the distance; fp is distinct."""
    spark = classes.sparkSession
    keys = [F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(mask - (mask >> 63 << 64)).cast("long")).alias("key")) for i, (_, mask) in enumerate(rule.keys())]
    if not keys:
        return spark.createDataFrame([], "a long, b long")
    keyed = classes.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.mask", "k.key")
    shared = keyed.groupBy("mask", "key").agg(F.count("*").alias("size")).filter("size > 1")
    members = keyed.join(shared, ["mask", "key"]).withColumn("blocks", F.ceil(F.col("size") / rule.block).cast("int"))
    members = members.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select("mask", "key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "fp")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    arranged = members.repartition(parts, "mask", "key", "low", "high").sortWithinPartitions("mask", "key", "low", "high", "fp")
    return arranged.mapInArrow(_links(rule), "a long, b long")


def simhash_groups(documents: DataFrame, rule: SimHash = SimHash()) -> DataFrame:
    """doc_id, fp, component_id (the least id reachable over links) and n_alike (rows with the fingerprint)."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    signed = bounded_batches(documents.select("doc_id", "text")).mapInArrow(_signed(rule.words), f"doc_id {kind}, fp long")
    signed = staged(signed, "simhash_signed")
    classes = staged(signed.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_alike")), "simhash_classes")
    links = staged(near_links(classes.select("fp"), rule).distinct(), "simhash_links")
    roots = connected_components(links).withColumnRenamed("key", "fp")
    named = roots.join(classes, "fp")
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    linked = named.join(least, "root").select("fp", "component_id")
    every = classes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"), "n_alike")
    return signed.join(staged(every, "simhash_groups"), "fp").select("doc_id", "fp", "component_id", "n_alike")
