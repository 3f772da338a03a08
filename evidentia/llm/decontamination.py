"""Benchmark decontamination: documents that hold a benchmark item or most of one, up to a few edits.

Texts and items are compared as lower-case words joined by single spaces. An item of n characters
may differ by ``rate * n`` edits. It is cut into one piece more than that budget; edits can spoil
all pieces but one, so any occurrence holds a piece unchanged (pigeonhole). One automaton finds
all pieces of all items in a single pass over a text. Around each hit Myers' bit-parallel
distance, with a free start and end, decides; windows of one item that overlap are joined first,
so no stretch of text is compared twice with an item.

An item may stand in a document in part only, as where a deduplication took single lines out of it.
So the lines of an item, long ones cut at words, are searched as well, each with its own pieces and
budget. Items of less than three segments' length have shorter ones, so that most of an item is
more than one of them; lines of items under three times ``shortest`` characters are not cut.
A document holds the item too if the segments it holds make up more than ``share`` of the
characters of all segments, wherever they stand. The distance reported for such a part is that of
the segments found plus the characters of those missing, and above the budget of the whole item.

The benchmark is the query set: it is read block by block, each of a fixed size. A benchmark of one
block meets all documents in one pass without a shuffle. Of a larger one, every block has a pass of
its own that writes its hits; a block's broadcast is given up before the next one is made, so a task
holds one automaton at any size of the benchmark, and the hits are joined to the documents at the end.

Defined results: null or empty items are never found; items so short that their budget is no edit
(under 13 characters at 8 %) are found as whole words, wherever they stand, so an item of one common
word is found in many documents; a null or empty text holds no item; a text of any length is searched whole; item ids that
repeat are reported once, with the least distance, null ids first; rows that agree in id and text
have equal results; empty tables give empty results. Of the columns of ``documents`` only doc_id and
text are read; ``without_leaks`` passes all on, whatever their names.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from evidentia.llm.common import bounded_batches
from evidentia.plans.staging import staged

_WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class EditMatching:
    """rate: edits for each character of an item. shortest: characters a segment has at least.
    block_chars: characters of items that are searched in one pass. segment: characters a segment
    of a long line has at least, if the item has three of them. share: see above."""

    rate: float = 0.08
    shortest: int = 20
    block_chars: int = 4_000_000
    segment: int = 60
    share: float = 0.5


def normal(text: str | None) -> str:
    return " ".join(_WORD.findall((text or "").lower()))


def pieces(length: int, budget: int) -> list[tuple[int, int]]:
    """Where the budget + 1 pieces of an item start and stop."""
    n = budget + 1
    return [(length * j // n, length * (j + 1) // n) for j in range(n)]


def segments(text: str, rule: EditMatching) -> list[str]:
    """The lines of an item, normalised; short ones joined to the next, long ones cut at words."""
    joined: list[str] = []
    for line in filter(None, map(normal, text.split("\n"))):
        if joined and len(joined[-1]) < rule.shortest:
            joined[-1] += " " + line
        else:
            joined.append(line)
    if len(joined) > 1 and len(joined[-1]) < rule.shortest:
        last = joined.pop()
        joined[-1] += " " + last
    found, total = [], sum(map(len, joined))
    # Of a line too short for three parts, one part could be more than half.
    least = min(rule.segment, max(rule.shortest, total // 3)) if total >= 3 * rule.shortest else total
    for line in joined:
        start, parts = 0, max(1, len(line) // max(least, 1))
        for k in range(1, parts):
            cut = line.find(" ", max(len(line) * k // parts, start + rule.shortest))
            if 0 < cut <= len(line) - rule.shortest - 1:
                found.append(line[start:cut])
                start = cut + 1
        found.append(line[start:])
    return found


def least_distance(masks: dict[str, int], length: int, text: str, most: int) -> int:
    """The least edit distance between the item and any part of ``text``; above ``most``, most + 1."""
    full, high = (1 << length) - 1, 1 << (length - 1)
    up, down, score, best = full, 0, length, most + 1
    for c in text:
        same = masks.get(c, 0)
        across = (((same & up) + up) ^ up) | same
        rises = down | (full & ~(across | up))
        falls = up & across
        if rises & high:
            score += 1
        elif falls & high:
            score -= 1
            if score < best:
                best = score
                if not best:
                    break
        rises = (rises << 1) & full
        falls = (falls << 1) & full
        same |= down
        up = falls | (full & ~(same | rises))
        down = rises & same
    return best


class Matcher:
    """Finds the items of one block. items: (id, text)."""

    def __init__(self, items: tuple[tuple[object, str], ...], rule: EditMatching):
        #: (id, characters, budget, masks, whether it is a segment); short items have no masks.
        self.items, self.rule = [], rule
        #: (item id, budget, places of its segments in ``items``, their characters) of items of several.
        self.parts: list[tuple[object, int, list[int], int]] = []
        self.found: dict[str, list[tuple[int, int]]] = {}
        known: dict[str, int] = {}
        for key, text in items:
            item = normal(text)
            if item and not int(rule.rate * len(item)):
                self.found.setdefault(item, []).append((len(self.items), 0))
                self.items.append((key, len(item), 0, None, False))
            elif item:
                self._add(key, item)
                cut = segments(text, rule)
                if len(cut) > 1:
                    # Segments are no items of their own; equal ones are searched once.
                    for s in cut:
                        if s not in known:
                            known[s] = self._add(None, s, part=True)
                    self.parts.append((key, int(rule.rate * len(item)), [known[s] for s in cut], sum(map(len, cut))))
        found = self.found
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        if found:
            self.automaton.make_automaton()

    def _add(self, key: object, item: str, part: bool = False) -> int:
        budget = int(self.rule.rate * len(item))
        masks: dict[str, int] = {}
        for i, c in enumerate(item):
            masks[c] = masks.get(c, 0) | 1 << i
        for start, stop in pieces(len(item), budget):
            self.found.setdefault(item[start:stop], []).append((len(self.items), start))
        self.items.append((key, len(item), budget, masks, part))
        return len(self.items) - 1

    def leaks(self, text: str | None) -> list[tuple[object, int]]:
        """(item id, distance) of the items that the text holds whole or for the most part."""
        own = normal(text)
        found: dict[object, int] = {}
        if not self.items or not own:
            return []
        windows: dict[int, list[tuple[int, int]]] = {}
        for end, (size, places) in self.automaton.iter(own):
            for i, start in places:
                key, length, budget, masks, _ = self.items[i]
                at = end + 1 - size - start
                if masks is None:
                    if own[max(at - 1, 0) : at] in ("", " ") and own[end + 1 : end + 2] in ("", " "):
                        found[key] = 0
                    continue
                low, high = max(0, at - budget), min(len(own), at + length + budget)
                spans = windows.setdefault(i, [])
                # Hits come by their end, so a window may begin before an earlier one; both are joined.
                while spans and low <= spans[-1][1]:
                    last = spans.pop()
                    low, high = min(low, last[0]), max(high, last[1])
                spans.append((low, high))
        held: dict[int, int] = {}
        for i, spans in windows.items():
            key, length, budget, masks, part = self.items[i]
            best = budget + 1
            for low, high in spans:
                best = min(best, least_distance(masks, length, own[low:high], budget))
            if best <= budget and part:
                held[i] = best
            elif best <= budget:
                found[key] = min(best, found.get(key, best))
        for key, budget, places, chars in self.parts if held else ():
            missing = sum(self.items[i][1] for i in places if i not in held)
            if chars - missing > self.rule.share * chars:
                apart = max(budget + 1, missing + sum(held.get(i, 0) for i in places))
                found[key] = min(apart, found.get(key, apart))
        return list(found.items())


@functools.lru_cache(maxsize=1)
def matcher(items: tuple[tuple[object, str], ...], rule: EditMatching) -> Matcher:
    return Matcher(items, rule)


def item_blocks(benchmark: DataFrame, rule: EditMatching) -> Iterator[tuple[tuple[object, str], ...]]:
    """The items in blocks of about ``block_chars`` characters; the driver holds one partition."""
    block, size = [], 0
    for row in benchmark.select("item_id", "text").filter("text is not null").toLocalIterator():
        block.append((row["item_id"], row["text"]))
        size += len(row["text"])
        if size >= rule.block_chars:
            yield tuple(sorted(block, key=str))
            block, size = [], 0
    if block:
        yield tuple(sorted(block, key=str))


def benchmark_leaks(documents: DataFrame, benchmark: DataFrame, rule: EditMatching = EditMatching()) -> DataFrame:
    """doc_id and ``leaks``, array of (item_id, distance), of every document."""
    one, blocks = _one_block(benchmark, rule)
    if one is not None:
        items = documents.sparkSession.sparkContext.broadcast(one)
        return _searched(documents.select("doc_id", "text"), items, benchmark, rule)
    found = _found(documents, blocks, benchmark, rule).select("id", "hash", F.explode("leaks").alias("x"))
    found = found.groupBy("id", "hash", F.col("x.item_id").alias("item_id")).agg(F.min("x.distance").alias("distance"))
    found = found.groupBy("id", "hash").agg(F.sort_array(F.collect_list(F.struct("item_id", "distance"))).alias("leaks"))
    every = documents.select("doc_id", _hash().alias("text_hash"))
    met = every.join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")), "left")
    return met.select("doc_id", F.coalesce("leaks", F.array().cast(_leaks_type(benchmark))).alias("leaks"))


def _hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _leaks_type(benchmark: DataFrame) -> str:
    return f"array<struct<item_id:{benchmark.schema['item_id'].dataType.simpleString()},distance:int>>"


def _one_block(benchmark: DataFrame, rule: EditMatching) -> tuple[tuple | None, Iterator[tuple]]:
    """The only block of the benchmark, if it is the only one, and all blocks."""
    blocks = item_blocks(benchmark, rule)
    some = list(itertools.islice(blocks, 2))
    return (some[0] if some else ()) if len(some) < 2 else None, itertools.chain(some, blocks)


def _found(documents: DataFrame, blocks: Iterator[tuple], benchmark: DataFrame, rule: EditMatching) -> DataFrame:
    """id, hash of the text and ``leaks`` of the documents that hold items: a row for each block with any."""
    spark, found = documents.sparkSession, []
    keyed = documents.select(F.col("doc_id").alias("id"), _hash().alias("hash"), "text")
    for block in blocks:
        items = spark.sparkContext.broadcast(block)
        found.append(staged(_searched(keyed, items, benchmark, rule).filter(F.size("leaks") > 0), "item_hits"))
        items.destroy()
    return functools.reduce(DataFrame.union, found)


def _searched(documents: DataFrame, items: Broadcast, benchmark: DataFrame, rule: EditMatching) -> DataFrame:
    """The documents with ``leaks`` in the place of their text, the last column."""
    kind = pa.list_(pa.struct([("item_id", to_arrow_type(benchmark.schema["item_id"].dataType)), ("distance", pa.int32())]))
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in documents.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = matcher(items.value, rule)
        for batch in batches:
            leaks = []
            for text in batch.column("text"):
                best: dict[object, int] = {}
                for key, distance in finder.leaks(text.as_py()):
                    best[key] = min(distance, best.get(key, distance))
                leaks.append([{"item_id": k, "distance": best[k]} for k in sorted(best, key=lambda k: (k is not None, k))])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(leaks, kind)], [*batch.schema.names[:-1], "leaks"])

    return bounded_batches(documents).mapInArrow(run, ", ".join([*kinds, f"leaks {_leaks_type(benchmark)}"]))


def without_leaks(documents: DataFrame, benchmark: DataFrame, rule: EditMatching = EditMatching()) -> DataFrame:
    """The documents that hold no item, with their own columns; no shuffle if the benchmark is one block."""
    one, blocks = _one_block(benchmark, rule)
    if one is None:
        found = staged(_found(documents, blocks, benchmark, rule).select("id", "hash").distinct(), "item_holders")
        rows = documents.select(F.struct(*[F.col(c) for c in documents.columns]).alias("row"), F.col("doc_id"), _hash().alias("text_hash"))
        clean = rows.join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")), "left_anti")
        return clean.select(*[F.col("row").getField(c).alias(c) for c in documents.columns])
    text_at = documents.columns.index("text")
    items = documents.sparkSession.sparkContext.broadcast(one)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = matcher(items.value, rule)
        for batch in batches:
            yield batch.filter(pa.array([not finder.leaks(x.as_py()) for x in batch.column(text_at)], pa.bool_()))

    return bounded_batches(documents).mapInArrow(run, documents.schema)
