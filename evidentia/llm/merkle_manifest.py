"""A Merkle manifest of a corpus: leaves, a tree for each language, one root, and a proof for each row.

Leaves stand in the order of their keys. To know where a leaf stands no global sort is made: keys
are strings of hexadecimal digits, histograms count how many keys of a group begin with each run of
digits, level by level, and a key's rank is the sum of what the histograms have before it at every
level plus its place in its last cell, which holds a bounded number of keys. Where an id repeats so
often that cells would be too large, the digits go on into the hash of the leaf. Rows that are
alike in id and leaf are one key with a count, so they never fill a task either.

The digits of a rank to the base of the fanout, most significant first, are the path to its place in
a trie. Nodes with the longest common prefixes are reduced first: all leaves that share all but
their last ``digits`` digits form a block, a row of a table, and become one node; these nodes form blocks
again, until each language has one node. The subroots, ranked in the same way by language, form
the trie of the root. Then the siblings go down the same blocks: what lies above a block is joined
to it once, and inside it every leaf takes its own. A block holds fanout ** digits nodes at most.

Defined results: null and empty values differ in leaves (``-`` and ``0:``); null ids and languages come
first; rows with equal ids in one language are ordered by their leaves, and rows alike in both take
consecutive places (which of them is which makes no difference); a null id is never tampered with,
nor is a null n_chars changed; the largest n_chars is raised past 64 bits in its decimal form; a
single row is its own root, with the proof of no siblings; very long texts are hashed whole; an
empty table has no rows; columns that are not named here give way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.common import bounded_batches
from evidentia.plans.staging import staged

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


@dataclass(frozen=True)
class Manifest:
    """fanout of a node; digits of a rank that one block reduces; keys that one cell ranks; digits of a
    key that one histogram adds; digits of the first cells."""

    fanout: int = 2
    digits: int = 10
    cell: int = 4096
    step: int = 3
    first: int = 14

    @property
    def width(self) -> int:
        return self.fanout**self.digits


def framed(value: Column) -> Column:
    """UTF-8 byte count, a colon and the value; ``-`` for null."""
    said = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said), F.lit("-"))


def leaf(documents: DataFrame, **instead: Column) -> Column:
    return F.sha2(F.concat(*[framed(instead.get(c, documents[c])) for c in FIELDS]), 256)


def tampered(documents: DataFrame) -> Column:
    """The leaf with n_chars raised by one, of rows that are tampered with; else null."""
    chosen = F.crc32(documents["doc_id"].cast("string")) % 7 == 0
    more = (documents["n_chars"].cast("decimal(20,0)") + 1).cast("decimal(20,0)")
    return F.when(chosen, leaf(documents, n_chars=more))


def ordered_number(value: Column) -> Column:
    """17 hexadecimal digits in the order of the numbers; null first."""
    flipped = F.hex(value.cast("long").bitwiseXOR(F.lit(-(2**63)).cast("long")))
    return F.coalesce(F.concat(F.lit("1"), F.lpad(flipped, 16, "0")), F.lit("0" * 17))


def ordered_text(value: Column) -> Column:
    """Hexadecimal digits in the bytewise order of the texts; null first."""
    return F.coalesce(F.concat(F.lit("1"), F.hex(F.encode(value, "UTF-8"))), F.lit("0"))


def group_ranks(rows: DataFrame, first: int, rule: Manifest) -> DataFrame:
    """``rows`` (group, key, n, ...), with keys distinct in a group, and for each the number of rows
    (each key counts n times) before it in its group as ``rank``, and in all its group as ``total``."""
    prefix = lambda length: F.substring("key", 1, length)
    depth = first
    while True:
        cells = staged(rows.groupBy("group", prefix(depth).alias("prefix")).agg(F.sum("n").alias("n"), F.count("*").alias("keys"), F.max(F.length("key")).alias("long")), "rank_cells")
        size = cells.agg(F.max("keys").alias("keys"), F.max("long").alias("long")).first()
        if (size["keys"] or 0) <= rule.cell or depth >= size["long"]:
            break
        depth += rule.step

    lengths = list(range(depth, 0, -rule.step))
    level, levels = cells.select("group", "prefix", "n"), []
    for length in lengths:
        level = level.groupBy("group", F.substring("prefix", 1, length).alias("prefix")).agg(F.sum("n").alias("n"))
        levels.append((length, level))
    before = rows.sparkSession.createDataFrame([], "group string, above string, before long")
    for length, level in reversed(levels):
        above = F.substring("prefix", 1, length - rule.step) if length > rule.step else F.lit("")
        level = level.withColumn("above", above)
        siblings = Window.partitionBy("group", "above").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
        level = level.withColumn("before_here", F.coalesce(F.sum("n").over(siblings), F.lit(0)))
        level = level.join(before, ["group", "above"], "left").withColumn("before", F.col("before_here") + F.coalesce("before", F.lit(0)))
        before = level.select("group", F.col("prefix").alias("above"), "before")
    totals = cells.groupBy("group").agg(F.sum("n").alias("total"))
    starts = cells.select("group", "prefix").join(before.withColumnRenamed("above", "prefix"), ["group", "prefix"], "left").join(totals, "group")
    starts = staged(starts.select("group", "prefix", F.coalesce("before", F.lit(0)).cast("long").alias("before"), "total"), "rank_starts")

    ranked = rows.withColumn("prefix", prefix(depth)).join(starts, ["group", "prefix"])
    inside = Window.partitionBy("group", "prefix").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    return ranked.withColumn("rank", F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0))).drop("prefix", "before")


def blocks_of(nodes: DataFrame, rule: Manifest) -> DataFrame:
    """Nodes (group, total, rank, n, node, forged, data) gathered in blocks (group, block, total, items)."""
    width = rule.width
    first, last = F.floor(F.col("rank") / width), F.floor((F.col("rank") + F.col("n") - 1) / width)
    held = nodes.withColumn("block", F.explode(F.sequence(first, last)))
    start = F.greatest("rank", F.col("block") * width)
    stop = F.least(F.col("rank") + F.col("n"), (F.col("block") + 1) * width)
    item = F.struct(start.alias("start"), (stop - start).cast("int").alias("n"), "node", "forged", "data")
    return held.groupBy("group", "block").agg(F.first("total").alias("total"), F.sort_array(F.collect_list(item)).alias("items"))


def levels_of(total: int, fanout: int) -> int:
    """Levels above the leaves of a tree of so many leaves."""
    found, reach = 0, 1
    while reach < total:
        reach, found = reach * fanout, found + 1
    return found


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def reduced(nodes: list[str], levels: int, fanout: int) -> list[list[str]]:
    """The nodes, and every level made of them."""
    found = [nodes]
    for _ in range(levels):
        last = found[-1]
        found.append([digest(last[k : k + fanout]) for k in range(0, len(last), fanout)])
    return found


def siblings(levels: list[list[str]], above: str, fanout: int) -> list[str]:
    """For every node of the first level its way to the last one, then ``above``.

    A step is the siblings left of the way, ``*`` for the way itself, those right of it, then ``/``."""
    ways = [above]
    for level in reversed(levels[:-1]):
        here = []
        for k in range(len(level)):
            run = k - k % fanout
            here.append("".join(level[run:k]) + "*" + "".join(level[k + 1 : run + fanout]) + "/" + ways[k // fanout])
        ways = here
    return ways


def folded(leaf: str, way: str) -> str:
    """The root that a leaf and its way lead to."""
    for step in way.split("/")[:-1]:
        leaf = digest([step.replace("*", leaf)])
    return leaf


def proof(way: str) -> str:
    """The hash of all siblings of a way."""
    return digest([way.replace("*", "").replace("/", "")])


def _places(items: pa.StructScalar) -> tuple[list[str], list[int]]:
    """The nodes of a block in their places, and for each the item that it comes from."""
    counts = items.field("n").to_pylist()
    at = [k for k, n in enumerate(counts) for _ in range(n)]
    nodes = items.field("node").to_pylist()
    return [nodes[k] for k in at], at


def _own_levels(total: int, stage: int, rule: Manifest) -> int:
    return max(0, min(rule.digits, levels_of(total, rule.fanout) - stage * rule.digits))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one at a time; ``items`` stays an Arrow array."""
    for batch in batches:
        table = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
        items = table.pop("items")
        plain = {name: column.to_pylist() for name, column in table.items()}
        for k in range(batch.num_rows):
            yield {name: column[k] for name, column in plain.items()} | {"items": items[k].values}


def _up(stage: int, rule: Manifest):
    """Blocks -> (group, rank, total, node): each block's one node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            nodes, _ = _places(r["items"])
            (top,) = reduced(nodes, _own_levels(r["total"], stage, rule), rule.fanout)[-1]
            yield pa.RecordBatch.from_arrays([pa.array([r["group"]]), pa.array([r["block"]]), pa.array([r["total"]]), pa.array([top])], ["group", "rank", "total", "node"])

    return run


def _down(stage: int, rule: Manifest):
    """Blocks with the way above them -> (group, rank, data, subroot, way) of every node in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            nodes, at = _places(r["items"])
            ways = siblings(reduced(nodes, _own_levels(r["total"], stage, rule), rule.fanout), r["way"], rule.fanout)
            start, n = r["block"] * rule.width, len(nodes)
            columns = [pa.array([r["group"]] * n), pa.array(range(start, start + n), pa.int64()), r["items"].field("data").take(pa.array(at)), pa.array([r["subroot"]] * n, pa.string()), pa.array(ways)]
            yield pa.RecordBatch.from_arrays(columns, ["group", "rank", "data", "subroot", "way"])

    return run


def _proved(rule: Manifest):
    """Blocks of leaves with the way above them -> (data, leaf, subroot, proof_sha256, folded_root)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            nodes, at = _places(r["items"])
            ways = siblings(reduced(nodes, _own_levels(r["total"], 0, rule), rule.fanout), r["way"], rule.fanout)
            forged = r["items"].field("forged").to_pylist()
            roots = [folded(forged[k] or node, way) for k, node, way in zip(at, nodes, ways)]
            columns = [r["items"].field("data").take(pa.array(at)), pa.array(nodes), pa.array([r["subroot"]] * len(at)), pa.array([proof(w) for w in ways]), pa.array(roots)]
            yield pa.RecordBatch.from_arrays(columns, ["data", "leaf", "subroot", "proof_sha256", "folded_root"])

    return run


def climb(blocks: DataFrame, rule: Manifest, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of every stage, and (group, rank, total, node): each group's last node."""
    stages, most = [], blocks.agg(F.max("total")).first()[0] or 1
    while True:
        stages.append(blocks)
        tops = staged(blocks.select("group", "block", "total", "items").mapInArrow(_up(len(stages) - 1, rule), "group string, rank long, total long, node string"), f"{name}_tops")
        if levels_of(most, rule.fanout) <= len(stages) * rule.digits:
            return stages, tops
        nothing = F.lit(None).cast("string")
        blocks = staged(blocks_of(tops.select("*", F.lit(1).alias("n"), nothing.alias("forged"), nothing.alias("data")), rule), f"{name}_blocks")


def with_ways(stages: list[DataFrame], ways: DataFrame, rule: Manifest) -> DataFrame:
    """The blocks of the first stage with their ways; ``ways`` (group, block, subroot, way) are the last one's."""
    for stage in range(len(stages) - 1, 0, -1):
        held = stages[stage].join(ways, ["group", "block"])
        found = held.mapInArrow(_down(stage, rule), "group string, rank long, data string, subroot string, way string")
        ways = found.select("group", F.col("rank").alias("block"), "subroot", "way")
    return stages[0].join(ways, ["group", "block"])


def merkle_manifest(documents: DataFrame, rule: Manifest = Manifest()) -> DataFrame:
    """doc_id, lang, leaf, subroot, root, proof_sha256, folded_root and verified of every row."""
    spark = documents.sparkSession
    kind = documents.schema["doc_id"].dataType.simpleString()
    named = bounded_batches(documents.select(*FIELDS))
    leaves = named.select(ordered_text(F.col("lang")).alias("group"), "doc_id", "lang", leaf(named).alias("node"), tampered(named).alias("forged"))
    leaves = leaves.withColumn("key", F.concat(ordered_number(F.col("doc_id")), "node"))
    alike = leaves.groupBy("group", "key").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("doc_id", "lang", "node", "forged")])
    alike = staged(alike.select("group", "key", "n", "node", "forged", F.struct("doc_id", "lang").alias("data")), "merkle_leaves")
    blocks = staged(blocks_of(group_ranks(alike, rule.first, rule), rule), "merkle_blocks")
    stages, subroots = climb(blocks, rule, "merkle")

    # One node for each language; they stand in the trie of the root as leaves do in theirs.
    tops = subroots.select(F.lit("").alias("group"), F.col("group").alias("key"), F.lit(1).cast("long").alias("n"), "node", F.lit(None).cast("string").alias("forged"), F.col("group").alias("data"))
    top_blocks = staged(blocks_of(group_ranks(staged(tops, "merkle_subroots"), 0, rule), rule), "merkle_root_blocks")
    top_stages, last = climb(top_blocks, rule, "merkle_root")
    found = last.first()  # one row, or none if there are no documents
    root = found["node"] if found else ""
    start = spark.createDataFrame([("", 0, "", "")], "group string, block long, subroot string, way string")
    ways = with_ways(top_stages, start, rule).mapInArrow(_down(0, rule), "group string, rank long, data string, subroot string, way string")
    ways = ways.select(F.col("data").alias("group"), "way").join(subroots.select("group", F.col("node").alias("subroot")), "group")
    ways = staged(ways.select("group", F.lit(0).cast("long").alias("block"), "subroot", "way"), "merkle_ways")

    proved = with_ways(stages, ways, rule).select("group", "block", "total", "items", "subroot", "way").mapInArrow(
        _proved(rule), f"data struct<doc_id:{kind},lang:string>, leaf string, subroot string, proof_sha256 string, folded_root string"
    )
    return proved.select("data.doc_id", "data.lang", "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))
