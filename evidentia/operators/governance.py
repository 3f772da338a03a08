"""Data governance: duplicates, splits, leakage, counts, registries."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from evidentia.operators.components import components
from evidentia.operators.ordered import ranged, running_total
from evidentia.plans.staging import staged


def exact_duplicates(rows: DataFrame, content: Column, key: str) -> DataFrame:
    """digest, n and the least key of every content that occurs more than once; no list of members."""
    return rows.groupBy(F.sha2(content, 256).alias("digest")).agg(F.count("*").alias("n"), F.min(key).alias(f"first_{key}")).filter("n > 1")


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no fragment, no trailing slash, no tracking parameters; the path keeps its case."""
    whole = F.regexp_replace(url, "#.*$", "")
    place = F.regexp_extract(whole, "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?]*", 0)
    bare = F.concat(F.lower(place), F.substring(whole, F.length(place) + 1, F.length(whole)))
    bare = F.regexp_replace(bare, r"([?&])utm_[a-z]+=[^&]*", "$1")
    return F.regexp_replace(F.regexp_replace(bare, r"[?&]+$", ""), "/+$", "")


def split_of(group: Column, train: int = 80, validation: int = 10) -> Column:
    """train, validation or test by the group's MD5: rows of a group never part, and engines agree."""
    bucket = F.conv(F.substring(F.md5(group), 1, 4), 16, 10).cast("int") % 100
    return F.when(bucket < train, "train").when(bucket < train + validation, "validation").otherwise("test")


def split_leakage(train: DataFrame, test: DataFrame, content: str) -> DataFrame:
    """Test rows whose content is in the training rows too."""
    return test.join(train.select(content).distinct(), content, "left_semi")


def unseen(evaluation: DataFrame, training: DataFrame, group: str) -> DataFrame:
    """Evaluation rows of groups (say, generators) that the training rows lack."""
    return evaluation.join(training.select(group).distinct(), group, "left_anti")


def missing_records(artifacts: DataFrame, registry: DataFrame, digest: str = "digest") -> DataFrame:
    """Artifacts without a complete licence and source record."""
    complete = registry.filter("license is not null and source is not null").select(digest)
    return artifacts.join(complete, digest, "left_anti")


#: Characters of benchmark items that are searched in one pass over the documents.
BLOCK_CHARS = 2_000_000


class _Block:
    """The items of one block. Equal texts are one pattern; ``places`` are numbers of items."""

    def __init__(self, texts: tuple[str, ...]):
        places: dict[str, list[int]] = {}
        for i, text in enumerate(texts):
            places.setdefault(text, []).append(i)
        #: The empty text is in every text, and no pattern of an automaton.
        self.empty = places.pop("", [])
        self.automaton = ahocorasick.Automaton()
        for text, own in places.items():
            self.automaton.add_word(text, own)
        if places:
            self.automaton.make_automaton()
        self.any = bool(places)

    def held(self, text: str) -> list[int]:
        """Numbers of the items whose text stands in ``text``, each once."""
        found = {own[0]: own for _, own in self.automaton.iter(text)} if self.any else {}
        return self.empty + [i for own in found.values() for i in own]


@functools.lru_cache(maxsize=1)
def _block(texts: tuple[str, ...]) -> _Block:
    return _Block(texts)


def _blocks(items: DataFrame, chars: int) -> Iterator[list[Row]]:
    """Rows of (item_id, item) in blocks of about so many characters; the driver holds one partition."""
    block, size = [], 0
    for row in items.filter("item is not null").toLocalIterator():
        block.append(row)
        size += len(row["item"])
        if size >= chars or len(block) >= chars // 20:
            yield block
            block, size = [], 0
    if block:
        yield block


def benchmark_contained(documents: DataFrame, benchmark: DataFrame, most_items: int | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id) of items whose whole text stands in a document.

    Every block of items meets all documents in a pass of its own, with one automaton and no shuffle; its
    hits are written as a table, so only one block is broadcast at a time. Null texts and items hold nothing; repeated rows on either side each give a row. ``most_items``:
    a caller may have more than so many items refused; by default none are."""
    items = benchmark.select("item_id", F.col("text").alias("item"))
    if most_items is not None and items.limit(most_items + 1).count() > most_items:
        raise ValueError(f"more than {most_items} items")
    texts = documents.select("doc_id", "text")
    schema = StructType([StructField("doc_id", texts.schema["doc_id"].dataType), StructField("item_id", items.schema["item_id"].dataType)])
    context, kind = documents.sparkSession.sparkContext, to_arrow_type(schema["item_id"].dataType)
    found = texts.sparkSession.createDataFrame([], schema)
    for block in _blocks(items, block_chars):
        sent = context.broadcast((tuple(r["item_id"] for r in block), tuple(r["item"] for r in block)))
        found = found.union(staged(texts.mapInArrow(_finding(sent, kind), schema), "benchmark_hits"))
        sent.destroy()
    return found


def _finding(sent, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, items = sent.value
        finder, ids = _block(items), pa.array(keys, kind)
        for batch in batches:
            at, which = [], []
            for k, text in enumerate(batch.column(1)):
                held = finder.held(text.as_py()) if text.is_valid else []
                at += [k] * len(held)
                which += held
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), ids.take(pa.array(which, pa.int64()))], ["doc_id", "item_id"])

    return run


def class_counts(rows: DataFrame, levels: list[str]) -> DataFrame:
    """Counts with subtotals, from the finest level up; the subtotal's columns are marked by grouping_id."""
    return rows.rollup(*levels).agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"))


def slice_metrics(rows: DataFrame, slices: list[str], correct: Column) -> DataFrame:
    """Counts and the share of correct rows in every combination of slices."""
    return rows.cube(*slices).agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"), F.round(F.avg(correct.cast("double")), 9).alias("accuracy"))


def linked_split(rows: DataFrame, key: str, groups: list[Column], train: int = 80, validation: int = 10) -> DataFrame:
    """``rows`` with ``component`` and ``split``: rows that share a value of any group never part.

    Groups are, say, identity, generator and class of near copies; values of different groups are told
    apart by the group's number, and null links nothing. The graph has a node for each value, not for
    each row, and rows link their values in a chain. Components, in the order of their MD5, fill
    train, validation and test by their rows, so the shares hold but for the component at each border.
    Rows without any value stand alone by ``key``."""
    said = [F.concat(F.lit(f"{i}:"), g.cast("string")) for i, g in enumerate(groups)]
    marked = rows.withColumn("values", F.array_compact(F.array(*said)))
    pair = F.transform(F.sequence(F.lit(1), F.size("values") - 1), lambda i: F.struct(F.get("values", i - 1).alias("a"), F.get("values", i).alias("b")))
    links = marked.filter(F.size("values") > 1).select(F.explode(pair).alias("l")).select("l.a", "l.b").distinct()
    first = F.coalesce(F.get("values", F.lit(0)), F.concat(F.lit("row:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    roots = components(links).select(F.col("key").alias("linked_value"), "root")
    placed = marked.withColumn("first_value", first).join(roots, F.col("first_value") == F.col("linked_value"), "left")
    placed = placed.withColumn("component", F.coalesce("root", "first_value")).drop("values", "root", "first_value", "linked_value")

    sizes = placed.groupBy("component").agg(F.count("*").alias("size")).withColumn("order", F.md5("component"))
    order = ["order", "component"]
    cells = ranged(sizes, [], order)
    before = running_total(cells, [], order, "size", "before").withColumn("total", cells.agg(F.sum("size").alias("total")).scalar())
    share = F.col("before") * 100
    split = F.when(share < F.col("total") * train, "train").when(share < F.col("total") * (train + validation), "validation").otherwise("test")
    found = before.select(F.col("component").alias("c"), split.alias("split"))
    return placed.join(found, placed["component"] == found["c"]).drop("c")


def coverage(left: DataFrame, right: DataFrame, names: tuple[str, str, str] = ("both", "left", "right")) -> DataFrame:
    """The distinct rows of two frames of one schema with ``side``: in both, in the left, or in the right one only. Nulls are equal."""
    said = lambda rows, name: rows.withColumn("side", F.lit(name))
    return said(left.intersect(right), names[0]).union(said(left.subtract(right), names[1])).union(said(right.subtract(left), names[2]))
