"""Near-duplicate texts: an n-gram Jaccard join with Bayesian pruning of candidates.

Texts that are equal form one class, and only classes are compared. A class is the set of its
shingles (windows of five words) and has a MinHash signature. A pair is a candidate if one of the
signature's bands agrees. Its MinHash values are compared in steps; given m of n agreeing, the
similarity has a Beta posterior, and once the probability that it reaches the threshold falls
below the tolerance the pair is dropped. Whatever survives is verified on the full shingle sets.
With 32 bands of 4 a pair at 0.8 shares none with probability 5e-8, and the pruning loses one
with about the tolerance.

Buckets of a band with more members than a block holds are cut into blocks, and the pairs of
blocks go to different tasks, so no task meets a whole hot bucket; inside a task the pairs are
compared in numpy and never become rows. What leaves it are links from each class to the least
class it may be similar to. Their connected components hold all candidate pairs; shingles travel
once for each block of a component, not for each band. There the pairs are pruned and verified
again, exactly, and every class's links are counted.

Defined results: a null text is an empty one; texts of one to four words have one shingle, all
their words; texts without words are equal to each other if the text is, and have no links; equal
rows are copies of one class. A class is named by its least id; null ids come first. A text of any
length gives all its shingles; an empty table has no rows; columns other than doc_id and text give
way, but for ``one_of_each_group``, which passes all on.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import bounded_batches, sieve, sieved
from evidentia.llm.components import connected_components
from evidentia.plans.staging import staged

@dataclass(frozen=True)
class NgramJoin:
    """similarity: of shingle sets. words: in a shingle. bands of rows: the signature. tolerance:
    posterior probability below which a candidate is dropped. step: MinHash values compared at a
    time. block: classes of a bucket, or of a component, that one side of a task holds; the
    shingles that it holds are bounded too."""

    similarity: float = 0.8
    words: int = 5
    bands: int = 32
    rows: int = 4
    tolerance: float = 1e-6
    step: int = 16
    block: int = 1024
    block_shingles: int = 1_500_000


def _constants(n: int, seed: int) -> np.ndarray:
    """Odd 64-bit multipliers."""
    return np.random.default_rng(seed).integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, n: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word windows."""
    words = (text or "").encode().split()  # of bytes, split() takes just space and tab to carriage return
    if not words:
        return np.empty(0, np.uint64)
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    multipliers = _constants(n, 1)
    if len(words) < n:
        return _mixed((own * multipliers[: len(words)]).sum(keepdims=True) + np.uint64(len(words)))
    windows = sum(own[k : len(own) - n + 1 + k] * multipliers[k] for k in range(n))
    return np.unique(_mixed(windows))


def signature(own: np.ndarray, rule: NgramJoin) -> np.ndarray:
    """MinHash values, each cut to 16 bits after the minimum was taken; a band is one uint64."""
    multipliers = _constants(rule.bands * rule.rows, 2)[:, None]
    least = np.full(len(multipliers), 2**32 - 1, np.uint64)
    for k in range(0, len(own), 4096):
        np.minimum(least, ((own[None, k : k + 4096] * multipliers) >> np.uint64(32)).min(1), out=least)
    return (_mixed(least) >> np.uint64(48)).astype(np.uint16)


@functools.lru_cache
def least_agreeing(rule: NgramJoin) -> tuple[tuple[int, int], ...]:
    """(n, m): of n compared values at least m must agree, else the similarity is too improbable.

    With a uniform prior, P(similarity >= t | m of n) is P(Binomial(n + 1, t) <= m)."""
    from math import comb

    t, steps = rule.similarity, []
    for n in range(rule.step, rule.bands * rule.rows + 1, rule.step):
        total, m = 0.0, -1
        while True:
            total += comb(n + 1, m + 1) * t ** (m + 1) * (1 - t) ** (n - m)
            if total >= rule.tolerance:
                break
            m += 1
        steps.append((n, m + 1))
    return tuple(steps)


def plausible(i: np.ndarray, j: np.ndarray, sizes: np.ndarray, values: np.ndarray, rule: NgramJoin) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that sizes and MinHash values, compared step by step, leave."""
    fits = np.minimum(sizes[i], sizes[j]) >= rule.similarity * np.maximum(sizes[i], sizes[j]) - 1e-9
    fits &= sizes[i] > 0
    i, j = i[fits], j[fits]
    agree, before = np.zeros(len(i), np.int32), 0
    for n, least in least_agreeing(rule):
        agree += (values[i, before:n] == values[j, before:n]).sum(1, dtype=np.int32)
        fits = agree >= least
        i, j, agree, before = i[fits], j[fits], agree[fits], n
    return i, j


def pairs(left: np.ndarray, right: np.ndarray | None, at_once: int = 100_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs within ``left``, or between the two, some at a time."""
    if right is None:
        start = 0
        while start < len(left) - 1:
            rows = max(1, at_once // (len(left) - start))
            a, b = np.meshgrid(np.arange(start, min(start + rows, len(left))), np.arange(start, len(left)), indexing="ij")
            later = b > a
            yield left[a[later]], left[b[later]]
            start += rows
    elif len(right):
        rows = max(1, at_once // len(right))
        for k in range(0, len(left), rows):
            part = left[k : k + rows]
            yield np.repeat(part, len(right)), np.tile(right, len(part))


def least_linked(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the least index of its component under the links."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    return label


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Consecutive rows that agree in their first ``keys`` columns, whatever batches they come in."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_pylist() for k in range(keys)]
        rows = list(zip(*columns))
        start = 0
        for k in range(len(rows)):
            if rows[k] != last:
                if k > start:
                    held.append(batch.slice(start, k - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], k, rows[k]
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def _sides(low: int, high: int, block: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    return (np.arange(len(block)), None) if low == high else (np.flatnonzero(block == low), np.flatnonzero(block == high))


def _signed(rule: NgramJoin):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, values = [], []
            for text in batch.column(2):
                own = shingles(text.as_py(), rule.words)
                sizes.append(len(own))
                values.append(signature(own, rule).tobytes() if len(own) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.array(values, pa.binary())], ["doc_id", "text_key", "n_shingles", "signature"])

    return run


def _banded(rule: NgramJoin):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = _constants(rule.bands, 3)
        for batch in batches:
            if not batch.num_rows:
                continue
            bands = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(-1, rule.bands)
            keys = _mixed(bands * salt + salt).astype(np.int64)
            at = np.repeat(np.arange(len(keys)), rule.bands)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), batch.column(0).take(pa.array(at))], ["bucket", "text_key"])

    return run


def _bucket_links(rule: NgramJoin):
    """(bucket, low, high, block, text_key, n_shingles, signature) -> links to the least class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for group in grouped(batches, 3):
            if group.num_rows < 2:
                continue
            low, high = group.column(1)[0].as_py(), group.column(2)[0].as_py()
            block, sizes = group.column(3).to_numpy(), group.column(5).to_numpy()
            values = np.frombuffer(b"".join(group.column(6).to_pylist()), np.uint16).reshape(len(sizes), -1)
            found = [plausible(i, j, sizes, values, rule) for i, j in pairs(*_sides(low, high, block))]
            if not sum(len(i) for i, _ in found):
                continue
            label = least_linked(len(sizes), np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found]))
            names = group.column(4).to_pylist()
            for k in np.flatnonzero(label != np.arange(len(label))).tolist():
                a.append(names[label[k]])
                b.append(names[k])
            if len(a) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return run


def verified(i: np.ndarray, j: np.ndarray, ids: np.ndarray, starts: np.ndarray, span: int, similarity: float) -> np.ndarray:
    """Which pairs reach the similarity. ids: the classes' shingles end to end, numbered from 0."""
    true = np.zeros(len(i), bool)
    mark = np.zeros(span, bool)
    order = np.argsort(i, kind="stable")
    cuts = np.flatnonzero(np.diff(i[order], prepend=-1))
    for first, last in zip(cuts, [*cuts[1:], len(order)]):
        at = order[first:last]
        own = ids[starts[i[at[0]]] : starts[i[at[0]] + 1]]
        mark[own] = True
        others = [ids[starts[k] : starts[k + 1]] for k in j[at]]
        sizes = np.array([len(x) for x in others])
        common = np.add.reduceat(mark[np.concatenate(others)], np.cumsum(sizes) - sizes, dtype=np.int64)
        true[at] = common >= similarity * (len(own) + sizes - common) - 1e-9
        mark[own] = False
    return true


def _verified_links(rule: NgramJoin):
    """(root, low, high, block, text_key, text) -> each class's links here, and whom it is linked to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, 3):
            low, high = group.column(1)[0].as_py(), group.column(2)[0].as_py()
            own = [shingles(x.as_py(), rule.words) for x in group.column(5)]
            sizes = np.array([len(x) for x in own])
            values = np.stack([signature(x, rule) for x in own])
            bands = values.view(np.uint64)
            span, ids = np.unique(np.concatenate(own), return_inverse=True)
            starts = np.append(0, np.cumsum(sizes))
            left, right = [], []
            for i, j in pairs(*_sides(low, high, group.column(3).to_numpy()), 50_000):
                near = (bands[i] == bands[j]).any(1)
                i, j = plausible(i[near], j[near], sizes, values, rule)
                true = verified(i, j, ids, starts, len(span), rule.similarity)
                left.append(i[true])
                right.append(j[true])
            i, j = (np.concatenate(x) if x else np.empty(0, int) for x in (left, right))
            links = np.bincount(np.concatenate([i, j]), minlength=len(own))
            label = least_linked(len(own), i, j)
            names = group.column(4).to_pylist()
            some = np.flatnonzero(links).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([names[label[k]] for k in some], pa.binary()), pa.array([names[k] for k in some], pa.binary()), pa.array(links[some], pa.int64())], ["a", "b", "links"])

    return run


def _in_blocks(df: DataFrame, blocks: Column) -> DataFrame:
    """One row for each pair of blocks that a row takes part in: columns low, high, block."""
    block = F.pmod(F.xxhash64("text_key"), F.col("n_blocks")).cast("int")
    df = df.withColumn("n_blocks", blocks.cast("int")).withColumn("block", block)
    df = df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    return df.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))


def near_duplicates(documents: DataFrame, rule: NgramJoin = NgramJoin()) -> DataFrame:
    """One row for each document: doc_id, text_key (of its text), class_id (the least id of its group
    of linked texts), n_copies (rows with its text), n_links (other texts as similar as asked) and root
    (the least text_key of the group, which tells groups apart where ids repeat or are null)."""
    spark = documents.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = documents.select("doc_id", F.unhex(F.md5(text)).alias("text_key"), text.alias("text"))
    kind = documents.schema["doc_id"].dataType.simpleString()
    signed = staged(bounded_batches(keyed).mapInArrow(_signed(rule), f"doc_id {kind}, text_key binary, n_shingles int, signature binary"), "ngram_signatures")
    per_text = signed.groupBy("text_key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_copies"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    classes = staged(per_text, "ngram_classes")

    # Buckets with one class have no pairs; most are such, and go before signatures travel.
    banded = classes.filter("n_shingles > 0").select("text_key", "signature").mapInArrow(_banded(rule), "bucket long, text_key binary")
    banded = staged(banded, "ngram_bands")
    shared = banded.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    members = banded.join(shared, "bucket").join(classes.select("text_key", "n_shingles", "signature"), "text_key")
    members = _in_blocks(members, F.ceil(F.col("size") / rule.block)).select("bucket", "low", "high", "block", "text_key", "n_shingles", "signature")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    arranged = members.repartition(parts, "bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")
    links = staged(arranged.mapInArrow(_bucket_links(rule), "a binary, b binary"), "ngram_candidates")

    roots = connected_components(links)
    known = classes.select("text_key", "first_id", "n_shingles")
    inside = roots.withColumnRenamed("key", "text_key").join(known, "text_key")
    sizes = inside.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / rule.block), F.ceil(F.sum("n_shingles") / rule.block_shingles)).alias("blocks"))
    wanted = staged(inside.join(sizes, "root"), "ngram_components")
    # A class's text is that of the row with its least id; copies do not travel.
    bits = sieve(wanted.select(F.xxhash64("text_key", "first_id").alias("h")), "ngram_sieve")
    texts = sieved(keyed, bits, F.xxhash64("text_key", "doc_id"))
    texts = texts.alias("d").join(wanted.alias("w"), (F.col("d.text_key") == F.col("w.text_key")) & F.col("d.doc_id").eqNullSafe(F.col("w.first_id")))
    texts = texts.select("d.text_key", "d.text", "w.root", "w.blocks")
    texts = _in_blocks(texts, F.col("blocks")).select("root", "low", "high", "block", "text_key", "text")
    arranged = texts.repartition(parts, "root", "low", "high").sortWithinPartitions("root", "low", "high", "text_key")
    true = staged(arranged.mapInArrow(_verified_links(rule), "a binary, b binary, links long"), "ngram_links")

    linked = connected_components(true)
    counts = true.groupBy(F.col("b").alias("key")).agg(F.sum("links").alias("n_links"))
    named = linked.join(counts, "key", "left").withColumnRenamed("key", "text_key").join(classes.select("text_key", "first_id"), "text_key")
    least = named.groupBy("root").agg(F.min("first_id").alias("class_id"))
    named = named.join(least, "root").select("text_key", "root", "class_id", "n_links")
    every = classes.select("text_key", "first_id", "n_copies").join(named, "text_key", "left")
    every = every.select("text_key", F.coalesce("class_id", "first_id").alias("class_id"), "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "text_key").alias("root"))
    return signed.select("doc_id", "text_key").join(staged(every, "ngram_groups"), "text_key").select("doc_id", "text_key", "class_id", "n_copies", "n_links", "root")


def one_of_each_group(documents: DataFrame, rule: NgramJoin = NgramJoin()) -> DataFrame:
    """The documents without near duplicates: of each group one row with its least id stays."""
    groups = near_duplicates(documents, rule)
    first = groups.filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("root", "class_id").agg(F.min("text_key").alias("text_key"))
    first = staged(first.select("class_id", "text_key"), "ngram_kept")
    key = F.unhex(F.md5(F.coalesce(F.col("text"), F.lit(""))))
    rows = documents.select(F.struct(*[F.col(c) for c in documents.columns]).alias("row"), F.col("doc_id").alias("id"), key.alias("key"))
    kept = rows.join(first, F.col("id").eqNullSafe(F.col("class_id")) & (F.col("key") == F.col("text_key")), "left_semi")
    # Rows that repeat an id and its text are copies of one document too.
    kept = kept.groupBy("key", "id").agg(F.first("row").alias("row"))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in documents.columns])
