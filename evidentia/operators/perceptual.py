"""Near copies of images: perceptual codes and a multi-index Hamming join.

A code has one bit for each coefficient of a tile's cosine transform: whether it is above zero. Two
codes that differ in at most d bits agree in one of d + 1 pieces, so pieces are the keys of an
equality join and ``bit_count`` verifies. Only distinct codes take part; copies are counted. A pair
is kept at the first piece that it shares, so no distinct is needed afterwards. Pieces with more
codes than a block holds are cut into blocks, and pairs of blocks meet in different tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.operators.components import components
from evidentia.operators.forensics import SIDE
from evidentia.plans.staging import staged

BITS = 64


def basis() -> np.ndarray:
    """The cosine transform of a SIDE by SIDE tile, a row for each coefficient, in order of (u, v)."""
    k, n = np.meshgrid(np.arange(SIDE), np.arange(SIDE), indexing="ij")
    one = np.sqrt(np.where(k == 0, 1, 2) / SIDE) * np.cos((2 * n + 1) * k * np.pi / (2 * SIDE))
    return np.kron(one, one)


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    transform = basis().T
    for batch in batches:
        tiles = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, BITS)
        codes = np.packbits(tiles @ transform > 0, axis=1).view(">i8").ravel().astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes)], ["key", "code"])


def perceptual_codes(rows: DataFrame, key: str, tile: str) -> DataFrame:
    """(key, code) of every tile of 64 finite values; others, null ones too, have no code and no row."""
    whole = F.coalesce((F.size(tile) == BITS) & F.forall(tile, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))
    kind = rows.schema[key].dataType.simpleString()
    found = rows.filter(whole).select(F.col(key).alias("key"), F.col(tile).cast("array<double>").alias("tile"))
    return found.mapInArrow(_coded, f"key {kind}, code long").withColumnRenamed("key", key)


def pieces(distance: int) -> list[tuple[int, int]]:
    """(shift, width) of the distance + 1 pieces of a code."""
    ends = [BITS * k // (distance + 1) for k in range(distance + 2)]
    return [(a, b - a) for a, b in zip(ends, ends[1:])]


def _piece(code: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(code, shift).bitwiseAND(F.lit((1 << width) - 1 if width < BITS else -1).cast("long"))


def hamming_pairs(codes: DataFrame, distance: int, block: int = 5_000) -> DataFrame:
    """(a, b) with a < b of all distinct codes in column ``code`` that differ in at most ``distance`` bits, each once."""
    cuts = pieces(distance)
    parts = F.array(*[F.struct(F.lit(i).alias("piece"), _piece(F.col("code"), *cut).alias("value")) for i, cut in enumerate(cuts)])
    keyed = codes.select("code", F.explode(parts).alias("p")).select("code", "p.piece", "p.value")
    sizes = keyed.groupBy("piece", "value").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.count("*").alias("size")).filter("size > 1").drop("size")
    members = keyed.join(sizes, ["piece", "value"]).withColumn("block", F.pmod(F.xxhash64("code"), F.col("blocks")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select("piece", "value", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "code")
    a, b = members.alias("a"), members.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("piece", "value", "low", "high")]
    x, y = F.col("a.code"), F.col("b.code")
    differ = x.bitwiseXOR(y)
    apart = (F.col("a.low") == F.col("a.high")) | (F.col("a.block") != F.col("b.block"))
    first = F.lit(True)
    for i, cut in enumerate(cuts):
        first &= (F.col("a.piece") <= i) | (_piece(differ, *cut) != 0)
    pairs = a.join(b, [*same, x < y, apart, F.bit_count(differ) <= distance, first])
    return pairs.select(x.alias("a"), y.alias("b"))


def near_copies(rows: DataFrame, key: str, tile: str, distance: int = 3) -> DataFrame:
    """key, code, class_id (the least key of all linked codes), n_copies (rows with the code) and n_links (other codes within the distance)."""
    coded = staged(perceptual_codes(rows, key, tile), "perceptual_codes")
    own = staged(coded.groupBy("code").agg(F.min(key).alias("first"), F.count("*").alias("n_copies")), "perceptual_classes")
    pairs = staged(hamming_pairs(own.select("code"), distance), "perceptual_pairs")
    ends = pairs.select(F.col("a").alias("code")).union(pairs.select("b")).groupBy("code").agg(F.count("*").alias("n_links"))
    named = components(pairs).withColumnRenamed("key", "code").join(own.select("code", "first"), "code")
    least = named.groupBy("root").agg(F.min("first").alias("class_id"))
    linked = named.join(least, "root").select("code", "class_id").join(ends, "code")
    every = own.join(linked, "code", "left").select("code", F.coalesce("class_id", "first").alias("class_id"), "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return coded.join(every, "code").select(key, "code", "class_id", "n_copies", "n_links")
