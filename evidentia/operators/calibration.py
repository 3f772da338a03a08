"""Calibration of scores by isotonic regression, and decisions with an abstention band.

The fit is the best non-decreasing step function of the score: neighbouring scores are pooled while
their positive rate does not rise (pool adjacent violators). Pooling may be done in any order, so
equal scores are counted first, then every task pools its own range of scores, ranges are joined in
ever fewer tasks, and one last pass joins each group. Rates are compared as products of whole
numbers, so the result is exact. What is left of n labelled rows is the lower edge of a convex
chain on an n by n grid, which has in the order of n ** (2/3) corners: the last pass stays small.

Rows whose score is null or NaN, or whose truth is null, are not used. A group without labelled
rows has no fit, and its scores stay uncalibrated.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.operators.ordered import last_known, ranged
from evidentia.plans.staging import staged

#: Ranges that one task of the next round joins.
JOINED = 16


def pooled(rows: Iterable[tuple]) -> Iterator[tuple]:
    """(group, low, high, n, positives) in order of group and low -> the same, with rates that rise in each group."""
    stack: list[tuple] = []
    for group, low, high, n, positives in rows:
        if stack and stack[-1][0] != group:
            yield from stack
            stack = []
        while stack and positives * stack[-1][3] <= stack[-1][4] * n:
            _, low, _, m, more = stack.pop()
            n, positives = n + m, positives + more
        stack.append((group, low, high, n, positives))
    yield from stack


def _pooling(by: list[str]):
    names = [*by, "low", "high", "n", "positives"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(len(names))]
            yield from ((tuple(r[: len(by)]), *r[len(by) :]) for r in zip(*columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        schema, held = pa.schema([pa.field(n, t) for n, t in zip(names, first.schema.types)]), []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)

        def chained() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        for group, *rest in pooled(rows(chained())):
            held.append((*group, *rest))
            if len(held) == 10_000:
                yield made()
                held.clear()
        if held:
            yield made()

    return run


def isotonic_blocks(rows: DataFrame, score: str, truth: str, by: list[str]) -> DataFrame:
    """by, low, high (the scores of a block), n, positives and calibrated (their rate) of every block."""
    usable = F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(truth).isNotNull()
    counted = rows.filter(usable).groupBy(*by, F.col(score).alias("low")).agg(F.count("*").alias("n"), F.count_if(F.col(truth) == 1).alias("positives"))
    blocks = staged(counted.select(*by, "low", F.col("low").alias("high"), "n", "positives"), "calibration_counts")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while parts > 1:
        dealt = blocks.repartitionByRange(parts, *by, "low").sortWithinPartitions(*by, "low")
        blocks = staged(dealt.mapInArrow(_pooling(by), blocks.schema), "calibration_blocks")
        parts //= JOINED
    last = (blocks.repartition(*by) if by else blocks.coalesce(1)).sortWithinPartitions(*by, "low")
    return last.mapInArrow(_pooling(by), blocks.schema).withColumn("calibrated", F.col("positives") / F.col("n"))


def calibrated(rows: DataFrame, blocks: DataFrame, score: str, by: list[str]) -> DataFrame:
    """``rows`` with ``calibrated``: the rate of the last block that begins at or below the score.

    Scores below the first block have its rate; null and NaN scores, and groups without blocks, null.
    Distinct scores are looked up in order of (group, score), so neither a group nor a common score is
    gathered; nothing is broadcast."""
    usable = F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))
    asked = rows.filter(usable).select(*by, score).distinct().select("*", F.lit(None).cast("double").alias("rate"), F.lit(1).alias("later"))
    kind = rows.schema[score].dataType
    known = blocks.select(*by, F.col("low").cast(kind).alias(score), F.col("calibrated").alias("rate"), F.lit(0).alias("later"))
    order = [score, "later"]
    found = last_known(ranged(known.unionByName(asked), by, order), by, order, "rate", "calibrated").filter("later = 1")
    first = blocks.groupBy(*by).agg(F.min("calibrated").alias("least"))
    match = lambda a, b, keys: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    found = found.alias("f").join(first.alias("g"), match("f", "g", by), "left") if by else found.withColumn("least", first.scalar()).alias("f")
    found = found.select(*[f"f.{b}" for b in by], f"f.{score}", F.coalesce("f.calibrated", "least").alias("calibrated"))
    return rows.alias("r").join(found.alias("f"), match("r", "f", [*by, score]), "left").select("r.*", "f.calibrated")


def band(blocks: DataFrame, by: list[str], low: float, high: float) -> DataFrame:
    """by, clear_to and suspicious_from: scores up to and from which the calibrated rate is outside (low, high).

    Between the two the check abstains. Null where no score is that certain."""
    least = F.min(F.when(F.col("calibrated") >= high, F.col("low")))
    return blocks.groupBy(*by).agg(F.max(F.when(F.col("calibrated") <= low, F.col("high"))).alias("clear_to"), least.alias("suspicious_from"))


def decided(rate: Column, low: float, high: float) -> Column:
    """The status that a calibrated rate leads to; a score without one abstains as unavailable."""
    return F.when(rate.isNull(), "unavailable").when(rate >= high, "suspicious").when(rate > low, "inconclusive").otherwise("completed")
