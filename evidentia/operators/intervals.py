"""Interval joins without comparing all pairs: bins whose width goes by the length of the intervals.

An interval of length at most width * 2 ** level covers at most two bins of that level. Two intervals
meet at the level of the longer one, in the first bin that they share there; so the join is one on
equality of group, level and bin, each pair comes out once, and an interval has two rows a level at
most, however long it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _level(start: Column, stop: Column, width: int) -> Column:
    return F.greatest(F.ceil(F.log2((stop - start) / F.lit(width))), F.lit(0)).cast("int")


def _binned(rows: DataFrame, by: list[str], width: int, levels: Column) -> DataFrame:
    wide = lambda level: F.lit(width) * F.pow(F.lit(2.0), level).cast("long")
    at = rows.withColumn("own_level", _level(F.col("start"), F.col("stop"), width)).withColumn("level", F.explode(F.sequence("own_level", levels)))
    at = at.withColumns({"first_bin": F.floor(F.col("start") / wide(F.col("level"))), "last_bin": F.floor((F.col("stop") - 1) / wide(F.col("level")))})
    return at.withColumn("bin", F.explode(F.sequence("first_bin", "last_bin")))


def overlapping(left: DataFrame, right: DataFrame, by: list[str], width: int) -> DataFrame:
    """Pairs of rows (id, start, stop, and the columns ``by``) of the two frames that agree in ``by`` and overlap:
    by, left_id, right_id, and the common part as start and stop.

    Intervals are whole numbers and half open; empty ones, and those with a null end, overlap nothing. The
    longest interval is the only thing that is asked of the data first."""
    usable = lambda rows: rows.filter(F.col("start") < F.col("stop")).select(*by, "id", "start", "stop")
    a, b = usable(left), usable(right)
    longest = [r.agg(F.max(_level(F.col("start"), F.col("stop"), width)).alias("level")).first()["level"] or 0 for r in (a, b)]
    top = F.lit(max(longest))
    x, y = _binned(a, by, width, top).alias("x"), _binned(b, by, width, top).alias("y")
    c = lambda side, name: F.col(f"{side}.{name}")
    once = (c("x", "level") == F.greatest(c("x", "own_level"), c("y", "own_level"))) & (c("x", "bin") == F.greatest(c("x", "first_bin"), c("y", "first_bin")))
    same = [c("x", k) == c("y", k) for k in (*by, "level", "bin")]
    met = x.join(y, [*same, once, c("x", "start") < c("y", "stop"), c("y", "start") < c("x", "stop")])
    return met.select(*[c("x", k) for k in by], c("x", "id").alias("left_id"), c("y", "id").alias("right_id"), F.greatest(c("x", "start"), c("y", "start")).alias("start"), F.least(c("x", "stop"), c("y", "stop")).alias("stop"))
