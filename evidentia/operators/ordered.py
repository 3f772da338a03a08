"""Running values over ordered rows, without a task that holds a whole group.

Rows are dealt out by ranges of (group, order), so a group of any size lies in consecutive cells of
about equal size. Windows run inside cells; what a cell inherits from the ones before it comes from
one row for each group and cell. Rows with equal group and order fall into one cell: callers add a
column that tells them apart, or count them first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.plans.staging import staged


def ranged(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``cell``, consecutive in the order; written as a table, for ranges are drawn from a sample."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return staged(rows.repartitionByRange(parts, *by, *order).withColumn("cell", F.spark_partition_id()), "ordered_cells")


def _inherited(cells: DataFrame, by: list[str], own: Column, over) -> DataFrame:
    """One row for each group and cell: ``inherited``, made by ``over(column, window)`` of the cells before."""
    ends = cells.groupBy(*by, "cell").agg(own.alias("own"))
    before = Window.partitionBy(*by).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    return ends.select(*by, "cell", over(F.col("own")).over(before).alias("inherited"))


def _with_inherited(cells: DataFrame, by: list[str], inherited: DataFrame) -> DataFrame:
    same = F.col("c.cell") == F.col("i.cell")
    for b in by:
        same &= F.col(f"c.{b}").eqNullSafe(F.col(f"i.{b}"))
    return cells.alias("c").join(inherited.alias("i"), same).select("c.*", "i.inherited")


def last_known(cells: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``cells`` with ``name``: the last ``value`` that is not null in the group, up to this row."""
    ending = F.max(F.when(F.col(value).isNotNull(), F.struct(*order, F.col(value).alias("v"))))["v"]
    inherited = _inherited(cells, by, ending, lambda c: F.last(c, ignorenulls=True))
    here = Window.partitionBy(*by, "cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = _with_inherited(cells, by, inherited)
    return found.withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(here), "inherited")).drop("inherited")


def running_total(cells: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``cells`` with ``name``: the sum of ``value`` over the rows of the group before this one."""
    inherited = _inherited(cells, by, F.sum(value), F.sum)
    here = Window.partitionBy(*by, "cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = _with_inherited(cells, by, inherited)
    none = F.lit(0)
    return found.withColumn(name, F.coalesce(F.sum(value).over(here), none) + F.coalesce("inherited", none)).drop("inherited")
