"""Connected components of links between keys: joins and minima, nothing gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.plans.staging import staged


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``key`` and ``root`` (the least key of its component) of every key in ``links`` (a, b).

    A key takes the least root among its own, its neighbours' and that of its root, until none moves.
    Minima combine before the shuffle, so a key with very many neighbours does not fill a task. The
    driver sees one count a round. Links that name a null key are left out."""
    pairs = links.select("a", "b").filter("a is not null and b is not null")
    both = staged(pairs.union(pairs.select("b", "a")).distinct(), "component_pairs")
    roots = staged(both.groupBy(F.col("a").alias("key")).agg(F.min("b").alias("root")).select("key", F.least("key", "root").alias("root")), "component_labels")
    for _ in range(most_rounds):
        around = both.join(roots, both["b"] == roots["key"]).groupBy(F.col("a").alias("of")).agg(F.min("root").alias("around"))
        above = roots.select(F.col("key").alias("is"), F.col("root").alias("above"))
        best = F.least("root", "around", "above")
        step = roots.join(around, roots["key"] == around["of"]).join(above, roots["root"] == above["is"])
        step = staged(step.select("key", best.alias("root"), (best < F.col("root")).alias("moved")), "component_labels")
        if step.filter("moved").isEmpty():
            return roots
        roots = step.select("key", "root")
    raise RuntimeError("the components did not settle")
