"""Connected components of links between keys, as joins; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.plans.staging import staged


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``key`` and ``root``, the least key of its component, of every key in ``links`` (a, b).

    Each round every key takes the least of its own root, its neighbours' roots and the root of its
    root. Roots halve their distance to the least key, so the rounds grow with the logarithm of a
    component's diameter. The counts of a round are the only thing the driver sees. Hot keys are
    pre-aggregated before the shuffle, for a minimum is all that is taken from them."""
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).filter("a != b").distinct()
    both = staged(both, "component_links")
    roots = staged(both.groupBy(F.col("a").alias("key")).agg(F.min("b").alias("b")).select("key", F.least("key", "b").alias("root")), "component_roots")
    for _ in range(most_rounds):
        near = both.join(roots, both["b"] == roots["key"]).groupBy(both["a"].alias("of")).agg(F.min("root").alias("near"))
        up = roots.select(F.col("key").alias("up"), F.col("root").alias("higher"))
        stepped = roots.join(near, roots["key"] == near["of"]).join(up, roots["root"] == up["up"])
        new = staged(stepped.select("key", F.least("root", "near", "higher").alias("root"), (F.least("root", "near", "higher") < F.col("root")).alias("moved")), "component_roots")
        if new.filter("moved").isEmpty():
            return roots
        roots = new.select("key", "root")
    raise RuntimeError("the components did not settle")
