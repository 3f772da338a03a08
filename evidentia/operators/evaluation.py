"""Measures of decisions against truth. Abstentions never count as errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.operators.ordered import ranged, running_total
from evidentia.plans.staging import staged

ABSTAINED = ("inconclusive", "unavailable")


def field_accuracy(rows: DataFrame, by: list[str]) -> DataFrame:
    """The share of predicted values equal to the true ones; two nulls are equal."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.col("predicted").eqNullSafe(F.col("truth")).cast("double")).alias("accuracy"))


def confusion(rows: DataFrame, outcome: Column, truth: Column, by: list[str]) -> DataFrame:
    """tp, fp, tn, fn, abstained and the two error rates, for each group."""
    flagged, abstained = outcome == "suspicious", outcome.isin(*ABSTAINED)
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    counted = rows.groupBy(*by).agg(
        count(flagged & (truth == 1)).alias("tp"), count(flagged & (truth == 0)).alias("fp"),
        count(~flagged & ~abstained & (truth == 0)).alias("tn"), count(~flagged & ~abstained & (truth == 1)).alias("fn"),
        count(abstained).alias("abstained"),
    )
    rate = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b)))
    return counted.withColumns({"false_alarm_rate": rate("fp", "tn"), "miss_rate": rate("fn", "tp")})


def exact_quantiles(rows: DataFrame, value: str, by: list[str], shares: dict[str, float]) -> DataFrame:
    """by, n and, for each name in ``shares``, the interpolated quantile of the values that are not null.

    Equal values are counted first and the distinct ones dealt out by ranges, so no task holds a group;
    a value answers for the ranks that it and its copies take. Groups without values have n = 0."""
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("value")).agg(F.count("*").alias("copies"))
    ranked = running_total(ranged(counted, by, ["value"]), by, ["value"], "copies", "before")
    sizes = staged(rows.groupBy(*by).agg(F.count(value).alias("n")), "quantile_groups")
    same = [F.col(f"r.{b}").eqNullSafe(F.col(f"s.{b}")) for b in by]
    both = ranked.alias("r").join(sizes.alias("s"), same) if by else ranked.withColumn("n", sizes.scalar())
    picks = {}
    for name, share in shares.items():
        place = (F.col("n") - 1) * F.lit(float(share))
        for end, rank in (("low", F.floor(place)), ("high", F.ceil(place))):
            picks[f"{name}_{end}"] = F.max(F.when((rank >= F.col("before")) & (rank < F.col("before") + F.col("copies")), F.col("value"))).alias(f"{name}_{end}")
    found = both.groupBy(*[F.col(f"s.{b}").alias(b) for b in by]).agg(*picks.values()).alias("f")
    whole = sizes.alias("s").join(found, [F.col(f"s.{b}").eqNullSafe(F.col(f"f.{b}")) for b in by], "left") if by else found.withColumn("n", sizes.scalar())
    rest = lambda share: F.pmod((F.col("n") - 1) * F.lit(float(share)), F.lit(1.0))
    at = {name: (F.col(f"{name}_low") + (F.col(f"{name}_high") - F.col(f"{name}_low")) * rest(share)).alias(name) for name, share in shares.items()}
    return whole.select(*[f"s.{b}" for b in by], "n", *at.values())


def latency(rows: DataFrame, value: str, by: list[str], exact: bool = True) -> DataFrame:
    """Median, 90th and 99th percentile; ``exact=False`` keeps a sketch instead of all values."""
    if exact:
        return exact_quantiles(rows, value, by, {"p50": 0.5, "p90": 0.9, "p99": 0.99})
    q = lambda p: F.percentile_approx(value, p, 10_000)
    return rows.groupBy(*by).agg(F.count(value).alias("n"), q(0.5).alias("p50"), q(0.9).alias("p90"), q(0.99).alias("p99"))


def roc_points(rows: DataFrame, score: str, truth: str, by: list[str]) -> DataFrame:
    """For each threshold (a distinct score): positives and negatives at or above it, and the rates.

    Scores are counted first, so what the window walks is one row for each distinct score."""
    counted = rows.filter(F.col(score).isNotNull() & F.col(truth).isNotNull()).groupBy(*by, F.col(score).alias("threshold")).agg(F.count_if(F.col(truth) == 1).alias("p"), F.count_if(F.col(truth) == 0).alias("n"))
    down = Window.partitionBy(*by).orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    rate = lambda c: F.when(F.sum(c).over(whole) > 0, F.sum(c).over(down) / F.sum(c).over(whole))
    return counted.select(*by, "threshold", F.sum("p").over(down).alias("tp"), F.sum("n").over(down).alias("fp"), rate("p").alias("tpr"), rate("n").alias("fpr"))
