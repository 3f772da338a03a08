"""Rule packs as data: a table of rules becomes conditions that one pass over the rows evaluates.

A rule is (rule, field, test, operand, severity): it is broken where the test holds for the field.
Operands are texts and are read as the field's type. A missing value breaks only ``missing``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

#: Rules that a pack may have: they are parts of one expression.
MOST_RULES = 1_000

_Test = Callable[[Column, str | None, DataType], Column]


def _as(operand: str | None, kind: DataType) -> Column:
    return F.lit(operand).cast(kind)


def _one_of(operand: str | None, kind: DataType) -> list[Column]:
    return [_as(x.strip(), kind) for x in (operand or "").split(",")]


TESTS: dict[str, _Test] = {
    "equals": lambda c, x, t: c == _as(x, t),
    "differs": lambda c, x, t: c != _as(x, t),
    "below": lambda c, x, t: c < _as(x, t),
    "above": lambda c, x, t: c > _as(x, t),
    "one_of": lambda c, x, t: c.isin(*_one_of(x, t)),
    "none_of": lambda c, x, t: ~c.isin(*_one_of(x, t)),
    "matches": lambda c, x, t: c.cast("string").rlike(x or ""),
    "lacks": lambda c, x, t: ~c.cast("string").rlike(x or ""),
    "longer": lambda c, x, t: F.length(c.cast("string")) > int(x or 0),
    "missing": lambda c, x, t: c.isNull() | (F.trim(c.cast("string")) == ""),
    "same_as": lambda c, x, t: c == F.col(x or ""),
    "not_as": lambda c, x, t: c != F.col(x or ""),
}


def compiled(pack: DataFrame, rows: DataFrame) -> dict[str, tuple[Column, str]]:
    """rule -> (condition, severity) for rows of this schema; a pack that cannot be meant is an error."""
    rules = pack.select("rule", "field", "test", "operand", "severity").orderBy("rule").limit(MOST_RULES + 1).collect()
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    found: dict[str, tuple[Column, str]] = {}
    for r in rules:
        other = r["operand"] if r["test"] in ("same_as", "not_as") else r["field"]
        if r["rule"] in found or r["test"] not in TESTS or r["field"] not in kinds or other not in kinds:
            raise ValueError(f"rule {r['rule']}: repeated, or an unknown field or test")
        found[r["rule"]] = (TESTS[r["test"]](F.col(r["field"]), r["operand"], kinds[r["field"]]), r["severity"])
    return found


def pack_findings(rows: DataFrame, pack: DataFrame, keys: list[str]) -> DataFrame:
    """The keys, ``rule`` and ``severity`` of every rule that a row breaks."""
    told = [F.when(F.coalesce(condition, F.lit(False)), F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"))) for rule, (condition, severity) in compiled(pack, rows).items()]
    if not told:
        return rows.select(*keys, F.lit("").alias("rule"), F.lit("").alias("severity")).limit(0)
    return rows.select(*keys, F.explode(F.array_compact(F.array(*told))).alias("f")).select(*keys, "f.rule", "f.severity")


def case_severity(findings: DataFrame, keys: list[str], order: tuple[str, ...]) -> DataFrame:
    """The gravest severity of each key, by ``order`` from the mildest on, and the rules that have it."""
    rank = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("severity"))
    worst = findings.withColumn("rank", rank).groupBy(*keys).agg(F.max("rank").alias("rank"), F.collect_set(F.struct("rank", "rule")).alias("all"))
    rules = F.array_sort(F.transform(F.filter("all", lambda x: x["rank"] == F.col("rank")), lambda x: x["rule"]))
    return worst.select(*keys, F.element_at(F.array(*[F.lit(s) for s in order]), F.col("rank").cast("int")).alias("severity"), rules.alias("rules"))
