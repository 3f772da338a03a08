"""Quality rules whose cutoffs carry a guarantee against rejecting good documents.

Every rule compares one statistic of a text with a cutoff. The possible cutoffs are fixed in
advance. For each stratum of documents, the labelled good documents of that stratum test each
cutoff: its false-rejection rate is below the limit, with certainty, when so few rejected good
documents would be improbable at that limit under the exact binomial law. The error budget is
split over strata and rules (Bonferroni), and inside one rule the cutoffs are tested from the
mildest to the harshest (fixed sequence), which needs no further correction. Among the certified
cutoffs the one that best tells bad from good documents is used; a rule without one stays silent.

The strata are the languages; every one has its own guarantee, however many there are. The guarantee is
about good documents that pass the base; it needs labels: at the default limit and four languages a
cutoff is certified from about 1,850 good labels of its stratum on, even if it rejects none of them.

Only DataFrame functions are used. Defined results: a null text has no words and fails the base, an
empty one too; a text of any length is counted whole; a null language is a stratum of its own, apart
from languages of any name; repeated rows each get their own result; labels that repeat for one id
count once, with the highest quality; of cutoffs of equal gain the higher, milder one is used; without
labels only the base decides, and without documents there are no rows; of the columns of the input
only doc_id, lang and text are read, and others give way.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import let, words
from evidentia.plans.staging import staged

#: Words in a window whose repetition is counted.
WINDOW = 5
#: Statistic of each rule, and its cutoffs from the mildest to the harshest. Above a cutoff: reject.
RULES: dict[str, tuple[float, ...]] = {
    "symbols_per_word": (3.0, 2.0, 1.5, 1.0, 0.7, 0.5, 0.3, 0.2),
    "repeated_line_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2),
    "repeated_word_share": (0.19, 0.18, 0.16, 0.14, 0.12, 0.1, 0.08, 0.06),
    "chars_per_word": (60.0, 40.0, 30.0, 25.0, 20.0, 16.0, 14.0, 12.0),
    "bangs_per_word": (2.0, 1.5, 1.0, 0.8, 0.6, 0.4, 0.3, 0.2),
    "capital_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3),
}


@dataclass(frozen=True)
class RiskControl:
    """limit: share of good documents of a stratum that all rules together may reject.
    error: probability that any stratum exceeds its limit. broadcast_rows: the most strata whose
    cutoffs are broadcast; more are joined, with the same result."""

    limit: float = 0.02
    error: float = 0.05
    broadcast_rows: int = 10_000
    rules: dict[str, tuple[float, ...]] = field(default_factory=lambda: dict(RULES))


def repeated_window_words(w: Column) -> Column:
    """Words that lie in a window of five which occurs twice or more in the text.

    Windows are compared by 64-bit hashes. Where all hashes differ the answer is 0; else the
    hashes are sorted with their positions, so that equal windows become neighbours, and the
    positions found are swept once: each adds the words that the next window does not cover.
    The work is n log n in the words of one text, whatever repeats.
    """

    def swept(p: Column) -> Column:
        gained = F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))))
        return F.aggregate(gained, F.lit(0).cast("long"), lambda a, x: a + x)

    def repeated(s: Column) -> Column:
        same = F.filter(s, lambda x, i: F.coalesce((F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]), F.get(s, i - 1)["h"] == x["h"], F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
        return let(F.sort_array(F.transform(same, lambda x: x["i"])), swept)

    def counted(h: Column) -> Column:
        pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(F.sort_array(pairs), repeated))

    starts = F.sequence(F.lit(0), F.size(w) - WINDOW)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
    return F.when(F.size(w) <= WINDOW, F.lit(0).cast("long")).otherwise(let(hashes, counted))


def text_statistics(documents: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang"), text_column: str = "text") -> DataFrame:
    """The columns to keep, the base counts, whether the base fails, and the statistic of each rule."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    by_words = let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_window_words(w).alias("n_repeat_words"),
        ),
    )
    by_lines = let(
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")),
    )
    counts = documents.select(
        *keep, by_words.alias("w"), by_lines.alias("l"),
        count(r"[#*$%&|<>]").alias("n_symbols"), count("!").alias("n_bangs"), count(r"\p{Lu}").alias("n_capitals"),
    )
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return counts.select(*keep, "w.*", "l.*", "n_symbols", "n_bangs", "n_capitals").select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
        per("n_symbols", "n_words").alias("symbols_per_word"),
        per("n_dup_lines", "n_lines").alias("repeated_line_share"),
        per("n_repeat_words", "n_words").alias("repeated_word_share"),
        per("word_chars", "n_words").alias("chars_per_word"),
        per("n_bangs", "n_words").alias("bangs_per_word"),
        per("n_capitals", "word_chars").alias("capital_share"),
    )


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """log P(X <= k) for X ~ Binomial(n, p), by summing the exact terms in logarithms."""
    start = F.struct((n * F.log(F.lit(1 - p))).alias("term"), (n * F.log(F.lit(1 - p))).alias("total"))

    def add(a: Column, i: Column) -> Column:
        term = a["term"] + F.log((n - i + 1) / i) + F.log(F.lit(p / (1 - p)))
        return let(term, lambda t: F.struct(t.alias("term"), (F.greatest(t, a["total"]) + F.log1p(F.exp(-F.abs(t - a["total"])))).alias("total")))

    terms = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(terms, start, add, lambda a: a["total"])


def certified_cutoffs(labelled: DataFrame, control: RiskControl) -> DataFrame:
    """One row for each stratum: its cutoff of each rule, null where none is certified or useful.

    labelled: stratum, quality and the statistics of labelled documents that pass the base."""
    good, bad = F.col("quality") == 1, F.col("quality") == 0
    sums = [F.count_if(good).alias("n_good"), F.count_if(bad).alias("n_bad")]
    for rule, levels in control.rules.items():
        for j, level in enumerate(levels):
            sums += [F.count_if(good & (F.col(rule) > level)).alias(f"{rule}_{j}_good"), F.count_if(bad & (F.col(rule) > level)).alias(f"{rule}_{j}_bad")]
    counts = staged(labelled.groupBy("stratum").agg(*sums), "quality_counts")
    n_tests = max(1, counts.count()) * len(control.rules)
    tested = F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.lit(level).alias("level"), F.col(f"{rule}_{j}_good").alias("k"), F.col(f"{rule}_{j}_bad").alias("hits"))
        for rule, levels in control.rules.items() for j, level in enumerate(levels)
    ])
    share = control.limit / len(control.rules)
    tests = counts.select("stratum", "n_good", "n_bad", F.explode(tested).alias("t")).select("stratum", "n_good", "n_bad", "t.*")
    passes = F.when(F.col("k") > share * F.col("n_good"), F.lit(False)).otherwise(
        binomial_tail(F.col("k"), F.col("n_good"), share) <= F.log(F.lit(control.error / n_tests))
    )
    gain = F.col("hits") / F.greatest(F.col("n_bad"), F.lit(1)) - F.col("k") / F.greatest(F.col("n_good"), F.lit(1))
    best = F.max(F.struct(gain.alias("gain"), F.col("level").alias("level")))["level"]
    return tests.filter(passes & (gain > 0)).groupBy("stratum").pivot("rule", list(control.rules)).agg(best)


def quality_rules(documents: DataFrame, labels: DataFrame, control: RiskControl = RiskControl()) -> DataFrame:
    """Every document with its counts, ``base_failed``, the ``rules`` that reject it, and ``kept``."""
    statistics = staged(text_statistics(documents), "quality_statistics")
    marks = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    # A null language is apart from one of any name.
    stratum = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))
    labelled = statistics.withColumn("stratum", stratum).join(marks, "doc_id").filter("not base_failed")
    cutoffs = certified_cutoffs(labelled, control)
    cutoffs = staged(cutoffs.select("stratum", *[F.col(r).alias(f"cutoff_{r}") for r in control.rules]), "quality_cutoffs")
    few = cutoffs.count() <= control.broadcast_rows
    judged = statistics.withColumn("stratum", stratum).join(F.broadcast(cutoffs) if few else cutoffs, "stratum", "left")
    broken = F.array_compact(F.array(*[F.when(F.col(r) > F.col(f"cutoff_{r}"), F.lit(r)) for r in control.rules]))
    judged = judged.withColumn("rules", broken)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("rules") == 0)).drop(*[f"cutoff_{r}" for r in control.rules])
