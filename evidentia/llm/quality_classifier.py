"""A quality classifier that knows where a document comes from.

Two kinds of evidence meet. A logistic classifier reads the text's statistics; its output, freed
of the share of good documents it was trained on, is a log-likelihood ratio. The site gives the
prior: a host's share of good documents is shrunk toward the global share, and a path's share
toward its host's. How strongly is estimated from the data: the beta-binomial's variance between
hosts (and between paths) by the method of moments says how many documents the prior is worth.
A sparse site thus stays near the prior, and a site without labels is the prior.

``source`` is the host and (source, lang) the path, unless other columns are named.

Statistics and scores are DataFrame expressions; the driver only sees the bounded training sample
(``sample`` rows of a dozen numbers, the labelled documents with the lowest hashes) and a few
sums. Site posteriors cover all labelled documents. Defined results: a null text has no words
and gets the score that its statistics give; a null host or path is a site of its own; labels
that repeat for one id count once, with the highest quality; with labels of one class only or
none, the classifier is silent and the prior decides, 0.5 where there is none; equal rows get
equal results, and a null id never has a label; a text of any length is read whole; an empty table
gives an empty result with the same columns; columns with the names of results give way, others pass.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import digits
from evidentia.llm.quality_rules import text_statistics
from evidentia.plans.staging import staged

RESULT = ("quality_prior", "quality_evidence", "quality_score", "quality_kept")


@dataclass(frozen=True)
class QualityModel:
    """sample: most labelled rows that the classifier is fitted on. threshold: documents scored
    below it are rejected. ridge: penalty of the classifier's weights. broadcast_rows: site tables
    up to so many rows are broadcast; larger ones are joined by a shuffle."""

    sample: int = 20_000
    threshold: float = 0.5
    ridge: float = 1.0
    broadcast_rows: int = 100_000


def _features() -> list[Column]:
    """The classifier's inputs: shares as they are, lengths and rates as logarithms."""
    log = lambda c: F.log1p(F.col(c))
    repeated = F.col("repeated_word_share")
    return [log("symbols_per_word"), F.col("repeated_line_share"), repeated, log("chars_per_word"), log("bangs_per_word"), F.col("capital_share"), log("n_words"), (repeated > 0.5).cast("double")]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 30) -> tuple[np.ndarray, float]:
    """Weights and intercept by Newton's method, on standardised inputs; the intercept is free."""
    mean, spread = x.mean(0), x.std(0)
    spread[spread == 0] = 1
    z = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    penalty = np.diag([ridge] * x.shape[1] + [0.0])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (p - y) + penalty @ w
        hessian = (z * (p * (1 - p))[:, None]).T @ z + penalty + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    weights = w[:-1] / spread
    return weights, float(w[-1] - weights @ mean)


def prior_strength(groups: DataFrame, good: str, n: str, share: Column) -> float:
    """How many documents the prior is worth: beta-binomial moments over groups.

    ``share`` is what a group's share of good documents is shrunk toward."""
    g = groups.select(F.col(good).alias("g"), F.col(n).alias("n"), share.alias("p")).filter("n > 0")
    spread = F.col("n") * (F.col("g") / F.col("n") - F.col("p")) ** 2 / F.greatest(F.col("p") * (1 - F.col("p")), F.lit(1e-6))
    row = g.agg(F.sum(spread).alias("s"), F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n").cast("double") ** 2).alias("nn")).first()
    if not row["k"] or row["k"] < 2:
        return 100.0
    excess = row["n"] - row["nn"] / row["n"] - (row["k"] - 1)
    correlation = (row["s"] - (row["k"] - 1)) / excess if excess > 0 else 0.0
    correlation = min(max(correlation, 1e-4), 0.5)
    return 1 / correlation - 1


def quality_scores(documents: DataFrame, labels: DataFrame, model: QualityModel = QualityModel(), host: str = "source", path: str = "lang") -> DataFrame:
    """The documents' own columns, then quality_prior, quality_evidence, quality_score, quality_kept.

    Columns of the documents that have one of these names give way."""
    own = [c for c in documents.columns if c not in RESULT]
    marks = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    ids = marks.orderBy(F.xxhash64(digits(F.col("doc_id"))), "doc_id").limit(model.sample)
    chosen = text_statistics(documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id"), keep=("doc_id", "quality")).dropDuplicates(["doc_id"])
    rows = chosen.select("doc_id", "quality", *[f.cast("double").alias(f"f{i}") for i, f in enumerate(_features())]).orderBy("doc_id").collect()
    x = np.array([r[2:] for r in rows], float).reshape(len(rows), len(_features()))
    y = np.array([r["quality"] for r in rows], float)
    if len(rows) and 0 < y.sum() < len(y):
        weights, intercept = fit_logistic(x, y, model.ridge)
        intercept -= float(np.log(y.sum() / (len(y) - y.sum())))
    else:
        weights, intercept = [], 0.0

    labelled = documents.select("doc_id", F.col(host).alias("host"), F.col(path).alias("path")).join(marks, "doc_id")
    paths = staged(labelled.groupBy("host", "path").agg(F.sum("quality").alias("good"), F.count("*").alias("n")), "quality_paths")
    whole = paths.agg(F.sum("good").alias("good"), F.sum("n").alias("n")).first()
    share = (whole["good"] + 0.5) / (whole["n"] + 1) if whole["n"] else 0.5
    hosts = paths.groupBy("host").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    strength = prior_strength(hosts, "good", "n", F.lit(share))
    hosts = staged(hosts.select("host", ((F.col("good") + strength * share) / (F.col("n") + strength)).alias("host_share")), "quality_hosts")
    known = paths.join(hosts, paths["host"].eqNullSafe(hosts["host"])).select(paths["host"], "path", "good", "n", "host_share")
    strength = prior_strength(known, "good", "n", F.col("host_share"))
    sites = staged(known.select("host", "path", ((F.col("good") + strength * F.col("host_share")) / (F.col("n") + strength)).alias("path_share")), "quality_sites")

    # The row stays in one struct, so that no column of it can clash with the names used here.
    row = F.struct(*[F.col(c) for c in own]).alias("row")
    text = F.col("text")
    judged = text_statistics(documents.select(row, text, F.col(host).alias("host"), F.col(path).alias("path")), keep=("row", "host", "path"))
    evidence = F.lit(intercept)
    for weight, feature in zip(weights, _features()):
        evidence = evidence + F.lit(float(weight)) * feature.cast("double")
    judged = judged.select("row", "host", "path", evidence.alias("evidence"))
    by_size = lambda df: F.broadcast(df) if df.count() <= model.broadcast_rows else df
    judged = judged.alias("d").join(by_size(sites).alias("s"), F.col("d.host").eqNullSafe(F.col("s.host")) & F.col("d.path").eqNullSafe(F.col("s.path")), "left").select("d.*", "s.path_share")
    judged = judged.alias("d").join(by_size(hosts).alias("h"), F.col("d.host").eqNullSafe(F.col("h.host")), "left").select("d.*", F.coalesce("d.path_share", "h.host_share", F.lit(share)).alias("prior"))
    score = 1 / (1 + F.exp(-(F.log(F.col("prior") / (1 - F.col("prior"))) + F.col("evidence"))))
    return judged.select(*[F.col("row").getField(c).alias(c) for c in own], *[c.alias(name) for c, name in zip((F.col("prior"), F.col("evidence"), score, score >= model.threshold), RESULT)])
