"""Scores of models, of which none is shipped: without weights a check is unavailable, never guessed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC, LinearSVCModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.operators.status import check_status

#: Turns a batch of one column into scores; made once for each worker.
Scorer = Callable[[], Callable[[pd.Series], np.ndarray]]


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays of numbers; null if either has no length."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    dot = lambda x, y: total(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")))
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def face_comparison(pairs: DataFrame, low: float, high: float, digits: int | None = None) -> DataFrame:
    """Similarity of a portrait's and a capture's vectors: an observation, not an identity.

    ``completed`` from high, ``inconclusive`` from low, else ``suspicious``; ``unavailable`` without both.
    With ``digits`` the similarity is rounded before it is judged, so the status is that of the value shown."""
    s = cosine(F.col("portrait"), F.col("capture"))
    if digits is not None:
        # Not F.round, which takes the sign from a small negative number.
        s = F.rint(s * 10**digits) / 10**digits
    status = F.when(F.col("similarity").isNull(), "unavailable").when(F.col("similarity") >= high, "completed").when(F.col("similarity") >= low, "inconclusive").otherwise("suspicious")
    return pairs.withColumn("similarity", s).withColumn("status", status)


def scored(images: DataFrame, column: str, scorer: Scorer | None) -> DataFrame:
    """The frame with ``score``, from a pluggable model; null for every row if there is none."""
    if scorer is None:
        return images.withColumn("score", F.lit(None).cast("double"))

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = scorer()
        for batch in batches:
            yield pd.Series(model(batch), index=batch.index, dtype="float64")

    return images.withColumn("score", run(F.col(column)))


def generated_image_status(images: DataFrame, low: float, high: float) -> DataFrame:
    """The status of whole-image scores, with a band between the thresholds where the model abstains."""
    status = check_status(F.col("score").isNotNull(), F.col("score"), low, high)
    reason = F.when(F.col("score").isNull(), "no_model").when(F.col("score") >= high, "score_high").when(F.col("score") >= low, "score_band")
    return images.withColumns({"status": status, "reason": reason})


def face_gated(images: DataFrame, low: float, high: float) -> DataFrame:
    """Face manipulation is judged only where a face was found. Needs face_found and score."""
    found = F.coalesce("face_found", F.lit(False))
    gated = images.withColumn("score", F.when(found, F.col("score")))
    status = check_status(found, F.col("score"), low, high)
    reason = F.when(~found, "no_face").when(F.col("score").isNull(), "no_model").when(F.col("score") >= high, "score_high").when(F.col("score") >= low, "score_band")
    return gated.withColumns({"status": status, "reason": reason})


def train_svm(rows: DataFrame, features: list[str], label: str) -> LinearSVCModel:
    """A linear baseline on the caller's own features; foreign pickles are never loaded."""
    vectors = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(rows)
    return LinearSVC(featuresCol="features", labelCol=label, maxIter=20, regParam=0.01).fit(vectors)


def svm_scores(model: LinearSVCModel, rows: DataFrame, features: list[str]) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    vectors = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(rows)
    out = model.transform(vectors)
    margin = vector_to_array("rawPrediction")[1]
    return out.withColumn("score", margin).drop("features", "rawPrediction", "prediction")
