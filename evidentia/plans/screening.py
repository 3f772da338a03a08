"""The two screenings, each a single plan from cases to outcomes. They are never merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.operators.document_checks import face_results, mrz_results, ocr_results, official_status, provenance_results, tampering_results
from evidentia.operators.models import Scorer, face_gated, generated_image_status, scored
from evidentia.operators.status import all_checks

RESULT = ("case_id", "workflow", "check", "status", "reason", "score")


def screen_documents(
    cases: DataFrame,
    as_of: Column,
    *,
    quality: str | None = None,
    indicators: DataFrame | None = None,
    limits: dict[str, tuple[float, float]] | None = None,
    faces: DataFrame | None = None,
    similar: tuple[float, float] = (0.4, 0.6),
    facts: DataFrame | None = None,
    official: bool = False,
) -> DataFrame:
    """All document checks of cases (case_id, text, expiry), a row for each; those without input are unavailable.

    quality: the column with the quality gate's status. indicators: long rows for ``tampering``, with
    their ``limits``. faces: case_id, portrait, capture, compared within the thresholds ``similar``.
    facts: provenance facts with case_id. official: also report that issuers' records were not asked."""
    results = ocr_results(cases, "text", quality).unionByName(mrz_results(cases, as_of, expiry="expiry"))
    if indicators is not None:
        results = results.unionByName(tampering_results(indicators, limits or {}))
    if faces is not None:
        results = results.unionByName(face_results(faces, *similar))
    if facts is not None:
        results = results.unionByName(provenance_results(facts))
    if official:
        results = results.unionByName(official_status(cases))
    return all_checks(results, cases.select("case_id", F.lit("document").alias("workflow"))).select(*RESULT)


def detect_media(cases: DataFrame, generated: Scorer | None = None, manipulated: Scorer | None = None, low: float = 0.4, high: float = 0.8, indicators: DataFrame | None = None, limits: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """All media checks of cases (case_id, content, face_found); the two models stay apart.

    Forensic indicators make the row of ``visual_forensics``. ``explanations`` is completed where
    another check of the case has a finding to explain."""
    row = lambda df, check: df.select("case_id", F.lit("media").alias("workflow"), F.lit(check).alias("check"), "status", "reason", "score")
    whole = row(generated_image_status(scored(cases, "content", generated), low, high), "generated_image")
    # The model for faces sees only images in which one was found.
    found = F.coalesce("face_found", F.lit(False))
    judged = scored(cases.filter(found), "content", manipulated).unionByName(cases.filter(~found).withColumn("score", F.lit(None).cast("double")))
    face = row(face_gated(judged, low, high), "face_manipulation")
    results = whole.unionByName(face)
    if indicators is not None:
        results = results.unionByName(row(tampering_results(indicators, limits or {}), "visual_forensics"))
    some = results.groupBy("case_id").agg(F.bool_or(F.col("status") != "unavailable").alias("some")).filter("some")
    told = row(some.withColumns({"status": F.lit("completed"), "reason": F.lit(None).cast("string"), "score": F.lit(None).cast("double")}), "explanations")
    return all_checks(results.unionByName(told), cases.select("case_id", F.lit("media").alias("workflow"))).select(*RESULT)
