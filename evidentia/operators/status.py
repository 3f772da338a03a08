"""Statuses of checks, outcomes of cases, and what a reviewer sees of them.

Every check adds rows (case_id, workflow, check, status, reason, score). The two workflows, document
and media, are never merged: each roll-up has the workflow among its keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The checks of each workflow with the names they are shown under.
CHECKS = {
    "document": {
        "ocr_fields": "OCR & field extraction",
        "mrz_consistency": "MRZ & consistency",
        "tampering": "Tampering indicators",
        "face_verification": "Face verification",
        "metadata_provenance": "Metadata & provenance",
    },
    "media": {
        "generated_image": "AI-generated image screening",
        "face_manipulation": "Deepfake / face manipulation",
        "visual_forensics": "Visual forensic signals",
        "explanations": "Explainable observations",
    },
}
#: The kinds of evidence that each workflow shows.
EVIDENCE = {
    "document": ("Extracted fields", "MRZ observations", "Consistency issues", "Date / validity checks", "Tampering evidence", "Face comparison", "Metadata / provenance", "Recommended review action"),
    "media": ("AI-image observations", "Deepfake observations", "Detected-face status", "Forensic signals", "Supported confidence", "Inconclusive reasons", "Unavailable checks", "Recommended review action"),
}
STATUSES = ("completed", "suspicious", "inconclusive", "unavailable")
ACTIONS = {
    "suspicious": "Escalate to a reviewer with the findings.",
    "inconclusive": "Ask for a better capture and review by hand.",
    "unavailable": "Run the missing checks before deciding.",
    "checks_completed": "Continue the usual review.",
}
REASONS = {
    "no_zone": "No machine-readable zone was found.",
    "several_zones": "The text holds several different machine-readable zones.",
    "not_comparable": "A printed field could not be compared with the machine-readable zone.",
    "no_connection": "There is no authorised connection to the issuer's records.",
    "field_mismatch": "A printed field differs from the machine-readable zone.",
    "check_digit": "A check digit does not hold.",
    "expired": "The document has expired.",
    "invalid_date": "A date cannot exist.",
    "low_quality": "The capture is too poor to judge.",
    "no_face": "No face was found.",
    "no_model": "The model for this check is not installed.",
    "repeated_region": "Parts of the image repeat.",
    "score_high": "The score is above the threshold.",
    "score_band": "The score lies between the thresholds.",
    "face_differs": "The portrait and the capture do not resemble each other.",
    "no_metadata": "The file carries no provenance data.",
    "unreadable": "The file could not be read.",
}


def check_catalog(spark: SparkSession) -> DataFrame:
    """workflow, check and name of all nine checks."""
    return spark.createDataFrame([(w, c, n) for w, checks in CHECKS.items() for c, n in checks.items()], "workflow string, check string, name string")


def evidence_catalog(spark: SparkSession) -> DataFrame:
    """workflow and kind of all sixteen kinds of evidence."""
    return spark.createDataFrame([(w, k) for w, kinds in EVIDENCE.items() for k in kinds], "workflow string, kind string")


def reason_texts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(REASONS.items()), "reason string, reason_text string")


def check_status(available: Column, score: Column, low: float, high: float) -> Column:
    """unavailable without a score; suspicious from ``high``; inconclusive from ``low``; else completed."""
    return F.when(~F.coalesce(available, F.lit(False)) | score.isNull(), "unavailable").when(score >= high, "suspicious").when(score >= low, "inconclusive").otherwise("completed")


def all_checks(results: DataFrame, cases: DataFrame) -> DataFrame:
    """All results, and a row for each check of the case's workflow that has none: unavailable.

    A case's checks come from the catalogue by its workflow, an equality join with nine rows. Results
    of checks outside the catalogue, of other cases and several of one check all stay. A null case_id is
    a case like any other."""
    catalog = F.broadcast(check_catalog(cases.sparkSession).drop("name"))
    wanted = cases.select("case_id", "workflow").distinct().join(catalog, "workflow")
    have = results.select("case_id", "workflow", "check").alias("r")
    same = F.col("w.case_id").eqNullSafe(F.col("r.case_id")) & (F.col("w.workflow") == F.col("r.workflow")) & (F.col("w.check") == F.col("r.check"))
    none = wanted.alias("w").join(have, same, "left_anti").withColumns({"status": F.lit("unavailable"), "reason": F.lit("no_model")})
    missing = F.col("status").isNull()
    found = results.withColumns({"status": F.coalesce("status", F.lit("unavailable")), "reason": F.when(missing, F.coalesce("reason", F.lit("no_model"))).otherwise(F.col("reason"))})
    return found.unionByName(none, allowMissingColumns=True)


def outcome(status: Column) -> Column:
    """The outcome of a group of statuses: the gravest finding, or unavailable if nothing ran."""
    some = lambda s: F.bool_or(status == s)
    return F.when(some("suspicious"), "suspicious").when(some("inconclusive"), "inconclusive").when(some("completed"), "checks_completed").otherwise("unavailable")


def case_outcomes(results: DataFrame) -> DataFrame:
    """case_id, workflow, outcome, manual_review, reasons, action. Order of rows never matters."""
    status = F.col("status")
    rolled = results.groupBy("case_id", "workflow").agg(outcome(status).alias("outcome"), F.bool_or(status == "unavailable").alias("gap"), F.array_sort(F.collect_set("reason")).alias("reasons"))
    action = F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])[F.col("outcome")]
    return rolled.select("case_id", "workflow", "outcome", (F.col("gap") | (F.col("outcome") != "checks_completed")).alias("manual_review"), "reasons", action.alias("action"))


def supported_confidence(score: Column, calibrated: Column) -> Column:
    """A confidence is shown only where the score was calibrated; never invented."""
    return F.when(F.coalesce(calibrated, F.lit(False)), score)


def explained(results: DataFrame) -> DataFrame:
    """Results with the sentence for their reason; reasons that are not known stay without."""
    return results.join(F.broadcast(reason_texts(results.sparkSession)), "reason", "left")


def evidence_view(results: DataFrame) -> DataFrame:
    """The expert's view: case_id, workflow, kind, check, status, reason, score of every kind of evidence (``EVIDENCE``)
    that a case has, and the recommended action as a row of its own, with the outcome as its status.

    A result stands under each kind that it speaks to, so a passed date is an observation of the zone and
    a validity check; results of checks that no kind names stay out."""
    check, why, status = F.col("check"), F.coalesce("reason", F.lit("")), F.col("status")
    zone, face = check == "mrz_consistency", check == "face_manipulation"
    document, media = EVIDENCE["document"], EVIDENCE["media"]
    speaks = {
        ("document", document[0]): check == "ocr_fields",
        ("document", document[1]): zone,
        ("document", document[2]): zone & why.isin("field_mismatch", "not_comparable", "several_zones"),
        ("document", document[3]): zone & why.isin("expired", "invalid_date"),
        ("document", document[4]): check == "tampering",
        ("document", document[5]): check == "face_verification",
        ("document", document[6]): check == "metadata_provenance",
        ("media", media[0]): check == "generated_image",
        ("media", media[1]): face & (status != "unavailable"),
        ("media", media[2]): face & (why != "no_model"),
        ("media", media[3]): check == "visual_forensics",
        ("media", media[4]): F.col("score").isNotNull(),
        ("media", media[5]): status == "inconclusive",
        ("media", media[6]): status == "unavailable",
    }
    kinds = F.array_compact(F.array(*[F.when((F.col("workflow") == w) & holds, F.lit(kind)) for (w, kind), holds in speaks.items()]))
    found = results.select("case_id", "workflow", F.explode(kinds).alias("kind"), "check", "status", "reason", "score")
    none = F.lit(None).cast("string")
    action = case_outcomes(results).select("case_id", "workflow", F.lit(document[7]).alias("kind"), none.alias("check"), F.col("outcome").alias("status"), F.col("action").alias("reason"), F.lit(None).cast("double").alias("score"))
    return found.unionByName(action)


def explanations(results: DataFrame) -> DataFrame:
    """case_id, workflow and ``text``: for a reviewer, what each check that ran found, and which could not.

    One sentence for each check with a status other than completed, in the order of the checks' names:
    the name under which it is shown, its status, and the sentence of its reason where there is one.
    Cases whose checks all completed have a text that says so."""
    names = {check: name for checks in CHECKS.values() for check, name in checks.items()}
    shown = F.coalesce(F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col("check")], F.col("check"))
    sentence = F.concat(shown, F.lit(": "), F.col("status"), F.lit("."), F.coalesce(F.concat(F.lit(" "), "reason_text"), F.lit("")))
    said = explained(results).withColumn("sentence", F.when(F.col("status") != "completed", F.struct("check", sentence.alias("sentence"))))
    told = F.transform(F.array_sort(F.collect_set("sentence")), lambda x: x["sentence"])
    whole = said.groupBy("case_id", "workflow").agg(told.alias("told"))
    return whole.select("case_id", "workflow", F.when(F.size("told") == 0, "All checks were completed.").otherwise(F.array_join("told", "\n")).alias("text"))


def disclosure(results: DataFrame) -> dict[str, DataFrame]:
    """Three views of the same results: summary, evidence and expert. Each reads only its own columns."""
    return {
        "summary": case_outcomes(results),
        "evidence": explained(results).select("case_id", "workflow", "check", "status", "reason", "reason_text"),
        "expert": results,
    }


def review_queue(outcomes: DataFrame, most: int) -> DataFrame:
    """The ``most`` cases that a person should see first: the gravest outcome, then the least case."""
    rank = F.create_map(*[F.lit(x) for pair in (("suspicious", 0), ("inconclusive", 1), ("unavailable", 2), ("checks_completed", 3)) for x in pair])[F.col("outcome")]
    return outcomes.filter("manual_review").withColumn("rank", rank).orderBy("rank", "case_id", "workflow").limit(most).drop("rank")


def assembled(*checks: DataFrame) -> DataFrame:
    """One row for each case and workflow with all evidence in a fixed order."""
    rows = checks[0]
    for more in checks[1:]:
        rows = rows.unionByName(more, allowMissingColumns=True)
    item = F.struct("check", "status", "reason", "score")
    return rows.groupBy("case_id", "workflow").agg(F.array_sort(F.collect_list(item)).alias("evidence"))
