"""Document checks: field extraction, printed-versus-MRZ consistency, rules, dates, quality."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions import printed as forms
from evidentia.functions.mrz import digits_ok, let, mrz_checks, mrz_date, parse_mrz
from evidentia.functions.printed import COUNTRIES, date_readings, numeric_date
from evidentia.operators.models import face_comparison

#: Labels under which fields are printed.
LABELS = {
    "surname": "surname|last name|family name",
    "given": "given names?|first names?",
    "number": "passport no|document no|card no|number",
    "nationality": "nationality",
    "birth": "date of birth|birth date|born",
    "expiry": "date of expiry|expiry date|expires|valid until",
}
#: Dates, with the years after ``as_of`` that such a date may lie in the future.
DATES = {"birth": 0, "expiry": 50}
NAMES = ("surname", "given")


def printed_field(field: str, text: Column) -> Column:
    """The value of a ``label: value`` line; null if there is none. A date with one reading is put in one form, others stay as printed."""
    raw = F.nullif(F.trim(F.regexp_extract(text, rf"(?im)^\s*(?:{LABELS[field]})\s*[:.]\s*(.+?)\s*$", 1)), F.lit(""))
    if field not in DATES:
        return raw
    one = lambda value: let(date_readings(value), lambda read: F.coalesce(F.when(F.size(read) == 1, F.get(read, F.lit(0)).cast("string")), value))
    return let(raw, one)


def zone_field(field: str, as_of: Column) -> Column:
    """The same of a parsed zone."""
    if field in DATES:
        return mrz_date(F.col(f"mrz_{field}"), as_of, DATES[field]).cast("string")
    return F.trim(F.translate(f"mrz_{field}", "<", " "))


def agreement(field: Column, printed: Column, zone: Column, cut: Column, countries: Mapping[str, tuple[str, ...]] = COUNTRIES) -> Column:
    """The status of a printed value held against the zone's.

    A value that only one of them has is inconclusive, and one that neither has unavailable. Names may
    be transliterated in any way that the standard allows and, where the names fill all their places
    (``cut``), be shortened. Nationalities are compared by code; one that is no code and not among
    ``countries`` is inconclusive. A date agrees if it can be read as the zone's; one that is not
    understood is inconclusive, one that cannot exist does not agree. Other values are compared
    without case and white space."""
    plain = lambda c: F.upper(F.regexp_replace(F.trim(c), r"\s+", " "))
    grade = lambda ok: F.when(ok.isNull(), "inconclusive").when(ok, "completed").otherwise("suspicious")
    number = lambda c: F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")
    day = let(date_readings(printed), lambda read: F.when((F.size(read) > 0) | numeric_date(printed), F.coalesce(F.array_contains(read, F.try_to_date(zone, "yyyy-MM-dd")), F.lit(False))))
    return (
        F.when(printed.isNull() & zone.isNull(), "unavailable")
        .when(printed.isNull() | zone.isNull(), "inconclusive")
        .when(field.isin(*NAMES), grade(forms.names_agree(printed, zone, F.coalesce(cut, F.lit(False)))))
        .when(field == "nationality", grade(forms.country_code(printed, countries) == plain(zone)))
        .when(field == "number", grade(number(printed) == number(zone)))
        .when(field.isin(*DATES), grade(day))
        .otherwise(grade(plain(printed) == plain(zone)))
    )


def compared(parsed: DataFrame, text: str, as_of: Column, countries: Mapping[str, tuple[str, ...]] = COUNTRIES) -> DataFrame:
    """``parsed`` with ``fields``: an array of field, printed, mrz and status, without a shuffle.

    Every field is there; what neither source has is unavailable."""
    zone = F.col("mrz_format").isNotNull()
    said = F.array(*[F.struct(F.lit(f).alias("field"), printed_field(f, F.col(text)).alias("printed"), F.when(zone, zone_field(f, as_of)).alias("mrz")) for f in LABELS])
    told = lambda x: F.struct(x["field"].alias("field"), x["printed"].alias("printed"), x["mrz"].alias("mrz"), agreement(x["field"], x["printed"], x["mrz"], F.col("mrz_cut"), countries).alias("status"))
    return parsed.withColumn("fields", F.transform(said, told))


def printed_fields(cases: DataFrame, text: str = "text") -> DataFrame:
    """Long rows (case_id, source, field, value) of ``label: value`` lines; absent fields give no row."""
    found = [F.struct(F.lit(f).alias("field"), printed_field(f, F.col(text)).alias("value")) for f in LABELS]
    rows = cases.select("case_id", F.explode_outer(F.array(*found)).alias("f"))
    return rows.select("case_id", F.lit("printed").alias("source"), "f.field", "f.value").filter("value is not null")


def mrz_fields(parsed: DataFrame, as_of: Column | None = None) -> DataFrame:
    """The same of the zone, with ``cut``. Centuries of dates are told by ``as_of``, today if it is not given."""
    day = F.current_date() if as_of is None else as_of
    found = [F.struct(F.lit(f).alias("field"), zone_field(f, day).alias("value")) for f in LABELS]
    rows = parsed.filter("mrz_format is not null").select("case_id", "mrz_cut", F.explode_outer(F.array(*found)).alias("f"))
    return rows.select("case_id", F.lit("mrz").alias("source"), "f.field", "f.value", F.col("mrz_cut").alias("cut"))


def field_consistency(fields: DataFrame) -> DataFrame:
    """One row for each case and field of long rows from any sources: both values and their ``agreement``.

    One grouped pass instead of a self join. Rows may have ``cut``, as zones' do."""
    value = lambda s: F.max(F.when(F.col("source") == s, F.col("value")))
    cut = F.bool_or(F.coalesce("cut", F.lit(False))) if "cut" in fields.columns else F.lit(False)
    both = fields.groupBy("case_id", "field").agg(value("printed").alias("printed"), value("mrz").alias("mrz"), cut.alias("cut"))
    return both.withColumn("status", agreement(F.col("field"), F.col("printed"), F.col("mrz"), F.col("cut"))).drop("cut")


def rule_findings(rows: DataFrame, rules: dict[str, Column], keys: list[str]) -> DataFrame:
    """Long findings: the keys and ``rule`` for each rule (a condition that must not hold) that a row breaks."""
    broken = F.array_compact(F.array(*[F.when(condition, F.lit(name)) for name, condition in rules.items()]))
    return rows.select(*keys, F.explode(broken).alias("rule"))


def date_status(raw: Column, pattern: str, as_of: Column) -> Column:
    """suspicious if the date has passed at ``as_of`` or cannot exist, unavailable if there is none.

    A document is still valid on the day it expires."""
    day = F.try_to_date(raw, pattern)
    return F.when(raw.isNull() | (F.trim(raw) == ""), "unavailable").when(day.isNull() | (day < as_of), "suspicious").otherwise("completed")


def quality_gate(images: DataFrame, least_sharpness: float, least_side: int) -> DataFrame:
    """Poor captures are inconclusive, never suspicious; needs sharpness, width and height."""
    poor = (F.col("sharpness") < least_sharpness) | (F.least("width", "height") < least_side)
    return images.withColumn("quality_status", F.when(F.col("sharpness").isNull(), "unavailable").when(poor, "inconclusive").otherwise("completed"))


def _row(check: str, status: Column, reason: Column, score: Column | None = None) -> list[Column | str]:
    score = F.lit(None).cast("double") if score is None else score
    return ["case_id", F.lit("document").alias("workflow"), F.lit(check).alias("check"), status.alias("status"), reason.cast("string").alias("reason"), score.alias("score")]


def mrz_results(cases: DataFrame, as_of: Column, text: str = "text", expiry: str | None = None, pattern: str = "yyyy-MM-dd", countries: Mapping[str, tuple[str, ...]] = COUNTRIES) -> DataFrame:
    """One row for each row of cases: check digits, the comparison with printed fields, and validity.

    Rows that share a case_id are its pages, and each has its own result. The expiry is that of the
    zone, the printed one and, in column ``expiry``, one that the caller supplies; if any has passed or
    cannot exist the check is suspicious. A printed date with several readings has passed if all have.
    Without a zone the check is unavailable, unless another date already is a finding. Reasons in this
    order: a check digit, a field, an impossible date, a passed one; then, inconclusive, several
    different zones and values that cannot be compared."""
    supplied = F.nullif(F.trim(F.col(expiry)), F.lit("")) if expiry else F.lit(None).cast("string")
    parsed = compared(mrz_checks(parse_mrz(cases, text)), text, as_of, countries)
    zone, other = F.get(F.filter("fields", lambda x: x["field"] == "expiry"), F.lit(0)), F.try_to_date("supplied", pattern)
    dated = parsed.withColumns({"supplied": supplied, "expiry_field": zone}).withColumn("read", date_readings(F.col("expiry_field.printed")))
    day = F.try_to_date("expiry_field.mrz", "yyyy-MM-dd")
    yes = lambda c: F.coalesce(c, F.lit(False))
    has = lambda status: F.exists("fields", lambda x: (x["status"] == status) & x["printed"].isNotNull() & x["mrz"].isNotNull())
    own = dated.select(
        "case_id",
        digits_ok().alias("digits_ok"),
        has("suspicious").alias("differs"),
        has("inconclusive").alias("unclear"),
        (F.col("mrz_zones") > 1).alias("several"),
        (yes(day < as_of) | yes(other < as_of) | yes(F.array_max("read") < as_of)).alias("passed"),
        (yes((F.translate("mrz_expiry", "<", "") != "") & day.isNull()) | yes(F.col("supplied").isNotNull() & other.isNull()) | yes((F.size("read") == 0) & numeric_date(F.col("expiry_field.printed")))).alias("impossible"),
    )
    found = F.when(~F.col("digits_ok"), "check_digit").when(F.col("differs"), "field_mismatch").when(F.col("impossible"), "invalid_date").when(F.col("passed"), "expired")
    unsure = F.when(F.col("several"), "several_zones").when(F.col("unclear"), "not_comparable")
    none = F.col("digits_ok").isNull()
    status = F.when(found.isNotNull(), "suspicious").when(none, "unavailable").when(unsure.isNotNull(), "inconclusive").otherwise("completed")
    return own.select(*_row("mrz_consistency", status, F.coalesce(found, F.when(none, "no_zone"), unsure)))


def ocr_results(cases: DataFrame, text: str = "text", quality: str | None = None) -> DataFrame:
    """Whether a text was read. A capture that the quality gate finds poor is inconclusive."""
    has_text = F.length(F.trim(F.coalesce(text, F.lit("")))) > 0
    poor = F.coalesce(F.col(quality) == "inconclusive", F.lit(False)) if quality else F.lit(False)
    status = F.when(~has_text, "unavailable").when(poor, "inconclusive").otherwise("completed")
    return cases.select(*_row("ocr_fields", status, F.when(~has_text | poor, "low_quality")))


def tampering_results(indicators: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """One row for each case of long indicators (case_id, indicator, value): the gravest of them.

    ``limits`` has, for each indicator that counts, the values from which it is inconclusive and
    suspicious. A case none of whose known indicators has a value is unavailable."""
    grade, name, value = F.lit(None).cast("int"), F.col("indicator"), F.col("value")
    for known, (low, high) in limits.items():
        grade = F.when((name == known) & value.isNotNull(), F.when(value >= high, 2).when(value >= low, 1).otherwise(0)).otherwise(grade)
    worst = indicators.withColumn("grade", grade).groupBy("case_id").agg(F.max(F.when(F.col("grade").isNotNull(), F.struct("grade", "indicator", "value"))).alias("w"))
    status = F.when(F.col("w").isNull(), "unavailable").when(F.col("w.grade") == 2, "suspicious").when(F.col("w.grade") == 1, "inconclusive").otherwise("completed")
    found = F.when(F.col("w.indicator") == "repeated_region", "repeated_region").when(F.col("w.grade") == 2, "score_high").otherwise("score_band")
    reason = F.when(F.col("w").isNull(), "no_model").when(F.col("w.grade") > 0, found)
    return worst.select(*_row("tampering", status, reason, F.col("w.value").cast("double")))


def face_results(pairs: DataFrame, low: float, high: float) -> DataFrame:
    """Portrait against capture (case_id, portrait, capture): an observation, not an identity."""
    compared = face_comparison(pairs, low, high)
    reason = F.when(F.col("portrait").isNull() | F.col("capture").isNull(), "no_face").when(F.col("similarity").isNull(), "no_model").when(F.col("similarity") < low, "face_differs").when(F.col("similarity") < high, "score_band")
    return compared.select(*_row("face_verification", F.col("status"), reason, F.col("similarity")))


def provenance_results(facts: DataFrame) -> DataFrame:
    """Files' facts with case_id. What a file does not carry is unavailable, which proves nothing."""
    status = F.col("provenance_status")
    return facts.select(*_row("metadata_provenance", status, F.when(status == "unavailable", "no_metadata")))


def official_status(cases: DataFrame) -> DataFrame:
    """Issuers' records need an authorised connection, which there is none of: always unavailable."""
    return cases.select(*_row("official_status", F.lit("unavailable"), F.lit("no_connection")))
