"""Documents as they are issued: long numbers, names and dates as they are printed, zones among other lines."""

import datetime

import pytest
from pyspark.sql import functions as F

from evidentia.functions import printed
from evidentia.functions.mrz import mrz_checks, parse_mrz
from evidentia.operators import document_checks, status
from evidentia.plans.screening import screen_documents

PASSPORT = "P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<\nL898902C36UTO7408122F1204159ZE184226B<<<<<10"


def digit(field):
    return str(sum("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ".find(c) * w for c, w in zip(field.replace("<", "0"), [7, 3, 1] * 40)) % 10)


def td3(surname, given, number="L898902C3", state="UTO"):
    number = number.ljust(9, "<")
    lower = f"{number}{digit(number)}{state.ljust(3, '<')}7408122F3404159{'<' * 14}0"
    return f"P<{'UTO'}{(surname + '<<' + given).ljust(39, '<')[:39]}\n{lower}{digit(lower[:10] + lower[13:20] + lower[21:43])}"


def td1(number, wrong=0):
    nine, rest = number[:9], number[9:]
    check = str((int(digit(number)) + wrong) % 10)
    upper = f"I<UTO{nine}" + (f"<{rest}{check}".ljust(16, "<") if rest else check.ljust(16, "<"))
    middle = "7408122F3404159UTO" + "<" * 11
    return f"{upper}\n{middle}{digit(upper[5:] + middle[:7] + middle[8:15] + middle[18:])}\nERIKSSON<<ANNA<MARIA<<<<<<<<<<"


def td2(number, wrong=0):
    nine, rest = number[:9], number[9:]
    check = str((int(digit(number)) + wrong) % 10)
    lower = f"{nine}<UTO7408122F3404159" + f"{rest}{check}".ljust(7, "<")
    return f"I<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<\n{lower}{digit(lower[:10] + lower[13:20] + lower[21:])}"


def results(spark, texts):
    cases = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "case_id int, text string")
    found = document_checks.mrz_results(cases, F.lit(datetime.date(2026, 1, 1)))
    return {r["case_id"]: (r["status"], r["reason"]) for r in found.collect()}


def test_numbers_longer_than_nine(spark):
    number = "D23145890734"
    texts = [td1(number), td2(number), td1(number, 1), td2(number, 1), f"Card No: {number}\n" + td1(number), f"Card No: D23145890735\n{td2(number)}", td1("D23145890")]
    assert results(spark, texts) == {0: ("completed", None), 1: ("completed", None), 2: ("suspicious", "check_digit"), 3: ("suspicious", "check_digit"), 4: ("completed", None), 5: ("suspicious", "field_mismatch"), 6: ("completed", None)}
    cases = spark.createDataFrame([(k, t) for k, t in enumerate(texts[:2])], "case_id int, text string")
    assert {r["mrz_number"] for r in mrz_checks(parse_mrz(cases)).collect()} == {number}


LONG = "ANNA<MARIA<MAGDALENA<JOSEPHINE<WILHELMINE<CHARLOTTE"
SPELLED = [
    ("Surname: Müller", td3("MUELLER", "ANNA"), None), ("Surname: Müller", td3("MULLER", "ANNA"), None), ("Surname: Müller", td3("MUELLER", "ANNA"), None), ("Surname: Müller", td3("MUXLLER", "ANNA"), "field_mismatch"),
    ("Surname: Smith-Jones", td3("SMITH<JONES", "ANNA"), None), ("Surname: O'Connor", td3("OCONNOR", "ANNA"), None), ("Surname: O’Connor", td3("OCONNOR", "ANNA"), None), ("Surname: Núñez, Łącki", td3("NUNXXEZ<LACKI", "ANNA"), None),
    ("Surname: Straße", td3("STRASSE", "ANNA"), None), ("Surname: Connor", td3("OCONNOR", "ANNA"), "field_mismatch"),
    ("Given names: Anna Maria Magdalena Josephine Wilhelmine Charlotte", td3("ERIKSSON", LONG), None), ("Given names: Anna Petra Magdalena Josephine", td3("ERIKSSON", LONG), "field_mismatch"), ("Given names: Anna Maria", td3("ERIKSSON", "ANNA"), "field_mismatch"),
    ("Nationality: Utopian", td3("ERIKSSON", "ANNA"), None), ("Nationality: UTO", td3("ERIKSSON", "ANNA"), None), ("Nationality: German", td3("ERIKSSON", "ANNA", state="D"), None), ("Nationality: German", td3("ERIKSSON", "ANNA"), "field_mismatch"), ("Nationality: Atlantean", td3("ERIKSSON", "ANNA"), "not_comparable"),
    ("Date of birth: 12 August 1974", td3("ERIKSSON", "ANNA"), None), ("Date of birth: August 12, 1974", td3("ERIKSSON", "ANNA"), None), ("Date of birth: 12 AUG/AOÛT 1974", td3("ERIKSSON", "ANNA"), None), ("Date of birth: 12. agosto 1974", td3("ERIKSSON", "ANNA"), None),
    ("Date of birth: 08/12/1974", td3("ERIKSSON", "ANNA"), None), ("Date of birth: 12/08/1974", td3("ERIKSSON", "ANNA"), None), ("Date of birth: 08.12.1974", td3("ERIKSSON", "ANNA"), "field_mismatch"), ("Date of birth: 13/08/1974", td3("ERIKSSON", "ANNA"), "field_mismatch"),
    ("Date of birth: twelfth of August", td3("ERIKSSON", "ANNA"), "not_comparable"), ("Date of birth: 31.02.1974", td3("ERIKSSON", "ANNA"), "field_mismatch"), ("Expiry date: 2020-01-01", td3("ERIKSSON", "ANNA"), "field_mismatch"), ("Passport No: L 898 902-C3", td3("ERIKSSON", "ANNA"), None),
]


def test_names_and_dates_as_printed(spark):
    found = results(spark, [f"{line}\n{zone}" for line, zone, _ in SPELLED])
    said = {None: "completed", "not_comparable": "inconclusive"}
    for k, (line, _, reason) in enumerate(SPELLED):
        assert (k, line, found[k]) == (k, line, (said.get(reason, "suspicious"), reason))


@pytest.mark.parametrize("text,expected", [
    (PASSPORT.replace("\n", "\r\n"), ("TD3", 1)), ("   " + PASSPORT.replace("\n", "  \n\t"), ("TD3", 1)), ("A" * 30 + "\n" + PASSPORT, ("TD3", 1)), ("I" * 36 + "\n" + PASSPORT, ("TD3", 1)),
    (PASSPORT + "\n" + PASSPORT, ("TD3", 1)), (PASSPORT + "\nnext page\n" + td2("D231458907"), ("TD3", 2)), ("P" * 44 + "\n\n" + "V" * 44, ("TD3", 1)), ("P" * 44 + "\nx\n" + "P" * 44, (None, 0)), ("", (None, 0)), (None, (None, 0)),
])
def test_zones_among_other_lines(spark, text, expected):
    row = parse_mrz(spark.createDataFrame([(1, text)], "case_id int, text string")).first()
    assert (row["mrz_format"], row["mrz_zones"]) == expected


def test_several_zones_and_pages(spark):
    texts = [PASSPORT.replace("1204159", "3404159"), td3("ERIKSSON", "ANNA") + "\n" + td2("D23145890734")]
    assert results(spark, texts)[1] == ("inconclusive", "several_zones")
    pages = spark.createDataFrame([(1, td3("ERIKSSON", "ANNA"), None), (1, "Surname: Other", None), (None, td3("ERIKSSON", "ANNA"), None)], "case_id int, text string, expiry string")
    found = screen_documents(pages, F.lit(datetime.date(2026, 1, 1)), official=True).collect()
    of = lambda case, check: sorted((r["status"], r["reason"]) for r in found if r["case_id"] == case and r["check"] == check)
    assert of(1, "mrz_consistency") == [("completed", None), ("unavailable", "no_zone")]
    assert of(None, "mrz_consistency") == [("completed", None)] and len(of(None, "tampering")) == 1
    assert of(1, "official_status")[0] == ("unavailable", "no_connection")
    assert set(status.REASONS) >= {r["reason"] for r in found if r["reason"]}


@pytest.mark.parametrize("text,dates", [
    ("1974-08-12", ["1974-08-12"]), ("1974/8/2", ["1974-08-02"]), ("12-08-1974", ["1974-08-12", "1974-12-08"]), ("5/5/2020", ["2020-05-05"]), ("12 08 1974", ["1974-08-12"]), ("29.02.2023", []), ("29.02.2024", ["2024-02-29"]),
    ("12 de agosto de 1974", ["1974-08-12"]), ("3. März 1999", ["1999-03-03"]), ("12 sept. 1974", ["1974-09-12"]), ("Dec 1, 2001", ["2001-12-01"]), ("12 Foo 1974", []), ("", []), (None, []),
])
def test_date_readings(spark, text, dates):
    row = spark.range(1).select(printed.date_readings(F.lit(text).cast("string")).alias("d")).first()
    assert [str(d) for d in row["d"] or []] == dates


def test_views_of_results(spark):
    rows = [(1, "document", "mrz_consistency", "suspicious", "expired", None), (1, "document", "ocr_fields", "completed", None, None), (1, "document", "official_status", "unavailable", "no_connection", None), (2, "media", "face_manipulation", "unavailable", "no_face", None), (2, "media", "generated_image", "inconclusive", "score_band", 0.5), (3, "media", "generated_image", "completed", None, 0.1)]
    frame = spark.createDataFrame(rows, "case_id int, workflow string, check string, status string, reason string, score double")
    kinds = {}
    for r in status.evidence_view(frame).collect():
        kinds.setdefault(r["case_id"], set()).add((r["kind"], r["status"]))
    assert kinds[1] == {("MRZ observations", "suspicious"), ("Date / validity checks", "suspicious"), ("Extracted fields", "completed"), ("Recommended review action", "suspicious")}
    assert kinds[2] == {("Detected-face status", "unavailable"), ("Unavailable checks", "unavailable"), ("AI-image observations", "inconclusive"), ("Supported confidence", "inconclusive"), ("Inconclusive reasons", "inconclusive"), ("Recommended review action", "inconclusive")}
    assert {k for kind in kinds.values() for k, _ in kind} <= {k for own in status.EVIDENCE.values() for k in own}
    told = {r["case_id"]: r["text"] for r in status.explanations(frame).collect()}
    assert told[1] == "MRZ & consistency: suspicious. The document has expired.\nofficial_status: unavailable. There is no authorised connection to the issuer's records."
    assert told[3] == "All checks were completed."
