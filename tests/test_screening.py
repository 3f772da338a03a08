"""Operators of the screening on small rows: each check both fires and stays silent."""

import datetime
import struct

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evidentia.functions import client_rules as client
from evidentia.functions.mrz import WEIGHTS, check_digit, digits_ok, mrz_checks, mrz_date, parse_mrz
from evidentia.operators import document_checks, evaluation, forensics, governance, models, status
from evidentia.plans import catalogue
from evidentia.plans.screening import detect_media, screen_documents
from evidentia.sources import evidence


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("size,text", [(0, "0 B"), (1023, "1023 B"), (1024, "1.0 KB"), (1280, "1.3 KB"), (1048575, "1024.0 KB"), (1048576, "1.0 MB"), (5 << 30, "5120.0 MB")])
def test_format_bytes(spark, size, text):
    assert one(spark, client.format_bytes(F.lit(size).cast("long"))) == text


def test_client_texts(spark):
    assert one(spark, client.backend_url(F.lit(""), "http://a/")) == "http://a"
    assert one(spark, client.backend_url(F.lit("http://b//"), "x")) == "http://b/"
    assert one(spark, client.client_trim(F.lit("  k 　"))) == "k"
    assert one(spark, client.humanize(F.lit("a_b_c"))) == "a b c"
    assert one(spark, client.file_type(F.lit(""))) == client.UNKNOWN_TYPE
    shown = lambda j: one(spark, client.pretty_value(F.parse_json(F.lit(j))))
    assert [shown(j) for j in ("null", '"t"', "2", "true", '{"a":[1]}')] == ["null", "t", "2", "true", '{\n  "a": [\n    1\n  ]\n}']


@pytest.mark.parametrize("has_file,key,state,ready", [(True, "k", "idle", True), (False, "k", "idle", False), (True, "  ", "idle", False), (True, "k", "running", False), (True, None, "idle", False)])
def test_can_analyze(spark, has_file, key, state, ready):
    assert one(spark, client.can_analyze(F.lit(has_file), F.lit(key).cast("string"), F.lit(state))) is ready


@pytest.mark.parametrize("field,digit", [("L898902C3", "6"), ("740812", "2"), ("120415", "9"), ("ZE184226B<<<<<", "1"), ("", "0")])
def test_published_check_digits(spark, field, digit):
    assert one(spark, check_digit(F.lit(field))) == digit


@settings(max_examples=12, deadline=None)
@given(st.text("ABCXYZ0189<", min_size=1, max_size=12), st.integers(0, 11), st.sampled_from("ABCXYZ0189<"))
def test_substitutions_are_found_unless_congruent(spark, field, at, other):
    at %= len(field)
    changed = field[:at] + other + field[at + 1 :]
    value = lambda c: 0 if c == "<" else int(c) if c.isdigit() else ord(c) - 55
    same = WEIGHTS[at % 3] * (value(field[at]) - value(other)) % 10 == 0
    assert (one(spark, check_digit(F.lit(field))) == one(spark, check_digit(F.lit(changed)))) is same


def test_mrz_dates(spark):
    as_of = F.lit(datetime.date(2024, 1, 1))
    assert [str(one(spark, mrz_date(F.lit(v), as_of, 10))) for v in ("740812", "300101", "230230", "<<<<<<")] == ["1974-08-12", "2030-01-01", "None", "None"]


def test_no_zone_is_unavailable(spark):
    cases = spark.createDataFrame([(1, "A" * 44), (2, None)], "case_id int, text string")
    assert {r["mrz_format"] for r in parse_mrz(cases).collect()} == {None}


def test_field_consistency(spark):
    rows = [(1, "printed", "a", "x  y"), (1, "mrz", "a", "X Y"), (1, "printed", "b", "1"), (1, "mrz", "b", "2"), (1, "mrz", "c", "1"), (1, "mrz", "d", None)]
    found = document_checks.field_consistency(spark.createDataFrame(rows, "case_id int, source string, field string, value string"))
    assert {r["field"]: r["status"] for r in found.collect()} == {"a": "completed", "b": "suspicious", "c": "inconclusive", "d": "unavailable"}


@pytest.mark.parametrize("raw,found", [("2024-01-02", "completed"), ("2024-01-01", "completed"), ("2023-12-31", "suspicious"), ("2023-02-30", "suspicious"), ("", "unavailable"), (None, "unavailable")])
def test_expiry(spark, raw, found):
    assert one(spark, document_checks.date_status(F.lit(raw).cast("string"), "yyyy-MM-dd", F.lit(datetime.date(2024, 1, 1)))) == found


def results(spark, rows):
    return spark.createDataFrame(rows, "case_id int, workflow string, check string, status string, reason string, score double")


@settings(max_examples=8, deadline=None)
@given(st.lists(st.sampled_from(status.STATUSES), min_size=1, max_size=5), st.randoms())
def test_outcomes_ignore_order_and_only_worsen(spark, statuses, random):
    rank = {"unavailable": 0, "checks_completed": 1, "inconclusive": 2, "suspicious": 3}
    rows = lambda s: results(spark, [(1, "document", f"c{i}", x, None, None) for i, x in enumerate(s)])
    before = status.case_outcomes(rows(statuses)).first()
    mixed = list(statuses)
    random.shuffle(mixed)
    assert status.case_outcomes(rows(mixed)).first()["outcome"] == before["outcome"]
    worse = status.case_outcomes(rows([*statuses, "suspicious"])).first()
    assert rank[worse["outcome"]] >= rank[before["outcome"]] and worse["manual_review"]


def test_workflows_are_never_merged(spark):
    rows = [(1, "document", "tampering", "completed", None, None), (1, "media", "generated_image", "suspicious", None, 0.9)]
    found = {r["workflow"]: r["outcome"] for r in status.case_outcomes(results(spark, rows)).collect()}
    assert found == {"document": "checks_completed", "media": "suspicious"}


def test_missing_checks_are_unavailable(spark):
    rows = results(spark, [(1, "media", "generated_image", "completed", None, 0.1)])
    found = status.all_checks(rows, rows.select("case_id", "workflow"))
    assert sorted((r["check"], r["status"]) for r in found.collect())[1] == ("face_manipulation", "unavailable") and found.count() == 4


def test_screenings(spark):
    cases = spark.createDataFrame([(1, None, None)], "case_id int, text string, expiry string")
    assert {len(v) for v in status.CHECKS.values()} == {4, 5} and status.evidence_catalog(spark).count() == 16
    assert {r["status"] for r in screen_documents(cases, F.lit("2024-01-01").cast("date")).collect()} == {"unavailable"}
    media = spark.createDataFrame([(1, b"x", True), (2, b"x", False)], "case_id int, content binary, face_found boolean")
    bright = lambda: (lambda batch: np.full(len(batch), 0.9))
    found = {(r["case_id"], r["check"]): (r["status"], r["reason"]) for r in detect_media(media, bright, bright).collect()}
    assert found[1, "face_manipulation"] == ("suspicious", "score_high") and found[2, "face_manipulation"] == ("unavailable", "no_face")
    none = {(r["case_id"], r["check"]): (r["status"], r["reason"]) for r in detect_media(media).collect()}
    assert none[1, "generated_image"] == ("unavailable", "no_model")


def test_tile_indicators_against_numpy(spark):
    tile = np.random.default_rng(3).normal(size=64)
    df = spark.createDataFrame([(tile.tolist(),)], "t array<double>")
    k, n = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
    basis = np.sqrt(np.where(k == 0, 1, 2) / 8) * np.cos((2 * n + 1) * k * np.pi / 16)
    c = basis @ tile.reshape(8, 8) @ basis.T
    low = np.add.outer(np.arange(8), np.arange(8)) < 4
    share = (c[~low] ** 2).sum() / ((c**2).sum() - c[0, 0] ** 2)
    row = df.select(forensics.dct_coefficient(F.col("t"), 2, 3).alias("c"), forensics.high_frequency_share(F.col("t")).alias("s"), forensics.noise_residual(F.col("t")).alias("n"), forensics.texture_variance(F.col("t")).alias("v")).first()
    assert np.allclose([row["c"], row["s"], row["n"], row["v"]], [c[2, 3], share, np.diff(tile.reshape(8, 8), axis=1).var(), tile.var()])


def test_models(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0])]
    found = models.face_comparison(spark.createDataFrame(rows, "portrait array<double>, capture array<double>"), -0.5, 0.5)
    assert [r["status"] for r in found.collect()] == ["completed", "inconclusive", "unavailable", "suspicious"]


def test_governance(spark):
    a = spark.createDataFrame([(1, "g1"), (2, "g2")], "id int, g string")
    assert [r["id"] for r in governance.unseen(a, a.filter("id = 1"), "g").collect()] == [2]
    assert [r["id"] for r in governance.split_leakage(a.filter("id = 1").select("g"), a, "g").collect()] == [1]
    with pytest.raises(ValueError):
        governance.benchmark_contained(a.withColumn("doc_id", F.col("id")).withColumn("text", F.col("g")), spark.range(5).selectExpr("id as item_id", "'x' as text"), most_items=4)


def test_abstentions_are_no_errors(spark):
    rows = spark.createDataFrame([("suspicious", 1), ("suspicious", 0), ("completed", 0), ("completed", 1), ("unavailable", 1)], "o string, t int")
    row = evaluation.confusion(rows, F.col("o"), F.col("t"), []).first()
    assert (row["tp"], row["fp"], row["tn"], row["fn"], row["abstained"], row["miss_rate"]) == (1, 1, 1, 1, 1, 0.5)


def test_evidence_files(spark, tmp_path):
    import zlib

    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    pixels = b"".join(b"\x00" + bytes(range(12)) for _ in range(3))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 3, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(pixels)) + chunk(b"IEND", b"")
    (tmp_path / "a.png").write_bytes(png)
    (tmp_path / "b.jpg").write_bytes(b"not an image")
    (tmp_path / "c.webp").write_bytes(b"RIFF\x00\x00\x00\x00WEBPc2pa")
    (tmp_path / "d.txt").write_bytes(png)
    files = evidence.accepted(evidence.read_evidence(spark, str(tmp_path)))
    found = {r["media_type"]: r for r in evidence.file_facts(files).collect()}
    assert set(found) == {"image/png", "image/webp"} and (found["image/png"]["width"], found["image/png"]["height"]) == (4, 3)
    assert (found["image/png"]["provenance_status"], found["image/webp"]["provenance_status"]) == ("unavailable", "completed")
    grey = evidence.decoded_pixels(spark, str(tmp_path / "a.png"))
    assert grey.count() == 12 and grey.filter("x = 0 and y = 0").first()["v"] == 1
    read = {r["path"].rsplit("/", 1)[1]: (r["status"], r["reason"]) for r in evidence.decode_results(spark, str(tmp_path)).collect()}
    assert read == {"a.png": ("completed", None), "b.jpg": ("unavailable", "unreadable"), "c.webp": ("unavailable", "unreadable")}
    assert evidence.with_text(files, None).filter("text is not null").isEmpty()


SPECIMENS = [
    (1, "P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<\nL898902C36UTO7408122F1204159ZE184226B<<<<<10", "TD3"),
    (2, "V<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<\nL8988901C4XXX4009078F96121096ZE184226B<<<<<<", "MRV-A"),
    (3, "I<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<\nD231458907UTO7408122F1204159<<<<<<<6", "TD2"),
    (4, "V<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<\nL8988901C4XXX4009078F9612109<<<<<<<<", "MRV-B"),
    (5, "I<UTOD231458907<<<<<<<<<<<<<<<\n7408122F1204159UTO<<<<<<<<<<<6\nERIKSSON<<ANNA<MARIA<<<<<<<<<<", "TD1"),
]


def test_published_specimens(spark):
    """Every format's specimen holds; a letter changed in its number does not."""
    cases = spark.createDataFrame([(i, z) for i, z, _ in SPECIMENS] + [(i + 10, z.replace("L898", "L897").replace("D2314", "D2315")) for i, z, _ in SPECIMENS], "case_id int, text string")
    found = {r["case_id"]: r for r in mrz_checks(parse_mrz(cases)).withColumn("ok", digits_ok()).collect()}
    for i, _, kind in SPECIMENS:
        assert (found[i]["mrz_format"], found[i]["ok"], found[i]["mrz_surname"], found[i]["mrz_given"]) == (kind, True, "ERIKSSON", "ANNA MARIA")
        assert found[i + 10]["ok"] is False


def test_zone_dates_are_checked(spark):
    passport, visa = SPECIMENS[0][1], SPECIMENS[1][1]
    rows = [
        (1, passport, None), (2, visa, None), (3, "Date of birth: 12.08.1974\n" + passport, None), (4, "Date of birth: 13 Aug 1974\n" + passport, None),
        (5, "Expiry date: 2012-02-31\n" + passport, None), (6, passport, "2011-01-01"), (7, "no zone", "2011-01-01"), (8, "no zone", "2013-01-01"),
    ]
    cases = spark.createDataFrame(rows, "case_id int, text string, expiry string")
    at = lambda day: {r["case_id"]: (r["status"], r["reason"]) for r in screen_documents(cases, F.lit(datetime.date.fromisoformat(day))).filter("check = 'mrz_consistency'").collect()}
    valid, late = at("2012-04-15"), at("2026-01-01")
    assert len(valid) == 8 and valid[1] == ("completed", None) and valid[3] == ("completed", None)
    assert valid[2] == ("suspicious", "expired")  # 1996
    assert valid[4] == valid[5] == ("suspicious", "field_mismatch")
    assert valid[6] == valid[7] == ("suspicious", "expired") and valid[8] == ("unavailable", "no_zone")
    assert late[1] == late[3] == late[8] == ("suspicious", "expired")


def test_all_checks_lose_nothing(spark):
    cases = spark.createDataFrame([(1, "document"), (2, "document")], "case_id int, workflow string")
    rows = document_checks.official_status(cases).unionByName(results(spark, [(1, "document", "tampering", "completed", None, 0.1), (1, "document", "tampering", "suspicious", "score_high", 0.9), (2, "document", "tampering", None, None, None)]))
    found = status.all_checks(rows, cases).collect()
    assert len(found) == 13 and sum(r["check"] == "official_status" for r in found) == 2
    assert sorted(r["status"] for r in found if r["check"] == "tampering") == ["completed", "suspicious", "unavailable"]


def test_wired_screening(spark):
    cases = spark.createDataFrame([(1, "text", None, "inconclusive"), (2, "text", None, "completed"), (3, "text", None, None)], "case_id int, text string, expiry string, quality string")
    indicators = spark.createDataFrame([(1, "repeated_region", 20.0), (1, "noise", 0.5), (2, "noise", 0.5), (2, "unknown", 9.0), (3, "noise", None)], "case_id int, indicator string, value double")
    faces = spark.createDataFrame([(1, [1.0, 0.0], [1.0, 0.0]), (2, [1.0, 0.0], [0.0, 1.0]), (3, None, [0.0, 1.0])], "case_id int, portrait array<double>, capture array<double>")
    facts = spark.createDataFrame([(1, "completed"), (2, "unavailable")], "case_id int, provenance_status string")
    found = screen_documents(cases, F.lit(datetime.date(2026, 1, 1)), quality="quality", indicators=indicators, limits={"repeated_region": (5, 16), "noise": (0.4, 0.8)}, faces=faces, facts=facts, official=True)
    by = {(r["case_id"], r["check"]): (r["status"], r["reason"]) for r in found.collect()}
    assert [by[i, "ocr_fields"][0] for i in (1, 2, 3)] == ["inconclusive", "completed", "completed"]
    assert [by[i, "tampering"] for i in (1, 2, 3)] == [("suspicious", "repeated_region"), ("inconclusive", "score_band"), ("unavailable", "no_model")]
    assert [by[i, "face_verification"] for i in (1, 2, 3)] == [("completed", None), ("suspicious", "face_differs"), ("unavailable", "no_face")]
    assert [by[i, "metadata_provenance"] for i in (1, 2, 3)] == [("completed", None), ("unavailable", "no_metadata"), ("unavailable", "no_model")]
    assert found.count() == 18


def test_every_body_has_its_entries(spark):
    bodies = ['{"a_b":{"c":[1]},"d":null,"e":"x"}', "<html>", '[true,"y"]', "null", '"text"', "7", None]
    rows = client.response_entries(spark.createDataFrame(list(enumerate(bodies)), "i int, body string")).collect()
    by = {}
    for r in rows:
        by.setdefault(r["i"], []).append((r["key"], r["label"], r["value"]))
    assert sorted(by[0]) == [("a_b", "a b", '{\n  "c": [\n    1\n  ]\n}'), ("d", "d", "null"), ("e", "e", "x")]
    assert by[1] == [("error", "error", client.NOT_JSON)] and sorted(by[2]) == [("0", "0", "true"), ("1", "1", "y")]
    assert set(by) <= {0, 1, 2, 6}


def test_similarities_are_judged_as_they_are_shown(spark, tmp_path):
    """On the thresholds, to six digits: the query and its SQL."""
    shown = [1.0, 0.2999998, 0.3000002, 0.2999994, -0.0000002, 0.0000002, -0.0000008, 0.0]
    rows = [(k, [x, (1 - x * x) ** 0.5], 1) for k, x in enumerate(shown)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = sorted(tuple(r) for r in catalogue.QUERIES["face_comparison"](spark, str(tmp_path)).collect())
    sql = catalogue.ORACLE_SQL["face_comparison"].replace("embeddings", f"'{tmp_path}/embeddings.parquet/*.parquet'")
    assert list(map(repr, found)) == list(map(repr, sorted(duckdb.sql(sql).fetchall())))
    assert [r[2] for r in found] == ["completed"] * 3 + ["inconclusive"] * 3 + ["suspicious", "inconclusive"]
