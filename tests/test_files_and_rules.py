"""The structure of files, repeated regions, traces of double compression, and rule packs."""

import itertools
import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evidentia.operators import forensics, rule_packs
from evidentia.sources import containers, evidence


def chunk(name, data, wrong=0):
    return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data) ^ wrong)


HEAD = chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 3, 8, 2, 0, 0, 0))
PNG = containers.PNG + HEAD + chunk(b"tEXt", b"Title\x00x") + chunk(b"eXIf", b"MM") + chunk(b"caBX", b"j") + chunk(b"IEND", b"")


def segment(marker, data):
    return bytes([0xFF, marker]) + struct.pack(">H", len(data) + 2) + data


SCAN = segment(0xDA, b"\x01") + b"\x12\xff\x00\x34\xff\xd0\x56"
JPEG = b"\xff\xd8" + segment(0xE1, containers.EXIF + b"II") + segment(0xE1, containers.XMP + b"<x/>") + segment(0xE1, b"other") + segment(0xEB, b"JP\x00\x01c2pa") + segment(0xFE, b"a comment") + SCAN + b"\xff\xd9"
WEBP = b"RIFF\x00\x00\x00\x00WEBP" + b"VP8 " + struct.pack("<I", 3) + b"abc\x00" + b"EXIF" + struct.pack("<I", 2) + b"MM" + b"XMP " + struct.pack("<I", 0)


def said(data):
    return [(name, length, status, carries) for name, _, length, status, carries in containers.parts(data)]


def test_parts_of_whole_files():
    assert said(PNG) == [("IHDR", 13, "ok", None), ("tEXt", 7, "ok", "text"), ("eXIf", 2, "ok", "exif"), ("caBX", 1, "ok", "credentials"), ("IEND", 0, "ok", None)]
    assert [(n, c) for n, _, _, c in said(JPEG)] == [("APP1", "exif"), ("APP1", "xmp"), ("APP1", None), ("APP11", "credentials"), ("COM", "text"), ("SOS", None), ("scan", None), ("EOI", None)]
    assert said(WEBP) == [("VP8 ", 3, "ok", None), ("EXIF", 2, "ok", "exif"), ("XMP ", 0, "ok", "xmp")]
    assert said(PNG + b"more")[-1] == ("trailing", 4, "ok", None) and said(JPEG + b"more")[-1] == ("trailing", 4, "ok", None)
    for none in (None, b"", b"<html>tEXt c2pa Exif\x00\x00", b"RIFF\x00\x00\x00\x00WAVE", b"\xff\xd8not"):
        assert containers.parts(none) == []


def test_lengths_that_lie():
    png = containers.PNG + HEAD
    assert said(png + b"\xff\xff\xff\xfftEXtabc")[-1] == ("tEXt", 3, "truncated", "text")
    assert said(png + chunk(b"tEXt", b"abc", wrong=1) + chunk(b"IEND", b""))[1] == ("tEXt", 3, "bad_crc", "text")
    assert said(b"\xff\xd8" + segment(0xE1, b"abc")[:-2]) == [("APP1", 1, "truncated", None)]
    assert said(b"\xff\xd8\xff\xe1\x00\x01")[-1][2] == "truncated" and said(b"\xff\xd8" + SCAN)[-1] == ("scan", 7, "truncated", None)
    assert said(WEBP[:-4] + b"\xff\xff\xff\x7f")[-1] == ("XMP ", 0, "truncated", "xmp")


@settings(max_examples=200, deadline=None)
@given(st.sampled_from([PNG, JPEG, WEBP]), st.data())
def test_no_file_makes_the_walk_fail(data, draw):
    cut = bytearray(data[: draw.draw(st.integers(0, len(data)))])
    for _ in range(draw.draw(st.integers(0, 4))):
        if cut:
            cut[draw.draw(st.integers(0, len(cut) - 1))] = draw.draw(st.integers(0, 255))
    parts = containers.parts(bytes(cut))
    assert all(0 <= offset <= len(cut) and length >= 0 for _, offset, length, _, _ in parts)
    assert all(a[1] < b[1] for a, b in itertools.pairwise(parts))


def test_facts_of_files(spark):
    rows = [("a", PNG), ("b", JPEG), ("c", WEBP), ("d", b"<html>tEXt c2pa"), ("e", PNG[:-3]), ("f", None), ("g", b"")]
    frame = spark.createDataFrame([(p, len(c or b""), c) for p, c in rows], "path string, length long, content binary")
    found = {r["path"]: r for r in evidence.file_facts(frame).collect()}
    flags = lambda p: tuple(found[p][f] for f in ("has_exif", "has_xmp", "has_credentials", "has_text_chunk", "damaged"))
    assert flags("a") == (True, False, True, True, False) and flags("b") == (True, True, True, True, False) and flags("c") == (True, True, False, False, False)
    assert flags("e")[-1] and {found[p]["provenance_status"] for p in "abce"} == {"completed"}
    assert {(found[p]["provenance_status"], flags(p)) for p in "dfg"} == {("unavailable", (False,) * 5)}


def pixels(spark, *images):
    rows = [(k, x, y, float(v)) for k, image in enumerate(images) for (y, x), v in np.ndenumerate(image)]
    return spark.createDataFrame(rows, "img_id int, x int, y int, v double").repartition(4)


def all_pairs(image, size=4, least=4):
    blocks = {}
    for y, x in np.ndindex(image.shape[0] - size + 1, image.shape[1] - size + 1):
        own = image[y : y + size, x : x + size]
        if own.min() < own.max():
            blocks.setdefault(own.tobytes(), []).append((y, x))
    votes = {}
    for places in blocks.values():
        for (a, b), (c, d) in itertools.combinations(places, 2):
            if max(abs(c - a), abs(d - b)) >= least:
                votes[d - b, c - a] = votes.get((d - b, c - a), 0) + 1
    return votes


def test_every_pair_of_equal_blocks_votes(spark):
    rng = np.random.default_rng(1)
    thrice = rng.integers(0, 250, (24, 30))
    thrice[10:16, 2:9] = thrice[17:23, 22:29] = thrice[1:7, 14:21]
    stripes = np.tile(np.arange(80) % 3, (70, 1))  # one content at very many places
    images = [thrice, stripes, np.full((12, 12), 7), rng.integers(0, 250, (3, 9))]
    found = {}
    for r in forensics.copy_move(pixels(spark, *images)).collect():
        found.setdefault(r["img_id"], {})[r["dx"], r["dy"]] = r["n_blocks"]
    assert found[0] == all_pairs(thrice) and set(found) == {0, 1}
    assert found[0][-12, 9] >= 12 and found[0][8, 16] >= 12 and found[0][20, 7] >= 12
    assert found[1] == all_pairs(stripes)


def test_noisy_copies_are_found(spark):
    rng = np.random.default_rng(2)
    image = rng.normal(120, 40, (40, 40))
    image[22:36, 20:38] = image[3:17, 1:19] + rng.normal(0, 1, (14, 18))
    frame = pixels(spark, image)
    assert forensics.copy_move(frame).filter("n_blocks > 3").isEmpty()
    best = forensics.copy_move(frame, near=12.0).orderBy("n_blocks", ascending=False).first()
    assert (best["dx"], best["dy"]) == (19, 19) and best["n_blocks"] > 50


def test_missing_pixels_leave_their_blocks_out(spark):
    image = np.arange(400).reshape(20, 20) % 97
    frame = pixels(spark, image).filter("not (x = 5 and y = 5)")
    whole = sum(r["n_blocks"] for r in forensics.copy_move(pixels(spark, image)).collect())
    assert 0 < sum(r["n_blocks"] for r in forensics.copy_move(frame).collect()) < whole
    assert forensics.copy_move(frame.limit(0)).count() == 0


def test_one_quantiser_against_two(spark):
    rng = np.random.default_rng(3)
    c = rng.laplace(0, 40, 4000)
    rows = [(0, 0, 1, int(q)) for q in np.round(c / 3)] + [(1, 0, 1, int(q)) for q in np.round(np.round(c / 9) * 9 / 3)] + [(2, 0, 1, int(q)) for q in np.round(np.round(c / 7) * 7 / 2)] + [(3, 0, 1, 0)] * 5
    found = {r["img_id"]: (r["period"], r["strength"]) for r in forensics.coefficient_periods(spark.createDataFrame(rows, "img_id int, u int, v int, q long")).collect()}
    assert found[0][1] < 0.2 and found[1] == (3, pytest.approx(1.0)) and found[2][1] > 0.4 and 3 not in found
    ratio = forensics.coefficient_periods(spark.createDataFrame(rows, "img_id int, u int, v int, q long").filter("img_id = 2"), (3.0, 3.5, 4.0)).first()
    assert ratio["period"] == 3.5 and ratio["strength"] > 0.75
    tiles = spark.createDataFrame([(1, rng.normal(size=64).tolist())], "img_id int, tile array<double>")
    assert forensics.quantised_coefficients(tiles, {(0, 1): 3.0, (2, 2): 0.5}).count() == 2


def test_rule_packs(spark):
    rows = spark.createDataFrame([(1, "abc", 5, "x"), (2, "", None, "x"), (3, None, 50, None), (4, "abcdefgh", 5, "abcdefgh")], "id int, name string, n int, other string")
    kinds = "rule string, field string, test string, operand string, severity string"
    tests = [("a", "n", "above", "10", "high"), ("b", "name", "missing", None, "low"), ("c", "name", "longer", "5", "low"), ("d", "n", "one_of", "5, 6", "mid"), ("e", "name", "same_as", "other", "high"), ("f", "name", "lacks", "^a", "mid"), ("g", "n", "below", "6", "low"), ("h", "name", "not_as", "other", "low"), ("i", "n", "differs", "5", "low"), ("j", "n", "none_of", "5", "low"), ("k", "name", "equals", "abc", "low"), ("l", "name", "matches", "b", "low")]
    pack = spark.createDataFrame(tests, kinds)
    found = {}
    for r in rule_packs.pack_findings(rows, pack, ["id"]).collect():
        found.setdefault(r["id"], set()).add(r["rule"])
    assert found == {1: set("dghkl"), 2: set("bfh"), 3: set("abij"), 4: set("cdegl")}
    worst = {r["id"]: (r["severity"], r["rules"]) for r in rule_packs.case_severity(rule_packs.pack_findings(rows, pack, ["id"]), ["id"], ("low", "mid", "high")).collect()}
    assert worst == {1: ("mid", ["d"]), 2: ("mid", ["f"]), 3: ("high", ["a"]), 4: ("high", ["e"])}
    assert rule_packs.pack_findings(rows, pack.limit(0), ["id"]).count() == 0
    for bad in (("x", "none", "equals", "1", "low"), ("x", "n", "unknown", "1", "low"), ("x", "n", "same_as", "none", "low"), ("a", "n", "above", "1", "low")):
        with pytest.raises(ValueError):
            rule_packs.compiled(spark.createDataFrame([*tests, bad], kinds), rows)


def test_random_offsets_agree_with_their_pairs():
    rng = random.Random(5)
    cells = np.array(sorted(rng.sample(range(90 * 60), 2500)))
    keys, votes = forensics._offsets(cells, 60)
    y, x = np.divmod(cells, 60)
    i, j = np.triu_indices(len(cells), 1)
    expected = np.unique((y[j] - y[i]) * 120 + x[j] - x[i], return_counts=True)
    order = np.argsort(keys)
    assert (keys[order] == expected[0]).all() and (votes[order] == expected[1]).all()


def test_periods_of_one_strength_give_the_shortest(spark):
    """Few coefficients are often as strong at one period as at another, but for the last bits."""
    rng = np.random.default_rng(5)
    groups = {k: [int(q) for q in rng.integers(1, 12, 1 + k % 5)] for k in range(300)}
    strength = lambda qs, p: round(abs(sum(np.exp(2j * np.pi * q / p) for q in qs)) / len(qs), 9)
    rows = [(k, 0, 1, q) for k, qs in groups.items() for q in qs]
    found = {r["img_id"]: r["period"] for r in forensics.coefficient_periods(spark.createDataFrame(rows, "img_id int, u int, v int, q long")).collect()}
    assert found == {k: max(range(2, 8), key=lambda p: (strength(qs, p), -p)) for k, qs in groups.items()}
