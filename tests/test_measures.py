"""Running values, calibration, quantiles, near copies, linked splits and the log of requests on small rows."""

import datetime as dt
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evidentia.operators import calibration, evaluation, governance, intervals, ordered, perceptual
from evidentia.operators.components import components
from evidentia.streaming import responses


def plain_isotonic(points):
    """(score, truth) -> the rate of every distinct score, by the min-max formula."""
    scores = sorted({s for s, _ in points})
    n = np.array([sum(1 for s, _ in points if s == x) for x in scores])
    p = np.array([sum(t for s, t in points if s == x) for x in scores])
    mean = lambda i, j: p[i : j + 1].sum() / n[i : j + 1].sum()
    return {x: max(min(mean(i, j) for j in range(k, len(scores))) for i in range(k + 1)) for k, x in enumerate(scores)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 1)), min_size=1, max_size=40), st.lists(st.integers(0, 12), max_size=4))
def test_pooling_in_parts_equals_the_formula(points, cuts):
    counted = [(("g",), s, s, sum(1 for x, _ in points if x == s), sum(t for x, t in points if x == s)) for s in sorted({s for s, _ in points})]
    parts, at = [], sorted({0, *[min(c, len(counted)) for c in cuts], len(counted)})
    for a, b in zip(at, at[1:]):
        parts += list(calibration.pooled(counted[a:b]))
    found = {s: block[4] / block[3] for block in calibration.pooled(parts) for s in plain_isotonic(points) if block[1] <= s <= block[2]}
    assert found == pytest.approx(plain_isotonic(points))


def test_blocks_and_lookup(spark):
    rng = random.Random(4)
    nan = float("nan")
    rows = [(k, "big", round(rng.random(), 2), None) for k in range(300)]
    rows = [(k, g, s, int(rng.random() < s)) for k, g, s, _ in rows]
    rows += [(400 + k, None, float(k), k % 2) for k in range(6)] + [(500, "big", nan, 1), (501, "big", None, 1), (502, "big", 0.5, None), (503, "unlabelled", 0.5, None), (504, "big", -7.0, None), (505, "big", 9.0, None)]
    frame = spark.createDataFrame(rows, "id int, g string, s double, t int").repartition(7)
    blocks = calibration.isotonic_blocks(frame, "s", "t", ["g"])
    found = {r["id"]: r["calibrated"] for r in calibration.calibrated(frame, blocks, "s", ["g"]).collect()}
    assert len(found) == len(rows)
    big = plain_isotonic([(s, t) for _, g, s, t in rows if g == "big" and t is not None and s is not None and s == s])
    for k, g, s, t in rows[:300]:
        assert found[k] == pytest.approx(big[s])
    assert [found[k] for k in (400, 402, 404)] == [0.0, 0.5, 0.5] and found[405] == 1.0
    assert found[500] is found[501] is found[503] is None
    assert found[504] == pytest.approx(min(big.values())) and found[505] == pytest.approx(max(big.values()))
    edges = {r["g"]: (r["clear_to"], r["suspicious_from"]) for r in calibration.band(blocks, ["g"], 0.2, 0.8).collect()}
    assert edges["big"] == (max(s for s, r in big.items() if r <= 0.2), min(s for s, r in big.items() if r >= 0.8))
    whole = calibration.isotonic_blocks(frame, "s", "t", [])
    assert sum(r["n"] for r in whole.collect()) == 306
    assert calibration.calibrated(frame, whole, "s", []).filter("calibrated is not null").count() == 310
    assert calibration.isotonic_blocks(frame.limit(0), "s", "t", ["g"]).count() == 0
    kinds = spark.range(1).select(*[calibration.decided(F.lit(x).cast("double"), 0.2, 0.8).alias(n) for n, x in (("a", None), ("b", 0.8), ("c", 0.5), ("d", 0.2))]).first()
    assert tuple(kinds) == ("unavailable", "suspicious", "inconclusive", "completed")


def test_running_values_of_a_hot_group(spark):
    rng = random.Random(1)
    rows = [("hot", k, rng.choice([None, k]), 1) for k in range(500)] + [(None, k, k if k == 2 else None, 2) for k in range(5)] + [("b", 1, None, 3)]
    frame = spark.createDataFrame(rows, "g string, at int, v int, n int").repartition(5)
    cells = ordered.ranged(frame, ["g"], ["at"])
    assert cells.filter("g = 'hot'").select("cell").distinct().count() > 1
    last = {(r["g"], r["at"]): r["last"] for r in ordered.last_known(cells, ["g"], ["at"], "v", "last").collect()}
    total = {(r["g"], r["at"]): r["before"] for r in ordered.running_total(cells, ["g"], ["at"], "n", "before").collect()}
    seen, sums = {}, {}
    for g, at, v, n in rows:
        seen[g] = v if v is not None else seen.get(g)
        assert last[g, at] == seen[g] and total[g, at] == sums.get(g, 0)
        sums[g] = sums.get(g, 0) + n


def test_quantiles_equal_numpy(spark):
    rng = random.Random(2)
    rows = [("a", rng.randint(0, 30)) for _ in range(200)] + [("b", 5)] * 40 + [(None, 1), (None, 4), ("c", None)]
    shares = {"p0": 0.0, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    found = {r["g"]: tuple(r)[1:] for r in evaluation.exact_quantiles(spark.createDataFrame(rows, "g string, v long").repartition(6), "v", ["g"], shares).collect()}
    for g in ("a", "b", None):
        own = [v for x, v in rows if x == g]
        assert found[g][0] == len(own) and found[g][1:] == pytest.approx([np.quantile(own, q) for q in shares.values()])
    assert found["c"] == (0, None, None, None, None)
    both = evaluation.exact_quantiles(spark.createDataFrame(rows, "g string, v long"), "v", [], {"m": 0.5}).first()
    assert tuple(both) == (242, np.quantile([v for _, v in rows if v is not None], 0.5))


@pytest.mark.parametrize("block,distance", [(5_000, 3), (7, 3), (7, 0), (50, 5)])
def test_hamming_pairs_equal_all_pairs(spark, block, distance):
    rng = random.Random(distance)
    codes = {rng.getrandbits(64) for _ in range(60)}
    base = rng.getrandbits(64)
    codes |= {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, distance + 2))) for _ in range(60)}
    signed = [c - (c >> 63 << 64) for c in codes]
    found = [tuple(r) for r in perceptual.hamming_pairs(spark.createDataFrame([(c,) for c in signed], "code long"), distance, block).collect()]
    expected = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) % 2**64).bit_count() <= distance}
    assert len(found) == len(expected) and set(found) == expected


def test_near_copies_of_tiles(spark):
    tile = np.random.default_rng(3).normal(size=64)
    odd = [(4, None), (5, [1.0]), (6, [None] * 64), (7, [float("nan")] * 64)]
    rows = [(1, tile.tolist()), (2, (tile * 1.5).tolist()), (3, (-tile).tolist()), (8, (tile + 1e-4).tolist()), *odd]
    found = {r["k"]: (r["class_id"], r["n_copies"]) for r in perceptual.near_copies(spark.createDataFrame(rows, "k int, t array<double>"), "k", "t").collect()}
    assert set(found) == {1, 2, 3, 8} and found[1][0] == found[2][0] == found[8][0] == 1 and found[3] == (3, 1)


def test_components_and_linked_splits(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (None, 7), (200, 200)], "a int, b int")
    roots = {r["key"]: r["root"] for r in components(links).collect()}
    assert {roots[k] for k in range(41)} == {0} and roots[101] == 100
    rng = random.Random(6)
    rows = [(k, rng.choice([None, f"i{k // 2}"]), rng.choice([None, f"g{rng.randint(0, 120)}"])) for k in range(300)]
    found = governance.linked_split(spark.createDataFrame(rows, "id int, i string, g string").repartition(4), "id", [F.col("i"), F.col("g")]).collect()
    assert len(found) == 300
    for column in ("i", "g", "component"):
        places = {}
        for r in found:
            if r[column] is not None:
                places.setdefault(r[column], set()).add((r["split"], r["component"]))
        assert all(len(p) == 1 for p in places.values())
    sizes = {}
    for r in found:
        sizes[r["component"]] = sizes.get(r["component"], 0) + 1
    train = sum(r["split"] == "train" for r in found)
    assert 240 <= train < 240 + max(sizes.values()) and {r["split"] for r in found} <= {"train", "validation", "test"}
    alone = governance.linked_split(spark.createDataFrame([(1, None), (2, None)], "id int, i string"), "id", [F.col("i")]).collect()
    assert len({r["component"] for r in alone}) == 2


def test_urls_keep_the_case_of_their_path(spark):
    urls = ["HTTP://Example.ORG/A/b/?utm_source=X&q=Q#Top", "http://example.org/a", "//Host/P", "/Only/Path", None]
    found = [r["u"] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(governance.canonical_url(F.col("u")).alias("u")).collect()]
    assert found == ["http://example.org/A/b/?&q=Q", "http://example.org/a", "//host/P", "/Only/Path", None]


AT = dt.datetime(2024, 1, 1)


def log(spark, rows):
    return spark.createDataFrame([(c, e, AT + dt.timedelta(hours=h), k) for c, e, h, k in rows], "case_id long, event_id long, ts timestamp, event string")


def test_late_responses_belong_to_their_file(spark):
    rows = [(1, 1, 0, "file"), (1, 2, 1, "run_started"), (1, 3, 2, "file"), (1, 4, 3, "run"), (1, 5, 4, "run_started"), (1, 6, 5, "run"), (1, 7, 6, "run"), (2, 8, 0, "run"), (2, 9, 1, "run_started"), (2, 10, 2, "file"), (2, 11, 3, "run"), (2, 12, 3, "health")]
    random.Random(3).shuffle(rows)
    found = {r["event_id"]: (r["request_id"], r["asked_file"], r["file_id"], r["late"]) for r in responses.attributed(log(spark, rows)).collect()}
    assert found == {4: (2, 1, 3, True), 6: (5, 3, 3, False), 7: (5, 3, 3, False), 8: (None, None, None, False), 11: (9, None, 10, True)}


def test_requests_as_a_stream(spark, tmp_path):
    """Batches with repeated and unordered events, a response in a later batch, and one behind the watermark."""
    first = [(1, 1, 0, "run_started"), (1, 2, 1.5, "run"), (1, 1, 0, "run_started"), (1, 3, 10, "run_started"), (2, 4, 11, "run_started"), (2, 5, 11.5, "file")]
    second = [(1, 6, 12, "run"), (1, 7, 11.8, "run"), (3, 8, 30, "run_started"), (3, 9, 29.5, "run")]
    third = [(3, 11, 31, "run"), (4, 12, 40, "run_started"), (None, 13, 31, "run_started")]
    fourth = [(2, 10, 12, "run"), (5, 14, 200, "run_started")]
    for k, rows in enumerate((first, second, third, fourth)):
        log(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/{k}")
    schema = "case_id long, event_id long, ts timestamp, event string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path))
    found = {r["request_id"]: (r["case_id"], r["waited"], r["status"]) for r in responses.drained(responses.verdicts(stream, 5 * 3600, "1 hour"), "requests").collect()}
    hour = 3_600_000_000
    assert found == {1: (1, 1.5 * hour, "answered"), 3: (1, 1.8 * hour, "answered"), 4: (2, None, "no_response"), 8: (3, hour, "answered"), 12: (4, None, "no_response")}


@pytest.mark.parametrize("width", [1, 10, 1000])
def test_overlaps_equal_all_pairs(spark, width):
    rng = random.Random(width)
    spans = [(rng.choice("ab"), k, s := rng.randint(-500, 500), s + rng.choice([0, 1, 3, 40, 900])) for k in range(120)] + [("a", 200, None, 5), ("a", 201, 5, None), (None, 202, 1, 9), ("b", 203, 9, 3), ("a", 204, -10_000, 10_000)]
    frame = spark.createDataFrame(spans, "g string, id int, start long, stop long")
    found = sorted(tuple(r) for r in intervals.overlapping(frame, frame, ["g"], width).collect())
    usable = [x for x in spans if x[0] is not None and x[2] is not None and x[3] is not None and x[2] < x[3]]
    assert found == sorted((g, i, j, max(a, c), min(b, d)) for g, i, a, b in usable for h, j, c, d in usable if g == h and a < d and c < b)
    assert intervals.overlapping(frame.limit(0), frame, ["g"], width).count() == 0


def test_coverage(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,), (None,)], "x int"), spark.createDataFrame([(2,), (3,), (None,)], "x int")
    assert {tuple(r) for r in governance.coverage(a, b).collect()} == {(1, "left"), (2, "both"), (None, "both"), (3, "right")}
