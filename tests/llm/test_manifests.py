"""Centroid clustering, SimHash near-duplicates and the Merkle manifest against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from evidentia.llm import queries
from evidentia.llm.centroid_clusters import Clustering, Movement, centroid_clusters, cluster_report, distances, moved_on, scanned
from evidentia.llm.merkle_manifest import Manifest, folded, merkle_manifest, reduced, siblings
from evidentia.llm.simhash_join import BITS, SimHash, fingerprint, near, near_links, simhash_groups
from tests.llm.conftest import ODD

DATA = "/root/testdata/sf0.001"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


# --- centroid clustering


def brute_clusters(rows, k=16, rounds=3, size=64):
    import math

    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (sha(f"1:{'null' if r[0] is None else r[0]}"), r[1]))
    centroids = [v for _, v in order[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    nearest = lambda v: min(range(len(centroids)), key=lambda c: (far(v, centroids[c]), c))
    for _ in range(rounds):
        at = [nearest(v) for _, v in kept]
        for c in range(len(centroids)):
            own = [v for (_, v), a in zip(kept, at) if a == c]
            if own:
                centroids[c] = [sum(x) // len(own) for x in zip(*own)]
    found = [(i, c := nearest(v), far(v, centroids[c])) for i, v in kept]
    inertia = {c: sum(d for _, x, d in found if x == c) for c in range(len(centroids))}
    return [(i, c, d, inertia[c], sum(inertia.values()), sha(",".join(map(str, centroids[c])))) for i, c, d in found]


def test_clusters_of_a_table_equal_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert sorted(tuple(r) for r in queries.op11_centroid_clusters(spark, DATA).collect()) == sorted(brute_clusters(rows))


def vectors(spark, rows, size, clash=False):
    extra = ", cluster string, v int, distance string" if clash else ""
    data = [(*r, *(("x", 1, "y") if clash else ())) for r in rows]
    return spark.createDataFrame(data, f"vec_id long, embedding array<double>{extra}").repartition(3)


def test_odd_vectors_ties_and_repeats(spark):
    rng = random.Random(1)
    nan, inf = float("nan"), float("inf")
    rows = [(i, [rng.randint(-3, 3) / 64 for _ in range(3)]) for i in range(120)]
    rows += [(200 + i, [0.5, -0.25, 1e3]) for i in range(60)] + [(1, rows[1][1])] * 3 + [(None, [0.0, 0.0, 0.1])]
    left_out = [(300, None), (301, []), (302, [1.0, 2.0]), (303, [1.0, None, 2.0]), (304, [nan, 1.0, 1.0]), (305, [inf, 0.0, 0.0]), (306, [1.0, 2.0, 3.0, 4.0])]
    for k, rounds in ((5, 3), (16, 3), (16, 0), (1, 2), (500, 2)):
        rule = Clustering(clusters=k, rounds=rounds, size=3)
        found = cluster_report(vectors(spark, rows + left_out, 3, clash=True), rule).collect()
        by = lambda r: (r[0] is None, r[0] or 0, r[1:])
        assert sorted((tuple(r) for r in found), key=by) == sorted(brute_clusters(rows + left_out, k, rounds, 3), key=by)


def test_no_vectors_and_too_large_ones(spark):
    assert cluster_report(vectors(spark, [], 3)).count() == 0
    assert cluster_report(vectors(spark, [(1, None), (2, [1.0])], 3)).count() == 0
    with pytest.raises(ValueError, match="past"):
        centroid_clusters(vectors(spark, [(1, [1e30] * 3)], 3), Clustering(size=3))


def test_bounds_hold_and_spare_scans():
    rng = np.random.default_rng(5)
    centres = rng.integers(-500, 500, (8, 6))
    v = (centres[rng.integers(0, 8, 3000)] + rng.integers(-30, 30, (3000, 6))).astype(np.int64)
    c = v[:8].copy()
    cluster, upper, lower = scanned(v, c)
    scans = 0
    for _ in range(8):
        sums = np.zeros_like(c)
        np.add.at(sums, cluster, v)
        n = np.bincount(cluster, minlength=8)[:, None]
        new = np.where(n > 0, sums // np.maximum(n, 1), c)
        cluster, upper, lower, some = moved_on(v, cluster, upper, lower, Movement.between(c, new))
        c, scans = new, scans + some
        exact = distances(v, c)
        assert (cluster == exact.argmin(1)).all()
        own = np.sqrt(exact[np.arange(len(v)), cluster])
        exact[np.arange(len(v)), cluster] = np.iinfo(np.int64).max
        assert (upper >= own).all() and (lower <= np.sqrt(exact.min(1))).all()
    assert scans < 8 * len(v) / 2


# --- SimHash


def brute_fingerprint(text, n=4):
    import re

    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, d=4):
    root = list(range(len(fps)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= d:
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for k in range(len(fps)):
        if ids[k] is not None:
            least[top(k)] = min(least.get(top(k), ids[k]), ids[k])
    return [least.get(top(k)) for k in range(len(fps))]


def test_simhash_of_a_table_equals_brute_force(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    fps = [brute_fingerprint(r["text"]) for r in rows]
    parts = brute_components([r["doc_id"] for r in rows], fps)
    expected = {(r["doc_id"], f"{f:016x}", c) for r, f, c in zip(rows, fps, parts)}
    found = [tuple(r) for r in queries.op12_simhash(spark, DATA).collect()]
    assert set(found) == expected and len(found) == len(rows)


def test_odd_texts_and_ids(spark, documents):
    long = " ".join(f"w{i % 977}" for i in range(300_000))
    texts = [*ODD, "ÄB Cd", "Äb cD", "äb cd", "one two three", " ", long, long + " end"]
    ids = [*range(len(texts)), 3, None, None]
    texts = [*texts, "word", "quite alone here now and then", "one of a kind is this text"]
    docs = documents(list(zip(ids, texts)), fp="x", component_id="y", root="z")
    found = sorted(((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in simhash_groups(docs).collect()), key=str)
    fps = [brute_fingerprint(t) for t in texts]
    assert found == sorted(zip(ids, fps, brute_components(ids, fps)), key=str)
    assert simhash_groups(docs.limit(0)).count() == 0
    alike = simhash_groups(documents([(k, "the same words again") for k in range(50)])).collect()
    assert {(r["component_id"], r["n_alike"]) for r in alike} == {(0, 50)}


@pytest.mark.parametrize("rule", [SimHash(), SimHash(block=40, at_once=100), SimHash(distance=1, parts=3), SimHash(distance=0), SimHash(distance=7, parts=1)])
def test_links_equal_brute_force(spark, rule):
    """Crowds around a few centres, with distances on both sides of the bound, and one dense crowd."""
    rng = random.Random(7)
    fps = {rng.getrandbits(64) for _ in range(100)}
    for _ in range(6):
        base = rng.getrandbits(64)
        for _ in range(60):
            fps.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, rule.distance + 1))))
    fps |= {fps_ ^ 1 << b for fps_ in list(fps)[:2] for b in range(64)}
    fps = sorted(fps)
    signed = [f - (f >> 63 << 64) for f in fps]
    links = [(r["a"] % 2**64, r["b"] % 2**64) for r in near_links(spark.createDataFrame([(f,) for f in signed], "fp long"), rule).collect()]
    root = {f: f for f in fps}

    def top(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    expected = brute_components(list(range(len(fps))), fps, rule.distance)
    assert [fps.index(min(g for g in fps if top(g) == top(f))) for f in fps] == expected


def test_every_close_pair_has_a_chain():
    rng = random.Random(3)
    rule = SimHash()
    assert len(rule.keys()) == 20 and sum(rule.segments()) == 2**BITS - 1
    for _ in range(3000):
        a = rng.getrandbits(64)
        b = a ^ sum(1 << x for x in rng.sample(range(64), rng.randint(0, 4)))
        x, y = np.array([a], np.uint64), np.array([b], np.uint64)
        assert any(a & mask == b & mask and near(x, y, rule.prefixes(k))[0] for k, mask in rule.keys())
    assert fingerprint(None) == fingerprint(" \t") == 0


# --- Merkle manifest


def brute_manifest(rows, fanout=2):
    """rows: (doc_id, source, lang, n_chars, text)."""
    framed = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    hashed = lambda r: sha("".join(framed(x) for x in r))
    first = lambda v: (v is not None, v if v is not None else 0)

    def tree(nodes):
        """The top and, for every node, its ways up: (left, right) of each level."""
        ways, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
        while len(level) > 1:
            for way, k in zip(ways, at):
                run = k - k % fanout
                way.append((level[run:k], level[k + 1 : run + fanout]))
            level = [sha("".join(level[k : k + fanout])) for k in range(0, len(level), fanout)]
            at = [k // fanout for k in at]
        return level[0], ways

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees, leaves = {}, {}
    for g in order:
        groups[g].sort(key=lambda r: (first(r[0]), hashed(r)))
        leaves[g] = [hashed(r) for r in groups[g]]
        trees[g] = tree(leaves[g])
    root, above = tree([trees[g][0] for g in order])
    found = []
    for g, upper in zip(order, above):
        for r, node, way in zip(groups[g], leaves[g], trees[g][1]):
            forged = node
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None:
                forged = hashed((*r[:3], r[3] + 1, r[4]))
            for left, right in way + upper:
                forged = sha("".join([*left, forged, *right]))
            proof = sha("".join("".join(left + right) for left, right in way + upper))
            found.append((r[0], node, trees[g][0], root, proof, forged, forged == root))
    return sorted(found, key=str)


def manifest(frame, rule=Manifest()):
    found = merkle_manifest(frame, rule).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted((tuple(r) for r in found.collect()), key=str)


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def test_manifest_of_a_table_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select(*FIELDS).collect()]
    found = sorted((tuple(r) for r in queries.op13_merkle_manifest(spark, DATA).collect()), key=str)
    assert found == brute_manifest(rows)
    assert {r[-1] for r in found} == {True, False}


@pytest.mark.parametrize("rule", [Manifest(), Manifest(digits=2, cell=3, step=2, first=3), Manifest(fanout=3, digits=1, cell=5, first=16)])
def test_hot_ids_nulls_and_repeats(spark, rule):
    rng = random.Random(2)
    big = 2**63 - 1
    rows = [(k, "s", rng.choice(["en", "de"]), k, f"text {k}") for k in [*range(20), -5, big, -big - 1, 10**12]]
    rows += [(7, "s", "en", 3, f"other {k}") for k in range(40)]  # one id, many texts
    rows += [(9, "s", "en", 1, "copy")] * 30  # rows alike
    rows += [(None, None, None, None, None), (None, "", "", 0, ""), (3, "s", None, big, "x"), (3, "s", "é", None, "y" * 300_000), (4, None, "e", 5, None)]
    rows += [(k, "s", f"lang{k}", 1, "z") for k in range(12)]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string").repartition(5)
    assert manifest(frame, rule) == brute_manifest(rows, rule.fanout)


def test_small_manifests(spark):
    kind = "doc_id long, source string, lang string, n_chars long, text string"
    assert manifest(spark.createDataFrame([], kind)) == []
    for n in (1, 2, 3, 5):
        rows = [(k, "s", "en", k, "t") for k in range(n)]
        assert manifest(spark.createDataFrame(rows, kind)) == brute_manifest(rows)


def test_a_changed_leaf_changes_the_root():
    nodes = [sha(str(k)) for k in range(11)]
    levels = reduced(nodes, 4, 2)
    ways = siblings(levels, "", 2)
    assert all(folded(node, way) == levels[-1][0] for node, way in zip(nodes, ways))
    assert folded(sha("x"), ways[3]) != levels[-1][0]
