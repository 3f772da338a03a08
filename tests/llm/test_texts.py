"""Rules, scores, shards, tokens and secrets on small tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.llm import bpe_codec, quality_rules, secret_scan, toxicity, word_bpe
from evidentia.llm.quality_classifier import quality_scores
from evidentia.llm.sharding import Ring, arc_of, shard_rows, walk
from evidentia.llm.token_counts import Counter, merger, token_counts
from tests.llm.conftest import ODD


def base_counts(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = collections.defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i : i + 5])].append(i)
    covered = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_base_counts(documents):
    rng = random.Random(3)
    texts = [*ODD, *[" ".join(rng.choices(["a", "b", "ç#", "d|"], k=rng.randint(0, 60))) + "\nx y\n \nx y" for _ in range(40)]]
    found = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in quality_rules.text_statistics(documents(texts, n_words="clash")).collect()}
    assert found == {i: base_counts(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("k,n,p", [(0, 10, 0.1), (3, 50, 0.05), (7, 2000, 0.01), (0, 100_000, 0.01)])
def test_binomial_tail(spark, k, n, p):
    from math import exp, lgamma, log

    terms = [lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log(1 - p) for i in range(k + 1)]
    top = max(terms)
    exact = top + log(sum(exp(t - top) for t in terms))
    assert spark.range(1).select(quality_rules.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p).alias("x")).first()["x"] == pytest.approx(exact)


def labelled_texts(n):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    good = [" ".join(word() for _ in range(30)) for _ in range(n)]
    bad = [" ".join(word() + "###" for _ in range(30)) for _ in range(n // 10)]
    return good + bad, [(i, int(i < n), 0) for i in range(n + n // 10)]


def test_certified_rules_reject_bad_and_keep_good(documents, labels):
    texts, marks = labelled_texts(600)
    control = quality_rules.RiskControl(limit=0.1, error=0.1, rules={"symbols_per_word": quality_rules.RULES["symbols_per_word"]})
    found = quality_rules.quality_rules(documents(texts + ODD), labels(marks), control).collect()
    kept = {r["doc_id"] for r in found if r["kept"]}
    assert kept == set(range(600)) and len(found) == len(texts) + len(ODD)
    assert all(r["base_failed"] for r in found if r["doc_id"] >= len(texts) and len((ODD[r["doc_id"] - len(texts)] or "").split()) < 10)


def test_few_labels_certify_nothing(documents, labels):
    texts, marks = labelled_texts(40)
    docs = documents(texts)
    assert quality_rules.quality_rules(docs, labels(marks)).filter("not kept").isEmpty()
    assert quality_rules.quality_rules(docs, labels(marks).limit(0)).filter("not kept").isEmpty()


def test_quality_classifier(documents, labels):
    texts, marks = labelled_texts(200)
    docs = documents(texts + ODD, quality_score="clash", prior="clash").withColumn("host", F.lit("clash"))
    held = {i for i, _, _ in marks if i % 3 == 0}
    found = {r["doc_id"]: r for r in quality_scores(docs, labels([m for m in marks if m[0] not in held])).collect()}
    right = [found[i]["quality_kept"] == bool(q) for i, q, _ in marks if i in held]
    assert np.mean(right) > 0.97 and len(found) == len(texts) + len(ODD) and found[0]["host"] == "clash"


def test_sparse_sites_are_shrunk(spark, labels):
    rows = [(i, "same words here", "en", "big") for i in range(40)] + [(100, "same words here", "en", "tiny"), (101, "same words here", "en", "new"), (102, "same words here", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    marks = labels([(i, int(i % 10 != 0), None) for i in range(40)] + [(100, 0, None)])
    prior = {r["doc_id"]: r["quality_prior"] for r in quality_scores(docs, marks).collect()}
    assert 0.05 < prior[100] < prior[101] < 0.95 and prior[101] == prior[102]
    none = quality_scores(docs, marks.limit(0)).collect()
    assert {r["quality_score"] for r in none} == {0.5}


def test_toxicity(documents, labels):
    rng = random.Random(6)
    plain = lambda: " ".join("".join(rng.choices("bcdfgaeiou", k=5)) for _ in range(40))
    toxic = lambda: plain() + " grumfle" + rng.choice("xyz") + " " + plain() + " zaggert"
    texts = [toxic() if i % 6 == 0 else plain() for i in range(600)]
    marks = [(i, 1, int(i % 6 == 0)) for i in range(600)]
    found = {r["doc_id"]: r for r in toxicity.toxicity_scores(documents(texts + ODD, score="clash"), labels(marks)).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in found.items())
    held = [i for i in range(600) if found[i]["held_out"]]
    assert np.mean([found[i]["predicted"] == marks[i][2] for i in held]) > 0.95
    assert {found[600 + i]["predicted"] for i in range(len(ODD))} == {0} and len(found) == 600 + len(ODD)
    # Labels of held-out rows make no difference.
    turned = [(i, q, 1 - t if i in held else t) for i, q, t in marks]
    again = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(documents(texts + ODD), labels(turned)).collect()}
    assert all(again[i] == found[i]["score"] for i in range(600 + len(ODD)))
    assert toxicity.toxicity_scores(documents(ODD), labels(marks).limit(0)).filter("predicted = 1").isEmpty()


def test_toxicity_of_a_sample_with_more_toxic_texts_than_the_labels(documents, labels):
    """60 of each class are learnt from, where one label in six is toxic; each kind of toxic text has words of its own."""
    rng = random.Random(8)
    plain = lambda: " ".join("".join(rng.choices("bcdfgaeiou", k=5)) for _ in range(40))
    kinds = ("grumfle", "zaggert", "prindle", "skwossh")
    texts = [plain() + "".join(" " + rng.choice(kinds[:2] if i % 4 else kinds[2:]) + rng.choice(["", "r", "s"]) for _ in range(3)) if i % 6 == 0 else plain() for i in range(900)]
    marks = [(i, 1, int(i % 6 == 0)) for i in range(900)]
    found = toxicity.toxicity_scores(documents(texts), labels(marks), toxicity.ToxicityModel(per_class=60)).collect()
    held = {r["doc_id"]: r for r in found if r["held_out"]}
    assert min(r["score"] for i, r in held.items() if i % 6 == 0) > max(r["score"] for i, r in held.items() if i % 6)
    assert np.mean([r["predicted"] == (i % 6 == 0) for i, r in held.items()]) > 0.95


def test_label_model_discounts_echoes():
    rng = np.random.default_rng(0)
    y = rng.random(3000) < 0.3
    fire = lambda a, b: np.where(y, rng.random(3000) < a, rng.random(3000) < b)
    echo = fire(0.5, 0.2)
    votes = np.column_stack([fire(0.8, 0.05), fire(0.7, 0.1), *[echo] * 6])
    noisy = np.where(rng.random(3000) < 0.15, 1 - y, y).astype(int)
    posterior = toxicity.label_model(votes, noisy, 0.3, 0.8)
    assert ((posterior > 0.5) == y).mean() > (noisy == y).mean() + 0.05


def test_shards_are_exact(documents):
    rows = [(i, ODD[i % len(ODD)]) for i in range(500)] + [(7, "again"), (7, "again"), (None, None)]
    found = shard_rows(documents(rows, shard="clash"), Ring(rows_per_bucket=1)).collect()
    by = collections.defaultdict(list)
    for r in found:
        by[r["shard"]].append(r["slot"])
    sizes = [len(by[s]) for s in range(8)]
    assert sum(sizes) == 503 and max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())
    text = {i: t or "" for i, t in rows if i != 7}
    assert all(r["size"] == len(text[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode()) for r in found if r["doc_id"] not in (7, None))
    assert shard_rows(documents(rows).limit(0)).count() == 0


def test_ring_moves_little_and_overflows_clockwise(spark):
    keys = np.random.default_rng(1).integers(0, 2**31, 20_000)

    def placed(shards):
        nodes = Ring(shards=shards).nodes()
        arcs = np.searchsorted([p for p, _ in nodes], keys) % len(nodes)
        runs = collections.defaultdict(list)
        for r in walk(dict(collections.Counter(arcs.tolist())), nodes, shards):
            runs[r.arc].append(r)
        rank, out = collections.Counter(), []
        for a in arcs.tolist():
            out.append(next(r.shard for r in runs[a] if r.start <= rank[a] < r.stop))
            rank[a] += 1
        return np.array(out), arcs, nodes

    (eight, arcs, nodes), (nine, _, _) = placed(8), placed(9)
    assert (eight != nine).mean() < 0.2  # a plain modulus moves eight ninths
    home = np.array([s for _, s in nodes])[arcs]
    assert (eight == home).mean() > 0.8
    positions = [p for p, _ in nodes]
    df = spark.createDataFrame([(int(k),) for k in keys[:300]], "k long")
    assert [r["a"] for r in df.select(arc_of(F.col("k"), positions).alias("a")).collect()] == (np.searchsorted(positions, keys[:300]) % len(nodes)).tolist()


def odd_texts(n):
    rng = random.Random(5)
    pool = [chr(c) for c in [*range(0x20, 0x250), *range(0x20), *range(0x300, 0x320), 0x3A3, 0x3C2, 0x130, 0x2028, 0x3000, 0x85, 0xA0, 0x4E2D, 0x1F600, 0xAC00, 0x1100, 0x1161, 0x212A]]
    pool += ["<|endoftext|>", "'s", "'LL", " ", " ", "a", "e", "th"] * 8
    return ["".join(rng.choices(pool, k=rng.randint(0, 60))) for _ in range(n)] + ["a" * 5000, "=" * 3001, "ab" * 2000, "\x1c a\x1db", "ΟΔΟΣ"]


def test_tokens_equal_the_library(documents, tokenizer_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path)
    texts = odd_texts(600) + ODD
    docs = documents(texts, n_tokens="clash")
    expected = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    counts = token_counts(docs, tokenizer_path, limit=100).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in counts} == {i: (len((texts[i] or "").encode()), len(e), len(e) > 100) for i, e in expected.items()}
    for r in bpe_codec.bpe_encode(docs, tokenizer_path).collect():
        assert r["ids"] == expected[r["doc_id"]] and r["decoded"] == library.decode(r["ids"], skip_special_tokens=False)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in bpe_codec.bpe_encode(docs, tokenizer_path, digests=True).collect():
        assert r["ids_sha256"] == sha(" ".join(map(str, expected[r["doc_id"]])))
    assert token_counts(docs.limit(0), tokenizer_path).count() == bpe_codec.bpe_encode(docs.limit(0), tokenizer_path).count() == 0


def test_a_small_memory_changes_nothing(tokenizer_path):
    bpe = word_bpe.loaded(word_bpe.read_source(tokenizer_path))
    codec, counter = bpe_codec.Codec(bpe), Counter(merger(word_bpe.read_source(tokenizer_path)))
    codec.known, codec.merged, counter.known = (word_bpe.Remembered(3) for _ in range(3))
    texts = odd_texts(60)
    assert counter.count(texts) == [len(codec.encode(t)) for t in texts] == [codec.texts(t)[0] for t in texts]


KEY = "AKIA" + "Z9" * 8
MIXED = "aB3" * 8


@pytest.mark.parametrize(
    "text,spans",
    [
        (None, ""),
        ("password = 'hunter2!'", "assign:0:19"),
        ("é API_KEY:abc", ""),
        ("secret=token: abcdefg", ""),
        (f"é {KEY}", f"access:2:{2 + len(KEY)}"),
        ("0" * 23 + " " + "0" * 24, "hex:24:48"),
        (MIXED, ""),
        (f"{MIXED} {KEY}", f"secret:0:24,access:25:{25 + len(KEY)}"),
        (f"{MIXED} {'x ' * 200} {KEY}", f"access:{len(MIXED) + 402}:{len(MIXED) + 402 + len(KEY)}"),
        ("https://a.b/c", ""),
        (f"https://a.b/c {KEY} {MIXED}", f"endpoint:0:13,access:14:{14 + len(KEY)},secret:{15 + len(KEY)}:{39 + len(KEY)}"),
        ("token = " + "a1" * 20, "assign:0:48,hex:8:48"),
    ],
)
def test_secrets(documents, text, spans):
    found = secret_scan.secret_scan(documents([text, text], spans="clash")).collect()
    assert [",".join(f"{s['name']}:{s['start']}:{s['stop']}" for s in r["spans"]) for r in found] == [spans, spans]


def test_base_secrets_equal_brute_force(documents):
    rng = random.Random(8)
    parts = ["token", "Secret", "=", ": ", '"', "abc", "123456", KEY, "AKIA", "f" * 30, " ", "\n", "é", "api_key", "passwd:", "=x"]
    texts = ["".join(rng.choices(parts, k=25)) for _ in range(200)]
    assign = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    expected = {}
    for i, t in enumerate(texts):
        spans = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        expected[i] = sorted(spans)
    found = secret_scan.secret_scan(documents(texts)).collect()
    assert {r["doc_id"]: [tuple(s) for s in r["spans"] if s["kind"] < 3] for r in found} == expected
