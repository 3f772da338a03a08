"""Line dedup, n-gram join and decontamination against brute force."""

import random
import re

import numpy as np
import pytest

from pyspark.sql import functions as F

from evidentia.llm import decontamination as decon
from evidentia.llm import line_dedup as line_dedup_module
from evidentia.llm.components import connected_components
from evidentia.llm.line_dedup import LineMatching, line_dedup
from evidentia.llm.ngram_join import NgramJoin, least_agreeing, near_duplicates, one_of_each_group, shingles, signature
from tests.llm.conftest import ODD

VOCABULARY = [f"w{i}" for i in range(300)]


def varied(seed, base, n, edits):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
        out.append(w)
    return out


def some_lines(seed):
    """Texts of lines, many of them variants of a few: similarities lie on both sides of 0.8."""
    rng = random.Random(seed)
    bases = [rng.sample(VOCABULARY, rng.choice([6, 12, 30])) for _ in range(4)]
    lines = [" ".join(w) for k, b in enumerate(bases) for w in varied(seed + k, b, 25, 4)]
    lines += [" ".join(rng.choices(VOCABULARY, k=rng.randint(1, 15))) for _ in range(60)]
    rng.shuffle(lines)
    return ["\n".join(lines[i : i + 4]) for i in range(0, len(lines), 4)]


def brute_lines(texts, least=1):
    seen, gone = [], []
    for text in texts:
        own = []
        for k, line in enumerate((text or "").split("\n")):
            s = frozenset(w for w in re.split(r"[\x20\x09-\x0D]+", line) if w)
            if len(s) >= least:
                if any(5 * len(s & o) >= 4 * len(s | o) for o in seen):
                    own.append(k)
                seen.append(s)
        gone.append(own)
    return gone


@pytest.mark.parametrize("hot", [100, 3])
def test_lines_equal_brute_force(documents, hot):
    texts = [*some_lines(1), *ODD, "a\tb c  d e\x0bf", "f e d c b a", "a b c d e f"]
    found = line_dedup(documents(texts, removed="clash", own="x"), LineMatching(hot=hot)).collect()
    expected = brute_lines(texts)
    assert {r["doc_id"]: r["removed"] for r in found} == dict(enumerate(expected))
    for r in found:
        text = texts[r["doc_id"]]
        kept = None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in expected[r["doc_id"]])
        assert r["text"] == kept and r["own"] == "x"


def test_lines_of_repeated_rows_and_none(documents):
    line = "one two three four five six"
    found = line_dedup(documents([(1, line), (1, line), (2, line), (None, "other words that stand here alone")])).collect()
    assert sorted((r["doc_id"] or 0, r["removed"]) for r in found) == [(0, []), (1, []), (1, []), (2, [0])]
    assert line_dedup(documents([(1, line)]).limit(0)).count() == 0


def shingle_set(text):
    w = (text or "").encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_groups(texts):
    """For each text: the least index of its group, copies, links."""
    kinds = sorted({t or "" for t in texts})
    sets = [shingle_set(t) for t in kinds]
    links, parent = [0] * len(kinds), list(range(len(kinds)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(kinds)):
        for j in range(i):
            if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    at = {t: i for i, t in enumerate(kinds)}
    first = {}
    for k, t in enumerate(texts):
        first.setdefault(root(at[t or ""]), k)
    return [(first[root(at[t or ""])], sum((u or "") == (t or "") for u in texts), links[at[t or ""]]) for t in texts]


@pytest.mark.parametrize("block", [1024, 8])
def test_near_duplicates_equal_brute_force(documents, block):
    rng = random.Random(5)
    texts = [" ".join(w) for k in range(4) for w in varied(k, rng.choices(VOCABULARY, k=80), 14, 3)]
    texts += [" ".join(rng.choices(VOCABULARY, k=30)) for _ in range(20)] + texts[:5] + ODD
    found = near_duplicates(documents(texts, class_id="clash"), NgramJoin(block=block)).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_copies"], r["n_links"]) for r in found} == dict(enumerate(brute_groups(texts)))
    kept = one_of_each_group(documents(texts, class_id="clash"), NgramJoin(block=block))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for c, _, _ in brute_groups(texts)})
    assert kept.columns[-1] == "class_id"


def test_near_duplicates_of_repeated_rows_nulls_and_none(documents):
    text = "one two three four five six"
    rows = documents([(3, text), (3, text), (None, text), (None, "unlike the rest of it all"), (None, "unlike the rest of it all")])
    assert {(r["doc_id"], r["class_id"], r["n_copies"]) for r in near_duplicates(rows).collect()} == {(3, 3, 3), (None, 3, 3), (None, None, 2)}
    assert sorted(str(r["doc_id"]) for r in one_of_each_group(rows).collect()) == ["3", "None"]
    assert near_duplicates(rows.limit(0)).count() == 0


def test_pruning_keeps_pairs_at_the_threshold():
    rule, rng, lost = NgramJoin(), np.random.default_rng(1), 0
    for _ in range(60):
        a = rng.integers(0, 2**63, 90, np.uint64)
        x, y = signature(a[:85], rule), signature(np.concatenate([a[5:85], a[85:], rng.integers(0, 2**63, 10, np.uint64)]), rule)
        lost += any((x[:n] == y[:n]).sum() < m for n, m in least_agreeing(rule))
    assert lost == 0
    assert len(shingles("a b c d e f", 5)) == 2 and len(shingles("a b", 5)) == 1 and not len(shingles(None, 5))


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {(r["key"], r["root"]) for r in connected_components(links).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}
    assert connected_components(links.limit(0)).isEmpty()


def edit_distance(item, text):
    before = [0] * (len(text) + 1)
    for i in range(1, len(item) + 1):
        now = [i] + [0] * len(text)
        for j in range(1, len(text) + 1):
            now[j] = min(before[j] + 1, now[j - 1] + 1, before[j - 1] + (item[i - 1] != text[j - 1]))
        before = now
    return min(before)


def test_edit_matching_equals_brute_force():
    rng, rule, hits = random.Random(2), decon.EditMatching(), 0
    words = ["the", "cat", "sat", "on", "mat", "dog", "ran", "far"]
    for _ in range(250):
        item = " ".join(rng.choices(words, k=rng.randint(7, 16)))
        noisy = list(item)
        for _ in range(rng.randint(0, 6)):
            noisy[rng.randrange(len(noisy))] = rng.choice(["", "x", "z ", "A"])
        text = " ".join(rng.choices(words, k=12)) + " " + "".join(noisy) + ", " + " ".join(rng.choices(words, k=5))
        item_n, best = decon.normal(item), None
        if len(item_n) < rule.shortest:
            continue
        best = edit_distance(item_n, decon.normal(text))
        budget = int(rule.rate * len(item_n))
        assert decon.Matcher(((1, item),), rule).leaks(text) == ([(1, best)] if best <= budget else [])
        hits += best <= budget
    assert 30 < hits < 220


def test_leaks_in_blocks(spark, documents):
    items = [(1, "The quick brown fox jumps over the lazy dog again and again"), (2, None), (3, ""), (4, "short item"), (5, "Another passage that nobody else would ever write down here")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    texts = [*ODD, "so: the QUICK brown fox jumped over the lazy dog, again and again!", "Short  item.", "a short item within", "short items, or a cohort item", items[4][1] + " " + items[0][1]]
    docs = documents(texts, leaks="clash")
    for block in (4_000_000, 10):
        rule = decon.EditMatching(block_chars=block)
        found = {r["doc_id"]: [x["item_id"] for x in r["leaks"]] for r in decon.benchmark_leaks(docs, benchmark, rule).collect()}
        n = len(ODD)
        assert {k: v for k, v in found.items() if v} == {n: [1], n + 1: [4], n + 2: [4], n + 4: [1, 5]} and len(found) == len(texts)
        clean = decon.without_leaks(docs, benchmark, rule)
        assert sorted(r["doc_id"] for r in clean.collect()) == [*range(n), n + 3] and clean.columns == docs.columns
    assert decon.benchmark_leaks(docs, benchmark.limit(0)).filter("size(leaks) > 0").isEmpty()
    assert decon.without_leaks(docs, benchmark.limit(0)).count() == len(texts)


def test_blocks_of_items_agree_with_one_block(spark, documents):
    rng = random.Random(8)
    lines = [" ".join(rng.choices(VOCABULARY, k=14)) for _ in range(60)]
    items = [(k if k % 7 else None, lines[k] + "\n" + lines[(k * 5) % 60]) for k in range(30)] + [(3, lines[50])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    texts = ["\n".join(rng.sample(lines, 4)) for _ in range(60)]
    rows = [(k % 50 if k % 9 else None, t) for k, t in enumerate(texts)] + [(1, texts[1])] * 3 + [(4, "word " * 300_000 + lines[50]), (5, None)]
    docs = documents(rows, hash="clash", row="clash")
    found = [sorted((str(r) for r in decon.benchmark_leaks(docs, benchmark, decon.EditMatching(block_chars=b)).collect())) for b in (4_000_000, 700)]
    assert found[0] == found[1] and len(found[0]) == len(rows)
    assert 5 < sum("item_id" in r for r in found[0]) < len(rows)
    clean = [sorted(str(r) for r in decon.without_leaks(docs, benchmark, decon.EditMatching(block_chars=b)).collect()) for b in (4_000_000, 700)]
    assert clean[0] == clean[1] and len(clean[0]) == sum("item_id" not in r for r in found[0])
    assert decon.without_leaks(docs.limit(0), benchmark).isEmpty() and decon.benchmark_leaks(docs.limit(0), benchmark).isEmpty()


def test_comparisons_do_not_grow_with_the_square(spark):
    """Zipf lines over a fixed vocabulary: four times the lines, at most six times the comparisons on keys."""
    rng = np.random.default_rng(1)
    share = 1 / np.arange(1, 1001)
    found = []
    for n in (4_000, 16_000, 64_000):
        lines = [" ".join(f"w{x}" for x in row) for row in rng.choice(1000, (n, 14), p=share / share.sum())]
        docs = spark.createDataFrame([(k, "\n".join(lines[k : k + 1000])) for k in range(0, n, 1000)], "doc_id long, text string")
        rule = LineMatching()
        ranks = line_dedup_module.word_ranks(docs)
        sets = line_dedup_module.line_sets(line_dedup_module.line_keys(docs, ranks, rule), rule)
        keys = line_dedup_module.key_rows(sets.withColumn("open", F.lit(True)).withColumn("age", F.col("first.doc_id")), ranks, rule).groupBy("key").count()
        found.append(keys.agg(F.max("count").alias("largest"), F.sum(F.col("count") * (F.col("count") - 1) / 2).alias("pairs")).first())
    assert max(r["largest"] for r in found) <= 200
    assert all(b["pairs"] <= 6 * a["pairs"] for a, b in zip(found, found[1:])), found
