"""The registered queries and the pipeline leave nothing out."""

import bisect
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from evidentia.llm import decontamination as decon
from evidentia.llm import queries, toxicity
from evidentia.llm.line_dedup import LineMatching, key_rows, line_dedup, line_keys, line_sets, word_ranks
from evidentia.llm.ngram_join import one_of_each_group
from evidentia.llm.sharding import Ring, shard_rows
from evidentia.plans.staging import staged
from tests.llm.conftest import ODD
from tests.llm.test_pairs import VOCABULARY, brute_lines, some_lines

DATA = "/root/testdata/sf0.001"


def test_short_lines_equal_brute_force(documents):
    short = ["Les.", "a b", "b a", "a b c", "a b c d", "a b c d e", "e d c b", "a b c x", "", " "]
    texts = [*some_lines(3), *ODD, "\n".join(short), "\n".join(reversed(short)), "Les.\nnew"]
    expected = dict(enumerate(brute_lines(texts, least=1)))
    for rule in (LineMatching(), LineMatching(hot=2), LineMatching(hot=2, frequent=0.0, pairs_up_to=12)):
        assert {r["doc_id"]: r["removed"] for r in line_dedup(documents(texts), rule).collect()} == expected
    assert expected[len(texts) - 1] == [0]


def test_op1_and_its_stage_take_every_line_with_a_word(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = sorted(docs.collect(), key=lambda r: r["doc_id"])
    expected = dict(zip([r["doc_id"] for r in rows], brute_lines([r["text"] for r in rows], least=1)))
    assert {r["doc_id"]: [int(k) for k in r["removed"].split(",") if k] for r in queries.op1_line_dedup(spark, DATA).collect()} == expected
    for r in corpus_pipeline.dedup_lines(spark, docs, DATA).collect():
        text = next(x["text"] for x in rows if x["doc_id"] == r["doc_id"])
        assert r["text"] == "\n".join(x for k, x in enumerate(text.split("\n")) if k not in expected[r["doc_id"]])


def test_most_of_an_item_is_found(spark, documents):
    first, second, third = (" ".join(VOCABULARY[k : k + 20]) for k in (0, 20, 40))
    long = " ".join(VOCABULARY[100:180])
    items = [(1, f"{first}\n{second}\n{third}"), (2, long), (3, f"ab cd\n{third}")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    middle = " ".join(VOCABULARY[110:170])
    texts = [
        f"new words here {first}\nother words {third.replace('w45', 'w4x')}",  # a line taken out of item 1
        f"{first} and no more of it",
        f"before {middle} after",
        " ".join(VOCABULARY[100:125]),
        items[0][1],
        "nothing of it",
        None,
    ]
    docs = documents(texts)
    found = {r["doc_id"]: {x["item_id"]: x["distance"] for x in r["leaks"]} for r in decon.benchmark_leaks(docs, benchmark).collect()}
    assert set(found[0]) == {1, 3} and found[0][1] == len(second) + 1
    assert 1 not in found[1] and set(found[2]) == {2} and found[3] == {} and found[4][1] == 0 and found[5] == found[6] == {}
    assert found[2][2] > int(0.08 * len(long))
    assert sorted(r["doc_id"] for r in decon.without_leaks(docs, benchmark).collect()) == [1, 3, 5, 6]


def test_segments_hold_every_word():
    rule = decon.EditMatching()
    for text in ("a\nb", "a b c\n" + " ".join(VOCABULARY[:90]) + "\n\nx", "x" * 500, " ".join(VOCABULARY)):
        cut = decon.segments(text, rule)
        assert " ".join(cut) == decon.normal(text)
        assert all(len(s) >= rule.shortest for s in cut) or len(cut) == 1


def test_one_of_each_group_where_ids_repeat_or_are_null(documents):
    words = [f"{c}{i}" for c in "ab" for i in range(80)]
    one, two = " ".join(words[:80]), " ".join(words[80:])
    near = lambda text: text + " more"
    kept = one_of_each_group(documents([(7, one), (7, two), (8, near(two)), (9, near(one))])).collect()
    assert sorted(r["text"] for r in kept) == sorted([one, two])
    kept = one_of_each_group(documents([(None, one), (None, near(one)), (None, two), (5, near(two))])).collect()
    assert len(kept) == 2 and {r["doc_id"] for r in kept} == {None, 5}


def test_a_null_language_is_a_stratum_apart(spark, labels):
    """Its cutoffs do not change with a language that is called none."""
    from evidentia.llm import quality_rules as rules

    rng = random.Random(4)
    text = lambda tail: " ".join("".join(rng.choices("abcdefghij", k=6)) + tail for _ in range(30))
    rows = [(i, text("" if i < 600 else "###"), None) for i in range(720)]
    other = [(1000 + i, text("###"), "none") for i in range(600)]
    marks = labels([(i, int(i < 600), 0) for i in range(720)] + [(1000 + i, 1, 0) for i in range(600)])
    control = rules.RiskControl(limit=0.1, error=0.1, rules={"symbols_per_word": rules.RULES["symbols_per_word"]}, broadcast_rows=1)
    for extra in ([], other):
        docs = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string")
        kept = {r["doc_id"] for r in rules.quality_rules(docs, marks, control).collect() if r["kept"]}
        assert kept == {*range(600), *(k for k, _, _ in extra)}


def test_op5_equals_a_plain_walk(spark):
    """Key by key around the ring, with the hashes made outside Spark."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    nodes = Ring().nodes()
    positions = [p for p, _ in nodes]
    arcs = [[] for _ in nodes]
    for r in docs:
        key = xxhash.xxh64(str(r["doc_id"]).encode(), seed=42).intdigest()
        order = xxhash.xxh64(b"order", seed=xxhash.xxh64((r["text"] or "").encode(), seed=key).intdigest()).intdigest()
        arcs[bisect.bisect_left(positions, key >> 33) % len(nodes)].append((order - (order >> 63 << 64), r["doc_id"]))
    room = [len(docs) // 8 + (s < len(docs) % 8) for s in range(8)]
    used, expected, over = [0] * 8, {}, []

    def put(shard, key):
        expected[key] = (shard, used[shard])
        used[shard] += 1

    for arc, (_, shard) in enumerate(nodes):
        for _, key in sorted(arcs[arc]):
            if used[shard] < room[shard]:
                put(shard, key)
            else:
                over.append((arc, key))
    for arc, key in over:
        put(next(s for k in range(1, len(nodes) + 1) if used[s := nodes[(arc + k) % len(nodes)][1]] < room[s]), key)
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in queries.op5_sharding(spark, DATA).collect()} == expected


def test_one_id_and_one_text_fill_no_window(documents):
    found = shard_rows(documents([(7, "same")] * 700 + [(7, f"t{i}") for i in range(100)] + [(None, None)] * 300), Ring(rows_per_bucket=1)).collect()
    slots = [sorted(r["slot"] for r in found if r["shard"] == s) for s in range(8)]
    assert len(found) == 1100 and all(v == list(range(len(v))) for v in slots) and max(map(len, slots)) - min(map(len, slots)) <= 1


def test_labels_that_votes_do_not_bear_out_are_overruled():
    rng = np.random.default_rng(3)
    toxic = rng.random(2000) < 0.2
    votes = np.column_stack([np.where(toxic, rng.random(2000) < 0.6, rng.random(2000) < 0.01) for _ in range(6)])
    labels = np.where(rng.random(2000) < 0.5, toxic.astype(int), toxicity.UNLABELLED)
    wrong = np.flatnonzero((labels == 0) & ~votes.any(1))[:20]
    labels[wrong] = 1
    posterior = toxicity.label_model(votes, labels, 0.2, 0.95)
    assert ((posterior > 0.5) == toxic).mean() > 0.95 and (posterior[wrong] < 0.5).all()
    # The weights: voters that always fire together share one vote.
    rates = (np.full(4, 0.05), np.full(4, 0.5))
    echo = np.column_stack([votes[:, 0]] * 3 + [votes[:, 1]]).astype(float)
    weights = toxicity.echo_weights(echo, toxic.astype(float), rates)
    assert np.allclose(weights[:3].sum(), 1, atol=0.05) and weights[3] > 0.9


def test_short_items_have_a_budget_and_parts():
    """Items of 13 characters may differ by an edit; of a line of 60 and more most is enough, a third is not."""
    line = " ".join(VOCABULARY[200:219])
    assert 60 <= len(line) < 120
    finder = decon.Matcher(((1, "a short phrase"), (2, line), (3, "brief")), decon.EditMatching())
    words = line.split()
    held = lambda text: sorted(key for key, _ in finder.leaks(text))
    assert held("what a shart phrase it is") == [1] and held("what a shart phrese it is") == [] and held("a brief one") == [3] and held("briefly") == []
    assert held("so " + " ".join(words[:14]) + " and no more") == [2] and held("so " + " ".join(words[5:]) + " stands here") == [2]
    assert held("so " + " ".join(words[:6]) + " and no more") == [] and held(line) == [2]


def test_texts_are_split_once(documents):
    """An inner explode filters by the size of its array first, which makes the array twice."""
    ranks = word_ranks(documents(ODD))
    keys = line_keys(documents(ODD), ranks, LineMatching())
    assert "Filter" not in keys._jdf.queryExecution().optimizedPlan().toString()
    assert keys.count() == sum((x or "").count("\n") + 1 for x in ODD)


def test_keys_are_made_in_compiled_code(documents):
    """Chains by lambdas are interpreted, and an array of all grades between two projections is copied for each line."""
    rule, docs = LineMatching(frequent=0.0), documents([*some_lines(2), *ODD])
    ranks = word_ranks(docs)
    keys = line_keys(docs, ranks, rule)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "AS known" not in plan(keys)
    sets = line_sets(keys, rule).withColumn("open", F.lit(True)).withColumn("age", F.col("first.doc_id"))
    sets = staged(sets, "some_sets")
    rows = key_rows(sets, ranks, rule)
    assert "lambda" not in plan(rows)
    # With every word frequent, lines of up to 40 words and few enough to match no longer one have chains of three only.
    p = [(r["id"], r["n"], [x for x in r["prefix"]]) for r in sets.filter("n between 12 and 30").collect()]
    found = {(r["id"], r["n"]): r["c"] for r in rows.filter("n between 12 and 30").groupBy("id", "n").agg(F.count("*").alias("c")).collect()}
    triples = lambda n, size: sum(1 for i in range(size) for j in range(i + 1, size) for k in range(j + 1, size) if i < n and j < n + 1 and k < n + 2)
    assert p and found == {(i, n): triples(len(w) - 2, len(w)) for i, n, w in p}
