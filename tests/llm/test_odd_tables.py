"""Empty tables, repeated rows, null ids, clashing columns and texts of several hundred thousand words."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.llm import bpe_codec, ngram_join, quality_classifier, quality_rules, secret_scan, sharding, simhash_join, token_counts, toxicity
from evidentia.llm.queries import tokenizer_path

LONG = " ".join(f"word{i % 1009}" for i in range(300_000))
OPERATORS = {
    "quality_rules": (lambda docs, labels: quality_rules.quality_rules(docs, labels), "rules"),
    "toxicity": (lambda docs, labels: toxicity.toxicity_scores(docs, labels), "score"),
    "ngram_join": (lambda docs, labels: ngram_join.near_duplicates(docs), "class_id"),
    "token_counts": (lambda docs, labels: token_counts.token_counts(docs, tokenizer_path()), "n_tokens"),
    "secret_scan": (lambda docs, labels: secret_scan.secret_scan(docs), "spans"),
    "bpe_codec": (lambda docs, labels: bpe_codec.bpe_encode(docs, tokenizer_path(), digests=True), "n_tokens"),
    "quality_classifier": (lambda docs, labels: quality_classifier.quality_scores(docs, labels), "quality_kept"),
    "simhash_join": (lambda docs, labels: simhash_join.simhash_groups(docs), "fp"),
    "sharding": (lambda docs, labels: sharding.shard_rows(docs), "size"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(documents, labels, name):
    """Each row has its result: repeated rows equal ones, null ids too, and a text of any length."""
    run, column = OPERATORS[name]
    texts = [(1, LONG), (2, "token: abcdef123456 and more"), (2, "token: abcdef123456 and more"), (2, "token: abcdef123456 and more"), (None, "some words"), (None, "some words"), (None, None), (3, None), (4, "")]
    marks = [(k, k % 2, (k + 1) % 2) for k in range(1, 5)] + [(None, 1, 1)]
    clash = {column: "clash", "n_words": "clash", "stratum": "clash", "host": "clash", "key": "clash"}
    found = run(documents(texts, **clash), labels(marks)).collect()
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(k) for k, _ in texts)
    twice = [str(r[column]) for r in found if r["doc_id"] == 2]
    assert len(twice) == 3 and len(set(twice)) == 1


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(documents, labels, name):
    run, column = OPERATORS[name]
    some = documents([(1, "a few words stand here")])
    empty = run(some.limit(0), labels([(1, 1, 0)]))
    assert empty.count() == 0 and column in empty.columns
    assert run(some, labels([(1, 1, 0)]).filter(F.lit(False))).count() == 1


def test_votes_weigh_as_their_likelihoods():
    """Log-odds of rows differ as the likelihoods of their votes do, multiplied out voter by voter."""
    rng = np.random.default_rng(4)
    rates = (rng.uniform(0.01, 0.2, 6), rng.uniform(0.2, 0.9, 6))
    votes = rng.random((40, 6)) < 0.4
    posterior = toxicity.posteriors(votes, rates, np.ones(6), 0.3, np.ones(40, bool))
    odds = np.log(posterior / (1 - posterior))
    likelihood = np.array([sum(np.log(rates[1][k] / rates[0][k]) if v else np.log((1 - rates[1][k]) / (1 - rates[0][k])) for k, v in enumerate(row)) for row in votes])
    assert np.allclose(odds - odds[0], likelihood - likelihood[0], atol=1e-6) and abs(posterior.mean() - 0.3) < 1e-6


def test_shapes_of_texts():
    assert toxicity.shouted("YOU ARE ALL!! WRONG ABOUT!! THIS ONE!! AND KNOW IT WELL ENOUGH NOW!!") and not toxicity.shouted("Well! done") and not toxicity.shouted("")
    assert toxicity.repeated("no " * 20) and not toxicity.repeated("no no") and not toxicity.repeated(LONG)
