"""The registered queries and the pipeline over a whole small table."""

import hashlib
import re

import pytest

import corpus_pipeline
from evidentia.llm import queries
from evidentia.llm.decontamination import Matcher, EditMatching
from tests.llm.test_pairs import brute_groups, brute_lines

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [name for name in queries.QUERIES if name != "op11_centroid_clusters"])
def test_every_document_has_its_row(spark, name):
    found = queries.QUERIES[name](spark, DATA)
    ids = sorted(r["doc_id"] for r in found.select("doc_id").collect())
    assert ids == sorted(r["doc_id"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").collect())


def test_pipeline_equals_brute_force(spark, tokenizer_path):
    """All but the classifier is done again by brute force, on what the classifier kept."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    first = sorted(corpus_pipeline.STAGES[0][1](spark, docs, DATA).collect(), key=lambda r: r["doc_id"])
    gone = brute_lines([r["text"] for r in first])
    rows = []
    for r, lines in zip(first, gone):
        text = "\n".join(x for k, x in enumerate(r["text"].split("\n")) if k not in lines)
        if not lines or re.search(r"[^\x20\x09-\x0D]", text):
            rows.append((r["doc_id"], text))
    groups = brute_groups([t for _, t in rows])
    rows = [row for k, (row, g) in enumerate(zip(rows, groups)) if g[0] == k]
    finder = Matcher(tuple((r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()), EditMatching())
    library, sha = Tokenizer.from_file(tokenizer_path), lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = set()
    for key, text in rows:
        if not finder.leaks(text):
            ids = library.encode(text, add_special_tokens=False).ids
            expected.add((key, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert {tuple(r) for r in corpus_pipeline.run(spark, DATA).collect()} == expected and len(expected) > 50


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, DATA)
        assert found.dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), DATA).count() == 0
