"""Small document tables."""

import os

import pytest

TOKENIZER = "word_bpe_49k.json"


@pytest.fixture
def documents(spark):
    """Makes a documents table from texts, or from (doc_id, text) pairs; lang, source and n_chars follow."""

    def make(rows, **extra):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        data = [(i, t, "en", "src0", None if t is None else len(t), *extra.values()) for i, t in rows]
        kinds = "".join(f", {k} string" for k in extra)
        return spark.createDataFrame(data, f"doc_id long, text string, lang string, source string, n_chars long{kinds}").repartition(3)

    return make


@pytest.fixture
def labels(spark):
    def make(rows):
        return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")

    return make


@pytest.fixture(scope="session")
def tokenizer_path():
    public = pytest.importorskip("public_tokenizers")
    path = public.path(TOKENIZER)
    if not os.path.exists(path):
        pytest.skip("no tokenizer file")
    return path


#: Null, empty, white space only, one word, ties, and a very long text.
ODD = [None, "", " \t\n ", "word", "word", "a b c d e", "x" * 50_000, "one two three four five six\n" * 400]
