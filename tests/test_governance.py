"""Leakage of benchmarks of any size."""

from evidentia.operators import governance


def test_benchmarks_of_any_size_are_searched(spark):
    texts = [(1, "xx item 20999. yy item 7. item 7."), (2, None), (3, ""), (3, "item 5"), (3, "Item 7."), (4, "ñ item 5.\U0001f600")]
    documents = spark.createDataFrame(texts, "doc_id long, text string")
    items = [(k, f"item {k}.") for k in range(21_000)] + [(-1, None), (-2, ""), (7, "item 7."), (-3, "\U0001f600")]
    benchmark = spark.createDataFrame(items, "item_id int, text string")
    expected = sorted((d, k) for d, text in texts for k, item in items if text is not None and item is not None and item in text)
    for chars in (governance.BLOCK_CHARS, 60_000):
        found = governance.benchmark_contained(documents, benchmark, block_chars=chars)
        assert found.dtypes == [("doc_id", "bigint"), ("item_id", "int")]
        assert sorted(tuple(r) for r in found.collect()) == expected
    assert governance.benchmark_contained(documents, benchmark.limit(0)).count() == 0
