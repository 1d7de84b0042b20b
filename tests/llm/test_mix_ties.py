"""Rows that repeat one id count as documents of their own when a quota ends among them."""

import os

import pytest

from lattica.llm import mixing as X

pytestmark = pytest.mark.skipif(not os.path.exists(X.TOKENIZER), reason="no tokenizer files")


@pytest.mark.parametrize("doc_id", [7, None])
@pytest.mark.parametrize("chunk", [65_536, 50])
def test_quota_ends_among_copies_of_one_row(spark, monkeypatch, doc_id, chunk):
    monkeypatch.setattr(X, "CHUNK", chunk)
    docs = spark.createDataFrame([(doc_id, "a", "word word word")] * 300, "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 1.0, 3)], "source string, target_share double, max_repeats long")
    each = X.token_counts(docs.limit(1)).first()["tokens"]
    for copies in (1, 100, 299, 300, 450, 900):
        rows = X.mix(docs, targets, total=float(copies * each)).collect()
        assert sum(r["copies"] for r in rows) == copies and len(rows) == min(copies, 300), copies
        assert max(r["copies"] for r in rows) - min(r["copies"] for r in rows) <= 1


def test_a_third_of_a_source_is_copies_of_one_row(spark):
    text = lambda n: " ".join(["word"] * (1 + n % 9))
    rows = [(n, "a", text(n)) for n in range(200)] + [(1000, "a", text(n % 3)) for n in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats long")
    sized = [r["tokens"] for r in X.token_counts(docs).collect()]
    for part in (0.1, 0.3, 0.5, 0.7, 0.9):
        for seed in (1, 2, 3):
            got = sum(r["tokens"] * r["copies"] for r in X.mix(docs, targets, total=part * sum(sized), seed=seed).collect())
            assert abs(got - part * sum(sized)) <= max(sized), (part, seed)
