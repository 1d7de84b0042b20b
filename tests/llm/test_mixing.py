"""Quotas and selections."""

import os
from collections import Counter

import pytest

from lattica.llm import mixing as X

pytestmark = pytest.mark.skipif(not os.path.exists(X.TOKENIZER), reason="no tokenizer files")
TARGETS = "source string, target_share double, max_repeats long"


def corpus(spark, sizes, length=30):
    rows, n = [], 0
    for source, many in sizes.items():
        for k in range(many):
            n += 1
            rows.append((n, source, " ".join(f"word{(n * 7 + j) % 50}" for j in range(1 + (k * 13) % length))))
    return spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 AS tokens", "2 AS copies", "0.5 AS weight", "'x' AS rank")


def test_token_counts_are_those_of_the_whole_text(spark):
    t = X._tokenizer(X.TOKENIZER)
    texts = ["", None, "a", "Grüße <|endoftext|> ok", "x" * 30_000, "naïve words " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'s' AS source")
    got = {r["doc_id"]: r["tokens"] for r in X.token_counts(df).collect()}
    assert got == {k: len(t.encode(x, add_special_tokens=False).ids) if x else 0 for k, x in enumerate(texts)}
    assert got[3] > 5 and got[5] == len(t.encode(texts[5]).ids)


def test_quotas():
    targets = [("a", 0.5, 1), ("b", 0.3, 3), ("none", 0.2, 5)]
    assert X.quotas(targets, {"a": 1000, "b": 100}) == {"a": pytest.approx(500), "b": pytest.approx(300)}
    assert X.quotas(targets, {"a": 1000, "b": 100}, 10_000) == {"a": 1000, "b": 300}
    assert X.quotas(targets, {}) == {}


def test_shares_are_met(spark):
    docs = corpus(spark, {"big": 900, "mid": 200, "small": 30, "other": 50})
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 4), ("absent", 0.0, 2), (None, 0.1, 1)], TARGETS)
    picked = X.mix(docs, targets)
    rows = picked.collect()
    assert {r["source"] for r in rows} == {"big", "mid", "small"} and len({r["doc_id"] for r in rows}) == len(rows)
    limit = {"big": 1, "mid": 2, "small": 4}
    assert all(1 <= r["copies"] <= limit[r["source"]] for r in rows)
    assert all(r["copies"] == 4 for r in rows if r["source"] == "small") and sum(r["source"] == "small" for r in rows) == 30
    got = {r["source"]: r for r in X.shares(picked, targets).collect()}
    for s, share in (("big", 0.5), ("mid", 0.3), ("small", 0.2)):
        assert got[s]["actual_share"] == pytest.approx(share, abs=0.005)
    assert got["absent"]["tokens"] == 0 and got["absent"]["actual_share"] == 0.0
    assert Counter(map(tuple, X.mix(docs.repartition(7), targets).collect())) == Counter(map(tuple, rows))
    assert Counter(r["doc_id"] for r in X.mix(docs, targets, seed=8).collect()) != Counter(r["doc_id"] for r in rows)


def test_total_cuts_what_cannot_be_met(spark):
    docs = corpus(spark, {"a": 100, "b": 10})
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], TARGETS)
    sized = {r["source"]: r["t"] for r in X.token_counts(docs).groupBy("source").agg({"tokens": "sum"}).withColumnRenamed("sum(tokens)", "t").collect()}
    got = {r["source"]: r for r in X.shares(X.mix(docs, targets, total=float(sized["a"])), targets).collect()}
    assert got["b"]["tokens"] == 2 * sized["b"] and abs(got["a"]["tokens"] - sized["a"] / 2) <= 70


def test_quota_is_met_within_one_document_in_fine_bins(spark, monkeypatch):
    monkeypatch.setattr(X, "BINS", 4)
    monkeypatch.setattr(X, "LAST", 5)
    docs = corpus(spark, {"a": 400, "b": 300})
    targets = spark.createDataFrame([("a", 0.9, 1), ("b", 0.1, 1)], TARGETS)
    got = {r["source"]: r for r in X.shares(X.mix(docs, targets), targets).collect()}
    assert got["b"]["actual_share"] == pytest.approx(0.1, abs=0.004)


def test_pareto_order_prefers_heavier_weights(spark):
    docs = corpus(spark, {"a": 600}, length=2)
    weights = spark.createDataFrame([(n, 4.0 if n % 2 else 1.0) for n in range(1, 601)], "doc_id long, weight double")
    targets = spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    total = X.token_counts(docs).agg({"tokens": "sum"}).first()[0] / 4
    picked = X.mix(docs, targets, total=total, weights=weights).collect()
    odd = sum(r["doc_id"] % 2 for r in picked) / len(picked)
    assert 0.72 < odd < 0.88  # 4 in 5 expected


def test_nulls_ties_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a", "x y"), (1, "a", "x y"), (2, "a", None), (3, None, "z"), (4, "a", ""), (None, "a", "q r s")], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 1.0, 2)], TARGETS)
    got = Counter(tuple(r)[:2] for r in X.mix(docs, targets).collect())
    assert got == {(1, "a"): 2, (None, "a"): 1}
    assert X.mix(docs.limit(0), targets).count() == 0 and X.mix(docs, targets.limit(0)).count() == 0
    assert X.mix(docs, spark.createDataFrame([("a", None, None)], TARGETS)).count() == 0
    assert X.shares(X.mix(docs.limit(0), targets), targets).first()["tokens"] == 0


def test_a_weighted_quota_is_met_while_repeats_are_left(spark):
    docs = spark.createDataFrame([(n, "a", "word " * 20) for n in range(10)], "doc_id long, source string, text string")
    each = X.token_counts(docs.limit(1)).first()["tokens"]
    targets = spark.createDataFrame([("a", 1.0, 2)], TARGETS)
    weights = spark.createDataFrame([(0, 100.0), (1, 3.0), (2, None), (3, 1.0)], "doc_id long, weight double")
    for copies in (1, 5, 11, 15, 19, 20):
        rows = X.mix(docs, targets, total=float(copies * each), weights=weights).collect()
        assert sum(r["copies"] for r in rows) == copies and max(r["copies"] for r in rows) <= 2
    heavy = {r["doc_id"]: r["copies"] for r in X.mix(docs, targets, total=15.0 * each, weights=weights).collect()}
    assert heavy[0] == heavy[1] == 2
    zero = spark.createDataFrame([(n, 0.0 if n < 4 else -1.0 if n == 4 else float("nan") if n == 5 else 1.0) for n in range(10)], "doc_id long, weight double")
    rows = X.mix(docs, targets, total=15.0 * each, weights=zero).collect()
    assert {r["doc_id"]: r["copies"] for r in rows} == {n: 2 for n in (6, 7, 8, 9)}


def test_weighted_sources_meet_their_shares(spark):
    docs = corpus(spark, {"a": 500, "b": 120})
    weights = docs.selectExpr("doc_id", "CASE WHEN doc_id % 10 = 0 THEN 50.0 WHEN doc_id % 3 = 0 THEN 0.01 ELSE doc_id % 7 + 0.5 END AS weight")
    targets = spark.createDataFrame([("a", 0.6, 2), ("b", 0.4, 3)], TARGETS)
    whole = X.token_counts(docs).agg({"tokens": "sum"}).first()[0]
    picked = X.mix(docs, targets, total=float(whole), weights=weights)
    got = {r["source"]: r for r in X.shares(picked, targets).collect()}
    biggest = 100
    assert abs(got["a"]["tokens"] - 0.6 * whole) <= biggest
    sized_b = X.token_counts(docs.where("source = 'b'")).agg({"tokens": "sum"}).first()[0]
    assert abs(got["b"]["tokens"] - min(0.4 * whole, 3 * sized_b)) <= biggest
    assert all(r["copies"] <= (2 if r["source"] == "a" else 3) for r in picked.collect())
