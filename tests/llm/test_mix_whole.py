"""The registered mix follows the corpus, not its scarcest source."""

import os

import pytest

from lattica.llm import mixing as X
from lattica.llm import queries as Q

pytestmark = pytest.mark.skipif(not os.path.exists(X.TOKENIZER), reason="no tokenizer files")


def test_available_size():
    targets = [("a", 0.6, 1), ("b", 0.3, 3), ("tiny", 0.1, 2), ("none", 0.0, 5)]
    have = {"a": 1000, "b": 100, "tiny": 3, "none": 900}
    assert X.quotas(targets, have, X.AVAILABLE) == {"a": pytest.approx(0.6 * 1103), "b": 300, "tiny": 6}
    assert X.quotas(targets, {}, X.AVAILABLE) == {}


def test_registered_mix_is_not_sized_by_a_tiny_source(spark, tmp_path):
    rows = [(n, "big", "word " * (5 + n % 20)) for n in range(400)] + [(1000 + n, "mid", "word " * (5 + n % 20)) for n in range(300)] + [(2000, "tiny", "word")]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("big", 0.5, 1), ("mid", 0.4, 2), ("tiny", 0.1, 3)],
        "source string, target_share double, max_repeats long").write.parquet(f"{tmp_path}/mix_targets.parquet")
    have = {r["source"]: r["t"] for r in X.token_counts(spark.read.parquet(f"{tmp_path}/documents.parquet")).groupBy("source").agg({"tokens": "sum"}).withColumnRenamed("sum(tokens)", "t").collect()}
    whole = sum(have.values())
    got = {r["source"]: r for r in Q.p7_shares(spark, str(tmp_path)).collect()}
    assert got["tiny"]["tokens"] == 3 * have["tiny"] and got["tiny"]["actual_share"] < 0.01
    assert abs(got["big"]["tokens"] - 0.5 * whole) <= 30 and abs(got["mid"]["tokens"] - 0.4 * whole) <= 30
