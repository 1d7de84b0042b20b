"""What is published outlives the process that published it."""

import json
import os
import subprocess
import sys
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lattica.operators import changes as C
from lattica.operators import merkle as M
from lattica.sources import shared
from lattica.sources.shared import Parts, Versions, fresh

T0 = datetime(2025, 3, 1)
FEED = "seq long, type string, document_path string, collection_path string, version long, commit_time timestamp_ntz"
SCRIPT = """
import json, sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession, functions as F
from lattica.operators.changes import apply_changes
from lattica.operators.merkle import process_new, unseen_changes
from lattica.plans.ast import Order
from lattica.plans.compiler import matching
from lattica.plans.parser import parse_query
from lattica.sources.indexes import Index, Indexes

run, at = int(sys.argv[1]), sys.argv[2]
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", at + "/shared").getOrCreate()
feed = spark.range(1, 41).select(
    F.col("id").alias("seq"), F.when(F.col("id") % 9 == 0, "removed").otherwise("modified").alias("type"), F.concat(F.lit("d/"), (F.col("id") % 6).cast("string")).alias("document_path"),
    F.lit("d").alias("collection_path"), F.col("id").alias("version"), F.timestamp_seconds(F.col("id")).cast("timestamp_ntz").alias("commit_time"))
part = feed.where("seq <= 20") if run == 1 else feed.where("seq > 15")
cursors = spark.createDataFrame([("one", 12)], "consumer string, seq long").withColumn("updated_at", F.timestamp_seconds(F.lit(30)).cast("timestamp_ntz"))
index = Index("d", (Order("n"),))
if run == 1:
    docs = spark.range(9).select(F.concat(F.lit("d/"), F.col("id").cast("string")).alias("document_path"), F.lit("d").alias("collection_id"), F.concat(F.lit('{{"n":{{"integerValue":"'), F.col("id").cast("string"), F.lit('"}}}}')).alias("data"))
    Indexes(spark, at + "/indexes").build(docs, index)
found = matching(Indexes(spark, at + "/indexes").open(index), parse_query({{"collection": "d", "where": {{"field": "n", "op": "gte", "value": {{"integerValue": "5"}}}}}}))
print(json.dumps({{
    "live": sorted(map(list, apply_changes(spark, part, at + "/state").collect())),
    "unseen": sorted(r["seq"] for r in unseen_changes(feed if run == 2 else part, cursors, at + "/unseen").collect()),
    "new": sorted(r["seq"] for r in process_new(spark, feed if run == 2 else part, "seq", at + "/new", lambda df: df).collect()),
    "indexed": found.count()}}))
spark.stop()
"""


def test_a_second_process_goes_on(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = tmp_path / "run.py"
    script.write_text(SCRIPT.format(root=root))
    out = []
    for run in (1, 2):
        done = subprocess.run([sys.executable, str(script), str(run), str(tmp_path)], capture_output=True, text=True, timeout=300,
            env={**os.environ, "PYSPARK_PYTHON": sys.executable})
        assert done.returncode == 0, done.stderr[-3000:]
        out.append(json.loads(done.stdout.strip().splitlines()[-1]))
    last = {f"d/{n % 6}": n for n in range(1, 41)}
    assert out[1]["live"] == sorted([p, n, n] for p, n in last.items() if n % 9)
    assert out[0]["unseen"] == list(range(13, 21)) and out[1]["unseen"] == list(range(21, 41))
    assert out[0]["new"] == list(range(1, 21)) and out[1]["new"] == list(range(21, 41))
    assert out[0]["indexed"] == out[1]["indexed"] == 4


def test_only_touched_buckets_are_written(spark):
    at = fresh(spark, "t")
    feed = spark.range(1, 2001).select(F.col("id").alias("seq"), F.lit("added").alias("type"),
        F.concat(F.lit("d/"), F.col("id").cast("string")).alias("document_path"), F.lit("d").alias("collection_path"),
        F.lit(1).cast("long").alias("version"), F.lit(T0).alias("commit_time"))
    C.apply_changes(spark, feed, at, 16)
    _, before = Versions(spark, at).latest()
    few = [(3000 + n, "modified", f"d/{n}", "d", 2, T0) for n in (7, 8)]
    assert C.apply_changes(spark, spark.createDataFrame(few, FEED), at).where("version = 2").count() == 2
    _, after = Versions(spark, at).latest()
    kept, written = (sum(len(ns) for f, ns in after["state"].items() if (f in before["state"]) == old) for old in (True, False))
    assert written <= 2 and kept == 16 - written
    assert C.live_documents(spark, at).count() == 2000
    Versions(spark, at).prune()
    assert C.live_documents(spark, at).count() == 2000


def test_buckets_grow(spark, monkeypatch):
    monkeypatch.setattr(C, "BUCKET_ROWS", 20)
    at = fresh(spark, "t")
    rows = lambda lo, hi: spark.createDataFrame([(n, "added", f"d/{n}", "d", 1, T0) for n in range(lo, hi)], FEED)
    C.apply_changes(spark, rows(1, 200), at, 2)
    assert C.apply_changes(spark, rows(200, 203), at).count() == 202
    _, m = Versions(spark, at).latest()
    assert m["buckets"] == 20 and sum(map(len, m["state"].values())) == 20


def test_ledger_and_marks_are_written_as_one_again(spark, monkeypatch):
    monkeypatch.setattr(C, "LEDGER_FOLDERS", 1)
    monkeypatch.setattr(M, "MARK_FOLDERS", 1)
    at, inc = fresh(spark, "t"), fresh(spark, "t")
    for n in range(3):
        feed = spark.createDataFrame([(9 - n, "added", "d/a", "d", n, T0), (20 + n, "added", "d/b", "d", 1, T0)], FEED)
        live = C.apply_changes(spark, feed, at)
        new = M.process_new(spark, feed, "seq", inc, lambda df: df)
        assert new.count() == 2 and M.process_new(spark, feed, "seq", inc, lambda df: df).count() == 0
    assert {tuple(r) for r in live.collect()} == {("d/a", 0, 9), ("d/b", 1, 20)}
    assert len(Versions(spark, at).latest()[1]["ledger"]) == 1


def test_an_unchanged_feed_opens_no_leaf(spark, monkeypatch):
    at = fresh(spark, "t")
    feed = spark.range(0, 100_000).select(F.col("id").alias("seq"), F.lit("added").alias("type"), F.lit("d/a").alias("document_path"),
        F.lit("d").alias("collection_path"), F.col("id").alias("version"), F.lit(T0).alias("commit_time"))
    cursors = spark.createDataFrame([("one", 70_000, T0 + timedelta(days=1))], "consumer string, seq long, updated_at timestamp_ntz")
    assert M.unseen_changes(feed, cursors, at).count() == 29_999
    looked = []
    real = M.differing_leaves
    monkeypatch.setattr(M, "stage", lambda df, name, keep=M.stage: (looked.append(name), keep(df, name))[1])
    monkeypatch.setattr(M, "differing_leaves", lambda *a: real(*a))
    assert M.unseen_changes(feed, cursors, at).count() == 0
    assert looked.count("differing") == 1 and "new" not in looked  # the top alone was compared


def test_a_cover_takes_few_nodes(spark):
    steps = spark.createDataFrame([("c", 5, 10**12, 1), ("c", 10**12, None, 2)], "consumer string, lo long, hi long, until long")
    low, high = 0, 10**11
    depth = M.depth_for(low, high, 64)
    cover, partial = M._covered(steps, low, high, depth, 128, 64)
    sizes = [c.count() for c in cover]
    assert sum(sizes) < 2 * 2 * 64 * (depth + 1) and partial.count() <= 4
    whole = sum(r["n"] * 64**level for level, c in enumerate(cover) for r in c.groupBy().count().select(F.col("count").alias("n")).collect())
    assert high - 2 <= whole <= high + 1


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        applicationId, master = "other-app", "yarn"
        getConf = staticmethod(lambda: {})

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.root(Session())


def test_parts_of_an_empty_table(spark):
    p = Parts(spark, "x long").replace(spark.range(0).select(F.col("id").alias("x"), F.lit(1).alias("part")), fresh(spark, "t"))
    assert p.folders == {} and p.read().count() == 0 and p.numbers() == set()


@pytest.mark.parametrize("seed", [1, 2])
def test_later_runs_give_what_is_new_to_each_consumer(spark, seed):
    """More changes, repeats, saves and a consumer that has started since: a later run gives what is unseen and not given yet."""
    import random

    from test_pipeline import plain_unseen, tidy

    rng = random.Random(seed)
    feed = tidy([(n, "modified", f"d{n % 7}", None, n, T0 + timedelta(seconds=n + (rng.randrange(-200, 200) if rng.random() < 0.1 else 0))) for n in range(1, 900) if rng.random() < 0.9])
    feed += [(r[0] + 3, *r[1:]) for r in feed if rng.random() < 0.1]
    saves = [(f"c{k % 3}", max(1, k * 12 - rng.randrange(60)), T0 + timedelta(seconds=k * 12)) for k in range(1, 70)]
    at, given = fresh(spark, "t"), set()
    for run, (upto, consumers) in enumerate(((300, {"c0"}), (300, {"c0", "c1"}), (640, {"c0", "c1"}), (950, {"c0", "c1", "c2"}))):
        part = [r for r in feed if r[0] <= upto]
        held = [s for s in saves if s[0] in consumers and s[1] <= upto]
        out = M.unseen_changes(spark.createDataFrame(part, FEED), spark.createDataFrame(held, "consumer string, seq long, updated_at timestamp_ntz"), at, 8, 4)
        got = [tuple(r) for r in out.collect()]
        assert len(got) == len(set(got)) and set(got) == plain_unseen(part, held) - given, run
        given |= set(got)
