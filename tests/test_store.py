"""The store at work: scans that prune, writes by the table, consumers, maintenance, options."""

import json
import random
from datetime import timedelta

import pytest
from helpers import documents, i, s
from pyspark.sql import functions as F

from lattica.database import Options, open_database
from lattica.functions import values as V
from lattica.functions.values import Value
from lattica.operators import writes as W
from lattica.operators.diff import frame_difference
from lattica.operators.lookup import rows_for
from lattica.operators.numbering import numbered_rows
from lattica.operators.writes import DELETE, Batch, Delete, Precondition, Set, Transform, Update, WriteError, parse_write, to_json
from lattica.plans.ast import Order, Query, Unary
from lattica.plans.compiler import matching
from lattica.plans.parser import parse_query
from lattica.sources.collections import TypedCollection
from lattica.sources.indexes import Index, IndexedCollections
from lattica.sources.shared import fresh
from lattica.sources.store import DocumentStore, PrunedError
from lattica.streaming.feed import Cursor, Hook, PartitionedHooks, catch_up, follow


@pytest.fixture
def db(spark):
    return open_database(spark, fresh(spark, "db"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def held(store):
    return {r["document_path"]: (r["version"], json.loads(r["data"])) for r in store.snapshot().collect()}


# ---- scans


def test_a_collection_is_read_from_its_partition(spark, db):
    db.store.load(documents(spark, {f"{c}/{n}": {"n": i(n)} for c in ("users", "posts", "users/1/notes") for n in range(5)}))
    found = matching(db.source(), parse_query({"collection": "users", "where": {"field": "n", "op": "gte", "value": {"integerValue": "3"}}}))
    text = plan(found)
    assert "PartitionFilters: [isnotnull(collection_id" in text and "collection_id#" in text and "StartsWith(document_path,users/)" in text
    assert "Aggregate" not in text and "Exchange" not in text  # rows written in bulk hold each path once
    assert found.count() == 2 and db.count({"collection": "users/1/notes"}) == 5
    db.write([Update("users/3", {"n": i(0)}), Delete("users/4"), Set("users/9", {"n": i(9)})])
    assert sorted(d.path for d in db.query({"collection": "users", "where": {"field": "n", "op": "gte", "value": {"integerValue": "3"}}}).documents) == ["users/9"]
    text = plan(matching(db.source(), parse_query({"collection": "users"})))
    assert text.count("PartitionFilters: [isnotnull(collection_id") == 3


def test_rows_in_bulk_and_commits_over_each_other(spark, db):
    db.store.load(documents(spark, {f"c/{n}": {"n": i(n)} for n in range(6)}))
    db.write([Delete("c/1"), Update("c/2", {"n": i(20)})])
    db.store.load(documents(spark, {"c/1": {"n": i(11)}, "d/1": {}}))
    db.write([Update("c/1", {"n": i(12)}), Delete("c/3")])
    want = {"c/0": 0, "c/1": 12, "c/2": 20, "c/4": 4, "c/5": 5}
    for _ in range(2):
        assert {d.path: d.fields["n"].v for d in db.query({"collection": "c"}).documents} == want
        db.store.compact()
        db.store.vacuum()
    assert db.store.changes().count() == 12 and len(db.store.state()[1]["changes"]) == 1


def test_typed_paths_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id AS k", "concat('x', id) AS name").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    at = lambda op, v: {"collection": "t", "where": {"field": "__name__", "op": op, "value": {"stringValue": v}}}
    by_number, by_text = TypedCollection("t", df, "k"), TypedCollection("t", df, "name")
    one = matching(by_number, parse_query(at("eq", "t/42")))
    assert "EqualTo(k,42)" in plan(one) and [r["k"] for r in one.collect()] == [42]
    assert [matching(by_number, parse_query(at("eq", p))).count() for p in ("t/042", "t/-0", "t/x", "u/42", "t/99999999999999999999", "t/+4", "t/100")] == [0] * 7
    assert matching(by_number, parse_query(at("ne", "t/42"))).count() == 99
    some = matching(by_text, parse_query(at("gte", "t/x95")))
    assert "GreaterThanOrEqual(name,x95)" in plan(some) and some.count() == 5
    assert matching(by_text, parse_query(at("lt", "t/x95"))).count() == 95 and matching(by_text, parse_query(at("gt", "s"))).count() == 100
    rows = rows_for(by_number, ["t/7", "t/none", "t/3"])
    assert [(r["pos"], r["k"]) for r in rows.collect()] == [(0, 7), (1, None), (2, 3)] and "In(k, [3,7])" in plan(rows)


def test_long_key_lists(spark, monkeypatch):
    from lattica.operators import lookup

    monkeypatch.setattr(lookup, "IN_FILTER", 3)
    src = TypedCollection("t", spark.range(10).withColumnRenamed("id", "k"), "k")
    assert [r["k"] for r in rows_for(src, ["t/1", "t/x", "t/9", "t/1", "t/0"]).collect()] == [1, None, 9, 1, 0]


def test_a_capped_count_does_not_sort(spark):
    from lattica.operators.aggregates import count_frame

    src = TypedCollection("t", spark.range(100).withColumnRenamed("id", "k"), "k")
    df = count_frame(src, parse_query({"collection": "t", "orderBy": [{"field": "k"}], "limit": 7}))
    assert df.first()[0] == 7 and "Sort" not in plan(df) and "TakeOrdered" not in plan(df)


# ---- numbering and differences


def test_numbered_rows(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"), F.lit(1).alias("g"))
    out, n = numbered_rows(df.repartition(13), ["x"], "at", 5)
    assert n == 1000 and all(r["at"] == r["x"] + 5 for r in out.collect())
    assert numbered_rows(df.limit(0), ["x"], "at")[1] == 0


def test_difference_with_places(spark):
    old = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("c", 3, 1)], "path string, n int, stamp int")
    new = spark.createDataFrame([("c", 0, 1), ("b", 2, 2), ("d", 9, 1)], "path string, n int, stamp int")
    got = {tuple(r) for r in frame_difference(old, new, "path", "stamp", ["n", "path"]).collect()}
    assert got == {("a", "removed", 0, -1), ("b", "modified", 1, 1), ("d", "added", -1, 2)}


# ---- writes by the table


def random_write(rng, path):
    value = lambda: rng.choice([i(rng.randrange(9)), s("x"), Value("map", {"k": i(rng.randrange(3))}), Value("array", (i(1), s("y"))), V.NULL])
    fields = {f: value() for f in rng.sample(["a", "b", "c"], rng.randrange(4))}
    transforms = tuple(rng.sample([Transform("n", "increment", i(2)), Transform("m.x", "maximum", V.double(1.5)),
        Transform("l", "arrayUnion", Value("array", (i(1),)))], rng.randrange(3)))
    kind = rng.randrange(6)
    if kind == 0:
        return Delete(path)
    if kind == 1:
        return Update(path, {**fields, "c.k": i(5), **({"b": DELETE} if rng.random() < 0.5 else {})} if "c" not in fields else fields, transforms)
    if kind == 2:
        return Set(path, {**fields, "gone": DELETE}, merge=True, transforms=transforms)
    if kind == 3:
        return Set(path, fields, merge_fields=("a", "c.k"), transforms=transforms)
    return Set(path, fields, transforms=transforms)


def test_a_table_of_writes_is_like_a_batch(spark):
    rng = random.Random(5)
    start = {f"c/{n}": {"a": i(n), "c": Value("map", {"k": i(1), "z": s("z")})} for n in range(0, 40, 2)}
    one, all_ = (DocumentStore(spark, fresh(spark, "db")) for _ in range(2))
    for st in (one, all_):
        st.load(documents(spark, start))
    writes = [random_write(rng, f"c/{n}") for n in range(40)]
    writes = [w if not isinstance(w, Update) or w.path in start else Set(w.path, {"a": i(1)}) for w in writes]
    one.commit(writes)
    last = all_.write_all(spark.createDataFrame([(json.dumps(to_json(w)),) for w in writes], "write string"))
    assert held(one) == held(all_) and last == one.state()[1]["seq"]
    feed = lambda st: {(r["type"], r["document_path"], r["version"]) for r in st.changes(len(start)).collect()}
    assert feed(one) == feed(all_)
    assert sorted(r["seq"] for r in all_.changes().collect()) == list(range(1, last + 1))


@pytest.mark.parametrize(("writes", "status"), [
    ([Set("c/a", {}), Update("c/none", {"x": i(1)})], "NOT_FOUND"), ([Set("c/have", {}, precondition=Precondition(exists=False))], "ALREADY_EXISTS"),
    ([Set("c/have", {}, precondition=Precondition(update_time=5))], "FAILED_PRECONDITION"),
    ([Set("c/a", {}), Set("c/a", {"x": i(1)})], "INVALID_ARGUMENT"), ([Delete("c/a", cascade=True)], "INVALID_ARGUMENT"),
    ([Set("c", {})], "INVALID_ARGUMENT"), ([Set("c/a", {"__x__": i(1)})], "INVALID_ARGUMENT"),
])
def test_a_table_of_writes_fails_whole(spark, db, writes, status):
    db.write([Set("c/have", {})])
    with pytest.raises(WriteError) as e:
        db.store.write_all(spark.createDataFrame([(json.dumps(to_json(w)),) for w in writes], "write string"))
    assert e.value.status == status and set(held(db.store)) == {"c/have"}
    assert db.store.write_all(spark.createDataFrame([], "write string")) == 1


@pytest.mark.parametrize("node", [
    None, [], {"set": {}, "delete": {}}, {"set": []}, {"set": {"path": 5}}, {"set": {"path": "a/b", "fields": []}},
    {"set": {"path": "a/b", "transforms": {}}}, {"set": {"path": "a/b", "transforms": [5]}},
    {"set": {"path": "a/b", "transforms": [{"kind": "increment"}]}}, {"set": {"path": "a/b", "transforms": [{"field": "x", "kind": "other"}]}},
    {"set": {"path": "a/b", "mergeFields": "x"}}, {"set": {"path": "a/b", "mergeFields": ["a..b"]}},
    {"set": {"path": "a/b", "merge": "yes"}}, {"delete": {"path": "a/b", "precondition": []}},
    {"delete": {"path": "a/b", "precondition": {"exists": 1}}}, {"delete": {"path": "a/b", "precondition": {"updateTime": "soon"}}},
    {"set": {"path": "a/b", "fields": {"x": {"integerValue": "x"}}}}, {"set": {"path": "a/b", "fields": {"x": 5}}},
    {"set": {"path": "a/b", "fields": {"x": {"mapValue": {"fields": []}}}}},
])
def test_malformed_writes_are_invalid(node):
    with pytest.raises(WriteError) as e:
        parse_write(node)
    assert e.value.status == "INVALID_ARGUMENT"


def test_writes_as_json():
    rng = random.Random(6)
    some = [random_write(rng, f"c/{n}") for n in range(200)] + [Delete("a/b", True, Precondition(True)),
        Set("a/b", {"m": Value("map", {"x": DELETE})}, merge=True, precondition=Precondition(update_time=77))]
    assert [parse_write(json.loads(json.dumps(to_json(w)))) for w in some] == some


def test_removing_below(spark, db, monkeypatch):
    from lattica.sources import store as S

    db.store.load(documents(spark, {p: {} for p in ("o/x", "o/x/sub/1", "o/x/sub/1/deep/2", "o/xx", "o/y", "o/y/sub/1")}))
    monkeypatch.setattr(S, "MAX_CASCADE", 1)
    with pytest.raises(WriteError):
        db.write([Delete("o/x", cascade=True)])
    assert db.store.remove_below("o/x") == 9 and set(held(db.store)) == {"o/xx", "o/y", "o/y/sub/1"}
    db.write([Delete("o/y", cascade=True)])
    db.write(Batch().set("o/z", {}).set("o/z/k/1", {}).writes)
    db.store.remove_below("o")
    assert held(db.store) == {}


# ---- feed and consumers


def test_a_pruned_place_is_an_error(spark, db):
    for n in range(4):
        db.write([Set(f"c/{n}", {})])
    second = db.store.changes().where("seq = 2").first()["commit_time"]
    from lattica.sources.store import us_of

    assert db.store.prune(us_of(second) + 1) == 3 and db.store.ends() == (3, 4)
    assert [r["seq"] for r in db.store.changes(2).orderBy("seq").collect()] == [3, 4]
    with pytest.raises(PrunedError):
        db.store.changes(1)
    with pytest.raises(Exception, match="no longer held"):
        follow(db.store, lambda *a: None, fresh(spark, "feed"), start=0, once=True).awaitTermination()


def test_named_consumers(spark, db):
    db.write([Set("c/0", {})])
    got, failing = [], [2]

    def handle(changes, docs):
        if failing[0]:
            failing[0] -= 1
            raise RuntimeError("busy")
        got.append(([r["seq"] for r in changes.orderBy("seq").collect()], sorted(r["document_path"] for r in docs.collect())))

    run = lambda **more: catch_up(db.store, "mail", handle, 2, backoff=(0.01, 0.02), **more)
    assert run() == 1 and got == []  # what was before the first start is not given
    for n in range(1, 4):
        db.write([Set(f"c/{n}", {})])
    db.write([Delete("c/3")])
    assert run() == 5 and got == [([2, 3], ["c/1", "c/2"]), ([4, 5], [])]
    assert run() == 5 and len(got) == 2
    db.write([Set("c/9", {})])
    failing[0] = 9
    with pytest.raises(RuntimeError):
        run(attempts=3)
    assert Cursor(db.store, "mail").get() == 5
    failing[0] = 0
    assert run() == 6 and got[-1] == ([6], ["c/9"])
    assert Cursor(db.store, "mail").save(3) == 6


def test_durable_and_other_streams(spark, db):
    db.write([Set("c/1", {})])
    tries, at = [], fresh(spark, "feed")

    def flaky(changes, docs):
        tries.append(changes.count())
        if len(tries) < 3:
            raise RuntimeError("busy")

    follow(db.store, flaky, at, start=0, once=True, attempts=5, backoff=(0.01, 0.01)).awaitTermination()
    assert tries == [1, 1, 1]
    tries.clear()
    follow(db.store, flaky, fresh(spark, "feed"), start=0, once=True, durable=False).awaitTermination()
    assert tries == [1]


def test_hooks_on_the_executors(spark, db, tmp_path):
    import os
    import uuid

    class Log(Hook):
        def __init__(self, folder):
            self.folder = folder

        def _say(self, *said):
            with open(os.path.join(self.folder, uuid.uuid4().hex), "w") as f:
                f.write(" ".join(map(str, said)))

        def on_set(self, path, document, captures):
            self._say("set", path, captures["id"], document.version)

        def on_delete(self, path, captures):
            self._say("delete", path)

    db.write([Set(f"c/{n}", {"n": i(n)}) for n in range(6)] + [Set("d/1", {})])
    db.write([Delete("c/3")])
    hooks = PartitionedHooks().add("c/{id}", Log(str(tmp_path)))
    follow(db.store, hooks, fresh(spark, "feed"), start=0, once=True).awaitTermination()
    said = sorted((tmp_path / f).read_text() for f in os.listdir(tmp_path))
    assert said == sorted(["delete c/3", *[f"set c/{n} {n} 1" for n in (0, 1, 2, 4, 5)]])


def test_one_failing_group_does_not_stop_the_others(db, monkeypatch):
    from lattica import database as D

    monkeypatch.setattr(D, "MAX_FAILURES", 2)
    bad, good = db.listen(Query("bad", None, ())), db.listen(Query("good", None, ()))
    bad.take(), good.take()
    real = db._page
    monkeypatch.setattr(db, "_page", lambda q: (_ for _ in ()).throw(RuntimeError("lost")) if q.collection == "bad" else real(q))
    db.write([Set("bad/1", {}), Set("good/1", {})])
    db.pump()
    assert [d.path for d in good.take().documents] == ["good/1"] and bad.take() is None
    monkeypatch.setattr(db, "_page", real)
    db.pump()
    assert [d.path for d in bad.take().documents] == ["bad/1"]  # its place had stayed
    monkeypatch.setattr(db, "_page", lambda q: (_ for _ in ()).throw(RuntimeError("lost")))
    db.write([Set("bad/2", {})])
    db.pump(), db.pump()
    with pytest.raises(RuntimeError):
        bad.take()
    good.close()
    db.pump()
    assert db._groups == {}


# ---- options


def test_indexes_are_chosen_and_go_stale(spark):
    db = open_database(spark, fresh(spark, "db"), options=Options(indexes=(Index("c", (Order("n"),), Unary("exists", "n")),)))
    db.store.load(documents(spark, {f"c/{n}": {"n": i(n)} if n % 2 else {} for n in range(20)}))
    q = parse_query({"collection": "c", "where": {"field": "n", "op": "gt", "value": {"integerValue": "10"}}})
    assert not isinstance(db.source(q), IndexedCollections)
    db.maintain()
    assert isinstance(db.source(q), IndexedCollections) and db.count(q) == 5
    assert "__f0_num" in plan(db.matching(q)) and "from_json" not in plan(db.matching(q))
    for other in ({"collection": "c"}, {"collection": "d", "orderBy": [{"field": "n"}]},
        {"collection": "c", "where": {"not": {"field": "n", "op": "gt", "value": {"integerValue": "1"}}}}):
        assert not isinstance(db.source(parse_query(other)), IndexedCollections)
    db.write([Update("c/1", {"n": i(99)})])
    assert not isinstance(db.source(q), IndexedCollections) and db.count(q) == 6
    db.build_indexes()
    assert isinstance(db.source(q), IndexedCollections) and db.count(q) == 6


def test_filtered_indexes_are_chosen_where_the_query_implies_their_filter(spark):
    from lattica.plans.ast import And, Test

    large = And((Test("n", "gte", i(10)), Unary("exists", "n")))
    db = open_database(spark, fresh(spark, "db"), options=Options(indexes=(Index("c", (Order("n"),), large),)))
    db.store.load(documents(spark, {f"c/{n}": {"n": i(n), "m": i(n % 3)} for n in range(20)}))
    db.build_indexes()
    where = lambda *tests: parse_query({"collection": "c", "where": {"and": [{"field": f, "op": op, "value": {"integerValue": str(v)}} for f, op, v in tests]}})
    for q, chosen, many in ((where(("n", "gt", 10)), True, 9), (where(("n", "gte", 10), ("m", "eq", 0)), True, 3), (where(("n", "eq", 12)), True, 1),
        (where(("n", "gt", 8)), False, 11), (where(("m", "eq", 0)), False, 7), (where(("n", "lt", 12)), False, 12)):
        assert isinstance(db.source(q), IndexedCollections) is chosen and db.count(q) == many, q


def test_expiry_retention_and_limits(spark):
    db = open_database(spark, fresh(spark, "db"), options=Options(ttl=(("s", "e"),), retention=timedelta(0), max_bytes=200, max_depth=2))
    db.write([Set("s/old", {"e": Value("timestamp", 1_000_000)}), Set("s/old/k/1", {}), Set("s/new", {"e": Value("timestamp", 9_000_000)})])
    with pytest.raises(WriteError):
        db.write([Set("s/big", {"x": s("y" * 200)})])
    with pytest.raises(WriteError):
        db.write([Set("s/deep", {"x": Value("map", {"y": Value("map", {"z": Value("map", {})})})})])
    db.maintain(5_000_000)
    assert set(held(db.store)) == {"s/new"} and db.store.ends() == (1, 5)
    db.maintain()  # the removal of what has expired by now is the newest change and stays
    assert held(db.store) == {} and db.store.ends() == (6, 6)


