"""Writes, transactions, feed, hooks, listeners, expiry, listing and rules over a store."""

import pytest
from helpers import NAN, arr, d, documents, i, mp, s, t

from lattica.database import open_database
from lattica.functions import values as V
from lattica.functions.paths import Pattern, PathError
from lattica.functions.values import Value
from lattica.operators.rules import Need, Rules
from lattica.operators.writes import DELETE, Batch, Delete, Document, Precondition, Set, Transform, Update, WriteError, apply, parse_write, transformed
from lattica.plans.ast import Cursor, Order, Query, QueryError
from lattica.queries import stores
from lattica.sources.shared import fresh
from lattica.streaming.feed import Hook, Hooks, follow


def run(writes, before=(), below=lambda p: []):
    docs = {x.path: x for x in before}
    return apply(writes, docs, below, 1000)


def doc(path, version=1, **fields):
    return Document(path, fields, 1, 1, version)


def after(write, **fields):
    return run([write], [doc("c/a", **fields)]).documents["c/a"].fields


def test_set_merge_and_deletions():
    out = run([Set("c/a", {"x": i(1)})])
    assert (out.changes[0].type, out.changes[0].version) == ("added", 1)
    assert after(Set("c/a", {"x": i(2)}), x=i(1), y=i(1)) == {"x": i(2)}
    assert after(Set("c/a", {"x": DELETE, "z": i(3)}, merge=True), x=i(1), y=i(1)) == {"y": i(1), "z": i(3)}
    assert after(Set("c/a", {"m": mp(x=DELETE, z=i(2))}, merge=True), m=mp(x=i(1), y=i(1))) == {"m": mp(y=i(1), z=i(2))}
    assert after(Set("c/a", {"m": mp(x=DELETE)}, merge=True), n=i(1)) == {"n": i(1)}
    assert after(Set("c/a", {"n": mp(x=DELETE)}, merge=True), n=i(1)) == {"n": i(1)}
    assert after(Set("c/a", {"n": mp()}, merge=True), n=i(1)) == {"n": mp()}
    assert after(Set("c/a", {"a.b": i(1)}, merge=True)) == {"a.b": i(1)}
    assert after(Set("c/a", {"m": mp(x=DELETE)}, merge=True), m=mp(x=i(1))) == {"m": mp()}


def test_masks_and_updates():
    assert after(Set("c/a", {"a": i(10)}, merge_fields=("a", "c")), a=i(1), b=i(2), c=i(3)) == {"a": i(10), "b": i(2)}
    assert after(Set("c/a", {"m": mp(x=i(9))}, merge_fields=("m.x",)), m=mp(x=i(1), y=i(2))) == {"m": mp(x=i(9), y=i(2))}
    assert after(Set("c/a", {"m": mp(z=i(9))}, merge_fields=("m",)), m=mp(x=i(1))) == {"m": mp(z=i(9))}
    assert after(Update("c/a", {"addr.city": s("B"), "gone": DELETE, "new.deep": i(1)}), addr=mp(city=s("A"), zip=s("1")),
        gone=i(1)) == {"addr": mp(city=s("B"), zip=s("1")), "new": mp(deep=i(1))}
    assert after(Update("c/a", {"x.y": DELETE}), x=i(1)) == {"x": i(1)}


def test_batches():
    out = run([Set("c/a", {"x": i(1)}), Update("c/a", {"x": i(2)})])
    assert [(c.type, c.version) for c in out.changes] == [("added", 2)]
    assert run([Set("c/a", {}), Delete("c/a")]).changes == []
    assert run([Delete("c/none")]).changes == []
    gone = run([Delete("o/x", cascade=True), Set("o/x/sub/new", {})], [doc("o/x"), doc("o/x/sub/s1"), doc("o/y")], lambda p: ["o/x/sub/s1"])
    assert [(c.type, c.path) for c in gone.changes] == [("removed", "o/x"), ("added", "o/x/sub/new"), ("removed", "o/x/sub/s1")]


@pytest.mark.parametrize(("write", "have", "status"), [
    (Update("c/a", {}), False, "NOT_FOUND"), (Set("c/a", {}, precondition=Precondition(exists=True)), False, "NOT_FOUND"),
    (Set("c/a", {}, precondition=Precondition(exists=False)), True, "ALREADY_EXISTS"),
    (Set("c/a", {}, precondition=Precondition(update_time=5)), True, "FAILED_PRECONDITION"),
    (Set("c/a", {}, precondition=Precondition(update_time=5)), False, "FAILED_PRECONDITION"),
    (Set("c/a", {"__x__": i(1)}), False, "INVALID_ARGUMENT"), (Set("c/a", {"x": s("y" * 1_048_576)}), False, "INVALID_ARGUMENT"),
])
def test_refusals(write, have, status):
    with pytest.raises(WriteError) as e:
        run([write], [doc("c/a")] if have else [])
    assert e.value.status == status


def test_depth_limit():
    v = i(1)
    for _ in range(19):
        v = mp(x=v)
    run([Set("c/a", {"x": v})])
    with pytest.raises(WriteError):
        run([Set("c/a", {"x": mp(x=mp(x=v))})])


@pytest.mark.parametrize(("existing", "kind", "operand", "result"), [
    (i(1), "increment", i(2), i(3)), (i(V.INT_MAX), "increment", i(1), i(V.INT_MAX)), (i(V.INT_MIN), "increment", i(-1), i(V.INT_MIN)),
    (i(1), "increment", d(0.5), d(1.5)), (None, "increment", i(2), i(2)), (s("x"), "increment", i(2), i(2)),
    (i(3), "maximum", d(3.0), i(3)), (i(3), "maximum", i(4), i(4)), (i(3), "minimum", d(2.5), d(2.5)), (d(NAN), "maximum", i(-5), i(-5)), (None, "minimum", i(1), i(1)),
    (arr(i(1), i(1)), "arrayUnion", arr(d(1.0), i(2), i(2)), arr(i(1), i(1), i(2))), (s("x"), "arrayUnion", arr(i(1)), arr(i(1))),
    (arr(i(1), d(1.0), i(2)), "arrayRemove", arr(i(1)), arr(i(2))), (None, "arrayRemove", arr(i(1)), arr()),
    (None, "serverTimestamp", None, Value("timestamp", 77)),
])
def test_transforms(existing, kind, operand, result):
    assert transformed(existing, Transform("f", kind, operand), 77) == result


def test_write_json():
    w = parse_write({"set": {"path": "c/a", "fields": {"x": {"integerValue": "1"}, "y": {"deleteField": True}}, "merge": True,
        "transforms": [{"field": "n", "kind": "increment", "operand": {"integerValue": "2"}}], "precondition": {"exists": True}}})
    assert w == Set("c/a", {"x": i(1), "y": DELETE}, True, None, (Transform("n", "increment", i(2)),), Precondition(exists=True))
    assert parse_write({"delete": {"path": "c/a", "cascade": True}}) == Delete("c/a", True)
    with pytest.raises(WriteError):
        parse_write({"set": {}, "delete": {}})


@pytest.fixture
def db(spark):
    return open_database(spark, fresh(spark, "db"))


def test_store_reads_its_writes_and_feeds(db):
    db.write(Batch().set("c/a", {"n": i(1)}).set("c/b", {"n": i(2)}).set("c/a/sub/x", {}).writes)
    first = db.get("c/a")
    db.write([Update("c/a", {"n": i(5)}), Delete("c/b")])
    again = db.get("c/a")
    assert (again.fields, again.version, again.created, db.get("c/b")) == ({"n": i(5)}, 2, first.created, None)
    assert [x and x.path for x in db.get_all(["c/b", "c/a"])] == [None, "c/a"]
    assert [(r["seq"], r["type"], r["document_path"], r["version"]) for r in db.store.changes().orderBy("seq").collect()] == [(1, "added", "c/a", 1),
        (2, "added", "c/a/sub/x", 1), (3, "added", "c/b", 1), (4, "modified", "c/a", 2), (5, "removed", "c/b", 1)]
    assert db.query({"collection": "c"}).documents == [again]
    assert db.count({"collection": "c"}) == 1
    assert db.aggregate({"collection": "c"}, [{"kind": "sum", "alias": "s", "field": "n"}]) == {"s": i(5)}
    assert db.list_collection_ids() == (["c"], None) and db.list_collection_ids("c/a") == (["sub"], None)
    added = db.add("c", {"n": i(9)})
    assert db.get(added.path).version == 1
    db.store.compact()
    assert db.count({"collection": "c"}) == 2 and db.get("c/a") == again
    db.write([Delete("c/a", cascade=True)])
    assert db.get("c/a/sub/x") is None


def test_failed_batch_leaves_nothing(db):
    with pytest.raises(WriteError):
        db.write([Set("c/a", {}), Update("c/none", {"x": i(1)})])
    assert db.get("c/a") is None and db.store.state()[1]["seq"] == 0


def test_transactions(db):
    db.write([Set("c/a", {"n": i(1)})])
    tid = db.begin()
    db.read_in(tid, ["c/a", "c/missing"])
    db.write([Update("c/a", {"n": i(2)})])
    with pytest.raises(WriteError) as e:
        db.commit(tid, [Update("c/a", {"n": i(3)})])
    assert e.value.status == "ABORTED"
    calls = []

    def body(tx):
        n = tx.get("c/a").fields["n"].v
        if not calls:
            db.write([Update("c/a", {"n": i(10)})])
        calls.append(n)
        tx.write(Update("c/a", {"n": i(n + 1)}))
        with pytest.raises(WriteError):
            tx.get("c/a")

    db.run_transaction(body)
    assert calls == [2, 10] and db.get("c/a").fields == {"n": i(11)}


def test_expired_transactions(spark):
    now = [0.0]
    db = open_database(spark, fresh(spark, "db"), clock=lambda: now[0])
    tid = db.begin()
    now[0] = 61
    with pytest.raises(WriteError):
        db.read_in(tid, ["c/a"])


def test_listeners(db):
    db.write([Set("c/a", {"n": i(1)})])
    q = Query("c", None, ())
    from lattica.plans.ast import Order

    q = Query("c", None, (Order("n"),))
    listener = db.listen(q)
    first = listener.take()
    assert [(c.type, c.new_index) for c in first.changes] == [("added", 0)]
    db.write([Set("c/b", {"n": i(0)})])
    db.pump()
    got = listener.take()
    assert [(c.type, c.document.path, c.old_index, c.new_index) for c in got.changes] == [("added", "c/b", -1, 0)]
    db.write([Update("c/a", {"n": i(-1)})])
    db.pump()
    assert [(c.type, c.document.path, c.old_index, c.new_index) for c in listener.take().changes] == [("modified", "c/a", 1, 0)]
    db.write([Delete("c/b")])
    db.write([Set("other/z", {})])
    db.pump()
    last = listener.take()
    assert [(c.type, c.document.path, c.old_index) for c in last.changes] == [("removed", "c/b", 1)] and last.gone == {"c/b"}
    db.write([Set("other/y", {})])
    db.pump()
    assert listener.take() is None
    assert db.listen(q, token=last.token).take().current
    one = db.listen_document("c/a")
    assert one.take().documents[0].path == "c/a"


def test_stream_hooks_resume(spark, db):
    calls = []

    class Log(Hook):
        def on_set(self, path, document, captures):
            calls.append(("set", path, captures["id"]))

        def on_update(self, path, document, captures):
            calls.append(("update", path, document.version))

        def on_delete(self, path, captures):
            calls.append(("delete", path))

    hooks, at = Hooks().add("c/{id}", Log()), fresh(spark, "feed")
    db.write([Set("c/a", {}), Set("d/x", {})])
    follow(db.store, hooks, at, start=0, once=True).awaitTermination()
    assert calls == [("set", "c/a", "a")]
    db.write([Update("c/a", {"n": i(1)})])
    db.write([Delete("c/a"), Set("c/b", {})])
    follow(db.store, hooks, at, start=0, once=True).awaitTermination()
    assert calls[1:] == [("delete", "c/a"), ("set", "c/b", "b")] or calls[1:] == [("update", "c/a", 2), ("delete", "c/a"), ("set", "c/b", "b")]


def test_expiry(db):
    at = Value("timestamp", 1_000_000)
    db.write([Set("s/old", {"e": at}), Set("s/old/k/child", {}), Set("s/new", {"e": Value("timestamp", 9_000_000)}), Set("s/none", {}),
        Set("s/text", {"e": s("x")}), Set("u/1/s/deep", {"e": at})])
    assert db.sweep("s", "e", now_us=5_000_000) == 2
    assert [db.get(p) is None for p in ("s/old", "s/old/k/child", "u/1/s/deep", "s/new", "s/none", "s/text")] == [True, True, True, False, False, False]


def test_bulk_load_and_prune(spark, db):
    from helpers import documents

    assert db.store.load(documents(spark, {f"c/{n:03d}": {"n": i(n)} for n in range(50)})) == 50
    assert db.count({"collection": "c"}) == 50
    assert sorted(r[0] for r in db.store.changes().select("seq").collect()) == list(range(1, 51))
    assert db.store.prune(2**60) == 51 and db.store.changes().count() == 0


def test_collection_pages(db):
    db.write([Set(f"c{n}/x", {}) for n in range(1, 6)])
    got, token = db.list_collection_ids(size=2)
    more, token2 = db.list_collection_ids(size=2, token=token)
    assert (got, more) == (["c1", "c2"], ["c3", "c4"]) and db.list_collection_ids(size=2, token=token2) == (["c5"], None)


def test_patterns():
    assert Pattern("users/{id}").match("users/a") == {"id": "a"} and Pattern("users/{id}").match("users/a/b/c") is None
    assert Pattern("a/{rest=**}").match("a/b/c/d") == {"rest": "b/c/d"}
    for bad in ("a/**", "{x=**}/b", "a//b"):
        with pytest.raises(PathError):
            Pattern(bad)


def test_rules(spark):
    mine = Rules().allow("notes/{id}", "read", lambda r: r.resource["owner"] == s(r.auth["uid"]), (Need("owner", "eq", lambda auth, c: s(auth["uid"])),)).allow(
        "notes/{id}", "create", lambda r: r.after["owner"] == s(r.auth["uid"]))
    path = fresh(spark, "db")
    ann, bob = (open_database(spark, path, rules=mine, auth={"uid": u}) for u in ("ann", "bob"))
    ann.write([Set("notes/1", {"owner": s("ann")})])
    assert ann.get("notes/1") is not None
    for call in (lambda: bob.get("notes/1"), lambda: bob.write([Set("notes/2", {"owner": s("ann")})]), lambda: ann.write([Delete("notes/1")]),
        lambda: ann.query({"collection": "notes"}),
                 lambda: bob.query({"collection": "notes", "where": {"field": "owner", "op": "eq", "value": {"stringValue": "ann"}}})):
        with pytest.raises(WriteError) as e:
            call()
        assert e.value.status == "PERMISSION_DENIED"
    q = {"collection": "notes", "where": {"field": "owner", "op": "eq", "value": {"stringValue": "ann"}}}
    assert len(ann.query(q).documents) == 1


def pages_in_turn(db, q):
    """The pages of a query one after another, each from the cursor at the last document of the one before."""
    out = []
    while True:
        got = db.query(q)
        out.append([x.path for x in got.documents])
        if not got.has_more:
            return out
        last = got.documents[-1]
        q = Query(q.collection, q.where, q.order_by, q.limit, start=Cursor.of_document(last.fields, last.path, q.order_by, before=False))


def test_walk_gives_the_pages_of_cursors(spark):
    db = open_database(spark, fresh(spark, "store"))
    kinds = [V.NULL, Value("boolean", True), d(NAN), i(2), d(1.5), Value("timestamp", 5), s("b"), s("a"), arr(i(1)), arr(i(1), s("x")), mp(a=i(1)), i(2)]
    db.store.load(documents(spark, {f"c/{n:02d}": {"f": v, "g": i(n)} for n, v in enumerate(kinds)} | {"c/bare": {"g": i(1)}, "c/00/c/deep": {"f": i(1)}, "other/x": {"f": i(1)}}))
    db.write([Set("c/new", {"f": i(2)}), Update("c/07", {"f": i(2)}), Delete("c/03")])
    for q in (Query("c", None, (Order("f"),), 4), Query("c", None, (Order("f", True),), 3), Query("c", t("gt", i(3), "g"), (Order("f"),), 2),
              Query("c", None, (Order("f"),), 2, start=Cursor((i(2),), False)), Query("c", None, (Order("f"),), 4, end=Cursor((s("b"),), False))):
        rows = sorted(db.walk(q, data=False).collect(), key=lambda r: r["place"])
        assert [r["place"] for r in rows] == list(range(len(rows))) and "data" not in rows[0]
        if q.end is None:
            want = pages_in_turn(db, q)
            assert len(want) > 1 and [[r["document_path"] for r in rows if r["page"] == n] for n in range(len(want))] == want
        else:
            assert {r["document_path"] for r in rows} == {r[0] for r in db.matching(q).select("document_path").collect()}
    whole = db.walk(Query("c", None, (Order("f"),), 4, select=("g",))).orderBy("place").first()
    assert (whole["place"], whole["page"], whole["data"]) == (0, 0, '{"g":{"integerValue":"0"}}')
    assert db.walk(Query("none", None, (Order("f"),), 4)).collect() == []
    for bad in (Query("c", None, (Order("f"),), 4, offset=1), Query("c", None, (Order("f"),), limit_to_last=4)):
        with pytest.raises(QueryError, match="PLACED_PAGE"):
            db.walk(bad)


def test_page_walk_sorts_once(spark, tmp_path):
    """More pages take no more jobs, each of which would look at the whole collection."""
    jobs = {}
    for pages in (1, 9):
        root, path = f"{tmp_path}/{pages}", lambda k: f"tenants/kestrel-works/orders/{k:05d}"
        docs = {path(k): {"placedAt": Value("timestamp", k * 7919 % 1000)} for k in range(1000 * pages)} | {path(99999): {"total": i(1)}}
        documents(spark, docs).write.parquet(f"{root}/winche_documents.parquet")
        stores._loaded(spark, root)
        spark.sparkContext.setJobGroup(f"walk {pages}", "")
        got = stores.QUERIES["store_page_walk"](spark, root).collect()
        jobs[pages] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"walk {pages}"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        want = sorted((f["placedAt"].v, p) for p, f in docs.items() if "placedAt" in f)
        assert [p for _, p in sorted(map(tuple, got))] == [p for _, p in want] and sorted(r["place"] for r in got) == list(range(1000 * pages))
    assert jobs[9] <= jobs[1] + 2, jobs
