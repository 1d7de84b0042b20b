"""Problems 1 to 5 on small tables: nulls, repeats, ties, empty tables, clashing names, failures, later runs."""

import json
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lattica.operators import changes as C
from lattica.operators import merkle as M
from lattica.operators import nested as N
from lattica.operators import orphans as O
from lattica.operators import skew as S
from lattica.sources.shared import Conflict, Versions, fresh, stage

T0 = datetime(2025, 3, 1)
DOCS = "document_path string, document_id string, collection_path string, collection_id string, data string, created_at timestamp_ntz, updated_at timestamp_ntz, version long"
FEED = "seq long, type string, document_path string, collection_path string, version long, commit_time timestamp_ntz"


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def doc(path, fields=None, version=1, created=0, updated=None, cid="x", data=...):
    at = lambda n: None if n is None else T0 + timedelta(seconds=n)
    text = json.dumps(fields or {}) if data is ... else data
    return (path, None, None, cid, text, at(created), at(created if updated is None else updated), version)


# ---- 1


def test_salted_aggregate_equals_plain(spark):
    rng = random.Random(1)
    data = [("hot" if rng.random() < 0.5 else None if rng.random() < 0.1 else f"k{rng.randrange(30)}",
        rng.choice(["a", "b", None, f"p{rng.randrange(200)}"]), rng.choice([1, 2, None])) for _ in range(3000)]
    df = spark.createDataFrame(data, "key string, path string, version int").withColumn("__salt", F.lit(1)).withColumn("rows", F.lit("x")).withColumn("__k", F.lit(2))
    measures = {"rows": ("count", None), "low": ("min", "version"), "high": ("max", "version"), "total": ("sum", "version")}
    got = S.salted_aggregate(df, "key", measures, {"paths": ["path"], "versions": ["path", "version"]}, share=0.1, salts=16)
    want = df.groupBy("key").agg(F.count("*"), F.min("version"), F.max("version"), F.sum("version"), F.countDistinct("path"), F.countDistinct("path", "version"))
    assert rows(got) == rows(want)
    assert rows(S.salted_aggregate(df, "key", measures, share=0.1)) == rows(want.select(*want.columns[:5]))
    assert got.columns == ["key", "rows", "low", "high", "total", "paths", "versions"]
    assert S.salted_aggregate(df.limit(0), "key", measures).count() == 0
    heavy = S.heavy_keys(df, [F.col("key")], 0.1)
    assert [h[0] for h in heavy] == ["hot"]
    spread = S.with_salt(df.select("key", "path"), ["key"], heavy, ["path"], 16).where("key = 'hot'")
    assert spread.select("__salt").distinct().count() > 4 and spread.groupBy("path").agg(F.countDistinct("__salt").alias("n")).where("n > 1").count() == 0
    with pytest.raises(ValueError):
        S.salted_aggregate(df, "key", {}, {"a": ["path"], "b": ["version"]})


def test_frequent_keys(spark):
    df = spark.createDataFrame([("a",)] * 5 + [("b",)] * 4 + [(None,)] * 91, "key string")
    assert rows(S.frequent_keys(df, "key", 0.05)) == {("a",): 1}
    assert S.frequent_keys(df.limit(0), "key", 0.05).count() == 0


@pytest.mark.parametrize("how", ["left_anti", "left_semi", "inner", "left"])
def test_skew_join_equals_plain(spark, how):
    rng = random.Random(2)
    left = spark.createDataFrame([(("hot" if rng.random() < 0.4 else rng.choice([None, *"abcdef"])), n) for n in range(400)], "k string, n int")
    right = spark.createDataFrame([(k, m) for k in ["hot", "a", "b", "b", None] for m in (10, 300)], "rk string, m int")
    cond = F.col("r.m") > F.col("l.n")
    got = S.skew_join(left, right, [("k", "rk")], how, cond, share=0.2, salts=8)
    want = left.alias("l").join(right.alias("r"), (F.col("l.k") == F.col("r.rk")) & cond, how)
    assert rows(got) == rows(want)


def test_equal_rows_of_a_heavy_key_are_spread(spark):
    left = spark.range(4000).select(F.lit("hot").alias("k"), F.lit(1).alias("x")).repartition(3)
    right = spark.createDataFrame([("hot", 5), ("cold", 6)], "r string, y int")
    spread = S.with_salt(S.with_place(left), ["k"], S.heavy_keys(left, [F.col("k")]), ["__place"])
    counts = [r["count"] for r in spread.groupBy("__salt").count().collect()]
    assert len(counts) > 400 and max(counts) < 40
    assert S.skew_join(left, right, [("k", "r")], "inner").count() == 4000 and S.skew_join(left, right, [("k", "r")], "left_anti").count() == 0
    assert S.skew_join(left, right.where("y = 6"), [("k", "r")], "left_anti").columns == ["k", "x"]


# ---- 2


def tagged(x):
    if isinstance(x, dict):
        return {"mapValue": {"fields": {k: tagged(v) for k, v in x.items()}}}
    if isinstance(x, list):
        return {"arrayValue": {"values": [tagged(v) for v in x]}}
    return {"nullValue": None} if x is None else {"stringValue": x}


def plain_cases(x, at="", parent="", element=False):
    """(parent, child) pointers of maps in arrays, by plain recursion."""
    if isinstance(x, dict):
        if element:
            yield parent, at
            parent = at
        for k, v in x.items():
            yield from plain_cases(v, f"{at}.{k}" if at else k, parent)
    elif isinstance(x, list):
        for n, v in enumerate(x):
            yield from plain_cases(v, f"{at}[{n}]", parent, True)


JSONS = st.recursive(st.none() | st.text(max_size=3), lambda c: st.lists(c,
    max_size=4) | st.dictionaries(st.sampled_from(["a", "b c", "mapValue", "ü"]), c, max_size=3), max_leaves=25)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.sampled_from(["x", "values", "arrayValue"]), JSONS, max_size=4))
def test_labels_and_links(doc_):
    nodes, sizes = N.walk({k: tagged(v) for k, v in doc_.items()})
    labels = N.intervals(nodes, sizes)
    assert sorted(p for _, p in labels) == list(range(len(nodes)))
    for n, (parent, *_) in enumerate(nodes):  # containment is ancestry
        up, ancestors = parent, set()
        while up >= 0:
            ancestors.add(up)
            up = nodes[up][0]
        assert ancestors == {a for a, (pre, post) in enumerate(labels) if pre < labels[n][0] and post > labels[n][1]}
    kept = [n for n, x in enumerate(nodes) if N.is_element_map(x)]
    ups = N.nearest_enclosing([labels[n] for n in kept])
    got = {(nodes[kept[u]][4] if u >= 0 else "", nodes[n][4]) for n, u in zip(kept, ups)}
    assert got == set(plain_cases(doc_))


def test_current_rows_and_element_maps(spark):
    data = [
        doc("a/1", {"items": tagged([{}, {"x": "y"}])}, 2), doc("a/1", {"items": tagged([{}])}, 1), doc("a/1", {"items": tagged([{}, {"x": "y"}])}, 2, cid=None),
        doc("a/2", data=None), doc("a/3", data='{"items":{"arrayValue":{"values":[{"mapValue"'),
        doc("a/4", {"items": {"arrayValue": {}}, "m": tagged({"k": "v"}), "n": {"arrayValue": {"values": [{"mapValue": {}}]}}}),
        doc("a/5", data="[1]"), doc("a/6", data=""), doc(None, {"items": tagged([{}])}), doc("a/7", {"x": tagged("y" * 200_000)}), doc("a/8", {"i": tagged([{}])}, None),
    ]
    df = spark.createDataFrame(data, DOCS).withColumn("pre", F.lit(1)).withColumn("__top", F.lit(1))
    current = N.current_rows(df, "document_path", "version", "collection_id", "data")
    assert {r[0]: r[2] for r in current.collect()} == {f"a/{n}": "x" for n in range(1, 9)}
    got = rows(N.element_maps(current).select("document_path", "parent_pointer", "pointer"))
    assert got == {("a/1", "", "items[0]"): 1, ("a/1", "", "items[1]"): 1, ("a/4", "", "n[0]"): 1, ("a/8", "", "i[0]"): 1}
    nodes = N.node_table(current)
    assert nodes.where("kind = 'document'").count() == 8
    assert N.element_maps(current.limit(0)).count() == 0 and N.node_table(current.limit(0)).count() == 0
    inside = N.contained(nodes.where("kind = 'arrayValue'"), nodes.where("kind = 'mapValue'"))
    assert inside.count() == 4


def test_flat_tables(spark):
    fields = {"n": tagged("x"), "address": tagged({"city": "y", "geo": {"deep": "z"}}),
        "items": tagged([{"a": "1", "opts": [{"b": "2"}, "plain", [{"b": "3"}]]}, {}]), "gone": {"nullValue": None},
        "point": {"geoPointValue": {"latitude": 1, "longitude": 2}}, "i": {"integerValue": 5}}
    got = {r[5]: (r[0], r[2], r[3], r[4], r[5], *r[6:]) for r in N.flatten(json.dumps(fields))}
    assert got[""][5] == {"n": "x", "address.city": "y", "address.geo.deep": "z", "gone": None, "point": '{"latitude": 1, "longitude": 2}',
        "i": "5"} and got[""][6]["i"] == "integerValue"
    assert [(p, r[0], r[5]) for p, r in got.items() if p] == [
        ("items[0]", "items[]", {"a": "1"}), ("items[0].opts[0]", "items[].opts[]", {"b": "2"}),
        ("items[0].opts[1]", "items[].opts[]", {"value": "plain"}), ("items[0].opts[2][0]", "items[].opts[][]", {"b": "3"}), ("items[1]", "items[]", {})]
    assert got["items[0].opts[2][0]"][3] == got["items[0]"][1] and got["items[1]"][3] == got[""][1] == 0 and got[""][3] == -1
    df = spark.createDataFrame([doc("a/1", fields), doc("a/2", data=None), doc("a/3", data="{")], DOCS).withColumn("fields", F.lit(1))
    rows_ = N.flat_rows(df)
    assert rows_.where("table_name = ''").count() == 3 and rows_.count() == 8
    assert rows(N.flat_table(rows_, "items[]", {"a": "a", "none": "x"}).select("pointer", "a", "none")) == {("items[0]", "1", None): 1, ("items[1]", None, None): 1}
    assert N.flat_rows(df.limit(0)).count() == 0


def test_escaped_tags_count(spark):
    text = '{"i":{"array\\u0056alue":{"values":[{"mapValue":{}}]}},"r":{"\\u0072eferenceValue":"a/none"}}'
    df = spark.createDataFrame([doc("a/1", data=text)], DOCS)
    assert rows(N.element_maps(df).select("pointer")) == {("i[0]",): 1}
    assert rows(O.document_orphans(df).select("target_path")) == {("a/none",): 1}


def test_very_deep_documents(spark):
    deep = "x"
    for _ in range(300):
        deep = [{"a": deep}]
    df = spark.createDataFrame([doc("a/1", {"f": tagged(deep)}), doc("a/2", data='{"f":' + '{"arrayValue":{"values":[' * 50_000)], DOCS)
    assert N.element_maps(df).count() == 300


def test_deep_json_is_read_as_json_is():
    rng = random.Random(2)

    def value(depth):
        if depth and rng.random() < 0.5:
            return [value(depth - 1) for _ in range(rng.randrange(3))]
        if depth and rng.random() < 0.5:
            return {f"k{k}": value(depth - 1) for k in range(rng.randrange(3))}
        return rng.choice([None, True, -1.5e-3, 10**20, 'q"\\\u00e9\n', "", 0])

    for _ in range(300):
        v = value(4)
        for text in (json.dumps(v), json.dumps(v, indent=1), json.dumps(v, ensure_ascii=False, separators=(",", ":"))):
            assert N._parse_deep(text) == v
    for bad in ("", "[", "[1", "[1,]", "{,}", '{"a"}', '{"a":}', '{"a":1,}', "[1 2]", "1 2", "]", '{"a":1]', "nul", '"a', "[}", "{1:2}", '{"a":1 "b":2}', "01", "[1]]"):
        with pytest.raises(ValueError):
            N._parse_deep(bad)
    deep = '{"f":' + '{"arrayValue":{"values":[' * 30_000 + '{"mapValue":{}}' + "]}}" * 30_000 + "}"
    nodes, _ = N.walk(N.parse(deep))
    assert len(nodes) == 30_002 and nodes[-1][1] == 30_001


# ---- 3


def plain_live(feed):
    known, last = {}, {}
    for seq, kind, path, _, version, at in feed:
        if path is not None and seq is not None:
            key = (kind, path, version, at)
            known[key] = min(seq, known.get(key, seq))
    for (kind, path, version, _), seq in known.items():
        last[path] = max(last.get(path, (-1,)), (seq, version if version is not None else -1, kind or "", version))
    return {(p, v, s) for p, (s, _, k, v) in last.items() if k != "removed"}


def random_feed(rng, n, docs=12):
    out = []
    for _ in range(n):
        row = (rng.randrange(1, 500), rng.choice(["added", "modified", "modified", "removed"]),
            "hot" if rng.random() < 0.3 else f"d{rng.randrange(docs)}", rng.choice(["c", None]), rng.randrange(1, 5), T0 + timedelta(seconds=rng.randrange(50)))
        out.append(row)
        if rng.random() < 0.3:
            out.append((row[0] + rng.randrange(0, 300), *row[1:3], None, *row[4:]))
    return out


def tidy(feed):
    """One change for a seq, as a feed has it."""
    first = {}
    for r in feed:
        first.setdefault(r[0], (r[1], r[2], r[4], r[5]))
    return [r for r in feed if first[r[0]] == (r[1], r[2], r[4], r[5])]


@pytest.mark.parametrize("seed", [1, 2])
def test_changes_in_any_order_and_several_runs(spark, seed):
    feed = tidy(random_feed(random.Random(seed), 400))
    frame = lambda part: spark.createDataFrame(part, FEED).withColumn("latest", F.lit(1))
    at = fresh(spark, "t3")
    once = C.apply_changes(spark, frame(feed), at, 3)
    assert {tuple(r) for r in once.collect()} == plain_live(feed)
    random.Random(9).shuffle(feed)
    steps = fresh(spark, "t3")
    for k in range(3):
        out = C.apply_changes(spark, frame(feed[k::3]), steps, 2)
    assert {tuple(r) for r in out.collect()} == plain_live(feed)
    assert {tuple(r) for r in C.apply_changes(spark, frame(feed[:50]), steps, 2).collect()} == plain_live(feed)
    assert {tuple(r) for r in C.apply_changes(spark, frame([feed[0]]).limit(0), steps, 2).collect()} == plain_live(feed)


def test_local_tables_are_put_out_when_full(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(C, "FLUSH", 10)
    rng = random.Random(3)
    feed = [(f"d{rng.randrange(40)}", "added", n, n) for n in range(500)]
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*part)], ["document_path", "type", "version", "seq"])
    want = {p: s for p, _, _, s in feed}
    for most in (None, 1, 7, 1000):
        out = [r for b in C._upsert((batch(feed[k : k + 13]) for k in range(0, 500, 13)), most) for r in b.to_pylist()]
        assert {p: max(r["seq"] for r in out if r["document_path"] == p) for p in want} == want
        assert most is not None and most < 40 or len(out) == len(want)


def test_changes_with_nulls_and_tombstones(spark):
    feed = [(1, "added", "a", None, 1, T0), (2, "removed", "a", None, 1, T0), (3, None, "b", None, None, None), (4, None, "b", None, None, None),
        (None, "added", "c", None, 1, T0), (5, "added", None, None, 1, T0)]
    at = fresh(spark, "t3")
    got = C.apply_changes(spark, spark.createDataFrame(feed, FEED), at)
    assert {tuple(r) for r in got.collect()} == {("b", None, 3)}
    late = C.apply_changes(spark, spark.createDataFrame([(1, "modified", "a", None, 1, T0 - timedelta(1))], FEED), at)
    assert {tuple(r) for r in late.collect()} == {("b", None, 3)}
    assert C.apply_changes(spark, spark.createDataFrame([], FEED), fresh(spark, "t3")).count() == 0


def test_a_failed_run_publishes_nothing(spark, monkeypatch):
    at = fresh(spark, "t3")
    C.apply_changes(spark, spark.createDataFrame([(1, "added", "a", None, 1, T0)], FEED), at)
    monkeypatch.setattr(C, "upsert_latest", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        C.apply_changes(spark, spark.createDataFrame([(2, "removed", "a", None, 1, T0)], FEED), at)
    assert C.live_documents(spark, at).count() == 1
    versions = Versions(spark, at)
    number, manifest = versions.latest()
    versions.publish(number, manifest)
    with pytest.raises(Conflict):
        versions.publish(number, manifest)


# ---- 4


def test_match_rules(spark):
    refs = spark.createDataFrame([(1, "a", "x"), (2, "a", None), (3, None, "z"), (4, None, None), (5, "b", "x"), (5, "b", "x")], "n int, p string, q string")
    targets = spark.createDataFrame([("a", "x"), ("a", "y"), (None, "z")], "tp string, tq string")
    ids = lambda match, t=targets: sorted(r["n"] for r in O.orphans(refs, t, [("p", "tp"), ("q", "tq")], match).collect())
    assert ids("simple") == [5, 5]
    assert ids("partial") == [5, 5]
    assert ids("full") == [2, 3, 5, 5]
    assert ids("exact") == [2, 4, 5, 5]
    assert ids("partial", targets.where("tq = 'y'")) == [1, 3, 5, 5]
    assert ids("exact", targets.limit(0)) == [1, 2, 3, 4, 5, 5]
    assert O.orphans(refs.limit(0), targets, [("p", "tp")]).count() == 0
    with pytest.raises(ValueError):
        O.orphans(refs, targets, [("p", "tp")], "other")


def test_document_orphans(spark):
    ref = lambda t: {"referenceValue": t}
    data = [
        doc("u/1", {"x": ref("u/2")}, created=10), doc("u/2", {}, created=20), doc("u/2", {"old": ref("u/none")}, 0),
        doc("u/3", {"x": ref("u/1"), "deep": {"arrayValue": {"values": [{"mapValue": {"fields": {"r": ref("U/1")}}}, ref("noslash"), ref("")]}},
        "s": {"stringValue": "u/none"}, "referenceValue": {"stringValue": "u/no"}}, created=30, cid=None),
        doc("u/1/sub/a", {}, created=5), doc("u/9/sub/b", {}, created=50), doc("u/4", {"x": ref("u/5")}, created=1, updated=99),
        doc("u/5", {}, created=99), doc("u/6", {"x": ref("u/5")}, created=None), doc("noslash/x/y", {}),
    ]
    df = spark.createDataFrame(data + data[:1], DOCS).withColumn("target_path", F.lit("u/1"))
    found = O.document_orphans(df)
    assert rows(found.select("document_path", "target_path")) == {k: 1 for k in [("u/1", "u/2"), ("u/3", "U/1"), ("u/3", "noslash"), ("u/3", ""),
        ("u/1/sub/a", "u/1"), ("u/9/sub/b", "u/9"), ("u/6", "u/5"), ("noslash/x/y", "noslash")]}
    report = {(r[0], r[1]): r[2] for r in O.orphan_report(found).collect()}
    assert report[(None, "2025-03")] == 3 and sum(report.values()) == 8
    assert O.document_orphans(df.limit(0)).count() == 0


def test_a_target_most_rows_name(spark):
    data = [doc(f"u/{n}", {"x": {"referenceValue": "hot/none" if n % 2 else "hot/is"}}, created=5) for n in range(400)] + [doc("hot/is", {})]
    assert O.document_orphans(spark.createDataFrame(data, DOCS)).count() == 200


# ---- 5


def plain_unseen(feed, cursors):
    known = {}
    for seq, kind, path, _, version, at in feed:
        if path is not None and seq is not None:
            known[(kind, path, version, at)] = min(seq, known.get((kind, path, version, at), seq))
    saves = defaultdict(list)
    for who, seq, at in cursors:
        if seq is not None and who is not None:
            saves[who].append((at, seq))
    out = set()
    for who, mine in saves.items():
        for (_, _, _, at), seq in known.items():
            fit = [t for t, s in mine if s >= seq]
            if not fit or at is None or not at <= min(fit):
                out.add((who, seq))
    return out


@pytest.mark.parametrize(("seed", "width", "fanout"), [(1, 4, 2), (2, 8, 4), (3, 128, 64), (4, 5, 4)])
def test_unseen_changes(spark, seed, width, fanout):
    rng = random.Random(seed)
    feed = tidy([(n, "modified", f"d{n % 7}", None, n, None if rng.random() < 0.01 else T0 + timedelta(seconds=n + (rng.randrange(-200,
        200) if rng.random() < 0.1 else 0))) for n in range(1, 600) if rng.random() < 0.9])
    feed += [(r[0] + 3, *r[1:]) for r in feed if rng.random() < 0.1]
    cursors = [(f"c{rng.randrange(4)}", None if rng.random() < 0.1 else max(1, k * 12 - rng.randrange(60)),
        T0 + timedelta(seconds=k * 12)) for k in range(1, 45)] + [("null-only", None, T0), (None, 5, T0), ("ahead", 9999, T0 + timedelta(days=1)),
        ("first", 1, T0 - timedelta(days=1))]
    cursors += cursors[:3]
    f, c = spark.createDataFrame(feed, FEED).withColumn("consumer", F.lit("x")), spark.createDataFrame(cursors, "consumer string, seq long, updated_at timestamp_ntz")
    at = fresh(spark, "t5")
    got = M.unseen_changes(f, c, at, width, fanout)
    assert rows(got) == {k: 1 for k in plain_unseen(feed, cursors)}
    assert M.unseen_changes(f, c, at, width, fanout).count() == 0  # each once
    assert M.unseen_changes(f.limit(0), c, fresh(spark, "t5")).count() == 0
    assert M.unseen_changes(f, c.limit(0), fresh(spark, "t5")).count() == 0


def test_incremental_runs_skip_and_repeat_nothing(spark):
    at = fresh(spark, "inc")
    base = spark.createDataFrame([(n, f"v{n}") for n in range(500)] + [(None, "no key"), (3, "v3")], "k long, digest string")
    run = lambda df, process=lambda x: x: M.process_new(spark, df, "k", at, process, 8, 4)
    assert run(base).count() == 500
    assert run(base).count() == 0
    later = base.where("k is null or k <> 77").unionByName(spark.createDataFrame([(77, "changed"), (1000, "new"), (-5, "early"), (3, None)], "k long, digest string"))

    def broken(df):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        run(later, broken)
    assert rows(run(later)) == {(77, "changed"): 1, (1000, "new"): 1, (-5, "early"): 1, (3, None): 1}
    assert run(later).count() == 0 and run(later.limit(0)).count() == 0 and run(later).count() == 0


def test_only_differing_leaves_are_found(spark):
    rows_ = spark.range(4000).select(M.leaf_of(F.col("id"), 8).alias("leaf"), M.row_digest("id").alias("digest"))
    saved = M.leaves(rows_.where("leaf not in (3, 499)"))
    depth = M.depth_for(0, 499, 4)
    found = M.differing_leaves(M.tree(M.leaves(rows_), depth, 4), M.tree(saved, depth, 4), 4)
    assert rows(found) == {(3,): 1, (499,): 1}


# ---- shared folder


def test_stage_uses_the_shared_folder(spark):
    df = stage(spark.range(10).withColumn("x", F.lit(None).cast("string")), "t")
    assert df.count() == 10 and "lattica-" in df.inputFiles()[0]
