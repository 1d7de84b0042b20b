"""What a store does with whole tables: writes, feed, expiry, removal, listing, consumers, listeners, with SQL for the same results."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.database import Database, Options, open_database
from lattica.functions import values as V
from lattica.functions.fields import TaggedField
from lattica.functions.values import Value, micros
from lattica.operators.diff import frame_difference
from lattica.operators.lookup import rows_for
from lattica.operators.writes import DELETE, Delete, Set, Transform, Update, to_json
from lattica.plans.ast import Order, Query, Unary
from lattica.plans.compiler import matching
from lattica.plans.parser import parse_query
from lattica.queries.engine import ORDERS, SQL as ENGINE_SQL, stored
from lattica.queries.pipeline import CURRENT
from lattica.sources.collections import tagged_at
from lattica.sources.indexes import Index
from lattica.sources.shared import fresh
from lattica.sources.tables import table
from lattica.streaming.feed import catch_up

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_text, _number = (lambda x: Value("string", x)), V.integer
_map = lambda **fields: Value("map", fields)
#: What is written to the documents of a collection id; to all others a plain set.
_WRITES = {
    "orders": lambda p: Update(p, {"status": _text("done"), "delivery.address.city": _text("Kelpford"), "coupon": DELETE},
                               (Transform("touched", "increment", _number(2)), Transform("total", "maximum", V.double(100.0)), Transform("low", "minimum", _number(7)))),
    "users": lambda p: Set(p, {"profile": _map(level=_number(3)), "builtin": DELETE}, merge=True),
    "products": lambda p: Set(p, {"price": V.double(5.0), "other": _text("not in the mask")}, merge_fields=("price", "stock")),
    "posts": lambda p: Set(p, {}, merge=True, transforms=(Transform("tags", "arrayUnion", Value("array", (_text("velvet"), _text("new")))),)),
    "comments": lambda p: Set(p, {}, merge=True, transforms=(Transform("likes", "arrayRemove", Value("array", (_text("x"),))), Transform("seen", "serverTimestamp"))),
    "presence": lambda p: Delete(p),
}
_REST = lambda p: Set(p, {"only": Value("boolean", True)})


def _writes(paths: DataFrame) -> DataFrame:
    """A table of writes: the JSON of one write per document, the path put in on the cluster."""
    cid = F.split_part("document_path", F.lit("/"), F.lit(-2))
    form: Column | None = None
    for name, make in _WRITES.items():
        form = (F.when if form is None else form.when)(cid == name, F.lit(json.dumps(to_json(make("\u0001")))))
    form = form.otherwise(F.lit(json.dumps(to_json(_REST("\u0001")))))
    quoted = F.regexp_extract(F.to_json(F.struct(F.col("document_path").alias("p"))), r'^\{"p":"(.*)"\}$', 1)
    return paths.select(F.replace(form, F.lit("\\u0001"), quoted).alias("write"))


_kept: dict[tuple[str, str, str], str] = {}


def _store(spark: SparkSession, root: str, name: str, make: Callable[[], Database], **options) -> Database:
    """A store that queries only read: made by the first of them, and there for all of the application."""
    key = (spark.sparkContext.applicationId, root, name)
    if key in _kept:
        db = open_database(spark, _kept[key], **options)
        if db.store.ends()[1]:
            return db
    _kept[key] = make().store.path
    return open_database(spark, _kept[key], **options)


def _own(spark: SparkSession, root: str, **options) -> Database:
    """A new store with the current rows, for a query that changes it."""
    db = open_database(spark, fresh(spark, "store"), **options)
    db.store.load(stored(spark, root).df)
    return db


def _loaded(spark: SparkSession, root: str, **options) -> Database:
    return _store(spark, root, "loaded", lambda: _own(spark, root), **options)


def _written(spark: SparkSession, root: str) -> tuple[Database, int]:
    """A store after one table of writes to all its documents, and the feed's end before them."""
    def make() -> Database:
        db = _own(spark, root)
        db.store.write_all(_writes(db.store.snapshot(data=False)))
        return db

    db = _store(spark, root, "written", make)
    return db, db.store.state()[1]["changes"][-1]["from"] - 1


def _field(path: str) -> TaggedField:
    return TaggedField(tagged_at(F.col("data"), path))


def _add(name: str, build: Callable, sql: str | None) -> None:
    QUERIES[name] = build
    if sql:
        SQL[name] = sql


_J = f"""WITH {CURRENT}, v AS (SELECT document_path, max(version) AS version FROM winche_documents GROUP BY document_path),
    docs AS (SELECT c.document_path, split_part(c.document_path, '/', -2) AS cid, version, CASE WHEN json_valid(data) THEN data::JSON ELSE '{{}}'::JSON END AS j FROM current c JOIN v USING (document_path))"""


def _after_writes(name: str, cid: str, columns: Callable[[], dict[str, Column]], sql: str) -> None:
    def run(spark: SparkSession, root: str) -> DataFrame:
        db, _ = _written(spark, root)
        return db.store.snapshot(collection_id=cid).select("document_path", "version", *[c.alias(n) for n, c in columns().items()])

    _add(name, run, f"{_J} SELECT document_path, version + 1 AS version, {sql} FROM docs WHERE cid = '{cid}'")


_after_writes("write_update", "orders", lambda: {
    "status": _field("status").text(), "city": _field("delivery.address.city").text(), "zip": _field("delivery.address.zip").text(), "coupon": _field("coupon").exists,
    "touched": _field("touched").integer(), "low": _field("low").integer(), "total": _field("total").double(), "buyer": _field("buyer").parts(70)[0]},
    """'done' AS status, 'Kelpford' AS city, json_extract_string(j, '$.delivery.mapValue.fields.address.mapValue.fields.zip.stringValue') AS zip, false AS coupon, 2::BIGINT AS touched, 7::BIGINT AS low,
    greatest(coalesce(json_extract_string(j, '$.total.doubleValue')::DOUBLE, 100.0), 100.0) AS total, json_extract_string(j, '$.buyer.referenceValue') AS buyer""")
_after_writes("write_merge", "users", lambda: {"level": _field("profile.level").integer(), "builtin": _field("builtin").exists,
    "fields": F.size(F.map_keys(F.from_json("data", "map<string,string>")))},
              """3::BIGINT AS level, false AS builtin, len(list_filter(json_keys(j), lambda k: k NOT IN ('builtin', 'profile')))::INT + 1 AS fields""")
_after_writes("write_mask", "products", lambda: {"price": _field("price").double(), "stock": _field("stock").exists, "other": _field("other").exists,
    "fields": F.size(F.map_keys(F.from_json("data", "map<string,string>")))},
              """5.0::DOUBLE AS price, false AS stock, json_exists(j, '$.other') AS other, len(list_filter(json_keys(j), lambda k: k NOT IN ('price', 'stock')))::INT + 1 AS fields""")
_STRINGS = "coalesce(list_transform((j->'tags'->'arrayValue'->'values')::JSON[], lambda v: v->>'stringValue'), [])"
_after_writes("write_array_union", "posts", lambda: {"tags": F.to_json(F.transform(F.from_json(F.from_json(F.from_json(tagged_at(F.col("data"),
    "tags"), "map<string,string>")["arrayValue"], "map<string,string>")["values"], "array<map<string,string>>"), lambda m: m["stringValue"]))},
              f"""to_json({_STRINGS} || CASE WHEN list_contains({_STRINGS}, 'velvet') THEN [] ELSE ['velvet'] END || CASE WHEN list_contains({_STRINGS}, 'new') THEN [] ELSE ['new'] END)::VARCHAR AS tags""")
_after_writes("write_array_remove", "comments", lambda: {"likes": _field("likes").rank,
    "now": _field("seen").parts(40)[0] == F.unix_micros(F.col("updated_at").cast("timestamp")), "body": _field("body").text()},
              """90 AS likes, true AS now, json_extract_string(j, '$.body.stringValue') AS body""")
_NAMED = ", ".join(f"'{n}'" for n in _WRITES)


def _replaced(spark: SparkSession, root: str) -> DataFrame:
    db, _ = _written(spark, root)
    return db.store.snapshot().where(~F.col("collection_id").isin(list(_WRITES))).select("document_path", "version", "data")


_add("write_replace", _replaced, f"""{_J} SELECT document_path, version + 1 AS version, '{{"only":{{"booleanValue":true}}}}' AS data FROM docs WHERE cid NOT IN ({_NAMED})""")
_add("write_delete", lambda spark, root: _written(spark, root)[0].store.snapshot(data=False).select("document_path"),
    f"{_J} SELECT document_path FROM docs WHERE cid <> 'presence'")


def _new(spark: SparkSession, root: str) -> DataFrame:
    """A table written as new documents, a write for each row."""
    db = open_database(spark, fresh(spark, "store"))
    c = table(spark, root, "customer")
    value = lambda tag, x: F.struct(x.alias(tag))
    fields = F.struct(value("stringValue", F.col("c_name")).alias("name"), value("doubleValue", F.col("c_acctbal")).alias("balance"),
        value("integerValue", F.col("c_nationkey").cast("string")).alias("nation"))
    write = F.struct(F.concat(F.lit("customers/"), F.col("c_custkey").cast("string")).alias("path"), fields.alias("fields"),
        F.struct(F.lit(False).alias("exists")).alias("precondition"))
    db.store.write_all(c.select(F.to_json(F.struct(write.alias("set"))).alias("write")))
    return db.store.snapshot().select("document_path", "version", _field("name").text().alias("name"), _field("balance").double().alias("balance"),
        _field("nation").integer().alias("nation"))


_add("write_set", _new, "SELECT 'customers/' || c_custkey AS document_path, 1::BIGINT AS version, c_name AS name, c_acctbal AS balance, c_nationkey::BIGINT AS nation FROM customer")


# the feed of these writes
def _feed(spark: SparkSession, root: str) -> DataFrame:
    db, at = _written(spark, root)
    return db.store.changes(at).select("type", "document_path", "collection_path", "version")


_add("store_feed_after", _feed, f"""{_J} SELECT CASE WHEN cid = 'presence' THEN 'removed' ELSE 'modified' END AS type, document_path, regexp_replace(document_path, '/[^/]*$', '') AS collection_path,
    CASE WHEN cid = 'presence' THEN version ELSE version + 1 END AS version FROM docs""")


def _places(spark: SparkSession, root: str) -> DataFrame:
    """Each change's place: the second commit follows the first, both in path order within a collection id."""
    db, _ = _written(spark, root)
    return db.store.changes().select("seq", "document_path")


_add("store_feed_order", _places, f"""{_J}, placed AS (SELECT document_path, row_number() OVER (ORDER BY cid, document_path) AS n, count(*) OVER () AS m FROM docs)
    SELECT n AS seq, document_path FROM placed UNION ALL SELECT n + m, document_path FROM placed""")


def _ends(spark: SparkSession, root: str) -> DataFrame:
    db, at = _written(spark, root)
    first, last = db.store.ends()
    here = [db.store.holds_change(at, F.col("collection_path") == c) for c in ("users", "none")]
    return spark.createDataFrame([(first, last, *here)], "first_seq long, last_seq long, users boolean, nobody boolean")


_add("store_feed_ends", _ends, "SELECT 1::BIGINT AS first_seq, 2 * count(DISTINCT document_path) AS last_seq, bool_or(regexp_matches(document_path, '^users/[^/]*$')) AS users, false AS nobody FROM winche_documents")


def _touched(spark: SparkSession, root: str) -> DataFrame:
    db, at = _written(spark, root)
    return db.store.touched(db.store.changes(at)).select("document_path", "version")


_add("store_feed_documents", _touched, f"{_J} SELECT document_path, version + 1 AS version FROM docs WHERE cid <> 'presence'")


def _consumed(spark: SparkSession, root: str) -> DataFrame:
    """A named consumer over the feed, in batches, one of which fails at first."""
    db, out = open_database(spark, fresh(spark, "store")), fresh(spark, "consumed")
    failures = [2]

    def handle(changes: DataFrame, documents: DataFrame) -> None:
        if failures[0]:
            failures[0] -= 1
            raise RuntimeError("not now")
        joined = changes.join(documents.select("document_path", F.col("version").alias("now")), "document_path", "left")
        joined.select("document_path", "type", "version", "now").write.mode("append").parquet(out)

    run = lambda: catch_up(db.store, "copy", handle, 50_000, backoff=(0.01, 0.02))
    run()
    db.store.load(stored(spark, root).df)
    run()
    db.store.write_all(_writes(db.store.snapshot(data=False)))
    run()
    return spark.read.parquet(out)


_add("consumer_named", _consumed, f"""{_J} SELECT document_path, 'added' AS type, version, version AS now FROM docs UNION ALL
    SELECT document_path, CASE WHEN cid = 'presence' THEN 'removed' ELSE 'modified' END, CASE WHEN cid = 'presence' THEN version ELSE version + 1 END, CASE WHEN cid <> 'presence' THEN version + 1 END FROM docs""")


# removal and expiry
def _without(spark: SparkSession, root: str) -> DataFrame:
    db = _own(spark, root)
    db.store.remove_below("tenants/kestrel-works")
    db.store.compact()
    return db.store.snapshot(data=False).select("document_path", "version")


_add("store_remove_below", _without, "SELECT document_path, max(version) AS version FROM winche_documents WHERE document_path <> 'tenants/kestrel-works' AND NOT starts_with(document_path, 'tenants/kestrel-works/') GROUP BY document_path")


def _swept(spark: SparkSession, root: str) -> DataFrame:
    db = _own(spark, root, options=Options(ttl=(("sessions", "startedAt"), ("presence", "lastSeen"))))
    db.maintain(micros("2025-04-01T00:00:00Z"))
    return db.store.changes().where("type = 'removed'").select("document_path", "version")


_EXPIRED = " OR ".join(f"(cid = '{c}' AND json_extract_string(j, '$.{f}.timestampValue')::TIMESTAMP < TIMESTAMP '2025-04-01 00:00:00')" for c,
    f in (("sessions", "startedAt"), ("presence", "lastSeen")))
_add("store_sweep", _swept, f"""{_J}, old AS (SELECT document_path FROM docs WHERE {_EXPIRED})
    SELECT document_path, version FROM docs d WHERE EXISTS (SELECT 1 FROM old o WHERE o.document_path = d.document_path OR starts_with(d.document_path, o.document_path || '/'))""")


# reads through the facade
_add("store_collection", lambda spark, root: _loaded(spark, root).matching({"collection": "users"}).select("document_path", "version"),
     f"{_J} SELECT document_path, version FROM docs WHERE regexp_matches(document_path, '^users/[^/]*$')")
_add("store_chosen_index", lambda spark, root: (lambda db: (db.build_indexes(),
    db.matching({"collection": ORDERS, "where": {"field": "total", "op": "gt", "value": {"integerValue": "100"}}}))[1].select("document_path"))(
    _loaded(spark, root, options=Options(indexes=(Index("orders", (Order("total"),), Unary("exists", "total")),)))), ENGINE_SQL["stored_gt_number"])


def _walk(spark: SparkSession, root: str) -> DataFrame:
    """All pages of a collection, each beginning after the last document of the one before: sorted once, a row per document."""
    return _loaded(spark, root).walk(Query(ORDERS, order_by=(Order("placedAt"),), limit=1000), data=False).select("place", "document_path")


_add("store_page_walk", _walk, f"""{_J} SELECT row_number() OVER (ORDER BY json_extract_string(j, '$.placedAt.timestampValue'), document_path) - 1 AS place, document_path
    FROM docs WHERE regexp_matches(document_path, '^{ORDERS}/[^/]*$') AND json_exists(j, '$.placedAt')""")


def _pages(spark: SparkSession, root: str) -> DataFrame:
    """Collection ids at the top, page by page, with the pages' opaque tokens."""
    db, out, token = _loaded(spark, root), [], None
    while True:
        got, token = db.list_collection_ids(size=40, token=token)
        out += [(len(out) + n, c) for n, c in enumerate(got)]
        if token is None:
            return spark.createDataFrame(out, "place long, collection_id string")


_add("list_pages", _pages, "SELECT row_number() OVER (ORDER BY collection_id) - 1 AS place, collection_id FROM (SELECT DISTINCT split_part(document_path, '/', 1) AS collection_id FROM winche_documents)")


def _facade(spark: SparkSession, root: str) -> DataFrame:
    """Count, aggregates and point reads through the database."""
    db = _loaded(spark, root)
    q = {"collection": ORDERS, "where": {"field": "total", "op": "gt", "value": {"integerValue": "100"}}}
    a = db.aggregate(q, [{"kind": "count", "alias": "n"}, {"kind": "average", "alias": "a", "field": "total"}])
    first = db.query({"collection": ORDERS, "limit": 2})
    missing, there = db.get_all([f"{ORDERS}/none", first.documents[0].path])
    row = (db.count(q), a["n"].v, a["a"].v, first.has_more, missing is None, there.path)
    return spark.createDataFrame([row], "count long, n long, a double, more boolean, missing boolean, first string")


_add("store_facade", _facade, f"""{_J}, o AS (SELECT document_path, json_extract_string(j, '$.total.doubleValue')::DOUBLE AS total FROM docs WHERE regexp_matches(document_path, '^{ORDERS}/[^/]*$'))
    SELECT count(*) FILTER (total > 100 AND NOT isnan(total)) AS count, count(*) FILTER (total > 100 AND NOT isnan(total)) AS n,
        sum(total::DECIMAL(38, 10)) FILTER (total > 100 AND NOT isnan(total))::DOUBLE / count(*) FILTER (total > 100 AND NOT isnan(total)) AS a, count(*) > 2 AS more, true AS missing, min(document_path) AS first FROM o""")


def _live(spark: SparkSession, root: str) -> DataFrame:
    """What a live query says after a write: the page's changes with their places before and after."""
    db = _own(spark, root)
    listener = db.listen(Query(ORDERS, order_by=(Order("placedAt", True),), limit=200))
    listener.take()
    top = db.query(Query(ORDERS, order_by=(Order("placedAt", True),), limit=3)).documents
    db.write([Delete(top[0].path), Update(top[2].path, {"placedAt": Value("timestamp", top[0].fields["placedAt"].v + 1)})])
    db.pump()
    said = [(c.type, c.document.path, c.old_index, c.new_index) for c in listener.take().changes]
    return spark.createDataFrame(said, "type string, document_path string, old_index long, new_index long")


_add("live_query", _live, f"""{_J}, o AS (SELECT document_path, row_number() OVER (ORDER BY json_extract_string(j, '$.placedAt.timestampValue') DESC, document_path DESC) - 1 AS n
        FROM docs WHERE regexp_matches(document_path, '^{ORDERS}/[^/]*$') AND json_exists(j, '$.placedAt'))
    SELECT 'removed' AS type, document_path, 0::BIGINT AS old_index, -1::BIGINT AS new_index FROM o WHERE n = 0 UNION ALL SELECT 'modified', document_path, 2, 0 FROM o WHERE n = 2
    UNION ALL SELECT 'added', document_path, -1, 199 FROM o WHERE n = 200""")


def _changes_in_order(spark: SparkSession, root: str) -> DataFrame:
    """Differences of two results with the places of their rows in an order."""
    e = table(spark, root, "events").withColumn("path", F.concat(F.lit("events/"), F.col("event_id").cast("string")))
    old = e.where(F.col("value") < 120).select("path", "value", F.col("ts").alias("stamp"))
    new = e.where(F.col("value") > 60).select("path", "value", F.expr("CASE WHEN user_id % 3 = 0 THEN ts + INTERVAL 1 SECOND ELSE ts END").alias("stamp"))
    return frame_difference(old, new, "path", "stamp", ["value", "path"])


_add("snapshot_diff_places", _changes_in_order, """
    WITH o AS (SELECT 'events/' || event_id AS path, ts AS stamp, row_number() OVER (ORDER BY value, 'events/' || event_id) - 1 AS n FROM events WHERE value < 120),
    n AS (SELECT 'events/' || event_id AS path, CASE WHEN user_id % 3 = 0 THEN ts + INTERVAL 1 SECOND ELSE ts END AS stamp, row_number() OVER (ORDER BY value, 'events/' || event_id) - 1 AS n FROM events WHERE value > 60)
    SELECT coalesce(o.path, n.path) AS path, CASE WHEN n.path IS NULL THEN 'removed' WHEN o.path IS NULL THEN 'added' ELSE 'modified' END AS type, coalesce(o.n, -1) AS old_index, coalesce(n.n, -1) AS new_index
    FROM o FULL JOIN n ON o.path = n.path WHERE o.path IS NULL OR n.path IS NULL OR o.stamp <> n.stamp""")


def _by_path(spark: SparkSession, root: str) -> DataFrame:
    """Point reads of stored documents in the order asked for, missing ones and repeats included."""
    db = _loaded(spark, root)
    asked = ["users/none", *[r[0] for r in db.store.snapshot(collection="products", data=False).select("document_path").orderBy("document_path").collect()], "users/none"]
    return rows_for(db.store.snapshot(paths=asked), asked).select("pos", "document_path", "version")


_add("store_get_all", _by_path, f"""{_J}, p AS (SELECT document_path, version FROM docs WHERE regexp_matches(document_path, '^products/[^/]*$'))
    SELECT 0::INT AS pos, 'users/none' AS document_path, NULL::BIGINT AS version UNION ALL SELECT row_number() OVER (ORDER BY document_path)::INT, document_path, version FROM p UNION ALL SELECT count(*)::INT + 1, 'users/none', NULL FROM p""")
_add("filter_reference_to_path", lambda spark, root: matching(_loaded(spark, root).source(),
    parse_query({"collection": "users", "where": {"field": "__name__", "op": "lt", "value": {"referenceValue": "users/M"}}})).select("document_path"),
     f"{_J} SELECT document_path FROM docs WHERE regexp_matches(document_path, '^users/[^/]*$') AND document_path < 'users/M'")
