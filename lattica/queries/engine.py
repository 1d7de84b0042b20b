"""The document query operators over the typed tables and the stored documents, with SQL for the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.values import micros
from lattica.operators.aggregates import count_frame, typed_frame
from lattica.operators.bulk import increment, merge_rows, remove_elements, union_elements
from lattica.operators.diff import frame_difference
from lattica.operators.listing import collection_ids, expired
from lattica.operators.lookup import rows_for
from lattica.plans.ast import Order, Unary
from lattica.plans.compiler import matching, page
from lattica.plans.parser import parse_aggregations, parse_query
from lattica.queries.pipeline import CURRENT
from lattica.sources.collections import TaggedCollections, TypedCollection
from lattica.sources.indexes import Index, Indexes
from lattica.sources.shared import fresh
from lattica.sources.store import DocumentStore, descendants
from lattica.sources.tables import table
from lattica.streaming.feed import change_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_KEYS = {"orders": "o_orderkey", "customer": "c_custkey", "events": "event_id", "part": "p_partkey", "nation": "n_nationkey", "supplier": "s_suppkey",
    "documents": "doc_id", "embeddings": "vec_id"}


def typed(spark: SparkSession, root: str, name: str) -> TypedCollection:
    df = table(spark, root, name)
    if name == "lineitem":  # no key: rows get their place in the order as told by two columns
        return TypedCollection(name, df, F.concat_ws("-", "l_orderkey", "l_linenumber"))
    if name == "orders":  # a field that some rows lack
        df = df.withColumn("status", F.expr("nullif(o_orderstatus, 'F')"))
    if name == "events":  # a field with NaN, and a nested one
        df = df.withColumn("reading", F.expr("CASE WHEN user_id % 7 = 0 THEN double('NaN') ELSE value END")).withColumn("nested", F.from_json("props", "k bigint"))
    if name == "documents":
        df = df.withColumn("tags", F.split("text", " "))
    return TypedCollection(name, df, _KEYS[name])


def stored(spark: SparkSession, root: str) -> TaggedCollections:
    """The current rows of the stored documents, by collection path."""
    from lattica.operators.nested import current_rows

    rows = current_rows(table(spark, root, "winche_documents"), "document_path", "document_id", "collection_path", "collection_id", "data", "created_at", "updated_at", "version")
    return TaggedCollections(rows)


def _add(name: str, build: Callable, sql: str | None) -> None:
    QUERIES[name] = build
    build.__name__ = name
    if sql:
        SQL[name] = sql


def field(f: str, op: str, **value) -> dict:
    return {"field": f, "op": op, "value": value}


def _match(name: str, coll: str, where: dict, condition: str, cols: str) -> None:
    """A filter over the whole table, without a page."""
    out = [c.strip() for c in cols.split(",")]

    def run(spark: SparkSession, root: str) -> DataFrame:
        return matching(typed(spark, root, coll), parse_query({"collection": coll, "where": where})).select(*out)

    _add(name, run, f"SELECT {cols} FROM {_SQL_TABLES.get(coll, coll)} WHERE {condition}")


def _page(name: str, q: dict, sql: str, cols: str) -> None:
    out = [c.strip() for c in cols.split(",")]
    _add(name, lambda spark, root: page(typed(spark, root, q["collection"]), parse_query(q)).select(*out), sql)


_SQL_TABLES = {
    "orders": "(SELECT *, nullif(o_orderstatus, 'F') AS status, 'orders/' || o_orderkey AS document_path FROM orders)",
    "events": "(SELECT *, CASE WHEN user_id % 7 = 0 THEN 'NaN'::DOUBLE ELSE value END AS reading, CAST(json_extract(props, '$.k') AS BIGINT) AS k, 'events/' || event_id AS document_path FROM events)",
    "documents": "(SELECT *, string_split(text, ' ') AS tags, 'documents/' || doc_id AS document_path FROM documents)",
    "customer": "(SELECT *, 'customer/' || c_custkey AS document_path FROM customer)",
    "part": "(SELECT *, 'part/' || p_partkey AS document_path FROM part)",
    "nation": "(SELECT *, 'nation/' || n_nationkey AS document_path FROM nation)",
}
O, E, D = _SQL_TABLES["orders"], _SQL_TABLES["events"], _SQL_TABLES["documents"]

# scans and point reads
_page("scan_collection", {"collection": "nation", "limit": 100},
    f"SELECT document_path, n_name FROM {_SQL_TABLES['nation']} ORDER BY document_path LIMIT 100", "document_path, n_name")
_match("point_get", "customer", field("__name__", "eq", stringValue="customer/42"), "c_custkey = 42", "c_custkey, c_name, c_acctbal")

# leaf filters, each over the whole table
_match("filter_eq", "orders", field("o_orderstatus", "eq", stringValue="F"), "o_orderstatus = 'F'", "o_orderkey, o_totalprice")
_match("filter_ne", "orders", field("status", "ne", stringValue="O"), "status IS NOT NULL AND status <> 'O'", "o_orderkey, status")
for _op, _sign in (("gt", ">"), ("gte", ">="), ("lt", "<"), ("lte", "<=")):
    _match(f"filter_{_op}", "lineitem", field("l_quantity", _op, integerValue="25"), f"l_quantity {_sign} 25", "l_orderkey, l_linenumber, l_quantity, l_extendedprice")
_match("filter_range_timestamp", "events", {"and": [field("ts", "gte", timestampValue="2024-01-05T00:00:00Z"), field("ts", "lt", timestampValue="2024-01-20T12:30:00.5Z")]},
       "ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-20 12:30:00.5'", "event_id, ts")
_match("filter_in", "part", field("p_brand", "in", arrayValue={"values": [{"stringValue": f"Brand#{n}"} for n in (11, 12, 23, 34)]}),
    "p_brand IN ('Brand#11', 'Brand#12', 'Brand#23', 'Brand#34')", "p_partkey, p_brand")
_match("filter_not_in", "orders", field("status", "notIn", arrayValue={"values": [{"stringValue": "O"}]}), "status IS NOT NULL AND status NOT IN ('O')", "o_orderkey, status")
_match("filter_contains", "part", field("p_name", "contains", stringValue="RED"), "p_name ILIKE '%red%'", "p_partkey, p_name")
_match("filter_starts_with", "customer", field("c_name", "startsWith", stringValue="customer#00000"), "c_name ILIKE 'customer#00000%'", "c_custkey, c_name")
_match("filter_ends_with", "part", field("p_type", "endsWith", stringValue="ard"), "p_type ILIKE '%ard'", "p_partkey, p_type")
_match("filter_regex", "part", field("p_name", "regex", stringValue="^(small|red) "), "regexp_matches(p_name, '^(small|red) ')", "p_partkey, p_name")
_match("filter_and_or_not", "orders", {"and": [{"or": [field("o_orderpriority", "eq", stringValue="1-URGENT"),
    field("o_totalprice", "gt", doubleValue=300000)]}, {"not": field("status", "eq", stringValue="O")}]},
       "(o_orderpriority = '1-URGENT' OR o_totalprice > 300000) AND NOT (status = 'O')", "o_orderkey, o_totalprice")
_match("filter_exists", "orders", {"unary": "exists", "field": "status"}, "status IS NOT NULL", "o_orderkey, status")
_match("filter_not_exists", "orders", {"not": {"unary": "exists", "field": "status"}}, "status IS NULL", "o_orderkey, o_orderstatus")
_match("filter_not_missing", "orders", {"not": field("status", "ne", stringValue="P")}, "NOT coalesce(status <> 'P', false)", "o_orderkey, o_orderstatus")
_match("filter_is_nan", "events", {"unary": "isNan", "field": "reading"}, "isnan(reading)", "event_id, user_id")
_match("filter_ne_excludes_nan", "events", field("reading", "ne", doubleValue=10.5), "NOT isnan(reading) AND reading <> 10.5", "event_id, reading")
_match("filter_gt_excludes_nan", "events", field("reading", "gt", integerValue="200"), "NOT isnan(reading) AND reading > 200", "event_id, reading")
_match("filter_other_type", "orders", {"not": field("o_orderkey", "eq", stringValue="1")}, "true", "o_orderkey")
_match("filter_compare", "lineitem", {"compare": {"left": "l_tax", "op": "lt", "right": "l_discount"}}, "l_tax < l_discount", "l_orderkey, l_linenumber, l_tax, l_discount")
_match("filter_compare_mixed", "events", {"compare": {"left": "event_id", "op": "lt", "right": "value"}}, "event_id < value", "event_id, value")
_match("filter_name_range", "events", field("__name__", "gte", stringValue="events/5"), "document_path >= 'events/5'", "event_id")
_match("filter_nested_field", "events", field("nested.k", "gte", integerValue="50"), "k >= 50", "event_id, props")
_match("array_contains", "documents", field("tags", "arrayContains", stringValue="the"), "list_contains(tags, 'the')", "doc_id, source")
_match("array_contains_any", "documents", field("tags", "arrayContainsAny",
    arrayValue={"values": [{"stringValue": w} for w in ("mill", "boat", "casa")]}), "list_has_any(tags, ['mill', 'boat', 'casa'])", "doc_id, source")
_match("array_contains_all", "documents", field("tags", "arrayContainsAll", arrayValue={"values": [{"stringValue": w} for w in ("the", "The")]}),
    "list_has_all(tags, ['the', 'The'])", "doc_id, source")

# order, page, cursors
_by_total = [{"field": "o_orderpriority"}, {"field": "o_totalprice", "direction": "desc"}]
_page("order_multi", {"collection": "orders", "orderBy": _by_total, "limit": 50},
    f"SELECT document_path, o_totalprice FROM {O} ORDER BY o_orderpriority, o_totalprice DESC, document_path DESC LIMIT 50", "document_path, o_totalprice")
_page("order_tiebreak_desc", {"collection": "orders", "orderBy": [{"field": "o_orderpriority", "direction": "desc"}], "limit": 40},
    f"SELECT document_path, o_orderpriority FROM {O} ORDER BY o_orderpriority DESC, document_path DESC LIMIT 40", "document_path, o_orderpriority")
_page("order_drops_missing", {"collection": "orders", "orderBy": [{"field": "status"}], "limit": 60},
    f"SELECT document_path, status FROM {O} WHERE status IS NOT NULL ORDER BY status, document_path LIMIT 60", "document_path, status")
_page("order_nan_first", {"collection": "events", "orderBy": [{"field": "reading"}], "limit": 2000},
    f"SELECT document_path, event_id FROM {E} ORDER BY isnan(reading) DESC, reading, document_path LIMIT 2000", "document_path, event_id")
_page("limit_offset", {"collection": "orders", "orderBy": [{"field": "o_totalprice"}], "limit": 20, "offset": 40},
    f"SELECT document_path, o_totalprice FROM {O} ORDER BY o_totalprice, document_path LIMIT 20 OFFSET 40", "document_path, o_totalprice")
_page("limit_to_last", {"collection": "orders", "orderBy": [{"field": "o_totalprice"}], "limitToLast": 10},
    f"SELECT document_path, o_totalprice FROM {O} ORDER BY o_totalprice DESC, document_path DESC LIMIT 10", "document_path, o_totalprice")
_page("top_k_filtered", {"collection": "events", "where": {"and": [field("event_type", "ne", stringValue="click"),
    field("value", "gte", doubleValue=10)]}, "orderBy": [{"field": "value", "direction": "desc"}], "limit": 25},
      f"SELECT document_path, event_type, value FROM {E} WHERE event_type <> 'click' AND value >= 10 ORDER BY value DESC, document_path DESC LIMIT 25", "document_path, event_type, value")


def _cursor(name: str, condition: str, desc: bool = False, **cursor) -> None:
    """A cursor range over the whole table, without a page."""
    q = {"collection": "events", "orderBy": [{"field": "value", "direction": "desc" if desc else "asc"}], **cursor}
    _add(name, lambda spark, root: matching(typed(spark, root, "events"), parse_query(q)).select("event_id", "value"), f"SELECT event_id, value FROM {E} WHERE {condition}")


_at = lambda before, *v: {"values": list(v), "before": before}
_cursor("cursor_start_at", "value >= 250.5", start=_at(True, {"doubleValue": 250.5}))
_cursor("cursor_start_after", "value > 250", start=_at(False, {"integerValue": "250"}))
_cursor("cursor_end_at", "value <= 99.25", end=_at(False, {"doubleValue": 99.25}))
_cursor("cursor_end_before", "value < 99.25", end=_at(True, {"doubleValue": 99.25}))
_cursor("cursor_descending", "value < 120 AND value >= 60", True, start=_at(False, {"doubleValue": 120}), end=_at(False, {"doubleValue": 60}))
_cursor("cursor_with_name", "value > 100 OR (value = 100 AND document_path > 'events/500')", start=_at(False, {"doubleValue": 100}, {"stringValue": "events/500"}))
_cursor("cursor_other_type", "true", start=_at(True, {"booleanValue": True}), end=_at(True, {"stringValue": ""}))

# counts and aggregates
_add("count_all", lambda spark, root: count_frame(typed(spark, root, "orders"), parse_query({"collection": "orders"}), "n"), "SELECT count(*) AS n FROM orders")
_add("count_filtered", lambda spark, root: count_frame(typed(spark, root, "lineitem"),
    parse_query({"collection": "lineitem", "where": field("l_quantity", "gt", integerValue="40")}), "n"), "SELECT count(*) AS n FROM lineitem WHERE l_quantity > 40")
_add("count_capped", lambda spark, root: count_frame(typed(spark, root, "orders"), parse_query({"collection": "orders", "limit": 1000}), "n"),
    "SELECT least(count(*), 1000) AS n FROM orders")


def _aggregate(name: str, q: dict, aggs: list[dict], sql: str, kinds: dict[str, str] | None = None) -> None:
    def run(spark: SparkSession, root: str) -> DataFrame:
        df = typed_frame(typed(spark, root, q["collection"]), parse_query(q), parse_aggregations(aggs))
        return df.select(*[F.col(c).cast((kinds or {}).get(c, "bigint" if c == "n" else "double")).alias(c) for c in df.columns])

    _add(name, run, sql)


_sum = lambda f: {"kind": "sum", "alias": "s", "field": f}
_avg = lambda f: {"kind": "average", "alias": "a", "field": f}
_n = {"kind": "count", "alias": "n"}
_aggregate("agg_count_sum_avg", {"collection": "lineitem", "where": field("l_returnflag", "eq", stringValue="R")}, [_n, _sum("l_extendedprice"), _avg("l_discount")],
           "SELECT count(*) AS n, sum(l_extendedprice::DECIMAL(38, 10))::DOUBLE AS s, sum(l_discount::DECIMAL(38, 10))::DOUBLE / count(*) AS a FROM lineitem WHERE l_returnflag = 'R'")
_aggregate("agg_sum_integer", {"collection": "lineitem"}, [_sum("l_orderkey")], "SELECT sum(l_orderkey)::BIGINT AS s FROM lineitem", {"s": "bigint"})
_aggregate("agg_exact_double", {"collection": "events"}, [_n, _sum("value"), _avg("value")],
    "SELECT count(*) AS n, sum(value::DECIMAL(38, 10))::DOUBLE AS s, sum(value::DECIMAL(38, 10))::DOUBLE / count(*) AS a FROM events")
_aggregate("agg_nan", {"collection": "events"}, [_n, _sum("reading")], "SELECT count(*) AS n, 'NaN'::DOUBLE AS s FROM events")
_aggregate("agg_empty", {"collection": "events", "where": field("value", "lt", integerValue="0")}, [_n, _sum("value"), _avg("value")],
    "SELECT 0::BIGINT AS n, 0::DOUBLE AS s, NULL::DOUBLE AS a")
_aggregate("agg_capped", {"collection": "orders", "orderBy": [{"field": "o_totalprice"}], "limit": 500}, [_n, _sum("o_totalprice")],
    f"SELECT count(*) AS n, sum(o_totalprice::DECIMAL(38, 10))::DOUBLE AS s FROM (SELECT * FROM {O} ORDER BY o_totalprice, document_path LIMIT 500)")

# projection
_add("select_nested", lambda spark, root: (lambda src: src.project(matching(src, parse_query({"collection": "events"})),
    ("event_type", "nested.k")).select("document_path", "event_type", F.col("nested.k").alias("k")))(typed(spark, root, "events")),
     f"SELECT document_path, event_type, k FROM {E}")
_page("select_top", {"collection": "events", "select": ["value"], "orderBy": [{"field": "value"}], "limit": 30},
    f"SELECT document_path, value FROM {E} ORDER BY value, document_path LIMIT 30", "document_path, value")

# stored documents
ORDERS = "tenants/kestrel-works/orders"
_C = f"WITH {CURRENT}, docs AS (SELECT c.*, json_valid(c.data) AS ok, CASE WHEN json_valid(c.data) THEN c.data::JSON ELSE '{{}}'::JSON END AS j FROM current c WHERE document_path LIKE '{ORDERS}/%' AND document_path NOT LIKE '{ORDERS}/%/%')"


def _stored(name: str, where: dict, condition: str) -> None:
    _add(name, lambda spark, root: matching(stored(spark, root), parse_query({"collection": ORDERS, "where": where})).select("document_path"),
        f"{_C} SELECT document_path FROM docs WHERE {condition}")


_stored("stored_eq_string", field("status", "eq", stringValue="paid"), "json_extract_string(j, '$.status.stringValue') = 'paid'")
_stored("stored_is_null", {"unary": "isNull", "field": "coupon"}, "json_exists(j, '$.coupon.nullValue')")
_stored("stored_exists_nested", {"unary": "exists", "field": "delivery.address.city"}, "json_exists(j, '$.delivery.mapValue.fields.address.mapValue.fields.city')")
_stored("stored_gt_number", field("total", "gt", integerValue="100"),
    "(json_extract_string(j, '$.total.doubleValue') NOT IN ('NaN') AND (json_extract_string(j, '$.total.doubleValue'))::DOUBLE > 100) OR (json_extract_string(j, '$.total.integerValue'))::BIGINT > 100")
_stored("stored_timestamp_range", field("placedAt", "gte", timestampValue="2025-04-01T00:00:00Z"),
    "(json_extract_string(j, '$.placedAt.timestampValue'))::TIMESTAMP >= TIMESTAMP '2025-04-01 00:00:00'")
_stored("stored_reference", field("buyer", "gte", referenceValue="users/m"), "json_extract_string(j, '$.buyer.referenceValue') >= 'users/m'")
_stored("stored_not_missing", {"not": field("coupon", "ne", stringValue="x")},
    "NOT (json_exists(j, '$.coupon') AND NOT json_exists(j, '$.coupon.nullValue') AND coalesce(json_extract_string(j, '$.coupon.stringValue') <> 'x', true))")
_add("stored_array_contains", lambda spark, root: matching(stored(spark, root),
    parse_query({"collection": "posts", "where": field("tags", "arrayContains", stringValue="velvet")})).select("document_path"),
     f"WITH {CURRENT}, docs AS (SELECT document_path, CASE WHEN json_valid(data) THEN data::JSON ELSE '{{}}'::JSON END AS j FROM current WHERE document_path LIKE 'posts/%' AND document_path NOT LIKE 'posts/%/%') "
     "SELECT document_path FROM docs WHERE list_contains(list_transform((j->'tags'->'arrayValue'->'values')::JSON[], lambda v: v->>'stringValue'), 'velvet')")
_add("stored_projection", lambda spark, root: (lambda src: src.project(matching(src, parse_query({"collection": ORDERS})), ("status", "delivery.address.city")).select(
    "document_path", src.field("status").text().alias("status"), src.field("delivery.address.city").text().alias("city"),
    F.length("data").alias("size").isNotNull().alias("kept")))(stored(spark, root)),
     f"{_C} SELECT document_path, json_extract_string(j, '$.status.stringValue') AS status, json_extract_string(j, '$.delivery.mapValue.fields.address.mapValue.fields.city.stringValue') AS city, true AS kept FROM docs")
_add("stored_projection_data", lambda spark, root: (lambda src: src.project(matching(src, parse_query({"collection": ORDERS})),
    ("status", "delivery.address.city", "delivery.address.zip", "buyer")).select("document_path", "data"))(stored(spark, root)),
     f"""{_C}, parts AS (SELECT document_path, (j->'status')::VARCHAR AS status, (j->'buyer')::VARCHAR AS buyer, json_exists(j, '$.delivery.mapValue') AS has_delivery, json_exists(j, '$.delivery.mapValue.fields.address.mapValue') AS has_address,
            json_extract(j, '$.delivery.mapValue.fields.address.mapValue.fields.city')::VARCHAR AS city, json_extract(j, '$.delivery.mapValue.fields.address.mapValue.fields.zip')::VARCHAR AS zip FROM docs)
        SELECT document_path, '{{' || concat_ws(',', '"status":' || status, '"buyer":' || buyer, CASE WHEN has_delivery THEN '"delivery":{{"mapValue":{{"fields":{{' ||
            CASE WHEN has_address THEN '"address":{{"mapValue":{{"fields":{{' || concat_ws(',', '"city":' || city, '"zip":' || zip) || '}}}}}}' ELSE '' END || '}}}}}}' END) || '}}' AS data FROM parts""")
_add("stored_order_cross_type", lambda spark, root: page(stored(spark, root),
    parse_query({"collection": ORDERS, "orderBy": [{"field": "total"}], "limit": 200})).select("document_path"),
     f"""{_C}, keyed AS (SELECT document_path, CASE WHEN json_exists(j, '$.total.nullValue') THEN 10 WHEN json_exists(j, '$.total.booleanValue') THEN 20 WHEN json_extract_string(j, '$.total.doubleValue') = 'NaN' THEN 29
        WHEN json_exists(j, '$.total.doubleValue') OR json_exists(j, '$.total.integerValue') THEN 30 WHEN json_exists(j, '$.total.timestampValue') THEN 40 WHEN json_exists(j, '$.total.stringValue') THEN 50 ELSE 60 END AS r,
        CASE WHEN json_extract_string(j, '$.total.doubleValue') <> 'NaN' THEN (json_extract_string(j, '$.total.doubleValue'))::DOUBLE ELSE (json_extract_string(j, '$.total.integerValue'))::DOUBLE END AS n, json_extract_string(j, '$.total.stringValue') AS s FROM docs WHERE json_exists(j, '$.total'))
     SELECT document_path FROM keyed ORDER BY r, n, s, document_path LIMIT 200""")


def _mixed_types(spark: SparkSession, root: str) -> DataFrame:
    """Order over a field that is null or a string (``total`` is always a double): all nulls, and 100 rows beyond them."""
    src = stored(spark, root)
    nulls = count_frame(src, parse_query({"collection": ORDERS, "where": {"unary": "isNull", "field": "coupon"}}), "n").first()["n"]
    return page(src, parse_query({"collection": ORDERS, "orderBy": [{"field": "coupon"}], "limit": nulls + 100})).select("document_path")


_add("stored_order_mixed_types", _mixed_types,
     f"""{_C} SELECT document_path FROM docs WHERE json_exists(j, '$.coupon') ORDER BY CASE WHEN json_exists(j, '$.coupon.nullValue') THEN 10 ELSE 50 END, json_extract_string(j, '$.coupon.stringValue'), document_path
     LIMIT (SELECT count(*) + 100 FROM docs WHERE json_exists(j, '$.coupon.nullValue'))""")

# batch gets, subtrees, listing, expiry
_PATHS = ["customer/7", "customer/999999999", "customer/3", "customer/1200", "customer/x"]


def _multi_get(spark: SparkSession, root: str) -> DataFrame:
    """In the order asked for, with nulls for the missing; the asked paths are a handful of literals."""
    return rows_for(typed(spark, root, "customer"), _PATHS).select("pos", "document_path", "c_name")


_add("multi_get", _multi_get, f"SELECT pos, p.document_path, c_name FROM (VALUES {', '.join(f'({i}, {p!r})' for i, p in enumerate(_PATHS))}) p(pos, document_path) LEFT JOIN {_SQL_TABLES['customer']} c ON c.document_path = p.document_path")
_add("subtree_scan", lambda spark, root: descendants(stored(spark, root).df, "tenants/kestrel-works").select("document_path", "version"),
     "SELECT document_path, max(version) AS version FROM winche_documents WHERE document_path = 'tenants/kestrel-works' OR starts_with(document_path, 'tenants/kestrel-works/') GROUP BY document_path")
_add("list_collections", lambda spark, root: collection_ids(table(spark, root, "winche_documents")),
    "SELECT DISTINCT split_part(document_path, '/', 1) AS collection_id FROM winche_documents")
_add("list_subcollections", lambda spark, root: collection_ids(table(spark, root, "winche_documents"), "tenants/kestrel-works"),
     "SELECT DISTINCT split_part(document_path, '/', 3) AS collection_id FROM winche_documents WHERE starts_with(document_path, 'tenants/kestrel-works/')")
_NOW = "2025-04-01T00:00:00Z"
_add("ttl_expired", lambda spark, root: expired(stored(spark, root).df, "sessions", "startedAt", micros(_NOW)).select("document_path"),
     f"WITH {CURRENT} SELECT document_path FROM current WHERE split_part(document_path, '/', -2) = 'sessions' AND json_valid(data) AND json_extract_string(data, '$.startedAt.timestampValue')::TIMESTAMP < TIMESTAMP '2025-04-01 00:00:00'")

# differences of two results
def _snapshot_diff(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "events").withColumn("path", F.concat(F.lit("events/"), F.col("event_id").cast("string")))
    old = e.where(F.col("value") < 120).select("path", F.col("ts").alias("stamp"))
    new = e.where(F.col("value") > 60).select("path", F.expr("CASE WHEN user_id % 3 = 0 THEN ts + INTERVAL 1 SECOND ELSE ts END").alias("stamp"))
    return frame_difference(old, new, "path", "stamp")


_add("snapshot_diff", _snapshot_diff, """
    WITH o AS (SELECT 'events/' || event_id AS path, ts AS stamp FROM events WHERE value < 120), n AS (SELECT 'events/' || event_id AS path, CASE WHEN user_id % 3 = 0 THEN ts + INTERVAL 1 SECOND ELSE ts END AS stamp FROM events WHERE value > 60)
    SELECT coalesce(o.path, n.path) AS path, CASE WHEN n.path IS NULL THEN 'removed' WHEN o.path IS NULL THEN 'added' ELSE 'modified' END AS type FROM o FULL JOIN n ON o.path = n.path WHERE o.path IS NULL OR n.path IS NULL OR o.stamp <> n.stamp""")


# write semantics over whole tables
def _merge_apply(spark: SparkSession, root: str) -> DataFrame:
    target = table(spark, root, "customer").select(F.col("c_custkey").alias("id"), "c_name", "c_acctbal")
    patch = table(spark, root, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_totalprice").alias("c_acctbal"))
    return merge_rows(target, patch, "id")


_add("merge_apply", _merge_apply, """SELECT coalesce(p.id, c_custkey) AS id, c_name, coalesce(p.total, c_acctbal) AS c_acctbal FROM customer FULL JOIN (SELECT o_custkey AS id, max(o_totalprice) AS total FROM orders GROUP BY 1) p ON p.id = c_custkey""")
_add("transform_increment", lambda spark, root: table(spark, root, "orders").select("o_orderkey",
    increment(F.expr("CASE WHEN o_orderstatus = 'F' THEN NULL WHEN o_orderstatus = 'P' THEN 9223372036854775807L ELSE o_custkey END"), F.col("o_orderkey")).alias("n")),
     "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderkey WHEN o_orderstatus = 'P' THEN least(9223372036854775807::HUGEINT + o_orderkey, 9223372036854775807)::BIGINT ELSE o_custkey + o_orderkey END AS n FROM orders")
def _tags(name: str, change: Callable, sql: str) -> None:
    """A transform of the words of all texts: their number, and the words themselves."""
    def run(spark: SparkSession, root: str) -> DataFrame:
        tags = typed(spark, root, "documents").df.select("doc_id", change(F.col("tags")).alias("t"))
        return tags.select("doc_id", F.size("t").alias("n"), F.array_join("t", " ").alias("tags"))

    _add(name, run, f"SELECT doc_id, len(t)::INT AS n, array_to_string(t, ' ') AS tags FROM (SELECT doc_id, {sql} AS t FROM (SELECT doc_id, coalesce(tags, []) AS tags FROM {D}))")


_tags("transform_array_union", lambda tags: union_elements(tags, F.array(F.lit("the"), F.lit("zzz"), F.lit("zzz"))),
      "tags || CASE WHEN list_contains(tags, 'the') THEN [] ELSE ['the'] END || CASE WHEN list_contains(tags, 'zzz') THEN [] ELSE ['zzz'] END")
_tags("transform_array_remove", lambda tags: remove_elements(tags, F.array(F.lit("the"), F.lit("a"))), "list_filter(tags, lambda x: x NOT IN ('the', 'a'))")


# the store: what is written comes back
def _store_round_trip(spark: SparkSession, root: str) -> DataFrame:
    store = DocumentStore(spark, fresh(spark, "store"))
    store.load(stored(spark, root).df)
    return store.snapshot().select("document_path", "collection_path", "data", "version")


_add("store_load_snapshot", _store_round_trip, f"WITH {CURRENT}, v AS (SELECT document_path, max(version) AS version FROM winche_documents GROUP BY document_path) SELECT c.document_path, regexp_replace(c.document_path, '/[^/]*$', '') AS collection_path, data, version FROM current c JOIN v USING (document_path)")


def _store_feed(spark: SparkSession, root: str) -> DataFrame:
    """The feed of a bulk load, through the streaming source, in one available-now run."""
    store = DocumentStore(spark, fresh(spark, "store"))
    store.load(stored(spark, root).df)
    out = fresh(spark, "streamed")
    change_stream(store, 0).writeStream.format("parquet").option("checkpointLocation", fresh(spark, "stream")).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.parquet(out).select("document_path", "type", "version")


_add("stream_feed", _store_feed, "SELECT document_path, 'added' AS type, max(version) AS version FROM winche_documents GROUP BY document_path")


# an index on stored documents: the same answers from shredded columns
def _indexed(spark: SparkSession, root: str, q: dict) -> DataFrame:
    index = Index("orders", (Order("total"), Order("status")), Unary("exists", "total"))
    src = Indexes(spark, fresh(spark, "indexes")).build(stored(spark, root).df, index)
    return matching(src, parse_query({"collection": ORDERS, **q})).select("document_path")


_add("indexed_gt_number", lambda spark, root: _indexed(spark, root, {"where": field("total", "gt", integerValue="100")}), SQL["stored_gt_number"])
_add("indexed_cursor", lambda spark, root: _indexed(spark, root,
    {"where": field("status", "eq", stringValue="paid"), "orderBy": [{"field": "total", "direction": "desc"}], "end": _at(True, {"integerValue": "50"})}),
     f"{_C} SELECT document_path FROM docs WHERE json_extract_string(j, '$.status.stringValue') = 'paid' AND (NOT json_exists(j, '$.total.nullValue') AND NOT json_exists(j, '$.total.booleanValue') AND json_exists(j, '$.total') "
     "AND (json_extract_string(j, '$.total.doubleValue') IS NULL OR json_extract_string(j, '$.total.doubleValue') <> 'NaN')) AND coalesce(coalesce(json_extract_string(j, '$.total.doubleValue'), json_extract_string(j, '$.total.integerValue'))::DOUBLE > 50, true)")
