"""Filters, cursors, orders and aggregates over a field that holds values of every type, with SQL for the same results.

The collection is made of the events: an event's number decides the type of its field ``f`` (or that it has none), its user
and kind the value, and ``g`` is a number that a third of them lack.
"""

from __future__ import annotations

import base64
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.values import Value, from_json
from lattica.operators.aggregates import count_frame, typed_frame
from lattica.plans.ast import Cursor, Order, Query, query_json
from lattica.plans.compiler import matching, page
from lattica.plans.parser import parse_aggregations, parse_query
from lattica.sources.collections import TaggedCollections
from lattica.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Types by the remainder of an event's number, as JSON made of its columns.
_FORMS = [
    """'{"nullValue":null}'""", """concat('{"booleanValue":', CAST(user_id % 2 = 0 AS STRING), '}')""", """'{"doubleValue":"NaN"}'""",
    """concat('{"integerValue":"', user_id, '"}')""", """concat('{"doubleValue":', CAST(user_id / 2.0D AS STRING), '}')""",
    """concat('{"timestampValue":"', date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), '"}')""", """concat('{"stringValue":"', event_type, '-', user_id, '"}')""",
    """concat('{"bytesValue":"', base64(encode(concat('b', user_id), 'UTF-8')), '"}')""", """concat('{"referenceValue":"users/u', user_id, '"}')""",
    """concat('{"geoPointValue":{"latitude":', user_id % 90, ',"longitude":', user_id - 75, '}}')""",
    """concat('{"arrayValue":{"values":[{"integerValue":"', user_id % 5, '"},{"stringValue":"', event_type, '"}]}}')""",
    """concat('{"mapValue":{"fields":{"k":{"integerValue":"', user_id % 5, '"}}}}')""",
]
_F = "CASE CAST(event_id % 13 AS INT) " + " ".join(f"WHEN {n} THEN {form}" for n, form in enumerate(_FORMS)) + " END"
_DATA = f"""concat('{{', concat_ws(',', CASE WHEN event_id % 13 < 12 THEN concat('"f":', {_F}) END,
    CASE WHEN event_id % 3 <> 0 THEN concat('"g":{{"integerValue":"', user_id % 100, '"}}') END), '}}')"""
#: Rank, number and the rest of the value as plain columns.
_KINDS = """kinds AS (
    SELECT event_id, 'kinds/' || event_id AS p, event_id % 13 AS k, user_id AS u, event_type AS t, ts,
        [10, 20, 29, 30, 30, 40, 50, 60, 70, 80, 90, 100][event_id % 13 + 1] AS r,
        CASE event_id % 13 WHEN 3 THEN user_id::DOUBLE WHEN 4 THEN user_id / 2.0 END AS num,
        CASE event_id % 13 WHEN 6 THEN event_type || '-' || user_id WHEN 7 THEN 'b' || user_id WHEN 8 THEN 'users/u' || user_id END AS s,
        CASE WHEN event_id % 3 <> 0 THEN user_id % 100 END AS g FROM events)"""
_ORDER = ["r", "num", "(k = 1 AND u % 2 = 0)", "CASE WHEN k = 5 THEN ts END", "s", "CASE WHEN k = 9 THEN u % 90 END", "CASE WHEN k = 9 THEN u END",
    "CASE WHEN k IN (10, 11) THEN u % 5 END", "CASE WHEN k = 10 THEN t END"]


def kinds(spark: SparkSession, root: str) -> TaggedCollections:
    e = table(spark, root, "events")
    return TaggedCollections(e.select(
        F.concat(F.lit("kinds/"), F.col("event_id").cast("string")).alias("document_path"), F.lit("kinds").alias("collection_id"),
        F.expr(_DATA).alias("data"), F.lit(1).cast("long").alias("version")))


def _add(name: str, build: Callable, sql: str) -> None:
    QUERIES[name] = build
    SQL[name] = f"WITH {_KINDS} {sql}"


def _filter(name: str, where: dict, condition: str) -> None:
    """A filter and its negation over the whole collection."""
    for full, node in ((f"kind_{name}", where), (f"kind_not_{name}", {"not": where})):
        q = parse_query({"collection": "kinds", "where": node})
        # a condition is null where the operator leaves a missing field undecided
        sql = f"SELECT p AS document_path FROM kinds WHERE {condition}" if node is where else f"SELECT p AS document_path FROM kinds WHERE NOT ({condition})"
        _add(full, lambda spark, root, q=q: matching(kinds(spark, root), q).select("document_path"), sql)


def _test(op: str, value: dict, field: str = "f") -> dict:
    return {"field": field, "op": op, "value": value}


_present = lambda condition: f"CASE WHEN k < 12 THEN coalesce({condition}, false) END"
_array = lambda *values: {"arrayValue": {"values": list(values)}}
_map = lambda **fields: {"mapValue": {"fields": fields}}
_i = lambda n: {"integerValue": str(n)}
_s = lambda x: {"stringValue": x}
_b = lambda x: {"bytesValue": base64.b64encode(x).decode()}
_geo = lambda lat, lng: {"geoPointValue": {"latitude": lat, "longitude": lng}}
_FORTY = "num = 40"

for _name, _value, _condition in (
    ("null", {"nullValue": None}, "k = 0"), ("bool", {"booleanValue": True}, "k = 1 AND u % 2 = 0"), ("nan", {"doubleValue": "NaN"}, "k = 2"),
    ("number", {"doubleValue": 40.0}, _FORTY),
    ("string", _s("view-40"), "k = 6 AND s = 'view-40'"), ("bytes", _b(b"b40"), "k = 7 AND s = 'b40'"),
    ("reference", {"referenceValue": "users/u40"}, "k = 8 AND s = 'users/u40'"), ("geopoint", _geo(40, -35.0), "k = 9 AND u = 40"),
    ("array", _array({"doubleValue": 3.0}, _s("view")), "k = 10 AND u % 5 = 3 AND t = 'view'"), ("map", _map(k={"doubleValue": 2.0}), "k = 11 AND u % 5 = 2"),
):
    _filter(f"eq_{_name}", _test("eq", _value), _present(_condition))
    if _name != "nan":
        # null and NaN differ from nothing
        _filter(f"ne_{_name}", _test("ne", _value), f"k NOT IN (0, 2, 12) AND NOT coalesce({_condition}, false)")
for _name, _op, _value, _condition in (
    ("gt_bool", "gt", {"booleanValue": False}, "k = 1 AND u % 2 = 0"), ("gte_number", "gte", _i(50), "num >= 50"), ("lt_number", "lt", {"doubleValue": 12.5}, "num < 12.5"),
    ("lt_timestamp", "lt", {"timestampValue": "2024-01-10T00:00:00Z"}, "k = 5 AND ts < TIMESTAMP '2024-01-10 00:00:00'"),
    ("lte_string", "lte", _s("error-9"), "k = 6 AND s <= 'error-9'"),
    ("gte_bytes", "gte", _b(b"b5"), "k = 7 AND s >= 'b5'"), ("lt_reference", "lt", {"referenceValue": "users/u3"}, "k = 8 AND s < 'users/u3'"),
    ("gt_geopoint", "gt", _geo(40, -35), "k = 9 AND (u % 90 > 40 OR u % 90 = 40 AND u > 40)"),
    ("gt_array", "gt", _array(_i(2), _s("error")), "k = 10 AND (u % 5 > 2 OR u % 5 = 2 AND t > 'error')"),
    ("gte_array_prefix", "gte", _array(_i(2)), "k = 10 AND u % 5 >= 2"), ("lte_map", "lte", _map(k=_i(2)), "k = 11 AND u % 5 <= 2"),
):
    _filter(_name, _test(_op, _value), _present(_condition))
# a range against null or NaN holds for nothing, missing fields included, so its negation keeps all
_filter("gte_null", _test("gte", {"nullValue": None}), "false")
_filter("lt_nan", _test("lt", {"doubleValue": "NaN"}), "false")
_filter("in", _test("in", _array({"doubleValue": 40.0}, _s("view-40"), _array(_i(3), _s("view")), {"booleanValue": False})),
    _present("num = 40 OR k = 6 AND s = 'view-40' OR k = 10 AND u % 5 = 3 AND t = 'view' OR k = 1 AND u % 2 <> 0"))
_filter("in_none", _test("notIn", _array(_i(40), _b(b"b40"))), "k NOT IN (0, 2, 12) AND NOT coalesce(num = 40 OR k = 7 AND s = 'b40', false)")
_filter("array_contains", _test("arrayContains", {"doubleValue": 3.0}), "k = 10 AND u % 5 = 3")
_filter("array_contains_any", _test("arrayContainsAny", _array(_i(1), _s("view"))), "k = 10 AND (u % 5 = 1 OR t = 'view')")
_filter("array_contains_all", _test("arrayContainsAll", _array(_i(1), _s("view"))), "k = 10 AND u % 5 = 1 AND t = 'view'")
_filter("contains", _test("contains", _s("IE")), _present("k = 6 AND s LIKE '%ie%'"))
_filter("starts_with", _test("startsWith", _s("View-4")), _present("k = 6 AND s LIKE 'view-4%'"))
_filter("ends_with", _test("endsWith", _s("7")), _present("k = 6 AND s LIKE '%7'"))
_filter("regex", _test("regex", _s("^(view|error)-[0-9]$")), _present("k = 6 AND regexp_matches(s, '^(view|error)-[0-9]$')"))
_filter("is_null", {"unary": "isNull", "field": "f"}, _present("k = 0"))
_filter("is_nan", {"unary": "isNan", "field": "f"}, _present("k = 2"))
_filter("exists", {"unary": "exists", "field": "f"}, "k < 12")
# fields compare across types: ranks first, so null, booleans and NaN lie below the numbers of g
_BELOW = "(r < 30 OR r = 30 AND num < g)"
_filter("compare_lt", {"compare": {"left": "f", "op": "lt", "right": "g"}}, f"CASE WHEN k < 12 AND g IS NOT NULL THEN coalesce({_BELOW}, false) END")
_filter("compare_gte", {"compare": {"left": "f", "op": "gte", "right": "g"}}, f"CASE WHEN k < 12 AND g IS NOT NULL THEN NOT coalesce({_BELOW}, false) END")
_filter("compare_eq", {"compare": {"left": "f", "op": "eq", "right": "g"}}, "CASE WHEN k < 12 AND g IS NOT NULL THEN coalesce(num = g, false) END")
_filter("compare_ne", {"compare": {"left": "f", "op": "ne", "right": "g"}}, "k < 12 AND g IS NOT NULL AND NOT coalesce(num = g, false)")
_filter("or_and", {"or": [{"and": [_test("gt", _i(20)), _test("lt", _i(60), "g")]}, _test("eq", {"nullValue": None})]},
    f"({_present('num > 20')} AND g < 60) OR {_present('k = 0')}")


# order over all types
def _page(name: str, q: dict, order: str, limit: str) -> None:
    parsed = parse_query({"collection": "kinds", **q})
    _add(name, lambda spark, root: page(kinds(spark, root), parsed).select("document_path"), f"SELECT p AS document_path FROM kinds WHERE k < 12 ORDER BY {order} {limit}")


_ASC, _DESC = (", ".join(f"{x} {d}" for x in [*_ORDER, "p"]) for d in ("ASC", "DESC"))
for _n, (_skip, _take) in enumerate(((0, 1000), (2500, 700), (5000, 1300), (8000, 500))):
    _page(f"kind_order_{_n}", {"orderBy": [{"field": "f"}], "offset": _skip, "limit": _take}, _ASC, f"LIMIT {_take} OFFSET {_skip}")
    _page(f"kind_order_desc_{_n}", {"orderBy": [{"field": "f", "direction": "desc"}], "offset": _skip, "limit": _take}, _DESC, f"LIMIT {_take} OFFSET {_skip}")
_page("kind_limit_to_last", {"orderBy": [{"field": "f"}], "limitToLast": 1200}, _DESC, "LIMIT 1200")


# cursors across types
def _cursor(name: str, condition: str, desc: bool = False, **bounds) -> None:
    q = parse_query({"collection": "kinds", "orderBy": [{"field": "f", "direction": "desc" if desc else "asc"}], **bounds})
    _add(name, lambda spark, root: matching(kinds(spark, root), q).select("document_path"), f"SELECT p AS document_path FROM kinds WHERE k < 12 AND coalesce({condition}, false)")


_at = lambda before, *values: {"values": list(values), "before": before}
_cursor("kind_start_at_number", "r > 30 OR num >= 40", start=_at(True, _i(40)))
_cursor("kind_start_after_geopoint", "r > 80 OR k = 9 AND (u % 90 > 40 OR u % 90 = 40 AND u > 40)", start=_at(False, _geo(40, -35)))
_cursor("kind_end_at_array", "r < 90 OR k = 10 AND (u % 5 < 2 OR u % 5 = 2 AND t <= 'error')", end=_at(False, _array(_i(2), _s("error"))))
_cursor("kind_end_before_bytes", "r < 60 OR k = 7 AND s < 'b5'", end=_at(True, _b(b"b5")))
_cursor("kind_between_types", "r > 20 AND r < 50", start=_at(False, {"booleanValue": True}), end=_at(True, _s("")))
_cursor("kind_descending", "r < 70 OR k = 8 AND s <= 'users/u5'", True, start=_at(True, {"referenceValue": "users/u5"}))
_cursor("kind_cursor_with_path", "r > 30 OR num > 40 OR num = 40 AND p > 'kinds/500'", start=_at(False, _i(40), _s("kinds/500")))


def _from_document(spark: SparkSession, root: str) -> DataFrame:
    """All documents after one of them in order."""
    import json

    src, order = kinds(spark, root), (Order("f"),)
    found = src.df.where("document_path = 'kinds/160'").first()
    fields: dict[str, Value] = {k: from_json(v) for k, v in json.loads(found["data"]).items()}
    q = Query("kinds", order_by=order, start=Cursor.of_document(fields, "kinds/160", order, before=False))
    return matching(src, parse_query(query_json(q))).select("document_path")


_add("kind_after_document", _from_document, f"""
    SELECT x.p AS document_path FROM (SELECT *, row_number() OVER (ORDER BY {_ASC}) AS n FROM kinds WHERE k < 12) x,
    (SELECT n FROM (SELECT p, row_number() OVER (ORDER BY {_ASC}) AS n FROM kinds WHERE k < 12) WHERE p = 'kinds/160') y WHERE x.n > y.n""")


# counts and aggregates of tagged fields
def _aggregate(name: str, where: dict | None, aggs: list[dict], casts: dict[str, str], sql: str) -> None:
    q = parse_query({"collection": "kinds", **({"where": where} if where else {})})

    def run(spark: SparkSession, root: str) -> DataFrame:
        df = typed_frame(kinds(spark, root), q, parse_aggregations(aggs))
        return df.select(*[F.col(c).cast(casts.get(c, "double")).alias(c) for c in df.columns])

    _add(name, run, sql)


_aggregate("kind_sum_numbers", _test("gte", _i(0)), [{"kind": "count", "alias": "n"}, {"kind": "sum", "alias": "s", "field": "f"},
    {"kind": "average", "alias": "a", "field": "f"}, {"kind": "sum", "alias": "sg", "field": "g"}],
           {"n": "bigint"}, "SELECT count(*) AS n, sum(num) AS s, sum(num) / count(num) AS a, sum(g)::DOUBLE AS sg FROM kinds WHERE num >= 0")
_aggregate("kind_sum_with_nan", None, [{"kind": "count", "alias": "n"}, {"kind": "sum", "alias": "s", "field": "f"}], {"n": "bigint"},
           "SELECT count(*) AS n, sum(CASE WHEN k = 2 THEN 'NaN'::DOUBLE ELSE num END) AS s FROM kinds")
_aggregate("kind_average_of_others", _test("gte", _s("")), [{"kind": "average", "alias": "a", "field": "f"}, {"kind": "average", "alias": "ag", "field": "g"}], {},
           "SELECT avg(num) AS a, sum(g) / count(g) AS ag FROM kinds WHERE k = 6")
for _name, _where, _sql in (("all", None, "true"), ("strings", _test("gte", _s("")), "k = 6"), ("missing", {"not": {"unary": "exists", "field": "f"}}, "k = 12")):
    _q = parse_query({"collection": "kinds", **({"where": _where} if _where else {})})
    _add(f"kind_count_{_name}", lambda spark, root, q=_q: count_frame(kinds(spark, root), q, "n"), f"SELECT count(*) AS n FROM kinds WHERE {_sql}")
_q_ordered = parse_query({"collection": "kinds", "orderBy": [{"field": "g"}], "limit": 3000})
_add("kind_count_ordered", lambda spark, root: count_frame(kinds(spark, root), _q_ordered, "n"), "SELECT least(count(*), 3000) AS n FROM kinds WHERE g IS NOT NULL")
