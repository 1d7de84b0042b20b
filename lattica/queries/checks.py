"""What the library refuses and why, transactions and access rules, as tables; with SQL that lists or computes the same."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lattica.database import TransactionContext, open_database
from lattica.functions.values import Value, integer
from lattica.operators.conditions import Auth, Field
from lattica.operators.rules import Rules, permitted
from lattica.operators.writes import Set, WriteError, parse_write
from lattica.plans.ast import ParseError, QueryError, query_key
from lattica.plans.normalizer import check_aggregations, normalize
from lattica.plans.parser import parse_aggregations, parse_query
from lattica.queries.engine import stored
from lattica.queries.pipeline import CURRENT
from lattica.sources.shared import fresh
from lattica.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_i, _s = (lambda n: {"integerValue": str(n)}), (lambda x: {"stringValue": x})
_where = lambda f: {"collection": "c", "where": f}
_by_f = [{"field": "f"}]

#: Queries that have no meaning, and the codes that say why.
_CODES = [
    ({"collection": "c/d"}, "BAD_COLLECTION_PATH"), ({"collection": "c", "limit": 0}, "BAD_LIMIT"), ({"collection": "c", "offset": -1}, "BAD_OFFSET"),
    ({"collection": "c", "orderBy": _by_f, "limitToLast": 0}, "BAD_LIMIT_TO_LAST"),
    ({"collection": "c", "orderBy": _by_f, "limit": 1, "limitToLast": 1}, "LIMIT_CONFLICT"),
    ({"collection": "c", "orderBy": _by_f, "offset": 1, "limitToLast": 1}, "OFFSET_LIMIT_TO_LAST"),
    ({"collection": "c", "limitToLast": 1}, "LIMIT_TO_LAST_NO_ORDER"), ({"collection": "c", "orderBy": _by_f, "start": {"values": [], "before": True}}, "CURSOR_ARITY"),
    ({"collection": "c", "start": {"values": [_i(1)], "before": True}}, "CURSOR_TYPE"), (_where({"and": []}), "EMPTY_COMPOSITE"),
    (_where({"field": "f", "op": "in", "value": _i(1)}), "OPERAND_TYPE"),
    (_where({"field": "f", "op": "regex", "value": _i(1)}), "OPERAND_TYPE"),
    (_where({"field": "__name__", "op": "contains", "value": _s("x")}), "NAME_OPERATOR"), (_where({"unary": "exists", "field": "__name__"}), "NAME_OPERATOR"),
    (_where({"compare": {"left": "a", "op": "in", "right": "b"}}), "COMPARE_OP"), (_where({"compare": {"left": "__name__", "op": "eq", "right": "b"}}), "COMPARE_OP"),
    ({"collection": "c", "orderBy": _by_f, "limit": 3, "start": {"values": [_i(1), _s("c/a")], "before": False}}, "none"),
]
#: Inputs that are no query, and the place of the offending part.
_PLACES = [
    ({"collection": "c", "nope": 1}, "$.nope"), ({"collection": "c", "limit": "5"}, "$.limit"),
    (_where({"field": "f", "op": "like", "value": _i(1)}), "$.where.op"), (_where({"field": "f", "op": "eq"}), "$.where.value"),
    (_where({"and": [{"unary": "x", "field": "f"}]}), "$.where.and[0].unary"),
    ({"collection": "c", "orderBy": [{"field": "a..b"}]}, "$.orderBy[0].field"), ({"collection": "c", "start": {"values": []}}, "$.start.before"),
    (_where({"field": "f", "op": "eq", "value": {"integerValue": "1"}}), "none"),
]
_AGGREGATIONS = [
    ([], "AGGREGATION_COUNT"), ([{"kind": "count", "alias": str(n)} for n in range(6)], "AGGREGATION_COUNT"),
    ([{"kind": "count", "alias": "a"}, {"kind": "sum", "alias": "a", "field": "f"}], "AGGREGATION_ALIAS"),
    ([{"kind": "sum", "alias": "a", "field": "__name__"}], "AGGREGATION_FIELD"), ([{"kind": "average", "alias": "a", "field": "f"}], "none"),
]
#: Writes to a store that holds ``c/here`` only, and the status they end with.
_WRITES = [
    ([{"update": {"path": "c/none", "fields": {}}}], "NOT_FOUND"),
    ([{"set": {"path": "c/here", "fields": {}, "precondition": {"exists": False}}}], "ALREADY_EXISTS"),
    ([{"delete": {"path": "c/none", "precondition": {"exists": True}}}], "NOT_FOUND"),
    ([{"set": {"path": "c/here", "fields": {}, "precondition": {"updateTime": "2001-01-01T00:00:00Z"}}}], "FAILED_PRECONDITION"),
    ([], "INVALID_ARGUMENT"), ([{"set": {"path": "c", "fields": {}}}], "INVALID_ARGUMENT"),
    ([{"set": {"path": "c/x", "fields": {"a": {"deleteField": True}}}}], "INVALID_ARGUMENT"),
    ([{"set": {"path": "c/x", "fields": {"__a__": _i(1)}}}], "INVALID_ARGUMENT"),
    ([{"set": {"path": "c/x", "merge": True, "mergeFields": ["a"], "fields": {}}}], "INVALID_ARGUMENT"),
    ([{"update": {"path": "c/here", "fields": {}, "transforms": [{"field": "a", "kind": "increment", "operand": _s("x")}]}}], "INVALID_ARGUMENT"),
    ([{"set": {"path": "c/x", "fields": {}}}, {"update": {"path": "c/none", "fields": {}}}], "NOT_FOUND"),
    ([{"set": {"path": f"c/{n}", "fields": {}}} for n in range(501)], "INVALID_ARGUMENT"), ([{"delete": {"path": "c/none"}}], "none"),
]


def _outcome(call: Callable[[], object]) -> str:
    try:
        call()
    except QueryError as e:
        return e.code
    except ParseError as e:
        return e.at
    except WriteError as e:
        return e.status
    return "none"


def _listed(name: str, cases: list[tuple], check: Callable) -> None:
    """A table of cases and what came of them, beside the list of what should."""
    def run(spark: SparkSession, root: str) -> DataFrame:
        done = check(spark)
        return spark.createDataFrame([(n, _outcome(lambda case=case: done(case))) for n, (case, _) in enumerate(cases)], "n int, outcome string")

    QUERIES[name] = run
    SQL[name] = f"SELECT n::INT AS n, outcome FROM (VALUES {', '.join(f'({n}, {want!r})' for n, (_, want) in enumerate(cases))}) v(n, outcome)"


def _refused(spark: SparkSession) -> Callable:
    db = open_database(spark, fresh(spark, "store"))
    db.write([Set("c/here", {})])
    return lambda writes: db.write([parse_write(w) for w in writes])


_listed("validation_codes", _CODES, lambda spark: lambda q: normalize(parse_query(q)))
_listed("parse_places", _PLACES, lambda spark: parse_query)
_listed("aggregation_codes", _AGGREGATIONS, lambda spark: lambda a: check_aggregations(parse_aggregations(a)))
_listed("write_statuses", _WRITES, _refused)


def _canonical(spark: SparkSession, root: str) -> DataFrame:
    """One filter for each part in its canonical JSON, which reads back as the same query."""
    out = []
    for r in table(spark, root, "nation").select("n_nationkey", "n_name").collect():  # a fixed table of 25
        q = parse_query({"limit": 5, "where": {"value": _s(r["n_name"]), "op": "eq", "field": "name"}, "collection": "c", "orderBy": [{"field": "f"}]})
        assert parse_query(json.loads(query_key(q))) == q
        out.append((r["n_nationkey"], query_key(q)))
    return spark.createDataFrame(out, "n_nationkey int, query string")


QUERIES["canonical_json"] = _canonical
SQL["canonical_json"] = """SELECT n_nationkey, '{"collection":"c","limit":5,"orderBy":[{"direction":"asc","field":"f"}],"where":{"field":"name","op":"eq","value":{"stringValue":"' || n_name || '"}}}' AS query FROM nation"""


def _transactions(spark: SparkSession, root: str) -> DataFrame:
    """A counter raised by a transaction for each region; the first meets another writer and begins again."""
    db = open_database(spark, fresh(spark, "store"))
    db.write([Set("counters/all", {"n": integer(0)})])
    tries = []

    def raise_by_one(tx: TransactionContext) -> None:
        n = tx.get("counters/all").fields["n"].v
        tries.append(n)
        if len(tries) == 1:
            db.write([Set("counters/all", {"n": integer(100)})])
        tx.write(Set("counters/all", {"n": integer(n + 1)}))

    for _ in range(table(spark, root, "region").count()):  # a fixed table of 5
        db.run_transaction(raise_by_one)
    d = db.get("counters/all")
    return spark.createDataFrame([(d.fields["n"].v, d.version, len(tries))], "n long, version long, tries long")


QUERIES["transaction_counter"] = _transactions
SQL["transaction_counter"] = "SELECT 100 + count(*) AS n, count(*) + 2 AS version, count(*) + 1 AS tries FROM region"


def _readable(spark: SparkSession, root: str) -> DataFrame:
    """The stored documents that a caller may get: comments by authors before a letter, and presence of those online."""
    rules = Rules().allow("posts/{post}/comments/{id}", "read", Field("author") < Auth("upto")).allow("presence/{id}", "get", Field("online") == True)  # noqa: E712
    return permitted(stored(spark, root).df, rules, "get", {"upto": Value("reference", "users/M")})


QUERIES["rules_get"] = _readable
SQL["rules_get"] = f"""WITH {CURRENT}, docs AS (SELECT document_path, CASE WHEN json_valid(data) THEN data::JSON ELSE '{{}}'::JSON END AS j FROM current)
    SELECT document_path FROM docs WHERE (regexp_matches(document_path, '^posts/[^/]+/comments/[^/]+$') AND json_extract_string(j, '$.author.referenceValue') < 'users/M')
        OR (regexp_matches(document_path, '^presence/[^/]+$') AND json_extract_string(j, '$.online.booleanValue') = 'true')"""
