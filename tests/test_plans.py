"""Typed collections: comparisons over typed columns, and the physical plans queries compile to."""

import re
from datetime import datetime

import pytest
from helpers import NAN, arr, d, i, s, t

from lattica.functions import values as V
from lattica.functions.values import Value
from lattica.plans.ast import And, Compare, Not, Order, Query, Unary
from lattica.plans.compiler import matching, page
from lattica.sources.collections import TaggedCollections, TypedCollection
from lattica.sources.shared import fresh


@pytest.fixture(scope="module")
def things(spark):
    rows = [
        (1, 5, 5.0, "Apple", True, datetime(2025, 1, 1), bytearray(b"\x01"), [1, 2], ["x"], (1, "k")),
        (2, 2**53 + 1, float(2**53), "banana", False, datetime(2025, 1, 2, 3, 4, 5, 678901), bytearray(b"\x02"), [2], None, (2, None)),
        (3, None, NAN, None, None, None, None, None, [], None), (4, -7, float("inf"), "100% é", True, datetime(1969, 12, 31), bytearray(b""), [], ["x", "y"], (None, "z")),
    ]
    df = spark.createDataFrame(rows, "id int, n long, x double, s string, b boolean, at timestamp_ntz, raw binary, ints array<int>, names array<string>, sub struct<q:int,r:string>")
    path = fresh(spark, "things")
    df.write.parquet(path)
    return TypedCollection("things", spark.read.parquet(path), "id")


def ids(src, f):
    return sorted(r["id"] for r in matching(src, Query("things", f)).select("id").collect())


@pytest.mark.parametrize(("f", "expected"), [
    (t("eq", d(5.0), "n"), [1]), (t("eq", d(5.5), "n"), []), (Not(t("eq", d(5.5), "n")), [1, 2, 4]), (t("gt", d(4.5), "n"), [1, 2]),
    (t("lt", d(-6.5), "n"), [4]), (t("gt", d(float("inf")), "n"), []), (t("lt", d(1e300), "n"), [1, 2, 4]),
    (t("eq", i(2**53 + 1), "x"), []), (t("eq", i(2**53), "x"), [2]), (t("lt", i(2**53 + 1), "x"), [1, 2]), (t("gte", i(2**53 + 1), "x"), [4]),
    (t("gt", i(5), "x"), [2, 4]), (t("eq", d(NAN), "x"), [3]), (t("ne", d(5), "x"), [2, 4]), (Unary("isNan", "x"), [3]),
    (Not(t("gt", i(5), "x")), [1, 3]), (t("eq", s("5"), "n"), []), (Not(t("eq", s("5"), "n")), [1, 2, 4]), (t("gt", V.NULL, "n"), []),
    (t("ne", V.NULL, "n"), [1, 2, 4]), (Unary("isNull", "n"), []),
    (t("eq", Value("timestamp", 1735787045678901), "at"), [2]), (t("lt", Value("timestamp", 0), "at"), [4]),
    (t("gt", Value("bytes", b"\x01"), "raw"), [2]), (t("eq", Value("boolean", False), "b"), [2]),
    (t("contains", s("% É"), "s"), [4]), (t("startsWith", s("BAN"), "s"), [2]), (t("regex", s("^A"), "s"), [1]), (Not(t("contains", s("a"), "s")), [4]),
    (t("arrayContains", i(2), "ints"), [1, 2]), (t("arrayContains", d(2.0), "ints"), [1, 2]),
    (t("arrayContainsAny", arr(s("y"), i(1)), "names"), [4]), (t("arrayContainsAll", arr(s("x"), s("y")), "names"), [4]),
    (t("arrayContainsAll", arr(), "names"), [1, 3, 4]), (Not(t("arrayContains", s("x"), "names")), [2, 3]),
    (t("eq", arr(i(1), d(2.0)), "ints"), [1]), (t("lt", arr(i(2)), "ints"), [1, 4]), (t("eq", i(2), "sub.q"), [2]),
    (Unary("exists", "sub.r"), [1, 4]), (t("eq", Value("map", {"q": i(2)}), "sub"), [2]),
    (Compare("n", "eq", "x"), [1, 2]),  # fields of two number types compare by nearest double
     (Compare("x", "gt", "n"), [4]), (Compare("n", "ne", "s"), [1, 2, 4]), (Compare("id", "lt", "n"), [1, 2]), (Unary("exists", "nothing"), []),
     (Not(t("eq", i(1), "nothing")), []), (Not(t("ne", i(1), "nothing")), [1, 2, 3, 4]),
])
def test_typed_filters(things, f, expected):
    assert ids(things, f) == expected


def test_typed_order(things):
    order = lambda f, down=False: [r["id"] for r in page(things, Query("things", None, (Order(f, down),))).collect()]
    assert order("x") == [3, 1, 2, 4] and order("x", True) == [4, 2, 1, 3] and order("n") == [4, 1, 2] and order("ints") == [4, 1,
        2] and order("sub") == [1, 2, 4] and order("nothing") == []


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_reader(things):
    q = Query("things", And((t("gte", i(3), "n"), t("ne", s("x"), "s"))), (Order("n", True),), limit=5, select=("n",))
    text = plan(page(things, q))
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", text)[1]
    assert "GreaterThanOrEqual(n,3)" in pushed and "IsNotNull(n)" in pushed
    assert set(re.search(r"ReadSchema: struct<(.*?)>\s", text)[1].split(",")) == {"id:int", "n:bigint", "s:string"}
    assert "TakeOrderedAndProject" in text and "Python" not in text and "Exchange" not in text


def test_offset_is_one_top_k(things):
    text = plan(page(things, Query("things", None, (Order("n"),), limit=5, offset=2)))
    assert "TakeOrderedAndProject" in text and "Exchange" not in text


def test_paths_prune_stored_documents(spark):
    from lattica.database import open_database
    from lattica.operators.writes import Set

    db = open_database(spark, fresh(spark, "db"))
    db.write([Set("c/a", {"n": i(1)}), Set("d/a", {})])
    text = plan(db.matching({"collection": "c", "where": {"field": "n", "op": "gt", "value": {"integerValue": "0"}}}))
    assert re.search(r"PushedFilters: \[[^\]]*StringStartsWith\(document_path,c/\)", text) and "ArrowEvalPython" not in text
    got = plan(db.store.snapshot(paths=["c/a"]))
    assert re.search(r"PartitionFilters: \[[^\]]*collection_id[^\]]*c\)?", got)


def test_scalar_queries_over_stored_documents_stay_in_the_jvm(spark):
    from helpers import documents

    src = TaggedCollections(documents(spark, {"c/a": {"f": i(1)}}))
    for f in (t("eq", i(1)), t("gt", s("x")), t("in", arr(i(1), s("a"))), t("ne", V.NULL), t("contains", s("a"))):
        assert "Python" not in plan(matching(src, Query("c", f))), f
