"""Indexed layouts answer as the documents do."""

import re

import pytest
from helpers import arr, boundary_values, collection_of, d, documents, i, s, t

from lattica.functions.values import Value
from lattica.plans.ast import And, Cursor, Not, Or, Order, Query, QueryError, Unary
from lattica.plans.compiler import matching, page
from lattica.sources.collections import TaggedCollections
from lattica.sources.indexes import Index, Indexes
from lattica.sources.shared import fresh

INDEX = Index("c", (Order("f"), Order("g", True)))


@pytest.fixture(scope="module")
def both(spark):
    values = boundary_values()
    docs = collection_of(values) | {f"c/g{n}": {"f": v, "g": i(n % 3)} for n, v in enumerate(values[::7])} | {"a/b/c/deep": {"f": i(5)}, "d/x": {"f": i(5)}}
    df = documents(spark, docs)
    return TaggedCollections(df), Indexes(spark, fresh(spark, "ix")).build(df, INDEX)


def test_all_comparisons(both):
    plain, indexed = both
    values = [Value("boolean", True), i(1), d(1.5), s("a"), Value("timestamp", 1), Value("bytes", b"\x7f\x00"), Value("reference", "a/x"),
        Value("geopoint", (0.25, 0.0)), arr(i(1), s("b"))]
    for v in values:
        conditions = {op: f for op in ("eq", "ne", "gt", "lte") for f in (t(op, v),)} | {f"not {op}": Not(t(op, v)) for op in ("eq", "gt", "ne")}
        cols = lambda src: matching(src, Query("c")).select("document_path", *[_column(src, f).alias(n) for n, f in conditions.items()])  # noqa: E731, B023
        assert sorted(map(tuple, cols(plain).collect())) == sorted(map(tuple, cols(indexed).collect())), v


def _column(src, f):
    from lattica.operators.predicates import compile_filter

    return compile_filter(src, f)


def test_order_and_cursor(both):
    plain, indexed = both
    for q in (Query("c", None, (Order("f"),)), Query("c", None, (Order("f", True), Order("g")), limit=20),
        Query("c", None, (Order("f"),), start=Cursor((i(5),), False), end=Cursor((s("b"),), True)), Query("a/b/c")):
        names = [[r["document_id"] for r in page(src, q).collect()] for src in (plain, indexed)]
        assert names[0] == names[1] and names[0]


def test_comparisons_reach_the_reader(spark, both):
    spark.conf.set("spark.sql.maxMetadataStringLength", 5000)
    text = matching(both[1], Query("c", t("gt", i(5)))).select("document_path")._jdf.queryExecution().executedPlan().toString()
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", text)[1]
    assert "EqualTo(__f0_rank,30)" in pushed and "GreaterThan(__f0_num,5.0)" in pushed and "data" not in text.split("ReadSchema")[1]


def test_filtered_indexes_names_and_drop(spark):
    df = documents(spark, {f"c/{n}": {"f": i(n)} for n in range(10)})
    index, store = Index("c", (Order("f"),), And((t("gte", i(5)), Unary("exists", "f")))), Indexes(spark, fresh(spark, "ix"))
    assert store.build(df, index).df.count() == 5 and store.build(df.limit(0), index).df.count() == 0
    assert index.name == Index("c", (Order("f"),), index.where).name != Index("c", (Order("f", True),), index.where).name
    store.drop(index)
    with pytest.raises(QueryError):
        store.open(index)
    for bad in (lambda: Index("a/b", (Order("f"),)), lambda: Index("c", ()), lambda: Index("c", (Order("f"),), Or((t("eq", i(1)),))),
        lambda: Index("c", (Order("f"),), t("ne", i(1)))):
        with pytest.raises(QueryError):
            bad()
