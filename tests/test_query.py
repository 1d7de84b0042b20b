"""Filters, order, cursors, pages, aggregates and projections over tagged documents."""

import itertools
import json
import re

import pytest
from helpers import NAN, arr, boundary_values, collection_of, d, document_row, documents, i, mp, natural, s, source, t

from lattica.functions import values as V
from lattica.functions.values import Value
from lattica.operators.aggregates import aggregate_frame, finish
from lattica.operators.predicates import compile_filter
from lattica.plans.ast import And, Compare, Cursor, Not, Or, Order, ParseError, Query, QueryError, Unary, query_json
from lattica.plans.compiler import matching, page
from lattica.plans.normalizer import normalize, rewrite
from lattica.plans.parser import parse_aggregations, parse_query


VALUES = boundary_values()


@pytest.fixture(scope="module")
def every(spark):
    src = source(spark, collection_of(VALUES))
    src.df = src.df.cache()
    return src


def ids(src, f, collection="c"):
    return sorted(r[0] for r in matching(src, Query(collection, f)).select("document_id").collect())


def expected(op, v, x):
    """What a test of the field's value ``x`` (None: missing) against ``v`` says: True, False or None, by the rules alone."""
    null_or_nan = lambda y: natural(y)[0] in (10, 29)
    if op in ("ne", "notIn"):  # null, NaN and missing fields differ from nothing
        listed = v.v if op == "notIn" else (v,)
        return x is not None and not null_or_nan(x) and not any(natural(x) == natural(y) for y in listed)
    if op in ("gt", "gte", "lt", "lte") and null_or_nan(v):
        return False
    if x is None:
        return None
    a = natural(x)
    if op == "in":
        return any(a == natural(y) for y in v.v)
    b = natural(v)
    if op == "eq":
        return a == b
    return a[0] == b[0] and {"gt": a > b, "gte": a >= b, "lt": a < b, "lte": a <= b}[op]


def one_of_each():
    """A value from the middle of every type."""
    by_rank = {}
    for v in sorted(VALUES, key=natural):
        by_rank.setdefault(natural(v)[0], []).append(v)
    return [vs[len(vs) // 2] for vs in by_rank.values()]


@pytest.mark.parametrize("v", one_of_each(), ids=lambda v: v.kind)
def test_comparisons_by_the_rules(every, v):
    tests = {op: (op, v) for op in ("eq", "ne", "gt", "gte", "lt", "lte")} | {op: (op, arr(v, i(1), s("Z"))) for op in ("in", "notIn")}
    columns = [compile_filter(every, rewrite(t(op, operand))).alias(name) for name, (op, operand) in tests.items()]
    rows = {r["document_id"]: r for r in matching(every, Query("c")).select("document_id", *columns).collect()}
    for n, x in [*[(f"{n:03d}", x) for n, x in enumerate(VALUES)], ("bare", None)]:
        for name, (op, operand) in tests.items():
            assert rows[n][name] is expected(op, operand, x), (x, op, operand)


def test_a_missing_field_under_not(every):
    """Of the document without the field, not(...) keeps what is false there and drops what is undecided."""
    v = i(1)
    undecided = [t("eq", v), t("eq", V.NULL), t("eq", d(NAN)), t("in", arr(v)), *[t(op, v) for op in ("gt", "gte", "lt", "lte")],
        *[t(op, s("x")) for op in ("contains", "startsWith", "endsWith", "regex")],
                 Unary("isNull", "f"), Unary("isNan", "f"), *[Compare("f", op, "g") for op in ("eq", "gt", "gte", "lt", "lte")]]
    false = [t("ne", v), t("ne", V.NULL), t("notIn", arr(v)), t("arrayContains", v), t("arrayContainsAny", arr(v)), t("arrayContainsAll", arr(v)),
        *[t(op, x) for op in ("gt", "gte", "lt", "lte") for x in (V.NULL, d(NAN))],
             Unary("exists", "f"), Compare("f", "ne", "g")]
    columns = [compile_filter(every, Not(rewrite(f))).alias(str(n)) for n, f in enumerate(undecided + false)]
    row = matching(every, Query("c")).where("document_id = 'bare'").select(*columns).first()
    assert list(row) == [None] * len(undecided) + [True] * len(false)


def test_unary_and_composite_filters(every):
    place = {n: f"{n:03d}" for n in range(len(VALUES))}
    of = lambda test: [place[n] for n, x in enumerate(VALUES) if test(natural(x))]
    assert ids(every, Unary("isNull", "f")) == of(lambda k: k == (10,)) and ids(every, Unary("isNan", "f")) == of(lambda k: k == (29,))
    assert ids(every, Unary("exists", "f")) == of(lambda k: True) and ids(every, Not(Unary("exists", "f"))) == ["bare"]
    assert ids(every, And((Or((t("gte", i(0)), t("eq", s("a")))), Not(t("eq", d(0)))))) == of(lambda k: k[0] == 30 and k[1] > 0 or k == (50, b"a"))
    assert ids(every, t("gte", s("c/050"), "__name__")) == [*[p for p in place.values() if p >= "050"], "bare"]
    assert ids(every, t("eq", Value("reference", "c/007"), "__name__")) == ["007"]


def test_array_tests_by_the_rules(every):
    has = lambda x, w: x.kind == "array" and any(natural(y) == natural(w) for y in x.v)
    for wanted in ((d(1.0),), (i(1), s("b")), (V.NULL, d(1.5)), ()):
        some, whole = ids(every, t("arrayContainsAny", arr(*wanted))), ids(every, t("arrayContainsAll", arr(*wanted)))
        assert some == [f"{n:03d}" for n, x in enumerate(VALUES) if any(has(x, w) for w in wanted)]
        assert whole == [f"{n:03d}" for n, x in enumerate(VALUES) if x.kind == "array" and all(has(x, w) for w in wanted)]
        if len(wanted) == 1:
            assert ids(every, t("arrayContains", wanted[0])) == some


def test_text_filters(spark):
    """Texts around every sign that means something to LIKE, to regular expressions or to SQL."""
    signs = "%_\\'\"[]^$.*+?|()"
    texts = [f"Ab{c}Cd" for c in signs] + ["AbxCd", "abcd", "ABXCD", ""]
    src = source(spark, {f"c/{n:02d}": {"f": s(x)} for n, x in enumerate(texts)} | {"c/n": {"f": i(5)}})
    want = lambda test: [f"{n:02d}" for n, x in enumerate(texts) if test(x)]
    for c in signs:
        assert ids(src, t("contains", s(f"b{c}c"))) == want(lambda x: f"b{c}c" in x.lower())  # noqa: B023
        assert ids(src, t("startsWith", s(f"aB{c}"))) == want(lambda x: x.lower().startswith(f"ab{c}"))  # noqa: B023
        assert ids(src, t("endsWith", s(f"{c}CD"))) == want(lambda x: x.lower().endswith(f"{c}cd"))  # noqa: B023
        assert ids(src, t("regex", s(re.escape(f"b{c}C")))) == want(lambda x: f"b{c}C" in x)  # noqa: B023
    assert ids(src, t("regex", s("^A.*d$"))) == want(lambda x: x.startswith("A") and x.endswith("d"))
    assert ids(src, t("contains", s(""))) == want(lambda x: True) and ids(src, t("eq", s("x' OR '1'='1"))) == []


def test_field_against_field(spark):
    src = source(spark, {"c/w1": {"a": i(2), "b": d(1.5)}, "c/w2": {"a": i(1), "b": d(1.5)}, "c/w3": {"a": i(1)}})
    assert ids(src, Compare("a", "gt", "b")) == ["w1"]
    assert ids(src, Compare("a", "ne", "b")) == ["w1", "w2"]


def test_integers_beyond_doubles_compare_exactly(spark):
    big = 2**53
    src = source(spark, {"c/a": {"f": i(big)}, "c/b": {"f": i(big + 1)}, "c/c": {"f": d(big)}, "c/d": {"f": i(V.INT_MAX)}, "c/e": {"f": d(2.0**63)}})
    assert ids(src, t("eq", i(big + 1))) == ["b"]
    assert ids(src, t("eq", d(big))) == ["a", "c"]
    assert ids(src, t("gt", i(V.INT_MAX))) == ["e"]
    assert ids(src, t("lt", d(2.0**63))) == ["a", "b", "c", "d"]


def test_field_names_of_all_sorts(spark):
    odd = {"größe": i(1), "two words": i(2), "mapValue": i(3), "stringValue": mp(mapValue=i(4)), "q'\"x": i(5)}
    src = source(spark, {"c/a": odd, "c/b": {"mapValue": s("no")}})
    for name, n in (("größe", 1), ("two words", 2), ("mapValue", 3), ("stringValue.mapValue", 4), ("q'\"x", 5)):
        assert ids(src, t("eq", i(n), name)) == ["a"]


def test_unreadable_documents_have_no_fields(spark):
    rows = [document_row("c/ok", {"f": i(1)}), *[(*document_row(f"c/{n}", {})[:4], data, *document_row("c/x", {})[5:]) for n,
        data in (("null", None), ("cut", '{"f":{"integerValue":"1"},"g":{"str'), ("empty", ""))]]
    from helpers import SCHEMA

    from lattica.sources.collections import TaggedCollections

    src = TaggedCollections(spark.createDataFrame(rows, SCHEMA))
    assert ids(src, Unary("exists", "f")) == ["ok"]


def test_total_order_in_python_and_spark(every):
    in_order = sorted(range(len(VALUES)), key=lambda n: (natural(VALUES[n]), n))
    for a, b in itertools.combinations(range(len(VALUES)), 2):
        x, y = natural(VALUES[a]), natural(VALUES[b])
        assert V.compare(VALUES[a], VALUES[b]) == (x > y) - (x < y) == -V.compare(VALUES[b], VALUES[a])
        ka, kb = V.order_key(VALUES[a]), V.order_key(VALUES[b])
        assert (ka > kb) - (ka < kb) == (x > y) - (x < y)
    got = [r["document_id"] for r in page(every, Query("c", None, (Order("f"),), limit=1000)).collect()]
    assert got == [f"{n:03d}" for n in in_order]
    down = [r["document_id"] for r in page(every, Query("c", None, (Order("f", True),), limit=1000)).collect()]
    assert down == got[::-1]


def names(src, q):
    return [r["document_id"] for r in page(src, q).collect()]


def test_cursors(spark):
    src = source(spark, {"c/d1": {"n": i(1)}, "c/d2": {"n": i(2)}, "c/d3": {"n": i(2)}, "c/d4": {"n": i(3)}})
    by = (Order("n"),)
    run = lambda **k: names(src, Query("c", None, k.pop("order", by), **k))
    assert run(start=Cursor((i(2),), True)) == ["d2", "d3", "d4"]
    assert run(start=Cursor((i(2),), False)) == ["d4"]
    assert run(end=Cursor((i(2),), True)) == ["d1"]
    assert run(end=Cursor((i(2),), False)) == ["d1", "d2", "d3"]
    assert run(start=Cursor((i(2), s("c/d2")), False)) == ["d3", "d4"]
    assert run(order=(Order("n", True),), start=Cursor((i(2),), False)) == ["d1"]
    mixed = source(spark, {"c/b": {"n": Value("boolean", True)}, "c/n": {"n": i(5)}, "c/s": {"n": s("a")}})
    assert names(mixed, Query("c", None, by, start=Cursor((i(0),), True))) == ["n", "s"]


def test_page_walk_visits_each_once(spark):
    docs = {f"c/p{n:02d}": {"n": i(n % 3)} for n in range(10)}
    src, order, seen, cursor = source(spark, docs), (Order("n"),), [], None
    while True:
        rows = page(src, Query("c", None, order, limit=3, start=cursor)).collect()
        if not rows:
            break
        seen += [r["document_id"] for r in rows]
        fields = {k: V.from_json(v) for k, v in json.loads(rows[-1]["data"]).items()}
        cursor = Cursor.of_document(fields, rows[-1]["document_path"], order, False)
    assert len(seen) == len(set(seen)) == 10


def test_offset_limit_to_last_and_ties(spark):
    src = source(spark, {f"c/0{n}": {"i": i(n)} for n in range(5)})
    by = (Order("i"),)
    assert names(src, Query("c", None, by, offset=2)) == ["02", "03", "04"]
    assert names(src, Query("c", None, by, limit=2, offset=1)) == ["01", "02"]
    assert names(src, Query("c", None, by, offset=10)) == []
    assert names(src, Query("c", None, by, limit_to_last=2)) == ["03", "04"]
    assert names(src, Query("c", None, (Order("i", True),), limit_to_last=2)) == ["01", "00"]
    tied = source(spark, {"c/a": {"n": i(1)}, "c/b": {"n": i(1)}, "c/none": {"other": i(1)}})
    assert names(tied, Query("c", None, (Order("n"),))) == ["a", "b"]
    assert names(tied, Query("c", None, (Order("n", True),))) == ["b", "a"]
    multi = source(spark, {"c/x1": {"g": i(1), "v": i(10)}, "c/x2": {"g": i(1), "v": i(20)}, "c/x3": {"g": i(2), "v": i(5)}})
    assert names(multi, Query("c", None, (Order("g"), Order("v", True)))) == ["x2", "x1", "x3"]


def aggregate(src, aggs, **k):
    parsed = parse_aggregations(aggs)
    return finish(parsed, aggregate_frame(src, Query("c", **k), parsed).first().asDict())


def test_aggregates(spark):
    agg = lambda values, **k: aggregate(source(spark, {f"c/{n}": ({"n": v} if v is not None else {"o": i(1)}) for n, v in enumerate(values)}),
        [{"kind": "count", "alias": "c"}, {"kind": "sum", "alias": "s", "field": "n"}, {"kind": "average", "alias": "a", "field": "n"}], **k)
    assert agg([i(2), i(3), s("no"), None]) == {"c": i(4), "s": i(5), "a": d(2.5)}
    assert agg([i(2), d(1.5)])["s"] == d(3.5)
    assert agg([i(2), i(4)])["a"] == d(3.0)
    assert agg([s("x")]) == {"c": i(1), "s": i(0), "a": V.NULL}
    assert V.rank(agg([i(2), d(NAN)])["s"]) == V.NAN_RANK
    assert agg([i(V.INT_MAX), i(V.INT_MAX)])["s"].kind == "double"
    assert agg([d(0.1)] * 10)["s"] == d(1.0)
    assert agg([i(1)] * 5, limit=3) == {"c": i(3), "s": i(3), "a": d(1.0)}
    assert agg([d(1e300), d(-1e300), i(1)])["s"].v in (1.0, 0.0)


def test_projection(spark):
    docs = {"c/d1": {"address": mp(city=s("X"), zip=s("1")), "name": s("n"), "gone": V.NULL}, "c/d2": {"name": s("m")},
        "c/d3": {"address": s("flat")}, "c/d4": {"address": mp(zip=s("2"))}}
    src = source(spark, docs)
    got = lambda *select: {r["document_id"]: json.loads(r["data"]) for r in page(src, Query("c", select=select)).collect()}
    city = {"mapValue": {"fields": {"city": {"stringValue": "X"}}}}
    assert got("address.city") == {"d1": {"address": city}, "d2": {}, "d3": {}, "d4": {"address": {"mapValue": {"fields": {}}}}}
    whole = {"mapValue": {"fields": {"city": {"stringValue": "X"}, "zip": {"stringValue": "1"}}}}
    assert got("address", "address.city")["d1"] == got("address.city", "address")["d1"] == {"address": whole}
    assert got("gone")["d1"] == {"gone": {"nullValue": None}}


def test_round_trip_and_parse_errors():
    q = {"collection": "c", "where": {"and": [{"field": "f", "op": "eq", "value": {"integerValue": "5"}}, {"not": {"unary": "exists", "field": "g"}},
        {"or": [{"compare": {"left": "a", "op": "lt", "right": "b"}}]}]},
         "orderBy": [{"field": "f", "direction": "desc"}], "limit": 5, "start": {"values": [{"integerValue": "1"}], "before": True}, "select": ["f"]}
    assert query_json(parse_query(q)) == q
    for bad, at in (
        ({"where": {"field": "f", "op": "like", "value": {"nullValue": None}}}, "$.where.op"),
        ({"where": {"field": "f", "op": "eq"}}, "$.where.value"), ({"where": {"and": [], "or": []}}, "$.where"),
        ({"orderBy": [{"field": "a..b"}]}, "$.orderBy[0].field"), ({"limit": "5"}, "$.limit"), ({"start": {"values": []}}, "$.start.before"),
        ({"nope": 1}, "$.nope"), ({"where": {"and": [{"unary": "x", "field": "f"}]}}, "$.where.and[0].unary"),
    ):
        with pytest.raises(ParseError) as e:
            parse_query({"collection": "c", **bad})
        assert e.value.at == at


@pytest.mark.parametrize(("q", "code"), [
    (Query(""), "EMPTY_COLLECTION"), (Query("a/b"), "BAD_COLLECTION_PATH"), (Query("c", limit=0), "BAD_LIMIT"), (Query("c", offset=-1), "BAD_OFFSET"),
    (Query("c", None, (Order("f"),), limit_to_last=0), "BAD_LIMIT_TO_LAST"),
    (Query("c", None, (Order("f"),), limit=1, limit_to_last=1), "LIMIT_CONFLICT"),
    (Query("c", None, (Order("f"),), offset=1, limit_to_last=1), "OFFSET_LIMIT_TO_LAST"), (Query("c", limit_to_last=1), "LIMIT_TO_LAST_NO_ORDER"),
    (Query("c", None, (Order("f"),), start=Cursor((), True)), "CURSOR_ARITY"), (Query("c", start=Cursor((i(1),), True)), "CURSOR_TYPE"),
    (Query("c", And(())), "EMPTY_COMPOSITE"), (Query("c", t("in", i(1))), "OPERAND_TYPE"),
    (Query("c", t("regex", i(1))), "OPERAND_TYPE"), (Query("c", t("contains", s("x"), "__name__")), "NAME_OPERATOR"),
    (Query("c", Compare("a", "in", "b")), "COMPARE_OP"), (Query("c", Compare("__name__", "eq", "b")), "COMPARE_OP"),
])
def test_validation_codes(q, code):
    with pytest.raises(QueryError) as e:
        normalize(q)
    assert e.value.code == code


def test_empty_table(spark):
    src = source(spark, {"c/a": {}})
    src.df = documents(spark, {"c/a": {}}).limit(0)
    assert ids(src, t("eq", i(1))) == []
    assert aggregate(src, [{"kind": "count", "alias": "n"}]) == {"n": i(0)}
