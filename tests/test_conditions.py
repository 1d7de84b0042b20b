"""Conditions of rules: what they say of a request, and what a query proves."""

import itertools

import pytest
from helpers import boundary_values, d, i, mp, natural, s, t

from lattica.database import open_database
from lattica.functions import values as V
from lattica.functions.values import Value
from lattica.operators.conditions import After, Always, Auth, Exists, Field, Now, Other, Param, plain_value
from lattica.operators.rules import Request, Rules
from lattica.operators.writes import Delete, Set, Update, WriteError
from lattica.plans.ast import And, Not, Or, Query
from lattica.sources.shared import fresh

OPS = {"eq": lambda f, v: f == v, "ne": lambda f, v: f != v, "gt": lambda f, v: f > v, "gte": lambda f, v: f >= v, "lt": lambda f, v: f < v, "lte": lambda f, v: f <= v}


def request(**more):
    return Request("get", "c/a", more.pop("auth", {}), more.pop("captures", {}), 5, **more)


def test_comparisons_are_those_of_the_database():
    some = boundary_values()[::5]
    for x, v in itertools.product(some, some):
        a, b = natural(x), natural(v)
        same = a[0] == b[0]
        want = {"eq": a == b, "ne": a != b, "gt": same and a > b, "gte": same and a >= b, "lt": same and a < b, "lte": same and a <= b}
        for op, make in OPS.items():
            assert make(Field("f"), v).holds(request(resource={"f": x})) is want[op], (x, op, v)


def test_a_proof_holds_for_every_document():
    """Whatever passes the query's test passes a condition that the test proves."""
    some = [v for v in boundary_values()[::7] if natural(v)[0] not in (10, 29)]
    proven = 0
    for (op, make), (top, _), x, v in itertools.product(OPS.items(), OPS.items(), some[::2], some[::3]):
        if make(Field("f"), v).proven([t(top, x)], request()):
            proven += 1
            passing = [y for y in some if OPS[top](Field("f"), x).holds(request(resource={"f": y}))]
            assert all(make(Field("f"), v).holds(request(resource={"f": y})) for y in passing), (top, x, op, v)
    assert proven > 50


def test_operands():
    r = request(auth={"uid": "ann", "token": {"roles": ["x"], "level": 3, "ok": True, "n": None}}, captures={"id": "a"}, resource={"m": mp(x=i(1))},
        after={"m": mp(x=i(2))}, fetch=lambda p: {"v": s(p)} if p == "users/ann" else None)
    value = lambda operand: operand.of(r)
    assert value(Auth("uid")) == s("ann") and value(Auth("token", "level")) == i(3) and value(Auth("token", "roles")) == Value("array", (s("x"),))
    assert value(Auth("token", "n")) is None and value(Auth("none", "x")) is None and value(Param("id")) == s("a") and value(Param("other")) is None
    assert (value(Field("m.x")), value(After("m.x")), value(Field("m.y")), value(Now())) == (i(1), i(2), None, Value("timestamp", 5))
    assert value(Other("users", Auth("uid"), field="v")) == s("users/ann") and value(Other("users", Param("id"),
        field="v")) is None and value(Other("users", Auth("none"), field="v")) is None
    assert Exists("users", Auth("uid")).holds(r) and not Exists("users", Param("id")).holds(r) and not Exists("users", Auth("none")).holds(r)
    assert not (Field("none") == 1).holds(r) and not (Field("none") != 1).holds(r) and Always().holds(r)
    assert plain_value({"a": [1, 2.5, None]}) == mp(a=Value("array", (i(1), d(2.5), V.NULL)))
    with pytest.raises(TypeError):
        plain_value(object())


def test_proofs_of_composed_conditions():
    mine, low = Field("owner") == Auth("uid"), Field("n") < 10
    r = request(auth={"uid": "ann", "role": "admin"}, fetch=lambda p: {} if p == "admins/ann" else None)
    owner, small = t("eq", s("ann"), "owner"), t("lte", i(9), "n")
    assert (mine & low).proven([owner, small], r) and not (mine & low).proven([owner], r)
    assert (mine | low).proven([small], r) and not (mine | low).proven([], r)
    assert (Auth("role") == "admin").proven([], r) and not (Auth("role") == "guest").proven([], r)
    assert Exists("admins", Auth("uid")).proven([], r) and not Exists("admins", Field("x")).proven([], r) and not (Field("n") < Now()).proven([small], r)
    assert (Auth("uid") == Field("owner")).proven([owner], r) and not (Field("owner") == Auth("none")).proven([owner], r)


def test_rules_with_expressions(spark):
    mine = Field("owner") == Auth("uid")
    rules = Rules().allow("notes/{id}", "read", mine | (Field("public") == True)).allow("notes/{id}", "create", After("owner") == Auth("uid")).allow(  # noqa: E712
        "notes/{id}", "update", mine & (After("owner") == Field("owner")) & (After("version") > Field("version"))).allow("teams/{team}/{rest=**}",
        "all", Exists("teams", Param("team"), "members", Auth("uid")))
    path = fresh(spark, "db")
    open_database(spark, path).write([Set("teams/t", {}), Set("teams/t/members/bob", {})])
    ann, bob = (open_database(spark, path, rules=rules, auth={"uid": u}) for u in ("ann", "bob"))
    ann.write([Set("notes/1", {"owner": s("ann")}), Set("notes/2", {"owner": s("ann"), "public": Value("boolean", True)})])
    ann.write([Update("notes/1", {"x": i(1)})])
    bob.write([Set("teams/t/docs/1", {"x": i(1)})])
    assert bob.get("notes/2") is not None and len(bob.query(Query("teams/t/docs")).documents) == 1
    by_owner = lambda who: t("eq", s(who), "owner")
    assert len(ann.query(Query("notes", by_owner("ann"))).documents) == 2 and len(bob.query(Query("notes", t("eq", Value("boolean", True), "public"))).documents) == 1
    for call in (lambda: bob.get("notes/1"), lambda: bob.write([Update("notes/1", {"x": i(1)})]),
        lambda: ann.write([Update("notes/1", {"owner": s("bob")})]), lambda: ann.write([Delete("notes/1")]), lambda: ann.query(Query("teams/t/docs")),
                 lambda: bob.query(Query("notes", by_owner("ann"))), lambda: ann.query(Query("notes", Or((by_owner("ann"), by_owner("bob"))))),
                 lambda: ann.query(Query("notes", And((Not(by_owner("bob")),)))), lambda: ann.query(Query("notes"))):
        with pytest.raises(WriteError) as e:
            call()
        assert e.value.status == "PERMISSION_DENIED"
