"""Queries as data: what the parser makes, the normalizer checks and the compiler turns into DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from lattica.functions.values import Value, string, to_json

NAME = "__name__"

# Operator names of the query language.
FIELD_OPS = ("eq", "ne", "gt", "gte", "lt", "lte", "in", "notIn", "arrayContains", "arrayContainsAny", "arrayContainsAll", "contains", "startsWith", "endsWith", "regex")
COMPARISONS = ("eq", "ne", "gt", "gte", "lt", "lte")
UNARY_OPS = ("isNull", "isNan", "exists")
AGGREGATES = ("count", "sum", "average")


@dataclass(frozen=True)
class And:
    items: tuple


@dataclass(frozen=True)
class Or:
    items: tuple


@dataclass(frozen=True)
class Not:
    item: object


@dataclass(frozen=True)
class Unary:
    op: str
    field: str


@dataclass(frozen=True)
class Test:
    field: str
    op: str
    value: Value


@dataclass(frozen=True)
class Compare:
    left: str
    op: str
    right: str


@dataclass(frozen=True)
class Order:
    field: str
    descending: bool = False


@dataclass(frozen=True)
class Cursor:
    values: tuple[Value, ...]
    before: bool

    @staticmethod
    def of_document(fields: dict[str, Value], path: str, order: tuple[Order, ...], before: bool) -> Cursor:
        """The cursor at a document: its value of each order key, then its path."""
        from lattica.functions.values import read_path

        out = []
        for o in order:
            v = string(path) if o.field == NAME else read_path(fields, o.field)
            if v is None:
                raise QueryError("CURSOR_FIELD", f"the document has no {o.field}")
            out.append(v)
        return Cursor((*out, string(path)) if NAME not in [o.field for o in order] else tuple(out), before)


@dataclass(frozen=True)
class Query:
    collection: str
    where: object = None
    order_by: tuple[Order, ...] = ()
    limit: int | None = None
    offset: int | None = None
    limit_to_last: int | None = None
    start: Cursor | None = None
    end: Cursor | None = None
    select: tuple[str, ...] = ()


@dataclass(frozen=True)
class Aggregation:
    kind: str
    alias: str
    field: str | None = None


class QueryError(ValueError):
    """A query that has no meaning, with the code that says why."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


class ParseError(ValueError):
    """Input that is no query, with the JSON path of the offending part."""

    def __init__(self, at: str, message: str):
        super().__init__(f"{at}: {message}")
        self.at = at


def filter_json(f) -> dict:
    match f:
        case And(items):
            return {"and": [filter_json(x) for x in items]}
        case Or(items):
            return {"or": [filter_json(x) for x in items]}
        case Not(item):
            return {"not": filter_json(item)}
        case Unary(op, field):
            return {"unary": op, "field": field}
        case Test(field, op, value):
            return {"field": field, "op": op, "value": to_json(value)}
        case Compare(left, op, right):
            return {"compare": {"left": left, "op": op, "right": right}}
    raise TypeError(f)


def query_json(q: Query) -> dict:
    """Canonical JSON of a query; equal queries give equal text when written with sorted keys."""
    cursor = lambda c: {"values": [to_json(v) for v in c.values], "before": c.before}
    out: dict = {"collection": q.collection}
    if q.where is not None:
        out["where"] = filter_json(q.where)
    if q.order_by:
        out["orderBy"] = [{"field": o.field, "direction": "desc" if o.descending else "asc"} for o in q.order_by]
    for key, v in (("limit", q.limit), ("offset", q.offset), ("limitToLast", q.limit_to_last)):
        if v is not None:
            out[key] = v
    for key, c in (("start", q.start), ("end", q.end)):
        if c is not None:
            out[key] = cursor(c)
    if q.select:
        out["select"] = list(q.select)
    return out


def query_key(q: Query) -> str:
    import json

    return json.dumps(query_json(q), sort_keys=True, ensure_ascii=False, separators=(",", ":"))
