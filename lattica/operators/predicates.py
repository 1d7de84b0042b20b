"""Filters as Columns.  Missing fields follow SQL's three-valued logic, so ``not`` keeps or drops them as listed:

null, thus dropped by ``not``: eq, in, the ranges, contains, startsWith, endsWith, regex, isNull, isNan, compare other than ne.
false, thus kept by ``not``: ne, notIn, the array tests, exists, compare ne, and ranges against null or NaN.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.functions import values as V
from lattica.functions.fields import Field, NameField
from lattica.functions.values import Value
from lattica.plans.ast import And, Compare, Not, Or, Test, Unary


_NAN = V.double(float("nan"))


def compile_filter(source, f) -> Column:
    match f:
        case And(items):
            return reduce(lambda a, b: a & b, [compile_filter(source, x) for x in items])
        case Or(items):
            return reduce(lambda a, b: a | b, [compile_filter(source, x) for x in items])
        case Not(item):
            return ~compile_filter(source, item)
        case Unary("exists", field):
            return source.field(field).exists
        case Unary("isNull", field):
            return source.field(field).let(lambda f: f.equals(V.NULL), V.NULL)
        case Unary("isNan", field):
            return source.field(field).let(lambda f: f.equals(_NAN), _NAN)
        case Compare(left, op, right):
            return _compare(source.field(left), op, source.field(right))
        case Test(field, op, value):
            f = source.field(field)
            if op.startswith("arrayContains"):
                return _test(f, op, value)
            # of an operand that lists values, any that needs a key decides how the field is read
            deciding = next((v for v in value.v if v.kind in ("array", "map")), V.NULL) if op in ("in", "notIn") else value
            return f.let(lambda x: _test(x, op, value), deciding)
    raise TypeError(f)


def _no_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _any_equal(field: Field, values: tuple[Value, ...]) -> Column:
    if not values:
        return F.lit(False)
    return reduce(lambda a, b: a | b, [field.equals(v) for v in values])


def _comparable(field: Field) -> Column:
    """Present, not null and not NaN."""
    cond = field.exists
    for r in (10, V.NAN_RANK):
        if r in field.ranks:
            cond = cond & (field.rank != F.lit(r))
    return cond


def _differs(field: Field, values: tuple[Value, ...]) -> Column:
    return _no_null(_comparable(field) & ~_any_equal(field, values))


def _test(field: Field, op: str, v: Value) -> Column:
    match op:
        case "eq":
            return field.equals(v)
        case "ne":
            if isinstance(field, NameField):
                return ~field.equals(v)
            return _differs(field, (v,))
        case "gt" | "gte" | "lt" | "lte":
            return field.within(op, v)
        case "in":
            return _any_equal(field, v.v)
        case "notIn":
            return _differs(field, v.v)
        case "arrayContains":
            return _holds(field, [v], all_of=False)
        case "arrayContainsAny":
            return _holds(field, list(v.v), all_of=False)
        case "arrayContainsAll":
            return _holds(field, list(v.v), all_of=True)
        case "contains" | "startsWith" | "endsWith":
            text, lit = F.lower(field.text()), F.lower(F.lit(v.v))
            found = {"contains": text.contains, "startsWith": text.startswith, "endsWith": text.endswith}[op](lit)
        case "regex":
            found = field.text().rlike(v.v)
        case _:
            raise ValueError(op)
    return F.when(field.exists, _no_null(found))


def _holds(field: Field, wanted: list[Value], all_of: bool) -> Column:
    native = _native_elements(field, wanted)
    if native is not None:
        elements, lits = native
    else:
        elements, lits = field.elements(), [F.lit(bytearray(V.order_key(w))) for w in wanted]
    if not lits:
        return _no_null(elements.isNotNull()) if all_of else F.lit(False)
    if all_of:
        cond = reduce(lambda a, b: a & b, [F.array_contains(elements, x) for x in lits])
    else:
        cond = F.array_contains(elements, lits[0]) if len(lits) == 1 else F.arrays_overlap(elements, F.array(*lits))
    return _no_null(cond)


def _native_elements(field: Field, wanted: list[Value]) -> tuple[Column, list[Column]] | None:
    """Arrays of strings or integers in a typed table are searched as they are, without leaving the JVM."""
    from pyspark.sql import types as T

    t = getattr(field, "type", None)
    if not isinstance(t, T.ArrayType):
        return None
    kinds = {w.kind for w in wanted}
    if isinstance(t.elementType, T.StringType) and kinds <= {"string"}:
        return field.column, [F.lit(w.v) for w in wanted]
    if isinstance(t.elementType, (T.IntegerType, T.LongType)) and kinds <= {"integer"}:
        return field.column, [F.lit(w.v).cast(t.elementType) for w in wanted]
    return None


def _compare(a: Field, op: str, b: Field) -> Column:
    same_kind = getattr(a, "kind", 1) == getattr(b, "kind", 2) and not getattr(a, "real", True)
    both_real = getattr(a, "real", False) and getattr(b, "real", False)
    if same_kind:
        x, y = a.column, b.column
    elif both_real:  # NaN lies below all numbers
        x, y = (F.struct(f.rank.alias("r"), F.when(~F.isnan(f.column), f.column).alias("n")) for f in (a, b))
        x, y = F.when(a.exists, x), F.when(b.exists, y)
    else:
        x, y = a.key(), b.key()
    if op == "ne":
        return _no_null(a.exists & b.exists & (x != y))
    return {"eq": lambda: x == y, "gt": lambda: x > y, "gte": lambda: x >= y, "lt": lambda: x < y, "lte": lambda: x <= y}[op]()
