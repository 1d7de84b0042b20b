"""Fields as Spark columns, over typed tables and over tagged documents.

A field answers ``exists``, ``rank`` (its type's place in the total order, null if missing) and, for each type class,
``parts``: columns whose lexicographic order is the order within the class.  Typed fields (a plain column) keep their
comparisons in the form ``column op literal``, which Parquet readers evaluate; tagged fields are taken out of the stored
JSON by built-in functions.  Only values nested in arrays and maps need a Python function, in Arrow batches.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.functions import values as V
from lattica.functions.values import Value

_MAP = "map<string,string>"


@F.pandas_udf(T.BinaryType())
def nested_key(tagged: pd.Series) -> pd.Series:
    """Order key of a tagged value."""
    return tagged.map(lambda t: _key(t), na_action="ignore")


@F.pandas_udf(T.ArrayType(T.BinaryType()))
def element_keys(tagged: pd.Series) -> pd.Series:
    """Order keys of the elements of a tagged array."""
    return tagged.map(lambda t: [V.order_key(x) for x in _read(t).v] if _read(t) is not None else None, na_action="ignore")


def _read(t: str) -> Value | None:
    try:
        return V.from_json(json.loads(t))
    except ValueError:
        return None


def _key(t: str) -> bytes | None:
    v = _read(t)
    return None if v is None else V.order_key(v)


def exact_parts(i: Column) -> tuple[Column, Column]:
    """A long as (nearest double, remainder): the pair's order is the exact order, also against doubles (d, 0)."""
    near = i.cast("double")
    top = F.lit(float(2**63))
    back = F.when(near >= top, F.lit(V.INT_MAX)).otherwise(near.cast("long"))
    return near, F.when(near >= top, (i - back) - 1).otherwise(i - back)


def exact_literal(n: float | int) -> tuple[float, int]:
    """The pair of ``exact_parts`` for a Python number."""
    near = float(n)
    return (near, 0) if isinstance(n, float) else (near, n - int(near))


def literal_parts(v: Value) -> list:
    """A value's parts as Python literals, in the shape of ``Field.parts`` of its rank."""
    match V.rank(v):
        case 10 | V.NAN_RANK:
            return []
        case 30:
            return list(exact_literal(v.v))
        case 80:
            return [v.v[0], v.v[1]]
        case 90 | 100:
            return [V.order_key(v)]
    return [v.v]


def typed_literal(x) -> Column:
    return F.lit(bytearray(x)) if isinstance(x, bytes) else F.lit(x)


class Field:
    """A field of tagged documents (or the base of one of a typed table)."""

    exists: Column
    rank: Column
    ranks: tuple[int, ...] = (10, 20, 29, 30, 40, 50, 60, 70, 80, 90, 100)

    def parts(self, rank: int) -> list[Column]:
        raise NotImplementedError

    def order(self) -> list[Column]:
        raise NotImplementedError

    def key(self) -> Column:
        """Order key across all types, for comparing two fields."""
        raise NotImplementedError

    def elements(self) -> Column:
        """Order keys of the elements; null if this is no array."""
        raise NotImplementedError

    def equals(self, v: Value) -> Column:
        """Same class and equal; null if the field is missing."""
        r = V.rank(v)
        here = self.rank == F.lit(r)
        for part, lit in zip(self.parts(r), literal_parts(v)):
            # a field of another class has no such part: the comparison must then say no, not null
            here = here & F.coalesce(part == typed_literal(lit), F.lit(False))
        return F.when(self.rank.isNotNull(), here)

    def within(self, op: str, v: Value) -> Column:
        """``gt``, ``gte``, ``lt`` or ``lte`` inside the class of ``v``; null if the field is missing."""
        r = V.rank(v)
        if r in (10, V.NAN_RANK):
            return F.lit(False)
        pairs = list(zip(self.parts(r), [typed_literal(x) for x in literal_parts(v)]))
        strict = {"g": lambda a, b: a > b, "l": lambda a, b: a < b}[op[0]]
        cond = F.lit(op.endswith("e"))
        for part, lit in reversed(pairs):
            cond = strict(part, lit) | ((part == lit) & cond)
        return F.when(self.rank.isNotNull(), (self.rank == F.lit(r)) & F.coalesce(cond, F.lit(False)))

    def let(self, condition: Callable[[Field], Column], v: Value) -> Column:
        """A condition on this field and ``v``; fields that are dear to read bind their value first."""
        return condition(self)

    def beyond(self, greater: bool, v: Value) -> Column:
        """Strictly after (or before) ``v`` in the total order over all types."""
        r = F.lit(V.rank(v))
        return (self.rank > r if greater else self.rank < r) | self.within("gt" if greater else "lt", v)

    def text(self) -> Column:
        """The string, null for other types."""
        return self.parts(50)[0]


class TaggedField(Field):
    """A field of a stored document: a column with one tagged value as JSON text, null if missing."""

    def __init__(self, tagged: Column, one: Column | None = None):
        self.tagged = tagged
        self.one = one = F.from_json(tagged, _MAP) if one is None else one
        self.tag, self.payload = F.try_element_at(F.map_keys(one), F.lit(1)), F.try_element_at(F.map_values(one), F.lit(1))
        self.exists = tagged.isNotNull()
        rank = F.when(self.tag == V.TAGS["double"], F.when(self.payload == "NaN", V.NAN_RANK).otherwise(30))
        for kind, r in V.RANKS.items():
            if kind != "double":
                rank = rank.when(self.tag == V.TAGS[kind], r)
        self.rank = rank

    def let(self, condition: Callable[[TaggedField], Column], v: Value) -> Column:
        """A condition on this field and ``v``, with the JSON parsed once and bound to a variable.

        A filter evaluates every mention of an expression anew, and a condition mentions the parsed value many times.
        Arrays and maps need a Python function, which cannot stand inside; their conditions are used as they are.
        """
        if v.kind in ("array", "map"):
            return condition(self)
        return F.element_at(F.transform(F.array(self.one), lambda m: condition(TaggedField(m, m))), 1)

    def _of(self, kind: str, column: Column) -> Column:
        return F.when(self.tag == V.TAGS[kind], column)

    def numbers(self) -> tuple[Column, Column]:
        near, rest = exact_parts(self._of("integer", self.payload.try_cast("long")))
        real = self.double()
        return F.coalesce(near, real), F.coalesce(rest, F.when(real.isNotNull(), F.lit(0).cast("long")))

    def integer(self) -> Column:
        return self._of("integer", self.payload.try_cast("long"))

    def double(self) -> Column:
        return F.when((self.tag == V.TAGS["double"]) & (self.payload != "NaN"), self.payload.try_cast("double"))

    def special(self) -> Column:
        """NaN and the infinities among doubles, else null."""
        d = self._of("double", self.payload.try_cast("double"))
        return F.when(F.isnan(d) | (F.abs(d) == float("inf")), d)

    def parts(self, rank: int) -> list[Column]:
        match rank:
            case 20:
                return [self._of("boolean", self.payload.try_cast("boolean"))]
            case 30:
                return list(self.numbers())
            case 40:
                return [self._of("timestamp", F.unix_micros(F.try_to_timestamp(self.payload)))]
            case 50:
                return [self._of("string", self.payload)]
            case 60:
                return [self._of("bytes", F.unbase64(self.payload))]
            case 70:
                return [self._of("reference", self.payload)]
            case 80:
                point = F.from_json(self._of("geopoint", self.payload), "latitude double, longitude double")
                return [point["latitude"], point["longitude"]]
            case 90 | 100:
                return [nested_key(F.when(self.rank >= 90, self.tagged))]
        return []

    def order(self) -> list[Column]:
        b, n = self.parts(20)[0], self.numbers()
        lat, lng = self.parts(80)
        num = F.coalesce(n[0], b.cast("double"), lat)
        res = F.coalesce(n[1], self.parts(40)[0])
        return [self.rank, num, res, lng, F.coalesce(self.parts(50)[0], self.parts(70)[0]), self.parts(60)[0], self.parts(90)[0]]

    def key(self) -> Column:
        return nested_key(self.tagged)

    def elements(self) -> Column:
        return element_keys(F.when(self.rank == 90, self.tagged))


def tagged_expression(c: Column, t: T.DataType) -> Column:
    """A typed column as tagged JSON text; null stays null (missing)."""
    q = lambda x: F.to_json(F.struct(x.alias("x")))
    wrap = lambda tag, inner: F.concat(F.lit('{"' + tag + '":'), inner, F.lit("}"))
    quoted = lambda x: F.regexp_replace(q(x), r'^\{"x":|\}$', "")
    match t:
        case T.BooleanType():
            return wrap("booleanValue", c.cast("string"))
        case T.ByteType() | T.ShortType() | T.IntegerType() | T.LongType():
            return wrap("integerValue", quoted(c.cast("string")))
        case T.FloatType() | T.DoubleType() | T.DecimalType():
            d = c.cast("double")
            return wrap("doubleValue", F.when(F.isnan(d) | (F.abs(d) == float("inf")), quoted(d.cast("string"))).otherwise(d.cast("string")))
        case T.TimestampType() | T.TimestampNTZType() | T.DateType():
            return wrap("timestampValue", quoted(F.date_format(c.cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")))
        case T.BinaryType():
            return wrap("bytesValue", quoted(F.base64(c)))
        case T.ArrayType():
            inner = F.transform(c, lambda x: F.coalesce(tagged_expression(x, t.elementType), F.lit('{"nullValue":null}')))
            return wrap("arrayValue", F.concat(F.lit('{"values":['), F.array_join(inner, ","), F.lit("]}")))
        case T.StructType():
            fields = [F.when(c[f.name].isNotNull(), F.concat(F.lit(json.dumps(f.name) + ":"), tagged_expression(c[f.name], f.dataType))) for f in t.fields]
            return F.when(c.isNotNull(), wrap("mapValue", F.concat(F.lit('{"fields":{'), F.concat_ws(",", *fields), F.lit("}}"))))
        case T.MapType():
            entry = F.transform(F.map_entries(c), lambda e: F.concat(quoted(e["key"].cast("string")), F.lit(":"),
                F.coalesce(tagged_expression(e["value"], t.valueType), F.lit('{"nullValue":null}'))))
            return wrap("mapValue", F.concat(F.lit('{"fields":{'), F.array_join(entry, ","), F.lit("}}")))
    return wrap("stringValue", quoted(c.cast("string")))


class TypedField(Field):
    """A scalar column: its type gives the rank, null is missing.  Comparisons stay ``column op literal``."""

    def __init__(self, column: Column, kind: str):
        self.column, self.kind = column, kind
        self.exists = column.isNotNull()
        self.real = kind == "double"
        self.fixed = V.RANKS[kind]
        self.ranks = (V.NAN_RANK, 30) if self.real else (self.fixed,)
        if self.real:
            self.rank = F.when(F.isnan(column), V.NAN_RANK).when(self.exists, 30)
        else:
            self.rank = F.when(self.exists, F.lit(self.fixed))

    def _never(self) -> Column:
        """False where the field is present, null where it is missing."""
        return F.when(self.exists, F.lit(False))

    def _native(self, v: Value):
        """The operand as a literal of the column's type, or None if numbers of the two types need exact pairs."""
        if self.fixed != 30:
            if self.kind == "timestamp":
                return F.lit(v.v)
            return typed_literal(v.v)
        if self.kind == "integer" and v.kind == "double":
            return F.lit(int(v.v)) if V.INT_MIN <= v.v < 2**63 and v.v == math.floor(v.v) else None
        if self.real and v.kind == "integer":
            return F.lit(float(v.v)) if int(float(v.v)) == v.v else None
        return F.lit(v.v)

    @property
    def comparable(self) -> Column:
        return F.unix_micros(self.column.cast("timestamp")) if self.kind == "timestamp" else self.column

    def equals(self, v: Value) -> Column:
        r = V.rank(v)
        if r not in self.ranks:
            return self._never()
        if r == V.NAN_RANK:
            return F.when(self.exists, F.isnan(self.column))
        if self.kind == "timestamp":
            return self.column == _instant(v.v)
        lit = self._native(v)
        return self._never() if lit is None else self.column == lit

    def within(self, op: str, v: Value) -> Column:
        r = V.rank(v)
        if r in (10, V.NAN_RANK):
            return F.lit(False)
        if r not in self.ranks:
            return self._never()
        apply = {"gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b}
        if self.kind == "timestamp":
            return apply[op](self.column, _instant(v.v))
        lit = self._native(v)
        if lit is None and self.kind == "integer":
            if math.isinf(v.v) or not V.INT_MIN <= v.v < 2**63:
                return F.when(self.exists, F.lit((v.v < 0) == (op[0] == "g")))
            return self.column > F.lit(math.floor(v.v)) if op[0] == "g" else self.column < F.lit(math.ceil(v.v))
        if lit is None:  # a double column against an integer no double can hold: the nearest double decides
            near = float(v.v)
            over = int(near) > v.v
            cond = (self.column >= F.lit(near) if over else self.column > F.lit(near)) if op[0] == "g" else (self.column < F.lit(near) if over else self.column <= F.lit(near))
        else:
            cond = apply[op](self.column, lit)
        return cond & ~F.isnan(self.column) if self.real and op[0] == "g" else cond  # Spark puts NaN last

    def beyond(self, greater: bool, v: Value) -> Column:
        r = V.rank(v)
        if self.real:
            return super().beyond(greater, v)
        if r != self.fixed:
            return F.when(self.exists, F.lit((self.fixed > r) == greater))
        return self.within("gt" if greater else "lt", v)

    def parts(self, rank: int) -> list[Column]:
        if rank not in self.ranks or rank == V.NAN_RANK:
            return [F.lit(None).cast("string")] * (2 if rank in (30, 80) else 1)
        if rank == 30:
            return [F.when(~F.isnan(self.column), self.column.cast("double")), F.lit(0).cast("long")] if self.real else list(exact_parts(self.column.cast("long")))
        return [self.comparable]

    def order(self) -> list[Column]:
        return [self.rank, F.when(~F.isnan(self.column), self.column)] if self.real else [self.column]

    def key(self) -> Column:
        return nested_key(self.tagged)

    @property
    def tagged(self) -> Column:
        spark_type = {"boolean": T.BooleanType(), "integer": T.LongType(), "double": T.DoubleType(), "timestamp": T.TimestampNTZType(),
            "string": T.StringType(), "bytes": T.BinaryType()}[self.kind]
        return tagged_expression(self.column, spark_type)

    def elements(self) -> Column:
        return F.lit(None).cast("array<binary>")

    def text(self) -> Column:
        return self.column if self.kind == "string" else F.lit(None).cast("string")

    def integer(self) -> Column:
        return self.column.cast("long") if self.kind == "integer" else F.lit(None).cast("long")

    def double(self) -> Column:
        return F.when(~F.isnan(self.column), self.column.cast("double")) if self.real else F.lit(None).cast("double")

    def special(self) -> Column:
        d = self.column.cast("double") if self.real else F.lit(None).cast("double")
        return F.when(F.isnan(d) | (F.abs(d) == float("inf")), d)


def _instant(us: int) -> Column:
    """A timestamp literal without zone; the stored times are UTC."""
    return F.lit(V.stamp(us)[:-1].replace("T", " ")).cast("timestamp_ntz")


class NestedField(TaggedField):  # its JSON is made from the column, not parsed
    """An array, struct or map column of a typed table, through its tagged form."""

    def __init__(self, column: Column, t: T.DataType):
        super().__init__(tagged_expression(column, t))
        self.exists = column.isNotNull()
        self.column, self.type = column, t
        self.fixed = 90 if isinstance(t, T.ArrayType) else 100
        self.rank = F.when(self.exists, F.lit(self.fixed))

    def order(self) -> list[Column]:
        if isinstance(self.type, T.ArrayType) and isinstance(self.type.elementType, (T.StringType, T.LongType, T.IntegerType, T.BooleanType)):
            return [self.column]  # Spark orders arrays element by element, the shorter first
        return [nested_key(self.tagged)]


class MissingField(Field):
    """A field the table has no column for: missing everywhere."""

    def __init__(self) -> None:
        self.exists, self.rank, self.tagged = F.lit(False), F.lit(None).cast("int"), F.lit(None).cast("string")

    def equals(self, v: Value) -> Column:
        return F.lit(None).cast("boolean")

    def within(self, op: str, v: Value) -> Column:
        return F.lit(False) if V.rank(v) in (10, V.NAN_RANK) else F.lit(None).cast("boolean")

    beyond = lambda self, greater, v: F.lit(None).cast("boolean")

    def parts(self, rank: int) -> list[Column]:
        return [F.lit(None).cast("string")]

    def order(self) -> list[Column]:
        return []

    def key(self) -> Column:
        return F.lit(None).cast("binary")

    def elements(self) -> Column:
        return F.lit(None).cast("array<binary>")

    def integer(self) -> Column:
        return F.lit(None).cast("long")

    def double(self) -> Column:
        return F.lit(None).cast("double")

    special = double


class NameField(TypedField):
    """The document's path."""

    def __init__(self, column: Column):
        super().__init__(column, "string")

    def _operand(self, v: Value) -> Value:
        return Value("string", v.v)

    def equals(self, v: Value) -> Column:
        return super().equals(self._operand(v))

    def within(self, op: str, v: Value) -> Column:
        return super().within(op, self._operand(v))

    def beyond(self, greater: bool, v: Value) -> Column:
        return super().beyond(greater, self._operand(v))


def key_of(path: str, prefix: str, t: T.DataType):
    """The key with which ``path`` is a row's path, or None if no key gives it."""
    if not path.startswith(prefix):
        return None
    text = path[len(prefix):]
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        bits = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}[type(t)]
        return int(text) if re.fullmatch(r"0|-?[1-9]\d{0,18}", text, re.ASCII) and -(1 << bits) <= int(text) < 1 << bits else None
    return text if isinstance(t, T.StringType) else None


class KeyField(NameField):
    """The path of a typed table's row, ``<prefix><key>``; what can be said of the key alone reaches the scan as such."""

    def __init__(self, column: Column, prefix: str, key: Column, t: T.DataType):
        super().__init__(column)
        self.prefix, self.key_column, self.key_type = prefix, key, t
        self.by_key = isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.StringType))

    def equals(self, v: Value) -> Column:
        if not self.by_key:
            return super().equals(v)
        k = key_of(v.v, self.prefix, self.key_type)
        return self._never() if k is None else self.key_column == F.lit(k)

    def within(self, op: str, v: Value) -> Column:
        # only texts are in the order of their paths
        if not isinstance(self.key_type, T.StringType) or not v.v.startswith(self.prefix):
            return super().within(op, v)
        return TypedField(self.key_column, "string").within(op, Value("string", v.v[len(self.prefix):]))
