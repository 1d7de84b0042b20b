"""Typed values: eleven kinds, their tagged JSON form, and the total order over all of them.

A value in Python is ``Value(kind, v)``:  null None · boolean bool · integer int · double float · timestamp int
(microseconds since 1970, UTC) · string str · bytes bytes · reference str · geopoint (lat, lng) · array tuple of
values · map dict of values.
"""

from __future__ import annotations

import base64
import math
import re
import struct
from datetime import UTC, datetime, timedelta
from functools import cmp_to_key
from typing import Any, NamedTuple


class ValueFormatError(ValueError):
    """Tagged JSON that is no value."""


class Value(NamedTuple):
    kind: str
    v: Any

    def __hash__(self) -> int:
        return hash(order_key(self))


# Tags of the stored form by kind, and the place of each kind in the total order (NaN: 29).
TAGS = {
    "null": "nullValue", "boolean": "booleanValue", "integer": "integerValue", "double": "doubleValue", "timestamp": "timestampValue", "string": "stringValue",
    "bytes": "bytesValue", "reference": "referenceValue", "geopoint": "geoPointValue", "array": "arrayValue", "map": "mapValue",
}
RANKS = {"null": 10, "boolean": 20, "integer": 30, "double": 30, "timestamp": 40, "string": 50, "bytes": 60, "reference": 70, "geopoint": 80, "array": 90, "map": 100}
NAN_RANK = 29
KINDS = {t: k for k, t in TAGS.items()}
INT_MIN, INT_MAX = -(2**63), 2**63 - 1
_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
_STAMP = re.compile(r"(\d{4})-(\d\d)-(\d\d)T(\d\d):(\d\d):(\d\d)(?:\.(\d{1,9}))?(Z|[+-]\d\d:\d\d)$")

NULL = Value("null", None)


def integer(i: int) -> Value:
    return Value("integer", i)


def double(d: float) -> Value:
    return Value("double", float(d))


def string(s: str) -> Value:
    return Value("string", s)


def micros(stamp: str) -> int:
    """Microseconds of an RFC 3339 instant; digits beyond microseconds are cut off."""
    m = _STAMP.match(stamp)
    if not m:
        raise ValueFormatError(f"not a timestamp: {stamp!r}")
    y, mo, d, h, mi, s = map(int, m.groups()[:6])
    at = datetime(y, mo, d, h, mi, s, tzinfo=UTC) - _EPOCH
    zone = 0 if m[8] == "Z" else int(m[8][0] + "1") * (int(m[8][1:3]) * 60 + int(m[8][4:6]))
    return (at.days * 86_400 + at.seconds - zone * 60) * 10**6 + int((m[7] or "").ljust(6, "0")[:6] or 0)


def stamp(us: int) -> str:
    return (_EPOCH + timedelta(microseconds=us)).strftime("%Y-%m-%dT%H:%M:%S.%fZ")


def inside(payload: dict, name: str, kind: type) -> Any:
    """What an array or a map holds; nothing if it is absent or null."""
    held = payload.get(name)
    if held is None:
        return kind()
    if not isinstance(held, kind):
        raise ValueFormatError(f"{name} is not {'a list' if kind is list else 'an object'}")
    return held


def from_json(node: Any, at: str = "$") -> Value:
    """The value of a tagged object; the error names its place in the input."""
    if not isinstance(node, dict) or len(node) != 1:
        raise ValueFormatError(f"{at}: a value is an object with exactly one tag")
    ((tag, p),) = node.items()
    kind = KINDS.get(tag)
    at = f"{at}.{tag}"
    try:
        match kind:
            case "null" if p is None:
                return NULL
            case "boolean" if isinstance(p, bool):
                return Value("boolean", p)
            case "integer" if isinstance(p, (int, str)) and not isinstance(p, bool):
                i = int(p)
                if INT_MIN <= i <= INT_MAX:
                    return Value("integer", i)
            case "double" if isinstance(p, (int, float)) and not isinstance(p, bool) or p in ("NaN", "Infinity", "-Infinity"):
                return Value("double", float(p))
            case "timestamp" if isinstance(p, str):
                return Value("timestamp", micros(p))
            case "string" | "reference" if isinstance(p, str):
                return Value(kind, p)
            case "bytes" if isinstance(p, str):
                return Value("bytes", base64.b64decode(p, validate=True))
            case "geopoint" if isinstance(p, dict):
                return Value("geopoint", (float(p["latitude"]), float(p["longitude"])))
            case "array" if isinstance(p, dict):
                return Value("array", tuple(from_json(x, f"{at}.values[{i}]") for i, x in enumerate(inside(p, "values", list))))
            case "map" if isinstance(p, dict):
                return Value("map", {k: from_json(x, f"{at}.fields.{k}") for k, x in inside(p, "fields", dict).items()})
    except ValueFormatError:
        raise
    except (ValueError, KeyError, TypeError) as e:
        raise ValueFormatError(f"{at}: {e}") from e
    raise ValueFormatError(f"{at}: no such value")


def to_json(value: Value) -> dict:
    """The tagged object, fields in code-point order of their names."""
    k, v = value
    match k:
        case "integer":
            v = str(v)
        case "double":
            v = "NaN" if math.isnan(v) else ("Infinity" if v > 0 else "-Infinity") if math.isinf(v) else v
        case "timestamp":
            v = stamp(v)
        case "bytes":
            v = base64.b64encode(v).decode()
        case "geopoint":
            v = {"latitude": v[0], "longitude": v[1]}
        case "array":
            v = {"values": [to_json(x) for x in v]}
        case "map":
            v = {"fields": {f: to_json(v[f]) for f in sorted(v)}}
    return {TAGS[k]: v}


def rank(value: Value) -> int:
    return NAN_RANK if value.kind == "double" and math.isnan(value.v) else RANKS[value.kind]


def _cmp(a: Any, b: Any) -> int:
    return (a > b) - (a < b)


def compare(a: Value, b: Value) -> int:
    """Total order: -1, 0 or 1; 0 is typed equality, so integer 5 equals double 5.0.  Numbers compare exactly."""
    ra, rb = rank(a), rank(b)
    if ra != rb or ra in (10, NAN_RANK):
        return _cmp(ra, rb)
    if ra in (50, 70):
        return _cmp(a.v.encode("utf-8", "surrogatepass"), b.v.encode("utf-8", "surrogatepass"))
    if ra == 90:
        for x, y in zip(a.v, b.v):
            if c := compare(x, y):
                return c
        return _cmp(len(a.v), len(b.v))
    if ra == 100:
        byte_order = lambda k: k.encode("utf-8", "surrogatepass")
        ka, kb = sorted(a.v, key=byte_order), sorted(b.v, key=byte_order)
        for x, y in zip(ka, kb):
            if c := _cmp(byte_order(x), byte_order(y)) or compare(a.v[x], b.v[y]):
                return c
        return _cmp(len(ka), len(kb))
    return _cmp(a.v, b.v)  # Python compares int with float exactly


by_order = cmp_to_key(compare)


def equal(a: Value, b: Value) -> bool:
    return compare(a, b) == 0


def _float_key(d: float) -> bytes:
    (bits,) = struct.unpack(">Q", struct.pack(">d", d + 0.0 if d else 0.0))
    return struct.pack(">Q", bits ^ (0xFFFFFFFFFFFFFFFF if bits >> 63 else 1 << 63))


def _text_key(b: bytes) -> bytes:
    return b.replace(b"\x00", b"\x00\xff") + b"\x00\x00"


def order_key(value: Value) -> bytes:
    """Bytes whose unsigned order is the total order; numbers as nearest double (exact up to 2**53)."""
    r, v = rank(value), value.v
    head = bytes([r])
    if r in (10, NAN_RANK):
        return head
    if r == 20:
        return head + bytes([v])
    if r == 30:
        return head + _float_key(float(v))
    if r == 40:
        return head + struct.pack(">Q", v + 2**63)
    if r in (50, 70):
        return head + _text_key(v.encode("utf-8", "surrogatepass"))
    if r == 60:
        return head + _text_key(v)
    if r == 80:
        return head + _float_key(v[0]) + _float_key(v[1])
    if r == 90:
        return head + b"".join(map(order_key, v)) + b"\x00"
    fields = sorted(((k.encode("utf-8", "surrogatepass"), x) for k, x in v.items()), key=lambda kx: kx[0])
    return head + b"".join(b"\x01" + _text_key(k) + order_key(x) for k, x in fields) + b"\x00"


def read_path(fields: dict[str, Value], path: str) -> Value | None:
    """The value at a dotted path, which passes through maps only; None if missing."""
    at: Value | None = Value("map", fields)
    for name in path.split("."):
        if at is None or at.kind != "map":
            return None
        at = at.v.get(name)
    return at
