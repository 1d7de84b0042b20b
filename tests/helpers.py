"""Small tables of documents for tests."""

import itertools
import json
import math
from datetime import datetime

from lattica.functions import values as V
from lattica.functions.paths import split_document
from lattica.functions.values import Value
from lattica.plans.ast import Test
from lattica.sources.collections import TaggedCollections

SCHEMA = "document_path string, document_id string, collection_path string, collection_id string, data string, created_at timestamp_ntz, updated_at timestamp_ntz, version long"
NAN, INF = float("nan"), float("inf")


def s(x):
    return Value("string", x)


def i(x):
    return Value("integer", x)


def d(x):
    return Value("double", float(x))


def arr(*x):
    return Value("array", tuple(x))


def mp(**x):
    return Value("map", x)


def document_row(path, fields, version=1):
    collection, cid, doc = split_document(path)
    at = datetime(2025, 1, 1)
    return (path, doc, collection, cid, json.dumps({k: V.to_json(v) for k, v in fields.items()}), at, at, version)


def documents(spark, docs):
    return spark.createDataFrame([document_row(p, f) for p, f in docs.items()], SCHEMA)


def source(spark, docs):
    return TaggedCollections(documents(spark, docs))


def words_over(letters, longest):
    """All sequences of up to so many of the letters."""
    return [w for n in range(longest + 1) for w in itertools.product(letters, repeat=n)]


def boundary_values():
    """Values of every type made by the types' own rules: around powers of two, over small alphabets, nested one deep."""
    powers = [2**e for e in (0, 31, 52)]
    numbers = [i(sign * p) for p in powers for sign in (-1, 1)] + [d(sign * (p + 0.5)) for p in powers[:2] for sign in (-1, 1)]
    numbers += [i(0), d(0), i(V.INT_MIN), i(V.INT_MAX), d(INF), d(-INF), d(math.ulp(0.0)), d(-math.ulp(0.0)), d(powers[1])]
    instants = [Value("timestamp", sign * 10**e) for e in (0, 15) for sign in (-1, 1)]
    texts = [s("".join(w)) for w in words_over("Zaß\U0001d11e", 2)]
    raw = [Value("bytes", bytes(w)) for w in words_over((0, 127, 255), 2)]
    references = [Value("reference", "/".join(w)) for w in itertools.product("Aaé", "x", "b", "Zz")] + [Value("reference", f"{x}/x") for x in "Aaé"]
    points = [Value("geopoint", p) for p in itertools.product((-90.0, 0.25, 90.0), (-180.0, 0.0, 180.0))]
    parts = [V.NULL, i(1), d(1.5), s("b")]
    arrays = [arr(*w) for w in words_over(parts, 2)]
    maps = [mp(**dict(w)) for names in ((), ("a",), ("b",), ("a", "b")) for w in itertools.product(*[[(n, v) for v in parts[1:3]] for n in names])]
    return [V.NULL, Value("boolean", False), Value("boolean", True), d(NAN), *numbers, *instants, *texts, *raw, *references, *points, *arrays, *maps]


def natural(v):
    """A key in the total order by Python's own order of numbers, bytes and tuples, apart from the library's comparisons."""
    utf8 = lambda x: x.encode("utf-8")
    match v.kind:
        case "null":
            return (10,)
        case "boolean":
            return (20, v.v)
        case "integer" | "double":
            return (29,) if v.v != v.v else (30, v.v)
        case "timestamp":
            return (40, v.v)
        case "string":
            return (50, utf8(v.v))
        case "bytes":
            return (60, v.v)
        case "reference":
            return (70, utf8(v.v))
        case "geopoint":
            return (80, *v.v)
        case "array":
            return (90, [natural(x) for x in v.v])
    return (100, [(utf8(k), natural(v.v[k])) for k in sorted(v.v, key=utf8)])


def collection_of(values):
    """A document for each value, named by its place, and one without the field."""
    return {f"c/{n:03d}": {"f": v} for n, v in enumerate(values)} | {"c/bare": {"g": i(1)}}


def t(op, value, field="f"):
    return Test(field, op, value)
