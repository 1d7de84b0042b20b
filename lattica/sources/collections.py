"""Where a query's rows come from: typed tables registered as collections, and tables of tagged documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.functions import fields as C
from lattica.plans.ast import NAME

#: Columns of a table of tagged documents.
DOCUMENT_COLUMNS = ("document_path", "document_id", "collection_path", "collection_id", "data", "created_at", "updated_at", "version")
_KINDS: list[tuple[tuple[type, ...], str]] = [
    ((T.BooleanType,), "boolean"), ((T.ByteType, T.ShortType, T.IntegerType, T.LongType), "integer"), ((T.FloatType, T.DoubleType, T.DecimalType), "double"),
    ((T.TimestampType, T.TimestampNTZType, T.DateType), "timestamp"), ((T.BinaryType,), "bytes"),
]


class TypedCollection:
    """A table with a schema as one collection; null means missing.  The path of a row is ``<name>/<id>``."""

    def __init__(self, name: str, df: DataFrame, id_column: str | Column):
        self.name = name
        key = F.col(id_column) if isinstance(id_column, str) else id_column
        self.key = (F.col(f"`{id_column}`"), df.schema[id_column].dataType) if isinstance(id_column, str) else None
        self.df = df.withColumn("document_path", F.concat(F.lit(f"{name}/"), key.cast("string")))

    def scan(self, collection: str) -> DataFrame:
        return self.df if collection == self.name else self.df.limit(0)

    def field(self, path: str) -> C.Field:
        if path == NAME:
            return C.NameField(F.col("document_path")) if self.key is None else C.KeyField(F.col("document_path"), f"{self.name}/", *self.key)
        t: T.DataType = self.df.schema
        column: Column | None = None
        for name in path.split("."):
            if isinstance(t, T.StructType) and name in t.names:
                column = F.col(f"`{name}`") if column is None else column.getField(name)
                t = t[name].dataType
            elif isinstance(t, T.MapType) and column is not None:
                column, t = column.getItem(name), t.valueType
            else:
                return C.MissingField()
        if isinstance(t, (T.ArrayType, T.StructType, T.MapType)):
            return C.NestedField(column, t)
        for classes, kind in _KINDS:
            if isinstance(t, classes):
                return C.TypedField(column.cast("double") if isinstance(t, (T.DecimalType, T.FloatType)) else column, kind)
        return C.TypedField(column, "string")

    def rows(self, paths: Sequence[str]) -> DataFrame:
        """The rows at these paths; where the key is a column, the filter is on it and reaches the scan."""
        if self.key is None:
            return self.df.where(F.col("document_path").isin(list(paths)))
        found = [k for p in sorted(set(paths)) if (k := C.key_of(p, f"{self.name}/", self.key[1])) is not None]
        return self.df.where(self.key[0].isin(found)) if found else self.df.limit(0)

    def project(self, df: DataFrame, select: tuple[str, ...]) -> DataFrame:
        """The path and the selected fields; a selected parent wins over its children."""
        if not select:
            return df
        return df.select("document_path", *[c for name, node in trie(select).items() if (c := self._part(F.col(f"`{name}`"), self.df.schema, name, node)) is not None])

    def _part(self, column: Column, parent: T.StructType, name: str, node: dict) -> Column | None:
        if name not in parent.names:
            return None
        t = parent[name].dataType
        if not node:
            return column.alias(name)
        if not isinstance(t, T.StructType):
            return None
        inner = [c for n, x in node.items() if (c := self._part(column.getField(n), t, n, x)) is not None]
        return F.when(column.isNotNull(), F.struct(*inner)).alias(name) if inner else None


class TaggedCollections:
    """A table of tagged documents of any number of collections (the columns of DOCUMENT_COLUMNS)."""

    def __init__(self, df: DataFrame):
        self.df = df

    def scan(self, collection: str) -> DataFrame:
        # the path says it all: a prefix reaches the Parquet reader, and the collection columns may be null in stored rows
        path = F.col("document_path")
        last = collection.rpartition("/")[2]
        below = path.startswith(f"{collection}/") & (F.locate("/", path, len(collection) + 2) == 0)
        return self.df.where(below & (F.col("collection_id").isNull() | (F.col("collection_id") == last)))

    def field(self, path: str) -> C.Field:
        return C.NameField(F.col("document_path")) if path == NAME else C.TaggedField(tagged_at(F.col("data"), path))

    def project(self, df: DataFrame, select: tuple[str, ...]) -> DataFrame:
        """The documents with the selected fields only.

        A map on the way to a selected field is kept, empty if it lacks the field; where it is missing or no map, nothing
        is.  An explicit null is kept.
        """
        if not select:
            return df
        return df.withColumn("data", F.coalesce(rebuilt(F.from_json("data", C._MAP), trie(select)), F.lit("{}")))


def tagged_at(data: Column, path: str) -> Column:
    """The tagged value at a dotted path of a stored document, as JSON text; null if missing."""
    names = path.split(".")
    at = F.from_json(data, C._MAP)[names[0]]
    for name in names[1:]:
        at = F.from_json(F.from_json(F.from_json(at, C._MAP)["mapValue"], C._MAP)["fields"], C._MAP)[name]
    return at


def trie(paths: tuple[str, ...]) -> dict:
    """Selected paths as a tree; an empty node is taken whole, whatever lies below."""
    root: dict = {}
    for path in sorted(paths, key=lambda p: p.count(".")):
        node, names = root, path.split(".")
        for i, name in enumerate(names):
            if name in node and not node[name]:
                break
            node = node.setdefault(name, {})
            if i == len(names) - 1:
                node.clear()
    return root


def rebuilt(fields: Column, node: dict) -> Column:
    """JSON text of a field map cut down to ``node``."""
    parts = []
    for name, inner in node.items():
        value = fields[name]
        if inner:
            one = F.from_json(value, C._MAP)
            below = rebuilt(F.from_json(F.from_json(one["mapValue"], C._MAP)["fields"], C._MAP), inner)
            value = F.when(F.map_contains_key(one, F.lit("mapValue")), F.concat(F.lit('{"mapValue":{"fields":'), F.coalesce(below, F.lit("{}")), F.lit("}}")))
        key = F.lit(_quoted(name) + ":")
        parts.append(F.when(value.isNotNull(), F.concat(key, value)))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def _quoted(name: str) -> str:
    import json

    return json.dumps(name, ensure_ascii=False)
