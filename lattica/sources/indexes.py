"""Indexes as layouts: the documents of a collection id with their hot fields shredded into typed columns and sorted by them.

A layout answers the same queries as the documents; comparisons on its fields are plain comparisons of columns, which the
Parquet reader checks against the value ranges of row groups, and nothing of the JSON is parsed for them.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import values as V
from lattica.functions.fields import Field, TaggedField, literal_parts, typed_literal
from lattica.functions.values import Value
from lattica.operators.predicates import compile_filter
from lattica.plans.ast import NAME, And, Order, QueryError, Test, Unary, filter_json
from lattica.sources.collections import TaggedCollections, tagged_at
from lattica.sources.shared import Versions, remove

#: Columns of a shredded field after its number, in sort order.
PARTS = ("rank", "num", "res", "num2", "text", "bytes", "key")


@dataclass(frozen=True)
class Index:
    """Fields (with direction) of all collections with an id, optionally of the documents that pass a filter only.

    The filter may be built from and, eq, gt, gte, lt, lte, exists and isNull.
    """

    collection_id: str
    fields: tuple[Order, ...]
    where: object = None

    def __post_init__(self) -> None:
        if not re.fullmatch(r"[A-Za-z0-9_-]+", self.collection_id):
            raise QueryError("INDEX_COLLECTION", "an index is on a collection id of one segment")
        if not self.fields or NAME in [o.field for o in self.fields] or len({o.field for o in self.fields}) < len(self.fields):
            raise QueryError("INDEX_FIELDS", "an index has one or more different fields")
        if self.where is not None:
            _check(self.where)

    @property
    def name(self) -> str:
        """The same for the same definition, everywhere."""
        text = json.dumps([self.collection_id, [[o.field, o.descending] for o in self.fields], filter_json(self.where) if self.where is not None else None], ensure_ascii=False)
        return f"{self.collection_id}-{hashlib.sha256(text.encode()).hexdigest()[:16]}"


def _check(f) -> None:
    match f:
        case And(items) if items:
            for x in items:
                _check(x)
        case Test(_, op, _) if op in ("eq", "gt", "gte", "lt", "lte"):
            pass
        case Unary(op, _) if op in ("exists", "isNull"):
            pass
        case _:
            raise QueryError("INDEX_FILTER", "an index filter has and, eq, gt, gte, lt, lte, exists and isNull")


class ShreddedField(Field):
    """A field read from the columns of a layout; missing means all of them are null."""

    def __init__(self, number: int):
        self.column = {p: F.col(f"__f{number}_{p}") for p in PARTS}
        self.rank = self.column["rank"]
        self.exists = self.rank.isNotNull()

    def parts(self, rank: int) -> list[Column]:
        names = {20: ["num"], 30: ["num", "res"], 40: ["res"], 50: ["text"], 60: ["bytes"], 70: ["text"], 80: ["num", "num2"], 90: ["key"], 100: ["key"]}
        return [self.column[p] for p in names.get(rank, [])]

    def _literals(self, v: Value) -> list[Column]:
        return [F.lit(float(x)) if isinstance(x, bool) else typed_literal(x) for x in literal_parts(v)]

    def equals(self, v: Value) -> Column:
        # a present field of another class fails on the rank, a missing one is null throughout: no guards needed
        cond = self.rank == F.lit(V.rank(v))
        for part, lit in zip(self.parts(V.rank(v)), self._literals(v)):
            cond = cond & (part == lit)
        return cond

    def within(self, op: str, v: Value) -> Column:
        r = V.rank(v)
        if r in (10, V.NAN_RANK):
            return F.lit(False)
        pairs = list(zip(self.parts(r), self._literals(v)))
        part, lit = pairs[-1]
        cond = {"gt": part > lit, "gte": part >= lit, "lt": part < lit, "lte": part <= lit}[op]
        for part, lit in reversed(pairs[:-1]):
            cond = (part > lit if op[0] == "g" else part < lit) | ((part == lit) & cond)
        return (self.rank == F.lit(r)) & cond

    def order(self) -> list[Column]:
        return [self.column[p] for p in PARTS]

    def text(self) -> Column:
        return F.when(self.rank == 50, self.column["text"])


class IndexedCollections(TaggedCollections):
    """A layout as a source of queries: its fields by their columns, all others from the JSON."""

    def __init__(self, df: DataFrame, index: Index):
        super().__init__(df)
        self.numbers = {o.field: n for n, o in enumerate(index.fields)}

    def field(self, path: str) -> Field:
        return ShreddedField(self.numbers[path]) if path in self.numbers and path != NAME else super().field(path)


def shredded(documents: DataFrame, index: Index) -> DataFrame:
    """The documents an index covers, with the columns of its fields, sorted by them within ranges."""
    source = TaggedCollections(documents)
    of_id = F.split_part(F.col("document_path"), F.lit("/"), F.lit(-2)) == index.collection_id
    df = documents.where(of_id)
    if index.where is not None:
        df = df.where(compile_filter(source, index.where))
    columns = {f"__f{n}_{p}": c for n, o in enumerate(index.fields) for p, c in zip(PARTS, TaggedField(tagged_at(F.col("data"), o.field)).order())}
    df = df.withColumns(columns)
    keys = [F.col(f"__f{n}_{p}").desc() if o.descending else F.col(f"__f{n}_{p}").asc() for n, o in enumerate(index.fields) for p in PARTS[:5]]
    return df.repartitionByRange(*keys, F.col("document_path")).sortWithinPartitions(*keys, "document_path")


class Indexes:
    """Layouts below a folder, by index name; building one again replaces it in one step."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, documents: DataFrame, index: Index, seq: int | None = None) -> IndexedCollections:
        """Build or replace the layout; ``seq`` says how far in the feed the documents go."""
        versions = Versions(self.spark, f"{self.path}/{index.name}")
        number, _ = versions.latest()
        with versions.writing(number) as at:
            shredded(documents, index).write.parquet(at)
            versions.publish(number, {"layout": at, "seq": seq})
        return self.open(index)

    def at(self, index: Index, seq: int) -> IndexedCollections | None:
        """The layout if it was built from just these documents."""
        _, manifest = Versions(self.spark, f"{self.path}/{index.name}").latest()
        return self.open(index) if manifest and manifest.get("seq") == seq else None

    def open(self, index: Index) -> IndexedCollections:
        _, manifest = Versions(self.spark, f"{self.path}/{index.name}").latest()
        if not manifest:
            raise QueryError("NO_INDEX", index.name)
        return IndexedCollections(self.spark.read.parquet(manifest["layout"]), index)

    def drop(self, index: Index) -> None:
        remove(self.spark, f"{self.path}/{index.name}")

