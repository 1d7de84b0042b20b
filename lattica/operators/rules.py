"""Access rules: which caller may get, list, create, update and delete what.

Rules only grant.  A condition is an expression (see ``lattica.operators.conditions``), which is evaluated for reads of
one document and for writes, and must follow from a query's own filter for the query to be allowed ("rules are not
filters").  It may also be a Python function of a ``Request``; what a query must imply is then listed beside it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions import values as V
from lattica.functions.paths import Pattern
from lattica.functions.values import Value
from lattica.operators.conditions import Condition
from lattica.operators.writes import Document, WriteError
from lattica.plans.ast import And, Query, Test

# Operations and what the two groups stand for.
GROUPS = {"read": ("get", "list"), "write": ("create", "update", "delete"), "all": ("get", "list", "create", "update", "delete")}


@dataclass
class Request:
    operation: str
    path: str
    auth: dict
    captures: dict[str, str]
    time: int
    resource: dict[str, Value] | None = None
    after: dict[str, Value] | None = None
    fetch: Callable[[str], dict[str, Value] | None] = lambda path: None
    _seen: dict = field(default_factory=dict)

    def get(self, path: str) -> dict[str, Value] | None:
        """Another document's fields, read once for each request."""
        if path not in self._seen:
            self._seen[path] = self.fetch(path)
        return self._seen[path]

    def exists(self, path: str) -> bool:
        return self.get(path) is not None


@dataclass(frozen=True)
class Need:
    """A test a query must imply; ``value`` gives the operand for the caller and the path's captures."""

    field: str
    op: str
    value: Callable[[dict, dict], Value]


@dataclass
class Rule:
    pattern: Pattern
    operations: frozenset[str]
    condition: Callable[[Request], bool]
    needs: tuple[Need, ...] | None
    expression: Condition | None = None


class Rules:
    def __init__(self) -> None:
        self.rules: list[Rule] = []

    def allow(self, pattern: str, operations: str | tuple[str, ...], condition: Callable[[Request], bool] | Condition = lambda r: True,
        needs: tuple[Need, ...] | None = None) -> Rules:
        """Grant operations on a path.  For a condition that is a function, ``needs`` (empty: none) says what a query must
        imply; without it no list is granted by it."""
        ops = (operations,) if isinstance(operations, str) else operations
        if isinstance(condition, Condition):
            self.rules.append(Rule(Pattern(pattern), frozenset(o for op in ops for o in GROUPS.get(op, (op,))), condition.holds, needs, condition))
            return self
        self.rules.append(Rule(Pattern(pattern), frozenset(o for op in ops for o in GROUPS.get(op, (op,))), condition, needs))
        return self

    def permit(self, request: Request) -> None:
        for rule in self.rules:
            captures = rule.pattern.match(request.path)
            if captures is not None and request.operation in rule.operations:
                request.captures = captures
                try:
                    if rule.condition(request):
                        return
                except (KeyError, AttributeError, TypeError):
                    continue  # a condition over what is not there grants nothing
        raise WriteError("PERMISSION_DENIED", f"{request.operation} {request.path}")

    def permit_query(self, q: Query, auth: dict, fetch: Callable[[str], dict[str, Value] | None] = lambda path: None) -> None:
        """Allowed if some rule's condition follows from the query's top-level conjunction."""
        tests = [t for t in (q.where.items if isinstance(q.where, And) else [q.where]) if isinstance(t, Test)]
        for rule in self.rules:
            captures = rule.pattern.match(f"{q.collection}/__any__")
            if captures is None or "list" not in rule.operations:
                continue
            if rule.expression is not None and rule.expression.proven(tests, Request("list", q.collection, auth, captures, 0, fetch=fetch)):
                return
            if rule.needs is None:
                continue
            try:
                if all(any(implies(t, n, n.value(auth, captures)) for t in tests) for n in rule.needs):
                    return
            except KeyError:
                continue
        raise WriteError("PERMISSION_DENIED", f"list {q.collection}")


def implies(t: Test, n: Need, v: Value) -> bool:
    """Whether every document that passes ``t`` passes the need."""
    if t.field != n.field or t.op not in ("eq", "ne", "gt", "gte", "lt", "lte"):
        return False
    same_class = V.rank(t.value) == V.rank(v)
    c = V.compare(t.value, v)
    holds = {"eq": c == 0, "ne": c != 0, "gt": c > 0, "gte": c >= 0, "lt": c < 0, "lte": c <= 0}
    if t.op == "eq":
        return holds[n.op] and (same_class or n.op == "ne")
    if t.op == "ne":
        return n.op == "ne" and c == 0
    if not same_class:
        return n.op == "ne"
    if n.op == "ne":
        return t.op[0] == "g" and (c > 0 or c == 0 and t.op == "gt") or t.op[0] == "l" and (c < 0 or c == 0 and t.op == "lt")
    if t.op[0] != n.op[0]:
        return False
    inside = c > 0 if t.op[0] == "g" else c < 0
    return inside or c == 0 and (n.op.endswith("e") or not t.op.endswith("e"))


def resource(d: Document | None) -> dict[str, Value] | None:
    """A document's fields with its metadata beside them; metadata wins over a field of the same name."""
    if d is None:
        return None
    collection, _, doc = d.path.rpartition("/")
    return {**d.fields, "id": V.string(doc), "path": V.string(d.path), "collection": V.string(collection), "createdAt": Value("timestamp", d.created),
        "updatedAt": Value("timestamp", d.updated), "version": V.integer(d.version)}


def permitted(documents: DataFrame, rules: Rules, operation: str, auth: dict) -> DataFrame:
    """(document_path) of the stored documents on which a caller may carry out ``get`` or ``delete``, decided on the cluster.

    Each document is looked at by itself, so conditions that read other documents hold for none.  Unreadable documents have
    no fields; rows with a null path are left out.
    """
    from lattica.operators.nested import parse

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path, data, created, updated, version in zip(*[b.column(k).to_pylist() for k in range(5)]):
                fields = {k: V.from_json(v) for k, v in parse(data).items()}
                try:
                    rules.permit(Request(operation, path, auth, {}, 0, resource(Document(path, fields, created or 0, updated or 0, version or 0))))
                    out.append(path)
                except WriteError:
                    continue
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["document_path"])

    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp_ntz").cast("timestamp")).alias(c)
    return documents.where(F.col("document_path").isNotNull()).select("document_path", "data", micros("created_at"), micros("updated_at"),
        "version").mapInArrow(decide, "document_path string")
