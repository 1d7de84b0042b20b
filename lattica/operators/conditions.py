"""Conditions of access rules as expressions: evaluated for a request, or proven from a query that has not run.

``Field("owner") == Auth("uid")`` is a condition; conditions combine with ``&`` and ``|``.  An operand may be missing (a field
that is not there, a caller without that claim); a comparison with a missing operand does not hold, whatever its
operator.  Ranges hold inside a type class only, as in filters.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from lattica.functions import values as V
from lattica.functions.values import Value
from lattica.plans.ast import Test

_FLIPPED = {"eq": "eq", "ne": "ne", "gt": "lt", "gte": "lte", "lt": "gt", "lte": "gte"}


def plain_value(x: Any) -> Value | None:
    """A Python value, as claims have it, as a typed one; None is missing."""
    match x:
        case None | Value():
            return x
        case bool():
            return Value("boolean", x)
        case int():
            return Value("integer", x)
        case float():
            return Value("double", x)
        case str():
            return Value("string", x)
        case list() | tuple():
            return Value("array", tuple(plain_value(e) or V.NULL for e in x))
        case dict():
            return Value("map", {k: plain_value(e) or V.NULL for k, e in x.items()})
    raise TypeError(f"no value: {x!r}")


class Operand:
    """Something that has a value for a request."""

    def of(self, request) -> Value | None:
        raise NotImplementedError

    @property
    def known(self) -> bool:
        """Whether the value does not depend on a document or on the time, so that it is known before a query runs."""
        return False

    def _compare(self, op: str, other: Any) -> Comparison:
        return Comparison(self, op, other if isinstance(other, Operand) else Constant(plain_value(other)))

    def __eq__(self, other: Any) -> Comparison:  # type: ignore[override]
        return self._compare("eq", other)

    def __ne__(self, other: Any) -> Comparison:  # type: ignore[override]
        return self._compare("ne", other)

    def __lt__(self, other: Any) -> Comparison:
        return self._compare("lt", other)

    def __le__(self, other: Any) -> Comparison:
        return self._compare("lte", other)

    def __gt__(self, other: Any) -> Comparison:
        return self._compare("gt", other)

    def __ge__(self, other: Any) -> Comparison:
        return self._compare("gte", other)

    __hash__ = object.__hash__


class Constant(Operand):
    known = True

    def __init__(self, value: Value | None):
        self.value = value

    def of(self, request) -> Value | None:
        return self.value


class Auth(Operand):
    """A claim of the caller; more names go into maps."""

    known = True

    def __init__(self, *names: str):
        self.names = names

    def of(self, request) -> Value | None:
        at: Any = request.auth
        for n in self.names:
            at = at.get(n) if isinstance(at, dict) else None
        return plain_value(at)


class Param(Operand):
    """What a capture of the rule's pattern stands for."""

    known = True

    def __init__(self, name: str):
        self.name = name

    def of(self, request) -> Value | None:
        return plain_value(request.captures.get(self.name))


class Field(Operand):
    """A field of the document as it is (dotted path), or one of its id, path, collection, createdAt, updatedAt, version."""

    def __init__(self, path: str):
        self.path = path

    def of(self, request) -> Value | None:
        return V.read_path(request.resource, self.path) if request.resource is not None else None


class After(Field):
    """The same of the document as the write leaves it."""

    def of(self, request) -> Value | None:
        return V.read_path(request.after, self.path) if request.after is not None else None


class Now(Operand):
    def of(self, request) -> Value | None:
        return Value("timestamp", request.time)


def _path(parts: Sequence[str | Operand], request) -> str | None:
    """A path put together from texts and operands; None if one is missing or no text."""
    out = []
    for p in parts:
        v = p.of(request) if isinstance(p, Operand) else Value("string", p)
        if v is None or v.kind not in ("string", "reference"):
            return None
        out.append(v.v)
    return "/".join(out)


class Other(Operand):
    """A field of another document, whose path is put together from texts and operands."""

    def __init__(self, *parts: str | Operand, field: str):
        self.parts, self.field = parts, field

    def of(self, request) -> Value | None:
        path = _path(self.parts, request)
        found = request.get(path) if path else None
        return V.read_path(found, self.field) if found is not None else None


class Condition:
    def holds(self, request) -> bool:
        raise NotImplementedError

    def proven(self, tests: Sequence[Test], request) -> bool:
        """Whether it holds for every document that passes the tests; ``request`` has caller and captures only."""
        return False

    def __and__(self, other: Condition) -> Condition:
        return AllOf((self, other))

    def __or__(self, other: Condition) -> Condition:
        return AnyOf((self, other))


class Always(Condition):
    def holds(self, request) -> bool:
        return True

    def proven(self, tests: Sequence[Test], request) -> bool:
        return True


@dataclass(frozen=True, eq=False)
class Comparison(Condition):
    left: Operand
    op: str
    right: Operand

    def holds(self, request) -> bool:
        a, b = self.left.of(request), self.right.of(request)
        if a is None or b is None:
            return False
        c = V.compare(a, b)
        if self.op in ("eq", "ne"):
            return (c == 0) == (self.op == "eq")
        return V.rank(a) == V.rank(b) and {"gt": c > 0, "gte": c >= 0, "lt": c < 0, "lte": c <= 0}[self.op]

    def proven(self, tests: Sequence[Test], request) -> bool:
        from lattica.operators.rules import Need, implies

        for a, op, b in ((self.left, self.op, self.right), (self.right, _FLIPPED[self.op], self.left)):
            if type(a) is Field and b.known and (v := b.of(request)) is not None:
                return any(implies(t, Need(a.path, op, lambda auth, captures: v), v) for t in tests)
        return self.left.known and self.right.known and self.holds(request)


@dataclass(frozen=True)
class AllOf(Condition):
    parts: tuple[Condition, ...]

    def holds(self, request) -> bool:
        return all(p.holds(request) for p in self.parts)

    def proven(self, tests: Sequence[Test], request) -> bool:
        return all(p.proven(tests, request) for p in self.parts)


@dataclass(frozen=True)
class AnyOf(Condition):
    parts: tuple[Condition, ...]

    def holds(self, request) -> bool:
        return any(p.holds(request) for p in self.parts)

    def proven(self, tests: Sequence[Test], request) -> bool:
        return any(p.proven(tests, request) for p in self.parts)


class Exists(Condition):
    """Whether another document is there; its path is put together from texts and operands."""

    def __init__(self, *parts: str | Operand):
        self.parts = parts

    def holds(self, request) -> bool:
        path = _path(self.parts, request)
        return path is not None and request.exists(path)

    def proven(self, tests: Sequence[Test], request) -> bool:
        return all(not isinstance(p, Operand) or p.known for p in self.parts) and self.holds(request)
