"""Atomic batches of writes: the new state of the documents a batch touches, and the net change of each.

A batch touches at most 500 documents named by the caller (and what a cascade removes), so it is applied in Python on
the driver; reading those documents and storing the result are Spark's part (``lattica.sources.store``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from typing import Any

from lattica.functions import values as V
from lattica.functions.paths import is_collection, is_document
from lattica.functions.values import KINDS, Value, ValueFormatError, from_json

# Limits of a batch and of a document.
MAX_WRITES, MAX_BYTES, MAX_DEPTH = 500, 1_048_576, 20
TRANSFORMS = ("serverTimestamp", "increment", "maximum", "minimum", "arrayUnion", "arrayRemove")

#: Stands for "remove this field"; never stored.
DELETE = Value("delete", None)


class WriteError(RuntimeError):
    """A write that cannot be applied: INVALID_ARGUMENT, NOT_FOUND, ALREADY_EXISTS, FAILED_PRECONDITION, ABORTED or PERMISSION_DENIED."""

    def __init__(self, status: str, message: str):
        super().__init__(f"{status}: {message}")
        self.status = status


@dataclass(frozen=True)
class Document:
    path: str
    fields: dict[str, Value]
    created: int
    updated: int
    version: int


@dataclass(frozen=True)
class Precondition:
    exists: bool | None = None
    update_time: int | None = None


@dataclass(frozen=True)
class Transform:
    field: str
    kind: str
    operand: Value | None = None


@dataclass(frozen=True)
class Set:
    path: str
    fields: dict[str, Value]
    merge: bool = False
    merge_fields: tuple[str, ...] | None = None
    transforms: tuple[Transform, ...] = ()
    precondition: Precondition = Precondition()


@dataclass(frozen=True)
class Update:
    path: str
    fields: dict[str, Value]
    transforms: tuple[Transform, ...] = ()
    precondition: Precondition = Precondition()


@dataclass(frozen=True)
class Delete:
    path: str
    cascade: bool = False
    precondition: Precondition = Precondition()


@dataclass(frozen=True)
class Change:
    type: str
    path: str
    version: int


@dataclass
class Outcome:
    documents: dict[str, Document | None] = field(default_factory=dict)
    changes: list[Change] = field(default_factory=list)
    results: list[dict[str, Value]] = field(default_factory=list)


def invalid(message: str) -> WriteError:
    return WriteError("INVALID_ARGUMENT", message)


# ---- checks on the request


def _holds_delete(v: Value) -> bool:
    if v is DELETE or v.kind == "delete":
        return True
    inner = v.v if v.kind == "array" else v.v.values() if v.kind == "map" else ()
    return any(map(_holds_delete, inner))


def _delete_in_array(v: Value) -> bool:
    if v.kind == "array":
        return _holds_delete(v)
    return v.kind == "map" and any(map(_delete_in_array, v.v.values()))


def check(writes: Iterable[Set | Update | Delete], allow_empty: bool = False) -> None:
    writes = list(writes)
    if not writes and not allow_empty or len(writes) > MAX_WRITES:
        raise invalid(f"a batch has 1 to {MAX_WRITES} writes")
    for w in writes:
        if isinstance(w, Delete):
            if not (is_document(w.path) or w.cascade and is_collection(w.path)):
                raise invalid(f"no document path: {w.path!r}")
            continue
        if not is_document(w.path):
            raise invalid(f"no document path: {w.path!r}")
        if isinstance(w, Set) and w.merge and w.merge_fields is not None:
            raise invalid("merge and mergeFields exclude each other")
        for v in w.fields.values():
            if _delete_in_array(v):
                raise invalid("a field cannot be deleted inside an array")
            if isinstance(w, Set) and not w.merge and w.merge_fields is None and _holds_delete(v):
                raise invalid("set without merge deletes no fields")
            if isinstance(w, Update) and v.kind == "map" and _holds_delete(v):
                raise invalid("update deletes by dotted path, not inside a value")
        if isinstance(w, Update) and any(not p or "" in p.split(".") for p in w.fields):
            raise invalid("empty segment in a field path")
        seen = set()
        for t in w.transforms:
            if t.kind not in TRANSFORMS or t.field in seen:
                raise invalid(f"one known transform for each field: {t.field}")
            seen.add(t.field)
            if t.kind == "serverTimestamp":
                continue
            if t.operand is None or _holds_delete(t.operand):
                raise invalid(f"{t.kind} needs an operand")
            wanted = ("array",) if t.kind.startswith("array") else ("integer", "double")
            if t.operand.kind not in wanted:
                raise invalid(f"{t.kind} takes {' or '.join(wanted)}")


# ---- field trees


def set_at(fields: dict[str, Value], names: list[str], v: Value) -> dict[str, Value]:
    """A copy with ``v`` at the path; whatever stands on the way and is no map is replaced by one."""
    out = dict(fields)
    if len(names) == 1:
        out[names[0]] = v
    else:
        below = out.get(names[0])
        out[names[0]] = Value("map", set_at(below.v if below is not None and below.kind == "map" else {}, names[1:], v))
    return out


def delete_at(fields: dict[str, Value], names: list[str]) -> dict[str, Value]:
    """A copy without the path; missing or non-map parents are left as they are."""
    if names[0] not in fields:
        return fields
    out = dict(fields)
    if len(names) == 1:
        del out[names[0]]
    elif out[names[0]].kind == "map":
        out[names[0]] = Value("map", delete_at(out[names[0]].v, names[1:]))
    return out


def merged(old: dict[str, Value], new: Mapping[str, Value]) -> dict[str, Value]:
    """Maps merge into maps; everything else replaces; deletions remove.

    A map in which only deletions stand changes an existing map and is otherwise ignored; a map given as empty is set.
    """
    out = dict(old)
    for name, v in new.items():
        have = out.get(name)
        if v.kind == "delete":
            out.pop(name, None)
        elif v.kind == "map":
            base = have.v if have is not None and have.kind == "map" else None
            if base is None and v.v and not _any_set(v):
                continue
            out[name] = Value("map", merged(base or {}, v.v))
        else:
            out[name] = v
    return out


def _any_set(v: Value) -> bool:
    """Whether a map holds anything but deletions."""
    return any(x.kind != "delete" and (x.kind != "map" or not x.v or _any_set(x)) for x in v.v.values())


def _stripped(v: Value) -> Value | None:
    if v.kind == "delete":
        return None
    if v.kind != "map":
        return v
    return Value("map", {k: s for k, x in v.v.items() if (s := _stripped(x)) is not None})


def masked(old: dict[str, Value], new: dict[str, Value], mask: Iterable[str]) -> dict[str, Value]:
    """Masked paths take their value from ``new``, or go if it has none; all else stays."""
    for path in mask:
        names = path.split(".")
        v = V.read_path(new, path)
        v = None if v is None else _stripped(v)
        old = delete_at(old, names) if v is None else set_at(old, names, v)
    return old


# ---- transforms


def transformed(existing: Value | None, t: Transform, now: int) -> Value:
    op, number = t.operand, existing is not None and existing.kind in ("integer", "double")
    match t.kind:
        case "serverTimestamp":
            return Value("timestamp", now)
        case "increment":
            if not number:
                return op
            if existing.kind == op.kind == "integer":
                return Value("integer", max(V.INT_MIN, min(V.INT_MAX, existing.v + op.v)))
            return Value("double", float(existing.v) + float(op.v))
        case "maximum" | "minimum":
            c = V.compare(op, existing) if number else 1
            return op if not number or (c > 0 if t.kind == "maximum" else c < 0) else existing
        case "arrayUnion":
            out = list(existing.v) if existing is not None and existing.kind == "array" else []
            for x in op.v:
                if not any(V.equal(x, y) for y in out):
                    out.append(x)
            return Value("array", tuple(out))
        case "arrayRemove":
            have = existing.v if existing is not None and existing.kind == "array" else ()
            return Value("array", tuple(x for x in have if not any(V.equal(x, y) for y in op.v)))
    raise invalid(t.kind)


# ---- limits on the result


def _name_bytes(path: str) -> int:
    return 16 + sum(len(s.encode()) + 1 for s in path.split("/"))


def value_bytes(v: Value) -> int:
    match v.kind:
        case "null" | "boolean":
            return 1
        case "integer" | "double" | "timestamp":
            return 8
        case "geopoint":
            return 16
        case "string":
            return len(v.v.encode()) + 1
        case "bytes":
            return len(v.v)
        case "reference":
            return _name_bytes(v.v) + 16
        case "array":
            return sum(map(value_bytes, v.v))
    return sum(len(k.encode()) + 1 + value_bytes(x) for k, x in v.v.items())


def check_limits(path: str, fields: dict[str, Value], max_bytes: int = MAX_BYTES, max_depth: int = MAX_DEPTH) -> None:
    size = _name_bytes(path) + 32 + value_bytes(Value("map", fields))
    if size > max_bytes:
        raise invalid(f"{path} has {size} bytes, more than {max_bytes}")
    todo = [(Value("map", fields), 0)]
    while todo:
        v, depth = todo.pop()
        if depth > max_depth:
            raise invalid(f"{path} is nested deeper than {max_depth}")
        if v.kind == "map":
            for k, x in v.v.items():
                if not k or (len(k) >= 4 and k.startswith("__") and k.endswith("__")):
                    raise invalid(f"reserved or empty field name {k!r} in {path}")
                todo.append((x, depth + 1))
        elif v.kind == "array":
            todo += [(x, depth + 1) for x in v.v]


# ---- the batch


def apply(writes: list[Set | Update | Delete], before: Mapping[str, Document], subtree: Callable[[str], Iterable[str]], now: int,
          authorize: Callable[[Any, Document | None, Document | None], None] | None = None, max_bytes: int = MAX_BYTES, max_depth: int = MAX_DEPTH) -> Outcome:
    """The outcome of a batch over ``before`` (the documents it names and the subtrees of its cascades).

    Writes see those before them in the batch; all have one commit time.  A cascade removes what stood below its root
    before the batch, so what the batch itself created there stays.  Any failure leaves nothing of the batch.
    """
    state: dict[str, Document | None] = dict(before)
    victims = {w.path: sorted(subtree(w.path)) for w in writes if isinstance(w, Delete) and w.cascade}
    out = Outcome()
    for w in writes:
        have = state.get(w.path)
        _check_precondition(w, have)
        results: dict[str, Value] = {}
        if isinstance(w, Delete):
            for path in [w.path, *victims.get(w.path, [])]:
                if authorize and state.get(path) is not None:
                    authorize(w, state[path], None)
                if path in state:
                    state[path] = None
            out.results.append(results)
            continue
        old = have.fields if have else {}
        if isinstance(w, Update):
            fields = old
            for path, v in w.fields.items():
                fields = delete_at(fields, path.split(".")) if v.kind == "delete" else set_at(fields, path.split("."), v)
        elif w.merge_fields is not None:
            fields = masked(old, w.fields, w.merge_fields)
        else:
            fields = merged(old, w.fields) if w.merge else dict(w.fields)
        for t in w.transforms:
            v = transformed(V.read_path(fields, t.field), t, now)
            fields = set_at(fields, t.field.split("."), v)
            results[t.field] = v
        check_limits(w.path, fields, max_bytes, max_depth)
        after = Document(w.path, fields, have.created if have else now, now, have.version + 1 if have else 1)
        if authorize:
            authorize(w, have, after)
        state[w.path] = after
        out.results.append(results)
    for path in sorted(state):
        was, is_ = before.get(path), state[path]
        if was is is_ or was is None and is_ is None:
            continue
        kind = "added" if was is None else "removed" if is_ is None else "modified"
        out.documents[path] = is_
        out.changes.append(Change(kind, path, (is_ or was).version))
    return out


def _check_precondition(w: Set | Update | Delete, have: Document | None) -> None:
    p = w.precondition
    if p.exists is True and have is None or isinstance(w, Update) and have is None and p.update_time is None:
        raise WriteError("NOT_FOUND", w.path)
    if p.exists is False and have is not None:
        raise WriteError("ALREADY_EXISTS", w.path)
    if p.update_time is not None and (have is None or have.updated != p.update_time):
        raise WriteError("FAILED_PRECONDITION", f"{w.path} was not last written at {V.stamp(p.update_time)}")


# ---- JSON


def _value(node: Any, at: str) -> Value:
    if node == {"deleteField": True}:
        return DELETE
    try:
        if isinstance(node, dict) and len(node) == 1:
            ((tag, p),) = node.items()
            if KINDS.get(tag) == "map" and isinstance(p, dict):
                return Value("map", {k: _value(x, f"{at}.{k}") for k, x in V.inside(p, "fields", dict).items()})
            if KINDS.get(tag) == "array" and isinstance(p, dict):
                return Value("array", tuple(_value(x, f"{at}[{i}]") for i, x in enumerate(V.inside(p, "values", list))))
        return from_json(node, at)
    except ValueFormatError as e:
        raise invalid(str(e)) from e


def _part(node: dict, name: str, kind: type, at: str) -> Any:
    """``node[name]`` if it is of a kind, None if it is absent or null."""
    v = node.get(name)
    if v is not None and not isinstance(v, kind):
        raise invalid(f"{at}.{name}: not {'an object' if kind is dict else 'a list' if kind is list else 'true or false' if kind is bool else 'a string'}")
    return v


def _transform(node: Any, at: str) -> Transform:
    if not isinstance(node, dict):
        raise invalid(f"{at}: a transform is an object")
    name, kind = _part(node, "field", str, at), _part(node, "kind", str, at)
    if not name or kind not in TRANSFORMS:
        raise invalid(f"{at}: a transform has a field and a kind of {', '.join(TRANSFORMS)}")
    return Transform(name, kind, _value(node["operand"], f"{at}.operand") if "operand" in node else None)


def parse_write(node: Any) -> Set | Update | Delete:
    """One of ``set``, ``update`` and ``delete`` from JSON; whatever is not of the grammar is INVALID_ARGUMENT, with its place."""
    kinds = [k for k in ("set", "update", "delete") if isinstance(node, dict) and k in node]
    if len(kinds) != 1 or len(node) != 1 or not isinstance(node[kinds[0]], dict):
        raise invalid("a write is an object with exactly one of set, update and delete")
    w, at = node[kinds[0]], f"$.{kinds[0]}"
    path = _part(w, "path", str, at) or ""
    p = _part(w, "precondition", dict, at) or {}
    exists, when = _part(p, "exists", bool, f"{at}.precondition"), _part(p, "updateTime", str, f"{at}.precondition")
    try:
        pre = Precondition(exists, V.micros(when) if when else None)
    except ValueFormatError as e:
        raise invalid(f"{at}.precondition.updateTime: {e}") from e
    if kinds[0] == "delete":
        return Delete(path, bool(_part(w, "cascade", bool, at)), pre)
    fields = {k: _value(v, f"{at}.fields.{k}") for k, v in (_part(w, "fields", dict, at) or {}).items()}
    transforms = tuple(_transform(t, f"{at}.transforms[{i}]") for i, t in enumerate(_part(w, "transforms", list, at) or []))
    if kinds[0] == "update":
        return Update(path, fields, transforms, pre)
    mask = _part(w, "mergeFields", list, at)
    if mask is not None and not all(isinstance(m, str) and m and "" not in m.split(".") for m in mask):
        raise invalid(f"{at}.mergeFields: a list of field paths")
    return Set(path, fields, bool(_part(w, "merge", bool, at)), tuple(mask) if mask is not None else None, transforms, pre)


def to_json(w: Set | Update | Delete) -> dict:
    """The JSON form of a write, which ``parse_write`` reads back."""
    def value(v: Value) -> dict:
        if v.kind == "delete":
            return {"deleteField": True}
        if v.kind == "map":
            return {"mapValue": {"fields": {k: value(x) for k, x in v.v.items()}}}
        return V.to_json(v)

    out: dict[str, Any] = {"path": w.path}
    if w.precondition != Precondition():
        p = w.precondition
        out["precondition"] = ({"exists": p.exists} if p.exists is not None else {}) | ({"updateTime": V.stamp(p.update_time)} if p.update_time is not None else {})
    if isinstance(w, Delete):
        return {"delete": out | ({"cascade": True} if w.cascade else {})}
    out["fields"] = {k: value(v) for k, v in w.fields.items()}
    if w.transforms:
        out["transforms"] = [{"field": t.field, "kind": t.kind} | ({"operand": value(t.operand)} if t.operand is not None else {}) for t in w.transforms]
    if isinstance(w, Update):
        return {"update": out}
    if w.merge:
        out["merge"] = True
    if w.merge_fields is not None:
        out["mergeFields"] = list(w.merge_fields)
    return {"set": out}


class Batch:
    """Collects writes: ``Batch().set("a/b", {...}).delete("a/c")``."""

    def __init__(self) -> None:
        self.writes: list[Set | Update | Delete] = []

    def set(self, path: str, fields: dict[str, Value], **more) -> Batch:
        self.writes.append(Set(path, fields, **more))
        return self

    def update(self, path: str, fields: dict[str, Value], **more) -> Batch:
        self.writes.append(Update(path, fields, **more))
        return self

    def delete(self, path: str, **more) -> Batch:
        self.writes.append(Delete(path, **more))
        return self

    def transform(self, path: str, *transforms: Transform) -> Batch:
        self.writes.append(Set(path, {}, merge=True, transforms=tuple(transforms)))
        return self
