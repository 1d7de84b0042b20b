"""Flat tables from nested tagged documents, linked by interval labels (problem 2).

Every node of a document gets its number in pre-order and in post-order by one depth-first traversal.  Node ``a``
encloses node ``b`` exactly when ``a.pre < b.pre and a.post > b.post``, so any two node tables of a collection can be
linked later without walking the documents again.  Nodes are emitted per type; the nearest enclosing node of a type
is found by one pass over the labels in pre-order with a stack, never by comparing all pairs.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODE_SCHEMA = (
    "document_path string, pre long, post long, depth int, parent_pre long, parent_pointer string, kind string,"
    " in_array boolean, pointer string, name string, value string"
)


def current_rows(documents: DataFrame, *columns: str) -> DataFrame:
    """The row with the highest version of each path, with ``columns``.

    Of rows equal in version the one with a non-null ``collection_id`` counts, then the later ``updated_at``, then the
    greater ``data``; a null version is below all others.  Rows without a path belong to no document.  Partial
    maxima are taken before the shuffle, so a path with very many rows costs one row per task.
    """
    ties = [c for c in ("updated_at", "data") if c in columns]
    order = [F.col("version"), *([F.col("collection_id").isNotNull()] if "collection_id" in columns else []), *[F.col(c) for c in ties]]
    rest = [c for c in columns if c not in ("document_path", "version", *ties)]
    top = F.max(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], *[F.col(c).alias(f"c_{c}") for c in rest]))
    at = {"version": "o0", **{c: f"o{len(order) - len(ties) + i}" for i, c in enumerate(ties)}, **{c: f"c_{c}" for c in rest}}
    return (
        documents.where(F.col("document_path").isNotNull())
        .groupBy("document_path")
        .agg(top.alias("__top"))
        .select(*[F.col("document_path") if c == "document_path" else F.col(f"__top.{at[c]}").alias(c) for c in columns])
    )


_TOKEN = re.compile(r'[ \t\n\r]*(?:([\[\]{},:])|("(?:[^"\\\x00-\x1f]|\\.)*"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null))')


def _parse_deep(text: str) -> object:
    """JSON nested beyond the reader's own limit, by a stack; ValueError for what is no JSON."""
    root: list = []
    stack: list = [root]
    names: list = [None]
    at, expect = 0, "value"  # or "name", "first name", "first value", "colon", "after"
    end = len(text.rstrip(" \t\n\r"))
    while at < end:
        m = _TOKEN.match(text, at)
        if not m or expect == "end":
            raise ValueError(f"no JSON at {at}")
        at, mark, plain = m.end(), m[1], m[2]
        here = stack[-1]
        if expect in ("name", "first name") and plain and plain[0] == '"':
            names[-1], expect = json.loads(plain), "colon"
        elif expect == "colon" and mark == ":":
            expect = "value"
        elif expect in ("value", "first value") and (plain or mark in ("[", "{")):
            value = json.loads(plain) if plain else [] if mark == "[" else {}
            if type(here) is list:
                here.append(value)
            else:
                here[names[-1]] = value
            if plain:
                expect = "after" if len(stack) > 1 else "end"
            else:
                stack.append(value)
                names.append(None)
                expect = "first value" if mark == "[" else "first name"
        elif expect == "after" and mark == ",":
            expect = "value" if type(here) is list else "name"
        elif (expect in ("after", "first value") and mark == "]" and type(here) is list) or (expect in ("after", "first name") and mark == "}" and type(here) is dict):
            stack.pop()
            names.pop()
            expect = "after" if len(stack) > 1 else "end"
        else:
            raise ValueError(f"no JSON at {at}")
    if expect != "end":
        raise ValueError("cut off")
    return root[0]


def parse(text: str | None) -> dict:
    """The field map of a stored document, nested however deep; null, cut-off or otherwise unreadable text has no fields."""
    if text is None:
        return {}
    try:
        try:
            found = json.loads(text)
        except RecursionError:
            found = _parse_deep(text)
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


Node = tuple[int, int, int, str, bool, str, str, object]  # parent, depth, size, tag, in_array, pointer, name, payload


def walk(fields: dict) -> tuple[list[tuple], list[int]]:
    """Nodes in pre-order as (parent index, depth, tag, in_array, pointer, name, payload), and their subtree sizes.

    Node 0 is the document itself.  The traversal keeps its own stack, so depth is not limited by Python's.
    Something that is not a one-tag object is a node with the tag ``invalid`` and no children.
    """
    nodes: list[tuple] = [(-1, 0, "document", False, "", "", None)]
    stack = [(0, 1, v, False, k, k) for k, v in reversed(fields.items())]
    pop, push, add = stack.pop, stack.append, nodes.append
    while stack:
        parent, depth, value, in_array, pointer, name = pop()
        if type(value) is not dict or len(value) != 1:
            add((parent, depth, "invalid", in_array, pointer, name, None))
            continue
        ((tag, payload),) = value.items()
        me = len(nodes)
        if tag == "mapValue":
            add((parent, depth, tag, in_array, pointer, name, None))
            inner = payload.get("fields") if type(payload) is dict else None
            if type(inner) is dict:
                for k in reversed(inner):
                    push((me, depth + 1, inner[k], False, f"{pointer}.{k}", k))
        elif tag == "arrayValue":
            add((parent, depth, tag, in_array, pointer, name, None))
            inner = payload.get("values") if type(payload) is dict else None
            if type(inner) is list:
                for i in range(len(inner) - 1, -1, -1):
                    push((me, depth + 1, inner[i], True, f"{pointer}[{i}]", str(i)))
        else:
            add((parent, depth, tag, in_array, pointer, name, payload))
    sizes = [1] * len(nodes)
    for i in range(len(nodes) - 1, 0, -1):
        sizes[nodes[i][0]] += sizes[i]
    return nodes, sizes


def intervals(nodes: list[tuple], sizes: list[int]) -> list[tuple[int, int]]:
    """(pre, post) of each node; post-order number = pre + descendants - depth."""
    return [(i, i + sizes[i] - 1 - n[1]) for i, n in enumerate(nodes)]


def nearest_enclosing(labels: Iterable[tuple[int, int]]) -> list[int]:
    """For (pre, post) labels in pre-order: the position of the nearest enclosing label among them, or -1."""
    out, open_ = [], []
    for i, (_, post) in enumerate(labels):
        while open_ and open_[-1][1] < post:
            open_.pop()
        out.append(open_[-1][0] if open_ else -1)
        open_.append((i, post))
    return out


def _text(payload: object) -> str | None:
    return payload if payload is None or isinstance(payload, str) else json.dumps(payload, ensure_ascii=False, sort_keys=True)


#: Nodes put out at once, whatever the size of the documents.
NODES_A_BATCH = 20_000


def _batched(rows: Iterator[tuple], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of NODES_A_BATCH."""
    while held := list(islice(rows, NODES_A_BATCH)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)


def node_table(documents: DataFrame, keep: Callable[[tuple], bool] | None = None) -> DataFrame:
    """Labelled nodes of the documents (``document_path``, ``data``), one row per node for which ``keep`` holds.

    ``parent_pre`` and ``parent_pointer`` are label and pointer of the nearest enclosing kept node, -1 and "" if there is
    none.  ``keep`` sees (parent index, depth, tag, in_array, pointer, name, payload) and may restrict what is emitted,
    never how nodes are numbered.
    Null, empty or unreadable ``data`` gives the document node alone.  Repeated paths give repeated nodes: pass
    current rows.
    """
    names = [f.split()[0] for f in NODE_SCHEMA.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.string()]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    nodes, sizes = walk(parse(data))
                    kept = [(i, i + sizes[i] - 1 - n[1]) for i, n in enumerate(nodes) if keep is None or keep(n)]
                    for (pre, post), up in zip(kept, nearest_enclosing(kept)):
                        _, depth, tag, in_array, pointer, name, payload = nodes[pre]
                        parent, above = (kept[up][0], nodes[kept[up][0]][4]) if up >= 0 else (-1, "")
                        yield path, pre, post, depth, parent, above, tag, in_array, pointer, name, _text(payload)

        return _batched(rows(), names, types)

    return documents.select("document_path", "data").mapInArrow(label, NODE_SCHEMA)


def is_element_map(node: tuple) -> bool:
    """A map that is an element of an array."""
    return node[3] and node[2] == "mapValue"


def element_maps(documents: DataFrame) -> DataFrame:
    """The maps in the documents' arrays: (document_path, pre, post, parent_pre, pointer, parent_pointer).

    The node table of that type; the parent is the nearest enclosing map of the same table, found by interval
    containment on the labels, or the document itself (``parent_pre`` -1, empty pointer).
    """
    return node_table(documents, is_element_map).select("document_path", "pre", "post", "parent_pre", "pointer", "parent_pointer")


FLAT_SCHEMA = (
    "document_path string, table_name string, kind string, pre long, post long, parent_pre long, pointer string, fields map<string,string>, types map<string,string>"
)
_FLAT_TYPES = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.map_(pa.string(), pa.string())]


def flatten(data: str | None) -> list[tuple]:
    """The rows of one document as (table, kind, pre, post, parent_pre, pointer, fields, types).

    The document is a row of the table "" and every map or plain value in an array a row of the table named by its way
    there, indexes left out (``items[].options[]``).  Plain values under maps become fields of the row around them, named
    by their way from it (``address.city``); a plain value in an array is the field ``value`` of its own row, of kind ``value`` (else ``map`` or ``document``).  Empty maps
    give rows without fields.
    """
    nodes, sizes = walk(parse(data))
    tables, names, rows, at = [""] * len(nodes), [""] * len(nodes), [], [0] * len(nodes)
    for i, (parent, depth, tag, in_array, pointer, name, payload) in enumerate(nodes):
        plain = tag not in ("mapValue", "arrayValue", "document")
        if parent >= 0:
            tables[i] = f"{tables[parent]}[]" if in_array else f"{tables[parent]}.{name}" if tables[parent] else name
        if parent < 0 or in_array and tag != "arrayValue":
            at[i] = len(rows)
            kind = "value" if plain else "map" if parent >= 0 else "document"
            rows.append((tables[i], kind, i, i + sizes[i] - 1 - depth, pointer, {}, {}))
            if plain:
                rows[-1][5]["value"], rows[-1][6]["value"] = _text(payload), tag
            continue
        at[i] = at[parent]
        names[i] = f"{names[parent]}.{name}" if names[parent] else name
        if plain:
            row = rows[at[i]]
            row[5][names[i]], row[6][names[i]] = _text(payload), tag
    ups = nearest_enclosing([(r[2], r[3]) for r in rows])
    return [(*r[:4], rows[up][2] if up >= 0 else -1, *r[4:]) for r, up in zip(rows, ups)]


def flat_rows(documents: DataFrame) -> DataFrame:
    """Rows of all flat tables of the documents (``document_path``, ``data``): see ``flatten``; pass current rows.

    Parents are found by interval containment; ``parent_pre`` with ``document_path`` is the key of the parent row.  Unreadable
    data gives the document's row without fields.
    """

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    for row in flatten(data):
                        yield path, *row[:6], list(row[6].items()), list(row[7].items())

        return _batched(rows(), [f.split()[0] for f in FLAT_SCHEMA.split(", ")], _FLAT_TYPES)

    return documents.select("document_path", "data").mapInArrow(label, FLAT_SCHEMA)


def flat_table(rows: DataFrame, name: str, columns: dict[str, str], kind: str = "map") -> DataFrame:
    """One flat table as columns: document_path, pre, parent_pre, pointer and ``columns`` (column -> field); null where a row lacks one."""
    of_table = rows.where((F.col("table_name") == name) & (F.col("kind") == kind))
    return of_table.select("document_path", "pre", "parent_pre", "pointer", *[F.col("fields")[f].alias(c) for c, f in columns.items()])


def contained(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """(document_path, outer_pre, inner_pre) of every node of ``inner`` inside a node of ``outer`` of the same document.

    A structural join: the nodes of both tables, brought together by document and sorted in pre-order, pass one stack
    of open intervals, so that only pairs that are results are ever made; there is one for each ancestor and descendant,
    and a document's depth bounds the ancestors of a node.  Repeated rows of a node count once.  Rows with a null path or
    label stand in no document and are left out.
    """
    mark = lambda df, side: df.select("document_path", F.col("pre").cast("long").alias("pre"), F.col("post").cast("long").alias("post"), F.lit(side).alias("side"))
    both = mark(outer, 0).unionByName(mark(inner, 1)).where("document_path IS NOT NULL AND pre IS NOT NULL AND post IS NOT NULL")
    sides = both.groupBy("document_path", "pre", "post").agg(F.min("side").alias("low"), F.max("side").alias("high"))
    ordered = sides.repartition("document_path").sortWithinPartitions("document_path", "pre")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            here, open_ = None, []
            for b in batches:
                for path, pre, post, low, high in zip(*[b.column(k).to_pylist() for k in range(5)]):
                    if path != here:
                        here, open_ = path, []
                    while open_ and open_[-1][1] < post:
                        open_.pop()
                    if high == 1:
                        yield from [(path, up, pre) for up, _ in open_]
                    if low == 0:
                        open_.append((pre, post))

        return _batched(rows(), ["document_path", "outer_pre", "inner_pre"], [pa.string(), pa.int64(), pa.int64()])

    return ordered.mapInArrow(join, "document_path string, outer_pre long, inner_pre long")
