"""References to records that do not exist (problem 4).

Keys may have several columns and some of them may be null.  References are grouped by their null mask; each mask is
anti-joined on its non-null columns, under a declared match rule.  A target that a third of all references name is
salted like any heavy key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.operators.nested import parse, walk
from lattica.operators.skew import skew_join
from lattica.sources.shared import stage

#: Null masks that may occur: all those of six key columns.
MASKS = 64
RULES = ("simple", "partial", "full", "exact")


def orphans(references: DataFrame, targets: DataFrame, on: Sequence[tuple[str, str]], match: str = "simple", condition: Column | None = None) -> DataFrame:
    """The rows of ``references`` for which ``targets`` holds no record.

    on: pairs of (reference column, target column).  condition: a further condition on ``l.`` (reference) and ``r.``
    (target), such as a target that must exist in time.  match says what a null in a reference means:

    * ``simple``: a reference with any null refers to nothing and is no orphan;
    * ``partial``: its non-null columns must equal those of some target; all null is no orphan;
    * ``full``: all null is no orphan, nulls in some columns only are always orphans;
    * ``exact``: a null equals a null, so the target must have nulls in the same columns; all null is looked up too.

    Repeated references come out as often as they stand.  Without references the result is empty; without targets all
    references that need one are orphans.  Each mask that occurs costs an
    anti-join; more than MASKS of them are refused.
    """
    if match not in RULES:
        raise ValueError(f"match must be one of {RULES}")
    if not on:
        raise ValueError("at least one key column")
    # which masks there are; each is an anti-join, so a table with more than MASKS of them is refused
    masks = references.select(*[F.col(a).isNull().alias(f"n{i}") for i, (a, _) in enumerate(on)]).distinct().limit(MASKS + 1).collect()
    if len(masks) > MASKS:
        raise ValueError(f"more than {MASKS} null masks")
    parts = []
    for mask in sorted(tuple(m) for m in masks):
        of_mask = references
        for (a, _), null in zip(on, mask):
            of_mask = of_mask.where(F.col(a).isNull() if null else F.col(a).isNotNull())
        keys = [pair for pair, null in zip(on, mask) if not null]
        if any(mask):
            if match == "simple" or (match in ("partial", "full") and not keys):
                continue
            if match == "full":
                parts.append(of_mask)
                continue
        found = targets
        if match == "exact":
            for (_, b), null in zip(on, mask):
                found = found.where(F.col(b).isNull() if null else F.col(b).isNotNull())
        if keys:
            parts.append(skew_join(of_mask, found, keys, "left_anti", condition))
        else:  # all null under "exact": nothing to join on, any fitting target will do
            one = F.lit(1).alias("__one")
            parts.append(skew_join(of_mask.select("*", one), found.select("*", one), [("__one", "__one")], "left_anti", condition).drop("__one"))
    out = parts[0] if parts else references.limit(0)
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def document_references(rows: DataFrame) -> DataFrame:
    """The references of stored documents: reference values at any depth, and the owner of a document's collection.

    rows: document_path, data, and any others.  Returns those but data, with ``targets``: the paths a document names, each
    once.
    """
    kept = [c for c in rows.columns if c != "data"]
    schema = T.StructType([*[rows.schema[c] for c in kept], T.StructField("targets", T.ArrayType(T.StringType()))])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            targets = []
            for path, data in zip(b.column(0).to_pylist(), b.column(b.num_columns - 1).to_pylist()):
                named = set()
                if data is not None and ("referenceValue" in data or "\\u" in data):
                    named = {n[6] for n in walk(parse(data))[0] if n[2] == "referenceValue" and isinstance(n[6], str)}
                segments = path.split("/")
                if len(segments) > 2:
                    named.add("/".join(segments[:-2]))
                targets.append(sorted(named))
            at = [b.schema.get_field_index(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in at], pa.array(targets, pa.list_(pa.string()))], [*kept, "targets"])

    return rows.select("document_path", *[c for c in kept if c != "document_path"], "data").mapInArrow(extract, schema)


def document_orphans(documents: DataFrame) -> DataFrame:
    """References of current rows to documents that are absent or were created after the referring row was written.

    documents: the stored rows, repeats and earlier versions included.  References are taken out of every stored row where
    it lies, so only they are shuffled to find the current rows, not the documents; these stand both for the references and
    for their targets.  Current is the highest version; of rows equal in it one with a ``collection_id`` counts, then the
    later ``updated_at``, then the greater list of references, then the later ``created_at``.  A null ``created_at`` or
    ``updated_at`` leaves the order in time unproven, and the reference is an orphan.  Strings compare as they are; the
    composite key is (collection path, document id) under the ``exact`` rule, so a target without a slash meets only such a
    path.
    """
    ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    stored = documents.where(F.col("document_path").isNotNull()).select("document_path", "version", "collection_id", ntz("created_at"), ntz("updated_at"), "data")
    top = F.max(F.struct("version", F.col("collection_id").isNotNull(), "updated_at", "targets", "created_at", "collection_id")).alias("r")
    current = document_references(stored).groupBy("document_path").agg(top)
    held = stage(current.select("document_path", "r.collection_id", "r.created_at", "r.updated_at", "r.targets"), "references")
    last = lambda c: F.substring_index(c, "/", -1)
    owner = lambda c: F.when(F.length(c) > F.length(last(c)), F.substring(F.col(c), F.lit(1), F.length(c) - F.length(last(c)) - 1))
    refs = held.select("document_path", "collection_id", "updated_at", F.explode("targets").alias("target_path"))
    refs = refs.select("*", owner("target_path").alias("target_collection"), last("target_path").alias("target_id"))
    targets = held.select(owner("document_path").alias("collection"), last("document_path").alias("id"), "created_at")
    in_time = F.col("r.created_at") <= F.col("l.updated_at")
    return orphans(refs, targets, [("target_collection", "collection"), ("target_id", "id")], "exact", in_time)


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphans per collection id and month of ``updated_at``; unknown ones under null."""
    return found.groupBy("collection_id", F.date_format("updated_at", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("orphans"))
