"""Write semantics as expressions over whole tables, for changes too large for a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions import values as V


def saturating_add(a: Column, b: Column) -> Column:
    """Sum of two longs, held at the ends of the range."""
    return F.coalesce(F.try_add(a, b), F.when(a > 0, F.lit(V.INT_MAX)).otherwise(F.lit(V.INT_MIN)))


def increment(existing: Column, by: Column) -> Column:
    """``existing + by``, the operand where the field is missing."""
    return F.when(existing.isNull(), by).otherwise(saturating_add(existing, by))


def union_elements(existing: Column, added: Column) -> Column:
    """``existing`` with the distinct elements of ``added`` that it lacks at the end; repeats in ``existing`` stay."""
    have = F.coalesce(existing, F.slice(added, 1, 0))
    return F.concat(have, F.array_except(added, have))


def remove_elements(existing: Column, removed: Column) -> Column:
    """``existing`` without any element of ``removed``; an empty array where the field is missing."""
    return F.coalesce(F.filter(existing, lambda x: ~F.coalesce(F.array_contains(removed, x), F.lit(False))), F.slice(removed, 1, 0))


def merge_rows(target: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Merge-set of ``patch`` into ``target`` by key: non-null fields of the patch replace, rows of new keys are added.

    Keys are unique on both sides; one full outer join, co-located if both are bucketed by the key.
    """
    t, p = target.alias("t"), patch.alias("p")
    shared = set(patch.columns)
    joined = t.join(p, F.col(f"t.{key}") == F.col(f"p.{key}"), "full_outer")
    return joined.select(*[(F.coalesce(F.col(f"p.{c}"), F.col(f"t.{c}")) if c in shared else F.col(f"t.{c}")).alias(c) for c in target.columns])
