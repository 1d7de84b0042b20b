"""Differences between two ordered results."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.operators.numbering import numbered_rows
from lattica.operators.writes import Document


@dataclass(frozen=True)
class Difference:
    type: str
    document: Document
    old_index: int
    new_index: int


def page_difference(old: Sequence[Document], new: Sequence[Document]) -> list[Difference]:
    """Removed, then added, then modified documents of two pages, with their places before and after (-1: none).

    A document is modified if it was written since; a mere move is no change.
    """
    before, after = {d.path: i for i, d in enumerate(old)}, {d.path: i for i, d in enumerate(new)}
    out = [Difference("removed", d, i, -1) for i, d in enumerate(old) if d.path not in after]
    out += [Difference("added", d, -1, i) for i, d in enumerate(new) if d.path not in before]
    out += [Difference("modified", d, before[d.path], i) for i, d in enumerate(new) if d.path in before and old[before[d.path]].updated != d.updated]
    return out


def frame_difference(old: DataFrame, new: DataFrame, key: str, stamp: str, order: Sequence[str | Column] | None = None) -> DataFrame:
    """(key, type) of rows removed, added or modified (``stamp`` differs) between two tables of unique keys: one full outer join.

    With ``order`` also ``old_index`` and ``new_index``, the places from 0 in that order before and after, -1 for none.
    """
    more = [[], []]
    if order is not None:
        old, new = (numbered_rows(df, list(order), name)[0] for df, name in ((old, "__at_old"), (new, "__at_new")))
        more = [["__at_old"], ["__at_new"]]
    o = old.select(F.col(key), F.col(stamp).alias("__old"), F.lit(True).alias("__in_old"), *more[0])
    n = new.select(F.col(key), F.col(stamp).alias("__new"), F.lit(True).alias("__in_new"), *more[1])
    kind = F.when(F.col("__in_new").isNull(), "removed").when(F.col("__in_old").isNull(), "added").when(~F.col("__old").eqNullSafe(F.col("__new")), "modified")
    places = [F.coalesce(f"__at_{side}", F.lit(-1)).cast("long").alias(f"{side}_index") for side in ("old", "new")] if order is not None else []
    return o.join(n, key, "full_outer").select(key, kind.alias("type"), *places).where(F.col("type").isNotNull())
