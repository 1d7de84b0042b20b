"""Rows by a list of keys, in the order of the list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys up to which the list itself goes into the scan's filter; a longer one is a table to join with.
IN_FILTER = 10_000


def rows_for(source, keys: Sequence[str], column: str = "document_path") -> DataFrame:
    """One row for each key with its ``pos`` from 0: the row with it (unique by ``column``), or nulls if there is none.

    source: a table, or a typed collection, whose own key column then takes the filter.  The keys are the caller's own
    list.  Up to IN_FILTER of them the table is first cut down by an ``IN`` filter that reaches the scan, so the join that
    follows has no more rows than the list on either side (how large they are decides how they are joined); beyond, it is an
    ordinary join.
    """
    df = source if isinstance(source, DataFrame) else source.df
    asked = df.sparkSession.createDataFrame(list(enumerate(keys)), f"pos int, `{column}` string")
    if len(keys) > IN_FILTER:
        return asked.join(df, column, "left").orderBy("pos")
    found = df.where(F.col(column).isin(sorted(set(keys)))) if isinstance(source, DataFrame) else source.rows(keys)
    return asked.join(found, column, "left").orderBy("pos")
