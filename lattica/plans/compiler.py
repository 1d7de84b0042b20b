"""Plans as DataFrames: scan, filter, cursor range, order, page, projection.

The result is an unresolved Catalyst plan; filters on typed columns reach the Parquet reader, unused columns are never
read, and order with limit becomes one top-k operator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.operators.numbering import numbered_rows
from lattica.operators.predicates import compile_filter
from lattica.plans.ast import Query, QueryError
from lattica.plans.normalizer import Bound, Plan, normalize


def bound_filter(source, plan: Plan, bound: Bound, lower: bool) -> Column:
    """Rows on the inner side of a bound: strictly beyond it in the first key, or equal there and beyond in the next ..."""
    cond = F.lit(bound.inclusive)
    for o, v in reversed(list(zip(plan.order, bound.values))):
        field, after = source.field(o.field), lower != o.descending
        cond = field.let(lambda f, v=v, after=after: f.beyond(after, v), v) | (field.let(lambda f, v=v: f.equals(v), v) & cond)
    return cond


def matching(source, q: Query | Plan) -> DataFrame:
    """All rows the query matches, before order, page and projection."""
    plan = q if isinstance(q, Plan) else normalize(q)
    df = source.scan(plan.collection)
    if plan.filter is not None:
        df = df.where(compile_filter(source, plan.filter))
    if plan.lower is not None:
        df = df.where(bound_filter(source, plan, plan.lower, True))
    if plan.upper is not None:
        df = df.where(bound_filter(source, plan, plan.upper, False))
    return df


def sort_columns(source, plan: Plan) -> list[tuple[Column, bool]]:
    """Sort keys and whether each descends."""
    return [(c, o.descending) for o in plan.order for c in source.field(o.field).order()]


def directed(keys: list[tuple[Column, bool]]) -> list[Column]:
    """The keys with their directions; nulls (absent parts of a key) come first ascending and last descending."""
    return [c.desc_nulls_last() if down else c.asc_nulls_first() for c, down in keys]


def sorted_by(df: DataFrame, keys: list[tuple[Column, bool]]) -> DataFrame:
    return df.orderBy(*directed(keys))


def keyed(source, plan: Plan) -> tuple[DataFrame, list[tuple[Column, bool]], list[str]]:
    """All rows the plan matches with its sort keys as columns, these keys, and the columns' names."""
    df, keys = matching(source, plan), sort_columns(source, plan)
    names = [f"__sort{i}" for i in range(len(keys))]
    return df.withColumns({n: c for n, (c, _) in zip(names, keys)}), [(F.col(n), down) for n, (_, down) in zip(names, keys)], names


def page(source, q: Query | Plan, extra: int = 0) -> DataFrame:
    """The rows of the query's page in the order asked for, with ``extra`` rows beyond it (to tell whether there are more).

    Sort keys are columns of a projection below the top-k operator: a stored document's JSON is then parsed once for all
    parts of its keys, and the keys are there again to turn a last page round.
    """
    plan = q if isinstance(q, Plan) else normalize(q)
    df, ready, names = keyed(source, plan)
    df = sorted_by(df, ready)
    if plan.offset:
        df = df.offset(plan.offset)
    df = df.limit(plan.limit + extra)
    if plan.reverse:
        df = sorted_by(df, [(c, not down) for c, down in ready])
    df = df.drop(*names)
    return source.project(df, plan.select)


def placed(source, q: Query | Plan, *columns: str) -> DataFrame:
    """All rows the query matches with their ``place`` in its order, from 0, before page and projection; of ``columns`` only, if named.

    One sort on the cluster, whatever the size of a page: pages asked for one by one would each look at the whole collection.
    """
    plan = q if isinstance(q, Plan) else normalize(q)
    if plan.offset or plan.reverse:
        raise QueryError("PLACED_PAGE", "places take no offset and no limitToLast")
    df, ready, names = keyed(source, plan)
    return numbered_rows(df.select(*columns, *names) if columns else df, directed(ready), "place")[0].drop(*names)
