"""count, sum and average over the rows a query matches, in one pass and with exact sums."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.values import INT_MAX, INT_MIN, NULL, Value, double, integer
from lattica.plans.ast import Aggregation, Query
from lattica.plans.compiler import matching, sort_columns, sorted_by
from lattica.plans.normalizer import check_aggregations, normalize

#: Doubles up to this size whose decimal text has at most 15 places after the point are added as decimals, and those up to
#: the other with at most two places as whole hundredths.
_EXACT, _HUNDREDTHS = 1e15, 1e13


def capped(source, q: Query, ordered: bool = True) -> DataFrame:
    """Matching rows, no more than an explicit limit; offset and limitToLast play no part.  The cap takes the first in order, or any."""
    plan = normalize(q)
    df = matching(source, plan)
    if plan.explicit_limit is not None and not ordered:
        return df.limit(plan.explicit_limit)
    return df if plan.explicit_limit is None else sorted_by(df, sort_columns(source, plan)).limit(plan.explicit_limit)


def count_frame(source, q: Query, alias: str = "count") -> DataFrame:
    return capped(source, q, ordered=False).agg(F.count(F.lit(1)).alias(alias))


def _sums(source, a: Aggregation) -> list[tuple[str, Column]]:
    """Columns from which a sum or an average is put together: integers, doubles as hundredths or as decimals, other doubles, NaN and infinities.

    Both decimal forms are exact: a double equal to its hundredths over 100 has no shorter decimal text, and they have no
    more than 15 digits.  Most stored amounts are of that form, which is found and added without making any text.
    """
    f = source.field(a.field)
    i, d, special = f.integer(), f.double(), f.special()
    hundredths = F.rint(d * 100)
    whole = F.coalesce((F.abs(d) < _HUNDREDTHS) & (hundredths / 100 == d), F.lit(False))
    as_decimal = F.when(~whole, d).cast("string").try_cast("decimal(38,15)")
    fits = whole | F.coalesce((F.abs(d) < _EXACT) & (as_decimal.cast("double") == d), F.lit(False))
    return [
        ("ints", F.sum(i.cast("decimal(20,0)"))),
        ("hundredths", F.sum(F.when(whole, hundredths.cast("long").cast("decimal(18,0)")))),
        ("exact", F.try_sum(F.when(fits & ~whole, as_decimal))),
        ("n_exact", F.count(F.when(fits & ~whole, 1))),
        ("rest", F.sum(F.when(special.isNull() & ~fits, d))),
        ("special", F.sum(special)),
        ("plain", F.sum(F.when(special.isNull(), d))),
        ("n_ints", F.count(i)),
        ("n_doubles", F.count(F.coalesce(d, special))),
    ]


def aggregate_frame(source, q: Query, aggs: tuple[Aggregation, ...]) -> DataFrame:
    """One row with the raw columns of all aggregations, named ``<place>_<part>``."""
    check_aggregations(aggs)
    out = []
    for n, a in enumerate(aggs):
        out += [F.count(F.lit(1)).alias(f"{n}_count")] if a.kind == "count" else [c.alias(f"{n}_{name}") for name, c in _sums(source, a)]
    return capped(source, q, ordered=any(a.kind != "count" for a in aggs)).agg(*out)


def finish(aggs: tuple[Aggregation, ...], row: dict) -> dict[str, Value]:
    """Typed results: integers stay integers while they fit, any double makes a sum a double, nothing to average is null."""
    out = {}
    for n, a in enumerate(aggs):
        get = lambda part, n=n: row[f"{n}_{part}"]
        if a.kind == "count":
            out[a.alias] = integer(get("count"))
            continue
        ints = int(get("ints") or 0)
        if get("special") is not None:
            total: Decimal | float = get("special")
        elif get("n_exact") and get("exact") is None:  # beyond 38 digits
            total = float(ints) + (get("plain") or 0.0)
        else:
            total = Decimal(ints) + (get("exact") or Decimal(0)) + (get("hundredths") or Decimal(0)) / 100
            total = total if get("rest") is None else float(total) + get("rest")
        many = get("n_ints") + get("n_doubles")
        if a.kind == "sum":
            whole = not get("n_doubles") and INT_MIN <= ints <= INT_MAX
            out[a.alias] = integer(ints) if whole else double(float(total))
        else:
            out[a.alias] = NULL if not many else double(float(total / many) if isinstance(total, Decimal) else total / many)
    return out


def typed_frame(source, q: Query, aggs: tuple[Aggregation, ...]) -> DataFrame:
    """One row with one column per alias: counts as long, sums as double or long by type, averages as double."""
    raw = aggregate_frame(source, q, aggs)
    cols = []
    for n, a in enumerate(aggs):
        c = lambda part, n=n: F.col(f"{n}_{part}")
        if a.kind == "count":
            cols.append(c("count").alias(a.alias))
            continue
        hundredths = (F.coalesce(c("hundredths"), F.lit(Decimal(0))) * F.lit(Decimal("0.01"))).cast("decimal(38,15)")
        exact = F.coalesce(c("ints").cast("decimal(38,15)"), F.lit(0)) + hundredths + F.coalesce(c("exact"), F.lit(0))
        total = F.coalesce(c("special"), F.when((c("n_exact") > 0) & c("exact").isNull(),
            F.coalesce(c("ints").cast("double"), F.lit(0.0)) + c("plain")), exact.cast("double") + F.coalesce(c("rest"), F.lit(0.0)))
        many = c("n_ints") + c("n_doubles")
        cols.append(total.alias(a.alias) if a.kind == "sum" else F.when(many > 0, total / many).alias(a.alias))
    return raw.select(*cols)

