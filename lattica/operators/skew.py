"""Aggregation and joins that stay balanced when a few keys hold most rows (problem 1).

``salted_aggregate`` works in two stages: rows of heavy keys get a salt, partial results are made per (key, salt),
and the partials are merged per key.  The salt is a hash of the row's place or of a counted column rather than
``rand()``: a task that runs again after an executor is lost then gives every row the same salt, and because with distinct
counts the salt depends on the first counted column alone, those of the salts can be added.  The rows of one value of
that column share a salt, but not a task: the first grouping spreads them by the other counted columns, and after it
each task holds one row of it.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.sources.shared import stage

#: A key is heavy when it holds at least this share of all rows, so there are at most 1 / SHARE heavy keys.
SHARE = 1 / 256
#: Salts for a key that held all rows; a heavy key gets its share of them.
SALTS = 512

_KEY, _SALT, _N, _PLACE = "__key{}", "__salt", "__n", "__place"


def heavy_keys(df: DataFrame, keys: Sequence[Column], share: float = SHARE) -> list[tuple]:
    """``(key values..., rows, all rows)`` of each key that holds at least ``share`` of the rows.

    At most ``1 / share`` rows reach the driver whatever the size of ``df``; counting combines on the map side, and the
    count of all rows needs no column of a stored table, only its files' footers.
    """
    named = df.select(*[k.alias(_KEY.format(i)) for i, k in enumerate(keys)])
    total = named.count()
    if not total:
        return []
    counted = named.groupBy(*named.columns).agg(F.count(F.lit(1)).alias(_N))
    return [(*row, total) for row in counted.where(F.col(_N) >= F.lit(share * total)).collect()]


def with_place(df: DataFrame, name: str = _PLACE) -> DataFrame:
    """A number of its own for each row, equal rows included, that stays when a task is run again.

    Rows that come straight from files have their places there; what has been shuffled is written first, as a task that
    is run again may meet shuffled rows in another order.
    """
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        df = stage(df, "placed")
    return df.withColumn(name, F.monotonically_increasing_id())


def with_salt(df: DataFrame, keys: Sequence[str], heavy: list[tuple], by: Sequence[str], salts: int = SALTS) -> DataFrame:
    """Add the column ``__salt``: below the key's number of salts for heavy keys, 0 for all others."""
    if not heavy:
        return df.withColumn(_SALT, F.lit(0))
    factors = salt_factors(df, keys, heavy, salts)
    on = [F.col(f"f.{_KEY.format(i)}").eqNullSafe(F.col(f"d.{k}")) for i, k in enumerate(keys)]
    spread = F.pmod(F.xxhash64(*[F.col(f"d.{c}") for c in by]), F.coalesce(F.col("f.__salts"), F.lit(1)))
    return df.alias("d").join(F.broadcast(factors.alias("f")), on, "left").select("d.*", spread.cast("int").alias(_SALT))


def salt_factors(df: DataFrame, keys: Sequence[str], heavy: list[tuple], salts: int) -> DataFrame:
    """The heavy keys with their number of salts; at most ``1 / share`` rows, so safe to broadcast."""
    fields = ", ".join(f"`{_KEY.format(i)}` {df.schema[k].dataType.simpleString()}" for i, k in enumerate(keys))
    rows = [(*h[:-2], max(2, math.ceil(h[-2] / h[-1] * salts))) for h in heavy]
    return df.sparkSession.createDataFrame(rows, f"{fields}, __salts int")


def salted_aggregate(
    df: DataFrame,
    key: str,
    measures: Mapping[str, tuple[str, str | None]],
    distinct: Mapping[str, Sequence[str]] | None = None,
    share: float = SHARE,
    salts: int = SALTS,
) -> DataFrame:
    """One row per value of ``key``: ``key`` and a column for each measure and each distinct count.

    measures: name -> (kind, column) with kind ``count`` (all rows, column None), ``sum``, ``min`` or ``max``.
    distinct: name -> columns; each list must extend the one before it, as in
        ``{"documents": ["document_path"], "versions": ["document_path", "version"]}``.

    Null keys form one group.  Nulls in measured columns are ignored, as in SQL; a distinct count takes the rows in
    which all of its columns are non-null.  Repeated rows count as stored.  An empty table gives no rows.  Other
    columns of ``df`` are never read, whatever their names.
    """
    chain = [(name, list(cols)) for name, cols in (distinct or {}).items()]
    for (_, a), (_, b) in zip(chain, chain[1:]):
        if b[: len(a)] != a:
            raise ValueError(f"{b} must extend {a}")
    finest = chain[-1][1] if chain else []
    inputs = {f"__m{i}": c for i, (_, c) in enumerate(measures.values())}
    flat = df.select(
        F.col(f"`{key}`").alias("__k"),
        *[(F.lit(1) if c is None else F.col(f"`{c}`")).alias(n) for n, c in inputs.items()],
        *[F.col(f"`{c}`").alias(f"__d{i}") for i, c in enumerate(finest)],
    )
    heavy = heavy_keys(df, [F.col(f"`{key}`")], share)
    spread_by = ["__d0"] if finest else [c for c in flat.columns if c != "__k"]
    # without distinct counts any spread will do: the row's place decides, not its contents, which may all be equal
    if heavy and not finest:
        flat, spread_by = with_place(flat), [_PLACE]
    salted = with_salt(flat, ["__k"], heavy, spread_by, salts)

    first = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}
    again = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
    kinds = {n: kind for n, (kind, _) in zip(inputs, measures.values())}
    merged = lambda: [again[kinds[n]](n).alias(n) for n in inputs]

    cur = salted.groupBy("__k", _SALT, *[f"__d{i}" for i in range(len(finest))]).agg(
        *[first[kinds[n]](n).alias(n) for n in inputs] or [F.count(F.lit(1)).alias("__rows")]
    )
    counted: list[str] = []
    for level in range(len(chain) - 1, -1, -1):
        width = len(chain[level][1])
        here = F.lit(True)
        for i in range(width):
            here = here & F.col(f"__d{i}").isNotNull()
        coarser = len(chain[level - 1][1]) if level else 0
        cur = cur.groupBy("__k", _SALT, *[f"__d{i}" for i in range(coarser)]).agg(
            *merged(),
            *[F.sum(c).alias(c) for c in counted],
            F.sum(here.cast("long")).alias(f"__c{level}"),
        )
        counted.append(f"__c{level}")
    out = cur.groupBy("__k").agg(*merged(), *[F.sum(c).alias(c) for c in counted] or [])
    return out.select(
        F.col("__k").alias(key),
        *[F.col(n).alias(name) for n, name in zip(inputs, measures)],
        *[F.col(f"__c{i}").alias(name) for i, (name, _) in enumerate(chain)],
    )


def frequent_keys(df: DataFrame, key: str, least: float) -> DataFrame:
    """The non-null keys that hold at least the share ``least`` of all rows of ``df``, null keys counted in the whole."""
    per_key = stage(salted_aggregate(df, key, {"rows": ("count", None)}), "per-key")
    total = per_key.agg(F.sum("rows")).first()[0] or 0
    return per_key.where(F.col(f"`{key}`").isNotNull() & (F.col("rows") >= F.lit(least * total))).select(key)


def skew_join(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], how: str, extra: Column | None = None,
              by: Sequence[str] = (), share: float = SHARE, salts: int = SALTS) -> DataFrame:
    """``left_anti``, ``left_semi``, ``left`` or ``inner`` join in which a heavy key of ``left`` is spread over salts.

    Each left row has one salt, by its place unless ``by`` names columns, so equal rows are spread as well; the right rows of
    a heavy key are repeated for each of its salts, so every pair still meets exactly once.  Keys compare as in SQL: a null matches nothing.  ``extra`` may refer to ``l.`` and ``r.``.
    """
    lk, rk = [a for a, _ in on], [b for _, b in on]
    cond = extra if extra is not None else F.lit(True)
    for a, b in on:
        cond = cond & (F.col(f"l.{a}") == F.col(f"r.{b}"))
    # heavy keys are told by a hash: two keys that share one are salted alike, which is harmless
    hashed = F.xxhash64(*[F.col(k) for k in lk])
    known = left.where(" AND ".join(f"`{k}` IS NOT NULL" for k in lk))
    heavy = heavy_keys(known, [hashed], share)
    if not heavy:
        return left.alias("l").join(right.alias("r"), cond, how)
    spread = with_salt((left if by else with_place(left)).withColumn("__h", hashed), ["__h"], heavy, by or [_PLACE], salts)
    factors = salt_factors(spread, ["__h"], heavy, salts)
    there = F.xxhash64(*[F.col(f"x.{b}").cast(left.schema[a].dataType) for a, b in on])
    copies = right.alias("x").join(F.broadcast(factors.alias("f")), F.col(f"f.{_KEY.format(0)}") == there, "left").select(
        "x.*", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("f.__salts"), F.lit(1)) - 1)).alias(_SALT))
    joined = spread.drop("__h", *([] if by else [_PLACE])).alias("l").join(copies.alias("r"), cond & (F.col(f"l.{_SALT}") == F.col(f"r.{_SALT}")), how)
    return joined.drop(_SALT)
