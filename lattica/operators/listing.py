"""Collection ids below a document, and documents whose time to live has passed."""

from __future__ import annotations

import base64

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions import values as V
from lattica.sources.collections import tagged_at
from lattica.functions.fields import TaggedField


def collection_ids(documents: DataFrame, parent: str | None = None) -> DataFrame:
    """Distinct ids of the collections directly below ``parent`` (None: the top), also where no document stands between.

    The prefix reaches the Parquet reader; distinct combines before the shuffle.
    """
    path = F.col("document_path")
    if parent is None:
        return documents.select(F.split_part(path, F.lit("/"), F.lit(1)).alias("collection_id")).distinct()
    depth = parent.count("/") + 2
    below = documents.where(path.startswith(f"{parent}/"))
    return below.select(F.split_part(path, F.lit("/"), F.lit(depth)).alias("collection_id")).distinct()


def page_token(last: str) -> str:
    return base64.urlsafe_b64encode(last.encode()).decode().rstrip("=")


def read_token(token: str) -> str:
    try:
        return base64.urlsafe_b64decode(token + "=" * (-len(token) % 4)).decode()
    except ValueError as e:
        raise ValueError(f"no page token: {token!r}") from e


def collection_page(documents: DataFrame, parent: str | None = None, size: int = 100, token: str | None = None) -> tuple[list[str], str | None]:
    """One page of collection ids in order, and the token of the next page or None; size is at most 300."""
    size = max(1, min(300, size))
    ids = collection_ids(documents, parent)
    if token:
        ids = ids.where(F.col("collection_id") > read_token(token))
    got = [r[0] for r in ids.orderBy("collection_id").limit(size + 1).collect()]
    return got[:size], page_token(got[size - 1]) if len(got) > size else None


def expired(documents: DataFrame, collection_id: str, field: str, now_us: int) -> DataFrame:
    """Documents of all collections of this id whose ``field`` is a timestamp before now; a missing or other value never expires."""
    now = V.Value("timestamp", now_us)
    passed = TaggedField(tagged_at(F.col("data"), field)).let(lambda f: f.within("lt", now), now)
    of_id = F.split_part(F.col("document_path"), F.lit("/"), F.lit(-2)) == collection_id
    return documents.where(of_id & (F.col("collection_id").isNull() | (F.col("collection_id") == collection_id))).where(passed)


