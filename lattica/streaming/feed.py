"""The change feed as a Structured Streaming source, its consumers, and hooks by path pattern.

Offsets are sequence numbers; each published change file is one partition, so a batch reads only the files it spans
and a restart from the checkpoint continues after the last finished batch (at least once; exactly once with an
idempotent sink).
"""

from __future__ import annotations

import json
import logging
import re
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from lattica.functions.paths import Pattern
from lattica.operators.writes import Document
from lattica.sources.shared import Conflict, Versions
from lattica.sources.store import CHANGES, DocumentStore, PrunedError

log = logging.getLogger(__name__)
FORMAT = "lattica_changes"


def _filesystem(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def latest_manifest(path: str) -> dict:
    """The newest manifest, read without a Spark session (the source runs outside the driver's)."""
    from pyarrow import fs

    files, root = _filesystem(path)
    found = files.get_file_info(fs.FileSelector(f"{root}/_versions", allow_not_found=True))
    names = sorted(f.path for f in found if f.path.endswith(".json") and not f.base_name.startswith("."))
    if not names:
        return {"changes": [], "seq": 0}
    with files.open_input_stream(names[-1]) as f:
        return json.loads(f.read())


@dataclass
class Span(InputPartition):
    path: str
    after: int
    upto: int


class ChangeReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.start = options["path"], options.get("startingseq", "0")

    def initialOffset(self) -> dict:
        return {"seq": latest_manifest(self.path)["seq"] if self.start == "latest" else int(self.start)}

    def latestOffset(self) -> dict:
        return {"seq": latest_manifest(self.path)["seq"]}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        m = latest_manifest(self.path)
        if start["seq"] < m.get("first_seq", 1) - 1:
            raise PrunedError(f"changes after {start['seq']} are no longer held; the first is {m['first_seq']}")
        spans = [c for c in m["changes"] if c["to"] > start["seq"] and c["from"] <= end["seq"]]
        return [Span(c["path"], start["seq"], end["seq"]) for c in spans]

    def read(self, partition: Span) -> Iterator:
        import pyarrow.dataset as ds

        files, root = _filesystem(partition.path)
        field = ds.field("seq")
        table = ds.dataset(root, filesystem=files, format="parquet", exclude_invalid_files=False)
        names = [c.split()[0] for c in CHANGES.split(", ")]
        yield from table.to_batches(columns=names, filter=(field > partition.after) & (field <= partition.upto))


class ChangeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return CHANGES

    def streamReader(self, schema) -> ChangeReader:
        return ChangeReader(self.options)


def change_stream(store: DocumentStore, start: int | str = "latest") -> DataFrame:
    """An unbounded DataFrame of changes after ``start`` (a sequence number, or ``latest``)."""
    store.spark.dataSource.register(ChangeSource)
    return store.spark.readStream.format(FORMAT).option("path", store.path).option("startingSeq", str(start)).load()


#: Seconds before a batch that failed is given again: the first pause, doubled each time up to the last.
BACKOFF = (1.0, 30.0)


def _retry(handle: Callable[[], None], attempts: int | None, backoff: tuple[float, float], name: str) -> None:
    """Call until it succeeds, or raise what the last of ``attempts`` raised; None: for ever."""
    n = 0
    while True:
        try:
            return handle()
        except Exception as e:
            n += 1
            if attempts is not None and n >= attempts:
                raise
            pause = min(backoff[1], backoff[0] * 2 ** min(n - 1, 30))
            log.warning("%s: attempt %d failed (%s), again in %.1f s", name, n, e, pause)
            time.sleep(pause)


def follow(store: DocumentStore, handle: Callable[[DataFrame, DataFrame], None], checkpoint: str, start: int | str = "latest", once: bool = False, every: str = "2 seconds",
           durable: bool = True, attempts: int | None = 1, backoff: tuple[float, float] = BACKOFF) -> StreamingQuery:
    """Give each batch of changes to ``handle(changes, documents)``.

    documents: the current rows of the documents the batch names and did not remove, joined once for all consumers of
    the batch.  A consumer that starts for the first time sees changes from then on.
    A durable consumer's batch that fails is given again in place, with growing pauses, up to ``attempts`` times (None: for
    ever); then the query ends, and starts with the same batch when it is started again.  One that is not durable has
    its failure logged and goes on with the next batch.
    """

    def batch(changes: DataFrame, _: int) -> None:
        changes = changes.persist()
        try:
            if changes.isEmpty():
                return
            try:
                _retry(lambda: handle(changes, store.touched(changes)), attempts if durable else 1, backoff, "consumer")
            except Exception as e:
                if durable:
                    raise
                log.warning("consumer skips a batch: %s", e)
        finally:
            changes.unpersist()

    writer = change_stream(store, start).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


class Cursor:
    """A consumer's place in a store's feed, kept under its name beside the store; it never goes back."""

    def __init__(self, store: DocumentStore, name: str):
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", name):
            raise ValueError(f"no consumer name: {name!r}")
        self.store, self.name = store, name
        self._saves = Versions(store.spark, f"{store.path}/cursors/{name}")

    def get(self) -> int | None:
        return self._saves.latest()[1].get("seq")

    def save(self, seq: int) -> int:
        """Save a place unless a later one is saved already; returns the place that holds."""
        while True:
            number, held = self._saves.latest()
            if held.get("seq") is not None and held["seq"] >= seq:
                return held["seq"]
            try:
                self._saves.publish(number, {"seq": seq})
            except Conflict:
                continue
            self._saves.prune()
            return seq


def catch_up(store: DocumentStore, name: str, handle: Callable[[DataFrame, DataFrame], None], batch: int = 100_000, attempts: int | None = None,
    backoff: tuple[float, float] = BACKOFF) -> int:
    """Give a named consumer everything since its cursor, in batches of at most ``batch`` sequence numbers; returns its place.

    The cursor is saved after each batch, so each batch comes at least once, over any number of processes; a batch that
    fails is given again, with growing pauses.  A consumer that starts for the first time begins at the end of the feed.
    """
    cursor = Cursor(store, name)
    m = store.state()[1]
    at = cursor.get()
    if at is None:
        return cursor.save(m["seq"])
    while at < m["seq"]:
        upto = min(m["seq"], at + batch)
        changes = store.changes(at, m).where(F.col("seq") <= upto)
        _retry(lambda changes=changes: handle(changes, store.touched(changes, m)), attempts, backoff, name)
        at = cursor.save(upto)
        m = store.state()[1]
    return at


class Hook:
    """Callbacks on documents; they must bear being called twice for a change."""

    def on_set(self, path: str, document: Document, captures: dict[str, str]) -> None: ...

    def on_update(self, path: str, document: Document, captures: dict[str, str]) -> None: ...

    def on_delete(self, path: str, captures: dict[str, str]) -> None: ...


class Hooks:
    """Hooks by path pattern, called in feed order on the driver; a batch has as many calls as it has matching changes.

    Only changes that some pattern may match reach the driver.
    """

    def __init__(self) -> None:
        self.bound: list[tuple[Pattern, Hook]] = []

    def add(self, pattern: str, hook: Hook) -> Hooks:
        self.bound.append((Pattern(pattern), hook))
        return self

    def _matching(self, changes: DataFrame, documents: DataFrame) -> DataFrame:
        joined = changes.alias("c").join(documents.alias("d"), "document_path", "left")
        rows = joined.select("c.seq", "c.type", "document_path", "d.data", "d.created_at", "d.updated_at", F.col("d.version").alias("version"))
        return rows.where(F.col("document_path").rlike("|".join(p.regex() for p, _ in self.bound) or "$^"))

    def __call__(self, changes: DataFrame, documents: DataFrame) -> None:
        _call(self.bound, self._matching(changes, documents).orderBy("seq").toLocalIterator())


class PartitionedHooks(Hooks):
    """Hooks called on the executors: the changes of one document in feed order, different documents side by side.

    The hooks are sent to the executors, so they must be picklable, and what they change there stays there.
    """

    def __call__(self, changes: DataFrame, documents: DataFrame) -> None:
        bound = self.bound
        by_document = self._matching(changes, documents).repartition("document_path").sortWithinPartitions("document_path", "seq")
        by_document.foreachPartition(lambda rows: _call(bound, rows))


def _call(bound: list[tuple[Pattern, Hook]], rows: Iterable) -> None:
    for r in rows:
        for pattern, hook in bound:
            captures = pattern.match(r["document_path"])
            if captures is None:
                continue
            if r["type"] == "removed":
                hook.on_delete(r["document_path"], captures)
            elif r["data"] is not None:  # removed again since: the removal will follow
                (hook.on_set if r["type"] == "added" else hook.on_update)(r["document_path"], DocumentStore.document(r), captures)
