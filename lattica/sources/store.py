"""The document store: an append-only log of row versions and changes in Parquet, committed by numbered manifests.

A commit writes its rows first and then one manifest that names all files of the store's state; creating the manifest
is exclusive, so of two writers over the same state one wins and the other sees a conflict.  Sequence numbers of the
change feed are given out by the manifest, so feed order is commit order.  Readers take the files of one manifest and
the last version of each path among them, whatever is written or compacted meanwhile.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Iterator
from datetime import datetime, timedelta
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import values as V
from lattica.functions.paths import is_document, split_document
from lattica.functions.values import Value
from lattica.operators.listing import expired
from lattica.operators.nested import parse
from lattica.operators.numbering import numbered_rows
from lattica.operators.writes import MAX_BYTES, MAX_DEPTH, Delete, Document, Outcome, Set, Update, WriteError, apply, check, parse_write
from lattica.sources.collections import DOCUMENT_COLUMNS, TaggedCollections
from lattica.sources.shared import Conflict, Versions, listing, remove, stage

ROWS = ("document_path string, document_id string, collection_path string, collection_id string, data string, created_at timestamp_ntz, updated_at timestamp_ntz,"
        " version long, commit_seq long, deleted boolean")
CHANGES = "seq long, type string, document_path string, collection_path string, version long, commit_time timestamp_ntz"
#: Documents that a cascade in a batch removes at most; ``remove_below`` has no such limit.
MAX_CASCADE = 100_000
#: Commits after which the row files are rewritten as one state.
COMPACT_AFTER = 64



class PrunedError(LookupError):
    """A reader's place in the feed lies before what is still held; it must begin anew from the documents."""


_EPOCH, _US = datetime(1970, 1, 1), timedelta(microseconds=1)


def when(us: int) -> datetime:
    return _EPOCH + us * _US


def us_of(at: datetime) -> int:
    return (at - _EPOCH) // _US


def encode(fields: dict[str, Value]) -> str:
    return json.dumps({k: V.to_json(fields[k]) for k in sorted(fields)}, ensure_ascii=False, separators=(",", ":"))


def decode(data: str | None) -> dict[str, Value]:
    """The fields of a stored document; null or unreadable text has none."""
    return {k: V.from_json(v) for k, v in parse(data).items()}


class DocumentStore:
    def __init__(self, spark: SparkSession, path: str, max_bytes: int = MAX_BYTES, max_depth: int = MAX_DEPTH):
        self.spark, self.path, self.limits = spark, path.rstrip("/"), (max_bytes, max_depth)
        self.versions = Versions(spark, self.path)

    # ---- reading

    def state(self) -> tuple[int, dict]:
        number, manifest = self.versions.latest()
        return number, manifest or {"rows": [], "changes": [], "seq": 0, "first_seq": 1, "time": 0, "since_compaction": 0}

    def rows(self, manifest: dict | None = None) -> DataFrame:
        return self._files((manifest or self.state()[1])["rows"])

    def _files(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], ROWS)
        return reduce(DataFrame.unionByName, [self.spark.read.schema(ROWS).parquet(p) for p in folders])

    def snapshot(self, manifest: dict | None = None, paths: list[str] | None = None, below: str | None = None, collection: str | None = None,
                 collection_id: str | None = None, data: bool = True) -> DataFrame:
        """The current documents: the last version of each path, without the removed.

        Filters go below everything else and into the Parquet scans; the collection id of ``paths`` and ``collection``, or one
        given, picks the partitions that are listed and opened.  Rows written in bulk hold each path once, so they need no
        aggregation: they lose the paths that commits have written since, by their keys alone, and their documents are
        never shuffled while those keys are few.  Only rows of commits are reduced to the last one of each path.
        Without ``data`` the documents' fields are not read.
        """
        m = manifest or self.state()[1]
        path, kept = F.col("document_path"), [c for c in DOCUMENT_COLUMNS if data or c != "data"]

        def asked(df: DataFrame) -> DataFrame:
            if paths is not None:
                df = df.where(path.isin(paths) & F.col("collection_id").isin(sorted({split_document(p)[1] for p in paths})))
            if below is not None:
                df = df.where(path.startswith(f"{below}/"))
            if collection_id is not None:
                df = df.where(F.col("collection_id") == collection_id)
            if collection is not None:
                df = df.where(path.startswith(f"{collection}/") & (F.locate("/", path, len(collection) + 2) == 0) & (F.col("collection_id") == collection.rpartition("/")[2]))
            return df

        whole = set(m.get("bulk", []))
        bulk, since = (asked(self._files([p for p in m["rows"] if (p in whole) == of_bulk])) for of_bulk in (True, False))
        latest = since.groupBy("document_path").agg(F.max(F.struct("commit_seq", "deleted", *[c for c in kept if c != "document_path"])).alias("r"))
        changed = latest.where(~F.col("r.deleted")).select("document_path", *[f"r.{c}" for c in kept if c != "document_path"])
        if not whole & set(m["rows"]):
            return changed
        if whole >= set(m["rows"]):
            return bulk.where(~F.col("deleted")).select(*kept)
        newer = (F.col("b.document_path") == F.col("s.document_path")) & (F.col("s.commit_seq") > F.col("b.commit_seq"))
        still = bulk.where(~F.col("deleted")).alias("b").join(since.select("document_path", "commit_seq").alias("s"), newer, "left_anti")
        return still.select(*kept).unionByName(changed)

    def collections(self) -> StoreCollections:
        return StoreCollections(self)

    def ends(self, manifest: dict | None = None) -> tuple[int, int]:
        """First and last ``seq`` of the feed that are still held; (1, 0) for a feed without any."""
        m = manifest or self.state()[1]
        return m["first_seq"], m["seq"]

    def holds_change(self, after: int, where: Column, manifest: dict | None = None) -> bool:
        """Whether a change after ``after`` fits; stops at the first."""
        return not self.changes(after, manifest).where(where).limit(1).isEmpty()

    def touched(self, changes: DataFrame, manifest: dict | None = None) -> DataFrame:
        """The current rows of the documents that a batch of changes names and did not remove at last."""
        named = changes.where(F.col("type") != "removed").select("document_path").distinct()
        return self.snapshot(manifest).join(named, "document_path", "left_semi")

    def changes(self, after: int | None = None, manifest: dict | None = None) -> DataFrame:
        """Changes with a greater ``seq`` (None: all that are held); only files that can hold them are read."""
        m = manifest or self.state()[1]
        after = m["first_seq"] - 1 if after is None else after
        if after < m["first_seq"] - 1:
            raise PrunedError(f"changes after {after} are no longer held; the first is {m['first_seq']}")
        files = [c["path"] for c in m["changes"] if c["to"] > after]
        if not files:
            return self.spark.createDataFrame([], CHANGES)
        return self.spark.read.schema(CHANGES).parquet(*files).where(F.col("seq") > after)

    def get_many(self, paths: Iterable[str], manifest: dict | None = None) -> dict[str, Document]:
        wanted = sorted(set(paths))
        if not wanted:
            return {}
        return {r["document_path"]: self.document(r) for r in self.snapshot(manifest, wanted).collect()}

    @staticmethod
    def document(r) -> Document:
        return Document(r["document_path"], decode(r["data"]) if "data" in r else {}, us_of(r["created_at"]), us_of(r["updated_at"]), r["version"])

    # ---- writing

    def commit(self, writes: list[Set | Update | Delete], read_set: dict[str, int | None] | None = None, authorize: Callable | None = None,
        attempts: int = 5) -> tuple[Outcome, int]:
        """Apply a batch atomically; returns its outcome and commit time.

        read_set: documents read before (path -> time of last write, None for missing); if one has changed since, the batch
        is ABORTED.  Losing the race for the manifest means checking and applying again on the new state.
        """
        check(writes, allow_empty=bool(read_set))
        for _ in range(attempts):
            number, m = self.state()
            named = {w.path for w in writes if "/" in w.path} | set(read_set or {})
            before = self.get_many([p for p in named if p.count("/") % 2], m)
            for path, at in (read_set or {}).items():
                if (before[path].updated if path in before else None) != at:
                    raise WriteError("ABORTED", f"{path} changed since it was read")
            below: dict[str, list[str]] = {}
            for w in writes:
                if isinstance(w, Delete) and w.cascade:
                    # a removal needs no fields, unless rules look at them
                    under = self.snapshot(m, below=w.path, data=authorize is not None).limit(MAX_CASCADE + 1).collect()
                    if len(under) > MAX_CASCADE:
                        raise WriteError("INVALID_ARGUMENT", f"more than {MAX_CASCADE} documents below {w.path}: remove_below deletes them on the cluster")
                    docs = {r["document_path"]: self.document(r) for r in under}
                    below[w.path] = list(docs)
                    before |= docs
            touched = {p: d for p, d in before.items() if p in {w.path for w in writes} or any(p in b for b in below.values())}
            now = max(time.time_ns() // 1000, m["time"] + 1)
            out = apply(writes, touched, lambda root: below.get(root, []), now, authorize, *self.limits)
            if not out.changes:
                return out, now
            try:
                self._publish(number, m, out, now)
                return out, now
            except Conflict:
                continue
        raise WriteError("ABORTED", "other writers were faster each time")

    def _publish(self, number: int, m: dict, out: Outcome, now: int) -> None:
        seq, rows, changes = m["seq"], [], []
        for c in out.changes:
            seq += 1
            collection, cid, doc_id = split_document(c.path)
            d = out.documents[c.path]
            rows.append((c.path, doc_id, collection, cid, encode(d.fields) if d else None, when(d.created if d else now), when(now), c.version, seq, d is None))
            changes.append((seq, c.type, c.path, collection, c.version, when(now)))
        at = f"{number + 1:020d}-{now}"
        rows_at, changes_at = f"{self.path}/rows/{at}", f"{self.path}/changes/{at}"
        self.spark.createDataFrame(rows, ROWS).coalesce(1).write.partitionBy("collection_id").parquet(rows_at)
        self.spark.createDataFrame(changes, CHANGES).coalesce(1).write.parquet(changes_at)
        self._write(number, m, rows_at, {"path": changes_at, "from": m["seq"] + 1, "to": seq}, seq, now)

    def _write(self, number: int, m: dict, rows_at: str, change: dict, seq: int, now: int, bulk: bool = False) -> None:
        manifest = {**m, "rows": [*m["rows"], rows_at], "changes": [*m["changes"], change], "seq": seq, "time": now, "since_compaction": m["since_compaction"] + 1}
        if bulk:
            manifest["bulk"] = [*m.get("bulk", []), rows_at]
        try:
            self.versions.publish(number, manifest)
        except Conflict:
            for path in (rows_at, change["path"]):
                remove(self.spark, path)
            raise
        if manifest["since_compaction"] >= COMPACT_AFTER:
            self.compact()

    def _append(self, number: int, m: dict, documents: DataFrame, now: int, bulk: bool) -> int:
        """Write rows (document_path, type, data, created_at, version) as one commit, distributed; returns its last seq.

        They are partitioned by collection id and sorted by path, so that scans of a collection and prefix reads skip
        files; sequence numbers follow that order.  ``bulk``: none of the paths is in the store.
        """
        path = F.col("document_path")
        placed_in = {"document_id": F.substring_index(path, "/", -1),
            "collection_path": F.expr("left(document_path, length(document_path) - length(substring_index(document_path, '/', -1)) - 1)"),
            "collection_id": F.split_part(path, F.lit("/"), F.lit(-2))}
        numbered, many = numbered_rows(documents.withColumns(placed_in), ["collection_id", "document_path"], "commit_seq", m["seq"] + 1)
        if not many:
            return m["seq"]
        at, stamp = f"{number + 1:020d}-{now}", F.lit(when(now)).cast("timestamp_ntz")
        rows_at, changes_at, removed = f"{self.path}/rows/{at}", f"{self.path}/changes/{at}", F.col("type") == "removed"
        full = numbered.withColumns({"deleted": removed, "data": F.when(~removed, F.col("data")), "updated_at": F.coalesce("updated_at", stamp),
            "created_at": F.coalesce("created_at", stamp)})
        full.select(*[c.split()[0] for c in ROWS.split(", ")]).write.partitionBy("collection_id").parquet(rows_at)
        numbered.select(F.col("commit_seq").alias("seq"), "type", "document_path", "collection_path", "version", stamp.alias("commit_time")).write.parquet(changes_at)
        self._write(number, m, rows_at, {"path": changes_at, "from": m["seq"] + 1, "to": m["seq"] + many}, m["seq"] + many, now, bulk)
        return m["seq"] + many

    def load(self, documents: DataFrame) -> int:
        """Bulk insert: rows with the columns of a document table become added documents; returns the last seq.

        Paths must be unique and not in the store yet; where a document lies follows from its path, whatever the
        other columns say.
        """
        number, m = self.state()
        now = max(time.time_ns() // 1000, m["time"] + 1)
        rows = documents.select("document_path", F.lit("added").alias("type"), "data", "created_at", "updated_at", "version")
        return self._append(number, m, rows, now, True)

    def write_all(self, writes: DataFrame) -> int:
        """Apply a table of writes as one commit on the cluster; returns the last seq.

        writes: ``write``, each a write in its JSON form.  Every document may be named once.  Preconditions, merges, masks,
        transforms and limits are those of a batch, by the same code in Arrow batches beside the document each write
        names; a cascade is refused (see ``remove_below``).  If any write fails nothing is written, and the error is that of
        the first path.
        """
        number, m = self.state()
        now = max(time.time_ns() // 1000, m["time"] + 1)
        text = F.col("write")
        path = F.coalesce(*[F.get_json_object(text, f"$.{k}.path") for k in ("set", "update", "delete")])
        asked = writes.select(F.coalesce(path, F.lit("")).alias("document_path"), "write")
        beside = self.snapshot(m).select("document_path", "data", "created_at", "updated_at", "version")
        schema = "document_path string, type string, data string, created_at timestamp_ntz, updated_at timestamp_ntz, version long, error string"
        done = asked.join(beside, "document_path", "left").mapInArrow(lambda batches, limits=self.limits: _applied(batches, now, limits), schema)
        done = stage(done, "written")
        once = done.groupBy("document_path").count().where("count > 1").select("document_path",
            F.lit("INVALID_ARGUMENT: a table of writes names each document once").alias("error"))
        wrong = done.where(F.col("error").isNotNull()).select("document_path", "error").unionByName(once).agg(F.min(F.struct("document_path", "error")).alias("e")).first()["e"]
        if wrong:
            status, _, message = wrong["error"].partition(": ")
            raise WriteError(status, message)
        return self._append(number, m, done.where(F.col("type").isNotNull()), now, False)

    def remove_below(self, path: str) -> int:
        """Remove the document or collection at ``path`` and everything below it, on the cluster; returns the last seq."""
        number, m = self.state()
        now = max(time.time_ns() // 1000, m["time"] + 1)
        doomed = self.snapshot(m, below=path, data=False)
        if is_document(path):
            doomed = doomed.unionByName(self.snapshot(m, paths=[path], data=False))
        return self._remove(number, m, doomed, now)

    def remove_expired(self, collection_id: str, field_name: str, now_us: int, cascade: bool = True) -> int:
        """Remove expired documents as one commit on the cluster (so the feed shows them), with what lies below them under ``cascade``.

        Only the partition of the collection id is searched; a document lies below an expired one if a path on the way to it
        is expired, found by an equality join on those paths.  Returns how many have expired.
        """
        number, m = self.state()
        now = max(time.time_ns() // 1000, m["time"] + 1)
        old = stage(expired(self.snapshot(m, collection_id=collection_id), collection_id, field_name, now_us).select("document_path", "created_at", "version"), "expired")
        many = old.count()
        if not many:
            return 0
        doomed = old
        if cascade:
            names = F.split("document_path", "/")
            above = F.transform(F.sequence(F.lit(2), F.size(names) - 2, F.lit(2)), lambda k: F.array_join(F.slice(names, 1, k), "/"))
            deep = self.snapshot(m, data=False).where((F.size(names) > 2) & (F.size(names) % 2 == 0)).select("document_path", "created_at", "version",
                F.explode(above).alias("above"))
            below = deep.join(old.select(F.col("document_path").alias("above")), "above", "left_semi").select("document_path", "created_at", "version")
            doomed = old.unionByName(below).dropDuplicates(["document_path"])
        self._remove(number, m, doomed, now)
        return many

    def _remove(self, number: int, m: dict, doomed: DataFrame, now: int) -> int:
        rows = doomed.select("document_path", F.lit("removed").alias("type"), F.lit(None).cast("string").alias("data"), "created_at",
            F.lit(None).cast("timestamp_ntz").alias("updated_at"), "version")
        return self._append(number, m, rows, now, False)

    def compact(self) -> None:
        """Rewrite the current documents as one set of files, sorted by path, and join the files of old changes.

        The feed's files are joined with their neighbours of the same compaction only, so that old ones can still be dropped.
        Older manifests keep their files until ``vacuum``.
        """
        number, m = self.state()
        at, feed = (f"{self.path}/{kind}/{number + 1:020d}-compact-{time.time_ns()}" for kind in ("rows", "changes"))
        current = self.snapshot(m).withColumn("commit_seq", F.lit(m["seq"])).withColumn("deleted", F.lit(False))
        current.repartitionByRange("collection_id", "document_path").sortWithinPartitions("collection_id", "document_path").write.partitionBy("collection_id").parquet(at)
        done, single = [c for c in m["changes"] if c.get("joined")], [c for c in m["changes"] if not c.get("joined")]
        if len(single) > 1:
            self.changes(single[0]["from"] - 1, m).repartitionByRange("seq").sortWithinPartitions("seq").write.parquet(feed)
            single = [{"path": feed, "from": single[0]["from"], "to": single[-1]["to"], "joined": True}]
        try:
            self.versions.publish(number, {**m, "rows": [at], "bulk": [at], "changes": [*done, *single], "since_compaction": 0})
        except Conflict:
            for path in (at, feed):
                remove(self.spark, path)

    def vacuum(self) -> None:
        """Remove the files that the newest state does not name, and the manifests before it; no older reader may be left."""
        number, m = self.state()
        named = {p.rpartition("/")[2] for p in [*m["rows"], *[c["path"] for c in m["changes"]]]}
        for kind in ("rows", "changes"):
            for name in listing(self.spark, f"{self.path}/{kind}"):
                if name not in named and int(name[:20]) <= number:
                    remove(self.spark, f"{self.path}/{kind}/{name}")
        self.versions.prune()

    def prune(self, before_us: int) -> int:
        """Drop change files that are wholly older than an instant; returns the first seq still held."""
        number, m = self.state()
        if not m["changes"]:
            return m["first_seq"]
        # one pass over two columns of the feed, whatever the number of files; places in it tell the files apart
        starts = F.array(*[F.lit(c["to"]) for c in m["changes"]])
        place = F.size(F.filter(starts, lambda to: to < F.col("seq")))
        newest = {r["place"]: us_of(r["at"]) for r in self.changes(m["first_seq"] - 1, m).groupBy(place.alias("place")).agg(F.max("commit_time").alias("at")).collect()}
        gone = 0  # only from the beginning, so that what is held has no gap
        while gone < len(m["changes"]) and newest.get(gone, before_us) < before_us:
            gone += 1
        if not gone:
            return m["first_seq"]
        first = m["changes"][gone - 1]["to"] + 1
        self.versions.publish(number, {**m, "changes": m["changes"][gone:], "first_seq": first})
        return first


class StoreCollections(TaggedCollections):
    """The collections of a store; a query's collection goes down to the files it reads."""

    def __init__(self, store: DocumentStore):
        self.store, self.manifest = store, store.state()[1]

    @property
    def df(self) -> DataFrame:
        return self.store.snapshot(self.manifest)

    def scan(self, collection: str) -> DataFrame:
        return self.store.snapshot(self.manifest, collection=collection)


def _applied(batches: Iterator[pa.RecordBatch], now: int, limits: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Writes beside the documents they name, as the rows they leave: a null type for no change, or an error."""
    for b in batches:
        out: list[list] = [[] for _ in range(7)]
        for r in b.to_pylist():
            path, have, row = r["document_path"], None, None
            if r["version"] is not None:
                have = Document(path, decode(r["data"]), us_of(r["created_at"]), us_of(r["updated_at"]), r["version"])
            try:
                w = parse_write(json.loads(r["write"]))
                if isinstance(w, Delete) and w.cascade:
                    raise WriteError("INVALID_ARGUMENT", "no cascade in a table of writes")
                check([w])
                done = apply([w], {path: have} if have else {}, lambda root: [], now, None, *limits)
                for c in done.changes:
                    d = done.documents[path]
                    row = (path, c.type, encode(d.fields) if d else None, when(d.created if d else have.created), when(now), c.version, None)
            except (WriteError, ValueError, TypeError) as e:
                row = (path, None, None, None, None, None, str(e) if isinstance(e, WriteError) else f"INVALID_ARGUMENT: {e}")
            for c, x in zip(out, row or (path, *[None] * 6)):
                c.append(x)
        types = [pa.string(), pa.string(), pa.string(), pa.timestamp("us"), pa.timestamp("us"), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["document_path", "type", "data", "created_at", "updated_at", "version", "error"])


def descendants(df: DataFrame, path: str) -> DataFrame:
    """The document at ``path`` and everything below it."""
    return df.where((F.col("document_path") == path) | F.col("document_path").startswith(f"{path}/"))
