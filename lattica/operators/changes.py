"""Applying a feed of inserts, updates and deletes (problem 3).

Documents are hashed to a fixed number of buckets.  A run loads the stored rows of the buckets it touches into an
embedded DuckDB table with one row per document; a change enters by an upsert that compares sequence numbers
(``ON CONFLICT ... DO UPDATE ... WHERE``), so order of arrival and repeats do not matter.  Removals stay as tombstones,
or an older change arriving later would bring the document back.  Each bucket is exported to a folder of its own, and
one manifest publishes all buckets at once; buckets without changes keep the folders they have.

Beside the buckets lies a ledger of the changes known so far and the lowest ``seq`` of each, in parts by a hash of the
whole change: the history of one document is spread over all parts, whatever its length.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators.skew import skew_join
from lattica.sources.shared import Parts, Versions, stage

#: What makes two rows of the feed the same change.
IDENTITY = ["type", "document_path", "version", "commit_time"]
#: Changes given to DuckDB at once.
FLUSH = 100_000
#: Most documents of a bucket on average, and of a task's own table: both keep DuckDB in memory.
BUCKET_ROWS, LOCAL_ROWS = 500_000, 300_000
#: Ledger folders after which they are written as one.
LEDGER_FOLDERS = 16
STATE_SCHEMA = "document_path string, type string, version long, seq long"


def known_changes(changes: DataFrame, *columns: str) -> DataFrame:
    """Each change once, under the lowest ``seq`` of its rows; nulls in the identity are equal to each other.

    Rows without a path name no document and rows without a ``seq`` no place in the feed; both are left out.  The
    minimum is taken on the map side first and the grouping key holds the version and time of the change, so a
    document with a third of all rows is spread like any other.
    """
    known = changes.where(F.col("document_path").isNotNull() & F.col("seq").isNotNull()).groupBy(*IDENTITY).agg(F.min("seq").alias("seq"), *[F.max(c).alias(c) for c in columns])
    return known


def _upsert(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows (document_path, type, version, seq) in, the latest of each document out, by conditional upserts.

    With ``most``, the table is put out and begun anew whenever it has as many documents; a document may then come out
    more than once.  A table that outgrows its memory spills to where Spark's own sorts spill.
    """
    import shutil

    import duckdb

    spill = next((f"{d}/upsert-{uuid.uuid4().hex}" for d in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if d), "")
    db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "1GB", "temp_directory": spill})
    db.execute("CREATE TABLE state (document_path VARCHAR PRIMARY KEY, type VARCHAR, version BIGINT, seq BIGINT)")
    # a statement may touch a row once only: repeats inside a batch are settled before the conflict check
    statement = """
        INSERT INTO state
        SELECT document_path, latest.type, latest.version, latest.seq
        FROM (SELECT document_path, arg_max(struct_pack(type := type, version := version, seq := seq), struct_pack(s := seq, v := coalesce(version, -1), t := coalesce(type, ''))) AS latest
              FROM incoming GROUP BY document_path)
        ON CONFLICT (document_path) DO UPDATE SET type = excluded.type, version = excluded.version, seq = excluded.seq
        WHERE (excluded.seq, coalesce(excluded.version, -1), coalesce(excluded.type, '')) > (state.seq, coalesce(state.version, -1), coalesce(state.type, ''))"""

    export = "SELECT document_path, type, version, seq FROM state"

    def flush(held: list[pa.RecordBatch]) -> None:
        db.register("incoming", pa.Table.from_batches(held))
        db.execute(statement)
        db.unregister("incoming")

    held, rows = [], 0
    try:
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= FLUSH:
                flush(held)
                held, rows = [], 0
                if most and db.execute("SELECT count(*) FROM state").fetchall()[0][0] >= most:
                    yield from db.sql(export).to_arrow_reader(50_000)
                    db.execute("TRUNCATE state")
        if rows:
            flush(held)
        yield from db.sql(export).to_arrow_reader(50_000)
    finally:
        db.close()
        if spill:
            shutil.rmtree(spill, ignore_errors=True)


def bucket_of(columns: list[str], n: int) -> Column:
    """The bucket of a row, equal to the task that a repartitioning to ``n`` by these columns gives it."""
    return F.pmod(F.hash(*columns), F.lit(n))


def upsert_latest(changes: DataFrame, buckets: int, stored: DataFrame | None = None) -> DataFrame:
    """The last change of each document of ``changes`` and ``stored`` (document_path, type, version, seq), tombstones included.

    First each task upserts what it holds of ``changes``, leaving one row per document and task (or per LOCAL_ROWS
    documents, so that its table stays small); then documents are hashed to buckets, and each bucket upserts these
    rows and its stored ones.  A document with a third of all changes thus sends its bucket a few rows per task.  Equal
    sequence numbers of a document go to the greater version, then type.
    """
    plain = lambda df: df.select("document_path", "type", F.col("version").cast("long").alias("version"), F.col("seq").cast("long").alias("seq"))
    local = plain(changes).mapInArrow(lambda batches: _upsert(batches, LOCAL_ROWS), STATE_SCHEMA)
    rows = local if stored is None else local.unionByName(plain(stored))
    return rows.repartition(buckets, "document_path").mapInArrow(_upsert, STATE_SCHEMA)


def _same(a: str, b: str) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in IDENTITY])


def _unknown(incoming: DataFrame, ledger: Parts) -> DataFrame:
    """Of the incoming changes those that the ledger lacks or has under a higher ``seq`` (then in ``old_seq``).

    Only the ledger's parts that can hold them are read, and joined with the incoming changes rather than shuffled as a
    whole where those are few.
    """
    parts = [r[0] for r in incoming.select("part").distinct().collect()]  # numbers of parts, whose count is fixed
    hits = ledger.read(parts).alias("o").join(incoming.alias("n"), (F.col("o.part") == F.col("n.part")) & _same("o", "n"))
    held = hits.groupBy(*[F.col(f"n.{c}").alias(c) for c in IDENTITY]).agg(F.min("o.seq").alias("old_seq"))
    both = incoming.alias("n").join(held.alias("h"), _same("n", "h"), "left").select("n.*", "h.old_seq")
    return both.where(F.col("old_seq").isNull() | (F.col("seq") < F.col("old_seq")))


def apply_changes(spark: SparkSession, changes: DataFrame, path: str, buckets: int | None = None) -> DataFrame:
    """Bring the table at ``path`` up to date with ``changes`` and publish it; returns the live documents.

    Live rows are (document_path, version, seq) of each document whose last change is not a removal.  A repeat that
    arrives in a later run, or a lower ``seq`` for a change already known, changes the outcome exactly as if all rows had
    come at once: the ledger tells both, and documents whose stored place sinks by a lower ``seq`` are worked out again from
    it.  Only buckets with changes are loaded and written.  Running the same changes twice changes nothing.  A run that
    fails publishes nothing; of two runs over the same version one gets :class:`~lattica.sources.shared.Conflict`.
    An empty feed publishes an empty table (or the table as it was).

    buckets: how many to begin with; else as many as give BUCKET_ROWS changes each at most.  A table whose buckets have
    come to hold twice as many documents gets more of them in its next run.
    """
    versions = Versions(spark, path)
    number, before = versions.latest()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = before.get("ledger_parts") or tasks
    ledger_schema = ", ".join(f"{c} {changes.schema[c].dataType.simpleString()}" for c in IDENTITY) + ", seq long"
    ledger, state = Parts(spark, ledger_schema, before.get("ledger")), Parts(spark, STATE_SCHEMA, before.get("state"))
    known = known_changes(changes.select(*IDENTITY, F.col("seq").cast("long").alias("seq"))).withColumn("part", bucket_of(IDENTITY, parts))
    with versions.writing(number) as at:
        if ledger.folders:
            news = stage(_unknown(stage(known, "incoming"), ledger), "news")
            sunk = stage(news.where(F.col("old_seq").isNotNull()).select("document_path").distinct(), "sunk")
            sunk = None if sunk.isEmpty() else sunk
            ledger = ledger.replace(news.drop("old_seq").repartition(parts, *IDENTITY), f"{at}/ledger")
        else:
            ledger, sunk = ledger.replace(known, f"{at}/ledger"), None
            news = ledger.read()
        if sunk is not None:
            again = skew_join(ledger.read(), sunk, [("document_path", "document_path")], "left_semi")
            news = known_changes(again.select(*IDENTITY, "seq").unionByName(news.select(*IDENTITY, "seq")))
        n = before.get("buckets") or buckets or max(tasks, -(-news.count() // BUCKET_ROWS))
        stored = state
        if before.get("documents", 0) > 2 * BUCKET_ROWS * n:
            n, state = -(-2 * before["documents"] // BUCKET_ROWS), Parts(spark, STATE_SCHEMA)
        touched = {r[0] for r in news.select(bucket_of(["document_path"], n)).distinct().collect()} if state.folders else set(range(n))
        held = stored.read(touched if state.folders else None).drop("part") if stored.folders else None
        if held is not None and sunk is not None:
            held = held.join(sunk, "document_path", "left_anti")
        latest = upsert_latest(news, n, held).withColumn("part", bucket_of(["document_path"], n))
        state = state.replace(latest, f"{at}/state", touched)
        if len(ledger.folders) > LEDGER_FOLDERS:
            whole = ledger.read().groupBy(*IDENTITY, "part").agg(F.min("seq").alias("seq"))
            ledger = Parts(spark, ledger_schema).replace(whole.repartition(parts, *IDENTITY), f"{at}/whole-ledger")
        versions.publish(number, {"buckets": n, "ledger_parts": parts, "ledger": ledger.folders, "state": state.folders, "documents": state.read().count()})
    return live_documents(spark, path)


def live_documents(spark: SparkSession, path: str) -> DataFrame:
    """The live documents of the version published last."""
    _, manifest = Versions(spark, path).latest()
    state = Parts(spark, STATE_SCHEMA, manifest.get("state")).read()
    return state.where(~F.col("type").eqNullSafe("removed")).select("document_path", "version", "seq")
