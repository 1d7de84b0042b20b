"""The shared folder: written stages that cut lineage, and versions that appear whole or not at all.

Every path goes through Hadoop's file system API, so the same code runs on a local folder, HDFS or an object
store.  Nothing is ever placed in a folder only one machine can see: without a shared folder only a local master
(tests, a laptop) gets one of its own, and any other is refused.

Scratch stages live in the application's own folder and end with it.  Whatever a manifest names lies below the version's
own path, so it outlives the application.
"""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid
from collections.abc import Collection, Iterator
from contextlib import contextmanager, suppress
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"
_roots: dict[str, str] = {}


def root(spark: SparkSession) -> str:
    """This application's own folder inside the shared one; removed when the process ends."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING, None)
        if not base and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {SETTING} to a folder that all machines share")
        if not base:
            base = tempfile.mkdtemp(prefix="lattica-")
            spark.sparkContext.setCheckpointDir(base)
            atexit.register(_remove_local, base)
        _roots[app] = f"{base.rstrip('/')}/lattica-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_remove, spark, _roots[app])
    return _roots[app]


def _remove_local(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        fs, p = _fs(spark, path)
        fs.delete(p, True)
    except Exception:  # the JVM may be gone already; the folder then stays for its owner to remove
        pass


def fresh(spark: SparkSession, name: str) -> str:
    """A new folder name that no other stage or run uses."""
    return f"{root(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later plans start there, whichever executors are lost."""
    spark = df.sparkSession
    path = fresh(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def listing(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


class Conflict(RuntimeError):
    """Another writer published the version first."""


def create_exclusive(spark: SparkSession, path: str, text: str) -> None:
    """Create ``path`` with ``text``, whole; raise :class:`Conflict` if it exists.

    The text goes to a file beside it, which is then renamed without permission to overwrite.
    """
    jvm, hidden = spark._jvm, f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"
    fs, p = _fs(spark, hidden)
    out = fs.create(p, False)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(context.makeQualified(p), context.makeQualified(jvm.org.apache.hadoop.fs.Path(path)), options)
    except Exception as e:
        fs.delete(p, False)
        if "FileAlreadyExists" in str(e):
            raise Conflict(path) from e
        raise


class Versions:
    """Numbered versions of a result below ``path``.

    A version is a JSON manifest naming folders that are already complete.  Readers see the newest manifest, so a
    run that fails before ``publish`` leaves nothing visible, and of two runs that publish the same number one fails.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def latest(self) -> tuple[int, dict]:
        names = [n for n in listing(self.spark, f"{self.path}/_versions") if n.endswith(".json")]
        if not names:
            return 0, {}
        return int(names[-1][:20]), json.loads(read_text(self.spark, f"{self.path}/_versions/{names[-1]}"))

    def publish(self, base: int, manifest: dict) -> int:
        create_exclusive(self.spark, f"{self.path}/_versions/{base + 1:020d}.json", json.dumps(manifest, sort_keys=True))
        return base + 1

    def prune(self) -> None:
        """Remove manifests before the newest, and finished data that it does not name."""
        number, manifest = self.latest()
        text = json.dumps(manifest)
        for name in listing(self.spark, f"{self.path}/_versions"):
            if name.endswith(".json") and int(name[:20]) < number:
                remove(self.spark, f"{self.path}/_versions/{name}")
        for name in listing(self.spark, f"{self.path}/data"):
            if int(name[:20]) <= number and name not in text:  # a later one belongs to a run that is still writing
                remove(self.spark, f"{self.path}/data/{name}")

    @contextmanager
    def writing(self, base: int) -> Iterator[str]:
        """A new folder below ``path`` for the data of the version after ``base``; removed again if the run fails."""
        at = f"{self.path}/data/{base + 1:020d}-{uuid.uuid4().hex[:8]}"
        try:
            yield at
        except BaseException:
            with suppress(Exception):  # the error that stopped the run is the one to tell
                remove(self.spark, at)
            raise


class Parts:
    """A table cut into numbered parts, each of which lies in the folder of the version that wrote it last.

    ``folders`` (folder -> numbers) goes into a manifest.  A run that touches few parts writes and reads only those.
    """

    def __init__(self, spark: SparkSession, schema: str, folders: dict[str, list[int]] | None = None, column: str = "part"):
        self.spark, self.schema, self.folders, self.column = spark, schema, folders or {}, column

    def numbers(self) -> set[int]:
        return {n for ns in self.folders.values() for n in ns}

    def read(self, only: Collection[int] | None = None) -> DataFrame:
        """The rows, with the part's number; of the parts ``only``, which alone are listed and opened."""
        kept = {f: [n for n in ns if only is None or n in only] for f, ns in self.folders.items()}
        found = [self.spark.read.schema(f"{self.schema}, {self.column} int").parquet(f).where(F.col(self.column).isin(ns)) for f, ns in kept.items() if ns]
        return reduce(DataFrame.unionByName, found) if found else self.spark.createDataFrame([], f"{self.schema}, {self.column} int")

    def replace(self, rows: DataFrame, folder: str, touched: Collection[int] = ()) -> Parts:
        """Write ``rows`` to ``folder``: all rows of the parts ``touched``, and more rows for others, which keep what they have."""
        rows.write.partitionBy(self.column).parquet(folder)
        kept = {f: left for f, ns in self.folders.items() if (left := [n for n in ns if n not in touched])}
        written = sorted(int(n.partition("=")[2]) for n in listing(self.spark, folder) if n.startswith(f"{self.column}="))
        return Parts(self.spark, self.schema, {**kept, folder: written} if written else kept, self.column)
