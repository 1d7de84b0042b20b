"""Processing only new or changed records, told by a Merkle tree over key ranges (problem 5).

Records lie on an integer key (a sequence number).  A leaf digests the records of a fixed range of keys; an inner node
digests its children.  Two trees are compared from the root: only nodes whose digests differ are descended into, so
the records of equal ranges are never looked at.  A run publishes its output and the tree of what it has handled in
one manifest: after a failure neither is visible and the next run starts from the same tree, so no record is skipped
or handled twice.  All that a manifest names lies below the result's own path.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.operators.changes import IDENTITY, known_changes
from lattica.sources.shared import Parts, Versions, stage

#: Keys per leaf, and children per inner node.
WIDTH, FANOUT = 128, 64
#: Folders of handled marks after which they are written as one.
MARK_FOLDERS = 16
_NEVER, _ALWAYS = -(2**63), 2**63 - 1
MARKS = "leaf long, digest long"
NODES = "node long, digest long, n long"


def leaf_of(key: Column, width: int = WIDTH) -> Column:
    return F.call_function("div", key - F.pmod(key, F.lit(width)), F.lit(width)) if width & (width - 1) else F.shiftright(key, width.bit_length() - 1)


def row_digest(*columns: str) -> Column:
    """64 bits of a record; nulls and their places count (a null and the next column's value can't be confused)."""
    return F.xxhash64(*[x for c in columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))])


def leaves(rows: DataFrame, late: bool = False) -> DataFrame:
    """(node, digest, n) from rows with ``leaf`` and ``digest``, with ``late`` also the latest of ``late``; the order of rows does not matter."""
    return rows.groupBy(F.col("leaf").alias("node")).agg(F.bit_xor("digest").alias("digest"), F.count(F.lit(1)).alias("n"), *([F.max("late").alias("late")] if late else []))


def parents(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The next level up; a node's digest covers its children's places, digests and counts."""
    shift = fanout.bit_length() - 1
    child = F.xxhash64("node", "digest", "n")
    more = [F.max("late").alias("late")] if "late" in nodes.columns else []
    return nodes.groupBy(F.shiftright("node", shift).alias("node")).agg(F.bit_xor(child).alias("digest"), F.sum("n").alias("n"), *more)


def tree(leaf_nodes: DataFrame, depth: int, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels from the leaves (0) to the top (``depth``)."""
    levels = [leaf_nodes]
    for _ in range(depth):
        levels.append(parents(levels[-1], fanout))
    return levels


def depth_for(leaf_low: int, leaf_high: int, fanout: int = FANOUT) -> int:
    """Levels above the leaves until the range of nodes is no wider than one fanout."""
    depth, shift = 0, fanout.bit_length() - 1
    while leaf_high - leaf_low >= fanout:
        leaf_low, leaf_high, depth = leaf_low >> shift, leaf_high >> shift, depth + 1
    return depth


def written_tree(leaf_nodes: DataFrame, at: str, fanout: int = FANOUT) -> tuple[list[DataFrame], int]:
    """Write all levels of a tree to folders ``<at>/<level>`` and read them back; also the depth (-1: no leaves)."""
    spark, levels = leaf_nodes.sparkSession, []

    def put(nodes: DataFrame) -> None:
        nodes.write.parquet(f"{at}/{len(levels)}")
        levels.append(spark.read.schema(nodes.schema).parquet(f"{at}/{len(levels)}"))

    put(leaf_nodes)
    low, high = levels[0].agg(F.min("node"), F.max("node")).first()
    if low is None:
        return levels, -1
    for _ in range(depth_for(low, high, fanout)):
        put(parents(levels[-1], fanout))
    return levels, len(levels) - 1


def saved_tree(spark: SparkSession, at: str, depth: int, wanted: int, fanout: int = FANOUT) -> list[DataFrame]:
    """The levels of a written tree up to ``wanted``; those above its own top follow from it."""
    levels = [spark.read.schema(NODES).parquet(f"{at}/{n}") for n in range(max(depth, 0) + 1)]
    while len(levels) <= wanted:
        levels.append(parents(levels[-1], fanout))
    return levels


def differing_leaves(current: Sequence[DataFrame], saved: Sequence[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """(node) of the current leaves whose digest is not the saved one's, found from the top downwards.

    A node that the saved tree lacks differs.  A level is joined with the children of differing nodes only, and as soon
    as no node differs the lower levels are not read at all.  The joins are merge joins throughout, as the trees grow
    with the data and compress so well that they may look small enough to broadcast.
    """
    shift, frontier = fanout.bit_length() - 1, None
    for level in range(len(current) - 1, -1, -1):
        now = current[level].select("node", F.col("digest").alias("now"), F.col("n").alias("now_n"))
        if frontier is not None:
            now = now.withColumn("__up", F.shiftright("node", shift)).join(frontier.withColumnRenamed("node", "__up").hint("merge"), "__up", "left_semi")
        old = saved[level].select("node", F.col("digest").alias("old"), F.col("n").alias("old_n"))
        same = F.col("now").eqNullSafe(F.col("old")) & F.col("now_n").eqNullSafe(F.col("old_n"))
        frontier = stage(now.join(old.hint("merge"), "node", "left").where(~same).select("node"), "differing")
        if level and frontier.isEmpty():
            break
    return frontier


def process_new(spark: SparkSession, rows: DataFrame, key: str, path: str, process: Callable[[DataFrame], DataFrame],
                width: int = WIDTH, fanout: int = FANOUT) -> DataFrame:
    """Run ``process`` over the rows of ``rows`` that no published run has handled; returns the published output.

    A row is told by all its columns, so a changed row is a new one; repeated rows are one.  Rows without a key lie in
    no range and are not processed.  Output, tree and marks of the handled rows appear together in one manifest: if
    ``process`` or a write fails, nothing does.  A run that finds nothing new publishes an empty output.  ``rows`` is
    digested in one pass; whole rows are read again in differing leaves only.  The marks (leaf and digest of a row) lie
    in parts by a hash of their place, of which only those with differing leaves are read; new marks are added to them.
    """
    versions = Versions(spark, path)
    number, before = versions.latest()
    n = before.get("parts") or int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.hash(F.shiftright("leaf", 6)), F.lit(n)).alias("part")
    # the row stays in one struct, so its columns may have any names
    keyed = rows.where(F.col(f"`{key}`").isNotNull()).select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"),
        leaf_of(F.col(f"`{key}`").cast("long"), width).alias("leaf"), row_digest(*rows.columns).alias("digest"))
    marks = Parts(spark, MARKS, before.get("marks"))
    with versions.writing(number) as at:
        levels, depth = written_tree(leaves(keyed.select("leaf", "digest").distinct()), f"{at}/tree", fanout)
        new = keyed
        if before and depth >= 0:
            changed = differing_leaves(levels, saved_tree(spark, before["tree"], before["depth"], depth, fanout), fanout).withColumnRenamed("node", "leaf")
            touched = [r[0] for r in changed.select(part).distinct().collect()]  # numbers of parts, whose count is fixed
            new = keyed.join(changed, "leaf", "left_semi").join(marks.read(touched), ["leaf", "digest"], "left_anti") if touched else keyed.limit(0)
        new = stage(new.distinct(), "new")
        process(new.select("row.*")).write.parquet(f"{at}/output")
        marks = marks.replace(new.select("leaf", "digest", part), f"{at}/marks")
        if len(marks.folders) > MARK_FOLDERS:
            marks = Parts(spark, MARKS).replace(marks.read().repartition(n, "part"), f"{at}/all-marks")
        versions.publish(number, {"output": f"{at}/output", "tree": f"{at}/tree", "depth": depth, "marks": marks.folders, "parts": n})
    return spark.read.parquet(f"{at}/output")


# ---- the change feed and its consumers


def cursor_steps(cursors: DataFrame) -> DataFrame:
    """Per consumer, ranges ``(lo, hi]`` of ``seq`` with ``until``: microseconds of the first save at or above them.

    A save counts only if it goes beyond all earlier saves (by ``updated_at``); saves with a null ``seq`` say nothing.
    A save without a time is taken as before all times, so it has seen nothing by then.  What lies beyond all saves is a
    last range with a null ``hi`` that nobody has seen.  The greatest earlier save is found in two steps, over sorted
    partitions and inside each, so a consumer with very many saves is spread over tasks.
    """
    saves = cursors.where(F.col("consumer").isNotNull() & F.col("seq").isNotNull()).groupBy("consumer",
        F.coalesce(F.unix_micros(F.col("updated_at").cast("timestamp_ntz").cast("timestamp")), F.lit(_NEVER)).alias("until")).agg(F.max("seq").cast("long").alias("hi"))
    placed = stage(saves.repartitionByRange("consumer", "until").sortWithinPartitions("consumer", "until").withColumn("p", F.spark_partition_id()), "saves")
    earlier = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    carried = placed.groupBy("consumer", "p").agg(F.max("hi").alias("top")).withColumn("before", F.max("top").over(earlier("consumer").orderBy("p")))
    within = placed.withColumn("inside", F.max("hi").over(earlier("p", "consumer").orderBy("until")))
    stepped = within.join(carried.select("consumer", "p", "before"), ["consumer", "p"]).withColumn("lo", F.greatest("before", "inside"))
    beyond = placed.groupBy("consumer").agg(F.max("hi").alias("lo")).select("consumer", "lo", F.lit(None).cast("long").alias("hi"), F.lit(_NEVER).alias("until"))
    return stepped.where(F.col("lo").isNull() | (F.col("hi") > F.col("lo"))).select("consumer", "lo", "hi", "until").unionByName(beyond)


def _covered(steps: DataFrame, low: int, high: int, depth: int, width: int, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """Steps taken apart along the tree whose leaves go from ``low`` to ``high``.

    Per level (consumer, until, node) of the largest nodes that lie whole inside a step, at most two fanouts of them a
    level however long the step is; and (consumer, until, lo, hi, leaf) of the leaves at a step's ends.
    """
    shift = fanout.bit_length() - 1
    span = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<long>"))
    first = F.greatest(F.coalesce(F.col("lo") + 1, F.lit(low * width)), F.lit(low * width))
    last = F.least(F.coalesce(F.col("hi"), F.lit(high * width + width - 1)), F.lit(high * width + width - 1))
    cut = steps.withColumns({"first": first, "last": last}).where("first <= last").withColumn("a",
        leaf_of(F.col("first") + (width - 1), width)).withColumn("b", leaf_of(F.col("last") + 1, width) - 1)
    ends = F.array_compact(F.array(F.when(F.pmod("first", F.lit(width)) != 0, leaf_of(F.col("first"), width)),
        F.when(F.pmod(F.col("last") + 1, F.lit(width)) != 0, leaf_of(F.col("last"), width))))
    partial = cut.select("consumer", "until", "lo", "hi", F.explode(F.array_distinct(ends)).alias("leaf"))
    out = []
    for level in range(depth + 1):
        a, b = F.col("a"), F.col("b")
        if level == depth:
            nodes = span(a, b)
        else:
            up_a, up_b = F.shiftright(a + (fanout - 1), shift), F.shiftright(b + 1, shift) - 1
            nodes = F.when(up_a <= up_b, F.concat(span(a, F.shiftleft(up_a, shift) - 1), span(F.shiftleft(up_b + 1, shift), b))).otherwise(span(a, b))
        out.append(cut.select("consumer", "until", F.explode(nodes).alias("node")))
        if level < depth:
            cut = cut.withColumns({"a": up_a, "b": up_b})
    return out, partial


def _unseen(rows: DataFrame, levels: Sequence[DataFrame], steps: DataFrame, width: int, fanout: int) -> DataFrame:
    """(consumer, seq) of the rows (seq, late, leaf) that consumers have not seen.

    A consumer's saved digest of a node inside a step is the current one if the latest commit in it is no later than the
    step's save, for then all of it was seen; else the saved tree lacks a record there and the digests differ.  The
    descent begins at the largest nodes inside each step, so a range seen whole costs a node or two, not its leaves.
    """
    low, high = levels[0].agg(F.min("node"), F.max("node")).first()
    if low is None:
        return steps.limit(0).select("consumer", F.col("lo").alias("seq"))
    shift, frontier = fanout.bit_length() - 1, None
    cover, partial = _covered(steps, low, high, len(levels) - 1, width, fanout)
    for level in range(len(levels) - 1, -1, -1):
        nodes = levels[level].select("node", "digest", "late")
        here = nodes.join(cover[level].hint("merge"), "node")
        if frontier is not None:
            children = nodes.withColumn("up", F.shiftright("node", shift)).join(frontier.withColumnRenamed("node", "up").hint("merge"), "up").drop("up")
            here = here.unionByName(children)
        saved = F.when(F.col("late") <= F.col("until"), F.col("digest"))
        frontier = here.where(~F.col("digest").eqNullSafe(saved)).select("consumer", "until", "node")
    no = F.lit(None).cast("long")
    opened = frontier.select("consumer", "until", no.alias("lo"), no.alias("hi"), F.col("node").alias("leaf")).unionByName(partial)
    inside = (F.col("lo").isNull() | (F.col("seq") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("seq") <= F.col("hi"))) & (F.col("late") > F.col("until"))
    # rows of one seq lie in one leaf, so telling them apart needs no further shuffle
    return rows.select("seq", "late", "leaf").join(opened.hint("merge"), "leaf").where(inside).groupBy("leaf", "consumer", "seq").agg(F.lit(1)).select("consumer", "seq")


def unseen_changes(changes: DataFrame, cursors: DataFrame, path: str, width: int = WIDTH, fanout: int = FANOUT) -> DataFrame:
    """(consumer, seq) of each known change that a consumer has not seen; published with the tree below ``path``.

    The first run derives every consumer's saved tree from its saves.  A run publishes its output, the tree of the
    changes it has been over, their marks and the consumers it has served; a later run compares the current tree with
    that one from the top, and a consumer served before is given only unseen changes that the differing leaves hold and
    their marks lack.  A consumer that has started since is looked at as in a first run.  So each change is put out once,
    and a run that fails has put out nothing.
    A change without a ``commit_time`` was seen by nobody.  Consumers without a save have not started.
    """
    spark = changes.sparkSession
    versions = Versions(spark, path)
    number, before = versions.latest()
    late = F.coalesce(F.unix_micros(F.col("commit_time").cast("timestamp_ntz").cast("timestamp")), F.lit(_ALWAYS)).alias("late")
    schema = "leaf long, digest long, seq long, late long"
    known = known_changes(changes.select(*IDENTITY, F.col("seq").cast("long").alias("seq")))
    with versions.writing(number) as at:
        known.select(leaf_of(F.col("seq"), width).alias("leaf"), row_digest(*IDENTITY, "seq").alias("digest"), "seq", late).write.parquet(f"{at}/marks")
        rows = spark.read.schema(schema).parquet(f"{at}/marks")
        levels, depth = written_tree(leaves(rows, late=True), f"{at}/tree", fanout)
        steps = stage(cursor_steps(cursors), "steps")
        started = steps.select("consumer").distinct()
        if before:
            served = spark.read.schema("consumer string").parquet(before["served"])
            started = started.unionByName(served).distinct()
            new = _new_rows(spark, rows, levels, depth, before, fanout)
            unseen = _unseen(rows, levels, steps.join(served, "consumer", "left_anti"), width, fanout)
            if new is not None:
                mine = steps.join(served, "consumer", "left_semi")
                unseen = unseen.unionByName(_unseen(new, [stage(x, "level") for x in tree(leaves(new, late=True), depth, fanout)], mine, width, fanout))
        else:
            unseen = _unseen(rows, levels, steps, width, fanout)
        unseen.write.parquet(f"{at}/output")
        started.write.parquet(f"{at}/served")
        versions.publish(number, {"output": f"{at}/output", "tree": f"{at}/tree", "depth": depth, "marks": f"{at}/marks", "served": f"{at}/served"})
    return spark.read.schema("consumer string, seq long").parquet(f"{at}/output")


def _new_rows(spark: SparkSession, rows: DataFrame, levels: Sequence[DataFrame], depth: int, before: dict, fanout: int) -> DataFrame | None:
    """The rows in differing leaves whose marks the version before lacks; None if no leaf differs."""
    if depth < 0:
        return None
    changed = differing_leaves(levels, saved_tree(spark, before["tree"], before["depth"], depth, fanout), fanout).withColumnRenamed("node", "leaf")
    if changed.isEmpty():
        return None
    old = spark.read.schema(MARKS).parquet(before["marks"]).join(changed.hint("merge"), "leaf", "left_semi")
    return stage(rows.join(changed.hint("merge"), "leaf", "left_semi").join(old.hint("merge"), ["leaf", "digest"], "left_anti"), "new")
