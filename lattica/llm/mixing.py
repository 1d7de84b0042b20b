"""Mixing sources to target weights (problem 7).

Sizes are tokens of a public tokenizer.  Every source gets a quota of tokens.  The expected number of copies of a
document is its source's quota over the source's tokens, times the document's weight if weights are given (raised
for the others where documents end at their cap); its whole
part is allocated to every document, and the fraction is the document's inclusion probability in a Pareto order
sample (Rosen 1997): documents are ranked by the odds of a random number divided by the odds of inclusion, and taken
from the lowest rank until the quota is filled.  The random numbers are hashes of the document ids, so a task that
runs again draws the same ones.

The place in the ranking at which a quota is filled is found without sorting a source in one task: ranks fall into
bins, the tokens of the bins are added up, and only the bin in which the quota is crossed is looked at more closely,
in finer bins, until a bin holds few documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.sources.shared import stage

#: Default place of the tokenizer's vocabulary; a parameter everywhere.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Bins per round of the search for a quota's place, and documents that one round may leave to be ranked one by one.
BINS, LAST = 4096, 20_000
#: Equal rows that one array lists when they are told apart.
CHUNK = 65_536
#: Most steps towards the rate at which a weighted source meets its quota.
STEPS = 60
#: A size of the mix: as many tokens as the sources with targets have.
AVAILABLE = "available"
_loaded: dict = {}


def _tokenizer(path: str):
    if path not in _loaded:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        _loaded[path] = t
    return _loaded[path]


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens): tokens of the whole ``text``, 0 for a null or empty one; rows as they stand."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(tokenizer)
        for b in batches:
            texts, counts = [x or "" for x in b.column(2).to_pylist()], []
            for i in range(0, len(texts), 64):
                counts += [len(e) for e in t.encode_batch_fast(texts[i : i + 64], add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.int64())], ["doc_id", "source", "tokens"])

    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    return source.mapInArrow(count, "doc_id long, source string, tokens long")


def quotas(targets: list[tuple[str, float, int]], available: dict[str, int], total: float | str | None = None) -> dict[str, float]:
    """Tokens each source shall give.

    Without ``total``: the largest size at which every source that has any tokens meets its share of them all within
    its repeats; one tiny source makes that tiny.  With it: each source's share of ``total``, cut where its repeats
    end.  ``AVAILABLE`` as total: the tokens of all sources that can give any.
    """
    able = {s: (share, available[s] * repeats) for s, share, repeats in targets if share > 0 and repeats > 0 and available.get(s, 0) > 0}
    if not able:
        return {}
    if total == AVAILABLE:
        size = sum(available[s] for s in able)
    else:
        size = total if total is not None else min(most / share for share, most in able.values())
    return {s: min(size * share, most) for s, (share, most) in able.items()}


def _targets(targets: DataFrame) -> list[tuple[str, float, int]]:
    rows = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max("target_share").alias("s"), F.max("max_repeats").alias("r")).limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("more than 100,000 sources have targets")
    return [(r["source"], float(r["s"] or 0), int(r["r"] or 0)) for r in rows]


def mix(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, total: float | str | None = None, seed: int = 7, weights: DataFrame | None = None) -> DataFrame:
    """(doc_id, source, tokens, copies) of the selected documents, ``copies`` >= 1.

    documents: doc_id, text, source.  targets: source, target_share, max_repeats (of repeated sources the greatest
    values hold; null is 0).  weights: doc_id, weight >= 0 (once per id), relative within a source; a missing or null
    weight is 1, a negative or NaN one 0.  Documents of weight 0 and of sources without a target, with a null source or with no tokens are never selected.
    A source gives the tokens of its quota to within one document; whole copies never exceed ``max_repeats``.
    Repeated rows are documents of their own; equal ones are interchangeable.  Empty tables give no rows.
    """
    spark = documents.sparkSession
    wanted = _targets(targets)
    schema = "doc_id long, source string, tokens long, copies long"
    if not wanted:
        return spark.createDataFrame([], schema)
    sized = token_counts(documents, tokenizer)
    named = spark.createDataFrame([(s, r) for s, _, r in wanted], "source string, max_repeats long")  # bounded by _targets
    sized = sized.join(F.broadcast(named), "source").where(F.col("tokens") > 0)
    if weights is not None:
        sized = sized.join(weights.select("doc_id", F.col("weight").cast("double").alias("weight")), "doc_id", "left")
    weight = F.when(F.isnan("weight") | (F.col("weight") < 0), F.lit(0.0)).otherwise(F.coalesce("weight", F.lit(1.0))) if weights is not None else F.lit(1.0)
    sized = sized.withColumn("weight", weight)
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11) + F.lit(0.5)) / F.lit(float(2**53))
    sized = stage(sized.select("doc_id", "source", "tokens", "max_repeats", "weight", uniform.alias("u")), "sized")
    totals = {r["source"]: r["tokens"] for r in sized.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}
    quota = quotas(wanted, totals, total)
    rates = _rates(sized, {s: float(q) for s, q in quota.items()}, weights is not None, totals)
    if not rates:
        return spark.createDataFrame([], schema)
    rated = sized.join(F.broadcast(spark.createDataFrame([(s, r) for s, (_, r) in rates.items()], "source string, rate double")), "source")
    expected = F.least(F.col("rate") * F.col("weight"), F.col("max_repeats").cast("double"))
    whole = F.floor(expected + F.lit(1e-9)).cast("long")
    rated = rated.withColumn("whole", whole).withColumn("part", F.greatest(expected - F.col("whole"), F.lit(0.0)))
    # Pareto rank: odds of the random number over odds of inclusion, monotonically mapped into (0, 1)
    ratio = (F.col("u") / (1 - F.col("u"))) / (F.col("part") / (1 - F.col("part")))
    sampled = (F.col("part") > 0) & (F.col("whole") < F.col("max_repeats"))
    ranked = rated.select("doc_id", "source", "tokens", "whole", F.when(sampled, ratio / (1 + ratio)).alias("rank"))

    given = {r["source"]: r["t"] for r in ranked.groupBy("source").agg(F.sum(F.col("whole") * F.col("tokens")).alias("t")).collect()}
    left = {s: q - float(given.get(s, 0)) for s, (q, _) in rates.items()}
    cuts = _places(ranked.where(F.col("rank").isNotNull()).select("source", "rank", "tokens", "doc_id"), left)
    if not cuts:
        return ranked.select("doc_id", "source", "tokens", F.col("whole").alias("copies")).where(F.col("copies") > 0)
    cut_df = spark.createDataFrame([(s, *c) for s, c in cuts.items()], "source string, cut_rank double, cut_doc long, cut_tokens long, cut_rows long")
    chosen = ranked.join(F.broadcast(cut_df), "source", "left")
    # structs compare with nulls first, as the running sum sorts them
    place, end = (F.struct(F.col(r).alias("rank"), F.col(d).alias("doc_id"), F.col(t).alias("tokens")) for r, d,
        t in (("rank", "doc_id", "tokens"), ("cut_rank", "cut_doc", "cut_tokens")))
    cuttable = F.col("rank").isNotNull() & F.col("cut_rank").isNotNull()
    chosen = chosen.withColumn("place", F.when(cuttable & (place < end), "before").when(cuttable & ~(place > end), "at").otherwise("after"))
    apart = chosen.where(F.col("place") != "at").select("doc_id", "source", "tokens", (F.col("whole") + (F.col("place") == "before").cast("long")).alias("copies"))
    # rows equal to the last one taken are interchangeable: cut_rows of them get a copy more
    many = chosen.where(F.col("place") == "at").groupBy("doc_id", "source", "tokens", "whole", "cut_rows").agg(F.count(F.lit(1)).alias("n"))
    begun = many.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(CHUNK).cast("long"))).alias("at"))
    each = begun.select("*", F.explode(F.sequence(F.col("at"), F.least(F.col("at") + F.lit(CHUNK), F.col("n")) - 1)).alias("k"))
    tied = each.select("doc_id", "source", "tokens", (F.col("whole") + (F.col("k") < F.col("cut_rows")).cast("long")).alias("copies"))
    return apart.unionByName(tied).where(F.col("copies") > 0)


def _rates(sized: DataFrame, quota: dict[str, float], weighted: bool, totals: dict[str, int]) -> dict[str, tuple[float, float]]:
    """For each source its quota and the expected copies of a document of weight 1 with which the quota is met.

    Expected copies end at ``max_repeats``; what a capped document cannot give is shared out among the others by raising
    their rate until the quota holds.  The tokens given are a concave function of the rate, made of straight pieces that
    end where documents reach their cap, so Newton's steps from below end at the exact rate after no more steps than there
    are pieces, in practice a few; each is one aggregation for all sources.  Documents of weight 0 give nothing: a quota
    beyond what the others can give is cut.
    """
    if not weighted:
        return {s: (q, q / totals[s]) for s, q in quota.items()}
    spark = sized.sparkSession
    cap = F.col("max_repeats").cast("double")
    most = {r["source"]: r["t"] for r in sized.where("weight > 0").groupBy("source").agg(F.sum(F.col("tokens") * cap).alias("t")).collect()}
    quota = {s: min(q, most[s]) for s, q in quota.items() if most.get(s)}
    done, rate = {}, {s: 0.0 for s in quota}
    for _ in range(STEPS):
        if not rate:
            break
        known = spark.createDataFrame(list(rate.items()), "source string, rate double")
        each = F.col("rate") * F.col("weight")
        pieces = sized.where("weight > 0").join(F.broadcast(known), "source").groupBy("source").agg(
            F.sum(F.col("tokens") * F.least(each, cap)).alias("given"), F.sum(F.when(each < cap, F.col("tokens") * F.col("weight"))).alias("slope")).collect()
        for r in pieces:
            s, at = r["source"], rate[r["source"]]
            short = quota[s] - r["given"]
            if r["slope"] and short > 1e-9 * quota[s]:
                rate[s] = at + short / r["slope"]
            else:
                done[s] = (quota[s], rate.pop(s))
    return done | {s: (quota[s], r) for s, r in rate.items()}


def _places(ranked: DataFrame, left: dict[str, float]) -> dict[str, tuple[float, int | None, int, int]]:
    """For each source the last (rank, doc_id, tokens) taken, and how many rows equal in these: ranked documents are taken until the tokens come nearest to what is left.

    Each round adds up the tokens of BINS bins per source and goes on inside the bin that crosses the quota; the sums stay
    on the cluster, and one row per source comes back.  When that bin holds no more than LAST documents they are ranked one by one.
    """
    from pyspark.sql import Window

    spark, out = ranked.sparkSession, {}
    open_ = {s: (0.0, 1.0, 0.0) for s, need in left.items() if need > 0}  # source -> bin's low, high, tokens before it
    for _ in range(6):
        if not open_:
            break
        ranges = spark.createDataFrame([(s, lo, hi, left[s] - seen) for s, (lo, hi, seen) in open_.items()], "source string, lo double, hi double, need double")
        inside = ranked.join(F.broadcast(ranges), "source").where((F.col("rank") >= F.col("lo")) & (F.col("rank") <= F.col("hi")))
        bins = (
            inside.withColumn("bin", F.least(F.floor((F.col("rank") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1)))
            .groupBy("source", "need", "bin").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"), F.min("rank").alias("first"), F.max("rank").alias("last"))
        )
        # at most BINS rows a source
        running = bins.withColumn("before", F.sum("t").over(Window.partitionBy("source").orderBy("bin")) - F.col("t"))
        crossing = F.min(F.when(F.col("before") + F.col("t") >= F.col("need"), F.struct("bin", "n", "first", "last", "before"))).alias("c")
        found = running.groupBy("source").agg(crossing, F.max("last").alias("top")).collect()
        close: dict[str, tuple[float, float, float]] = {}
        seen_now = {s: open_.pop(s)[2] for s in list(open_)}
        for r in found:
            s, c = r["source"], r["c"]
            if c is None:  # all of them are needed
                out[s] = (r["top"], 2**63 - 1, 2**63 - 1, 0)
            elif c["n"] <= LAST or c["first"] == c["last"]:
                close[s] = (c["first"], c["last"], seen_now[s] + c["before"])
            else:
                open_[s] = (c["first"], c["last"], seen_now[s] + c["before"])
        if close:
            out |= _in_bin(ranked, left, close)
    for s, (_, high, _) in open_.items():  # not reached: six rounds tell 2**72 ranks apart
        out[s] = (high, 2**63 - 1, 2**63 - 1, 0)
    return out


def _in_bin(ranked: DataFrame, left: dict[str, float], close: dict[str, tuple[float, float, float]]) -> dict[str, tuple[float, int | None, int, int]]:
    """The last document taken inside a bin of few documents (or of equal ranks), by a running sum over its different rows."""
    from pyspark.sql import Window

    spark = ranked.sparkSession
    ranges = spark.createDataFrame([(s, a, b, seen, left[s]) for s, (a, b, seen) in close.items()], "source string, lo double, hi double, seen double, need double")
    inside = ranked.join(F.broadcast(ranges), "source").where((F.col("rank") >= F.col("lo")) & (F.col("rank") <= F.col("hi")))
    equal = inside.groupBy("source", "rank", "doc_id", "tokens", "seen", "need").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("source").orderBy("rank", "doc_id", "tokens")
    before = equal.withColumn("before", F.col("seen") + F.sum(F.col("tokens") * F.col("n")).over(order) - F.col("tokens") * F.col("n"))
    # take the crossing document when that comes nearer to the quota than leaving it out
    fit = F.floor((F.col("need") - F.col("before")) / F.col("tokens") + F.lit(0.5))
    taken = before.withColumn("rows", F.least(fit, F.col("n")).cast("long")).where(F.col("rows") > 0)
    last = taken.groupBy("source").agg(F.max(F.struct("rank", "doc_id", "tokens", "rows")).alias("m")).collect()
    found = {r["source"]: tuple(r["m"]) for r in last}
    import math

    return {s: found.get(s, (math.nextafter(a, -1.0), 2**63 - 1, 2**63 - 1, 0)) for s, (a, _, _) in close.items()}


def shares(selection: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source with a target: target share, documents, copies, tokens and the share it really has of all tokens."""
    per = selection.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col("tokens")).alias("tokens"))
    whole = per.agg(F.sum("tokens")).scalar()
    wanted = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    joined = wanted.join(per, "source", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    actual = F.coalesce(F.try_divide(F.coalesce(F.col("tokens"), F.lit(0)), whole), F.lit(0.0))
    return joined.select("source", "target_share", "max_repeats", zero("documents"), zero("copies"), zero("tokens"), actual.alias("actual_share"))
