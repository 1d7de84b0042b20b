"""Evaluation texts inside training text (problem 6).

Size-partitioned MinHash containment search after LSH Ensemble (Zhu, Nargesian, Pu, Miller: VLDB 2016), with the small
query sets (items) indexed and the large side (documents) streamed past them.

Items and documents are cut into windows of at most ``WINDOW`` words that overlap so far that every run of twelve words
lies whole in one of them, so the sets of four-word shingles are of bounded size however long a text is.  A signature is
a one-permutation MinHash (Li, Owen, Zhang: NIPS 2012): the hash values of a window fall into bins by their leading bits
and the least value of each bin is kept, so making it takes one pass over the shingles whatever the number of bins.  Items
are partitioned by the size of their sets, and a partition has as many bins as keep the chance of missing a case below
``MISS``, given the least overlap that makes a case.  That overlap is small by the definition of a case, so each bin is
a band of its own.  A minimum of few bins is one of more bins, too, hence one signature of a document, with the most bins
that any partition has, meets the items of all partitions.  Candidates are verified by exact containment: of four-word
shingles, then of the words themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.words import words, words_of_all

#: A case: so many consecutive words of the item, or so large a share of its words in runs of at least RUN words.
LONG_RUN, SHARE, RUN = 12, 0.8, 4
#: Words of a window and of the overlap of two.
WINDOW, OVERLAP = 64, LONG_RUN - 1
#: Shingles of a window, and from the start of one to the start of the next.
WIDE, STEP = WINDOW - RUN + 1, WINDOW - OVERLAP
#: Greatest chance that MinHash misses a case.
MISS = 1e-7
#: Items, and words of items, indexed at once (some 40 bytes a word); more of them mean more passes over the documents.
BLOCK, BLOCK_WORDS = 50_000, 4_000_000
#: Characters of documents looked at together, and words whose hashes are remembered.
GROUP, KNOWN = 2_000_000, 1 << 18

_LONG = b"\x01" * (LONG_RUN - RUN + 1)
_ODD = np.random.default_rng(0x9E3779B97F4A7C15).integers(1, 2**63, RUN, np.uint64) * np.uint64(2) + np.uint64(1)


class _Hashes(dict):
    """64-bit hashes of words; so many are remembered."""

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < KNOWN:
            self[word] = h
        return h


_hashes = _Hashes()


def shingles(ws: list[str]) -> np.ndarray:
    """64-bit hashes of the runs of RUN words, in text order."""
    n = len(ws) - RUN + 1
    if n < 1:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, ws), np.uint64, len(ws))
    mixed = reduce(np.add, (h[k : k + n] * _ODD[k] for k in range(RUN)))
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return mixed


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sets of so many shingles, one after the other, cut into windows: the shingles' places and the windows they are in."""
    many = np.where(lengths > WIDE, -(-(lengths - WIDE) // STEP) + 1, lengths > 0)
    text = np.repeat(np.arange(len(lengths)), many)
    ends = np.cumsum(lengths)
    begin = (ends - lengths)[text] + (np.arange(len(text)) - (np.cumsum(many) - many)[text]) * STEP
    sizes = np.minimum(WIDE, ends[text] - begin)
    window = np.repeat(np.arange(len(text)), sizes)
    return (begin - np.cumsum(sizes) + sizes)[window] + np.arange(int(sizes.sum())), window


def signature(values: np.ndarray, window: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The least value of each window's bins, of which there are two to the power of ``bits``, and the windows."""
    order = np.lexsort((values, window))
    values, window = values[order], window[order]
    bins = values >> np.uint64(64 - bits)
    least = np.ones(len(values), bool)
    least[1:] = (window[1:] != window[:-1]) | (bins[1:] != bins[:-1])
    return values[least], window[least]


def least_shared(n_words: int) -> int:
    """Shingles that an item of so many words shares at least with a text that holds it, by either part of the definition."""
    covered = math.ceil(SHARE * n_words - 1e-9)
    by_share = math.ceil(covered / RUN)  # runs of exactly RUN words have one shingle each
    return min(by_share, LONG_RUN - RUN + 1) if n_words >= LONG_RUN else by_share


def least_distinct(runs: np.ndarray, n_words: int) -> int:
    """Lower bound of the distinct shingles that an item of these shingles, in text order, shares with a text that holds it."""
    _, at = np.unique(runs, return_inverse=True)
    if len(runs) == len(np.unique(at)):
        return least_shared(n_words)
    covers = np.sort(np.bincount(at) * RUN)[::-1]  # words under all places of a shingle, at most
    by_share = int(np.searchsorted(np.cumsum(covers), math.ceil(SHARE * n_words - 1e-9))) + 1
    long = LONG_RUN - RUN + 1
    return min([by_share, *[len(set(at[i : i + long].tolist())) for i in range(len(at) - long + 1)]])


def bits_for(shared: int, size: int, miss: float = MISS) -> int:
    """The bins' bits with which an item window of ``size`` shingles is missed with no more than the chance ``miss``.

    A shared shingle fails if another one of the two windows' is less in its bin, which has at most the chance
    (shingles of both) / (2 * bins); a case is missed if all its shared shingles fail.
    """
    return min(62, math.ceil(math.log2((min(size, WIDE) + WIDE) / 2 * miss ** (-1 / shared))))


def _distinct(key: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different (key, owner), in this order."""
    order = np.lexsort((owner, key))
    key, owner = key[order], owner[order]
    once = np.ones(len(key), bool)
    once[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    return key[once], owner[once]


class _Holders:
    """Which items hold a key."""

    def __init__(self, key: np.ndarray, owner: np.ndarray):
        key, self.owner = _distinct(key, owner)
        self.key, first = np.unique(key, return_index=True)
        self.at = np.append(first, len(key))

    def of(self, keys: np.ndarray, asking: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(who asked, item) for each item that holds one of the keys."""
        if not len(self.key) or not len(keys):
            return np.empty(0, np.int64), np.empty(0, np.int32)
        place = np.minimum(np.searchsorted(self.key, keys), len(self.key) - 1)
        hit = self.key[place] == keys
        place = place[hit]
        many = self.at[place + 1] - self.at[place]
        ends = np.cumsum(many)
        return np.repeat(asking[hit], many), self.owner[np.repeat(self.at[place] - ends + many, many) + np.arange(ends[-1] if len(ends) else 0)]


class Index:
    """Signatures of a block of items by size partition, and what their verification needs."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.texts, self.runs, shared, sizes = [], [], [], [], []
        for item_id, text in items:
            ws = words(text)
            if len(ws) >= RUN:
                self.ids.append(item_id)
                self.texts.append(" ".join(ws))
                self.runs.append(shingles(ws))
                shared.append(least_distinct(self.runs[-1], len(ws)))
                sizes.append(len(ws))
        self.sizes, self.need = np.array(sizes, np.int64), np.array(shared, np.int64)
        # partitions: sizes within a factor of two, each with the bins that its hardest item needs
        classes = np.array([int(n - 1).bit_length() for n in sizes], np.int64)
        self.partitions = []
        keys, owners = [np.empty(0, np.uint64)], [np.empty(0, np.int32)]
        for c in sorted(set(classes.tolist())):
            members = np.flatnonzero(classes == c)
            bits = max(bits_for(shared[m], len(self.runs[m])) for m in members)
            self.partitions.append((c, len(members), bits))
            lengths = np.array([len(self.runs[m]) for m in members], np.int64)
            at, window = windows(lengths)
            least, of = signature(np.concatenate([self.runs[m] for m in members])[at], window, bits)
            text = np.repeat(members, np.where(lengths > WIDE, -(-(lengths - WIDE) // STEP) + 1, 1))
            keys.append(least)
            owners.append(text[of].astype(np.int32))
        self.bits = max((b for _, _, b in self.partitions), default=1)
        self.band = _Holders(np.concatenate(keys), np.concatenate(owners))
        everything = np.concatenate([np.empty(0, np.uint64), *self.runs])
        self.shingle = _Holders(everything, np.repeat(np.arange(len(self.runs), dtype=np.int32), [len(r) for r in self.runs]))

    def candidates(self, hashed: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, item) pairs of which some windows agree in some bin and that share enough shingles, in order.

        The texts' shingles lie one after the other, ``lengths`` of each.
        """
        at, window = windows(lengths)
        least, of = signature(hashed[at], window, self.bits)
        text = np.repeat(np.arange(len(lengths)), np.where(lengths > WIDE, -(-(lengths - WIDE) // STEP) + 1, lengths > 0))
        pairs = np.unique(self._pairs(*self.band.of(least, text[of])))
        # exact containment for these: how many different shingles of the item the text has
        asked = np.zeros(len(lengths), bool)
        asked[pairs // max(1, len(self.ids))] = True
        text = np.repeat(np.arange(len(lengths)), lengths)
        mine = asked[text]
        found, times = np.unique(self._pairs(*self.shingle.of(*_distinct(hashed[mine], text[mine]))), return_counts=True)
        pairs = np.intersect1d(pairs, found[times >= self.need[found % max(1, len(self.ids))]], assume_unique=True)
        return pairs // max(1, len(self.ids)), pairs % max(1, len(self.ids))

    def _pairs(self, text: np.ndarray, item: np.ndarray) -> np.ndarray:
        return text.astype(np.int64) * len(self.ids) + item

    def find(self, texts: list[str]) -> Iterator[tuple[int, int]]:
        """(place of the text, item id) for each item that one of the texts holds."""
        ws, counts = words_of_all(texts)
        starts = np.cumsum([0, *counts])
        whole = shingles(ws)
        lengths = np.maximum(np.array(counts, np.int64) - RUN + 1, 0)
        # shingles that begin in the last words of a text would run into the next
        inside = np.repeat(starts[:-1] - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))
        hashed = whole[inside] if len(whole) else np.empty(0, np.uint64)
        ends = np.cumsum(lengths)
        seen, mine, known = -1, hashed[:0], hashed[:0]
        for text, item in zip(*[x.tolist() for x in self.candidates(hashed, lengths)]):
            if text != seen:
                seen, mine = text, hashed[ends[text] - lengths[text] : ends[text]]
                known = np.sort(mine)
            if _may_hold(_in(known, self.runs[item]), int(self.sizes[item])) and self._holds(item, ws[starts[text] : starts[text + 1]], mine):
                yield text, self.ids[item]

    def _holds(self, item: int, ws: list[str], hashed: np.ndarray) -> bool:
        """Whether the words hold the item; only where its shingles stand are they looked at."""
        at = np.flatnonzero(_in(np.sort(self.runs[item]), hashed)).tolist()
        runs = {tuple(ws[p : p + RUN]) for p in at}
        long = LONG_RUN - RUN
        long_runs = {tuple(ws[p : p + LONG_RUN]) for p, q in zip(at, at[long:]) if q == p + long}
        return holds(self.texts[item].split(" "), runs, long_runs)

    def matches(self, text: str | None) -> list[int]:
        """Ids of the items the text holds."""
        return [i for _, i in self.find([text])] if text else []


def _in(known: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which of ``wanted`` are among the sorted ``known``."""
    if not len(known):
        return np.zeros(len(wanted), bool)
    return known[np.minimum(np.searchsorted(known, wanted), len(known) - 1)] == wanted


def _may_hold(present: np.ndarray, n_words: int) -> bool:
    """Whether shingles present in these places can be a long run or cover enough of the item."""
    if _LONG in present.tobytes():
        return True
    bits = int.from_bytes(np.packbits(present).tobytes()) << 8  # room for the words of the last shingle
    covered = reduce(int.__or__, (bits >> k for k in range(RUN)))
    return covered.bit_count() >= SHARE * n_words - 1e-9


def holds(item: list[str], runs: set, long_runs: set) -> bool:
    """Whether a text with these runs of words holds the item, by the words themselves."""
    if long_runs and any(r in long_runs for r in zip(*[islice(item, i, None) for i in range(LONG_RUN)])):
        return True
    covered = end = 0
    for i, r in enumerate(zip(*[islice(item, i, None) for i in range(RUN)])):
        if r in runs:
            covered += i + RUN - max(i, end)
            end = i + RUN
    return covered >= SHARE * len(item) - 1e-9


def _groups(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Texts in groups of at most GROUP characters (a longer one alone), and where each begins; null is no text."""
    begin, held, size = 0, [], 0
    for i, t in enumerate(texts):
        t = t or ""
        if held and size + len(t) > GROUP:
            yield begin, held
            begin, held, size = i, [], 0
        held.append(t)
        size += len(t)
    if held:
        yield begin, held


def _blocks(items: Iterator, most: int) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of at most ``most`` and about BLOCK_WORDS words."""
    held, size = [], 0
    for r in items:
        held.append((r["item_id"], r["text"]))
        size += r["text"].count(" ") + 1
        if len(held) >= most or size >= BLOCK_WORDS:
            yield held
            held, size = [], 0
    if held:
        yield held


def leaked_items(documents: DataFrame, items: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id) of each document whose text holds an evaluation item.

    documents: doc_id, text.  items: item_id, text.  A document holds an item if twelve or more consecutive words of
    it stand consecutively in the text, or if four fifths of its words lie in runs of four or more words consecutive
    in both.  Null and blank texts and items hold nothing and are held by nothing; items of fewer than four words can
    not be held.  Rows with a null id are left out.  Repeated rows give one pair.  The items pass in blocks of
    ``block`` items and BLOCK_WORDS words at most, each broadcast to the documents' tasks; documents are never shuffled for
    the search, and their texts are compared whole.
    """
    spark = documents.sparkSession
    schema = "doc_id long, item_id long"
    source = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text").toLocalIterator()
    out = None
    for chunk in _blocks(rows, block):
        index = spark.sparkContext.broadcast(Index(chunk))

        def search(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            held = index.value
            for b in batches:
                ids, docs, found = b.column(0).to_pylist(), [], []
                for begin, texts in _groups(b.column(1).to_pylist()):
                    for place, item in held.find(texts):
                        docs.append(ids[begin + place])
                        found.append(item)
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(found, pa.int64())], ["doc_id", "item_id"])

        part = source.mapInArrow(search, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out.distinct()


def leak_report(leaks: DataFrame, items: DataFrame) -> DataFrame:
    """Each item with its suite and the number of documents that hold it, 0 for items that never leaked."""
    per_item = leaks.groupBy("item_id").agg(F.count(F.lit(1)).alias("leaked"))
    return items.select("item_id", "suite").distinct().join(per_item, "item_id", "left").select("item_id", "suite", F.coalesce("leaked", F.lit(0)).alias("documents"))
