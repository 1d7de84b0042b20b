"""Containment search against brute force."""

import random
import tracemalloc

import numpy as np

from lattica.llm import contamination as K
from lattica.llm.words import words


def brute(docs, items):
    out = set()
    for d, text in docs:
        ws = words(text)
        grams = {n: {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} for n in (4, 12)}
        for i, item in items:
            it = words(item)
            long = any(tuple(it[k : k + 12]) in grams[12] for k in range(len(it) - 11))
            covered = {j for k in range(len(it) - 3) if tuple(it[k : k + 4]) in grams[4] for j in range(k, k + 4)}
            if it and (long or len(covered) >= 0.8 * len(it) and covered):
                out.add((d, i))
    return out


def word(rng):
    return "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 5)))


def make(rng, n_docs, n_items):
    items = [(k, " ".join(word(rng) for _ in range(rng.choice([4, 5, 12, 13, 30, 60, 85])))) for k in range(n_items)]
    docs = []
    for d in range(n_docs):
        ws = [word(rng) for _ in range(rng.choice([0, 3, 20, 70, 400]))]
        for _ in range(rng.randrange(3)):
            it = rng.choice(items)[1].split()
            at = rng.randrange(len(ws) + 1)
            kind = rng.randrange(4)
            if kind == 0:
                part = it
            elif kind == 1:  # a piece around the limit
                k = rng.randrange(len(it))
                part = it[k : k + rng.randrange(10, 14)]
            elif kind == 2:  # broken into runs
                part = [w for k in range(0, len(it), 5) for w in (*it[k : k + 5], word(rng))]
            else:  # every sixth word changed
                part = [word(rng) if k % 6 == 5 else w for k, w in enumerate(it)]
            ws[at:at] = part
        docs.append((d, " ".join(ws)))
    return docs, items


def test_index_equals_brute_force():
    for seed in range(4):
        docs, items = make(random.Random(seed), 150, 60)
        index = K.Index(items)
        assert {(d, i) for d, text in docs for i in index.matches(text)} == brute(docs, items)


def test_runs_across_windows_and_very_long_texts():
    rng = random.Random(5)
    item = [word(rng) + str(k) for k in range(40)]
    index = K.Index([(1, " ".join(item))])
    filler = [f"w{k}" for k in range(30_000)]
    for at in (0, 40, 52, 53, 60, 53 * 64 - 5, 53 * 64, 53 * 128 - 11, 29_990):
        assert index.matches(" ".join(filler[:at] + item[7:19] + filler[at:])) == [1], at
        assert index.matches(" ".join(filler[:at] + item[7:18] + filler[at:])) == [], at
    spread = [w for k in range(0, 40, 4) for w in (*item[k : k + 4], *filler[k * 100 : k * 100 + 300])]
    assert index.matches(" ".join(spread)) == [1]


def test_case_accents_and_invisible_characters():
    item = "Élan vital über große Häuser ging die stille Straße entlang nach Süden fort"
    index = K.Index([(1, item)])
    shown = "xx ELAN-vi­tal, über GROSSE H​auser... ging (die) stille STRASSE\n\nentlang nach Süden fort"
    assert index.matches(shown) == [1]
    assert index.matches(item.replace(" ", "")) == []


def test_leaked_items(spark):
    docs, items = make(random.Random(8), 60, 25)
    d = spark.createDataFrame([*docs, (3, docs[3][1]), (None, docs[0][1]), (900, None), (901, " \n ")], "doc_id long, text string").selectExpr("*", "'x' AS item_id", "1 AS lang")
    i = spark.createDataFrame([*items, items[0], (None, "a b c d"), (77, None), (78, "one two three"), (79, "")], "item_id long, text string").selectExpr("*", "'s' AS suite")
    want = brute(docs, items)
    assert {tuple(r) for r in K.leaked_items(d, i).collect()} == want
    found = K.leaked_items(d, i, block=7)
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)
    assert K.leaked_items(d.limit(0), i).count() == 0 and K.leaked_items(d, i.limit(0)).count() == 0
    report = {r["item_id"]: r["documents"] for r in K.leak_report(found, i.where("item_id is not null")).collect()}
    assert report[77] == 0 and sum(report.values()) == len(want)


def test_bins_hold_the_chance_of_a_miss():
    for shared in range(1, 10):
        for size in (1, 9, 37, 61, 7997):
            assert ((min(size, K.WIDE) + K.WIDE) / 2 ** (K.bits_for(shared, size) + 1)) ** shared <= K.MISS
    # measured where misses are frequent: windows of 61 shingles of which 3 are those of an item window of 20
    rng, miss, n = np.random.default_rng(3), 0.2, 4000
    bits = K.bits_for(3, 20, miss)
    at = np.repeat(np.arange(n), K.WIDE)
    text = rng.integers(0, 2**64, (n, K.WIDE), np.uint64)
    item = np.concatenate([text[:, :3], rng.integers(0, 2**64, (n, 17), np.uint64)], axis=1)
    pairs = [set(zip(*[x.tolist() for x in K.signature(v.ravel(), w, bits)])) for v, w in ((text, at), (item, np.repeat(np.arange(n), 20)))]
    found = {w for _, w in pairs[0] & pairs[1]}
    assert 1 - len(found) / n <= miss


def test_windows_cover_every_long_run():
    lengths = np.array([0, 1, 60, 61, 62, 114, 115, 700, 0, 5])
    at, window = K.windows(lengths)
    assert np.bincount(window).max() <= K.WIDE
    held = {}
    for a, w in zip(at.tolist(), window.tolist()):
        held.setdefault(w, []).append(a)
    runs = {(w[k], w[k] + 8) for w in held.values() for k in range(len(w) - 8)}
    ends = np.cumsum(lengths)
    for begin, end in zip((ends - lengths).tolist(), ends.tolist()):
        assert all((p, p + 8) in runs for p in range(begin, end - 8)) and set(range(begin, end)) <= set(at.tolist())


def test_a_very_long_item_takes_bounded_work():
    rng = random.Random(4)
    words_ = [word(rng) + str(k) for k in range(8000)]
    text = " ".join([f"f{k}" for k in range(1000)] + words_[4000:4012] + [f"g{k}" for k in range(1000)])
    tracemalloc.start()
    index = K.Index([(1, " ".join(words_)), (2, " ".join(words_[:100]))])
    assert index.matches(text) == [1] and index.matches(" ".join(words_)) == [1, 2]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6 and max(b for _, _, b in index.partitions) <= 12


def test_texts_are_grouped_whole(monkeypatch):
    docs, items = make(random.Random(11), 40, 20)
    index = K.Index(items)
    texts = [t for _, t in docs] + [None, "with\x1emark", "ünï " + docs[0][1]]
    for size in (1, 500, 10**7):
        monkeypatch.setattr(K, "GROUP", size)
        got = {(b + p, i) for b, group in K._groups(texts) for p, i in index.find(group)}
        assert got == brute(list(enumerate(texts)), items)
