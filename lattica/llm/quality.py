"""Per-document text quality statistics, and what texts that are not prose mainly are (problem 8).

One pass over the documents, each looked at whole and on its own, so nothing is shuffled.  Besides the usual shares
there are repetition statistics (repeated lines and paragraphs, coverage by the dominant and by repeated n-grams).
Lines are told apart by their make-up (list item, row of cells, sentence, none of these), and a set of combined rules
names a document after what most of it is.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Mapping
from functools import cached_property, lru_cache
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Marks that end a sentence, and marks that may close it afterwards.
SENTENCE_END = ".!?…。！？"
CLOSERS = "\"'”’»›“‘)]*_"

_WORD = re.compile(r"[^\W_]+")  # letters and digits of any script
_LETTERS = re.compile(r"[^\W\d_]")
_MARKS = regex.compile(r"\p{M}")
_ENDS = re.compile(rf"[{re.escape(SENTENCE_END)}][{re.escape(CLOSERS)}]*(?=\s|$)")
_LINE_END = regex.compile(rf"[\p{{P}}][{re.escape(CLOSERS)}]*$")
_MARKER = regex.compile(r"^\s*(?:[-*+•·▪◦‣○●■□–—>✓✔☐☑]|\(?\d{1,4}[.)\]:]|\(?[a-zA-Z][.)]|\(?[ivxIVX]{1,5}[.)]|\[[ xX✓]?\])\s+(?=\S)")
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,300}>|\{[^{}]{0,40}\}|&[a-z]{2,8};")
_GAP = re.compile(r"\S(?:\s{2,}|\t)(?=\S)")
_RULE = re.compile(r"^[\s|+:=_-]{3,}$")
_QUOTED = re.compile(r'"(?:[^"]|"")*"')
_BROKEN = re.compile("[\ufffd\x80-\x84\x86-\x9f]|[\u00c2\u00c3](?=[\u0080-\u00bf\u00c2\u00c3])")
_CODE = regex.compile(r"^(?:0x)?[0-9a-fA-F]{4,}$|^(?=.*\d)(?=.*\p{L}).{6,}$|^\S{28,}$")

_HINT = re.compile(r"\d[A-Za-z]|[A-Za-z]\d|\S{28}|(?<!\S)[0-9a-fA-F]{4,}(?!\S)")  # where one of these stands there may be codes

STAT_FIELDS = [
    ("n_words", pa.int64(), "long"), ("mean_word_length", pa.float64(), "double"), ("symbol_ratio", pa.float64(), "double"),
    ("punct_line_share", pa.float64(), "double"), ("common_word_share", pa.float64(), "double"),
    ("duplicate_line_share", pa.float64(), "double"), ("duplicate_paragraph_share", pa.float64(), "double"),
    ("top_ngram_coverage", pa.float64(), "double"), ("repeated_ngram_coverage", pa.float64(), "double"),
    ("sentence_share", pa.float64(), "double"), ("list_share", pa.float64(), "double"), ("table_share", pa.float64(), "double"),
    ("boilerplate", pa.bool_(), "boolean"), ("kind", pa.string(), "string"),
]

#: The rules' thresholds.
LEAST_COMMON = 0.06  # of the words of a text that reads as one
CLEARLY_COMMON = 0.15  # the same, for a text without capitals
MOST_TOP_WORD = 0.30  # of the words of a text of at least 12 words, for a word that is not common
MOST_TOP_NGRAM = 0.60  # of the word characters under the dominant n-gram
MOST_BROKEN = 0.08  # of the characters lost in decoding
MOST_CODE = 0.4  # of the tokens that are hex, keys or other strings no one reads
MOST_TAGS = 0.3  # of the characters in mark-up
SAME_CELLS = 0.7  # of the lines that have the cells of a table
ALIGNED_CELLS = 0.35  # the same where cells stand in one column, as rows may lack all but their first cell
BOILERPLATE_LINES = 0.5  # of the lines (characters) that are repeats
MOST_AGAIN = 0.6  # of the n-grams of a text that stand in it before; one that says all of it twice has a half
LEAST_REPEATED = 20  # words of a text that is no prose for its repeats; a few repeated words may be dialogue


class _Words:
    """The folded words of a text, with what several rules ask of them worked out once."""

    def __init__(self, ws: tuple[str, ...]):
        self.ws, self.counts = ws, Counter(ws)
        self.size = sum(map(len, ws))
        self._shared: tuple[Mapping | None, float] = (None, 0.0)

    def common_share(self, common: Mapping[str, frozenset[str]]) -> float:
        """Share of the words that are common in the language in which most of them are."""
        if self._shared[0] is not common:
            most = max((sum([self.counts[w] for w in self.counts.keys() & held]) for held in common.values()), default=0)
            self._shared = (common, most / len(self.ws) if self.ws else 0.0)
        return self._shared[1]

    @cached_property
    def grams(self) -> dict[int, Counter]:
        """Counts of the n-grams of 2 to 5 words, up to the first length of which none repeats, nor then does a longer one."""
        out, ws = {}, self.ws
        if len(self.counts) == len(ws):
            return out
        for n in (2, 3, 4, 5):
            if len(ws) < n:
                break
            grams = Counter(zip(*[islice(ws, i, None) for i in range(n)]))
            if len(grams) == len(ws) - n + 1:
                break
            out[n] = grams
        return out

    @cached_property
    def top_ngram(self) -> float:
        """Share of the word characters that the dominant n-gram of 2 to 4 words covers, the greatest over n."""
        best, ws = 0.0, self.ws
        for n in (2, 3, 4):
            if n not in self.grams or best >= 1.0:
                break
            times = max(self.grams[n].values())
            gram = max((g for g, t in self.grams[n].items() if t == times), key=lambda g: sum(map(len, g)))
            covered = [False] * len(ws)
            for i in range(len(ws) - n + 1):
                if ws[i] == gram[0] and ws[i : i + n] == gram:
                    covered[i : i + n] = [True] * n
            best = max(best, sum(len(w) for w, c in zip(ws, covered) if c) / self.size)
        return best

    @cached_property
    def repeated(self) -> float:
        """Share of the word characters inside 5-grams that stand more than once."""
        times = self.grams.get(5)
        if not times:
            return 0.0
        covered = [False] * len(self.ws)
        for i, g in enumerate(zip(*[islice(self.ws, i, None) for i in range(5)])):
            if times[g] > 1:
                covered[i : i + 5] = [True] * 5
        return sum(len(w) for w, c in zip(self.ws, covered) if c) / self.size

    @cached_property
    def again(self) -> float:
        """Share of the 5-grams that repeat an earlier one."""
        return 1 - len(self.grams[5]) / (len(self.ws) - 4) if 5 in self.grams else 0.0


#: A text's lines are often all one run, so its words are asked about twice in a row.
_words_of = lru_cache(maxsize=2)(_Words)


def _duplicates(parts: list[str]) -> float:
    """Share of the characters in parts that repeat an earlier one."""
    total = sum(map(len, parts))
    return (total - sum(map(len, set(parts)))) / total if total else 0.0


def cells(line: str, mark: str) -> int:
    """How many cells ``mark`` parts the line into."""
    if mark == "gap":
        return len(_GAP.findall(line.strip())) + 1 if "  " in line or "\t" in line else 1
    if mark == "|":
        return len(line.strip().strip("|").split("|"))
    if mark == "," and '"' in line:
        line = _QUOTED.sub("q", line)
    return line.count(mark) + 1


def table_lines(lines: list[str]) -> tuple[str, set[int]]:
    """The mark that parts most lines into the same number (two or more) of cells, and those lines' positions."""
    best: tuple[str, set[int]] = ("", set())
    for mark in ("\t", "|", ";", ",", "gap"):
        if mark != "gap" and not any(mark in line for line in lines):
            continue
        counts = [cells(line, mark) for line in lines]
        if mark == "gap":  # an empty cell widens a gap, so the number of cells varies a little
            fit = {i for i, (c, line) in enumerate(zip(counts, lines)) if c >= 2 and not _ENDS.search(line)}
        else:
            several = Counter(c for c in counts if c >= 2)
            if not several:
                continue
            usual = several.most_common(1)[0][0]
            fit = {i for i, c in enumerate(counts) if c == usual}
            if mark in ",;":  # marks that sentences have, too: most cells must be short
                wordy = sum(len(x.split()) > 4 for i in fit for x in re.split(mark, _QUOTED.sub("q", lines[i]))) > 0.25 * usual * len(fit)
                if wordy or usual == 2 and mark == "," and not all(_bare_cells(lines[i]) for i in fit):
                    continue
                if any(_MARKER.match(lines[i]) for i in fit):
                    continue
        if len(fit) > len(best[1]):
            best = (mark, fit)
    return best


def _aligned(lines: list[str], rows: set[int]) -> bool:
    """Whether the second cells of the rows begin in the same column, and no line is long or ends a sentence."""
    starts = Counter(m.end() for i in rows if (m := _GAP.search(lines[i])))
    return starts.most_common(1)[0][1] >= 0.9 * len(rows) and not any(_ENDS.search(x) or len(x.split()) > 2 * len(rows) + 6 for x in lines)


def _bare_cells(line: str) -> bool:
    """Two comma cells that are plainly data: quoted, or a number in one of them, without blanks after the comma."""
    return '"' in line or (", " not in line and len(line.split()) <= 4)


def _excess(counts: Counter, total: int, common: Mapping[str, frozenset[str]]) -> bool:
    """Whether one word that is common in no language makes up too much of the text."""
    least = MOST_TOP_WORD * total
    return max(counts.values()) > least and any(n > least and not any(w in held for held in common.values()) for w, n in counts.items())


def _symbols(text: str, found: list[str]) -> int:
    """Characters that are no letters, digits, marks or white space; found: the words."""
    shown = sum(map(len, text.split()))
    return shown - sum(map(len, found)) - (0 if text.isascii() else len(_MARKS.findall(text)))


def _reads_as_text(text: str, common: Mapping[str, frozenset[str]]) -> bool:
    """Whether words of a language stand here: common words among them, no word in excess, few codes and tags."""
    if ("<" in text or "{" in text or "&" in text) and sum(map(len, _TAG.findall(text))) > MOST_TAGS * len(text):
        return False
    tokens = text.split()
    odd = [t for t in tokens if len(t) > 3 and (t.isascii() or len(t) > 27)] if _HINT.search(text) else ()
    if len(odd) > MOST_CODE * len(tokens) and sum([1 for t in odd if _CODE.match(t.strip(".,;:!?\"'()“”«»*"))]) > MOST_CODE * len(tokens):
        return False
    ws = _WORD.findall(text.casefold())
    if not ws:
        return False
    held = _words_of(tuple(ws))
    counts = held.counts
    # a text of nearly all different words has no dominant n-gram
    if len(ws) >= 12 and (_excess(counts, len(ws), common) or len(counts) < 0.85 * len(ws) and held.top_ngram > MOST_TOP_NGRAM):
        return False
    if len(_BROKEN.findall(text)) > MOST_BROKEN * len(text):
        return False
    share = held.common_share(common)
    if share >= LEAST_COMMON and (share >= CLEARLY_COMMON or text != text.lower()):
        return True  # short common words also turn up among random letters, but there nothing is capitalised
    # a few words may do without: then they must look like a sentence
    return len(ws) <= 8 and text.strip()[:1].isupper() and bool(_ENDS.search(text)) and len(ws) >= 2


def line_kinds(text: str, common: Mapping[str, frozenset[str]]) -> dict[str, int]:
    """Characters of the text by what their lines are: sentence, list, table or other."""
    lines = [x for x in text.splitlines() if x.strip()]
    size = Counter({"sentence": 0, "list": 0, "table": 0, "other": 0})
    mark, rows = table_lines(lines)
    body = [i for i in range(len(lines)) if not _RULE.match(lines[i])]
    fit = len(rows & set(body))
    # every second line of cells would do in a text with headings, were they not fewer than the rows
    if not (fit >= 2 and fit >= (ALIGNED_CELLS if mark == "gap" and _aligned(lines, rows) else SAME_CELLS) * len(body)):
        rows = set()
    elif sum(bool(_ENDS.search(lines[i])) for i in rows) > 0.5 * len(rows):
        rows = set()  # lines of sentences that happen to have as many commas
    bare: list[list[str]] = [[]]
    spoken = False
    for i, line in enumerate(lines):
        s = line.strip()
        if i in rows or (rows and (_RULE.match(line) or mark == "gap" and fit < SAME_CELLS * len(body))):
            size["table"] += len(s)
            bare.append([])
        elif m := _MARKER.match(line):
            item = line[m.end():]
            whole = len(item.split()) >= 4 and _ENDS.search(item) and _reads_as_text(item, common)
            # a long dash opens speech; a line that is cut off counts as the sentences before it
            open_ended = len(item.split()) > 9 or line.lstrip().startswith("—") or spoken
            reads = spoken = bool(whole or open_ended and _reads_as_text(item, common))
            size["sentence" if reads else "list" if _item(item) else "other"] += len(s)
            bare.append([])
        else:
            bare[-1].append(s)
    for run in bare:
        if run:
            _bare_run(run, size, common)
    return size


def _item(text: str) -> bool:
    """Whether something a person could read stands in a list item."""
    return bool(_LETTERS.search(text)) and not (sum(map(len, _TAG.findall(text))) > MOST_TAGS * len(text))


def _bare_run(run: list[str], size: Counter, common: Mapping[str, frozenset[str]]) -> None:
    """Lines without markers that follow each other: wrapped or single sentences, plain items, or neither."""
    joined = " ".join(run)
    ended = len(_ENDS.findall(joined))
    if ended:
        # lines before the first and after the last sentence may still be headings; they count with the sentences
        size["sentence" if _reads_as_text(joined, common) else "other"] += sum(map(len, run))
        return
    if len(run) >= 3 and _plain_items(run):
        size["list"] += sum(map(len, run))
        return
    size["sentence" if _reads_as_text(joined, common) else "other"] += sum(map(len, run))


def _plain_items(run: list[str]) -> bool:
    """Whether lines without any sentence end are items, one to a line, rather than one sentence wrapped or scraps."""
    tokens = [t for x in run for t in x.split()]
    if sum(bool(_CODE.match(t)) for t in tokens) > 0.25 * len(tokens) or any(_TAG.search(x) for x in run):
        return False
    counts = Counter(t.casefold() for t in tokens)
    if len(tokens) >= 12 and counts.most_common(1)[0][1] > MOST_TOP_WORD * len(tokens):
        return False
    longest = max(map(len, run))
    body = run[1:] if run[0][:1].isupper() and not run[1][:1].isupper() else run  # a heading over small items
    wrapped = len(run) >= 2 and longest > 40 and all(len(x) > 0.7 * longest for x in run[1:-1]) and any(x[:1].islower() for x in run[1:])
    return not wrapped and sum(len(x.split()) for x in body) <= 10 * len(body) and not all(len(x.split()) == 1 and len(x) > 24 for x in body)


def statistics(text: str | None, common: Mapping[str, frozenset[str]]) -> tuple:
    """The values of STAT_FIELDS for one text; zeros, and a null kind, for a null or blank one."""
    if text is None or not text.strip():
        return (0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, False, None)
    if text.isascii():  # folding then changes no length
        found = ws = _WORD.findall(text.lower())
    else:
        found = _WORD.findall(text)
        ws = [w.casefold() for w in found]
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    paragraphs = [p.strip() for p in re.split(r"\n\s*\n", text) if p.strip()]
    size = line_kinds(text, common)
    total = sum(size.values()) or 1
    share = {k: v / total for k, v in size.items()}
    held = _words_of(tuple(ws))
    top, repeated, dup, dup_paragraphs = held.top_ngram, held.repeated, _duplicates(lines), _duplicates(paragraphs)
    kind = max(("sentence", "list", "table", "other"), key=lambda k: (size[k], k == "sentence"))
    kind = {"sentence": "prose", "list": "list", "table": "table", "other": "junk"}[kind]
    boilerplate = max(dup, dup_paragraphs) > BOILERPLATE_LINES or len(ws) >= LEAST_REPEATED and repeated > 0.6
    if kind == "prose" and boilerplate and len(ws) >= LEAST_REPEATED and (max(dup, dup_paragraphs) > BOILERPLATE_LINES or held.again > MOST_AGAIN):
        kind = "junk"  # sentences, but mostly the same ones
    return (
        len(ws), sum(map(len, found)) / len(found) if found else 0.0, _symbols(text, found) / len(text),
        sum(bool(_LINE_END.search(x)) for x in lines) / len(lines), held.common_share(common),
        dup, dup_paragraphs, top, repeated, share["sentence"], share["list"], share["table"],
        boilerplate, kind)


def _common(common_words: DataFrame) -> dict[str, frozenset[str]]:
    rows = common_words.where(F.col("lang").isNotNull() & F.col("word").isNotNull()).select("lang", "word").distinct().limit(200_001).collect()
    if len(rows) > 200_000:
        raise ValueError("more than 200,000 common words")
    out: dict[str, set[str]] = {}
    for r in rows:
        out.setdefault(r["lang"], set()).add(r["word"].casefold())
    return {k: frozenset(v) for k, v in out.items()}


def text_statistics(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """doc_id and the statistics of each document's whole text; one row for each row of ``documents``.

    documents: doc_id, text.  common_words: lang, word (at most 200,000, which is checked).  A null or blank text has
    zeros and a null ``kind``; otherwise ``kind`` is prose, list, table or junk.  Without common words a text reads as
    such only by its sentences' form.  Words are runs of letters and digits; the share of common words is that of the
    best fitting language, as the stored language is often wrong.
    """
    common = _common(common_words)
    names = ["doc_id", *[n for n, _, _ in STAT_FIELDS]]
    types = [pa.int64(), *[t for _, t, _ in STAT_FIELDS]]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [statistics(t.as_py(), common) for t in b.column(1)]
            cols = [b.column(0), *([pa.array([r[i] for r in rows], t) for i, t in enumerate(types[1:])])]
            yield pa.RecordBatch.from_arrays(cols, names)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(measure, "doc_id long, " + ", ".join(f"{n} {t}" for n, _, t in STAT_FIELDS))


def not_prose(statistics_: DataFrame) -> DataFrame:
    """(doc_id, kind) of the documents that are not natural prose."""
    return statistics_.where(F.col("kind").isin("list", "table", "junk")).select("doc_id", "kind")
