"""Words of a text as the operators of this subpackage compare them."""

from __future__ import annotations

import re
import unicodedata

import regex

#: Runs of letters and digits.
WORD = re.compile(r"[^\W_]+")
#: Marks on letters, and characters that do not show: formatting characters and controls other than white space.
UNSEEN = regex.compile(r"[\p{M}\p{Cf}ᅟᅠㅤﾠ]+|(?![\t\n\v\f\r\x1c-\x1f\x85])\p{Cc}")
ASCII_CONTROLS = regex.compile(r"[\x00-\x08\x0e-\x1b\x7f]+")


def fold(text: str) -> str:
    """``text`` without letter case, accents and invisible characters."""
    if text.isascii():
        return ASCII_CONTROLS.sub("", text.lower())
    out = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", text).casefold())
    return UNSEEN.sub("", out)


def words(text: str | None) -> list[str]:
    """Folded words of ``text``; none for null or blank text."""
    return WORD.findall(fold(text)) if text else []


def words_of_all(texts: list[str]) -> tuple[list[str], list[int]]:
    """The folded words of all texts, one after the other, and how many each has; folded together, as that is faster."""
    plain = [i for i, t in enumerate(texts) if t.isascii()]
    other = [i for i, t in enumerate(texts) if not t.isascii()]
    found: list[list[str]] = [[]] * len(texts)
    for group in (plain, other):
        if group:
            # this mark is white space, so it parts words as the texts' ends do
            folded = fold("\x1e".join([texts[i] for i in group])).split("\x1e")
            if len(folded) != len(group):  # it stands in a text, too
                folded = [fold(texts[i]) for i in group]
            for i, t in zip(group, folded):
                found[i] = WORD.findall(t)
    return [w for ws in found for w in ws], [len(ws) for ws in found]
