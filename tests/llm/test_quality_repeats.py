"""Sentences that are mostly repeats are no prose."""

import pytest

from test_quality import stats

ONE = "The mill sold the old boat to the village today."


@pytest.mark.parametrize(("text", "kind"), [
    (" ".join([ONE] * 50), "junk"), ("\n".join([ONE] * 50), "junk"), ("\n\n".join([ONE] * 50), "junk"),
    (ONE, "prose"), ('"It was."\n"It was."\n"It was."', "prose"),
    (ONE + "\n" + ONE + "\nThe rain had stopped over the harbour, and it was late in the year when they found the lamp.", "prose"),
    (ONE + " It is old, and the rain had stopped.\n\nAnd so " + ONE.lower() + " It is old, and the rain had stopped.", "prose"),
    ("- lamp\n- road mill\n- bridge\n" * 10, "list"), ("a\tb\nc\td\n" * 15, "table"),
])
def test_repeats(text, kind):
    assert stats(text)["kind"] == kind
