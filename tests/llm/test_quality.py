"""Statistics and kinds of texts."""

import pytest

from lattica.llm import quality as Q

COMMON = {"en": frozenset("the of and to in a is that it was with over for".split()), "de": frozenset("der die das und mit".split())}
NAMES = [n for n, _, _ in Q.STAT_FIELDS]


def stats(text):
    return dict(zip(NAMES, Q.statistics(text, COMMON)))


KINDS = [
    ("The mill sold the boat. It was late in the year.", "prose"), ("Lornok found the market", "prose"), ("He left.", "prose"),
    ('"The boat is in the harbour."\n"It was."', "prose"), ("— The roof is old.\n— It was painted over", "prose"),
    ("The harbour forgot the team at the edge of the town, and\nthe rain had stopped. It was in the plan that the mill\nmoved to the village over",
    "prose"), ("A heading\nThe boat was sold to the village. It is old.", "prose"),
    ("The mill sold the boat. It was late in the year and the rain had stopped.\n- bridge\n- mill road", "prose"),
    ("It was the best  of  times, and\nit was the worst of times.", "prose"),
    ("- lamp\n- road mill\n- bridge", "list"), ("1. lamp\n2. road\n3. bridge sky", "list"), ("[x] Lamp\n[ ] Road Mill", "list"),
    ("lamp road\nmill\nbridge sky\nboat", "list"), ("Things:\na) lamp;\nb) road\nc) mill", "list"),
    ("Mill behind the church\nRoad in a small room\nBoat under the trees\nLamp over the water", "list"), (" * Kitchen, 48\n * Boat station, 47\n * Song, 33", "list"),
    ("a\tb\nc\td", "table"), ("| a | 1 |\n|---|---|\n| b | 2 |", "table"), ('"a","1.5","x"\n"b","","y"', "table"), ("a;1;x\nb;2;\nc;;z", "table"),
    ("mill              12.5            boat\nroof                              lamp\nmap               3               door", "table"),
    ("2655              814.43\n2461\n1233\n1273              553.29\n3551              348.43", "table"),
    ("rskdt it qwpt aflpp elyup ord foitd lposa ooeae jokae oykh ewpyf lsega", "junk"),
    ("xqzv wrtk plmn bvcx zzkq trwq mmnb qqwe", "junk"), ("station " * 60, "junk"), ("0x1F2A deadbeef 0x33 8f3b2c1d a9b8c7d6", "junk"),
    ("aGVsbG8gd29ybGQgdGhpcyBpcyBiYXNlNjQ5MDg\nQ9xkLmN0aGVzZSBhcmUgbm90IHdvcmRz8812ab==", "junk"),
    ('<div class="a"></div><li class="b">{x:1}<td class="c"></td>', "junk"), ("#$%^ &*( )_+ {}[] |||", "junk"), ("S�n emb�rgo �� the l��via a�� ��o.", "junk"),
]


@pytest.mark.parametrize(("text", "kind"), KINDS)
def test_kinds(text, kind):
    assert stats(text)["kind"] == kind


def test_statistics():
    s = stats("The cat is in it.\nNo end here\n\nThe cat is in it.")
    assert s["n_words"] == 13 and s["mean_word_length"] == pytest.approx(sum(map(len, "The cat is in it No end here The cat is in it".split())) / 13)
    assert s["symbol_ratio"] == pytest.approx(2 / 48) and s["punct_line_share"] == pytest.approx(2 / 3) and s["common_word_share"] == pytest.approx(8 / 13)
    assert s["duplicate_line_share"] == pytest.approx(17 / 45) and s["duplicate_paragraph_share"] == 0.0
    assert stats("one\n\none\n\ntwo")["duplicate_paragraph_share"] == pytest.approx(3 / 9)
    assert stats("a b a b a b c")["top_ngram_coverage"] == pytest.approx(6 / 7)
    assert stats("v w x y z q v w x y z")["repeated_ngram_coverage"] == pytest.approx(10 / 11)
    assert stats("same line here\n" * 5)["boilerplate"] and not s["boilerplate"]


def test_null_blank_and_long_texts(spark):
    long_text = "The boat was sold to the village. " * 40_000
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \n\t"), (4, long_text), (None, "- a\n- b"), (5, "!"), (5, "!"), (6, "7")],
        "doc_id long, text string").selectExpr("*", "'z' AS kind", "1 AS n_words")
    common = spark.createDataFrame([("en", w) for w in COMMON["en"]] + [(None, "x"), ("de", None), ("en", "the")], "lang string, word string")
    got = {r["doc_id"]: r for r in Q.text_statistics(docs, common).collect()}
    assert [got[n]["kind"] for n in (1, 2, 3)] == [None] * 3 and got[1]["mean_word_length"] == 0.0
    assert got[4]["n_words"] == 280_000 and got[5]["kind"] == "junk" and got[6]["n_words"] == 1
    found = Q.not_prose(Q.text_statistics(docs, common)).collect()
    assert (None, "list") in {tuple(r) for r in found} and not {1, 2, 3} & {r["doc_id"] for r in found}
    assert Q.text_statistics(docs.limit(0), common).count() == 0 and Q.text_statistics(docs, common.limit(0)).count() == 8
