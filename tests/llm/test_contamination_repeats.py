"""Items that repeat shingles share fewer different ones with a text that holds them."""

from lattica.llm import contamination as K


def test_least_distinct():
    plain = K.shingles([f"w{k}" for k in range(40)])
    assert K.least_distinct(plain, 40) == K.least_shared(40) == 8
    for n in (4, 12, 13, 85):
        assert K.least_distinct(K.shingles([f"w{k}" for k in range(n)]), n) == K.least_shared(n)
    assert K.least_distinct(K.shingles(["x"] * 12 + [f"w{k}" for k in range(90)]), 102) == 1
    assert K.least_distinct(K.shingles(["a", "b"] * 8 + [f"w{k}" for k in range(90)]), 106) == 2


def test_one_word_twelve_times_is_found():
    items = [(k, " ".join([f"i{k}w{j}" for j in range(100)] + [f"r{k}"] * 12 + [f"i{k}v{j}" for j in range(100)])) for k in range(80)]
    index = K.Index(items)
    filler = [f"f{j}" for j in range(200)]
    missed = [k for k in range(80) if index.matches(" ".join(filler[:100] + [f"r{k}"] * 12 + filler[100:])) != [k]]
    assert missed == []
    assert index.matches(" ".join(filler[:100] + ["r0"] * 11 + filler[100:])) == []
    assert index.need.tolist() == [1] * 80
