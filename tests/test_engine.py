"""Queries over whole fields, against brute force."""

from helpers import documents, s

from lattica.functions import values as V
from lattica.queries import engine

TEXTS = ["the mill", " ".join(["x"] * 12 + ["the", "The", "casa"]), " ".join(["the"] * 6 + ["y"] * 9 + ["The", "a", "boat"]), " ".join(["z"] * 40), "", " the  The "]


def run(spark, root, name, texts=TEXTS):
    spark.createDataFrame([(k, x, "s") for k, x in enumerate(texts)], "doc_id long, text string, source string").write.mode("overwrite").parquet(f"{root}/documents.parquet")
    return {r[0]: r[1] for r in engine.QUERIES[name](spark, str(root)).collect()}


def test_array_filters_see_words_after_the_twelfth(spark, tmp_path):
    words = {k: x.split(" ") for k, x in enumerate(TEXTS)}
    assert set(run(spark, tmp_path, "array_contains")) == {k for k, w in words.items() if "the" in w} == {0, 1, 2, 5}
    assert set(run(spark, tmp_path, "array_contains_any")) == {k for k, w in words.items() if {"mill", "boat", "casa"} & set(w)} == {0, 1, 2}
    assert set(run(spark, tmp_path, "array_contains_all")) == {k for k, w in words.items() if {"the", "The"} <= set(w)} == {1, 2, 5}


def test_array_transforms_take_the_whole_text(spark, tmp_path):
    words = {k: x.split(" ") for k, x in enumerate(TEXTS)}
    texts = lambda name: {r["doc_id"]: r["tags"] for r in engine.QUERIES[name](spark, str(tmp_path)).collect()}
    run(spark, tmp_path, "transform_array_union")
    assert texts("transform_array_union") == {k: " ".join([*w, *[x for x in ("the", "zzz") if x not in w]]) for k, w in words.items()}
    assert texts("transform_array_remove") == {k: " ".join(x for x in w if x not in ("the", "a")) for k, w in words.items()}
    assert run(spark, tmp_path, "transform_array_union") == {k: len(w) + ("the" not in w) + ("zzz" not in w) for k, w in words.items()}
    assert run(spark, tmp_path, "transform_array_remove") == {k: sum(x not in ("the", "a") for x in w) for k, w in words.items()}


def test_array_transforms_of_a_missing_text(spark, tmp_path):
    texts = [None, "the a b", None]
    assert run(spark, tmp_path, "transform_array_union", texts) == {0: 2, 1: 4, 2: 2}  # the operand alone, each element once
    assert run(spark, tmp_path, "transform_array_remove", texts) == {0: 0, 1: 1, 2: 0}


def test_stored_order_compares_types(spark, tmp_path):
    path = lambda k: f"tenants/kestrel-works/orders/{k:05d}"
    kinds = {path(k): {"coupon": V.NULL if k % 3 == 0 else s(f"c{k % 7}")} for k in range(1600)} | {path(9000): {"total": V.NULL}}
    documents(spark, kinds).write.parquet(f"{tmp_path}/winche_documents.parquet")
    got = [r[0] for r in engine.QUERIES["stored_order_mixed_types"](spark, str(tmp_path)).collect()]
    held = [(f["coupon"] is not V.NULL, f["coupon"].v if f["coupon"] is not V.NULL else "", p) for p, f in kinds.items() if "coupon" in f]
    assert got == [p for _, _, p in sorted(held)][: 534 + 100]
