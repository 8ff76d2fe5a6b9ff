"""Problem 9."""

import itertools

from scriptorium.llm import lookalike
from tests.conftest import values

SCHEMA = "doc_id bigint, text string, look string"


def pairs(spark, texts, **kw):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], SCHEMA)
    return values(lookalike.look_alike_pairs(df, **kw))


def test_what_looks_the_same(spark):
    assert pairs(spark, ["The éye", "Тhe éye", "The éye", "Ｔｈｅ éye", "The éye", "Th​e éye"]) == list(itertools.combinations(range(6), 2))
    assert pairs(spark, ["ﬁsh oﬃce", "fish office"]) == [(0, 1)]


def test_what_does_not(spark):
    assert pairs(spark, ["Eye", "eye", "éye", "eye!", "ey e", "oeil", "œil", "x²", "x2"]) == []
    assert pairs(spark, ["same", "same"]) == []


def test_edges(spark):
    assert pairs(spark, [None, None, "", "", "​", "x" * 50000, "х" + "x" * 49999]) == [(2, 4), (3, 4), (5, 6)]
    df = spark.createDataFrame([], SCHEMA)
    assert lookalike.look_alike_pairs(df).count() == 0 and lookalike.canonical_texts(df).count() == 0


def test_hot_class_equals_brute_force(spark):
    texts = ["Sol"] * 40 + ["Ѕol", "Sоl", "Luna"]
    want = [(i, j) for i, j in itertools.combinations(range(43), 2) if texts[i] != texts[j] and "Luna" not in (texts[i], texts[j])]
    assert sorted(pairs(spark, texts, per_slice=5)) == want


def test_classes_hold_what_the_pairs_say(spark):
    texts = ["Sol"] * 40 + ["Ѕol", "Sоl", "Luna", "Luna", None, ""]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] * 2, SCHEMA)
    assert values(lookalike.look_alike_classes(df).select("n_docs", "n_texts", "first_id")) == [(42, 3, 0)]
    assert lookalike.look_alike_classes(df.limit(0)).count() == 0


def test_canonical_form(spark):
    df = spark.createDataFrame([(1, "ѕоl λόγος вода"), (2, "sol λόγος вода"), (3, None), (4, "")], "doc_id bigint, text string")
    got = {r.doc_id: r.canonical_text for r in lookalike.canonical_texts(df).collect()}
    assert got == {1: "sol λόγος вода", 2: "sol λόγος вода", 3: None, 4: ""}
    again = spark.createDataFrame([(k, v) for k, v in got.items()], "doc_id bigint, text string")
    assert not any(r.changed for r in lookalike.canonical_texts(again).collect())
