"""Problem 2."""

import pytest

from scriptorium.llm import languages
from scriptorium.session import table
from tests.conftest import values


@pytest.fixture(scope="module")
def canonical(spark):
    return table(spark, "/root/testdata/sf0.001", "canonical_languages")


# Given aliases, by entry.
ALIASES = {
    "Latin": "latina, latein, latijn, latin, lingua latina", "German": "tedesco, hochdeutsch, deutsch", "French": "français, francais, frans", "Dutch": "nederlands, dutch", "Church Slavonic": "old slavonic, slavonic",
}


@pytest.fixture(scope="module")
def aliases(spark):
    rows = [(e, a, "name") for e, names in ALIASES.items() for a in names.split(", ")] + [("German", "ger", "iso"), ("Nowhere", "nowhere", "name")]
    return spark.createDataFrame(rows, "entry string, alias string, kind string")


CASES = {
    "Latin": "Latin", "LATEIN": "Latin", "Ltaina": "Latin", "lingua latina (?)": "Latin", "[Latijn]": "Latin", "la": "Latin", "Lat.": "Latin", "tedesco": "German", "Hochdeusch": "German",
    "Français text": "French", "franc.": "French", "mostly Nederlands": "Dutch", "Dtch": "Dutch", "العربية": "Arabic", "ger": "German", "German; French": "-", "Arabic/Persian": "-",
    "Basque": "-", "Breistethaurk": "-", "?": "-", "1614": "-", "und": "-", "   ": "-", "Old-Slavonic": "Church Slavonic", "x" * 5000: "-",
}


def test_cases(spark, canonical, aliases):
    df = spark.createDataFrame([(v, "clash") for v in CASES] * 2 + [(None, None), ("", "")], "raw_value string, canonical_code string")
    got = {r.raw_value: r.canonical_code for r in languages.map_values(df, canonical, aliases).collect()}
    assert got == CASES


def test_empty(spark, canonical):
    none = spark.createDataFrame([], "raw_value string")
    assert languages.map_values(none, canonical).count() == 0
    assert values(languages.map_values(spark.createDataFrame([("Latin",)], "raw_value string"), canonical.limit(0)).select("canonical_code")) == [("-",)]


def test_typed_values(spark):
    df = spark.createDataFrame([(1, "Latin", ["a", "a", None, "", "b"]), (2, "x", None), (3, "y", [])], "lang_row_id bigint, code string, variants array<string>")
    assert values(languages.typed_values(df)) == [(1, "Latin"), (1, "a"), (1, "b"), (2, "x"), (3, "y")]


def test_aliases_are_learned(spark, canonical):
    """A value that stands beside the names of one language, in rows enough, becomes a name of it; one that
    stands beside several, or too seldom, doesn't."""
    rows = [(f"a{i}", ["Latin", "latinsky", "unbekannt"]) for i in range(4)] + [(f"b{i}", ["German", "unbekannt", None, ""]) for i in range(4)]
    rows += [(f"c{i}", ["latinsky", "lateinski"]) for i in range(3)] + [("d", ["French", "selten"]), ("d", ["French", "selten"]), ("d", ["French", "selten"]), ("e", None), ("f", [])]
    df = spark.createDataFrame(rows, "lang_row_id string, values array<string>")
    assert values(languages.learned_aliases(df, canonical).select("entry", "alias")) == [("Latin", "lateinski"), ("Latin", "latinsky")]
    assert languages.learned_aliases(df.limit(0), canonical).count() == 0
    names = languages.learned_aliases(df, canonical)
    typed = spark.createDataFrame([("Latinski",), ("Lateinsky",), ("unbekannt",)], "raw_value string")
    assert values(languages.map_values(typed, canonical, names).select("raw_value", "canonical_code")) == [("Lateinsky", "Latin"), ("Latinski", "Latin"), ("unbekannt", "-")]


def test_an_operator_without_names_to_learn(spark, canonical):
    assert values(languages.map_values(spark.createDataFrame([("Lattin",)], "raw_value string"), canonical).select("canonical_code", "how")) == [("Latin", "typo")]
