"""Text, markup, identifier, statistics and layout functions."""

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.functions import ids, layout, markup, stats, text


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'int'}" for k, v in values.items()))
    return row.select(column).collect()[0][0]


def test_normalize_and_snippet(spark):
    assert one(spark, text.normalize_text("t"), t=" Dürer ÉTÉ ") == "durer ete"
    assert one(spark, text.snippet(F.col("t"), "gold", 3), t="the old gold ring") == "...ld gold ri..."
    assert one(spark, text.snippet(F.col("t"), "tin", 3), t="x" * 301) == "x" * 300 + "..."
    assert one(spark, text.snippet(F.col("t"), "tin"), t=None) == ""


def test_highlighted_snippets(spark):
    got = one(spark, text.highlighted_snippets("gold ring", 5)("t"), t="gold ring " + "." * 30 + " Gold")
    assert [r["position"] for r in got] == [0, 41]
    assert got[0]["snippet"].startswith("<mark>gold</mark>") and "<mark>Gold</mark>" in got[1]["snippet"]
    assert one(spark, text.highlighted_snippets("x")("t"), t=None) == []


def test_word_measures(spark):
    assert one(spark, text.word_jaccard(F.col("a"), F.col("b")), a="The art of gold", b="Art of the ring") == 50
    assert text.word_overlap("Agrippa opera", "Agrippae opera omnia") == 60
    assert text.word_overlap("", "x") == 0
    assert text.query_keywords("What does the author say about mercury?") == ["say", "mercury"]
    assert text.search_terms("mercury sulphur sal mercury philosophers") == ["philosophers", "mercury", "sulphur"]


def test_urls_and_hash(spark):
    assert one(spark, text.domain_of(F.col("u")), u="https://www.example.org/a") == "example.org"
    assert one(spark, text.domain_of(F.col("u")), u="") == "direct"
    assert one(spark, text.first_ip(F.col("u")), u=" 1.2.3.4 , 5.6.7.8") == "1.2.3.4"
    assert one(spark, text.first_ip(F.col("u")), u=None) == "unknown"
    assert one(spark, text.string_hash("u"), u="hello") == "5e918d2"
    assert one(spark, text.plausible_year(F.col("u")), u="anno 1533, 12345") == "1533"
    assert one(spark, text.replace_opening(F.col("u"), 1, F.lit("New.")), u="Old. Rest here.") == "New. Rest here."


@pytest.mark.parametrize(
    ("t", "kinds"),
    [
        ("[[note: x]]", []), ("[[notes: x]]", []), ("[[page number: 12]]", []), ("[[unclear:]]", ["empty_tag"]), ("[[note: a [[term: b]] c]]", ["nested_bracket"]),
        ("]]", ["unclosed_close"]), ("[[note: open", ["unclosed_open"]), ("[[foo: x]]", ["unknown_tag"]), ("-> a <-", []), ("-> a", ["unbalanced_center"]), ("a <-", ["unbalanced_center"]),
        ("<note></note>", ["empty_xml_tag"]), ("<note>x", ["unclosed_xml"]), ("</note>", ["unclosed_xml"]), ("<b>x</b>", ["unknown_xml_tag"]), ("<vocab>a, b</vocab>", []), ("", []),
    ],
)
def test_markup_faults(t, kinds):
    assert [i["type"] for i in markup.check(t)] == kinds


def test_repairs(spark):
    df = spark.createDataFrame([("a ]] b",), ("[[note: open",), ("<note>x",)], "t string")
    fixed = df.withColumn("i", F.get(markup.issues("t"), F.lit(0))).select(markup.repaired(F.col("t"), F.col("i"))).collect()
    assert [r[0] for r in fixed] == ["a  b", "[[note: open]]", "<note>x</note>"]


def test_migration_is_idempotent(spark):
    t = "[[note: a]] [[page number: 4]] [[vocabulary: x, y]] [[foo: z]]"
    once = one(spark, markup.migrate(F.col("t")), t=t)
    assert once == "<note>a</note> <page-num>4</page-num> <vocab>x, y</vocab> [[foo: z]]"
    assert one(spark, markup.migrate(F.col("t")), t=once) == once
    assert one(spark, markup.migration_count(F.col("t")), t=t) == 3


def test_elements(spark):
    assert one(spark, markup.terms(F.col("t"), "vocabulary"), t="<vocab>a, b</vocab> [[vocabulary: c,,d]]") == ["a", "b", "c", "d"]
    assert one(spark, markup.page_number(F.col("t")), t="[[page number: 12]]") == 12
    assert one(spark, markup.notes(F.col("t")), t="<note>x</note> [[note: y ]]") == ["y", "x"]
    assert one(spark, markup.term_kind(F.col("t")), t="Marsilio Ficino") == "person"
    m = one(spark, markup.metadata(F.col("t")), t="Here is the translation:\n<lang>Latin</lang><sig>A4</sig>Text <meta>m</meta>")
    assert (m["language"], m["signature"], m["meta"], m["clean_text"]) == ("Latin", "A4", ["m"], "Text")
    assert one(spark, markup.without_empty_tags(F.col("t")), t="a<note> </note>b[[note: ]]")["removed"] == 2


def test_summary_and_headings(spark):
    df = spark.createDataFrame([("<summary> s </summary>", "x"), ("t", "stored"), ("p" * 40 + "\n\nq", None), (None, None)], "t string, s string")
    assert [r[0] for r in df.select(markup.page_summary(F.col("t"), F.col("s"))).collect()] == ["s", "stored", None, None]
    assert one(spark, markup.page_summary(F.col("t"), F.lit(None)), t="word " * 80).endswith("...")
    h = one(spark, markup.headings(F.col("t")), t="# Liber primus\n## ->**The sun**<-\n# page 4\n# abc\n### et cetera multa\n#### deep one")
    assert [(x["level"], x["title"]) for x in h] == [(1, "Liber primus"), (2, "The sun")]


def test_demultiplex(spark):
    got = one(spark, markup.demultiplex(F.col("t"), F.lit(2)), t="x === PAGE 1 === a === PAGE 2 === b === PAGE 9 === c")
    assert [(r["ordinal"], r["text"]) for r in got] == [(1, "a"), (2, "b")]
    assert one(spark, markup.demultiplex(F.col("t"), F.lit(1)), t=" whole ")[0]["text"] == "whole"


@given(st.integers(0, 16**24 - 1), st.integers(1, 65535))
def test_shortlink_round_trip(book, page):
    b = f"{book:024x}"
    assert ids.decode(ids.encode(b, page)) == {"book_id": b, "page": page}


def test_shortlink_errors():
    assert ids.encode("xyz", 1) is None and ids.encode("0" * 24, 0) is None and ids.encode(None, 1) is None
    assert ids.decode("!!") is None and ids.decode(None) is None


def test_citations(spark):
    c = ids.citations(F.col("a"), F.lit("Title"), F.lit(None).cast("string"), F.lit("10.1/x"), F.lit(3), "the library", 2025)
    row = one(spark, c, a="Ficino, Marsilio")
    assert row["inline"] == "(Ficino n.d., p. 3)" and row["footnote"].startswith("Marsilio Ficino, Title") and row["mla"].endswith("DOI: 10.1/x.")
    assert "@book{ficinon.d.," in row["bibtex"]


def test_published_p_values(spark):
    for wins, n, want in ((17, 31, 0.59), (18, 31, 0.37)):
        assert round(one(spark, stats.binomial_p(F.col("w"), F.col("n")), w=wins, n=n), 2) == want
    assert one(spark, stats.binomial_p(F.col("w"), F.col("n")), w=30, n=31) < 0.001
    assert one(spark, stats.binomial_p(F.col("w"), F.col("n")), w=0, n=0) == 1.0
    w = one(spark, stats.wilson(F.col("w"), F.col("n")), w=0, n=0)
    assert (w["low"], w["high"]) == (0.0, 0.0)


def test_elo_is_zero_sum_and_ordered(spark):
    j = spark.createDataFrame([("e", 1, "x", "y", "a"), ("e", 2, "y", "x", "tie"), ("f", 1, "x", "y", "b")], "g string, n int, condition_a string, condition_b string, winner string")
    r = {(x.g, x.condition): x.rating for x in stats.elo(j, "g", ["n"]).collect()}
    assert r["e", "x"] + r["e", "y"] == pytest.approx(3000) and r["e", "x"] > 1500 and r["f", "y"] == 1516


def test_gutter(spark):
    img = np.full((100, 200), 230, np.uint8)
    img[:, 98:102] = 20
    img[::4, 10:80] = 50
    found = layout.detect(img.tobytes(), 200, 100)
    assert found["two_pages"] and abs(found["position"] - 500) <= 20 and not found["text_at_split"]
    assert layout.detect(None, 1, 1) is None and layout.detect(b"x", 5, 5) is None
    assert layout.detect(bytes(80), 8, 10)["two_pages"] is False
    assert 0 < layout.features(img)["text_gap_center"] < 1000


def test_model(spark):
    rows = spark.createDataFrame([(float(i), 50.0, 0.0, 1.5, 500.0) for i in range(20)], "center_darkest double, center_brightest double, edge_center_diff double, aspect_ratio double, y double")
    w = layout.train(rows, "y")
    assert rows.select(layout.predict(w, rows.columns)).first()[0] == 500
    with pytest.raises(ValueError):
        layout.train(rows.limit(5), "y")
