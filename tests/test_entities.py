"""Entities, editions, links and queues on small frames."""

import datetime as dt

from pyspark.sql import functions as F

from scriptorium.functions import links, markup
from scriptorium.operators import entities
from tests.conftest import values


def test_roll_up_and_merge(spark):
    m = spark.createDataFrame([("person", "Paracelsus", "b1", 2), ("person", "paracelsus", "b1", 2), ("person", "PARACELSUS", "b2", 1), ("person", None, "b1", 1)], "kind string, term string, book_id string, page int")
    e = entities.rolled_up(m)
    assert values(e.select("name", "label", "book_count", "total_mentions")) == [("paracelsus", "Paracelsus", 2, 2)]
    newer = entities.rolled_up(spark.createDataFrame([("person", "Paracelsus", "b2", p) for p in (1, 5, 9)], m.schema))
    merged = entities.merge_entities(e, newer).first()
    assert (merged.book_count, merged.total_mentions) == (2, 4) and [b.book_id for b in merged.books] == ["b1", "b2"]


def test_versions(spark):
    v = spark.createDataFrame([("a", "1.9.0"), ("a", "1.10.3"), ("b", "x"), ("c", None)], "g string, v string")
    assert values(entities.next_version(v, "g", "v")) == [("a", "1.11.0"), ("b", "1.0.0"), ("c", "1.0.0")]
    e = spark.createDataFrame([([("1", "published"), ("2", "published"), ("3", "draft")],)], "e array<struct<id:string,status:string>>")
    assert [x.status for x in e.select(entities.supersede(F.col("e"), F.lit("2"))).first()[0]] == ["superseded", "published", "draft"]


def test_queue_and_remaining(spark):
    t = dt.datetime(2024, 1, 1)
    q = spark.createDataFrame([("a", "queued", t), ("b", "queued", None), ("c", "done", None), ("d", "queued", dt.datetime(2030, 1, 1))], "id string, status string, due timestamp")
    assert entities.first_due(q, "queued", "due", "2025-01-01", "id").first().id == "b"
    assert entities.first_due(q.where("id <> 'b'"), "queued", "due", "2025-01-01", "id").first().id == "a"
    assert values(entities.remaining(q.select("id"), q.where("id = 'a'").select("id"), "id", 2)) == [("b",), ("c",)]


def test_trees_ranges_models(spark):
    c = spark.createDataFrame([("1", None), ("2", "1"), ("3", "1"), ("4", "9")], "id string, parent_id string")
    assert values(entities.reply_counts(c).select("id", "n_replies")) == [("1", 2), ("2", 0), ("3", 0), ("4", 0)]
    assert values(entities.without_tree(c, c.where("id = '1'").select("id"), "parent_id", "id").select("id")) == [("1",), ("4",)]
    r = spark.createDataFrame([(1, 3), (5, 4), (None, 2)], "a int, b int")
    assert values(entities.expand_ranges(r, "a", "b", "n").select("n")) == [(1,), (2,), (3,)]
    m = spark.createDataFrame([("x", 1), ("x", 2), ("y", 1)], "g string, v int")
    assert values(entities.active_models(m, "g", "v").where("active").select("g", "v")) == [("x", 2), ("y", 1)]


def test_title_page_and_suggestions(spark):
    books = spark.createDataFrame([("b", "Theatrum Chymicum", "Zetzner")], "id string, title string, author string")
    text = "theatrum chymicum praecipuos selectorum auctorum tractatus continens argentorati sumptibus"
    p = spark.createDataFrame([("p1", "b", 1.0, "x" * 60), ("p2", "b", 2.0, "anno domini " + "x" * 60), ("p3", "b", 3.0, text)], "id string, book_id string, page_number double, text string")
    assert values(entities.title_page(p, books)) == [("b", "p3")]
    assert values(entities.title_page(p.where("id <> 'p3'"), books)) == [("b", "p2")]
    assert values(entities.title_page(p.where("id = 'p1'"), books)) == [("b", "p1")]
    rows = spark.createDataFrame([("b", "Unknown", "1600"), ("c", None, None)], "id string, author string, year string")
    m = spark.createDataFrame([("b", 90, "A", "1500"), ("b", 70, "B", "1"), ("c", 50, "C", "2")], "k string, confidence int, ma string, my string")
    assert values(entities.suggested_values(rows, m.withColumnRenamed("k", "id"), "id", {"author": "ma", "year": "my"})) == [("b", "A", "1600"), ("c", None, None)]


def test_layout_verdict(spark):
    s = spark.createDataFrame([("a", 2.0, 1.0), ("a", 1.3, 1.0), ("b", 0.5, 1.0), ("b", 1.0, 1.0), ("c", 2.0, 1.0), ("c", 0.5, 1.0), ("d", None, 1.0)], "g string, w double, h double")
    assert values(entities.layout_verdict(s, "g", "w", "h").select("g", "needs_splitting", "confidence")) == [("a", True, "high"), ("b", False, "medium"), ("c", None, "low"), ("d", None, "low")]


def test_links(spark):
    df = spark.createDataFrame([("https://archive.org/download/abc/x.jpg", None), ("https://books.google.com/?id=q&x", None), ("/home/x", None), (None, "ia1"), (None, None)], "u string, ia string")
    got = [r[0] and tuple(r[0]) for r in df.select(links.image_source(F.col("u"), F.col("ia"))).collect()]
    assert got == [("archive", "abc"), ("book_search", "q"), ("own_scan", None), ("archive", "ia1"), None]
    v = spark.createDataFrame([("https://a.example.org/x",), ("http://example.org",), ("https://evil-example.org",), (None,)], "u string")
    assert [r[0] for r in v.select(links.valid_address(F.col("u"), ["example.org"])).collect()] == [True, False, False, False]
    n = spark.createDataFrame([("ocr-12345678-99",), ("other",), (None,)], "n string")
    assert [tuple(r[0]) for r in n.select(links.batch_name(F.col("n"))).collect()] == [("ocr", "12345678", 99), (None, None, None), (None, None, None)]
    box = spark.createDataFrame([("u v", (0.1, 0.2, 0.3, 0.4)), ("u", None)], "u string, b struct<x:double,y:double,width:double,height:double>")
    assert [r[0] for r in box.select(links.crop_address("/c", F.col("u"), F.col("b"))).collect()] == ["/c?url=u+v&x=0.1&y=0.2&w=0.3&h=0.4", "u"]


def test_reader_view(spark):
    df = spark.createDataFrame([("[[note: n]] [[term: t]] [[image: i]] ->## Head<-\n## ->B<-\n->c<-",)], "t string")
    assert df.select(markup.shown(F.col("t"))).first()[0] == '<note>n</note> <term>t</term>  <h2 class="text-center">Head</h2>\n<h2 class="text-center">B</h2>\n<center>c</center>'
    assert df.select(markup.shown(F.col("t"), with_notes=False)).first()[0].startswith(" <term>t</term>")
