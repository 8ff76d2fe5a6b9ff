"""The parametrised interface."""

import pytest
from pyspark.sql import functions as F

from scriptorium.plans.facade import Library


@pytest.fixture(scope="module")
def lib(spark):
    return Library(spark, "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def hot(lib):
    """The book with most pages."""
    return lib.pages().groupBy("book_id").count().orderBy(F.desc("count")).first().book_id


def test_search(lib):
    out = lib.search("gold", year=1600, limit=500)
    rows = out["hits"].collect()
    assert 0 < len(rows) <= 100 or out["total"].first().n == 0
    kinds = [r.type for r in lib.search("the", limit=100)["hits"].collect()]
    assert kinds == sorted(kinds) and lib.search("the", content=False)["hits"].where("type = 'page'").count() == 0
    assert all(abs(r.y - 1600) <= 5 and r.y != 1600 for r in out["nearby"].collect())
    with pytest.raises(ValueError):
        lib.search("a")
    assert lib.search("the", has_doi=True)["hits"].count() <= lib.search("the")["hits"].count()


def test_small_searches(lib):
    labels = [r.label for r in lib.quick_search("de", 10).collect()]
    assert labels == sorted(labels, key=len)
    assert lib.catalogue("de la", limit=5).count() <= 5 and lib.catalogue("de", source="bph").where("source <> 'bph'").count() == 0


def test_in_book_and_retrieval(lib, hot):
    got = lib.in_book(hot, "mercury luna")
    assert got["pages"].count() <= 50 and got["counts"].first().n >= got["pages"].count()
    top = lib.retrieve(hot, "What is said about the mercury and the silver?").collect()
    assert [r.score for r in top] == sorted((r.score for r in top), reverse=True) and len(top) <= 15
    src = lib.sources_for("Which virtue has the mercury?").collect()
    assert len({r.book_id for r in src}) == len(src) <= 3
    page = lib.pages().where(F.col("book_id") == hot).orderBy("page_number").offset(3).first().id
    assert all(len(r.text) <= 800 for r in lib.around(page).collect())


def test_gallery(lib):
    g = lib.gallery(limit=1000)
    items = g["items"].collect()
    assert len(items) <= 200 and all(r.confidence >= 0.5 for r in items)
    by_type = {r.key: r.n for r in g["facets"].where("facet = 'type'").collect()}
    assert sum(by_type.values()) <= g["total"].first().n
    if items:
        assert lib.image(items[0].id, items[0].image_index).count() == 1
    assert lib.image("none", 0).count() == 0
    posts = lib.post_images(5).collect()
    assert len({r.book_id for r in posts}) == len(posts)
    used = lib.spark.createDataFrame([(r.id, r.image_index) for r in posts], "page_id string, image_index int") if posts else None
    if used:
        assert not {r.key for r in posts} & {r.key for r in lib.post_images(5, exclude=used).collect()}


def test_reading(lib, hot):
    b = lib.book(hot)
    assert b["book"].count() == 1 and "ocr" not in b["pages"].columns
    n = int(b["pages"].first().page_number)
    q = lib.quote(hot, n, context=True).collect()
    assert q and q[0].short_code and f"p. {n})" in q[0].citation["inline"]
    assert lib.quote("none").count() == 0 and lib.chapters(hot).count() >= 0


def test_indexes(lib, hot):
    assert lib.index(hot, "summary").count() >= 0
    e = lib.entities("summary", limit=5).collect()
    assert all(r.total_mentions >= r.book_count for r in e)
    assert lib.related(e[0].name if e else "x", "summary").count() <= 10


def test_quality_and_usage(lib):
    s = lib.qa_sample(20)
    est = s["estimate"].first()
    assert est.n <= 20 and est.pages.lower <= est.pages.point <= est.pages.upper
    by_day, by_model = lib.usage("day"), lib.usage("model")
    assert by_day.agg(F.sum("calls")).first()[0] == by_model.agg(F.sum("calls")).first()[0]
    assert lib.usage("type", start="2999-01-01").count() == 0
