"""Readers, writers and streams."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from scriptorium.sources import readers, writers
from scriptorium.streaming import events
from tests.conftest import values


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"key": "p1", "n": 1}\n\nnot json\n{"key": "p2"}\n')
    good, bad = readers.json_lines(spark, str(tmp_path), "key string, n int")
    assert values(good) == [("p1", 1), ("p2", None)] and values(bad) == [("not json",)]


def test_documents_and_collections(spark, tmp_path):
    doc = {"id": "c", "totalPages": 5, "books": [{"bookId": "b1", "pages": 5}, {"bookId": "gone", "pages": 0}]}
    (tmp_path / "c.json").write_text(json.dumps(doc, indent=1))
    c = readers.json_documents(spark, str(tmp_path / "c.json"), "id string, totalPages bigint, books array<struct<bookId:string,pages:bigint>>")
    books = spark.createDataFrame([("b1", "T", 0)], "id string, title string, pages_count int")
    assert values(readers.collection_books(c, books)) == [("c", 0, "b1", "T", 0)]


def test_manifest(spark):
    canvas = lambda n: {"@id": f"c{n}", "label": f"f. {n}", "width": 10, "height": 20, "images": [{"resource": {"@id": f"img{n}", "service": {"@id": f"s{n}"}}}]}
    m = spark.createDataFrame([("b", json.dumps({"@id": "m", "sequences": [{"canvases": [canvas(1), canvas(2), canvas(3)]}]})), ("x", "{}"), ("y", "broken")], "book_id string, value string")
    assert values(readers.manifest_pages(m, first=2).select("book_id", "page_number", "image")) == [("b", 1, "img2"), ("b", 2, "img3")]
    assert readers.manifest_pages(m).count() == 3


def test_archive_and_files(spark):
    items = spark.createDataFrame([("a", 2, None, None), ("b", None, ["x.jp2", "y.txt"], None), ("c", None, None, "<page 1><page 2><page 3>"), ("d", None, None, None)], "identifier string, image_count int, file_names array<string>, scandata string")
    assert values(readers.archive_pages(items).groupBy("identifier").count()) == [("a", 2), ("b", 1), ("c", 3)]
    assert readers.archive_pages(items).where("identifier = 'a'").orderBy("page_number").first().photo.endswith("/a/page/0.jpg")
    f = spark.createDataFrame([("b", ["1.jpg", "", None, "2.jpg"])], "book_id string, page_files array<string>")
    assert values(readers.file_pages(f)) == [("b", 1, "1.jpg"), ("b", 2, "2.jpg")]


def test_metrics(spark):
    raw = spark.createDataFrame([("load", "1.1.1.1, 2.2.2.2", "A" * 300)], "name string, forwarded string, user_agent string")
    r = readers.enriched_metrics(raw).first()
    assert r.ip == "1.1.1.1" and len(r.agent) == 200


def test_writers(spark, tmp_path):
    pages = spark.createDataFrame([("b", 2.0, "q", ("", "o2"), ("t2",)), ("b", 1.0, "p", ("x", "o1"), (None,))], "book_id string, page_number double, id string, ocr struct<source:string,data:string>, translation struct<data:string>")
    assert values(writers.book_texts(pages, "both")) == [("b", "=== 1 ===\no1\n\n=== 2 ===\no2\n\nt2")]
    assert values(writers.book_texts(pages)) == [("b", "=== 2 ===\nt2")]
    lines = writers.request_lines(pages, "book_id", ["page_number"], 1, F.struct("id"))
    assert values(lines.select("file_no", "line")) == [(0, '{"id":"p"}'), (1, '{"id":"q"}')]
    writers.write_request_files(lines, "book_id", str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 2
    res = spark.createDataFrame([("p", "new"), ("q", "")], "k string, t string")
    assert values(writers.merge_results(pages, res, "id", "k", "t", "ocr").select("id", "ocr.data")) == [("p", "new"), ("q", "o2")]


MINUTES = [0, 30, 59, 60, 61, 90, 121]


@pytest.fixture
def reads(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(minutes=m), "u", "view", 1.0) for i, m in enumerate(MINUTES)]
    return spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id string, event_type string, value double")


def test_greedy_dedupe_anchors_on_the_accepted(reads):
    assert values(events.dedupe_batch(reads, ["user_id", "event_type"], "ts", "event_id").select("event_id")) == [(0,), (4,)]


def test_stream_equals_batch(spark, tmp_path, reads):
    reads.write.parquet(str(tmp_path / "in"))
    src = events.read_events(spark, str(tmp_path / "in"), reads.schema).withWatermark("ts", "1 day")
    events.run_once(events.dedupe_stream(src, ["user_id", "event_type"]), "kept", str(tmp_path / "cp"))
    assert values(spark.table("kept").select("event_id")) == [(0,), (4,)]


def test_daily_and_sliding_streams(spark, tmp_path, reads):
    reads.write.parquet(str(tmp_path / "in"))
    src = events.read_events(spark, str(tmp_path / "in"), reads.schema)
    events.run_once(events.daily_counts(src), "daily", str(tmp_path / "cp"), "complete")
    assert values(spark.table("daily").select("n")) == [(7,)]
    still = reads.withColumn("ts", F.col("ts").cast("timestamp"))
    assert events.sliding_counts(still).agg(F.sum("n")).first()[0] == 4 * 7
    assert values(events.sessions(still, gap="30 minutes").select("n")) == [(1,), (6,)]
    assert values(events.counters(still, "user_id").select("n")) == [(7,)]


def test_stream_join_and_upsert(spark, tmp_path, reads):
    reads.write.parquet(str(tmp_path / "in"))
    a = events.read_events(spark, str(tmp_path / "in"), reads.schema)
    b = events.read_events(spark, str(tmp_path / "in"), reads.schema)
    events.run_once(events.matched(a.where("event_id = 0"), b, "user_id"), "pairs", str(tmp_path / "cp"))
    assert values(spark.table("pairs").select("right_id")) == [(0,), (1,), (2,), (3,)]
    got = []
    events.upsert_each(a, str(tmp_path / "cp2"), lambda df, n: got.append(df.count()))
    assert got == [7]
