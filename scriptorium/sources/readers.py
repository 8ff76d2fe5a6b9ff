"""Sources: documents, line files, manifests and lists of page images, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_documents(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Files of one JSON document (or list of documents) each. Files that don't parse give a row of nulls
    with their text in _corrupt_record, if the schema has it."""
    return spark.read.schema(schema).json(path, multiLine=True)


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good, bad): parsed lines, and the lines that aren't JSON. Empty lines are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r._corrupt").isNotNull()
    return parsed.where(~bad).select("r.*").drop("_corrupt"), parsed.where(bad).select("value")


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header and a given schema."""
    return spark.read.schema(schema).csv(path, header=True)


MANIFEST = "struct<`@id`:string,label:string,sequences:array<struct<canvases:array<struct<`@id`:string,label:string,width:int,height:int,images:array<struct<resource:struct<`@id`:string,service:struct<`@id`:string>>>>>>>>>"


def manifest_pages(manifests: DataFrame, text: str = "value", first: int | None = None, last: int | None = None) -> DataFrame:
    """Pages of image manifests (a column of their JSON): one row per canvas of the first sequence, numbered
    from 1, with label, size and image address. first and last cut a range of pages, which is numbered
    from 1 again. Manifests that don't parse or have no canvases give no rows."""
    m = manifests.select(*[c for c in manifests.columns if c != text], F.from_json(text, MANIFEST).alias("m"))
    canvases = m.select(*[c for c in manifests.columns if c != text], F.col("m.`@id`").alias("manifest_id"), F.posexplode(F.get("m.sequences", F.lit(0))["canvases"]).alias("at", "c"))
    low, high = max((first or 1) - 1, 0), last
    kept = canvases.where(F.col("at") >= low) if high is None else canvases.where((F.col("at") >= low) & (F.col("at") < high))
    image = F.get("c.images", F.lit(0))["resource"]
    return kept.select(*[c for c in manifests.columns if c != text], "manifest_id", (F.col("at") - low + 1).alias("page_number"), F.col("c.label").alias("label"), F.col("c.width").alias("width"), F.col("c.height").alias("height"), image["@id"].alias("image"), image["service"]["@id"].alias("service"))


def archive_pages(items: DataFrame, address: str = "https://example.org/{id}/page/{n}.jpg") -> DataFrame:
    """Pages of archived scans. items: identifier, and the three places where a number of pages may stand, in
    the order of trust: image_count, listed files (file_names) and the scan description (scandata). One row
    per page 0..n-1; items without any number give none."""
    files = F.nullif(F.size(F.filter(F.coalesce("file_names", F.array().cast("array<string>")), lambda f: F.lower(f).rlike(r"\.(jp2|jpe?g|tiff?|png)$"))), F.lit(0))
    listed = F.nullif(F.regexp_count(F.coalesce("scandata", F.lit("")), F.lit("<page ")), F.lit(0))
    n = F.coalesce(F.nullif(F.col("image_count"), F.lit(0)), files, listed)
    rows = items.withColumn("n_pages", n).where("n_pages > 0").select("identifier", "n_pages", F.explode(F.sequence(F.lit(0), F.col("n_pages") - 1)).alias("n"))
    before, _, after = address.partition("{id}")
    mid, _, end = after.partition("{n}")
    return rows.select("identifier", (F.col("n") + 1).alias("page_number"), F.concat(F.lit(before), "identifier", F.lit(mid), F.col("n").cast("string"), F.lit(end)).alias("photo"))


def file_pages(books: DataFrame, files: str = "page_files") -> DataFrame:
    """Pages from a book's list of image files, in their order; empty names are skipped."""
    kept = books.withColumn(files, F.filter(files, lambda f: F.coalesce(F.trim(f), F.lit("")) != ""))
    return kept.select("book_id", F.posexplode(files).alias("at", "photo")).select("book_id", (F.col("at") + 1).alias("page_number"), "photo")


def collection_books(collections: DataFrame, books: DataFrame) -> DataFrame:
    """Curated collections (with nested books) joined with the library's books; entries without a book there
    are left out. (collection, place, book_id, title, n_pages)"""
    entries = collections.select(F.col("id").alias("collection"), F.posexplode("books").alias("place", "e"))
    lib = books.select(F.col("id").alias("book_id"), "title", F.coalesce(F.nullif(F.col("pages_count"), F.lit(0)), F.lit(0)).alias("n_pages"))
    return entries.join(lib, F.col("e.bookId") == F.col("book_id")).select("collection", "place", "book_id", "title", "n_pages")


def enriched_metrics(raw: DataFrame, received_at: str = "received_at") -> DataFrame:
    """Client metrics with what the server adds: the first forwarded address and a shortened agent."""
    from scriptorium.functions import text

    return raw.select("*", text.first_ip(F.col("forwarded")).alias("ip"), F.substring("user_agent", 1, 200).alias("agent")).drop("forwarded", "user_agent")
