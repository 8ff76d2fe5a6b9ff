"""Sinks: appends, request files, text exports, feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def append(df: DataFrame, path: str, *partition_by: str) -> None:
    """Adds rows to a parquet table."""
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def request_lines(pages: DataFrame, group: str, order: list[str], per_file: int, body: Column) -> DataFrame:
    """(group, file_no, line): JSON lines of requests, at most per_file of a group in one file, numbered
    from 0 in order."""
    n = F.row_number().over(W.partitionBy(group).orderBy(*order)) - 1
    return pages.withColumn("file_no", F.floor(n / per_file).cast("int")).select(group, "file_no", *order, F.to_json(body).alias("line"))


def write_request_files(lines: DataFrame, group: str, path: str) -> None:
    """One text file per group and number."""
    lines.select(group, "file_no", F.col("line").alias("value")).repartition(group, "file_no").write.partitionBy(group, "file_no").mode("overwrite").text(path)


def book_texts(pages: DataFrame, kind: str = "translation") -> DataFrame:
    """(book_id, text): a book's pages in order under a line with their number; kind: translation, ocr or
    both. Pages without text are left out. A book is a bounded group."""
    t, o = F.coalesce("translation.data", F.lit("")), F.coalesce("ocr.data", F.lit(""))
    body = {"translation": t, "ocr": o, "both": F.concat_ws("\n\n", F.nullif(o, F.lit("")), F.nullif(t, F.lit("")))}[kind]
    rows = pages.select("book_id", "page_number", "id", body.alias("body")).where("body <> ''")
    one = F.concat(F.lit("=== "), F.col("page_number").cast("int").cast("string"), F.lit(" ===\n"), F.col("body"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("page_number", "id", one.alias("x")))), lambda s: s["x"])
    return rows.groupBy("book_id").agg(F.array_join(parts, "\n\n").alias("text"))


def sitemap_lines(books: DataFrame, pages: DataFrame, base: str) -> DataFrame:
    """(loc, changed) of every book and page."""
    b = books.select(F.concat(F.lit(f"{base}/book/"), "id").alias("loc"), F.col("updated_at").alias("changed"))
    p = pages.select(F.concat(F.lit(f"{base}/book/"), "book_id", F.lit("/page/"), "id").alias("loc"), F.col("updated_at").alias("changed"))
    return b.unionByName(p)


def merge_results(pages: DataFrame, results: DataFrame, key: str, result_key: str, text: str, target: str) -> DataFrame:
    """Pages with the texts of a batch written into target (a struct with data); of several results for one
    page the greatest text counts, empty and null texts change nothing."""
    r = results.where(F.coalesce(text, F.lit("")) != "").groupBy(F.col(result_key).alias("__k")).agg(F.max(text).alias("__t"))
    new = F.when(F.col("__t").isNotNull(), F.col(target).withField("data", F.col("__t"))).otherwise(F.col(target))
    return pages.join(r, F.col(key) == F.col("__k"), "left").withColumn(target, new).drop("__k", "__t")
