"""Addresses of images and what they tell."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def page_image(cropped: Column, crop: Column, archived: Column, original: Column, photo: Column) -> Column:
    """The best image of a page: the cropped one if there is a crop, then archived, original, photo. Empty
    addresses count as missing."""
    some = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(F.when(crop.isNotNull(), some(cropped)), some(archived), some(original), some(photo))


def image_source(url: Column, archive_id: Column) -> Column:
    """Struct (provider, identifier) by the form of an image's address, else by an archive id; null where
    nothing tells."""
    u = F.coalesce(url, F.lit(""))
    archive, books = F.regexp_extract(u, r"archive\.org/download/([^/]+)", 1), F.regexp_extract(u, r"id=([^&]+)", 1)
    some = lambda c: F.nullif(c, F.lit(""))
    make = lambda p, i: F.struct(F.lit(p).alias("provider"), i.alias("identifier"))
    none = F.lit(None).cast("string")
    return (
        F.when(u.contains("archive.org"), make("archive", some(archive)))
        .when(u.contains("books.google"), make("book_search", some(books)))
        .when(u.contains("s3.amazonaws.com") | u.contains(".s3.") | u.startswith("/Users/") | u.startswith("/home/"), make("own_scan", none))
        .when(F.coalesce(archive_id, F.lit("")) != "", make("archive", archive_id))
    )


def crop_address(base: str, url: Column, box: Column) -> Column:
    """The address of a cut-out (x, y, width, height); the whole image if there is no box."""
    part = lambda n, f: F.concat(F.lit(f"&{n}="), box[f].cast("string"))
    return F.when(box.isNull(), url).otherwise(F.concat(F.lit(f"{base}?url="), F.url_encode(url), part("x", "x"), part("y", "y"), part("w", "width"), part("h", "height")))


def valid_address(url: Column, hosts: list[str]) -> Column:
    """Whether it is a secure address at one of the hosts or below; false for null."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^https://([^/:?#]+)", 1)
    ok = F.lit(False)
    for h in hosts:
        ok = ok | (host == h) | host.endswith("." + h)
    return ok


def batch_name(name: Column) -> Column:
    """Struct (kind, book, at) of a batch's display name, kind-book-time; nulls where it has another form."""
    p = lambda i: F.nullif(F.regexp_extract(F.coalesce(name, F.lit("")), r"^(ocr|translate)-([^-]+)-(\d+)$", i), F.lit(""))
    return F.struct(p(1).alias("kind"), p(2).alias("book"), p(3).cast("bigint").alias("at"))


def batch_state(state: Column) -> Column:
    """A batch's state under the name that jobs use; pending for null and empty."""
    return F.coalesce(F.nullif(F.replace(state, F.lit("BATCH_STATE_"), F.lit("JOB_STATE_")), F.lit("")), F.lit("JOB_STATE_PENDING"))
