"""Entities, editions and other records assembled from parts of many rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def expand_ranges(df: DataFrame, first: str, last: str, name: str) -> DataFrame:
    """One row per number of an inclusive range; empty and null ranges give none."""
    return df.where(F.col(first) <= F.col(last)).withColumn(name, F.explode(F.sequence(F.col(first), F.col(last))))


def rolled_up(mentions: DataFrame) -> DataFrame:
    """Entities of mentions (kind, term, book_id, page): key is the kind and the lower-case term, label the
    form on the first page of the first book. (kind, name, label, books, book_count, total_mentions); books
    is an array of (book_id, n_pages). Null terms are left out, a page counts once per entity."""
    m = mentions.where("term is not null").withColumn("name", F.lower("term"))
    per_book = m.groupBy("kind", "name", "book_id").agg(F.count_distinct("page").alias("n_pages"), F.min(F.struct("book_id", "page", "term")).alias("first"))
    return per_book.groupBy("kind", "name").agg(
        F.min("first")["term"].alias("label"),
        F.array_sort(F.collect_list(F.struct("book_id", "n_pages"))).alias("books"),
        F.count(F.lit(1)).alias("book_count"),
        F.sum("n_pages").alias("total_mentions"),
    )


def merge_entities(old: DataFrame, new: DataFrame) -> DataFrame:
    """Stored entities with those of newly indexed books: a book's new entry replaces its old one, so no book
    is in twice; counts are made anew."""
    books = lambda df, age: df.select("kind", "name", "label", F.lit(age).alias("age"), F.explode("books").alias("b")).select("kind", "name", "label", "age", "b.*")
    both = books(old, 0).unionByName(books(new, 1))
    latest = both.withColumn("rn", F.row_number().over(W.partitionBy("kind", "name", "book_id").orderBy(F.desc("age")))).where("rn = 1")
    label = both.groupBy("kind", "name").agg(F.min_by("label", F.struct("age", "label")).alias("label"))
    merged = latest.groupBy("kind", "name").agg(F.array_sort(F.collect_list(F.struct("book_id", "n_pages"))).alias("books"), F.count(F.lit(1)).alias("book_count"), F.sum("n_pages").alias("total_mentions"))
    return merged.join(label, ["kind", "name"])


def next_version(versions: DataFrame, group: str, version: str) -> DataFrame:
    """(group, next): the minor version after the greatest, by numbers; 1.0.0 if none parses."""
    parts = F.split(version, r"\.")
    n = lambda i: F.get(parts, F.lit(i)).try_cast("int")
    top = F.max(F.when(n(0).isNotNull() & n(1).isNotNull(), F.struct(n(0).alias("major"), n(1).alias("minor"), F.coalesce(n(2), F.lit(0)).alias("patch"))))
    out = versions.groupBy(group).agg(top.alias("t"))
    return out.select(group, F.coalesce(F.concat(F.col("t.major").cast("string"), F.lit("."), (F.col("t.minor") + 1).cast("string"), F.lit(".0")), F.lit("1.0.0")).alias("next"))


def supersede(editions: Column, keep: Column) -> Column:
    """An array of editions in which every published one but that with the id `keep` is superseded."""
    return F.transform(editions, lambda e: e.withField("status", F.when((e["status"] == "published") & ~e["id"].eqNullSafe(keep), "superseded").otherwise(e["status"])))


def title_page(pages: DataFrame, books: DataFrame, first: int = 5) -> DataFrame:
    """(book_id, page_id): of a book's first pages the one that names its title (two words) or author (one)
    and a printer or date; else the first with a printer or date; else its first page."""
    # Words of imprints.
    imprint = "excudebat|typis|apud|impensis|published|printed|anno|mdcc|mdccc|m\\.dc|m\\.d\\.|cum privilegio|sumptibus"
    w = W.partitionBy("book_id").orderBy("page_number", "id")
    top = pages.select("id", "book_id", "page_number", F.lower(F.coalesce("text", F.lit(""))).alias("t")).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= first)
    words = lambda c: F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda x: F.length(x) > 3)
    j = top.join(books.select(F.col("id").alias("b"), words(F.col("title")).alias("tw"), words(F.col("author")).alias("aw")), F.col("book_id") == F.col("b"))
    hits = F.size(F.filter("tw", lambda x: F.contains(F.col("t"), x)))
    named = ((F.size("tw") > 0) & (hits >= F.least(F.lit(2), F.size("tw")))) | F.exists("aw", lambda x: F.contains(F.col("t"), x))
    printed = (F.length("t") >= 50) & F.col("t").rlike(imprint)
    rank = F.when(printed & named, 0).when(printed, 1).otherwise(2)
    return j.groupBy("book_id").agg(F.min_by("id", F.struct(rank, "rn")).alias("page_id"))


def layout_verdict(samples: DataFrame, group: str, width: str, height: str, single: float = 0.9, spread: float = 1.2) -> DataFrame:
    """Whether sampled pages of a book are spreads: (group, spreads, singles, unclear, needs_splitting,
    confidence). Pages without a size don't count; a draw and an empty sample leave the verdict open."""
    ratio = F.try_divide(F.col(width), F.col(height))
    g = samples.groupBy(group).agg(F.count_if(ratio > spread).alias("spreads"), F.count_if(ratio < single).alias("singles"), F.count_if(ratio.between(single, spread)).alias("unclear"))
    n = F.col("spreads") + F.col("singles") + F.col("unclear")
    more = F.when(F.col("spreads") > F.col("singles"), True).when(F.col("singles") > F.col("spreads"), False)
    pure = (n > 0) & ((F.col("spreads") == n) | (F.col("singles") == n))
    return g.withColumn("needs_splitting", more).withColumn("confidence", F.when(more.isNull(), "low").when(pure | (F.col("unclear") == 0), "high").otherwise("medium"))


def first_due(df: DataFrame, status: str, due: str, as_of: str, tie: str) -> DataFrame:
    """The next row of a queue: without a time first, then the earliest that is due."""
    ready = (F.col("status") == status) & (F.col(due).isNull() | (F.col(due) <= F.lit(as_of).cast("timestamp")))
    return df.where(ready).orderBy(F.asc_nulls_first(due), tie).limit(1)


def remaining(all_ids: DataFrame, done: DataFrame, key: str, n: int) -> DataFrame:
    """The next n rows of a resumable job: in order, without those done."""
    return all_ids.join(done.select(F.col(key).alias("__k")).distinct(), F.col(key) == F.col("__k"), "left_anti").orderBy(key).limit(n)


def without_tree(children: DataFrame, gone: DataFrame, parent_key: str, key: str) -> DataFrame:
    """Children whose parent isn't deleted: a cascade."""
    return children.join(gone.select(F.col(key).alias("__k")), F.col(parent_key) == F.col("__k"), "left_anti")


def reply_counts(comments: DataFrame, key: str = "id", parent: str = "parent_id") -> DataFrame:
    """Comments with the number of their direct replies."""
    n = comments.where(F.col(parent).isNotNull()).groupBy(F.col(parent).alias("__p")).agg(F.count(F.lit(1)).alias("n_replies"))
    return comments.join(n, F.col(key) == F.col("__p"), "left").drop("__p").withColumn("n_replies", F.coalesce("n_replies", F.lit(0)))


def active_models(models: DataFrame, group: str, version: str) -> DataFrame:
    """All versions, of which the greatest of each group is active."""
    return models.withColumn("active", F.row_number().over(W.partitionBy(group).orderBy(F.desc(version))) == 1)


def suggested_values(rows: DataFrame, matches: DataFrame, key: str, fields: dict[str, str], least: int = 60) -> DataFrame:
    """Rows with missing or "Unknown" fields filled from their best match of at least `least` confidence;
    known values stay. matches: key, confidence and the fields' sources."""
    best = matches.where(F.col("confidence") >= least).groupBy(F.col(key).alias("__k")).agg(F.max_by(F.struct(*fields.values()), F.struct("confidence", *fields.values())).alias("m"))
    j = rows.join(best, F.col(key) == F.col("__k"), "left")
    for field, source in fields.items():
        own = F.nullif(F.nullif(F.trim(field), F.lit("")), F.lit("Unknown"))
        j = j.withColumn(field, F.coalesce(own, F.col(f"m.{source}"), F.col(field)))
    return j.drop("__k", "m")
