"""Updates as functions from a table to its next version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.operators.ranking import run_rank


def set_fields(df: DataFrame, when: Column, **values: Column) -> DataFrame:
    """New values where the condition holds; a double underscore in a name reaches into a struct. Rows where
    the condition is null stay as they are."""
    for name, value in values.items():
        top, _, field = name.partition("__")
        new = F.col(top).withField(field.replace("__", "."), value) if field else value
        df = df.withColumn(top, F.when(F.coalesce(when, F.lit(False)), new).otherwise(F.col(top)))
    return df


def increment(df: DataFrame, events: DataFrame, key: str, event_key: str, counter: str, amount: Column | None = None) -> DataFrame:
    """Adds the grouped events to a counter; null counters count as 0."""
    delta = events.groupBy(F.col(event_key).alias("__k")).agg(F.sum(F.lit(1) if amount is None else amount).alias("__d"))
    return df.join(delta, F.col(key) == F.col("__k"), "left").withColumn(counter, F.coalesce(counter, F.lit(0)) + F.coalesce("__d", F.lit(0))).drop("__k", "__d")


def add_to_set(df: DataFrame, array: str, values: Column) -> DataFrame:
    """Adds elements that aren't there yet; a null array counts as empty."""
    return df.withColumn(array, F.array_union(F.coalesce(F.col(array), F.array().cast(df.schema[array].dataType)), values))


def pull(df: DataFrame, array: str, value) -> DataFrame:
    """Removes an element wherever it occurs."""
    return df.withColumn(array, F.array_remove(array, value))


def upsert(old: DataFrame, new: DataFrame, key: str, on_insert: dict[str, Column] | None = None) -> DataFrame:
    """Rows of new replace or join those of old by key; a null in new keeps the old value. on_insert gives
    values for columns of rows that are new. Both tables must have each key once."""
    on_insert = on_insert or {}
    n = new.select(*[F.col(c).alias(f"__n_{c}") for c in new.columns])
    joined = old.withColumn("__old", F.lit(True)).join(n, F.col(key) == F.col(f"__n_{key}"), "full_outer")
    cols = []
    for c in old.columns:
        value = F.coalesce(F.col(f"__n_{c}"), F.col(c)) if c in new.columns else F.col(c)
        cols.append((F.when(F.col("__old").isNull(), on_insert[c]).otherwise(value) if c in on_insert else value).alias(c))
    return joined.select(*cols)


def archive(parents: DataFrame, children: DataFrame, key: str, child_key: str, deleted: Column, at: Column) -> DataFrame:
    """Deleted parents with their children nested in one row, as they go to an archive. For parents of a
    bounded number of children (the pages of a book)."""
    nested = children.groupBy(F.col(child_key).alias("__k")).agg(F.collect_list(F.struct(*children.columns)).alias("children"))
    return parents.where(deleted).join(nested, F.col(key) == F.col("__k"), "left").drop("__k").withColumn("deleted_at", at)


def restore(archived: DataFrame) -> DataFrame:
    """The children of archived rows again as rows."""
    return archived.select(F.explode("children").alias("c")).select("c.*")


def purgeable(archived: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Archived rows older than so many days."""
    return archived.where(F.datediff(F.lit(as_of).cast("date"), F.col("deleted_at").cast("date")) >= days)


def split_pages(pages: DataFrame, splits: DataFrame, overlap: int = 10) -> DataFrame:
    """Pages with a split position (page_id, position of 1000) become a left and a right page; all pages of
    a book are numbered anew. Adds side, x_start, x_end and number. The right page follows its left one;
    a page with several split rows is split at the first position."""
    first = splits.groupBy(F.col("page_id").alias("__p")).agg(F.min("position").alias("__at"))
    joined = pages.join(first, F.col("id") == F.col("__p"), "left")
    half = lambda s, a, b, plus: F.struct(F.lit(s).alias("side"), a.alias("x_start"), b.alias("x_end"), F.lit(plus).alias("plus"))
    at, none = F.col("__at"), F.lit(None).cast("int")
    sides = F.when(at.isNull(), F.array(half("whole", none, none, 0.0))).otherwise(
        F.array(half("left", F.lit(0), F.least(at + overlap, F.lit(1000)).cast("int"), 0.0), half("right", F.greatest(at - overlap, F.lit(0)).cast("int"), F.lit(1000), 0.5))
    )
    each = joined.withColumn("__s", F.explode(sides)).select(*pages.columns, "__s.side", "__s.x_start", "__s.x_end", (F.col("page_number") + F.col("__s.plus")).alias("__order"))
    return run_rank(each, "book_id", "__order", "id", name="number").drop("__order")


def reset_splits(pages: DataFrame) -> DataFrame:
    """Without the right halves; left halves are whole again; numbered anew. Undoes split_pages."""
    kept = pages.where(F.col("side") != "right").withColumn("side", F.lit("whole"))
    kept = kept.withColumns({"x_start": F.lit(None).cast("int"), "x_end": F.lit(None).cast("int")})
    return run_rank(kept.drop("number"), "book_id", "page_number", "id", name="number")


def snapshots(before: DataFrame, changed: DataFrame, key: str, field: str) -> DataFrame:
    """(key, field, old text) of rows about to be overwritten whose text was made by hand."""
    old = before.where((F.col(f"{field}.source") == "manual") & (F.coalesce(F.col(f"{field}.data"), F.lit("")) != ""))
    return old.join(changed.select(F.col(key).alias("__k")).distinct(), F.col(key) == F.col("__k"), "left_semi").select(key, F.lit(field).alias("field"), F.col(f"{field}.data").alias("old_text"))


def repair_orphans(children: DataFrame, parents: DataFrame, child_key: str, key: str, id_column: str, new_id: Column) -> DataFrame:
    """Children without a parent go; a missing id is filled in."""
    kept = children.join(parents.select(F.col(key).alias("__k")), F.col(child_key) == F.col("__k"), "left_semi")
    return kept.withColumn(id_column, F.coalesce(id_column, new_id))
