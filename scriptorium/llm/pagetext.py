"""What the page problems share: the texts of the latest states, and the lines that aren't text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.operators.ranking import latest_rows

#: A printed number in Arabic digits, of any length (l, I and O as misread digits), and one in Roman digits; of
#: those over 499 only well-formed ones of three letters and more, as words are written with d and m, too.
ARABIC = r"[0-9lIO]+"
ROMAN = r"(?:[ivxlcIVXLC]{1,12}|(?i:(?=[mdclxvi]{3})m*(?:cm|cd|d?c{0,4})(?:xc|xl|l?x{0,4})(?:ix|iv|v?i{0,4}))(?!\w))"
#: A line that holds a printed page or leaf number and nothing else.
NUMBER = rf"(?:<page-num>[^<\n]*</page-num>|[-–—\[(]?\s*(?:(?:fol|f|p|pp|pag|page|S|bl)\.?\s*)?{ARABIC}\s?[rv]?\s*[-–—\])]?\.?|[-–—\[(]?\s*{ROMAN}\s*[-–—\])]?\.?)"
#: Other lines without running text: markup elements, ornaments, closing formulas.
FURNITURE = r"(?:<([A-Za-z][\w-]*)>[^<]*</[\w-]+>|\[\[meta:[^\]]*\]\]|(?:\*\s*)+|\((?:blank)\)|FINIS\.?|Finis[^\n]{0,30}|Fin\.?|Ende\.?|The End\.?|Einde\.?|Fine\.?)"
#: A running header: every word begins with a capital letter or a digit, or a mark read in its place.
HEADING = r"(?:(?:fol\. ?\w+|p\. ?\w+|['’]?[\p{Lu}\d][^\s]*|['’.,]+[^\s]*|\d+\.?|\[\d+\]|- ?\w+ ?-|&)(?:[ \t]+|(?=\n)|$)){1,9}"
#: Hyphens that break a word at the end of a line.
HYPHENS = "-=⸗¬‐­"

TRAILING = rf"(?:(?:^|\n)[ \t]*(?:{NUMBER}|{FURNITURE})?[ \t]*)+$"
LEADING = rf"^(?:[ \t]*(?:{NUMBER}|{FURNITURE}|(?:{NUMBER}[ \t]{{2,}})?{HEADING}(?:(?<=[ \t][ \t]){NUMBER})?)?[ \t]*\n)+"


def latest_pages(pages: DataFrame, *columns: Column | str) -> DataFrame:
    """(id, book_id, page_number, columns) of the latest state of each page. Columns are computed
    before the rows are moved, so that only what is needed travels. Pages with a null id are out."""
    narrow = pages.select("id", "book_id", "page_number", "updated_at", *columns)
    return latest_rows(narrow, "id", "updated_at").drop("updated_at")


def with_next(rows: DataFrame, wanted: dict[str, str], span: int = 64) -> DataFrame:
    """Adds columns of the next row of the same book, by page number: wanted maps names to columns.

    A book may hold any share of all pages: its pages are cut into runs of `span` numbers, and the
    last page of a run takes the first page of the next run that has one. The last page of a book
    gets nulls.
    """
    run = rows.withColumn("__run", F.floor(F.coalesce(F.col("page_number"), F.lit(0.0)) / span).cast("long"))
    order = ["page_number", "id"]
    packed = F.struct(*[F.col(c).alias(n) for n, c in wanted.items()])
    firsts = run.groupBy("book_id", "__run").agg(F.min_by(packed, F.struct(*order)).alias("__first"))
    after = firsts.select(F.col("book_id").alias("__b"), F.col("__run").alias("__r"), F.lead("__first").over(W.partitionBy("book_id").orderBy("__run")).alias("__after"))
    within = run.withColumn("__next", F.lead(packed).over(W.partitionBy("book_id", "__run").orderBy(*order)))
    joined = within.join(after, (F.col("book_id") == F.col("__b")) & (F.col("__run") == F.col("__r")), "left")
    chosen = F.coalesce("__next", "__after")
    return joined.withColumns({n: chosen[n] for n in wanted}).drop("__run", "__next", "__after", "__b", "__r")
