"""Short links and citations."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions.vectorized import vectorized

# The digits of base 62.
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def encode(book_id: str | None, page: int | None) -> str | None:
    """A 24-digit hex id and a page number (1 to 65535) as one base-62 number; null if either is
    invalid."""
    if book_id is None or page is None or page != page or not re.fullmatch(r"[0-9a-fA-F]{24}", book_id) or not 1 <= page <= 65535:
        return None
    n, out = int(book_id, 16) * 65536 + int(page), ""
    while n:
        n, d = divmod(n, 62)
        out = DIGITS[d] + out
    return out or "0"


def decode(code: str | None) -> dict | None:
    """The id and page of a short link; null if it isn't one."""
    if not code or any(c not in DIGITS for c in code):
        return None
    n = 0
    for c in code:
        n = n * 62 + DIGITS.index(c)
    book, page = divmod(n, 65536)
    return {"book_id": f"{book:024x}", "page": page} if page >= 1 and book < 16**24 else None


@vectorized("string")
def shortlink(book_id: pd.Series, page: pd.Series) -> pd.Series:
    return pd.Series([encode(b, p) for b, p in zip(book_id, page)])


@vectorized("struct<book_id:string,page:int>")
def shortlink_parts(code: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([decode(c) or {"book_id": None, "page": None} for c in code], columns=["book_id", "page"])


def citations(author: Column, title: Column, published: Column, doi: Column, page: Column, translator: str, year: int) -> Column:
    """Struct of citation styles. A null author is Unknown, a null date n.d.; "Last, First" is turned round
    where the style wants it. year: of the translation."""
    who, when = F.coalesce(author, F.lit("Unknown")), F.coalesce(F.nullif(published, F.lit("")), F.lit("n.d."))
    parts = F.transform(F.split(who, ","), lambda x: F.trim(x))
    two = F.size(parts) == 2
    first_last = F.when(two, F.concat(parts[1], F.lit(" "), parts[0])).otherwise(who)
    last_first = F.when(two, F.concat(parts[0], F.lit(", "), parts[1])).otherwise(who)
    tail = lambda before, after: F.coalesce(F.concat(F.lit(before), doi, F.lit(after)), F.lit(""))
    p = page.cast("int").cast("string")
    key = F.concat(F.regexp_replace(F.lower(parts[0]), "[^a-z]", ""), when)
    return F.struct(
        F.concat(F.lit("("), parts[0], F.lit(" "), when, F.lit(", p. "), p, F.lit(")")).alias("inline"),
        F.concat(first_last, F.lit(", "), title, F.lit(f", trans. {translator} ({year}), "), p, tail(". DOI: ", ""), F.lit(".")).alias("footnote"),
        F.concat(last_first, F.lit(". "), title, F.lit(f". Translated by {translator}. {year}."), tail(" DOI: ", ".")).alias("bibliography"),
        F.concat(last_first, F.lit(". "), when, F.lit(". "), title, F.lit(f". Translated by {translator}. {year}."), tail(" https://doi.org/", ".")).alias("chicago"),
        F.concat(last_first, F.lit(". "), title, F.lit(f". Translated by {translator}, {year}."), tail(" DOI: ", ".")).alias("mla"),
        F.concat(F.lit("@book{"), key, F.lit(",\n  author = {"), last_first, F.lit("},\n  title = {"), title, F.lit("},\n  year = {"), when, F.lit(f"}},\n  translator = {{{translator}}},\n  note = {{Translation published {year}}}"), tail(",\n  doi = {", "}"), tail(",\n  url = {https://doi.org/", "}"), F.lit("\n}")).alias("bibtex"),
    )
