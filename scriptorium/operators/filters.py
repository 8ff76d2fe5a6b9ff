"""Predicates over document fields. In a document store a missing field and a null one are one thing
here; each predicate says what it does with null."""

from __future__ import annotations

import operator
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def has_text(c: Column | str, longer_than: int = 0) -> Column:
    """Not null and longer than so many code points; false for null."""
    return F.length(F.coalesce(col(c), F.lit(""))) > longer_than


def is_blank(c: Column | str) -> Column:
    """Null, missing or empty."""
    return F.coalesce(col(c), F.lit("")) == ""


def differs(c: Column | str, value) -> Column:
    """Not equal, and true for null: a filter for "anything but" keeps rows without the field."""
    return ~col(c).eqNullSafe(F.lit(value))


def none_of(c: Column | str, values: list) -> Column:
    """In none of the values; true for null unless None is among them."""
    known = [v for v in values if v is not None]
    out = F.coalesce(~col(c).isin(known), F.lit(True)) if known else F.lit(True)
    return out & col(c).isNotNull() if None in values else out


def contains_ci(c: Column | str, literal: str) -> Column:
    """Literal, case-insensitive substring; false for null."""
    return F.coalesce(F.lower(col(c)).contains(literal.lower()), F.lit(False))


def any_field_contains(fields: list[Column | str], literal: str) -> Column:
    """One of several fields contains the literal; the empty string is in every non-null field."""
    return reduce(operator.or_, [contains_ci(f, literal) for f in fields], F.lit(False))


def all_words_in(fields: list[Column | str], query: str) -> Column:
    """Every word of the query is in some field; a query without words matches all rows."""
    return reduce(operator.and_, [any_field_contains(fields, w) for w in query.split()], F.lit(True))


def any_word_in(c: Column | str, query: str) -> Column:
    """Some word of the query, taken literally, is in the field; false for null or no words."""
    words = [re.escape(w) for w in query.split()]
    return F.coalesce(col(c).rlike("(?i)" + "|".join(words)), F.lit(False)) if words else F.lit(False)


def matches_ci(c: Column | str, pattern: str) -> Column:
    """Case-insensitive regular expression; false for null."""
    return F.coalesce(col(c).rlike(f"(?i){pattern}"), F.lit(False))


def array_has(c: Column | str, value) -> Column:
    """Equality on an array field is membership; false for null and empty arrays."""
    return F.coalesce(F.array_contains(col(c), value), F.lit(False))


def any_element(c: Column | str, test) -> Column:
    """Some element passes the test; false for null and empty arrays, null elements count as failing."""
    return F.coalesce(F.exists(col(c), lambda x: F.coalesce(test(x), F.lit(False))), F.lit(False))


def non_empty(c: Column | str) -> Column:
    """An array with elements; false for null."""
    return F.coalesce(F.size(col(c)) > 0, F.lit(False))


def less_than_column(a: Column | str, b: Column | str) -> Column:
    """Column against column, a null on the left counting as 0; null on the right gives false."""
    return F.coalesce(F.coalesce(col(a), F.lit(0)) < col(b), F.lit(False))


def year_in_text(c: Column | str) -> Column:
    """The first four-digit number of a free-form year as int, null if there is none."""
    return F.regexp_extract(F.coalesce(col(c), F.lit("")), r"(\d{4})", 1).try_cast("int")


def between(c: Column | str, low=None, high=None) -> Column:
    """Range with open ends; false for null unless both ends are open."""
    tests = [col(c) >= low] * (low is not None) + [col(c) <= high] * (high is not None)
    return F.coalesce(reduce(operator.and_, tests), F.lit(False)) if tests else F.lit(True)


def within(c: Column | str, as_of: str, interval: str) -> Column:
    """Not older than an interval before a given time, so that results don't depend on the clock."""
    return col(c) >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {interval}")


def rejected(fields: list[Column | str], patterns: list[str]) -> Column:
    """Whether some field matches one of the patterns; null fields don't."""
    return reduce(operator.or_, [F.coalesce(col(f).rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(False)) for f in fields], F.lit(False))


def json_kind(c: Column | str, path: str) -> Column:
    """The type of a field of a JSON document (STRING, BIGINT, ...), whatever it is in other rows; null where it
    is missing or the text is no JSON."""
    return F.schema_of_variant(F.variant_get(F.try_parse_json(col(c)), path, "variant"))


def stale(at: Column | str, as_of: str, interval: str) -> Column:
    """Whether a stored result is older than its time to live, or was never made."""
    return F.coalesce(col(at) < F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {interval}"), F.lit(True))
