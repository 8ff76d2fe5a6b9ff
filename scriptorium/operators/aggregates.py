"""Aggregations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.operators.ranking import order_statistics


def count_where(df: DataFrame, **tests: Column) -> DataFrame:
    """Many counts of one table in one scan; 0 where nothing matches, null tests count as false."""
    return df.agg(*[F.count_if(t).alias(n) for n, t in tests.items()])


def half_up(c: Column, digits: int = 0) -> Column:
    """Rounding with halves up, also below zero: floor(x + 0.5)."""
    p = 10**digits
    return F.floor(c * p + 0.5) / p if digits else F.floor(c + 0.5)


def half_even(c: Column, digits: int = 0) -> Column:
    """Rounding with halves to the even digit."""
    return F.bround(c, digits)


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, halves up, 0 where the whole is 0 or null."""
    return F.coalesce(F.when(whole > 0, half_up(part * 100 / whole)), F.lit(0)).cast("int")


def usage_by(df: DataFrame, dims: list[Column], cost: Column, failed: Column, **sums: Column) -> DataFrame:
    """Calls, failures, cost and sums by any dimensions; sums of nothing are 0."""
    return df.groupBy(*dims).agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(failed).alias("failed"),
        F.coalesce(F.sum(cost), F.lit(0)).alias("cost"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in sums.items()],
    )


def nearest_rank(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """The value at place floor(n * share) of each group's values in order, from 0 and at most the last.
    Exact for groups of any size (see order_statistics)."""
    n = F.col("__n")
    return order_statistics(df, keys, value, {name: F.least(F.floor(n * s), n - 1) for name, s in shares.items()}).drop("__n")


def percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], few: int = 2_000_000, **measures: Column) -> DataFrame:
    """Measures of each group, and percentiles, linear between the two nearest values. Exact for groups of
    any size: tables of at most `few` rows, which are counted, are aggregated at once, larger ones by
    order_statistics, with the same result. Groups without values have null percentiles."""
    plain = [c.alias(n) for n, c in measures.items()]
    if df.select(F.lit(1)).limit(few + 1).count() <= few:
        return df.groupBy(*keys).agg(*plain, *[F.percentile(value, F.lit(s)).alias(n) for n, s in shares.items()])
    at = lambda s: (F.col("__n") - 1) * F.lit(s)
    low, high = {f"__lo_{n}": F.floor(at(s)) for n, s in shares.items()}, {f"__hi_{n}": F.ceil(at(s)) for n, s in shares.items()}
    found = order_statistics(df, keys, value, low | high, few=few)
    between = lambda n, s: F.col(f"__lo_{n}") + (F.col(f"__hi_{n}") - F.col(f"__lo_{n}")) * (at(s) - F.floor(at(s)))
    tails = found.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[between(n, s).alias(n) for n, s in shares.items()])
    groups = df.groupBy(*keys).agg(*plain, F.lit(1).alias("__one"))
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
    return groups.join(tails, on, "left").select(*keys, *measures, *shares)


def inverted_index(df: DataFrame, term: str, place: str) -> DataFrame:
    """(term, places, n_places): distinct places in order; null terms and places are left out. For places
    within one book or corpus of bounded size per term."""
    pairs = df.where(F.col(term).isNotNull() & F.col(place).isNotNull()).select(term, place).distinct()
    return pairs.groupBy(term).agg(F.array_sort(F.collect_list(place)).alias("places"), F.count(F.lit(1)).alias("n_places"))


def tallies(df: DataFrame, a: str, b: str, winner: str, keys: list[str] | None = None) -> DataFrame:
    """Wins, losses and ties per condition; each judgment counts for both of its conditions."""
    sides = F.explode(
        F.array(
            F.struct(F.col(a).alias("condition"), (F.col(winner) == "a").alias("won"), (F.col(winner) == "b").alias("lost")),
            F.struct(F.col(b).alias("condition"), (F.col(winner) == "b").alias("won"), (F.col(winner) == "a").alias("lost")),
        )
    )
    long = df.select(*(keys or []), sides.alias("s")).select(*(keys or []), "s.*")
    return long.groupBy(*(keys or []), "condition").agg(
        F.count_if("won").alias("wins"), F.count_if("lost").alias("losses"), F.count_if(~F.coalesce("won", F.lit(False)) & ~F.coalesce("lost", F.lit(False))).alias("ties")
    )


def rollup_counts(df: DataFrame, dims: list[str], **measures: Column) -> DataFrame:
    """Group, subtotals and total in one pass; `level` is the grouping id."""
    return df.rollup(*dims).agg(F.grouping_id().alias("level"), *[c.alias(n) for n, c in measures.items()])


def cube_counts(df: DataFrame, dims: list[str], **measures: Column) -> DataFrame:
    """All combinations of dimensions in one pass; `level` is the grouping id."""
    return df.cube(*dims).agg(F.grouping_id().alias("level"), *[c.alias(n) for n, c in measures.items()])
