"""Joins by what they mean. Sides are left to the optimizer (AQE broadcasts small ones by their
measured size and splits skewed partitions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def lookup_one(df: DataFrame, other: DataFrame, key: str, other_key: str, prefix: str, required: bool = False) -> DataFrame:
    """Each row with the row of the other table that its key names; other's columns get a prefix, so
    names can't clash. Not required: rows without partner stay, with nulls."""
    named = other.select(*[F.col(c).alias(f"{prefix}{c}") for c in other.columns])
    return df.join(named, F.col(key) == F.col(f"{prefix}{other_key}"), "inner" if required else "left")


def lookup_measures(df: DataFrame, many: DataFrame, key: str, many_key: str, **measures: Column) -> DataFrame:
    """One-to-many: measures of the partners of each row, aggregated before the join so that no list of
    partners is built. Rows without partners get nulls."""
    agg = many.where(F.col(many_key).isNotNull()).groupBy(F.col(many_key).alias("__k")).agg(*[c.alias(n) for n, c in measures.items()])
    return df.join(agg, F.col(key) == F.col("__k"), "left").drop("__k")


def semi(df: DataFrame, keys: DataFrame, on: str, other: str | None = None) -> DataFrame:
    """Rows whose key occurs in keys; an empty keys table gives no rows."""
    return df.join(keys.select(F.col(other or on).alias("__k")), F.col(on) == F.col("__k"), "left_semi")


def anti(df: DataFrame, keys: DataFrame, on: str, other: str | None = None) -> DataFrame:
    """Rows whose key doesn't occur in keys; null keys stay."""
    return df.join(keys.select(F.col(other or on).alias("__k")), F.col(on) == F.col("__k"), "left_anti")


def mark(df: DataFrame, keys: DataFrame, on: str, flag: str, other: str | None = None) -> DataFrame:
    """All rows, with whether their key occurs in keys."""
    known = keys.select(F.col(other or on).alias("__k")).where("__k is not null").distinct().withColumn("__f", F.lit(True))
    return df.join(known, F.col(on) == F.col("__k"), "left").withColumn(flag, F.coalesce("__f", F.lit(False))).drop("__k", "__f")


def co_occurring(incidence: DataFrame, item: str, within: str, value, k: int = 10) -> DataFrame:
    """The k items that share most groups with the given item: (item, shared), ties by item. Starts
    from the item's groups, so the pairs of other items are never built."""
    groups = incidence.where(F.col(item) == value).select(F.col(within).alias("__g")).distinct()
    others = incidence.where(F.col(item) != value).select(item, within).distinct().join(groups, F.col(within) == F.col("__g"), "left_semi")
    return others.groupBy(item).agg(F.count(F.lit(1)).alias("shared")).orderBy(F.desc("shared"), item).limit(k)


def neighbours(df: DataFrame, group: str, order: str, value: str, distance: int = 1) -> DataFrame:
    """Adds before_n and after_n: the value at order - n and order + n in the same group, null where that
    place is empty. An equality join per distance, so a large group is no bottleneck; of several rows at
    one place the first by value counts."""
    at = df.groupBy(F.col(group).alias("__g"), F.col(order).alias("__o")).agg(F.min(value).alias("__v"))
    for n in range(1, distance + 1):
        for name, shift in ((f"before_{n}", -n), (f"after_{n}", n)):
            side = at.select(F.col("__g").alias("__g2"), (F.col("__o") - shift).alias("__o2"), F.col("__v").alias(name))
            df = df.join(side, (F.col(group) == F.col("__g2")) & (F.col(order) == F.col("__o2")), "left").drop("__g2", "__o2")
    return df


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, value: str, name: str) -> DataFrame:
    """Each left row with the value of the latest right row of its key at or before its time. One sort
    of both sides together; no row is copied. Null keys and times find nothing."""
    l = left.withColumn("__side", F.lit(1)).withColumn("__v", F.lit(None).cast(right.schema[value].dataType))  # noqa: E741
    r = right.select(F.col(key), F.col(time), F.lit(0).alias("__side"), F.col(value).alias("__v"))
    both = l.unionByName(r, allowMissingColumns=True)
    w = W.partitionBy(key).orderBy(time, "__side").rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn(name, F.when(F.col(key).isNotNull() & F.col(time).isNotNull(), F.last("__v", ignorenulls=True).over(w)))
    return found.where("__side = 1").drop("__side", "__v")


def in_range(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Points with the ranges [low, high] that hold them. Both sides are put into bins of a width, which
    join by equality; a range is copied once per bin it touches. Null ends match nothing."""
    p = points.withColumn("__bin", F.floor(F.col(point) / width))
    r = ranges.where(F.col(low) <= F.col(high)).withColumn("__bin", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return p.join(r, "__bin").where((F.col(point) >= F.col(low)) & (F.col(point) <= F.col(high))).drop("__bin")


def pair_blocked(left: DataFrame, right: DataFrame, left_tokens: str, right_tokens: str, left_short: str, right_short: str) -> DataFrame:
    """Candidate pairs for a fuzzy match: rows that share two tokens (array columns of distinct tokens), and
    rows that share one if both are short (boolean columns). All such pairs, however frequent a token is:
    the key is a pair of tokens, which few rows share where single tokens are common. The result has all
    columns of both sides (names must differ); null and empty arrays find nothing."""

    def keyed(df: DataFrame, unique_id: str, tokens: str, short: str) -> DataFrame:
        t = F.array_sort(F.array_distinct(F.coalesce(tokens, F.array().cast("array<string>"))))
        two = F.flatten(F.transform(t, lambda x, i: F.transform(F.slice(t, i + 2, F.size(t)), lambda y: F.xxhash64(x, y))))
        one = F.when(F.coalesce(short, F.lit(False)), F.transform(t, lambda x: F.xxhash64(x))).otherwise(F.array().cast("array<bigint>"))
        return df.select(unique_id, F.explode(F.concat(two, one)).alias("__key"))

    lid, rid = left.withColumn("__l", F.xxhash64(*left.columns)), right.withColumn("__r", F.xxhash64(*right.columns))
    pairs = keyed(lid, "__l", left_tokens, left_short).join(keyed(rid, "__r", right_tokens, right_short), "__key").select("__l", "__r").distinct()
    return pairs.join(lid, "__l").join(rid, "__r").drop("__l", "__r")
