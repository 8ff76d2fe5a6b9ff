"""Ranks and running sums that don't gather a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def split_rank(df: DataFrame, keys: list[str], unique_id: str, slices: int = 64, name: str = "rank") -> DataFrame:
    """Number the rows of each group of keys from 0, in a fixed but arbitrary order.

    A group may hold any share of all rows: it is cut by the hash of unique_id into slices, each is
    numbered by itself, and the counts of the slices before it are added. Ties of unique_id are put
    in some order. Null keys form a group. An empty table gives an empty table.
    """
    sliced = df.withColumn("__slice", F.pmod(F.xxhash64(unique_id), F.lit(slices)).cast("int"))
    counts = sliced.groupBy(*keys, "__slice").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(*keys).orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        F.col("__slice").alias("__s"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
    )
    within = F.row_number().over(W.partitionBy(*keys, "__slice").orderBy(F.xxhash64(unique_id), unique_id)) - 1
    on = F.col("__slice") == F.col("__s")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return (
        sliced.withColumn("__within", within)
        .join(offsets, on)
        .withColumn(name, F.col("__within") + F.col("__before"))
        .drop("__slice", "__within", "__before", "__s", *[f"__k{i}" for i in range(len(keys))])
    )


def split_running_sum(df: DataFrame, keys: list[str], position: Column, unique_id: str, value: str, slices: int = 64, name: str = "running") -> DataFrame:
    """Inclusive running sum of value in each group, in the order of position (a double in [0, 1)).

    The range of position is cut into slices; each is summed by itself and gets the total of the
    slices before it. Equal positions follow unique_id. Null values count as 0.
    """
    sliced = df.withColumn("__pos", position).withColumn("__slice", F.floor(F.col("__pos") * slices).cast("int"))
    worth = F.coalesce(F.col(value), F.lit(0))
    sums = sliced.groupBy(*keys, "__slice").agg(F.sum(worth).alias("__n"))
    before = W.partitionBy(*keys).orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        F.col("__slice").alias("__s"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
    )
    within = F.sum(worth).over(W.partitionBy(*keys, "__slice").orderBy("__pos", unique_id).rowsBetween(W.unboundedPreceding, 0))
    on = F.col("__slice") == F.col("__s")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return (
        sliced.withColumn("__within", within)
        .join(offsets, on)
        .withColumn(name, F.col("__within") + F.col("__before"))
        .drop("__pos", "__slice", "__within", "__before", "__s", *[f"__k{i}" for i in range(len(keys))])
    )


def run_rank(df: DataFrame, group: str, number: str, unique_id: str, span: int = 64, name: str = "rank") -> DataFrame:
    """Numbers the rows of each group from 1, by a numeric column and then unique_id.

    A group may hold any share of all rows: it is cut into runs of `span` numbers, each is numbered by
    itself, and the counts of the runs before it are added. A null number comes first.
    """
    runs = df.withColumn("__run", F.coalesce(F.floor(F.col(number) / span), F.lit(-(1 << 62))))
    counts = runs.groupBy(group, "__run").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(W.partitionBy(group).orderBy("__run").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select(F.col(group).alias("__g"), F.col("__run").alias("__r"), F.coalesce(before, F.lit(0)).alias("__before"))
    within = F.row_number().over(W.partitionBy(group, "__run").orderBy(F.asc_nulls_first(number), unique_id))
    joined = runs.withColumn("__within", within).join(offsets, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__run") == F.col("__r")))
    return joined.withColumn(name, (F.col("__within") + F.col("__before")).cast("int")).drop("__run", "__within", "__before", "__g", "__r")


def order_statistics(df: DataFrame, keys: list[str], value: str, places: dict[str, Column], slices: int = 64, few: int = 2_000_000) -> DataFrame:
    """(keys, __n, names): the values at given places (from 0) of each group's values in order; places are
    expressions of __n, the number of values.

    Exact, and no group is gathered: a sketch cuts each group into slices of about equal size, the slices
    are counted, and only the values of the slices that hold a place are ranked. Tables of at most `few`
    rows, which are counted, are ranked at once, with the same result. Null values are left out; a group
    without values has no row.
    """
    if df.select(F.lit(1)).limit(few + 1).count() <= few:
        return ranked_at_once(df, keys, value, places)
    named = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    vals = df.where(F.col(value).isNotNull()).select(*named, F.col(value).alias("__v"))
    ks = [f"__k{i}" for i in range(len(keys))]
    other = lambda d, tag: d.select(*[F.col(k).alias(f"{tag}{k}") for k in ks], *[c for c in d.columns if c not in ks])

    def same(tag: str) -> Column:
        on = F.lit(True)
        for k in ks:
            on = on & F.col(k).eqNullSafe(F.col(f"{tag}{k}"))
        return on

    cuts = vals.groupBy(*ks).agg(F.percentile_approx("__v", [i / slices for i in range(1, slices)], 1000).alias("__cuts"))
    # how many cuts are below the value: its place among them. (A lambda over the value would enter the
    # optimizer's inferred filters on the other side of the join below, where the value isn't.)
    place = F.array_position(F.sort_array(F.array_append("__cuts", F.col("__v"))), F.col("__v"))
    sliced = vals.join(other(cuts, "c"), same("c")).select(*ks, "__v", place.alias("__s"))
    values = sliced.groupBy(*ks, "__s", "__v").agg(F.count(F.lit(1)).alias("__c"))
    w = W.partitionBy(*ks)
    sizes = sliced.groupBy(*ks, "__s").agg(F.count(F.lit(1)).alias("__c"))
    spans = sizes.withColumn("__to", F.sum("__c").over(w.orderBy("__s").rowsBetween(W.unboundedPreceding, 0))).withColumn("__n", F.sum("__c").over(w))
    asked = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), c.cast("long").alias("at")) for n, c in places.items()])).alias("__a")
    at, upto = F.col("__a.at"), F.col("__to")
    wanted = spans.select(*ks, F.col("__s").alias("__ws"), "__n", "__to", (upto - F.col("__c")).alias("__before"), asked).where((at >= F.col("__before")) & (at < upto))
    wanted = wanted.select(*ks, "__ws", "__n", "__before", F.col("__a.name").alias("__name"), at.alias("__at"))
    inner = values.join(other(wanted, "w"), same("w") & (F.col("__s") == F.col("__ws")))
    ranked = inner.withColumn("__upto", F.col("__before") + F.sum("__c").over(W.partitionBy(*ks, "__s", "__name").orderBy("__v").rowsBetween(W.unboundedPreceding, 0)))
    hit = ranked.where((F.col("__at") < F.col("__upto")) & (F.col("__at") >= F.col("__upto") - F.col("__c")))
    out = hit.groupBy(*ks).agg(F.max("__n").alias("__n"), *[F.max(F.when(F.col("__name") == n, F.col("__v"))).alias(n) for n in places])
    return out.select(*[F.col(k).alias(name) for k, name in zip(ks, keys)], "__n", *places)


def ranked_at_once(df: DataFrame, keys: list[str], value: str, places: dict[str, Column]) -> DataFrame:
    """order_statistics of a table whose groups each fit a task: equal values are counted, then ranked."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    w = W.partitionBy(*keys)
    upto = F.sum("__c").over(w.orderBy("__v").rowsBetween(W.unboundedPreceding, 0))
    ranked = counts.withColumns({"__upto": upto, "__n": F.sum("__c").over(w)})
    at = lambda c: F.max(F.when((c < F.col("__upto")) & (c >= F.col("__upto") - F.col("__c")), F.col("__v")))
    return ranked.groupBy(*keys).agg(F.max("__n").alias("__n"), *[at(c).alias(n) for n, c in places.items()])


def latest_rows(df: DataFrame, key: str, version: str) -> DataFrame:
    """The row of each key with the greatest version; rows with a null key are dropped.

    Identical copies and ties leave one row. The rank limit is applied before the shuffle too, so
    that a key with many states sends few of them.
    """
    w = W.partitionBy(key).orderBy(F.col(version).desc_nulls_last())
    return df.where(F.col(key).isNotNull()).withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
