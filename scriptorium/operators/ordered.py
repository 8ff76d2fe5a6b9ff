"""Operators that depend on an order: versions, numbering, batches, top-k, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.operators.ranking import run_rank


def latest_version(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per group: the first by the given order. The limit is applied before the shuffle too."""
    return df.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def renumber(df: DataFrame, group: str, number: str, tie: str, name: str = "number") -> DataFrame:
    """Numbers 1..n in each group, without gaps, in the order of a number; groups of any size."""
    return run_rank(df, group, number, tie, name=name)


def best_per_group(df: DataFrame, group: str, score: Column, tie: str, k: int) -> DataFrame:
    """The k best rows of which no two share a group. Exact: the best row of each group is taken before
    the cut, so no over-fetching is needed."""
    scored = df.withColumn("__score", score)
    return latest_version(scored, [group], F.desc_nulls_last("__score"), F.asc(tie)).orderBy(F.desc_nulls_last("__score"), tie).limit(k).drop("__score")


def interleave(df: DataFrame, group: str, *order: Column | str, first: int, name: str = "turn") -> DataFrame:
    """Round robin over the groups, the largest first: the rows of the first `first` turns, with turn (the
    row's place in its group) and group_size; sort by turn, group_size descending, group. Each group sends
    so many rows at most from each partition, and its size comes from a count, so no group is gathered."""
    top = df.withColumn(name, F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col(name) <= first)
    sizes = df.groupBy(F.col(group).alias("__g")).agg(F.count(F.lit(1)).alias("group_size"))
    return top.join(sizes, F.col(group).eqNullSafe(F.col("__g"))).drop("__g")


def chunks(df: DataFrame, group: str, size: int, number: str, tie: str, name: str = "chunk") -> DataFrame:
    """Chunk numbers from 0, each of at most `size` rows of a group in the order of a number; groups of any
    size."""
    return run_rank(df, group, number, tie, name=name).withColumn(name, F.floor((F.col(name) - 1) / size).cast("int"))


def greedy_batches(df: DataFrame, group: str, order: list[str], size: Column, budget: int) -> DataFrame:
    """Consecutive batches of a group: a row opens a new one if it would exceed the budget, so a batch has
    at least one row. (group, batch, n_rows, total), batch from 1. The cut depends on the cut before, so
    the sizes of a group are folded in order; only order and size are gathered, and a group is meant to
    be a book. Null sizes count as 0."""
    kinds = "struct<sizes:array<struct<n:int,total:bigint>>,n:int,total:bigint>"
    start = F.from_json(F.lit('{"sizes":[],"n":0,"total":0}'), kinds)
    seq = F.sort_array(F.collect_list(F.struct(*order, F.coalesce(size, F.lit(0)).cast("bigint").alias("__size"))))

    def step(s: Column, x: Column) -> Column:
        over = (s["n"] > 0) & (s["total"] + x["__size"] > budget)
        closed = F.concat(s["sizes"], F.array(F.struct(s["n"].alias("n"), s["total"].alias("total"))))
        return F.struct(
            F.when(over, closed).otherwise(s["sizes"]).alias("sizes"),
            F.when(over, F.lit(1)).otherwise(s["n"] + 1).cast("int").alias("n"),
            F.when(over, x["__size"]).otherwise(s["total"] + x["__size"]).alias("total"),
        )

    def finish(s: Column) -> Column:
        return F.concat(s["sizes"], F.array(F.struct(s["n"].alias("n"), s["total"].alias("total"))))

    batches = df.groupBy(group).agg(seq.alias("__seq")).select(group, F.posexplode(F.aggregate("__seq", start, step, finish)).alias("batch", "b"))
    return batches.select(group, (F.col("batch") + 1).alias("batch"), F.col("b.n").alias("n_rows"), F.col("b.total").alias("total"))


def sections(df: DataFrame, group: str, start: str, last: Column) -> DataFrame:
    """Adds section_end: one before the next start of the group, and for the last section the given end."""
    nxt = F.lead(start).over(W.partitionBy(group).orderBy(start))
    return df.withColumn("section_end", F.coalesce(nxt - 1, last))


def page_of(df: DataFrame, order: list[Column], limit: int, offset: int = 0, most: int = 200) -> DataFrame:
    """A page of a sorted result; the limit is clamped to 1..most."""
    return df.orderBy(*order).offset(max(0, offset)).limit(min(max(1, limit), most))


def exact_sample(df: DataFrame, unique_id: str, n: int, seed: int = 0) -> DataFrame:
    """Exactly n rows (or all, if fewer), the same for the same seed: the first by hash. A top-k, so
    each partition sends n rows at most."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(unique_id).cast("string"))), unique_id).limit(n)


def nearest(df: DataFrame, value: str, target, within: float, k: int, tie: str) -> DataFrame:
    """The k rows whose value is nearest to the target, at most `within` away."""
    far = F.abs(F.col(value) - F.lit(target))
    return df.where(far <= within).orderBy(far, tie).limit(k)


def page_with_total(df: DataFrame, order: list[Column], limit: int, offset: int = 0, most: int = 200) -> DataFrame:
    """A page of a sorted result with the number of all rows (total) and whether rows follow (has_more)."""
    n = df.agg(F.count(F.lit(1)).alias("total"))
    return page_of(df, order, limit, offset, most).crossJoin(F.broadcast(n)).withColumn("has_more", F.col("total") > max(0, offset) + min(max(1, limit), most))


def sorted_by(df: DataFrame, field: str, allowed: dict[str, str], default: str, tie: str, descending: bool = True) -> list[Column]:
    """The order of an asked field: only names in `allowed` (name -> column) count, others mean the default."""
    c = F.col(allowed.get(field, allowed[default]))
    return [c.desc_nulls_last() if descending else c.asc_nulls_first(), F.asc(tie)]


def matchups(df: DataFrame, subject: str, condition: str, n: int, seed: int = 0) -> DataFrame:
    """n pairs (subject, a, b) of conditions a < b that a subject has both of: the first by hash of all pairs.
    The conditions of a subject are a short list of different names."""
    lists = df.where(F.col(condition).isNotNull()).groupBy(subject).agg(F.array_sort(F.collect_set(condition)).alias("__c"))
    pairs = F.flatten(F.transform("__c", lambda x, i: F.transform(F.slice("__c", i + 2, F.size("__c")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    each = lists.select(subject, F.explode(pairs).alias("p")).select(subject, "p.a", "p.b")
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(subject).cast("string"), "a", "b"))
    return each.orderBy(draw, subject, "a", "b").limit(n)
