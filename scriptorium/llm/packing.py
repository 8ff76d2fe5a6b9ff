"""Problem 7: texts put together into containers of fixed capacity.

Variable-capacity best-fit over the histogram of item sizes. Sizes are whole numbers of at most the
largest capacity, so the histogram has at most that many entries whatever the number of texts. Bins
are planned as patterns (a multiset of sizes) with a multiplicity, and every item finds its place by
its rank among the items of its size; no task sees more than a slice of any size.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.operators.ranking import split_rank
from scriptorium.session import materialize


class Sizes:
    """Counts by size, with a search for the largest remaining size up to a bound."""

    def __init__(self, histogram: dict[int, int]) -> None:
        self.left = {s: n for s, n in histogram.items() if s > 0 and n > 0}
        self.order = sorted(self.left)

    def largest(self, bound: int) -> int:
        i = bisect_right(self.order, bound)
        return self.order[i - 1] if i else 0

    def take(self, pattern: dict[int, int], times: int) -> None:
        for s, k in pattern.items():
            self.left[s] -= k * times
            if not self.left[s]:
                del self.left[s]
                self.order.remove(s)


def fill(sizes: Sizes, first: int, capacity: int) -> dict[int, int]:
    """Best fit for one bin: the first item, then always the item that leaves the least room; of the
    last two places, the pair that leaves the least room together."""
    pattern = {first: 1}
    gap = capacity - first
    while gap > 0:
        used = lambda s: sizes.left.get(s, 0) - pattern.get(s, 0)
        s = sizes.largest(gap)
        while s and used(s) <= 0:
            s = sizes.largest(s - 1)
        if not s:
            break
        best, best_rest = (s,), gap - s
        if best_rest:  # a single item leaves room: would two leave less? The larger is over half of them
            for k in range(bisect_right(sizes.order, gap) - 1, -1, -1):
                a = sizes.order[k]
                if 2 * a <= gap - best_rest:
                    break
                if used(a) <= 0:
                    continue
                b = sizes.largest(min(gap - a, a))
                while b and used(b) <= (a == b):
                    b = sizes.largest(b - 1)
                if b and gap - a - b < best_rest:
                    best, best_rest = (a, b), gap - a - b
                    if not best_rest:
                        break
        for x in best:
            pattern[x] = pattern.get(x, 0) + 1
        gap -= sum(best)
    return pattern


def plan(histogram: dict[int, int], capacities: list[int]) -> list[tuple[dict[int, int], int, int]]:
    """(pattern, multiplicity, capacity) for all items of a histogram.

    The largest remaining item opens a bin of the capacity that loses the smallest share of its
    room when filled best-fit, the larger one on a tie; the same pattern is used as often as the
    remaining counts allow; at last the bin is downsized to the smallest capacity that holds its
    contents. Each pattern uses up one size at least, so there are at most as many patterns as sizes.
    """
    sizes, out = Sizes(histogram), []
    allowed = sorted(set(capacities))
    while sizes.order:
        first = sizes.order[-1]
        tried = []
        for c in allowed:
            if c >= first:
                pattern = fill(sizes, first, c)
                used = sum(s * k for s, k in pattern.items())
                tried.append(((c - used) / c, -c, c, pattern, used))
        _, _, _, pattern, used = min(tried, key=lambda x: x[:3])
        times = min(sizes.left[s] // k for s, k in pattern.items())
        out.append((pattern, times, next(c for c in allowed if c >= used)))
        sizes.take(pattern, times)
    return out


def pack(counted: DataFrame, capacities: list[int], name: str, unique_id: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """Each text's container among containers of the given capacities.

    Result: pack_name, unique_id, part, token_start, token_end, container_id, slot, capacity. Only
    a text longer than the largest capacity is split: into parts of exactly that capacity and a
    rest. A text of 0 tokens (or a null length) takes no room and gets container_id null. Repeated
    ids are packed once per row.
    """
    spark = counted.sparkSession
    top = max(capacities)
    n = F.coalesce(F.col(tokens), F.lit(0))
    sized = counted.select(unique_id, n.alias("n"))
    parts = sized.select(unique_id, "n", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / top).cast("int") - 1, F.lit(0)))).alias("part"))
    parts = parts.select(
        unique_id,
        "part",
        (F.col("part") * top).alias("token_start"),
        F.least(F.col("n"), (F.col("part") + 1) * top).alias("token_end"),
    ).withColumn("size", (F.col("token_end") - F.col("token_start")).cast("int"))
    histogram = {r["size"]: r["count"] for r in parts.groupBy("size").count().collect()}  # at most `top` rows
    rows, first_container = [], 0
    taken: dict[int, int] = {}
    for pattern, times, capacity in plan(histogram, capacities):
        slot = 0
        for s, k in sorted(pattern.items(), reverse=True):
            rows.append((s, taken.get(s, 0), taken.get(s, 0) + k * times, k, slot, first_container, capacity))
            taken[s] = taken.get(s, 0) + k * times
            slot += k
        first_container += times
    ranges = spark.createDataFrame(rows or [(-1, 0, 0, 1, 0, 0, 0)], "size int, from_rank bigint, to_rank bigint, per_bin int, first_slot int, first_container bigint, capacity int")
    # the plan's rows of one size are few; they travel as one array per size, at most `top` rows
    ranges = ranges.groupBy("size").agg(F.sort_array(F.collect_list(F.struct("to_rank", "from_rank", "per_bin", "first_slot", "first_container", "capacity"))).alias("plan"))
    ranked = split_rank(parts.withColumn("__key", F.concat_ws("/", F.col(unique_id).cast("string"), F.col("part"))), ["size"], "__key").drop("__key")
    placed = ranked.join(F.broadcast(ranges), "size", "left").withColumn("p", F.element_at(F.filter("plan", lambda p: F.col("rank") < p["to_rank"]), 1))
    at = F.col("rank") - F.col("p.from_rank")
    return placed.select(
        F.lit(name).alias("pack_name"),
        unique_id,
        "part",
        F.col("token_start").cast("int").alias("token_start"),
        F.col("token_end").cast("int").alias("token_end"),
        F.when(F.col("size") > 0, F.col("p.first_container") + F.floor(at / F.col("p.per_bin"))).alias("container_id"),
        F.when(F.col("size") > 0, F.col("p.first_slot") + at % F.col("p.per_bin")).cast("int").alias("slot"),
        F.when(F.col("size") > 0, F.col("p.capacity")).alias("capacity"),
    )


def pack_all(counted: DataFrame, packs: DataFrame, unique_id: str = "doc_id", tokens: str = "tokens", joint: str = "joint") -> DataFrame:
    """An arrangement for each row of packs (pack_name, capacity_tokens), and one named `joint` that
    may use all their capacities. packs: a small list of container kinds."""
    counted = materialize(counted.select(unique_id, tokens), "tokens")
    kinds = [(r["pack_name"], r["capacity_tokens"]) for r in packs.select("pack_name", "capacity_tokens").distinct().orderBy("capacity_tokens").collect() if r["capacity_tokens"]]
    jobs = [([c], n) for n, c in kinds] + ([([c for _, c in kinds], joint)] if len(kinds) > 1 else [])
    out = None
    for capacities, name in jobs:
        one = pack(counted, capacities, name, unique_id, tokens)
        out = one if out is None else out.unionByName(one)
    return out


def fills(packed: DataFrame) -> DataFrame:
    """The fill of each container: items, used, unused and used share."""
    size = F.col("token_end") - F.col("token_start")
    return (
        packed.where("container_id is not null")
        .groupBy("pack_name", "container_id", "capacity")
        .agg(F.count(F.lit(1)).alias("items"), F.sum(size).cast("int").alias("used"))
        .withColumn("unused", F.col("capacity") - F.col("used"))
        .withColumn("fill", F.round(F.col("used") / F.col("capacity"), 4))
    )
