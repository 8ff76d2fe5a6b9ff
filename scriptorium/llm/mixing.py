"""Problem 8: records of several sources mixed so that each makes up its share of the tokens.

Records of a source are put in the order of a hash-random key; distributed prefix sums of their
token counts say where the source's budget ends. Whole epochs come first, and the last, partial one
is cut at the budget. No source is gathered in one task, however large.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.operators.ranking import split_running_sum
from scriptorium.session import materialize


def budgets(counted: DataFrame, targets: DataFrame, source: str = "source", tokens: str = "tokens") -> DataFrame:
    """(mix_name, source, target_share, max_repeats, have, budget): the tokens each source gives.

    The mix is as large as its scarcest source allows: the least of have * max_repeats / share over
    its sources. A source without tokens (or with share or repeats of 0) can't give its share; it
    gets a budget of 0 and doesn't limit the others. A source listed twice in a mix counts once,
    with the larger share.
    """
    have = counted.groupBy(F.col(source).alias("source")).agg(F.sum(F.col(tokens).cast("bigint")).alias("have"))
    wanted = targets.groupBy("mix_name", "source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    known = wanted.join(have, "source", "left").withColumn("have", F.coalesce("have", F.lit(0).cast("bigint")))
    room = F.when((F.col("have") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0), F.col("have") * F.col("max_repeats") / F.col("target_share"))
    size = known.groupBy("mix_name").agg(F.min(room).alias("size"))
    return known.join(size, "mix_name").select(
        "mix_name", "source", "target_share", "max_repeats", "have",
        F.when(room.isNotNull(), F.least(F.floor(F.col("size") * F.col("target_share") + 1e-6), F.col("have") * F.col("max_repeats"))).otherwise(F.lit(0)).cast("bigint").alias("budget"),
    )


def mix(counted: DataFrame, targets: DataFrame, unique_id: str = "doc_id", source: str = "source", tokens: str = "tokens", seed: int = 7) -> DataFrame:
    """(mix_name, source, unique_id, tokens, repeats): the records of each mix.

    Every record is used budget div have times, and once more while the prefix sum in random order
    stays within the rest of the budget; the record on the cut is taken if that comes nearer to the
    budget. So a source misses its budget, or goes over it, by at most half a record; shares() tells by how
    much. Records without tokens are never chosen. targets: the list of mixes, of a size that doesn't grow
    with the records; it is joined by source, whose rows are spread by the hash order.
    """
    # 52 random bits per record and seed
    position = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(unique_id)), 12) / F.lit(float(2**52))
    plain = counted.select(unique_id, F.col(source).alias("source"), F.col(tokens).cast("bigint").alias("tokens")).where("tokens > 0")
    summed = split_running_sum(plain, ["source"], position, unique_id, "tokens", name="prefix")
    goals = budgets(plain, targets, "source", "tokens")
    whole = F.floor(F.col("budget") / F.col("have"))
    rest = F.col("budget") - whole * F.col("have")
    chosen = summed.join(F.broadcast(goals) if goals_fit(targets) else goals, "source")
    below = F.col("prefix") - F.col("tokens")
    again = (F.col("prefix") <= rest) | ((below < rest) & (F.col("prefix") - rest < rest - below))
    repeats = (whole + again.cast("int")).cast("int")
    return chosen.withColumn("repeats", repeats).where("repeats > 0").select("mix_name", "source", unique_id, "tokens", "repeats")


def goals_fit(targets: DataFrame, most: int = 10_000) -> bool:
    """Whether the list of mixes has at most `most` rows, so that it may be broadcast."""
    return targets.limit(most + 1).count() <= most


def shares(mixed: DataFrame, goals: DataFrame) -> DataFrame:
    """Target and actual share of each source of each mix, by tokens, and how far it is over its budget
    (under it if negative); a source that gave nothing has 0. goals: from budgets()."""
    got = mixed.groupBy("mix_name", "source").agg(
        F.sum(F.col("tokens") * F.col("repeats")).alias("used_tokens"), F.count(F.lit(1)).alias("records"), F.max("repeats").alias("most_repeats")
    )
    total = got.groupBy("mix_name").agg(F.sum("used_tokens").alias("mix_tokens"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return (
        goals.join(got, ["mix_name", "source"], "left")
        .join(total, "mix_name", "left")
        .select("mix_name", "source", "target_share", "budget", zero("used_tokens"), (F.coalesce(F.col("used_tokens"), F.lit(0)) - F.col("budget")).alias("over_budget"), zero("records"), zero("most_repeats"),
                F.round(F.coalesce(F.col("used_tokens") / F.col("mix_tokens"), F.lit(0.0)), 6).alias("actual_share"))
    )


def counted_once(counted: DataFrame) -> DataFrame:
    """Token counts written once, since the budget and the prefix sums both read them."""
    return materialize(counted, "tokens")
