"""Statistics of experiments, as column expressions and ordered folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wilson(successes: Column, n: Column, z: float = 1.96) -> Column:
    """Struct (low, high) of the Wilson score interval, within 0 and 1; (0, 0) for n = 0 or null."""
    p = successes / n
    base = 1 + z * z / n
    mid = (p + z * z / (2 * n)) / base
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / base
    ok = n > 0
    return F.struct(
        F.coalesce(F.when(ok, F.greatest(F.lit(0.0), mid - half)), F.lit(0.0)).alias("low"),
        F.coalesce(F.when(ok, F.least(F.lit(1.0), mid + half)), F.lit(0.0)).alias("high"),
    )


def normal_cdf(z: Column) -> Column:
    """Distribution function of the normal, by the usual polynomial for erf (error under 1.5e-7)."""
    # Coefficients of the approximation.
    a, p = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429), 0.3275911
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + p * x)
    poly = F.lit(0.0)
    for c in reversed(a):
        poly = (poly + c) * t
    y = 1 - poly * F.exp(-x * x)
    return F.when(z < 0, 0.5 * (1 - y)).otherwise(0.5 * (1 + y))


def binomial_p(wins: Column, n: Column) -> Column:
    """Two-tailed p of so many wins in n fair trials, by the normal approximation; 1 for n = 0."""
    z = F.abs(wins - n * 0.5) / F.sqrt(n * 0.25)
    return F.when(n > 0, 2 * (1 - normal_cdf(z))).otherwise(F.lit(1.0))


def elo(judgments: DataFrame, group: str, order: list[str], a: str = "condition_a", b: str = "condition_b", winner: str = "winner", k: float = 32.0, start: float = 1500.0) -> DataFrame:
    """(group, condition, rating, n): ratings after all judgments of a group in order. Each update needs the
    one before, so a group, one experiment, is read in order; partitions are sorted and folded as they stream
    by, with the ratings of the group's conditions as the state, so a group of any length needs no memory.
    Judgments without a condition are left out; a null group is a group."""
    from collections.abc import Iterator

    import pandas as pd

    kind = judgments.schema[group].dataType.simpleString()

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict = {}
        now: object = fold  # no group yet
        for batch in batches:
            for g, x, y, won in zip(batch["__g"], batch[a], batch[b], batch[winner]):
                if now is fold or not (g == now or (pd.isna(g) and pd.isna(now))):
                    if state:
                        yield rows(now, state)
                    now, state = g, {}
                one, two = state.setdefault(x, [start, 0]), state.setdefault(y, [start, 0])
                gain = {"a": 1.0, "b": 0.0}.get(won, 0.5) - 1 / (1 + 10 ** ((two[0] - one[0]) / 400))
                one[0], two[0] = one[0] + k * gain, two[0] - k * gain
                one[1], two[1] = one[1] + 1, two[1] + 1
        if state:
            yield rows(now, state)

    def rows(g, state: dict) -> pd.DataFrame:
        return pd.DataFrame({group: [g] * len(state), "condition": list(state), "rating": [x for x, _ in state.values()], "n": [n for _, n in state.values()]})

    needed = judgments.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(group).alias("__g"), *order, a, b, winner)
    sorted_ = needed.repartition("__g").sortWithinPartitions("__g", *order)
    return sorted_.mapInPandas(fold, f"`{group}` {kind}, condition string, rating double, n int")


def estimate(rate: Column, interval: Column, population: Column) -> Column:
    """Struct (lower, point, upper) of a rate and its interval times a population, whole numbers."""
    whole = lambda c: F.floor(c * population + 0.5).cast("bigint")
    return F.struct(whole(interval["low"]).alias("lower"), whole(rate).alias("point"), whole(interval["high"]).alias("upper"))
