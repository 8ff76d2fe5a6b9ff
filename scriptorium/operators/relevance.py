"""Full-text search by relevance."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def occurrences(text: Column, word: str) -> Column:
    """How often a whole word occurs, in any case; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(rf"(?i)\b{re.escape(word)}\b")), F.lit(0))


def relevance(df: DataFrame, unique_id: str, text: str, query: str, k: int = 50, saturation: float = 1.2, lengths: float = 0.75) -> DataFrame:
    """(unique_id, score): the k texts most relevant to a query by BM25: rare words weigh more, repeated ones
    ever less, and long texts need more. A text without any word of the query is left out; null texts count
    as empty ones. One pass counts the words, one scores; no index is needed and nothing is collected.
    """
    words = list(dict.fromkeys(re.findall(r"\w+", query.lower())))
    t = F.coalesce(F.col(text), F.lit(""))
    counted = df.select(unique_id, F.array(*[occurrences(t, w) for w in words]).alias("__tf"), F.regexp_count(t, F.lit(r"\w+")).alias("__size"))
    if not words:
        return counted.limit(0).select(unique_id, F.lit(0.0).alias("score"))
    stats = counted.agg(F.count(F.lit(1)).alias("__n"), F.avg("__size").alias("__mean"), *[F.count_if(F.col("__tf")[i] > 0).alias(f"__df{i}") for i in range(len(words))])
    hits = counted.where(F.exists("__tf", lambda x: x > 0)).crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(words)):
        tf, seen = F.col("__tf")[i], F.col(f"__df{i}")
        rarity = F.log(1 + (F.col("__n") - seen + 0.5) / (seen + 0.5))
        score = score + rarity * tf * (saturation + 1) / (tf + saturation * (1 - lengths + lengths * F.col("__size") / F.col("__mean")))
    return hits.select(unique_id, score.alias("score")).orderBy(F.desc("score"), unique_id).limit(k)
