"""All core queries by name, and their SQL for the comparison engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators import aggregates as A
from scriptorium.plans import activity, details, library  # noqa: F401  (fill the registry)
from scriptorium.plans.base import ORACLE, QUERIES, query  # noqa: F401
from scriptorium.session import table


@query(
    "metric_stats",
    """SELECT event_type, count(*) AS n, floor(avg(value)*100+0.5)/100 AS avg_value, min(value) AS min_value, max(value) AS max_value,
       quantile_cont(value,0.5) AS p50, quantile_cont(value,0.95) AS p95 FROM events GROUP BY event_type""",
)
def metric_stats(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return A.percentiles(
        e, ["event_type"], "value", {"p50": 0.5, "p95": 0.95},
        n=F.count(F.lit(1)), avg_value=F.floor(F.avg("value") * 100 + 0.5) / 100, min_value=F.min("value"), max_value=F.max("value"),
    )
