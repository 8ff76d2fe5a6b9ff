"""Queries over usage, events, experiments and trade tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.functions import layout, stats, text
from scriptorium.operators import aggregates as A
from scriptorium.operators import changes, entities, filters, joins, nested, ordered
from scriptorium.plans.base import query
from scriptorium.sources import writers
from scriptorium.session import table
from scriptorium.streaming import events as E

USAGE = "(SELECT DISTINCT * FROM gemini_usage)"


def usage(spark, d) -> DataFrame:
    """Usage rows once each; repeated deliveries are equal in all fields."""
    return table(spark, d, "gemini_usage").dropDuplicates(["id"])


def _usage_query(name: str, dim_sql: str, dim):
    @query(
        name,
        f"""SELECT {dim_sql} AS dim, count(*) AS calls, count(*) FILTER (lower(status) LIKE 'fail%' OR lower(status)='error') AS failed, CAST(coalesce(sum(cost_usd),0) AS DOUBLE) AS cost,
            CAST(coalesce(sum(page_count),0) AS BIGINT) AS pages, CAST(coalesce(sum(input_tokens),0) AS BIGINT) AS tokens_in, CAST(coalesce(sum(output_tokens),0) AS BIGINT) AS tokens_out FROM {USAGE} GROUP BY 1""",
    )
    def run(spark, d):
        failed = F.lower("status").startswith("fail") | (F.lower("status") == "error")
        out = A.usage_by(usage(spark, d), [dim().alias("dim")], F.col("cost_usd"), failed, pages=F.col("page_count"), tokens_in=F.col("input_tokens"), tokens_out=F.col("output_tokens"))
        return out.withColumn("cost", F.col("cost").cast("double"))

    return run


_usage_query("usage_by_day", "strftime(timestamp, '%Y-%m-%d')", lambda: F.date_format("timestamp", "yyyy-MM-dd"))
_usage_query("usage_by_type", "coalesce(type,'Unknown')", lambda: F.coalesce("type", F.lit("Unknown")))
_usage_query("usage_by_model", "coalesce(model,'Unknown')", lambda: F.coalesce("model", F.lit("Unknown")))
_usage_query("usage_by_book", "coalesce(book_id,'Unknown')", lambda: F.coalesce("book_id", F.lit("Unknown")))


@query(
    "usage_totals",
    f"""SELECT count(*) AS calls, CAST(coalesce(sum(cost_usd),0) AS DOUBLE) AS cost, count(DISTINCT book_id) AS books, count(*) FILTER (book_id IS NULL) AS without_book, count(*) FILTER (lower(status)='success') AS succeeded FROM {USAGE}""",
)
def usage_totals(spark, d):
    return usage(spark, d).agg(F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum("cost_usd"), F.lit(0)).cast("double").alias("cost"), F.count_distinct("book_id").alias("books"),
                               F.count_if(F.col("book_id").isNull()).alias("without_book"), F.count_if(F.lower("status") == "success").alias("succeeded"))


@query(
    "usage_pivot",
    f"""SELECT strftime(timestamp, '%Y-%m-%d') AS day, CAST(coalesce(sum(page_count) FILTER (type='ocr'),0) AS BIGINT) AS ocr, CAST(coalesce(sum(page_count) FILTER (type='translation'),0) AS BIGINT) AS translation FROM {USAGE} GROUP BY 1""",
)
def usage_pivot(spark, d):
    u = usage(spark, d).withColumn("day", F.date_format("timestamp", "yyyy-MM-dd"))
    return nested.pivot_sums(u, ["day"], "type", ["ocr", "translation"], F.col("page_count"))


@query(
    "late_usage",
    f"""SELECT id, CAST(floor(date_diff('second', timestamp, received_at)/3600) AS BIGINT) AS hours_late FROM {USAGE} WHERE received_at > timestamp + INTERVAL 6 HOUR""",
)
def late_usage(spark, d):
    late = F.expr("timestampdiff(SECOND, timestamp, received_at)")
    return usage(spark, d).where(F.expr("received_at > timestamp + INTERVAL 6 HOURS")).select("id", F.floor(late / 3600).alias("hours_late"))


@query(
    "top_books_by_cost",
    f"""SELECT book_id, CAST(sum(cost_usd) AS DOUBLE) AS cost FROM {USAGE} WHERE book_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 3 ORDER BY sum(cost_usd) DESC, book_id LIMIT 20""",
)
def top_books_by_cost(spark, d):
    g = usage(spark, d).where("book_id is not null").groupBy("book_id").agg(F.sum("cost_usd").alias("c"), F.count(F.lit(1)).alias("n")).where("n >= 3")
    return g.orderBy(F.desc("c"), "book_id").limit(20).select("book_id", F.col("c").cast("double").alias("cost"))


@query(
    "nearest_rank",
    """SELECT event_type, list_sort(list(value))[1+least(CAST(floor(count(*)*0.5) AS BIGINT), count(*)-1)] AS p50, list_sort(list(value))[1+least(CAST(floor(count(*)*0.95) AS BIGINT), count(*)-1)] AS p95 FROM events WHERE value IS NOT NULL GROUP BY 1""",
)
def nearest_rank(spark, d):
    return A.nearest_rank(table(spark, d, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


@query("approx_percentiles", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, true AS users_near FROM events GROUP BY 1")
def approx_percentiles(spark, d):
    # a sketch this wide is exact on groups of few thousand values; users are counted within a tenth
    p, exact = F.percentile_approx("value", [0.5, 0.95], 100_000), F.count_distinct("user_id")
    near = F.abs(F.approx_count_distinct("user_id") - exact) <= exact * 0.1
    g = table(spark, d, "events").groupBy("event_type").agg(p.alias("p"), near.alias("users_near"))
    return g.select("event_type", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95"), "users_near")


@query(
    "daily_visitors",
    """SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS views, count(DISTINCT user_id) AS visitors FROM events GROUP BY 1""",
)
def daily_visitors(spark, d):
    return table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("views"), F.count_distinct("user_id").alias("visitors"))


@query(
    "recent_events",
    """SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 24 HOUR""",
)
def recent_events(spark, d):
    return table(spark, d, "events").where(filters.within("ts", "2024-01-30 00:00:00", "24 HOURS")).select("event_id")


@query(
    "json_props",
    """SELECT CAST(json_extract_string(props, '$.k') AS INT) AS k, count(*) AS n FROM events GROUP BY 1""",
)
def json_props(spark, d):
    return table(spark, d, "events").groupBy(F.from_json("props", "k int")["k"].alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "dedupe_hour",
    """WITH RECURSIVE o AS (SELECT event_id, user_id, event_type, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events),
       f AS (SELECT event_id, user_id, event_type, rn, ts AS last, true AS ok FROM o WHERE rn=1 UNION ALL SELECT o.event_id, o.user_id, o.event_type, o.rn, CASE WHEN o.ts > f.last + INTERVAL 1 HOUR THEN o.ts ELSE f.last END, o.ts > f.last + INTERVAL 1 HOUR
       FROM f JOIN o ON o.user_id=f.user_id AND o.event_type=f.event_type AND o.rn=f.rn+1) SELECT event_id FROM f WHERE ok""",
)
def dedupe_hour(spark, d):
    return E.dedupe_batch(table(spark, d, "events"), ["user_id", "event_type"], "ts", "event_id").select("event_id")


@query(
    "event_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
       s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS begin_at, count(*) AS n FROM s GROUP BY user_id, s""",
)
def event_sessions(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return E.sessions(e).select("user_id", F.col("begin").cast("timestamp_ntz").alias("begin_at"), "n")


@query(
    "sliding_windows",
    """SELECT b AS begin_at, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 15 MINUTE, ts), time_bucket(INTERVAL 15 MINUTE, ts)-INTERVAL 15 MINUTE, time_bucket(INTERVAL 15 MINUTE, ts)-INTERVAL 30 MINUTE, time_bucket(INTERVAL 15 MINUTE, ts)-INTERVAL 45 MINUTE]) AS b FROM events) GROUP BY 1,2""",
)
def sliding_windows(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return E.sliding_counts(e).select(F.col("begin").cast("timestamp_ntz").alias("begin_at"), "event_type", "n")


@query(
    "daily_totals",
    """SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""",
)
def daily_totals(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return E.daily_counts(e).select(F.col("day").cast("timestamp_ntz").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    "as_of_purchase",
    """SELECT e.event_id, p.value AS last_purchase FROM (SELECT * FROM events WHERE event_type='view') e ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type='purchase' GROUP BY ALL) p ON e.user_id=p.user_id AND e.ts >= p.ts""",
)
def as_of_purchase(spark, d):
    e = table(spark, d, "events")
    p = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return joins.as_of(e.where("event_type = 'view'").select("event_id", "user_id", "ts"), p, "user_id", "ts", "value", "last_purchase").select("event_id", "last_purchase")


@query(
    "price_bands",
    """SELECT r.p_partkey AS band, count(*) AS n FROM part p JOIN (SELECT p_partkey, p_retailprice - 5 AS lo, p_retailprice + 5 AS hi FROM part WHERE p_partkey <= 20) r ON p.p_retailprice BETWEEN r.lo AND r.hi GROUP BY 1""",
)
def price_bands(spark, d):
    p = table(spark, d, "part")
    r = p.where("p_partkey <= 20").select(F.col("p_partkey").alias("band"), (F.col("p_retailprice") - 5).alias("lo"), (F.col("p_retailprice") + 5).alias("hi"))
    return joins.in_range(p.select("p_retailprice"), r, "p_retailprice", "lo", "hi", 10.0).groupBy("band").agg(F.count(F.lit(1)).alias("n"))


@query(
    "lookup_left",
    """SELECT o.o_orderkey, c.c_name AS customer FROM orders o LEFT JOIN customer c ON c.c_custkey=o.o_custkey""",
)
def lookup_left(spark, d):
    return joins.lookup_one(table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "customer").select("c_custkey", "c_name"), "o_custkey", "c_custkey", "x_").select("o_orderkey", F.col("x_c_name").alias("customer"))


@query(
    "lookup_inner",
    """SELECT p_brand, count(*) AS n FROM lineitem JOIN part ON p_partkey=l_partkey GROUP BY 1""",
)
def lookup_inner(spark, d):
    j = joins.lookup_one(table(spark, d, "lineitem").select("l_partkey"), table(spark, d, "part").select("p_partkey", "p_brand"), "l_partkey", "p_partkey", "x_", required=True)
    return j.groupBy(F.col("x_p_brand").alias("p_brand")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "nest_count",
    """SELECT o_orderkey, coalesce(n,0) AS n, CASE WHEN coalesce(n,0)>0 THEN round_even(r*100.0/n, 1) ELSE 0 END AS returned FROM orders LEFT JOIN (SELECT l_orderkey, count(*) n, count(*) FILTER (l_returnflag='R') r FROM lineitem GROUP BY 1) ON l_orderkey=o_orderkey""",
)
def nest_count(spark, d):
    l = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag")  # noqa: E741
    j = joins.lookup_measures(table(spark, d, "orders").select("o_orderkey"), l, "o_orderkey", "l_orderkey", n=F.count(F.lit(1)), r=F.count_if(F.col("l_returnflag") == "R"))
    return j.select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(A.half_even(F.col("r") * 100.0 / F.col("n"), 1), F.lit(0.0)).alias("returned"))


@query("semi_join", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus='P')")
def semi_join(spark, d):
    return joins.semi(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").where("o_orderstatus = 'P'"), "c_custkey", "o_custkey")


@query("anti_join", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey IS NOT NULL)")
def anti_join(spark, d):
    return joins.anti(table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem").select("l_orderkey"), "o_orderkey", "l_orderkey")


@query("mark_join", "SELECT p_partkey, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) AS sold FROM part")
def mark_join(spark, d):
    return joins.mark(table(spark, d, "part").select("p_partkey"), table(spark, d, "lineitem").where("l_quantity > 49").select("l_partkey"), "p_partkey", "sold", "l_partkey")


@query(
    "full_outer_dim",
    """SELECT coalesce(n_nationkey, k) AS nation, coalesce(n_name, 'other') AS name, coalesce(n,0) AS n FROM nation FULL JOIN (SELECT CASE WHEN s_suppkey%7=0 THEN 99 ELSE s_nationkey END AS k, count(*) AS n FROM supplier GROUP BY 1) ON k=n_nationkey""",
)
def full_outer_dim(spark, d):
    s = table(spark, d, "supplier").groupBy(F.when(F.col("s_suppkey") % 7 == 0, 99).otherwise(F.col("s_nationkey")).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    j = table(spark, d, "nation").join(s, F.col("n_nationkey") == F.col("k"), "full_outer")
    return j.select(F.coalesce("n_nationkey", "k").alias("nation"), F.coalesce("n_name", F.lit("other")).alias("name"), F.coalesce("n", F.lit(0)).alias("n"))


@query(
    "worklist",
    """SELECT r_name, p FROM region CROSS JOIN (SELECT DISTINCT o_orderpriority AS p FROM orders) EXCEPT SELECT r_name, p FROM (SELECT r_name, min(o_orderpriority) AS p FROM region CROSS JOIN orders GROUP BY 1)""",
)
def worklist(spark, d):
    r, p = table(spark, d, "region").select("r_name"), table(spark, d, "orders").select(F.col("o_orderpriority").alias("p")).distinct()
    seen = r.crossJoin(F.broadcast(table(spark, d, "orders").agg(F.min("o_orderpriority").alias("p"))))  # both sides are lists of fixed size
    return r.crossJoin(F.broadcast(p)).join(seen, ["r_name", "p"], "left_anti")


@query(
    "latest_order",
    """SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC)=1""",
)
def latest_order(spark, d):
    return ordered.latest_version(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey")


@query(
    "sections",
    """SELECT event_id, coalesce(lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) - 1, 999999999) AS section_end FROM events""",
)
def sections(spark, d):
    return ordered.sections(table(spark, d, "events").select("user_id", "event_id"), "user_id", "event_id", F.lit(999999999)).select("event_id", "section_end")


@query(
    "conditional_counts",
    """SELECT count(*) AS n, count(*) FILTER (o_orderstatus='F') AS done, count(*) FILTER (o_totalprice>100000) AS large, count(*) FILTER (o_orderpriority LIKE '1%') AS urgent FROM orders""",
)
def conditional_counts(spark, d):
    return A.count_where(table(spark, d, "orders"), n=F.lit(True), done=F.col("o_orderstatus") == "F", large=F.col("o_totalprice") > 100000, urgent=F.col("o_orderpriority").startswith("1"))


@query(
    "rollup_orders",
    """SELECT o_orderstatus, o_orderpriority, grouping_id(o_orderstatus, o_orderpriority) AS level, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)""",
)
def rollup_orders(spark, d):
    return A.rollup_counts(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], n=F.count(F.lit(1)))


@query(
    "cube_orders",
    """SELECT o_orderstatus, o_orderpriority, grouping_id(o_orderstatus, o_orderpriority) AS level, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""",
)
def cube_orders(spark, d):
    return A.cube_counts(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], n=F.count(F.lit(1)))


@query(
    "set_operations",
    """SELECT 'both' AS kind, count(*) AS n FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag='A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag='R') UNION ALL SELECT 'only', count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag='A' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag='R')""",
)
def set_operations(spark, d):
    l = table(spark, d, "lineitem")  # noqa: E741
    a, r = (l.where(F.col("l_returnflag") == x).select("l_partkey") for x in "AR")
    return nested.union_tagged({"both": a.intersect(r).agg(F.count(F.lit(1)).alias("n")), "only": a.subtract(r).agg(F.count(F.lit(1)).alias("n"))}, "kind")


@query(
    "window_shares",
    """SELECT o_orderkey, ntile(4) OVER w AS quarter, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS so_far FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""",
)
def window_shares(spark, d):
    w = W.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.ntile(4).over(w).cast("bigint").alias("quarter"), F.round(F.sum("o_totalprice").over(w.rowsBetween(W.unboundedPreceding, 0)), 2).alias("so_far"))


@query(
    "unwind_index",
    """SELECT CAST(i - 1 AS INT) AS place, round(avg(x), 5) AS mean FROM (SELECT unnest(generate_series(1, len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY 1""",
)
def unwind_index(spark, d):
    e = nested.unwind(table(spark, d, "embeddings").select("embedding"), "embedding", "x", index="place")
    return e.groupBy("place").agg(F.round(F.avg(F.col("x").cast("double")), 5).alias("mean"))


# Judgments between the event types of one user and day: the greater value wins.
_JUDGE = """(SELECT user_id, a.event_id AS id, a.event_type AS condition_a, b.event_type AS condition_b, CASE WHEN a.value > b.value THEN 'a' WHEN a.value < b.value THEN 'b' ELSE 'tie' END AS winner
  FROM events a JOIN (SELECT user_id AS u, event_id - 1 AS prev, event_type, value FROM events) b ON b.prev = a.event_id WHERE a.event_type <> b.event_type)"""


def judgments(spark, d) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "event_type", "value", (F.col("event_id") % 10).alias("experiment"))
    b = e.select((F.col("event_id") - 1).alias("prev"), F.col("event_type").alias("condition_b"), F.col("value").alias("vb"))
    j = e.join(b, F.col("event_id") == F.col("prev")).where("event_type <> condition_b")
    win = F.when(F.col("value") > F.col("vb"), "a").when(F.col("value") < F.col("vb"), "b").otherwise("tie")
    return j.select("experiment", F.col("event_id").alias("id"), F.col("event_type").alias("condition_a"), "condition_b", win.alias("winner"))


@query(
    "judgment_tallies",
    f"""SELECT condition, count(*) FILTER (o='w') AS wins, count(*) FILTER (o='l') AS losses, count(*) FILTER (o='t') AS ties FROM (
        SELECT condition_a AS condition, CASE winner WHEN 'a' THEN 'w' WHEN 'b' THEN 'l' ELSE 't' END AS o FROM {_JUDGE} UNION ALL SELECT condition_b, CASE winner WHEN 'b' THEN 'w' WHEN 'a' THEN 'l' ELSE 't' END FROM {_JUDGE}) GROUP BY 1""",
)
def judgment_tallies(spark, d):
    return A.tallies(judgments(spark, d), "condition_a", "condition_b", "winner")


@query("elo_ratings")
def elo_ratings(spark, d):
    return stats.elo(judgments(spark, d), "experiment", ["id"])


@query(
    "wilson_intervals",
    """SELECT source, greatest(0, (p + 1.96*1.96/(2*n))/(1+1.96*1.96/n) - 1.96*sqrt(p*(1-p)/n + 1.96*1.96/(4*n*n))/(1+1.96*1.96/n)) AS low,
       least(1, (p + 1.96*1.96/(2*n))/(1+1.96*1.96/n) + 1.96*sqrt(p*(1-p)/n + 1.96*1.96/(4*n*n))/(1+1.96*1.96/n)) AS high FROM (SELECT source, count(*)*1.0 AS n, count(*) FILTER (lang='la')*1.0/count(*) AS p FROM documents GROUP BY 1)""",
)
def wilson_intervals(spark, d):
    g = table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("lang") == "la").alias("k"))
    w = stats.wilson(F.col("k"), F.col("n"))
    return g.select("source", w["low"].alias("low"), w["high"].alias("high"))


@query(
    "sample_estimate",
    """SELECT CAST(floor(k*1.0/n*1000000+0.5) AS BIGINT) AS point FROM (SELECT count(*) AS n, count(*) FILTER (n_chars > 1000) AS k FROM documents)""",
)
def sample_estimate(spark, d):
    g = table(spark, d, "documents").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_chars") > 1000).alias("k"))
    return g.select(stats.estimate(F.col("k") / F.col("n"), stats.wilson(F.col("k"), F.col("n")), F.lit(1000000))["point"].alias("point"))


@query(
    "split_deltas",
    """SELECT round(avg(d),6) AS mean_delta, round(avg(abs(d)),6) AS mean_abs, count(*) FILTER (d>0) AS right_side, count(*) FILTER (d<0) AS left_side FROM (SELECT p_size - 25 AS d FROM part ORDER BY p_partkey DESC LIMIT 100)""",
)
def split_deltas(spark, d):
    last = table(spark, d, "part").orderBy(F.desc("p_partkey")).limit(100).select((F.col("p_size") - 25).alias("d"))
    return last.agg(F.round(F.avg("d"), 6).alias("mean_delta"), F.round(F.avg(F.abs("d")), 6).alias("mean_abs"), F.count_if(F.col("d") > 0).alias("right_side"), F.count_if(F.col("d") < 0).alias("left_side"))


@query("layout_model")
def layout_model(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", *[(F.get("embedding", F.lit(i)) * 50 + 50).cast("double").alias(c) for i, c in enumerate(["center_darkest", "center_brightest", "edge_center_diff"])], (F.get("embedding", F.lit(3)) + 1.5).cast("double").alias("aspect_ratio"))
    e = e.withColumn("target", 500 + F.col("center_darkest") - 50)
    return e.select("vec_id", layout.predict(layout.train(e, "target"), e.columns).alias("position"))


@query(
    "likes",
    """SELECT o_custkey AS target, count(*) AS n, bool_or(o_orderstatus='P') AS mine FROM orders GROUP BY 1 HAVING count(*) >= 12""",
)
def likes(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("target")).agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("o_orderstatus") == "P").alias("mine")).where("n >= 12")


@query(
    "url_domains",
    """SELECT CASE WHEN coalesce(photo,'')='' THEN 'direct' WHEN regexp_extract(photo, '^[A-Za-z]+://([^/:?#]+)', 1) <> '' THEN regexp_replace(regexp_extract(photo, '^[A-Za-z]+://([^/:?#]+)', 1), '^www\\.', '') ELSE split_part(photo, '/', 3) END AS domain, count(*) AS n FROM pages GROUP BY 1""",
)
def url_domains(spark, d):
    return table(spark, d, "pages").groupBy(text.domain_of(F.col("photo")).alias("domain")).agg(F.count(F.lit(1)).alias("n"))


@query("normalised_titles", "SELECT id, trim(lower(strip_accents(title))) AS plain FROM books WHERE title IS NOT NULL")
def normalised_titles(spark, d):
    return table(spark, d, "books").where("title is not null").select("id", text.normalize_text("title").alias("plain"))


@query(
    "request_files",
    """SELECT book_id, CAST(floor((row_number() OVER (PARTITION BY book_id ORDER BY doc_id)-1)/25) AS INT) AS file_no, doc_id FROM documents WHERE book_id IS NOT NULL""",
)
def request_files(spark, d):
    docs = table(spark, d, "documents").where("book_id is not null")
    return writers.request_lines(docs, "book_id", ["doc_id"], 25, F.struct("doc_id", "title")).select("book_id", "file_no", "doc_id")


@query(
    "counter_increments",
    """SELECT c_custkey, coalesce(n,0) AS reads FROM customer LEFT JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type='view' GROUP BY 1) ON user_id=c_custkey""",
)
def counter_increments(spark, d):
    c = table(spark, d, "customer").select("c_custkey").withColumn("reads", F.lit(0).cast("bigint"))
    return changes.increment(c, table(spark, d, "events").where("event_type = 'view'"), "c_custkey", "user_id", "reads").select("c_custkey", "reads")


@query(
    "facet_parts",
    """SELECT 'brand' AS facet, p_brand AS key, count(*) AS n FROM part GROUP BY ALL UNION ALL SELECT 'size', CAST(p_size AS VARCHAR), count(*) FROM part GROUP BY ALL""",
)
def facet_parts(spark, d):
    return nested.facets(table(spark, d, "part"), {"brand": F.col("p_brand"), "size": F.col("p_size")})


@query(
    "documents_by_language",
    """SELECT coalesce(lang,'unknown') AS lang, count(*) AS n, max(n_chars) AS longest FROM documents GROUP BY 1""",
)
def documents_by_language(spark, d):
    return table(spark, d, "documents").groupBy(F.coalesce("lang", F.lit("unknown")).alias("lang")).agg(F.count(F.lit(1)).alias("n"), F.max("n_chars").alias("longest"))


@query(
    "word_index",
    """SELECT w AS term, count(DISTINCT doc_id) AS n_places FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{12,}')) AS w FROM documents) GROUP BY 1""",
)
def word_index(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{12,})"), F.lit(1))).alias("term"))
    return t.groupBy("term").agg(F.count_distinct("doc_id").alias("n_places"))


@query(
    "dashboard",
    f"""SELECT 'books' AS section, count(*) AS n FROM books UNION ALL SELECT 'pages', count(DISTINCT id) FROM pages UNION ALL SELECT 'calls', count(*) FROM {USAGE} UNION ALL SELECT 'documents', count(*) FROM documents""",
)
def dashboard(spark, d):
    n = F.count(F.lit(1)).alias("n")
    return nested.union_tagged(
        {"books": table(spark, d, "books").agg(n), "pages": table(spark, d, "pages").agg(F.count_distinct("id").alias("n")), "calls": usage(spark, d).agg(n), "documents": table(spark, d, "documents").agg(n)}, "section"
    )


@query(
    "regions_of_top_users",
    """WITH t AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 30) SELECT coalesce(n_name,'Unknown') AS country, CAST(sum(t.n) AS BIGINT) AS visits, count(*) AS users FROM t LEFT JOIN customer ON c_custkey=user_id LEFT JOIN nation ON n_nationkey=c_nationkey GROUP BY 1""",
)
def regions_of_top_users(spark, d):
    top = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "user_id").limit(30)
    c = joins.lookup_one(top, table(spark, d, "customer").select("c_custkey", "c_nationkey"), "user_id", "c_custkey", "x_")
    n = joins.lookup_one(c, table(spark, d, "nation").select("n_nationkey", "n_name"), "x_c_nationkey", "n_nationkey", "y_")
    return n.groupBy(F.coalesce("y_n_name", F.lit("Unknown")).alias("country")).agg(F.sum("n").alias("visits"), F.count(F.lit(1)).alias("users"))


@query(
    "interval_incidence",
    """SELECT page, count(*) AS n FROM (SELECT unnest(generate_series(p_size, p_size + 4)) AS page FROM part) GROUP BY 1""",
)
def interval_incidence(spark, d):
    p = table(spark, d, "part").select(F.col("p_size").cast("bigint").alias("a"), (F.col("p_size") + 4).cast("bigint").alias("b"))
    return entities.expand_ranges(p, "a", "b", "page").groupBy("page").agg(F.count(F.lit(1)).alias("n"))


@query(
    "next_versions",
    """SELECT g, CAST(mx.a AS VARCHAR) || '.' || CAST(mx.b + 1 AS VARCHAR) || '.0' AS next FROM (SELECT s_nationkey AS g, max({'a': CAST(s_suppkey % 3 AS INT), 'b': CAST(s_suppkey % 11 AS INT)}) AS mx FROM supplier GROUP BY 1)""",
)
def next_versions(spark, d):
    v = table(spark, d, "supplier").select(F.col("s_nationkey").alias("g"), F.concat_ws(".", (F.col("s_suppkey") % 3).cast("string"), (F.col("s_suppkey") % 11).cast("string"), F.lit("0")).alias("v"))
    return entities.next_version(v, "g", "v")


@query(
    "reply_counts",
    """SELECT event_id, coalesce(n, 0) AS n_replies FROM events LEFT JOIN (SELECT event_id // 3 AS p, count(*) AS n FROM events WHERE event_id % 3 = 0 GROUP BY 1) ON p = event_id""",
)
def reply_counts(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.floor(F.col("event_id") / 3)).alias("parent_id"))
    return entities.reply_counts(e, "event_id").select("event_id", "n_replies")
