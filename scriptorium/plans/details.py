"""Queries that show single operators: lookups, markup, sources and sinks, updates, search interface."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.functions import ids, layout, links, markup, stats, text
from scriptorium.operators import aggregates as A
from scriptorium.operators import changes, entities, filters, joins, nested, ordered
from scriptorium.operators.relevance import relevance
from scriptorium.plans.activity import _JUDGE, judgments, usage
from scriptorium.plans.base import query
from scriptorium.plans.facade import Library
from scriptorium.plans.library import PAGES, books_of, pages_of
from scriptorium.session import shared_dir, table
from scriptorium.sources import readers, writers

FIRST_BOOK = "(SELECT min(id) FROM books)"


def first_book(spark: SparkSession, d: str) -> str:
    return books_of(spark, d).agg(F.min("id")).first()[0]  # one value


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for files that a query writes and reads again."""
    return f"{shared_dir(spark).rstrip('/')}/scriptorium-{name}-{uuid.uuid4().hex}"


# -- lookups, nested fields, shapes


@query("point_lookup", f"SELECT id, title FROM books WHERE id = {FIRST_BOOK}")
def point_lookup(spark, d):
    return Library(spark, d).book(first_book(spark, d))["book"].select("id", "title")


@query("pages_without_texts", f"SELECT id, ocr.model AS model, translation.source AS source FROM {PAGES}")
def pages_without_texts(spark, d):
    return nested.without(pages_of(spark, d, "ocr", "translation"), "ocr.data", "translation.data", "updated_at").select("id", "ocr.model", "translation.source")


@query("images_or_none", f"SELECT id, img.type AS kind FROM (SELECT id, unnest(CASE WHEN len(coalesce(detected_images, [])) = 0 THEN [NULL] ELSE detected_images END) AS img FROM {PAGES})")
def images_or_none(spark, d):
    return nested.unwind(pages_of(spark, d, "detected_images"), "detected_images", "img", keep_empty=True).select("id", F.col("img.type").alias("kind"))


@query("image_rows", f"SELECT img.type AS type, img.description AS description, img.confidence AS confidence FROM (SELECT unnest(detected_images) AS img FROM {PAGES})")
def image_rows(spark, d):
    return nested.replace_root(nested.unwind(pages_of(spark, d, "detected_images"), "detected_images", "img"), "img").select("type", "description", "confidence")


@query("pages_with_sure_image", f"SELECT id FROM {PAGES} WHERE len(list_filter(coalesce(detected_images, []), lambda x: x.confidence > 0.9)) > 0")
def pages_with_sure_image(spark, d):
    return pages_of(spark, d, filters.any_element("detected_images", lambda x: x["confidence"] > 0.9).alias("hit")).where("hit").select("id")


@query("image_by_place", f"SELECT k AS key, detected_images[CAST(split_part(k, ':', 2) AS INT) + 1].type AS kind FROM (SELECT id || ':' || (len(detected_images) - 1) AS k, detected_images FROM {PAGES} WHERE len(detected_images) > 0)")
def image_by_place(spark, d):
    p = pages_of(spark, d, "detected_images").where(filters.non_empty("detected_images"))
    keys = p.select(F.concat("id", F.lit(":"), (F.size("detected_images") - 1).cast("string")).alias("key"))
    parts = keys.select("key", F.substring_index("key", ":", 1).alias("page_id"), F.substring_index("key", ":", -1).cast("int").alias("place"))
    found = joins.lookup_one(parts, p.select("id", "detected_images"), "page_id", "id", "p_", required=True)
    return found.select("key", F.get("p_detected_images", F.col("place"))["type"].alias("kind"))


@query("image_totals", f"SELECT count(*) FILTER (len(detected_images) > 0) AS n_pages, CAST(coalesce(sum(len(detected_images)), 0) AS BIGINT) AS n_images FROM {PAGES}")
def image_totals(spark, d):
    p = pages_of(spark, d, F.coalesce(F.size("detected_images"), F.lit(0)).alias("n"))
    return p.agg(F.count_if(F.col("n") > 0).alias("n_pages"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_images"))


@query("usage_map", "SELECT string_agg(type || '=' || n, ' ' ORDER BY type) AS groups FROM (SELECT coalesce(type,'unknown') AS type, count(*) AS n FROM (SELECT DISTINCT * FROM gemini_usage) GROUP BY 1)")
def usage_map(spark, d):
    g = nested.group_map(usage(spark, d), "type", F.count(F.lit(1)))
    shown = F.transform(F.map_entries("groups"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return g.select(F.array_join(shown, " ").alias("groups"))


@query("dense_status", "SELECT count(*) FILTER (o_orderstatus='F') AS f, count(*) FILTER (o_orderstatus='O') AS o, count(*) FILTER (o_orderstatus='P') AS p, count(*) FILTER (o_orderstatus='X') AS x FROM orders")
def dense_status(spark, d):
    return A.count_where(table(spark, d, "orders"), **{s.lower(): F.col("o_orderstatus") == s for s in "FOPX"})


@query("names_by_segment", "SELECT c_mktsegment AS segment, string_agg(c_name, ',' ORDER BY c_acctbal DESC, c_name) AS names FROM (SELECT * FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_name) <= 3) GROUP BY 1")
def names_by_segment(spark, d):
    w = W.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_name")
    top = table(spark, d, "customer").withColumn("rn", F.row_number().over(w)).where("rn <= 3")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("rn", "c_name"))), lambda s: s["c_name"])
    return top.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.array_join(parts, ",").alias("names"))


@query("curated_order", "SELECT p AS name, place, n FROM (VALUES (1,'5-LOW'),(2,'1-URGENT'),(3,'9-NONE')) v(place, p) JOIN (SELECT o_orderpriority AS k, count(*) AS n FROM orders GROUP BY 1) ON k = p")
def curated_order(spark, d):
    listed = spark.createDataFrame([(1, "5-LOW"), (2, "1-URGENT"), (3, "9-NONE")], "place int, name string")
    j = joins.lookup_measures(listed, table(spark, d, "orders"), "name", "o_orderpriority", n=F.count(F.lit(1)))
    return j.where("n > 0").orderBy("place").select("name", "place", "n")


@query("matchups", """WITH e AS (SELECT DISTINCT user_id, event_type FROM events) SELECT x.user_id, x.event_type AS a, y.event_type AS b FROM e x JOIN e y ON x.user_id = y.user_id AND x.event_type < y.event_type ORDER BY md5('7:' || x.user_id || ':' || a || ':' || b), 1, 2, 3 LIMIT 30""")
def matchups(spark, d):
    return ordered.matchups(table(spark, d, "events"), "user_id", "event_type", 30, seed=7)


# -- counts, ranks, pages of results


@query("mean_of_levels", "SELECT o_orderstatus AS g, round(avg(CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '3-MEDIUM' THEN 2 WHEN '5-LOW' THEN 1 ELSE 2 END), 9) AS level FROM orders GROUP BY 1")
def mean_of_levels(spark, d):
    level = F.when(F.col("o_orderpriority") == "1-URGENT", 3).when(F.col("o_orderpriority") == "3-MEDIUM", 2).when(F.col("o_orderpriority") == "5-LOW", 1).otherwise(2)
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("g")).agg(F.round(F.avg(level), 9).alias("level"))


_TALLY = f"""SELECT condition, count(*) FILTER (o='w') AS wins, count(*) FILTER (o='l') AS losses FROM (SELECT condition_a AS condition, CASE winner WHEN 'a' THEN 'w' WHEN 'b' THEN 'l' ELSE 't' END AS o FROM {_JUDGE}
    UNION ALL SELECT condition_b, CASE winner WHEN 'b' THEN 'w' WHEN 'a' THEN 'l' ELSE 't' END FROM {_JUDGE}) GROUP BY 1"""


@query("ranked_conditions", f"SELECT condition, round(CASE WHEN wins + losses > 0 THEN wins * 1.0 / (wins + losses) ELSE 0.5 END, 9) AS win_rate, CAST(rank() OVER (ORDER BY CASE WHEN wins + losses > 0 THEN wins * 1.0 / (wins + losses) ELSE 0.5 END DESC) AS INT) AS place FROM ({_TALLY})")
def ranked_conditions(spark, d):
    t = A.tallies(judgments(spark, d), "condition_a", "condition_b", "winner")
    rate = F.coalesce(F.try_divide(F.col("wins"), F.col("wins") + F.col("losses")), F.lit(0.5))
    return t.withColumn("r", rate).select("condition", F.round("r", 9).alias("win_rate"), F.rank().over(W.orderBy(F.desc("r"))).alias("place"))  # one row per condition


_Z = "abs(wins - (wins + losses) * 0.5) / sqrt((wins + losses) * 0.25)"
_T = f"(1 / (1 + 0.3275911 * ({_Z}) / sqrt(2.0)))"
_ERF = f"(1 - (((((1.061405429 * {_T} - 1.453152027) * {_T}) + 1.421413741) * {_T} - 0.284496736) * {_T} + 0.254829592) * {_T} * exp(-({_Z}) * ({_Z}) / 2))"


@query("binomial_tests", f"SELECT condition, round(CASE WHEN wins + losses > 0 THEN 2 * (1 - 0.5 * (1 + {_ERF})) ELSE 1 END, 9) AS p, CASE WHEN wins + losses > 0 THEN 2 * (1 - 0.5 * (1 + {_ERF})) ELSE 1 END < 0.05 AS significant FROM ({_TALLY})")
def binomial_tests(spark, d):
    t = A.tallies(judgments(spark, d), "condition_a", "condition_b", "winner")
    p = stats.binomial_p(F.col("wins"), F.col("wins") + F.col("losses"))
    return t.select("condition", F.round(p, 9).alias("p"), (p < 0.05).alias("significant"))


@query("rank_frames", """SELECT o_orderkey, round(percent_rank() OVER w, 9) AS share, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 500 PRECEDING AND CURRENT ROW), 2) AS lately FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""")
def rank_frames(spark, d):
    w = W.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.round(F.percent_rank().over(w), 9).alias("share"), F.round(F.sum("o_totalprice").over(w.rangeBetween(-500, 0)), 2).alias("lately"))


@query("page_with_total", "SELECT id, title, (SELECT count(*) FROM books WHERE year IS NOT NULL) AS total, (SELECT count(*) FROM books WHERE year IS NOT NULL) > 30 AS has_more FROM books WHERE year IS NOT NULL ORDER BY year DESC, id LIMIT 20 OFFSET 10")
def page_with_total(spark, d):
    b = books_of(spark, d).where("year is not null").select("id", "title", "year")
    return ordered.page_with_total(b, [F.desc("year"), F.asc("id")], 20, 10).select("id", "title", "total", "has_more")


@query("sorted_by_field", "SELECT id FROM books ORDER BY updated_at DESC NULLS LAST, id LIMIT 25")
def sorted_by_field(spark, d):
    b = books_of(spark, d).select("id", "created_at", "updated_at")
    allowed = {"created": "created_at", "changed": "updated_at"}
    unknown = ordered.sorted_by(b, "changed; drop", allowed, "changed", "id")  # not a field: the default
    return ordered.page_of(b, unknown, 25).select("id")


@query("next_due", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND (o_orderdate IS NULL OR o_orderdate <= TIMESTAMP '2030-01-01') ORDER BY o_orderdate NULLS FIRST, o_orderkey LIMIT 1")
def next_due(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderdate").cast("timestamp").alias("due"))
    return entities.first_due(o, "P", "due", "2030-01-01", "o_orderkey").select("o_orderkey")


@query("alphabetical", "SELECT id, title FROM books ORDER BY title NULLS FIRST, id LIMIT 100")
def alphabetical(spark, d):
    return ordered.page_of(books_of(spark, d).select("id", "title"), [F.asc_nulls_first("title"), F.asc("id")], 100)


@query("misaligned_pages", f"""SELECT id, n - CAST(page_number AS INT) AS off FROM (SELECT id, page_number, TRY_CAST(nullif(regexp_extract(ocr.data, '(?i)<page-num>(\\d+)</page-num>', 1), '') AS INT) AS n FROM {PAGES} QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY page_number, id) <= 50) WHERE abs(n - page_number) > 10""")
def misaligned_pages(spark, d):
    p = pages_of(spark, d, markup.page_number(F.col("ocr.data")).alias("n"))
    first = ordered.renumber(p, "book_id", "page_number", "id", name="place").where("place <= 50")
    return first.where(F.abs(F.col("n") - F.col("page_number")) > 10).select("id", (F.col("n") - F.col("page_number").cast("int")).alias("off"))


@query("training_due", "SELECT source, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) >= 20")
def training_due(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")).where("n >= 20")


@query("stale_results", f"SELECT id FROM {PAGES} WHERE ocr.updated_at < TIMESTAMP '2025-06-01' - INTERVAL 1 DAY OR ocr.updated_at IS NULL")
def stale_results(spark, d):
    return pages_of(spark, d, filters.stale("ocr.updated_at", "2025-06-01", "1 DAY").alias("old")).where("old").select("id")


@query("collection_stats", "SELECT c AS collection, count(*) AS n_books, CAST(sum(coalesce(pages_count, 0)) AS BIGINT) AS n_pages FROM (SELECT CASE WHEN coalesce(year,0) % 2 = 0 THEN 'even' ELSE 'odd' END AS c, pages_count FROM books) GROUP BY 1")
def collection_stats(spark, d):
    b = books_of(spark, d)
    entry = F.struct(F.col("id").alias("bookId"), F.col("title").alias("title"))
    lists = b.groupBy(F.when(F.coalesce("year", F.lit(0)) % 2 == 0, "even").otherwise("odd").alias("id")).agg(F.collect_list(entry).alias("books"))
    lists = lists.withColumn("books", F.concat("books", F.array(F.struct(F.lit("nowhere").alias("bookId"), F.lit("x").alias("title")))))
    return readers.collection_books(lists, b).groupBy("collection").agg(F.count(F.lit(1)).alias("n_books"), F.sum("n_pages").alias("n_pages"))


@query("relevant_documents", r"""WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '(?i)\bsilver\b')) AS a, len(regexp_extract_all(text, '(?i)\bmoon\b')) AS b, len(regexp_extract_all(text, '\w+')) AS size FROM documents),
    s AS (SELECT count(*) AS n, avg(size) AS mean, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM c)
    SELECT doc_id, round(score, 6) AS score FROM (SELECT doc_id, ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * size / mean)) + ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * size / mean)) AS score FROM c, s WHERE a + b > 0) ORDER BY score DESC, doc_id LIMIT 50""")
def relevant_documents(spark, d):
    return relevance(table(spark, d, "documents"), "doc_id", "text", "Silver, moon!").select("doc_id", F.round("score", 6).alias("score"))


# -- updates


@query("fields_set", f"SELECT CASE WHEN ocr IS NULL THEN NULL WHEN ocr.source = 'ai' THEN 'machine' ELSE ocr.source END AS source, count(*) AS n FROM {PAGES} GROUP BY 1")
def fields_set(spark, d):
    changed = changes.set_fields(pages_of(spark, d, "ocr"), F.col("ocr.source") == "ai", ocr__source=F.lit("machine"))
    return changed.groupBy(F.col("ocr.source").alias("source")).agg(F.count(F.lit(1)).alias("n"))


@query("array_changes", "SELECT id, array_to_string(list_sort(list_filter(list_distinct(list_concat(coalesce(categories, []), ['texts', 'old'])), lambda x: x <> 'old')), '|') AS now, len(list_filter(['texts', 'old'], lambda x: NOT list_contains(coalesce(categories, []), x))) > 0 AS changed FROM books")
def array_changes(spark, d):
    b = books_of(spark, d).select("id", "categories", F.coalesce("categories", F.array().cast("array<string>")).alias("before"))
    suggested = F.array(F.lit("texts"), F.lit("old"))
    after = changes.pull(changes.add_to_set(b, "categories", suggested), "categories", "old")
    now = F.array_join(F.array_sort(F.filter("categories", lambda x: x.isNotNull())), "|")
    return after.select("id", now.alias("now"), (F.size(F.array_except(suggested, "before")) > 0).alias("changed"))


@query("words_once", "SELECT id, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ' ') AS words FROM (SELECT id, string_split(lower(title), ' ') AS w FROM books WHERE title IS NOT NULL)")
def words_once(spark, d):
    return books_of(spark, d).where("title is not null").select("id", F.array_join(F.array_distinct(F.split(F.lower("title"), " ")), " ").alias("words"))


@query("splits_undone", f"SELECT id, CAST(row_number() OVER (PARTITION BY book_id ORDER BY page_number, id) AS INT) AS number FROM {PAGES}")
def splits_undone(spark, d):
    p = pages_of(spark, d)
    at = p.where(F.col("page_number") % 3 == 0).select(F.col("id").alias("page_id"), F.lit(480).alias("position"))
    return changes.reset_splits(changes.split_pages(p, at)).select("id", "number")


@query("cascade", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def cascade(spark, d):
    gone = table(spark, d, "customer").where("c_acctbal < 0").select("c_custkey")
    return entities.without_tree(table(spark, d, "orders").select("o_orderkey", "o_custkey"), gone, "o_custkey", "c_custkey").select("o_orderkey")


@query("merged_results", f"SELECT id, CASE WHEN r.t IS NOT NULL THEN r.t ELSE translation.data END AS text FROM {PAGES} p LEFT JOIN (SELECT DISTINCT book_id AS b, page_number AS n, max('new ' || title) OVER (PARTITION BY book_id, page_number) AS t FROM documents WHERE book_id IS NOT NULL AND page_number IS NOT NULL AND title IS NOT NULL) r ON r.b = p.book_id AND r.n = p.page_number WHERE p.translation IS NOT NULL")
def merged_results(spark, d):
    key = lambda n: F.concat("book_id", F.lit("/"), F.col(n).cast("int").cast("string"))
    results = table(spark, d, "documents").where("book_id is not null and page_number is not null").select(key("page_number").alias("rk"), F.concat(F.lit("new "), "title").alias("t"))
    p = pages_of(spark, d, "translation").where("translation is not null")
    whole = F.when(F.col("page_number") == F.floor("page_number"), key("page_number"))
    return writers.merge_results(p.withColumn("pk", whole), results, "pk", "rk", "t", "translation").select("id", F.col("translation.data").alias("text"))


@query("superseded", "SELECT g, string_agg(s_suppkey || ':' || CASE WHEN s_suppkey = top THEN 'published' ELSE 'superseded' END, ' ' ORDER BY s_suppkey) AS editions FROM (SELECT s_nationkey AS g, s_suppkey, max(s_suppkey) OVER (PARTITION BY s_nationkey) AS top FROM supplier) GROUP BY 1")
def superseded(spark, d):
    edition = F.struct(F.col("s_suppkey").alias("id"), F.lit("published").alias("status"))
    e = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("g")).agg(F.array_sort(F.collect_list(edition)).alias("e"), F.max("s_suppkey").alias("top"))
    shown = F.transform(entities.supersede(F.col("e"), F.col("top")), lambda x: F.concat_ws(":", x["id"].cast("string"), x["status"]))
    return e.select("g", F.array_join(shown, " ").alias("editions"))


@query("active_versions", "SELECT s_suppkey, s_suppkey = max(s_suppkey) OVER (PARTITION BY s_nationkey) AS active FROM supplier")
def active_versions(spark, d):
    return entities.active_models(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), "s_nationkey", "s_suppkey").select("s_suppkey", "active")


# -- texts and markup


_PLAIN = "lower(coalesce(language,''))"


@query("writing_direction", f"SELECT id, regexp_matches({_PLAIN}, 'arabic|hebrew|aramaic|syriac|persian|farsi|urdu') AS right_to_left, CASE regexp_extract({_PLAIN}, '(arabic|hebrew|aramaic|syriac|persian|farsi|urdu)', 1) WHEN 'arabic' THEN 'ar' WHEN 'hebrew' THEN 'he' WHEN 'aramaic' THEN 'arc' WHEN 'syriac' THEN 'syr' WHEN 'persian' THEN 'fa' WHEN 'farsi' THEN 'fa' WHEN 'urdu' THEN 'ur' END AS code FROM books")
def writing_direction(spark, d):
    return books_of(spark, d).select("id", text.right_to_left(F.col("language")).alias("right_to_left"), text.script_code(F.col("language")).alias("code"))


@query("slug_labels", "SELECT DISTINCT upper(substr(s, 1, 1)) || replace(substr(s, 2), '-', ' ') AS label FROM (SELECT replace(lower(p_type), ' ', '-') AS s FROM part)")
def slug_labels(spark, d):
    return table(spark, d, "part").select(text.slug_label(F.replace(F.lower("p_type"), F.lit(" "), F.lit("-"))).alias("label")).distinct()


@query("enriched_metrics", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'unknown' ELSE '10.0.0.' || (user_id % 200) END AS ip, substr(repeat(event_type || '/', 60), 1, 200) AS agent FROM events")
def enriched_metrics(spark, d):
    chain = F.concat(F.lit(" 10.0.0."), (F.col("user_id") % 200).cast("string"), F.lit(" , 192.168.0.1"))
    raw = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, chain).alias("forwarded"), F.repeat(F.concat("event_type", F.lit("/")), F.lit(60)).alias("user_agent"))
    return readers.enriched_metrics(raw).select("event_id", "ip", "agent")


@query("plausible_years", r"SELECT id, nullif(regexp_extract(coalesce(published,''), '\b(1[4-9]\d{2}|20[0-2]\d)\b', 1), '') AS year FROM books")
def plausible_years(spark, d):
    return books_of(spark, d).select("id", text.plausible_year(F.col("published")).alias("year"))


@query("text_hashes", "SELECT id, CASE WHEN h >= 2147483648 THEN '-' || lower(to_hex(4294967296 - h)) ELSE lower(to_hex(h)) END AS hash FROM (SELECT id, list_reduce(list_concat([0::BIGINT], list_transform(string_split(title, ''), lambda x: CAST(ord(x) AS BIGINT))), lambda h, c: (h * 31 + c) % 4294967296) AS h FROM books WHERE coalesce(title, '') <> '')")
def text_hashes(spark, d):
    return books_of(spark, d).where(filters.has_text("title")).select("id", text.string_hash("title").alias("hash"))


@query("batch_names", "SELECT DISTINCT CASE WHEN type IN ('ocr','translate') THEN type END AS kind, CASE WHEN type IN ('ocr','translate') THEN substr(book_id, 1, 8) END AS book, CASE coalesce(status,'') WHEN '' THEN 'JOB_STATE_PENDING' ELSE 'JOB_STATE_' || upper(status) END AS state FROM gemini_usage WHERE book_id IS NOT NULL")
def batch_names(spark, d):
    u = table(spark, d, "gemini_usage").where("book_id is not null")
    name = links.batch_name(F.concat_ws("-", F.coalesce("type", F.lit("none")), F.substring("book_id", 1, 8), F.lit("1735689600000")))
    state = links.batch_state(F.when(F.coalesce("status", F.lit("")) != "", F.concat(F.lit("BATCH_STATE_"), F.upper("status"))))
    return u.select(name["kind"].alias("kind"), name["book"].alias("book"), state.alias("state")).distinct()


@query("valid_addresses", r"SELECT id, coalesce(regexp_matches(photo, '^https://([^/:?#]+\.)?(example\.org|example\.com)([/:?#]|$)'), false) AS ok FROM " + PAGES)
def valid_addresses(spark, d):
    return pages_of(spark, d, links.valid_address(F.col("photo"), ["example.org", "example.com"]).alias("ok")).select("id", "ok")


_WORDS = r"list_distinct(list_filter(regexp_split_to_array(trim(regexp_replace(lower(coalesce({0}, '')), '[^\w\s]', '', 'g')), '\s+'), lambda w: length(w) > 2))"


@query("title_likeness", f"SELECT id, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE CAST(floor(len(list_intersect(a, b)) * 100.0 / len(list_distinct(list_concat(a, b))) + 0.5) AS INT) END AS percent FROM (SELECT id, {_WORDS.format('title')} AS a, {_WORDS.format('summary_text')} AS b FROM books WHERE regexp_full_match(coalesce(title, '') || coalesce(summary_text, ''), '[ -~]*'))")
def title_likeness(spark, d):
    # word characters mean ASCII in one engine and any letters in the other; so texts of ASCII are compared
    b = books_of(spark, d).where(F.concat(F.coalesce("title", F.lit("")), F.coalesce("summary_text", F.lit(""))).rlike("^[ -~]*$"))
    return b.select("id", text.word_jaccard(F.col("title"), F.col("summary_text")).alias("percent"))


@query("repaired_markup", "SELECT id, replace(replace(title, '[[', ''), ']]', '') || '  end' AS mended FROM books WHERE title IS NOT NULL AND title NOT LIKE '%[%' AND title NOT LIKE '%<%'")
def repaired_markup(spark, d):
    b = books_of(spark, d).where(F.col("title").isNotNull() & ~F.col("title").rlike(r"[\[<]")).select("id", F.concat("title", F.lit(" ]] end")).alias("t"))
    return b.withColumn("i", F.get(markup.issues("t"), F.lit(0))).select("id", markup.repaired(F.col("t"), F.col("i")).alias("mended"))


@query(
    "planted_faults",
    """SELECT id, kind, CAST(length(title) + p AS INT) AS place FROM (SELECT id, title FROM books WHERE title IS NOT NULL AND NOT regexp_matches(title, '[][<>]')), (VALUES ('unclosed_close', 1), ('unbalanced_center', 4), ('unknown_xml_tag', 7), ('unclosed_xml', 7), ('empty_xml_tag', 11), ('unknown_tag', 25), ('empty_tag', 25), ('unclosed_open', 34)) v(kind, p)""",
)
def planted_faults(spark, d):
    b = books_of(spark, d).where(F.col("title").isNotNull() & ~F.col("title").rlike(r"[\[\]<>]"))
    made = F.concat("title", F.lit(" ]] -> <b> <note> </note>[[foo:]] [[x"))
    return b.select("id", F.explode(markup.issues(made)).alias("i")).select("id", F.col("i.type").alias("kind"), F.col("i.position").alias("place"))


@query("emptied_tags", "SELECT id, coalesce(title, '') || 'x' AS cleaned, 2 AS removed FROM books")
def emptied_tags(spark, d):
    t = F.concat(F.coalesce("title", F.lit("")), F.lit("<note> </note>[[term: ]]x"))
    return books_of(spark, d).select("id", markup.without_empty_tags(t).alias("e")).select("id", "e.cleaned", "e.removed")


_STRIP = r"regexp_replace(regexp_replace(coalesce({0}, ''), '(?is)<[a-z-]+>.*?</[a-z-]+>', '', 'g'), '\[\[[^\]]+\]\]', '', 'g')"
_BODY = r"trim(regexp_replace(regexp_replace(regexp_replace(" + _STRIP + r", '(?i)^```(?:markdown)?\s*\n?', '', 'g'), '\n?```\s*$', '', 'g'), '^\s+|\s+$', '', 'g'))"


@query("plain_texts", f"SELECT id, {_BODY.format('ocr.data')} AS plain FROM {PAGES}")
def plain_texts(spark, d):
    return pages_of(spark, d, markup.plain_text(F.col("ocr.data")).alias("plain")).select("id", "plain")


_TAGGED = "coalesce(nullif(trim(regexp_extract(coalesce(t,''), '(?is)<summary>(.*?)</summary>', 1)), ''), nullif(trim(regexp_extract(coalesce(t,''), '(?i)\\[\\[summary:\\s*(.*?)\\]\\]', 1)), ''))"
_FIRST = f"trim(list_filter(regexp_split_to_array({_BODY.format('t')}, '\\n\\n+'), lambda p: length(trim(p)) > 30)[1])"


@query("page_summaries_or_opening", f"SELECT id, summary FROM (SELECT id, coalesce({_TAGGED}, nullif(s, ''), CASE WHEN length(coalesce(t,'')) > 50 THEN CASE WHEN length(f) > 300 THEN regexp_replace(substr(f, 1, 300), '\\s+\\S*$', '') || '...' ELSE f END END) AS summary FROM (SELECT id, translation.data AS t, summary.data AS s, {_FIRST.replace('coalesce(t,', 'coalesce(translation.data,').replace('coalesce(t, ', 'coalesce(translation.data, ')} AS f FROM {PAGES})) WHERE summary IS NOT NULL")
def page_summaries_or_opening(spark, d):
    return pages_of(spark, d, markup.page_summary(F.col("translation.data"), F.col("summary.data")).alias("summary")).where("summary is not null").select("id", "summary")


@query("term_kinds", "SELECT DISTINCT term, CASE WHEN regexp_matches(term, '^[A-Z][a-z]+ [A-Z][a-z]+') THEN 'person' WHEN regexp_matches(lower(term), 'city|kingdom|rome|egypt') THEN 'place' ELSE 'concept' END AS kind FROM (SELECT unnest([n_name, 'City of ' || n_name, 'John ' || upper(substr(n_name,1,1)) || lower(substr(n_name,2)), lower(n_name)]) AS term FROM nation)")
def term_kinds(spark, d):
    n = F.col("n_name")
    terms = F.array(n, F.concat(F.lit("City of "), n), F.concat(F.lit("John "), F.upper(F.substring(n, 1, 1)), F.lower(F.substring(n, 2, 100))), F.lower(n))
    t = table(spark, d, "nation").select(F.explode(terms).alias("term"))
    return t.select("term", markup.term_kind(F.col("term")).alias("kind")).distinct()


@query("headings", "SELECT id, title, 2 AS level FROM books WHERE length(title) >= 5 AND contains(title, ' ') AND NOT regexp_matches(title, '^[a-z]') AND title NOT LIKE '[[%' AND NOT regexp_matches(title, '(?i)^(et|uel|aut|sed|nam|cum|si|in|de|ad|ex|per|pro|quod|quia|quam|tum|tunc|enim|autem|uero|ergo|igitur|itaque)\\s')")
def headings(spark, d):
    made = F.concat(F.lit("Opening words.\n## -> **"), "title", F.lit("** <-\n# page 12\n### ab\n# minor\n## et cetera\n#### deep"))
    b = books_of(spark, d).where(filters.has_text("title")).where(F.col("title").contains(" ") & ~F.col("title").rlike("^[a-z]")).select("id", F.explode(markup.headings(made)).alias("h"))
    return b.select("id", "h.title", "h.level")


@query("openings_replaced", r"SELECT doc_id, CASE WHEN len(s) > 1 THEN 'New. ' || array_to_string(s[2:], ' ') ELSE 'New. ' END AS text FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents)")
def openings_replaced(spark, d):
    return table(spark, d, "documents").select("doc_id", text.replace_opening(F.col("text"), 1, F.lit("New.")).alias("text"))


@query("demultiplexed", "SELECT id, 1 AS ordinal, trim(title) AS text FROM books WHERE trim(coalesce(title,'')) <> '' UNION ALL SELECT id, 2, id FROM books")
def demultiplexed(spark, d):
    reply = F.concat(F.lit("Here:\n=== PAGE 1 ===\n"), F.coalesce("title", F.lit("")), F.lit("\n\n=== page 2 ===\n"), "id", F.lit("\n=== PAGE 9 ===\nbeyond\n=== PAGE 2 ===\n  "))
    return books_of(spark, d).select("id", F.explode(markup.demultiplex(reply, F.lit(3))).alias("p")).select("id", "p.ordinal", "p.text")


@query("escaped_texts", "SELECT id, replace(replace(replace(replace(replace(title || ' <&\"''>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') AS escaped FROM books")
def escaped_texts(spark, d):
    return books_of(spark, d).select("id", text.escape_xml(F.concat("title", F.lit(" <&\"'>"))).alias("escaped"))


@query("rejected_editions", r"SELECT id FROM books WHERE regexp_matches(coalesce(ia_identifier,''), '_20[2-9]\d|(?i:penguin|oxford|cambridge)|(?i:translated.*by.*\d{4})|[0-5]$') OR regexp_matches(coalesce(title,''), '_20[2-9]\d|(?i:penguin|oxford|cambridge)|(?i:translated.*by.*\d{4})|[0-5]$')")
def rejected_editions(spark, d):
    patterns = [r"_20[2-9]\d", r"(?i:penguin|oxford|cambridge)", r"(?i:translated.*by.*\d{4})", r"[0-5]$"]
    return books_of(spark, d).where(filters.rejected(["ia_identifier", "title"], patterns)).select("id")


@query("json_kinds", "SELECT CASE WHEN lang IS NULL THEN 'none' WHEN doc_id % 2 = 0 THEN 'STRING' ELSE 'number' END AS kind, count(*) AS n FROM documents GROUP BY 1")
def json_kinds(spark, d):
    docs = table(spark, d, "documents")
    made = F.when(F.col("doc_id") % 2 == 0, F.to_json(F.struct(F.col("lang").alias("a")))).otherwise(F.to_json(F.struct(F.when(F.col("lang").isNotNull(), F.col("doc_id")).alias("a"))))
    kind = filters.json_kind(made, "$.a")
    shown = F.when(kind.isNull(), "none").when(kind == "STRING", "STRING").otherwise("number")
    return docs.groupBy(shown.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("titles_without", "SELECT id FROM books WHERE title IS NOT NULL AND lower(title) NOT LIKE '%de%'")
def titles_without(spark, d):
    return books_of(spark, d).where(F.col("title").rlike("(?is)^(?!.*de).*$")).select("id")


# -- page layout


@query("split_detections")
def split_detections(spark, d):
    # each vector as a small grey picture, sixteen columns wide
    grey = F.transform("embedding", lambda x: F.lpad(F.hex(F.greatest(F.least(((x + 0.5) * 255).cast("int"), F.lit(255)), F.lit(0))), 2, "0"))
    e = table(spark, d, "embeddings").select("vec_id", F.unhex(F.array_join(grey, "")).alias("pixels"))
    return e.select("vec_id", layout.detect_split("pixels", F.lit(16), F.lit(4)).alias("s")).select("vec_id", "s.*")


# -- links and citations


def _digits(n: str, base: int, count: int, alphabet: str) -> str:
    parts = ", ".join(f"substr('{alphabet}', CAST(({n} // {base**k}::HUGEINT) % {base} AS INT) + 1, 1)" for k in reversed(range(count)))
    return f"array_to_string([{parts}], '')"


_HEX = " + ".join(f"(strpos('0123456789abcdef', lower(substr(book_id, {k}, 1))) - 1)::HUGEINT * {16 ** (24 - k)}::HUGEINT" for k in range(1, 25))


@query("shortlinks", f"SELECT id, CASE WHEN ok THEN regexp_replace({_digits('n', 62, 19, ids.DIGITS)}, '^0+', '') END AS code, CASE WHEN ok THEN lower(book_id) END AS book_id, CASE WHEN ok THEN CAST(page_number AS INT) END AS page FROM (SELECT id, book_id, page_number, trunc(page_number) BETWEEN 1 AND 65535 AND regexp_full_match(book_id, '[0-9a-fA-F]{{24}}') AS ok, ({_HEX}) * 65536::HUGEINT + CAST(trunc(page_number) AS HUGEINT) AS n FROM {PAGES})")
def shortlinks(spark, d):
    p = pages_of(spark, d).withColumn("code", ids.shortlink("book_id", F.col("page_number").cast("int")))
    return p.select("id", "code", ids.shortlink_parts("code").alias("x")).select("id", "code", F.col("x.book_id").alias("book_id"), F.col("x.page").alias("page"))


_TWO = "len(string_split(who, ',')) = 2"
_P = [f"trim(split_part(who, ',', {k}))" for k in (1, 2)]
_FL, _LF = f"CASE WHEN {_TWO} THEN {_P[1]} || ' ' || {_P[0]} ELSE who END", f"CASE WHEN {_TWO} THEN {_P[0]} || ', ' || {_P[1]} ELSE who END"


@query(
    "citation_styles",
    f"""SELECT id, '(' || {_P[0]} || ' ' || date || ', p. 3)' AS inline, ({_FL}) || ', ' || name || ', trans. the library (2025), 3' || coalesce('. DOI: ' || doi, '') || '.' AS footnote,
        ({_LF}) || '. ' || name || '. Translated by the library. 2025.' || coalesce(' DOI: ' || doi || '.', '') AS bibliography, ({_LF}) || '. ' || date || '. ' || name || '. Translated by the library. 2025.' || coalesce(' https://doi.org/' || doi || '.', '') AS chicago,
        ({_LF}) || '. ' || name || '. Translated by the library, 2025.' || coalesce(' DOI: ' || doi || '.', '') AS mla,
        '@book{{' || regexp_replace(lower({_P[0]}), '[^a-z]', '', 'g') || date || ',' || chr(10) || '  author = {{' || ({_LF}) || '}},' || chr(10) || '  title = {{' || name || '}},' || chr(10) || '  year = {{' || date || '}},' || chr(10) || '  translator = {{the library}},' || chr(10) || '  note = {{Translation published 2025}}' || coalesce(',' || chr(10) || '  doi = {{' || doi || '}}', '') || coalesce(',' || chr(10) || '  url = {{https://doi.org/' || doi || '}}', '') || chr(10) || '}}' AS bibtex
        FROM (SELECT id, doi, coalesce(author, 'Unknown') AS who, coalesce(nullif(published, ''), 'n.d.') AS date, coalesce(display_title, title) AS name FROM books)""",
)
def citation_styles(spark, d):
    c = ids.citations(F.col("author"), F.coalesce("display_title", "title"), F.col("published"), F.col("doi"), F.lit(3), "the library", 2025)
    return books_of(spark, d).select("id", c.alias("c")).select("id", "c.*")


# -- sources and sinks


@query("manifest_pages", "SELECT 'm-' || n_nationkey AS manifest_id, CAST(i AS INT) AS page_number, 'leaf ' || i AS label, CAST(10 * i AS INT) AS width, 'img-' || n_nationkey || '-' || i AS image FROM nation, generate_series(2, 3) g(j), LATERAL (SELECT j - 1 AS i0, j AS i)".replace("CAST(i AS INT) AS page_number", "CAST(i - 1 AS INT) AS page_number"))
def manifest_pages(spark, d):
    n = F.col("n_nationkey").cast("string")
    canvas = lambda i: F.concat(F.lit(f'{{"@id":"c{i}","label":"leaf {i}","width":{10 * i},"height":5,"images":[{{"resource":{{"@id":"img-'), n, F.lit(f'-{i}"}}}}]}}'))
    made = F.concat(F.lit('{"@id":"m-'), n, F.lit('","sequences":[{"canvases":['), F.concat_ws(",", *[canvas(i) for i in (1, 2, 3, 4)]), F.lit("]}]}"))
    broken = table(spark, d, "region").select(F.lit("{not json").alias("value"))
    return readers.manifest_pages(table(spark, d, "nation").select(made.alias("value")).unionByName(broken), first=2, last=3).select("manifest_id", "page_number", "label", "width", "image")


@query("archive_pages", "SELECT id AS identifier, CAST(n + 1 AS INT) AS page_number, 'https://example.org/' || id || '/page/' || n || '.jpg' AS photo FROM (SELECT id, unnest(generate_series(0, CASE WHEN coalesce(pages_count, 0) > 0 THEN pages_count ELSE 2 END - 1)) AS n FROM books)")
def archive_pages(spark, d):
    files = F.array(F.lit("a_0001.jp2"), F.lit("meta.xml"), F.lit("a_0002.JPG"))
    items = books_of(spark, d).select(F.col("id").alias("identifier"), F.col("pages_count").alias("image_count"), files.alias("file_names"), F.lit("<page a><page b><page c>").alias("scandata"))
    return readers.archive_pages(items)


@query("file_pages", "SELECT id AS book_id, CAST(i AS INT) AS page_number, list_filter([id || '.jpg', '', NULL, 'b.jpg'], lambda x: coalesce(trim(x), '') <> '')[i] AS photo FROM books, generate_series(1, 2) g(i)")
def file_pages(spark, d):
    names = F.array(F.concat("id", F.lit(".jpg")), F.lit(""), F.lit(None).cast("string"), F.lit("b.jpg"))
    return readers.file_pages(books_of(spark, d).select(F.col("id").alias("book_id"), names.alias("page_files")))


@query("json_lines_read", "SELECT n_nationkey, n_name, false AS bad FROM nation UNION ALL SELECT -1, '{broken', true FROM region WHERE r_regionkey = 0")
def json_lines_read(spark, d):
    path = scratch(spark, "lines")
    lines = table(spark, d, "nation").select(F.to_json(F.struct("n_nationkey", "n_name")).alias("value"))
    more = table(spark, d, "region").where("r_regionkey = 0").select(F.explode(F.array(F.lit("{broken"), F.lit("  "))).alias("value"))
    lines.unionByName(more).write.text(path)
    good, bad = readers.json_lines(spark, path, "n_nationkey int, n_name string")
    return good.withColumn("bad", F.lit(False)).unionByName(bad.select(F.lit(-1).alias("n_nationkey"), F.col("value").alias("n_name"), F.lit(True).alias("bad")))


@query("json_documents_read", "SELECT r_regionkey, r_name FROM region")
def json_documents_read(spark, d):
    path = scratch(spark, "documents")
    every = table(spark, d, "region").agg(F.to_json(F.array_sort(F.collect_list(F.struct("r_regionkey", "r_name")))).alias("value"))  # five rows
    every.write.text(path)
    return readers.json_documents(spark, path, "r_regionkey int, r_name string")


@query("csv_read", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def csv_read(spark, d):
    path = scratch(spark, "csv")
    table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal").write.csv(path, header=True)
    return readers.csv_table(spark, path, "s_suppkey bigint, s_name string, s_acctbal double")


@query("appended", "SELECT n_regionkey, count(*) * 2 AS n FROM nation GROUP BY 1")
def appended(spark, d):
    path = scratch(spark, "appended")
    for _ in range(2):
        writers.append(table(spark, d, "nation"), path, "n_regionkey")
    return spark.read.parquet(path).groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"))


@query("book_texts", f"SELECT book_id, md5(string_agg('=== ' || CAST(CAST(trunc(page_number) AS INT) AS VARCHAR) || ' ===' || chr(10) || b, chr(10) || chr(10) ORDER BY page_number, id)) AS hash FROM (SELECT book_id, page_number, id, array_to_string(list_filter([nullif(ocr.data, ''), nullif(translation.data, '')], lambda x: x IS NOT NULL), chr(10) || chr(10)) AS b FROM {PAGES}) WHERE b <> '' GROUP BY 1")
def book_texts(spark, d):
    return writers.book_texts(pages_of(spark, d, "ocr", "translation"), "both").select("book_id", F.md5("text").alias("hash"))


@query("sitemap", f"SELECT 'https://example.org/book/' || id AS loc, updated_at AS changed FROM books UNION ALL SELECT 'https://example.org/book/' || book_id || '/page/' || id, updated_at FROM {PAGES}")
def sitemap(spark, d):
    return writers.sitemap_lines(books_of(spark, d), pages_of(spark, d), "https://example.org")


# -- the search interface

_ONE = f"(SELECT * FROM {PAGES} WHERE book_id = {FIRST_BOOK})"


@query("in_book_counts", f"SELECT count(*) AS n, count(*) FILTER (o) AS in_ocr, count(*) FILTER (t) AS in_translation FROM (SELECT regexp_matches(coalesce(ocr.data,''), '(?i)sun|the') AS o, regexp_matches(coalesce(translation.data,''), '(?i)sun|the') AS t FROM {_ONE}) WHERE o OR t")
def in_book_counts(spark, d):
    return Library(spark, d).in_book(first_book(spark, d), "sun the")["counts"]


@query("retrieved_pages", f"SELECT id, CAST(score AS INT) AS score FROM (SELECT id, page_number, len(regexp_extract_all(t, '(?i)silver')) + len(regexp_extract_all(t, '(?i)moon')) AS score FROM (SELECT id, page_number, coalesce(nullif(translation.data,''), ocr.data) AS t FROM {_ONE}) WHERE coalesce(t,'') <> '') ORDER BY score DESC, page_number, id LIMIT 15")
def retrieved_pages(spark, d):
    return Library(spark, d).retrieve(first_book(spark, d), "What is the silver of the moon?").select("id", F.col("score").cast("int").alias("score"))


@query("question_sources", f"""WITH s AS (SELECT id, book_id, len(regexp_extract_all(t, '(?i)mercury')) + len(regexp_extract_all(t, '(?i)serpent')) + len(regexp_extract_all(t, '(?i)gold')) AS score FROM (SELECT id, book_id, translation.data AS t FROM {PAGES}) WHERE length(t) > 100 AND NOT regexp_matches(t, '(?i)<warning>|\\[\\[warning'))
    SELECT id, book_id, CAST(score AS INT) AS score FROM (SELECT * FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY score DESC, id) = 1) ORDER BY score DESC, id LIMIT 3""")
def question_sources(spark, d):
    return Library(spark, d).sources_for("How does mercury serpent gold?").select("id", "book_id", F.col("score").cast("int").alias("score"))


@query("pages_around", f"""WITH h AS (SELECT book_id AS b, page_number AS n FROM {PAGES} WHERE id = (SELECT min(x.id) FROM {PAGES} x JOIN {PAGES} y ON x.book_id = y.book_id AND y.page_number = x.page_number + 1 WHERE length(y.translation.data) > 50)) SELECT id, page_number, substr(translation.data, 1, 800) AS text FROM {PAGES}, h
    WHERE book_id = b AND abs(page_number - n) <= 2 AND page_number <> n AND length(translation.data) > 50 AND NOT regexp_matches(translation.data, '(?i)<warning>|\\[\\[warning')""")
def pages_around(spark, d):
    p = pages_of(spark, d, filters.has_text("translation.data", 50).alias("ok"))
    after = joins.neighbours(p, "book_id", "page_number", "ok").where("after_1").agg(F.min("id")).first()[0]  # one value
    return Library(spark, d).around(after)


@query("series_images", f"""SELECT key, round(score, 9) AS score FROM (SELECT book_id, id || ':' || (i - 1) AS key, 50 * img.confidence + CASE WHEN length(coalesce(img.description,'')) > 50 THEN 10 ELSE 0 END + CASE WHEN img.type IS NOT NULL THEN 5 ELSE 0 END AS score FROM (SELECT id, book_id, unnest(generate_series(1, len(detected_images))) AS i, unnest(detected_images) AS img FROM {PAGES}) WHERE img.confidence >= 0.7
    QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY score DESC, key) = 1) ORDER BY score DESC, key LIMIT 5""")
def series_images(spark, d):
    rich = 50 * F.col("confidence") + F.when(filters.has_text("description", 50), 10).otherwise(0) + F.when(F.col("type").isNotNull(), 5).otherwise(0)
    return Library(spark, d).post_images(5).select("key", F.round(rich, 9).alias("score"))


@query("book_index", f"SELECT term, count(DISTINCT n) AS n_places FROM (SELECT trim(unnest(string_split(s, ','))) AS term, CAST(page_number AS INT) AS n FROM (SELECT page_number, unnest(regexp_extract_all(coalesce(translation.data,''), '(?is)<summary>(.*?)</summary>', 1)) AS s FROM {PAGES} WHERE book_id = (SELECT min(book_id) FROM {PAGES} WHERE translation.data LIKE '%<summary>%'))) WHERE term <> '' GROUP BY 1")
def book_index(spark, d):
    book = pages_of(spark, d, F.contains("translation.data", F.lit("<summary>")).alias("ok")).where("ok").agg(F.min("book_id")).first()[0]  # one value
    return Library(spark, d).index(book, "summary").select("term", "n_places")


@query("entity_page", f"""WITH t AS (SELECT book_id, page_number, trim(unnest(string_split(s, ','))) AS term FROM (SELECT book_id, page_number, unnest(regexp_extract_all(coalesce(translation.data,''), '(?is)<summary>(.*?)</summary>', 1)) AS s FROM {PAGES})),
    e AS (SELECT lower(term) AS name, CASE WHEN regexp_matches(term, '^[A-Z][a-z]+ [A-Z][a-z]+') THEN 'person' WHEN regexp_matches(lower(term), 'city|kingdom|rome|egypt') THEN 'place' ELSE 'concept' END AS kind, count(DISTINCT book_id) AS book_count, count(DISTINCT book_id || '/' || page_number) AS total_mentions FROM t WHERE term <> '' GROUP BY ALL)
    SELECT name, kind, book_count, total_mentions, (SELECT count(*) FROM e) AS total, (SELECT count(*) FROM e) > 12 AS has_more FROM e ORDER BY total_mentions DESC, name, kind LIMIT 10 OFFSET 2""")
def entity_page(spark, d):
    return Library(spark, d).entities("summary", limit=10, offset=2).select("name", "kind", "book_count", "total_mentions", "total", "has_more")
