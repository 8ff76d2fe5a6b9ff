"""Queries over books and pages: listings, search, indexes, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.functions import ids, links, markup, text
from scriptorium.operators import aggregates as A
from scriptorium.operators import changes, entities, filters, joins, metadata, nested, ordered
from scriptorium.operators.ranking import latest_rows
from scriptorium.plans.base import query
from scriptorium.session import table

#: The latest state of each page, in the comparison engine's SQL.
PAGES = "(SELECT * FROM pages WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1)"


def pages_of(spark: SparkSession, d: str, *columns: Column | str) -> DataFrame:
    """The latest state of each page; only the asked columns travel."""
    narrow = table(spark, d, "pages").select("id", "book_id", "page_number", "updated_at", *columns)
    return latest_rows(narrow, "id", "updated_at")


def books_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "books")


@query(
    "book_list",
    f"""SELECT b.id, coalesce(b.display_title, b.title) AS title, b.author, coalesce(p.n, 0) AS n_pages FROM books b
        LEFT JOIN (SELECT book_id, count(*) AS n FROM {PAGES} GROUP BY book_id) p ON p.book_id = b.id""",
)
def book_list(spark, d):
    counted = joins.lookup_measures(books_of(spark, d), pages_of(spark, d), "id", "book_id", n=F.count(F.lit(1)))
    return counted.select("id", F.coalesce("display_title", "title").alias("title"), "author", F.coalesce("n", F.lit(0)).alias("n_pages"))


@query(
    "book_status",
    f"""SELECT b.id, coalesce(n,0) AS n_pages, coalesce(o,0) AS with_ocr, coalesce(t,0) AS with_translation,
        CAST(CASE WHEN coalesce(n,0) > 0 THEN floor(o*100.0/n+0.5) ELSE 0 END AS INT) AS ocr_percent,
        CAST(CASE WHEN coalesce(n,0) > 0 THEN floor(t*100.0/n+0.5) ELSE 0 END AS INT) AS translation_percent
        FROM books b LEFT JOIN (SELECT book_id, count(*) n, count(*) FILTER (length(coalesce(ocr.data,''))>0) o, count(*) FILTER (length(coalesce(translation.data,''))>0) t
        FROM {PAGES} GROUP BY book_id) p ON p.book_id=b.id""",
)
def book_status(spark, d):
    p = pages_of(spark, d, filters.has_text("ocr.data").alias("o"), filters.has_text("translation.data").alias("t"))
    c = joins.lookup_measures(books_of(spark, d).select("id"), p, "id", "book_id", n=F.count(F.lit(1)), o=F.count_if("o"), t=F.count_if("t"))
    zero = lambda x: F.coalesce(F.col(x), F.lit(0))
    return c.select("id", zero("n").alias("n_pages"), zero("o").alias("with_ocr"), zero("t").alias("with_translation"),
                    A.percent(zero("o"), zero("n")).alias("ocr_percent"), A.percent(zero("t"), zero("n")).alias("translation_percent"))


@query(
    "home_order",
    """SELECT id, CAST(row_number() OVER (ORDER BY (coalesce(pages_translated,0) > 0) DESC, last_translation_at DESC NULLS LAST, title NULLS FIRST, id) AS INT) AS place
       FROM books ORDER BY place LIMIT 50""",
)
def home_order(spark, d):
    order = [F.desc(F.coalesce("pages_translated", F.lit(0)) > 0), F.desc_nulls_last("last_translation_at"), F.asc_nulls_first("title"), F.asc("id")]
    top = ordered.page_of(books_of(spark, d).select("id", "pages_translated", "last_translation_at", "title"), order, 50)
    return top.withColumn("place", F.row_number().over(W.orderBy(*order))).select("id", "place")  # at most 50 rows


@query(
    "category_counts",
    """SELECT category, count(*) AS n_books FROM (SELECT unnest(categories) AS category FROM books) WHERE category IS NOT NULL GROUP BY category""",
)
def category_counts(spark, d):
    return nested.unwind(books_of(spark, d).select("categories"), "categories", "category").where("category is not null").groupBy("category").agg(F.count(F.lit(1)).alias("n_books"))


@query(
    "categories_with_source",
    """SELECT id, coalesce(list_contains(categories, (SELECT min(c) FROM (SELECT unnest(categories) c FROM books))), false) AS in_first, len(coalesce(categories, [])) > 0 AS has_any FROM books""",
)
def categories_with_source(spark, d):
    b = books_of(spark, d)
    first = nested.unwind(b.select("categories"), "categories", "c").agg(F.min("c").alias("first"))
    return b.crossJoin(F.broadcast(first)).select("id", F.coalesce(F.array_contains("categories", F.col("first")), F.lit(False)).alias("in_first"), filters.non_empty("categories").alias("has_any"))


_LANG_CASE = " ".join(f"WHEN lower(trim(language))='{k}' THEN '{v}'" for k, v in text.LANGUAGE_NAMES.items())
_LANG = f"CASE WHEN coalesce(language,'')='' THEN 'Unknown' {_LANG_CASE} ELSE upper(substr(trim(language),1,1)) || substr(trim(language),2) END"


@query(
    "language_list",
    f"""SELECT lang, count(*) AS n_books, coalesce(array_to_string(list_sort(list(DISTINCT trim(language)) FILTER (trim(language) <> lang AND trim(language) <> '')), '|'), '') AS variants
        FROM (SELECT language, {_LANG} AS lang FROM books) GROUP BY lang""",
)
def language_list(spark, d):
    b = books_of(spark, d).select("language", text.language_label(F.col("language"), text.LANGUAGE_NAMES).alias("lang"))
    other = F.when((F.trim("language") != F.col("lang")) & (F.trim("language") != ""), F.trim("language"))
    return b.groupBy("lang").agg(F.count(F.lit(1)).alias("n_books"), F.array_join(F.array_sort(F.collect_set(other)), "|").alias("variants"))


@query(
    "catalogue_export",
    f"""SELECT b.id, substr(coalesce(s.summary, b.summary_text, ''), 1, 500) AS summary FROM books b LEFT JOIN
        (SELECT book_id, arg_min(summary.data, (page_number, id)) AS summary FROM {PAGES} WHERE coalesce(summary.data,'') <> '' GROUP BY book_id) s ON s.book_id=b.id""",
)
def catalogue_export(spark, d):
    p = pages_of(spark, d, F.col("summary.data").alias("s")).where(filters.has_text("s"))
    c = joins.lookup_measures(books_of(spark, d), p, "id", "book_id", s=F.min_by("s", F.struct("page_number", "id")))
    return c.select("id", F.substring(F.coalesce("s", "summary_text", F.lit("")), 1, 500).alias("summary"))


@query(
    "search_books",
    """SELECT id, published, (lower(coalesce(title,'')) LIKE '%sun%') AS in_title FROM books WHERE (lower(coalesce(title,'')) LIKE '%sun%' OR lower(coalesce(display_title,'')) LIKE '%sun%' OR lower(coalesce(author,'')) LIKE '%sun%')""",
)
def search_books(spark, d):
    b = books_of(spark, d)
    return b.where(filters.any_field_contains(["title", "display_title", "author"], "sun")).select("id", "published", filters.contains_ci("title", "sun").alias("in_title"))


@query(
    "search_published_range",
    """SELECT id, published FROM books WHERE published >= '1500' AND published <= '1600'""",
)
def search_published_range(spark, d):
    return books_of(spark, d).where(filters.between("published", "1500", "1600")).select("id", "published")


@query(
    "search_year_text",
    r"""SELECT id, TRY_CAST(nullif(regexp_extract(published, '(\d{4})', 1), '') AS INT) AS year_found FROM books WHERE TRY_CAST(nullif(regexp_extract(published, '(\d{4})', 1), '') AS INT) BETWEEN 1550 AND 1650""",
)
def search_year_text(spark, d):
    return books_of(spark, d).withColumn("year_found", filters.year_in_text("published")).where(filters.between("year_found", 1550, 1650)).select("id", "year_found")


@query(
    "nearby_years",
    """SELECT id, year FROM books WHERE abs(year-1600) <= 20 ORDER BY abs(year-1600), id LIMIT 10""",
)
def nearby_years(spark, d):
    return ordered.nearest(books_of(spark, d).select("id", "year"), "year", 1600, 20, 10, "id")


_SNIP = """CASE WHEN strpos(lower(t),'mercury')>0 THEN
 (CASE WHEN strpos(lower(t),'mercury')-1-150>0 THEN '...' ELSE '' END) || substr(t, greatest(strpos(lower(t),'mercury')-1-150,0)+1, least(strpos(lower(t),'mercury')-1+7+150,length(t))-greatest(strpos(lower(t),'mercury')-1-150,0))
 || (CASE WHEN least(strpos(lower(t),'mercury')-1+7+150,length(t))<length(t) THEN '...' ELSE '' END) ELSE substr(t,1,300) || CASE WHEN length(t)>300 THEN '...' ELSE '' END END"""


@query(
    "search_pages",
    f"""SELECT id, book_id, {_SNIP} AS snippet FROM (SELECT id, book_id, coalesce(translation.data,'') AS t FROM {PAGES}) WHERE lower(t) LIKE '%mercury%'""",
)
def search_pages(spark, d):
    t = F.coalesce("translation.data", F.lit(""))
    p = pages_of(spark, d, F.when(filters.contains_ci(t, "mercury"), text.snippet(t, "mercury")).alias("snippet"))
    return p.where("snippet is not null").select("id", "book_id", "snippet")


@query(
    "search_union",
    f"""SELECT * FROM (SELECT 'book' AS type, id, id AS book_id, title AS label FROM books WHERE lower(coalesce(title,'')) LIKE '%gold%'
        UNION ALL SELECT 'page', p.id, p.book_id, b.title FROM {PAGES} p JOIN books b ON b.id=p.book_id WHERE lower(coalesce(p.translation.data,'')) LIKE '%golden metal%')
        ORDER BY CASE WHEN type='book' THEN 0 ELSE 1 END, id LIMIT 100""",
)
def search_union(spark, d):
    b = books_of(spark, d)
    hits = b.where(filters.contains_ci("title", "gold")).select("id", F.col("id").alias("book_id"), F.col("title").alias("label"))
    p = pages_of(spark, d, filters.contains_ci("translation.data", "golden metal").alias("hit")).where("hit").select("id", "book_id")
    on_pages = joins.lookup_one(p, b.select("id", "title"), "book_id", "id", "b_", required=True).select("id", "book_id", F.col("b_title").alias("label"))
    both = nested.union_tagged({"book": hits, "page": on_pages})
    return both.orderBy(F.when(F.col("type") == "book", 0).otherwise(1), "id").limit(100)


@query(
    "quick_search",
    """SELECT id, title FROM books WHERE lower(strip_accents(coalesce(title,''))) LIKE '%traite%' ORDER BY length(title), id LIMIT 10""",
)
def quick_search(spark, d):
    b = books_of(spark, d).select("id", "title").where(F.col("title").isNotNull())
    return b.where(text.normalize_text("title").contains("traite")).orderBy(F.length("title"), "id").limit(10)


@query(
    "catalog_words",
    """SELECT catalog_id FROM external_catalog WHERE (lower(coalesce(title,'')) LIKE '%von%' OR lower(coalesce(author,'')) LIKE '%von%') AND (lower(coalesce(title,'')) LIKE '%kraut%' OR lower(coalesce(author,'')) LIKE '%kraut%')""",
)
def catalog_words(spark, d):
    return table(spark, d, "external_catalog").where(filters.all_words_in(["title", "author"], "von kraut")).select("catalog_id")


@query(
    "documents_any_word",
    """SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)tower|serpent')""",
)
def documents_any_word(spark, d):
    return table(spark, d, "documents").where(filters.any_word_in("text", "tower serpent")).select("doc_id")


@query(
    "keyword_score",
    """SELECT doc_id, CAST(len(regexp_extract_all(text, '(?i)silver')) + len(regexp_extract_all(text, '(?i)moon')) AS INT) AS score FROM documents
       WHERE len(regexp_extract_all(text, '(?i)silver')) + len(regexp_extract_all(text, '(?i)moon')) > 0 ORDER BY score DESC, doc_id LIMIT 15""",
)
def keyword_score(spark, d):
    docs = table(spark, d, "documents").select("doc_id", text.keyword_score(F.col("text"), ["silver", "moon"]).cast("int").alias("score"))
    return docs.where("score > 0").orderBy(F.desc("score"), "doc_id").limit(15)


@query("page_search_snippets")
def page_search_snippets(spark, d):
    t = F.when(filters.any_word_in("translation.data", "river bird"), F.col("translation.data"))
    hits = pages_of(spark, d, text.highlighted_snippets("river bird")(t).alias("found")).select("id", "book_id", F.explode("found").alias("s"))
    return hits.select("id", "book_id", "s.position", "s.snippet")


@query(
    "pages_with_image",
    f"""SELECT book_id, count(*) AS n FROM {PAGES} WHERE regexp_matches(coalesce(ocr.data,''), '(?i)<image-desc>|\\[\\[image:') GROUP BY book_id""",
)
def pages_with_image(spark, d):
    return pages_of(spark, d, filters.matches_ci("ocr.data", r"<image-desc>|\[\[image:").alias("hit")).where("hit").groupBy("book_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "gallery",
    f"""SELECT p.id AS page_id, i - 1 AS image_index, b.title AS book_title, img.type AS image_type, img.description AS description, img.confidence AS confidence
        FROM (SELECT id, book_id, detected_images, unnest(generate_series(1, len(detected_images))) AS i, unnest(detected_images) AS img FROM {PAGES}) p LEFT JOIN books b ON b.id=p.book_id WHERE img.confidence >= 0.5""",
)
def gallery(spark, d):
    p = nested.unwind(pages_of(spark, d, "detected_images"), "detected_images", "img", index="image_index").where("img.confidence >= 0.5")
    j = joins.lookup_one(p, books_of(spark, d).select("id", "title"), "book_id", "id", "b_")
    return j.select(F.col("id").alias("page_id"), F.col("image_index").cast("bigint").alias("image_index"), F.col("b_title").alias("book_title"), F.col("img.type").alias("image_type"), F.col("img.description").alias("description"), F.col("img.confidence").alias("confidence"))


@query(
    "gallery_facets",
    f"""WITH g AS (SELECT b.year, b.author, img FROM (SELECT book_id, unnest(detected_images) AS img FROM {PAGES}) p LEFT JOIN books b ON b.id=p.book_id)
        SELECT 'type' AS facet, img.type AS key, count(*) AS n FROM g WHERE img.type IS NOT NULL GROUP BY ALL
        UNION ALL SELECT 'author', author, count(*) FROM g WHERE author IS NOT NULL GROUP BY ALL
        UNION ALL SELECT 'decade', CAST(CAST(floor(year/10)*10 AS INT) AS VARCHAR), count(*) FROM g WHERE year IS NOT NULL GROUP BY ALL""",
)
def gallery_facets(spark, d):
    p = nested.unwind(pages_of(spark, d, "detected_images"), "detected_images", "img")
    j = joins.lookup_one(p, books_of(spark, d).select("id", "year", "author"), "book_id", "id", "b_")
    return nested.facets(j, {"type": F.col("img.type"), "author": F.col("b_author"), "decade": (F.floor(F.col("b_year") / 10) * 10).cast("int")})


@query(
    "gallery_years",
    f"""SELECT min(b.year) AS first_year, max(b.year) AS last_year, count(*) AS n FROM (SELECT book_id, unnest(detected_images) AS img FROM {PAGES}) p JOIN books b ON b.id=p.book_id""",
)
def gallery_years(spark, d):
    p = nested.unwind(pages_of(spark, d, "detected_images").select("book_id", "detected_images"), "detected_images", "img")
    j = joins.lookup_one(p.select("book_id"), books_of(spark, d).select("id", "year"), "book_id", "id", "b_", required=True)
    return j.agg(F.min("b_year").alias("first_year"), F.max("b_year").alias("last_year"), F.count(F.lit(1)).alias("n"))


@query(
    "best_image_per_book",
    f"""WITH g AS (SELECT id AS page_id, book_id, i-1 AS image_index, img.confidence AS c FROM (SELECT id, book_id, unnest(generate_series(1, len(detected_images))) AS i, unnest(detected_images) AS img FROM {PAGES}))
        SELECT page_id, book_id, c AS confidence FROM g WHERE c IS NOT NULL QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY c DESC, page_id || ':' || image_index) = 1 ORDER BY c DESC, page_id || ':' || image_index LIMIT 20""",
)
def best_image_per_book(spark, d):
    p = nested.unwind(pages_of(spark, d, "detected_images"), "detected_images", "img", index="i").where("img.confidence is not null")
    keyed = p.select(F.col("id").alias("page_id"), "book_id", F.col("img.confidence").alias("confidence"), F.concat("id", F.lit(":"), F.col("i").cast("string")).alias("key"))
    return ordered.best_per_group(keyed, "book_id", F.col("confidence"), "key", 20).drop("key")


@query(
    "detection_queue",
    f"""SELECT p.id, b.title FROM {PAGES} p JOIN books b ON b.id=p.book_id WHERE regexp_matches(coalesce(p.ocr.data,''), '(?i)<image-desc>') AND len(coalesce(p.detected_images, []))=0 AND p.manually_skipped IS DISTINCT FROM true""",
)
def detection_queue(spark, d):
    p = pages_of(spark, d, filters.matches_ci("ocr.data", "<image-desc>").alias("hit"), filters.non_empty("detected_images").alias("has"), "manually_skipped")
    p = p.where(F.col("hit") & ~F.col("has") & filters.differs("manually_skipped", True))
    return joins.lookup_one(p.select("id", "book_id"), books_of(spark, d).select("id", "title"), "book_id", "id", "b_", required=True).select("id", F.col("b_title").alias("title"))


@query(
    "counter_check",
    f"""SELECT b.id, coalesce(n,0) AS pages_now, coalesce(b.pages_count,0) AS pages_stored, coalesce(o,0) AS ocr_now, coalesce(b.pages_ocr,0) AS ocr_stored
        FROM books b LEFT JOIN (SELECT book_id, count(*) n, count(*) FILTER (length(coalesce(ocr.data,''))>0) o FROM {PAGES} GROUP BY book_id) p ON p.book_id=b.id
        WHERE coalesce(n,0) <> coalesce(b.pages_count,0) OR coalesce(o,0) <> coalesce(b.pages_ocr,0)""",
)
def counter_check(spark, d):
    p = pages_of(spark, d, filters.has_text("ocr.data").alias("o"))
    c = joins.lookup_measures(books_of(spark, d), p, "id", "book_id", n=F.count(F.lit(1)), o=F.count_if("o"))
    zero = lambda x: F.coalesce(F.col(x), F.lit(0)).cast("bigint")
    out = c.select("id", zero("n").alias("pages_now"), F.coalesce("pages_count", F.lit(0)).alias("pages_stored"), zero("o").alias("ocr_now"), F.coalesce("pages_ocr", F.lit(0)).alias("ocr_stored"))
    return out.where("pages_now <> pages_stored or ocr_now <> ocr_stored")


@query(
    "backlog",
    f"""SELECT book_id, n_missing, n_pages FROM (SELECT book_id, count(*) FILTER (coalesce(ocr.data,'')='') AS n_missing, count(*) AS n_pages FROM {PAGES} GROUP BY book_id) WHERE n_missing > 0 ORDER BY n_missing DESC, book_id LIMIT 50""",
)
def backlog(spark, d):
    p = pages_of(spark, d, filters.is_blank("ocr.data").alias("missing")).groupBy("book_id").agg(F.count_if("missing").alias("n_missing"), F.count(F.lit(1)).alias("n_pages"))
    return ordered.page_of(p.where("n_missing > 0"), [F.desc("n_missing"), F.asc("book_id")], 50)


@query(
    "backlog_totals",
    f"""SELECT count(*) AS n_books, CAST(sum(m) AS BIGINT) AS n_missing, max(m) AS most FROM (SELECT book_id, count(*) FILTER (coalesce(translation.data,'')='') AS m FROM {PAGES} GROUP BY book_id) WHERE m > 0""",
)
def backlog_totals(spark, d):
    per_book = pages_of(spark, d, filters.is_blank("translation.data").alias("x")).groupBy("book_id").agg(F.count_if("x").alias("m")).where("m > 0")
    return per_book.agg(F.count(F.lit(1)).alias("n_books"), F.sum("m").alias("n_missing"), F.max("m").alias("most"))


@query(
    "open_books",
    """SELECT id FROM books WHERE coalesce(pages_ocr,0) < pages_count""",
)
def open_books(spark, d):
    return books_of(spark, d).where(filters.less_than_column("pages_ocr", "pages_count")).select("id")


@query(
    "storage_stats",
    f"""SELECT count(*) AS n_pages, count(*) FILTER (photo IS NOT NULL AND photo <> '') AS with_photo, count(*) FILTER (photo_original IS NOT NULL AND photo_original <> '') AS with_original,
        count(*) FILTER (split_from IS NOT NULL) AS from_split, count(*) FILTER (summary.data IS NOT NULL AND summary.data <> '') AS with_summary FROM {PAGES}""",
)
def storage_stats(spark, d):
    p = pages_of(spark, d, "photo", "photo_original", "split_from", F.col("summary.data").alias("s"))
    return A.count_where(p, n_pages=F.lit(True), with_photo=filters.has_text("photo"), with_original=filters.has_text("photo_original"), from_split=F.col("split_from").isNotNull(), with_summary=filters.has_text("s"))


@query(
    "image_sources",
    """SELECT image_source IS NOT NULL AS has_source, coalesce(image_source.provider, 'none') AS provider, count(*) AS n FROM books GROUP BY ALL""",
)
def image_sources(spark, d):
    return books_of(spark, d).groupBy(F.col("image_source").isNotNull().alias("has_source"), F.coalesce("image_source.provider", F.lit("none")).alias("provider")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "distinct_providers",
    """SELECT DISTINCT image_source.license AS license FROM books WHERE image_source.license IS NOT NULL""",
)
def distinct_providers(spark, d):
    return books_of(spark, d).where("image_source.license is not null").select(F.col("image_source.license").alias("license")).distinct()


@query(
    "neighbour_pages",
    f"""SELECT a.id, b.id AS before_1, c.id AS after_1 FROM {PAGES} a LEFT JOIN (SELECT book_id, page_number, min(id) AS id FROM {PAGES} GROUP BY ALL) b ON b.book_id=a.book_id AND b.page_number=a.page_number-1
        LEFT JOIN (SELECT book_id, page_number, min(id) AS id FROM {PAGES} GROUP BY ALL) c ON c.book_id=a.book_id AND c.page_number=a.page_number+1""",
)
def neighbour_pages(spark, d):
    return joins.neighbours(pages_of(spark, d), "book_id", "page_number", "id").select("id", "before_1", "after_1")


@query(
    "stitch_candidates",
    f"""WITH w AS (SELECT id, book_id, page_number, coalesce(translation.data,'') AS t, coalesce(translation.stitched,false) AS stitched, lag(page_number) OVER w AS pn, lag(coalesce(translation.data,'')) OVER w AS pt FROM {PAGES} WINDOW w AS (PARTITION BY book_id ORDER BY page_number, id))
        SELECT id, CASE WHEN regexp_matches(ltrim(t), '^[a-z]') THEN 'starts_lowercase' WHEN regexp_matches(ltrim(t), '(?i)^(and|but|or|for|nor|yet|so|however|therefore|thus|hence|moreover)\\b') THEN 'starts_conjunction' ELSE 'prev_incomplete' END AS reason
        FROM w WHERE page_number = pn + 1 AND NOT stitched AND (regexp_matches(ltrim(t), '^[a-z]') OR regexp_matches(ltrim(t), '(?i)^(and|but|or|for|nor|yet|so|however|therefore|thus|hence|moreover)\\b') OR regexp_matches(rtrim(pt), '[,;:–—-]$'))""",
)
def stitch_candidates(spark, d):
    t = F.coalesce("translation.data", F.lit(""))
    marks = pages_of(spark, d, F.coalesce("translation.stitched", F.lit(False)).alias("stitched"), F.ltrim(t).rlike("^[a-z]").alias("low"),
                     F.ltrim(t).rlike(r"(?i)^(and|but|or|for|nor|yet|so|however|therefore|thus|hence|moreover)\b").alias("conj"), F.rtrim(t).rlike("[,;:–—-]$").alias("open"))
    w = W.partitionBy("book_id").orderBy("page_number", "id")
    pairs = marks.withColumns({"pn": F.lag("page_number").over(w), "po": F.lag("open").over(w)}).where("page_number = pn + 1 and not stitched and (low or conj or po)")
    return pairs.select("id", F.when(F.col("low"), "starts_lowercase").when(F.col("conj"), "starts_conjunction").otherwise("prev_incomplete").alias("reason"))


@query(
    "renumbered_pages",
    f"""SELECT id, CAST(row_number() OVER (PARTITION BY book_id ORDER BY page_number, id) AS INT) AS number FROM {PAGES}""",
)
def renumbered_pages(spark, d):
    return ordered.renumber(pages_of(spark, d), "book_id", "page_number", "id").select("id", "number")


@query(
    "page_chunks",
    f"""SELECT book_id, chunk, count(*) AS n FROM (SELECT book_id, CAST(floor((row_number() OVER (PARTITION BY book_id ORDER BY page_number, id)-1)/25) AS INT) AS chunk FROM {PAGES}) GROUP BY ALL""",
)
def page_chunks(spark, d):
    return ordered.chunks(pages_of(spark, d), "book_id", 25, "page_number", "id").groupBy("book_id", "chunk").agg(F.count(F.lit(1)).alias("n"))


@query(
    "text_batches",
    f"""WITH RECURSIVE o AS (SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY page_number, id) AS rn, CAST(length(coalesce(ocr.data,'')) AS BIGINT) AS sz FROM {PAGES}),
        f AS (SELECT book_id, rn, 1 AS batch, sz AS total FROM o WHERE rn=1 UNION ALL
        SELECT o.book_id, o.rn, CASE WHEN f.total + o.sz > 5000 THEN f.batch+1 ELSE f.batch END, CASE WHEN f.total + o.sz > 5000 THEN o.sz ELSE f.total + o.sz END FROM f JOIN o ON o.book_id=f.book_id AND o.rn=f.rn+1)
        SELECT book_id, batch, CAST(count(*) AS INT) AS n_rows, max(total) AS total FROM f GROUP BY ALL""",
)
def text_batches(spark, d):
    p = pages_of(spark, d, F.length(F.coalesce("ocr.data", F.lit(""))).alias("size"))
    return ordered.greedy_batches(p, "book_id", ["page_number", "id"], F.col("size"), 5000)


@query(
    "interleaved_plan",
    f"""WITH n AS (SELECT p.id, coalesce(b.language,'') AS lang FROM {PAGES} p JOIN books b ON b.id=p.book_id WHERE coalesce(p.ocr.data,'')=''),
        w AS (SELECT id, lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY id) AS INT) AS turn, count(*) OVER (PARTITION BY lang) AS group_size FROM n) SELECT * FROM w ORDER BY turn, group_size DESC, lang LIMIT 100""",
)
def interleaved_plan(spark, d):
    p = pages_of(spark, d, filters.is_blank("ocr.data").alias("x")).where("x").select("id", "book_id")
    n = joins.lookup_one(p, books_of(spark, d).select("id", "language"), "book_id", "id", "b_", required=True).select("id", F.coalesce("b_language", F.lit("")).alias("lang"))
    return ordered.interleave(n, "lang", "id", first=100).orderBy("turn", F.desc("group_size"), "lang").limit(100)


@query(
    "exact_sample",
    f"""SELECT id FROM {PAGES} ORDER BY md5('7:' || id), id LIMIT 50""",
)
def exact_sample(spark, d):
    return ordered.exact_sample(pages_of(spark, d).select("id"), "id", 50, seed=7)


@query(
    "term_index",
    f"""WITH t AS (SELECT book_id, page_number, trim(unnest(string_split(s, ','))) AS term FROM (SELECT book_id, page_number, unnest(regexp_extract_all(coalesce(translation.data,''), '(?is)<summary>(.*?)</summary>', 1)) AS s FROM {PAGES}))
        SELECT book_id || '|' || term AS book_term, count(DISTINCT page_number) AS n_places, array_to_string(list_sort(list(DISTINCT CAST(page_number AS INT))), ' ') AS places FROM t WHERE term <> '' GROUP BY book_id, term""",
)
def term_index(spark, d):
    p = pages_of(spark, d, markup.terms(F.col("translation.data"), "summary").alias("terms"))
    t = p.select(F.explode("terms").alias("term"), "book_id", F.col("page_number").cast("int").alias("page"))
    i = A.inverted_index(t.select(F.concat("book_id", F.lit("|"), "term").alias("book_term"), "page"), "book_term", "page")
    return i.select("book_term", "n_places", F.array_join(F.transform("places", lambda x: x.cast("string")), " ").alias("places"))


@query(
    "page_metadata",
    f"""SELECT id, nullif(trim(regexp_extract(coalesce(ocr.data,''), '(?is)<page-num>(.*?)</page-num>', 1)), '') AS printed_page, nullif(trim(regexp_extract(coalesce(ocr.data,''), '(?is)<sig>(.*?)</sig>', 1)), '') AS signature FROM {PAGES}""",
)
def page_metadata(spark, d):
    return pages_of(spark, d, markup.metadata(F.col("ocr.data")).alias("m")).select("id", F.col("m.page_number").alias("printed_page"), F.col("m.signature").alias("signature"))


@query(
    "printed_page_drift",
    f"""SELECT id, CAST(page_number - n AS INT) AS drift FROM (SELECT id, page_number, TRY_CAST(nullif(regexp_extract(ocr.data, '(?i)<page-num>(\\d+)</page-num>', 1), '') AS INT) AS n FROM {PAGES}) WHERE abs(page_number - n) > 1""",
)
def printed_page_drift(spark, d):
    p = pages_of(spark, d, markup.page_number(F.col("ocr.data")).alias("n"))
    return p.where(F.abs(F.col("page_number") - F.col("n")) > 1).select("id", (F.col("page_number") - F.col("n")).cast("int").alias("drift"))


@query(
    "page_summaries",
    f"""SELECT id, nullif(trim(regexp_extract(coalesce(translation.data,''), '(?is)<summary>(.*?)</summary>', 1)), '') AS summary FROM {PAGES} WHERE nullif(trim(regexp_extract(coalesce(translation.data,''), '(?is)<summary>(.*?)</summary>', 1)), '') IS NOT NULL""",
)
def page_summaries(spark, d):
    return pages_of(spark, d, markup.element(F.col("translation.data"), "summary").alias("summary")).where("summary is not null").select("id", "summary")


def _nested(sql: str, steps: list[tuple[str, str]]) -> str:
    """SQL of regular replacements, one after the other."""
    for pattern, new in steps:
        sql = f"regexp_replace({sql}, '{pattern}', '{new}', 'g')"
    return sql


_BRACKET = [(rf"(?is)\[\[{old}:\s*(.*?)\]\]", f"<{new}>\\1</{new}>") for old, new in markup.RENAMED]


@query(
    "migrated_markup",
    f"""SELECT id, {_nested("t", _BRACKET)} AS migrated, CAST({" + ".join(f"len(regexp_extract_all(t, '{p}'))" for p, _ in _BRACKET)} AS INT) AS n FROM (SELECT id, ocr.data AS t FROM {PAGES}) WHERE t IS NOT NULL""",
)
def migrated_markup(spark, d):
    t = F.col("ocr.data")
    p = pages_of(spark, d, markup.migrate(t).alias("migrated"), markup.migration_count(t).cast("int").alias("n"))
    return p.where("migrated is not null").select("id", "migrated", "n")


@query("markup_faults")
def markup_faults(spark, d):
    p = pages_of(spark, d, F.col("ocr.data").alias("t")).where(F.col("t").rlike(r"\[\[|\]\]|->|<-|<"))
    return p.select("id", F.explode(markup.issues("t")).alias("i")).select("id", "i.type", "i.position", "i.length")


@query(
    "qa_by_model",
    f"""SELECT coalesce(ocr.model,'unknown') AS model, count(*) AS n, floor(avg(length(ocr.data))+0.5) AS mean_length FROM {PAGES} WHERE coalesce(ocr.data,'') <> '' GROUP BY ALL""",
)
def qa_by_model(spark, d):
    p = pages_of(spark, d, F.col("ocr.model").alias("m"), F.length("ocr.data").alias("n")).where("n > 0")
    return p.groupBy(F.coalesce("m", F.lit("unknown")).alias("model")).agg(F.count(F.lit(1)).alias("n"), A.half_up(F.avg("n")).cast("double").alias("mean_length"))


@query(
    "edition_hash",
    f"""SELECT book_id, sha256(string_agg('--- Page ' || CAST(CAST(page_number AS INT) AS VARCHAR) || ' ---' || chr(10) || translation.data, chr(10) || chr(10) ORDER BY page_number, id)) AS hash FROM {PAGES} WHERE coalesce(translation.data,'') <> '' GROUP BY book_id""",
)
def edition_hash(spark, d):
    p = pages_of(spark, d, F.col("translation.data").alias("t")).where(filters.has_text("t"))
    line = F.concat(F.lit("--- Page "), F.col("page_number").cast("int").cast("string"), F.lit(" ---\n"), F.col("t"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("page_number", "id", line.alias("x")))), lambda s: s["x"])
    return p.groupBy("book_id").agg(F.sha2(F.array_join(parts, "\n\n"), 256).alias("hash"))


@query(
    "citations",
    """SELECT id, '(' || split_part(coalesce(author,'Unknown'), ',', 1) || ' ' || coalesce(nullif(published,''),'n.d.') || ', p. 3)' AS inline FROM books""",
)
def citations(spark, d):
    b = books_of(spark, d)
    c = ids.citations(F.col("author"), F.coalesce("display_title", "title"), F.col("published"), F.col("doi"), F.lit(3), "the library", 2025)
    return b.select("id", c["inline"].alias("inline"))


@query(
    "translation_dates",
    f"""SELECT b.id, m AS last_translation_at FROM books b JOIN (SELECT book_id, max(translation.updated_at) AS m FROM {PAGES} WHERE coalesce(translation.data,'')<>'' GROUP BY book_id) p ON p.book_id=b.id WHERE b.last_translation_at IS DISTINCT FROM m""",
)
def translation_dates(spark, d):
    p = pages_of(spark, d, F.col("translation.data").alias("t"), F.col("translation.updated_at").alias("at")).where(filters.has_text("t"))
    j = joins.lookup_measures(books_of(spark, d), p, "id", "book_id", m=F.max("at")).where(F.col("m").isNotNull() & ~F.col("last_translation_at").eqNullSafe(F.col("m")))
    return j.select("id", F.col("m").alias("last_translation_at"))


@query(
    "last_processed",
    f"""SELECT b.id, greatest(o, t) AS last_at FROM books b JOIN (SELECT book_id, max(ocr.updated_at) o, max(translation.updated_at) t FROM {PAGES} GROUP BY book_id) p ON p.book_id=b.id WHERE greatest(o,t) IS NOT NULL ORDER BY last_at DESC, b.id LIMIT 20""",
)
def last_processed(spark, d):
    p = pages_of(spark, d, F.col("ocr.updated_at").alias("o"), F.col("translation.updated_at").alias("t"))
    j = joins.lookup_measures(books_of(spark, d).select("id"), p, "id", "book_id", o=F.max("o"), t=F.max("t"))
    return j.select("id", F.greatest("o", "t").alias("last_at")).where("last_at is not null").orderBy(F.desc("last_at"), "id").limit(20)


@query(
    "ocr_batches",
    f"""SELECT book_id, date_trunc('second', ocr.updated_at) AS at, count(*) AS n FROM {PAGES} WHERE ocr.updated_at IS NOT NULL GROUP BY ALL HAVING count(*) > 1""",
)
def ocr_batches(spark, d):
    p = pages_of(spark, d, F.col("ocr.updated_at").alias("u")).where("u is not null")
    return p.groupBy("book_id", F.date_trunc("second", "u").cast("timestamp_ntz").alias("at")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query(
    "orphan_repair",
    """SELECT count(*) AS n, count(*) FILTER (id IS NULL) AS filled FROM pages p WHERE EXISTS (SELECT 1 FROM books b WHERE b.id=p.book_id)""",
)
def orphan_repair(spark, d):
    p = table(spark, d, "pages").select("id", "book_id", F.col("id").isNull().alias("was_null"))
    fixed = changes.repair_orphans(p, books_of(spark, d), "book_id", "id", "id", F.expr("uuid()"))
    return A.count_where(fixed, n=F.col("id").isNotNull(), filled=F.col("was_null"))


@query(
    "split_preview",
    f"""WITH s AS (SELECT id, book_id, page_number, 500 AS at FROM {PAGES} WHERE split_from IS NOT NULL), e AS (
        SELECT id, book_id, page_number AS o, 'whole' AS side FROM {PAGES} WHERE split_from IS NULL UNION ALL SELECT id, book_id, page_number, 'left' FROM s UNION ALL SELECT id, book_id, page_number+0.5, 'right' FROM s)
        SELECT id, side, CAST(row_number() OVER (PARTITION BY book_id ORDER BY o, id) AS INT) AS number FROM e""",
)
def split_preview(spark, d):
    p = pages_of(spark, d, "split_from")
    at = p.where("split_from is not null").select(F.col("id").alias("page_id"), F.lit(500).alias("position"))
    return changes.split_pages(p.drop("split_from"), at).select("id", "side", "number")


@query(
    "snapshot_candidates",
    f"""SELECT id FROM {PAGES} WHERE ocr.source='manual' AND coalesce(ocr.data,'')<>''""",
)
def snapshot_candidates(spark, d):
    p = pages_of(spark, d, "ocr")
    return changes.snapshots(p, p.select("id"), "id", "ocr").select("id")


@query(
    "archive_round_trip",
    f"""SELECT id, book_id FROM {PAGES} WHERE book_id IN (SELECT id FROM books WHERE needs_splitting)""",
)
def archive_round_trip(spark, d):
    p = pages_of(spark, d).select("id", "book_id")
    gone = changes.archive(books_of(spark, d).select("id", "needs_splitting"), p, "id", "book_id", F.coalesce("needs_splitting", F.lit(False)), F.lit("2025-01-01").cast("timestamp"))
    return changes.restore(gone)


@query(
    "upserted_books",
    """SELECT coalesce(n.id, o.id) AS id, coalesce(n.title, o.title) AS title, CASE WHEN o.id IS NULL THEN 'new' ELSE coalesce(o.author,'') END AS author
       FROM (SELECT id, title, author FROM books WHERE coalesce(year,0) % 2 = 0) o FULL JOIN (SELECT id, upper(title) AS title FROM books WHERE coalesce(year,0) % 3 = 0) n ON n.id=o.id""",
)
def upserted_books(spark, d):
    b = books_of(spark, d)
    y = F.coalesce("year", F.lit(0))
    old = b.where(y % 2 == 0).select("id", "title", F.coalesce("author", F.lit("")).alias("author"))
    new = b.where(y % 3 == 0).select("id", F.upper("title").alias("title"))
    return changes.upsert(old, new, "id", {"author": F.lit("new")})


@query(
    "keyword_categories",
    """SELECT id, array_to_string(list_sort(list_distinct(list_filter([CASE WHEN lower(title) LIKE '%luce%' OR lower(title) LIKE '%light%' OR lower(title) LIKE '%licht%' THEN 'light' END, CASE WHEN lower(title) LIKE '%sale%' OR lower(title) LIKE '%salz%' OR lower(title) LIKE '%salt%' THEN 'salt' END], lambda x: x IS NOT NULL))), '|') AS found FROM books WHERE title IS NOT NULL""",
)
def keyword_categories(spark, d):
    lexicon = {"light": ["luce", "light", "licht"], "salt": ["sale", "salz", "salt"]}
    tests = [F.when(filters.any_field_contains(["title"], w[0]) | filters.any_field_contains(["title"], w[1]) | filters.any_field_contains(["title"], w[2]), F.lit(c)) for c, w in lexicon.items()]
    found = F.array_sort(F.array_distinct(F.filter(F.array(*tests), lambda x: x.isNotNull())))
    return books_of(spark, d).where("title is not null").select("id", F.array_join(found, "|").alias("found"))


@query("metadata_matches")
def metadata_matches(spark, d):
    b = books_of(spark, d).where("title is not null").select(F.col("id").alias("left_key"), "title", "author")
    e = table(spark, d, "external_catalog").where("title is not null").select(F.col("catalog_id").alias("right_key"), "title", "author")
    return metadata.best_matches(b, e).withColumnsRenamed({"left_key": "book_id", "right_key": "catalog_id"})


@query(
    "entity_index",
    f"""WITH e AS (SELECT DISTINCT book_id, unnest(regexp_extract_all(coalesce(ocr.data,''), '([A-Z][a-z]+(?:ius|inus)) scribit', 1)) AS name FROM {PAGES}) SELECT lower(name) AS entity, count(DISTINCT book_id) AS n_books FROM e GROUP BY ALL""",
)
def entity_index(spark, d):
    p = pages_of(spark, d, F.regexp_extract_all(F.coalesce("ocr.data", F.lit("")), F.lit("([A-Z][a-z]+(?:ius|inus)) scribit"), F.lit(1)).alias("names"))
    return p.select("book_id", F.explode("names").alias("name")).groupBy(F.lower("name").alias("entity")).agg(F.count_distinct("book_id").alias("n_books"))


@query(
    "related_books",
    f"""WITH c AS (SELECT id, unnest(categories) AS cat FROM books), f AS (SELECT min(id) AS id FROM c) SELECT c2.id, count(DISTINCT c2.cat) AS shared FROM c c1 JOIN c c2 ON c1.cat=c2.cat WHERE c1.id=(SELECT id FROM f) AND c2.id<>c1.id GROUP BY c2.id ORDER BY shared DESC, c2.id LIMIT 10""",
)
def related_books(spark, d):
    inc = nested.unwind(books_of(spark, d).select("id", "categories"), "categories", "cat").where("cat is not null").select("id", "cat")
    first = inc.agg(F.min("id").alias("id")).first()["id"]  # one value
    return joins.co_occurring(inc, "id", "cat", first, 10)


@query(
    "title_pages",
    f"""WITH t AS (SELECT id, book_id, lower(coalesce(ocr.data,'')) AS t, row_number() OVER (PARTITION BY book_id ORDER BY page_number, id) AS rn FROM {PAGES}),
        j AS (SELECT t.*, list_filter(regexp_split_to_array(lower(coalesce(title,'')), '\\s+'), lambda x: length(x)>3) AS tw, list_filter(regexp_split_to_array(lower(coalesce(author,'')), '\\s+'), lambda x: length(x)>3) AS aw FROM t JOIN books b ON b.id=t.book_id WHERE rn<=5),
        r AS (SELECT *, (length(t)>=50 AND regexp_matches(t, 'excudebat|typis|apud|impensis|published|printed|anno|mdcc|mdccc|m\\.dc|m\\.d\\.|cum privilegio|sumptibus')) AS p,
        (len(tw)>0 AND len(list_filter(tw, lambda x: contains(t, x)))>=least(2,len(tw))) OR len(list_filter(aw, lambda x: contains(t, x)))>0 AS n FROM j)
        SELECT book_id, id AS page_id FROM r QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY CASE WHEN p AND n THEN 0 WHEN p THEN 1 ELSE 2 END, rn)=1""",
)
def title_pages(spark, d):
    return entities.title_page(pages_of(spark, d, F.col("ocr.data").alias("text")), books_of(spark, d))


@query(
    "entity_roll_up",
    f"""WITH m AS (SELECT book_id, page_number, unnest(regexp_extract_all(coalesce(ocr.data,''), '([A-Z][a-z]+) scribit', 1)) AS term FROM {PAGES}), b AS (SELECT lower(term) AS name, book_id, count(DISTINCT page_number) AS n FROM m GROUP BY ALL)
        SELECT 'person' AS kind, name, (SELECT arg_min(term, (book_id, page_number, term)) FROM m WHERE lower(term) = b.name) AS label, count(*) AS book_count, CAST(sum(n) AS BIGINT) AS total_mentions FROM b GROUP BY name""",
)
def entity_roll_up(spark, d):
    p = pages_of(spark, d, F.regexp_extract_all(F.coalesce("ocr.data", F.lit("")), F.lit("([A-Z][a-z]+) scribit"), F.lit(1)).alias("terms"))
    e = entities.rolled_up(p.select(F.lit("person").alias("kind"), F.explode("terms").alias("term"), "book_id", F.col("page_number").alias("page")))
    return entities.merge_entities(e, e).select("kind", "name", "label", "book_count", "total_mentions")


@query(
    "image_providers",
    """SELECT id, CASE WHEN contains(t, 'archive.org') THEN 'archive' WHEN contains(t, 'books.google') THEN 'book_search' WHEN contains(t, 's3.amazonaws.com') OR contains(t, '.s3.') OR starts_with(t, '/Users/') OR starts_with(t, '/home/') THEN 'own_scan' WHEN coalesce(ia_identifier,'')<>'' THEN 'archive' END AS provider
       FROM (SELECT id, ia_identifier, coalesce(thumbnail,'') AS t FROM books)""",
)
def image_providers(spark, d):
    return books_of(spark, d).select("id", links.image_source(F.col("thumbnail"), F.col("ia_identifier"))["provider"].alias("provider"))


@query(
    "page_images",
    f"""SELECT id, coalesce(nullif(photo_original,''), nullif(photo,'')) AS image FROM {PAGES}""",
)
def page_images(spark, d):
    none = F.lit(None).cast("string")
    return pages_of(spark, d, links.page_image(none, none, none, F.col("photo_original"), F.col("photo")).alias("image")).select("id", "image")


@query(
    "crop_addresses",
    f"""SELECT id, i - 1 AS place, CASE WHEN img.bbox IS NULL THEN coalesce(photo,'') ELSE '/crop?url=' || replace(replace(url_encode(coalesce(photo,'')), '%20', '+'), '~', '%7E') || '&x=' || CAST(img.bbox.x AS VARCHAR) || '&y=' || CAST(img.bbox.y AS VARCHAR) || '&w=' || CAST(img.bbox.width AS VARCHAR) || '&h=' || CAST(img.bbox.height AS VARCHAR) END AS address
        FROM (SELECT id, photo, unnest(generate_series(1, len(detected_images))) AS i, unnest(detected_images) AS img FROM {PAGES})""",
)
def crop_addresses(spark, d):
    p = nested.unwind(pages_of(spark, d, "detected_images", "photo"), "detected_images", "img", index="place")
    return p.select("id", F.col("place").cast("bigint").alias("place"), links.crop_address("/crop", F.coalesce("photo", F.lit("")), F.col("img.bbox")).alias("address"))


@query(
    "layout_verdicts",
    f"""SELECT book_id, s.n AS spreads, s.g AS singles, s.u AS unclear, CASE WHEN s.n>s.g THEN true WHEN s.g>s.n THEN false END AS needs_splitting FROM (SELECT book_id, count(*) FILTER (r>1.2) AS n, count(*) FILTER (r<0.9) AS g, count(*) FILTER (r BETWEEN 0.9 AND 1.2) AS u
        FROM (SELECT book_id, img.bbox.width / nullif(img.bbox.height,0) AS r FROM (SELECT book_id, unnest(detected_images) AS img FROM {PAGES})) GROUP BY 1) s""",
)
def layout_verdicts(spark, d):
    p = nested.unwind(pages_of(spark, d, "detected_images"), "detected_images", "img").select("book_id", F.col("img.bbox.width").alias("w"), F.col("img.bbox.height").alias("h"))
    return entities.layout_verdict(p, "book_id", "w", "h").drop("confidence")


@query(
    "next_pages_to_do",
    f"""SELECT id FROM {PAGES} WHERE id NOT IN (SELECT id FROM {PAGES} WHERE coalesce(ocr.data,'') <> '') ORDER BY id LIMIT 10""",
)
def next_pages_to_do(spark, d):
    p = pages_of(spark, d, filters.has_text("ocr.data").alias("done"))
    return entities.remaining(p.select("id"), p.where("done").select("id"), "id", 10)


@query(
    "titles_in_locale_order",
    """SELECT id, CAST(row_number() OVER (ORDER BY title COLLATE en NULLS FIRST, id) AS INT) AS place FROM books ORDER BY place LIMIT 20""",
)
def titles_in_locale_order(spark, d):
    order = [F.asc_nulls_first(F.collate("title", "UNICODE")), F.asc("id")]
    return books_of(spark, d).select("id", "title").orderBy(*order).limit(20).withColumn("place", F.row_number().over(W.orderBy(*order))).select("id", "place")  # 20 rows


_SHOWN = [(r"(?is)\[\[image:\s*.*?\]\]", "")]
_SHOWN += [(p, "") for p, _ in _BRACKET if any(p.startswith(f"(?is)\\[\\[{n}") for n in ("notes?", "margin", "gloss", "insert", "unclear"))]
_SHOWN += [(r"(?is)\[\[term:\s*(.*?)\]\]", r"<term>\1</term>")]
_SHOWN += [(rf"(?m)(?:->\s*#{{{k}}}\s*([^\n]*?)\s*<-|^#{{{k}}}\s*->\s*([^\n]*?)\s*<-\s*$)", rf'<h{k} class="text-center">\1\2</h{k}>') for k in range(6, 0, -1)]
_SHOWN += [(r"->\s*([^\n]*?)\s*<-", r"<center>\1</center>")]


@query("reader_view", f"""SELECT id, {_nested("t", _SHOWN)} AS shown FROM (SELECT id, ocr.data AS t FROM {PAGES}) WHERE t IS NOT NULL""")
def reader_view(spark, d):
    return pages_of(spark, d, markup.shown(F.col("ocr.data"), with_notes=False).alias("shown")).where("shown is not null").select("id", "shown")
