"""The library's search and reading interface: functions with parameters, each a lazy plan.

Limits are clamped like the service's; functions that return several tables return a dict of them.
Tables are looked up in a folder of parquet files, so the same call runs over any size.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.functions import ids, markup, stats, text
from scriptorium.operators import aggregates as A
from scriptorium.operators import filters, joins, nested, ordered
from scriptorium.operators.ranking import latest_rows
from scriptorium.operators.relevance import relevance
from scriptorium.session import small, table


def clamp(limit: int, most: int) -> int:
    return min(max(1, limit), most)


def long_enough(q: str, least: int = 2) -> str:
    """A query of at least so many characters; shorter ones are refused as the service does."""
    if len(q.strip()) < least:
        raise ValueError(f"a query needs at least {least} characters")
    return q.strip()


@dataclass
class Library:
    spark: SparkSession
    folder: str

    def books(self) -> DataFrame:
        return table(self.spark, self.folder, "books")

    def pages(self, *columns: Column | str, book_id: str | None = None) -> DataFrame:
        """The latest state of each page with the asked columns. Of one book, only pages that have a state in
        it are looked at; a page that has moved to another book since isn't one of its pages."""
        raw = table(self.spark, self.folder, "pages")
        narrow = raw.select("id", "book_id", "page_number", "updated_at", *columns)
        if book_id is None:
            return latest_rows(narrow, "id", "updated_at").drop("updated_at")
        ids = small(raw.where(F.col("book_id") == book_id).select(F.col("id").alias("__id")).distinct(), 100_000)
        own = narrow.join(ids, F.col("id") == F.col("__id"), "left_semi")
        return latest_rows(own, "id", "updated_at").drop("updated_at").where(F.col("book_id") == book_id)

    # -- search

    def search(self, q: str, language: str | None = None, category: str | None = None, date_from: str | None = None, date_to: str | None = None, year: int | None = None,
               has_doi: bool | None = None, has_translation: bool | None = None, book_id: str | None = None, content: bool = True, limit: int = 20, offset: int = 0) -> dict[str, DataFrame]:
        """hits: books (title, names) before pages (with a snippet), exact titles first; nearby: books of
        about the asked year. Filters hold for page hits too."""
        q = long_enough(q)
        b = self.books()
        keep = [F.lit(True)]
        if language:
            keep.append(F.col("language") == language)
        if category:
            keep.append(filters.array_has("categories", category))
        if date_from or date_to:
            keep.append(filters.between("published", date_from, date_to))
        if year:
            keep.append(filters.year_in_text("published") == year)
        if has_doi is not None:
            keep.append(filters.has_text("doi") == has_doi)
        if has_translation is not None:
            keep.append((F.coalesce("pages_translated", F.lit(0)) > 0) == has_translation)
        if book_id:
            keep.append(F.col("id") == book_id)
        b = b.where(reduce(lambda x, y: x & y, keep))
        label = F.coalesce("display_title", "title")
        of_books = b.where(filters.any_field_contains(["title", "display_title", "author"], q)).select(
            F.lit("book").alias("type"), F.col("id").alias("book_id"), F.lit(None).cast("string").alias("page_id"), label.alias("label"), text.snippet(F.coalesce("summary_text", "title"), q).alias("snippet"),
            F.coalesce(F.lower("title") == q.lower(), F.lit(False)).alias("exact"), filters.contains_ci("title", q).alias("in_title"),
        )
        hits = of_books
        if content:
            t = F.coalesce(F.nullif("translation.data", F.lit("")), "ocr.data")
            p = self.pages(F.when(filters.contains_ci(t, q), text.snippet(t, q)).alias("snippet")).where("snippet is not null")
            named = joins.lookup_one(p, b.select("id", label.alias("label")), "book_id", "id", "b_", required=True)
            hits = hits.unionByName(named.select(F.lit("page").alias("type"), "book_id", F.col("id").alias("page_id"), F.col("b_label").alias("label"), "snippet", F.lit(False).alias("exact"), F.lit(False).alias("in_title")))
        order = [F.when(F.col("type") == "book", 0).otherwise(1), F.desc("exact"), F.desc("in_title"), F.asc("book_id"), F.asc_nulls_first("page_id")]
        out = {"hits": ordered.page_of(hits, order, limit, offset, 100), "total": hits.agg(F.count(F.lit(1)).alias("n"))}
        if year:
            out["nearby"] = ordered.nearest(self.books().withColumn("y", filters.year_in_text("published")).select("id", "title", "y"), "y", year, 5, 10, "id").where(F.col("y") != year)
        return out

    def quick_search(self, q: str, limit: int = 5) -> DataFrame:
        """Books, catalogue entries and pages whose names hold the query, short names first. Sorted before
        the cut, so the best are kept."""
        q = long_enough(q)
        b = self.books().where(filters.any_field_contains(["title", "display_title", "author"], q)).select("id", F.coalesce("display_title", "title").alias("label"))
        c = table(self.spark, self.folder, "external_catalog").where(filters.any_field_contains(["title", "author"], q)).select(F.col("identifier").alias("id"), F.col("title").alias("label"))
        both = nested.union_tagged({"book": b, "catalogue": c}).where("label is not null")
        return both.orderBy(F.length("label"), "label", "id").limit(clamp(limit, 10))

    def catalogue(self, q: str, source: str = "all", limit: int = 20) -> DataFrame:
        """External entries of which some field holds each word of the query."""
        e = table(self.spark, self.folder, "external_catalog").where(filters.all_words_in(["title", "author", "description", "publisher"], long_enough(q)))
        return (e if source == "all" else e.where(F.col("source") == source)).orderBy("title", "catalog_id").limit(clamp(limit, 100))

    def in_book(self, book_id: str, q: str) -> dict[str, DataFrame]:
        """Pages of one book with any word of the query, with marked snippets, and counts by field."""
        p = self.pages(F.col("ocr.data").alias("ocr"), F.col("translation.data").alias("translation"), book_id=book_id)
        p = p.withColumns({"in_ocr": filters.any_word_in("ocr", q), "in_translation": filters.any_word_in("translation", q)}).where("in_ocr or in_translation")
        shown = p.orderBy("page_number", "id").limit(50)
        snip = text.highlighted_snippets(q)
        return {
            "pages": shown.select("id", "page_number", snip("ocr").alias("ocr_hits"), snip("translation").alias("translation_hits")),
            "counts": A.count_where(p, n=F.lit(True), in_ocr=F.col("in_ocr"), in_translation=F.col("in_translation")),
        }

    def relevant(self, book_id: str, q: str, limit: int = 50) -> DataFrame:
        """The pages of one book by relevance to a query, over both texts: (id, score)."""
        both = F.concat_ws("\n", "ocr.data", "translation.data")
        return relevance(self.pages(both.alias("t"), book_id=book_id), "id", "t", long_enough(q), clamp(limit, 50))

    def retrieve(self, book_id: str, question: str, limit: int = 15) -> DataFrame:
        """The pages of a book that hold the question's keywords most often; its first pages if none does."""
        p = self.pages(F.coalesce(F.nullif("translation.data", F.lit("")), "ocr.data").alias("t"), book_id=book_id).where(filters.has_text("t"))
        score = text.keyword_score(F.col("t"), text.query_keywords(question))
        return p.withColumn("score", score).orderBy(F.desc("score"), "page_number", "id").limit(limit)

    def around(self, page_id: str, distance: int = 2) -> DataFrame:
        """Readable texts of the pages next to one: over 50 characters, without a warning, cut at 800."""
        p = self.pages(F.col("translation.data").alias("t"))
        here = p.where(F.col("id") == page_id).select(F.col("book_id").alias("b"), F.col("page_number").alias("n"))
        near = p.join(F.broadcast(here), (F.col("book_id") == F.col("b")) & (F.abs(F.col("page_number") - F.col("n")) <= distance) & (F.col("page_number") != F.col("n")))
        return near.where(filters.has_text("t", 50) & ~filters.matches_ci("t", r"<warning>|\[\[warning")).select("id", "page_number", F.substring("t", 1, 800).alias("text")).orderBy("page_number", "id")

    def sources_for(self, question: str, most: int = 3) -> DataFrame:
        """Pages that answer a question from different books: the best page of each of the best books."""
        terms = text.search_terms(question)
        t = F.col("translation.data")
        fit = filters.has_text(t, 100) & ~filters.matches_ci(t, r"<warning>|\[\[warning")
        score = F.when(fit, text.keyword_score(t, terms)).otherwise(0)
        scored = self.pages(F.when(score > 0, t).alias("t"), score.alias("score")).where("score > 0")
        return ordered.best_per_group(scored, "book_id", F.col("score"), "id", most)

    # -- images

    def gallery(self, q: str | None = None, book_id: str | None = None, kind: str | None = None, year_from: int | None = None, year_to: int | None = None, min_confidence: float = 0.5, limit: int = 50, offset: int = 0) -> dict[str, DataFrame]:
        """items: detected images with their book, best first; total; facets: counts by type, author, decade."""
        p = nested.unwind(self.pages("detected_images"), "detected_images", "img", index="image_index").select("id", "book_id", "page_number", "image_index", "img.*").where(F.col("confidence") >= min_confidence)
        if book_id:
            p = p.where(F.col("book_id") == book_id)
        if kind:
            p = p.where(F.col("type") == kind)
        j = joins.lookup_one(p, self.books().select("id", F.coalesce("display_title", "title").alias("title"), "author", "year"), "book_id", "id", "b_")
        if year_from or year_to:
            j = j.where(filters.between("b_year", year_from, year_to))
        if q:
            j = j.where(filters.any_field_contains(["description", "b_title"], q))
        order = [F.desc_nulls_last("confidence"), F.asc("id"), F.asc("image_index")]
        return {
            "items": ordered.page_of(j, order, limit, offset, 200),
            "total": j.agg(F.count(F.lit(1)).alias("n")),
            "facets": nested.facets(j, {"type": F.col("type"), "author": F.col("b_author"), "decade": (F.floor(F.col("b_year") / 10) * 10).cast("int")}),
            "years": j.agg(F.min("b_year").alias("first"), F.max("b_year").alias("last")),
        }

    def image(self, page_id: str, index: int) -> DataFrame:
        """One image by its page and place, from 0; no row if there is none."""
        return nested.unwind(self.pages("detected_images").where(F.col("id") == page_id), "detected_images", "img", index="image_index").where(F.col("image_index") == index)

    def post_images(self, n: int = 5, min_confidence: float = 0.7, exclude: DataFrame | None = None) -> DataFrame:
        """The best images for a series, of which no two are from one book. exclude: (page_id, image_index)
        of images used of late."""
        j = nested.unwind(self.pages("detected_images"), "detected_images", "img", index="image_index").select("id", "book_id", "image_index", "img.*").where(F.col("confidence") >= min_confidence)
        if exclude is not None:
            x = exclude.select(F.col("page_id").alias("__p"), F.col("image_index").alias("__i"))
            j = j.join(x, (F.col("id") == F.col("__p")) & (F.col("image_index") == F.col("__i")), "left_anti")
        rich = 50 * F.col("confidence") + F.when(filters.has_text("description", 50), 10).otherwise(0) + F.when(F.col("type").isNotNull(), 5).otherwise(0)
        key = F.concat("id", F.lit(":"), F.col("image_index").cast("string"))
        return ordered.best_per_group(j.withColumn("key", key), "book_id", rich, "key", clamp(n, 50))

    # -- reading

    def book(self, book_id: str) -> dict[str, DataFrame]:
        """A book and its pages without their texts."""
        heavy = self.pages("photo", "manually_reviewed", filters.has_text("ocr.data").alias("has_ocr"), filters.has_text("translation.data").alias("has_translation"), book_id=book_id)
        return {"book": self.books().where(F.col("id") == book_id), "pages": heavy.orderBy("page_number", "id")}

    def quote(self, book_id: str, page: int = 1, original: bool = True, context: bool = False, translator: str = "the library", year: int = 2025) -> DataFrame:
        """A page's text with citations and its short link, and the pages before and after."""
        p = self.pages(F.col("translation.data").alias("translation"), F.col("ocr.data").alias("original"), book_id=book_id)
        p = joins.neighbours(p, "book_id", "page_number", "translation") if context else p
        one = joins.lookup_one(p.where(F.col("page_number") == page), self.books(), "book_id", "id", "b_", required=True)
        cite = ids.citations(F.col("b_author"), F.coalesce("b_display_title", "b_title"), F.col("b_published"), F.col("b_doi"), F.col("page_number"), translator, year)
        columns = ["id", "page_number", "translation", *["original"] * original, *["before_1", "after_1"] * context]
        return one.select(*columns, cite.alias("citation"), ids.shortlink("book_id", F.col("page_number").cast("int")).alias("short_code"))

    def chapters(self, book_id: str) -> DataFrame:
        """Headings of a book's pages in order, with the section that each opens: short sections (under three
        pages) belong to the one before, unless they are the first."""
        p = self.pages(markup.headings(F.col("ocr.data")).alias("hs"), book_id=book_id).select("book_id", "page_number", F.explode("hs").alias("h")).select("book_id", "page_number", "h.level", "h.title")
        starts = p.groupBy("book_id", "page_number").agg(F.min_by(F.struct("level", "title"), "level").alias("h")).select("book_id", F.col("page_number").cast("int").alias("start"), "h.*")
        last = self.pages(book_id=book_id).agg(F.max("page_number").cast("int").alias("last_page"))
        s = ordered.sections(starts.crossJoin(F.broadcast(last)), "book_id", "start", F.col("last_page"))
        w = W.partitionBy("book_id").orderBy("start")
        opens = (F.col("section_end") - F.col("start") + 1 >= 3) | (F.row_number().over(w) == 1) | F.lead("start").over(w).isNull()
        grouped = s.withColumn("opens", opens).withColumn("section", F.sum(F.col("opens").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
        return grouped.groupBy("book_id", "section").agg(F.min("start").alias("start_page"), F.max("section_end").alias("end_page"), F.min_by("title", "start").alias("title")).orderBy("section")

    # -- indexes and entities

    def index(self, book_id: str, tag: str = "keywords", field: str = "translation") -> DataFrame:
        """(term, kind, places, n_places) of a book's tagged terms."""
        p = self.pages(markup.terms(F.col(f"{field}.data"), tag).alias("terms"), book_id=book_id).select("page_number", F.explode("terms").alias("term"))
        i = A.inverted_index(p.select("term", F.col("page_number").cast("int").alias("page")), "term", "page")
        return i.withColumn("kind", markup.term_kind(F.col("term"))).orderBy(F.desc("n_places"), "term")

    def entities(self, tag: str = "keywords", kind: str | None = None, q: str | None = None, min_books: int = 1, limit: int = 50, offset: int = 0) -> DataFrame:
        """Terms over all books by lower-case name and kind: the casing seen first, books, mentions. Each page
        of a book counts once."""
        p = self.pages(markup.terms(F.col("translation.data"), tag).alias("terms")).select("book_id", "page_number", F.explode("terms").alias("term"))
        t = p.select("book_id", "page_number", "term", markup.term_kind(F.col("term")).alias("kind"), F.lower("term").alias("name")).dropDuplicates(["kind", "name", "book_id", "page_number"])
        e = t.groupBy("kind", "name").agg(F.min_by("term", F.struct("book_id", "page_number")).alias("label"), F.count_distinct("book_id").alias("book_count"), F.count(F.lit(1)).alias("total_mentions"))
        e = e.where(F.col("book_count") >= min_books)
        if kind:
            e = e.where(F.col("kind") == kind)
        if q:
            e = e.where(filters.contains_ci("name", q))
        return ordered.page_with_total(e, [F.desc("total_mentions"), F.asc("name"), F.asc("kind")], limit, offset)

    def related(self, name: str, tag: str = "keywords", k: int = 10) -> DataFrame:
        """The entities that share most books with one."""
        p = self.pages(markup.terms(F.col("translation.data"), tag).alias("terms")).select("book_id", F.explode("terms").alias("term")).select(F.lower("term").alias("name"), "book_id")
        return joins.co_occurring(p, "name", "book_id", name.lower(), k)

    # -- quality and usage

    def qa_sample(self, n: int = 50, book_id: str | None = None, seed: int = 0) -> dict[str, DataFrame]:
        """A sample of translated pages with their markup faults, and the share of faulty pages with its
        interval, for all pages."""
        p = self.pages(F.col("translation.data").alias("t"), F.coalesce("translation.model", F.lit("unknown")).alias("model")).where(filters.has_text("t"))
        p = p.where(F.col("book_id") == book_id) if book_id else p
        s = ordered.exact_sample(p, "id", clamp(n, 200), seed).withColumn("issues", markup.issues("t"))
        g = s.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("issues") > 0).alias("with_issues"), F.sum(F.size("issues")).alias("n_issues"), A.half_up(F.avg(F.length("t"))).alias("mean_length"))
        total = s.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("issues") > 0).alias("k")).crossJoin(p.agg(F.count(F.lit(1)).alias("population")))
        ci = stats.wilson(F.col("k"), F.col("n"))
        return {"pages": s, "models": g, "estimate": total.select("n", "k", "population", ci.alias("interval"), stats.estimate(F.try_divide("k", "n"), ci, F.col("population")).alias("pages"))}

    def usage(self, group_by: str = "day", start: str | None = None, end: str | None = None, book_id: str | None = None) -> DataFrame:
        """Calls, failures, cost and tokens by day, type, model or book."""
        u = table(self.spark, self.folder, "gemini_usage").dropDuplicates(["id"])
        if start or end:
            u = u.where(filters.between("timestamp", F.lit(start).cast("timestamp_ntz") if start else None, F.lit(end).cast("timestamp_ntz") if end else None))
        if book_id:
            u = u.where(F.col("book_id") == book_id)
        dims = {"day": F.date_format("timestamp", "yyyy-MM-dd"), "type": F.coalesce("type", F.lit("Unknown")), "model": F.coalesce("model", F.lit("Unknown")), "book": F.coalesce("book_id", F.lit("Unknown"))}
        failed = F.coalesce(F.lower("status").startswith("fail") | (F.lower("status") == "error"), F.lit(False))
        return A.usage_by(u, [dims[group_by].alias(group_by)], F.col("cost_usd"), failed, pages=F.col("page_count"), tokens_in=F.col("input_tokens"), tokens_out=F.col("output_tokens")).orderBy(F.desc("cost"), group_by)
