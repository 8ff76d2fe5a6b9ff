"""The pN_ queries, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import alignment, langid, languages, lookalike, matching, mixing, packing, pagetext, repair, tokens, truncation
from scriptorium.session import materialize, small, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str):
    def add(f):
        QUERIES[name] = f
        return f

    return add


@query("p9_found")
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.look_alike_pairs(table(spark, d, "documents"))


@query("p9_canonical")
def p9_canonical(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.canonical_texts(table(spark, d, "documents")).select("doc_id", "canonical_text", "changed")


def _aliases(spark: SparkSession, d: str) -> DataFrame:
    """Names of languages, learned from the values that stand beside known names in language_counts."""
    counts = table(spark, d, "language_counts")
    together = F.array_union(F.array("code"), F.coalesce("variants", F.array().cast("array<string>")))
    return languages.learned_aliases(counts.select("lang_row_id", together.alias("values")), table(spark, d, "canonical_languages"))


@query("p9_classes")
def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.look_alike_classes(table(spark, d, "documents"))


@query("p2_found")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    canonical = table(spark, d, "canonical_languages")
    typed = languages.typed_values(table(spark, d, "language_counts"))
    typed = typed.join(canonical.select(F.col("code").alias("raw_value")), "raw_value", "left_anti")
    mapped = languages.map_values(typed, canonical, _aliases(spark, d))
    return typed.join(mapped.select("raw_value", "canonical_code"), "raw_value").select("lang_row_id", "raw_value", "canonical_code")


@query("p2_unmatched")
def p2_unmatched(spark: SparkSession, d: str) -> DataFrame:
    canonical = table(spark, d, "canonical_languages")
    typed = languages.typed_values(table(spark, d, "language_counts"))
    mapped = languages.map_values(typed, canonical, _aliases(spark, d)).where("canonical_code = '-'")
    return typed.join(mapped, "raw_value").groupBy("raw_value", "how").agg(F.count(F.lit(1)).alias("n_rows"))


def _catalogues(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    left = table(spark, d, "external_catalog").selectExpr("catalog_id AS key", "title", "author", "year", "place_of_publication AS place")
    right = table(spark, d, "catalog_matches").selectExpr("match_id AS key", "title", "author", "year", "place")
    return left, right


@query("p1_found")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return matching.match_records(*_catalogues(spark, d)).select(F.col("key_a").alias("catalog_id"), F.col("key_b").alias("match_id"))


@query("p1_confidence")
def p1_confidence(spark: SparkSession, d: str) -> DataFrame:
    return matching.match_records(*_catalogues(spark, d)).withColumnsRenamed({"key_a": "catalog_id", "key_b": "match_id"})


def _counted(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_counts(table(spark, d, "documents").select("doc_id", "source", "text"))


@query("p7_packed")
def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_all(_counted(spark, d), table(spark, d, "pack_sizes"))


@query("p7_fill")
def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fills(p7_packed(spark, d))


@query("p8_mixed")
def p8_mixed(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(mixing.counted_once(_counted(spark, d)), table(spark, d, "mix_targets"))


@query("p8_shares")
def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    counted, targets = mixing.counted_once(_counted(spark, d)), table(spark, d, "mix_targets")
    return mixing.shares(mixing.mix(counted, targets), mixing.budgets(counted, targets).select("mix_name", "source", "target_share", "budget"))


@query("p4_found")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.judged_values(table(spark, d, "pages")).where("cut").select("page_id", "field")


@query("p4_values")
def p4_values(spark: SparkSession, d: str) -> DataFrame:
    return truncation.judged_values(table(spark, d, "pages")).where("cut")


@query("p4_sources")
def p4_sources(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cut_rates(truncation.judged_values(table(spark, d, "pages")))


def _book_languages(spark: SparkSession, d: str) -> DataFrame:
    """(book_id, book_lang): the ISO 639-1 code that books.language denotes, or null."""
    books, canonical = table(spark, d, "books").select("id", "language"), table(spark, d, "canonical_languages")
    mapped = languages.map_values(books, canonical, _aliases(spark, d), value="language")
    iso = canonical.select(F.col("code").alias("canonical_code"), F.col("iso639_1").alias("book_lang"))
    known = mapped.join(small(iso, 10_000), "canonical_code").select("language", "book_lang")
    return books.join(known, "language", "left").select(F.col("id").alias("book_id"), "book_lang")


def _segments(spark: SparkSession, d: str) -> DataFrame:
    """The segments of all pages, with book_lang."""
    pages = table(spark, d, "pages").select("id", "book_id", "page_number", "updated_at", "ocr.data")
    latest = pagetext.latest_pages(pages, F.col("data").alias("text")).where("text <> ''").withColumnRenamed("id", "page_id")
    texts = materialize(latest.select("page_id", "book_id", "text"), "texts")
    labels = texts.select("page_id", "book_id", F.length("text").alias("n")).join(_book_languages(spark, d), "book_id", "left")
    labels = materialize(labels.select("page_id", F.col("book_lang").alias("lang"), "n"), "labels")
    model = langid.fit(langid.labelled_sentences(table(spark, d, "language_samples"), texts, labels))
    return langid.segment_pages(texts, model).join(labels.select("page_id", F.col("lang").alias("book_lang")), "page_id")


@query("p3_found")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    s = _segments(spark, d).where((F.col("main") | F.col("whole")) & ~F.col("lang").eqNullSafe(F.col("book_lang")))
    return s.select("page_id", "lang").distinct()


@query("p3_segments")
def p3_segments(spark: SparkSession, d: str) -> DataFrame:
    return _segments(spark, d)


@query("p5_found")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return repair.noisy_lines(table(spark, d, "pages"), table(spark, d, "books"))


@query("p5_repaired")
def p5_repaired(spark: SparkSession, d: str) -> DataFrame:
    return repair.repaired_pages(table(spark, d, "pages"), table(spark, d, "books"))


@query("p6_links")
def p6_links(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("id", "book_id", "page_number", "updated_at", "manually_reviewed", F.col("ocr.data").alias("src"), F.col("translation.data").alias("trg"))
    latest = pagetext.latest_pages(pages, "manually_reviewed", "src", "trg")
    return alignment.align_pages(latest.where("manually_reviewed").withColumnRenamed("id", "page_id"))


@query("p6_found")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_links(spark, d).select("page_id", "ocr_sent", "trans_sent")
