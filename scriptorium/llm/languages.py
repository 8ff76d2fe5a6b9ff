"""Problem 2: typed values mapped to the entries of a reference list.

Distinct values are normalised, meet the names of the reference list in a character n-gram inverted
index, are scored by weighted cosine, and are accepted above a threshold and with a margin to the
best name of any other entry. An edit-distance check follows. The names of an entry are those of the
reference list, and those of a table of aliases, which is given or learned from values that stand beside
known names.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.llm.matching import near
from scriptorium.session import materialize, small

# Words around a language name that don't change which language it is.
AROUND = ["language", "text", "lingua", "sprache", "langue", "lengua", "taal", "mostly", "in", "mainly", "chiefly", "orig", "original", "probably", "auf", "en", "op", "idioma"]
#: Joins between two names: such a value denotes more than one entry.
SEPARATORS = r"\s*(?:[,;/&+|]|\band\b|\bet\b|\bund\b|\be\b|\by\b|\bou\b|\bor\b|\boder\b|-)\s*"


def plain(c: Column) -> Column:
    """Lower case, without accents, brackets, marks of doubt and outer punctuation; '' for null."""
    marks = F.regexp_replace(F.regexp_replace(F.lower(c), "ß", "ss"), "[æ]", "ae")
    folded = F.translate(marks, "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿčşšžœ", "aaaaaaceeeeiiiinoooooouuuuyycsszo")
    kept = F.regexp_replace(folded, r"[^\p{L}\p{M}\p{N},;/&+|-]+", " ")
    return F.coalesce(F.trim(F.regexp_replace(kept, r"(^[\s,;/&+|-]+|[\s,;/&+|-]+$)", "")), F.lit(""))


def bare(c: Column) -> Column:
    """The plain form without the words that only accompany a name, unless nothing else is left."""
    words = F.split(F.regexp_replace(c, "-", " "), r"\s+")
    kept = F.array_join(F.filter(words, lambda w: ~w.isin(AROUND)), " ")
    return F.when(kept == "", F.regexp_replace(c, "-", " ")).otherwise(kept)


def grams(c: Column) -> Column:
    """Distinct 2- and 3-grams of a name with its ends marked."""
    s = F.concat(F.lit("^"), c, F.lit("$"))
    n = F.length(s)
    two = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(2)))
    three = F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(s, i, F.lit(3)))
    return F.array_distinct(F.concat(two, three))


def learned_aliases(rows: DataFrame, canonical: DataFrame, aliases: DataFrame | None = None, row_id: str = "lang_row_id", values: str = "values", least: int = 3, share: float = 0.75, rounds: int = 2) -> DataFrame:
    """(entry, alias, kind): names learned from rows whose `values` (an array) mostly denote one language.

    A value that is no known name gets a vote from each row for the entry that the row's known names
    denote, if they agree. It becomes an alias with at least `least` votes, of which `share` are for one
    entry; a row given twice votes once. Values that name several entries, and those of one or two
    letters, don't. Null and empty arrays and values have no vote. The names of one round are known in the
    next. aliases: names known before, which aren't returned.
    """
    if rounds > 1:
        first = learned_aliases(rows, canonical, aliases, row_id, values, least, share, rounds - 1)
        more = learned_aliases(rows, canonical, first if aliases is None else aliases.unionByName(first), row_id, values, least, share, 1)
        return materialize(first.unionByName(more), "aliases")
    names = reference_names(canonical, aliases)
    exact = names.groupBy("alias").agg(F.collect_set("canonical_code").alias("codes")).where(F.size("codes") == 1).select("alias", F.col("codes")[0].alias("code"))
    each = rows.select(F.col(row_id).alias("row"), F.explode(F.array_distinct(F.col(values))).alias("v")).where("v <> ''")
    each = materialize(each.withColumn("alias", bare(plain(F.col("v")))).where("alias <> ''").select("row", "alias").distinct(), "values")
    known = each.join(small(exact, 100_000), "alias", "left")
    agreed = known.groupBy("row").agg(F.collect_set("code").alias("codes")).where(F.size("codes") == 1).select("row", F.col("codes")[0].alias("entry_code"))
    votes = known.where(F.col("code").isNull() & ~F.col("alias").rlike(r"[,;/&+|]") & (F.length("alias") > 2)).join(agreed, "row").groupBy("alias", "entry_code").agg(F.count(F.lit(1)).alias("n"))
    judged = votes.groupBy("alias").agg(F.sum("n").alias("total"), F.max_by("entry_code", F.struct("n", "entry_code")).alias("entry_code"), F.max("n").alias("n"))
    kept = judged.where((F.col("n") >= least) & (F.col("n") >= share * F.col("total")))
    entries = canonical.select(F.col("code").alias("entry_code"), F.col("name").alias("entry"))
    return materialize(kept.join(entries, "entry_code").select("entry", "alias", F.lit("name").alias("kind")), "aliases")


def reference_names(canonical: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(canonical_code, alias, kind): every name of every entry, plain; kind is name or iso. aliases:
    (entry, alias, kind), entry being the name of an entry; those of other entries are left out."""
    both = canonical.select(
        F.col("code").alias("canonical_code"),
        F.explode(
            F.array(
                *[F.struct(F.col(c).alias("alias"), F.lit("name").alias("kind")) for c in ("code", "name", "native_name")],
                *[F.struct(F.col(c).alias("alias"), F.lit("iso").alias("kind")) for c in ("iso639_1", "iso639_3")],
            )
        ).alias("x"),
    ).select("canonical_code", "x.alias", "x.kind")
    if aliases is not None:
        known = canonical.select(F.col("name").alias("entry"), F.col("code").alias("canonical_code"))
        both = both.unionByName(aliases.join(known, "entry").select("canonical_code", "alias", "kind"))
    both = both.where("alias is not null and trim(alias) <> ''")
    p = plain(F.col("alias"))
    forms = F.when(F.col("kind") == "iso", F.array(p)).otherwise(F.array_distinct(F.array(bare(p), F.regexp_replace(p, "-", " "))))
    return both.withColumn("alias", F.explode(forms)).where("alias <> ''").distinct()


def slip_count(a: str, b: str) -> Column:
    """Insertions, deletions, changes and swaps of neighbours between two names; 3 if more than two."""

    @F.pandas_udf("int")
    def count(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([next((k for k in (0, 1, 2) if near(p, q, k)), 3) for p, q in zip(x, y)], dtype="int32")

    return count(a, b)


def map_values(values: DataFrame, canonical: DataFrame, aliases: DataFrame | None = None, value: str = "raw_value", threshold: float = 0.2, margin: float = 0.04) -> DataFrame:
    """Each distinct value with the entry it denotes, or '-', and its score.

    aliases: more names of entries, see reference_names. Result: value, canonical_code, score, how (exact,
    prefix, typo, several or none). Null and
    empty values are left out. A value that names two entries is '-' with how = several. Cost: one
    row per distinct value; the n-grams of both sides meet in a join, so neither needs to fit in
    memory.
    """
    names = materialize(reference_names(canonical, aliases), "names")
    distinct = values.select(F.col(value).alias("v")).where("v is not null and v <> ''").distinct()
    norm = distinct.withColumn("p", plain(F.col("v"))).withColumn("q", bare(F.col("p")))

    # Exact names, of the whole value and of its parts between separators.
    exact_of = names.groupBy("alias").agg(F.collect_set("canonical_code").alias("codes"))
    pieces = norm.select("v", "q", F.explode(F.array_union(F.array("p", "q"), F.transform(F.split("p", SEPARATORS), bare))).alias("alias")).where("alias <> ''")
    hits = (
        pieces.join(exact_of, "alias")
        .groupBy("v")
        .agg(
            F.array_distinct(F.flatten(F.collect_list(F.when((F.col("alias") == F.col("q")) | (F.length("alias") == F.length("q")), F.col("codes"))))).alias("whole"),
            F.array_distinct(F.flatten(F.collect_list("codes"))).alias("parts"),
        )
    )

    # Candidates: shared n-grams, weighted by their rarity among the names.
    only = names.where("kind = 'name'").select("canonical_code", "alias").distinct()
    total = only.select(F.countDistinct("alias").alias("total"))
    posted = only.withColumn("g", F.explode(grams(F.col("alias"))))
    weight = posted.groupBy("g").agg(F.countDistinct("alias").alias("df")).crossJoin(total).select("g", F.log(1 + F.col("total") / F.col("df")).alias("w"))
    index = posted.join(weight, "g").select("canonical_code", "alias", "g", "w")
    size = index.groupBy("canonical_code", "alias").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("alias_norm"))
    rest = norm.join(hits, "v", "left_anti").where(~F.col("q").rlike(r"[,;/&+|]"))
    mine = rest.select("v", "q", F.explode(grams(F.col("q"))).alias("g")).join(weight, "g", "left").withColumn("w", F.coalesce("w", F.lit(6.0)))
    own = mine.groupBy("v", "q").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("v_norm"))
    dots = mine.select("v", "g").join(index, "g").groupBy("v", "canonical_code", "alias").agg(F.sum(F.col("w") * F.col("w")).alias("dot"))
    close = dots.join(size, ["canonical_code", "alias"]).join(own, "v").withColumn("cosine", F.col("dot") / (F.col("alias_norm") * F.col("v_norm")))

    # The exact check: an abbreviation of one name, or a name with one or two slips.
    abbreviated = F.col("v").rlike(r"\.\W*$") & F.col("alias").startswith(F.col("q")) & (F.length("q") >= 2) & (F.length("q") < F.length("alias"))
    slips = slip_count("q", "alias")
    allowed = F.when(F.length("alias") < 4, 0).when(F.length("alias") < 6, 1).otherwise(2)
    judged = (
        close.where(F.col("cosine") >= threshold)
        .withColumn("short_for", abbreviated)
        .withColumn("slips", F.when(abbreviated, F.lit(0)).otherwise(slips))
        .where(F.col("short_for") | ((F.col("slips") <= allowed) & (F.col("cosine") >= threshold)))
        .withColumn("score", F.when(F.col("short_for"), 0.6 + 0.4 * F.col("cosine")).otherwise(F.col("cosine")) - 0.25 * F.col("slips") + 0.25)
    )
    per_code = judged.groupBy("v", "canonical_code").agg(F.max("score").alias("score"), F.max("short_for").alias("short_for"))
    ranked = per_code.withColumn("rn", F.row_number().over(W.partitionBy("v").orderBy(F.desc("score"), "canonical_code"))).withColumn(
        "next", F.lead("score").over(W.partitionBy("v").orderBy(F.desc("score"), "canonical_code"))
    )
    found = ranked.where("rn = 1").select(
        "v",
        F.when(F.coalesce(F.col("score") - F.col("next"), F.lit(1.0)) >= margin, F.col("canonical_code")).otherwise(F.lit("-")).alias("near_code"),
        F.col("score").alias("near_score"),
        F.when(F.col("short_for"), "prefix").otherwise("typo").alias("near_how"),
    )
    out = norm.join(hits, "v", "left").join(found, "v", "left")
    whole, parts = F.size("whole"), F.size("parts")
    one = F.when(whole == 1, F.element_at("whole", 1)).when((whole <= 0) & (parts == 1) & ~F.col("p").rlike(r"[,;/&+|]|\band\b"), F.element_at("parts", 1))
    return out.select(
        F.col("v").alias(value),
        F.coalesce(one, F.when(parts > 0, F.lit("-")), F.col("near_code"), F.lit("-")).alias("canonical_code"),
        F.round(F.when(one.isNotNull(), F.lit(1.0)).otherwise(F.coalesce("near_score", F.lit(0.0))), 4).alias("score"),
        F.when(one.isNotNull(), "exact").when(parts > 0, "several").when(F.col("near_code").isNull(), "none").when(F.col("near_code") == "-", "several").otherwise(F.col("near_how")).alias("how"),
    )


def typed_values(counts: DataFrame, row_id: str = "lang_row_id", code: str = "code", variants: str = "variants") -> DataFrame:
    """(row_id, raw_value): each distinct non-empty value of a row. Null and empty lists have none."""
    each = F.explode(F.array_union(F.array(F.col(code)), F.coalesce(F.col(variants), F.array().cast("array<string>"))))
    return counts.select(row_id, each.alias("raw_value")).where("raw_value is not null and raw_value <> ''").distinct()
