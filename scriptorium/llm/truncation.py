"""Problem 4: values that were cut off before their text was complete.

A value that is a strict prefix of a longer value elsewhere is found by a prefix self-join: values
that share the hash of a fixed-length prefix are sorted, and a value that the next one extends has a
longer copy. That proves a cut if the value stops within a sentence, or if the longer copy is another
state of the same page; a whole text with which a longer one happens to begin wasn't cut. Most cut
values have no longer copy, though; those are found by their end: running text that stops within a
sentence and isn't taken up at the top of the next page, or stops with the mark of a cut or exactly
at a length at which its source cuts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.llm import pagetext
from scriptorium.session import materialize, small

LEAST = 60


def body(text: Column) -> Column:
    """A page text without the numbers, ornaments and markup lines at its end."""
    return F.rtrim(F.regexp_replace(text, pagetext.TRAILING, ""))


def unfinished(text: Column, b: Column) -> Column:
    """Whether the running text stops within a sentence, or with the marks of a cut; b: its body. A page
    number or closing line at the end shows that the end is there."""
    whole = b.rlike(r"[.!?][\"'»”’)\]]*(?:\s*</[\w-]+>)*(?:\s*\[\[[^\]]*\]\][.!?]?)?$") & ~b.rlike(r"(?:\.\.\.|…)$")
    return (F.length(b) > 0) & (F.length(b) == F.length(F.rtrim(F.regexp_replace(text, r"\s+$", "")))) & ~whole


def marked(text: Column) -> Column:
    """Whether the text ends with the dots that a transfer puts where it cut."""
    return F.rtrim(text).rlike(r"(?:\.\.\.|…)$")


def goes_on(text: Column) -> Column:
    """Whether the running text begins with a small letter, behind headers and numbers."""
    return F.regexp_replace(text, pagetext.LEADING, "").rlike(r"^[ \t]*\p{Ll}")


def strict_prefixes(values: DataFrame, key: list[str], text: str = "text", size: int = 64, narrow_rows: int = 100_000) -> DataFrame:
    """The distinct texts (key columns, text) that a longer text with the same key extends.

    Texts of under `size` characters are left out. Only texts whose first `size` characters occur
    with two or more different texts are moved. They are sorted over all partitions: a text has an
    extension exactly if the next different text of its key extends it; the last text of a
    partition is held against the first of the next. No group is gathered, however many texts share
    a prefix. Nulls have no prefix.
    """
    long = values.where(F.length(text) >= size)
    head = F.xxhash64(*key, F.substring(text, 1, size))
    kinds = long.select(head.alias("h"), F.xxhash64(text).alias("v")).groupBy("h").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("lo <> hi").select("h")
    kinds = materialize(kinds, "heads")
    shared = long.withColumn("h", head).join(small(kinds, narrow_rows), "h", "left_semi").select(*key, text).distinct()
    placed = materialize(shared.repartitionByRange(*key, text).withColumn("part", F.spark_partition_id()).sortWithinPartitions(*key, text), "sorted")
    own = W.partitionBy("part").orderBy(*key, text)
    later = placed.withColumn("after", F.lead(F.struct(*key, text)).over(own))
    firsts = placed.groupBy("part").agg(F.min(F.struct(*key, text)).alias("first"))
    follow = firsts.select("part", F.lead("first").over(W.orderBy("part")).alias("follow"))  # one row per partition
    both = later.join(F.broadcast(follow), "part").withColumn("after", F.coalesce("after", "follow"))
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col("after")[k])
    return both.where(same & F.startswith(F.col("after")[text], F.col(text))).select(*key, text)


def page_fields(pages: DataFrame) -> DataFrame:
    """(id, field, source, text, length) of all states of all pages with a text."""
    one = lambda f: F.struct(F.lit(f).alias("field"), F.col(f"{f}.source").alias("source"), F.col(f"{f}.data").alias("text"))
    return pages.where("id is not null").select("id", F.explode(F.array(one("ocr"), one("translation"))).alias("x")).select("id", "x.*").where("text <> ''")


def limits(values: DataFrame, times: int = 10, around: int = 10) -> DataFrame:
    """(source, field, length): the lengths at which a source cuts. At such a length it has over
    `times` as many values that stop within a sentence as at a length nearby: the mean over the
    `around` lengths to either side, and one more, as a mean of few says little. Takes (source, field,
    length, open) of all values; works on the counts by length. A null source is a source."""
    counts = values.where("open").groupBy("source", "field", "length").agg(F.count(F.lit(1)).alias("n"))
    near = F.sum("n").over(W.partitionBy("source", "field").orderBy("length").rangeBetween(-around, around)) - F.col("n")
    return counts.withColumn("near", near).where(F.col("n") > times * (F.col("near") / (2 * around) + 1)).select("source", "field", "length")


def judged_values(pages: DataFrame) -> DataFrame:
    """(page_id, field, source, length, cut, why) for each value of at least 60 characters of the
    latest states. why, the first that holds: state (another state of the page goes on behind it),
    prefix (stops within a sentence, and a longer text begins with it), mark (stops with dots), limit
    (stops within a sentence at a length at which its source cuts), end (stops within a sentence that
    the next page doesn't take up), or null. Null and shorter values are out."""
    marks, bodies = [], {f"__{f}": body(F.col(f"{f}.data")) for f in ("ocr", "translation")}
    for f in ("ocr", "translation"):
        data = F.col(f"{f}.data")
        ok = F.length(data) >= LEAST
        marks.append(
            F.struct(
                F.lit(f).alias("field"),
                F.col(f"{f}.source").alias("source"),
                F.length(data).alias("length"),
                F.when(ok, unfinished(data, F.col(f"__{f}"))).alias("open"),
                F.when(ok, marked(data)).alias("marked"),
                F.when(data != "", goes_on(data)).alias("goes_on"),
                F.when(ok, F.xxhash64(F.lit(f), data)).alias("value"),
            ).alias(f)
        )
    latest = pagetext.latest_pages(pages.withColumns(bodies), *marks)
    ahead = pagetext.with_next(latest.withColumns({"g_ocr": F.col("ocr.goes_on"), "g_translation": F.col("translation.goes_on")}), {"next_ocr": "g_ocr", "next_translation": "g_translation"})
    each = F.explode(F.array(F.struct("ocr.*", F.col("next_ocr").alias("taken_up")), F.struct("translation.*", F.col("next_translation").alias("taken_up")))).alias("x")
    values = materialize(ahead.select(F.col("id").alias("page_id"), each).select("page_id", "x.*").where(F.col("length") >= LEAST), "values")
    texts = page_fields(pages)
    prefixes = strict_prefixes(texts.select("field", "text"), ["field"]).select(F.xxhash64("field", "text").alias("value")).distinct()
    states = strict_prefixes(texts.select("id", "field", "text"), ["id", "field"]).select(F.col("id").alias("page_id"), F.xxhash64("field", "text").alias("value")).distinct()
    fixed = limits(values).select(F.col("source").alias("s"), F.col("field").alias("f"), F.col("length").alias("l"), F.lit(True).alias("at_limit"))
    seen = (
        values.join(prefixes.withColumn("is_prefix", F.lit(True)), "value", "left")
        .join(states.withColumn("has_state", F.lit(True)), ["page_id", "value"], "left")
        .join(small(fixed, 10_000), F.col("source").eqNullSafe(F.col("s")) & (F.col("field") == F.col("f")) & (F.col("length") == F.col("l")), "left")
    )
    open_ = F.col("open")
    why = (
        F.when(F.col("has_state"), "state")
        .when(open_ & F.col("is_prefix"), "prefix")
        .when(open_ & F.col("marked"), "mark")
        .when(open_ & F.col("at_limit"), "limit")
        .when(open_ & ~F.coalesce("taken_up", F.lit(False)), "end")
    )
    return seen.select("page_id", "field", "source", "length", why.isNotNull().alias("cut"), why.alias("why"))


def cut_rates(judged: DataFrame) -> DataFrame:
    """For each source and field: values, cut ones, their share, and the length at which most cut
    values end with its share of them (a fixed limit if near 1). A null source is a source."""
    by = ["source", "field"]
    totals = judged.groupBy(*by).agg(F.count(F.lit(1)).alias("n_values"), F.count_if("cut").alias("n_cut"))
    lengths = judged.where("cut").groupBy(*by, "length").agg(F.count(F.lit(1)).alias("n"))
    top = lengths.groupBy(*by).agg(F.max_by("length", F.struct("n", "length")).alias("usual_length"), F.max("n").alias("n_usual"))
    top = top.select(F.col("source").alias("s"), F.col("field").alias("f"), "usual_length", "n_usual")
    joined = totals.join(top, F.col("source").eqNullSafe(F.col("s")) & (F.col("field") == F.col("f")), "left")
    share = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 4)
    return joined.select(*by, "n_values", "n_cut", share(F.col("n_cut"), F.col("n_values")).alias("cut_rate"), "usual_length", share(F.col("n_usual"), F.col("n_cut")).alias("usual_share"))
