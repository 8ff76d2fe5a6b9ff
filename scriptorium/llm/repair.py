"""Problem 5: noise in the text of scanned pages.

Lines are told apart by their form and by what repeats through the book: running headers, printed
numbers, lines whose last word is broken. Misread words are found by a symmetric-delete index over
the corpus frequency lexicon: forms that are alike but for one piece of up to two letters meet, and a
rare form is held against a far more frequent one by a weighted edit distance. What it costs to read
one piece for another is learned from the corpus: the more of the frequent words with that piece are
seen misread so, the cheaper; the usual confusions of print are only where it starts from. Where
several repairs are possible, the neighbouring words decide by their bigram counts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.llm import pagetext
from scriptorium.llm.matching import fold, near, surname
from scriptorium.session import materialize, small

# Letters of print and what they are usually misread as, "right wrong".
USUAL = "e c, c e, i l, t r, a o, n u, u n, s f, g q, h b, v y, m rn, d cl, in m, l 1, i 1, o 0, ti d, ü ii, é 6, ó 6, ß b"
#: Of the frequent words with a piece of text, the share that is taken to be seen misread in a usual and in
#: any other way, as if so many words had been looked at before the corpus; words seen SHOWS times show all
#: their misreadings, rarer ones so much less.
USUAL_SHARE, OTHER_SHARE, BEFORE, SHOWS = 0.5, 0.002, 20, 1000
#: A word is misread in one way at most this often; forms that are more frequent are words of their own.
MOST_MISREAD = 1 / 80
#: Words of two or three letters, which other words are near by chance, even less.
MOST_MISREAD_SHORT = 1 / 200
#: Least occurrences of a word from whose misreadings is learned.
TEACHES = 100
#: Most cost of a repair for each letter of the word, and for a short word.
COST_A_LETTER, COST_SHORT = 0.25, 0.75
#: Words of so many letters and more are found by their first or last letters.
LONG = 60
# Words that follow a hyphen which joins two compounds ("Gold- und Silber").
JOINERS = {"und", "oder", "en", "of", "and", "or", "et", "ou", "e", "o", "y", "u"}
# Words that open a chapter heading.
CHAPTERS = {"caput", "capitel", "kapitel", "chapitre", "chapter", "capitolo", "capitulo", "hoofdstuk"}

#: Letters, and digits among letters (a misread l or o).
WORD = re.compile(r"[^\W_]*[^\W\d_][^\W_]*")
NUMBER = re.compile(rf"[ \t]*{pagetext.NUMBER}[ \t]*")
FURNITURE = re.compile(rf"[ \t]*{pagetext.FURNITURE}[ \t]*")
HEADING = re.compile(r"[ \t]*(?:(?:fol\. ?\w+|p\. ?\w+|['’.,]?[A-ZÀ-Þ0-9][^\s]*|['’.,]+[^\s]*|\[\w+\]|- ?\w+ ?-|&)(?:[ \t]+|$)){1,9}")
#: A printed number beside a running header, two spaces apart: Arabic, Roman in small letters, or marked up.
BESIDE = rf"(?:<page-num>[^<\n]*</page-num>|\[?{pagetext.ARABIC}[rv]?\]?\.?|- ?{pagetext.ARABIC} ?-|(?:fol|p)\. ?{pagetext.ARABIC}[rv]?\.?|[ivxlcdm1]+\.?)"
IN_HEADER = re.compile(rf"^[ \t]*{BESIDE}[ \t]{{2,}}|[ \t]{{2,}}{BESIDE}[ \t]*$")
MARKUP = re.compile(r"<([A-Za-z][\w-]*)>[^<]*</\1>|<[^>\n]*>|\[\[[^\]\n]*(?:\]\]|\n[^\]\n]*\]\]|$)")
BROKEN = re.compile(rf"(\w)[{pagetext.HYPHENS}] *\n+(?=[a-zß-ÿ])(?!(?:{'|'.join(sorted(JOINERS))})\b)")
HYPHEN_END = re.compile(rf"([^\W\d_]+)[{pagetext.HYPHENS}][ \t]*$")


def header_key(line: str) -> str:
    """A header without its page number and without everything that isn't a letter."""
    return fold(IN_HEADER.sub(" ", line)).replace(" ", "")


class Page:
    """The lines of one page by their kind. Line numbers count from 1, empty lines included."""

    def __init__(self, text: str) -> None:
        self.lines = text.split("\n")
        full = [i for i, line in enumerate(self.lines) if line.strip()]
        self.numbers: list[int] = []
        self.header = -1
        skip = set()
        for at, i in enumerate(full[:3]):
            line = self.lines[i]
            if NUMBER.fullmatch(line):
                self.numbers.append(i)
            elif FURNITURE.fullmatch(line):
                pass
            elif len(full) > 1 and HEADING.fullmatch(IN_HEADER.sub("", line, count=1)):
                words = fold(line).split()
                if words and words[0] in CHAPTERS:
                    pass
                elif self.header < 0 and at < 2 and len(line) < 70:
                    self.header = i
                else:
                    break
            else:
                break
            skip.add(i)
        for i in reversed(full[-3:]):
            line = self.lines[i]
            if i in skip:
                break
            if NUMBER.fullmatch(line):
                self.numbers.append(i)
            elif not FURNITURE.fullmatch(line):
                break
            skip.add(i)
        if self.header >= 0 and IN_HEADER.search(self.lines[self.header]):
            self.numbers.append(self.header)
        self.running = [i for i in full if i not in skip]

    def first_word(self) -> str:
        """The first word of the running text."""
        for i in self.running:
            if m := re.match(r"\s*([^\W\d_]+)", self.lines[i]):
                return m[1]
            return ""
        return ""

    def hyphens(self) -> tuple[list[int], int, list[tuple[int, str]]]:
        """Lines whose last word goes on in the next line; the last line if it ends with a hyphen and
        only the next page can tell (else -1); and lines with a hyphen before a joining word, each with the
        word that both would make: it breaks a word only if that word is known."""
        out, maybe = [], []
        for at, i in enumerate(self.running):
            line = self.lines[i].rstrip()
            end = HYPHEN_END.search(line) if line and line[-1] in pagetext.HYPHENS else None
            if not end:
                continue
            if at + 1 == len(self.running):
                return out, i, maybe
            follow = re.match(r"\s*([^\W\d_]+)", self.lines[self.running[at + 1]])
            if follow and follow[1][0].islower():
                if follow[1] in JOINERS:
                    maybe.append((i, (end[1] + follow[1]).lower()))
                else:
                    out.append(i)
        return out, -1, maybe

    def words(self) -> list[tuple[int, int, str]]:
        """(line, rest, word) of the running text, lower case; a broken word stands whole on its first
        line and rest counts its letters there (0 for other words). Markup is out, and so is the
        page's first word if it may be the rest of a word, and the last if the text breaks off."""
        clean = {i: self.lines[i] for i in self.running}
        if any("<" in s or "[[" in s for s in clean.values()):
            joined = MARKUP.sub(lambda m: "\n" * m[0].count("\n") + " ", "\n".join(self.lines))
            parts = joined.split("\n")
            clean = {i: parts[i] for i in self.running} if len(parts) == len(self.lines) else {i: MARKUP.sub(" ", s) for i, s in clean.items()}
        broken, pending, _ = self.hyphens()
        out: list[tuple[int, int, str]] = []
        carry: tuple[int, str] | None = None
        for i in self.running:
            ws = WORD.findall(clean[i].lower())
            if carry and ws:
                out.append((carry[0], len(carry[1]), carry[1] + ws[0]))
                ws = ws[1:]
            carry = None
            if ws and (i in broken or i == pending):
                carry = (i, ws[-1])
                ws = ws[:-1]
            out += [(i, 0, w) for w in ws]
        if self.running:
            if self.first_word()[:1].islower() and out:
                out = out[1:]
            last = clean[self.running[-1]].rstrip()
            if out and (last[-1:].isalpha() or last.endswith(("...", "…"))):
                out = out[:-1]
        return out


def lexicon(texts: DataFrame) -> DataFrame:
    """(word, n): frequency of every word form in the whole corpus, lower case. Counted within each
    batch first, so that a word crosses the network once per batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for batch in batches:
            for t in batch["text"]:
                if "<" in t or "[[" in t:
                    t = MARKUP.sub(" ", t)
                counts.update(WORD.findall(BROKEN.sub(r"\1", t).lower() if "\n" in t else t.lower()))
            if len(counts) > 300_000:
                yield pd.DataFrame(counts.items(), columns=["word", "n"])
                counts = Counter()
        yield pd.DataFrame(list(counts.items()), columns=["word", "n"])

    return texts.select("text").mapInPandas(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def pairs_of(text: str) -> list[tuple[str, str]]:
    return [tuple(x.split()) for x in text.split(", ")]


def piece(right: str, wrong: str) -> str:
    """"x>y" if reading y for the one piece x turns the one word into the other; else ''. The pieces are as
    short as can be; one of them may be empty."""
    i, most = 0, min(len(right), len(wrong))
    while i < most and right[i] == wrong[i]:
        i += 1
    j = 0
    while j < most - i and right[-1 - j] == wrong[-1 - j]:
        j += 1
    x, y = right[i : len(right) - j], wrong[i : len(wrong) - j]
    return f"{x}>{y}" if len(x) <= 2 and len(y) <= 2 and x != y else ""


def index_keys(word: Column) -> Column:
    """The symmetric-delete keys of a word: the word without each piece of up to two letters, by what is
    before and behind it. Words that are alike but for one such piece share a key. Long words have keys of
    their first and last letters instead, of which such a pair shares one at least."""
    n = F.length(word)
    every = F.flatten(F.transform(F.array(*[F.lit(k) for k in (0, 1, 2)]), lambda k: F.transform(
        F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), lambda i: F.xxhash64(F.substring(word, F.lit(1), i), F.lit("/"), F.substring(word, i + k + 1, n)))))
    half = LONG // 2
    ends = F.array(F.xxhash64(F.lit("first"), F.substring(word, 1, half)), F.xxhash64(F.lit("last"), F.right(word, F.lit(half))))
    return F.array_distinct(F.when(n < LONG - 2, every).when(n > LONG + 2, ends).otherwise(F.concat(every, ends)))


def explains(n: Column, n_fix: Column, rate: Column | float) -> Column:
    """Whether a word seen n_fix times may be misread n times in one way if that happens at a rate of at
    most `rate`, as far as such counts can tell: the rate itself for large counts, and a chance of one in
    twenty or so for small ones. So a misreading isn't lost as the corpus grows."""
    return n_fix * rate >= F.greatest(n * 0.1, n - 1.645 * F.sqrt(n))


def close_forms(words: DataFrame) -> DataFrame:
    """(word, fix, n, n_fix, piece): all forms that differ from a more frequent one in one piece, of which
    they may be a misreading by their counts. Both sides of the index are spread by key; a key is a word
    less a piece, so few forms share one, however large the corpus. Forms of one letter are left out."""
    known = words.where(F.length("word") >= 2)
    rate = F.when(F.length("word") <= 3, MOST_MISREAD_SHORT).otherwise(MOST_MISREAD)
    right = known.where(F.col("n") * MOST_MISREAD >= 0.1).select(F.explode(index_keys(F.col("word"))).alias("key"), F.col("word").alias("fix"), F.col("n").alias("n_fix"))
    wrong = known.select(F.explode(index_keys(F.col("word"))).alias("key"), "word", "n")
    met = wrong.join(right, "key").where((F.col("word") != F.col("fix")) & explains(F.col("n"), F.col("n_fix"), rate)).select("word", "fix", "n", "n_fix").distinct()

    @F.pandas_udf("string")
    def pieces(word: pd.Series, fix: pd.Series) -> pd.Series:
        return pd.Series([piece(f, w) for w, f in zip(word, fix)])

    return met.withColumn("piece", pieces("word", "fix")).where("piece <> ''")


def confusion_costs(words: DataFrame, close: DataFrame, usual: str = USUAL) -> list[tuple[str, float]]:
    """("x>y", cost) of the pieces that are misread in many words: the negative logarithm of the share of
    frequent words with x that are seen with y in its place. The usual confusions and others start from
    different shares, which the corpus outweighs as more words are seen. Costs so high that no word could
    bear them are left out, which leaves few: each takes a twentieth of the frequent words with its piece."""
    seen = close.where(F.col("n_fix") >= TEACHES).groupBy("piece").agg(F.count_distinct("fix").alias("k"))
    frequent = words.where(F.col("n") >= TEACHES)
    shows = F.least(F.lit(1.0), F.col("n") / SHOWS)
    n = F.length("word")
    inside = F.flatten(F.transform(F.array(F.lit(1), F.lit(2)), lambda k: F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.substring(F.col("word"), i, k))))
    shown = frequent.select(F.explode(F.array_distinct(F.concat(F.array(F.lit("")), inside))).alias("x"), shows.alias("s")).groupBy("x").agg(F.sum("s").alias("shown"))
    listed = {f"{a}>{b}" for a, b in pairs_of(usual)}
    start = F.when(F.col("piece").isin(sorted(listed)), USUAL_SHARE).otherwise(OTHER_SHARE)
    share = F.least(F.lit(1.0), (F.col("k") + BEFORE * start) / (F.coalesce("shown", F.lit(0.0)) + BEFORE))
    learned = seen.join(shown, F.substring_index("piece", ">", 1) == F.col("x"), "left").select("piece", share.alias("share"))
    found = {r["piece"]: r["share"] for r in learned.where(F.col("share") >= 0.05).collect()}
    unseen = {r["x"]: r["shown"] for r in shown.where(F.col("x").isin(sorted({x.split(">")[0] for x in listed}))).collect()}
    for x in listed - {r["piece"] for r in learned.where(F.col("piece").isin(sorted(listed))).collect()}:
        found[x] = BEFORE * USUAL_SHARE / (unseen.get(x.split(">")[0], 0.0) + BEFORE)
    return sorted((x, -math.log(max(share, 1e-9))) for x, share in found.items())


def two_slips(fix: str, costs: list[tuple[str, str, float]], most: float) -> dict[str, float]:
    """Every form that two misreadings make of a word, with their least cost, up to `most`."""
    one = {}
    for x, y, cost in costs:
        at = fix.find(x)
        while at >= 0 and x:
            form = fix[:at] + y + fix[at + len(x) :]
            one[form, at + len(y)] = min(cost, one.get((form, at + len(y)), most))
            at = fix.find(x, at + 1)
    out: dict[str, float] = {}
    for (form, begin), cost in one.items():  # the second behind the first, so that each pair comes once
        for x, y, more in costs:
            if x and cost + more <= most:
                at = form.find(x, begin)
                while at >= 0:
                    other = form[:at] + y + form[at + len(x) :]
                    out[other] = min(cost + more, out.get(other, most))
                    at = form.find(x, at + 1)
    out.pop(fix, None)
    return out


def corrections(words: DataFrame, usual: str = USUAL) -> DataFrame:
    """(word, fix, n, n_fix, cost): every form with every form that it may be a misreading of.

    cost is the weighted edit distance: of one misread piece, or of two that both have learned costs. A
    repair may cost COST_A_LETTER for each letter. The counts must allow it (see explains); for two
    misreadings at the square of the rate. Words of any length take part.
    """
    close = materialize(close_forms(words), "close")
    costs = confusion_costs(words, close, usual)
    table = words.sparkSession.createDataFrame(costs or [("", 0.0)], "piece string, cost double")
    bound = F.greatest(F.lit(COST_SHORT), COST_A_LETTER * F.length("word"))
    one = close.join(F.broadcast(table), "piece").where(F.col("cost") <= bound).select("word", "fix", "n", "n_fix", "cost")
    split = [(*x.split(">"), c) for x, c in costs]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(w, f, n, c) for f, n in zip(batch["word"], batch["n"]) for w, c in two_slips(f, split, max(COST_SHORT, COST_A_LETTER * (len(f) + 2))).items()]
            yield pd.DataFrame(rows, columns=["word", "fix", "n_fix", "cost"])

    frequent = words.where((F.col("n") * MOST_MISREAD**2 >= 0.1) & (F.length("word") >= 4)).select("word", "n")
    made = frequent.mapInPandas(run, "word string, fix string, n_fix bigint, cost double").where(F.col("cost") <= bound)
    two = made.join(words, "word").where(explains(F.col("n"), F.col("n_fix"), MOST_MISREAD**2)).select("word", "fix", "n", "n_fix", "cost")
    return one.unionByName(two).groupBy("word", "fix").agg(F.max("n").alias("n"), F.max("n_fix").alias("n_fix"), F.round(F.min("cost"), 4).alias("cost"))


STRUCTURE = "page_id string, book_id string, page_number double, first string, header int, header_key string, numbers array<int>, hyphens array<int>, maybe array<struct<line:int,word:string>>, pending int, unknown array<struct<line:int,rest:int,word:string,before:string,after:string>>"


def page_structure(texts: DataFrame, good: set[str]) -> DataFrame:
    """One row per page (page_id, book_id, page_number, text): its special lines, and the words of its
    running text that aren't in `good`, with their neighbours."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for pid, bid, number, text in zip(batch["page_id"], batch["book_id"], batch["page_number"], batch["text"]):
                page = Page(text)
                broken, pending, maybe = page.hyphens()
                ws = page.words()
                odd = [
                    {"line": i + 1, "rest": rest, "word": w, "before": ws[k - 1][2] if k else "", "after": ws[k + 1][2] if k + 1 < len(ws) else ""}
                    for k, (i, rest, w) in enumerate(ws)
                    if w not in good
                ]
                h = page.header
                rows.append((pid, bid, number, page.first_word(), h + 1, header_key(page.lines[h]) if h >= 0 else None, [i + 1 for i in page.numbers], [i + 1 for i in broken], [{"line": i + 1, "word": w} for i, w in maybe], pending + 1, odd))
            yield pd.DataFrame(rows, columns=["page_id", "book_id", "page_number", "first", "header", "header_key", "numbers", "hyphens", "maybe", "pending", "unknown"])

    return texts.select("page_id", "book_id", "page_number", "text").mapInPandas(run, STRUCTURE)


def true_headers(structure: DataFrame, books: DataFrame) -> DataFrame:
    """(page_id, line_no) of running headers: top lines in capitals that repeat in their book, or that
    begin like its title or are its author's name, but for a slip or two."""
    tops = structure.where("header > 0 and header_key <> ''").select("page_id", "book_id", F.col("header").alias("line_no"), "header_key")
    kinds = tops.groupBy("book_id", "header_key").agg(F.count(F.lit(1)).alias("n"))
    named = kinds.join(books.select(F.col("id").alias("book_id"), "title", "author"), "book_id", "left")
    common = named.withColumn("most", F.max_by("header_key", F.struct("n", "header_key")).over(W.partitionBy("book_id")))

    @F.pandas_udf("boolean")
    def is_header(key: pd.Series, n: pd.Series, title: pd.Series, author: pd.Series, most: pd.Series) -> pd.Series:
        out = []
        for k, c, t, a, m in zip(key, n, title, author, most):
            t, a = fold(t or "").replace(" ", ""), fold((a or "").split(" ")[-1])
            slips = 1 if len(k) < 6 else 2
            out.append(bool(c >= 2 or near(re.sub("[ivxl]+$", "", k), "liber", 1) or (len(k) >= 3 and any(near(k, t[: len(k) + d], slips) for d in (0, 1))) or (a and near(k, a, slips)) or (len(k) > 4 and m and near(k, m, slips))))
        return pd.Series(out)

    judged = common.withColumn("ok", is_header("header_key", "n", "title", "author", "most")).where("ok").select("book_id", "header_key")
    return tops.join(judged, ["book_id", "header_key"]).select("page_id", "line_no")


def good_words(words: DataFrame, wrong: DataFrame, most: int = 30_000) -> set[str]:
    """The most frequent forms that aren't misreadings, at most `most`: a shortcut that keeps them from
    being looked up. What is looked up in vain otherwise has the same result, whatever `most` is."""
    top = words.join(wrong.select("word").distinct(), "word", "left_anti").orderBy(F.desc("n"), "word").limit(most)
    return {r["word"] for r in top.select("word").collect()}


def prepare(pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """texts of the latest states, the lexicon, its corrections, and the structure of each page."""
    data = pages.select("id", "book_id", "page_number", "updated_at", F.col("ocr.data").alias("text"))
    texts = pagetext.latest_pages(data, "text").where("text <> ''").withColumnRenamed("id", "page_id")
    texts = materialize(texts, "texts")
    words = materialize(lexicon(texts), "lexicon")
    wrong = materialize(corrections(words), "wrong")
    structure = materialize(page_structure(texts, good_words(words, wrong)), "structure")
    return texts, words, wrong, structure


def wrong_words(structure: DataFrame, wrong: DataFrame) -> DataFrame:
    """(page_id, line_no, word, fix, before, after, n_fix): every possible repair of every misread word;
    of a broken word, on the line that holds the wrong letter."""
    odd = structure.select("page_id", F.explode("unknown").alias("u")).select("page_id", "u.*")
    met = odd.join(small(wrong.select("word", "fix", "n_fix"), 500_000), "word")
    # letters that agree at the beginning: beyond the break, the slip is on the next line
    same = F.aggregate(F.sequence(F.lit(1), F.length("word")), F.lit(0), lambda k, i: F.when((k == i - 1) & (F.substring(F.col("word"), i, F.lit(1)) == F.substring(F.col("fix"), i, F.lit(1))), i).otherwise(k))
    line = F.when((F.col("rest") > 0) & (same >= F.col("rest")), F.col("line") + 1).otherwise(F.col("line"))
    return met.select("page_id", line.alias("line_no"), "word", "fix", "before", "after", "n_fix")


def noisy_lines(pages: DataFrame, books: DataFrame) -> DataFrame:
    """(page_id, line_no, kind), kind being hyphen, misread, header or page_number.

    Reads whole texts of the latest states. A page without text has no row; a page of one line has
    no header. A hyphen at the end of a page counts if the book's next page goes on in small
    letters.
    """
    _, words, wrong, structure = prepare(pages)
    kinds = lambda c, kind: structure.select("page_id", F.explode(c).alias("line_no"), F.lit(kind).alias("kind"))
    out = kinds("numbers", "page_number").unionByName(kinds("hyphens", "hyphen"))
    known = words.where("n >= 2").select("word").join(wrong.select("word"), "word", "left_anti")
    joined = structure.select("page_id", F.explode("maybe").alias("m")).select("page_id", F.col("m.line").alias("line_no"), "m.word").join(known, "word", "left_semi")
    out = out.unionByName(joined.select("page_id", "line_no", F.lit("hyphen").alias("kind")))
    out = out.unionByName(true_headers(structure, books).withColumn("kind", F.lit("header")))
    ends = pagetext.with_next(structure.select(F.col("page_id").alias("id"), "book_id", "page_number", "first", "pending"), {"next_first": "first"})
    small_letter = F.col("next_first").rlike(r"^\p{Ll}") & ~F.col("next_first").isin(sorted(JOINERS))
    out = out.unionByName(ends.where((F.col("pending") > 0) & small_letter).select(F.col("id").alias("page_id"), F.col("pending").alias("line_no"), F.lit("hyphen").alias("kind")))
    misread = wrong_words(structure, wrong).select("page_id", "line_no").withColumn("kind", F.lit("misread"))
    return out.unionByName(misread).distinct()


def bigrams_with(texts: DataFrame, wanted: set[str] | None) -> DataFrame:
    """(a, b, n): how often two words stand next to each other in the corpus, one of them in wanted;
    of all words if wanted is None."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts: Counter = Counter()
            for t in batch["text"]:
                ws = WORD.findall(BROKEN.sub(r"\1", t).lower())
                counts.update((a, b) for a, b in zip(ws, ws[1:]) if wanted is None or a in wanted or b in wanted)
            yield pd.DataFrame([(a, b, n) for (a, b), n in counts.items()], columns=["a", "b", "n"])

    return texts.select("text").mapInPandas(run, "a string, b string, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))


def chosen_repairs(texts: DataFrame, structure: DataFrame, wrong: DataFrame, most_ambiguous: int = 200_000) -> DataFrame:
    """(page_id, line_no, word, fix): one repair for each misread word.

    Of several candidates the one wins whose bigrams with the words before and after are most
    frequent in the corpus; then the more frequent form, then the first by letters. Bigrams are
    counted only for candidates of ambiguous forms; if these are more than most_ambiguous, so that
    they'd not fit a task, all bigrams are counted and those asked for are found by a join, with the
    same result.
    """
    found = wrong_words(structure, wrong)
    several = wrong.groupBy("word").agg(F.collect_set("fix").alias("fixes")).where(F.size("fixes") > 1)
    forms = several.select(F.explode("fixes").alias("fix")).distinct()
    listed = forms.limit(most_ambiguous + 1).collect()
    if listed:
        if len(listed) <= most_ambiguous:
            pairs = bigrams_with(texts, {r["fix"] for r in listed})
        else:
            open_ = found.join(several.select("word"), "word", "left_semi")
            asked = open_.select(F.explode(F.array(F.struct(F.col("before").alias("a"), F.col("fix").alias("b")), F.struct(F.col("fix").alias("a"), F.col("after").alias("b")))).alias("x")).select("x.*").distinct()
            pairs = bigrams_with(texts, None).join(asked, ["a", "b"], "left_semi")
        pairs = materialize(pairs, "bigrams")
        left = pairs.select(F.col("a").alias("before"), F.col("b").alias("fix"), F.col("n").alias("n_before"))
        right = pairs.select(F.col("a").alias("fix"), F.col("b").alias("after"), F.col("n").alias("n_after"))
        found = found.join(left, ["before", "fix"], "left").join(right, ["fix", "after"], "left")
        support = F.log1p(F.coalesce("n_before", F.lit(0))) + F.log1p(F.coalesce("n_after", F.lit(0)))
    else:
        support = F.lit(0.0)
    best = F.max_by("fix", F.struct(support.alias("s"), F.col("n_fix"), F.col("fix")))
    return found.groupBy("page_id", "line_no", "word").agg(best.alias("fix"))


def repaired_pages(pages: DataFrame, books: DataFrame) -> DataFrame:
    """(page_id, text, n_repairs): the page as continuous paragraphs.

    Headers, printed numbers and other lines without running text are out; broken words are joined;
    misread words are replaced, keeping a capital; the lines of a paragraph are joined by a space, and
    paragraphs are divided by an empty line. A page of nothing but such lines has the text ''.
    """
    texts, _, wrong, structure = prepare(pages)
    fixes = chosen_repairs(texts, structure, wrong).groupBy("page_id").agg(F.collect_list(F.struct("word", "fix")).alias("fixes"))
    lines = true_headers(structure, books).groupBy("page_id").agg(F.max("line_no").alias("header_line"))
    full = texts.select("page_id", "text").join(fixes, "page_id", "left").join(lines, "page_id", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for pid, text, fixes, header in zip(batch["page_id"], batch["text"], batch["fixes"], batch["header_line"]):
                page = Page(text)
                keep = set(page.running)
                if page.header >= 0 and not header == page.header + 1:
                    keep.add(page.header)
                broken = set(page.hyphens()[0])
                out, join = "", False
                for i, line in enumerate(page.lines):
                    if i not in keep:
                        if not line.strip() and out and not join:
                            out = out.rstrip(" \n") + "\n\n"
                        continue
                    line = line.strip()
                    out += line if join or not out or out.endswith("\n") else " " + line
                    join = i in broken
                    if join:
                        out = out[:-1]
                n = 0
                to = {f["word"]: f["fix"] for f in fixes} if fixes is not None else {}
                if to:

                    def mend(m: re.Match) -> str:
                        nonlocal n
                        fix = to.get(m[0].lower())
                        if fix is None:
                            return m[0]
                        n += 1
                        return fix.upper() if m[0].isupper() and len(m[0]) > 1 else fix[0].upper() + fix[1:] if m[0][0].isupper() else fix

                    out = WORD.sub(mend, out)
                rows.append((pid, out.strip(), n))
            yield pd.DataFrame(rows, columns=["page_id", "text", "n_repairs"])

    return full.mapInPandas(run, "page_id string, text string, n_repairs int")
