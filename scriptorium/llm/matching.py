"""Problem 1: records of two catalogues that describe the same printing.

Each record's attributes are encoded as a fixed bit vector of hashed q-grams, in five blocks of 64
bits: surname, year, place, first and second word of the title that tell something. Close pairs are
found exactly by multi-index Hamming hashing: there is a table for each choice of two blocks, so
every pair within RADIUS differing bits, of which none lies in two of the blocks, meets in at least
one table; one slip stays within its block. Their field-weighted Dice score is worked out where they
meet. Binned Dice scores of the fields become a confidence without labels: their weights are fitted
by expectation maximisation over the counts of bin patterns, and the weights' sum is calibrated, by
isotonic regression, against an exact look at words and values. A pair is taken if its confidence
reaches the least one and the exact look finds the same work, volume and edition.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.session import materialize, small

#: The blocks of a record's bit vector; all tables, each a pair of blocks that must agree.
BLOCKS = ["surname", "year", "place", "word1", "word2"]
TABLES = [(i, j) for j in range(len(BLOCKS)) for i in range(j)]
#: Tables that are shuffled together.
TOGETHER = 4
#: Most differing bits of the blocks that both records have: seven or eight two-letter grams in each of
#: three blocks, on either side, are about 45 bits.
RADIUS = 45
#: A table's key under which more pairs would meet is cut into slices of about so many.
MOST_PAIRS = 4_000_000
TITLE_BITS = 256
#: Weights of the fields in the similarity; a field that a record lacks doesn't count.
WEIGHTS = {"title": 0.5, "author": 0.3, "place": 0.2, "year": 0.2}

# Words for a part of a work, and ordinals, in the languages of the catalogues.
PARTS = "pars tomus liber volumen teil theil band partie tome parte tomo part volume deel boek vol tom".split()
ORDINALS = {
    1: "prima primus primum erster erste premiere premier primo primera primero first eerste i 1".split(),
    2: "secunda secundus anderer ander zweiter zweite seconde second deuxieme seconda secondo segunda segundo tweede ii 2".split(),
    3: "tertia tertius dritter dritte troisieme terza terzo tercera tercero third derde iii 3".split(),
    4: "quarta quartus vierter vierte quatrieme quarto cuarta cuarto fourth vierde iv 4".split(),
}
# What stands in a field in place of a value.
NO_VALUE = {"", "s l", "s a", "s n", "s d", "n d", "n p", "sine loco", "sine anno", "unknown", "anon", "anonymous", "anonymus", "n a", "none", "various"}
# Titles before a name, printers' words after a place.
TITLES = {"d", "dr", "mag", "m", "fr", "prof", "sir", "don", "p"}
AFTER_PLACE = {"apud", "typis", "ex", "officina", "bei", "chez", "in", "impensis"}


def fold(text: str | None) -> str:
    """Lower case without accents; u for v, i for j; everything else than letters and digits as a space."""
    if not text:
        return ""
    t = unicodedata.normalize("NFD", text.lower().replace("ß", "ss").replace("æ", "ae").replace("œ", "oe"))
    t = "".join(c for c in t if not unicodedata.combining(c))
    return " ".join(re.sub(r"[^a-z0-9]+", " ", t).split())


def spelling(word: str) -> str:
    """Early modern spelling variants of a word under one form."""
    return word.replace("v", "u").replace("j", "i").replace("y", "i").replace("ck", "k").replace("th", "t").replace("ph", "f")


def surname(author: str | None) -> str:
    """The family name, without titles, given names and Latin endings; '' if there is none."""
    if not author or fold(author) in NO_VALUE:
        return ""
    a = author.strip(" []")
    if "," in a:
        a = a.split(",")[0]
    elif "(" in a:
        a = a.split("(")[0]
    words = [w for w in fold(a).split() if w not in TITLES]
    if not words:
        return ""
    last = spelling(words[-1])
    bare = re.sub(r"(i?us)+$", "", last)
    return bare if len(bare) >= 3 else last


def year_of(text: str | None) -> int:
    """The year in Arabic or Roman digits; 0 if missing or unknown."""
    t = (text or "").strip()
    if m := re.search(r"(?<!\d)1[0-9]{3}(?!\d)", t):
        return int(m[0])
    if m := re.fullmatch(r"[\[(]?([mdclxvij]{2,})[.\])]*", t.lower()):
        values = {"i": 1, "j": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
        n = [values[c] for c in m[1]]
        y = sum(-a if a < b else a for a, b in zip(n, [*n[1:], 0]))
        return y if 1000 <= y < 2000 else 0
    return 0


def place_of(text: str | None) -> tuple[str, bool]:
    """The place without Latin endings and printers' words, and whether it is abbreviated."""
    raw = (text or "").strip(" []")
    f = fold(raw)
    if f in NO_VALUE:
        return "", False
    words = [w for w in f.split() if w not in AFTER_PLACE]
    if not words:
        return "", False
    p = spelling("".join(words))
    short = raw.rstrip("]) ").endswith(".")
    if not short:
        p = re.sub(r"(gae|ae|ii|e|i)$", "", p)
    return p, short


def near(a: str, b: str, most: int) -> bool:
    """Whether a becomes b by at most `most` insertions, deletions, changes or swaps of neighbours."""
    if abs(len(a) - len(b)) > most:
        return False
    if a == b:
        return True
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if before and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        before, row = row, new
        if min(row) > most:
            return False
    return row[-1] <= most


def same_name(a: str, b: str) -> bool:
    """Whether two family names are one but for a Latin ending."""
    short, long = sorted((a, b), key=len)
    return len(short) >= 3 and long.startswith(short) and re.fullmatch(r"(?:s*i?us)*s*", long[len(short) :]) is not None


@lru_cache(maxsize=100_000)
def is_part(word: str) -> bool:
    """Whether it is a word for a part of a work, but for a slip in one of four letters or more."""
    return word in PARTS or 3 <= len(word) <= 8 and any(len(x) >= 4 and near(word, x, 1) for x in PARTS)


@lru_cache(maxsize=100_000)
def ordinal(word: str) -> int:
    """The number that it names, but for a slip in one of five letters or more; 0 if none."""
    return next((n for n, names in ORDINALS.items() if word in names or len(word) >= 4 and any(len(x) > 4 and near(word, x, 1) for x in names)), 0)


def volume_of(words: list[str], common: set[str] = frozenset()) -> int:
    """The number of the part that a title names, 0 if none. Common words aren't slips of a word for a part."""
    for i, w in enumerate(words):
        if w in PARTS or w not in common and is_part(w):
            for other in (words[i + 1] if i + 1 < len(words) else "", words[i - 1] if i else ""):
                if n := ordinal(other):
                    return n
    return 0


def bits(tokens: list[str], size: int, times: int = 1) -> int:
    import xxhash

    v = 0
    for t in tokens:
        for k in range(times):
            v |= 1 << (xxhash.xxh64_intdigest(t, seed=k) % size)
    return v


def bigrams(word: str, tag: str = "") -> list[str]:
    w = f"^{word}$"
    return [tag + w[i : i + 2] for i in range(len(w) - 1)] if word else []


def block(tokens: list[str]) -> int | None:
    """One 64-bit block as a signed number; None if there is nothing to encode."""
    if not tokens:
        return None
    v = bits(tokens, 64)
    return v - 2**64 if v >> 63 else v


def title_words(records: DataFrame) -> DataFrame:
    """(word, n): in how many records of either table a word of the title occurs."""
    folded = F.lower(F.translate(F.col("title"), "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ", "aaaaaaceeeeiiiinoooooouuuuyy"))
    words = F.array_distinct(F.split(F.trim(F.regexp_replace(folded, r"[^a-z0-9]+", " ")), " "))
    return records.select(F.explode(words).alias("word")).where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def encode(records: DataFrame, common_words: list[str]) -> DataFrame:
    """Normal forms and bit vectors of records (key, side, title, author, year, place).

    common_words: words in so many titles that they tell nothing. Records with the same normal
    forms share `form`, a hash of them.
    """
    schema = "key bigint, side int, words array<string>, short array<string>, cut boolean, volume int, surname string, year int, place string, place_short boolean, title_bits array<bigint>, place_bits bigint, blocks array<bigint>, form bigint"

    long_common = [spelling(w) for w in common_words if len(w) >= 4]
    known: dict[str, bool] = {}

    def slip_of_common(w: str) -> bool:
        if w not in known:
            if len(known) > 200_000:
                known.clear()
            known[w] = len(w) >= 5 and any(near(w, c, 1) for c in long_common)
        return known[w]

    def words_of(longs: int) -> list[int]:
        return [((longs >> (64 * i)) & (2**64 - 1)) - (2**64 if (longs >> (64 * i + 63)) & 1 else 0) for i in range(TITLE_BITS // 64)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        common, plain = {spelling(w) for w in common_words}, set(common_words)
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                raw = r.title or ""
                cut = bool(re.search(r"(…|\.\.\.|\[etc\.?\]|&c\.?|\betc\.?)\s*$", raw))
                folded = fold(re.sub(r"(…|\.\.\.|\[etc\.?\]|&c\.?|\betc\.?)\s*$", "", raw)).split()
                volume = volume_of(folded, plain)
                begin = 1 if re.match(r"\s*(?:\w+\.\s+|\w{1,4}\s)\w", raw) else 0  # an abbreviated first word, or an article
                content = [w for w in map(spelling, folded[begin:]) if w not in common and len(w) > 1 and not slip_of_common(w)] or [spelling(w) for w in folded]
                abbreviated = sorted({spelling(w) for x in re.findall(r"(\w{2,})\.(?=\s*\w)", raw) for w in fold(x).split()} & set(content))
                s, y, (p, short) = surname(r.author), year_of(r.year), place_of(r.place)
                grams, names = sum((bigrams(w) for w in content), []), bigrams(s)
                digits = [f"{i}{c}" for i, c in enumerate(str(y))] if y else []
                heads = [bigrams(w) for w in [*content, "", ""][:2]]
                blocks = [block(names), block(digits), block(bigrams(p[:4])[:-1]), *map(block, heads)]
                form = xxhash.xxh64_intdigest(repr((content, abbreviated, cut, volume, s, y, p, short))) - 2**63
                rows.append((r.key, r.side, content, abbreviated, cut, volume, s, y, p, short, words_of(bits(grams, TITLE_BITS)), block(bigrams(p)), blocks, form))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])

    return records.select("key", "side", "title", "author", "year", "place").mapInPandas(run, schema)


def dice(a: list[Column], b: list[Column]) -> Column:
    """Dice coefficient of two bit vectors, given by their 64-bit words; null if a word is null or both
    are empty."""
    count = lambda cs: reduce(lambda x, y: x + y, [F.bit_count(c) for c in cs])
    return F.try_divide(2 * count([x.bitwiseAND(y) for x, y in zip(a, b)]), count(a) + count(b))


def binned(c: Column, *bounds: float) -> Column:
    """How many of the bounds a Dice score reaches; -1 for null."""
    return F.when(c.isNull(), -1).otherwise(reduce(lambda x, y: x + y, [(c >= x).cast("int") for x in bounds]))


#: Bins of the fields' Dice scores.
DICES = {"d_title": (0.3, 0.45, 0.6, 0.75, 0.9), "d_author": (0.3, 0.5, 0.7, 0.9), "d_year": (0.5, 0.75, 0.99), "d_place": (0.3, 0.5, 0.7, 0.9), "d_volume": (0.5,)}


def close_pairs(left: DataFrame, right: DataFrame, least: float = 0.0, radius: int = 320, tables: list[tuple[int, int]] = TABLES) -> DataFrame:
    """All pairs of records that are equal in at least two blocks (a missing block is equal to none),
    within `radius` differing bits of the blocks they both have, and of a similarity of at least
    `least`: (form_a, form_b, distance, similarity, d_...), d_... being binned Dice scores of the fields.

    left, right: (form, blocks, title_bits, place_bits, volume). A pair comes from the table of its first
    two equal blocks only, so no distinct is needed; all conditions are bit counts in the join itself.
    tables: those that are looked at. If both sides have `year`, `possible` tells whether the exact look may
    take the pair.
    Under a key where more than MOST_PAIRS pairs would meet (a frequent author in a frequent town) the
    two sides are cut into slices, and each slice of the one meets each of the other, about MOST_PAIRS
    pairs at once, so no task holds the pairs of a frequent key and none is left out.
    """
    n_blocks, n_title = len(BLOCKS), TITLE_BITS // 64
    years = "year" in left.columns and "year" in right.columns

    def postings(df: DataFrame, x: str) -> DataFrame:
        # tab says which two blocks are equal, as bits
        keys = [F.struct(F.lit((1 << i) + (1 << j)).alias("tab"), F.xxhash64(F.lit(i), F.lit(j), F.col("blocks")[i], F.col("blocks")[j]).alias("key"), (F.col("blocks")[i].isNotNull() & F.col("blocks")[j].isNotNull()).alias("ok")) for i, j in tables]
        vector = [F.col("blocks")[i].alias(f"{x}{i}") for i in range(n_blocks)] + [F.get("title_bits", F.lit(i)).alias(f"{x}t{i}") for i in range(n_title)]
        return df.select(F.col("form").alias(f"form_{x}"), *vector, F.col("place_bits").alias(f"{x}p"), F.col("volume").alias(f"{x}v"), *([F.col("year").alias(f"{x}y")] if years else []), F.explode(F.filter(F.array(*keys), lambda k: k["ok"])).alias("k")).select("*", "k.tab", "k.key").drop("k")

    a, b = postings(left, "a"), postings(right, "b")
    counts = a.groupBy("tab", "key").agg(F.count(F.lit(1)).alias("n_a")).join(b.groupBy("tab", "key").agg(F.count(F.lit(1)).alias("n_b")), ["tab", "key"])
    meet = F.col("n_a") * F.col("n_b")
    parts = lambda n: F.ceil(F.col(n) / math.isqrt(MOST_PAIRS)).cast("int")
    hot = materialize(counts.where(meet > MOST_PAIRS).select("tab", "key", parts("n_a").alias("parts_a"), parts("n_b").alias("parts_b")), "hot", tidy=True)

    def sliced(df: DataFrame, x: str, y: str) -> DataFrame:
        """Each posting in one slice of its own side, once for each slice of the other side."""
        cut = df.join(small(hot, 100_000), ["tab", "key"], "left")
        own = F.pmod(F.xxhash64(f"form_{x}"), F.coalesce(f"parts_{x}", F.lit(1))).cast("int")
        others = F.sequence(F.lit(0), F.coalesce(f"parts_{y}", F.lit(1)) - 1)
        return cut.withColumn(f"slice_{x}", own).withColumn(f"slice_{y}", F.explode(others)).drop("parts_a", "parts_b")

    # the equal blocks as bits; up to the table's second block they must be just its two
    equal = reduce(lambda x, y: x + y, [F.when(F.col(f"a{i}") == F.col(f"b{i}"), 1 << i).otherwise(0) for i in range(n_blocks)])
    upto = reduce(lambda x, j: F.when(F.col("tab") >= 1 << j, (2 << j) - 1).otherwise(x), range(1, n_blocks), F.lit(0))
    first = equal.bitwiseAND(upto) == F.col("tab")
    distance = reduce(lambda x, y: x + y, [F.coalesce(F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))), F.lit(0)) for i in range(n_blocks)])
    of = lambda *names: dice([F.col(f"a{n}") for n in names], [F.col(f"b{n}") for n in names])
    scores = {"title": of(*[f"t{i}" for i in range(n_title)]), "author": of("0"), "year": of("1"), "place": of("p")}
    there = {"title": F.lit(True)} | {f: F.col(f"a{n}").isNotNull() & F.col(f"b{n}").isNotNull() for f, n in (("author", "0"), ("year", "1"), ("place", "p"))}
    weight = reduce(lambda x, y: x + y, [F.when(there[f], w).otherwise(0.0) for f, w in WEIGHTS.items()])
    similarity = F.coalesce(F.try_divide(reduce(lambda x, y: x + y, [F.coalesce(w * scores[f], F.lit(0.0)) for f, w in WEIGHTS.items()]), weight), F.lit(0.0))
    met = sliced(a, "a", "b").join(sliced(b, "b", "a"), ["tab", "key", "slice_a", "slice_b"]).where(first & (distance <= radius) & (similarity >= least))
    bins = {f"d_{f}": binned(c, *DICES[f"d_{f}"]) for f, c in scores.items()} | {"d_volume": (F.col("av") == F.col("bv")).cast("int")}
    possible = [open_to_look().alias("possible")] if years else []
    return met.select("form_a", "form_b", distance.alias("distance"), F.round(similarity, 4).alias("similarity"), *[c.alias(f) for f, c in bins.items()], *possible)


def open_to_look() -> Column:
    """Whether surnames (a0, b0: their bits), years and volumes of a pair leave it open that the exact look
    takes it: never false for a pair that it takes. An edit changes at most three two-letter grams on
    either side, so names within two edits differ in at most 12 bits; a name with a Latin ending lacks at
    most the last gram of the bare one."""
    a, b = F.col("a0"), F.col("b0")
    lacks = lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))
    named = a.isNull() | b.isNull() | (F.bit_count(a.bitwiseXOR(b)) <= 12) | (lacks(a, b) <= 1) | (lacks(b, a) <= 1)
    differ = lambda x, far: (F.col(f"a{x}") != 0) & (F.col(f"b{x}") != 0) & (F.abs(F.col(f"a{x}") - F.col(f"b{x}")) > far)
    return named & ~differ("y", 3) & ~differ("v", 0)


def possible_pairs(left: DataFrame, right: DataFrame, least: float, radius: int) -> DataFrame:
    """The close pairs that the exact look may take, (form_a, form_b, n = 1, similarity, d_...), and the others
    counted by their bins, with null forms and similarity as a sum. Some tables after the other are
    shuffled and written, so the disk holds the postings of TOGETHER tables at a time."""
    bins, out = list(DICES), []
    for i in range(0, len(TABLES), TOGETHER):
        met = close_pairs(left, right, least, radius, TABLES[i : i + TOGETHER])
        by = [F.when(F.col("possible"), F.col(k)).alias(k) for k in ("form_a", "form_b")]
        out.append(materialize(met.groupBy(*by, *bins).agg(F.count(F.lit(1)).alias("n"), F.sum("similarity").alias("similarity")), "close", tidy=True))
    return reduce(DataFrame.unionByName, out)




def agreement(pairs: DataFrame, common_words: list[str]) -> DataFrame:
    """Levels of agreement of candidate pairs by an exact look at their words and values. Of the words
    that one title has and the other hasn't, short ones that may be slips of a common word don't count."""
    short_common = [w for w in map(spelling, common_words) if len(w) <= 4]
    slips: dict[str, bool] = {}

    def counts(w: str) -> bool:
        if len(w) > 4:
            return True
        if w not in slips:
            slips[w] = not any(near(w, c, 1) for c in short_common)
        return slips[w]

    schema = "form_a bigint, form_b bigint, similarity double, pattern int, l_title int, l_author int, l_year int, l_place int, l_volume int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                a, b = list(r.words_a), list(r.words_b)
                same = set(a) & set(b)
                left, right = [w for w in a if w not in same], [w for w in b if w not in same]
                for w in list(left):
                    most = 1 if len(w) < 6 else 2
                    hit = next((x for x in right if near(w, x, most)), None)
                    if hit is not None:
                        left.remove(w)
                        right.remove(hit)
                for mine, other, short in ((left, right, r.short_a), (right, left, r.short_b)):  # abbreviated words
                    for w in [w for w in mine if w in short]:
                        whole = next((x for x in other if x.startswith(w)), None)
                        if whole is not None:
                            mine.remove(w)
                            other.remove(whole)
                if r.cut_a and left and right and any(x.startswith(left[-1]) for x in right):
                    left.pop()
                if r.cut_b and left and right and any(x.startswith(right[-1]) for x in left):
                    right.pop()
                if left and right:
                    left, right = [w for w in left if counts(w)], [w for w in right if counts(w)]
                title = 0 if left and right else 2 if not left and not right else 1
                if not (len(a) - len(left)):
                    title = 0
                sa, sb = r.surname_a, r.surname_b
                author = 1 if not sa or not sb else 3 if same_name(sa, sb) else 2 if near(sa, sb, 1 if min(len(sa), len(sb)) < 5 else 2) else 0
                ya, yb = r.year_a, r.year_b
                year = 1 if not ya or not yb else 3 if ya == yb else 2 if abs(ya - yb) <= 3 else 0
                pa, pb = r.place_a, r.place_b
                if not pa or not pb:
                    place = 1
                elif pa == pb:
                    place = 3
                elif (r.place_short_a and pb.startswith(pa)) or (r.place_short_b and pa.startswith(pb)) or near(pa, pb, 1):
                    place = 2
                else:
                    place = 0
                volume = 1 if r.volume_a == r.volume_b or (not r.volume_a and r.cut_a) or (not r.volume_b and r.cut_b) else 0
                rows.append((r.form_a, r.form_b, r.similarity, r.pattern, title, author, year, place, volume))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])

    return pairs.mapInPandas(run, schema)


LEVELS = ["l_title", "l_author", "l_year", "l_place", "l_volume"]


def same_printing() -> Column:
    """Whether the levels allow the same work, volume and edition: an edition is another one if
    year and place both differ, or one differs while the other is missing; a year that is off by three at
    most is a slip if the place agrees, or is missing while author and title agree."""
    work = (F.col("l_title") >= 1) & (F.col("l_volume") == 1) & ((F.col("l_author") >= 2) | ((F.col("l_author") == 1) & (F.col("l_title") >= 1)))
    edition = (
        ((F.col("l_year") == 3) & (F.col("l_place") >= 1))
        | ((F.col("l_year") == 2) & (F.col("l_place") >= 2))
        | ((F.col("l_year") == 2) & (F.col("l_place") == 1) & (F.col("l_author") >= 2))
        | ((F.col("l_year") == 1) & (F.col("l_place") >= 2))
    )
    vague = (F.col("l_year") == 1) & (F.col("l_place") == 1) & (F.col("l_author") >= 2) & (F.col("l_title") == 2)
    return F.when(work & edition, 2).when(work & vague, 1).otherwise(0)


def weights_of(patterns: list[tuple], rounds: int = 40) -> dict[tuple, float]:
    """The log-odds of each pattern of binned Dice scores, by EM over the counts of patterns without
    labels. patterns: (bins..., similarity, n), similarity being the mean of its pairs, from which the
    beliefs start. The bins bound the number of patterns, whatever the data."""
    fields = len(DICES)
    count = {p[:fields]: p[-1] for p in patterns}
    belief = {p[:fields]: min(0.98, max(0.02, 2 * p[fields] - 0.9)) for p in patterns}
    odds = {k: math.log(b / (1 - b)) for k, b in belief.items()}
    seen = [sorted({k[i] for k in count}) for i in range(fields)]
    for _ in range(rounds):
        match = sum(count[k] * belief[k] for k in count)
        other = sum(count[k] * (1 - belief[k]) for k in count)
        if match < 1 or other < 1:
            break
        m = [{v: (0.5 + sum(count[k] * belief[k] for k in count if k[i] == v)) / (match + 0.5 * len(seen[i])) for v in seen[i]} for i in range(fields)]
        u = [{v: (0.5 + sum(count[k] * (1 - belief[k]) for k in count if k[i] == v)) / (other + 0.5 * len(seen[i])) for v in seen[i]} for i in range(fields)]
        prior = math.log(match / other)
        odds = {k: prior + sum(math.log(m[i][k[i]] / u[i][k[i]]) for i in range(fields)) for k in count}
        belief = {k: 1 / (1 + math.exp(-max(-30, min(30, x)))) for k, x in odds.items()}
    return odds


def calibrated(points: list[tuple[float, int, int]], own: float = 20.0) -> list[float]:
    """A confidence for each point (score, n, hits): the share of hits among its pairs, drawn towards the
    share that its score stands for as if `own` more pairs had been seen with that. The latter is the
    isotonic regression of shares on scores (pool adjacent violators); half a hit and half a miss are
    added to every pool, so that nothing is certain. Many pairs speak for themselves, few follow their
    score."""
    pools: list[list] = []  # [n, hits, places]
    merged: dict[float, list] = {}
    for i, (score, n, hits) in enumerate(points):
        pool = merged.setdefault(score, [0, 0, []])
        pool[0] += n
        pool[1] += hits
        pool[2].append(i)
    share = lambda p: (p[1] + 0.5) / (p[0] + 1)
    for score in sorted(merged):
        pools.append(merged[score])
        while len(pools) > 1 and share(pools[-2]) >= share(pools[-1]):
            n, hits, places = pools.pop()
            pools[-1] = [pools[-1][0] + n, pools[-1][1] + hits, pools[-1][2] + places]
    out = [0.0] * len(points)
    for p in pools:
        for i in p[2]:
            _, n, hits = points[i]
            out[i] = (hits + own * share(p)) / (n + own)
    return out


def common_words(records: DataFrame, total: int, share: float) -> list[str]:
    """Words that occur in over `share` of all titles, by more than two standard deviations of their
    count, so that chance makes none common in a small table. Titles are of bounded length, so these are
    few dozen words."""
    n = F.col("n")
    return [r["word"] for r in title_words(records).where(n - 2 * F.sqrt(n) > share * total).collect()]


def match_records(left: DataFrame, right: DataFrame, common_share: float = 0.018, least_similarity: float = 0.5, least_confidence: float = 0.02) -> DataFrame:
    """Pairs of records of two tables that are the same printing.

    left, right: (key, title, author, year, place), all but key text that may be null or empty.
    Result: key_a, key_b, similarity (field-weighted Dice), confidence (calibrated share of pairs of
    such Dice scores that the exact look accepts), and the levels of agreement that the exact look
    found. Pairs of a lower similarity or confidence aren't taken. Records with equal normal forms are
    compared once and expanded at the end. A record without a title finds no partner.
    """
    spark = left.sparkSession
    needed = ["key", "title", "author", "year", "place"]
    both = left.select(*needed, F.lit(0).alias("side")).unionByName(right.select(*needed, F.lit(1).alias("side")))
    common = common_words(both, both.count(), common_share)
    coded = materialize(encode(both.where("title is not null and trim(title) <> ''"), common), "codes", tidy=True)
    forms = materialize(coded.dropDuplicates(["side", "form"]).drop("key"), "forms", tidy=True)
    a, b = forms.where("side = 0"), forms.where("side = 1")
    bins = list(DICES)
    near_ = possible_pairs(a, b, least_similarity, RADIUS)
    patterns = sorted(tuple(r) for r in near_.groupBy(*bins).agg(F.sum("similarity") / F.sum("n"), F.sum("n")).collect())  # the bins bound their number
    odds = weights_of(patterns)
    numbered = {p[: len(bins)]: i for i, p in enumerate(patterns)}
    listed = spark.createDataFrame([(*k, i) for k, i in numbered.items()] or [(*[0] * len(bins), 0)], ", ".join(f"{x} int" for x in bins) + ", pattern int")
    found = near_.where("form_a is not null").join(F.broadcast(listed), bins).select("form_a", "form_b", "similarity", "pattern")
    fields = ["words", "short", "cut", "volume", "surname", "year", "place", "place_short"]
    side = lambda df, x: df.select(F.col("form").alias(f"form_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in fields])
    full = found.join(side(a, "a"), "form_a").join(side(b, "b"), "form_b")
    levels = materialize(agreement(full, common).withColumn("plausible", F.when(F.col("l_title") > 0, same_printing()).otherwise(0)).where("plausible > 0"), "levels", tidy=True)
    hits = {r["pattern"]: r["hits"] for r in levels.groupBy("pattern").agg(F.count(F.lit(1)).alias("hits")).collect()}
    belief = calibrated([(odds[p[: len(bins)]], p[-1], hits.get(i, 0)) for i, p in enumerate(patterns)])
    sure = spark.createDataFrame(list(enumerate(belief)) or [(0, 0.0)], "pattern int, confidence double")
    judged = levels.join(F.broadcast(sure), "pattern").where(F.col("confidence") >= least_confidence).drop("pattern")
    # a record without year and place stands for one printing only if its partners are of one year
    years_a = b.select(F.col("form").alias("form_b"), F.col("year").alias("year_b"))
    years_b = a.select(F.col("form").alias("form_a"), F.col("year").alias("year_a"))
    named = judged.join(years_a, "form_b").join(years_b, "form_a")
    spread = lambda k, y: named.groupBy(k).agg(F.countDistinct(F.when(F.col(y) > 0, F.col(y))).alias(f"n_{y}"))
    vague = judged.where("plausible = 1").join(spread("form_a", "year_b"), "form_a").join(spread("form_b", "year_a"), "form_b").where("n_year_b <= 1 and n_year_a <= 1").drop("n_year_a", "n_year_b")
    kept = judged.where("plausible = 2").unionByName(vague)
    keys = lambda s, x: coded.where(F.col("side") == s).select(F.col("key").alias(f"key_{x}"), F.col("form").alias(f"form_{x}"))
    return kept.join(keys(0, "a"), "form_a").join(keys(1, "b"), "form_b").select("key_a", "key_b", "similarity", F.round("confidence", 4).alias("confidence"), *LEVELS).distinct()
