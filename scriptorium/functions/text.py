"""Text functions, as column expressions where Spark has the parts."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions.vectorized import vectorized

# Words left out of the keywords of a question about a book.
STOP_WORDS = set(
    """a an the is are was were be been being have has had do does did will would could should may might must shall can need
    dare ought used to of in for on with at by from as into through during before after above below between and but or nor
    so yet both either neither not only own same than too very just what which who whom this that these those i me my we
    our you your he him his she her it its they them their about tell says said does mean book text author page pages read
    write wrote written""".split()
)
# Words left out of the search terms of a question about a page.
QUESTION_WORDS = set(
    """what is the a an of in to and or how why does do this that these those it its about from with for on at by as be are
    was were been have has had can could would should will may might mean means meaning think you your here there""".split()
)


@vectorized("string")
def normalize_text(s: pd.Series) -> pd.Series:
    """Lower case, without combining accents, trimmed. Null stays null."""
    import unicodedata

    marks = re.compile("[̀-ͯ]")
    return s.map(lambda t: marks.sub("", unicodedata.normalize("NFD", t)).lower().strip(), na_action="ignore")


def snippet(text: Column, query: str, around: int = 150) -> Column:
    """The first case-insensitive hit with so much text on both sides, with "..." where text is left
    out; without a hit the first 300 characters. Null gives ''."""
    t = F.coalesce(text, F.lit(""))
    at = F.locate(query.lower(), F.lower(t))
    start = F.greatest(at - 1 - around, F.lit(0))
    end = F.least(at - 1 + len(query) + around, F.length(t))
    hit = F.concat(F.when(start > 0, "...").otherwise(""), F.substring(t, start + 1, end - start), F.when(end < F.length(t), "...").otherwise(""))
    none = F.concat(F.substring(t, 1, 300), F.when(F.length(t) > 300, "...").otherwise(""))
    return F.when(at > 0, hit).otherwise(none)


def highlighted_snippets(query: str, around: int = 80, most: int = 3):
    """A function of a text column: up to `most` places of the query's words, at least 2 x around apart,
    as (snippet, position) with the words marked. Null and empty texts give none."""
    words = [w for w in query.lower().split() if w]

    @F.pandas_udf("array<struct<snippet:string,position:int>>")
    def find(texts: pd.Series) -> pd.Series:
        mark = re.compile("|".join(re.escape(w) for w in sorted(set(words), key=lambda w: (-len(w), w))), re.I) if words else None
        out = []
        for t in texts:
            low, kept = (t or "").lower(), []
            places = sorted({m.start() for w in words for m in re.finditer(f"(?={re.escape(w)})", low)})
            for p in places:
                if len(kept) == most:
                    break
                if all(abs(p - k) >= 2 * around for k in kept):
                    kept.append(p)
            rows = []
            for p in kept:
                a, b = max(0, p - around), min(len(t), p + around + len(query))
                body = mark.sub(lambda m: f"<mark>{m[0]}</mark>", t[a:b])
                rows.append({"snippet": ("..." if a else "") + body + ("..." if b < len(t) else ""), "position": p})
            out.append(rows)
        return pd.Series(out)

    return find


def query_keywords(query: str) -> list[str]:
    """The words of a question that say what it is about: longer than two letters, no stop words."""
    return [w for w in re.sub(r"[^\w\s]", " ", query.lower()).split() if len(w) > 2 and w not in STOP_WORDS]


def search_terms(question: str, most: int = 3) -> list[str]:
    """The longest different terms of a question."""
    words = re.sub(r"[?.,!'\"]", "", question.lower()).split()
    return sorted(dict.fromkeys(w for w in words if len(w) > 2 and w not in QUESTION_WORDS), key=lambda w: -len(w))[:most]


def keyword_score(text: Column, words: list[str]) -> Column:
    """How often the words occur in the text, together; 0 for null."""
    out = F.lit(0)
    for w in words:
        out = out + F.coalesce(F.regexp_count(text, F.lit("(?i)" + re.escape(w))), F.lit(0))
    return out


def significant_words(text: Column, longer_than: int = 2) -> Column:
    """Distinct lower-case words without punctuation, longer than so many letters; [] for null."""
    clean = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\w\s]", "")
    return F.array_distinct(F.filter(F.split(F.trim(clean), r"\s+"), lambda w: F.length(w) > longer_than))


def stems(text: Column) -> Column:
    """The first four letters of each word of over two letters, the same ones numbered (merc 1, merc 2), so
    that words that stem_match takes for one another share an entry; [] for null."""
    clean = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\w\s]", "")
    words = F.array_sort(F.transform(F.filter(F.split(F.trim(clean), r"\s+"), lambda w: F.length(w) > 2), lambda w: F.substring(w, 1, 4)))
    return F.transform(words, lambda w, i: F.concat(w, F.lit(" "), (i - F.array_position(words, w) + 2).cast("string")))


def word_jaccard(a: Column, b: Column) -> Column:
    """Shared words against all words in percent, halves up; 0 if either side has none."""
    x, y = significant_words(a), significant_words(b)
    shared, every = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0).otherwise(F.floor(F.coalesce(F.try_divide(shared * 100, every), F.lit(0.0)) + 0.5)).cast("int")


def stem_match(a: str, b: str) -> float:
    """1 for the same word, 0.8 for the same beginning (up to five letters, at least four), else 0."""
    n = min(5, min(len(a), len(b)) - 1)
    return 1.0 if a == b else 0.8 if n >= 4 and a[:n] == b[:n] else 0.0


def matched_words(text: str | None) -> list[str]:
    """Lower-case words of over two letters, without punctuation and letters outside ASCII, as word_overlap
    compares them. Those of two texts together are the words of the first and then those of the second."""
    return [w for w in re.sub(r"[^\w\s]", "", (text or "").lower(), flags=re.A).split() if len(w) > 2]


def words_overlap(left: list[str], right: list[str]) -> int:
    """word_overlap of two lists of words."""
    if not left or not right:
        return 0
    free, total = list(range(len(right))), 0.0
    for w in left:
        for i in free:
            got = stem_match(w, right[i])
            if got:
                total += got
                free.remove(i)
                break
    return int(total / max(len(left), len(right)) * 100 + 0.5)


def word_overlap(a: str | None, b: str | None) -> int:
    """Matched words against the longer side's number of words, in percent. Each word of b is used once,
    by the first word of a that fits."""
    return words_overlap(matched_words(a), matched_words(b))


def words_confidence(ta: list[str], aa: list[str], tb: list[str], ab: list[str]) -> int:
    """match_confidence of one pair, given the words of its titles and authors."""
    shared = len({w for w in ta if len(w) > 3} & {w for w in tb if len(w) > 3})
    bonus = 15 if shared >= 3 else 8 if shared == 2 else 0
    best = max(
        0.7 * words_overlap(ta, tb) + 0.3 * words_overlap(aa, ab) + bonus,
        0.9 * words_overlap(ta, tb + ab),
        0.9 * words_overlap(ta + aa, tb),
        words_overlap(ta + aa, tb + ab) + bonus,
    )
    return int(best + 0.5)


@vectorized("int")
def match_confidence(title_a: pd.Series, author_a: pd.Series, title_b: pd.Series, author_b: pd.Series) -> pd.Series:
    """The best of several comparisons of title and author, with a bonus for shared title words: 0 to
    about 115."""
    return pd.Series([words_confidence(*map(matched_words, r)) for r in zip(title_a, author_a, title_b, author_b)], dtype="int32")


def plausible_year(text: Column) -> Column:
    """A year from 1400 to 2029 standing by itself; null if none."""
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), r"\b(1[4-9]\d{2}|20[0-2]\d)\b", 1), F.lit(""))


def domain_of(url: Column) -> Column:
    """Host of a link without "www."; "direct" for null and empty, the third part between slashes for what
    isn't a link."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)
    third = F.get(F.split(url, "/"), F.lit(2))
    return F.when(F.coalesce(url, F.lit("")) == "", "direct").when(host != "", F.regexp_replace(host, r"^www\.", "")).otherwise(F.coalesce(third, F.lit("")))


def first_ip(forwarded: Column) -> Column:
    """The first address of a forwarding header, "unknown" for null and empty."""
    return F.coalesce(F.nullif(F.trim(F.get(F.split(forwarded, ","), F.lit(0))), F.lit("")), F.lit("unknown"))


def shortened(text: Column, n: int, ellipsis: str = "...") -> Column:
    """The first n characters, with an ellipsis if more was there."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(ellipsis))).otherwise(text)


def slug_label(slug: Column) -> Column:
    """alchemy-in-prague as Alchemy in prague."""
    return F.concat(F.upper(F.substring(slug, 1, 1)), F.replace(F.substring(slug, 2, 1000), F.lit("-"), F.lit(" ")))


def sentences(text: Column) -> Column:
    """Array of the pieces between sentence ends and white space; [''] for ''."""
    return F.split(text, r"(?<=[.!?])\s+")


def replace_opening(text: Column, n: int, new: Column) -> Column:
    """The text with its first n sentences replaced."""
    s = sentences(text)
    return F.concat_ws(" ", new, F.array_join(F.slice(s, n + 1, F.greatest(F.size(s) - n, F.lit(0))), " "))


@vectorized("string")
def string_hash(s: pd.Series) -> pd.Series:
    """Signed 32-bit polynomial hash (h * 31 + code unit) in hex, with a minus sign where negative."""

    def one(t: str) -> str:
        h = 0
        units = t.encode("utf-16-le")
        for i in range(0, len(units), 2):
            h = (h * 31 + units[i] + 256 * units[i + 1]) & 0xFFFFFFFF
        h = h - (1 << 32) if h >> 31 else h
        return f"{h:x}"

    return s.map(one, na_action="ignore")


def language_label(c: Column, known: dict[str, str]) -> Column:
    """A language name in its usual form: by a map of lower-case variants, else with a capital; Unknown
    for null and empty."""
    pairs = [F.lit(x) for kv in known.items() for x in kv]
    t = F.trim(c)
    mapped = F.create_map(*pairs)[F.lower(t)]
    return F.when(F.coalesce(c, F.lit("")) == "", "Unknown").otherwise(F.coalesce(mapped, F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 1000))))


# Languages written from right to left, by their codes.
RIGHT_TO_LEFT = {"arabic": "ar", "hebrew": "he", "aramaic": "arc", "syriac": "syr", "persian": "fa", "farsi": "fa", "urdu": "ur"}


def script_code(language: Column) -> Column:
    """The code of the right-to-left language that a name holds; null for others and for null."""
    names = "|".join(RIGHT_TO_LEFT)
    codes = F.create_map(*[F.lit(x) for kv in RIGHT_TO_LEFT.items() for x in kv])
    return F.try_element_at(codes, F.regexp_extract(F.lower(F.coalesce(language, F.lit(""))), f"({names})", 1))


def right_to_left(language: Column) -> Column:
    """Whether a language name holds that of one written from right to left; false for null."""
    return script_code(language).isNotNull()


def escape_xml(text: Column) -> Column:
    """The text with the five marks of XML as entities."""
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(mark), F.lit(entity))
    return text


# Lower-case language names and what they are counted as.
LANGUAGE_NAMES = {
    "latin": "Latin", "german": "German", "deutsch": "German", "french": "French", "français": "French", "francais": "French",
    "italian": "Italian", "italiano": "Italian", "english": "English", "dutch": "Dutch", "nederlands": "Dutch", "spanish": "Spanish",
    "español": "Spanish", "espanol": "Spanish", "greek": "Greek", "hebrew": "Hebrew", "arabic": "Arabic", "portuguese": "Portuguese",
    "português": "Portuguese", "portugues": "Portuguese",
}
