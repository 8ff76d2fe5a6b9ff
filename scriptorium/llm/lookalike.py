"""Problem 9: one form for texts that look alike but differ in their characters.

Look-alike classes are the transitive closure, by union-find, over code points and short strings
(ligatures, full-width forms, look-alike letters). The representative of a class is its most
frequent member in the corpus; texts are rewritten by a multi-pattern automaton, longest match
first. Full-width, narrow and no-break forms, ligatures and combining accents come from the Unicode
tables, for all scripts; look-alike letters are those of the stated Latin, Greek and Cyrillic pairs.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.session import materialize

# Letters of other scripts that are drawn like a Latin letter, "Latin: look-alikes".
LETTERS = """
A: Α А
B: Β В
C: С Ϲ
E: Ε Е
H: Η Н
I: Ι І Ӏ
J: Ј
K: Κ К
M: Μ М
N: Ν
O: Ο О
P: Ρ Р
S: Ѕ
T: Τ Т
V: Ѵ
X: Χ Х
Y: Υ Ү
Z: Ζ
Q: Ԛ
W: Ԝ
a: а ɑ
c: с ϲ
d: ԁ
e: е
g: ɡ
h: һ
i: і
j: ј ϳ
l: ӏ
o: о ο
p: р
q: ԛ
s: ѕ
v: ν ѵ
w: ԝ
x: х
y: у
-: ‐ ‑
"""
#: Compatibility decompositions that leave the look of a character as it is.
SAME_LOOK = {"<wide>", "<narrow>", "<noBreak>"}
LIGATURES = range(0xFB00, 0xFB05)


class Classes:
    """Union-find over code points and strings."""

    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def union(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def groups(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for x in list(self.up):
            out.setdefault(self.find(x), []).append(x)
        return out


def code_point_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(cp, n): in how many texts each code point outside plain ASCII letters' range occurs, and each
    ASCII one. At most as many rows as Unicode has code points, whatever the corpus."""
    chars = F.array_distinct(F.split(F.col(text), ""))
    return docs.select(F.explode(chars).alias("ch")).where("ch <> ''").groupBy("ch").agg(F.count(F.lit(1)).alias("n"))


def look_alike_rules(counts: dict[str, int]) -> tuple[dict[str, str], list[tuple[str, str, int]]]:
    """Rewriting rules, member -> representative, and all classes as (member, representative, n)."""
    classes = Classes()
    for line in LETTERS.strip().splitlines():
        head, _, rest = line.partition(": ")
        for other in rest.split():
            classes.union(head, other)
    for ch in counts:
        for part in unicodedata.normalize("NFD", ch):
            cp = ord(part)
            kind, _, to = unicodedata.decomposition(part).partition(" ")
            if kind in SAME_LOOK or cp in LIGATURES:
                classes.union(part, "".join(chr(int(x, 16)) for x in to.split()))
            elif unicodedata.category(part) == "Zs" and part != " ":
                classes.union(part, " ")
    seen = dict(counts)
    for ch, n in counts.items():  # decomposed letters count for their base letter
        base = unicodedata.normalize("NFD", ch)[0]
        if base != ch:
            seen[base] = seen.get(base, 0) + n
    rules, rows = {}, []
    for members in classes.groups().values():
        weight = lambda m: (-min(seen.get(c, 0) for c in m), len(m), m)
        best = min(members, key=weight)
        if best.isspace():
            best = " "
        for m in sorted(members):
            rows.append((m, best, min(seen.get(c, 0) for c in m)))
            if m != best:
                rules[m] = best
    return rules, rows


class Rewriter:
    """Puts texts into the common form with one automaton over all rules."""

    def __init__(self, rules: dict[str, str]) -> None:
        import ahocorasick
        import regex

        self.auto = ahocorasick.Automaton()
        for member, to in rules.items():
            self.auto.add_word(member, (len(member), to))
        self.auto.make_automaton()
        self.plain = all(not m.isascii() for m in rules)  # then an ASCII text stays as it is
        self.hidden = regex.compile(r"[\p{Cf}͏᠎︀-️]+")
        self.words = regex.compile(r"[\p{L}\p{M}]+")
        self.foreign = regex.compile(r"[\p{Greek}\p{Cyrillic}]")
        kinds = {s: regex.compile(rf"\p{{{s}}}") for s in ("Latin", "Greek", "Cyrillic")}
        self.script_of = lambda c: next((s for s, p in kinds.items() if p.match(c)), "")
        classes: dict[str, list[str]] = {}
        for member, to in sorted(rules.items()):
            classes.setdefault(to, [to]).append(member)
        self.shared = {m for ms in classes.values() for m in ms}
        self.into: dict[str, dict[int, str]] = {s: {} for s in kinds}
        for to, members in classes.items():
            for m in members:
                script = self.script_of(m)
                if len(to) == len(m) == 1 and script and unicodedata.decomposition(m)[:1] != "<":
                    self.into[script].setdefault(ord(to), m)

    def common(self, text: str | None) -> str | None:
        """The form in which texts that look the same are the same string."""
        if text is None or (self.plain and text.isascii()):
            return text
        t = self.hidden.sub("", unicodedata.normalize("NFD", text))
        out, at = [], 0
        for end, (size, to) in self.auto.iter_long(t):
            begin = end - size + 1
            out += (t[at:begin], to)
            at = end + 1
        out.append(t[at:])
        return unicodedata.normalize("NFC", "".join(out))

    def one_script(self, word: str) -> str:
        """A word in the script of its letters that have no look-alike, else in that of most of its
        letters; as it is if several scripts have such letters."""
        if not self.foreign.search(word):
            return word
        t = unicodedata.normalize("NFD", word)
        scripts = [(self.script_of(c), c in self.shared) for c in t if c.isalpha()]
        only = {s for s, shared in scripts if not shared and s}
        if len(only) > 1:
            return word
        votes = [s for s, _ in scripts if s]
        target = only.pop() if only else max(("Latin", "Greek", "Cyrillic"), key=votes.count)
        return unicodedata.normalize("NFC", t.translate(self.into[target]))

    def readable(self, common: str | None) -> str | None:
        """The common form with each word in one script. Depends on the common form only, so
        equal-looking texts stay equal."""
        if common is None or common.isascii() or not self.foreign.search(common):
            return common
        return self.words.sub(lambda m: self.one_script(m[0]), common)


def canonical_texts(docs: DataFrame, unique_id: str = "doc_id", text: str = "text", rules: dict[str, str] | None = None, keep_text: bool = True) -> DataFrame:
    """Each document with its text in the common form.

    Result: unique_id, look (128-bit hash of the common form), exact (of the text as stored), and if
    keep_text canonical_text and changed. A null text gives nulls and changed = false; an empty text
    stays empty. Whole texts are read; other columns of docs play no part. rules: from
    look_alike_rules over the same corpus if not given.
    """
    if rules is None:
        counts = {r["ch"]: r["n"] for r in code_point_counts(docs, text).collect()}  # at most one row per Unicode code point
        rules, _ = look_alike_rules(counts)
    kind = docs.schema[unique_id].dataType.simpleString()
    schema = f"`{unique_id}` {kind}, look string, exact string{', canonical_text string, changed boolean' if keep_text else ''}"

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        rewriter = Rewriter(rules)
        digest = lambda s: None if s is None else xxhash.xxh3_128_hexdigest(s.encode("utf-8", "surrogatepass"))
        for batch in batches:
            texts = batch["__text"].tolist()
            common = [rewriter.common(t) for t in texts]
            out = {unique_id: batch["__id"]}
            out["look"] = [digest(c) for c in common]
            out["exact"] = [digest(t) for t in texts]
            if keep_text:
                out["canonical_text"] = [rewriter.readable(c) for c in common]
                out["changed"] = [c != t for c, t in zip(out["canonical_text"], texts)]
            yield pd.DataFrame(out)

    return docs.select(F.col(unique_id).alias("__id"), F.col(text).alias("__text")).mapInPandas(rewrite, schema)


def look_alike_classes(docs: DataFrame, unique_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(look, n_docs, n_texts, first_id): each class of documents that look the same though their texts
    aren't all the same string: how many documents and different strings it holds, and its least id. One
    row per class, however large, so that a class of copies needn't be expanded into pairs."""
    keyed = canonical_texts(docs, unique_id, text, keep_text=False).where("look is not null").groupBy("look", "exact").agg(F.count_distinct(unique_id).alias("n"), F.min(unique_id).alias("first"))
    return keyed.groupBy("look").agg(F.sum("n").alias("n_docs"), F.count(F.lit(1)).alias("n_texts"), F.min("first").alias("first_id")).where("n_texts > 1")


def look_alike_pairs(docs: DataFrame, unique_id: str = "doc_id", text: str = "text", per_slice: int = 5_000) -> DataFrame:
    """Pairs (a < b) of documents whose texts look the same without being the same string.

    Only classes with two or more different strings take part. A class may hold a third of all
    rows: its first side is cut into slices of about per_slice rows, each of which meets the whole
    second side, so no task holds the pairs of a large class. Copies of one string form no pair;
    a document id given twice counts once; null texts have no pair.
    """
    keyed = materialize(canonical_texts(docs, unique_id, text, keep_text=False).where("look is not null").select(unique_id, "look", "exact").distinct(), "looks")
    mixed = (
        keyed.groupBy("look")
        .agg(F.min("exact").alias("lo"), F.max("exact").alias("hi"), F.count(F.lit(1)).alias("n"))
        .where("lo <> hi")
        .select("look", F.ceil(F.col("n") / per_slice).cast("int").alias("slices"))
    )
    own = keyed.join(mixed, "look")
    a = own.select(F.col(unique_id).alias(f"{unique_id}_a"), "look", F.col("exact").alias("exact_a"), F.pmod(F.hash(unique_id), F.col("slices")).alias("slice"))
    b = own.select(F.col(unique_id).alias(f"{unique_id}_b"), "look", F.col("exact").alias("exact_b"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    found = a.join(b, ["look", "slice"]).where((F.col("exact_a") != F.col("exact_b")) & (F.col(f"{unique_id}_a") < F.col(f"{unique_id}_b")))
    return found.select(f"{unique_id}_a", f"{unique_id}_b")
