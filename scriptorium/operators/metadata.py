"""The most like records of two tables by title and author, without judging every pair of them."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.functions import text

#: Rows of either side that meet in one task.
LEFT_ROWS, RIGHT_ROWS = 4_096, 65_536
#: Candidates of a row that are judged before its least confidence is raised again.
STEP = 8
#: Rows whose bound is worked out at a time, at least.
FIRST = 200
#: Above any error of the sums of floats.
TINY = 1e-6


def numbered(words: Iterable[str]) -> list[tuple[str, int]]:
    """Repeated words numbered, so that sets of them meet as the lists do."""
    seen: Counter = Counter()
    out = []
    for w in words:
        seen[w] += 1
        out.append((w, seen[w]))
    return out


class Index:
    """The entries of rows as numbers, row after row; counts how many of some entries the rows hold."""

    def __init__(self, rows: list[list]) -> None:
        self.ids: dict = {}
        self.flat = np.array([self.ids.setdefault(e, len(self.ids)) for r in rows for e in r], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum([len(r) for r in rows], dtype=np.int64)])
        self.asked = np.zeros(len(self.ids), dtype=bool)

    def counts(self, entries: list, at: np.ndarray) -> np.ndarray:
        """How many of the entries each of the rows `at` holds."""
        known = [self.ids[e] for e in entries if e in self.ids]
        size = self.start[at + 1] - self.start[at]
        ends = np.cumsum(size)
        places = np.arange(size.sum()) + np.repeat(self.start[at] - ends + size, size)
        self.asked[known] = True
        sums = np.concatenate([[0], np.cumsum(self.asked[self.flat[places]])])
        self.asked[known] = False
        return sums[ends] - sums[ends - size]

    def inverted(self) -> Index:
        """Adds the rows of each entry, for counts over all rows."""
        rows = np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))
        order = np.argsort(self.flat, kind="stable")
        self.rows, self.first = rows[order], np.searchsorted(self.flat[order], np.arange(len(self.ids) + 1))
        return self

    def all_counts(self, entries: list) -> np.ndarray:
        found = [self.rows[self.first[i] : self.first[i + 1]] for i in (self.ids[e] for e in entries if e in self.ids)]
        return np.bincount(np.concatenate(found) if found else [], minlength=len(self.start) - 1)


class Side:
    """Words of titles and of authors, and indexes over the words and their stems."""

    def __init__(self, titles: Iterable[str | None], authors: Iterable[str | None]) -> None:
        self.title, self.author = [text.matched_words(t) for t in titles], [text.matched_words(a) for a in authors]
        self.whole = [t + a for t, a in zip(self.title, self.author)]
        self.sizes = {f: np.array([len(r) for r in getattr(self, f)], dtype=np.int64) for f in ("title", "author", "whole")}

    def index(self) -> Side:
        self.stems = {f: Index([numbered(w[:4] for w in r) for r in getattr(self, f)]) for f in self.sizes}
        self.words = {f: Index([numbered(r) for r in getattr(self, f)]) for f in self.sizes}
        self.long = Index([list(long_words(r)) for r in self.title])
        self.stems["whole"].inverted()
        return self

    def at_most(self, field: str, words: list[str], at: np.ndarray) -> np.ndarray:
        """For each row `at` no less than words_overlap of the words with the row's field: matched words
        share a numbered stem and count 0.8, and 1 only if the words are the same."""
        weight = 0.8 * self.stems[field].counts(numbered(w[:4] for w in words), at) + 0.2 * self.words[field].counts(numbered(words), at)
        return np.floor(weight / np.maximum(np.maximum(self.sizes[field][at], len(words)), 1) * 100 + 0.5 + TINY)

    def bound(self, title: list[str], author: list[str], at: np.ndarray) -> np.ndarray:
        """For each row `at` no less than words_confidence of title and author with it."""
        shared = self.long.counts(list(long_words(title)), at)
        bonus = np.where(shared >= 3, 15, np.where(shared == 2, 8, 0))
        whole = title + author
        parts = (
            0.7 * self.at_most("title", title, at) + 0.3 * self.at_most("author", author, at) + bonus,
            0.9 * self.at_most("whole", title, at),
            0.9 * self.at_most("title", whole, at),
            self.at_most("whole", whole, at) + bonus,
        )
        return np.floor(np.max(parts, axis=0) + 0.5 + TINY).astype(np.int64)


def long_words(words: list[str]) -> set[str]:
    return {w for w in words if len(w) > 3}


def first_bound(n_title: int, n_author: int, shared: int) -> int:
    """No less than words_confidence of a row with so many words in title and author and any row with
    which it shares so many numbered stems, in title and author together."""
    part = lambda n, of: math.floor(min(n, of) / of * 100 + 0.5 + TINY) if of else 0
    split = max(0.7 * part(shared - a, n_title) + 0.3 * part(a, n_author) for a in range(min(shared, n_author) + 1))
    return math.floor(max(split + 15, 0.9 * part(shared, n_title), part(shared, n_title + n_author) + 15) + 0.5 + TINY)


def best_of(title: list[str], author: list[str], right: Side, keys: np.ndarray, more_than: int, k: int) -> list[tuple[int, int]]:
    """The k best rows of the right side, (confidence, place), ties by key. Rows with most shared stems come
    first, FIRST at least at a time; among these, rows are judged from the highest bound on. No row is left out
    whose bound reaches the k-th best confidence and is over more_than."""
    shared = right.stems["whole"].all_counts(numbered(w[:4] for w in title + author))
    left = np.bincount(shared)  # rows by number of shared stems
    bounds = [first_bound(len(title), len(author), n) for n in range(len(left))]
    best: list[tuple[int, int, int]] = []
    need = lambda: max(more_than + 1, -best[-1][0] if len(best) == k else 0)
    top = len(left) - 1
    while top >= 0 and bounds[top] >= need():
        low, n = top, left[top]
        while low and n < FIRST and bounds[low - 1] >= need():
            low -= 1
            n += left[low]
        at = np.flatnonzero((shared >= low) & (shared <= top))
        bound = right.bound(title, author, at)
        order = np.lexsort((keys[at], -bound))
        at, bound = at[order], bound[order]
        for start in range(0, len(at), STEP):
            if bound[start] < need():
                break
            judged = ((text.words_confidence(title, author, right.title[j], right.author[j]), j) for j in at[start : start + STEP].tolist())
            best = sorted(best + [(-c, int(keys[j]), j) for c, j in judged if c > more_than])[:k]
        top = low - 1
    return [(-c, j) for c, _, j in best]


def best_matches(left: DataFrame, right: DataFrame, more_than: int = 40, k: int = 5) -> DataFrame:
    """(left_key, right_key, confidence, rank): for each row of left the k rows of right with the highest
    text.match_confidence over `more_than`, ties by right_key.

    left: (left_key, title, author), right: (right_key bigint, title, author); keys are unique. Each part of the left side
    meets each part of the right side in a task of its own, of bounded size; there an index of words gives
    a bound of the confidence for all pairs at once, and only pairs whose bound reaches the k-th best
    are judged. No pair that could be among the best is left out.
    """
    parts = [max(1, math.ceil(df.count() / n)) for df, n in ((left, LEFT_ROWS), (right, RIGHT_ROWS))]
    key = left.schema["left_key"].dataType.simpleString()

    def cells(df: DataFrame, by: str, own: int) -> DataFrame:
        n, others = parts[own], F.sequence(F.lit(0), F.lit(parts[1 - own] - 1))
        mine = F.pmod(F.xxhash64(by), F.lit(n)).cast("int")
        cell = (mine * parts[1] + F.col("__o")) if own == 0 else (F.col("__o") * parts[1] + mine)
        return df.withColumn("__o", F.explode(others)).select(cell.alias("cell"), by, "title", "author")

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(a) and len(b):
            mine, other, keys = Side(a["title"], a["author"]), Side(b["title"], b["author"]).index(), b["right_key"].to_numpy()
            for i, name in enumerate(a["left_key"]):
                rows += [(name, keys[j], c) for c, j in best_of(mine.title[i], mine.author[i], other, keys, more_than, k)]
        return pd.DataFrame(rows, columns=["left_key", "right_key", "confidence"])

    # the data of a part are few for the work they make, so parts aren't put together by their size
    n = min(2 * parts[0] * parts[1], 20_000)
    a, b = cells(left, "left_key", 0).repartition(n, "cell"), cells(right, "right_key", 1).repartition(n, "cell")
    pairs = a.groupBy("cell").cogroup(b.groupBy("cell")).applyInPandas(run, f"left_key {key}, right_key bigint, confidence int")
    w = W.partitionBy("left_key").orderBy(F.desc("confidence"), "right_key")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
