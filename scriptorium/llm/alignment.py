"""Problem 6: which sentences of two texts translate one another.

A word lexicon is learned from the pages themselves: first from sentences at like places, then from
the links found with it. A sentence becomes a vector over the words of the other language; entropic
optimal transport between the sentence vectors of a page, with null masses on both sides for
omissions, is solved by Sinkhorn scaling; where much of a sentence's mass goes is a link. One
sentence linked with several is a merge or a split.

Pages are worked on in parts of bounded size. The lexicon is a table: each part gets the entries of
its own words by a join, so no task and no driver ever holds the whole of it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.session import materialize, small

WORD = re.compile(r"[^\W\d_]{2,}")
SENTENCE = re.compile(r"(?<=[.!?])\s+")
BROKEN = re.compile(r"(\w)[-=⸗¬‐­] *\n+(?=[a-zß-ÿ])")
MARKUP = re.compile(r"<([A-Za-z][\w-]*)>[^<]*</\1>|<[^>\n]*>|\[\[\w+:|\]\]")


def code(word: str) -> int:
    """A word as a 31-bit number."""
    import xxhash

    return xxhash.xxh32_intdigest(word) & 0x7FFFFFFF


class Coder:
    """Codes of words, kept while the process lives (up to a bound)."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, word: str) -> int:
        c = self.known.get(word)
        if c is None:
            if len(self.known) > 500_000:
                self.known.clear()
            c = self.known[word] = code(word)
        return c


def sentence_codes(text: str, coder: Coder) -> list[list[int]]:
    """The different word codes of each sentence, in order; sentences without words have none."""
    if "\n" in text:
        text = BROKEN.sub(lambda m: m[1] + "\x00", text)  # the number of sentences stays as it is
    out = []
    for s in SENTENCE.split(text):
        s = s.replace("\x00", "")
        if "<" in s or "[[" in s:
            s = MARKUP.sub(" ", s)
        out.append([coder(w) for w in set(WORD.findall(s.lower()))])
    return out


def encoded(pages: DataFrame) -> DataFrame:
    """(page_id, src, n_src, trg, n_trg) of pages with both texts: the word codes of all sentences one
    after the other, and how many each sentence has."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = Coder()
        for batch in batches:
            out = {"page_id": batch["page_id"]}
            for c in ("src", "trg"):
                sentences = [sentence_codes(t, coder) for t in batch[c]]
                out[c] = [[w for s in p for w in s] for p in sentences]
                out[f"n_{c}"] = [[len(s) for s in p] for p in sentences]
            yield pd.DataFrame(out)

    return page_pairs(pages).mapInPandas(run, "page_id string, src array<int>, n_src array<int>, trg array<int>, n_trg array<int>")


def page_pairs(pages: DataFrame) -> DataFrame:
    """(page_id, src, trg) of pages with both texts."""
    return pages.where("src <> '' and trg <> ''").select("page_id", "src", "trg")


def near_prior(n: int, m: int, width: float = 0.09, top: float = 0.3) -> np.ndarray:
    """Weights of sentence pairs by how alike their relative places are. Each row sums to 1, but on long
    pages, where its largest weight would fall under `top`, it is scaled up to that, so that their words
    are learned too; the row then sums to more, and so does what chance gives."""
    x, y = (np.arange(n) + 0.5) / n, (np.arange(m) + 0.5) / m
    w = np.exp(-((x[:, None] - y[None, :]) ** 2) / (2 * width**2))
    w[w < 0.05] = 0
    w /= np.maximum(w.sum(axis=1, keepdims=True), 1e-9)
    best = w.max(axis=1, keepdims=True)
    return np.where(best > 0, w * np.maximum(1.0, top / np.maximum(best, 1e-9)), 0.0)


#: Weights are counted as whole numbers of so small a part, so that sums don't depend on their order.
#: The least weight of the prior is three of them.
STEPS = 200
#: Most word pairs held before they are summed, most cells of a page's word matrix at once, and most
#: cells of a table of sums; where more are needed, sums are made by sorting.
HELD, CELLS, TABLE = 3_000_000, 1_000_000, 8_000_000
#: Words of a part (about 2,000 pages), and of the pages of a part that are worked on at once; most tasks that
#: parts are spread over, so that beyond it a task works on several parts, one after the other.
PART_WORDS, CHUNK_WORDS, TASKS = 500_000, 40_000, 20_000


class Pages:
    """Some pages, their sentences one after the other: of each word its code and sentence, of each
    sentence its page."""

    def __init__(self, src: list, n_src: list, trg: list, n_trg: list) -> None:
        self.s, self.t = (np.concatenate([np.asarray(x, np.int64) for x in c]) if len(c) else np.empty(0, np.int64) for c in (src, trg))
        self.n, self.m = (np.array([len(x) for x in c], np.int64) for c in (n_src, n_trg))
        self.n_s, self.n_t = (np.concatenate([np.asarray(x, np.int64) for x in c]) if len(c) else np.empty(0, np.int64) for c in (n_src, n_trg))
        self.s_at, self.t_at = np.repeat(np.arange(len(self.n_s)), self.n_s), np.repeat(np.arange(len(self.n_t)), self.n_t)
        self.first_s, self.first_t = np.cumsum(self.n) - self.n, np.cumsum(self.m) - self.m
        self.page_s, self.page_t = np.repeat(np.arange(len(self.n)), self.n), np.repeat(np.arange(len(self.m)), self.m)
        cells = self.n * self.m
        self.first_cell, self.cells = np.cumsum(cells) - cells, int(cells.sum())

    def __len__(self) -> int:
        return len(self.n)

    def blocks(self, flat: np.ndarray) -> list[np.ndarray]:
        """One matrix of source by target sentences for each page, from all their cells."""
        return [flat[a : a + n * m].reshape(n, m) for a, n, m in zip(self.first_cell, self.n, self.m)]


def spans(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of runs that begin at `first` and hold `count`, and which run each is of."""
    of = np.repeat(np.arange(len(count)), count)
    return np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + first[of], of


class Lexicon:
    """The part of the lexicon that some pages need: association weights of word pairs, the best worth
    that each source word can have, and how much each word of the second language tells."""

    def __init__(self, kinds: np.ndarray, s: np.ndarray, t: np.ndarray, w: np.ndarray) -> None:
        """kind 0: weight of the pair (s, t); 1: best of s; 2: worth of t."""
        e = kinds == 0
        order = np.lexsort((t[e], s[e]))
        self.s, self.t, self.w = s[e][order], t[e][order], w[e][order]
        self.same = np.unique(self.s[self.s == self.t])
        self.best, self.best_of = self.by_code(s[kinds == 1], w[kinds == 1])
        self.told, self.worth_of = self.by_code(t[kinds == 2], w[kinds == 2])

    @staticmethod
    def by_code(codes: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(codes)
        return codes[order], w[order]

    @staticmethod
    def find(codes: np.ndarray, known: np.ndarray, w: np.ndarray, default: float) -> np.ndarray:
        if not len(known):
            return np.full(len(codes), default)
        k = np.minimum(np.searchsorted(known, codes), len(known) - 1)
        return np.where(known[k] == codes, w[k], default)

    def similarity(self, p: Pages) -> np.ndarray:
        """Similarities of all sentence pairs of each page, in the order of Pages.blocks. The vector of a
        source sentence holds, for each word of the page's second text, the weight of its best
        translation; it is held against the words of each target sentence, weighed by their worth. The
        same word on both sides (a name, or a passage that stays in its language) counts as a translation."""
        if not len(p.s) or not len(p.t):
            return np.zeros(p.cells)
        place, at = np.unique(p.page_t[p.t_at] << 31 | p.t, return_inverse=True)  # the words of each page's second text
        g = self.find(place & 0x7FFFFFFF, self.told, self.worth_of, 1.0)
        page = p.page_s[p.s_at] << 31
        begin, end = np.searchsorted(self.s, p.s, "left"), np.searchsorted(self.s, p.s, "right")
        has_pair = np.isin(p.s, self.same)
        alike = np.where(has_pair | (end == begin), 1.0, 0.7)
        entry, word = spans(begin, end - begin)
        key = page[word] | self.t[entry]
        k = np.minimum(np.searchsorted(place, key), len(place) - 1)
        hit = place[k] == key
        entry, word, k = entry[hit], word[hit], k[hit]
        weight = self.w[entry] + np.where(self.t[entry] == p.s[word], 1.0, 0.0)
        own = np.minimum(np.searchsorted(place, page | p.s), len(place) - 1)
        both = place[own] == (page | p.s)
        bare = both & ~has_pair
        sent = np.concatenate([p.s_at[word], p.s_at[bare]])
        into = np.concatenate([k, own[bare]])
        weight = np.concatenate([weight, alike[bare]])
        best = self.find(p.s, self.best, self.best_of, 0.0)
        best[both] = np.maximum(best[both], (alike * g[own])[both])
        expected = np.bincount(p.s_at, best, minlength=len(p.n_s))
        told = np.bincount(p.t_at, g[at], minlength=len(p.n_t))
        over = np.zeros(p.cells)
        if len(sent):
            cell = sent * len(place) + into
            order = np.argsort(cell, kind="stable")
            cell, weight = cell[order], weight[order]
            first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            v = np.minimum(np.maximum.reduceat(weight, first), 1.0)
            sent, into = np.divmod(cell[first], len(place))
            by = np.argsort(at, kind="stable")  # the target words of each place
            n = np.bincount(at, minlength=len(place))
            token, row = spans((np.cumsum(n) - n)[into], n[into])
            j, i = p.t_at[by[token]], sent[row]
            q = p.page_s[i]
            over = np.bincount(p.first_cell[q] + (i - p.first_s[q]) * p.m[q] + j - p.first_t[q], (v * g[into])[row], minlength=p.cells)
        i, j = self.rows_and_columns(p)
        return np.minimum(over / np.sqrt(np.maximum(expected, 0.3)[i] * np.maximum(told, 0.3)[j]), 1.0)

    @staticmethod
    def rows_and_columns(p: Pages) -> tuple[np.ndarray, np.ndarray]:
        """Source and target sentence of each cell."""
        cell, page = spans(np.zeros(len(p), np.int64), p.n * p.m)
        return p.first_s[page] + cell // p.m[page], p.first_t[page] + cell % p.m[page]


SETTINGS = {"null_cost": 0.55, "eps": 0.06, "tolerance": 1e-3}
#: The scaling converges, as all costs are finite; this only guards against a tolerance out of reach of floats.
ENDLESS = 100_000
#: Cells of the pages that are scaled at once, and steps between two looks at who has met the masses.
SCALED, EVERY = 60_000, 8


def transport(sims: list[np.ndarray], a: list[np.ndarray], b: list[np.ndarray], null_cost: float, eps: float, tolerance: float, drift: float = 0.12) -> list[np.ndarray]:
    """Entropic optimal transport of the sentence masses of each page, with a null on either side; Sinkhorn
    scaling until every source sentence's mass is met but for the share `tolerance`. Returns the plans
    without the nulls. A small cost of distance in place breaks ties.

    Pages of like size are scaled together; each stops by its own masses. A page's plan doesn't depend on
    the others but for the last digits.
    """
    out: list[np.ndarray] = [np.empty(0)] * len(sims)
    order = sorted(range(len(sims)), key=lambda i: (sims[i].shape, i))
    at = 0
    while at < len(order):
        n, m, k = 0, 0, 0
        while at + k < len(order):
            shape = sims[order[at + k]].shape
            wide, high = max(n, shape[0]), max(m, shape[1])
            if k and ((k + 1) * (wide + 1) * (high + 1) > SCALED or wide > 1.5 * sims[order[at]].shape[0] + 2):
                break
            n, m, k = wide, high, k + 1
        group = order[at : at + k]
        at += k
        for i, plan in zip(group, scaled([sims[i] for i in group], [a[i] for i in group], [b[i] for i in group], n, m, null_cost, eps, tolerance, drift)):
            out[i] = plan
    return out


def scaled(sims: list[np.ndarray], a: list[np.ndarray], b: list[np.ndarray], n: int, m: int, null_cost: float, eps: float, tolerance: float, drift: float) -> list[np.ndarray]:
    """transport() of pages of at most n by m sentences. The nulls are row n and column m; the rows and
    columns that a page doesn't have carry no mass."""
    count = len(sims)
    k, left, right = np.zeros((count, n + 1, m + 1)), np.zeros((count, n + 1)), np.zeros((count, m + 1))
    off = np.exp(-null_cost / eps)
    for i, (sim, x, y) in enumerate(zip(sims, a, b)):
        r, c = sim.shape
        away = np.abs((np.arange(r) + 0.5)[:, None] / r - (np.arange(c) + 0.5)[None, :] / c)
        k[i, :r, :c] = np.exp((sim - 1 - drift * away) / eps)
        k[i, :r, m], k[i, n, :c], k[i, n, m] = off, off, 1.0
        left[i, :r] = np.maximum(x, 0.5) / x.sum() if x.sum() else 1 / r
        right[i, :c] = np.maximum(y, 0.5) / y.sum() if y.sum() else 1 / c
    left[:, n], right[:, m] = 1.0, 1.0
    u_all, v_all = np.zeros_like(left), np.zeros_like(right)
    live = np.arange(count)
    kt, no_left, no_right = np.ascontiguousarray(k.transpose(0, 2, 1)), (left == 0).astype(float), (right == 0).astype(float)
    a_, b_, u, v = left, right, 1 - no_left, 1 - no_right
    for step in range(1, ENDLESS + 1):
        new = a_ / (np.matmul(k, v[:, :, None])[:, :, 0] + no_left)
        close = (np.abs(new - u) <= tolerance * u).all(axis=1) if step % EVERY == 0 or step == ENDLESS else None
        u = new
        v = b_ / (np.matmul(kt, u[:, :, None])[:, :, 0] + no_right)
        if close is not None and close.any():
            u_all[live[close]], v_all[live[close]] = u[close], v[close]
            go = ~close
            live = live[go]
            if not len(live):
                break
            k, kt, no_left, no_right, a_, b_, u, v = (x[go] for x in (k, kt, no_left, no_right, a_, b_, u, v))
    if len(live):
        u_all[live], v_all[live] = u, v
    out = []
    for i, sim in enumerate(sims):
        r, c = sim.shape
        away = np.abs((np.arange(r) + 0.5)[:, None] / r - (np.arange(c) + 0.5)[None, :] / c)
        plan = u_all[i, :r, None] * np.exp((sim - 1 - drift * away) / eps) * v_all[i, None, :c]
        out.append(plan / np.minimum(left[i, :r, None], right[i, None, :c]))
    return out


def plans(p: Pages, lexicon: Lexicon) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Transport plans and similarities of pages."""
    sims = p.blocks(lexicon.similarity(p))
    cut = lambda x, first, n: [x[a : a + k].astype(float) for a, k in zip(first, n)]
    return transport(sims, cut(p.n_s, p.first_s, p.n), cut(p.n_t, p.first_t, p.m), **SETTINGS), sims


class PairSums:
    """Sums of the weights of word pairs and words. Words are numbered; pairs of few different words are
    summed in a table, of many by sorting."""

    def __init__(self, s: np.ndarray, t: np.ndarray) -> None:
        """s, t: all words of either side that may come, different and in order."""
        self.s, self.t = s, t
        self.table = np.zeros(len(s) * len(t), np.int64) if len(s) * len(t) <= TABLE else None
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held, self.most = 0, HELD

    def add(self, s: np.ndarray, t: np.ndarray, sums: np.ndarray) -> Iterator[pd.DataFrame]:
        """s, t: numbers of words."""
        self.parts.append((s * len(self.t) + t, sums))
        self.held += len(s)
        if self.held > self.most:
            self.gather()
            if self.held > HELD:
                yield from self.end()

    def gather(self) -> None:
        """Puts what is held together; afterwards HELD more are taken before it is done again."""
        if not self.parts:
            return
        keys, sums = (np.concatenate(x) for x in zip(*self.parts))
        self.parts, self.held = [], 0
        if self.table is not None:
            self.table += np.bincount(keys, sums, minlength=len(self.table)).astype(np.int64)
        else:
            self.parts = [summed(keys, sums)]
            self.held = len(self.parts[0][0])
        self.most = self.held + HELD

    def end(self) -> Iterator[pd.DataFrame]:
        self.gather()
        if self.table is not None:
            keys = np.flatnonzero(self.table)
            yield self.frame(keys, self.table[keys])
            self.table[:] = 0
        elif self.parts:
            yield self.frame(*self.parts[0])
        self.parts, self.held, self.most = [], 0, HELD

    def frame(self, keys: np.ndarray, sums: np.ndarray) -> pd.DataFrame:
        s, t = np.divmod(keys, len(self.t)) if len(self.t) else (keys, keys)
        return pd.DataFrame({"key": self.s[s] << 31 | self.t[t], "c": sums})


def summed(keys: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sums of each key."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(sums[order], first) if len(keys) else sums


def counts_of(src: list, n_src: list, trg: list, n_trg: list, lexicon: Lexicon | None) -> Iterator[pd.DataFrame]:
    """(key, c) of the pages of a part, c in STEPS: see pair_counts."""
    every = Pages(src, n_src, trg, n_trg)
    (s_words, s_all), (t_words, t_all) = (np.unique(x, return_inverse=True) for x in (every.s, every.t))
    sums = PairSums(s_words, t_words)
    mass = np.zeros(len(s_words), np.int64)
    s_end, t_end = np.cumsum([len(x) for x in src]), np.cumsum([len(x) for x in trg])
    for a, b in chunks(src, trg):
        p = Pages(src[a:b], n_src[a:b], trg[a:b], n_trg[a:b])
        levels = [near_prior(n, m) for n, m in zip(p.n, p.m)] if lexicon is None else [np.minimum(x, 1.0) for x in plans(p, lexicon)[0]]
        for i, level in zip(range(a, b), levels):
            s, t = s_all[s_end[i] - len(src[i]) : s_end[i]], t_all[t_end[i] - len(trg[i]) : t_end[i]]
            if lexicon is None:
                row = np.rint(level.sum(axis=1) * STEPS).astype(np.int64)
                mass += np.bincount(s, np.repeat(row, n_src[i]), minlength=len(s_words)).astype(np.int64)
            for x, y, c in page_sums(s, np.asarray(n_src[i]), t, np.asarray(n_trg[i]), np.rint(level * STEPS)):
                yield from sums.add(x, y, c)
    yield from sums.end()
    if lexicon is None:
        yield pd.DataFrame({"key": -1 - s_words, "c": mass})


def page_sums(s: np.ndarray, n_s: np.ndarray, t: np.ndarray, n_t: np.ndarray, level: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(s, t, sums of levels) of the word pairs of one page, each pair once; level: of each sentence pair."""
    words, at = np.unique(s, return_inverse=True)
    place, into = np.unique(t, return_inverse=True)
    if not len(words) or not len(place):
        return
    of = np.zeros((len(words), len(n_s)))
    of[at, np.repeat(np.arange(len(n_s)), n_s)] = 1.0
    has = np.zeros((len(n_t), len(place)))
    has[np.repeat(np.arange(len(n_t)), n_t), into] = 1.0
    rows = level @ has
    size = max(1, CELLS // len(place))
    for k in range(0, len(words), size):
        sums = of[k : k + size] @ rows
        i, j = np.nonzero(sums)
        yield words[k : k + size][i], place[j], sums[i, j].astype(np.int64)


def chunks(src: list, trg: list) -> Iterator[tuple[int, int]]:
    """Runs of pages of about CHUNK_WORDS words, a longer page by itself."""
    a, held = 0, 0
    for i in range(len(src)):
        held += len(src[i]) + len(trg[i])
        if held >= CHUNK_WORDS:
            yield a, i + 1
            a, held = i + 1, 0
    if a < len(src):
        yield a, len(src)


def parted(texts: DataFrame) -> tuple[DataFrame, int, int]:
    """texts with `part`, the number of parts, and of source sentences: pages are spread by hash over
    parts of about PART_WORDS words, whatever the number of pages."""
    words, sentences = texts.agg(F.sum(F.size("src") + F.size("trg")), F.sum(F.size("n_src"))).first()
    n = 1 + (words or 0) // PART_WORDS
    return texts.withColumn("part", F.pmod(F.xxhash64("page_id"), F.lit(n)).cast("int")), n, sentences or 1


def vocabulary(texts: DataFrame) -> DataFrame:
    """(part, side, code, n): the words of each part and in how many of its sentences they are, side 0 being
    the source."""
    side = lambda c, k: texts.select("part", F.lit(k).alias("side"), F.explode(F.col(c).cast("array<bigint>")).alias("code"))
    return side("src", 0).unionByName(side("trg", 1)).groupBy("part", "side", "code").agg(F.count(F.lit(1)).alias("n"))


def shards(vocab: DataFrame, lexicon: DataFrame) -> DataFrame:
    """The lexicon's rows (kind, s, t, w) that each part needs: entries and bests of its source words,
    worths of its target words."""
    of = vocab.where("side = 0").select("part", F.col("code").alias("s")).join(lexicon.where("kind < 2"), "s")
    to = vocab.where("side = 1").select("part", F.col("code").alias("t")).join(lexicon.where("kind = 2").drop("s"), "t").withColumn("s", F.lit(0).cast("long"))
    return of.select("part", "kind", "s", "t", "w").unionByName(to.select("part", "kind", "s", "t", "w"))


def by_part(texts: DataFrame, n: int, shard: DataFrame | None, work, schema: str) -> DataFrame:
    """work(src, n_src, trg, n_trg, page ids, lexicon) on each part with its piece of the lexicon."""

    def run(pages: pd.DataFrame, entries: pd.DataFrame | None) -> Iterator[pd.DataFrame]:
        lexicon = None if entries is None else Lexicon(*(entries[c].to_numpy() for c in ("kind", "s", "t", "w")))
        if len(pages):
            pages = pages.sort_values("page_id")
            yield from work(*(pages[c].tolist() for c in ("src", "n_src", "trg", "n_trg")), pages["page_id"].tolist(), lexicon)

    joined = lambda frames: pd.concat(frames, ignore_index=True) if frames else pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})
    parts = texts.repartition(min(n, TASKS), "part").groupBy("part")
    if shard is None:
        return parts.applyInPandas(lambda pages: joined(list(run(pages, None))), schema)
    return parts.cogroup(shard.repartition(min(n, TASKS), "part").groupBy("part")).applyInPandas(lambda pages, entries: joined(list(run(pages, entries))), schema)


def pair_counts(texts: DataFrame, n: int, shard: DataFrame | None) -> DataFrame:
    """(key, c): weighted counts of word pairs in sentences that correspond: at like places if there is
    no lexicon yet, else by the transport plan. Without a lexicon the keys -1 - s count, of each source
    word, the weights of its sentences' rows; with one each row weighs 1. Counted within each part first."""
    work = lambda src, n_src, trg, n_trg, ids, lexicon: counts_of(src, n_src, trg, n_trg, lexicon)
    return by_part(texts, n, shard, work, "key bigint, c bigint").groupBy("key").agg((F.sum("c") / STEPS).alias("c"))


def learn(texts: DataFrame, n: int, vocab: DataFrame, total: int, shard: DataFrame | None, least: float = 0.06, support: float = 1.2, narrow_rows: int = 200_000) -> DataFrame:
    """One round of learning over all pages: (kind, s, t, w), see Lexicon. The weight of a pair is the
    share of the source word's sentences whose counterpart holds the target word, less what chance gives,
    and less for few cases. The share doesn't depend on how large a part of the corpus a language is.
    Pairs of a lower sum than `support` have no weight. total: the number of source sentences."""
    key, c = F.col("key"), F.col("c")
    counts = materialize(pair_counts(texts, n, shard).where((key < 0) | (c >= support)), "pairs")
    of = lambda side, name, count: vocab.where(F.col("side") == side).groupBy(F.col("code").alias(name)).agg(F.sum("n").alias(count))
    src, trg = of(0, "s", "n_s"), of(1, "t", "n_t")
    if shard is None:
        src = src.join(counts.where(key < 0).select((-1 - key).alias("s"), c.alias("mass")), "s")
    else:
        src = src.withColumn("mass", F.col("n_s").cast("double"))
    worth = F.when(F.col("n_t") >= 3, F.least(F.lit(1.0), F.log(F.lit(float(total)) / F.col("n_t") + 1) / 5)).otherwise(F.lit(1.0))
    src, trg = materialize(src, "sources"), materialize(trg.withColumn("g", worth), "targets")
    pairs = counts.where(key >= 0).select(F.shiftright("key", 31).alias("s"), key.bitwiseAND(0x7FFFFFFF).alias("t"), "c")
    scored = (
        pairs.join(small(src, narrow_rows), "s")
        .join(small(trg, narrow_rows), "t")
        .withColumn("w", (c / F.col("n_s") - F.col("mass") / F.col("n_s") * F.col("n_t") / total) * c / (c + 1))
        .where(F.col("w") >= least)
    )
    scored = materialize(scored.select("s", "t", "w", "g"), "scored")
    kept = scored.groupBy("s").agg(F.max("w").alias("top")).join(scored, "s").where(F.col("w") >= F.col("top") * 0.2)
    kept = kept.select("s", "t", F.least(F.col("w") * 1.6, F.lit(1.0)).alias("w"), "g")
    best = kept.groupBy("s").agg(F.max(F.col("w") * F.col("g")).alias("w"))
    rows = (
        kept.select(F.lit(0).alias("kind"), "s", "t", "w")
        .unionByName(best.select(F.lit(1).alias("kind"), "s", F.lit(0).cast("long").alias("t"), "w"))
        .unionByName(trg.select(F.lit(2).alias("kind"), F.lit(0).cast("long").alias("s"), "t", F.col("g").alias("w")))
    )
    return materialize(rows, "lexicon")


LINKS = "page_id string, ocr_sent int, trans_sent int, strength double, kind string"


def links_of(src: list, n_src: list, trg: list, n_trg: list, ids: list, lexicon: Lexicon, share: float, least: float) -> Iterator[pd.DataFrame]:
    """The links of the pages of a part: see align."""
    for a, b in chunks(src, trg):
        p = Pages(src[a:b], n_src[a:b], trg[a:b], n_trg[a:b])
        rows = []
        for pid, plan, sim in zip(ids[a:b], *plans(p, lexicon)):
            hit = (plan >= share) & (sim >= least)
            of, to = hit.sum(axis=1), hit.sum(axis=0)
            for i, j in zip(*np.nonzero(hit)):
                kind = "many" if to[j] > 1 and of[i] > 1 else "merge" if to[j] > 1 else "split" if of[i] > 1 else "one"
                rows.append((pid, int(i) + 1, int(j) + 1, round(float(min(plan[i, j], 1.0)), 4), kind))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in LINKS.split(", ")])


def align(texts: DataFrame, n: int, shard: DataFrame, share: float = 0.5, least: float = 0.25) -> DataFrame:
    """(page_id, ocr_sent, trans_sent, strength, kind) of linked sentences, counted from 1.

    A link needs `share` of the smaller sentence's mass and a similarity of at least `least`. kind:
    one, merge (several source sentences in one), split (one in several), many. Sentences without a
    link are omissions and have no row, nor has a page where one text is null or empty.
    """
    return by_part(texts, n, shard, lambda src, n_src, trg, n_trg, ids, lexicon: links_of(src, n_src, trg, n_trg, ids, lexicon, share, least), LINKS)


def align_pages(pages: DataFrame, rounds: int = 3) -> DataFrame:
    """Links of all pages (page_id, src, trg), with a lexicon learned from all of them. An empty table
    gives an empty table; a page given twice is linked twice, with equal rows."""
    texts, n, total = parted(materialize(encoded(pages), "bitexts"))
    vocab = materialize(vocabulary(texts), "vocabulary")
    shard = None
    for _ in range(rounds):
        shard = shards(vocab, learn(texts, n, vocab, total, shard))
    return align(texts, n, shard)
