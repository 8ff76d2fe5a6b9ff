"""Problem 3: the language of each page and of its segments in other languages.

Error-correcting output codes: each language has a codeword of BITS bits; one binary classifier over
hashed character n-grams predicts each bit; decoding weighs the loss of each bit by how reliable its
classifier is and picks the codeword of least loss. A small gap to the next codeword flags
ambiguity.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BITS = 21
BUCKETS = 1 << 16
ORDERS = (1, 2, 3, 4)
#: Bound of the labelled sample of page sentences per language, for the fit.
SAMPLE_PAGES_PER_LANGUAGE = 250

WORD = re.compile(r"[^\W\d_]+")
MARKUP = re.compile(r"<([A-Za-z][\w-]*)>[^<]*</\1>|<[^>]*>|\[\[meta:[^\]]*\]\]|\[\[\w+:|\]\]|\[\[")
BROKEN = re.compile(r"(\w)[-=⸗¬‐­] *\n+(?=\w)")
#: A sentence ends behind its mark and before white space; a heading or number line isn't part of one.
SENTENCE_END = re.compile(r"(?<=[.!?])[\"'»”’)]*\s+")
ALONE = re.compile(r"^[ \t]*(?:[-–—\[(]?\s*(?:fol\.|p\.)?\s*[0-9lIO]{1,4}\s?[rv]?\s*[-–—\])]?\.?|[ivxlcIVXLC]{1,8}\.?|(?:\*\s*)+)[ \t]*$", re.M)
#: A line of capitalised words only, of at most nine words.
HEADING = re.compile(r"^[ \t]*(?:(?:fol\. ?\w+|p\. ?\w+|['’]?[A-ZÀ-Þ0-9][^\s]*|\[\d+\]|&)(?:[ \t]+|$)){1,9}$", re.M)


def codewords(n: int, bits: int = BITS, seed: int = 11, tries: int = 400) -> np.ndarray:
    """n codewords of +1 and -1, far apart: the best of `tries` random codes by least distance. Every
    bit splits the languages."""
    rng, best, far = np.random.default_rng(seed), None, -1
    for _ in range(tries):
        code = rng.choice([-1, 1], size=(n, bits))
        for b in range(bits):
            if abs(code[:, b].sum()) == n:
                code[rng.integers(n), b] *= -1
        gap = min([int((code[i] != code[j]).sum()) for i in range(n) for j in range(i)] or [bits])
        if gap > far:
            best, far = code, gap
    return best


def word_features(word: str) -> np.ndarray:
    """Hashed n-grams of one lower-case word with its ends marked, and the word itself."""
    import xxhash

    w = f"<{word}>"
    grams = [w[i : i + n] for n in ORDERS for i in range(len(w) - n + 1) if n > 1 or w[i] not in "<>"] + [w]
    return np.fromiter((xxhash.xxh32_intdigest(g) % BUCKETS for g in grams), dtype=np.int64, count=len(grams))


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def __post_init__(self) -> None:
        self.rows: dict[str, int] = {}
        self.table = np.zeros((4096, BITS + 1), dtype=np.float32)

    def __getstate__(self):
        return {"langs": self.langs, "code": self.code, "weights": self.weights.astype(np.float16), "trust": self.trust}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.weights = self.weights.astype(np.float32)
        self.__post_init__()

    def row(self, word: str) -> int:
        """Row of a word's summed weights, kept while the process lives (up to a bound)."""
        at = self.rows.get(word)
        if at is None:
            if len(self.rows) >= 400_000:
                self.rows.clear()
            at = len(self.rows)
            if at >= len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            f = word_features(word)
            self.table[at, :BITS] = self.weights[f].sum(axis=0)
            self.table[at, BITS] = len(f)
            self.rows[word] = at
        return at

    def decode(self, sums: np.ndarray) -> np.ndarray:
        """Log-probabilities of the languages (texts x languages) from summed word rows."""
        scores = sums[:, :BITS] / np.sqrt(np.maximum(sums[:, BITS:], 1.0))
        loss = np.zeros((len(sums), len(self.langs)))
        for k, word in enumerate(self.code):
            loss[:, k] = (np.logaddexp(0, -scores * word) * self.trust).sum(axis=1)
        z = -loss
        return z - np.logaddexp.reduce(z, axis=1, keepdims=True)

    def predict(self, texts: list[list[str]]) -> np.ndarray:
        """texts: lists of lower-case words. Empty texts get equal probabilities."""
        flat = [self.row(w) for t in texts for w in t]
        sums = np.zeros((len(texts), BITS + 1))
        sizes = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
        if flat:
            full = np.flatnonzero(sizes)
            starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
            sums[full] = np.add.reduceat(self.table[np.asarray(flat)], starts, axis=0)
        return self.decode(sums)


def fit(texts: list[tuple[str, str]], epochs: int = 6, rate: float = 0.25, seed: int = 5) -> Model:
    """Binary classifiers for each bit of the codewords, by AdaGrad on the logistic loss, from
    (language, text). The trust of a bit is its accuracy on a held-out tenth, above chance."""
    langs = sorted({lang for lang, _ in texts})
    code = codewords(len(langs))
    rows = []
    cache: dict[str, np.ndarray] = {}
    for lang, text in texts:
        words = WORD.findall(text.lower())
        if words:
            for w in words:
                if w not in cache:
                    cache[w] = word_features(w)
            f = np.concatenate([cache[w] for w in words])
            rows.append((langs.index(lang), f, np.unique(f)))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    held = set(order[: len(rows) // 10].tolist()) if len(rows) >= 200 else set()
    weights, squares = np.zeros((BUCKETS, BITS), dtype=np.float32), np.full((BUCKETS, BITS), 0.1, dtype=np.float32)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            if i in held:
                continue
            k, f, u = rows[i]
            y, scale = code[k], 1 / np.sqrt(len(f))
            step = -y / (1 + np.exp(np.clip(weights[f].sum(axis=0) * scale * y, -30, 30))) * scale
            squares[u] += step * step
            weights[u] -= rate * step / np.sqrt(squares[u])
    trust = np.ones(BITS)
    if held:
        hits = np.zeros(BITS)
        for i in held:
            k, f, _ = rows[i]
            hits += np.sign(weights[f].sum(axis=0)) == code[k]
        trust = np.maximum(hits / len(held) - 0.5, 0.05) * 2
    return Model(langs, code, weights, trust)


def sentences(text: str) -> list[str]:
    """The sentences of a page's running text: broken words joined, headings and markup out."""
    if "<" in text or "[[" in text:
        text = MARKUP.sub(" ", text)
    if "\n" in text:
        text = BROKEN.sub(r"\1", text)
        text = HEADING.sub("", ALONE.sub("", text))
    return SENTENCE_END.split(text.strip())


#: A page's text goes through the model in batches of this many sentences.
SEGMENTS = "page_id string, seg int, lang string, n_words int, whole boolean, confidence double, ambiguous boolean, main boolean, page_conf double"


def segment_pages(pages: DataFrame, model: Model, least: int = 60, surprise: float = 2.5, gap: float = 0.8, min_words: int = 4) -> DataFrame:
    """Languages of pages (page_id, text) and of their segments.

    One row per run of sentences in one language: page_id, seg (from 1), lang, n_words, whole
    (whether the run holds a whole sentence), confidence, ambiguous (the next language is nearer
    than `gap`), main (the language of most of the running text), page_conf. A sentence is taken to
    be in the page's main language unless another one is better by `surprise` in log-probability;
    sentences of under min_words words follow their neighbours. Null texts and texts under `least`
    characters give no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            ids, spans, texts, ends = [], [], [], []
            for pid, text in zip(batch["page_id"], batch["text"]):
                ss = [(s, WORD.findall(s.lower())) for s in sentences(text)]
                ss = [(s, w) for s, w in ss if w]
                if ss:
                    ids.append(pid)
                    spans.append((len(texts), len(texts) + len(ss)))
                    texts += [w for _, w in ss]
                    ends += [s[-1:] in ".!?\"'»”’)" and (i > 0 or s[:1].isupper() or not s[:1].isalpha()) for i, (s, _) in enumerate(ss)]
            if not ids:
                continue
            logp = model.predict(texts)
            sizes = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
            for pid, (a, b) in zip(ids, spans):
                p, n = logp[a:b], sizes[a:b]
                total = (np.maximum(p, -8) * n[:, None]).sum(axis=0)
                votes = np.bincount(p.argmax(axis=1), weights=n, minlength=len(model.langs))
                main = int(np.lexsort((total, votes))[-1])
                pick = p.argmax(axis=1)
                weak = (p[np.arange(b - a), pick] - p[:, main] < surprise) | (n < min_words)
                pick = np.where(weak, main, pick)
                conf_page = float(np.exp(p[pick == main, main].mean())) if (pick == main).any() else 0.0
                start, seg = 0, 0
                for i in range(1, b - a + 1):
                    if i == b - a or pick[i] != pick[start]:
                        seg += 1
                        k = int(pick[start])
                        part, w = p[start:i], n[start:i]
                        mean = (part * w[:, None]).sum(axis=0) / w.sum()
                        others = np.delete(mean, k)
                        complete = any(ends[a + j] and n[j] >= min_words for j in range(start, i))
                        out.append((pid, seg, model.langs[k], int(w.sum()), complete, round(float(np.exp(mean[k])), 4), bool(len(others) and mean[k] - others.max() < gap), k == main, round(conf_page, 4)))
                        start = i
            if out:
                yield pd.DataFrame(out, columns=[c.split()[0] for c in SEGMENTS.split(", ")])

    texts = pages.where(F.length("text") >= least).select("page_id", "text")
    return texts.mapInPandas(run, SEGMENTS)


def labelled_sentences(samples: DataFrame, texts: DataFrame, labels: DataFrame, per_language: int = SAMPLE_PAGES_PER_LANGUAGE) -> list[tuple[str, str]]:
    """Labelled texts for the fit: the clean samples, and sentences of a bounded number of pages whose
    book's label and whose prediction by the samples alone agree.

    texts: (page_id, text); labels: (page_id, lang, n), n being the text's length. Takes the
    per_language pages of each label that come first by hash, of at least 200 characters; their number
    doesn't grow with the data. Only ids are ranked; the texts of the chosen are read at the end.
    """
    base = [(r["lang"], r["text"]) for r in samples.where("lang is not null and text is not null").select("lang", "text").collect()]
    first = fit(base)
    known = labels.where(F.col("lang").isin(first.langs) & (F.col("n") >= 200))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    # a filter by hash keeps about 4 x the wanted pages before the exact cut by rank
    keep = F.lit(False)
    for lang, n in counts.items():
        share = min(1.0, 4.0 * per_language / n)
        keep = keep | ((F.col("lang") == lang) & (F.pmod(F.xxhash64("page_id"), F.lit(1_000_000)) < int(share * 1_000_000)))
    order = W.partitionBy("lang").orderBy(F.xxhash64("page_id"), "page_id")
    chosen = known.where(keep).withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= per_language).select("page_id", "lang")
    rows = texts.select("page_id", "text").join(F.broadcast(chosen), "page_id").select("lang", "text").collect()  # at most per_language of each label
    parts, names = [], []
    for r in rows:
        for s in sentences(r["text"]):
            words = WORD.findall(s.lower())
            if len(words) >= 5:
                parts.append((s, words))
                names.append(r["lang"])
    if not parts:
        return base
    logp = first.predict([w for _, w in parts])
    pick = logp.argmax(axis=1)
    sure = logp.max(axis=1) > np.log(0.6)
    return base + [(lang, s) for (s, _), lang, k, ok in zip(parts, names, pick, sure) if ok and first.langs[k] == lang]
