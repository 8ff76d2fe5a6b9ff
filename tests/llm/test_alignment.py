"""Problem 6."""

import numpy as np

from scriptorium.llm import alignment
from tests.conftest import values

NOUNS = {"sol": "sun", "luna": "moon", "mare": "sea", "mons": "mountain", "aqua": "water", "ignis": "fire", "liber": "book", "manus": "hand", "rex": "king", "flos": "flower"}
VERBS = {"amat": "loves", "videt": "sees", "portat": "carries", "quaerit": "seeks"}


def corpus(n=120):
    rng = np.random.default_rng(2)
    rows, truth = [], set()
    for p in range(n):
        src, trg = [], []
        for _ in range(6):
            a, b = rng.choice(list(NOUNS), 2, replace=False)
            v = rng.choice(list(VERBS))
            src.append(f"Hic {a} semper {v} {b}.")
            trg.append(f"This {NOUNS[a]} always {VERBS[v]} the {NOUNS[b]}.")
        ids = [[i] for i in range(6)]
        kind = p % 4
        if kind == 1:  # two merged
            trg[2:4] = [trg[2][:-1] + " and " + trg[3]]
            ids[2:4] = [[2, 3]]
        elif kind == 2:  # one left out
            del trg[1], ids[1]
        elif kind == 3:  # two swapped
            trg[0], trg[1] = trg[1], trg[0]
            ids[0], ids[1] = ids[1], ids[0]
        rows.append((f"p{p}", " ".join(src), " ".join(trg), p))
        truth |= {(f"p{p}", i + 1, j + 1) for j, s in enumerate(ids) for i in s}
    return rows, truth


def test_links_on_a_made_up_language(spark):
    rows, truth = corpus()
    df = spark.createDataFrame(rows, "page_id string, src string, trg string, strength int")
    got = {(r.page_id, r.ocr_sent, r.trans_sent) for r in alignment.align_pages(df).collect()}
    assert len(got & truth) / len(truth) > 0.97 and len(got & truth) / len(got) > 0.97


def test_transport_keeps_marginals():
    sim = np.array([[0.9, 0.0], [0.0, 0.8], [0.0, 0.0]])
    (plan,) = alignment.transport([sim], [np.ones(3)], [np.ones(2)], **alignment.SETTINGS)
    assert plan[0, 0] > 0.9 and plan[1, 1] > 0.9 and plan[2].max() < 0.4 and (plan <= 1.01).all()


def test_edges(spark):
    schema = "page_id string, src string, trg string"
    rows = [("n", None, "A b c."), ("e", "", "A b c."), ("one", "Sol.", "Sun."), ("marks", "... !", "? ."), ("long", "Sol videt mare. " * 400, "The sun sees the sea. " * 400)]
    out = alignment.align_pages(spark.createDataFrame(rows * 2, schema))
    assert {r.page_id for r in out.collect()} <= {"one", "long", "marks"}
    assert values(alignment.align_pages(spark.createDataFrame([], schema))) == []


def test_sentences_are_counted_in_the_whole_value():
    c = alignment.Coder()
    assert len(alignment.sentence_codes("A b. C d! <note>x.</note>\nE f?  G", c)) == 4
    assert [set(x) for x in alignment.sentence_codes("in-\nter alia.", c)] == [{c("inter"), c("alia")}]


def test_long_pages_teach_the_lexicon(spark):
    """Of pages with 100 sentences each, every weight of the prior is small; the words are learned all the same."""
    rng = np.random.default_rng(5)
    letters = list("abcdefghiklmnoprstu")
    source, target = (sorted({"".join(rng.choice(letters, 7)) for _ in range(60)}) for _ in "st")
    rows = []
    for p in range(25):
        picks = rng.integers(0, 60, (100, 4))
        src, trg = ([" ".join(words[k] for k in pick) + "." for pick in picks] for words in (source, target))
        rows.append((f"p{p}", " ".join(src), " ".join(trg)))
    df = spark.createDataFrame(rows, "page_id string, src string, trg string")
    texts, n, total = alignment.parted(alignment.encoded(df))
    first = alignment.learn(texts, n, alignment.vocabulary(texts), total, None).where("kind = 0").collect()
    pairs = {(alignment.code(s), alignment.code(t)) for s, t in zip(source, target)}
    assert len(pairs & {(r.s, r.t) for r in first}) >= 57
    got = {(r.page_id, r.ocr_sent, r.trans_sent) for r in alignment.align_pages(df).collect()}
    truth = {(f"p{p}", k, k) for p in range(25) for k in range(1, 101)}
    assert len(got & truth) / len(truth) > 0.97 and len(got & truth) / len(got) > 0.97


def test_prior_gives_every_sentence_a_weight():
    for n, m in ((1, 1), (9, 7), (50, 50), (90, 100), (2000, 1500)):
        level = np.rint(alignment.near_prior(n, m) * alignment.STEPS)
        assert (level.max(axis=1) >= 0.29 * alignment.STEPS).all()


def test_transport_meets_the_masses():
    rng = np.random.default_rng(3)
    sim = rng.random((40, 30)) ** 4
    a, b = rng.integers(1, 20, 40).astype(float), rng.integers(1, 20, 30).astype(float)
    loose, exact = (alignment.transport([sim], [a], [b], **alignment.SETTINGS | {"tolerance": x})[0] for x in (alignment.SETTINGS["tolerance"], 1e-10))
    assert np.abs(loose - exact).max() < 0.02
    # with pages of other sizes beside it: the same plan
    others = [rng.random(shape) for shape in ((3, 40), (38, 31), (1, 1), (41, 2))]
    sims, n, m = [*others, sim], [np.ones(len(x)) for x in others], [np.ones(x.shape[1]) for x in others]
    together = alignment.transport(sims, [*n, a], [*m, b], **alignment.SETTINGS)[-1]
    assert np.allclose(together, loose, atol=1e-9)


def slow_similarity(src, trg, weights, worth, best):
    """The definition, word by word."""
    out = np.zeros((len(src), len(trg)))
    sources = {s for s, _ in weights}
    alike = lambda w: 1.0 if w not in sources or (w, w) in weights else 0.7
    words = {t for s in trg for t in s}
    for i, s in enumerate(src):
        v = {t: max([weights.get((w, t), 0) + (alike(w) if w == t else 0) for w in s], default=0) for t in words}
        expected = sum(max(best.get(w, 0), alike(w) * worth.get(w, 1.0) if w in words else 0) for w in s)
        for j, q in enumerate(trg):
            told = sum(worth.get(t, 1.0) for t in q)
            out[i, j] = min(1.0, sum(min(v[t], 1) * worth.get(t, 1.0) for t in q) / np.sqrt(max(expected, 0.3) * max(told, 0.3)))
    return out


def test_similarity_and_sums_against_the_definition(monkeypatch):
    rng = np.random.default_rng(9)
    weights = {(int(s), int(t)): float(w) for s, t, w in zip(rng.integers(0, 12, 40), rng.integers(5, 20, 40), rng.random(40))}
    worth, best = {t: float(rng.random()) for t in range(0, 18)}, {s: float(rng.random()) for s in {s for s, _ in weights}}
    rows = [(0, s, t, w) for (s, t), w in weights.items()] + [(1, s, 0, w) for s, w in best.items()] + [(2, 0, t, w) for t, w in worth.items()]
    lexicon = alignment.Lexicon(*(np.array(x) for x in zip(*rows)))
    texts = [[[sorted(set(rng.integers(0, 20, rng.integers(0, 6)).tolist())) for _ in range(rng.integers(1, 5))] for _ in range(2)] for _ in range(12)]
    flat = lambda x: ([w for s in x for w in s], [len(s) for s in x])
    src, n_src, trg, n_trg = zip(*((*flat(s), *flat(t)) for s, t in texts))
    p = alignment.Pages(list(src), list(n_src), list(trg), list(n_trg))
    for (s, t), got in zip(texts, p.blocks(lexicon.similarity(p))):
        assert np.allclose(got, slow_similarity(s, t, weights, worth, best))
    sums = []
    for table, held in ((alignment.TABLE, alignment.HELD), (0, 7)):
        monkeypatch.setattr(alignment, "TABLE", table)
        monkeypatch.setattr(alignment, "HELD", held)
        total = {}
        for frame in alignment.counts_of(list(src), list(n_src), list(trg), list(n_trg), None):
            for k, c in zip(frame["key"], frame["c"]):
                total[k] = total.get(k, 0) + c
        sums.append(total)
    want = {}
    for s, t in texts:
        level = np.rint(alignment.near_prior(len(s), len(t)) * alignment.STEPS)
        for i, a in enumerate(s):
            for j, b in enumerate(t):
                for w in a:
                    for x in b:
                        want[w << 31 | x] = want.get(w << 31 | x, 0) + level[i, j]
    assert sums[0] == sums[1] and {k: c for k, c in sums[0].items() if 0 <= k < 1 << 62} == {k: c for k, c in want.items() if c}


def test_many_parts_give_the_same_links(spark, monkeypatch):
    df = spark.createDataFrame(corpus(40)[0], "page_id string, src string, trg string, strength int")
    one = values(alignment.align_pages(df))
    monkeypatch.setattr(alignment, "PART_WORDS", 300)
    monkeypatch.setattr(alignment, "CHUNK_WORDS", 50)
    for tasks in (alignment.TASKS, 2):
        monkeypatch.setattr(alignment, "TASKS", tasks)
        assert values(alignment.align_pages(df)) == one
