"""Operators that must not gather a group, against brute force."""

import random
import types

import pytest
from pyspark.sql import functions as F

from scriptorium import session
from scriptorium.functions import markup, text
from scriptorium.operators import aggregates, joins, ordered, ranking
from tests.conftest import values


@pytest.mark.parametrize("few", [0, 10**6])
def test_order_statistics_against_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(ranking.order_statistics, "__defaults__", (64, few))
    rng = random.Random(2)
    rows = [("hot", rng.choice([rng.random(), 0.5, -1.0])) for _ in range(3000)] + [("few", float(i)) for i in range(5)] + [("one", 7.0)] * 3 + [(None, 1.0), (None, 3.0), ("gone", None)]
    df = spark.createDataFrame(rows, "k string, v double").withColumn("__n", F.lit("clash")).drop("__n")
    by = {}
    for k, v in rows:
        if v is not None:
            by.setdefault(k, []).append(v)
    shares = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r.k: tuple(r)[1:] for r in aggregates.nearest_rank(df, ["k"], "v", shares).collect()}
    assert got == {k: tuple(sorted(v)[min(int(len(v) * s), len(v) - 1)] for s in shares.values()) for k, v in by.items()}
    exact = {r.k: r for r in df.where("v is not null").groupBy("k").agg(*[F.percentile("v", F.lit(s)).alias(n) for n, s in shares.items()]).collect()}
    for r in aggregates.percentiles(df, ["k"], "v", shares, few=few, n=F.count("v")).collect():
        assert r.n == len(by.get(r.k, [])) and all(r[n] is None if r.n == 0 else abs(r[n] - exact[r.k][n]) < 1e-9 for n in shares)
    for slices, few in ((2, 0), (8, 0), (64, 0), (64, 10**6)):
        assert values(ranking.order_statistics(df, ["k"], "v", {"m": F.floor(F.col("__n") / 2), "z": F.col("__n") - 1}, slices, few).select("k", "m")) == sorted(((k, sorted(v)[len(v) // 2]) for k, v in by.items()), key=repr)
    assert aggregates.nearest_rank(df.limit(0), ["k"], "v", shares).count() == 0


def test_run_rank_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, -5.5, 0.0, *map(float, range(300))]), f"i{i:04}", "x") for i in range(500)]
    df = spark.createDataFrame(rows, "g string, n double, id string, clash string").repartition(5)
    want = {}
    for g in ("a", "b", None):
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0.0, r[2]))
        want |= {r[2]: i + 1 for i, r in enumerate(mine)}
    assert {r.id: r.rank for r in ranking.run_rank(df, "g", "n", "id", span=16).collect()} == want
    assert {r.id: r.chunk for r in ordered.chunks(df, "g", 7, "n", "id").collect()} == {i: (n - 1) // 7 for i, n in want.items()}
    assert ranking.run_rank(df.limit(0), "g", "n", "id").count() == 0


def test_interleave_keeps_the_first_turns(spark):
    df = spark.createDataFrame([("hot", i) for i in range(100)] + [("b", i) for i in range(3)] + [(None, 1)], "g string, i int")
    out = ordered.interleave(df, "g", "i", first=4).collect()
    assert {(r.g, r.i, r.turn, r.group_size) for r in out} == {("hot", i, i + 1, 100) for i in range(4)} | {("b", i, i + 1, 3) for i in range(3)} | {(None, 1, 1, 1)}


def test_pair_blocked_against_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(9)]
    rows = [(i, [rng.choice(words) for _ in range(rng.randrange(0, 5))], rng.random() < 0.4) for i in range(60)] + [(60, None, True), (61, ["w0"] * 3, None)]
    a = spark.createDataFrame(rows, "a int, ta array<string>, sa boolean")
    b = spark.createDataFrame(rows, "b int, tb array<string>, sb boolean")
    want = {(x[0], y[0]) for x in rows for y in rows if len(set(x[1] or []) & set(y[1] or [])) >= (1 if x[2] and y[2] else 2)}
    got = [tuple(r) for r in joins.pair_blocked(a, b, "ta", "tb", "sa", "sb").select("a", "b").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_blocking_loses_no_metadata_match(spark):
    """Every pair whose confidence is over 40 shares two stems, or one between titles of at most two words."""
    rng = random.Random(5)
    words = "liber libri von dem der mercurius mercurii aurum auri traite sol sole kunst kunste".split()
    make = lambda n: " ".join(rng.choice(words) for _ in range(rng.randrange(1, n)))
    left = [(i, make(7), rng.choice([None, make(3)])) for i in range(60)]
    right = [(i, make(7), rng.choice([None, make(3)])) for i in range(60)]
    a = spark.createDataFrame(left, "a int, b_title string, b_author string")
    b = spark.createDataFrame(right, "c int, c_title string, c_author string")
    judged = a.crossJoin(b).where(text.match_confidence("b_title", "b_author", "c_title", "c_author") > 40).select("a", "c")
    toks = lambda df, x: df.withColumns({f"tok_{x}": text.stems(F.concat_ws(" ", f"{x}_title", f"{x}_author")), f"short_{x}": F.size(text.stems(F.col(f"{x}_title"))) <= 2})
    blocked = joins.pair_blocked(toks(a, "b"), toks(b, "c"), "tok_b", "tok_c", "short_b", "short_c").select("a", "c")
    assert judged.count() > 50 and judged.exceptAll(blocked).count() == 0


def test_best_metadata_matches_against_brute_force(spark, monkeypatch):
    """The same rows as if every pair were judged, however the tables are cut, with ties, nulls and repeated
    rows; and few pairs are judged."""
    from scriptorium.operators import metadata

    rng = random.Random(7)
    words = "liber libri von dem der die mercurius mercurii mercuri aurum auri traite sol sole kunst kunste é l'or an".split()
    make = lambda n: " ".join(rng.choice(words) for _ in range(rng.randrange(0, n)))
    rows = lambda n: [(make(9), rng.choice([None, "", make(4)])) for _ in range(n)] + [(None, None), ("liber " * 30, "sol"), ("", "liber")]
    left, right = [(f"b{i}", *r) for i, r in enumerate(rows(50))], [(i, *r) for i, r in enumerate(rows(90) * 2)]
    a = spark.createDataFrame(left, "left_key string, title string, author string")
    b = spark.createDataFrame(right, "right_key bigint, title string, author string")
    sure = lambda x, y: text.words_confidence(*[text.matched_words(t) for t in (x[1], x[2], y[1], y[2])])
    want = set()
    for x in left:
        found = sorted((-c, y[0]) for y in right if (c := sure(x, y)) > 40)[:5]
        want |= {(x[0], y, -c, i + 1) for i, (c, y) in enumerate(found)}
    assert len(want) > 100
    for sizes in ((4_096, 65_536, 200), (20, 30, 5)):
        for name, n in zip(("LEFT_ROWS", "RIGHT_ROWS", "FIRST"), sizes):
            monkeypatch.setattr(metadata, name, n)
        got = [tuple(r) for r in metadata.best_matches(a, b).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert metadata.best_matches(a, b.limit(0)).count() == 0

    made = lambda: [f"der {rng.choice('abcdefghij') * 3}{rng.randrange(30):02} und {rng.choice('klmnopqr') * 3}{rng.randrange(30):02}" for _ in range(2_000)]
    judged, plain = [], text.words_confidence
    monkeypatch.setattr(text, "words_confidence", lambda *x: judged.append(1) or plain(*x))
    side, other = metadata.Side(made(), [None] * 2_000), metadata.Side(made(), [None] * 2_000).index()
    import numpy as np

    for t in side.title:
        metadata.best_of(t, [], other, np.arange(2_000), 40, 5)
    assert len(judged) < 2_000 * 100  # of 4,000,000 pairs, all of which share two words


def test_shared_folder_is_named_by_the_cluster(spark):
    def fake(master, named=None):
        conf = types.SimpleNamespace(get=lambda k, d=None: named if k == "spark.checkpoint.dir" else d, set=lambda k, v: None)
        return types.SimpleNamespace(sparkContext=types.SimpleNamespace(getConf=lambda: conf, master=master), conf=conf)

    assert session.shared_dir(fake("spark://host:7077", "hdfs://x/y")) == "hdfs://x/y"
    assert session.shared_dir(fake("local[4]")) and session.shared_dir(fake("local"))
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1000]"):
        with pytest.raises(RuntimeError):
            session.shared_dir(fake(master))


CASES = {
    "[[note: a]] and <note>b</note> -> c <-": [],
    "a ]] b [[x": [("unclosed_close", 2), ("unclosed_open", 7)],
    "[[note: a [[foo: b]] c]]": [("nested_bracket", 10), ("unknown_tag", 10)],
    "[[ : x]] [[note:  ]]": [("unknown_tag", 0), ("empty_tag", 9)],
    "[[no colon]] [[:x]]": [],
    "-> a -> b <-": [("unbalanced_center", 0)],
    "<- a": [("unbalanced_center", 0)],
    "<- a ->": [],
    "<NOTE>x</note><note></note>": [("empty_xml_tag", 14)],
    "<note><note></note>": [("unclosed_xml", 6)],
    "</note><i>": [("unclosed_xml", 0), ("unknown_xml_tag", 7), ("unclosed_xml", 7)],
    "<1> < note> <>": [],
}


@pytest.mark.parametrize("t", list(CASES))
def test_markup_faults_by_place(t):
    assert [(i["type"], i["position"]) for i in markup.check(t)] == CASES[t]


def test_repairs_of_markup():
    open_ = markup.check("[[note: a\n\nb")[0]
    assert (open_["fix"], open_["fix_position"], open_["fix_text"]) == ("insert", 9, "]]")
    long = "x" * 40 + "]]" + "y" * 40
    assert markup.check(long)[0]["context"] == "..." + "x" * 30 + "]]" + "y" * 30 + "..."


def test_ratings_against_a_plain_fold(spark):
    from scriptorium.functions import stats

    rng = random.Random(6)
    rows = [(rng.choice(["e1", "e2", None]), i, *rng.sample("xyz", 2), rng.choice(["a", "b", "tie"])) for i in range(200)] + [("e1", 999, None, "x", "a")]
    want = {}
    for g, _, x, y, won in sorted((r for r in rows if r[2]), key=lambda r: r[1]):
        rx, ry = want.setdefault((g, x), 1500.0), want.setdefault((g, y), 1500.0)
        gain = 32 * ({"a": 1.0, "b": 0.0}.get(won, 0.5) - 1 / (1 + 10 ** ((ry - rx) / 400)))
        want[g, x] += gain
        want[g, y] -= gain
    df = spark.createDataFrame(rows, "g string, id int, condition_a string, condition_b string, winner string").repartition(5)
    got = {(r.g, r.condition): r.rating for r in stats.elo(df, "g", ["id"]).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    assert stats.elo(df.limit(0), "g", ["id"]).count() == 0
