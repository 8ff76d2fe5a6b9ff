"""Problems 7 and 8, and the token counts they use."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.llm import mixing, packing, tokens
from tests.conftest import values


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), min_size=1, max_size=20), st.sampled_from([[64], [16, 64], [8, 16, 64]]))
def test_plan_places_every_item_once(histogram, capacities):
    left = dict(histogram)
    room = 0
    for pattern, times, capacity in packing.plan(histogram, capacities):
        used = sum(s * k for s, k in pattern.items())
        assert used <= capacity and capacity == min(c for c in capacities if c >= used)
        room += times * capacity
        for s, k in pattern.items():
            left[s] -= k * times
    assert not any(left.values())
    assert room <= 2 * sum(s * n for s, n in histogram.items()) + max(capacities)


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 900), st.integers(1, 3), min_size=1, max_size=300), st.integers(1, 1000))
def test_last_pair_leaves_the_least_room(histogram, gap):
    """The pair is the best of all, however many sizes there are."""
    pattern = packing.fill(packing.Sizes({**histogram, 2000: 1}), 2000, 2000 + gap)
    picked = sorted((s for s, k in pattern.items() for _ in range(k)), reverse=True)[1:]
    sizes = sorted(s for s in histogram if s <= gap)
    if not sizes:
        assert picked == []
        return
    one = sizes[-1]
    two = max((a + b for a in sizes for b in sizes if a + b <= gap and (a != b or histogram[a] > 1)), default=0)
    assert sum(picked) >= max(one, two)


def test_packing(spark):
    rows = [(1, 700), (2, 300), (3, 212), (4, 512), (5, 0), (6, None), (7, 1500), (8, 300), (8, 300)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, tokens int, capacity string")
    out = packing.pack(df, [512], "short").collect()
    by = {}
    for r in out:
        if r.container_id is not None:
            by.setdefault(r.container_id, []).append(r)
    assert all(sum(r.token_end - r.token_start for r in v) <= 512 and sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    whole = {}
    for r in out:
        whole[r.doc_id] = whole.get(r.doc_id, 0) + r.token_end - r.token_start
    assert whole == {1: 700, 2: 300, 3: 212, 4: 512, 5: 0, 6: 0, 7: 1500, 8: 600}
    assert {r.doc_id for r in out if r.container_id is None} == {5, 6}
    assert all(r.part == 0 for r in out if r.doc_id in (2, 3, 4, 8)) and max(r.part for r in out if r.doc_id == 7) == 2
    fills = packing.fills(packing.pack(df, [512], "short"))
    assert fills.agg(F.sum("used")).first()[0] == 3824 and fills.count() == len(by)


def test_joint_sizes_and_empty(spark):
    packs = spark.createDataFrame([("s", 100), ("l", 400)], "pack_name string, capacity_tokens int")
    df = spark.createDataFrame([(i, n) for i, n in enumerate([350, 90, 10, 260, 140])], "doc_id bigint, tokens int")
    out = packing.pack_all(df, packs)
    joint = packing.fills(out.where("pack_name = 'joint'"))
    assert joint.agg(F.sum("unused")).first()[0] <= packing.fills(out.where("pack_name = 'l'")).agg(F.sum("unused")).first()[0]
    assert packing.pack_all(df.where("false"), packs).count() == 0


def test_tokens(spark):
    df = spark.createDataFrame([("a b",), ("",), (None,), ("word " * 20000,)], "text string").withColumn("tokens", F.lit("clash"))
    for name in ("byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model", "word_bpe_49k.json"):
        n = [r.tokens for r in tokens.token_counts(df, path=f"{tokens.FOLDER}/{name}").collect()]
        assert n[0] >= 2 and n[1:3] == [0, 0] and n[3] >= 20000


@pytest.fixture
def records(spark):
    rows = [(i, "big", 10) for i in range(1000)] + [(1000 + i, "small", 20) for i in range(10)] + [(2000, "small", 0), (2001, "small", None), (3000, None, 5)]
    return spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, source string, tokens int, repeats int")


def test_mix(spark, records):
    t = spark.createDataFrame([("m", "big", 0.5, 2), ("m", "small", 0.5, 3), ("n", "big", 0.9, 1), ("n", "gone", 0.1, 4)], "mix_name string, source string, target_share double, max_repeats int")
    out = mixing.mix(records, t)
    goals = mixing.budgets(records, t)
    s = {(r.mix_name, r.source): r for r in mixing.shares(out, goals.select("mix_name", "source", "target_share", "budget")).collect()}
    assert s["m", "small"].used_tokens == 600 and s["m", "big"].used_tokens == 600 and s["m", "small"].most_repeats == 3
    assert all(r.over_budget == r.used_tokens - r.budget for r in s.values()) and s["m", "big"].over_budget == 0
    assert s["n", "gone"].used_tokens == 0 and s["n", "big"].actual_share == 1.0
    assert out.groupBy("mix_name", "doc_id").count().where("count > 1").count() == 0
    assert values(mixing.mix(records, t).select("mix_name", "doc_id", "repeats")) == values(out.select("mix_name", "doc_id", "repeats"))
    assert mixing.mix(records.where("false"), t).count() == 0 and mixing.mix(records, t.where("false")).count() == 0


def test_mix_cuts_at_the_budget(spark, records):
    t = spark.createDataFrame([("m", "big", 0.99, 1), ("m", "small", 0.01, 1)], "mix_name string, source string, target_share double, max_repeats int")
    used = mixing.mix(records, t).groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("n"))
    goal = {r.source: r.budget for r in mixing.budgets(records, t).collect()}
    assert all(abs(goal[r.source] - r.n) <= (10 if r.source == "small" else 5) for r in used.collect())
    assert mixing.mix(records, t).where("repeats > 1").count() == 0
