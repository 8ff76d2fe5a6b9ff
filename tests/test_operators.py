"""Null and order semantics of the operators on small frames, and properties."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.operators import aggregates, changes, filters, joins, nested, ordered, ranking
from tests.conftest import values


def test_null_predicates(spark):
    df = spark.createDataFrame([(1, None, None), (2, "", []), (3, "Ab", ["x"]), (4, "b", ["y", None])], "id int, s string, a array<string>")
    ids = lambda c: [r.id for r in df.where(c).orderBy("id").collect()]
    assert ids(filters.has_text("s")) == [3, 4]
    assert ids(filters.has_text("s", 1)) == [3]
    assert ids(filters.is_blank("s")) == [1, 2]
    assert ids(filters.differs("s", "b")) == [1, 2, 3]
    assert ids(filters.none_of("s", ["b", ""])) == [1, 3]
    assert ids(filters.none_of("s", ["b", None])) == [2, 3]
    assert ids(filters.contains_ci("s", "B")) == [3, 4]
    assert ids(filters.array_has("a", "y")) == [4]
    assert ids(filters.any_element("a", lambda x: x == "x")) == [3]
    assert ids(filters.non_empty("a")) == [3, 4]
    assert ids(filters.all_words_in(["s"], "")) == [1, 2, 3, 4]
    assert ids(filters.any_word_in("s", "")) == []
    assert ids(~filters.has_text("s")) == [1, 2]


def test_years_and_ranges(spark):
    df = spark.createDataFrame([("1533",), ("c. 1533",), ("1533-1534",), ("Unknown",), (None,)], "p string")
    assert [r[0] for r in df.select(filters.year_in_text("p")).collect()] == [1533, 1533, 1533, None, None]
    assert df.where(filters.between("p", "1500", "1599")).count() == 2
    assert df.where(filters.between("p")).count() == 5
    n = spark.createDataFrame([(None, 5), (5, 5), (3, None)], "a int, b int")
    assert values(n.select(filters.less_than_column("a", "b"))) == [(False,), (False,), (True,)]


def test_unwind(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None)], "id int, x array<string>")
    assert values(nested.unwind(df, "x", "e").select("id", "e")) == [(1, "a"), (1, "b")]
    assert values(nested.unwind(df, "x", "e", keep_empty=True, index="i").select("id", "i", "e")) == [(1, 0, "a"), (1, 1, "b"), (2, None, None), (3, None, None)]
    assert values(nested.facets(df, {"x": F.col("x"), "id": F.col("id")})) == [("id", "1", 1), ("id", "2", 1), ("id", "3", 1), ("x", "a", 1), ("x", "b", 1)]


def test_joins(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "id int, k string")
    b = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "k string, id int")
    assert values(joins.lookup_one(a, b, "k", "k", "b_").select("id", "b_id")) == [(1, 1), (1, 2), (2, None), (3, None)]
    assert values(joins.lookup_measures(a, b, "k", "k", n=F.count(F.lit(1))).select("id", "n")) == [(1, 2), (2, None), (3, None)]
    assert values(joins.anti(a, b, "k").select("id")) == [(2,), (3,)]
    assert values(joins.mark(a, b, "k", "f").select("id", "f")) == [(1, True), (2, False), (3, False)]
    none = b.where("false")
    assert joins.semi(a, none, "k").count() == 0 and joins.anti(a, none, "k").count() == 3


def test_neighbours_need_the_exact_place(spark):
    p = spark.createDataFrame([("b", 1.0, "p1"), ("b", 2.0, "p2"), ("b", 4.0, "p4")], "g string, n double, id string")
    assert values(joins.neighbours(p, "g", "n", "id").select("id", "before_1", "after_1")) == [("p1", None, "p2"), ("p2", "p1", None), ("p4", None, None)]


def test_as_of_and_range(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, None, 5)], "id int, k string, t int")
    right = spark.createDataFrame([("a", 2, 10.0), ("a", 5, 20.0)], "k string, t int, v double")
    assert values(joins.as_of(left, right, "k", "t", "v", "last").select("id", "last")) == [(1, 20.0), (2, None), (3, None)]
    pts, rng = spark.createDataFrame([(1.0,), (2.5,), (None,)], "x double"), spark.createDataFrame([("r", 0.0, 2.5), ("bad", 3.0, 1.0)], "r string, lo double, hi double")
    assert values(joins.in_range(pts, rng, "x", "lo", "hi", 1.0).select("x", "r")) == [(1.0, "r"), (2.5, "r")]


def test_rounding_and_ranks(spark):
    x = spark.createDataFrame([(2.5,), (-2.5,), (3.5,)], "x double")
    assert [r[0] for r in x.select(aggregates.half_up(F.col("x"))).collect()] == [3, -2, 4]
    assert [r[0] for r in x.select(aggregates.half_even(F.col("x"))).collect()] == [2.0, -2.0, 4.0]
    v = spark.createDataFrame([("a", float(i)) for i in range(10)] + [("b", 1.0), ("c", None)], "k string, v double")
    assert values(aggregates.nearest_rank(v, ["k"], "v", {"p50": 0.5, "p95": 0.95, "top": 1.0})) == [("a", 5.0, 9.0, 9.0), ("b", 1.0, 1.0, 1.0)]


def test_greedy_batches(spark):
    p = spark.createDataFrame([("b", 1, 40), ("b", 2, 40), ("b", 3, 90), ("b", 4, None), ("b", 5, 10), ("c", 1, 500)], "g string, n int, size int")
    assert values(ordered.greedy_batches(p, "g", ["n"], F.col("size"), 100)) == [("b", 1, 2, 80), ("b", 2, 3, 100), ("c", 1, 1, 500)]


def test_latest_rows_keep_one_of_equal_states(spark):
    p = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("a", 2, "new"), (None, 9, "x")], "id string, v int, t string")
    assert values(ranking.latest_rows(p, "id", "v")) == [("a", 2, "new")]


def test_split_rank_and_sum(spark):
    df = spark.createDataFrame([("hot", i) for i in range(500)] + [(None, 1000), (None, 1001)], "k string, id int")
    out = ranking.split_rank(df, ["k"], "id", slices=8).collect()
    assert sorted(r["rank"] for r in out if r.k == "hot") == list(range(500)) and sorted(r["rank"] for r in out if r.k is None) == [0, 1]
    pos = F.col("id") / F.lit(1100.0)
    got = {r.id: r.running for r in ranking.split_running_sum(df.withColumn("n", F.lit(2)), ["k"], pos, "id", "n", slices=8).where("k = 'hot'").collect()}
    assert all(got[i] == 2 * (i + 1) for i in range(500))
    assert ranking.split_rank(df.where("false"), ["k"], "id").count() == 0


def test_updates(spark):
    old = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "id string, t string, n int")
    new = spark.createDataFrame([("b", None, 5), ("c", "z", 6)], "id string, t string, n int")
    assert values(changes.upsert(old, new, "id")) == [("a", "x", 1), ("b", "y", 5), ("c", "z", 6)]
    assert values(changes.upsert(old, new.select("id", "n"), "id", {"t": F.lit("new")})) == [("a", "x", 1), ("b", "y", 5), ("c", "new", 6)]
    s = spark.createDataFrame([(1, ("d", "m")), (2, None)], "id int, o struct<data:string,model:string>")
    assert [r.o.data if r.o else None for r in changes.set_fields(s, F.col("id") == 1, o__data=F.lit("new")).orderBy("id").collect()] == ["new", None]
    ev = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    assert values(changes.increment(old, ev, "id", "k", "n").select("id", "n")) == [("a", 3), ("b", 2)]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 3), st.integers(0, 20), st.booleans()), min_size=1, max_size=12, unique_by=lambda t: (t[0], t[1])))
def test_split_then_reset_is_the_identity(spark, rows):
    pages = spark.createDataFrame([(f"p{b}-{n}", f"b{b}", float(n)) for b, n, _ in rows], "id string, book_id string, page_number double")
    at = spark.createDataFrame([(f"p{b}-{n}", 500) for b, n, s in rows if s] or [("none", 1)], "page_id string, position int")
    split = changes.split_pages(pages, at)
    assert split.count() == len(rows) + sum(s for *_, s in rows)
    per_book = {}
    for r in split.collect():
        per_book.setdefault(r.book_id, []).append(r.number)
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in per_book.values())
    back = changes.reset_splits(split)
    assert sorted(r.id for r in back.collect()) == sorted(f"p{b}-{n}" for b, n, _ in rows)


def test_archive_round_trip(spark):
    books = spark.createDataFrame([("a", True), ("b", False), ("c", True)], "id string, gone boolean")
    pages = spark.createDataFrame([("p1", "a"), ("p2", "a"), ("p3", "b")], "id string, book_id string")
    box = changes.archive(books, pages, "id", "book_id", F.col("gone"), F.lit("2025-01-01").cast("timestamp"))
    assert values(changes.restore(box)) == [("p1", "a"), ("p2", "a")]
    assert changes.purgeable(box, "2025-01-07").count() == 0 and changes.purgeable(box, "2025-01-08").count() == 2
