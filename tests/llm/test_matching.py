"""Problem 1."""

import random
import re

from pyspark.sql import functions as F

from scriptorium.llm import matching
from tests.conftest import values

FIELDS = "key bigint, title string, author string, year string, place string, side string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "extra") for r in rows], FIELDS)


def pairs(spark, a, b):
    return values(matching.match_records(frame(spark, a), frame(spark, b)).select("key_a", "key_b"))


def test_normal_forms():
    assert matching.surname("Kubrein, Johann") == matching.surname("D. Johannes Kubreinius") == matching.surname("Kubrein (Johann)") == "kubrein"
    assert matching.surname("[anon.]") == matching.surname(None) == matching.surname("") == ""
    assert [matching.year_of(y) for y in ("c. 1608", "[1608]", "MDCVIII", "Mdcviii.", "1608-09", "s.a.", "16--", None)] == [1608] * 5 + [0, 0, 0]
    assert matching.place_of("Lindburgii")[0] == matching.place_of("[Lindburg]")[0] == matching.place_of("LINDBURG, apud")[0] == "lindburg"
    assert matching.place_of("Lind.") == ("lind", True) and matching.place_of("s.l.") == ("", False)
    assert matching.volume_of(matching.fold("De sole, pars secunda").split()) == 2 and matching.volume_of(["nunc", "primum"]) == 0
    assert matching.volume_of(["anderer", "tel"]) == 2 and matching.volume_of(["the", "fist", "part"]) == 1 and matching.volume_of(["prima", "terra"]) == 0
    assert matching.volume_of("trattato del terra".split(), {"del"}) == 0
    assert matching.near("herbam", "hebram", 1) and not matching.near("herbam", "hortum", 2)


def test_same_printing_reprint_and_volume(spark):
    a = [(1, "Disputatio de luce contra vinum", "Kubrein, Johann", "1608", "Lindburg"), (2, "Theatrum solis, pars prima", "Digang, Paul", "1550", "Oskau"), (3, None, "X", "1500", "Y"), (4, "", None, None, None)]
    b = [
        (11, "DISPUTATIO DE LUCE CONTRA VNUM", "J. Kubreinius", "MDCVIII", "[Lindburgii]"),
        (12, "Disputatio de luce contra vinum", "Kubrein", "1650", "Tormach"),
        (13, "Theatrum solis, pars secunda", "Digang (Paul)", "1550", "Oskau"),
        (14, "Theatrum solis pars prima", None, "c. 1550", "Osk."),
        (14, "Theatrum solis pars prima", None, "c. 1550", "Osk."),
        (15, None, None, None, None),
    ]
    assert pairs(spark, a, b) == [(1, 11), (2, 14)]


def test_abbreviated_words_slips_of_the_year_and_of_the_part(spark):
    a = [(1, "Disputatio de natura contra manum", "Mires, Michele", "1690", "Vellau"), (2, "Theatrum portae et imaginis", "Daulaulm", "1525", None), (3, "Bericht von dem Ofen, anderer Teil", "Flogiel", "1685", "Kest"), (4, "Clavis lunae et solis", "Kodraund", "1600", "Oskau")]
    b = [(11, "Disp. de nat. contra manum", "Michael Mires", "1690", "Vellau"), (12, "Theatrum portae et imaginis", "A. Daulaulm", "1526", "Lindburg"), (13, "Bericht von dem Ofen, anderer Tel", "G. Flogiel", "1685", "Kest"), (14, "Clavis lunae et solis", "Kodraund", "1606", None)]
    assert pairs(spark, a, b) == [(1, 11), (2, 12), (3, 13)]


def test_empty_tables(spark):
    row = [(1, "De sole", "A B", "1500", "C")]
    assert pairs(spark, [], row) == pairs(spark, row, []) == pairs(spark, [], []) == []


VECTORS = "form bigint, blocks array<bigint>, title_bits array<bigint>, place_bits bigint, volume int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, r, [7, 0, 0, i], 5, 0) for i, r in enumerate(rows)], VECTORS)


def test_block_pairs_are_all_found(spark, monkeypatch):
    """The multi-index finds exactly the pairs that agree in two blocks and are near enough, with and
    without hot keys."""
    rng = random.Random(1)
    rows = [[rng.choice([None, 1, 2, 3, 255]) for _ in range(5)] for _ in range(60)]
    df = vectors(spark, rows)
    agree = lambda x, y: sum(p is not None and p == q for p, q in zip(x, y))
    far = lambda x, y: sum((p ^ q).bit_count() for p, q in zip(x, y) if p is not None and q is not None)
    for most in (matching.MOST_PAIRS, 60):
        monkeypatch.setattr(matching, "MOST_PAIRS", most)
        for radius in (320, 6):
            got = [(r.form_a, r.form_b, r.distance) for r in matching.close_pairs(df, df, radius=radius).collect()]
            want = {(i, j, far(rows[i], rows[j])) for i in range(60) for j in range(60) if agree(rows[i], rows[j]) >= 2 and far(rows[i], rows[j]) <= radius}
            assert len(got) == len(set(got)) and set(got) == want


def test_hot_keys_lose_no_pair(spark, monkeypatch):
    """Also pairs that agree in no third block are found under hot keys, each once."""
    rows = [[1, 2, 10 + i % 9, None if i % 4 == 0 else 30 + i, 100 + i] for i in range(50)]
    monkeypatch.setattr(matching, "MOST_PAIRS", 60)
    df = vectors(spark, rows)
    got = [(r.form_a, r.form_b) for r in matching.close_pairs(df, df).collect()]
    assert len(got) == 2500 and set(got) == {(i, j) for i in range(50) for j in range(50)}


def test_similarity_is_the_weighted_dice_of_the_fields_that_both_have(spark):
    a = [(1, [3, None, 1, 1, 1], [3, 0, 0, 0], 1, 0)]
    b = [(2, [1, 5, 1, 1, 1], [1, 0, 0, 0], 3, 2)]
    (r,) = matching.close_pairs(spark.createDataFrame(a, VECTORS), spark.createDataFrame(b, VECTORS)).collect()
    assert r.similarity == 0.6667 and r.distance == 1 and (r.d_title, r.d_author, r.d_year, r.d_place, r.d_volume) == (3, 2, -1, 2, 0)


def test_no_pair_that_the_exact_look_takes_is_closed_to_it(spark):
    """Years, volumes and names with slips and endings, against the exact look."""
    rng = random.Random(8)
    names = ["Bridierk", "Bridierkius", "Brideirk", "Birdiekr", "Bridrk", "Lisas", "Liss", "Lsiasius", "Kenulm", "Knelum", "Bo", "", None]
    places = ["Francofurti", "Francof.", "Franc.", "Francofutri", "Fracnofurti", "Lipsiae", "Lpisiae", "Lips.", "Lipsia", "Basel", "Bsael", "B.", "s.l.", None]
    years = ["1601", "1604", "1605", "MDCI", "s.a.", None]
    parts = ["", " pars prima", " pars secunda", "..."]
    rows = [(i, i % 2, "De luce aquae" + rng.choice(parts), rng.choice(names), rng.choice(years), rng.choice(places)) for i in range(160)]
    coded = matching.encode(spark.createDataFrame(rows, "key bigint, side int, title string, author string, year string, place string"), []).dropDuplicates(["side", "form"]).cache()
    side = lambda n, x: coded.where(F.col("side") == n).select(*[F.col(c).alias(f"{c}_{x}") for c in coded.columns])
    every = side(0, "a").crossJoin(side(1, "b")).withColumns({"similarity": F.lit(1.0), "pattern": F.lit(0)})
    taken = matching.agreement(every, []).where(F.when(F.col("l_title") > 0, matching.same_printing()).otherwise(0) > 0).select("form_a", "form_b")
    named = every.select("form_a", "form_b", *[F.col(f"{c}_{x}").alias(x + n) for x in "ab" for c, n in (("year", "y"), ("volume", "v"))], *[F.col(f"blocks_{x}")[0].alias(f"{x}0") for x in "ab"])
    left_open = named.where(matching.open_to_look()).select("form_a", "form_b")
    assert 200 < taken.count() < left_open.count() < every.count() and taken.exceptAll(left_open).count() == 0


def test_few_tables_of_postings_are_on_the_disk_at_a_time(spark, monkeypatch):
    """No shuffled file outlives the writing of some tables' pairs; only possible pairs are written one by one."""
    written = []
    plain = matching.materialize
    monkeypatch.setattr(matching, "materialize", lambda df, label="t", tidy=False: written.append((label, tidy)) or plain(df, label, tidy))
    rows = [(i, f"De luce et aqua {'abcdefgh'[i % 8] * 4}", "Anna Kubrein", str(1500 + 9 * (i % 40)), "Lipsiae") for i in range(120)]
    a = spark.createDataFrame(rows, "key bigint, title string, author string, year string, place string")
    matching.match_records(a, a.withColumn("key", F.col("key") + 1000)).count()
    assert all(tidy for _, tidy in written) and sum(label == "close" for label, _ in written) == -(-len(matching.TABLES) // matching.TOGETHER) > 2
    coded = matching.encode(a.withColumn("side", F.lit(0)), []).dropDuplicates(["form"])
    met = matching.possible_pairs(coded, coded, 0.5, matching.RADIUS)
    whole = matching.close_pairs(coded, coded, 0.5, matching.RADIUS)
    assert met.agg(F.sum("n")).first()[0] == whole.count() > 3 * met.count()


def test_weights_and_calibration():
    patterns = [(5, 4, 3, 4, 1, 0.97, 90), (5, 4, 0, 0, 1, 0.7, 80), (1, 0, 0, 1, 1, 0.3, 300), (3, -1, 3, 4, 1, 0.8, 10)]
    odds = matching.weights_of(patterns)
    assert odds[5, 4, 3, 4, 1] > odds[3, -1, 3, 4, 1] > odds[1, 0, 0, 1, 1] and matching.weights_of([]) == {}
    points = [(0.1, 100, 1), (0.5, 10, 6), (0.6, 10, 4), (2.0, 100, 99), (0.1, 100, 3), (3.0, 0, 0)]
    c = matching.calibrated(points, own=1e12)  # the regression alone
    assert abs(c[0] - c[4]) < 1e-6 and c[0] < c[1] and abs(c[1] - c[2]) < 1e-6 and abs(c[1] - 10.5 / 21) < 1e-6 and c[2] < c[3] and matching.calibrated([]) == []
    own = matching.calibrated(points, own=1.0)
    assert own[0] < 0.02 < 0.025 < own[4] < 0.035 and own[2] < own[1]


def catalogues(n, seed):
    """Two made-up catalogues whose true pairs are known: slips, missing fields, reprints and volumes."""
    rng = random.Random(seed)
    name = lambda k: "".join(rng.choice("bcdfglmnprstv") + rng.choice("aeiou") for _ in range(k)).capitalize()
    nouns, towns = [name(4) for _ in range(400)], [name(3) for _ in range(20)]

    def slip(t):
        if not t or rng.random() < 0.6:
            return t
        at = rng.choice([m.start() + 1 for m in re.finditer(r"\w{5}", t)])
        return t[:at] + rng.choice("aeiou") + t[at + 1 :]

    a, b, truth = [], [], set()
    for i in range(n):
        title = f"De {rng.choice(nouns)} et {rng.choice(nouns)} contra {rng.choice(nouns)}"
        author, year, town = name(4), rng.randrange(1500, 1800), rng.choice(towns)
        a.append((i, title, author, str(year), town))
        if rng.random() < 0.7:
            b.append((10**6 + 3 * i, slip(title), slip(author) if rng.random() < 0.9 else None, str(year) if rng.random() < 0.9 else None, slip(town)))
            truth.add((i, 10**6 + 3 * i))
        if rng.random() < 0.3:
            b.append((10**6 + 3 * i + 1, title, author, str(year + rng.randrange(5, 60)), rng.choice([t for t in towns if t != town])))
    return a, b, truth


def test_confidence_is_calibrated_on_planted_cases(spark):
    a, b, truth = catalogues(600, 5)
    rows = matching.match_records(frame(spark, a), frame(spark, b)).collect()
    got = {(r.key_a, r.key_b) for r in rows}
    assert len(got & truth) / len(truth) > 0.95 and len(got & truth) / len(got) > 0.95
    assert all(0.02 <= r.confidence <= 1 and r.similarity >= 0.5 for r in rows) and len({r.confidence for r in rows}) > 2
    # the share of true pairs doesn't fall from the less to the more confident half
    rows.sort(key=lambda r: r.confidence)
    half = len(rows) // 2
    share = lambda part: sum((r.key_a, r.key_b) in truth for r in part) / len(part)
    assert share(rows[half:]) >= share(rows[:half]) - 0.01


def test_small_tables_follow_the_same_rules(spark):
    """Words are common by their share alone; chance makes none common in a small table."""
    df = frame(spark, [(i, f"Liber de {w}", "A B", "1500", "C") for i, w in enumerate(["sole", "luna", "mari", "sole", "igne", "aqua", "rege", "flore", "monte", "libro"])])
    assert sorted(matching.common_words(df, 10, 0.018)) == ["de", "liber"] and matching.common_words(df.limit(0), 0, 0.018) == []
