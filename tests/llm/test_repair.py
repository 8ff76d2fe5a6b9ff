"""Problem 5."""

import datetime as dt
import random

import pytest

from scriptorium.llm import repair
from tests.conftest import values

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "id string, book_id string, page_number double, updated_at timestamp, ocr struct<data:string>, kind string"
BOOKS = "id string, title string, author string"
GOOD = "Liber secundus docet cur vinum sine rore inveniri non possit."


@pytest.fixture(scope="module")
def books(spark):
    return spark.createDataFrame([("b", "De luce et aqua", "Anna Kubrein"), ("c", None, None)], BOOKS)


def pages(spark, rows):
    return spark.createDataFrame([(i, b, n, T0, (t,) if t is not None else None, "x") for i, b, n, t in rows], SCHEMA)


def test_kinds_of_lines(spark, books):
    filler = [(f"f{i}", "c", float(i), GOOD) for i in range(60)]
    noisy = "DE LUCE   fol. 5r\nLiber secundus docet cur vinum sine rore inve-\nniri non possit. Liber secundvs docet\ncur vinnm sine rore inveniri. Die Gold-\nund Silberschmiede, liber secun-\n\n- 7 -"
    rows = [*filler, ("p", "b", 1.0, noisy), ("q", "b", 2.0, "KUBREIN.\n8\ndus docet cur vinum sine rore.\nCAPUT V. LUX\n" + GOOD), ("n", "b", 3.0, None), ("e", "b", 4.0, "")]
    got = {}
    for r in repair.noisy_lines(pages(spark, rows), books).where("page_id in ('p','q','n','e')").collect():
        got.setdefault((r.page_id, r.kind), set()).add(r.line_no)
    assert got == {
        ("p", "header"): {1}, ("p", "page_number"): {1, 7}, ("p", "hyphen"): {2, 5}, ("p", "misread"): {4},
        ("q", "header"): {1}, ("q", "page_number"): {2},
    }


def test_headers_with_roman_numbers(spark, books):
    heads = ["xlv   De Luce Et Aqua", "De Luce Et   cclxxxviii", "DE LUCE   [4]", "ix  KUBREIN.", "<page-num>4</page-num>   DE LUCE", "De Luce 't Aqua   <page-num>xi</page-num>"]
    rows = [(f"p{i}", "b", float(i), f"{h}\n{GOOD}\n{GOOD}") for i, h in enumerate(heads)] + [("q", "b", 9.0, f"Vinum et   luce\n{GOOD}"), ("r", "b", 10.0, f"De Luce\n{GOOD}\ncclxxxviii")]
    got = values(repair.noisy_lines(pages(spark, rows), books))
    assert got == sorted([(f"p{i}", 1, k) for i in range(6) for k in ("header", "page_number")] + [("r", 1, "header"), ("r", 3, "page_number")], key=repr)


def test_long_printed_numbers(spark, books):
    heads = ["[26880]   De Luce Et Aqua", "De Luce Et   - 123456 -", "mmmmmmmmdccclxxxviii  KUBREIN."]
    rows = [(f"p{i}", "b", float(i), f"{h}\n{GOOD}\n{GOOD}") for i, h in enumerate(heads)] + [("r", "b", 10.0, f"De Luce\n{GOOD}\n[26881]"), ("s", "b", 11.0, f"De Luce\n{GOOD}\ndcclx")]
    got = values(repair.noisy_lines(pages(spark, rows), books))
    assert got == sorted([(f"p{i}", 1, k) for i in range(3) for k in ("header", "page_number")] + [(x, n, k) for x in "rs" for n, k in ((1, "header"), (3, "page_number"))], key=repr)


def close(lex):
    """All pairs that differ in one piece and whose counts allow a misreading, by the definition."""
    rate = lambda w: repair.MOST_MISREAD_SHORT if len(w) <= 3 else repair.MOST_MISREAD
    fits = lambda w, f: lex[f] >= 8 and lex[f] * rate(w) >= max(lex[w] * 0.1, lex[w] - 1.645 * lex[w] ** 0.5)
    return {(w, f, repair.piece(f, w)) for w in lex for f in lex if w != f and len(w) > 1 and len(f) > 1 and fits(w, f) and repair.piece(f, w)}


def test_close_forms_against_brute_force(spark):
    long = "a" * 29 + "bcdefghij" + "k" * 24
    lex = {"natura": 500, "notura": 2, "naturc": 1, "magna": 300, "rnagna": 2, "viridis": 200, "viriclis": 1, "terra": 90, "torra": 80, "de": 900, "dc": 3, "x": 5, "sale": 40, "sole": 30, "naturaa": 1, "atura": 1, "nxxura": 1}
    for n in range(54, 67):  # around the length at which the index changes
        lex[long[:n]] = 100
        lex |= {long[:5] + "zz" + long[6:n]: 1, long[: n - 3] + "y" + long[n - 2 : n]: 1, long[:20] + long[22:n]: 1}
    df = spark.createDataFrame(list(lex.items()) + [(None, 3)], "word string, n bigint")
    assert {(r.word, r.fix, r.piece) for r in repair.close_forms(df).collect()} == close(lex)
    assert repair.close_forms(df.where("false")).count() == 0 and repair.corrections(df.where("false")).count() == 0


def test_usual_confusions_are_found_in_a_small_corpus(spark):
    lex = {"natura": 500, "notura": 2, "naturc": 1, "magna": 300, "rnagna": 2, "viridis": 200, "viriclis": 1, "sale": 40, "sole": 30, "naturx": 1, "nxtura": 1}
    got = {(r.word, r.fix) for r in repair.corrections(spark.createDataFrame(list(lex.items()), "word string, n bigint")).collect()}
    assert got == {("notura", "natura"), ("rnagna", "magna"), ("viriclis", "viridis")}


def test_confusions_are_learned_from_the_corpus(spark):
    """A slip outside the list of usual ones is found where the corpus shows it in many words, and only
    there; so are words with two slips."""
    rng = random.Random(4)
    right = {"".join(rng.choice("abdgklmoprstuv") for _ in range(9)) for _ in range(60)}
    lex = {w: 20_000 for w in right}
    swapped = {w.replace("k", "x", 1): w for w in right if "k" in w}
    lex |= {w: 3 for w in swapped}
    twice = {w.replace("k", "x", 1).replace("r", "z", 1): w for w in right if "k" in w and "r" in w and w.index("k") < w.index("r")}
    lex |= {w.replace("r", "z", 1): 2 for w in right if "r" in w} | {w: 1 for w in twice}
    one_only = min(w for w in right if "d" in w)
    lex[one_only.replace("d", "y", 1)] = 3
    got = {(r.word, r.fix) for r in repair.corrections(spark.createDataFrame(list(lex.items()), "word string, n bigint")).collect()}
    assert set(swapped.items()) <= got and twice and set(twice.items()) <= got
    assert (one_only.replace("d", "y", 1), one_only) not in got


def test_a_misreading_stays_one_as_the_corpus_grows(spark):
    """The judgement rests on the rate: with all counts a hundred times as high it is the same."""
    lex = {"natura": 4000, "notura": 10, "terra": 3000, "torra": 300, "magna": 1000, "rnagna": 1}
    for times in (1, 100):
        df = spark.createDataFrame([(w, n * times) for w, n in lex.items()], "word string, n bigint")
        assert {r.word for r in repair.corrections(df).collect()} == {"notura", "rnagna"}


def test_hyphen_before_a_joining_word(spark, books):
    """It breaks a word only if both make a known one, however many words are known."""
    filler = [(f"f{i}", "c", float(i), "Er kennt den Grundund und das Gold. " + GOOD) for i in range(20)]
    rows = [*filler, ("p", "b", 1.0, "Liber secundus docet den Grund-\nund das Gold-\nund Silber. " + GOOD)]
    got = repair.noisy_lines(pages(spark, rows), books).where("page_id = 'p'").select("line_no", "kind")
    assert values(got) == [(1, "hyphen")]


def test_repaired_text(spark, books):
    filler = [(f"f{i}", "c", float(i), GOOD) for i in range(60)]
    rows = [*filler, ("p", "b", 1.0, "DE LUCE\nLiber sccundus docet cur\nvinum sine ro-\nre inveniri.\n\nVinurn docet.\n5"), ("only", "b", 2.0, "5\n6")]
    out = {r.page_id: (r.text, r.n_repairs) for r in repair.repaired_pages(pages(spark, rows), books).collect()}
    assert out["p"] == ("Liber secundus docet cur vinum sine rore inveniri.\n\nVinum docet.", 2)
    assert out["only"][0] == "" and out["f1"][0] == GOOD


def test_context_decides(spark):
    """A form with two possible repairs takes the one that its neighbours go with."""
    texts = spark.createDataFrame([(f"t{i}", "ad mare magnum it") for i in range(40)] + [(f"u{i}", "cum more suo it") for i in range(60)], "page_id string, text string")
    wrong = spark.createDataFrame([("mcre", "mare", 1, 40), ("mcre", "more", 1, 60)], "word string, fix string, n bigint, n_fix bigint")
    odd = "array<struct<line:int,rest:int,word:string,before:string,after:string>>"
    s = spark.createDataFrame([("p", [(1, 0, "mcre", "ad", "magnum")]), ("q", [(1, 0, "mcre", "", "")])], f"page_id string, unknown {odd}")
    assert values(repair.chosen_repairs(texts, s, wrong).select("page_id", "fix")) == [("p", "mare"), ("q", "more")]


def test_context_decides_for_any_number_of_forms(spark):
    """The bigrams found by a join, which many ambiguous forms need, choose as those of a collected set."""
    texts = spark.createDataFrame([(f"t{i}", "ad mare magnum it") for i in range(40)] + [(f"u{i}", "cum more suo it") for i in range(60)], "page_id string, text string")
    wrong = spark.createDataFrame([("mcre", "mare", 1, 40), ("mcre", "more", 1, 60)], "word string, fix string, n bigint, n_fix bigint")
    odd = "array<struct<line:int,rest:int,word:string,before:string,after:string>>"
    s = spark.createDataFrame([("p", [(1, 0, "mcre", "ad", "")]), ("q", [(1, 0, "mcre", "", "")]), ("r", [(1, 0, "mcre", "", "magnum")])], f"page_id string, unknown {odd}")
    assert values(repair.chosen_repairs(texts, s, wrong, most_ambiguous=1).select("page_id", "fix")) == [("p", "mare"), ("q", "more"), ("r", "mare")]


def test_empty_and_long(spark, books):
    assert repair.noisy_lines(pages(spark, []), books).count() == 0
    assert repair.repaired_pages(pages(spark, [("n", "b", 1.0, None)]), books).count() == 0
    long = "\n".join([GOOD] * 3000)
    assert repair.noisy_lines(pages(spark, [("l", "b", 1.0, long)]), books).count() == 0
