"""Problem 4."""

import datetime as dt
import random

from scriptorium.llm import truncation
from tests.conftest import values

SCHEMA = "id string, book_id string, page_number double, updated_at timestamp, ocr struct<data:string,source:string>, translation struct<data:string,source:string>, field string"
FULL = "Mare est coloris viridis et in bibliotheca vetere granum gignit. Cur lux timeatur, cum etiam anima corpus sequatur?"
T0, T1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)


def own(i, text):
    """A text with a beginning of its own, so that no test value is the beginning of another."""
    return text and f"Nomen {i} scribit quod mons {i} per quinque horas cum porta {i} manet. " + text


def pages(spark, rows):
    return spark.createDataFrame([(i, b, n, t, (o, "ai") if o is not False else None, (x, "batch") if x is not False else None, "clash") for i, b, n, t, o, x in rows], SCHEMA)


def cut(spark, rows):
    return {(r.page_id, r.field): r.why for r in truncation.judged_values(pages(spark, rows)).where("cut").collect()}


def test_ends(spark):
    rows = [
        ("whole", "b", 1.0, T0, own(1, FULL), own(2, FULL + "\n\n- 5 -")),
        ("mid", "b", 2.0, T0, own(3, FULL + " Deinde corpus per"), None),
        ("goes", "b", 3.0, T0, own(4, FULL + " Deinde corpus per"), ""),
        ("on", "b", 4.0, T0, "DE LUCE\n7\nsex horas purga et salem serva. " + FULL, False),
        ("dots", "c", 1.0, T0, own(5, FULL + " Dein..."), own(6, FULL + " Dein�")),
        ("short", "c", 2.0, T0, "Mare est coloris", None),
        ("foot", "c", 3.0, T0, own(7, FULL + " Deinde corpus per\nfol. 5r"), None),
        ("none", "c", 4.0, T0, False, False),
    ]
    assert cut(spark, rows) == {("mid", "ocr"): "end", ("dots", "ocr"): "mark", ("dots", "translation"): "end"}


def test_latest_state_counts_and_copies_once(spark):
    rows = [("p", "b", 1.0, T0, own(1, FULL + " Deinde corpus per"), False), ("p", "b", 1.0, T1, FULL, False), ("p", "b", 1.0, T1, FULL, False), (None, "b", 2.0, T1, FULL + " Deinde", False)]
    assert truncation.judged_values(pages(spark, rows)).count() == 1
    assert set(cut(spark, rows)) == set()


def test_prefix_of_a_longer_copy(spark):
    """Longer copies prove a cut within a sentence, or of the same page; not that a whole text with which
    another one begins was cut. Precision and recall by reason, on planted values."""
    rows, want = [], {}
    for i in range(30):
        whole, longer = own(i, FULL), own(i, FULL + " Dosis septem grana ne excedat.")
        rows.append((f"whole{i}", "b", 10.0 * i, T0, whole, False))
        rows.append((f"long{i}", "c", 10.0 * i, T0, longer, False))
        rows.append((f"open{i}", "d", 2.0 * i, T0, longer[:-9], False))  # the next page goes on, but not with this text
        rows.append((f"next{i}", "d", 2.0 * i + 1, T0, "minor est luna. " + own(100 + i, FULL), False))
        rows.append((f"late{i}", "e", 10.0 * i, T0, own(200 + i, FULL + " Dosis septem grana ne excedat."), False))
        rows.append((f"late{i}", "e", 10.0 * i, T1, own(200 + i, FULL), False))
        want |= {(f"open{i}", "ocr"): "prefix", (f"late{i}", "ocr"): "state"}
    assert cut(spark, rows) == want


def test_marks_and_limits_hold_though_the_next_page_goes_on(spark):
    fill = lambda i, n: own(i, FULL * 3)[: n - 1].replace("...", "   ") + "x"
    rows = []
    for i in range(40):  # a source that cuts at 200 characters, among texts of other lengths
        rows.append((f"limit{i:02}", "b", 2.0 * i, T0, fill(i, 200), False))
        rows.append((f"after{i:02}", "b", 2.0 * i + 1, T0, "minor est luna. " + own(100 + i, FULL), False))
        rows.append((f"runs{i:02}", "c", 2.0 * i, T0, fill(300 + i, 180 + i), False))
        rows.append((f"on{i:02}", "c", 2.0 * i + 1, T0, "minor est luna. " + own(400 + i, FULL), False))
    rows += [("dots", "d", 1.0, T0, own(900, FULL + " Deinde..."), False), ("then", "d", 2.0, T0, "minor est luna. " + FULL, False)]
    rows += [("roman", "f", 1.0, T0, own(901, FULL + " Deinde cor"), False), ("head", "f", 2.0, T0, "xii   LIBER III.\nMinor est luna. " + FULL, False)]
    rows += [("runs", "g", 1.0, T0, own(902, FULL + " Deinde cor"), False), ("tail", "g", 2.0, T0, "De Luce Et   cclxxxviii\nminor est luna. " + FULL, False)]
    found = cut(spark, rows)
    assert {k[0]: w for k, w in found.items() if w == "limit"} == {f"limit{i:02}": "limit" for i in range(40)} | {"runs20": "limit"}
    assert {k[0]: w for k, w in found.items() if w != "limit"} == {"dots": "mark", "roman": "end"}


def test_printed_numbers_of_any_length(spark):
    """A book of over 9,999 pages, or over 499 in Roman digits, prints longer numbers; they are no text."""
    rows = []
    for i, number in enumerate(["[26880]", "- 123456 -", "fol. 10021v", "l0021.", "dxii", "MMDCCCLXXXVIII"]):
        rows.append((f"foot{i}", f"b{i}", 1.0, T0, own(i, FULL) + f"\n\n{number}", False))
        rows.append((f"open{i}", f"b{i}", 2.0, T0, own(20 + i, FULL + " Deinde corpus per") + f"\n{number}", False))
        rows.append((f"goes{i}", f"b{i}", 3.0, T0, own(40 + i, FULL + " Deinde corpus per"), False))
        rows.append((f"next{i}", f"b{i}", 4.0, T0, f"{number}   CLAVIS MANUS.\nsex horas purga. " + FULL, False))
        rows.append((f"word{i}", f"c{i}", 1.0, T0, own(60 + i, FULL) + "\nDeinde\n" + ["di", "mi", "mild", "vidi", "modo", "dici"][i], False))
    assert cut(spark, rows) == {(f"word{i}", "ocr"): "end" for i in range(6)}


def test_prefixes_against_brute_force(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("ab") for _ in range(40)) for _ in range(3)]
    texts = {b[: rng.randrange(8, 40)] + rng.choice(["", "x"]) for b in base for _ in range(40)} | {"", "abc"}
    df = spark.createDataFrame([(k, t) for t in texts for k in ("p", "q")] * 2 + [("p", None)], "k string, text string").repartition(4)
    want = sorted((k, t) for k in ("p", "q") for t in texts if len(t) >= 8 and any(u != t and u.startswith(t) for u in texts))
    for narrow in (100_000, 0):
        assert values(truncation.strict_prefixes(df, ["k"], size=8, narrow_rows=narrow)) == want
    assert truncation.strict_prefixes(df.where("false"), ["k"]).count() == 0


def test_rates(spark):
    rows = [(f"p{i}", "b", float(i), T0, own(i, FULL if i % 2 else FULL + " Deinde"), False) for i in range(4)]
    r = truncation.cut_rates(truncation.judged_values(pages(spark, rows))).collect()
    assert [(x.source, x.field, x.n_values, x.n_cut, x.cut_rate) for x in r] == [("ai", "ocr", 4, 2, 0.5)]
    assert truncation.judged_values(pages(spark, [])).count() == 0
