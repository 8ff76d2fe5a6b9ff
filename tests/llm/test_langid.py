"""Problem 3."""

import pytest

from scriptorium.llm import langid
from scriptorium.session import table

DATA = "/root/testdata/sf0.001"
LA = "Quidam dicunt aquam filiam veneni esse, alii negant. Cur lux timeatur, cum etiam anima corpus sequatur?"
DE = "Auf dieser Tafel sieht man das Licht, die Tinktur und das Blei."


@pytest.fixture(scope="module")
def samples(spark):
    return table(spark, DATA, "language_samples")


@pytest.fixture(scope="module")
def model(samples):
    return langid.fit([(r.lang, r.text) for r in samples.collect()])


def test_held_out_accuracy(samples):
    rows = [(r.lang, r.text, r.sample_id) for r in samples.collect()]
    train, held = [r[:2] for r in rows if r[2] % 4], [r for r in rows if not r[2] % 4]
    m = langid.fit(train)
    p = m.predict([langid.WORD.findall(t.lower()) for _, t, _ in held]).argmax(axis=1)
    right = sum(m.langs[k] == lang for k, (lang, _, _) in zip(p, held))
    assert right / len(held) >= 0.9


def test_codewords_are_apart():
    code = langid.codewords(7)
    gaps = [int((code[i] != code[j]).sum()) for i in range(7) for j in range(i)]
    assert min(gaps) >= 7 and all(abs(code[:, b].sum()) < 7 for b in range(code.shape[1]))


def test_segments(spark, model):
    long = (LA + " ") * 300
    rows = [("la", LA, 1), ("mix", f"{LA} {DE} {LA}", 2), ("null", None, 3), ("empty", "", 4), ("short", "Mare est.", 5), ("long", long, 6), ("marks", "<page-num>5</page-num>\n" + "- 5 -\n" * 20, 7)]
    df = spark.createDataFrame(rows, "page_id string, text string, lang int")
    out = langid.segment_pages(df, model).orderBy("page_id", "seg").collect()
    got = {}
    for r in out:
        got.setdefault(r.page_id, []).append((r.lang, r.main))
    assert got["la"] == [("la", True)] and got["long"] == [("la", True)]
    assert got["mix"] == [("la", True), ("de", False), ("la", True)]
    assert not {"null", "empty", "short", "marks"} & set(got)
    assert all(0 <= r.confidence <= 1 for r in out)
    assert langid.segment_pages(df.where("false"), model).count() == 0


def test_model_survives_pickling(model):
    import pickle

    m = pickle.loads(pickle.dumps(model))
    assert m.langs[int(m.predict([langid.WORD.findall(DE.lower())]).argmax())] == "de"


def test_bounded_sample(spark, samples):
    texts = spark.createDataFrame([(f"p{i}", " ".join([LA] * 3)) for i in range(50)] + [("n", None)], "page_id string, text string")
    labels = spark.createDataFrame([(f"p{i}", "la", 300) for i in range(50)] + [("n", None, None)], "page_id string, lang string, n int")
    got = langid.labelled_sentences(samples, texts, labels, per_language=5)
    assert 140 <= len(got) <= 140 + 5 * 6
