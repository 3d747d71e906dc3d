import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from condeval.llm import language_id as L
from condeval.llm.queries import op1_language_id

WORDS = {"xx": "abra cadab rabra", "yy": "zuzu wuzzy zwuz", "zz": "mimo nimo omin"}


@pytest.fixture(scope="module")
def model():
    random = np.random.default_rng(0)
    texts, labels = [], []
    for label, words in WORDS.items():
        for _ in range(60):
            texts.append(" ".join(random.choice(words.split(), 8)).encode())
            labels.append(label)
    return L.train(texts, labels, passes=6)


def test_gradients_match_finite_differences():
    random = np.random.default_rng(1)
    weights = [random.normal(0, 0.5, s).astype(np.float64) for s in ((2, 257, 6), (2, 3, 6), (6, 2), (2,))]
    symbols = random.integers(95, 105, (5, 4)).astype(np.int16)
    symbols[3:, 1] = L.END
    target = np.array([0, 1, 1, 0])

    def loss(parts):
        found = L._softmax(L._log_odds(L.Model(("a", "b"), *parts), L._forward(L.Model(("a", "b"), *parts), symbols)))
        right = np.take_along_axis(found, np.broadcast_to(target, symbols.shape)[..., None], -1)[..., 0]
        return -(np.log(right) * (symbols != L.END)).sum() / (symbols != L.END).sum()

    given = L._gradients(L.Model(("a", "b"), *[w.astype(np.float32) for w in weights]), symbols, target)
    for part, gradient in enumerate(given):
        at = np.unravel_index(np.abs(gradient).argmax(), gradient.shape)
        step = 1e-2
        sides = []
        for sign in (1, -1):
            moved = [w.astype(np.float32).copy() for w in weights]
            moved[part][at] += sign * step
            sides.append(loss(moved))
        assert gradient[at] == pytest.approx((sides[0] - sides[1]) / (2 * step), rel=0.05, abs=1e-4)


def test_every_byte_is_labelled_and_pooled(model):
    text = "abra cadab é rabra " * 40
    labels = L.position_labels(model, text)
    assert len(labels) == len(text.encode()) and labels.count("xx") > 0.8 * len(labels)
    assert L.position_labels(model, "") == []


def test_cases(spark, model):
    rows = [
        (1, "abra cadab abra", "no"), (2, None, "no"), (3, "", "no"), (4, "12 34 !?", "no"), (None, "zuzu wuzzy zuzu", "no"),
        (5, "mimo omin nimo " * 20_000, "no"), (1, "abra cadab abra", "no"),
    ]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang_pred string")
    got = L.predicted(table, model).collect()
    assert sorted((str(r.doc_id), r.lang_pred) for r in got) == sorted(
        [("1", "xx"), ("1", "xx"), ("2", "und"), ("3", "und"), ("4", "und"), ("None", "yy"), ("5", "zz")]
    )
    assert all(0 <= r.score <= 1 and (r.score == 0) == (r.lang_pred == "und") for r in got)
    kept = L.kept(table, model, 0.34)
    assert kept.columns == table.columns and kept.count() == 4
    assert L.predicted(table.limit(0), model).count() == 0 and L.kept(table.limit(0), model, 0.5).count() == 0


def test_a_texts_numbers_do_not_depend_on_its_neighbours(model):
    texts = [b"abra cadab", b"zuzu" * 300, b"mimo nimo"]
    together = L.pooled(model, texts)
    for text, row in zip(texts, together, strict=True):
        assert np.array_equal(L.pooled(model, [text])[0], row)


def test_held_out_accuracy(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = L.predicted(documents, L.fitted(documents, texts=300)).join(documents, "doc_id")
    out = found.where(L.held_out("doc_id") & F.col("lang").isNotNull())
    right, of = out.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert of > 200 and right / of > 0.97


def test_nothing_to_learn_from(spark):
    table = spark.createDataFrame([(1, "abc", None)], "doc_id bigint, text string, lang string")
    with pytest.raises(ValueError, match="no labelled text"):
        L.fitted(table)


@pytest.mark.parametrize("rows", [[], [(1, "abc", None), (2, None, "xx"), (3, "12", "xx"), (None, "", None)]])
def test_without_a_usable_label_all_is_undetermined(spark, rows):
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = L.fitted_if_any(table)
    assert model.languages == ()
    found = L.predicted(table, model)
    assert found.columns == ["doc_id", "lang_pred", "score"]
    assert sorted(map(str, found.collect())) == sorted(f"Row(doc_id={k}, lang_pred='und', score=0.0)" for k, _, _ in rows)
    kept = L.kept(table, model, 0.0)
    assert kept.columns == table.columns and kept.count() == 0


def test_where_there_are_labels_the_model_is_the_same(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one, two = L.fitted(documents, texts=40), L.fitted_if_any(documents, texts=40)
    assert one.languages == two.languages and np.array_equal(one.reading, two.reading)


@pytest.mark.parametrize("rows", [[], [(1, "abc", None, "s", 3)]])
def test_query_on_tables_without_labels(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(
        str(tmp_path / "documents.parquet")
    )
    got = op1_language_id(spark, str(tmp_path))
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    assert [(r.doc_id, r.lang_pred, r.score) for r in got.collect()] == [(k, "und", 0.0) for k, *_ in rows]


def byte_by_byte(model, text):
    """A text's pooled probabilities, each number by itself: windows, steps, states and sums in plain Python."""
    hidden = model.states.shape[1]
    sums = [0.0] * len(model.languages)
    labels = []
    for start in range(0, len(text), L.WINDOW):
        window = list(text[start : start + L.WINDOW])
        symbols = window + [L.END] * (L.WINDOW - len(window))
        sides = []
        for side in range(2):
            state, states = [0.0] * hidden, {}
            for at in range(L.WINDOW) if side == 0 else reversed(range(L.WINDOW)):
                pre = [
                    float(model.inputs[side, symbols[at], k]) + sum(h * float(model.states[side, i, k]) for i, h in enumerate(state))
                    for k in range(2 * hidden)
                ]
                gate = [1 / (1 + math.exp(-2 * u)) for u in pre[:hidden]]
                state = [h + z * (math.tanh(c) - h) for h, z, c in zip(state, gate, pre[hidden:])]
                states[at] = state
            sides.append(states)
        for at in range(len(window)):
            both = sides[0][at] + sides[1][at]
            odds = [float(b) + sum(h * float(model.reading[i, k]) for i, h in enumerate(both)) for k, b in enumerate(model.bias)]
            weights = [math.exp(o - max(odds)) for o in odds]
            labels.append(model.languages[weights.index(max(weights))])
            sums = [s + w / sum(weights) for s, w in zip(sums, weights)]
    return [s / len(text) for s in sums], labels


def test_probabilities_equal_those_made_byte_by_byte(spark, model):
    texts = ["abra zuzu", "mimo " * 50, "é" * 47 + "a", "w" * L.WINDOW, "w" * (L.WINDOW + 1), "汉字 abra wuzzy " * 9, "z"]
    found = L.pooled(model, [t.encode() for t in texts])
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in L.predicted(table, model).collect()}
    for i, text in enumerate(texts):
        want, labels = byte_by_byte(model, text.encode())
        assert found[i] == pytest.approx(want, abs=1e-5)
        best = max(range(len(want)), key=lambda k: want[k])
        assert rows[i].lang_pred == model.languages[best] and rows[i].score == pytest.approx(want[best], abs=1e-5)
        assert sum(a == b for a, b in zip(L.position_labels(model, text), labels)) >= len(labels) - 1
