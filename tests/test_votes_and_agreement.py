import pytest
from golden import RATINGS

from condeval.operators import agreement as A
from condeval.operators import votes as M
from condeval.sources.verdicts import read_verdicts

ROWS = "item string, c double, label string"


def test_majority_is_strict(frame):
    rows = [("a", 0.0, v) for v in ("LITERAL", "LITERAL", "FIGURATIVE", None)]
    rows += [("b", 0.0, v) for v in ("LITERAL", "LITERAL", "FIGURATIVE", "FIGURATIVE")]
    rows += [("c", 0.0, None), (None, 0.0, "LITERAL")]
    got = {r["item"]: (r["n_labelled"], r["majority"]) for r in M.majority_labels(frame(rows, ROWS), ["item", "c"]).collect()}
    assert got == {"a": (3, "LITERAL"), "b": (4, None), "c": (0, None)}


def test_flips(frame):
    rows = [("a", 0.0, "FIGURATIVE"), ("a", -1.0, "LITERAL")]
    rows += [("b", 0.0, "FIGURATIVE"), ("b", -1.0, "FIGURATIVE")]
    rows += [("c", 0.0, "FIGURATIVE"), ("c", -1.0, "LITERAL"), ("c", -1.0, "INCOHERENT")]
    rows += [("d", 0.0, "LITERAL"), ("d", -1.0, "FIGURATIVE"), ("e", 0.0, "FIGURATIVE"), ("e", 5.0, "LITERAL")]
    flips = M.label_flips(frame(rows, ROWS), ["item"], "c", -1.0)
    got = {r["item"]: (r["comparable"], r["flipped"]) for r in flips.collect()}
    assert got == {
        "a": (True, True),
        "b": (True, False),
        "c": (False, False),
        "d": (True, False),
        "e": (False, False),
    }
    summary = M.flip_summary(flips, "item").first()
    assert tuple(summary) == (5, 3, 1, 1)


@pytest.fixture
def ratings(frame):
    rows = [(h, j) for h, j, n in RATINGS for _ in range(n)]
    return frame(rows, "human_label string, label string")


def test_published_agreement(ratings):
    row = A.agreement(ratings).first()
    assert (row["n_pairs"], row["n_agree"]) == (86, 64)
    assert row["po"] == pytest.approx(0.7442, abs=5e-5)
    assert row["kappa"] == pytest.approx(0.4943, abs=5e-5)


def test_published_confusion(ratings):
    rates = {(r["human_label"], r["label"]): r["rate"] for r in A.confusion_rates(ratings).collect()}
    assert rates[("FIGURATIVE", "LITERAL")] == pytest.approx(16 / 43)
    assert rates[("LITERAL", "FIGURATIVE")] == pytest.approx(5 / 43)


def test_kappa_of_a_rater_with_itself(frame):
    rows = frame([(x, x) for x in "aabbc"], "human_label string, label string")
    assert A.agreement(rows).first()["kappa"] == pytest.approx(1)


def test_kappa_without_variation_is_null(frame):
    assert A.agreement(frame([("a", "a")] * 3, "human_label string, label string")).first()["kappa"] is None
    assert A.agreement(frame([], "human_label string, label string")).first()["po"] is None


def test_pairs_need_a_human_label(frame):
    rated = frame([(1, 0.0, "LITERAL"), (2, 0.0, None), (3, 1.2, "FIGURATIVE")], "k int, c double, human_label string")
    judged = frame([(1, "LITERAL"), (2, "LITERAL")], "k int, label string")
    pairs = A.pair_ratings(rated, judged, "k", keep=["c"])
    assert [tuple(r) for r in pairs.collect()] == [(1, 0.0, "LITERAL", "LITERAL")]
    coverage = {r["c"]: (r["n_rows"], r["n_rated"]) for r in A.rating_coverage(rated, "c").collect()}
    assert coverage == {0.0: (2, 1), 1.2: (1, 1)}


FIRST = """Here are my rows.

ROW 1 | see red
FIG: and he shouted
LIT: under the stage lamp
VERDICT: VALID

ROW 2 | on ice
FIG: the plan | waits
LIT: ROW boats froze
VERDICT: INVALID
REVISION: The team kept it on ice
ROW 3 | take a bow
FIG: a
LIT: b
VERDICT: VALID
SUMMARY: 2/3 valid, 1 flagged
"""
SECOND = """ROW 1 | see red\r
FIG: x\r
LIT: y\r
VERDICT: VALID\r
ROW 2 | on ice\r
FIG: x\r
LIT: y\r
VERDICT: INVALID\r
REVISION: Keep it on ice\r
ROW 3 | take a bow\r
FIG: x\r
LIT: y\r
VERDICT: INVALID\r
REVISION: r\r
ROW 4 | extra\r
FIG: x\r
LIT: y\r
VERDICT: VALID\r
"""


def test_verdict_files_to_merge(spark, tmp_path):
    for name, text in (("a", FIRST), ("b", SECOND)):
        (tmp_path / name).write_bytes(text.encode())
    one, two = (read_verdicts(spark, str(tmp_path / n)) for n in "ab")
    rows = {r["row_id"]: r for r in one.collect()}
    assert tuple(rows[2]) == (2, "on ice", "the plan | waits", "ROW boats froze", "INVALID", "The team kept it on ice")
    assert rows[1]["revision"] is None and rows[3]["verdict"] == "VALID"
    assert {r["row_id"]: r["expression"] for r in two.collect()}[4] == "extra"
    merged = A.merge_verdicts(one, two)
    got = {r["row_id"]: (r["agree"], r["decision"]) for r in merged.collect()}
    assert got == {1: (True, "keep"), 2: (True, "revise"), 3: (False, "revise"), 4: (False, "revise")}
    assert tuple(A.verdict_agreement(merged).first()) == (4, 2, 0.5, 1)
    assert tuple(A.annotator_summary(one).first()) == (2, 1, 3)
