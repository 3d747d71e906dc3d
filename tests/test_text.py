import re

import pytest
from pyspark.sql import functions as F

from condeval.functions.text import fill_template, locate_spans, parse_labels, same_surface

ANSWERS = {
    "<think>LITERAL maybe</think> final label: figurative": "FIGURATIVE",
    "it is literally figurative": "LITERAL",
    "FINAL LABEL: <FIGURATIVE>": "FIGURATIVE",
    "": "UNPARSEABLE",
    "no verdict": "UNPARSEABLE",
    "<think> LITERAL and no end": "LITERAL",
    "Final\nLabel : INCOHERENT then FINAL LABEL: LITERAL": "INCOHERENT",
    "literal, figurative, incoherent": "INCOHERENT",
    "<think>a</think>x<think>\nLITERAL\n</think> figurative": "FIGURATIVE",
    "<THINK>LITERAL</THINK> figurative": "LITERAL",
}


def test_parse_labels(frame):
    rows = frame([(a,) for a in [*ANSWERS, None]], "answer string")
    got = {r["answer"]: r["label"] for r in parse_labels(rows, "answer").collect()}
    assert got == {**ANSWERS, None: None}


def _token(text, span):
    start = text.lower().find(span.lower())
    if start < 0 or not span:
        return None
    last = start + len(span) - 1
    ends = [m.end() for m in re.finditer(r"\S+", text)]
    starts = [m.start() for m in re.finditer(r"\S+", text)]
    inside = [i for i, (s, e) in enumerate(zip(starts, ends)) if s <= last]
    return inside[-1] if inside else None


SPANS = [
    ("She broke the ice at last", "the ice"),
    ("She broke THE\nICE  at last", "ice"),
    ("She broke it", "the ice"),
    ("unbreakable", "break"),
    ("", "x"),
    ("a b a b", "b"),
    ("  lead and trail  ", "lead "),
    ("a.b c", "."),
]


def test_locate_spans(frame):
    rows = frame(SPANS, "text string, span string")
    for r in locate_spans(rows, "text", "span").collect():
        hit = r["text"].lower().find(r["span"].lower())
        assert r["start"] == (hit + 1 if hit >= 0 else None)
        assert r["token"] == _token(r["text"], r["span"]), (r["text"], r["span"])


def test_empty_and_missing_spans(frame):
    rows = frame([("abc", ""), ("abc", None), (None, "a")], "text string, span string")
    assert [r["token"] for r in locate_spans(rows, "text", "span").collect()] == [None, None, None]


def test_template_is_filled_once(frame):
    rows = frame([("{prefix}", "p{{", "c")], "expression string, prefix string, continuation string")
    prompt = fill_template(
        "{{x}} {expression}|{prefix}|{continuation}|{expression}",
        expression="expression",
        prefix="prefix",
        continuation="continuation",
    )
    assert rows.select(prompt).first()[0] == "{x} {prefix}|p{{|c|{prefix}"


def test_template_with_a_missing_value_is_null(frame):
    rows = frame([("a", None)], "x string, y string")
    assert rows.select(fill_template("{x} {y}", x="x", y="y")).first()[0] is None


def test_template_rejects_unknown_places():
    with pytest.raises(ValueError):
        fill_template("{x}", y=None)


def test_same_surface_drops_nulls(frame):
    rows = frame([("See Red", "see red"), ("a", "b"), (None, "a"), ("a", None)], "a string, b string")
    assert rows.filter(same_surface(F.col("a"), "b")).count() == 1
