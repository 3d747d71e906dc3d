import hashlib

import pytest

from condeval.llm import chat as C

DDL = "conv_id bigint, turn int, role string, text string, n_turns string"
TEXTS = ["plain", "", "\\### Assistant: </turn> ok", "a\\", "\\\\### x", "</turn>\n### User: hi", "####", "</turn></turn>\n", "é😀\n", "\\</turn>"]


def test_escapes_are_reversible():
    for text in [*TEXTS, *(a + b for a in TEXTS for b in TEXTS)]:
        assert C.unescape(C.escape(text)) == text


@pytest.mark.parametrize("text", TEXTS)
def test_reader_gets_back_what_was_said(text):
    reader = C.Reader()
    turns = [("user", text), ("assistant", text), ("a: b###\\", text), ("assistant", "x" + text)]
    for piece, masked in C.compiled(C.TEMPLATE)({"messages": iter([{"role": r, "text": t} for r, t in turns])}):
        reader.add(piece, masked)
    sha = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    n, turned, size, loss, _ = reader.result()
    assert (n, turned) == (4, sha(f"{r}\n{t}\n" for r, t in turns))
    assert (size, loss) == (2 * len(text) + 1, sha([text, "x" + text]))


def test_language():
    show = lambda template, **names: "".join(p for p, _ in C.compiled(template)(names))
    assert show("{{ 'a' + \"b\" | upper }}{{ x.y['z'] }}{{ gone }}{{ 3 }}", x={"y": {"z": "!"}}) == "aB!3"
    assert show("{% for m in l %}{% if loop.first %}<{% elif m == 'c' %}({% else %}-{% endif %}{{ m }}{% endfor %}", l="abc") == "<a-b(c"
    assert show("{% if not a and (b or 'x' == 'y') %}1{% else %}2{% endif %}", a="", b="t") == "1"
    masked = [*C.compiled("a{% generation %}{{ t }}{% endgeneration %}b")({"t": "x"})]
    assert masked == [("a", False), ("x", True), ("b", False)]


def test_constants_are_folded():
    tree = C.fold(C.parse("a{{ 'b' + 'c' | upper }}{% if 1 == 1 %}d{% else %}{{ x }}{% endif %}{% if 'a' == 'b' %}{{ y }}{% endif %}e"))
    assert tree == (C.Show(C.Const("abCde")),)


@pytest.mark.parametrize(
    "template",
    ["{% if a %}", "{{ }}", "{{ a.b( }}", "{% while a %}", "{{ a | eval }}", "{{ 'a }}", "{% for 1 in a %}{% endfor %}", "{% endif %}", "{{ a b }}"],
)
def test_what_is_not_of_the_language_is_refused(template):
    with pytest.raises(C.TemplateError):
        C.parse(template)


def test_names_reach_no_attributes():
    assert "".join(p for p, _ in C.compiled("{{ x.upper }}{{ x['__class__'] }}")({"x": "s"})) == ""
    with pytest.raises(C.TemplateError):
        C.parse("{{ x.__class__ }}")


def test_operators(spark):
    rows = [(k, i, ["user", "assistant"][i % 2], t, "x") for k in (1, 2) for i, t in enumerate(TEXTS)]
    rows += [(3, 0, None, None, "x"), (3, None, "assistant", "first", "x"), (3, 0, None, None, "x"), (None, 1, "user", "q", "x")]
    rows += [(4, i, "assistant", "long " * 20_000, "x") for i in range(3)]
    table = spark.createDataFrame(rows, DDL).repartition(5)
    got = {r.conv_id: r for r in C.read_back(table).collect()}
    whole = {r.conv_id: r for r in C.formatted(table).collect()}
    groups = {}
    for k, turn, role, text, _ in rows:
        groups.setdefault(k, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(whole) == set(groups)
    for k, turns in groups.items():
        turns.sort()
        said = "".join(t for *_, r, t in turns if r == "assistant")
        r = got[k]
        assert r.n_turns == len(turns) and r.loss_chars == len(said) and r.formatted_chars == len(whole[k].text)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for *_, a, t in turns).encode()).hexdigest()
        assert "".join(C.unescape(whole[k].text[s.start : s.stop]) for s in whole[k].loss) == said
    assert C.read_back(table.limit(0)).count() == 0 and C.formatted(table.limit(0)).count() == 0
