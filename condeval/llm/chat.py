"""Chat formatting by a template compiler.

A template in a small language is parsed into a syntax tree, constants are folded, and
Python closures are generated that render a conversation. The language is a sandbox:
it reads the names it is given and keys of mappings, has no calls, and its only filters
are those of ``FILTERS``.

    {{ expression }}   {% for m in messages %} {% endfor %}
    {% if e %} {% elif e %} {% else %} {% endif %}   {% generation %} {% endgeneration %}

Expressions have strings, integers, names, ``a.b`` and ``a['b']``, ``==``, ``!=``, ``+``,
``not``, ``and``, ``or`` and ``value | filter``. Text inside ``generation`` is under the
loss mask. Rendering is lazy: messages are read one by one and pieces come out as they
are made, so a conversation of any length is formatted in the memory of a few turns.

The template here starts a turn with ``### Role: `` and ends it with ``</turn>`` and a
line feed. The escape filter puts a backslash before each backslash, ``###`` and
``</turn>`` in a text, which a reader takes off again.

Defined cases: NULL texts and roles count as empty; rows of a conversation go by turn,
then role, then text, NULLs first; rows that repeat are turns of their own; a NULL
conv_id is one conversation; an empty table gives an empty table; other columns are
neither read nor returned.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "###", "</turn>"
TEMPLATE = (
    "{% for m in messages %}"
    "### {{ m.role | escape_name }}: "
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}"
    "</turn>\n"
    "{% endfor %}"
)

_SPECIAL = re.compile(r"\\|###|</turn>")
_NAME_SPECIAL = re.compile(r"\\|###|</turn>|:")


def escape(text: str) -> str:
    return _SPECIAL.sub(lambda found: "\\" + found[0], text)


def unescape(text: str) -> str:
    return re.sub(r"(?s)\\(.)", r"\1", text)


FILTERS: dict[str, Callable[[str], str]] = {
    "escape": escape,
    "escape_name": lambda name: _NAME_SPECIAL.sub(lambda found: "\\" + found[0], name),
    "trim": str.strip,
    "upper": str.upper,
    "lower": str.lower,
}


# The syntax tree. Expressions first, then what stands in a template.
@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: object
    key: str


@dataclass(frozen=True)
class Apply:
    operator: str
    values: tuple


@dataclass(frozen=True)
class Show:
    value: object


@dataclass(frozen=True)
class Loop:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class Choice:
    branches: tuple  # of (condition, body)


@dataclass(frozen=True)
class Generation:
    body: tuple


class TemplateError(ValueError):
    """A template that isn't of the language."""


_TAGS = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.DOTALL)
_SYMBOLS = re.compile(r"\s*(?:('(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\")|(\d+)|([A-Za-z]\w*)|(==|!=|[.|+()\[\]]))", re.DOTALL)


class _Expression:
    """Recursive descent over one expression."""

    def __init__(self, source: str) -> None:
        self.symbols: list[tuple[str, str]] = []
        at, source = 0, source.rstrip()
        while at < len(source):
            found = _SYMBOLS.match(source, at)
            if not found:
                raise TemplateError(f"can't read {source[at:]!r}")
            kind = ("text", "number", "word", "sign")[found.lastindex - 1]
            self.symbols.append((kind, found[found.lastindex]))
            at = found.end()
        self.at = 0

    def take(self, *wanted: str) -> str | None:
        if self.at < len(self.symbols) and self.symbols[self.at][0] != "text" and self.symbols[self.at][1] in wanted:
            self.at += 1
            return self.symbols[self.at - 1][1]
        return None

    def need(self, kind: str) -> str:
        if self.at >= len(self.symbols) or self.symbols[self.at][0] != kind:
            raise TemplateError(f"a {kind} is missing")
        self.at += 1
        return self.symbols[self.at - 1][1]

    def whole(self):
        value = self.chain(("or",), lambda: self.chain(("and",), self.negation))
        if self.at < len(self.symbols):
            raise TemplateError(f"unexpected {self.symbols[self.at][1]!r}")
        return value

    def chain(self, operators: tuple[str, ...], part: Callable):
        value = part()
        while operator := self.take(*operators):
            value = Apply(operator, (value, part()))
        return value

    def negation(self):
        if self.take("not"):
            return Apply("not", (self.negation(),))
        return self.chain(("==", "!="), lambda: self.chain(("+",), self.filtered))

    def filtered(self):
        value = self.postfix()
        while self.take("|"):
            name = self.need("word")
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            value = Apply("|" + name, (value,))
        return value

    def postfix(self):
        value = self.atom()
        while sign := self.take(".", "["):
            if sign == ".":
                value = Item(value, self.need("word"))
            else:
                value = Item(value, _text(self.need("text")))
                if not self.take("]"):
                    raise TemplateError("a ] is missing")
        return value

    def atom(self):
        if self.take("("):
            value = self.chain(("or",), lambda: self.chain(("and",), self.negation))
            if not self.take(")"):
                raise TemplateError("a ) is missing")
            return value
        if self.at < len(self.symbols):
            kind, symbol = self.symbols[self.at]
            self.at += 1
            if kind == "text":
                return Const(_text(symbol))
            if kind == "number":
                return Const(int(symbol))
            if kind == "word" and symbol not in ("and", "or", "not", "in"):
                return Name(symbol)
        raise TemplateError("a value is missing")


def _text(symbol: str) -> str:
    return re.sub(r"(?s)\\(.)", lambda found: {"n": "\n", "t": "\t"}.get(found[1], found[1]), symbol[1:-1])


def parse(template: str) -> tuple:
    """The syntax tree of a template."""
    parts: list[tuple[str, str]] = []
    at = 0
    for found in _TAGS.finditer(template):
        parts.append(("text", template[at : found.start()]))
        parts.append(("show", found[1]) if found[1] is not None else ("do", found[2].strip()))
        at = found.end()
    parts.append(("text", template[at:]))
    stream = iter(parts)

    def body(ends: tuple[str, ...]) -> tuple[tuple, str]:
        nodes: list = []
        for kind, content in stream:
            if kind == "text":
                if content:
                    nodes.append(Show(Const(content)))
                continue
            if kind == "show":
                nodes.append(Show(_Expression(content).whole()))
                continue
            word, _, rest = content.partition(" ")
            if word in ends:
                return tuple(nodes), content
            if word == "for":
                found = re.fullmatch(r"\s*([A-Za-z]\w*)\s+in\s+(.*)", rest, re.DOTALL)
                if not found:
                    raise TemplateError(f"can't read {content!r}")
                inner, _ = body(("endfor",))
                nodes.append(Loop(found[1], _Expression(found[2]).whole(), inner))
            elif word == "if":
                branches, condition, end = [], _Expression(rest).whole(), ""
                while end != "endif":
                    inner, end = body(("elif", "else", "endif") if condition != Const(True) or end == "" else ("endif",))
                    branches.append((condition, inner))
                    condition = _Expression(end[4:]).whole() if end.startswith("elif") else Const(True)
                nodes.append(Choice(tuple(branches)))
            elif word == "generation":
                nodes.append(Generation(body(("endgeneration",))[0]))
            else:
                raise TemplateError(f"unexpected {content!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return tuple(nodes), ""

    return body(())[0]


def _operated(operator: str, values: list):
    if operator == "not":
        return not values[0]
    if operator == "==":
        return values[0] == values[1]
    if operator == "!=":
        return values[0] != values[1]
    if operator == "+":
        return values[0] + values[1]
    return FILTERS[operator[1:]]("" if values[0] is None else str(values[0]))


def fold(node):
    """The same tree with constant parts worked out and neighbouring texts joined."""
    if isinstance(node, tuple):
        out: list = []
        for part in map(fold, node):
            for one in part if isinstance(part, tuple) else (part,):
                both = out and isinstance(one, Show) and isinstance(out[-1], Show)
                if both and isinstance(one.value, Const) and isinstance(out[-1].value, Const):
                    out[-1] = Show(Const(_shown(out[-1].value.value) + _shown(one.value.value)))
                else:
                    out.append(one)
        return tuple(out)
    if isinstance(node, Apply):
        values = tuple(map(fold, node.values))
        if node.operator in ("and", "or") and isinstance(values[0], Const):
            return values[1] if bool(values[0].value) == (node.operator == "and") else values[0]
        if node.operator not in ("and", "or") and all(isinstance(v, Const) for v in values):
            return Const(_operated(node.operator, [v.value for v in values]))
        return Apply(node.operator, values)
    if isinstance(node, Item):
        return Item(fold(node.of), node.key)
    if isinstance(node, Show):
        return Show(fold(node.value))
    if isinstance(node, Loop):
        return Loop(node.name, fold(node.over), fold(node.body))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    if isinstance(node, Choice):
        kept: list = []
        for condition, inner in node.branches:
            condition = fold(condition)
            if isinstance(condition, Const) and not condition.value:
                continue
            kept.append((condition, fold(inner)))
            if isinstance(condition, Const):
                break
        if kept and isinstance(kept[0][0], Const):
            return kept[0][1]
        return Choice(tuple(kept)) if kept else ()
    return node


def _shown(value) -> str:
    return "" if value is None else str(value)


def _evaluator(node) -> Callable[[dict], object]:
    if isinstance(node, Const):
        return lambda scope, value=node.value: value
    if isinstance(node, Name):
        return lambda scope, name=node.name: scope.get(name)
    if isinstance(node, Item):
        of, key = _evaluator(node.of), node.key
        return lambda scope: found.get(key) if isinstance(found := of(scope), dict) else None
    parts = [_evaluator(v) for v in node.values]
    if node.operator == "and":
        return lambda scope: parts[0](scope) and parts[1](scope)
    if node.operator == "or":
        return lambda scope: parts[0](scope) or parts[1](scope)
    return lambda scope, operator=node.operator: _operated(operator, [p(scope) for p in parts])


Pieces = Iterator[tuple[str, bool]]


def _renderer(nodes: tuple, masked: bool) -> Callable[[dict], Pieces]:
    """A closure that yields a tree's pieces, each with whether the loss mask covers it."""
    closures = []
    for node in nodes:
        if isinstance(node, Show):
            value = _evaluator(node.value)
            closures.append(lambda scope, value=value: ((_shown(value(scope)), masked),))
        elif isinstance(node, Generation):
            closures.append(_renderer(node.body, True))
        elif isinstance(node, Loop):
            closures.append(_looping(node, masked))
        else:
            branches = [(_evaluator(c), _renderer(b, masked)) for c, b in node.branches]
            closures.append(
                lambda scope, branches=branches: next((b(scope) for c, b in branches if c(scope)), iter(()))
            )

    def render(scope: dict) -> Pieces:
        for closure in closures:
            yield from closure(scope)

    return render


def _looping(node: Loop, masked: bool) -> Callable[[dict], Pieces]:
    over, body = _evaluator(node.over), _renderer(node.body, masked)

    def render(scope: dict) -> Pieces:
        for number, value in enumerate(over(scope) or ()):
            yield from body(scope | {node.name: value, "loop": {"index": number + 1, "first": number == 0}})

    return render


@lru_cache(maxsize=16)
def compiled(template: str) -> Callable[[dict], Pieces]:
    """A closure from names to pieces of text, each with its place under the loss mask."""
    return _renderer(fold(parse(template)), False)


# Reading back.
_TURN = re.compile(r"(?s)### ((?:[^\\:]|\\.)*+): ((?:[^\\<]|\\.|<(?!/turn>))*+)</turn>\n")


@dataclass
class Reader:
    """Reads a formatted conversation as its pieces come, a turn at a time."""

    def __init__(self) -> None:
        self.turns, self.chars, self.loss_chars = 0, 0, 0
        self.turn_hash, self.loss_hash = hashlib.sha256(), hashlib.sha256()
        self.waiting: list[str] = []
        self.under: list[str] = []

    def add(self, piece: str, masked: bool) -> None:
        self.chars += len(piece)
        self.waiting.append(piece)
        if masked:
            self.under.append(piece)
        elif piece.endswith(CLOSE + "\n"):
            self.turn()

    def turn(self) -> None:
        found = _TURN.fullmatch("".join(self.waiting))
        if not found:
            return  # the text so far ends like a turn, but is none yet
        self.waiting = []
        self.turns += 1
        role, text = unescape(found[1]), unescape(found[2])
        self.turn_hash.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        loss = unescape("".join(self.under))
        self.under = []
        self.loss_chars += len(loss)
        self.loss_hash.update(loss.encode("utf-8", "surrogatepass"))

    def result(self) -> tuple[int, str, int, str, int]:
        if self.waiting:
            raise ValueError("the formatted text doesn't end with a turn")
        return self.turns, self.turn_hash.hexdigest(), self.loss_chars, self.loss_hash.hexdigest(), self.chars


def _conversations(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[dict]]]:
    """Conversations of sorted rows, each with its messages as a stream."""

    def rows():
        for batch in batches:
            yield from zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)

    for key, group in groupby(rows(), key=lambda row: row[0]):
        yield key, ({"role": role or "", "text": text or ""} for _, role, text in group)


def _by_conversation(table: DataFrame, key: str) -> DataFrame:
    rows = table.select(F.col(key).alias("key"), "turn", "role", "text")
    return rows.repartition("key").sortWithinPartitions("key", "turn", "role", "text").select("key", "role", "text")


def formatted(table: DataFrame, template: str = TEMPLATE, key: str = "conv_id") -> DataFrame:
    """(key, text, loss): each conversation's text, and its (start, stop) places under the loss mask."""

    def run(batches):
        kind = None
        for found, messages in _conversations(batches):
            parts, spans, at = [], [], 0
            for piece, masked in compiled(template)({"messages": messages}):
                if masked and spans and spans[-1]["stop"] == at:
                    spans[-1]["stop"] += len(piece)
                elif masked:
                    spans.append({"start": at, "stop": at + len(piece)})
                parts.append(piece)
                at += len(piece)
            span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
            yield pa.RecordBatch.from_arrays(
                [pa.array([found], kind or pa.int64()), pa.array(["".join(parts)]), pa.array([spans], pa.list_(span))],
                names=["key", "text", "loss"],
            )

    rows = _by_conversation(table.withColumn(key, F.col(key).cast("bigint")), key)
    return rows.mapInArrow(
        run, "key bigint, text string, loss array<struct<start: bigint, stop: bigint>>"
    ).withColumnRenamed("key", key)


def read_back(table: DataFrame, template: str = TEMPLATE, key: str = "conv_id") -> DataFrame:
    """Format each conversation and read its turns and loss text back from the output.

    (key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars); pieces go
    from the template to the reader as they are made.
    """
    names = ["key", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def batch(rows):
        columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def run(batches):
        rows = []
        for found, messages in _conversations(batches):
            reader = Reader()
            for piece, masked in compiled(template)({"messages": messages}):
                reader.add(piece, masked)
            rows.append((found, *reader.result()))
            if len(rows) >= 4096:
                yield batch(rows)
                rows = []
        if rows:
            yield batch(rows)

    rows = _by_conversation(table.withColumn(key, F.col(key).cast("bigint")), key)
    return rows.mapInArrow(
        run,
        "key bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    ).withColumnRenamed("key", key)
