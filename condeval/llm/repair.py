"""Conversation structure repair by Hirschberg's divide and conquer.

A conversation's rows are kept, given another role, deleted, or have empty rows inserted
between them, so that their roles read system (if any), then user and assistant in turn. A
path of edits moves through four states: at the start, after a system, a user and an
assistant row. Forward cost vectors from the start and backward ones from the end meet at
the middle row; the state where they cross at the least cost is fixed, and both halves are
solved alike. Of several crossings, that of the audit least in ASCII order is taken: a
forward vector also keeps the order of its states' least audits. That is enough, since
audits up to a row hold as many letters of rows and end with one, so none begins another.

Long conversations are cut into slices of turns. A slice's least costs from each state to
each, with the order of their audits, are one more step of the same kind: slices are
summed up in parallel, their vectors meet first, and each slice is then solved alone. So a
conversation with most of all rows is spread over tasks; only its digest, which runs through
the repaired rows in order, is made by one task, as a stream.

Costs: keep 0, another role 2, insert 2, delete 3; a truncated row that stays adds 1. Blank
and duplicate rows must go.

Defined cases: NULL roles and texts are one space; NULL turns come first; rows of one turn are
ordered by role and text; a NULL conversation is one of its own; repeated rows are
duplicates; texts are read whole; a conversation without rows has zeros and the digest of
nothing; an empty table gives an empty table; other columns are neither read nor returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from condeval.llm.common import checkpointed

KEEP, REROLE, INSERT, DELETE, TRUNCATED = 0, 2, 2, 3, 1
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
INITIALS, OTHER = "sua", 3
LEGAL = {(0, 1), (1, 2), (2, 1)}
SOUND, CUT_OFF, GONE = range(3)
BLANKS = " \t\n\x0b\x0c\r"
NEVER = 1 << 50
# Turns of a slice.
SLICE = 4096
# The slice of rows without a turn, before all others.
NO_TURN = -(1 << 63)

# [from][to]: the least cost and, among equal ones, the place of the least audit.
Edges = tuple[tuple[tuple[int, int], ...], ...]


def _inserted(state: int) -> int:
    return ASSISTANT if state == USER else USER


def _letters(initial: int, fault: int) -> list[list[tuple[int, str] | None]]:
    """[from][to]: cost and letters of the best edits of a row, with the insertions before it."""
    best: list[list[tuple[int, str] | None]] = [[None] * 4 for _ in STATES]
    for start in STATES:
        state = start
        for inserts in range(3):
            steps = [(state, DELETE, "D")]
            if fault != GONE:
                extra = TRUNCATED if fault == CUT_OFF else 0
                steps.append((_inserted(state), REROLE + extra, "R"))
                if initial == SYSTEM - 1 and state == START:
                    steps.append((SYSTEM, KEEP + extra, "K"))
                if initial < OTHER and initial + 1 == _inserted(state):
                    steps.append((initial + 1, KEEP + extra, "K"))
            for end, cost, letter in steps:
                found = (INSERT * inserts + cost, "I" * inserts + letter)
                if best[start][end] is None or found < best[start][end]:
                    best[start][end] = found
            state = _inserted(state)
    return best


# By code: three times the role's initial, plus the fault.
LETTERS = [_letters(initial, fault) for initial in range(4) for fault in range(3)]
_ORDER = {x: i for i, x in enumerate(sorted({e[1] for table in LETTERS for row in table for e in row if e}))}
ROW_EDGES: list[Edges] = [
    tuple(tuple((e[0], _ORDER[e[1]]) if e else (NEVER, 0) for e in row) for row in table) for table in LETTERS
]
# Insertions after the last row, and their cost: a conversation ends empty or with an assistant.
LAST_INSERTS = (0, 2, 1, 0)
LAST_COSTS = tuple(INSERT * n for n in LAST_INSERTS)


@lru_cache(maxsize=1 << 16)
def forward(costs: tuple[int, ...], places: tuple[int, ...], edges: Edges) -> tuple[int, tuple, tuple]:
    """The vector after a step: what all its costs have in common, the rest of each, and their audits' order."""
    best = [
        min((costs[q] + edges[q][end][0], places[q], edges[q][end][1]) for q in STATES) for end in STATES
    ]
    order = sorted(STATES, key=lambda end: best[end][1:])
    low = min(b[0] for b in best)
    return low, tuple(min(b[0] - low, NEVER) for b in best), tuple(order.index(end) for end in STATES)


@lru_cache(maxsize=1 << 16)
def backward(costs: tuple[int, ...], edges: Edges) -> tuple[int, tuple]:
    best = [min(edges[q][end][0] + costs[end] for end in STATES) for q in STATES]
    low = min(best)
    return low, tuple(min(b - low, NEVER) for b in best)


def at_state(state: int) -> tuple[int, ...]:
    return tuple(0 if q == state else NEVER for q in STATES)


def crossings(steps: Sequence[Edges], start: int, ends: tuple[int, ...]) -> list[int]:
    """The state after each step of the best path from ``start``; ``ends`` are costs after the last."""
    found = [0] * len(steps)
    todo = [(0, len(steps), start, ends)] if steps else []
    while todo:
        low, high, state, goal = todo.pop()
        middle = (low + high + 1) // 2
        costs, places = at_state(state), tuple(STATES)
        for edges in steps[low:middle]:
            _, costs, places = forward(costs, places, edges)
        rest = goal
        for edges in reversed(steps[middle:high]):
            _, rest = backward(rest, edges)
        cross = min(STATES, key=lambda q: (costs[q] + rest[q], places[q]))
        found[middle - 1] = cross
        if middle - low > 1:
            todo.append((low, middle - 1, state, _before(steps[middle - 1], cross)))
        if high > middle:
            todo.append((middle, high, cross, goal))
    return found


def _before(edges: Edges, end: int) -> tuple[int, ...]:
    return tuple(edges[q][end][0] for q in STATES)


def summed(steps: Sequence[Edges]) -> Edges:
    """The edges of all steps as one."""
    rows = []
    for start in STATES:
        total, costs, places = 0, at_state(start), tuple(STATES)
        for edges in steps:
            low, costs, places = forward(costs, places, edges)
            total += low
        rows.append(tuple((min(total + c, NEVER), p) for c, p in zip(costs, places, strict=True)))
    return tuple(rows)


def audit_of(codes: bytes, start: int, end: int, last: bool) -> str:
    """The letters of a slice's edits between two states; the last one's also insert at its end."""
    states = crossings([ROW_EDGES[c] for c in codes], start, at_state(end))
    letters = [LETTERS[c][q][r][1] for c, q, r in zip(codes, [start, *states], states)]
    return "".join(letters) + ("I" * LAST_INSERTS[end] if last else "")


def damaged(table: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Conversations with faults, told by the CRC of conversation and turn modulo 20.

    0 drops a row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes it the user's.
    """
    space = F.lit(" ")
    name = F.concat(
        F.coalesce(F.col(conv).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn).cast("string"), space)
    )
    fault = F.crc32(name) % 20
    said = F.coalesce(F.col(text), space)
    changed = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.translate(said, ".!?", "")).otherwise(said)
    speaker = F.when(F.col("_fault") == 4, "user").otherwise(F.coalesce(F.col(role), space))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("_fault") == 3, 2).otherwise(1)))
    rows = table.select(conv, turn, role, text, fault.alias("_fault")).where("_fault <> 0")
    return rows.select(conv, turn, speaker.alias(role), changed.alias(text), copies.alias("_copy")).drop("_copy")


def _facts(table: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows under the names used here, each with its slice, initial, fault by itself and digest."""
    space = F.lit(" ")
    rows = table.select(
        F.col(conv).alias("conv"),
        F.col(turn).cast("bigint").alias("turn"),
        F.coalesce(F.col(role), space).alias("role"),
        F.coalesce(F.col(text), space).alias("text"),
    )
    whole = F.rtrim("text", F.lit(BLANKS))
    initial = F.position(F.substring("role", 1, 1), F.lit(INITIALS))
    initial = F.when((F.col("role") == "") | (initial == 0), OTHER).otherwise(initial - 1)
    fault = F.when(whole == "", GONE).when(F.right(whole, F.lit(1)).isin(".", "!", "?"), SOUND).otherwise(CUT_OFF)
    return rows.select(
        "*",
        F.coalesce(F.floor(F.col("turn") / SLICE).cast("bigint"), F.lit(NO_TURN)).alias("slice"),
        initial.cast("int").alias("initial"),
        fault.cast("int").alias("fault"),
        F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))).alias("digest"),
    )


def _repeated(facts: DataFrame) -> DataFrame:
    """(conv, slice, digest, turn) of texts that come at several turns: the first turn, in each slice that has them."""
    said = facts.where(F.col("fault") != GONE)
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = said.groupBy("conv", "digest").agg(F.min(place).alias("low"), F.max(place).alias("high"))
    firsts = firsts.where("low < high").select("conv", "digest", F.col("low.turn").alias("turn"))
    places = said.select("conv", "slice", "digest").distinct()
    same = places["conv"].eqNullSafe(firsts["conv"]) & (places["digest"] == firsts["digest"])
    return places.join(firsts, same).select(places["conv"], "slice", places["digest"], "turn")


def _groups(batches, width: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Runs of rows alike in their first ``width`` columns, each read as it comes; a run must be read up before the next."""
    rows = (row for b in batches for row in zip(*[c.to_pylist() for c in b.columns], strict=True))
    ahead = next(rows, None)

    def run(name):
        nonlocal ahead
        while ahead is not None and ahead[:width] == name:
            row, ahead = ahead, next(rows, None)
            yield row[width:]

    while ahead is not None:
        name = ahead[:width]
        yield name, run(name)


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


_COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")


def _slices(facts: DataFrame) -> DataFrame:
    """A row per slice: the codes of its rows, its counts, and its edges as one step."""
    kind = to_arrow_type(facts.schema["conv"].dataType)
    names = ["conv", "slice", "codes", "edges", *_COUNTS, "first", "last", "low", "high"]
    kinds = [kind, pa.int64(), pa.binary(), pa.binary(), *[pa.int64()] * 9]

    def run(batches):
        out: list[tuple] = []
        for (conv, slice_), rows in _groups(batches, 2):
            firsts: dict[bytes, int | None] = {}
            codes = bytearray()
            blank = duplicate = truncated = illegal = turns = 0
            low = high = first = last = before = None
            for kind_, turn, initial, fault, digest in rows:
                if kind_ == 0:
                    firsts[digest] = turn
                    continue
                if turn is not None:
                    turns += turn != high
                    low, high = turn if low is None else low, turn
                if fault == GONE:
                    blank += 1
                elif (turn, digest) == before or firsts.get(digest, turn) != turn:
                    fault = GONE
                    duplicate += 1
                else:
                    truncated += fault == CUT_OFF
                before = (turn, digest)
                illegal += last is not None and (last, initial) not in LEGAL
                first, last = initial if first is None else first, initial
                codes.append(3 * initial + fault)
            edges = np.array(summed([ROW_EDGES[c] for c in codes]), np.int64).tobytes()
            out.append((conv, slice_, bytes(codes), edges, blank, duplicate, truncated, illegal, turns, first, last, low, high))
            if len(out) >= 1000:
                yield _batch(out, names, kinds)
                out = []
        yield _batch(out, names, kinds)

    rows = facts.select("conv", "slice", F.lit(1).alias("kind"), "turn", "initial", "fault", "digest", "role", "text")
    nothing = F.lit(None)
    marks = _repeated(facts).select(
        "conv",
        "slice",
        F.lit(0).alias("kind"),
        "turn",
        nothing.cast("int").alias("initial"),
        nothing.cast("int").alias("fault"),
        "digest",
        nothing.cast("string").alias("role"),
        nothing.cast("string").alias("text"),
    )
    dealt = rows.unionByName(marks).repartition("conv", "slice")
    dealt = dealt.sortWithinPartitions("conv", "slice", "kind", F.asc_nulls_first("turn"), "role", "text")
    numbers = ", ".join(f"{n} bigint" for n in names[4:])
    return dealt.select("conv", "slice", "kind", "turn", "initial", "fault", "digest").mapInArrow(
        run, f"conv {facts.schema['conv'].dataType.simpleString()}, slice bigint, codes binary, edges binary, {numbers}"
    )


_TOTALS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _met(slices: DataFrame) -> DataFrame:
    """(conv, slice, start, end, final) of each slice, and the conversation's totals on its first one."""
    kind = to_arrow_type(slices.schema["conv"].dataType)
    names = ["conv", "slice", "start", "end", "final", *_TOTALS]

    def run(batches):
        for (conv,), rows in _groups(batches, 1):
            places, steps, sums = [], [], [0] * len(_COUNTS)
            low = high = before = None
            for slice_, edges, *counts, first, last, least, most in rows:
                places.append(slice_)
                steps.append(tuple(tuple(map(tuple, q)) for q in np.frombuffer(edges, np.int64).reshape(4, 4, 2).tolist()))
                sums = [a + b for a, b in zip(sums, counts, strict=True)]
                sums[3] += before is not None and (before, first) not in LEGAL
                before = last
                low, high = least if low is None else low, high if most is None else most
            states = crossings(steps, START, LAST_COSTS)
            cost, state = LAST_COSTS[states[-1]], START
            for step, following in zip(steps, states, strict=True):
                cost, state = cost + step[state][following][0], following
            gaps = 0 if low is None else high - low + 1 - sums[4]
            size = len(places)
            totals = [gaps, *sums[:4], cost]
            columns = [
                pa.array([conv] * size, kind),
                pa.array(places, pa.int64()),
                pa.array([START, *states[:-1]], pa.int64()),
                pa.array(states, pa.int64()),
                pa.array([False] * (size - 1) + [True]),
                *(pa.array([t] + [None] * (size - 1), pa.int64()) for t in totals),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    numbers = ", ".join(f"{n} bigint" for n in _TOTALS)
    columns = ["conv", "slice", "edges", *_COUNTS, "first", "last", "low", "high"]
    dealt = slices.select(*columns).repartition("conv").sortWithinPartitions("conv", "slice")
    return dealt.mapInArrow(
        run,
        f"conv {slices.schema['conv'].dataType.simpleString()}, slice bigint, start bigint, end bigint, final boolean, {numbers}",
    )


def audits(facts: DataFrame) -> DataFrame:
    """(conv, slice, start, audit) of each slice, with the conversation's totals on its first one."""
    slices = checkpointed(_slices(facts))
    met = _met(slices)
    same = slices["conv"].eqNullSafe(met["conv"]) & (slices["slice"] == met["slice"])
    joined = slices.select("conv", "slice", "codes").join(met, same)
    joined = joined.select(met["conv"], met["slice"], "codes", "start", "end", "final", *_TOTALS)

    def run(batches):
        for b in batches:
            solved = zip(*[b.column(i).to_pylist() for i in range(2, 6)], strict=True)
            letters = pa.array([audit_of(*row) for row in solved], pa.string())
            columns = [b.column(0), b.column(1), b.column(3), letters, *b.columns[6:]]
            yield pa.RecordBatch.from_arrays(columns, names=["conv", "slice", "start", "audit", *_TOTALS])

    numbers = ", ".join(f"{n} bigint" for n in _TOTALS)
    kind = facts.schema["conv"].dataType.simpleString()
    return joined.mapInArrow(run, f"conv {kind}, slice bigint, start bigint, audit string, {numbers}")


def _edited(state: int, audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of each edit that leaves a row."""
    for letter in audit:
        if letter == "I":
            state = _inserted(state)
            yield letter, ("user", "assistant")[state - USER], ""
            continue
        role, text = next(rows)
        if letter == "D":
            continue
        if letter == "R":
            state = _inserted(state)
            role = ("user", "assistant")[state - USER]
        else:
            state = 1 + INITIALS.index(role[0])
        yield letter, role, text


def _with_audits(facts: DataFrame, solved: DataFrame) -> DataFrame:
    """Rows of a slice behind the row with its audit; to be dealt and sorted."""
    rows = facts.select("conv", "slice", F.lit(1).alias("kind"), "turn", "role", "text")
    return rows.unionByName(solved.withColumn("kind", F.lit(0)), allowMissingColumns=True)


_READ = ("conv", "slice", "kind", "start", "audit", *_TOTALS, "role", "text")


def _sorted(rows: DataFrame, *dealt_by: str) -> DataFrame:
    rows = rows.repartition(*dealt_by)
    rows = rows.sortWithinPartitions("conv", F.asc_nulls_first("slice"), "kind", F.asc_nulls_first("turn"), "role", "text")
    return rows.select(*_READ)


def repaired_rows(
    table: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(conv, slice, place, edit, role, text): the rows of the repaired conversations.

    They are in order by conversation, slice and place. Slices are edited in parallel.
    """
    facts = _facts(table, conv, turn, role, text)
    kind = to_arrow_type(facts.schema["conv"].dataType)
    names = ["conv", "slice", "place", "edit", "role", "text"]
    kinds = [kind, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(batches):
        out: list[tuple] = []
        for (name, slice_), rows in _groups(batches, 2):
            _, start, audit, *_ = next(rows)
            for place, edited in enumerate(_edited(start, audit, (row[-2:] for row in rows))):
                out.append((name, slice_, place, *edited))
                if len(out) >= 1000:
                    yield _batch(out, names, kinds)
                    out = []
        yield _batch(out, names, kinds)

    schema = f"conv {facts.schema['conv'].dataType.simpleString()}, slice bigint, place bigint, edit string, role string, text string"
    found = _sorted(_with_audits(facts, audits(facts)), "conv", "slice").mapInArrow(run, schema)
    return found.withColumnsRenamed({"conv": conv, "role": role, "text": text})


def repaired(
    table: DataFrame,
    conversations: DataFrame | None = None,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """Of each conversation: gaps, faults, illegal neighbours, cost, audit and the repaired rows' digest.

    ``conversations`` names those to report, even if ``table`` has no rows of them.
    """
    facts = _facts(table, conv, turn, role, text)
    kind = to_arrow_type(facts.schema["conv"].dataType)
    names = ["conv", *_TOTALS, "audit", "repaired_sha256"]
    kinds = [kind, *[pa.int64()] * len(_TOTALS), pa.string(), pa.string()]

    def run(batches):
        out: list[tuple] = []
        for (name,), rows in _groups(batches, 1):
            totals, letters, digest = [0] * len(_TOTALS), [], hashlib.sha256()
            begun = False
            for _, kind_, start, audit, *values, _, _ in rows:
                if kind_ < 0:
                    continue  # the conversation's name alone
                if values[0] is not None:
                    totals = values
                letters.append(audit)
                for _, role_, text_ in _edited(start, audit, (row[-2:] for row in rows)):
                    digest.update(f"\n{role_}:{text_}".encode() if begun else f"{role_}:{text_}".encode())
                    begun = True
            out.append((name, *totals, "".join(letters), digest.hexdigest()))
            if len(out) >= 1000:
                yield _batch(out, names, kinds)
                out = []
        yield _batch(out, names, kinds)

    rows = _with_audits(facts, audits(facts))
    if conversations is not None:
        named = conversations.select(F.col(conv).alias("conv")).distinct().withColumn("kind", F.lit(-1))
        rows = rows.unionByName(named, allowMissingColumns=True)
    numbers = ", ".join(f"{n} bigint" for n in _TOTALS)
    schema = f"conv {facts.schema['conv'].dataType.simpleString()}, {numbers}, audit string, repaired_sha256 string"
    return _sorted(rows, "conv").mapInArrow(run, schema).withColumnRenamed("conv", conv)


# The CRC byte by byte, and the least path row by row: of each state the best (cost, audit, repaired lines).
ORACLE = r"""
    WITH RECURSIVE bits(i, k, v) AS (
      SELECT i, 0, i::BIGINT FROM range(256) r(i)
      UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
    crc_table AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
    told AS (
      SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))) AS h FROM conversations),
    faulty AS (
      SELECT conv_id, turn, role, text, xor(list_reduce(
               list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
               lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 20 AS f
      FROM told, crc_table),
    damaged AS (
      SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
             CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS copy
      FROM faulty WHERE f <> 0),
    placed AS (
      SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
             left(role, 1) AS initial, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
             regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') AS loose
      FROM damaged),
    judged AS (
      SELECT *, NOT blank AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
             lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair,
             count(*) OVER (PARTITION BY conv_id) AS n
      FROM placed),
    rows AS (SELECT *, blank OR again AS gone, loose AND NOT blank AND NOT again AS cut FROM judged),
    moves(state, inserted, here, lines) AS (VALUES
      ('', '', '', []), ('', 'I', 'u', ['user:']), ('', 'II', 'a', ['user:', 'assistant:']),
      ('s', '', 's', []), ('s', 'I', 'u', ['user:']), ('s', 'II', 'a', ['user:', 'assistant:']),
      ('u', '', 'u', []), ('u', 'I', 'a', ['assistant:']), ('u', 'II', 'u', ['assistant:', 'user:']),
      ('a', '', 'a', []), ('a', 'I', 'u', ['user:']), ('a', 'II', 'a', ['user:', 'assistant:'])),
    paths AS (
      SELECT DISTINCT conv_id, 0::BIGINT AS i, '' AS state, {'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]} AS best FROM rows
      UNION ALL
      SELECT conv_id, i, to_state, min({'cost': cost, 'audit': audit, 'lines': lines})
      FROM (
        SELECT p.conv_id, r.i, e.to_state, p.best.cost + 2 * length(m.inserted) + e.cost AS cost,
               p.best.audit || m.inserted || e.letter AS audit, list_concat(p.best.lines, list_concat(m.lines, e.lines)) AS lines
        FROM paths p JOIN rows r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1 JOIN moves m ON m.state = p.state,
             LATERAL (SELECT unnest([
               {'letter': 'D', 'cost': 3, 'to_state': m.here, 'lines': []::VARCHAR[], 'may': true},
               {'letter': 'R', 'cost': 2 + r.cut::INT, 'to_state': CASE m.here WHEN 'u' THEN 'a' ELSE 'u' END,
                'lines': [CASE m.here WHEN 'u' THEN 'assistant:' ELSE 'user:' END || r.text], 'may': NOT r.gone},
               {'letter': 'K', 'cost': r.cut::INT, 'to_state': r.initial, 'lines': [r.role || ':' || r.text],
                'may': NOT r.gone AND (r.initial = CASE m.here WHEN 'u' THEN 'a' ELSE 'u' END OR (r.initial = 's' AND m.here = ''))}
             ], recursive := true)) e
        WHERE e.may)
      GROUP BY conv_id, i, to_state),
    solved AS (
      SELECT p.conv_id, min({'cost': best.cost + 2 * length(m.inserted), 'audit': best.audit || m.inserted,
                             'lines': list_concat(best.lines, m.lines)}) AS best
      FROM paths p JOIN moves m ON m.state = p.state AND m.here IN ('', 'a')
      WHERE p.i = (SELECT max(n) FROM rows r WHERE r.conv_id IS NOT DISTINCT FROM p.conv_id) GROUP BY p.conv_id),
    counted AS (
      SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
             count(*) FILTER (blank) AS blank, count(*) FILTER (again) AS duplicate, count(*) FILTER (cut) AS truncated,
             count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal
      FROM rows GROUP BY conv_id)
    SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
           coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost,
           coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o
    LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
    LEFT JOIN solved s ON s.conv_id IS NOT DISTINCT FROM o.conv_id"""
