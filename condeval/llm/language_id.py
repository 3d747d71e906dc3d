"""Language identification by a bidirectional gated recurrent network over bytes.

Two small gated layers read a text's bytes, one from the left, one from the right.
Their states at a byte give log-odds of the languages there, so every byte is
labelled; a document's probabilities are pooled from all its bytes. The network is
trained here, in numpy, by backpropagation through time.

The recurrence runs over windows of ``window`` bytes that start from a zero state.
Windows tile the whole text, so each byte is read and labelled exactly once and all
windows of a batch are stepped together.

The gate of a layer is z = sigmoid(Z[b] + h U), its candidate c = tanh(C[b] + h V),
and h moves to h + z (c - h).

Defined cases: NULL text, and a text without any letter, is ``und`` with score 0; an
empty table gives an empty table; rows that repeat get equal rows; NULL keys are kept;
other columns are neither read nor returned. ``fitted`` needs at least one labelled text;
``fitted_if_any`` returns a model without languages where there is none, by which every
text is ``und`` with score 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from condeval.llm.common import free_names

UNDETERMINED = "und"
HIDDEN = 8
# Bytes that are stepped through from one zero state, and windows stepped together.
WINDOW, ROWS = 96, 1024
# The training sample: so many texts of a language, so many places in each, so many
# characters from each place. Nothing else of the corpus reaches the driver.
TEXTS, PLACES, LENGTH = 600, 4, 64
SPARE = 4
PASSES, BATCH, RATE, SEED = 10, 192, 0.02, 7
END = 256  # the symbol beyond a text's end


@dataclass(frozen=True)
class Model:
    """Weights of both layers, and of the reading of their states."""

    languages: tuple[str, ...]
    inputs: np.ndarray  # (2 directions, 257 symbols, 2 * hidden)
    states: np.ndarray  # (2, hidden, 2 * hidden)
    reading: np.ndarray  # (2 * hidden, languages)
    bias: np.ndarray


UNTRAINED = Model(
    (),
    np.zeros((2, END + 1, 2 * HIDDEN), np.float32),
    np.zeros((2, HIDDEN, 2 * HIDDEN), np.float32),
    np.zeros((2 * HIDDEN, 0), np.float32),
    np.zeros(0, np.float32),
)


def _forward(model: Model, symbols: np.ndarray, trace: list | None = None) -> np.ndarray:
    """States at every place: (2, places, rows, hidden), for symbols of (places, rows)."""
    places, rows = symbols.shape
    symbols = symbols.astype(np.intp)
    hidden = model.states.shape[1]
    out = np.empty((2, places, rows, hidden), np.float32)
    read = np.empty((rows, 2 * hidden), np.float32)
    pre = np.empty((rows, 2 * hidden), np.float32)
    gate, candidate = pre[:, :hidden], pre[:, hidden:]
    for side in range(2):
        state = np.zeros((rows, hidden), np.float32)
        for at in range(places) if side == 0 else range(places - 1, -1, -1):
            np.take(model.inputs[side], symbols[at], axis=0, out=read, mode="clip")
            np.matmul(state, model.states[side], out=pre)
            np.add(pre, read, out=pre)
            np.tanh(pre, out=pre)
            gate *= 0.5  # sigmoid(2 u) = (1 + tanh(u)) / 2
            gate += 0.5
            if trace is not None:
                trace.append((side, at, state.copy(), gate.copy(), candidate.copy()))
            candidate -= state
            candidate *= gate
            state += candidate
            out[side, at] = state
    return out


def _log_odds(model: Model, states: np.ndarray) -> np.ndarray:
    hidden = states.shape[-1]
    return states[0] @ model.reading[:hidden] + states[1] @ model.reading[hidden:] + model.bias


def _softmax(odds: np.ndarray) -> np.ndarray:
    odds = np.exp(odds - odds.max(axis=-1, keepdims=True))
    return odds / odds.sum(axis=-1, keepdims=True)


def _gradients(model: Model, symbols: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
    """Of the mean cross-entropy over all bytes, by backpropagation through time."""
    trace: list = []
    states = _forward(model, symbols, trace)
    hidden = model.states.shape[1]
    error = _softmax(_log_odds(model, states))
    error[np.arange(symbols.shape[0])[:, None], np.arange(symbols.shape[1]), target[None, :]] -= 1
    error *= (symbols != END)[..., None] / max(1, int((symbols != END).sum()))
    g_inputs, g_states = np.zeros_like(model.inputs), np.zeros_like(model.states)
    g_reading = np.concatenate([np.tensordot(states[side], error, ((0, 1), (0, 1))) for side in range(2)])
    g_bias = error.sum(axis=(0, 1))
    flow = np.zeros((2, symbols.shape[1], hidden), np.float32)
    pres: list = [np.empty((*symbols.shape, 2 * hidden), np.float32) for _ in range(2)]
    for side, at, before, gate, candidate in reversed(trace):
        g = flow[side] + error[at] @ model.reading[side * hidden : (side + 1) * hidden].T
        pre = pres[side][at]
        # The gate is (1 + tanh(u)) / 2, so d gate / d u = 2 gate (1 - gate).
        pre[:, :hidden] = g * (candidate - before) * 2 * gate * (1 - gate)
        pre[:, hidden:] = g * gate * (1 - candidate**2)
        g_states[side] += before.T @ pre
        flow[side] = g * (1 - gate) + pre @ model.states[side].T
    flat = symbols.ravel()
    for side in range(2):
        values = pres[side].reshape(len(flat), -1)
        for k in range(2 * hidden):
            g_inputs[side, :, k] = np.bincount(flat, values[:, k], END + 1)
    return [g_inputs, g_states, g_reading.astype(np.float32), g_bias]


def train(texts: list[bytes], labels: list[str], hidden: int = HIDDEN, passes: int = PASSES) -> Model:
    """Fit a model to labelled pieces of text, each at most a window long."""
    if not texts:
        raise ValueError("no labelled text to learn from")
    languages = tuple(sorted(set(labels)))
    random = np.random.default_rng(SEED)
    weights = [
        random.normal(0, 0.3, (2, END + 1, 2 * hidden)).astype(np.float32),
        random.normal(0, 0.3, (2, hidden, 2 * hidden)).astype(np.float32),
        random.normal(0, 0.3, (2 * hidden, len(languages))).astype(np.float32),
        np.zeros(len(languages), np.float32),
    ]
    symbols = _tiled([t[:WINDOW] for t in texts])[0]
    target = np.array([languages.index(label) for label in labels])
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    steps, total = 0, passes * -(-len(texts) // BATCH)
    for _ in range(passes):
        order = random.permutation(len(texts))
        for start in range(0, len(texts), BATCH):
            chosen = order[start : start + BATCH]
            steps += 1
            rate = RATE * (1 - (steps - 1) / total)
            found = _gradients(Model(languages, *weights), symbols[:, chosen], target[chosen])
            for w, g, m, v in zip(weights, found, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= rate * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.99**steps)) + 1e-8)
    return Model(languages, *weights)


def _tiled(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Windows of the texts as columns, (window, windows), and how many each text has."""
    counts = np.array([-(-len(t) // WINDOW) for t in texts], np.int64)
    tiled = np.full((int(counts.sum()), WINDOW), END, np.int16)
    flat, at = tiled.reshape(-1), 0
    for text, count in zip(texts, counts, strict=True):
        flat[at : at + len(text)] = np.frombuffer(text, np.uint8)
        at += int(count) * WINDOW
    return tiled.T, counts


def position_labels(model: Model, text: str) -> list[str]:
    """The language of each byte of a text."""
    symbols, _ = _tiled([text.encode()])
    best = _log_odds(model, _forward(model, symbols)).argmax(axis=-1).T.ravel()
    return [model.languages[i] for i in best[: len(text.encode())]]


def pooled(model: Model, texts: list[bytes]) -> np.ndarray:
    """Each text's language probabilities: those of its bytes, averaged.

    Windows go through the layers in blocks of one fixed shape, so that a text's
    numbers don't depend on its neighbours.
    """
    symbols, counts = _tiled(texts)
    sums = np.zeros((symbols.shape[1], len(model.languages)))
    for start in range(0, symbols.shape[1], ROWS):
        part = symbols[:, start : start + ROWS]
        block = np.full((WINDOW, ROWS), END, np.int16)
        block[:, : part.shape[1]] = part
        odds = _softmax(_log_odds(model, _forward(model, block)))
        odds *= (block != END)[..., None]
        sums[start : start + part.shape[1]] = odds.sum(axis=0)[: part.shape[1]]
    owner = np.repeat(np.arange(len(texts)), counts)
    out = np.zeros((len(texts), len(model.languages)))
    for k in range(len(model.languages)):
        out[:, k] = np.bincount(owner, sums[:, k], len(texts))
    return out / np.maximum(1, [[len(t)] for t in texts])


def held_out(key: str) -> Column:
    """Whether a row is kept from training: crc32 of its key as text leaves 2 by 4."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _sample(table: DataFrame, key: str, text: str, label: str, texts: int) -> tuple[list[bytes], list[str]]:
    """Pieces of the rows that aren't held out and have a label, and their languages.

    The sample is ``texts`` texts of each language, those whose key hashes lowest, and
    ``PLACES`` pieces of ``LENGTH`` characters from hashed places of each. Languages are
    counted first (a row each, as the model has an output each), so that only about
    ``SPARE`` times as many texts as wanted, whatever the table's size, are compared.
    """
    has_letter = F.col("_text").rlike(r"\p{L}")
    known = table.select(
        F.col(text).alias("_text"), F.col(label).alias("_label"), F.xxhash64(key).alias("_h"), held_out(key).alias("_out")
    ).where(~F.col("_out") & F.col("_label").isNotNull() & has_letter)
    counts = known.groupBy("_label").count().collect()
    shares = [x for r in counts for x in (F.lit(r["_label"]), F.lit(SPARE * texts / r["count"]))]
    if not shares:
        return [], []
    place = (F.col("_h").cast("double") + float(1 << 63)) / float(1 << 64)
    known = known.where(place < F.element_at(F.create_map(*shares), F.col("_label")))
    first = Window.partitionBy("_label").orderBy("_h", "_text")
    sample = known.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= texts)
    free = F.greatest(F.length("_text") - LENGTH + 1, F.lit(1))
    pieces = sample.select(
        "_label",
        "_h",
        F.explode(
            F.array(
                *(
                    F.substring("_text", F.pmod(F.xxhash64("_h", F.lit(p)), free).cast("int") + 1, F.lit(LENGTH))
                    for p in range(PLACES)
                )
            )
        ).alias("_piece"),
    ).where(F.col("_piece").rlike(r"\p{L}"))
    rows = sorted((r["_label"], r["_h"], r["_piece"]) for r in pieces.collect())
    return [r[2].encode() for r in rows], [r[0] for r in rows]


def fitted(
    table: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", texts: int = TEXTS
) -> Model:
    """Train on a sample of the rows that aren't held out and have a label."""
    return train(*_sample(table, key, text, label, texts))


def fitted_if_any(
    table: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", texts: int = TEXTS
) -> Model:
    """As ``fitted``, but a model without languages where no row can be learned from."""
    pieces, labels = _sample(table, key, text, label, texts)
    return train(pieces, labels) if pieces else UNTRAINED


def _labelled(batch, model: Model, texts: int, lettered: int) -> tuple[list[str], list[float]]:
    """Languages and scores of one Arrow batch, a bounded number of bytes at a time."""
    if not model.languages:
        return [UNDETERMINED] * batch.num_rows, [0.0] * batch.num_rows
    languages, scores = [], []
    values = [
        (t or "").encode() if ok else b""
        for t, ok in zip(batch.column(texts).to_pylist(), batch.column(lettered).to_pylist(), strict=True)
    ]
    at = 0
    while at < len(values):
        size, end = 0, at
        while end < len(values) and (end == at or size < ROWS * WINDOW * 4):
            size += len(values[end]) + WINDOW // 2
            end += 1
        found = pooled(model, values[at:end])
        best = found.argmax(axis=1)
        for text, row, top in zip(values[at:end], found, best, strict=True):
            languages.append(model.languages[top] if text else UNDETERMINED)
            scores.append(min(1.0, round(float(row[top]), 6)) if text else 0.0)
        at = end
    return languages, scores


def _lettered(text: str) -> Column:
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def predicted(table: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score): the likeliest language of each whole text and its probability."""

    def run(batches):
        for batch in batches:
            languages, scores = _labelled(batch, model, 1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(languages, pa.string()), pa.array(scores, pa.float64())],
                names=[key, "lang_pred", "score"],
            )

    kind = table.schema[key].dataType.simpleString()
    return table.select(key, text, _lettered(text).alias("_lettered")).mapInArrow(
        run, f"`{key}` {kind}, lang_pred string, score double"
    )


def kept(table: DataFrame, model: Model, least: float, text: str = "text") -> DataFrame:
    """The rows, with all their columns, whose language is determined with a score of ``least``."""
    place = table.columns.index(text)
    (extra,) = free_names(table.columns, "_lettered")

    def run(batches):
        for batch in batches:
            languages, scores = _labelled(batch, model, place, len(table_columns))
            good = [lang != UNDETERMINED and s >= least for lang, s in zip(languages, scores, strict=True)]
            yield batch.select(range(len(table_columns))).filter(pa.array(good, pa.bool_()))

    table_columns = table.columns
    return table.withColumn(extra, _lettered(text)).mapInArrow(run, table.schema)
