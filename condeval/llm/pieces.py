"""SentencePiece encoding and decoding from a table of distinct chunks.

Blanks become whitespace markers, and one marker is put before a text. No piece of a
supported model holds a marker behind another character, so no merge crosses from a word
into the marker of the next: a text falls into marked chunks whose pieces don't depend on
their neighbours. For the same reason ASCII characters that stand in no longer piece, such
as the line feed, are chunks of their own, and a word whose last letter stands before no
sign in any piece ends before a sign, such as a comma. The distinct chunks of a batch of texts make
a table, each is segmented once, and its ids are joined back to the texts by position.

Chunks merge their pairs best score first, then leftmost. The table's chunks of one length
do so together, a merge a round, as columns of symbols; a very long chunk has a queue of its
own. Characters that the vocabulary lacks become the ids of their UTF-8 bytes. Decoding concatenates pieces,
gathers bytes into characters, and drops the marker that was put before the text.

The table is made per batch and not for the whole corpus: joining a corpus-wide one by
position would shuffle a position for every word. What it held is kept from batch to batch
in a worker, boundedly.

Defined cases: NULL text counts as empty and has the end id only; an empty table gives an
empty table; repeated rows and ties give equal rows; a text is never cut, and a chunk of
any length takes n log n steps; a literal marker in a text is a blank, as in the library;
other columns are neither read nor returned, so their names can't clash.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
import sys
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of the model file's format: the marker, kinds of pieces, the kind of model.
MARKER = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BPE = 2
# A queued merge is one number: its rank, then the place of its left symbol.
PLACE_BITS = 40
PLACE_MASK = (1 << PLACE_BITS) - 1
# Texts are tabled together up to about so many characters.
TABLE_CHARS = 4_000_000
# A worker keeps the table of earlier texts until its chunks have about so many characters.
KEPT_CHARS = 8_000_000
# Chunks of up to so many characters are segmented together, column by column; longer ones by a queue.
SHORT = 64


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def message_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and raw values of a serialised message, in order."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class Segmenter:
    """Encodes and decodes texts by the pieces and scores of one BPE model.

    Refused with ``ValueError``: models of another kind, with a normalisation table, with
    pieces given by the user, without byte pieces, or with pieces that cross a marker.
    """

    def __init__(self, model: bytes) -> None:
        pieces, trainer, normalizer = [], {}, {3: 1, 4: 1, 5: 1}
        for number, value in message_fields(model):
            if number == 1:
                pieces.append({3: NORMAL, 2: b"\0\0\0\0"} | dict(message_fields(value)))
            elif number == 2:
                trainer = dict(message_fields(value))
            elif number == 3:
                normalizer |= dict(message_fields(value))
        names = [p[1].decode() for p in pieces]
        kinds = [p[3] for p in pieces]
        scores = [struct.unpack("<f", p[2])[0] for p in pieces]
        if trainer.get(3) != BPE or trainer.get(24) or not {NORMAL, UNKNOWN, CONTROL, BYTE} >= set(kinds):
            raise ValueError("only BPE models of learned pieces are supported")
        if normalizer.get(2) or not normalizer[3] or normalizer[4] or not normalizer[5]:
            raise ValueError("only models that leave texts as they are and put a marker first are supported")
        self.ids = {name: i for i, (name, kind) in enumerate(zip(names, kinds, strict=True)) if kind == NORMAL}
        crossing = re.compile(f"[^{MARKER}]{MARKER}")
        if any(crossing.search(name) for name in self.ids):
            raise ValueError("pieces cross a whitespace marker: chunks can't be segmented alone")
        self.bytes = [i for i, kind in enumerate(kinds) if kind == BYTE]
        if len(self.bytes) != 256:
            raise ValueError("the model has no byte pieces")
        self.byte_of = {i: int(names[i][3:-1], 16) for i in self.bytes}
        self.bytes.sort(key=self.byte_of.get)
        self.names = names
        self.silent = {i for i, kind in enumerate(kinds) if kind == CONTROL}
        self.unknown = {i for i, kind in enumerate(kinds) if kind == UNKNOWN}
        self.special = self.silent | self.unknown | set(self.bytes)
        self.end = names.index("</s>")
        places = {score: rank for rank, score in enumerate(sorted({scores[i] for i in self.ids.values()}, reverse=True))}
        self.ranks = {name: places[scores[i]] for name, i in self.ids.items()}
        self.chunks = self._chunk_pattern().findall
        self._symbol_tables(names)
        self.table: dict[str, tuple[str, str]] = {}
        self.held = 0

    def _chunk_pattern(self) -> re.Pattern:
        """What no piece crosses: markers, characters of no longer piece, and the step from a letter to a sign."""
        longer = set().union(*(name for name in self.ids if len(name) > 1))
        ascii_ = [c for c in map(chr, range(128)) if c != " "]
        alone = "".join(c for c in ascii_ if c not in longer)
        sign = "".join(c for c in ascii_ if c in longer and not c.isalpha())
        led = {a for name in self.ids for a, b in pairwise(name) if b in sign}
        alone, sign, led = (re.escape("".join(sorted(x))) for x in (alone, sign, led))
        word = rf"{MARKER}*[^\W\d_{led}]++(?=[{MARKER}{alone}{sign}]|\Z)"
        return re.compile(f"[{alone}]|{word}|{MARKER}*[^{MARKER}{alone}]+|{MARKER}+")

    def _symbol_tables(self, names: list[str]) -> None:
        """Symbols: ids of pieces, further numbers for characters of pieces, one for all others."""
        self.none = len(names)
        lone = dict.fromkeys(c for name in self.ids for c in name if c not in self.ids)
        symbols = self.ids | {c: self.none + 1 + i for i, c in enumerate(lone)}
        self.width = self.none + 1 + len(lone)
        self.symbol_of = np.full(sys.maxunicode + 1, self.none, np.int32)
        for name, symbol in symbols.items():
            if len(name) == 1:
                self.symbol_of[ord(name)] = symbol
        products = {}
        for name, symbol in self.ids.items():
            for cut in range(1, len(name)):
                left, right = symbols.get(name[:cut]), symbols.get(name[cut:])
                if left is not None and right is not None:
                    products[left * self.width + right] = symbol
        self.pairs = np.array([*sorted(products), np.iinfo(np.int64).max])
        self.products = np.array([products.get(pair, self.none) for pair in self.pairs.tolist()], np.int32)
        self.rank_of = np.full(self.width, self.none, np.int32)
        self.plain = np.zeros(self.width, bool)
        for name, symbol in self.ids.items():
            self.rank_of[symbol] = self.ranks[name]
            self.plain[symbol] = True
        self.shown = [name.replace(MARKER, " ") for name in names]
        self.digits = [str(i) for i in range(len(names))]

    def marked_chunks(self, text: str) -> list[str]:
        """The chunks of a text; they concatenate to the text with a marker first and for each blank."""
        return self.chunks(MARKER + text.replace(" ", MARKER)) if text else []

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The symbol that each pair of symbols merges into; ``none`` where there is none."""
        wanted = left.astype(np.int64) * self.width + right
        places = np.searchsorted(self.pairs, wanted)
        return np.where(self.pairs[places] == wanted, self.products[places], self.none)

    def segmented(self, chunks: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of chunks of one length, and the symbols of each, for all chunks at once.

        Every chunk that can still merge does so once a round, at its best and leftmost
        pair. So the rows that go on are equally long, and merges are columnar steps.
        """
        codes = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)
        rows = np.arange(len(chunks))
        symbols = self.symbol_of[codes].reshape(len(chunks), -1)
        ranks = self.rank_of[self.merged(symbols[:, :-1], symbols[:, 1:])]
        while ranks.shape[1]:
            at = ranks.argmin(axis=1)
            going = ranks[np.arange(len(at)), at] < self.none
            if not going.all():
                yield rows[~going], symbols[~going]
                rows, symbols, ranks, at = rows[going], symbols[going], ranks[going], at[going]
                if not len(rows):
                    return
            lines = np.arange(len(rows))
            symbols[lines, at] = self.merged(symbols[lines, at], symbols[lines, at + 1])
            keep = np.arange(symbols.shape[1] - 1)
            symbols = np.take_along_axis(symbols, keep + (keep > at[:, None]), axis=1)
            keep = keep[:-1]
            ranks = np.take_along_axis(ranks, keep + (keep >= at[:, None]), axis=1)
            for first in (at - 1, at):
                here = lines[(first >= 0) & (first < len(keep))]
                place = first[here]
                ranks[here, place] = self.rank_of[self.merged(symbols[here, place], symbols[here, place + 1])]
        yield rows, symbols

    def long_chunk_ids(self, chunk: str) -> list[int]:
        """The ids of a chunk of any length, by a queue of merges over a linked list."""
        size = len(chunk)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        alive = bytearray(b"\1") * size
        rank_of = self.ranks.get
        queue = []
        for at in range(size - 1):
            if (rank := rank_of(chunk[at : at + 2])) is not None:
                queue.append(rank << PLACE_BITS | at)
        heapq.heapify(queue)
        while queue:
            entry = heapq.heappop(queue)
            at = entry & PLACE_MASK
            middle = after[at]
            if not alive[at] or middle >= size:
                continue
            end = after[middle]
            if rank_of(chunk[at:end]) != entry >> PLACE_BITS:
                continue  # stale: one of its symbols has been merged since
            alive[middle] = 0
            after[at] = end
            if end < size:
                before[end] = at
                if (rank := rank_of(chunk[at : after[end]])) is not None:
                    heapq.heappush(queue, rank << PLACE_BITS | at)
            if (start := before[at]) >= 0 and (rank := rank_of(chunk[start:end])) is not None:
                heapq.heappush(queue, rank << PLACE_BITS | start)
        return [i for at in range(size) if alive[at] for i in self.piece_ids(chunk[at : after[at]])]

    def piece_ids(self, piece: str) -> list[int]:
        """The id of a piece, or those of its bytes."""
        found = self.ids.get(piece)
        return [found] if found is not None else [self.bytes[b] for b in piece.encode()]

    def add(self, chunks: Iterable[str]) -> None:
        """Put chunks into the table: the ids of each, joined by blanks, and the text they decode to."""
        by_length: dict[int, list[str]] = {}
        for chunk in chunks:
            by_length.setdefault(len(chunk), []).append(chunk)
        table, digits, shown = self.table, self.digits, self.shown
        for length, group in by_length.items():
            self.held += length * len(group)
            if length > SHORT:
                for chunk in group:
                    self._add_one(chunk, self.long_chunk_ids(chunk))
                continue
            for rows, symbols in self.segmented(group):
                special = ~self.plain[symbols].all(axis=1)
                for row, line, odd in zip(rows.tolist(), symbols.tolist(), special.tolist(), strict=True):
                    chunk = group[row]
                    if odd:
                        self._add_one(chunk, self._with_bytes(chunk, line))
                    else:
                        table[chunk] = " ".join([digits[i] for i in line]), "".join([shown[i] for i in line])

    def _add_one(self, chunk: str, ids: list[int]) -> None:
        self.table[chunk] = " ".join([self.digits[i] for i in ids]), self.decode(ids, first=False)

    def _with_bytes(self, chunk: str, symbols: list[int]) -> list[int]:
        """Ids of symbols of which some are characters without a piece."""
        ids: list[int] = []
        at = 0
        for symbol in symbols:
            size = len(self.names[symbol]) if symbol < len(self.names) else 1
            ids += self.piece_ids(chunk[at : at + size])
            at += size
        return ids

    def decode(self, ids: list[int], first: bool = True) -> str:
        """The text of ids; ``first`` drops the marker that was put before it."""
        if self.special.isdisjoint(ids):
            text = "".join([self.names[i] for i in ids])
            return (text[1:] if first and text[:1] == MARKER else text).replace(MARKER, " ")
        out: list[str] = []
        run = bytearray()
        for i in ids:
            if (byte := self.byte_of.get(i)) is not None:
                run.append(byte)
                first = False
                continue
            if run:
                out.append(run.decode(errors="replace"))
                run.clear()
            if i in self.silent:
                continue
            piece = " ⁇ " if i in self.unknown else self.names[i]
            if first and piece.startswith(MARKER):
                piece = piece[1:]
            first = False
            out.append(piece.replace(MARKER, " "))
        out.append(run.decode(errors="replace"))
        return "".join(out)

    def chunked(self, texts: list[str]) -> Iterator[list[str]]:
        """The chunks of each text, once the table holds all of them.

        Texts share a table up to ``TABLE_CHARS`` characters; it is kept for the next ones
        until it holds ``KEPT_CHARS``.
        """
        at = 0
        while at < len(texts):
            if self.held > KEPT_CHARS:
                self.table, self.held = {}, 0
            cut, taken = [], 0
            missing: set[str] = set()
            while at < len(texts) and taken < TABLE_CHARS:
                cut.append(self.marked_chunks(texts[at]))
                missing |= set(cut[-1]).difference(self.table)
                taken += len(texts[at])
                at += 1
            self.add(missing)
            yield from cut

    def joined(self, chunks: list[str]) -> tuple[str, str]:
        """The ids of a text's chunks, joined by blanks with the end id last, and the text they decode to."""
        table = self.table
        found = [table[chunk] for chunk in chunks]
        # The first chunk begins with the marker that was put before the text.
        return " ".join([*[ids for ids, _ in found], self.digits[self.end]]), "".join([text for _, text in found])[1:]

    def encode(self, text: str) -> list[int]:
        """The ids of a text, with the end id."""
        return [int(i) for chunks in self.chunked([text]) for i in self.joined(chunks)[0].split()]


_SEGMENTERS: dict[str, Segmenter] = {}


def _segmenter(shipped) -> Segmenter:
    """The worker's segmenter for a shipped model, built once per worker."""
    name, model = shipped.value
    if name not in _SEGMENTERS:
        _SEGMENTERS.clear()
        _SEGMENTERS[name] = Segmenter(model)
    return _SEGMENTERS[name]


def _ship(table: DataFrame, path: str):
    """Read the model (a file of fixed size) once, check it, and send it to the workers."""
    with open(path, "rb") as file:
        model = file.read()
    Segmenter(model)
    return table.sparkSession.sparkContext.broadcast((hashlib.sha256(model).hexdigest(), model))


def _texts(column: pa.Array) -> list[str]:
    return [text or "" for text in column.to_pylist()]


def encoded(table: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): the ids of each whole text, with the end id."""
    shipped = _ship(table, path)

    def run(batches):
        segmenter = _segmenter(shipped)
        for batch in batches:
            rows = [
                [int(i) for i in segmenter.joined(chunks)[0].split()]
                for chunks in segmenter.chunked(_texts(batch.column(1)))
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], names=["key", "ids"])

    kind = table.schema[key].dataType.simpleString()
    return table.select(key, text).mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decoded(table: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text): the text of each row's ids; NULL ids count as none."""
    shipped = _ship(table, path)

    def run(batches):
        segmenter = _segmenter(shipped)
        for batch in batches:
            texts = pa.array([segmenter.decode(i or []) for i in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=["key", "decoded"])

    kind = table.schema[key].dataType.simpleString()
    found = table.select(key, ids).mapInArrow(run, f"key {kind}, decoded string")
    return found.withColumnsRenamed({"key": key, "decoded": "text"})


def round_trip_digests(table: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of each whole text.

    Digests of the decimal ids joined by blanks, the end id last, and of the text that
    the same ids decode to; neither leaves the worker.
    """
    shipped = _ship(table, path)

    def run(batches):
        segmenter = _segmenter(shipped)
        for batch in batches:
            counts, ids, texts = [], [], []
            for chunks in segmenter.chunked(_texts(batch.column(1))):
                found, text_ = segmenter.joined(chunks)
                counts.append(found.count(" ") + 1)
                ids.append(hashlib.sha256(found.encode()).hexdigest())
                texts.append(hashlib.sha256(text_.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())],
                names=["key", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = table.schema[key].dataType.simpleString()
    found = table.select(key, text).mapInArrow(
        run, f"key {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )
    return found.withColumnRenamed("key", key)
