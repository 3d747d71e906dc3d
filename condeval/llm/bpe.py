"""Byte-pair encoding and decoding with a given vocabulary file.

A word is a doubly linked list of symbols. A priority queue holds the merges its
neighbours allow, lowest rank and leftmost first; a merge relinks two nodes and
queues the pairs it made, and an entry whose nodes have changed since is skipped.
Decoding concatenates vocabulary strings.

Defined cases: NULL text counts as empty and has no ids; an empty table gives an
empty table; repeated rows and ties give equal rows; a text is never cut, and a
word of any length takes n log n steps; other columns are neither read nor
returned, so their names can't clash.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the vocabulary file's format.
WORD_END = "</w>"
WORDS = (
    r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]"
    r"|[^\p{White_Space}\p{L}\p{N}]+"
)
# Ids, and places in a word, as parts of one number.
ID_BITS, PLACE_BITS = 20, 40
ID_MASK, PLACE_MASK = (1 << ID_BITS) - 1, (1 << PLACE_BITS) - 1
# Below this code point, letters and digits are listed for Python's own, faster matcher.
LATIN = 0x250
# A worker keeps the encodings of this many words at most, twice.
KEPT_WORDS = 150_000
# Longer words are encoded each time.
KEPT_LENGTH = 48


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Encoder:
    """Encodes and decodes texts by the merges of one vocabulary file."""

    def __init__(self, vocabulary: str) -> None:
        import regex

        parsed = json.loads(vocabulary)
        ids = parsed["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        self.strings = {i: s for s, i in [*ids.items(), *self.special.items()]}
        self.merges = {
            ids[a] << ID_BITS | ids[b]: rank << ID_BITS | ids[a + b]
            for rank, (a, b) in enumerate(parsed["model"]["merges"])
        }
        letters = byte_letters()
        self.inner = [ids[c] for c in letters]
        self.last = [ids[c + WORD_END] for c in letters]
        self.find_any = regex.compile(WORDS).findall
        self.beyond_latin = re.compile(f"[{chr(LATIN)}-{chr(sys.maxunicode)}]").search
        kinds = {"L": "", "N": "", "Z": "\t\n\x0b\x0c\r\x85"}
        for letter in map(chr, range(LATIN)):
            kind = unicodedata.category(letter)[0]
            kinds[kind] = kinds.get(kind, "") + letter
        letters_, digits, spaces = (re.escape(kinds[k]) for k in "LNZ")
        self.find_latin = re.compile(
            f"'(?:[stmd]|re|ve|ll)|[{letters_}]+|[{digits}]|[^{spaces}{letters_}{digits}]+"
        ).findall
        longest_first = sorted(map(regex.escape, self.special), key=len, reverse=True)
        self.split = regex.compile(f"({'|'.join(longest_first)})").split if longest_first else None
        self.young: dict[str, tuple[int, str, str]] = {}
        self.old: dict[str, tuple[int, str, str]] = {}

    def word_ids(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "surrogatepass")
        symbol = [self.inner[b] for b in raw]
        symbol[-1] = self.last[raw[-1]]
        size = len(raw)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        merge_of = self.merges.get
        # A queued merge is one number: its rank, then the place of its left node.
        queue = []
        left = symbol[0]
        for at in range(size - 1):
            right = symbol[at + 1]
            if (found := merge_of(left << ID_BITS | right)) is not None:
                queue.append(found >> ID_BITS << PLACE_BITS | at)
            left = right
        heapq.heapify(queue)
        while queue:
            entry = heapq.heappop(queue)
            at = entry & PLACE_MASK
            following = after[at]
            if following >= size or (left := symbol[at]) < 0:
                continue
            found = merge_of(left << ID_BITS | symbol[following])
            if found is None or found >> ID_BITS != entry >> PLACE_BITS:
                continue  # stale: one of its nodes has been merged since
            symbol[at] = merged = found & ID_MASK
            symbol[following] = -1
            after[at] = end = after[following]
            if end < size:
                before[end] = at
                found = merge_of(merged << ID_BITS | symbol[end])
                if found is not None:
                    heapq.heappush(queue, found >> ID_BITS << PLACE_BITS | at)
            start = before[at]
            if start >= 0:
                found = merge_of(symbol[start] << ID_BITS | merged)
                if found is not None:
                    heapq.heappush(queue, found >> ID_BITS << PLACE_BITS | start)
        return [s for s in symbol if s >= 0]

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.strings[i] for i in ids])

    def entry(self, word: str) -> tuple[int, str, str]:
        """How many ids a word has, and they and their strings, each joined by spaces."""
        if (found := self.young.get(word)) is not None:
            return found
        if (found := self.old.get(word)) is None:
            ids = self.word_ids(word)
            found = (len(ids), " ".join(map(str, ids)), self.decode(ids))
        if len(word) <= KEPT_LENGTH:
            if len(self.young) >= KEPT_WORDS:
                self.old, self.young = self.young, {}
            self.young[word] = found
        return found

    def entries(self, text: str) -> Iterator[tuple[int, str, str]]:
        """Entries of all words and special tokens of a text, in order."""
        parts = self.split(text) if self.split and "<" in text else [text]
        for k, part in enumerate(parts):
            if k % 2:
                yield 1, str(self.special[part]), part
            elif part:
                # Letters are lower-cased one by one, so no final sigma is made.
                normal = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                find = self.find_any if self.beyond_latin(normal) else self.find_latin
                known = self.young.get
                yield from [known(word) or self.entry(word) for word in find(normal)]

    def encode(self, text: str) -> list[int]:
        return [int(i) for _, ids, _ in self.entries(text) for i in ids.split(" ")]


_ENCODERS: dict[str, Encoder] = {}


def _encoder(shipped) -> Encoder:
    """The worker's encoder for a shipped vocabulary, built once per worker."""
    name, vocabulary = shipped.value
    if name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[name] = Encoder(vocabulary)
    return _ENCODERS[name]


def _ship(table: DataFrame, path: str):
    """Read the vocabulary (a file of fixed size) once and send it to the workers."""
    with open(path, encoding="utf-8") as file:
        vocabulary = file.read()
    name = hashlib.sha256(vocabulary.encode()).hexdigest()
    return table.sparkSession.sparkContext.broadcast((name, vocabulary))


def encoded(table: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): the ids of each whole text."""
    shipped = _ship(table, path)

    def run(batches):
        encoder = _encoder(shipped)
        for batch in batches:
            ids = pa.array([encoder.encode(t or "") for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    kind = table.schema[key].dataType.simpleString()
    return table.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decoded(table: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text): the strings of each row's ids; NULL ids count as none."""
    shipped = _ship(table, path)

    def run(batches):
        encoder = _encoder(shipped)
        for batch in batches:
            texts = pa.array([encoder.decode(i or []) for i in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=[key, "text"])

    kind = table.schema[key].dataType.simpleString()
    return table.select(key, ids).mapInArrow(run, f"`{key}` {kind}, text string")


def round_trip_digests(table: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of each whole text.

    The same encoder and decoder as above, without the ids leaving the worker:
    digests of the decimal ids joined by spaces and of the decoded text.
    """
    shipped = _ship(table, path)

    def run(batches):
        encoder = _encoder(shipped)
        for batch in batches:
            counts, ids, texts = [], [], []
            for value in batch.column(1).to_pylist():
                entries = list(encoder.entries(value or ""))
                counts.append(sum([e[0] for e in entries]))
                ids.append(hashlib.sha256(" ".join([e[1] for e in entries]).encode()).hexdigest())
                texts.append(hashlib.sha256(" ".join([e[2] for e in entries]).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())],
                names=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = table.schema[key].dataType.simpleString()
    return table.select(key, F.col(text)).mapInArrow(
        run, f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )
