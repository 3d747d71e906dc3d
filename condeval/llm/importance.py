"""Importance resampling towards a target corpus.

A pre-tokeniser of the tokenizers library, an untrained Split by a regular expression, cuts
ASCII-lowered text into words with offsets. Windows are pairs of offsets: from the start of
a word to the end of it, of the next, and of the one after, with one space between words.
The CRC of a window picks its bucket. CRCs of windows are put together from those of words
by shifting one past the length of the next, a column at a time. Bucket counts of the corpus
and of the target give each bucket a gain, a text weighs the sum of its windows' gains, and
Gumbel noise from a digest of the key turns the highest scores into a draw without
replacement, in proportion to the weights.

Texts are cut into words once: a document's buckets, two bytes a window, go to a table in
the shared folder, from which counts and then weights are read. Counts meet as at most
``BUCKETS`` sums, so these are all that the driver sees. Ranks come from ranges of the
scores, so no task sorts all of them.

Defined cases: NULL text has no words; a document without words weighs nothing; texts are
read whole, in spans that end at a space, and the words before a span's start are carried
into its windows; repeated rows count each and get scores alike, ties go to the smaller key,
then to the smaller weight and size; a NULL key is hashed as empty and stands after others;
empty tables have zero counts and give an empty table; other columns are neither read nor
returned.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from condeval.llm.common import checkpointed, scratch_table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS, LONGEST = 10_000, 3
# Texts are pre-tokenised in spans of about so many characters, and windows are hashed
# for about so many words at a time.
SPAN, WORDS_AT_ONCE = 240, 1 << 17
# Lengths up to this are shifted past in one step.
STEP = 63
LEAST_WORDS, SHARE = 20, (5, 100)
SEED = 42

_WIDE = 1 << 32


@lru_cache(maxsize=1)
def _splitter():
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(WORD), behavior="removed", invert=True)


def lowered(text: str) -> str:
    """A text with A to Z lower-cased, and nothing else."""
    return text.encode().lower().decode()


def spans(text: str) -> Iterator[tuple[int, str]]:
    """Pieces of a text with their places; all but the last end before a space."""
    at = 0
    while at < len(text):
        end = text.find(" ", at + SPAN) if at + SPAN < len(text) else -1
        end = len(text) if end < 0 else end
        yield at, text[at:end]
        at = end


def words_with_offsets(text: str) -> Iterator[tuple[str, tuple[int, int]]]:
    """The words of a text in lower case, each with its first character's place and its end."""
    split = _splitter().pre_tokenize_str
    for at, span in spans(lowered(text)):
        for word, (start, end) in split(span):
            yield word, (at + start, at + end)


@lru_cache(maxsize=1)
def _shifts() -> np.ndarray:
    """[length, byte, value]: what a CRC's byte of that value becomes past so many zero bytes."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    out = np.empty((STEP + 1, 4, 256), np.uint32)
    for byte in range(4):
        out[0, byte] = np.arange(256, dtype=np.uint32) << np.uint32(8 * byte)
    for length in range(1, STEP + 1):
        before = out[length - 1]
        out[length] = (before >> np.uint32(8)) ^ table[before & np.uint32(255)]
    return out


def past(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs carried past so many bytes: XOR with the CRC of those bytes gives that of both."""
    shifts, rest = _shifts(), length.astype(np.int64)
    while True:
        step = np.minimum(rest, STEP)
        crc = (
            shifts[step, 0, crc & np.uint32(255)]
            ^ shifts[step, 1, crc >> np.uint32(8) & np.uint32(255)]
            ^ shifts[step, 2, crc >> np.uint32(16) & np.uint32(255)]
            ^ shifts[step, 3, crc >> np.uint32(24)]
        )
        rest = rest - step
        if not rest.any():
            return crc


def window_crcs(crcs: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """CRCs of all runs of 1 to ``LONGEST`` words joined by a space, from those of the words."""
    space = np.uint32(zlib.crc32(b" "))
    one = np.ones(1, np.int64)
    found = [crcs]
    for _ in range(LONGEST - 1):
        longest = found[-1][:-1]
        spaced = past(longest, np.broadcast_to(one, longest.shape)) ^ space
        ends = len(found)  # the window's new last word
        found.append(past(spaced, lengths[ends:]) ^ crcs[ends:] if len(spaced) else spaced)
    return found


class _Documents:
    """Gathers the words of documents, and hashes their windows many at a time.

    A document's words are numbers that hold the CRC and length of each; words of a very
    long one are hashed as they come, with the last ``LONGEST`` - 1 kept for windows.
    """

    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self.words: list[int] = []

    def _number(self, word: str) -> int:
        raw = word.encode()
        number = len(raw) << 32 | zlib.crc32(raw)
        if len(raw) <= STEP:
            if len(self.known) >= 1 << 18:
                self.known.clear()
            self.known[word] = number
        return number

    def _hashed(self, carried: int, ends: list[int]) -> list[tuple[int, np.ndarray]]:
        """Words and buckets of each document up to its end; windows within the carried words were had before."""
        numbers = np.array(self.words, np.uint64)
        crcs = (numbers & np.uint64(_WIDE - 1)).astype(np.uint32)
        lengths = (numbers >> np.uint64(32)).astype(np.int64)
        buckets = [(c % np.uint32(BUCKETS)).astype(np.uint16) for c in window_crcs(crcs, lengths)]
        out, start = [], 0
        for end in ends:
            had = carried if start == 0 else 0
            rows = [b[max(start, start + had - k) : max(start, end - k)] for k, b in enumerate(buckets)]
            out.append((end - start - had, np.concatenate(rows)))
            start = end
        return out

    def rows(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
        """Of each text: how many words it has, and the buckets of its windows."""
        split, known, number = _splitter().pre_tokenize_str, self.known.get, self._number
        ends: list[int] = []
        for text in texts:
            parts: list[tuple[int, np.ndarray]] = []  # of this text, if it is long
            carried = 0
            for _, span in spans(lowered(text or "")):
                if len(self.words) >= WORDS_AT_ONCE:
                    *whole, part = self._hashed(carried, [*ends, len(self.words)])
                    yield from whole
                    parts.append(part)
                    start = max(ends[-1] if ends else 0, len(self.words) - LONGEST + 1)
                    self.words, ends = self.words[start:], []
                    carried = len(self.words)
                self.words += [known(word) or number(word) for word, _ in split(span)]
            if parts:
                parts += self._hashed(carried, [len(self.words)])
                yield sum(p[0] for p in parts), np.concatenate([p[1] for p in parts])
                self.words = []
            else:
                ends.append(len(self.words))
        yield from self._hashed(0, ends)
        self.words = []


def profiled(table: DataFrame, text: str = "text", key: str | None = None) -> DataFrame:
    """Rows (key, n_words, buckets) of documents, if a key is named, and (bucket, n) of the windows in each task."""
    kind = table.schema[key].dataType.simpleString() if key else "bigint"
    names = ["key", "n_words", "buckets", "bucket", "n"]

    def run(batches):
        documents, counts = _Documents(), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            words, buckets = [], []
            for n, found in documents.rows(batch.column(0).to_pylist()):
                counts += np.bincount(found, minlength=BUCKETS)
                words.append(n)
                buckets.append(found.tobytes() if key else None)
            if key:
                nothing = pa.nulls(len(words), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1), pa.array(words, pa.int64()), pa.array(buckets, pa.binary()), nothing, nothing],
                    names=names,
                )
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.nulls(len(seen), key_type),
                pa.nulls(len(seen), pa.int64()),
                pa.nulls(len(seen), pa.binary()),
                pa.array(seen),
                pa.array(counts[seen]),
            ],
            names=names,
        )

    key_type = to_arrow_type(table.schema[key].dataType) if key else pa.int64()
    return table.select(text, *([key] if key else [])).mapInArrow(
        run, f"key {kind}, n_words bigint, buckets binary, bucket bigint, n bigint"
    )


def bucket_counts(profile: DataFrame) -> np.ndarray:
    """Windows in each bucket: at most ``BUCKETS`` sums come to the driver."""
    counts = [0] * BUCKETS
    for bucket, n in profile.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("n")).collect():
        counts[bucket] = n
    return np.array(counts, np.float64)


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(((t + 1)(S + BUCKETS)) / ((s + 1)(T + BUCKETS)))) of each bucket, in doubles."""
    whole, aimed = corpus.sum() + BUCKETS, target.sum() + BUCKETS
    ratios = ((target + 1) * whole) / ((corpus + 1) * aimed)
    return np.array([math.floor(1000 * math.log(r)) for r in ratios.tolist()], np.int64)


def noise(key: str, seed: int = SEED) -> Column:
    """Gumbel noise of a key in thousandths, rounded down."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    drawn = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((drawn + 0.5) / 4294967296.0)))


def weighed(profile: DataFrame, gains: np.ndarray) -> DataFrame:
    """(key, n_words, n_features, weight) of each document of a profile."""
    shipped = profile.sparkSession.sparkContext.broadcast(gains)
    kind = profile.schema["key"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            column = batch.column(2)
            _, offsets, values = column.cast(pa.large_binary()).buffers()
            ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
            of_window = shipped.value[np.frombuffer(values or b"", np.uint16)[ends[0] // 2 : ends[-1] // 2]]
            sums = np.concatenate([[0], np.cumsum(of_window)])
            places = (ends - ends[0]) // 2
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(np.diff(places)),
                    pa.array(sums[places[1:]] - sums[places[:-1]]),
                ],
                names=["key", "n_words", "n_features", "weight"],
            )

    rows = profile.where("n_words IS NOT NULL").select("key", "n_words", "buckets")
    return rows.mapInArrow(run, f"key {kind}, n_words bigint, n_features bigint, weight bigint")


def ranked(rows: DataFrame, order: list[Column], rank: str = "rank") -> DataFrame:
    """Rows with their place, from 1, in an order of the whole table.

    Rows are dealt by ranges of the order, ranked inside their range, and a range starts
    after the rows of those before it; the ranges' sizes are all that is added up in one task.
    """
    spread = rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    dealt = checkpointed(spread)
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_size"))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    inside = dealt.withColumn("_place", F.row_number().over(W.partitionBy("_range").orderBy(*order)))
    placed = inside.join(starts, "_range").withColumn(rank, F.col("_start") + F.col("_place"))
    return placed.drop("_range", "_start", "_place")


def resampled(
    table: DataFrame,
    target: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    least_words: int = LEAST_WORDS,
    share: tuple[int, int] = SHARE,
    seed: int = SEED,
) -> DataFrame:
    """(key, n_words, n_features, weight, score, rank) of every document.

    Of the N documents with at least ``least_words`` words, the floor(N * share) highest
    scores are drawn and numbered from 1; ``rank`` is NULL for all others.
    """
    profile = scratch_table(profiled(table, text, key))
    gains = bucket_gains(bucket_counts(profile), bucket_counts(profiled(target, target_text)))
    rows = checkpointed(weighed(profile, gains).withColumn("score", F.col("weight") + noise("key", seed)))
    enough = F.col("n_words") >= least_words
    drawn = rows.where(enough).count() * share[0] // share[1]
    order = [F.desc("score"), F.asc_nulls_last("key"), F.asc("weight"), F.asc("n_words"), F.asc("n_features")]
    placed = ranked(rows.where(enough), order)
    placed = placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return placed.unionByName(rows.where(~enough).withColumn("rank", F.lit(None).cast("bigint"))).withColumnRenamed("key", key)


def _feature_sql(table: str, key: str) -> str:
    """(key, feature, times) of a table's texts."""
    return f"""
      SELECT key, feature, count(*) AS times FROM (
        SELECT key, unnest(list_concat(w, list_concat(
                 list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]),
                 list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))) AS feature
        FROM (SELECT {key} AS key, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {table}))
      GROUP BY ALL"""


# The CRC is computed byte by byte, from the 256 values of its table.
ORACLE = f"""
    WITH RECURSIVE bits(i, k, v) AS (
      SELECT i, 0, i::BIGINT FROM range(256) r(i)
      UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
    crc_table AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
    of_documents AS ({_feature_sql("documents", "doc_id")}),
    of_benchmark AS ({_feature_sql("benchmark", "item_id")}),
    buckets AS (
      SELECT feature, xor(list_reduce(
               list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
               lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % {BUCKETS} AS bucket
      FROM (SELECT feature, hex(encode(feature)) AS h
            FROM (SELECT feature FROM of_documents UNION SELECT feature FROM of_benchmark)), crc_table),
    s AS (SELECT bucket, sum(times)::DOUBLE AS s FROM of_documents JOIN buckets USING (feature) GROUP BY bucket),
    t AS (SELECT bucket, sum(times)::DOUBLE AS t FROM of_benchmark JOIN buckets USING (feature) GROUP BY bucket),
    gains AS (
      SELECT bucket, floor(1000 * ln(
               ((coalesce(t, 0) + 1) * ((SELECT coalesce(sum(s), 0) FROM s) + {BUCKETS}))
               / ((coalesce(s, 0) + 1) * ((SELECT coalesce(sum(t), 0) FROM t) + {BUCKETS}))))::BIGINT AS gain
      FROM s FULL JOIN t USING (bucket)),
    weights AS (
      SELECT key, sum(times)::BIGINT AS n_features, sum(times * gain)::BIGINT AS weight
      FROM of_documents JOIN buckets USING (feature) JOIN gains USING (bucket) GROUP BY key),
    scored AS (
      SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(
               -1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
      FROM documents LEFT JOIN weights ON key = doc_id),
    -- 20 words or more have 57 windows or more
    placed AS (
      SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n
      FROM scored WHERE n_features >= {3 * LEAST_WORDS - 3})
    SELECT doc_id, n_features, weight, score, CASE WHEN place <= n * {SHARE[0]} // {SHARE[1]} THEN place END AS rank
    FROM scored LEFT JOIN placed USING (doc_id)"""
