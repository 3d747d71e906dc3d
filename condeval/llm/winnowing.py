"""Document fingerprints by winnowing.

Every run of ``GRAM`` code points has a rolling hash. Of every ``WINDOW`` hashes in a
row the smallest is kept, the rightmost of equals, together with its position. Two texts
that share GRAM + WINDOW - 1 code points in a row share a kept hash, at positions that
tell where.

Defined cases: NULL text counts as empty, and has an empty fingerprint; a text shorter
than a gram has one hash, of the whole; a text with fewer hashes than a window keeps the
smallest. Two empty fingerprints are alike by 1, an empty one and another by 0. Texts of
any length are hashed in whole. Rows that repeat a key follow each other, in order of
their texts; NULL keys come after all others. Keys are numbers, as ranges of them are cut
by percentiles. An empty table gives an empty table; other
columns are neither read nor returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Code points of a gram (a power of two) and hashes of a window.
GRAM, WINDOW = 16, 16
BASE = 0x9E3779B97F4A7C15
MIXED = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
# Ranges of keys for each of the session's shuffle partitions.
RANGES = 4


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(points: np.ndarray) -> np.ndarray:
    """32-bit hashes of all grams: a polynomial, doubled from pairs up to GRAM, then mixed."""
    if len(points) < GRAM:
        if not len(points):
            return np.empty(0, np.uint64)
        value = len(points)
        for point in points.tolist():
            value = (value * BASE + point + 1) & ((1 << 64) - 1)
        hashes = np.array([value], np.uint64)
    else:
        hashes = points.astype(np.uint64)
        width, factor = 1, BASE
        while width < GRAM:
            ahead = hashes[width:]
            hashes = hashes[: len(ahead)] * np.uint64(factor)
            hashes += ahead
            width, factor = 2 * width, factor * factor & ((1 << 64) - 1)
    hashes ^= hashes >> np.uint64(33)
    hashes *= np.uint64(MIXED[0])
    hashes ^= hashes >> np.uint64(29)
    hashes *= np.uint64(MIXED[1])
    return hashes >> np.uint64(32)


def winnowed(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Kept hashes and their positions, in order of position."""
    return _winnowed(_points(text))


def _winnowed(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hashes = gram_hashes(points)
    if not len(hashes):
        return hashes, hashes
    # Hash above, distance from the end below: the least is the rightmost of the smallest.
    keyed = hashes << np.uint64(32)
    keyed |= np.uint64(0xFFFFFFFF) - np.arange(len(hashes), dtype=np.uint64)
    width = 1
    size = min(WINDOW, len(hashes))
    while width < size:
        step = min(width, size - width)
        keyed = np.minimum(keyed[: len(keyed) - step], keyed[step:])
        width += step
    kept = keyed[np.concatenate([[True], keyed[1:] != keyed[:-1]])]
    return kept >> np.uint64(32), np.uint64(0xFFFFFFFF) - (kept & np.uint64(0xFFFFFFFF))


def likeness(left: np.ndarray, right: np.ndarray) -> float:
    """Share of common values in two sorted sets."""
    if not len(left) and not len(right):
        return 1.0
    both = len(np.intersect1d(left, right, assume_unique=True))
    return both / (len(left) + len(right) - both)


def digest(kept: tuple[np.ndarray, np.ndarray]) -> str:
    """A fingerprint as a string: 128 bits of its hashes and positions; empty if it has none."""
    if not len(kept[0]):
        return ""
    parts = kept[0].astype("<u4").tobytes() + kept[1].astype("<u4").tobytes()
    return hashlib.blake2b(parts, digest_size=16).hexdigest()


def fingerprints(table: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, hashes, positions): the fingerprint of each whole text."""

    def run(batches):
        for batch in batches:
            found = [winnowed(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *(pa.array([f[i].astype(np.int64) for f in found], pa.list_(pa.int64())) for i in range(2)),
                ],
                names=[key, "hashes", "positions"],
            )

    kind = table.schema[key].dataType.simpleString()
    return table.select(key, text).mapInArrow(run, f"`{key}` {kind}, hashes array<bigint>, positions array<bigint>")


def _cuts(table: DataFrame, key: str, count: int) -> list:
    """Keys, from large to small, that cut a table into about ``count`` ranges of equal rows."""
    shares = F.array(*(F.lit((i + 1) / count) for i in range(count - 1))) if count > 1 else F.array(F.lit(0.5))
    found = table.agg(F.percentile_approx(key, shares, max(10_000, 10 * count))).first()[0]
    return sorted(set(found or []), reverse=True)


def _range_of(key: str, cuts: list) -> Column:
    """A number that grows from range to range as keys fall; NULL keys come last.

    Cuts are looked up in two steps, first among runs of them and then in one run.
    """
    width = max(1, round(len(cuts) ** 0.5))
    runs = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    if not runs:
        return F.col(key).isNull().cast("int")
    above = lambda values: F.size(F.filter(values, lambda c: c >= F.col(key)))
    full = above(F.lit([run[-1] for run in runs]))
    place = full * width + above(F.element_at(F.lit([*runs, runs[-1]]), full + 1))
    return F.when(F.col(key).isNull(), (len(runs) + 1) * width + 1).otherwise(place).cast("int")


def edited_fingerprints(table: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text's fingerprint against that of an edited text and of the next document.

    Documents follow each other by descending key, the first after the last. The edited
    text has the last third of the code points replaced by the first of the next text.

    Keys are cut into ranges, a range is sorted in one task, and the first document of
    a range visits the range before it, so texts are shuffled once and no task sees
    more than its ranges.
    """
    rows = table.select(F.col(key).alias("key"), F.col(text).alias("text"))
    count = RANGES * int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.withColumn("range", _range_of("key", _cuts(rows, "key", count)))
    # One row a range, and the ranges are ``count``: in order, each visits the one before
    # it, and the first visits the last.
    heads = ranged.groupBy("range").agg(F.max("key").alias("head")).orderBy("range").collect()
    before = F.lit(None).cast("int")
    if heads:
        places = [h["range"] for h in heads]
        earlier = F.create_map(*(F.lit(p) for i, own in enumerate(places) for p in (own, places[i - 1])))
        known = F.col("key").isin([h["head"] for h in heads if h["head"] is not None])
        before = F.when(known | F.col("key").isNull(), F.element_at(earlier, F.col("range")))
    placed = ranged.select(
        "key",
        "text",
        F.explode(
            F.filter(
                F.array(
                    F.struct(F.col("range").alias("range"), F.lit(0).alias("visit")),
                    F.struct(before.alias("range"), F.lit(1).alias("visit")),
                ),
                lambda s: s["range"].isNotNull(),
            )
        ).alias("place"),
    ).select("key", "text", "place.range", "place.visit")
    dealt = placed.repartition(count, "range").sortWithinPartitions(
        "range", "visit", F.col("key").desc_nulls_last(), "text"
    )

    def run(batches):
        yield from _compared(batches)

    kind = table.schema[key].dataType.simpleString()
    found = dealt.mapInArrow(
        run,
        f"key {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string,"
        " near_edited double, near_next double, n_kept bigint",
    )
    return found.withColumnRenamed("key", key)


def _compared(batches) -> Iterator[pa.RecordBatch]:
    """Rows of every document that isn't a visitor, read against the one that follows it."""
    held = None  # (range, key, text, fingerprint, sorted hashes) that waits for the next
    for batch in batches:
        out: list[list] = [[] for _ in range(8)]
        columns = (batch.column(i).to_pylist() for i in range(4))
        for key, text, place, visit in zip(*columns, strict=True):
            if visit and (held is None or held[0] != place):
                continue
            text = text or ""
            points = _points(text)
            kept = _winnowed(points)
            mine = (place, key, points, kept, np.unique(kept[0]))
            if held is not None and held[0] == place:
                for column, value in zip(out, _row(held, mine), strict=True):
                    column.append(value)
            held = None if visit else mine
        kinds = (None, pa.int64(), *(pa.string(),) * 3, pa.float64(), pa.float64(), pa.int64())
        names = (
            "key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_kept",
        )
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k or batch.column(0).type) for c, k in zip(out, kinds, strict=True)], names=list(names)
        )


def _row(one: tuple, following: tuple) -> tuple:
    _, key, points, kept, hashes = one
    cut = len(points) // 3
    edited = np.concatenate([points[: len(points) - cut], following[2][:cut]])
    changed = _winnowed(edited)
    raw = edited.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    return (
        key,
        len(points),
        hashlib.sha256(raw).hexdigest(),
        digest(kept),
        digest(changed),
        likeness(hashes, np.unique(changed[0])),
        likeness(hashes, following[4]),
        len(kept[0]),
    )
