"""N-gram Jaccard join: a forest of count-vector R-trees, one tree to a cell.

A document's set holds its distinct word 5-grams, as 64-bit hashes. Hashed once more
into ``GROUPS`` groups they make a count vector, the point an R-tree indexes. Two sets
share at most the sum, over groups, of the smaller count; a node keeps the largest
count of each group and the smallest size below it, so the same sum bounds whole
subtrees. Pairs that survive the bound are verified on the sets themselves.

One tree over everything would prune nothing near its root: boxes over many unrelated
texts hold every count. So points are first dealt into cells no link can escape. A
link shares three quarters of each set, hence two linked sets share a hash among the
first ``n - ceil(0.75 n) + 1`` of each, in any order both agree on. A cell is such a
hash and its points. Hashes that many documents
share come last in the order, so that common passages don't fill cells. Which hashes
these are only changes the time taken, never the result.

Steps: equal sets are one class. Cells of up to ``LEAF`` points are joined outright; in
larger ones each point is first paired with one pivot. Verified pairs make components,
and the trees of large cells are then joined with themselves, skipping subtrees that
lie in one component already. So a large group of near copies costs its size, not its
square, and no link between different components is lost.

Defined cases: NULL or wordless text has an empty set, linked with nothing; equal texts
share a class; an empty table gives an empty table; repeated rows count as copies; a
NULL key is never a component's smallest unless all its keys are NULL; other columns
are neither read nor returned.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from condeval.llm.common import checkpointed, free_names, in_small_batches

WORDS = 5
# Link: PART * union <= WHOLE * intersection.
PART, WHOLE = 75, 100
GROUPS = 256
SATURATED = 255
LEAF, FANOUT = 8, 8
# Points that a pivot is chosen by.
CENTRAL = 32
# Classes of a cell that one task holds, and more blocks than any cell has.
BLOCK, BLOCKS = 8192, 1 << 31
# Bits of a set's name besides those of its size.
NAME_BITS = 55
# Steps of a class's size per doubling, and by how many those of linked sets differ at most.
SIZE_STEPS, SIZE_MASK = 8, 255
SIZE_APART = int(SIZE_STEPS * math.log2(WHOLE / PART)) + 1
# The filter that finds texts again has about so many bits a key, within these bounds, and
# looks at so many of them.
BITS_PER_KEY, FEWEST_BITS, MOST_BITS = 32, 1 << 18, 1 << 27
LOOKS = 3
# Most groups of a fine count vector.
MOST_GROUPS = 1 << 16
# Pairs whose counts are compared at a time, 2 MB a side.
PIECE_PAIRS = 8192
# A point tells so many of its large cells, the first ones, so that a pair is found in one of them only.
TOLD = 16
# Texts are hashed in pieces of about so many bytes, and searched for hashes that
# repeat in pieces of about so many hashes.
PIECE_BYTES, PIECE_HASHES = 1 << 19, 2_000_000
# A hash is frequent from so many sightings in pieces where it repeats. So many
# frequent hashes at most, the most frequent, are sent to the workers (8 bytes each).
FREQUENT, MOST_FREQUENT = 4, 400_000
MULTIPLIER = 0x9E3779B97F4A7C15
MIXED = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)

_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIXED[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIXED[1])
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _power_tables(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64."""
    size = 1 << max(16, int(count).bit_length())
    return _powers(MULTIPLIER, size), _powers(pow(MULTIPLIER, -1, 1 << 64), size)


def _piece_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text in a run of bytes."""
    count = len(offsets) - 1
    data = _LOWER[data]
    inside = ~_SPACE[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    starts[first], ends[last] = inside[first], inside[last]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    words = _mixed((sums[end] - sums[start]) * down[start])
    bounds = np.searchsorted(start, offsets)
    grams = np.zeros(max(0, len(words) - WORDS + 1), np.uint64)
    for k in range(WORDS):
        grams += words[k : k + len(grams)] * up[2 * k + 1]
    grams = _mixed(grams)
    out = []
    for i in range(count):
        a, b = bounds[i], bounds[i + 1]
        if b - a >= WORDS:
            out.append(np.unique(grams[a : b - WORDS + 1]))
        elif b > a:
            whole = (words[a:b] * up[1 : 2 * (b - a) : 2]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(_mixed(np.array([whole], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The shingle set of each text of an Arrow column, in order."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, places, values = texts.buffers()
    offsets = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(values or b"", np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE_BYTES, side="right")) - 1)
        end = min(end, len(texts))
        yield from _piece_sets(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
        at = end


def name_of(hashes: np.ndarray, bits: int = NAME_BITS) -> tuple[int, int]:
    """A set's name and check: bits of a digest.

    A name has ``bits`` bits, and eight low ones that tell the size on a logarithmic
    scale; it is not negative. The check has 64 other bits.
    """
    digest = hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
    name, check = (int.from_bytes(digest[i : i + 8], "little", signed=True) for i in (0, 8))
    scale = min(SIZE_MASK, int(SIZE_STEPS * math.log2(len(hashes)))) if len(hashes) else 0
    return (name & ((1 << bits) - 1)) << 8 | scale, check


# Bits of a name, and the numbers of sets that have another's name.
Names = tuple[int, dict[tuple[int, int], int]]


def class_of(hashes: np.ndarray, names: Names) -> int:
    """The number that stands for a set: its name, or another where several sets have that name."""
    bits, renamed = names
    name, check = name_of(hashes, bits)
    return renamed.get((name, check), name) if renamed else name


def _renamed(rows: DataFrame) -> dict[tuple[int, int], int]:
    """New numbers for all but one of the sets that share a name.

    Among n sets about n * n / 2**56 names are shared, so these are few: 2 at 4 * 10**8 sets.
    The new numbers are negative, and so differ from all names and from each other.
    """
    shared = rows.groupBy("class").agg(F.min("check").alias("low"), F.max("check").alias("high"))
    shared = shared.where("low < high").select("class", "low")
    others = rows.join(shared, "class").where("check <> low").select("class", "check").distinct()
    found = sorted((r["class"], r["check"]) for r in others.collect())
    return {(name, check): -(i + 1 << 8) | name & SIZE_MASK for i, (name, check) in enumerate(found)}


def routing_hashes(hashes: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The first hashes of a set in the agreed order: frequent ones last, else by value."""
    size = len(hashes)
    needed = size - -(-PART * size // WHOLE) + 1 if size else 0
    if needed and len(frequent):
        places = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
        common = frequent[places] == hashes
        if common.any():
            hashes = np.concatenate([hashes[~common], hashes[common]])
    return hashes[:needed]


def group_counts(hashes: np.ndarray, groups: int = 0) -> np.ndarray:
    """A set's count vector; counts from ``SATURATED`` on are kept as that."""
    groups = groups or GROUPS
    found = (hashes >> np.uint64(40)) % np.uint64(groups)
    return np.minimum(np.bincount(found.astype(np.intp), minlength=groups), SATURATED).astype(np.uint8)


def _packed(counts: np.ndarray) -> bytes:
    """A count vector as it is stored and shuffled. Counts are small, so bytes of them pack well."""
    return zlib.compress(counts.tobytes(), 1)


def _rows_of(packed: list[bytes]) -> np.ndarray:
    """Count vectors as rows."""
    return np.frombuffer(b"".join(map(zlib.decompress, packed)), np.uint8).reshape(-1, GROUPS)


def fine_counts(hashes: np.ndarray) -> bytes:
    """A set's size, and a count vector of about as many groups as it has hashes."""
    groups = min(MOST_GROUPS, max(GROUPS, 1 << (len(hashes) - 1).bit_length()))
    return len(hashes).to_bytes(8, "little") + _packed(group_counts(hashes, groups))


def fine_may_link(left: bytes, right: bytes) -> bool:
    """The bound of ``_may_link`` on two fine vectors, the longer folded to the shorter."""
    a, b = (np.frombuffer(zlib.decompress(x[8:]), np.uint8) for x in (left, right))
    groups = min(len(a), len(b))
    a, b = (np.where((x == SATURATED).reshape(-1, groups).any(axis=0), 1 << 20, x.reshape(-1, groups).sum(axis=0, dtype=np.int64)) for x in (a, b))
    sizes = [int.from_bytes(x[:8], "little") for x in (left, right)]
    return _fits(sizes[0], sizes[1]) and (PART + WHOLE) * int(np.minimum(a, b).sum()) >= PART * sum(sizes)


def linked(left: bytes, right: bytes) -> bool:
    """Whether two sets link."""
    a, b = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return WHOLE * both >= PART * (len(a) + len(b) - both)


def _fits(size_a, size_b):
    """Whether two sizes allow a link."""
    return PART * np.maximum(size_a, size_b) <= WHOLE * np.minimum(size_a, size_b)


def _shared_at_most(counts_a: np.ndarray, counts_b: np.ndarray) -> np.ndarray:
    """Summed minima of packed counts, row by row; counts that are saturated in both bound nothing."""
    least = np.minimum(counts_a, counts_b)
    found = least.sum(axis=1, dtype=np.int64)
    found[(least == SATURATED).any(axis=1)] = 1 << 40
    return found


def _may_link(size_a, counts_a, size_b, counts_b) -> np.ndarray:
    """Whether summed minima of the counts, and the sizes, allow a link, row by row.

    A link shares at least PART (a + b) / (PART + WHOLE) hashes. Sizes are looked at first.
    """
    size_a, size_b = np.broadcast_arrays(size_a, size_b)
    allowed = _fits(size_a, size_b)
    shape = (len(allowed), counts_a.shape[-1])
    counts_a, counts_b = np.broadcast_to(counts_a, shape), np.broadcast_to(counts_b, shape)
    left = np.flatnonzero(allowed)
    for at in range(0, len(left), PIECE_PAIRS):
        rows = left[at : at + PIECE_PAIRS]
        shared = _shared_at_most(counts_a[rows], counts_b[rows])
        allowed[rows] = (PART + WHOLE) * shared >= PART * (size_a[rows] + size_b[rows])
    return allowed


class CountTree:
    """An R-tree over count vectors, bulk-loaded level by level.

    Leaves hold ``LEAF`` points that are neighbours by component, size and counts.
    """

    def __init__(self, sizes: np.ndarray, counts: np.ndarray, components: np.ndarray) -> None:
        order = np.lexsort((counts[:, 1], counts[:, 0], sizes, components))
        self.order = order
        self.levels = [(counts[order], sizes[order], sizes[order], components[order], components[order])]
        width = LEAF
        while len(self.levels[-1][0]) > 1:
            top, least, most, low, high = self.levels[-1]
            cuts = np.arange(0, len(top), width)
            self.levels.append(
                (
                    np.maximum.reduceat(top, cuts),
                    np.minimum.reduceat(least, cuts),
                    np.maximum.reduceat(most, cuts),
                    np.minimum.reduceat(low, cuts),
                    np.maximum.reduceat(high, cuts),
                )
            )
            width = FANOUT

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Point pairs of different components that the bound allows, in pieces of bounded size.

        Depth first: each level holds one piece of pairs of nodes at a time.
        """
        todo = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while todo:
            level, a, b = todo.pop()
            if len(a) > PIECE_PAIRS:
                todo.append((level, a[PIECE_PAIRS:], b[PIECE_PAIRS:]))
                a, b = a[:PIECE_PAIRS], b[:PIECE_PAIRS]
            top, least, most, low, high = self.levels[level]
            small = PART * np.maximum(least[a], least[b]) <= WHOLE * np.minimum(most[a], most[b])
            mixed = ~((low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b]))
            keep = small & mixed
            a, b = a[keep], b[keep]
            fits = (PART + WHOLE) * _shared_at_most(top[a], top[b]) >= PART * (least[a] + least[b])
            a, b = a[fits], b[fits]
            if level == 0:
                if len(a):
                    yield self.order[a], self.order[b]
                continue
            width = LEAF if level == 1 else FANOUT
            below = len(self.levels[level - 1][0])
            step = max(1, PIECE_PAIRS // width**2)
            for at in range(0, len(a), step):
                left = (a[at : at + step, None] * width + np.arange(width))[:, :, None]
                right = (b[at : at + step, None] * width + np.arange(width))[:, None, :]
                left, right = (x.ravel() for x in np.broadcast_arrays(left, right))
                good = (left < below) & (right < below)
                good &= left < right if level == 1 else left <= right
                todo.append((level - 1, left[good], right[good]))


def _profiles(table: DataFrame, key: str, text: str, bits: int = NAME_BITS) -> DataFrame:
    """(key, class, size, counts) of each document, and (hash, sightings) rows of repeating hashes."""
    schema = "key {}, class bigint, check bigint, size bigint, counts binary, hash bigint, sightings bigint".format(
        table.schema[key].dataType.simpleString()
    )

    names = ["key", "class", "check", "size", "counts", "hash", "sightings"]

    def repeating(sets: dict[int, np.ndarray], kind: pa.DataType):
        every = np.concatenate([*sets.values(), np.empty(0, np.uint64)])
        sets.clear()
        every.sort()
        found, times = np.unique(every[1:][every[1:] == every[:-1]], return_counts=True)
        times += 1
        return pa.RecordBatch.from_arrays(
            [
                pa.nulls(len(found), kind),
                pa.nulls(len(found), pa.int64()),
                pa.nulls(len(found), pa.int64()),
                pa.nulls(len(found), pa.int64()),
                pa.nulls(len(found), pa.binary()),
                pa.array(found.view(np.int64)),
                pa.array(times.astype(np.int64)),
            ],
            names=names,
        )

    def run(batches):
        sets: dict[int, np.ndarray] = {}
        held = 0
        for batch in batches:
            kind = batch.column(0).type
            classes, checks, sizes, counts = [], [], [], []
            for hashes in shingle_sets(batch.column(1)):
                name, check = name_of(hashes, bits)
                classes.append(name)
                checks.append(check)
                sizes.append(len(hashes))
                counts.append(_packed(group_counts(hashes)))
                if check not in sets:
                    sets[check] = hashes
                    held += len(hashes)
                    if held > PIECE_HASHES:
                        yield repeating(sets, kind)
                        held = 0
            nothing = pa.nulls(len(classes), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(classes, pa.int64()),
                    pa.array(checks, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(counts, pa.binary()),
                    nothing,
                    nothing,
                ],
                names=names,
            )
        if sets:
            yield repeating(sets, kind)

    return table.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)


def _postings(table: DataFrame, text: str, frequent, names: Names) -> DataFrame:
    """(hash, class): where each set is to be found."""

    def run(batches):
        for batch in batches:
            seen: set[int] = set()
            hashes, classes = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            for found in shingle_sets(batch.column(0)):
                if len(found) and (name := class_of(found, names)) not in seen:
                    seen.add(name)
                    hashes.append(routing_hashes(found, frequent.value))
                    classes.append(np.full(len(hashes[-1]), name, np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate(classes))],
                names=["hash", "class"],
            )

    return table.select(text).mapInArrow(run, "hash bigint, class bigint")


def _shared(postings: DataFrame) -> DataFrame:
    """Cells of at least two classes: small ones as pairs (class, other), large ones as (hash, part, class).

    Rows come sorted, so a cell is read as a stream, whatever its size; only the up to
    ``LEAF`` rows of an unfinished small cell are held. A large cell is cut into parts of
    ``BLOCK`` classes, and its smallest class is in each. Pairs that their sizes rule out
    are left out.
    """

    def batch(hashes, parts, classes, others):
        return pa.RecordBatch.from_arrays(
            [pa.array(x, pa.int64()) if x is not None else pa.nulls(len(classes), pa.int64()) for x in (hashes, parts, classes, others)],
            names=["hash", "part", "class", "other"],
        )

    def small(starts, lengths, classes):
        for length in range(2, LEAF + 1):
            rows = starts[lengths == length][:, None] + np.arange(length)
            i, j = np.triu_indices(length, 1)
            a, b = classes[rows[:, i].ravel()], classes[rows[:, j].ravel()]
            near = np.abs((a & SIZE_MASK) - (b & SIZE_MASK)) <= SIZE_APART
            if near.any():
                pairs = np.unique(np.stack([a[near], b[near]], axis=1), axis=0)
                yield batch(None, None, pairs[:, 0].copy(), pairs[:, 1].copy())

    def run(batches):
        last = (None, None)  # the row before
        held = (np.empty(0, np.int64), np.empty(0, np.int64))  # an unfinished small cell
        begun, pivot, going = 0, 0, 0  # of an unfinished large cell: rows that are out, smallest class, hash
        for block in batches:
            h, c = (block.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            if not len(h):
                continue
            repeat = np.concatenate([[(h[0], c[0]) == last], (h[1:] == h[:-1]) & (c[1:] == c[:-1])])
            last = (h[-1], c[-1])
            h, c = np.concatenate([held[0], h[~repeat]]), np.concatenate([held[1], c[~repeat]])
            if not len(h):
                continue
            more = begun and h[0] == going  # the large cell goes on
            starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            lengths = np.diff(np.append(starts, len(h)))
            large = lengths > LEAF
            large[0] |= bool(more)
            place = np.arange(len(h)) - np.repeat(starts, lengths)
            pivots = np.repeat(c[starts], lengths)
            if more:
                place[: lengths[0]] += begun
                pivots[: lengths[0]] = pivot
            held = (np.empty(0, np.int64), np.empty(0, np.int64)) if large[-1] else (h[starts[-1] :], c[starts[-1] :])
            begun, pivot, going = (int(place[-1]) + 1, pivots[-1], h[-1]) if large[-1] else (0, 0, 0)
            done = np.ones(len(starts), bool)
            done[-1] = False
            yield from small(starts[~large & done], lengths[~large & done], c)
            keep = np.repeat(large, lengths)
            again = keep & (place > 0) & (place % BLOCK == 0)
            if keep.any():
                yield batch(
                    np.concatenate([h[keep], h[again]]),
                    np.concatenate([place[keep], place[again]]) // BLOCK,
                    np.concatenate([c[keep], pivots[again]]),
                    None,
                )
        yield from small(np.array([0]), np.array([len(held[0])]), held[1])

    cells = postings.repartition("hash").sortWithinPartitions("hash", "class")
    return cells.mapInArrow(run, "hash bigint, part bigint, class bigint, other bigint")


def _found_again(table: DataFrame, key: str, text: str, names: Names, keys: DataFrame, made) -> DataFrame:
    """(class, made) of at least the documents with these keys; ``made`` turns a set into bytes.

    A Bloom filter holds the keys and picks the texts where they are read, so texts aren't
    shuffled. It has ``MOST_BITS`` at most; what it lets through beyond the keys is left out
    by the joins that follow. Copies in one batch of rows come once.
    """
    wanted = BITS_PER_KEY * max(1, keys.count())
    size = min(MOST_BITS, max(FEWEST_BITS, 1 << wanted.bit_length()))

    def places(key: str) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(look)), F.lit(size)) for look in range(LOOKS)]

    buckets = (
        keys.select(F.explode(F.array(*places("_key"))).alias("p"))
        .groupBy(F.bitmap_bucket_number("p").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    )
    width = 1 << 12  # bytes of a bucket; MOST_BITS / 8 bytes of all
    bits = np.zeros((size // 8 // width + 2) * width, np.uint8)
    for row in buckets.collect():
        bits[row["bucket"] * width : row["bucket"] * width + len(row["bits"])] = np.frombuffer(row["bits"], np.uint8)
    shipped = table.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        for batch in batches:
            inside = np.ones(len(batch), bool)
            for look in range(LOOKS):
                number, position = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1 + 2 * look, 2 + 2 * look))
                inside &= (shipped.value[number * width + position // 8] >> (position % 8) & 1).astype(bool)
            rows: dict[int, bytes] = {}
            for found in shingle_sets(batch.column(0).filter(pa.array(inside))):
                if len(found) and (name := class_of(found, names)) not in rows:
                    rows[name] = made(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(rows), pa.int64()), pa.array(list(rows.values()), pa.binary())], names=["class", "made"]
            )

    spots = [f(p).alias(f"{a}{i}") for i, p in enumerate(places(key)) for a, f in (("n", F.bitmap_bucket_number), ("p", F.bitmap_bit_position))]
    return table.select(text, *spots).mapInArrow(run, "class bigint, made binary")


def _cells(batches, finish) -> Iterator[pa.RecordBatch]:
    """Call ``finish`` with whole parts of cells, gathered from sorted batches."""
    rest = None
    for batch in batches:
        part = pa.Table.from_batches([batch])
        rest = part if rest is None else pa.concat_tables([rest, part])
        h, p = rest.column("hash").to_numpy(), rest.column("part").to_numpy()
        if len(h) and (h[0], p[0]) != (h[-1], p[-1]):
            cut = int(np.flatnonzero((h != h[-1]) | (p != p[-1]))[-1]) + 1
            yield from finish(rest.slice(0, cut))
            rest = rest.slice(cut)
    if rest is not None and len(rest):
        yield from finish(rest)


def _unpacked(cells: pa.Table):
    h, p, c, n = (cells.column(k).to_numpy() for k in ("hash", "part", "class", "size"))
    counts = _rows_of(cells.column("counts").to_pylist())
    starts = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (p[1:] != p[:-1])]))
    return c, n, counts, starts, np.diff(np.append(starts, len(h)))


def _pair_batch(left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
    pairs = np.unique(np.stack([np.minimum(left, right), np.maximum(left, right)], axis=1), axis=0)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], names=["a", "b"]
    )


def _most_central(sizes: np.ndarray, counts: np.ndarray) -> int:
    """The point whose bound allows a link with most of some others: of near copies, their original."""
    others = np.linspace(0, len(sizes) - 1, min(len(sizes), CENTRAL)).astype(int)
    near = np.zeros(len(sizes))
    for other in others:
        shared = np.minimum(counts, counts[other]).sum(axis=1, dtype=np.int64)
        near += shared / (sizes + sizes[other])
    return int(near.argmax())


def _bounded(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """The pairs (a, b) that the bound on their points allows."""

    def run(batches):
        for batch in batches:
            sizes = [batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 4)]
            counts = [_rows_of(batch.column(i).to_pylist()) for i in (3, 5)]
            yield batch.select([0, 1]).filter(pa.array(_may_link(sizes[0], counts[0], sizes[1], counts[1]), pa.bool_()))

    of_a = points.select(F.col("class").alias("a"), F.col("size").alias("n_a"), F.col("counts").alias("c_a"))
    of_b = points.select(F.col("class").alias("b"), F.col("size").alias("n_b"), F.col("counts").alias("c_b"))
    both = pairs.join(of_b, "b").join(of_a, "a").select("a", "b", "n_a", "c_a", "n_b", "c_b")
    return both.mapInArrow(run, "a bigint, b bigint")


def _pivot_pairs(cells: DataFrame) -> DataFrame:
    """Pairs of a large cell's points with a pivot, where the bound allows them.

    A part of a very large cell has two pivots: its own, and the cell's, which joins the parts.
    """

    def finish(part):
        c, n, counts, starts, lengths = _unpacked(part)
        for start, length in zip(starts, lengths, strict=True):
            y = np.arange(start, start + length)
            middle = start + _most_central(n[y], counts[y])
            for x in {middle, start} if length > BLOCK // 2 else {middle}:
                ok = _may_link(n[x], counts[x][None], n[y], counts[y]) & (y != x)
                yield _pair_batch(np.full(ok.sum(), c[x]), c[y[ok]])

    return cells.mapInArrow(lambda batches: _cells(batches, finish), "a bigint, b bigint")


def _had_before(told_a: np.ndarray, told_b: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Whether two points tell of a common cell before the given one, row by row."""
    found = np.zeros(len(cells), bool)
    for at in range(0, len(cells), PIECE_PAIRS):
        rows = slice(at, at + PIECE_PAIRS)
        a, b, cell = told_a[rows], told_b[rows], cells[rows, None, None]
        found[rows] = ((a[:, :, None] == b[:, None, :]) & (a[:, :, None] < cell)).any(axis=(1, 2))
    return found


def _tree_pairs(cells: DataFrame) -> DataFrame:
    """Pairs of different components, from a tree over each pair of a large cell's blocks.

    ``part`` numbers the pair of blocks; pairs inside a block belong to its pair with itself.
    Near copies lie in many cells together, and a pair is left to the first one they both
    tell of. What they don't tell only makes a pair come again.
    """

    def finish(part):
        c, n, counts, starts, lengths = _unpacked(part)
        h, component, block, pair = (part.column(k).to_numpy() for k in ("hash", "component", "block", "part"))
        told = np.full((len(c), TOLD), np.iinfo(np.int64).max)
        for row, known in enumerate(part.column("told").to_pylist()):
            told[row, : len(known)] = known
        for start, length in zip(starts, lengths, strict=True):
            inside = slice(start, start + length)
            across = pair[start] // BLOCKS != pair[start] % BLOCKS
            for a, b in CountTree(n[inside], counts[inside], component[inside]).pairs():
                a, b = a + start, b + start
                ok = (block[a] != block[b]) | (not across)
                a, b = a[ok], b[ok]
                new = ~_had_before(told[a], told[b], h[a])
                yield _pair_batch(c[a[new]], c[b[new]])

    return cells.mapInArrow(lambda batches: _cells(batches, finish), "a bigint, b bigint")


def _large_cells(cells: DataFrame, joined: DataFrame) -> DataFrame:
    """(hash, part, class, block, component, told): large cells of several components, dealt as pairs of blocks.

    ``told`` lists the first ``TOLD`` of these cells that the class is in.
    """
    blocks = cells.groupBy("hash").agg((F.max("part") + 1).alias("blocks"))
    members = cells.join(blocks, "hash").groupBy("hash", "class")
    members = members.agg(F.min("part").alias("block"), F.first("blocks").alias("blocks"))
    members = members.join(joined.withColumnRenamed("node", "class"), "class", "left")
    members = members.withColumn("component", F.coalesce("component", "class"))
    several = members.groupBy("hash").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    members = members.join(several.where("low < high").select("hash"), "hash", "left_semi")
    first = F.slice(F.array_sort(F.collect_set("hash")), 1, TOLD)
    members = members.join(members.groupBy("class").agg(first.alias("told")), "class")
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
    pair = F.least("block", "other") * BLOCKS + F.greatest("block", "other")
    return members.withColumn("other", other).select("hash", pair.alias("part"), "class", "block", "component", "told")


def _passing(
    pairs: DataFrame, table: DataFrame, key: str, text: str, names: Names, classes: DataFrame, made, passes
) -> DataFrame:
    """The pairs that pass a test of what is made of their two sets."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    keys = checkpointed(needed.join(classes.select("class", "key"), "class").select(F.col("key").alias("_key")))
    found = checkpointed(_found_again(table, key, text, names, keys, made))

    def run(batches):
        for batch in batches:
            both = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            yield batch.select([0, 1]).filter(pa.array([passes(a, b) for a, b in both], pa.bool_()))

    of_b = found.select(F.col("class").alias("b"), F.col("made").alias("of_b"))
    of_a = found.select(F.col("class").alias("a"), F.col("made").alias("of_a"))
    sides = pairs.join(of_b, "b").join(of_a, "a").select("a", "b", "of_a", "of_b")
    # Rows that repeat a key are found more than once.
    return checkpointed(sides.mapInArrow(run, "a bigint, b bigint").distinct())


def _verified(pairs: DataFrame, *place) -> DataFrame:
    """The pairs that link: the bound is first repeated on fine vectors, then sets are compared."""
    pairs = _passing(checkpointed(pairs.distinct()), *place, fine_counts, fine_may_link)
    return _passing(pairs, *place, lambda hashes: hashes.tobytes(), linked)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable from each node of edges (a, b).

    Large stars and small stars in turn, until the edges stay the same; they are kept
    in the shared folder between rounds.
    """
    edges = checkpointed(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    )
    mark = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = checkpointed(small.union(low.select("u", "m")).where("u <> v").distinct())
        found = edges.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if tuple(found) == mark:
            break
        mark = tuple(found)
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )


def near_duplicates(
    table: DataFrame, key: str = "doc_id", text: str = "text", name_bits: int = NAME_BITS
) -> DataFrame:
    """(key, n_shingles, component_id): each document's set size and the smallest key it reaches."""
    # All steps that read texts are checkpointed, so none runs after this.
    with in_small_batches(table.sparkSession):
        return _near_duplicates(table, key, text, name_bits)


def _near_duplicates(table: DataFrame, key: str, text: str, name_bits: int) -> DataFrame:
    profiles = checkpointed(_profiles(table, key, text, name_bits))
    rows = profiles.where("hash IS NULL").select("key", "class", "check", "size", "counts")
    renamed = _renamed(rows)
    names = (name_bits, renamed)
    if renamed:
        numbers = [(*name, number) for name, number in renamed.items()]
        numbers = table.sparkSession.createDataFrame(numbers, "class bigint, check bigint, number bigint")
        rows = rows.join(numbers, ["class", "check"], "left")
        rows = rows.withColumn("class", F.coalesce("number", "class")).drop("number")
    rows = rows.drop("check")
    classes = (
        rows.where("size > 0")
        .groupBy("class")
        .agg(F.min("key").alias("key"), F.first("size").alias("size"), F.first("counts").alias("counts"))
    )
    common = (
        profiles.where("hash IS NOT NULL")
        .groupBy("hash")
        .agg(F.sum("sightings").alias("times"))
        .where(F.col("times") >= FREQUENT)
        .orderBy(F.desc("times"), "hash")
        .limit(MOST_FREQUENT)
    )
    frequent = np.sort(np.array([r[0] for r in common.select("hash").collect()], np.int64).view(np.uint64))
    frequent = table.sparkSession.sparkContext.broadcast(frequent)

    shared = checkpointed(_shared(_postings(table, text, frequent, names)))
    pairs = shared.where("hash IS NULL").select(F.col("class").alias("a"), F.col("other").alias("b")).distinct()
    cells = shared.where("hash IS NOT NULL").drop("other")
    points = classes.select("class", "size", "counts")

    def dealt(table_: DataFrame) -> DataFrame:
        return table_.join(points, "class").repartition("hash", "part").sortWithinPartitions("hash", "part", "class")

    place = (table, key, text, names, classes)
    first = _verified(_bounded(pairs, points).union(_pivot_pairs(dealt(cells))), *place)
    joined = checkpointed(components(first))
    second = _verified(_tree_pairs(dealt(_large_cells(cells, joined))), *place)
    linked = components(first.union(second)).withColumnRenamed("node", "class")
    named = (
        classes.select("class", F.col("key").alias("least"))
        .join(linked, "class", "left")
        .withColumn("component", F.coalesce("component", "class"))
    )
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(ids, "component").select("class", "component_id")
    return (
        rows.drop("counts")
        .join(named, "class", "left")
        .select(
            F.col("key").alias(key),
            F.col("size").alias("n_shingles"),
            F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("key")).alias("component_id"),
        )
    )


def one_of_each(table: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows, with all their columns, of one document per component: that of the smallest key.

    Rows with a NULL key stay, as no component is named by one. Rows that repeat a key
    and its text are one document.
    """
    own, mark = free_names(table.columns, "_own", "_mark")
    found = near_duplicates(table, key, text)
    chosen = found.where(F.col(key) == F.col("component_id")).select(F.col(key).alias(own)).distinct()
    named = table.join(chosen, F.col(key) == F.col(own), "left_semi").withColumn(mark, F.xxhash64(text))
    named = named.dropDuplicates([key, mark]).drop(mark)
    return named.unionByName(table.where(F.col(key).isNull()))
