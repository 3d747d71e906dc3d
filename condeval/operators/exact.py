"""Sums of vectors that do not depend on the order of summation.

A double is an integer of 53 bits times a power of two. It is split over limbs of 32 bits,
limb k counting units of 2**(32 k - OFFSET), and limbs are added as integers. So sums are
exact, whichever rows a task holds and in whichever order partial sums meet, and they are
rounded once, at the end. NaN and infinities are added apart, as doubles: their sums do not
depend on the order either.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS, OFFSET, LIMBS = 32, 1152, 72
MASK = (1 << BITS) - 1
# Tasks whose partial sums are merged together before the last merge.
FAN_IN = 64
# Elements that are split into limbs at a time.
ELEMENTS = 1 << 18

_PARTIAL = "positive boolean, n bigint, size int, even boolean, first int, limbs binary, counts binary, odd binary"
_NAMES = [field.split()[0] for field in _PARTIAL.split(", ")]


class ExactSums:
    """Sums of the rows of one class, element by element."""

    def __init__(self, size: int) -> None:
        self.size, self.n, self.even = size, 0, True
        self.limbs = np.zeros((LIMBS, size), np.int64)
        self.counts = np.zeros(size, np.int64)
        self.odd = np.zeros(size)

    def add(self, values: np.ndarray, present: np.ndarray) -> None:
        """Add rows of doubles; an element that is not present counts nothing."""
        self.n += len(values)
        self.counts += present.sum(axis=0)
        finite = np.isfinite(values) & present
        with np.errstate(invalid="ignore"):
            self.odd += np.where(present & ~finite, values, 0.0).sum(axis=0)
        fraction, power = np.frexp(np.where(finite, values, 0.0))
        whole = np.ldexp(fraction, 53).astype(np.int64)
        limb, shift = np.divmod(power.astype(np.int64) - 53 + OFFSET, BITS)
        low = (whole & MASK).astype(np.uint64) << shift.astype(np.uint64)
        high = (whole >> BITS) << shift
        parts = (
            (low & np.uint64(MASK)).astype(np.int64),
            (low >> np.uint64(BITS)).astype(np.int64) + (high & MASK),
            high >> BITS,
        )
        for k in np.unique(limb[whole != 0]).tolist():
            here = limb == k
            for i, part in enumerate(parts):
                self.limbs[k + i] += np.where(here, part, 0).sum(axis=0)
        self._carry()

    def merge(self, n: int, even: bool, first: int, limbs: bytes, counts: bytes, odd: bytes) -> None:
        self.n += n
        self.even &= even
        found = np.frombuffer(limbs, np.int32).reshape(-1, self.size)
        self.limbs[first : first + len(found)] += found
        self.counts += np.frombuffer(counts, np.int64)
        with np.errstate(invalid="ignore"):
            self.odd += np.frombuffer(odd, np.float64)
        self._carry()

    def _carry(self) -> None:
        """Bring each limb into [-2**31, 2**31), so that it fits 32 bits and zeros stay zeros."""
        for k in range(LIMBS - 1):
            if self.limbs[k].any():
                carry = (self.limbs[k] + (1 << BITS - 1)) >> BITS
                self.limbs[k] -= carry << BITS
                self.limbs[k + 1] += carry

    def row(self) -> tuple:
        """n, even, and the limbs in use, from the first one on."""
        used = np.flatnonzero(self.limbs.any(axis=1))
        first, end = (int(used[0]), int(used[-1]) + 1) if len(used) else (0, 0)
        limbs = self.limbs[first:end].astype(np.int32).tobytes()
        return self.n, self.even, first, limbs, self.counts.tobytes(), self.odd.tobytes()

    def sums(self) -> list[float]:
        """Each sum, rounded once; Python's division of integers is exact to the last bit."""
        unit = 1 << OFFSET
        out = []
        for place, odd in enumerate(self.odd.tolist()):
            total = sum(limb << BITS * k for k, limb in enumerate(self.limbs[:, place].tolist()) if limb)
            try:
                out.append(odd if odd != 0 else total / unit)
            except OverflowError:
                out.append(float("inf") if total > 0 else float("-inf"))
        return out


def _partial_batch(classes: dict[bool, ExactSums]) -> pa.RecordBatch:
    kinds = [pa.bool_(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    rows = [(mark, sums.n, sums.size, *sums.row()[1:]) for mark, sums in classes.items()]
    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=_NAMES)


def _sum_rows(batches) -> Iterator[pa.RecordBatch]:
    """One row a class for a whole task."""
    classes: dict[bool, ExactSums] = {}
    for batch in batches:
        marks, vectors = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
        lengths = np.diff(vectors.offsets.to_numpy())
        flat = vectors.flatten()
        values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
        present = flat.is_valid().to_numpy(zero_copy_only=False)
        starts = np.cumsum(lengths) - lengths
        for mark in (True, False):
            rows = np.flatnonzero((marks == mark) & (lengths > 0))
            if not len(rows):
                continue
            size = classes[mark].size if mark in classes else int(lengths[rows[0]])
            sums = classes.setdefault(mark, ExactSums(size))
            alike = rows[lengths[rows] == size]
            sums.even &= len(alike) == len(rows)
            for at in range(0, len(alike), max(1, ELEMENTS // size)):
                places = starts[alike[at : at + max(1, ELEMENTS // size)], None] + np.arange(size)
                sums.add(values[places], present[places])
    yield _partial_batch(classes)


def _merged(batches) -> dict[bool, ExactSums]:
    classes: dict[bool, ExactSums] = {}
    for batch in batches:
        for mark, n, size, *rest in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            sums = classes.setdefault(mark, ExactSums(size))
            if size == sums.size:
                sums.merge(n, *rest)
            else:
                sums.even = False
    return classes


def class_means(vectors: DataFrame, positive: Column, vector: str) -> DataFrame:
    """(positive, n, even, means): exact means of each class, element by element.

    Each task sends one row a class; these are merged in groups of ``FAN_IN`` tasks and
    then all together. A mean is the exact sum, rounded, divided by how many there are; it
    is NULL where there are none. ``even`` tells whether all vectors were equally long; NULL
    and empty ones are left out.
    """

    def finish(batches):
        for mark, sums in _merged(batches).items():
            means = [total / n if n else None for total, n in zip(sums.sums(), sums.counts.tolist(), strict=True)]
            columns = [pa.array([mark]), pa.array([sums.n]), pa.array([sums.even]), pa.array([means], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["positive", "n", "even", "means"])

    def merge(batches):
        yield _partial_batch(_merged(batches))

    rows = vectors.filter(F.col(vector).isNotNull()).select(
        F.coalesce(positive, F.lit(False)).alias("positive"), F.col(vector).cast("array<double>").alias("vector")
    )
    partial = rows.mapInArrow(_sum_rows, _PARTIAL)
    group = F.floor(F.spark_partition_id() / FAN_IN)
    near = partial.withColumn("_group", group).repartition("_group").drop("_group").mapInArrow(merge, _PARTIAL)
    return near.repartition("positive").mapInArrow(finish, "positive boolean, n bigint, even boolean, means array<double>")
