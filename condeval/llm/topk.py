"""Exact top-k inner products by columnar branch and bound.

Candidates lie in blocks, a dimension to a row (the vertical layout). A query takes a
block's dimensions a few at a time, adding to every candidate's partial sum. What the
dimensions left can still add is at most the product of the two remaining norms, so a
candidate whose partial sum plus that cannot reach the k-th best sure value is dropped,
and the columns of the survivors are compacted before the next step.

Queries and candidates are dealt into blocks of bounded size, and every pair of a query
block and a candidate block is one task's work, whatever the number of either. Blocks
are picked by hash of the id. Of each pair only k rows a query leave.

Components are floor(64 * x); scores are 64-bit integers. Sums are made in float64 where
all of a block's are below 2**53, which is exact, and in int64 otherwise. A score beyond 2**63
wraps, as 64-bit integers do, and a component beyond it is held at the limit: vectors are
meant to have components of moderate size (below 10**6 in 64 dimensions).

Defined cases: vectors that are NULL, hold NULL or hold a component that isn't finite
take no part; an empty vector scores 0 with all, a shorter one counts as filled up with
zeros; rows that repeat an id count once, by their smallest vector, or, with ``every_row``,
each for itself, as candidate of all rows but itself and as query; NULL ids take no part;
ties go to the smaller id; fewer than k candidates are all returned; an empty table gives
an empty table; other columns are neither read nor returned.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE = 64
EVERY = 20
# Rows of a candidate block and of a query block, and dimensions added per step.
CANDIDATES, QUERIES, STEP = 8192, 2048, 16


def whole_vectors(
    table: DataFrame, key: str = "vec_id", vector: str = "embedding", every_row: bool = False
) -> DataFrame:
    """(id, v, n): floor(64 * x) of each component as long, one row an id or, with
    ``every_row``, one for each of its vectors, and how many rows have it."""
    x = F.col(vector).cast("array<double>")
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = table.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & ~F.coalesce(odd, F.lit(True)))
    rows = rows.select(F.col(key).cast("bigint").alias("id"), F.transform(x, lambda c: F.floor(c * SCALE)).alias("v"))
    if every_row:
        return rows.groupBy("id", "v").agg(F.count("*").alias("n"))
    return rows.groupBy("id").agg(F.min("v").alias("v"), F.lit(1).cast("bigint").alias("n"))


def _matrix(lists: list[list[int]], width: int) -> np.ndarray:
    out = np.zeros((len(lists), width), np.int64)
    for row, values in enumerate(lists):
        out[row, : len(values)] = values
    return out


def best_of_block(queries, query_ids, columns, ids, k: int):
    """For each query, positions and scores of its k best among a block's columns.

    ``columns`` is (dimensions, candidates), sorted by id, so ties keep the smaller. One
    candidate with the query's id and vector is the query itself and left out.
    """
    width, count = columns.shape
    largest = max(int(np.abs(columns).max(initial=0)), int(np.abs(queries).max(initial=0)))
    exact = largest < 1 << 26 and width * largest * largest < 1 << 53
    kind = np.float64 if exact else np.int64
    columns, queries = columns.astype(kind), queries.astype(kind)
    starts = list(range(0, width, STEP))
    # Norms of what is left from each step on, rounded up a little.
    left = np.zeros((len(starts) + 1, count))
    left_q = np.zeros((len(starts) + 1, len(queries)))
    for at in range(len(starts) - 1, -1, -1):
        cut = slice(starts[at], starts[at] + STEP)
        left[at] = left[at + 1] + (columns[cut].astype(np.float64) ** 2).sum(axis=0)
        left_q[at] = left_q[at + 1] + (queries[:, cut].astype(np.float64) ** 2).sum(axis=1)
    left, left_q = np.sqrt(left) * (1 + 1e-9), np.sqrt(left_q) * (1 + 1e-9)
    for row, (query, own) in enumerate(zip(queries, query_ids, strict=True)):
        first, end = np.searchsorted(ids, own), np.searchsorted(ids, own, "right")
        itself = first + np.flatnonzero((columns[:, first:end] == query[:, None]).all(axis=0))[:1]
        alive = np.delete(np.arange(count), itself)
        partial = np.zeros(len(alive), kind)
        block = columns if len(alive) == count else None
        for at, start in enumerate(starts):
            cut = slice(start, start + STEP)
            part = block[cut] if block is not None else columns[cut, alive]
            partial = partial + query[cut] @ part
            if not exact or len(alive) <= k or at == len(starts) - 1:
                continue
            slack = left_q[at + 1, row] * left[at + 1, alive]
            sure = np.partition(partial - slack, len(alive) - k)[len(alive) - k]
            good = partial + slack >= sure
            if not good.all():
                alive, partial, block = alive[good], partial[good], None
        if len(alive) > k:
            least = np.partition(partial, len(alive) - k)[len(alive) - k]
            good = partial >= least
            alive, partial = alive[good], partial[good]
            order = np.argsort(-partial, kind="stable")[:k]
            alive, partial = alive[order], partial[order]
        yield own, alive, partial.astype(np.int64)


def top_k(
    table: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding", is_query: Column | None = None,
    every_row: bool = False,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of each query against every other row."""
    vectors = whole_vectors(table, key, vector, every_row)
    counted = table.agg(F.count("*"), F.max(F.size(vector))).first()
    rows, width = counted[0], max(1, counted[1] or 0)
    if is_query is None:
        is_query = F.col("id") % EVERY == 0
    blocks = max(1, ceil(rows / CANDIDATES))
    query_blocks = max(1, ceil(rows / EVERY / QUERIES))
    candidates = vectors.withColumn("c", F.pmod(F.xxhash64("id", "v"), F.lit(blocks))).withColumn(
        "q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))
    )
    queries = (
        vectors.where(is_query)
        .withColumn("q", F.pmod(F.xxhash64("id", "v", F.lit(1)), F.lit(query_blocks)).cast("int"))
        .withColumns({"h": F.xxhash64("v"), "g": F.xxhash64(F.lit(2), "v")})
        .withColumn("c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
    )

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = left.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        # Of equal rows a query can't take more than k, besides itself.
        order = np.repeat(order, np.minimum(left.column("n").to_numpy(), k + 1)[order])
        columns = np.ascontiguousarray(_matrix(left.column("v").to_pylist(), width)[order].T)
        asked = _matrix(right.column("v").to_pylist(), width)
        own = [right.column(name).to_numpy() for name in ("id", "h", "g", "n")]
        out = [(np.empty(0, np.int64),) * 6]
        if len(ids) and len(asked):
            found = best_of_block(asked, own[0], columns, ids[order], k)
            for row, (_, alive, score) in enumerate(found):
                out.append((*(np.full(len(alive), x[row]) for x in own), ids[order][alive], score))
        return pa.table(
            {
                name: pa.array(np.concatenate([o[i] for o in out]), pa.int64())
                for i, name in enumerate(("query_id", "h", "g", "n", "vec_id", "score"))
            }
        )

    found = (
        candidates.groupBy("c", "q")
        .cogroup(queries.select("id", "v", "n", "h", "g", "c", "q").groupBy("c", "q"))
        .applyInArrow(run, "query_id bigint, h bigint, g bigint, n bigint, vec_id bigint, score bigint")
    )
    best = Window.partitionBy("query_id", "h", "g").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    # Equal query rows have equal results.
    return ranked.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n")))).select(
        "query_id", "rank", "vec_id", "score"
    )

ORACLE = """
WITH parts AS (
  SELECT vec_id, generate_subscripts(embedding, 1) AS i, CAST(floor(64 * unnest(embedding)::DOUBLE) AS BIGINT) AS x
  FROM embeddings
), scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM parts q JOIN parts c USING (i) WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id GROUP BY ALL
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id, score
FROM scores QUALIFY rank <= 20
"""
