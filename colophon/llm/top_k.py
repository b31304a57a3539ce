"""Exact top-k search: tiled matrix products of queries and shards.

Components become integers floor(256 * x), so products are exact. Queries and candidates are dealt into a
grid of cells by hash, every cell multiplies its queries with its candidates tile by tile, keeps the best
k of each tile by partial selection, and the lists of a query are merged as a tree, MERGE lists at a time.
A cell holds about ROWS_A_TASK candidates and QUERIES_A_TASK queries at most, fewer where vectors are long: VALUES_A_TASK
components of either, whatever the table's size.

Ties go to the smaller vec_id. The order (score, -vec_id) is total, so results don't depend on tiling.

Defined results: vectors that are null, or hold null or non-finite components, take no part; nor do rows
without a vec_id. A query is never its own candidate: rows of its own vec_id are left out, and equal vectors
of other ids are candidates as any. Rows with one vec_id are all queries and candidates, equal ones too; the k best of
all their pairs are the vec_id's list. Vectors of another length than the query's are not comparable and are left out. A query without
candidates has no rows; a score that doesn't fit in a long is an error; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colophon.llm.common import written

SCALE, TILE, QUERIES_A_TASK, ROWS_A_TASK, MERGE = 256, 4096, 2048, 16384, 16
VALUES_A_TASK = 4 << 20


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array of long) and a row number, of usable rows."""
    wide = F.transform("embedding", lambda x: x.cast("double"))
    sound = ~F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(F.coalesce(sound, F.lit(False)))
    v = F.transform(wide, lambda x: F.floor(x * SCALE).cast("long")).alias("v")
    return usable.select(F.col("vec_id").cast("long"), v, F.monotonically_increasing_id().alias("row_id"))


def best_of_tile(scores: np.ndarray, k: int) -> np.ndarray:
    """Column numbers of the k best of each row, ties to the smaller column, best first."""
    n = scores.shape[1]
    k = min(k, n)
    top = int(np.abs(scores).max(initial=0))
    if top < 2**62 // max(n, 1):  # score and column in one number: partial selection is exact on ties
        keys = scores * n + np.arange(n - 1, -1, -1)
        part = np.argpartition(keys, n - k, axis=1)[:, n - k :] if k < n else np.broadcast_to(np.arange(n), scores.shape)
        order = np.argsort(-np.take_along_axis(keys, part, 1), axis=1, kind="stable")
        return np.take_along_axis(part, order, 1)
    return np.argsort(-scores, axis=1, kind="stable")[:, :k]


def products(queries: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """Exact integer products; by floating point where no sum can leave 2**53."""
    dim = max(1, queries.shape[1])
    most = int(np.abs(queries).max(initial=0)) * int(np.abs(shard).max(initial=0)) * dim
    if most < 2**53:
        return (queries.astype(np.float64) @ shard.astype(np.float64).T).astype(np.int64)
    if most < 2**63:
        return queries @ shard.T
    exact = queries.astype(object) @ shard.astype(object).T
    if any(abs(int(x)) >= 2**63 for x in exact.flat):
        raise OverflowError("an inner product does not fit in a long")
    return exact.astype(np.int64)


def _cell(left: pa.Table, right: pa.Table, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query ids, candidate ids, scores) of the best k of every tile."""

    def matrices(t: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        ids, v = t.column(0).to_numpy(), t.column(1).combine_chunks()
        dims = np.diff(v.offsets.to_numpy())
        flat, starts = v.values.to_numpy(zero_copy_only=False), v.offsets.to_numpy()[:-1]
        out = {}
        for d in np.unique(dims):
            at = np.flatnonzero(dims == d)
            at = at[np.argsort(ids[at], kind="stable")]
            out[int(d)] = (ids[at], flat[starts[at, None] + np.arange(d)])
        return out

    shards = matrices(right)
    for d, (qids, q) in matrices(left).items():
        if d not in shards:
            continue
        cids, c = shards[d]
        for i in range(0, len(cids), TILE):
            ids = cids[i : i + TILE]
            for j in range(0, len(qids), 512):
                scores = products(q[j : j + 512], c[i : i + TILE])
                own = qids[j : j + 512, None] == ids
                keep = min(k + int(own.sum(1).max(initial=0)), len(ids))  # rows of the query's own vec_id may be among them
                pick = best_of_tile(scores, keep)
                good = ~np.take_along_axis(own, pick, 1)
                good &= np.cumsum(good, 1) <= k
                row, col = np.nonzero(good)
                yield qids[j : j + 512][row], ids[pick[row, col]], scores[row, pick[row, col]]


def _cells(rows: DataFrame, most: int) -> int:
    """Into how many parts the rows are dealt: so that one has `most` rows and VALUES_A_TASK components at most, about."""
    n, values = rows.agg(F.count("*"), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
    return max(1, -(-n // most), -(-values // VALUES_A_TASK))


def top_k(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id and score: the k best candidates of each vector whose vec_id `every` divides."""
    whole = written(integer_vectors(vectors), "search-vectors")
    asked = whole.filter(F.col("vec_id") % every == 0)
    down, across = _cells(asked, QUERIES_A_TASK), _cells(whole, ROWS_A_TASK)
    spread = lambda salt, n: F.pmod(F.xxhash64("row_id", F.lit(salt)), n).cast("int")
    left = asked.withColumns({"qc": spread(1, down), "sc": F.explode(F.sequence(F.lit(0), F.lit(across - 1)))})
    right = whole.withColumns({"sc": spread(2, across), "qc": F.explode(F.sequence(F.lit(0), F.lit(down - 1)))}).toDF("c_id", "c_v", "c_row", "c_sc", "c_qc")

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        found = list(_cell(a, b, k)) if a.num_rows and b.num_rows else []
        parts = [np.concatenate([f[i] for f in found]) if found else np.array([], np.int64) for i in range(3)]
        number = a.column("sc")[0].as_py() if a.num_rows else 0
        return pa.table({"query_id": pa.array(parts[0], pa.int64()), "vec_id": pa.array(parts[1], pa.int64()), "score": pa.array(parts[2], pa.int64()), "part": pa.array(np.full(len(parts[0]), number, np.int64))})

    lists = left.groupBy("qc", "sc").cogroup(right.groupBy("c_qc", "c_sc")).applyInArrow(cell, "query_id long, vec_id long, score long, part long")
    best = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id"))
    while across > MERGE:
        lists = lists.withColumn("part", F.floor(F.col("part") / MERGE)).withColumn("rank", best("query_id", "part")).filter(F.col("rank") <= k).drop("rank")
        across = -(-across // MERGE)
    return lists.withColumn("rank", best("query_id").cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
"""
