"""Exact top-k inner products by Fagin's threshold algorithm.

Vectors are rounded down to integers (``floor(scale * x)``), so scores are exact.  Candidates
are dealt over blocks by a hash of their id and queries likewise; a task gets one block of each.
It sorts the candidates of its block along every dimension once.  For a query it walks the
lists of all dimensions with a nonzero weight from the favourable end, scores what it meets for the
first time, and stops when the sum of the lists' current values, weighted, is below the kth
best score: no unseen vector can beat that.  (It goes on while they are equal, for ties.)
The blocks' k best meet in a last selection for each query.

Vectors that are null or hold null or non-finite components take no part, nor do vectors whose
length differs from the most common one.  Fewer than k candidates: all are returned.  A row
isn't its own candidate; rows that repeat an id are left out of that id's candidates.  Empty
tables give empty results.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import spill

BLOCK = 8192
QUERY_BLOCK = 1024
SCALE = 256
#: How far to walk before the bound is looked at first; then four times as far, and so on.
FIRST_DEPTH = 32


def threshold_top_k(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Rows (query index, id, score) of each query's k best; and how many vectors were scored."""
    n, dims = vectors.shape
    order = np.argsort(vectors, axis=0, kind="stable")  # rising
    values = np.take_along_axis(vectors, order, axis=0)
    order, values = np.ascontiguousarray(order.T), np.ascontiguousarray(values.T)
    exact = vectors.astype(np.float64) if max(1, np.abs(vectors).max(initial=0)) * max(1, np.abs(queries).max(initial=0)) * max(1, dims) < 2**53 else vectors
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    scored = 0
    for q in range(len(queries)):
        weight = queries[q].astype(exact.dtype)
        up, down = np.flatnonzero(weight > 0), np.flatnonzero(weight < 0)
        seen = ids == query_ids[q]
        best_score, best_id = np.empty(0, exact.dtype), np.empty(0, np.int64)
        depth, step = 0, FIRST_DEPTH
        while depth < n:
            end = min(n, depth + step)
            if len(up) + len(down):
                met = np.concatenate([order[up, n - end : n - depth].ravel(), order[down, depth:end].ravel()])
                fresh = np.zeros(n, bool)
                fresh[met] = True
                fresh &= ~seen
            else:
                fresh, end = ~seen, n
            seen |= fresh
            rows = np.flatnonzero(fresh)
            scored += len(rows)
            score = exact[rows] @ weight
            if len(score) > k:  # only what reaches the kth best can stay
                least = np.partition(score, len(score) - k)[len(score) - k]
                good = score >= (max(least, best_score[-1]) if len(best_score) == k else least)
                rows, score = rows[good], score[good]
            best_score, best_id = np.append(best_score, score), np.append(best_id, ids[rows])
            top = np.lexsort((best_id, -best_score))[:k]
            best_score, best_id = best_score[top], best_id[top]
            if len(top) == k and end < n:
                bound = values[up, n - end] @ weight[up] + values[down, end - 1] @ weight[down]
                if bound < best_score[-1]:
                    break
            depth, step = end, step * 4
        out.append((np.full(len(best_id), q), best_id, best_score.astype(np.int64)))
    parts = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 3
    return (*parts, scored)


def _integers(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def _matrix(table: pa.Table, dims: int) -> np.ndarray:
    column = table.column("v").combine_chunks()
    flat = column.flatten() if isinstance(column, pa.ListArray) else pa.concat_arrays([c.flatten() for c in column.chunks])
    return flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def top_k(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score for the rows where ``queries`` holds, against all rows."""
    fit = vectors.where(F.col(vector_col).isNotNull() & ~F.exists(vector_col, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))))
    data = spill(fit.select(F.col(id_col).cast("long").alias("vec_id"), _integers(F.col(vector_col), scale).alias("v"), queries.alias("asks")).where("vec_id is not null"), "vectors")
    sizes = data.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("q")).orderBy(F.desc("n"), F.desc("d")).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if sizes is None or sizes["d"] <= 0:
        return data.sparkSession.createDataFrame([], schema)
    dims, blocks, query_blocks = sizes["d"], -(-sizes["n"] // block), max(1, -(-sizes["q"] // query_block))
    data = data.where(F.size("v") == dims)

    def dealt(rows: DataFrame, own: int, other: int, own_name: str, other_name: str) -> DataFrame:
        at = F.pmod(F.xxhash64("vec_id", F.lit(own_name)), F.lit(own)).alias(own_name)
        return rows.select("vec_id", "v", at, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(other - 1).cast("long"))).alias(other_name))

    candidates = dealt(data.drop("asks"), blocks, query_blocks, "c_block", "q_block")
    asked = dealt(data.where("asks").drop("asks"), query_blocks, blocks, "q_block", "c_block")

    def search(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            q = i = s = np.empty(0, np.int64)
            query_ids = np.empty(0, np.int64)
        else:
            query_ids = right.column("vec_id").to_numpy()
            q, i, s, _ = threshold_top_k(left.column("vec_id").to_numpy(), _matrix(left, dims), query_ids, _matrix(right, dims), k)
        return pa.table({"query_id": query_ids[q], "vec_id": i, "score": s})

    best = candidates.groupBy("c_block", "q_block").cogroup(asked.groupBy("c_block", "q_block")).applyInArrow(search, "query_id long, vec_id long, score long")
    # A rank limit, which Spark applies in every task before the shuffle too.
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
