"""Exact top-k by inner product, with a pivot table.

Every vector's distances to a fixed number of pivots are computed once.  For a query q and a
candidate x, max over pivots of |d(q,p) - d(x,p)| bounds their distance from below, so
(|q|^2 + |x|^2 - bound^2) / 2 bounds the inner product from above.  Candidates are evaluated in the
order of that bound until it falls below the k-th best score: what is left cannot enter the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIVOTS = 32
#: Rows from which pivots are chosen (those of smallest hash), and rows and queries that meet in one task.
PIVOT_SAMPLE = 2_048
BLOCK_ROWS, BLOCK_QUERIES = 32_768, 2_048
#: Candidates evaluated between two looks at the bound.
STEP = 256


def quantised(embedding: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of every component as long; null for vectors that are null or hold null or non-finite components."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.when(finite, F.transform(embedding, lambda x: F.floor(x.cast("double") * scale)))


def choose_pivots(vectors: np.ndarray, most: int = PIVOTS) -> np.ndarray:
    """Farthest-first traversal: each pivot is far from those before it."""
    if len(vectors) == 0:
        return vectors
    picked, far = [0], ((vectors - vectors[0]) ** 2).sum(1)
    while len(picked) < min(most, len(vectors)) and far.max() > 0:
        picked.append(int(far.argmax()))
        far = np.minimum(far, ((vectors - vectors[picked[-1]]) ** 2).sum(1))
    return vectors[picked]


def search_block(ids, rows, row_table, query_ids, queries, query_table, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per query its best ``k`` of ``rows`` (fewer, if there are fewer): ids and scores, best first."""
    norms = (rows.astype(float) ** 2).sum(1)
    for q_id, q, q_dist in zip(query_ids, queries, query_table, strict=True):
        own = (q.astype(float) ** 2).sum()
        low = np.zeros(len(rows))
        for p in range(row_table.shape[1]):
            np.maximum(low, np.abs(row_table[:, p] - q_dist[p]), out=low)
        # The slack covers rounding in distances and norms, which are doubles.
        bound = (norms + own - low**2) / 2 + 1 + 1e-9 * (norms + own)
        bound[ids == q_id] = -np.inf
        order = np.argsort(-bound, kind="stable")
        order = order[: len(order) - int((bound == -np.inf).sum())]
        best_ids, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for at in range(0, len(order), STEP):
            if len(best) >= k and bound[order[at]] < best[k - 1]:
                break
            part = order[at : at + STEP]
            all_ids, scores = np.concatenate([best_ids, ids[part]]), np.concatenate([best, rows[part] @ q])
            top = np.lexsort((all_ids, -scores))[:k]
            best_ids, best = all_ids[top], scores[top]
        yield q_id, best_ids, best


def _matrix(column: pa.ChunkedArray, dtype, n: int) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, dtype).reshape(n, -1) if n else np.zeros((0, 0), dtype)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, vector: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row that ``is_query``, the best ``k`` other rows.

    Ties go to the smaller id.  Vectors that are null or hold null or non-finite components, and rows
    without id, take no part; only vectors of equal length are compared; repeated rows count once;
    rows with the query's id are its own.  Squared norms must stay below 2**62 (components are exact
    64-bit integers).  Query and row blocks meet in a grid of tasks: every task holds at most about
    ``BLOCK_ROWS`` rows and ``BLOCK_QUERIES`` queries, whatever the table's size.
    """
    base = vectors.select("vec_id", quantised(F.col(vector)).alias("v"), is_query.alias("asks"))
    base = base.where(F.col("v").isNotNull() & F.col("vec_id").isNotNull()).dropDuplicates(["vec_id", "v"])
    base = base.withColumn("dim", F.size("v"))
    counts = base.agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).first()
    across, down = -(-counts["n"] // BLOCK_ROWS) or 1, -(-counts["q"] // BLOCK_QUERIES) or 1
    ranked = base.withColumn("h", F.xxhash64("vec_id"))
    sample = ranked.orderBy("h", "vec_id").limit(PIVOT_SAMPLE).select("v").toArrow()["v"].to_pylist()
    pivots = {d: choose_pivots(np.array([v for v in sample if len(v) == d], float)) for d in {len(v) for v in sample}}

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed, distances = [], []
            for v in batch.column("v").to_pylist():
                x = np.array(v, np.int64)
                p = pivots.get(len(v), np.zeros((0, len(v))))
                packed.append(x.tobytes())
                distances.append(np.sqrt(((p - x) ** 2).sum(1)).tobytes())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("dim", "vec_id", "asks")), pa.array(packed, pa.binary()), pa.array(distances, pa.binary())],
                ["dim", "vec_id", "asks", "v", "d"],
            )

    packed = base.select("dim", "vec_id", F.coalesce("asks", F.lit(False)).alias("asks"), "v").mapInArrow(
        table, "dim int, vec_id long, asks boolean, v binary, d binary"
    )
    spread = F.xxhash64("vec_id", F.lit(7))
    rows = packed.withColumn("a", F.pmod(spread, F.lit(across)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    asks = packed.where("asks").withColumn("b", F.pmod(spread, F.lit(down)).cast("int"))
    asks = asks.withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        n, m = left.num_rows, right.num_rows
        out = {"query_id": [], "vec_id": [], "score": []}
        if n and m:
            args = (_matrix(left["v"], np.int64, n), _matrix(left["d"], float, n), right["vec_id"].to_numpy())
            for q, ids, scores in search_block(left["vec_id"].to_numpy(), *args, _matrix(right["v"], np.int64, m), _matrix(right["d"], float, m), k):
                out["query_id"] += [q] * len(ids)
                out["vec_id"] += ids.tolist()
                out["score"] += scores.tolist()
        return pa.table({c: pa.array(x, pa.int64()) for c, x in out.items()})

    keys = ("dim", "a", "b")
    near = rows.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score long")
    # At most k rows for each query and block of rows meet here.
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
