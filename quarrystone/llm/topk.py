"""Exact top-k by integer inner product, with block-at-a-time pruning.

A component is a term, its value the term's impact. Vectors of a shard are ordered so that similar
ones stand together and cut into range blocks, each with a forward index (its vectors as one
matrix) and every term's largest and smallest value. For a query, the sum over terms of the larger of
the two products bounds all scores of a block. Blocks are scored in the order of their bounds until a
bound falls below the k-th score. Queries meet candidates as groups of bounded size: a task holds one
group of queries and one shard.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

K = 20
SCALE = 64
BLOCK = 128
SHARD = 32_768
QUERIES = 512
_LONG = 2**63 - 1


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(row, vec_id, v): floor(scale * x) of each component as long, without rows that take no part; row numbers every row."""
    v = F.col("v").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine)
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.transform(v, lambda x: F.floor(x * scale)).alias("v"))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    lists = column.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy()
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _width(*columns: pa.ChunkedArray) -> int:
    return max((int(np.diff(c.combine_chunks().offsets.to_numpy()).max(initial=0)) for c in columns), default=0)


def _locality(m: np.ndarray) -> np.ndarray:
    """An order in which neighbours agree in the signs of seeded projections, the first ones above all."""
    planes = np.random.default_rng(17).standard_normal((m.shape[1], 16))
    signs = (m.astype(np.float64) @ planes > 0).astype(np.int64)
    return np.argsort(signs @ (1 << np.arange(15, -1, -1)), kind="stable")


def search_shard(q_own: np.ndarray, q: np.ndarray, own: np.ndarray, ids: np.ndarray, m: np.ndarray, k: int = K, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(place in q, vec_id, score) of each query's k best in one shard, and how many blocks were scored in all.

    own: numbers of the rows; a query does not meet the row that it is itself.
    """
    order = _locality(m)
    own, ids, m = own[order], ids[order], m[order]
    largest = max(int(np.abs(m).max(initial=0)), 1) * max(int(np.abs(q).max(initial=0)), 1) * max(m.shape[1], 1)
    kind = np.float64 if largest < 1 << 52 else object  # exact either way
    m, q = m.astype(kind), q.astype(kind)
    starts = np.arange(0, len(ids), block)
    top, low = np.maximum.reduceat(m, starts, axis=0), np.minimum.reduceat(m, starts, axis=0)
    bounds = np.maximum(q, 0) @ top.T + np.minimum(q, 0) @ low.T
    out, scored = [], 0
    for i in range(len(q)):
        ranked = np.argsort(-bounds[i], kind="stable")
        mine = bounds[i][ranked]
        best, best_ids, at, step, kth = np.empty(0, kind), np.empty(0, np.int64), 0, 1, None
        while at < len(ranked) and (kth is None or mine[at] >= kth):
            chosen = ranked[at : at + step]
            if kth is not None:
                chosen = chosen[mine[at : at + step] >= kth]
            rows = np.concatenate([np.arange(starts[b], min(starts[b] + block, len(ids))) for b in chosen])
            rows = rows[own[rows] != q_own[i]]
            best, best_ids = np.concatenate([best, m[rows] @ q[i]]), np.concatenate([best_ids, ids[rows]])
            if len(best) > k:
                keep = np.lexsort((best_ids, -best))[:k]
                best, best_ids = best[keep], best_ids[keep]
            if len(best) >= k:
                kth = best.min()
            scored, at, step = scored + len(chosen), at + step, step * 2
        out.append((np.full(len(best), i), best_ids, np.array([max(-_LONG - 1, min(_LONG, int(s))) for s in best], np.int64)))
    rows, found, scores = (np.concatenate(x) if out else np.empty(0, np.int64) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3
    return rows, found, scores, scored


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K, shard: int = SHARD, group: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries the k best candidates but itself.

    Both are rows (row, vec_id, v) of one table of quantised(), written once, so that a row keeps its number. Repeated rows
    are candidates each, and queries each. Ties go to the smaller id. Of vectors of unequal length the shorter one has
    zeros at the end; scores beyond 64 bits become the nearest long. Without other candidates a query has no
    row; without queries, or on an empty table, there are none.
    """
    queries, candidates = written(queries, "queries"), written(candidates, "candidates")
    n_q, n_c = queries.count(), candidates.count()
    groups, shards = max(1, -(-n_q // group)), max(1, -(-n_c // shard))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("g", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int")).withColumn("s", every(shards))
    right = candidates.withColumn("s", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")).withColumn("g", every(groups))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        width = _width(a["v"], b["v"])
        names, own = a["vec_id"].to_numpy(), a["row"].to_numpy()
        if not a.num_rows or not b.num_rows:
            rows, found, scores = (np.empty(0, np.int64),) * 3
        else:
            rows, found, scores, _ = search_shard(own, _matrix(a["v"], width), b["row"].to_numpy(), b["vec_id"].to_numpy(), _matrix(b["v"], width), k)
        return pa.table({"query_id": pa.array(names[rows], pa.int64()), "own": pa.array(own[rows], pa.int64()), "vec_id": pa.array(found, pa.int64()), "score": pa.array(scores, pa.int64())})

    found = left.groupBy("g", "s").cogroup(right.groupBy("g", "s")).applyInArrow(run, "query_id long, own long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("own").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, every: int = 20, k: int = K, scale: int = SCALE) -> DataFrame:
    """Rows whose id is divisible by `every` as queries against all rows but the query's own.

    Repeated rows count each. Rows with a null id or vector, or a vector with a null or non-finite component, take no part.
    """
    rows = written(quantised(vectors, scale=scale), "quantised")
    return top_k(rows.where(F.col("vec_id") % every == 0), rows, k)
