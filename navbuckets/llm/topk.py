"""1. Exact top-k inner products by no-random-access aggregation (NRA).

The score of a candidate is a sum over dimensions, and each dimension is a sorted list. The
candidates are dealt into blocks; a block keeps its own sorted lists, and NRA runs for a
block of queries at once: all lists are read sequentially to the same depth (descending for
positive query components, ascending for negative ones). An entry not read yet lies between
the list's frontier and its end, which gives every candidate an upper and a lower score
bound; both are matrix products over the lists with the unread entries replaced. Reading
stops for a query when the outsiders' upper bounds are below its k-th lower bound; the few
survivors' scores are then resolved exactly. Per-block winners meet in a ranked window with
map-side group limits.

A task holds one block of candidates and one of queries. Neither side is broadcast or
collected: both are dealt to (candidate block, query block) cells.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_SCHEMA = "query_row long, query_id long, vec_id long, score long"


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = len(column)
    return np.asarray(column.flatten(), dtype=np.int64).reshape(rows, -1)


def nra_topk(lists: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int,
             depths=(0.125, 0.25, 0.5)):
    """NRA over one block: ``lists`` (candidates x dimensions) against ``queries``.

    Returns (query index, candidate index, score) of each query's k best, ties to smaller
    ids. A candidate with the query's own id takes no part.
    """
    n, dims = lists.shape
    out = []
    peak = max(1, int(np.abs(lists).max(initial=0))) * max(1, int(np.abs(queries).max(initial=0))) * max(1, dims)
    kind = np.float64 if peak < 1 << 52 else np.int64  # float products of such integers are exact
    x, q = lists.astype(kind), queries.astype(kind)
    order = np.sort(x, axis=0)

    def resolve(i: int, alive: np.ndarray):
        score = (x[alive] @ q[i]).astype(np.int64)
        best = np.lexsort((ids[alive], -score))[:k]
        out.append((np.full(len(best), i), alive[best], score[best]))

    active = np.arange(len(q))
    for share in depths:
        depth = int(n * share)
        if depth < 4 * k or not len(active) or not dims:
            continue
        top, low = order[n - depth], order[depth - 1]  # the frontiers of both reading directions
        pos, neg = np.maximum(q[active], 0), np.minimum(q[active], 0)
        upper = pos @ np.maximum(x, top).T + neg @ np.minimum(x, low).T
        lower = pos @ np.where(x >= top, x, order[0]).T + neg @ np.where(x <= low, x, order[-1]).T
        own = query_ids[active][:, None] == ids[None, :]
        lower[own] = np.iinfo(np.int64).min if kind is np.int64 else -np.inf
        kth = np.partition(lower, n - k, axis=1)[:, n - k]
        inside = (upper >= kth[:, None]) & ~own
        stop = inside.sum(axis=1) <= max(8 * k, n // 8)
        for row in np.flatnonzero(stop):
            resolve(active[row], np.flatnonzero(inside[row]))
        active = active[~stop]
    if len(active):  # the lists are read to their ends: every bound is the score itself
        score = q[active] @ x.T
        for row, i in enumerate(active):
            alive = np.flatnonzero(ids != query_ids[i])
            if len(alive) > 4 * k:
                kth = np.partition(score[row][alive], len(alive) - k)[len(alive) - k]
                alive = alive[score[row][alive] >= kth]
            if len(alive):
                resolve(i, alive)
    return [np.concatenate(z) for z in zip(*out)] if out else [np.zeros(0, np.int64)] * 3


def _cell(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_row", "query_id", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64())] * 4, names=names)
        ids, qids = (np.asarray(t.column("vec_id"), dtype=np.int64) for t in (left, right))
        i, j, s = nra_topk(_matrix(left.column("vec")), ids, _matrix(right.column("vec")), qids, k)
        rows = np.asarray(right.column("row"), dtype=np.int64)
        return pa.table([pa.array(v, pa.int64()) for v in (rows[i], qids[i], ids[j], s)], names=names)

    return run


def quantized(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, vec): components as floor(scale * x), x as double. Rows whose id or vector is
    null, or whose vector holds a null or non-finite component, take no part."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return (vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & F.coalesce(finite, F.lit(False)))
            .select(F.col("vec_id").cast("long").alias("vec_id"),
                    F.transform(x, lambda v: F.floor(v.cast("double") * scale)).alias("vec")))


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 5,
               block: int = 2048, query_block: int = 1024) -> DataFrame:
    """The ``k`` best ``vectors(vec_id, vec)`` of every row of ``queries(vec_id, vec)`` by integer
    inner product: (query_id, rank, vec_id, score).

    Only vectors of the query's own length are compared; a candidate with the query's id is
    its own row and is left out; fewer candidates than ``k`` give fewer rows; ties go to the
    smaller id; a repeated query row is answered once per row. Empty inputs give no rows.
    """
    cells = max(1, -(-vectors.count() // block))
    query_cells = max(1, -(-queries.count() // query_block))
    row = F.monotonically_increasing_id()
    dealt = (vectors.select("vec_id", "vec", F.size("vec").alias("dims"), row.alias("row"))
             .select("vec_id", "vec", "dims", F.pmod("row", F.lit(cells)).alias("cell"),
                     F.explode(F.sequence(F.lit(0), F.lit(query_cells - 1))).alias("query_cell")))
    asked = (queries.select("vec_id", "vec", F.size("vec").alias("dims"), row.alias("row"))
             .select("vec_id", "vec", "dims", "row", F.pmod("row", F.lit(query_cells)).cast("int").alias("query_cell"),
                     F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))).alias("cell")))
    key = ["dims", "cell", "query_cell"]
    won = dealt.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(_cell(k), _SCHEMA)
    best = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id"))
    return (won.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
