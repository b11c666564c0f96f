"""Exact nearest neighbours by inner product as a block matrix join.

Queries and candidates are cut into blocks of bounded size. In each tile (a query block against a candidate block) the product
of int8 codes gives every score up to a known quantisation error; pairs whose upper bound stays below the k-th lower bound of
their query are out, the rest is computed anew in double precision from the original vectors. The k best of each tile are
merged by heaps, a bounded number of tiles at a time.
"""

from __future__ import annotations

import heapq
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_RESULT = "query_row long, query_id long, cell long, vec_id long, score double"
_PAIRS_AT_ONCE = 1 << 16
_RUNS_AT_ONCE = 64


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, vector as doubles, dim) of rows that have an id and a finite vector other than zero."""
    finite = F.forall(F.col("vector"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vector"))
            .filter(F.col("id").isNotNull() & F.col("vector").isNotNull())
            .filter(finite & F.exists(F.col("vector"), lambda x: x != 0))
            .withColumn("dim", F.size("vector")))


def _matrix(table: pa.Table) -> np.ndarray:
    lists = table["vector"].combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _coded(x: np.ndarray):
    """int8 codes as floats (products of codes stay exact), scale per row, norm of the coded row and of its error."""
    scale = np.abs(x).max(axis=1, keepdims=True) / 127.0
    scale[scale == 0] = 1.0
    codes = np.rint(x / scale).astype(np.int8)
    back = codes * scale
    # The margin covers rounding in the norms themselves.
    return codes, scale, np.linalg.norm(back, axis=1, keepdims=True) * (1 + 1e-9), np.linalg.norm(x - back, axis=1, keepdims=True) * (1 + 1e-9)


def _exact(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of the pairs (i, j) in double precision, a bounded number at a time."""
    out = np.empty(len(i))
    for at in range(0, len(i), _PAIRS_AT_ONCE):
        part = slice(at, at + _PAIRS_AT_ONCE)
        a, b, total = left[i[part]].T, right[j[part]].T, 0.0
        for x, y in zip(a, b, strict=True):  # component by component: equal vectors get equal scores, whatever the tile
            total = total + x * y
        out[part] = total
    return out


def tile(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, rows_at_once: int = 256):
    """(query index, candidate index, score) of the k best candidates of every query within a tile, best first."""
    codes, scales, norms, errors = _coded(vectors)
    integers, wide = codes.T.astype(np.float64), norms + errors
    found = []
    for at in range(0, len(queries), rows_at_once):
        own = slice(at, at + rows_at_once)
        qc, qs, qn, qe = _coded(queries[own])
        near = (qc.astype(np.float64) @ integers) * qs * scales.T
        slack = qn * errors.T + qe * wide.T
        slack += 1e-9 * (qn * norms.T) + 1e-300
        same = query_ids[own][:, None] == ids[None, :]
        low, high = np.where(same, -np.inf, near - slack), np.where(same, -np.inf, near + slack)
        if low.shape[1] > k:
            floor = np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k][:, None]
        else:
            floor = np.full((low.shape[0], 1), -np.inf)
        i, j = np.nonzero((high >= floor) & ~same)
        score = _exact(queries[own], vectors, i, j)
        order = np.lexsort((ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        first = np.searchsorted(i, i)
        best = np.arange(len(i)) - first < k
        found.append((i[best] + at, j[best], score[best]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, int), np.empty(0, int), np.empty(0))


def _tiles(k: int):
    schema = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("cell", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def work(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        if not len(queries) or not len(candidates):
            return schema.empty_table()
        query_ids, ids = queries["id"].to_numpy(), candidates["id"].to_numpy()
        i, j, score = tile(_matrix(queries), query_ids, _matrix(candidates), ids, k)
        return pa.table([queries["row"].to_numpy()[i], query_ids[i], np.full(len(i), candidates["cell"][0].as_py()), ids[j], score], schema=schema)
    return work


def _merge(k: int):
    def work(rows: pa.Table) -> pa.Table:
        """Heap over the sorted runs of one query, one run per tile or earlier merge."""
        rows = rows.sort_by([("cell", "ascending"), ("score", "descending"), ("vec_id", "ascending")])
        cells, scores, ids = rows["cell"].to_numpy(), rows["score"].to_numpy(), rows["vec_id"].to_numpy()
        edges = [0, *(np.nonzero(np.diff(cells))[0] + 1).tolist(), len(cells)]
        runs = [list(zip((-scores[a:b]).tolist(), ids[a:b].tolist(), range(a, b), strict=True)) for a, b in zip(edges, edges[1:], strict=False)]
        return rows.take(pa.array([x[2] for x in islice(heapq.merge(*runs), k)], pa.int64()))
    return work


def search(queries: DataFrame, candidates: DataFrame, k: int = 20, block: int = 4096, id_column: str = "vec_id",
           vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of largest inner product for every query row, ties to the smaller id.

    Rows without an id, and vectors that are null, empty, zero or hold null or non-finite components, take no part.
    A candidate with the id of the query is the query's own. Only vectors of equal length meet. Repeated candidate rows are
    candidates of their own; a repeated query row is answered again. The result is exact. Blocks hold ``block`` rows on average.
    """
    asked = usable(queries, id_column, vector_column).withColumn("row", F.monotonically_increasing_id())
    given = usable(candidates, id_column, vector_column).withColumn("row", F.monotonically_increasing_id())
    query_blocks, cells = (max(1, -(-x.count() // block)) for x in (asked, given))
    salt = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(n)).cast("long")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = asked.withColumn("block", salt(query_blocks, 1)).withColumn("cell", every(cells))
    right = given.withColumn("cell", salt(cells, 2)).withColumn("block", every(query_blocks))
    keys = ["dim", "block", "cell"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_tiles(k), _RESULT)
    runs = cells
    while runs > 1:
        found = found.withColumn("__merge", F.expr(f"cell div {_RUNS_AT_ONCE}"))
        found = found.groupBy("query_row", "__merge").applyInArrow(_keep(_merge(k)), _RESULT).withColumn("cell", F.expr(f"cell div {_RUNS_AT_ONCE}"))
        runs = -(-runs // _RUNS_AT_ONCE)
    return _ranked(found)


def _keep(merge):
    def work(rows: pa.Table) -> pa.Table:
        return merge(rows.drop_columns(["__merge"]))
    return work


def _ranked(found: DataFrame) -> DataFrame:
    from pyspark.sql import Window
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score")
