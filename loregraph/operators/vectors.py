"""Exact nearest vectors: blocks of queries times blocks of the collection, each a matrix product of unit vectors whose best rows alone leave the task."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loregraph.session import parallelism

#: Rows of a query block and of a collection block; collection blocks are smaller while there are fewer of them than tasks can run at once.
QUERY_BLOCK, COLLECTION_BLOCK, LEAST_BLOCK = 16_384, 131_072, 1_024
#: Rows of the parts of a tile that are multiplied at once.
SUB_Q, SUB_C = 256, 8_192
DECIMALS = 6


def _unit(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def best_of(rows: np.ndarray, sims: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best entries of each row: the higher similarity, then the smaller id."""
    order = np.lexsort((ids, -sims, rows))
    rows, sims, ids = rows[order], sims[order], ids[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[keep], sims[keep], ids[keep]


def tile_best(q: np.ndarray, c: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, cosine rounded to 6 decimals, id) of the ``k`` best rows of ``c`` for each row of ``q``, both of unit length."""
    out = []
    for a in range(0, len(q), SUB_Q):
        rows, sims, got = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        for b in range(0, len(c), SUB_C):
            s = np.round(q[a : a + SUB_Q] @ c[b : b + SUB_C].T, DECIMALS)
            near = s >= np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None] if s.shape[1] > k else np.ones(s.shape, bool)
            r, i = np.nonzero(near)
            rows, sims, got = best_of(np.concatenate([rows, r]), np.concatenate([sims, s[r, i]]), np.concatenate([got, ids[b + i]]), k)
        out.append((rows + a, sims, got))
    return tuple(np.concatenate(x) for x in zip(*out))


def _tile(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return schema.empty_table()
        rows, sims, ids = tile_best(_unit(left["v"]), _unit(right["v"]), right["id"].to_numpy(), k)
        return pa.table([pa.array(left["query_id"].to_numpy()[rows]), pa.array(ids), pa.array(sims)], schema=schema)

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int, *, id_col: str = "id", vec: str = "embedding", group: str | None = None, other_than_itself: bool = False) -> DataFrame:
    """(query_id, id, score, rank): the ``k`` rows of ``vectors`` with the greatest cosine for each row of ``queries`` (query_id, ``vec``), of its ``group`` only if one is named.

    Cosines are rounded to 6 decimals, ties go to the smaller id. Null, empty and all-zero vectors take no part; vectors of different lengths are not compared. Both sides
    are cut into blocks, so that neither a hot group nor the number of queries meets in one task; each tile gives ``k`` rows a query.
    """
    spark = vectors.sparkSession
    n, nq = vectors.count(), queries.count()
    q_blocks = max(1, -(-nq // QUERY_BLOCK))
    c_blocks = max(1, -(-n // COLLECTION_BLOCK), min(-(-n // LEAST_BLOCK), -(-2 * parallelism(spark) // q_blocks)))
    usable = F.exists(vec, lambda x: x != 0) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x))
    g = (F.col(group) if group else F.lit(0)).cast("string").alias("g")
    cell = lambda key, blocks, other: [F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("mine"), F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias("theirs")]
    left = queries.filter(usable).select(F.col("query_id").cast("long").alias("query_id"), F.col(vec).cast("array<double>").alias("v"), g, *cell("query_id", q_blocks, c_blocks))
    right = vectors.filter(usable).select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v"), g, *cell(id_col, c_blocks, q_blocks))
    keys = ["g", "dim", "tile"]
    left = left.withColumn("dim", F.size("v")).withColumn("tile", F.col("mine") * c_blocks + F.col("theirs")).drop("mine", "theirs")
    right = right.withColumn("dim", F.size("v")).withColumn("tile", F.col("theirs") * c_blocks + F.col("mine")).drop("mine", "theirs")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_tile(k + other_than_itself), "query_id long, id long, score double")
    if other_than_itself:
        found = found.filter("id <> query_id")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
