"""The k most similar vectors for a set of query vectors: a block matrix join over int8 codes.

Vectors are normalised and coded as int8 with one scale each. A tile multiplies a block of query codes with a block of collection codes;
the sums of up to 1,024 products are whole numbers below 2**24, so a float32 matrix product gives them exactly; longer vectors are multiplied in slices of that length. With the norm of what the coding lost on either side
every estimate has a proven error bound. Pairs whose upper bound misses the k-th lower bound are dropped, the surviving pairs are recomputed in
double precision, and the best of every tile are merged.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loregraph.session import checkpointed, parallelism

K = 10
#: Rows of a query block and of a collection block; collection blocks are smaller while there are fewer of them than TILES_PER_CORE asks for.
QUERY_BLOCK, COLLECTION_BLOCK, LEAST_BLOCK, TILES_PER_CORE = 65_536, 262_144, 4_096, 3
#: Rows of the sub-tiles held in memory at once.
SUB_Q, SUB_C = 512, 4_096
DECIMALS = 6


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors (double), int8 codes, scales, and the norms of the coding errors."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    scale = np.abs(unit).max(axis=1) / 127.0
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    lost = np.linalg.norm(unit - codes * scale[:, None], axis=1)
    return unit, codes, scale, lost


#: Products of int8 codes that float32 sums exactly: 127 * 127 * 1,024 < 2 ** 24.
SLICE = 1_024


def code_products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The exact inner products of all rows of two arrays of int8 codes, given as float32."""
    if q.shape[1] <= SLICE:
        return q @ c.T
    return sum((q[:, s : s + SLICE] @ c[:, s : s + SLICE].T).astype(np.float64) for s in range(0, q.shape[1], SLICE))


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k]


def tile_top(queries: np.ndarray, collection: np.ndarray, members: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query row the ids of its ``k`` best members of this collection block, as (query row, id, rounded cosine).

    ``members`` holds the ids (at most ``k``, ascending) of each collection row. Best means the higher cosine rounded to 6 decimals, then the smaller id.
    """
    qu, qc, qs, ql = quantise(queries)
    cu, cc, cs, cl = quantise(collection)
    ccf = cc.astype(np.float32)
    slack = 10.0**-DECIMALS
    out_q, out_i, out_s = [], [], []
    counts = np.array([len(m) for m in members])
    flat = np.concatenate(members) if len(members) else np.empty(0, np.int64)
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    for a in range(0, len(qc), SUB_Q):
        b = min(a + SUB_Q, len(qc))
        qf = qc[a:b].astype(np.float32)
        floor = np.full(b - a, -np.inf)  # lower bound of the k-th best cosine so far
        best_q, best_c, best_s = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for c in range(0, len(ccf), SUB_C):
            d = min(c + SUB_C, len(ccf))
            # |<u,v> - <u~,v~>| <= |u - u~| + |u~| |v - v~|; the scales turn code products into <u~,v~>
            est = code_products(qf, ccf[c:d]) * (qs[a:b, None] * cs[None, c:d]).astype(np.float32)
            bound = ql[a:b] + (1.0 + ql[a:b]) * cl[c:d].max() + 2e-6
            if c == 0 and d - c >= k:
                floor = _kth(est, k) - bound
            qi, ci = np.divmod(np.flatnonzero(est >= (floor - bound - slack).astype(np.float32)[:, None]), d - c)
            exact = np.round(np.einsum("ij,ij->i", qu[a + qi], cu[c + ci]), DECIMALS)
            keep = exact >= floor[qi] - slack
            best_q, best_c, best_s = np.concatenate([best_q, qi[keep]]), np.concatenate([best_c, c + ci[keep]]), np.concatenate([best_s, exact[keep]])
            order = np.lexsort((-best_s, best_q))
            best_q, best_c, best_s = best_q[order], best_c[order], best_s[order]
            at = np.arange(len(best_q)) - np.searchsorted(best_q, best_q)
            kth = at == k - 1
            floor[best_q[kth]] = np.maximum(floor[best_q[kth]], best_s[kth])
            keep = best_s >= floor[best_q] - slack / 2  # rows tied with the k-th stay: the smaller id decides
            best_q, best_c, best_s = best_q[keep], best_c[keep], best_s[keep]
        reps = counts[best_c]
        rows, sims = np.repeat(best_q, reps), np.repeat(best_s, reps)
        ids = flat[np.repeat(starts[best_c], reps) + np.arange(len(rows)) - np.repeat(np.cumsum(reps) - reps, reps)]
        order = np.lexsort((ids, -sims, rows))
        rows, sims, ids = rows[order], sims[order], ids[order]
        keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
        out_q.append(rows[keep] + a)
        out_i.append(ids[keep])
        out_s.append(sims[keep])
    return np.concatenate(out_q), np.concatenate(out_i), np.concatenate(out_s)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _tile(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("best", pa.list_(pa.struct([("far", pa.float64()), ("id", pa.int64())])))])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return schema.empty_table()
        ids = right["ids"].combine_chunks()
        cuts = ids.offsets.to_numpy()
        members = np.split(ids.values.to_numpy(zero_copy_only=False), cuts[1:-1])
        rows, got, sims = tile_top(_matrix(left["v"]), _matrix(right["v"]), members, k)
        offsets = np.searchsorted(rows, np.arange(len(left) + 1)).astype(np.int32)
        best = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(-sims), pa.array(got)], ["far", "id"]))
        return pa.Table.from_arrays([left["h1"].combine_chunks(), left["h2"].combine_chunks(), best], schema=schema)

    return run


def nearest_vectors(df: DataFrame, id_col: str, vec_col: str, is_query, *, k: int = K, query_block: int = QUERY_BLOCK, collection_block: int = COLLECTION_BLOCK, least_block: int = LEAST_BLOCK) -> DataFrame:
    """(query_id, rank, neighbour_id, similarity): the ``k`` rows of ``df`` most similar to each row for which the Column ``is_query`` holds.

    Similarity is the cosine in double precision rounded to 6 decimals; ties go to the smaller id; a row is not its own neighbour. The result is
    exact. Null, empty and all-zero vectors and rows without an id take no part; vectors that hold a null or NaN take no part either; all others must
    have one length (rows of another length are compared among themselves). Equal vectors are found once and stand for all their rows, so a vector
    repeated millions of times costs no more than one. Fewer than ``k`` other rows give as many as there are. Other columns are not looked at.
    """
    spark = df.sparkSession
    v = F.col("v")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    usable = F.col("id").isNotNull() & v.isNotNull() & F.exists(v, lambda x: x != 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x))
    rows = rows.filter(usable).select("id", "v", "q", F.xxhash64(v).alias("h1"), F.xxhash64(F.lit(7), v).alias("h2"))
    # the k + 1 smallest ids of equal vectors suffice; the limit is applied before the shuffle, so a hot vector sends k + 1 rows per task
    key = Window.partitionBy("h1", "h2").orderBy("id")
    few = rows.withColumn("rn", F.row_number().over(key)).filter(F.col("rn") <= k + 1)
    distinct = checkpointed(few.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.sort_array(F.collect_list("id")).alias("ids")))
    asked = rows.filter("q").select("id", "h1", "h2", "v")
    query_vectors = checkpointed(asked.groupBy("h1", "h2").agg(F.first("v").alias("v")))
    n, nq = distinct.count(), query_vectors.count()
    q_blocks = max(1, -(-nq // query_block))
    c_blocks = max(1, -(-n // collection_block), min(-(-n // least_block), -(-TILES_PER_CORE * parallelism(spark) // q_blocks)))
    block = lambda blocks, other: [F.pmod("h1", F.lit(blocks)).alias("mine"), F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias("theirs")]
    dim = F.size("v").alias("dim")
    left = query_vectors.select("h1", "h2", "v", dim, *block(q_blocks, c_blocks)).withColumn("tile", F.col("mine") * c_blocks + F.col("theirs")).drop("mine", "theirs")
    right = distinct.select("ids", "v", dim, *block(c_blocks, q_blocks)).withColumn("tile", F.col("theirs") * c_blocks + F.col("mine")).drop("mine", "theirs")
    tiles = q_blocks * c_blocks
    left, right = left.repartition(tiles, "tile", "dim"), right.repartition(tiles, "tile", "dim")
    found = left.groupBy("tile", "dim").cogroup(right.groupBy("tile", "dim")).applyInArrow(_tile(k + 1), "h1 long, h2 long, best array<struct<far double, id long>>")
    # the sorted lists of the tiles are merged as a stream that stops after k + 1, so that no task holds those of all tiles
    far = found.select("h1", "h2", F.inline("best")).withColumn("rn", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("far", "id"))).filter(F.col("rn") <= k + 1)
    best = far.groupBy("h1", "h2").agg(F.array_sort(F.collect_list(F.struct("far", "id"))).alias("best"))
    hits = asked.select("id", "h1", "h2").join(best, ["h1", "h2"])
    mine = F.slice(F.filter("best", lambda x: x["id"] != F.col("id")), 1, k)
    return hits.select(F.col("id").alias("query_id"), F.posexplode(mine).alias("pos", "x")).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("x.id").alias("neighbour_id"), (-F.col("x.far")).alias("similarity"))
