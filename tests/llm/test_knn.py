import numpy as np
from pyspark.sql import functions as F

from loregraph.llm.knn import nearest_vectors, quantise


def brute(ids, x, queries, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = set()
    for i in np.flatnonzero(queries):
        s = np.round(u @ u[i], 6)
        order = [j for j in np.lexsort((ids, -s)) if j != i][:k]
        out |= {(int(ids[i]), r + 1, int(ids[j]), float(s[j])) for r, j in enumerate(order)}
    return out


def test_bound_holds():
    x = np.random.default_rng(1).normal(size=(300, 64)).astype("float32").astype(float)
    unit, codes, scale, lost = quantise(x)
    est = (codes.astype(float) @ codes.astype(float).T) * np.outer(scale, scale)
    assert (np.abs(est - unit @ unit.T) <= lost[:, None] + (1 + lost[:, None]) * lost[None, :]).all()


def test_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(-3, 4, size=(900, 6)).astype(float)  # coarse values: many ties
    x[:300] = x[0]  # a third of all rows are one vector
    x = x[np.abs(x).sum(1) > 0]
    ids = rng.permutation(len(x)) + 1
    df = spark.createDataFrame([(int(i), [float(c) for c in v], "clash") for i, v in zip(ids, x)], "id long, e array<float>, h1 string")
    got = nearest_vectors(df, "id", "e", F.col("id") % 7 == 0, k=5, query_block=40, collection_block=200, least_block=100)
    assert {tuple(r) for r in got.collect()} == brute(ids, x, ids % 7 == 0, 5)


def test_degenerate_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]), (None, [1.0, 1.0]), (7, [1.0, 1.0]), (8, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "id long, e array<float>")
    got = {(r.query_id, r.neighbour_id) for r in nearest_vectors(df, "id", "e", F.lit(True)).collect()}
    assert got == {(1, 7), (7, 1)}
    assert nearest_vectors(df.limit(0), "id", "e", F.lit(True)).count() == 0


def test_products_of_long_vectors_are_exact():
    from loregraph.llm.knn import code_products

    q, c = (np.full((n, 3_000), 127, np.float32) for n in (2, 3))
    q[0, 1::2] = -127
    assert (code_products(q, c)[1] == 127 * 127 * 3_000).all() and (code_products(q, c)[0] == 0).all()
