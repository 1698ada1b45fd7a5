from pyspark.sql import functions as F
from loregraph.operators import facts as K

TAKES = "page_id long, row_num int, claim string, weight double, quality string, active boolean"


def test_takes(spark):
    t = spark.createDataFrame([(1, 1, "a", 0.5, None, True), (1, 2, "b", 0.4, "correct", True), (2, 1, "c", 0.1, None, True)], TAKES)
    new = spark.createDataFrame([(1, 1, "a2", 1.7, None, True), (1, 2, "b2", 0.9, None, True), (3, 1, "d", -2.0, None, True)], TAKES)
    got = {(r.page_id, r.row_num): (r.claim, r.weight) for r in K.upsert_takes(t, new).collect()}
    assert got == {(1, 1): ("a2", 1.0), (1, 2): ("b", 0.4), (2, 1): ("c", 0.1), (3, 1): ("d", 0.0)}
    s = sorted((r.page_id, r.row_num, r.claim, r.active) for r in K.supersede_take(t, 1, 1, "z").collect())
    assert s == [(1, 1, "a", False), (1, 2, "b", True), (1, 3, "z", True), (2, 1, "c", True)]
    assert K.supersede_take(t, 1, 2, "z").count() == 3  # resolved claims are immutable
    o = spark.createDataFrame([(1, 2, "incorrect"), (2, 1, "partial")], "page_id long, row_num int, quality string")
    assert {(r.page_id, r.row_num): r.quality for r in K.resolve_takes(t, o).collect()} == {(1, 1): None, (1, 2): "correct", (2, 1): "partial"}


def test_superseding(spark):
    f = spark.createDataFrame([(1, 9.0, None, None), (2, 8.0, None, None)], "id long, value double, expired_at timestamp_ntz, superseded_by long")
    n = spark.createDataFrame([(3, 7.0, None, None, 1), (4, 6.0, None, None, None)], "id long, value double, expired_at timestamp_ntz, superseded_by long, supersedes long")
    got = K.insert_superseding(f, n, "2024-01-01 00:00:00")
    assert sorted((r.id, r.superseded_by) for r in got.collect()) == [(1, 3), (2, None), (3, None), (4, None)]
    assert K.active(got).count() == 3 and [r.id for r in K.supersessions(got, 5).collect()] == [1]


def test_consolidation_equals_a_plain_model(spark):
    import random

    rng = random.Random(4)
    rows = [(i, "hot" if i % 3 else "b", [rng.choice([0.0, 1.0]) for _ in range(4)]) for i in range(300)] + [(900, "few", [1.0] * 4), (901, "few", [1.0] * 4), (902, "hot", None)]
    got = {(r.entity, r.head, r.id) for r in K.consolidate(spark.createDataFrame(rows, "id long, e string, v array<double>"), "e", "id", "v").collect()}

    def cos(a, b):
        n = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return sum(x * y for x, y in zip(a, b)) / n if n else 0.0

    want = set()
    for e in ("hot", "b"):
        clusters = []
        for i, _, v in sorted((r for r in rows if r[1] == e and r[2]), reverse=True):
            c = next((c for c in clusters if cos(c[0][1], v) >= 0.85 - 1e-12), None)
            clusters.append([(i, v)]) if c is None else c.append((i, v))
        want |= {(e, c[0][0], i) for c in clusters if len(c) > 1 for i, _ in c}
    assert got == want


def test_consolidation_waits_for_age(spark):
    from loregraph.operators import facts as K

    rows = [(i, "e" if i < 5 else "f", [1.0, 0.0], "2024-01-01 00:00:00" if i < 5 else "2024-01-02 12:00:00") for i in range(10)]
    df = spark.createDataFrame(rows, "id long, e string, v array<double>, s string").withColumn("s", F.col("s").cast("timestamp_ntz"))
    got = K.consolidate(df, "e", "id", "v", stamp="s", as_of="2024-01-03 00:00:00").collect()
    assert {r.entity for r in got} == {"e"} and {r.head for r in got} == {4}
    assert {r.entity for r in K.consolidate(df, "e", "id", "v").collect()} == {"e", "f"}
