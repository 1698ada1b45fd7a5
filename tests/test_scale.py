"""Work that must not grow with pairs of rows: what large tables ran out of disk or time by, on small frames."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from loregraph.operators import facts as K
from loregraph.operators import keywords as KW
from loregraph.operators import retrieval as R
from loregraph.operators import text as T


def shuffled(spark, df, what: str = "records") -> int:
    """Rows, or bytes, that the shuffles of a query write; ``df`` gives a frame, or runs the query itself."""
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    wait = lambda: spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)

    def every() -> dict:
        wait()
        stages = store.stageList(None, False, False, none, None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() if what == "records" else s.shuffleWriteBytes() for s in map(stages.apply, range(stages.size()))}

    before = every()
    if hasattr(got := df(), "write"):
        got.write.format("noop").mode("overwrite").save()
    return sum(n for k, n in every().items() if k not in before)


def keyword_tables(spark, n=1_500, nq=120):
    """Texts that all hold one word forty times, and queries of this word and a rare one."""
    c = spark.range(n).select(F.col("id"), F.col("id").alias("page_id"), F.lit("body").alias("chunk_source"), F.concat(F.repeat(F.lit("common "), 40), F.concat(F.lit("w"), F.col("id") % nq)).alias("chunk_text"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("embedding"))
    q = spark.range(nq).select(F.col("id").alias("query_id"), F.concat(F.lit("Common w"), F.col("id")).alias("query"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("embedding"))
    p = spark.range(n).select("id", F.concat(F.lit("notes/"), "id").alias("slug"), F.lit("t").alias("title"), F.lit("note").alias("type"), F.lit("s").alias("source_id"), F.lit(None).cast("timestamp").alias("deleted_at"), F.lit(0.0).alias("emotional_weight"), *[F.lit("2025-01-01").cast("timestamp").alias(x) for x in ("effective_date", "updated_at", "created_at")])
    l = spark.createDataFrame([], "to_page_id long, from_page_id long, link_source string")
    return p, c, l, q


def test_postings_of_common_words_stay_in_their_task(spark):
    p, c, l, q = keyword_tables(spark)
    arm = 5
    rows = shuffled(spark, lambda: R.fused_scores(p, c, l, q, "2025-06-01 00:00:00", arm=arm))
    assert rows < 40 * 1_500, rows  # one row for each time the common word stands in a text is too many
    got = R.fused_scores(p, c, l, q, "2025-06-01 00:00:00", arm=arm).groupBy("query_id").count().collect()
    assert len(got) == 120 and all(arm <= x["count"] <= 2 * arm for x in got)


def test_keyword_hits_are_those_of_the_scores(spark):
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(30)]
    texts = [(i if i % 40 else 0, " ".join(rnd.choice(vocab[: rnd.choice([3, 30])]) for _ in range(rnd.randrange(0, 25))) if i % 17 else None) for i in range(400)]  # the id 0 stands for ten rows
    asked = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randrange(0, 4)))) for i in range(60)] + [(100, "w1 unknown"), (101, None), (102, "W1, w1"), (103, "w1")]
    c, q = spark.createDataFrame(texts, "id long, chunk_text string").repartition(3), spark.createDataFrame(asked, "query_id long, query string")
    plain = lambda df: sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 6)) for r in df.collect())
    want = plain(R.top(R.keyword_scores(c, q).withColumn("score", F.round("score", 6)), "query_id", "score", 7, "chunk_id"))
    assert len(want) > 100 and {x[0] for x in want} >= {102, 103}
    assert plain(KW.keyword_hits(c, q, 7)) == want
    assert plain(KW.keyword_hits(c, q, 7, sets_per_pass=9)) == want
    assert KW.keyword_hits(c.limit(0), q, 7).count() == 0 and KW.keyword_hits(c, q.limit(0), 7).count() == 0
    s = spark.createDataFrame([("b", "x y"), ("a", "x y")], "id string, chunk_text string")
    assert [(r.query_id, r.chunk_id) for r in KW.keyword_hits(s, spark.createDataFrame([("q", "y")], "query_id string, query string"), 1).collect()] == [("q", "a")]


def test_best_of_set_against_counting():
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 6, rng.integers(0, 12)).tolist() for _ in range(90)]
    code, row = np.array([t for d in docs for t in d]), np.array([i for i, d in enumerate(docs) for _ in d])
    rows, gain, bounds = KW.postings(code, row, len(docs), 7)
    for terms in ([0], [1, 2], [0, 3, 5]):
        want = sorted((-round(sum(1 + np.log(Counter(d)[t]) for t in terms), 6), i) for i, d in enumerate(docs) if set(terms) <= set(d))[:8]
        r, s = KW.best_of_set(np.array(terms), rows, gain, bounds, np.arange(len(docs)), 8)
        assert sorted(zip(-s, r)) == want


def alike_tables(spark, n=300, nq=20):
    """Results with texts, of which some are near copies, equal sets of words, empty or null."""
    rnd = random.Random(9)
    base = [[f"w{rnd.randrange(2000)}" for _ in range(rnd.choice([3, 40, 60]))] for _ in range(n // 3)]
    texts = []
    for i in range(n):
        words = list(base[rnd.randrange(len(base))])
        for _ in range(rnd.choice([0, 0, 1, 3, 8])):
            words[rnd.randrange(len(words))] = f"x{rnd.randrange(2000)}"
        texts.append((i, None if i % 31 == 0 else "" if i % 37 == 0 else " ".join(words if i % 2 else reversed(words)).title()))
    docs = spark.createDataFrame(texts, "chunk_id long, chunk_text string")
    rows = [(q, c, c, "t", float(rnd.randrange(50))) for q in range(nq) for c in rnd.sample(range(n), 120)] + [(0, -1, None, "t", 3.0), (0, -2, None, "t", 3.0)]
    return spark.createDataFrame(rows, "query_id long, page_id long, chunk_id long, type string, score double"), docs


def test_near_texts_by_marks_are_those_by_texts(spark):
    r, docs = alike_tables(spark)
    order, up = ["score", "page_id", "chunk_id"], [False, True, True]
    plain = lambda df: sorted((x.query_id, x.page_id) for x in df.collect())
    for limit in (0.5, 0.85):
        want = plain(T.greedy_distinct(r.join(docs, "chunk_id", "left"), "query_id", order, up, "chunk_text", limit))
        got = plain(T.greedy_distinct_rows(r, docs, "query_id", order, up, "chunk_id", "chunk_text", limit))
        assert got == want and 100 < len(got) < r.count() and (0, -1) in got and (0, -2) in got


def test_texts_of_results_do_not_go_along(spark):
    """Every query finds every text: a text is looked up once, not carried along with each result."""
    p, c, l, q = keyword_tables(spark, 300, 30)
    c = c.withColumn("chunk_text", F.concat_ws(" ", "chunk_text", *[F.sha2(F.concat(F.col("id").cast("string"), F.lit(str(i))), 512) for i in range(40)]))
    written = lambda: R.hybrid_search(p, c, l, q, "2025-06-01 00:00:00").collect()
    size = shuffled(spark, written, "bytes")
    assert size < 30 * 100 * 5_000 / 2, size  # 30 queries with 100 texts of 5 kB each, at least


def test_claims_of_one_text_are_compared_once(spark):
    n, nq = 3_000, 200
    t = spark.range(n).select((F.col("id") % 7).alias("page_id"), F.col("id").alias("row_num"), F.element_at(F.array(*[F.lit(x) for x in ("red bolt", "Red bolt", "red rod", "blue anvil")]), (F.col("id") % 4 + 1).cast("int")).alias("claim"))
    q = spark.range(nq).select(F.col("id").alias("query_id"), F.when(F.col("id") % 2 == 0, "red bolt").otherwise("anvil of blue").alias("query"))
    df = lambda: K.search_takes(t, q)
    rows = shuffled(spark, df)
    assert rows < n * nq / 40, rows
    got = {}
    for x in df().orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.page_id, x.row_num, x.similarity))
    want = sorted(((i % 7, i, 1.0) for i in range(n) if i % 4 < 2))[:10]
    assert len(got) == nq and got[0] == want == got[198] and [x[:2] for x in got[1]] == sorted((i % 7, i) for i in range(n) if i % 4 == 3)[:10]


def test_claims_found_are_those_of_all_pairs(spark):
    rnd = random.Random(2)
    name = lambda: " ".join(rnd.choice(["red", "rod", "bolt", "bold", "anvil", "a", "ab", "größe", "new", "news"]) for _ in range(rnd.randrange(0, 4)))
    claims, asked = [name() for _ in range(120)] + [None], [name() for _ in range(30)] + [None]
    grams = lambda s: {f"  {w} "[i : i + 3] for w in (s or "").lower().split() for i in range(len(w) + 1)}
    want = []
    for a, x in enumerate(asked):
        hits = []
        for i, y in enumerate(claims):
            p, q = grams(x), grams(y)
            if p & q and round(len(p & q) / len(p | q), 6) >= 0.3:
                hits.append((-round(len(p & q) / len(p | q), 6), i % 5, i))
        want += [(a, m, i, r + 1) for r, (_, m, i) in enumerate(sorted(hits)[:10])]
    t = spark.createDataFrame([(i % 5, i, c) for i, c in enumerate(claims)], "page_id long, row_num long, claim string")
    q = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    assert sorted((x.query_id, x.page_id, x.row_num, x["rank"]) for x in K.search_takes(t, q).collect()) == sorted(want)
