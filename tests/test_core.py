import math

import pytest
from pyspark.sql import functions as F

from loregraph.functions import expressions as X
from loregraph.operators import graph as G
from loregraph.operators import pages as P
from loregraph.operators import retrieval as R
from loregraph.operators import stats as S
from loregraph.operators import text as T
from loregraph.sources import files as SF
from loregraph.streaming import ingest as SI


def one(df):
    return df.collect()[0]


def test_scorecard_golden(spark):
    rows = [("A", 0.9, "correct"), ("A", 0.6, "correct"), ("A", 0.7, "incorrect"), ("A", 0.4, "incorrect"), ("A", 0.5, "partial"), ("B", 0.8, "correct"), (None, None, None)]
    c = spark.createDataFrame(rows, "holder string, weight double, quality string")
    r = {x.holder: x for x in S.scorecard(c, "holder").collect()}
    assert r["A"].brier == 0.205 and r["A"].partial_rate == 0.2 and r["A"].accuracy == 0.5 and r["B"].brier == 0.04 and r[None].brier is None
    curve = {x.bin: (x.n, x.observed) for x in S.calibration_curve(c.filter("holder = 'A'")).collect()}
    assert curve == {9: (1, 1.0), 6: (1, 1.0), 7: (1, 0.0), 4: (1, 0.0)}
    assert S.scorecard(c.limit(0), "holder").count() == 0


def test_calibration_bins_are_decimal(spark):
    c = spark.createDataFrame([(0.3, "correct"), (1.0, "correct")], "weight double, quality string")
    assert {x.bin for x in S.calibration_curve(c).collect()} == {3, 9}


def test_anomaly_with_and_without_variation(spark):
    rows = [("steady", f"2024-01-{d:02d}") for d in range(1, 31)] + [("wedding", "2024-01-30")] * 7 + [("old", "2024-01-10")]
    e = spark.createDataFrame(rows, "tag string, day string").withColumn("day", F.col("day").cast("timestamp"))
    got = S.anomalies(e, "tag", "day", "2024-01-30", 29).collect()
    assert [x.cohort for x in got] == ["wedding"]


def test_regressions_skip_zero_and_include_the_edge(spark):
    f = spark.createDataFrame([(1, "u", "m", 0.0, 1), (2, "u", "m", 100.0, 2), (3, "u", "m", 90.0, 3), (4, "u", "m", 81.1, 4), (5, "u", "n", 5.0, 1)], "id int, e string, m string, v double, t int")
    assert [(x.id, x.fall) for x in S.trajectory_regressions(f, "e", "m", "v", "t", "id").collect()] == [(3, 0.1)]


def test_token_budget_stops_at_first_overflow(spark):
    r = spark.createDataFrame([("q", 1, 4), ("q", 2, 6), ("q", 3, 1), ("p", 1, 11), ("p", 2, 1)], "q string, r int, c int")
    assert sorted((x.q, x.r) for x in S.token_budget(r, "q", "r", F.col("c"), 10).collect()) == [("q", 1), ("q", 2)]


def test_autocut_and_ranks(spark):
    r = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 0.95), ("a", 3, 0.5), ("a", 4, 0.45), ("b", 1, 1.0), ("b", 2, 0.9), ("c", 1, 0.3)], "q string, r int, s double")
    assert sorted((x.q, x.r) for x in S.autocut(r, "q", "r", "s").collect()) == [("a", 1), ("a", 2), ("b", 1), ("b", 2), ("c", 1)]


def test_ir_metrics(spark):
    ranked = spark.createDataFrame([("q", 1, 10), ("q", 2, 11), ("q", 3, 12)], "query string, rank int, doc int")
    rel = spark.createDataFrame([("q", 11), ("q", 12), ("q", 99), ("z", 1)], "query string, doc int")
    r = {x.query: x for x in S.ir_metrics(ranked, rel, 5).collect()}
    ideal = 1 + 1 / math.log2(3) + 0.5
    assert (r["q"].p_at_k, r["q"].r_at_k, r["q"].rr) == (0.4, 0.666667, 0.5) and abs(r["q"].ndcg - (1 / math.log2(3) + 0.5) / ideal) < 1e-6 and r["z"].ndcg == 0


def test_rank_fusion_bases(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id int, k string, rank int")
    b = spark.createDataFrame([(1, "y", 1)], "query_id int, k string, rank int")
    s = {x.k: x.rrf for x in R.rrf([(a, 1.0), (b, 1.0)], "k").collect()}
    assert abs(s["x"] - 1 / 60) < 1e-12 and abs(s["y"] - (1 / 61 + 1 / 60)) < 1e-12
    s = {x.k: x.rrf for x in R.rrf([(a, 1.0)], "k", base=1).collect()}
    assert abs(s["x"] - 1 / 61) < 1e-12


def test_keyword_needs_all_terms(spark):
    c = spark.createDataFrame([(1, "Alpha beta alpha"), (2, "alpha"), (3, None), (4, "")], "id long, chunk_text string")
    q = spark.createDataFrame([(7, "alpha beta"), (8, ""), (9, None)], "query_id int, query string")
    got = R.keyword_scores(c, q).collect()
    assert [(x.query_id, x.chunk_id) for x in got] == [(7, 1)] and abs(got[0].score - (2 + math.log(2))) < 1e-12


def test_source_factor_longest_prefix(spark):
    df = spark.createDataFrame([("media/x/1",), ("media/articles/1",), ("notes/1",), (None,)], "slug string")
    assert [x[0] for x in df.select(X.source_factor(F.col("slug"))).collect()] == [0.7, 1.1, 1.0, 1.0]
    assert [x[0] for x in df.select(X.source_factor(F.col("slug"), "high")).collect()] == [1.0] * 4


def test_recency_half_life_and_clamp(spark):
    df = spark.createDataFrame([("meetings/a", 60.0), ("concepts/a", 1.0), ("daily/a", -5.0)], "slug string, d double")
    assert [x[0] for x in df.select(X.recency(F.col("slug"), F.col("d"))).collect()] == [0.5, 0.0, 1.5]


def test_graph_with_cycle(spark):
    l = spark.createDataFrame([(1, 2, "a", None), (2, 3, "a", "mentions"), (2, 4, "b", None), (4, 1, "b", None), (4, 5, "c", None), (4, 5, "c", None)], "from_page_id long, to_page_id long, link_type string, link_source string")
    s = spark.createDataFrame([(1,)], "id long")
    assert sorted((x.node, x.hop) for x in G.fanout(l, s, 3).collect()) == [(2, 1), (4, 2), (5, 3)]
    assert sorted((x.to_page_id, x.depth) for x in G.walk_edges(l, s, 10).collect()) == [(1, 3), (2, 1), (3, 2), (4, 2), (5, 3)]
    with pytest.raises(ValueError):
        G.fanout(l, s, 11)


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000), (None, 1)]
    got = {}
    for x in G.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect():
        got.setdefault(x.component, set()).add(x.node)
    assert got == {0: set(range(61)), 1000: set(range(1000, 1300)), 5000: {5000}}


def test_upsert_keeps_provenance(spark):
    schema = "source_id string, slug string, title string, import_filename string, effective_date_source string"
    old = spark.createDataFrame([("s", "a", "A", "f.md", "date"), ("s", "b", "B", None, None)], schema)
    new = spark.createDataFrame([("s", "a", "A2", None, None), ("t", "a", "T", None, None)], schema)
    assert sorted((x.source_id, x.slug, x.title, x.import_filename or "") for x in P.upsert_pages(old, new).collect()) == [("s", "a", "A2", "f.md"), ("s", "b", "B", ""), ("t", "a", "T", "")]


def test_text_operators(spark):
    p = spark.createDataFrame([(1, "# Top\n[Ann](people/ann.md) and [[companies/x|X]]\n```\n[No](people/no)\n```", "- **2024-02-30** | no\n- **2024-02-28** | yes"), (2, None, None), (3, "", "")], "id long, compiled_truth string, timeline string")
    assert sorted((x.target, x.label) for x in T.entity_refs(p).collect()) == [("companies/x", "X"), ("people/ann", "Ann")]
    assert [(x.id, str(x.date), x.summary) for x in T.timeline_lines(p).collect()] == [(1, "2024-02-28", "yes")]
    assert [x.heading for x in T.sections(p).collect()] == ["Top"]
    back = T.from_markdown(T.to_markdown(p.withColumn("frontmatter", F.lit("{}")))).collect()
    assert back[0].timeline.startswith("- **2024") and back[2].compiled_truth == ""
    assert one(spark.range(1).select(T.strip_html(F.lit("<p>a<script>x</script> <b>b</b></p>"))))[0] == "a b"
    assert float(one(spark.range(1).select(T.money_total(F.lit("$1,234.50 and €2 and $x"))))[0]) == 1236.5
    assert one(spark.createDataFrame([("  ‘Ｆull  Width’ ",)], "a string").select(T.alias_norm("a")))[0] == "full width"


def test_chunks_keep_all_words():
    text = "\n\n".join(" ".join(f"w{i}x{j}" for j in range(170)) for i in range(9))
    chunks = T.chunk_text(text, 300, 50)
    assert [w for k, c in enumerate(chunks) for w in c.split()[50 if k else 0 :]] == text.split()
    assert T.chunk_text("") == [] and max(len(c.split()) for c in chunks) <= 300 * 1.5 + 50


def test_similar_titles_equals_brute_force(spark):
    import itertools
    import random

    rng = random.Random(2)
    titles = ["".join(rng.choice("abc") for _ in range(rng.randrange(3, 9))) + rng.choice(["", " x", " yy"]) for _ in range(120)]
    df = spark.createDataFrame([(i, "t", t) for i, t in enumerate(titles)], "id long, type string, title string")
    got = {(x.a, x.b) for x in R.similar_titles(df, 0.6).collect()}

    def grams(t):
        return {("  " + w + " ")[i : i + 3] for w in t.split() for i in range(len(w) + 1)}

    first = {t: titles.index(t) for t in titles}
    want = set()
    for a, b in itertools.combinations(sorted(set(titles)), 2):
        g, h = grams(a), grams(b)
        if round(len(g & h) / len(g | h), 6) >= 0.6:
            want.add(tuple(sorted((first[a], first[b]))))
    assert got == want and want


def test_greedy_distinct(spark):
    r = spark.createDataFrame([("q", 1, "a b c d"), ("q", 2, "a b c d"), ("q", 3, "x y"), ("q", 4, None)], "q string, r int, t string")
    assert sorted(x.r for x in T.greedy_distinct(r, "q", ["r"], [True], "t").collect()) == [1, 3, 4]


def test_sources(spark, tmp_path):
    (tmp_path / "people").mkdir()
    (tmp_path / "people" / "ann.md").write_text("---\ntitle: Ann Lee\n---\n# Other\nbody\n```py\nx = 1\n```\n")
    (tmp_path / "meetings").mkdir()
    (tmp_path / "meetings" / "2024-05-06-sync.md").write_text("# Sync\ntext")
    files = SF.read_markdown(spark, str(tmp_path))
    got = {x.slug: (x.title, x.type, str(x.day)) for x in SF.infer_front(files).collect()}
    assert got == {"people/ann": ("Ann Lee", "person", "None"), "meetings/2024-05-06-sync": ("Sync", "meeting", "2024-05-06")}
    known = files.filter("slug = 'people/ann'").select("slug", F.sha2("markdown", 256).alias("content_hash"))
    assert [x.slug for x in SF.changed(files, known).collect()] == ["meetings/2024-05-06-sync"]
    assert [(x.language, x.code) for x in SF.code_fences(files.select(F.lit(1).alias("id"), F.col("markdown").alias("compiled_truth"))).collect()] == [("py", "x = 1\n")]
    assert {x.kind for x in SF.read_binary(spark, str(tmp_path)).collect()} == {"other"}


def test_stream_dedup_slides(spark, tmp_path):
    hour = 3600
    rows = [(1, 240 * hour), (2, 250 * hour), (3, 270 * hour), (4, 300 * hour)]  # 3 is suppressed because 2 renewed the time
    df = spark.createDataFrame([(i, "k", t) for i, t in rows], "event_id long, k string, t long").select("event_id", "k", F.timestamp_seconds("t").alias("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")).withWatermark("ts", "1 hour")
    SI.drain(SI.dedup_sliding(stream, ["k"]), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    assert sorted(x.event_id for x in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 4]
    days = SI.daily_counters(df, "k").collect()
    assert sorted((x.day, x.n) for x in days) == [("1970-01-11", 2), ("1970-01-12", 1), ("1970-01-13", 1)]
    SI.drain(SI.rate_limited(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")).withWatermark("ts", "1 hour"), "k", 1, 20 * 3600), str(tmp_path / "rate"), str(tmp_path / "ckpt2"))
    accepted, last = [], None
    for r in sorted(df.collect(), key=lambda r: r.ts):
        if last is None or (r.ts - last).total_seconds() >= 20 * 3600:
            accepted.append(r.event_id)
            last = r.ts
    assert sorted(x.event_id for x in spark.read.parquet(str(tmp_path / "rate")).collect()) == sorted(accepted) and 0 < len(accepted) < 4
    ok, bad = SI.split_valid(df.withColumn("event_type", F.lit(None).cast("string")))
    assert ok.count() == 0 and bad.count() == 4


def test_mentions_of_long_names(spark):
    from loregraph.operators.text import mentions

    long = " ".join(f"Part{i}" for i in range(12))
    names = spark.createDataFrame([("The Jilwolwhox Systems Company", 1), (long, 2), ("Runway", 3), ("Hourborvrenx Partners B.V.", 4), ("abc", 5), (None, 6), ("Systems Company", 7)], "name string, entity long").withColumn("source_id", F.lit("s"))
    texts = [(1, "Met the JILWOLWHOX systems company, twice: the Jilwolwhox Systems Company."), (2, f"x {long.lower()} y runway"), (3, "The Jilwolwhox Systems; Hourborvrenx Partners B.V."), (4, None), (5, ""), (6, "abc")]
    df = spark.createDataFrame(texts, "id long, t string").withColumn("source_id", F.lit("s"))
    assert sorted(map(tuple, mentions(df.withColumn("id", F.col("id") + 10), names, "id", "t").collect())) == [(11, 1), (11, 7), (12, 2), (12, 3), (13, 4)]
    assert mentions(df.withColumn("source_id", F.lit("other")), names, "id", "t").count() == 0
    assert sorted(map(tuple, mentions(df, names, "id", "t").collect())) == [(1, 7), (2, 3), (3, 4)]  # a text's own name does not count
    assert mentions(df, names.limit(0), "id", "t").count() == 0


def test_nearest_in_blocks(spark):
    """A third of all rows in one group, equal vectors, ties, unusable rows: the same as by brute force."""
    import numpy as np

    from loregraph.operators import vectors as V

    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 8)).round(1)
    x[::3] = x[0]
    rows = [(i, [float(v) for v in x[i]], "hot" if i % 3 == 0 else f"g{i % 7}") for i in range(300)] + [(900, None, "hot"), (901, [0.0] * 8, "hot"), (902, [], "hot"), (903, [1.0, 2.0], "hot")]
    df = spark.createDataFrame(rows, "id long, embedding array<double>, g string")
    qs = df.filter("id % 20 = 0").withColumnRenamed("id", "query_id")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for group in (None, "g"):
        got = {(r.query_id, r.rank): r.id for r in V.nearest(df, qs, 4, group=group, other_than_itself=True).collect()}
        for q in range(0, 300, 20):
            s = np.round(u @ u[q], 6)
            sure = [j for j in np.lexsort((np.arange(300), -s)) if j != q and (group is None or rows[j][2] == rows[q][2])][:4]
            assert [got[(q, r)] for r in range(1, 5)] == sure
    assert V.nearest(df.limit(0), qs, 4).count() == 0


def test_result_list_layers(spark):
    from loregraph.operators import retrieval as R

    rows = [(1, 10, 100, "timeline", "people/a", "person", "The same words here today", 0.9), (1, 10, 101, "compiled_truth", "people/a", "person", "other text", 0.1), (1, 20, 200, "timeline", "people/b", "person", "the SAME words here today", 0.8),
            (1, 30, 300, "compiled_truth", "notes/c", "note", None, 0.7), (1, 40, 400, "timeline", "notes/d", "note", "quite another one", 0.6)]
    df = spark.createDataFrame(rows, "query_id long, page_id long, chunk_id long, chunk_source string, slug string, type string, chunk_text string, score double")
    kept = R.dedup_results(df, cap=1, alike=0.85)
    assert sorted(r.chunk_id for r in kept.collect()) == [100, 300, 400]  # 200 repeats 100, 101 is over the cap
    assert sorted(r.chunk_id for r in R.guarantee_compiled(kept, df).collect()) == [101, 300, 400]
    adj = spark.createDataFrame([(1, 40, 2, 2)], "query_id long, page_id long, inbound long, foreign_sources long")
    got = {r.chunk_id: round(r.score, 4) for r in R.graph_signals(df, adj, head=4).collect()}
    assert got == {100: 0.9, 200: 0.76, 300: 0.7, 400: 0.6584, 101: 0.1}
    al = spark.createDataFrame([("Big  Board", 40), ("big board", 99)], "alias string, page_id long")
    qs = spark.createDataFrame([(1, " BIG board ")], "query_id long, query string")
    hop = {(r.page_id, round(r.score, 3)) for r in R.alias_hop(df, al, qs).collect()}
    assert (40, 0.66) in hop and (99, 0.9) in hop


def test_swamp(spark):
    """A chat log full of a term does not hide the page written about it."""
    from loregraph.operators import retrieval as R

    chunks = spark.createDataFrame([(1, 1, "compiled_truth", "the ledger idea"), (2, 2, "compiled_truth", "ledger ledger idea idea ledger idea")], "id long, page_id long, chunk_source string, chunk_text string")
    pages = spark.createDataFrame([(1, "originals/ledger", "s", "concept"), (2, "openclaw/chat/2024", "s", "note")], "id long, slug string, source_id string, type string")
    qs = spark.createDataFrame([(1, "ledger idea")], "query_id long, query string")
    assert [r.page_id for r in R.pool_pages(R.keyword_scores(chunks, qs), chunks, pages, 5).orderBy("rank").collect()] == [1, 2]
    assert [r.page_id for r in R.pool_pages(R.keyword_scores(chunks, qs), chunks, pages, 5, "high").orderBy("rank").collect()] == [2, 1]


def test_websearch_syntax(spark):
    from loregraph.operators import retrieval as R

    chunks = spark.createDataFrame([(1, "Größere boards freeze budgets"), (2, "the budget board froze"), (3, "freeze the board"), (4, "zebras"), (5, None)], "id long, chunk_text string")
    qs = spark.createDataFrame([(1, "board -froze"), (2, '"freeze budget"'), (3, "zebra or größere"), (4, "budget board"), (5, "")], "query_id long, query string")
    got = sorted((r.query_id, r.chunk_id) for r in R.websearch_scores(chunks, qs).collect())
    assert got == [(1, 1), (1, 3), (2, 1), (3, 1), (3, 4), (4, 1), (4, 2)]


def test_running_sums_of_a_hot_group(spark):
    rows = [("hot" if i % 3 else f"g{i % 5}" if i % 2 else None, i, (i * 37) % 11) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, r int, x int")
    sure, total = {}, {}
    for g, r, x in sorted(rows, key=lambda t: t[1]):
        total[g] = total.get(g, 0) + x
        sure[r] = total[g]
    assert {r.r: r.running for r in S.running(df, ["g"], ["r"], F.col("x")).collect()} == sure
    budget = S.token_budget(df, "g", "r", F.col("x"), 40)
    assert {r.r for r in budget.collect()} == {r for _, r, _ in rows if sure[r] <= 40}
    assert S.running(df.limit(0), ["g"], ["r"], F.col("x")).count() == 0
