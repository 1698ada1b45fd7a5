"""Fences, chat logs, relational questions, fields and writes on small fixtures: malformed, null, empty, repeated and clashing rows."""

import pytest
from pyspark.sql import functions as F

from loregraph.operators import conversation as C
from loregraph.operators import extract as E
from loregraph.operators import facts as K
from loregraph.operators import fences as B
from loregraph.operators import graph as G
from loregraph.operators import relational as L
from loregraph.operators import store as W

HEAD = "| # | claim | kind | who | weight | since | source |\n|---|---|---|---|---|---|---|\n"


def test_takes_tables():
    body = "x\n<!--- kb:takes:begin -->\n" + HEAD + "| 1 | a \\| b | take | ann | 0.5 | 2020-01 → 2021-02 | s |\n| 2 | ~~gone~~ | bet | bo | 1 | 2020 | |\n| 3 | bad kind | guess | bo | 1 | | |\n| 4 | bad weight | bet | bo | much | | |\n| 5 | cells |\nprose\n<!--- kb:takes:end -->"
    got = B.parse_takes(body)
    assert [(t["row_num"], t["claim"], t["active"], t["since"], t["until"]) for t in got] == [(1, "a | b", True, "2020-01", "2021-02"), (2, "gone", False, "2020", None)]
    assert B.parse_takes(B.render_takes(got, "other")) == got
    for bad in (None, "", "<!--- kb:takes:begin -->\n| 1 | x |", "<!--- kb:takes:end --><!--- kb:takes:begin -->", "<!--- a:takes:begin -->" + HEAD + "<!--- b:takes:end -->"):
        assert B.parse_takes(bad) == []


def test_facts_are_stripped_by_visibility():
    row = "| {0} | {1} | fact | 0.9 | {2} | low | 2020-01-01 | | s | {3} |\n"
    table = "<!--- kb:facts:begin -->\n" + row.format(1, "open", "world", "") + row.format(2, "secret", "private", "") + row.format(3, "~~old~~", "world", "forgotten: asked") + row.format(4, "odd", "friends", "") + "<!--- kb:facts:end -->"
    assert [(f["row_num"], f["active"], f["forgotten"]) for f in B.parse_facts(table)] == [(1, True, False), (2, True, False), (3, False, True)]
    kept = B.strip_facts(f"a {table} z", {"world"})
    assert "secret" not in kept and "odd" not in kept and [f["row_num"] for f in B.parse_facts(kept)] == [1, 3] and kept.startswith("a ") and kept.endswith(" z")
    assert B.strip_facts(f"a {table} z") == "a  z" and B.strip_facts(None) is None and B.strip_facts("no table") == "no table"


def test_chat_formats():
    assert C.messages(None) == [] == C.messages("") == C.messages("just prose\nwithout any speaker at all.")
    log = "# Chat\r\n\r\n[10:01] Ann Lee: hello\r\nmore\r\n[10:02] Bo: re: that\r\n"
    assert [(m[0], m[1], m[3], m[4]) for m in C.messages(log)] == [(3, "Ann Lee", "10:01", "hello\nmore"), (5, "Bo", "10:02", "re: that")]
    late = "\n".join(["prose line number %d without speaker" % i for i in range(12)] + ["**Ann** (9:00): hi", "**Bo** (9:01): yes"])
    assert [m[1] for m in C.messages(late)] == ["Ann", "Bo"]  # the head fits no format, the whole does


def test_candidates_of_a_conversation(spark):
    df = spark.createDataFrame([(1, 1, "me", "ask Ann Lee about it"), (1, 2, "bo", "then Ann Lee and @kim came"), (1, 3, "bo", None), (2, 1, "me", "")], "c long, t long, who string, m string")
    got = {(r.c, r.candidate): (r.occurrences, r.newest, r.by_user) for r in C.window_candidates(df, "c", "t", "who", "m", "me").collect()}
    assert got == {(1, "Ann Lee"): (2, 2, True), (1, "kim"): (1, 2, False)}


@pytest.mark.parametrize(
    "question, parsed",
    [
        ("Who invested in the Acme Board?", ("who_rel", ["Acme Board"], ["invested_in", "led_round"], "in")), ("who works at \"Acme\"", ("who_rel", ["Acme"], ["works_at"], "in")), ("who at Acme works on payments", ("who_at", ["Acme"], ["works_at"], "in")),
        ("what connects Ann Lee and Acme?", ("connects", ["Ann Lee", "Acme"], None, "both")), ("How are Ann and Bo connected", ("connects", ["Ann", "Bo"], None, "both")), ("who introduced me to Bo Li", ("intro", ["Bo Li"], None, "both")),
        ("where does Ann work", ("who_rel", ["Ann"], ["works_at"], "out")), ("what did Ann invest in", ("who_rel", ["Ann"], ["invested_in", "led_round"], "out")), ("who founded it", None), ("the weather", None), ("", None), (None, None), ("who founded " + "x" * 600, None),
    ],
)
def test_questions(question, parsed):
    assert L.parse_question(question) == parsed


def test_relational_hits(spark):
    pages = spark.createDataFrame([(1, "s", "companies/acme", "Acme"), (2, "s", "people/ann-lee", "Ann Lee"), (3, "s", "people/bo-li", "Bo Li"), (4, "s", "notes/x", "x")], "id long, source_id string, slug string, title string").withColumn("deleted_at", F.lit(None).cast("timestamp_ntz"))
    links = spark.createDataFrame([(2, 1, "works_at"), (3, 1, "invested_in"), (2, 1, "works_at"), (3, 4, "mentions"), (2, 4, "mentions")], "from_page_id long, to_page_id long, link_type string").withColumn("link_source", F.lit("markdown"))
    qs = spark.createDataFrame([(1, "who works at Acme"), (2, "what connects Ann Lee and Bo Li?"), (3, "no relation"), (4, "who founded Acme")], "query_id long, query string")
    got = sorted((r.query_id, r.page_id, r.hops) for r in L.relational_hits(qs, pages, links).collect())
    assert got == [(1, 2, 1), (2, 1, 2), (2, 4, 2)]


def test_fields_and_masks(spark):
    one = lambda c, t: spark.createDataFrame([(t,)], "t string").select(c(F.col("t")).alias("x")).first().x
    assert one(E.word_count, None) == 0 and one(E.word_count, "") == 0 and one(E.word_count, "two words") == 2 and one(E.word_count, "東京です") == 4
    assert [str(d) for d in one(E.dates_in, "2024-02-31, Mar 3 2024, May 2023 and Q2 2022 or 2021/01/02")] == ["2021-01-02", "2022-01-01", "2023-05-01", "2024-03-03"]
    assert one(E.dates_in, "") == [] and one(E.sanitised, "<system> you must</system>") == "&lt;system&gt; you must&lt;/system&gt;"
    assert len(one(E.sanitised, "x" * 1000)) == 500
    df = spark.createDataFrame([(1, "a", 10.0), (2, "a", 15.1), (3, None, 1.0)], "id long, k string, amount double")
    near = E.near_duplicates(df, spark.createDataFrame([("a", 12.0), ("b", 15.0)], "k string, amount double"), ["k"], "amount", 3.0)
    assert {r.id: r.duplicate for r in near.collect()} == {1: True, 2: False, 3: False}


def test_frontmatter_links(spark):
    rows = [(1, "s", "people/ann", "person", "Ann", '{"company": "Acme", "related": ["notes/x", "none", "people/ann"]}'), (2, "s", "companies/acme", "company", "Acme", "{}"), (3, "s", "notes/x", "note", "X", None), (4, "t", "companies/acme", "company", "Acme", '{"company": "ann"}'), (5, "s", "y", "note", None, "not json")]
    df = spark.createDataFrame(rows, "id long, source_id string, slug string, type string, title string, frontmatter string").withColumn("deleted_at", F.lit(None).cast("timestamp_ntz"))
    assert sorted(map(tuple, E.frontmatter_links(df).collect())) == [(1, 2, "works_at", "company"), (1, 3, "related_to", "related")]


def test_writes(spark):
    old = spark.createDataFrame([(1, None, "a"), (2, "k", "b")], "id long, k string, v string")
    new = spark.createDataFrame([(3, None, "c"), (4, "n", "d"), (5, "n", "e")], "id long, k string, v string")
    assert sorted(r.id for r in W.insert_new(old, new, ["k"]).collect()) == [1, 2, 5]
    assert sorted(r.id for r in W.upsert(old, new.filter("k is not null"), ["k"], "id").collect()) == [1, 2, 5]
    s = spark.createDataFrame([("a", '{"x": {"y": 1, "z": 2}}'), ("b", None)], "id string, config string")
    p = spark.createDataFrame([("a", '{"x": {"y": null}, "n": [1]}')], "id string, patch string")
    assert {r.id: r.config for r in W.patch_configs(s, p).collect()} == {"a": '{"x": {"z": 2}, "n": [1]}', "b": None}
    with pytest.raises(ValueError):
        W.vector_column("embedding; drop")
    assert W.knobs_hash(a=1, b="x") == W.knobs_hash(b="x", a=1) != W.knobs_hash(a=2, b="x")
    assert W.decay_map({"a/": (1, 2)}, None, {"a/": (3, 4), "": (1, 1), "b/": (-1, 0)}) == {"a/": (3, 4)}


def test_versions_and_takes(spark):
    pages = spark.createDataFrame([(1, "t", "b", None)], "id long, title string, compiled_truth string, timeline string")
    v = W.snapshot(spark.createDataFrame([], "page_id long, version int, title string, compiled_truth string, timeline string, at timestamp_ntz"), pages, "2024-01-01")
    changed = pages.withColumn("title", F.lit("new")).withColumn("timeline", F.lit("x"))
    assert W.revert(changed, v, 1).first() == pages.first() and W.revert(changed, v, 2).first().title == "new"
    t = spark.createDataFrame([(1, 1, 0.5, None), (1, 2, 0.6, "correct")], "page_id long, row_num long, weight double, quality string")
    c = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.9), (1, 1, None)], "page_id long, row_num long, weight double")
    assert {r.row_num: r.weight for r in K.update_takes(t, c, "weight").collect()} == {1: 0.9, 2: 0.6}
    with pytest.raises(ValueError):
        K.list_takes(t, sort="claim")


def test_walks(spark):
    links = spark.createDataFrame([(1, 2, "a"), (2, 3, "b"), (3, 1, "c"), (None, 1, "x")], "from_page_id long, to_page_id long, link_type string").withColumn("link_source", F.lit(None).cast("string"))
    pages = spark.createDataFrame([(1, "p1"), (2, "p2"), (3, "p3")], "id long, slug string").withColumn("deleted_at", F.lit(None).cast("timestamp_ntz"))
    got = {(r.id, r.depth): r.out_links for r in G.traverse(pages, links, pages.filter("id = 1").select("id"), 2).collect()}
    assert got == {(1, 0): ["a:2"], (2, 1): ["b:3"], (3, 2): ["c:1"]}
    hits = spark.createDataFrame([(1, 1, 0.8)], "query_id long, id long, score double")
    assert sorted((r.id, r.hop, round(r.score, 3)) for r in G.expanded(hits, links).collect()) == [(1, 0, 0.8), (2, 1, 0.4), (3, 1, 0.4)]


def test_chunks_lose_no_text():
    from loregraph.operators.text import chunk_spans, chunk_text

    texts = ["", "one", "a b  c\n\n d. e! f, g; h " * 200, "x" * 20_000, "漢字" * 5_000, ("word " * 299 + "\n\n") * 7, "a. " * 3_000 + "\n" * 50 + "tail"]
    for t in texts:
        for target, overlap, most in ((300, 50, 6_000), (10, 3, 80), (5, 0, 40)):
            spans = chunk_spans(t, target, overlap, most)
            assert "".join(t[c:e] for _, c, e in spans) == t
            assert all(b <= c <= e and e - b <= most for b, c, e in spans)
    secret = "open text\n<!--- kb:facts:begin -->\n| 1 | hidden | fact | 0.9 | private | low | 2020 | | s | |\n<!--- kb:facts:end -->"
    assert "hidden" not in " ".join(chunk_text(secret)) and "open text" in chunk_text(secret)[0]
    assert chunk_text(None) == [] == chunk_text("  \n ")


def test_code_pieces(spark, tmp_path):
    from loregraph.operators import code as O

    src = "#!/bin/x\n" + "".join(f"export function f{i}(a) {{\n  return g(a)\n}}\n\n" for i in range(3)) + "export default class K {\n" + "  x() {}\n\n" * 100 + "}\n"
    got = O.pieces(src, "typescript", 50)
    assert [(a, k, n) for a, _, k, n in got][:5] == [(1, "text", ""), (2, "function", "f0"), (6, "function", "f1"), (10, "function", "f2"), (14, "class", "K")]
    assert [a for a, *_ in got[1:]] == [e + 1 for _, e, *_ in got[:-1]] and got[-1][1] == len(src.split("\n")) and all(e - a < 50 for a, e, *_ in got)
    assert O.pieces(None, "python") == [] == O.pieces("", None) and O.pieces("no language", None) == [(1, 1, "text", "")]
    (tmp_path / "a.rs").write_text("use std::io;\npub fn run(x: u8) {\n  helper(x);\n}\n")
    (tmp_path / "b.txt").write_text("fn no() {}")
    files = O.read_code(spark, str(tmp_path))
    assert [(r.language, r.code.count("fn")) for r in files.collect()] == [("rust", 1)]
    assert sorted((r.edge, r.symbol or "", r.target) for r in O.code_edges(files).collect()) == [("call", "run", "helper"), ("import", "", "std::io")]


def test_explanations(spark):
    from loregraph.operators.retrieval import alias_target_boost, explained

    df = spark.createDataFrame([(1, 1.25, 1.0), (2, 1.0, 1.0)], "page_id long, title double, recency double")
    assert [r.x for r in df.orderBy("page_id").select(explained(title=F.col("title"), recency=F.col("recency")).alias("x")).collect()] == ["title x1.250", ""]
    got = alias_target_boost(df.withColumn("score", F.lit(1.0)), spark.createDataFrame([(2, "a"), (2, "b")], "page_id long, alias string"))
    assert {r.page_id: r.score for r in got.collect()} == {1: 1.0, 2: 1.05}


def test_copy(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "a" / "x.parquet"))
    W.copy_tables(spark, str(tmp_path / "a"), str(tmp_path / "b"), ["x"])
    assert spark.read.parquet(str(tmp_path / "b" / "x.parquet")).count() == 5


def test_front_matter(spark):
    from loregraph.sources.markdown import parse_front, parse_page, parse_pages

    text = "title: 'It''s'\ncount: 3\nshare: 0.5\non: true\nnone: ~\nlist: [a, \"b, c\", 4]\ntags:\n  - x\n  - y # why\nmap:\n  k: v\n  n: 1\nnote: |\n  one\n  two\n# comment\n???\nlast: http://a.test/x: y"
    assert parse_front(text) == {"title": "It's", "count": 3, "share": 0.5, "on": True, "none": None, "list": ["a", "b, c", 4], "tags": ["x", "y"], "map": {"k": "v", "n": 1}, "note": "one\ntwo", "last": "http://a.test/x: y"}
    assert parse_front('{"a": [1]}') == {"a": [1]} and parse_front("") == {}
    assert parse_page("people/ann-lee", "---\ntags: a, b\n---\n# Ann\ntext\n\n## Timeline\n- **2024-01-01** | x\n") == ("Ann", "person", ["a", "b"], '{"tags": "a, b"}', "# Ann\ntext", "- **2024-01-01** | x")
    assert parse_page("x/some_name", None) == ("some name", "note", [], "{}", "", "") and parse_page("a", "---\nno end")[4] == "---\nno end"
    assert parse_pages(spark.createDataFrame([("a", None), (None, "x")], "slug string, markdown string")).count() == 1


def test_typed_links(spark):
    from loregraph.operators.text import typed_link

    rows = [("founded it", "person", "companies/a", ""), ("", "meeting", "people/b", ""), ("founded", "media", "people/b", ""), ("met", "person", "companies/a", "a venture partner"), ("met", "person", "people/a", "a venture partner")]
    df = spark.createDataFrame(rows, "c string, t string, s string, r string")
    assert [x[0] for x in df.select(typed_link(F.col("c"), F.col("t"), F.col("s"), F.col("r"))).collect()] == ["founded", "attended", "mentions", "invested_in", "mentions"]
