"""The registered queries over the driver's tables, whole tables each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loregraph.functions import expressions as X
from loregraph.operators import graph as G
from loregraph.operators import pages as P
from loregraph.operators import retrieval as R
from loregraph.operators import stats as S
from loregraph.operators import text as T
from loregraph.session import table

AS_OF = "2025-06-01 00:00:00"
QUERIES: dict = {}


def q(f):
    QUERIES[f.__name__] = f
    return f


def claims(spark: SparkSession, d: str) -> DataFrame:
    """Orders as claims: the weight from the price, the quality from the status."""
    o = table(spark, d, "orders")
    quality = F.when(F.col("o_orderstatus") == "F", "correct").when(F.col("o_orderstatus") == "O", "incorrect").otherwise("partial")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("domain"), ((F.col("o_custkey") % 7)).alias("holder"), (F.pmod("o_orderkey", F.lit(101)) / 100).alias("weight"), quality.alias("quality"))


def some_queries(spark: SparkSession, d: str) -> DataFrame:
    """Search queries and their vectors: titles of the pages whose id is divisible by 20, with the vector of the page's first usable chunk."""
    p = table(spark, d, "pages").filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("title").alias("query"))
    c = table(spark, d, "content_chunks").filter((F.col("model") == "embed-v2") & F.col("embedding").isNotNull() & F.exists("embedding", lambda x: x != 0))
    v = c.groupBy(F.col("page_id").alias("query_id")).agg(F.min_by("embedding", "id").alias("embedding"))
    return p.join(v, "query_id")


# -- pages and chunks ---------------------------------------------------------------------------------------------------------------------------------------------


@q
def list_pages(spark, d):
    return P.list_pages(table(spark, d, "pages")).select("id", "slug", "type")


@q
def list_pages_filtered(spark, d):
    return P.list_pages(table(spark, d, "pages"), type="meeting", slug_prefix="meetings/", updated_after="2022-01-01", sort="slug", limit=50, offset=5).select("id", "slug")


@q
def list_pages_by_tag(spark, d):
    return P.list_pages(table(spark, d, "pages"), tag="wedding", sort="created_desc", limit=1000).select("id", "slug")


@q
def visible_pages(spark, d):
    return P.visible(table(spark, d, "pages"), table(spark, d, "sources")).select("id", "slug")


@q
def page_tags(spark, d):
    return P.page_tags(table(spark, d, "pages"))


@q
def upsert_pages(spark, d):
    p = table(spark, d, "pages")
    new = p.filter("type = 'daily'").withColumn("title", F.upper("title")).withColumn("import_filename", F.lit(None).cast("string"))
    return P.upsert_pages(p, new).select("id", "title", "import_filename")


@q
def duplicate_pages(spark, d):
    return P.duplicate_pages(table(spark, d, "pages"))


@q
def purge_deleted_pages(spark, d):
    return P.purge_deleted(table(spark, d, "pages"), "2024-06-01 00:00:00").select("id")


@q
def newest_chunks(spark, d):
    return P.newest_chunks(table(spark, d, "content_chunks")).select("id", "page_id", "chunk_index")


@q
def stale_chunks(spark, d):
    return P.stale_chunks(table(spark, d, "content_chunks"), "embed-v2").agg(F.count("*").alias("n"), F.sum(F.length("chunk_text")).alias("chars"))


@q
def stale_chunk_page(spark, d):
    return P.keyset(P.stale_chunks(table(spark, d, "content_chunks"), "embed-v2"), "page_id", "chunk_index", (10, 0), 200).select("id", "page_id", "chunk_index")


@q
def timeline_dedup(spark, d):
    return P.dedup_timeline(table(spark, d, "timeline_entries")).select("id", "page_id", "summary")


@q
def timeline_range(spark, d):
    return P.timeline_range(table(spark, d, "timeline_entries"), 1, "2021-01-01", "2024-12-31").select("id", "page_id", "summary")


@q
def effective_dates(spark, d):
    return P.effective_dates(table(spark, d, "pages")).select("source_id", "slug", F.date_format("effective", "yyyy-MM-dd").alias("day"))


@q
def content_sanity(spark, d):
    return P.content_sanity(table(spark, d, "pages"))


@q
def ingest_pages(spark, d):
    """The page ids of each logged run, with runs delivered twice counted once."""
    log = table(spark, d, "ingest_log").groupBy("source_id", "source_type", "source_ref", "pages_updated").agg(F.min("id").alias("id"))
    return log.select("id", "source_id", F.explode(F.from_json("pages_updated", "array<bigint>")).alias("page_id"))


@q
def ingest_rollup(spark, d):
    log = table(spark, d, "ingest_log")
    return log.groupBy("source_type", F.date_format("created_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("runs"), F.sum(F.size(F.from_json("pages_updated", "array<bigint>"))).alias("pages"))


@q
def corpus_sample(spark, d):
    return S.seeded_sample(table(spark, d, "pages").filter("deleted_at is null"), "id", 50, 11).select("id")


# -- statistics ---------------------------------------------------------------------------------------------------------------------------------------------------


@q
def brain_stats(spark, d):
    return S.brain_stats(*(table(spark, d, t) for t in ("pages", "content_chunks", "links", "timeline_entries")))


@q
def brain_health(spark, d):
    return S.health(*(table(spark, d, t) for t in ("pages", "content_chunks", "links", "timeline_entries")))


@q
def orphan_pages(spark, d):
    return S.orphans(table(spark, d, "pages"), table(spark, d, "links"))


@q
def dead_links(spark, d):
    return S.dead_links(table(spark, d, "pages"), table(spark, d, "links"))


@q
def most_connected(spark, d):
    return S.most_connected(table(spark, d, "pages"), table(spark, d, "links")).select("id", "degree")


@q
def backlink_counts(spark, d):
    return S.backlink_counts(table(spark, d, "pages"), table(spark, d, "links")).select("id", "backlinks")


@q
def link_sources(spark, d):
    return S.histogram(table(spark, d, "links"), "link_source", "link_type")


@q
def pages_by_type(spark, d):
    return S.histogram(table(spark, d, "pages"), "type", n="pages")


@q
def source_health(spark, d):
    return S.source_health(table(spark, d, "sources"), table(spark, d, "pages"), table(spark, d, "content_chunks"))


@q
def slug_prefixes(spark, d):
    return S.prefixes(table(spark, d, "pages"))


@q
def scorecard(spark, d):
    return S.scorecard(claims(spark, d), "holder")


@q
def domain_scorecards(spark, d):
    return S.scorecard(claims(spark, d), "domain")


@q
def conviction_brier(spark, d):
    return S.conviction_brier(claims(spark, d), "domain")


@q
def calibration_curve(spark, d):
    return S.calibration_curve(claims(spark, d))


@q
def anomalies(spark, d):
    e = table(spark, d, "events").withColumn("cohort", F.concat_ws("/", "event_type", (F.col("user_id") % 10).cast("string")))
    return S.anomalies(e, "cohort", "ts", "2024-01-29", 20, 1.0).select("cohort", "count", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@q
def emotional_weight(spark, d):
    p = table(spark, d, "pages")
    return S.emotional_weight(P.page_tags(p), p, table(spark, d, "timeline_entries"), ["wedding", "hiring"])


@q
def recent_salience(spark, d):
    return S.recent_salience(table(spark, d, "pages"), table(spark, d, "timeline_entries"), AS_OF, 700, 50).select("id", "score")


@q
def enrich_candidates(spark, d):
    return S.enrich_candidates(table(spark, d, "pages"), table(spark, d, "links")).select("id", "inbound")


@q
def adjacency_boosts(spark, d):
    p = table(spark, d, "pages")
    return S.adjacency(p.select("id"), table(spark, d, "links"), p)


@q
def prefix_sample(spark, d):
    return S.prefix_sample(table(spark, d, "pages"), table(spark, d, "links"))


@q
def fact_regressions(spark, d):
    return S.trajectory_regressions(table(spark, d, "events"), "user_id", "event_type", "value", "ts", "event_id")


@q
def fact_validity(spark, d):
    return S.validity_chain(table(spark, d, "events"), "user_id", "event_type", "ts", "event_id")


@q
def drift_score(spark, d):
    return S.drift_score(table(spark, d, "embeddings"), "label", "vec_id", "embedding")


@q
def wilson_intervals(spark, d):
    c = claims(spark, d).groupBy("domain").agg(F.count_if(F.col("quality") == "correct").alias("hits"), F.count("*").alias("n"))
    lo, hi = S.wilson(F.col("hits"), F.col("n"))
    return c.select("domain", F.round(lo, 6).alias("low"), F.round(hi, 6).alias("high"))


@q
def user_sessions(spark, d):
    return S.sessions(table(spark, d, "events"), "user_id", "ts", "event_id", 240)


@q
def token_budget(spark, d):
    w = Window.partitionBy("page_id").orderBy("chunk_index", "id")
    c = table(spark, d, "content_chunks").select("page_id", "id", F.length("chunk_text").alias("n"), F.row_number().over(w).alias("rank"))
    return S.token_budget(c, "page_id", "rank", F.ceil(F.col("n") / 4), 1000).select("page_id", "id", "rank", "running")


@q
def autocut(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), F.asc("o_orderkey"))
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.row_number().over(w).alias("rank"))
    return S.autocut(o, "o_custkey", "rank", "o_totalprice").select("o_custkey", "o_orderkey", "rank")


@q
def ir_metrics(spark, d):
    """Each customer's orders by price against their urgent orders."""
    o = table(spark, d, "orders")
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), F.asc("o_orderkey"))
    ranked = o.select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("doc"), F.row_number().over(w).alias("rank"))
    return S.ir_metrics(ranked, o.filter("o_orderpriority like '1%'").select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("doc")), 5)


@q
def score_distribution(spark, d):
    return S.nearest_rank(table(spark, d, "events"), "event_type", "value", {"least": 0.0, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "most": 1.0})


@q
def duration_percentiles(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.percentile("value", F.lit(0.5)), 6).alias("p50"), F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95"))


@q
def daily_rollup(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.min("value").alias("least"), F.max("value").alias("most"))


@q
def replay_metrics(spark, d):
    """Users' event types of the first and the second half of the month as two result sets: mean Jaccard and stability of the most frequent."""
    e = table(spark, d, "events").select("user_id", "event_type", (F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")).alias("first"))
    n = e.groupBy("user_id", "first", "event_type").agg(F.count("*").alias("n"))
    top = n.withColumn("r", F.row_number().over(Window.partitionBy("user_id", "first").orderBy(F.desc("n"), F.asc("event_type")))).filter("r <= 3")
    return S.set_stability(top.filter("first"), top.filter("not first"), "user_id", "event_type", "r")


@q
def expert_finder(spark, d):
    """Customers as experts of urgent orders: number, age of the last, salience by account balance."""
    o = table(spark, d, "orders").filter("o_orderpriority like '1%'").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("raw"), F.max("o_orderdate").alias("last"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.greatest("c_acctbal", F.lit(0.0)).alias("bal"))
    s = R.expert_score(F.col("raw"), F.datediff(F.lit("2001-12-31").cast("date"), F.col("last").cast("date")), F.col("bal") / 1000)
    return o.join(c, "id").select("id", F.round(s, 6).alias("score")).orderBy(F.desc("score"), F.asc("id")).limit(20)


@q
def fact_confidence(spark, d):
    e = table(spark, d, "events")
    age = X.age_days(F.col("ts"), "2024-02-01")
    return e.select("event_id", F.round(R.effective_confidence(F.least(F.abs("value") / 100, F.lit(1.0)), age, F.col("event_type"), {"error": 7.0, "click": 90.0}, 365.0), 6).alias("confidence"))


# -- retrieval ----------------------------------------------------------------------------------------------------------------------------------------------------


def kw_queries(spark):
    return spark.createDataFrame([(1, "retrieval quality"), (2, "citation check"), (3, "board freeze"), (4, "zebra")], "query_id int, query string")


@q
def keyword_chunks(spark, d):
    hits = R.keyword_scores(table(spark, d, "content_chunks"), kw_queries(spark))
    return R.top(hits.withColumn("score", F.round("score", 6)), "query_id", "score", 20, "chunk_id")


@q
def keyword_pages(spark, d):
    c = table(spark, d, "content_chunks")
    return R.pool_pages(R.keyword_scores(c, kw_queries(spark), keep=("page_id",)), None, table(spark, d, "pages"), 20).select("query_id", "page_id", "chunk_id", "score", "rank")


@q
def substring_search(spark, d):
    qs = spark.createDataFrame([(1, "Größere"), (2, "réunion")], "query_id int, query string")
    return R.substring_scores(table(spark, d, "pages"), qs, "compiled_truth")


@q
def vector_search(spark, d):
    e = table(spark, d, "embeddings").withColumnRenamed("vec_id", "id")
    qs = e.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
    return R.vector_hits(e, qs, 10)


@q
def rank_fusion(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("doc"), "o_totalprice", "o_orderdate")
    a = R.top(o, "query_id", "o_totalprice", 10, "doc")
    b = R.top(o, "query_id", "o_orderdate", 10, "doc")
    return R.rrf([(a, 1.0), (b, 0.5)], "doc").select("query_id", "doc", F.round("score", 6).alias("score"))


@q
def boosted_scores(spark, d):
    n = S.backlink_counts(table(spark, d, "pages"), table(spark, d, "links")).select("id", "backlinks")
    p = table(spark, d, "pages").filter("deleted_at is null").join(n, "id")
    days = X.age_days(F.coalesce("effective_date", "updated_at", "created_at"), AS_OF)
    s = R.recency_boost(R.backlink_boost(X.source_factor(F.col("slug")), F.col("backlinks")), F.col("slug"), days)
    return p.select("id", F.round(s, 6).alias("score"))


@q
def title_matches(spark, d):
    qs = spark.createDataFrame([(1, "retrieval quality"), (2, "weekly review log"), (3, "runway")], "query_id int, query string")
    return R.title_hits(table(spark, d, "pages"), qs)


@q
def result_dedup(spark, d):
    r = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("page_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_id"), F.col("l_returnflag").alias("type"), F.col("l_extendedprice").alias("score"))
    return R.dedup_results(r).select("query_id", "page_id", "chunk_id")


@q
def similar_titles(spark, d):
    return R.similar_titles(table(spark, d, "pages"), 0.7)


@q
def hybrid_fused(spark, d):
    """The arms of the hybrid search, fused and boosted, before deduplication."""
    return R.fused_scores(table(spark, d, "pages"), table(spark, d, "content_chunks"), table(spark, d, "links"), some_queries(spark, d), AS_OF).select("query_id", "page_id", "chunk_id", "score")


@q
def hybrid_search(spark, d):
    return R.hybrid_search(table(spark, d, "pages"), table(spark, d, "content_chunks"), table(spark, d, "links"), some_queries(spark, d), AS_OF)


@q
def hybrid_search_keyword(spark, d):
    """The flagship: keyword search over chunks with source factors, pooled to pages and cut by a token budget."""
    c = table(spark, d, "content_chunks")
    c = c.withColumn("cost", F.ceil(F.length("chunk_text") / 4))
    pooled = R.pool_pages(R.keyword_scores(c, kw_queries(spark), keep=("page_id", "cost")), None, P.visible(table(spark, d, "pages"), table(spark, d, "sources")), 50)
    return S.token_budget(pooled, "query_id", "rank", F.col("cost"), 4000).select("query_id", "page_id", "chunk_id", "score", "rank", "running")


# -- graph --------------------------------------------------------------------------------------------------------------------------------------------------------


def graph_seeds(spark, d):
    """The searches' seeds: every page whose id is divisible by 20, against all links."""
    return table(spark, d, "pages").filter("id % 20 = 0").select("id")


@q
def fanout(spark, d):
    return G.fanout(table(spark, d, "links"), graph_seeds(spark, d), 2)


@q
def fanout_inbound(spark, d):
    return G.fanout(table(spark, d, "links"), graph_seeds(spark, d), 1, "in")


@q
def walk_edges(spark, d):
    return G.walk_edges(table(spark, d, "links"), graph_seeds(spark, d), 2)


@q
def connects(spark, d):
    l = table(spark, d, "links")
    s = lambda n: spark.createDataFrame([(n,)], "id long")
    return G.connects(G.fanout(l, s(3), 2, "both"), G.fanout(l, s(7), 2, "both"))


@q
def connected_components(spark, d):
    c = G.connected_components(table(spark, d, "links"), "from_page_id", "to_page_id")
    return c.select(F.col("node").alias("page_id"), "component")


# -- text ---------------------------------------------------------------------------------------------------------------------------------------------------------


@q
def slugs_of_titles(spark, d):
    return table(spark, d, "pages").select("id", X.slugify(F.col("title")).alias("slug"))


@q
def headings(spark, d):
    return T.sections(table(spark, d, "pages"))


@q
def timeline_lines(spark, d):
    return T.timeline_lines(table(spark, d, "pages")).select("id", F.date_format("date", "yyyy-MM-dd").alias("day"), "summary")


@q
def transcript_lines(spark, d):
    return T.speakers(table(spark, d, "pages"))


@q
def title_mentions(spark, d):
    p = table(spark, d, "pages")
    names = p.select(F.col("title").alias("name"), F.col("id").alias("entity"), "source_id")
    return T.mentions(p, names, "id", "compiled_truth")


@q
def context_link_types(spark, d):
    return table(spark, d, "links").groupBy(T.link_type(F.col("context")).alias("inferred")).agg(F.count("*").alias("n"))


@q
def recursive_chunks(spark, d):
    return T.recursive_chunks(table(spark, d, "pages"), "id", "compiled_truth")


@q
def markdown_round_trip(spark, d):
    p = table(spark, d, "pages")
    back = T.from_markdown(T.to_markdown(p)).select("id", F.col("frontmatter").alias("f"), F.col("compiled_truth").alias("b"), F.col("timeline").alias("t"))
    same = (F.col("f") == F.coalesce("frontmatter", F.lit("{}"))) & (F.col("b") == F.coalesce("compiled_truth", F.lit(""))) & (F.col("t") == F.coalesce("timeline", F.lit("")))
    return p.join(back, "id").select("id", same.alias("same"))


@q
def money_totals(spark, d):
    return table(spark, d, "documents").filter(F.col("text").isNotNull()).select("doc_id", T.money_total(F.col("text")).cast("double").alias("total")).filter("total > 0")


# -- facts, claims, roll-ups ---------------------------------------------------------------------------------------------------------------------------------------

from loregraph.operators import facts as K  # noqa: E402


@q
def facts_by_entity(spark, d):
    return K.by_entity(table(spark, d, "events"), "user_id", "ts", "event_id", 3).select("user_id", "event_id", "rank")


@q
def facts_health(spark, d):
    return K.health(table(spark, d, "events"), "ts", "2024-01-30 00:00:00", "user_id")


@q
def superseded_facts(spark, d):
    """Events as facts: errors are superseded by new facts with the id + 1,000,000."""
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), "event_type", "user_id", "value", F.lit(None).cast("timestamp_ntz").alias("expired_at"), F.lit(None).cast("long").alias("superseded_by"))
    new = e.filter("event_type = 'error'").select((F.col("id") + 1_000_000).alias("id"), "event_type", "user_id", (F.col("value") * 2).alias("value"), "expired_at", "superseded_by", F.col("id").alias("supersedes"))
    return K.insert_superseding(e, new, "2024-02-01 00:00:00").select("id", "user_id", "value", F.col("expired_at").isNotNull().alias("expired"), "superseded_by")


@q
def fact_duplicates(spark, d):
    e = table(spark, d, "embeddings")
    return K.dedup_candidates(e, e.filter("vec_id % 20 = 0"), "label", "vec_id", "embedding", 3, 0.5).select("new_id", "id", "similarity", "rank", "duplicate")


@q
def consolidated_facts(spark, d):
    return K.consolidate(table(spark, d, "embeddings"), "label", "vec_id", "embedding", 3, 0.4)


@q
def upserted_takes(spark, d):
    c = claims(spark, d).select((F.col("id") % 500).alias("page_id"), F.floor(F.col("id") / 500).alias("row_num"), "weight", F.when(F.col("quality") != "partial", F.col("quality")).alias("quality"))
    new = c.withColumn("weight", F.col("weight") * 3 - 1).withColumn("quality", F.lit(None).cast("string"))
    return K.upsert_takes(c, new).select("page_id", "row_num", F.round("weight", 6).alias("weight"), "quality")


@q
def telemetry_stats(spark, d):
    return S.telemetry(table(spark, d, "events"), "event_type", "ts", "value")


@q
def tier_pairs(spark, d):
    return S.tier_pairs(table(spark, d, "links"), table(spark, d, "pages"))


@q
def job_stats(spark, d):
    return S.queue_stats(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority", "o_totalprice", "o_orderdate").withColumnRenamed("mean", "mean_price")


@q
def quarter_windows(spark, d):
    return S.quarter_totals(table(spark, d, "orders"), "o_orderdate", "o_totalprice")


@q
def result_pairs(spark, d):
    """Pairs of each customer's five dearest orders of different status, with their combined score."""
    r = R.top(table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("doc"), "o_orderstatus", "o_totalprice"), "query_id", "o_totalprice", 5, "doc")
    return S.result_pairs(r, "query_id", "rank", "doc", "o_totalprice", "o_orderstatus")


@q
def retrieval_gate(spark, d):
    """Means of the retrieval metrics over all queries, and whether they pass the gate of 0.70 recall, 0.60 first relevant and 0.50 relevant at the top."""
    m = ir_metrics(spark, d)
    return m.agg(F.count("*").alias("queries"), F.round(F.avg("r_at_k"), 6).alias("recall"), F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.avg("ndcg"), 6).alias("ndcg"), F.round(F.avg(F.col("top1").cast("double")), 6).alias("top1")).withColumn("passed", (F.col("recall") >= 0.7) & (F.col("mrr") >= 0.6) & (F.col("top1") >= 0.5))


@q
def edge_union(spark, d):
    """Outgoing edges of resolved and unresolved links in one frame, with the kind of each."""
    l = table(spark, d, "links")
    a = l.filter("link_source is not null").select("from_page_id", "to_page_id", "link_type", F.lit("resolved").alias("state"))
    b = l.filter("link_source is null").select("from_page_id", "to_page_id", F.lit("unresolved").alias("state"))
    return a.unionByName(b, allowMissingColumns=True).groupBy("from_page_id", "state").agg(F.count("*").alias("n"), F.countDistinct("to_page_id").alias("targets"))


@q
def page_link_coverage(spark, d):
    return S.link_coverage(table(spark, d, "pages"), table(spark, d, "links"))


@q
def chunk_page_context(spark, d):
    """Each page's chunks with the page's slug and whether they are older than the newest dated entry of the page."""
    t = table(spark, d, "timeline_entries").groupBy("page_id").agg(F.max("date").alias("newest"))
    p = table(spark, d, "pages").select(F.col("id").alias("page_id"), "slug", "updated_at").join(t, "page_id", "left")
    c = table(spark, d, "content_chunks").select("id", "page_id")
    return c.join(p, "page_id").select("id", "slug", F.coalesce(F.col("newest") > F.col("updated_at").cast("date"), F.lit(False)).alias("stale"))


@q
def frontmatter_stats(spark, d):
    p = table(spark, d, "pages")
    has = lambda k: F.get_json_object("frontmatter", f"$.{k}").isNotNull()
    return p.groupBy("source_id").agg(F.count("*").alias("pages"), F.count_if(F.col("frontmatter") == "{}").alias("bare"), F.count_if(has("title")).alias("titled"), F.count_if(has("tags")).alias("tagged"))


# -- names, intents, samples ---------------------------------------------------------------------------------------------------------------------------------------

from loregraph.operators import resolve as V  # noqa: E402


@q
def resolved_names(spark, d):
    names = spark.createDataFrame([("Retrieval quality notes",), ("Weekly review",), ("Obsidian Weather Board",), ("release rhythm draft",), ("Runway",)], "name string")
    return V.resolve_names(names, table(spark, d, "pages"), table(spark, d, "links"))


@q
def query_intents(spark, d):
    return table(spark, d, "eval_items").select("item_id", V.intent(F.col("question")).alias("intent"))


@q
def far_set(spark, d):
    e = table(spark, d, "embeddings")
    return V.far_set(e, e.filter("label < 3 and vec_id % 20 = 0"), "vec_id", "label", "embedding", 25)


@q
def adaptive_returns(spark, d):
    o = R.top(table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("doc"), "o_totalprice", F.when(F.col("o_custkey") % 2 == 0, "entity").otherwise("general").alias("intent")), "query_id", "o_totalprice", 10, "doc")
    return V.adaptive_return(o, "query_id", "rank", "intent").select("query_id", "doc", "rank")


@q
def timeline_by_month(spark, d):
    """Distinct dated entries per source and month, and how many were written more than 90 days late."""
    t = table(spark, d, "timeline_entries")
    t = P.dedup_timeline(t).select("id").join(t.select("id", "date", "source", "created_at"), "id")
    late = F.count_if(F.datediff(F.col("created_at").cast("date"), F.col("date")) > 90)
    return t.groupBy("source", F.date_format("date", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), late.alias("late"))


@q
def events_as_of_orders(spark, d):
    """As-of join: for each event the last earlier event of the same user of type purchase, by one window over the union instead of a range join."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w)
    return e.withColumn("purchase_id", last).filter("purchase_id is not null").select("event_id", "purchase_id")


@q
def near_link_types(spark, d):
    """Pairs of link types that lead from one page to the same page, with how often."""
    l = table(spark, d, "links").filter("link_type <> ''").select("from_page_id", "to_page_id", "link_type").distinct()
    return l.join(l.withColumnRenamed("link_type", "other"), ["from_page_id", "to_page_id"]).filter("link_type < other").groupBy("link_type", "other").agg(F.count("*").alias("n"))


@q
def reciprocal_links(spark, d):
    l = table(spark, d, "links").select("from_page_id", "to_page_id").distinct()
    back = l.select(F.col("to_page_id").alias("from_page_id"), F.col("from_page_id").alias("to_page_id"))
    return l.intersect(back).filter("from_page_id < to_page_id")


@q
def cosine_rescored(spark, d):
    """The nearest 50 vectors of each query vector with the reciprocal of their rank as the fused score, re-scored with the cosine."""
    e = table(spark, d, "embeddings").withColumnRenamed("vec_id", "id")
    qs = e.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
    fused = R.vector_hits(e, qs, 50).select("query_id", "chunk_id", (1 / (60 + F.col("rank"))).alias("score"))
    return R.cosine_rescore(fused, e, qs).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@q
def exact_matches(spark, d):
    """Titles of the pages whose id is divisible by 20, and a few words, as queries."""
    p = table(spark, d, "pages").filter("deleted_at is null")
    qs = spark.createDataFrame([(-1, "Runway log"), (-2, "notes"), (-3, "weekly review digest"), (-4, "2023")], "query_id long, query string")
    return R.exact_hits(p, qs.unionAll(p.filter("id % 20 = 0 and title is not null").select("id", "title")))


@q
def graph_signals(spark, d):
    p = table(spark, d, "pages")
    adj = S.adjacency(p.select("id"), table(spark, d, "links"), p)
    r = p.select(F.col("type").alias("query_id"), F.col("id").alias("page_id"), "slug", F.col("emotional_weight").cast("double").alias("score"))
    return R.graph_signals(r, adj).select("page_id", F.round("score", 6).alias("score"))


@q
def blast_radius(spark, d):
    return G.blast(table(spark, d, "links"), graph_seeds(spark, d), 2)


@q
def semantic_segments(spark, d):
    return T.semantic_breaks(table(spark, d, "embeddings"), "label", "vec_id", "embedding")


from loregraph.plans.store import QUERIES as _STORE  # noqa: E402
from loregraph.plans.structure import QUERIES as _STRUCTURE  # noqa: E402

QUERIES |= _STORE | _STRUCTURE
