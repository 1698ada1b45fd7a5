"""Aggregations and statistics over pages, links, chunks, dated facts and claims."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loregraph.functions.expressions import age_days, cosine, jaccard, js_round, recency, source_factor
from loregraph.operators.pages import page_tags
from loregraph.session import broadcast_if_small, checkpointed


def live(pages: DataFrame) -> DataFrame:
    return pages.filter(F.col("deleted_at").isNull())


def brain_stats(pages: DataFrame, chunks: DataFrame, links: DataFrame, entries: DataFrame) -> DataFrame:
    """One row of counts; each table is read once."""
    p = live(pages).agg(F.count("*").alias("page_count"))
    c = chunks.agg(F.count("*").alias("chunk_count"), F.count("embedding").alias("embedded_count"))
    t = page_tags(pages).agg(F.count("*").alias("tag_count"))
    return p.crossJoin(c).crossJoin(links.agg(F.count("*").alias("link_count"))).crossJoin(entries.agg(F.count("*").alias("timeline_count"))).crossJoin(t)


def orphans(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Live pages without an inbound link from a live page."""
    l = live(pages)
    inbound = links.join(l.select(F.col("id").alias("from_page_id")), "from_page_id", "left_semi").select(F.col("to_page_id").alias("id")).distinct()
    return l.select("id", "slug", "source_id").join(inbound, "id", "left_anti")


def dead_links(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Links whose target is missing or deleted."""
    return links.join(live(pages).select(F.col("id").alias("to_page_id")), "to_page_id", "left_anti").select("id", "from_page_id", "to_page_id")


def health(pages: DataFrame, chunks: DataFrame, links: DataFrame, entries: DataFrame) -> DataFrame:
    """Coverage ratios and the score of 100: 35 vectors, 25 links per page, 15 timelines, 15 without orphans, 10 without dead links."""
    n = lambda c: F.greatest(c, F.lit(1))
    p = pages.agg(F.count("*").alias("pages"))
    c = chunks.agg(F.count("*").alias("chunks"), F.count("embedding").alias("embedded"))
    l = links.agg(F.count("*").alias("links"))
    t = entries.agg(F.countDistinct("page_id").alias("with_timeline"))
    o = orphans(pages, links).agg(F.count("*").alias("orphans"))
    d = dead_links(pages, links).agg(F.count("*").alias("dead"))
    j = p.crossJoin(c).crossJoin(l).crossJoin(t).crossJoin(o).crossJoin(d)
    score = (
        js_round(35 * F.col("embedded") / n(F.col("chunks"))) + js_round(25 * F.least(F.lit(1.0), F.col("links") / n(F.col("pages")))) + js_round(15 * F.least(F.lit(1.0), F.col("with_timeline") / n(F.col("pages"))))
        + js_round(15 * (1 - F.col("orphans") / n(F.col("pages")))) + js_round(10 * (1 - F.least(F.lit(1.0), F.col("dead") / n(F.col("links")))))
    )
    return j.withColumn("score", score)


def degrees(links: DataFrame) -> DataFrame:
    ends = links.select(F.col("from_page_id").alias("id")).unionAll(links.select(F.col("to_page_id").alias("id")))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def most_connected(pages: DataFrame, links: DataFrame, k: int = 5) -> DataFrame:
    p = live(pages).filter(F.col("type").isin("person", "company")).select("id", "slug", "source_id")
    return p.join(degrees(links), "id").orderBy(F.desc("degree"), F.asc("id")).limit(k)


def backlink_counts(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Inbound links per live page without mere mentions, zero-filled."""
    n = links.filter(~F.col("link_source").eqNullSafe("mentions")).groupBy(F.col("to_page_id").alias("id")).agg(F.count("*").alias("n"))
    return live(pages).select("id", "slug").join(n, "id", "left").select("id", "slug", F.coalesce("n", F.lit(0)).alias("backlinks"))


def histogram(df: DataFrame, *by: str, n: str = "n") -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias(n))


def source_health(sources: DataFrame, pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Counts per source, zero-filled; pages and chunks are counted before they are joined."""
    c = chunks.groupBy("page_id").agg(F.count("*").alias("chunks"), F.count("embedding").alias("embedded"))
    per = (
        live(pages).select("id", "source_id").join(c.withColumnRenamed("page_id", "id"), "id", "left").groupBy("source_id")
        .agg(F.count("*").alias("pages"), F.sum(F.coalesce("chunks", F.lit(0))).alias("chunks"), F.sum(F.coalesce("embedded", F.lit(0))).alias("embedded"))
    )
    return sources.select(F.col("id").alias("source_id")).join(per, "source_id", "left").fillna(0)


def prefixes(pages: DataFrame, least: int = 5) -> DataFrame:
    pre = F.substring_index("slug", "/", 1)
    return pages.filter(F.col("slug").contains("/")).groupBy(pre.alias("prefix")).agg(F.count("*").alias("n"), F.countDistinct("type").alias("types")).filter(F.col("n") >= least)


def scorecard(claims: DataFrame, *by: str) -> DataFrame:
    """Per group: counts by quality, Brier score over right and wrong claims, accuracy, share of partly right ones."""
    q, w = F.col("quality"), F.col("weight")
    hit = F.when(q == "correct", 1.0).when(q == "incorrect", 0.0)
    right, wrong, part = F.count_if(q == "correct"), F.count_if(q == "incorrect"), F.count_if(q == "partial")
    return claims.groupBy(*by).agg(
        F.count("*").alias("total"), right.alias("correct"), wrong.alias("incorrect"), part.alias("partial"),
        F.round(F.avg((w - hit) * (w - hit)), 6).alias("brier"), F.round(F.try_divide(right, right + wrong), 6).alias("accuracy"), F.round(F.try_divide(part, right + wrong + part), 6).alias("partial_rate"),
    )


def calibration_curve(claims: DataFrame, size: str = "0.1") -> DataFrame:
    """Bins of the weight, in decimals so that 0.3 falls into the bin of 0.3."""
    last = int(round(1 / float(size))) - 1
    b = F.least(F.floor(F.col("weight").cast("decimal(10,4)") / F.lit(size).cast("decimal(10,4)")), F.lit(last)).cast("int")
    hit = F.when(F.col("quality") == "correct", 1.0).otherwise(0.0)
    binary = claims.filter(F.col("quality").isin("correct", "incorrect"))
    return binary.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg(hit), 6).alias("observed"), F.round(F.avg("weight"), 6).alias("predicted"))


def conviction_brier(claims: DataFrame, *by: str) -> DataFrame:
    q, w = F.col("quality"), F.col("weight")
    hit = F.when(q == "correct", 1.0).when(q == "incorrect", 0.0)
    c = F.when(hit.isNotNull(), 2 * F.abs(w - 0.5))
    return claims.groupBy(*by).agg(F.round(F.try_divide(F.sum((w - hit) * (w - hit) * c), F.sum(c)), 6).alias("conviction_brier"))


def anomalies(events: DataFrame, cohort: str, stamp: str, day: str, lookback: int = 30, sigma: float = 3.0, k: int = 20) -> DataFrame:
    """Cohorts whose count on ``day`` is above mean + sigma x deviation of the densified days before (or above mean + 1 if these do not vary)."""
    d = F.lit(day).cast("date")
    per = events.select(F.col(cohort).alias("cohort"), F.col(stamp).cast("date").alias("d")).filter((F.col("d") <= d) & (F.col("d") >= F.date_sub(d, lookback))).groupBy("cohort", "d").agg(F.count("*").alias("n"))
    days = per.select("cohort").distinct().withColumn("d", F.explode(F.sequence(F.date_sub(d, lookback), F.date_sub(d, 1))))
    base = days.join(per, ["cohort", "d"], "left").groupBy("cohort").agg(F.avg(F.coalesce("n", F.lit(0))).alias("mean"), F.coalesce(F.stddev_samp(F.coalesce("n", F.lit(0))), F.lit(0.0)).alias("sd"))
    today = per.filter(F.col("d") == d).select("cohort", F.col("n").alias("count"))
    over = F.when(F.col("sd") > 0, F.col("count") > F.col("mean") + sigma * F.col("sd")).otherwise(F.col("count") > F.col("mean") + 1)
    seen = F.when(F.col("sd") > 0, (F.col("count") - F.col("mean")) / F.col("sd")).otherwise(F.col("count") - F.col("mean"))
    return today.join(base, "cohort").filter(over).withColumn("sigma_observed", seen).orderBy(F.desc("sigma_observed"), F.asc("cohort")).limit(k)


def emotional_weight(tags: DataFrame, pages: DataFrame, entries: DataFrame, high: list[str], takes: DataFrame | None = None, user: object = None) -> DataFrame:
    """0.5 for a tag of high emotion, 0.1 per dated entry up to 0.3, and, of active claims (page_id, holder, weight, active), a tenth of their mean weight and of the user's share; clamped to 1."""
    hot = tags.filter(F.col("tag").isin(high)).select("page_id").distinct().withColumn("hot", F.lit(0.5))
    n = entries.groupBy("page_id").agg(F.count("*").alias("n"))
    j = pages.select(F.col("id").alias("page_id")).join(hot, "page_id", "left").join(n, "page_id", "left")
    w = F.coalesce("hot", F.lit(0.0)) + F.least(F.coalesce(F.col("n"), F.lit(0)) * 0.1, F.lit(0.3))
    if takes is not None:
        t = takes.filter("active").groupBy("page_id").agg(F.avg("weight").alias("__w"), F.avg((F.col("holder") == user).cast("double")).alias("__u"))
        j = j.join(t, "page_id", "left")
        w = w + 0.1 * F.coalesce("__w", F.lit(0.0)) + 0.1 * F.coalesce("__u", F.lit(0.0))
    return j.select("page_id", F.round(F.least(F.greatest(w, F.lit(0.0)), F.lit(1.0)), 6).alias("weight"))


def recent_salience(pages: DataFrame, entries: DataFrame, as_of: str, days: int, k: int, takes: DataFrame | None = None) -> DataFrame:
    """5 x emotional weight + ln(1 + entries, or active claims if they are given) + recency, of the pages changed within ``days``."""
    age = age_days(F.col("updated_at"), as_of)
    p = live(pages).filter((age >= 0) & (age <= days)).select("id", "slug", "emotional_weight", age.alias("age"))
    n = entries.groupBy(F.col("page_id").alias("id")).agg(F.countDistinct("date", "summary").alias("n")) if takes is None else takes.filter("active").groupBy(F.col("page_id").alias("id")).agg(F.countDistinct("row_num").alias("n"))
    s = 5 * F.coalesce(F.col("emotional_weight").cast("double"), F.lit(0.0)) + F.log1p(F.coalesce("n", F.lit(0))) + recency(F.col("slug"), F.col("age"))
    return p.join(n, "id", "left").select("id", "slug", F.round(s, 6).alias("score")).orderBy(F.desc("score"), F.asc("id")).limit(k)


def enrich_candidates(pages: DataFrame, links: DataFrame, max_chars: int = 400, k: int = 50) -> DataFrame:
    """Short live pages with the most inbound links."""
    thin = live(pages).filter(F.coalesce(F.length("compiled_truth"), F.lit(0)) < max_chars).select("id", "slug")
    n = links.groupBy(F.col("to_page_id").alias("id")).agg(F.count("*").alias("inbound"))
    return thin.join(n, "id").orderBy(F.desc("inbound"), F.asc("id")).limit(k)


def trajectory_regressions(facts: DataFrame, entity: str, metric: str, value: str, stamp: str, id_col: str, drop: float = 0.10) -> DataFrame:
    """Consecutive values of an entity's metric that fall by at least ``drop``; an old value of 0 is skipped."""
    w = Window.partitionBy(entity, metric).orderBy(stamp, id_col)
    f = facts.withColumn("old", F.lag(value).over(w))
    fall = (F.col("old") - F.col(value)) / F.abs("old")
    return f.filter((F.col("old") != 0) & (fall >= drop)).select(F.col(id_col).alias("id"), F.col(entity).alias("entity"), F.col(metric).alias("metric"), "old", F.col(value).alias("new"), F.round(fall, 6).alias("fall"))


def validity_chain(facts: DataFrame, entity: str, metric: str, stamp: str, id_col: str) -> DataFrame:
    """Each fact is valid until the next one of the same entity and metric begins."""
    w = Window.partitionBy(entity, metric).orderBy(stamp, id_col)
    return facts.select(F.col(id_col).alias("id"), F.lead(id_col).over(w).alias("next_id"), F.lead(stamp).over(w).alias("valid_until"))


def drift_score(vectors: DataFrame, by: str, order: str, vec: str) -> DataFrame:
    """1 - mean cosine of consecutive vectors, for groups of at least three."""
    w = Window.partitionBy(by).orderBy(order)
    pairs = vectors.select(F.col(by), F.col(order), cosine(F.col(vec), F.lag(vec).over(w)).alias("c"))
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.avg("c")))
    return pairs.groupBy(by).agg(F.count("*").alias("points"), F.round(s, 6).alias("drift")).filter("points >= 3")


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """95 % interval of a share; its ends are exact where the share is 0 or 1."""
    p = hits / n
    mid, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(hits == 0, F.lit(0.0)).otherwise(mid - half), F.when(hits == n, F.lit(1.0)).otherwise(mid + half)


def sessions(events: DataFrame, by: str, stamp: str, order: str, gap_minutes: int = 30, least: int = 2) -> DataFrame:
    """Runs of events without a gap of more than ``gap_minutes``; shorter runs than ``least`` are dropped."""
    w = Window.partitionBy(by).orderBy(stamp, order)
    new = F.coalesce((F.unix_micros(F.col(stamp).cast("timestamp")) - F.unix_micros(F.lag(stamp).over(w).cast("timestamp")) > gap_minutes * 60_000_000).cast("int"), F.lit(0))
    s = events.withColumn("new", new).withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy(F.col(by).alias("entity"), "session").agg(F.count("*").alias("n"), F.min(order).alias("first_id"), F.max(order).alias("last_id")).filter(F.col("n") >= least)


def running(df: DataFrame, by: list[str], order: list[str], amount: Column, name: str = "running") -> DataFrame:
    """``df`` with the running sum of ``amount`` in the order of ``order`` within ``by``, for groups of any size.

    The rows are cut into ranges of the order, whose sums are added up first; a task sees one range, never a whole group. Nulls in ``by`` are a group of their own.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = checkpointed(df.withColumn("__amount", amount).repartitionByRange(parts, *by, *order).withColumn("__range", F.spark_partition_id()))
    per = cut.groupBy(*by, "__range").agg(F.sum("__amount").alias("__sum"))
    before = per.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__range").alias("__r"), F.coalesce(F.sum("__sum").over(Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by], F.col("__range") == F.col("__r"))
    inside = F.sum("__amount").over(Window.partitionBy(*by, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return cut.withColumn(name, inside).join(broadcast_if_small(before), same).withColumn(name, F.col(name) + F.col("__before")).select(*df.columns, name)


def token_budget(ranked: DataFrame, by: str, rank: str, cost: Column, budget: int) -> DataFrame:
    """The head of each ranking whose running cost stays within the budget; the first row over it ends the head. Costs are not negative, so the running sum alone decides."""
    return running(ranked, [by], [rank], F.greatest(cost, F.lit(0))).filter(F.col("running") <= budget)


def autocut(ranked: DataFrame, by: str, rank: str, score: str, least_gap: float = 0.2, keep: Column | None = None) -> DataFrame:
    """Each ranking down to its largest gap of scores relative to the best, if that is at least ``least_gap``; never nothing. Rows for which ``keep`` holds, such as alias hits, stay."""
    w = Window.partitionBy(by).orderBy(rank)
    top = F.max(score).over(Window.partitionBy(by))
    g = ranked.withColumn("__gap", (F.col(score) - F.lead(score).over(w)) / top)
    cut = g.groupBy(by).agg(F.max_by(rank, F.struct(F.coalesce("__gap", F.lit(-1.0)), -F.col(rank))).alias("__at"), F.max("__gap").alias("__most"))
    stays = (F.coalesce("__most", F.lit(0.0)) < least_gap) | (F.col(rank) <= F.col("__at"))
    stays = stays if keep is None else stays | F.coalesce(keep, F.lit(False))
    return g.join(cut, by).filter(stays).drop("__gap", "__at", "__most")


def seeded_sample(df: DataFrame, id_col: str, k: int, seed: int) -> DataFrame:
    """``k`` rows in an order that a seed decides, the same in every run."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))), id_col).limit(k)


def run_trend(runs: DataFrame, stamp: str, hits: str, n: str, as_of: str, days: int) -> DataFrame:
    """(at, hits, n, share, low, high) of the runs of the last ``days``, oldest first, with the 95 % interval of the share."""
    age = age_days(F.col(stamp), as_of)
    lo, hi = wilson(F.col(hits), F.col(n))
    r = runs.filter((age >= 0) & (age <= days) & (F.col(n) > 0))
    return r.select(F.col(stamp).alias("at"), F.col(hits).alias("hits"), F.col(n).alias("n"), F.round(F.col(hits) / F.col(n), 6).alias("share"), F.round(lo, 6).alias("low"), F.round(hi, 6).alias("high")).orderBy("at")


def ir_metrics(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """P@k, R@k, reciprocal rank and nDCG@k per query, for ``ranked`` (query, rank from 1, doc) and ``relevant`` (query, doc)."""
    n = relevant.groupBy("query").agg(F.count("*").alias("n"))
    hits = ranked.filter(F.col("rank") <= k).join(relevant, ["query", "doc"]).groupBy("query").agg(F.count("*").alias("h"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    j = n.join(hits, "query", "left")
    h = F.coalesce("h", F.lit(0))
    return j.select("query", F.coalesce(F.col("first") == 1, F.lit(False)).alias("top1"), F.round(h / k, 6).alias("p_at_k"), F.round(h / F.col("n"), 6).alias("r_at_k"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("rr"), F.round(F.coalesce("dcg", F.lit(0.0)) / ideal, 6).alias("ndcg"))


def nearest_rank(df: DataFrame, by: str, score: str, shares: dict[str, float]) -> DataFrame:
    """Values at index round((n - 1) x share) of each group. Equal values are counted first and ranked by running sums over ranges, so that few and large groups are spread."""
    counts = df.filter(F.col(score).isNotNull()).groupBy(by, score).agg(F.count("*").alias("__n"))
    upto = running(counts, [by], [score], F.col("__n"), "__upto")
    n = broadcast_if_small(counts.groupBy(F.col(by).alias("__by")).agg(F.sum("__n").alias("n")))
    r = upto.join(n, F.col(by).eqNullSafe(F.col("__by")))
    at = lambda s: js_round((F.col("n") - 1) * s)
    pick = lambda s: F.max(F.when((F.col("__upto") - F.col("__n") <= at(s)) & (at(s) < F.col("__upto")), F.col(score)))
    return r.groupBy(by).agg(F.max("n").alias("n"), *[pick(s).alias(c) for c, s in shares.items()])


def prefix_sample(pages: DataFrame, links: DataFrame) -> DataFrame:
    """The best connected page of each prefix of two slug segments."""
    p = live(pages).select("id", "slug").join(degrees(links), "id", "left").withColumn("prefix", F.substring_index("slug", "/", 2)).withColumn("degree", F.coalesce("degree", F.lit(0)))
    w = Window.partitionBy("prefix").orderBy(F.desc("degree"), F.asc("slug"), F.asc("id"))
    return p.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("prefix", "id", "degree")


def adjacency(result: DataFrame, links: DataFrame, pages: DataFrame) -> DataFrame:
    """Within a set of page ids: distinct inbound pages of the set, and distinct foreign sources among them."""
    r = broadcast_if_small(result.select("id").distinct())
    p = pages.select("id", "source_id").join(r, "id", "left_semi")
    a, b = p.select(F.col("id").alias("from_page_id"), F.col("source_id").alias("sa")), p.select(F.col("id").alias("to_page_id"), F.col("source_id").alias("sb"))
    e = links.join(a, "from_page_id").join(b, "to_page_id").filter("from_page_id <> to_page_id")
    return e.groupBy(F.col("to_page_id").alias("id")).agg(F.countDistinct("from_page_id").alias("inbound"), F.countDistinct(F.when(F.col("sa") != F.col("sb"), F.col("sa"))).alias("foreign_sources"))


def queue_stats(jobs: DataFrame, status: str, kind: str, cost: str, stamp: str) -> DataFrame:
    """(status, kind, n, mean of ``cost``, last day) of a queue's jobs."""
    return jobs.groupBy(status, kind).agg(F.count("*").alias("n"), F.round(F.avg(cost), 4).alias("mean"), F.date_format(F.max(stamp), "yyyy-MM-dd").alias("last"))


def telemetry(events: DataFrame, kind: str, stamp: str, value: str) -> DataFrame:
    """(kind, n, mean, least, most, days) from daily sums, as a store of daily counters gives them: means are weighted by the days' counts."""
    day = events.groupBy(kind, F.to_date(stamp).alias("__d")).agg(F.count("*").alias("n"), F.count(value).alias("k"), F.sum(value).alias("s"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    return day.groupBy(kind).agg(F.sum("n").alias("n"), F.round(F.try_divide(F.sum("s"), F.sum("k")), 6).alias("mean"), F.min("lo").alias("least"), F.max("hi").alias("most"), F.count("*").alias("days"))


def tier(slug: Column) -> Column:
    """curated for source factors above 1.05, bulk below 0.95."""
    f = source_factor(slug)
    return F.when(f > 1.05, "curated").when(f < 0.95, "bulk").otherwise("other")


def tier_pairs(links: DataFrame, pages: DataFrame) -> DataFrame:
    """(tier_a, tier_b, n): links by the tiers of their ends, in either direction alike."""
    p = pages.select("id", tier(F.col("slug")).alias("tier"))
    l = links.join(p.select(F.col("id").alias("from_page_id"), F.col("tier").alias("a")), "from_page_id").join(p.select(F.col("id").alias("to_page_id"), F.col("tier").alias("b")), "to_page_id")
    return l.groupBy(F.least("a", "b").alias("tier_a"), F.greatest("a", "b").alias("tier_b")).agg(F.count("*").alias("n"))


def link_coverage(pages: DataFrame, links: DataFrame, share: float = 1.0, seed: int = 5) -> DataFrame:
    """(type, n, share, error): live pages with an inbound link by type, on a sample that a seed decides if ``share`` is below 1, with the half-width of one standard error."""
    p = live(pages)
    p = p if share >= 1 else p.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)))
    hit = links.select(F.col("to_page_id").alias("id")).distinct().withColumn("__hit", F.lit(1.0))
    s = p.join(hit, "id", "left").groupBy("type").agg(F.count("*").alias("n"), F.avg(F.coalesce("__hit", F.lit(0.0))).alias("p"))
    return s.select("type", "n", F.round("p", 6).alias("share"), F.round(F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("n")), 6).alias("error"))


def quarter_totals(df: DataFrame, stamp: str, amount: str) -> DataFrame:
    """(quarter, n, total): tumbling quarters, labelled 2024Q1."""
    label = F.concat(F.year(stamp).cast("string"), F.lit("Q"), F.quarter(stamp).cast("string"))
    return df.groupBy(label.alias("quarter")).agg(F.count("*").alias("n"), F.round(F.sum(amount), 2).alias("total"))


def result_pairs(ranked: DataFrame, by: str, rank: str, item: str, score: str, differ: str) -> DataFrame:
    """(by, item_a, item_b, combined): pairs of each ranking whose ``differ`` is not the same, the better one first; rankings are short by construction."""
    a, b = (ranked.select(by, F.col(item).alias(f"{item}_{x}"), F.col(differ).alias(f"__d{x}"), F.col(score).alias(f"__s{x}"), F.col(rank).alias(f"__r{x}")) for x in "ab")
    return a.join(b, by).filter("__ra < __rb and __da <> __db").select(by, f"{item}_a", f"{item}_b", F.round(F.col("__sa") + F.col("__sb"), 2).alias("combined"))


def set_stability(first: DataFrame, second: DataFrame, by: str, item: str, rank: str) -> DataFrame:
    """One row: n of the groups that both rankings have, mean Jaccard of their items, share of them with the same item at the top."""
    side = lambda df, x: df.groupBy(by).agg(F.collect_set(item).alias(f"s{x}"), F.min_by(item, rank).alias(f"t{x}"))
    s = side(first, 1).join(side(second, 2), by)
    return s.agg(F.count("*").alias("n"), F.round(F.avg(jaccard(F.col("s1"), F.col("s2"))), 6).alias("jaccard"), F.round(F.avg((F.col("t1") == F.col("t2")).cast("double")), 6).alias("top1"))
