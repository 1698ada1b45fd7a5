"""Dated facts and attributed claims: reads, append-only changes, deduplication and consolidation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loregraph.operators.vectors import nearest


def active(facts: DataFrame) -> DataFrame:
    return facts.filter(F.col("expired_at").isNull())


def by_entity(facts: DataFrame, entity: str, stamp: str, id_col: str, k: int) -> DataFrame:
    """The newest ``k`` facts of every entity."""
    w = Window.partitionBy(entity).orderBy(F.desc(stamp), F.desc(id_col))
    return facts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def insert_superseding(facts: DataFrame, new: DataFrame, at: str) -> DataFrame:
    """``facts`` (id, ..., expired_at, superseded_by) with ``new`` (the same columns and supersedes) appended; superseded facts expire at ``at`` unless they have expired."""
    s = new.filter("supersedes is not null").groupBy(F.col("supersedes").alias("id")).agg(F.min("id").alias("__by"))
    hit = F.col("__by").isNotNull() & F.col("expired_at").isNull()
    old = facts.join(s, "id", "left")
    changed = {"expired_at": F.when(hit, F.lit(at).cast("timestamp_ntz")).otherwise(F.col("expired_at")), "superseded_by": F.when(hit, F.col("__by")).otherwise(F.col("superseded_by"))}
    return old.select(*[changed.get(c, F.col(c)).alias(c) for c in facts.columns]).unionByName(new.select(*facts.columns))


def supersessions(facts: DataFrame, k: int) -> DataFrame:
    return facts.filter("expired_at is not null and superseded_by is not null").orderBy(F.desc("expired_at"), F.desc("id")).limit(k)


def dedup_candidates(facts: DataFrame, new: DataFrame, entity: str, id_col: str, vec: str, k: int, duplicate: float = 0.95) -> DataFrame:
    """For each new fact its ``k`` nearest facts of the entity, with the decision duplicate / related; an entity's facts are compared in blocks."""
    near = nearest(facts, new.withColumn("query_id", F.col(id_col)), k, id_col=id_col, vec=vec, group=entity, other_than_itself=True)
    return near.select(F.col("query_id").alias("new_id"), "id", F.col("score").alias("similarity"), "rank", (F.col("score") >= duplicate).alias("duplicate"))


def consolidate(facts: DataFrame, entity: str, id_col: str, vec: str, least: int = 3, limit: float = 0.85, stamp: str | None = None, as_of: str | None = None, hours: float = 24) -> DataFrame:
    """(entity, head, id): greedy clusters, newest first, of facts at least ``limit`` similar to a cluster's head; clusters of two or more.

    Entities with fewer than ``least`` facts, or, if ``stamp`` and ``as_of`` are given, none of which is ``hours`` old, are left out before the shuffle of the vectors. The sorted partitions are streamed: an entity's facts are never held
    together, only the heads of its clusters so far. Facts without a vector stay out.
    """
    old = F.lit(True) if stamp is None else F.min(stamp) <= F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(hours=F.lit(int(hours)))
    n = facts.groupBy(entity).agg(F.count("*").alias("n"), old.alias("__old")).filter((F.col("n") >= least) & F.col("__old")).select(entity)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, ids, heads = None, [], np.empty((0, 0))
        for b in batches:
            out = []
            for e, i, v in zip(b["e"], b["id"], b["v"]):
                v = np.asarray(v, dtype=float)
                v = v / (np.linalg.norm(v) or 1.0)
                if e != now:
                    now, ids, heads = e, [], np.empty((64, len(v)))
                near = np.flatnonzero(heads[: len(ids)] @ v >= limit) if ids else []
                if len(near):
                    out.append((e, ids[near[0]], int(i)))
                else:
                    if len(ids) == len(heads):
                        heads = np.concatenate([heads, np.empty_like(heads)])  # twice the room
                    heads[len(ids)] = v
                    ids.append(int(i))
                    out.append((e, int(i), int(i)))
            yield pd.DataFrame(out, columns=["entity", "head", "id"])

    src = facts.join(n, entity, "left_semi").filter(F.col(vec).isNotNull()).select(F.col(entity).cast("string").alias("e"), F.col(id_col).cast("long").alias("id"), F.col(vec).alias("v"))
    got = src.repartition("e").sortWithinPartitions("e", F.desc("id")).mapInPandas(run, "entity string, head long, id long")
    real = got.groupBy("entity", "head").agg(F.count("*").alias("n")).filter("n > 1").select("entity", "head")
    return got.join(real, ["entity", "head"], "left_semi")


def upsert_takes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Claims by (page_id, row_num); weights are clamped to 0..1, resolved claims never change."""
    n = new.withColumn("weight", F.least(F.greatest("weight", F.lit(0.0)), F.lit(1.0)))
    fixed = old.filter("quality is not null")
    keys = ["page_id", "row_num"]
    return fixed.unionByName(old.filter("quality is null").join(n, keys, "left_anti")).unionByName(n.join(fixed, keys, "left_anti"))


def supersede_take(takes: DataFrame, page_id: int, row_num: int, claim: str) -> DataFrame:
    """The claim becomes inactive and the page gets a new row with the next number; a resolved one stays as it is and nothing is added."""
    at = (F.col("page_id") == page_id) & (F.col("row_num") == row_num) & F.col("quality").isNull() & F.col("active")
    nxt = takes.filter(F.col("page_id") == page_id).agg(F.max("row_num").alias("m"))
    new = takes.filter(at).drop("row_num").crossJoin(nxt).withColumn("row_num", F.col("m") + 1).withColumn("claim", F.lit(claim)).select(*takes.columns)
    return takes.withColumn("active", F.col("active") & ~F.coalesce(at, F.lit(False))).unionByName(new)


def resolve_takes(takes: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Quality set once: (page_id, row_num, quality) outcomes of resolved claims have no effect."""
    o = outcomes.groupBy("page_id", "row_num").agg(F.min("quality").alias("__q"))
    return takes.join(o, ["page_id", "row_num"], "left").withColumn("quality", F.coalesce("quality", "__q")).select(*takes.columns)


def health(facts: DataFrame, stamp: str, as_of: str, entity: str) -> DataFrame:
    """Counts in all, of the last day and week, and of entities."""
    age = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col(stamp).cast("timestamp"))) / F.lit(3_600e6)
    return facts.agg(F.count("*").alias("total"), F.count_if((age >= 0) & (age < 24)).alias("last_day"), F.count_if((age >= 0) & (age < 168)).alias("last_week"), F.countDistinct(entity).alias("entities"))


def top_entities(facts: DataFrame, entity: str, k: int = 5) -> DataFrame:
    """The entities with the most facts."""
    return facts.groupBy(F.col(entity).alias("entity")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc("entity")).limit(k)


def listed(facts: DataFrame, *, entity: tuple[str, object] | None = None, since: tuple[str, str] | None = None, kinds: tuple[str, list[str]] | None = None, visible: list[str] | None = None, only_active: bool = True, order: tuple[str, str] = ("valid_from", "id"), limit: int = 100) -> DataFrame:
    """Facts, newest first: of one entity (column, value) or session, since a time (column, time), of some kinds (column, values), of allowed visibilities."""
    f = active(facts) if only_active and "expired_at" in facts.columns else facts
    if entity is not None:
        f = f.filter(F.col(entity[0]) == entity[1])
    if since is not None:
        f = f.filter(F.col(since[0]) >= F.lit(since[1]).cast("timestamp_ntz"))
    if kinds is not None:
        f = f.filter(F.col(kinds[0]).isin(kinds[1]))
    if visible is not None:
        f = f.filter(F.col("visibility").isin(visible))
    return f.orderBy(F.desc_nulls_last(order[0]), F.desc(order[1])).limit(limit)


def trajectory(facts: DataFrame, entity: str, metric: str, value: str, stamp: str, id_col: str, *, of: object, metrics: list[str], since: str, until: str) -> DataFrame:
    """(id, metric, value, at) of one entity's metrics within a window of days, in the order of time."""
    f = facts.filter((F.col(entity) == of) & F.col(metric).isin(metrics) & (F.col(stamp) >= F.lit(since).cast("timestamp_ntz")) & (F.col(stamp) < F.lit(until).cast("timestamp_ntz")))
    return f.select(F.col(id_col).alias("id"), F.col(metric).alias("metric"), F.col(value).alias("value"), F.col(stamp).alias("at")).orderBy("at", "id")


def expired(facts: DataFrame, ids: DataFrame, at: str) -> DataFrame:
    """The named facts (id, superseded_by or null) expire at ``at`` unless they have."""
    s = ids.groupBy("id").agg(F.min("superseded_by").alias("__by"), F.lit(True).alias("__hit"))
    j = facts.join(s, "id", "left")
    hit = F.coalesce(F.col("__hit") & F.col("expired_at").isNull(), F.lit(False))
    new = {"expired_at": F.when(hit, F.lit(at).cast("timestamp_ntz")).otherwise(F.col("expired_at")), "superseded_by": F.when(hit, F.coalesce("__by", "superseded_by")).otherwise(F.col("superseded_by"))}
    return j.select(*[new.get(c, F.col(c)).alias(c) for c in facts.columns])


def without_pages(facts: DataFrame, pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Without facts that were derived from the named pages; facts of no page stay."""
    return facts.join(pages.select(key).distinct(), key, "left_anti")


def consolidated_into(facts: DataFrame, heads: DataFrame, at: str) -> DataFrame:
    """Facts of clusters (id, head) with the time and the head they were consolidated into; those that were before keep theirs."""
    j = facts.join(heads.groupBy("id").agg(F.min("head").alias("__head")), "id", "left")
    new = F.col("consolidated_into").isNull() & F.col("__head").isNotNull()
    cols = {"consolidated_into": F.when(new, F.col("__head")).otherwise(F.col("consolidated_into")), "consolidated_at": F.when(new, F.lit(at).cast("timestamp_ntz")).otherwise(F.col("consolidated_at"))}
    return j.select(*[cols.get(c, F.col(c)).alias(c) for c in facts.columns])


def repointed(facts: DataFrame, moves: DataFrame, key: str) -> DataFrame:
    """Facts of an alias entity (old) carry the canonical one (new) instead."""
    m = moves.groupBy(F.col("old").alias(key)).agg(F.min("new").alias("__new"))
    return facts.join(m, key, "left").withColumn(key, F.coalesce("__new", key)).select(*facts.columns)


def list_takes(takes: DataFrame, *, holder: object | None = None, domain: str | None = None, only_active: bool | None = None, resolved: bool | None = None, pages: DataFrame | None = None, visible: list[str] | None = None, least: float | None = None, sort: str = "since", limit: int = 100) -> DataFrame:
    """Claims by any of the filters, the greatest of the sort column first, nulls last."""
    if sort not in ("since", "weight", "row_num"):
        raise ValueError(f"unknown order: {sort!r}")
    t = takes
    for c, v in (("holder", holder), ("domain", domain), ("active", only_active)):
        t = t if v is None else t.filter(F.col(c) == v)
    t = t if resolved is None else t.filter(F.col("quality").isNotNull() if resolved else F.col("quality").isNull())
    t = t if pages is None else t.join(pages.select("page_id").distinct(), "page_id", "left_semi")
    t = t if visible is None else t.filter(F.col("visibility").isin(visible))
    t = t if least is None else t.filter(F.col("weight") >= least)
    return t.orderBy(F.desc_nulls_last(sort), F.asc("page_id"), F.asc("row_num")).limit(limit)


def update_takes(takes: DataFrame, changes: DataFrame, *cols: str) -> DataFrame:
    """A partial update by (page_id, row_num): columns ``cols`` where the change has a value; resolved claims never change."""
    keys = ["page_id", "row_num"]
    c = changes.groupBy(*keys).agg(*[F.max(x).alias(f"__{x}") for x in cols])
    j = takes.join(c, keys, "left")
    return j.select(*[F.when(F.col("quality").isNull(), F.coalesce(f"__{x}", x)).otherwise(F.col(x)).alias(x) if x in cols else F.col(x) for x in takes.columns])


def unresolved_attempts(takes: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Outcomes that may not be written because their claim is resolved already: to be reported as errors."""
    return outcomes.join(takes.filter("quality is not null").select("page_id", "row_num"), ["page_id", "row_num"], "left_semi")


def search_takes(takes: DataFrame, queries: DataFrame, claim: str = "claim", least: float = 0.3, k: int = 10) -> DataFrame:
    """(query_id, page_id, row_num, similarity, rank): claims by trigram similarity. Equal claims, and equal queries, are compared once; the ``k`` first rows of a claim stand for all.

    Texts are joined on their rarest trigrams: a pair of the wanted similarity shares one of the first n - ceil(least x n) + 1 of either in order of rarity (prefix filter).
    """
    from loregraph.functions.expressions import jaccard, trigrams

    rows = takes.select("page_id", "row_num", F.lower(claim).alias("c")).filter("c is not null")
    few = rows.withColumn("__rn", F.row_number().over(Window.partitionBy("c").orderBy("page_id", "row_num"))).filter(F.col("__rn") <= k).drop("__rn")
    asked = queries.select("query_id", F.lower("query").alias("a"))
    grams = lambda df, c: df.select(c).distinct().withColumn("g", trigrams(F.col(c))).withColumn("n", F.size("g")).filter("n > 0")
    t, s = grams(few, "c"), grams(asked, "a")
    floor = least - 1e-6  # similarities are rounded before they are compared
    df = t.select(F.explode("g").alias("x")).groupBy("x").agg(F.count("*").alias("df"))
    rarest = lambda g, c: g.select(c, "n", F.explode("g").alias("x")).join(df, "x", "left").withColumn("r", F.row_number().over(Window.partitionBy(c).orderBy(F.coalesce("df", F.lit(0)), "x"))).filter(F.col("r") <= F.col("n") - F.ceil(F.col("n") * floor) + 1).select(c, F.col("n").alias(f"n_{c}"), "x")
    cand = rarest(t, "c").join(rarest(s, "a"), "x").filter(F.least("n_a", "n_c") >= floor * F.greatest("n_a", "n_c")).select("a", "c").distinct()
    j = cand.join(t.select("c", F.col("g").alias("gc")), "c").join(s.select("a", F.col("g").alias("ga")), "a")
    near = j.select("a", "c", F.round(jaccard(F.col("gc"), F.col("ga")), 6).alias("similarity")).filter(F.col("similarity") >= least)
    w = Window.partitionBy("a").orderBy(F.desc("similarity"), "page_id", "row_num")
    best = near.join(few, "c").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return asked.join(best, "a").select("query_id", "page_id", "row_num", "similarity", "rank")


def promoted(clusters: DataFrame, facts: DataFrame, claim: str = "claim", confidence: str = "confidence") -> DataFrame:
    """(entity, head, claim, weight, n): a claim for each cluster, in the words of its surest fact, of the smallest id among equals, with the mean confidence as its weight."""
    f = clusters.join(facts.select("id", F.col(claim).alias("__c"), F.least(F.greatest(F.coalesce(confidence, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)).alias("__w")), "id")
    return f.groupBy("entity", "head").agg(F.max_by("__c", F.struct("__w", -F.col("id"))).alias("claim"), F.round(F.avg("__w"), 6).alias("weight"), F.count("*").alias("n"))
