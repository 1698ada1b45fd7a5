"""Resolving free names to pages, intents of queries, and samples far from a close set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loregraph.functions.expressions import jaccard, slugify, trigrams
from loregraph.operators.vectors import nearest
from loregraph.session import broadcast_if_small


def resolve_names(names: DataFrame, pages: DataFrame, links: DataFrame, least: float = 0.4) -> DataFrame:
    """(name, slug, how): the slug as written, else the most similar title of at least ``least``, else the best connected slug that begins with it, else the name made a slug.

    Names are a small, counted set; titles are compared on shared trigrams only.
    """
    n = broadcast_if_small(names.select("name").distinct().withColumn("as_slug", slugify(F.col("name"))).withColumn("g", trigrams(F.col("name"))))
    p = pages.filter("deleted_at is null").select("id", "slug", "title")
    exact = p.join(n, F.substring_index("slug", "/", -1) == F.col("as_slug")).groupBy("name").agg(F.min("slug").alias("exact"))
    keys = p.filter("title is not null").select("slug", trigrams(F.col("title")).alias("t")).select("slug", "t", F.explode("t").alias("x"))
    cand = keys.join(broadcast_if_small(n.select("name", "g", F.explode("g").alias("x"))), "x").select("name", "slug", jaccard(F.col("t"), F.col("g")).alias("sim")).filter(F.col("sim") >= least)
    fuzzy = cand.groupBy("name").agg(F.min_by("slug", F.struct(-F.round("sim", 6), "slug")).alias("fuzzy"))
    deg = links.groupBy(F.col("to_page_id").alias("id")).agg(F.count("*").alias("deg"))
    pre = p.join(n, F.startswith(F.substring_index("slug", "/", -1), F.concat("as_slug", F.lit("-")))).join(deg, "id", "left")
    prefix = pre.groupBy("name").agg(F.min_by("slug", F.struct(-F.coalesce("deg", F.lit(0)), "slug")).alias("prefix"))
    r = n.select("name", "as_slug").join(exact, "name", "left").join(fuzzy, "name", "left").join(prefix, "name", "left")
    how = F.when(F.col("exact").isNotNull(), "exact").when(F.col("fuzzy").isNotNull(), "fuzzy").when(F.col("prefix").isNotNull(), "prefix").otherwise("new")
    return r.select("name", F.coalesce("exact", "fuzzy", "prefix", "as_slug").alias("slug"), how.alias("how"))


def suggested_slugs(names: DataFrame, pages: DataFrame, k: int = 5, least: float = 0.3) -> DataFrame:
    """(name, slug, similarity, rank): the page whose slug is the name, or else the ``k`` slugs whose titles are most similar to it; names are a small, counted set."""
    n = broadcast_if_small(names.select("name").distinct().withColumn("g", trigrams(F.col("name"))))
    p = pages.filter("deleted_at is null").select("slug", "title")
    exact = p.join(n, F.col("slug") == F.col("name")).select("name", "slug").distinct().select("name", "slug", F.lit(1.0).alias("similarity"), F.lit(1).alias("rank"))
    rest = broadcast_if_small(n.join(exact.select("name"), "name", "left_anti").select("name", "g", F.explode("g").alias("x")))
    keys = p.filter("title is not null").select("slug", trigrams(F.col("title")).alias("t")).select("slug", "t", F.explode("t").alias("x"))
    sim = keys.join(rest, "x").groupBy("name", "slug").agg(F.max(F.round(jaccard(F.col("t"), F.col("g")), 6)).alias("similarity")).filter(F.col("similarity") >= least)
    w = Window.partitionBy("name").orderBy(F.desc("similarity"), "slug")
    return exact.unionByName(sim.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k))


def intent(query: Column) -> Column:
    """temporal, entity, event or general, by the first family of words that occurs."""
    q = F.lower(query)
    return (
        F.when(q.rlike(r"\b(when|yesterday|today|last (week|month|year)|recent|latest|since|20\d\d)\b"), "temporal").when(q.rlike(r"\b(who|whom|person|founder|ceo|works? at|invested)\b"), "entity")
        .when(q.rlike(r"\b(meeting|call|launch|offsite|event|met)\b"), "event").otherwise("general")
    )


def far_set(vectors: DataFrame, close: DataFrame, id_col: str, group: str, vec: str, m: int) -> DataFrame:
    """The ``m`` vectors, of groups that have none in the close set, with the greatest distance 1 - max cosine to it: each vector's nearest of the close set, in blocks."""
    v = vectors.join(close.select(group).distinct(), group, "left_anti").select(F.col(id_col).alias("query_id"), group, vec)
    d = nearest(close, v, 1, id_col=id_col, vec=vec).select("query_id", F.round(1 - F.col("score"), 6).alias("distance"))
    return v.join(d, "query_id").select(F.col("query_id").alias("id"), group, "distance").orderBy(F.desc("distance"), F.asc("id")).limit(m)


def adaptive_return(ranked: DataFrame, by: str, rank: str, intent_col: str, entity: int = 2, other: int = 6) -> DataFrame:
    return ranked.filter(F.col(rank) <= F.when(F.col(intent_col) == "entity", entity).otherwise(other))
