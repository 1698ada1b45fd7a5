"""Graph operators over edge DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loregraph.session import checkpointed


def both_directions(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(a, b) in either direction, each once, kept; edges with a null are dropped."""
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    return checkpointed(e.union(e.select("b", "a")).distinct())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", *, prepared: bool = False) -> DataFrame:
    """(node, component): each node of an undirected edge list with the smallest node of its component.

    Smallest labels spread along the edges and are shortened by jumping to the label's label, so that long chains need few rounds. Only minima are
    aggregated, partially before each shuffle; no neighbourhood is ever collected. Self-loops make single nodes; nulls are dropped. ``prepared``: the edges come from
    ``both_directions``.
    """
    e = edges if prepared else both_directions(edges, src, dst)
    label = checkpointed(e.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("l")).withColumnRenamed("a", "node"))
    while True:
        near = e.join(label, F.col("b") == F.col("node")).groupBy("a").agg(F.min("l").alias("m"))
        step = label.join(near, F.col("node") == F.col("a"), "left").select("node", F.col("l").alias("old"), F.least("l", F.coalesce("m", "l")).alias("l"))
        jump = step.select(F.col("node").alias("j"), F.col("l").alias("jl"))
        new = checkpointed(step.join(jump, F.col("l") == F.col("j"), "left").select("node", "old", F.least("l", F.coalesce("jl", "l")).alias("l")))
        if new.filter("l <> old").limit(1).count() == 0:
            return new.select("node", F.col("l").alias("component"))
        label = new.select("node", "l")


def _steps(links: DataFrame, direction: str) -> DataFrame:
    links = links.filter("from_page_id is not null and to_page_id is not null")
    out = links.select(F.col("from_page_id").alias("at"), F.col("to_page_id").alias("to"), "link_type")
    back = links.select(F.col("to_page_id").alias("at"), F.col("from_page_id").alias("to"), "link_type")
    return (out if direction == "out" else back if direction == "in" else out.unionAll(back)).distinct()


def fanout(links: DataFrame, seeds: DataFrame, depth: int, direction: str = "out", mentions: bool = False) -> DataFrame:
    """(seed, node, hop, types): nodes reached from each seed with the fewest hops and the number of link types of the last step at that hop.

    A breadth-first walk: every level joins the frontier with the links and drops nodes already met, so that paths are never enumerated.
    """
    if not 1 <= depth <= 10:
        raise ValueError("depth must be 1 to 10")
    e = _steps(links if mentions else links.filter(~F.col("link_source").eqNullSafe("mentions")), direction)
    met = seeds.select(F.col("id").alias("seed"), F.col("id").alias("node"), F.lit(0).alias("hop"), F.lit(0).cast("long").alias("types"))
    frontier = met
    for hop in range(1, depth + 1):
        nxt = frontier.select("seed", F.col("node").alias("at")).join(e, "at").groupBy("seed", F.col("to").alias("node")).agg(F.countDistinct("link_type").alias("types"))
        frontier = checkpointed(nxt.join(met.select("seed", "node"), ["seed", "node"], "left_anti").select("seed", "node", F.lit(hop).alias("hop"), "types"))
        met = met.unionByName(frontier)
    return met.filter("hop > 0")


def fanout_in_source(links: DataFrame, pages: DataFrame, seeds: DataFrame, depth: int, direction: str = "out", limit: int = 200) -> DataFrame:
    """(seed, node, hop, types, rank): ``fanout`` that never leaves the seed's source and live pages, the ``limit`` nearest of each seed, fewest hops and then smallest ids first."""
    live = pages.filter("deleted_at is null").select("id", "source_id")
    a, b = live.select(F.col("id").alias("from_page_id"), F.col("source_id").alias("__sa")), live.select(F.col("id").alias("to_page_id"), F.col("source_id").alias("__sb"))
    own = checkpointed(links.join(a, "from_page_id").join(b, "to_page_id").filter("__sa = __sb").select("from_page_id", "to_page_id", "link_type", "link_source"))
    w = Window.partitionBy("seed").orderBy("hop", "node")
    return fanout(own, seeds, depth, direction).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def walk_edges(links: DataFrame, seeds: DataFrame, depth: int, link_type: str | None = None) -> DataFrame:
    """(seed, from_page_id, to_page_id, link_type, depth): the edges that a breadth-first walk along outgoing links follows, each once per level."""
    e = links.select("from_page_id", "to_page_id", "link_type").distinct()
    if link_type is not None:
        e = e.filter(F.col("link_type") == link_type)
    seen = seeds.select(F.col("id").alias("seed"), F.col("id").alias("node"))
    frontier, out = seen, None
    for d in range(1, depth + 1):
        step = checkpointed(frontier.join(e, frontier.node == e.from_page_id).select("seed", "from_page_id", "to_page_id", "link_type", F.lit(d).alias("depth")))
        out = step if out is None else out.unionByName(step)
        frontier = checkpointed(step.select("seed", F.col("to_page_id").alias("node")).distinct().join(seen, ["seed", "node"], "left_anti"))
        seen = seen.unionByName(frontier)
    return out


def connects(a: DataFrame, b: DataFrame) -> DataFrame:
    """Nodes that two fan-outs share: (node, hops), fewest hops first."""
    x, y = (w.groupBy("node").agg(F.min("hop").alias(n)) for w, n in ((a, "ha"), (b, "hb")))
    return x.join(y, "node").select("node", (F.col("ha") + F.col("hb")).alias("hops"))


def blast(links: DataFrame, seeds: DataFrame, depth: int = 5) -> DataFrame:
    """(seed, node, hop, confidence): what a change of a seed may reach along inbound edges, with confidence 1 / (1 + 0.3 hop) within 0.05 to 1."""
    c = F.least(F.greatest(1 / (1 + 0.3 * F.col("hop")), F.lit(0.05)), F.lit(1.0))
    return fanout(links, seeds, depth, "in", mentions=True).select("seed", "node", "hop", F.round(c, 6).alias("confidence"))


def edges_of(links: DataFrame, ids: DataFrame, direction: str = "both") -> DataFrame:
    """(id, other, link_type, way): the edges that leave, or reach, the asked nodes; both as the union of two equi-joins."""
    asked = ids.select(F.col("id")).distinct()
    out = links.select(F.col("from_page_id").alias("id"), F.col("to_page_id").alias("other"), "link_type", F.lit("out").alias("way")).join(asked, "id", "left_semi")
    back = links.select(F.col("to_page_id").alias("id"), F.col("from_page_id").alias("other"), "link_type", F.lit("in").alias("way")).join(asked, "id", "left_semi")
    return (out if direction == "out" else back if direction == "in" else out.unionAll(back)).distinct()


def traverse(pages: DataFrame, links: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(seed, id, slug, depth, out_links): every node of an outgoing walk at its fewest hops, the seed itself at 0, with its own outgoing links as sorted text ``type:target``."""
    live = pages.filter("deleted_at is null").select("id", "slug")
    w = fanout(links, seeds, depth, mentions=True).select("seed", F.col("node").alias("id"), F.col("hop").alias("depth"))
    w = w.unionByName(seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("depth")))
    out = links.select("from_page_id", F.concat_ws(":", "link_type", F.col("to_page_id").cast("string")).alias("l")).groupBy(F.col("from_page_id").alias("id")).agg(F.array_sort(F.collect_set("l")).alias("out_links"))
    return w.join(live, "id").join(out, "id", "left").select("seed", "id", "slug", "depth", F.coalesce("out_links", F.array().cast("array<string>")).alias("out_links"))


def expanded(hits: DataFrame, links: DataFrame, hops: int = 2, per_hop: int = 50) -> DataFrame:
    """(query_id, id, score, hop): hits (query_id, id, score) with their neighbours up to ``hops`` away at score / (1 + hop), the ``per_hop`` best new ones of each hop."""
    e = links.select(F.col("from_page_id").alias("id"), F.col("to_page_id").alias("to")).unionAll(links.select(F.col("to_page_id"), F.col("from_page_id"))).filter("id is not null and to is not null").distinct()
    met = hits.groupBy("query_id", "id").agg(F.max("score").alias("base")).withColumn("hop", F.lit(0))
    frontier = met
    for hop in range(1, hops + 1):
        nxt = frontier.select("query_id", "id", "base").join(e, "id").groupBy("query_id", F.col("to").alias("id")).agg(F.max("base").alias("base"))
        new = nxt.join(met.select("query_id", "id"), ["query_id", "id"], "left_anti")
        w = Window.partitionBy("query_id").orderBy(F.desc("base"), F.asc("id"))
        frontier = checkpointed(new.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= per_hop).select("query_id", "id", "base", F.lit(hop).alias("hop")))
        met = met.unionByName(frontier)
    return met.select("query_id", "id", (F.col("base") / (1 + F.col("hop"))).alias("score"), "hop")
