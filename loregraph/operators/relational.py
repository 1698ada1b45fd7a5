"""Questions about relations: parsed by verbs, walked along the links from the pages they name."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loregraph.operators.graph import fanout
from loregraph.operators.resolve import resolve_names
from loregraph.session import broadcast_if_small, checkpointed

#: (verbs of "who ... X", link types that answer them); all are walked against their direction.
WHO = (
    (r"invest(?:ed|s) in|funded|backed|backs|led the (?:seed|round|series \w) in", ("invested_in", "led_round")), (r"(?:co-?)?founded|started", ("founded",)), (r"advise[sd]", ("advises",)),
    (r"work(?:s|ed) (?:at|for)", ("works_at",)), (r"attended", ("attended",)),
)
PRONOUNS = frozenset("it that this them these those here there everyone anyone someone anybody somebody people things us me him her you who what which".split())
LONGEST = 512
_X = r"(.{1,80}?)"


def _patterns() -> list[tuple[re.Pattern, str, tuple[str, ...] | None, str]]:
    """(pattern, kind, link types, direction), from the special to the general."""
    p = [
        (rf"\b(?:what|which)\b.*?\b(?:connects?|links?|ties? together|(?:connection|link|relationship) between)\s+{_X}\s+(?:and|to|with|&)\s+{_X}\s*\??$", "connects", None, "both"),
        (rf"\bhow (?:are|is|do|does)\s+{_X}\s+(?:and|&)\s+{_X}\s+(?:connected|related|linked|associated)\b", "connects", None, "both"),
        (rf"\bwho (?:introduced|connected|referred) (?:me|us|him|her|them) to\s+{_X}\s*\??$", "intro", None, "both"),
        (rf"\bwho (?:at|from|in)\s+{_X}\s+(?:works?(?: on)?|leads?|runs?|builds?|owns?|handles?|manages?)\b", "who_at", ("works_at",), "in"),
    ]
    p += [(rf"\bwho (?:{verbs})\s+{_X}\s*\??$", "who_rel", types, "in") for verbs, types in WHO]
    p += [(rf"\bwhat (?:companies |startups |deals )?(?:has |have |did |does )?{_X}\s+invest(?:ed)? in\b", "who_rel", ("invested_in", "led_round"), "out"), (rf"\bwhere (?:does|did|has)\s+{_X}\s+work\b", "who_rel", ("works_at",), "out")]
    return [(re.compile(x, re.I), kind, types, way) for x, kind, types, way in p]


_PATTERNS = _patterns()


def parse_question(question: str | None) -> tuple[str, list[str], list[str] | None, str] | None:
    """(kind, seeds, link types or None for any, direction) of a question about relations; None if it is none, or names no one."""
    if not question or len(question) > LONGEST:
        return None
    for pattern, kind, types, way in _PATTERNS:
        if m := pattern.search(question.strip()):
            seeds = [re.sub(r"(?i)^(?:the|an?)\s+", "", s.strip().rstrip("?").strip("\"'`")).strip() for s in m.groups()]
            if all(s and s.lower() not in PRONOUNS for s in seeds):
                return kind, seeds, list(types) if types else None, way
    return None


def parse_questions(queries: DataFrame) -> DataFrame:
    """(query_id, kind, seed_no, seed, types, direction) of the questions (query_id, query) about relations; the queries are a small, counted set."""

    def run(batches):
        for b in batches:
            got = [(i, *p) for i, t in zip(b["query_id"], b["query"]) if (p := parse_question(t))]
            yield pd.DataFrame([(i, kind, k, s, types, way) for i, kind, seeds, types, way in got for k, s in enumerate(seeds)], columns=["query_id", "kind", "seed_no", "seed", "types", "direction"])

    return queries.select(F.col("query_id").cast("long").alias("query_id"), "query").mapInPandas(run, "query_id long, kind string, seed_no int, seed string, types array<string>, direction string")


def relational_hits(queries: DataFrame, pages: DataFrame, links: DataFrame, depth: int = 1, k: int = 50) -> DataFrame:
    """(query_id, page_id, hops, rank): the pages that answer questions about relations, fewest hops first, then by slug; the rank is the place in the list.

    Seeds are resolved to pages, links of the asked types are walked from them; for two seeds the pages that both walks reach.
    """
    asked = checkpointed(parse_questions(queries))
    spark, live = pages.sparkSession, pages.filter("deleted_at is null")
    slugs = resolve_names(asked.select(F.col("seed").alias("name")), live, links).filter("how <> 'new'").select(F.col("name").alias("seed"), "slug")
    seeds = checkpointed(asked.join(broadcast_if_small(slugs), "seed").join(live.groupBy("slug").agg(F.min("id").alias("id")), "slug"))
    walks = spark.createDataFrame([], "query_id long, seed_no int, node long, hop int")
    e = links.select("from_page_id", "to_page_id", "link_type").distinct()
    step = e.select(F.col("from_page_id").alias("id"), F.col("to_page_id").alias("node"), "link_type")
    back = e.select(F.col("to_page_id").alias("id"), F.col("from_page_id").alias("node"), "link_type")
    for way, typed in sorted(tuple(r) for r in seeds.select("direction", F.col("types").isNotNull()).distinct().collect()):  # six at most
        some = seeds.filter((F.col("direction") == way) & (F.col("types").isNotNull() == F.lit(typed)))
        if typed:
            # the few sets of types are walked together: an edge counts for a seed if its type is asked for
            steps = step if way == "out" else back if way == "in" else step.union(back)
            got = some.join(steps, "id").filter(F.array_contains("types", F.col("link_type"))).select("query_id", "seed_no", "node", F.lit(1).alias("hop"))
        else:
            w = fanout(links, some.select("id").distinct(), depth + 1, way)
            got = some.join(w.withColumnRenamed("seed", "id"), "id").select("query_id", "seed_no", "node", "hop")
        walks = walks.unionByName(got)
    need = asked.groupBy("query_id").agg((F.max("seed_no") + 1).alias("need"))
    per = walks.groupBy("query_id", "seed_no", "node").agg(F.min("hop").alias("hop")).groupBy("query_id", "node").agg(F.count("*").alias("n"), F.sum("hop").alias("hops"))
    hit = per.join(need, "query_id").filter("n = need").join(live.select(F.col("id").alias("node"), "slug"), "node").join(seeds.select("query_id", F.col("id").alias("node")), ["query_id", "node"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("hops", "slug", "node"))
    return hit.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("node").alias("page_id"), "hops", "rank")
