"""Keyword and vector search for many queries at once, rank fusion, boosts and result deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loregraph.functions.expressions import age_days, cosine, jaccard, recency, slugify, source_factor, stems, trigrams, words
from loregraph.operators.keywords import keyword_hits
from loregraph.operators.text import greedy_distinct, greedy_distinct_rows
from loregraph.operators.vectors import nearest
from loregraph.session import broadcast_if_small, checkpointed


def top(df: DataFrame, by: str | list[str], score: str, k: int, *ties: str, rank: str = "rank") -> DataFrame:
    """The ``k`` best rows per group by score, then by ``ties`` ascending, with their rank from 1."""
    w = Window.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(F.desc(score), *[F.asc(t) for t in ties])
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def keyword_scores(chunks: DataFrame, queries: DataFrame, text: str = "chunk_text", id_col: str = "id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, chunk_id, ``keep``, score): all terms of a query must occur; the score sums 1 + ln(term frequency).

    The terms of all queries are broadcast only if counted small; postings are made for query terms alone, before the shuffle. Columns of the chunks that later steps
    need go along, so that the chunks are read once.
    """
    terms = queries.select("query_id", F.array_distinct(words(F.col("query"))).alias("__t")).select("query_id", F.size("__t").alias("need"), F.explode("__t").alias("term"))
    tokens = chunks.select(F.col(id_col).alias("chunk_id"), *keep, F.explode(words(F.col(text))).alias("term")).join(broadcast_if_small(terms.select("term").distinct()), "term", "left_semi")
    # one shuffle by chunk serves the term frequencies and the scores
    tf = tokens.repartition("chunk_id").groupBy("chunk_id", *keep, "term").agg(F.count("*").alias("tf"))
    hit = tf.join(broadcast_if_small(terms), "term").groupBy("query_id", "need", "chunk_id", *keep).agg(F.count("*").alias("found"), F.sum(1 + F.log("tf")).alias("score"))
    return hit.filter("found = need").select("query_id", "chunk_id", *keep, "score")


def parse_websearch(queries: DataFrame) -> DataFrame:
    """(query_id, alt, terms, phrases, without): one row per alternative of a query in the syntax of web searches: words are all needed, "quoted words" must stand in this
    order, or separates alternatives, a hyphen before a word excludes it. Words are stemmed.
    """
    alt = queries.select("query_id", F.posexplode(F.split("query", r"(?i)\s+or\s+")).alias("alt", "q"))
    without = F.regexp_extract_all("q", F.lit(r"(?:^|\s)-([\p{L}\p{N}]+)"), 1)
    kept = F.regexp_replace("q", r"(?:^|\s)-[\p{L}\p{N}]+", " ")
    phrases = F.transform(F.regexp_extract_all("q", F.lit('"([^"]+)"'), 1), lambda p: F.array_join(stems(p), " "))
    got = alt.select("query_id", "alt", F.array_distinct(stems(kept)).alias("terms"), phrases.alias("phrases"), F.flatten(F.transform(without, stems)).alias("without"))
    return got.filter("size(terms) > 0")


def websearch_scores(chunks: DataFrame, queries: DataFrame, text: str = "chunk_text", id_col: str = "id") -> DataFrame:
    """(query_id, chunk_id, score) of queries in the syntax of ``parse_websearch``: sum of 1 + ln(term frequency), of the best alternative that fits."""
    alts = parse_websearch(queries)
    need = alts.select("query_id", "alt", F.size("terms").alias("need"), "phrases", "without", F.explode("terms").alias("term"))
    doc = chunks.select(F.col(id_col).alias("chunk_id"), stems(F.col(text)).alias("w"))
    tokens = doc.select("chunk_id", F.explode("w").alias("term")).join(broadcast_if_small(need.select("term").distinct()), "term", "left_semi")
    tf = tokens.repartition("chunk_id").groupBy("chunk_id", "term").agg(F.count("*").alias("tf")).join(broadcast_if_small(need.select("query_id", "alt", "need", "term")), "term")
    full = tf.groupBy("query_id", "alt", "need", "chunk_id").agg(F.count("*").alias("found"), F.sum(1 + F.log("tf")).alias("score")).filter("found = need")
    rules = broadcast_if_small(alts.select("query_id", "alt", "phrases", "without"))
    run = F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" "))
    fits = F.forall("phrases", lambda p: F.contains(run, F.concat(F.lit(" "), p, F.lit(" ")))) & ~F.arrays_overlap("w", "without")
    ok = full.join(rules, ["query_id", "alt"]).join(doc, "chunk_id").filter(fits)
    return ok.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))


def pool_pages(hits: DataFrame, chunks: DataFrame | None, pages: DataFrame, k: int, detail: str = "medium") -> DataFrame:
    """Scores times the source factor, the best chunk of each page, the top ``k`` pages per query. ``chunks`` may be left out if the hits carry page_id."""
    p = pages.select(F.col("id").alias("page_id"), "slug", "source_id", "type")
    h = (hits if chunks is None else hits.join(chunks.select(F.col("id").alias("chunk_id"), "page_id", "chunk_source"), "chunk_id")).join(p, "page_id")
    h = h.withColumn("score", F.round(F.col("score") * source_factor(F.col("slug"), detail), 6))
    best = top(h, ["query_id", "page_id"], "score", 1, "chunk_id")
    return top(best.drop("rank"), "query_id", "score", k, "page_id", "chunk_id")


def over_fetched(hits: DataFrame, chunks: DataFrame, pages: DataFrame, k: int, factor: int = 5) -> DataFrame:
    """Pooling over the ``factor`` x ``k`` best chunks of each query only, as an engine does that fetches more chunks than pages are wanted."""
    return pool_pages(top(hits, "query_id", "score", factor * k, "chunk_id").drop("rank"), chunks, pages, k)


def substring_scores(pages: DataFrame, queries: DataFrame, text: str) -> DataFrame:
    """Occurrences of a literal query, for scripts without word boundaries."""
    q = broadcast_if_small(queries)
    n = (F.length(text) - F.length(F.replace(F.col(text), F.col("query"), F.lit("")))) / F.length("query")
    return pages.join(q, F.contains(F.col(text), F.col("query"))).select("query_id", "id", n.cast("int").alias("score"))


def vector_hits(chunks: DataFrame, queries: DataFrame, k: int, vec: str = "embedding") -> DataFrame:
    """(query_id, chunk_id, score, rank): the ``k`` chunks of the greatest cosine."""
    return nearest(chunks, queries, k, vec=vec).withColumnRenamed("id", "chunk_id")


def rrf(arms: list[tuple[DataFrame, float]], key: str, k: int = 60, base: int = 0) -> DataFrame:
    """Weighted reciprocal rank fusion of rankings (query_id, key, rank from 1), relative to the best of a query.

    ``base`` is the rank that counts as the first: 0 adds 1 / (k / weight + rank), 1 the same with ranks from 1.
    """
    parts = [df.select("query_id", key, (1 / (F.lit(k / weight) + F.col("rank") - 1 + base)).alias("s")) for df, weight in arms]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionAll(p)
    s = union.groupBy("query_id", key).agg(F.sum("s").alias("rrf"))
    return s.withColumn("score", F.col("rrf") / F.max("rrf").over(Window.partitionBy("query_id")))


def compiled_boost(score: Column, chunk_source: Column, factor: float = 2.0) -> Column:
    return F.when(chunk_source == "compiled_truth", score * factor).otherwise(score)


def backlink_boost(score: Column, n: Column) -> Column:
    return score * (1 + 0.05 * F.log1p(n))


def salience_boost(score: Column, s: Column, k: float = 0.15) -> Column:
    return score * (1 + k * F.log1p(s))


def recency_boost(score: Column, slug: Column, days: Column, strength: float = 1.0) -> Column:
    return score * (1 + strength * recency(slug, days))


def title_boost(score: Column, title: Column, query: Column, factor: float = 1.25) -> Column:
    """Applies if the words of the query are the title, or at least two of them stand in it as a run."""
    t, q = F.array_join(words(title), " "), F.array_join(words(query), " ")
    run = (F.size(words(query)) >= 2) & F.contains(F.concat(F.lit(" "), t, F.lit(" ")), F.concat(F.lit(" "), q, F.lit(" ")))
    return F.when((t == q) | run, score * factor).otherwise(score)


def title_hits(pages: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id): pages whose title is a query's words, or holds at least two of them as a run; found by the first word of the query among those of the title."""
    q = queries.select("query_id", words(F.col("query")).alias("__q")).filter("size(__q) > 0").select("query_id", "__q", F.col("__q")[0].alias("w"))
    t = pages.select("id", words(F.col("title")).alias("__t")).select("id", "__t", F.posexplode("__t").alias("__p", "w"))
    hit = t.join(broadcast_if_small(q), "w").filter(F.slice("__t", F.col("__p") + 1, F.size("__q")) == F.col("__q"))
    return hit.filter((F.size("__q") >= 2) | (F.size("__t") == 1)).select("query_id", "id").distinct()


def exact_hits(pages: DataFrame, queries: DataFrame, strong: float = 1.25, weak: float = 1.10) -> DataFrame:
    """(query_id, id, factor): strong if the query is the title or the slug's last segment, weak if that ends in it after a hyphen; found by equality with the title and with all such ends."""
    q = queries.select("query_id", F.lower(F.trim("query")).alias("__title"), slugify(F.col("query")).alias("__slug"))
    tail = F.substring_index("slug", "/", -1)
    parts = F.split(tail, "-")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, i, F.size(parts)), "-").alias("__slug"), F.when(i == 1, strong).otherwise(weak).alias("factor")))
    by_slug = pages.select("id", F.inline(ends)).join(broadcast_if_small(q.filter("__slug <> ''")), "__slug").select("query_id", "id", "factor")
    by_title = pages.select("id", F.lower(F.trim("title")).alias("__title")).join(broadcast_if_small(q), "__title").select("query_id", "id", F.lit(strong).alias("factor"))
    return by_slug.unionAll(by_title).groupBy("query_id", "id").agg(F.max("factor").alias("factor"))


def evidence(alias: Column, title: Column, base: Column) -> Column:
    return F.when(alias, "alias").when(title, "title").when(base >= 0.85, "strong").when(base >= 0.60, "medium").otherwise("weak")


def dedup_results(results: DataFrame, *, per_page: int = 3, share: float = 0.6, cap: int = 2, alike: float | None = None, texts: DataFrame | None = None) -> DataFrame:
    """Of each query's results (query_id, page_id, chunk_id, type, score): the best per page, without texts (chunk_text, of the results or of ``texts`` by chunk_id) nearer than
    ``alike`` to a better one if that is given, at most a share per type, then at most ``cap`` per page.
    """
    r = top(results, ["query_id", "page_id"], "score", per_page, "chunk_id", rank="__page").drop("__page")
    if texts is not None:
        r = greedy_distinct_rows(r, texts, "query_id", ["score", "page_id", "chunk_id"], [False, True, True], "chunk_id", "chunk_text", alike)
    elif alike is not None:
        r = greedy_distinct(r, "query_id", ["score", "page_id", "chunk_id"], [False, True, True], "chunk_text", alike)
    most = F.ceil(F.count("*").over(Window.partitionBy("query_id")) * share)
    r = r.withColumn("__most", most)
    w = Window.partitionBy("query_id", "type").orderBy(F.desc("score"), F.asc("page_id"), F.asc("chunk_id"))
    r = r.withColumn("__t", F.row_number().over(w)).filter("__t <= __most").drop("__t", "__most")
    return top(r, ["query_id", "page_id"], "score", cap, "chunk_id", rank="__page").drop("__page")


def similar_titles(pages: DataFrame, least: float, title: str = "title") -> DataFrame:
    """(a, b, similarity) of pages of one type whose titles have a trigram similarity of at least ``least``, equal titles once by representative.

    Distinct titles are joined on their rarest trigrams: a pair of the wanted similarity shares one of the first n - ceil(least x n) + 1 in order of rarity (prefix filter).
    """
    t = pages.filter(F.col(title).isNotNull()).groupBy("type", F.lower(title).alias("t")).agg(F.min("id").alias("id")).withColumn("g", trigrams(F.col("t"))).filter(F.size("g") > 0)
    df = t.select(F.explode("g").alias("x")).groupBy("x").agg(F.count("*").alias("df"))
    ranked = t.select("type", "id", F.size("g").alias("n"), F.explode("g").alias("x")).join(df, "x").withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("df", "x")))
    keys = ranked.filter(F.col("r") <= F.col("n") - F.ceil(F.col("n") * least) + 1).select("type", "x", "id")
    cand = keys.withColumnRenamed("id", "a").join(keys.withColumnRenamed("id", "b"), ["type", "x"]).filter("a < b").select("a", "b").distinct()
    g = t.select("id", "g")
    j = cand.join(g.select(F.col("id").alias("a"), F.col("g").alias("ga")), "a").join(g.select(F.col("id").alias("b"), F.col("g").alias("gb")), "b")
    return j.select("a", "b", F.round(jaccard(F.col("ga"), F.col("gb")), 6).alias("similarity")).filter(F.col("similarity") >= least)


def effective_confidence(conf: Column, age: Column, kind: Column, half: dict[str, float], default: float) -> Column:
    """confidence x exp(-age / h) by kind; facts of the future do not decay."""
    h = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in half.items()], F.lit(default))
    return conf * F.exp(-F.greatest(age, F.lit(0.0)) / h)


def expert_score(raw: Column, days: Column, salience: Column) -> Column:
    return F.log1p(raw) * F.greatest(F.lit(0.1), F.exp(-days / 180)) * (0.5 + 0.5 * salience / (1 + salience))


def guarantee_compiled(kept: DataFrame, results: DataFrame) -> DataFrame:
    """Pages among ``kept`` (query_id, page_id, chunk_id, chunk_source, score, ...) without a chunk of their compiled truth get the best one of ``results`` for their lowest chunk."""
    mine = Window.partitionBy("query_id", "page_id")
    k = kept.withColumn("__has", F.max((F.col("chunk_source") == "compiled_truth").cast("int")).over(mine)).withColumn("__low", F.row_number().over(mine.orderBy("score", F.desc("chunk_id"))))
    best = top(results.filter("chunk_source = 'compiled_truth'"), ["query_id", "page_id"], "score", 1, "chunk_id").select("query_id", "page_id", *[F.struct(*[c for c in kept.columns if c not in ("query_id", "page_id")]).alias("__new")])
    j = k.join(best, ["query_id", "page_id"], "left")
    swap = (F.col("__has") == 0) & (F.col("__low") == 1) & F.col("__new").isNotNull()
    return j.select("query_id", "page_id", *[F.when(swap, F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) for c in kept.columns if c not in ("query_id", "page_id")]).select(*kept.columns)


def query_adjacency(results: DataFrame, links: DataFrame, pages: DataFrame) -> DataFrame:
    """(query_id, page_id, inbound, foreign_sources): the other results of the same query that link to a result, and the other sources they are of."""
    r = results.select("query_id", "page_id").distinct().join(pages.select(F.col("id").alias("page_id"), "source_id"), "page_id")
    a, b = (r.select("query_id", F.col("page_id").alias(p), F.col("source_id").alias(s)) for p, s in (("from_page_id", "sa"), ("to_page_id", "sb")))
    e = links.select("from_page_id", "to_page_id").distinct().join(a, "from_page_id").join(b, ["query_id", "to_page_id"]).filter("from_page_id <> to_page_id")
    return e.groupBy("query_id", F.col("to_page_id").alias("page_id")).agg(F.countDistinct("from_page_id").alias("inbound"), F.countDistinct(F.when(F.col("sa") != F.col("sb"), F.col("sa"))).alias("foreign_sources"))


def fused_scores(pages: DataFrame, chunks: DataFrame, links: DataFrame, queries: DataFrame, as_of: str, *, arm: int = 100, floor: float = 0.5, aliases: DataFrame | None = None) -> DataFrame:
    """Keyword and vector arms for all queries (query_id, query, embedding) of live pages, fused by reciprocal ranks, with the boosts for compiled truth and source, and, for chunks of at
    least ``floor`` of the query's best, those for backlinks, salience, recency, titles and exact matches: query_id, page_id, chunk_id, chunk_source, slug, type, score.
    """
    queries = checkpointed(queries.select("query_id", "query", "embedding"))  # read by both arms and the boosts
    kw = keyword_hits(chunks, queries, arm)
    ve = vector_hits(chunks, queries, arm)
    fused = rrf([(kw, 1.0), (ve, 1.0)], "chunk_id").join(chunks.select(F.col("id").alias("chunk_id"), "page_id", "chunk_source"), "chunk_id")
    p = pages.filter(F.col("deleted_at").isNull()).select(F.col("id").alias("page_id"), "slug", "title", "type", F.coalesce(F.col("emotional_weight").cast("double"), F.lit(0.0)).alias("weight"), F.coalesce("effective_date", "updated_at", "created_at").alias("at"))
    n = links.filter(~F.col("link_source").eqNullSafe("mentions")).groupBy(F.col("to_page_id").alias("page_id")).agg(F.count("*").alias("n"))
    r = fused.join(p, "page_id").join(n, "page_id", "left").join(broadcast_if_small(queries.select("query_id", "query")), "query_id")
    r = r.withColumn("score", F.round(compiled_boost(F.col("score"), F.col("chunk_source")) * source_factor(F.col("slug")), 9)).withColumn("best", F.max("score").over(Window.partitionBy("query_id")))
    s = salience_boost(backlink_boost(F.col("score"), F.coalesce("n", F.lit(0))), F.col("weight"))
    s = recency_boost(s, F.col("slug"), age_days(F.col("at"), as_of), 0.5)
    s = exact_match_boost(title_boost(s, F.col("title"), F.col("query")), F.col("slug"), F.col("title"), F.col("query"))
    r = r.withColumn("score", F.round(floored(F.col("score"), s, F.col("best"), floor), 6)).select("query_id", "page_id", "chunk_id", "chunk_source", "slug", "type", "score")
    return r if aliases is None else alias_hop(r, aliases, queries)


def hybrid_search(pages: DataFrame, chunks: DataFrame, links: DataFrame, queries: DataFrame, as_of: str, k: int = 10, *, aliases: DataFrame | None = None) -> DataFrame:
    """The whole pipeline: fused and boosted arms, the four layers of deduplication and the guarantee of a compiled chunk, graph signals over the best 20, the top ``k``."""
    r = checkpointed(fused_scores(pages, chunks, links, queries, as_of, aliases=aliases))  # a few hundred rows a query, read several times below
    text = chunks.select(F.col("id").alias("chunk_id"), "chunk_text")
    d = checkpointed(guarantee_compiled(dedup_results(r, alike=0.85, texts=text), r))
    g = graph_signals(d, query_adjacency(d, links, pages))
    return top(g.withColumn("score", F.round("score", 6)), "query_id", "score", k, "page_id", "chunk_id").select("query_id", "page_id", "chunk_id", "score", "rank")


def cosine_rescore(fused: DataFrame, vectors: DataFrame, queries: DataFrame, vec: str = "embedding", weight: float = 0.7) -> DataFrame:
    """weight x score / best + (1 - weight) x cosine, for fused rows (query_id, chunk_id, score); rows without a usable vector keep their relative score."""
    v = vectors.filter(F.exists(vec, lambda x: x != 0)).select(F.col("id").alias("chunk_id"), F.col(vec).alias("v"))
    q = broadcast_if_small(queries.select("query_id", F.col(vec).alias("qv")), 2_000)
    r = fused.join(v, "chunk_id", "left").join(q, "query_id", "left")
    base = F.col("score") / F.max("score").over(Window.partitionBy("query_id"))
    return r.select("query_id", "chunk_id", F.when(F.size("v") == F.size("qv"), weight * base + (1 - weight) * cosine(F.col("v"), F.col("qv"))).otherwise(base).alias("score"))


def floored(score: Column, boosted: Column, best: Column, ratio: float) -> Column:
    """Boosts apply only to rows of at least ``ratio`` of the best score."""
    return F.when(score >= ratio * best, boosted).otherwise(score)


def exact_match_boost(score: Column, slug: Column, title: Column, query: Column, strong: float = 1.25, weak: float = 1.10) -> Column:
    """Strong if the query is the title or the slug's last segment, weak if the slug ends in it after a hyphen."""
    s, tail = slugify(query), F.substring_index(slug, "/", -1)
    return F.when((F.lower(F.trim(title)) == F.lower(F.trim(query))) | (tail == s), score * strong).when(F.endswith(tail, F.concat(F.lit("-"), s)), score * weak).otherwise(score)


def graph_signals(results: DataFrame, adjacency: DataFrame, head: int = 20, hub: float = 1.05, foreign: float = 1.10, session: float = 0.95) -> DataFrame:
    """Within the best ``head`` results (query_id, page_id, slug, score, ...): pages with two inbound results, or two foreign sources, rise; then all but the best page of a folder
    sink. Results beyond the head keep their scores. ``adjacency`` is by query_id and page_id, or by id for all queries.
    """
    adj, on = (adjacency, ["query_id", "page_id"]) if "query_id" in adjacency.columns else (adjacency.withColumnRenamed("id", "page_id"), ["page_id"])
    ties = [F.asc("page_id"), *([F.asc("chunk_id")] if "chunk_id" in results.columns else [])]
    r = results.withColumn("__rn", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), *ties))).withColumn("__head", F.col("__rn") <= head).join(adj, on, "left")
    up = F.when(F.coalesce("inbound", F.lit(0)) >= 2, hub).otherwise(1.0) * F.when(F.coalesce("foreign_sources", F.lit(0)) >= 2, foreign).otherwise(1.0)
    r = r.withColumn("score", F.when(F.col("__head"), F.col("score") * up).otherwise(F.col("score"))).withColumn("__folder", F.regexp_extract("slug", r"^(.*)/[^/]*$", 1))
    place = F.row_number().over(Window.partitionBy("query_id", "__folder", "__head").orderBy(F.desc("score"), *ties))
    r = r.withColumn("__place", place)
    return r.withColumn("score", F.when(F.col("__head") & (F.col("__place") > 1) & (F.col("__folder") != ""), F.col("score") * session).otherwise(F.col("score"))).select(*results.columns)


def alias_hop(results: DataFrame, aliases: DataFrame, queries: DataFrame, boost: float = 1.10, most: int = 3) -> DataFrame:
    """Pages whose alias (alias, page_id) is the whole query are boosted if they are among the results (query_id, page_id, score, ...), else put on top, ``most`` at most."""
    norm = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    hit = queries.select("query_id", norm(F.col("query")).alias("a")).join(aliases.select(norm(F.col("alias")).alias("a"), "page_id"), "a").select("query_id", "page_id").distinct().withColumn("hit", F.lit(True))
    present = results.join(hit, ["query_id", "page_id"], "left").withColumn("score", F.when(F.col("hit"), F.col("score") * boost).otherwise(F.col("score"))).select(*results.columns)
    best = present.groupBy("query_id").agg(F.max("score").alias("best"))
    new = hit.join(results.select("query_id", "page_id").distinct(), ["query_id", "page_id"], "left_anti").join(best, "query_id", "left").withColumn("rn", F.row_number().over(Window.partitionBy("query_id").orderBy("page_id"))).filter(F.col("rn") <= most)
    return present.unionByName(new.select("query_id", "page_id", (F.coalesce("best", F.lit(0.0)) + 1e-6).alias("score")), allowMissingColumns=True)


def alias_target_boost(results: DataFrame, aliases: DataFrame, factor: float = 1.05) -> DataFrame:
    """Results (page_id, score, ...) that are the page of some alias rise a little."""
    target = aliases.select("page_id").distinct().withColumn("__hit", F.lit(True))
    return results.join(target, "page_id", "left").withColumn("score", F.when(F.col("__hit"), F.col("score") * factor).otherwise(F.col("score"))).select(*results.columns)


def reranked(results: DataFrame, scorer: Column, head: int = 30) -> DataFrame:
    """The best ``head`` results of each query in the order of a scorer the caller gives (a column, null where it fails); those it does not score keep their places below, as does the rest."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("page_id"), F.asc("chunk_id"))
    r = results.withColumn("__rn", F.row_number().over(w)).withColumn("__s", F.when(F.col("__rn") <= head, scorer))
    order = [F.when(F.col("__rn") > head, 2).when(F.col("__s").isNull(), 1).otherwise(0), F.desc_nulls_last("__s"), F.asc("__rn")]
    return r.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).select(*results.columns, "rank")


def explained(**factors: Column) -> Column:
    """One line that names the factors other than 1 of a score, in the order given."""
    parts = [F.when(F.round(c, 3) != 1, F.concat(F.lit(f"{n} x"), F.format_number(c, 3))) for n, c in factors.items()]
    return F.concat_ws(", ", *parts)
