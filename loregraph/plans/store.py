"""Registered reads and writes, each with its DuckDB statement beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loregraph.operators import store as W
from loregraph.session import table

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def q(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


AT = "2025-06-01 00:00:00"
_LIVE = "(SELECT * FROM pages WHERE deleted_at IS NULL)"
_TAKES = """(SELECT o_custkey % 100 AS page_id, o_orderkey AS row_num, o_custkey % 7 AS holder, o_orderpriority AS domain, (o_orderkey % 101) / 100.0::DOUBLE AS weight,
    CASE o_orderstatus WHEN 'F' THEN 'correct' WHEN 'O' THEN 'incorrect' END AS quality, o_orderkey % 3 > 0 AS active, CASE WHEN o_orderkey % 5 = 0 THEN 'private' ELSE 'public' END AS visibility, o_orderdate AS since FROM orders)"""


def takes(spark, d) -> DataFrame:
    """Orders as claims on a hundred pages."""
    quality = F.when(F.col("o_orderstatus") == "F", "correct").when(F.col("o_orderstatus") == "O", "incorrect")
    return table(spark, d, "orders").select(
        (F.col("o_custkey") % 100).alias("page_id"), F.col("o_orderkey").alias("row_num"), (F.col("o_custkey") % 7).alias("holder"), F.col("o_orderpriority").alias("domain"), (F.pmod("o_orderkey", F.lit(101)) / 100).alias("weight"),
        quality.alias("quality"), (F.col("o_orderkey") % 3 > 0).alias("active"), F.when(F.col("o_orderkey") % 5 == 0, "private").otherwise("public").alias("visibility"), F.col("o_orderdate").alias("since"),
    )


def daily(spark, d):
    return table(spark, d, "pages").filter("type = 'daily'")


@q(f"SELECT id, slug FROM {_LIVE} WHERE slug = (SELECT min(slug) FROM pages) ORDER BY source_id, id LIMIT 1")
def get_page(spark, d):
    p = table(spark, d, "pages")
    return W.get_page(p, p.agg(F.min("slug")).first()[0]).select("id", "slug")


@q("SELECT DISTINCT source_id, slug FROM pages")
def all_page_refs(spark, d):
    return W.page_refs(table(spark, d, "pages"))


@q("SELECT id FROM pages WHERE type <> 'daily'")
def deleted_pages(spark, d):
    return W.delete_pages(table(spark, d, "pages"), daily(spark, d))[0].select("id")


@q("SELECT source_id, slug FROM pages WHERE type = 'daily'")
def confirmed_deletions(spark, d):
    return W.delete_pages(table(spark, d, "pages"), daily(spark, d).unionByName(daily(spark, d).withColumn("slug", F.lit("none/such"))))[1]


@q("SELECT id, CASE WHEN type = 'daily' THEN coalesce(deleted_at, TIMESTAMP '2025-06-01') ELSE deleted_at END AS deleted_at FROM pages")
def soft_deleted_pages(spark, d):
    return W.soft_delete(table(spark, d, "pages"), daily(spark, d), AT).select("id", "deleted_at")


@q("SELECT id, CASE WHEN type <> 'note' THEN deleted_at END AS deleted_at FROM pages")
def restored_pages(spark, d):
    p = table(spark, d, "pages")
    return W.restore(p, p.filter("type = 'note'")).select("id", "deleted_at")


@q(f"SELECT import_filename AS path, source_id, slug FROM {_LIVE} WHERE import_filename IN (SELECT import_filename FROM pages WHERE id % 20 = 0)")
def slugs_by_paths(spark, d):
    p = table(spark, d, "pages")
    return W.slugs_by_paths(p, p.filter("id % 20 = 0").select(F.col("import_filename").alias("path")))


@q("SELECT id, CASE WHEN type = 'daily' THEN slug || '-moved' ELSE slug END AS slug FROM pages")
def renamed_pages(spark, d):
    return W.update_slugs(table(spark, d, "pages"), daily(spark, d).withColumn("new_slug", F.concat("slug", F.lit("-moved")))).select("id", "slug")


@q("SELECT id, CASE WHEN type = 'daily' THEN upper(title) ELSE title END AS title FROM pages")
def refreshed_pages(spark, d):
    return W.update_pages(table(spark, d, "pages"), daily(spark, d).select("id", F.upper("title").alias("title")), "title").select("id", "title")


@q("""SELECT id, round(CASE WHEN id % 2 = 0 THEN 0.25 ELSE emotional_weight::DOUBLE END, 6) AS weight, id % 2 = 0 AND emotional_weight::DOUBLE IS DISTINCT FROM 0.25 AS touched FROM pages""")
def written_weights(spark, d):
    p = table(spark, d, "pages")
    w = W.set_emotional_weights(p, p.filter("id % 2 = 0").select("id", F.lit(0.25).alias("weight")), AT)
    return w.select("id", F.round("emotional_weight", 6).alias("weight"), F.col("touched_at").isNotNull().alias("touched"))


@q("SELECT slug, max(coalesce(updated_at, created_at)) AS at FROM pages GROUP BY 1")
def page_timestamps(spark, d):
    return W.page_timestamps(table(spark, d, "pages"))


def _versions(spark, d):
    none = spark.createDataFrame([], "page_id long, version int, title string, compiled_truth string, timeline string, at timestamp_ntz")
    p = table(spark, d, "pages")
    return W.snapshot(W.snapshot(none, p, AT), p.withColumn("title", F.upper("title")).filter("type = 'daily'"), AT)


@q("SELECT id AS page_id, 1 AS version, title FROM pages UNION ALL SELECT id, 2, upper(title) FROM pages WHERE type = 'daily'")
def page_versions(spark, d):
    return _versions(spark, d).select("page_id", "version", "title")


@q("SELECT id, CASE WHEN type = 'daily' THEN upper(title) ELSE title END AS title, compiled_truth FROM pages")
def reverted_pages(spark, d):
    return W.revert(table(spark, d, "pages"), _versions(spark, d), 2).select("id", "title", "compiled_truth")


@q("SELECT id, source_id FROM ingest_log ORDER BY created_at DESC NULLS LAST, id DESC LIMIT 50")
def newest_ingests(spark, d):
    return W.newest(table(spark, d, "ingest_log"), 50).select("id", "source_id")


@q("SELECT id FROM ingest_log WHERE created_at >= TIMESTAMP '2023-01-01' AND source_id = 'default' ORDER BY created_at DESC, id DESC LIMIT 100")
def logged_since(spark, d):
    return W.logged_since(table(spark, d, "ingest_log"), "2023-01-01 00:00:00", 100, source_id="default").select("id")


@q("SELECT id FROM ingest_log WHERE created_at IS NULL OR created_at >= TIMESTAMP '2023-06-01'")
def retained_log(spark, d):
    return W.retained(table(spark, d, "ingest_log"), "2023-06-01 00:00:00").select("id")


@q("SELECT id, (id * 3) % 7 > 3 AS fresh FROM sources UNION ALL SELECT 'new', true")
def raw_data_upsert(spark, d):
    """Blobs by source, replaced by newer ones; the last of repeated keys counts."""
    s = table(spark, d, "sources")
    n = s.select("id", F.length("id").alias("v"))
    return W.upsert(n, n.unionByName(n.withColumn("v", F.col("v") + 1)).unionByName(spark.createDataFrame([("new", 9)], "id string, v int")), ["id"], "v").select("id", F.col("v").cast("int").alias("v"))


ORACLES["raw_data_upsert"] = "SELECT id, (length(id) + 1)::INT AS v FROM sources UNION ALL SELECT 'new', 9"


@q("SELECT min(id) AS id, source_ref FROM ingest_log GROUP BY source_ref")
def runs_written_once(spark, d):
    """An append that is idempotent on its key: every run again gives nothing new."""
    log = table(spark, d, "ingest_log")
    first = log.groupBy("source_ref").agg(F.min("id").alias("id"))
    return W.insert_new(first, log.select("source_ref", "id"), ["source_ref"])


@q("SELECT id, json_extract_string(config, '$.patched') AS patched, true AS kept FROM (SELECT id, json_merge_patch(config, '{\"patched\": \"yes\"}') AS config FROM sources)")
def patched_sources(spark, d):
    s = table(spark, d, "sources")
    got = W.patch_configs(s, s.select("id", F.lit('{"patched": "yes", "gone": null}').alias("patch"))).select("id", F.col("config").alias("c"))
    keys = F.json_object_keys(F.col("config"))
    kept = F.size(F.array_except(keys, F.json_object_keys("c"))) == 0
    return s.select("id", "config").join(got, "id").select("id", F.get_json_object("c", "$.patched").alias("patched"), kept.alias("kept"))


@q("SELECT id, page_id, chunk_index FROM content_chunks WHERE page_id IN (SELECT id FROM pages WHERE type = 'daily')")
def page_chunks(spark, d):
    return W.page_chunks(table(spark, d, "content_chunks"), daily(spark, d)).select("id", "page_id", "chunk_index")


@q("SELECT id, len(embedding) AS n FROM content_chunks WHERE model = 'embed-v2' AND embedding IS NOT NULL AND len(embedding) = 64 AND id % 20 = 0")
def vectors_by_ids(spark, d):
    c = table(spark, d, "content_chunks")
    return W.vectors_by_ids(c, c.filter("id % 20 = 0")).select("id", F.size("v").cast("long").alias("n"))


@q("""WITH o AS (SELECT * FROM content_chunks QUALIFY row_number() OVER (PARTITION BY page_id, chunk_index ORDER BY embedded_at DESC NULLS LAST, id DESC) = 1)
    SELECT page_id, chunk_index, count(*) AS n, bool_or(embedding IS NOT NULL) AS has FROM (SELECT page_id, chunk_index, embedding FROM content_chunks WHERE page_id % 2 = 1 OR page_id NOT IN (SELECT page_id FROM content_chunks WHERE chunk_index > 0)
    UNION ALL SELECT page_id, chunk_index, CASE WHEN page_id % 4 = 0 THEN embedding END FROM o WHERE page_id % 2 = 0 AND chunk_index > 0) GROUP BY 1, 2""")
def upserted_chunks(spark, d):
    """New chunks of the pages with an even id without their first one: those of every fourth page with the same text, the others with another; none has a vector."""
    c = table(spark, d, "content_chunks")
    text = F.when(F.col("page_id") % 4 == 0, F.col("chunk_text")).otherwise(F.concat("chunk_text", F.lit("!")))
    o = W.latest(c, ["page_id", "chunk_index"], "embedded_at", "id")
    new = o.filter("page_id % 2 = 0 and chunk_index > 0").withColumn("chunk_text", text).withColumn("embedding", F.lit(None).cast("array<float>")).withColumn("embedded_at", F.lit(None).cast("timestamp_ntz"))
    return W.upsert_chunks(c, new).groupBy("page_id", "chunk_index").agg(F.count("*").alias("n"), F.max(F.col("embedding").isNotNull()).alias("has"))


@q("SELECT id FROM content_chunks WHERE page_id NOT IN (SELECT id FROM pages WHERE type = 'daily')")
def deleted_chunks(spark, d):
    return W.delete_chunks(table(spark, d, "content_chunks"), daily(spark, d)).select("id")


@q(f"""SELECT c.id, p.slug FROM content_chunks c JOIN {_LIVE} p ON p.id = c.page_id WHERE chunk_source = 'compiled_truth' AND type IN ('note', 'daily', 'meeting', 'concept')
    AND coalesce(effective_date, updated_at, p.created_at) > TIMESTAMP '2021-06-01' AND coalesce(effective_date, updated_at, p.created_at) < TIMESTAMP '2024-06-01'""")
def filtered_chunks(spark, d):
    return W.search_filter(table(spark, d, "content_chunks"), table(spark, d, "pages"), detail="low", types=["note", "daily", "meeting", "concept"], after="2021-06-01", before="2024-06-01").select("id", "slug")


@q(f"SELECT c.id, p.slug FROM content_chunks c JOIN {_LIVE} p ON p.id = c.page_id WHERE language = 'markdown'")
def chunks_of_language(spark, d):
    return W.search_filter(table(spark, d, "content_chunks"), table(spark, d, "pages"), language="markdown").select("id", "slug")


def signatures(spark, d):
    return table(spark, d, "pages").select(F.col("id").alias("page_id"), F.when(F.col("id") % 3 == 0, "old").when(F.col("id") % 3 == 1, "new").alias("signature"))


@q("""SELECT c.id FROM content_chunks c JOIN pages p ON p.id = c.page_id WHERE coalesce(json_extract_string(frontmatter, '$.embed_skip'), '') <> 'true' AND (embedding IS NULL OR page_id % 3 = 0)""")
def stale_by_signature(spark, d):
    return W.stale_for_embedding(table(spark, d, "content_chunks"), table(spark, d, "pages"), signatures(spark, d), "new").select("id")


@q("SELECT id, embedding IS NOT NULL AND page_id % 3 <> 0 AS has FROM content_chunks")
def dropped_vectors(spark, d):
    return W.drop_stale_vectors(table(spark, d, "content_chunks"), signatures(spark, d), "new").select("id", F.col("embedding").isNotNull().alias("has"))


def marks(spark, d):
    return table(spark, d, "pages").filter("id % 4 > 0").select("id", F.when(F.col("id") % 4 == 1, F.lit("2020-01-01")).otherwise(F.lit("2024-01-01")).cast("timestamp_ntz").alias("extracted_at"))


@q(f"SELECT id FROM {_LIVE} WHERE id % 4 <= 1 OR updated_at > TIMESTAMP '2024-01-01'")
def stale_for_extraction(spark, d):
    return W.stale_for_extraction(table(spark, d, "pages"), marks(spark, d), "2022-01-01 00:00:00").select("id")


@q("SELECT id, CASE WHEN type = 'daily' THEN TIMESTAMP '2025-06-01' WHEN id % 4 = 1 THEN TIMESTAMP '2020-01-01' ELSE TIMESTAMP '2024-01-01' END AS extracted_at FROM pages WHERE type = 'daily' OR id % 4 > 0")
def marked_extracted(spark, d):
    return W.mark_extracted(marks(spark, d), daily(spark, d), AT)


@q("SELECT min(id) AS id, page_id, summary FROM timeline_entries GROUP BY page_id, date, summary, source UNION ALL SELECT -1 AS id, -1 AS page_id, 'new' AS summary")
def added_timeline(spark, d):
    """All entries delivered again, and a new one twice."""
    t = table(spark, d, "timeline_entries")
    one = t.limit(1).withColumn("id", F.lit(-1).cast("long")).withColumn("page_id", F.lit(-1).cast("long")).withColumn("summary", F.lit("new"))
    first = t.join(t.groupBy("page_id", "date", "summary", "source").agg(F.min("id").alias("id")).select("id"), "id", "left_semi")
    return W.add_timeline(first, t.unionByName(one).unionByName(one)).select("id", "page_id", "summary")


@q("""SELECT page_id, tag FROM (SELECT DISTINCT id AS page_id, unnest(from_json(json_extract(frontmatter, '$.tags'), '["VARCHAR"]')) AS tag FROM pages WHERE json_extract(frontmatter, '$.tags') IS NOT NULL
    UNION SELECT id, 'reviewed' FROM pages WHERE type = 'daily') WHERE tag <> 'wedding'""")
def edited_tags(spark, d):
    from loregraph.operators.pages import page_tags

    t = page_tags(table(spark, d, "pages"))
    return W.remove_tags(W.add_tags(t, daily(spark, d).select(F.col("id").alias("page_id"), F.lit("reviewed").alias("tag"))), t.filter("tag = 'wedding'"))


_OUT = "SELECT DISTINCT {0} AS page_id, {1} AS other_id, p.slug AS other_slug, link_type, link_source FROM links JOIN " + _LIVE + " p ON p.id = {1} WHERE {0} IN (SELECT id FROM pages WHERE id % 20 = 0)"


@q(_OUT.format("from_page_id", "to_page_id"))
def outgoing_links(spark, d):
    p = table(spark, d, "pages")
    return W.links_of(table(spark, d, "links"), p, p.filter("id % 20 = 0"))


@q(_OUT.format("to_page_id", "from_page_id"))
def incoming_links(spark, d):
    p = table(spark, d, "pages")
    return W.links_of(table(spark, d, "links"), p, p.filter("id % 20 = 0"), "in")


@q(f"""SELECT l.id, l.from_page_id, l.to_page_id, o.id AS origin_page_id FROM links l JOIN {_LIVE} a ON a.id = l.from_page_id JOIN {_LIVE} b ON b.id = l.to_page_id AND a.source_id = b.source_id
    LEFT JOIN {_LIVE} o ON o.id = l.origin_page_id AND o.source_id = a.source_id""")
def resolved_links(spark, d):
    """Links given by slugs instead of ids, in the source of their first end."""
    p, l = table(spark, d, "pages"), table(spark, d, "links")
    end = lambda i, s, extra=(): p.select(F.col("id").alias(i), F.col("slug").alias(s), *extra)
    named = l.select("id", "from_page_id", "to_page_id", "origin_page_id").join(end("from_page_id", "from_slug", ["source_id"]), "from_page_id").join(end("to_page_id", "to_slug", [F.col("source_id").alias("sb")]), "to_page_id")
    named = named.join(end("origin_page_id", "origin_slug", [F.col("source_id").alias("so")]), "origin_page_id", "left").filter("source_id = sb")
    named = named.withColumn("origin_slug", F.when(F.col("so") == F.col("source_id"), F.col("origin_slug")))
    return W.resolve_links(named.select("id", "source_id", "from_slug", "to_slug", "origin_slug"), p).select("id", "from_page_id", "to_page_id", "origin_page_id")


@q("SELECT from_page_id, to_page_id, link_type, count(*) AS n FROM (SELECT from_page_id, to_page_id, link_type FROM links UNION ALL SELECT DISTINCT to_page_id, -from_page_id, 'back' FROM links) GROUP BY ALL")
def added_links(spark, d):
    l = table(spark, d, "links")
    back = l.withColumn("x", F.col("from_page_id")).withColumn("from_page_id", F.col("to_page_id")).withColumn("to_page_id", -F.col("x")).withColumn("link_type", F.lit("back")).withColumn("link_source", F.lit(None).cast("string")).drop("x")
    return W.add_links(l, l.unionByName(back)).groupBy("from_page_id", "to_page_id", "link_type").agg(F.count("*").alias("n"))


@q("SELECT id FROM links WHERE (from_page_id, to_page_id) NOT IN (SELECT (from_page_id, to_page_id) FROM links WHERE link_type = 'founded')")
def removed_links(spark, d):
    l = table(spark, d, "links")
    return W.remove_links(l, l.filter("link_type = 'founded'")).select("id")


def aliases(spark, d):
    """Titles as aliases of their pages."""
    return table(spark, d, "pages").filter("title is not null and deleted_at is null").select(F.col("id").alias("page_id"), F.col("title").alias("alias"))


@q(f"""WITH a AS (SELECT id AS page_id, lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))) AS a FROM {_LIVE} WHERE title IS NOT NULL), u AS (SELECT a, min(page_id) AS page_id FROM (SELECT DISTINCT * FROM a) GROUP BY 1 HAVING count(*) = 1)
    SELECT DISTINCT upper(title) AS name, u.page_id FROM pages JOIN u ON lower(trim(regexp_replace(upper(title), '\\s+', ' ', 'g'))) = a WHERE id % 20 = 0""")
def resolved_aliases(spark, d):
    return W.resolve_aliases(table(spark, d, "pages").filter("id % 20 = 0").select(F.upper("title").alias("name")), aliases(spark, d))


@q(f"""SELECT id AS page_id, title AS alias FROM {_LIVE} WHERE title IS NOT NULL AND type NOT IN ('daily', 'note') UNION ALL SELECT id, 'the ' || id FROM pages WHERE type = 'daily'""")
def replaced_aliases(spark, d):
    p = table(spark, d, "pages")
    new = p.filter("type in ('daily', 'note')").select(F.col("id").alias("page_id"), F.when(F.col("type") == "daily", F.concat(F.lit("the "), F.col("id").cast("string"))).alias("alias"))
    return W.set_aliases(aliases(spark, d), new)


@q("SELECT id // 10 AS entry, bool_and(id % 7 > 0) AS valid FROM pages GROUP BY 1")
def valid_cache_entries(spark, d):
    p = table(spark, d, "pages")
    return W.generations_valid(p.select(F.floor(F.col("id") / 10).alias("entry"), F.col("id").alias("page_id"), (F.col("generation") + F.when(F.col("id") % 7 == 0, 1).otherwise(0)).alias("generation")), p)


@q("""SELECT id, coalesce(early, ev, da, pu, fn, updated_at, created_at) AS effective FROM (SELECT *, CASE WHEN starts_with(slug, 'daily/') OR starts_with(slug, 'meetings/') THEN fn END AS early FROM
    (SELECT id, slug, updated_at, created_at, """ + ", ".join(f"CASE WHEN {e} >= TIMESTAMP '1990-01-01' AND {e} <= TIMESTAMP '2026-06-01' THEN {e} END AS {n}" for n, e in (
        ("ev", "try_strptime(substr(json_extract_string(frontmatter, '$.event_date'), 1, 10), '%Y-%m-%d')"), ("da", "try_strptime(substr(json_extract_string(frontmatter, '$.date'), 1, 10), '%Y-%m-%d')"),
        ("pu", "try_strptime(substr(json_extract_string(frontmatter, '$.published'), 1, 10), '%Y-%m-%d')"), ("fn", "try_strptime(regexp_extract(coalesce(import_filename, slug), '(\\d{4}-\\d{2}-\\d{2})', 1), '%Y-%m-%d')"))) + " FROM pages))")
def dated_pages(spark, d):
    return W.dated(table(spark, d, "pages"), AT).select("id", "effective")


_RUBRIC = {"person": {"body": 2, "title": 1, "links": 2, "timeline": 1}, "meeting": {"body": 1, "date": 2, "tags": 1}}
_PLAIN = {"body": 2, "title": 1, "tags": 1, "file": 1}
_CHECK = {"body": "least(coalesce(length(compiled_truth), 0) / 800.0::DOUBLE, 1)", "title": "coalesce(length(title) > 0, false)::INT", "tags": "(json_extract(frontmatter, '$.tags') IS NOT NULL)::INT",
          "timeline": "(id IN (SELECT page_id FROM timeline_entries))::INT", "links": "(id IN (SELECT from_page_id FROM links))::INT", "date": "(effective_date IS NOT NULL)::INT", "file": "(import_filename IS NOT NULL)::INT"}
_TOTAL = lambda w: "(" + " + ".join(f"{v} * {_CHECK[k]}" for k, v in w.items()) + f") / {sum(w.values())}::DOUBLE"


@q("SELECT id, round(CASE type " + " ".join(f"WHEN '{t}' THEN {_TOTAL(w)}" for t, w in _RUBRIC.items()) + f" ELSE {_TOTAL(_PLAIN)} END, 3) AS score FROM pages")
def completeness(spark, d):
    return W.completeness(table(spark, d, "pages"), table(spark, d, "links"), table(spark, d, "timeline_entries"), _RUBRIC, _PLAIN)


@q(f"""WITH c AS (SELECT holder, domain, count(*) FILTER (quality = 'correct') AS r, count(quality) AS n FROM {_TAKES} GROUP BY 1, 2), b AS (SELECT domain, sum(r) / sum(n)::DOUBLE AS base FROM c GROUP BY 1)
    SELECT t.row_num AS id, round(coalesce(CASE WHEN n >= 5 THEN round(r / n::DOUBLE, 6) END, base), 6) AS expected, CASE WHEN n >= 5 THEN 'holder' ELSE 'domain' END AS basis FROM {_TAKES} t JOIN c USING (holder, domain) JOIN b USING (domain) WHERE t.quality IS NULL""")
def take_forecasts(spark, d):
    from loregraph.operators.stats import scorecard

    t = takes(spark, d)
    return W.forecast(t.filter("quality is null").select(F.col("row_num").alias("id"), "holder", "domain"), scorecard(t, "holder", "domain"))


@q(f"""SELECT t.page_id, row_num, n AS recent FROM {_TAKES} t JOIN (SELECT page_id, count(*) AS n FROM timeline_entries WHERE date_diff('day', date, DATE '2024-06-01') BETWEEN 0 AND 900 GROUP BY 1) e USING (page_id)
    WHERE quality IS NULL AND weight BETWEEN 0.3 AND 0.7 ORDER BY n DESC, page_id, row_num LIMIT 200""")
def drift_candidates(spark, d):
    return W.drift_candidates(takes(spark, d), table(spark, d, "timeline_entries"), "2024-06-01 00:00:00", 900)


@q("""WITH f AS (SELECT from_page_id AS a, to_page_id AS b, 1 + id % 3 AS s FROM links), x AS (SELECT a AS page_id, s FROM f UNION ALL SELECT b, s FROM f)
    SELECT page_id, count(*) AS appearances, max(s) AS severity FROM x GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 10""")
def hot_pages(spark, d):
    return W.hot_pages(table(spark, d, "links").select(F.col("from_page_id").alias("page_a"), F.col("to_page_id").alias("page_b"), (1 + F.col("id") % 3).alias("severity")))


@q("SELECT CASE id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS severity, count(*) AS n FROM links GROUP BY 1")
def severity_buckets(spark, d):
    from loregraph.operators.stats import histogram

    return histogram(table(spark, d, "links").select(F.element_at(F.array(*map(F.lit, ("low", "medium", "high"))), (F.col("id") % 3 + 1).cast("int")).alias("severity")), "severity")


@q("SELECT event_type, user_id % 3 AS channel, count(*) AS offered, count(*) FILTER (value > 50) AS used, round(count(*) FILTER (value > 50) / count(*)::DOUBLE, 3) AS precision FROM events GROUP BY 1, 2")
def volunteer_precision(spark, d):
    return W.precision_by(table(spark, d, "events").select("event_type", (F.col("user_id") % 3).alias("channel"), (F.col("value") > 50).alias("used")), "event_type", "channel")


@q("""WITH a AS (SELECT *, coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 6000 * 60000000::BIGINT)::INT, 0) AS new FROM events),
    b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM a), c AS (SELECT *, (row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) - 1) // 5 AS part FROM b)
    SELECT user_id AS entity, run * 1000000 + part AS session, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM c GROUP BY user_id, run, part HAVING count(*) >= 2""")
def capped_sessions(spark, d):
    return W.capped_sessions(table(spark, d, "events"), "user_id", "ts", "event_id", 6000, 5)


@q("SELECT from_page_id AS id, array_to_string(list_sort(list_distinct(list(link_type))), ',') AS types, string_agg(link_type, ',' ORDER BY link_type, id) AS every FROM links WHERE link_type <> '' GROUP BY 1")
def link_type_lists(spark, d):
    l = table(spark, d, "links").filter("link_type <> ''")
    s = F.array_sort(F.collect_list(F.struct("link_type", "id")))
    return l.groupBy(F.col("from_page_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("link_type")), ",").alias("types"), F.array_join(s["link_type"], ",").alias("every"))


@q("SELECT event_type AS preferred, count(*) AS n FROM events WHERE ts > TIMESTAMP '2024-01-30' - INTERVAL 7 DAY AND ts <= TIMESTAMP '2024-01-30' GROUP BY 1")
def preference_counts(spark, d):
    e = table(spark, d, "events").filter("ts > timestamp_ntz'2024-01-30' - interval 7 day and ts <= timestamp_ntz'2024-01-30'")
    return e.groupBy(F.col("event_type").alias("preferred")).agg(F.count("*").alias("n"))


@q("SELECT content_hash AS hash, count(*) AS n FROM (SELECT sha256('{\"slug\":' || to_json(slug) || ',\"source_id\":' || to_json(source_id) || '}') AS content_hash FROM pages) GROUP BY 1")
def content_hashes(spark, d):
    return W.content_hash(table(spark, d, "pages").select("source_id", "slug"), "source_id", "slug").groupBy("hash").agg(F.count("*").alias("n"))


@q(f"""WITH n AS (SELECT id, source_id, content_hash FROM pages WHERE id % 2 = 0), l AS (SELECT source_id, content_hash, id FROM {_LIVE} WHERE content_hash IS NOT NULL)
    SELECT n.id, min(l.id) AS duplicate_of, 'hash' AS how FROM n JOIN l ON l.source_id = n.source_id AND l.content_hash = n.content_hash AND l.id <> n.id GROUP BY 1""")
def found_duplicates(spark, d):
    from loregraph.operators.pages import find_duplicates

    p = table(spark, d, "pages")
    return find_duplicates(p.filter("id % 2 = 0"), p)


@q("""WITH r AS (SELECT ts::DATE AS dd, count(*) FILTER (event_type = 'error')::DOUBLE AS h, count(*)::DOUBLE AS n FROM events GROUP BY 1)
    SELECT strftime(dd, '%Y-%m-%d') AS day, round(h / n, 6) AS share, round(CASE WHEN h = 0 THEN 0.0 ELSE (h / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(h / n * (1 - h / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n) END, 6) AS low FROM r WHERE date_diff('day', dd, DATE '2024-01-30') BETWEEN 0 AND 14""")
def error_trend(spark, d):
    """Days as runs: the share of errors with its interval."""
    from loregraph.operators.stats import run_trend

    runs = table(spark, d, "events").groupBy(F.col("ts").cast("date").cast("timestamp").alias("day")).agg(F.count_if(F.col("event_type") == "error").alias("hits"), F.count("*").alias("n"))
    return run_trend(runs, "day", "hits", "n", "2024-01-30 00:00:00", 14).select(F.date_format("at", "yyyy-MM-dd").alias("day"), "share", "low")
