"""Reads and writes of pages, chunks, timelines and logs as set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loregraph.functions.expressions import not_excluded
from loregraph.operators.store import latest
from loregraph.session import broadcast_if_small


def visible(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """Pages that are not deleted, not quarantined, not of an archived source and not hard-excluded."""
    archived = broadcast_if_small(sources.filter("archived").select(F.col("id").alias("source_id")))
    live = pages.filter(F.col("deleted_at").isNull() & F.get_json_object("frontmatter", "$.quarantine").isNull() & not_excluded(F.col("slug")))
    return live.join(archived, "source_id", "left_anti")


def scoped(df: DataFrame, source_ids: list[str] | None) -> DataFrame:
    return df if source_ids is None else df.filter(F.col("source_id").isin(source_ids))


SORTS = {
    "updated_desc": [F.desc_nulls_last, "updated_at"], "updated_asc": [F.asc_nulls_last, "updated_at"], "created_desc": [F.desc_nulls_last, "created_at"], "slug": [F.asc_nulls_last, "slug"],
}


def list_pages(pages: DataFrame, *, type: str | None = None, slug_prefix: str | None = None, updated_after: str | None = None, tag: str | None = None, sort: str = "updated_desc", limit: int = 100, offset: int = 0) -> DataFrame:
    df = pages.filter(F.col("deleted_at").isNull())
    if type:
        df = df.filter(F.col("type") == type)
    if slug_prefix:
        df = df.filter(F.col("slug").startswith(slug_prefix))
    if updated_after:
        df = df.filter(F.col("updated_at") > F.lit(updated_after).cast("timestamp_ntz"))
    if tag:
        df = df.filter(F.array_contains(tags_of(F.col("frontmatter")), tag))
    order, col = SORTS[sort]
    return df.orderBy(order(col), F.asc("id")).offset(offset).limit(limit)


def tags_of(frontmatter):
    return F.coalesce(F.from_json(F.get_json_object(frontmatter, "$.tags"), "array<string>"), F.array().cast("array<string>"))


def page_tags(pages: DataFrame) -> DataFrame:
    """(page_id, tag), each once."""
    return pages.select(F.col("id").alias("page_id"), F.explode(tags_of(F.col("frontmatter"))).alias("tag")).distinct()


def upsert_pages(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("source_id", "slug"), keep: tuple[str, ...] = ("import_filename", "effective_date_source")) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same keys, of repeated ones the last changed; columns in ``keep`` stay where the new row has none."""
    n = latest(new, list(keys), *[c for c in ("updated_at", "id") if c in new.columns])
    o = old.select(*keys, *[F.col(c).alias(f"__old_{c}") for c in keep])
    merged = n.join(o, list(keys), "left").select(*[F.coalesce(c, f"__old_{c}").alias(c) if c in keep else F.col(c) for c in new.columns])
    return old.join(n.select(*keys), list(keys), "left_anti").unionByName(merged)


def duplicate_pages(pages: DataFrame) -> DataFrame:
    """Groups of live pages with one content hash: (content_hash, copies, first_id)."""
    live = pages.filter(F.col("deleted_at").isNull() & F.col("content_hash").isNotNull())
    return live.groupBy("content_hash").agg(F.count("*").alias("copies"), F.min("id").alias("first_id")).filter("copies > 1")


def find_duplicates(new: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, duplicate_of, how): for new pages the first live page of their source with the same content hash, else with the same id in the front matter."""
    live = pages.filter("deleted_at is null")
    key = lambda df, how: F.col("content_hash") if how == "hash" else F.get_json_object("frontmatter", "$.id")
    hits = None
    for how in ("hash", "id"):
        known = live.select("source_id", key(live, how).alias("k"), F.col("id").alias("other")).filter("k is not null")
        asked = new.select("id", "source_id", key(new, how).alias("k")).filter("k is not null")
        h = asked.join(known, ["source_id", "k"]).filter("id <> other").groupBy("id").agg(F.min("other").alias("duplicate_of")).withColumn("how", F.lit(how))
        hits = h if hits is None else hits.unionByName(h.join(hits.select("id"), "id", "left_anti"))
    return hits


def purge_deleted(pages: DataFrame, as_of: str, hours: int = 72) -> DataFrame:
    """Without pages that were deleted more than ``hours`` before ``as_of``."""
    limit = F.lit(as_of).cast("timestamp_ntz") - F.make_interval(hours=F.lit(hours))
    return pages.filter(F.col("deleted_at").isNull() | (F.col("deleted_at") >= limit))


def newest_chunks(chunks: DataFrame) -> DataFrame:
    """One row per (page_id, chunk_index): the last embedded, then the largest id."""
    w = Window.partitionBy("page_id", "chunk_index").orderBy(F.desc_nulls_last("embedded_at"), F.desc("id"))
    return chunks.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def stale_chunks(chunks: DataFrame, model: str) -> DataFrame:
    """Chunks without a vector of the current model."""
    return chunks.filter(F.col("embedding").isNull() | ~F.col("model").eqNullSafe(model))


def keyset(df: DataFrame, a: str, b: str, after: tuple[int, int], limit: int) -> DataFrame:
    return df.filter((F.col(a) > after[0]) | ((F.col(a) == after[0]) & (F.col(b) > after[1]))).orderBy(a, b, "id").limit(limit)


def dedup_timeline(entries: DataFrame) -> DataFrame:
    """The smallest id of each (page_id, date, summary, source), nulls alike."""
    return entries.groupBy("page_id", "date", "summary", "source").agg(F.min("id").alias("id"))


def timeline_range(entries: DataFrame, page_id: int, since: str, until: str, limit: int = 100) -> DataFrame:
    return entries.filter((F.col("page_id") == page_id) & (F.col("date") >= F.lit(since).cast("date")) & (F.col("date") <= F.lit(until).cast("date"))).orderBy(F.desc("date"), F.asc("id")).limit(limit)


def effective_dates(pages: DataFrame) -> DataFrame:
    return pages.select("source_id", "slug", F.coalesce("effective_date", "updated_at", "created_at").alias("effective"))


def content_sanity(pages: DataFrame, warn: int = 50_000, block: int = 500_000, markup: float = 0.85) -> DataFrame:
    """(id, bytes, verdict): oversize, junk (titles and beginnings of error pages), markup (between the two limits, hardly any prose beside tags, links and code), large, ok."""
    size = F.octet_length("compiled_truth")
    junk = F.lower(F.concat_ws(" ", "title", F.substring("compiled_truth", 1, 2048))).rlike(JUNK)
    prose = F.regexp_replace(F.regexp_replace(F.regexp_replace("compiled_truth", r"(?s)```.*?```", ""), r"<[^<>]*>", ""), r"!?\[[^\]]*\]\([^)]*\)|https?://\S+", "")
    ratio = 1 - F.length(F.regexp_replace(prose, r"\s", "")) / F.greatest(F.length(F.regexp_replace("compiled_truth", r"\s", "")), F.lit(1))
    verdict = F.when(size > block, "oversize").when(junk, "junk").when((size > warn) & (ratio > markup), "markup").when(size > warn, "large").otherwise("ok")
    return pages.filter(F.col("compiled_truth").isNotNull()).select("id", size.alias("bytes"), verdict.alias("verdict"))


#: Phrases of pages that stand in for what was asked: blocked, missing, challenges of bots.
JUNK = "access denied|attention required|just a moment\\.\\.\\.|enable javascript|404 not found|captcha"


def annotated(pages: DataFrame) -> DataFrame:
    """Pages with the reason of a content flag in their front matter, which annotates them where a quarantine would hide them; null for most."""
    return pages.withColumn("content_flag", F.coalesce(F.get_json_object("frontmatter", "$.content_flag.reason"), F.get_json_object("frontmatter", "$.content_flag")))
