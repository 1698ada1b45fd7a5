"""Reads and writes of a knowledge base as set operations: every write takes a table and a frame of changes and gives the new table."""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loregraph.functions.expressions import age_days
from loregraph.session import broadcast_if_small

PAGE = ["source_id", "slug"]


# -- generic writes -----------------------------------------------------------------------------------------------------------------------------------------------


def latest(new: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row per key: the last by ``order``, nulls first, and then any of equal rows (all columns decide)."""
    by = [F.desc_nulls_last(c) for c in (*order, *[c for c in new.columns if c not in keys])]
    return new.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).filter("__rn = 1").drop("__rn")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Rows of ``new`` replace those with the same keys; of repeated keys in ``new`` the last by ``order`` counts."""
    n = latest(new, keys, *order)
    return old.join(n.select(*keys), keys, "left_anti").unionByName(n)


def insert_new(old: DataFrame, new: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Rows of ``new`` whose keys are not there yet are appended, each key once; nulls are equal to nulls."""
    n = latest(new, keys, *order)
    same = reduce(lambda a, b: a & b, [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys])
    return old.unionByName(n.alias("n").join(old.select(*keys).alias("o"), same, "left_anti"))


def delete(old: DataFrame, keys_of: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(keys_of.select(*keys).distinct(), keys, "left_anti")


def changed_where(df: DataFrame, hit: Column, **values: Column) -> DataFrame:
    """``df`` with columns replaced where ``hit`` holds; a null counts as no."""
    return df.select(*[F.when(F.coalesce(hit, F.lit(False)), values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns])


# -- pages --------------------------------------------------------------------------------------------------------------------------------------------------------


def get_page(pages: DataFrame, slug: str, source_ids: list[str] | None = None, deleted: bool = False) -> DataFrame:
    p = pages.filter(F.col("slug") == slug)
    p = p if source_ids is None else p.filter(F.col("source_id").isin(source_ids))
    return (p if deleted else p.filter("deleted_at is null")).orderBy("source_id", "id").limit(1)


def page_refs(pages: DataFrame) -> DataFrame:
    return pages.select(*PAGE).distinct()


def delete_pages(pages: DataFrame, which: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the pages left, the keys that were there)."""
    return delete(pages, which, PAGE), pages.join(which.select(*PAGE).distinct(), PAGE, "left_semi").select(*PAGE)


def _flagged(pages: DataFrame, which: DataFrame) -> DataFrame:
    return pages.join(which.select(*PAGE).distinct().withColumn("__hit", F.lit(True)), PAGE, "left")


def soft_delete(pages: DataFrame, which: DataFrame, at: str) -> DataFrame:
    """Marked as deleted at ``at`` unless they are already."""
    return changed_where(_flagged(pages, which), F.col("__hit") & F.col("deleted_at").isNull(), deleted_at=F.lit(at).cast("timestamp_ntz")).select(*pages.columns)


def restore(pages: DataFrame, which: DataFrame) -> DataFrame:
    return changed_where(_flagged(pages, which), F.col("__hit"), deleted_at=F.lit(None).cast("timestamp_ntz")).select(*pages.columns)


def slugs_by_paths(pages: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, source_id, slug) of live pages that were imported from the given paths."""
    return pages.filter("deleted_at is null").select(F.col("import_filename").alias("path"), *PAGE).join(broadcast_if_small(paths.select("path").distinct()), "path")


def update_slugs(pages: DataFrame, moves: DataFrame) -> DataFrame:
    """Renames by (source_id, slug, new_slug) where the new name is free; links hold ids and need no change."""
    taken = pages.select("source_id", F.col("slug").alias("new_slug"))
    m = latest(moves.select(*PAGE, "new_slug"), ["source_id", "new_slug"]).join(taken, ["source_id", "new_slug"], "left_anti")
    return pages.join(latest(m, PAGE), PAGE, "left").withColumn("slug", F.coalesce("new_slug", "slug")).select(*pages.columns)


def update_pages(pages: DataFrame, changes: DataFrame, *cols: str) -> DataFrame:
    """A narrow update by id: columns ``cols`` of ``changes`` where they are not null."""
    c = latest(changes.select("id", *cols), ["id"]).select("id", *[F.col(x).alias(f"__{x}") for x in cols])
    j = pages.join(c, "id", "left")
    return j.select(*[F.coalesce(f"__{x}", x).alias(x) if x in cols else F.col(x) for x in pages.columns])


def set_emotional_weights(pages: DataFrame, weights: DataFrame, at: str) -> DataFrame:
    """Weights (id, weight) written back; ``touched_at`` moves only where the weight changes, a null counting as a value."""
    j = pages.join(weights.groupBy("id").agg(F.max("weight").alias("__w"), F.lit(True).alias("__hit")), "id", "left")
    differs = F.col("__hit") & ~F.col("emotional_weight").cast("double").eqNullSafe(F.col("__w"))
    touched = F.col("touched_at") if "touched_at" in pages.columns else F.lit(None).cast("timestamp_ntz")
    out = j.withColumn("touched_at", F.when(differs, F.lit(at).cast("timestamp_ntz")).otherwise(touched)).withColumn("emotional_weight", F.when(F.col("__hit"), F.col("__w")).otherwise(F.col("emotional_weight").cast("double")))
    return out.drop("__w", "__hit")


def page_timestamps(pages: DataFrame) -> DataFrame:
    """(slug, at): the last change by slug alone, whatever the source."""
    return pages.groupBy("slug").agg(F.max(F.coalesce("updated_at", "created_at")).alias("at"))


def snapshot(versions: DataFrame, pages: DataFrame, at: str) -> DataFrame:
    """``versions`` (page_id, version, title, compiled_truth, timeline, at) with the present state of the pages as their next version."""
    last = versions.groupBy("page_id").agg(F.max("version").alias("last"))
    new = pages.select(F.col("id").alias("page_id"), "title", "compiled_truth", "timeline").join(last, "page_id", "left")
    return versions.unionByName(new.select("page_id", (F.coalesce("last", F.lit(0)) + 1).cast("int").alias("version"), "title", "compiled_truth", "timeline", F.lit(at).cast("timestamp_ntz").alias("at")))


def revert(pages: DataFrame, versions: DataFrame, version: int) -> DataFrame:
    """Pages that have the version get its title, body and timeline back."""
    v = versions.filter(F.col("version") == version).select(F.col("page_id").alias("id"), *[F.col(c).alias(f"__{c}") for c in ("title", "compiled_truth", "timeline")], F.lit(True).alias("__hit"))
    j = pages.join(v, "id", "left")
    return changed_where(j, F.col("__hit"), **{c: F.col(f"__{c}") for c in ("title", "compiled_truth", "timeline")}).select(*pages.columns)


def newest(df: DataFrame, k: int, stamp: str = "created_at", id_col: str = "id") -> DataFrame:
    """The last ``k`` rows of a log."""
    return df.orderBy(F.desc_nulls_last(stamp), F.desc(id_col)).limit(k)


def logged_since(log: DataFrame, since: str, limit: int, stamp: str = "created_at", **equal: str) -> DataFrame:
    """Rows of a log from ``since`` on with the given column values, newest first."""
    f = log.filter(F.col(stamp) >= F.lit(since).cast("timestamp_ntz"))
    for c, v in equal.items():
        f = f.filter(F.col(c) == v)
    return newest(f, limit, stamp)


def retained(log: DataFrame, before: str, stamp: str = "created_at") -> DataFrame:
    """Without rows older than ``before``."""
    return log.filter(F.col(stamp).isNull() | (F.col(stamp) >= F.lit(before).cast("timestamp_ntz")))


def unexpired(cache: DataFrame, at: str, stamp: str = "expires_at") -> DataFrame:
    return cache.filter(F.col(stamp) > F.lit(at).cast("timestamp_ntz"))


# -- sources ------------------------------------------------------------------------------------------------------------------------------------------------------


def _merged(old: object, patch: object) -> object:
    if not isinstance(patch, dict):
        return patch
    out = dict(old) if isinstance(old, dict) else {}
    for k, v in patch.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = _merged(out.get(k), v)
    return out


@F.pandas_udf(StringType())
def merge_patch(old: pd.Series, patch: pd.Series) -> pd.Series:
    """JSON merge patch (RFC 7396): objects are merged, null takes a key away, everything else replaces. A null patch changes nothing."""
    return pd.Series([o if p is None else json.dumps(_merged(json.loads(o) if o else {}, json.loads(p)), ensure_ascii=False) for o, p in zip(old, patch)])


def patch_configs(sources: DataFrame, patches: DataFrame) -> DataFrame:
    """Sources with the patches (id, patch) merged into their config."""
    p = broadcast_if_small(patches.groupBy("id").agg(F.max("patch").alias("__patch")))
    return sources.join(p, "id", "left").withColumn("config", merge_patch("config", "__patch")).select(*sources.columns)


# -- chunks -------------------------------------------------------------------------------------------------------------------------------------------------------

#: Vector columns that may be named by a caller: column, model, length.
VECTOR_COLUMNS = {"current": ("embedding", "embed-v2", 64), "legacy": ("embedding", "embed-v1", 32)}


def vector_column(name: str) -> tuple[str, str, int]:
    """A registered vector column; names that are not registered never reach a plan."""
    if name not in VECTOR_COLUMNS:
        raise ValueError(f"unknown vector column: {name!r}")
    return VECTOR_COLUMNS[name]


def page_chunks(chunks: DataFrame, page_ids: DataFrame, vectors: bool = False) -> DataFrame:
    c = chunks.join(page_ids.select(F.col("id").alias("page_id")).distinct(), "page_id", "left_semi")
    return (c if vectors else c.drop("embedding")).orderBy("page_id", "chunk_index", "id")


def vectors_by_ids(chunks: DataFrame, ids: DataFrame, name: str = "current") -> DataFrame:
    """(id, v) of the asked chunks that have a vector of the registered column."""
    col, model, size = vector_column(name)
    return chunks.filter((F.col("model") == model) & F.col(col).isNotNull() & (F.size(col) == size)).join(ids.select("id").distinct(), "id", "left_semi").select("id", F.col(col).alias("v"))


def upsert_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """Pages that occur in ``new`` have exactly its chunk indices afterwards; a chunk keeps its vector if the text is unchanged and the new row has none or an older one."""
    keys = ["page_id", "chunk_index"]
    n = latest(new, keys, "embedded_at", "id")
    o = latest(old, keys, "embedded_at", "id").select(*keys, F.col("chunk_text").alias("__t"), *[F.col(c).alias(f"__{c}") for c in ("embedding", "model", "embedded_at")])
    j = n.join(o, keys, "left")
    newer = F.col("embedding").isNull() | (F.col("__embedded_at") > F.coalesce("embedded_at", F.lit("0001-01-01").cast("timestamp_ntz")))
    kept = changed_where(j, (F.col("chunk_text") == F.col("__t")) & F.col("__embedding").isNotNull() & newer, **{c: F.col(f"__{c}") for c in ("embedding", "model", "embedded_at")}).select(*old.columns)
    return old.join(n.select("page_id").distinct(), "page_id", "left_anti").unionByName(kept)


def delete_chunks(chunks: DataFrame, page_ids: DataFrame) -> DataFrame:
    return delete(chunks, page_ids.select(F.col("id").alias("page_id")), ["page_id"])


def search_filter(chunks: DataFrame, pages: DataFrame, *, detail: str = "medium", language: str | None = None, types: list[str] | None = None, after: str | None = None, before: str | None = None, modality: str | None = "text") -> DataFrame:
    """Chunks with their page's slug and type that a search may give: for low detail compiled truth alone; one language; page types; pages dated strictly within a window; text or images."""
    c = chunks
    if detail == "low":
        c = c.filter("chunk_source = 'compiled_truth'")
    if language is not None:
        c = c.filter(F.col("language") == language)
    if modality is not None:
        c = c.filter((F.col("chunk_source") == "image") if modality == "image" else ~F.col("chunk_source").eqNullSafe("image"))
    p = pages.filter("deleted_at is null").select(F.col("id").alias("page_id"), "slug", "type", F.coalesce("effective_date", "updated_at", "created_at").alias("dated"))
    if types is not None:
        p = p.filter(F.col("type").isin(types))
    if after is not None:
        p = p.filter(F.col("dated") > F.lit(after).cast("timestamp_ntz"))
    if before is not None:
        p = p.filter(F.col("dated") < F.lit(before).cast("timestamp_ntz"))
    return c.join(p, "page_id")


def stale_for_embedding(chunks: DataFrame, pages: DataFrame, signatures: DataFrame, signature: str) -> DataFrame:
    """Chunks without a vector, or of a page whose signature (page_id, signature) is another; pages marked embed_skip never count."""
    p = pages.filter(~F.coalesce(F.get_json_object("frontmatter", "$.embed_skip") == "true", F.lit(False))).select(F.col("id").alias("page_id"))
    c = chunks.join(p, "page_id", "left_semi").join(signatures, "page_id", "left")
    return c.filter(F.col("embedding").isNull() | (F.col("signature").isNotNull() & (F.col("signature") != signature))).select(*chunks.columns)


def drop_stale_vectors(chunks: DataFrame, signatures: DataFrame, signature: str) -> DataFrame:
    """Vectors of pages with another signature become null."""
    j = chunks.join(signatures, "page_id", "left")
    none = {c: F.lit(None).cast(chunks.schema[c].dataType) for c in ("embedding", "embedded_at")}
    return changed_where(j, F.col("signature") != signature, **none).select(*chunks.columns)


def stale_for_extraction(pages: DataFrame, marks: DataFrame, version_at: str) -> DataFrame:
    """Live pages never extracted, extracted before ``version_at``, or changed since; ``marks`` are (id, extracted_at)."""
    j = pages.filter("deleted_at is null").join(marks, "id", "left")
    return j.filter(F.col("extracted_at").isNull() | (F.col("extracted_at") < F.lit(version_at).cast("timestamp_ntz")) | (F.col("updated_at") > F.col("extracted_at"))).select(*pages.columns)


def mark_extracted(marks: DataFrame, ids: DataFrame, at: str) -> DataFrame:
    return upsert(marks, ids.select("id", F.lit(at).cast("timestamp_ntz").alias("extracted_at")), ["id"])


# -- timeline, tags, links ----------------------------------------------------------------------------------------------------------------------------------------


def add_timeline(entries: DataFrame, new: DataFrame) -> DataFrame:
    return insert_new(entries, new, ["page_id", "date", "summary", "source"], "id")


def add_tags(tags: DataFrame, new: DataFrame) -> DataFrame:
    return tags.unionByName(new.select(*tags.columns)).distinct()


def remove_tags(tags: DataFrame, gone: DataFrame) -> DataFrame:
    return delete(tags, gone, ["page_id", "tag"])


LINK = ["from_page_id", "to_page_id", "link_type", "link_source"]


def links_of(links: DataFrame, pages: DataFrame, page_ids: DataFrame, direction: str = "out") -> DataFrame:
    """(page_id, other_id, other_slug, link_type, link_source) of the live pages that the asked ones link to, or that link to them; repeated rows once."""
    mine, other = ("from_page_id", "to_page_id") if direction == "out" else ("to_page_id", "from_page_id")
    l = links.join(page_ids.select(F.col("id").alias(mine)).distinct(), mine, "left_semi").select(F.col(mine).alias("page_id"), F.col(other).alias("other_id"), "link_type", "link_source").distinct()
    return l.join(pages.filter("deleted_at is null").select(F.col("id").alias("other_id"), F.col("slug").alias("other_slug")), "other_id").select("page_id", "other_id", "other_slug", "link_type", "link_source")


def resolve_links(named: DataFrame, pages: DataFrame) -> DataFrame:
    """Links by slugs (source_id, from_slug, to_slug, origin_slug, ...) with ids in their place; a link whose ends are not both there is left out, an origin may be missing."""
    p = pages.filter("deleted_at is null").select("source_id", "slug", "id")
    end = lambda s, i: p.select("source_id", F.col("slug").alias(s), F.col("id").alias(i))
    j = named.join(end("from_slug", "from_page_id"), ["source_id", "from_slug"]).join(end("to_slug", "to_page_id"), ["source_id", "to_slug"])
    return j.join(end("origin_slug", "origin_page_id"), ["source_id", "origin_slug"], "left").drop("from_slug", "to_slug", "origin_slug", "source_id")


def add_links(links: DataFrame, new: DataFrame) -> DataFrame:
    return insert_new(links, new, LINK, "id")


def remove_links(links: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    """Without links that agree with a row of ``gone`` in ``keys`` (both ends if none are named)."""
    return delete(links, gone, list(keys) or LINK[:2])


def set_aliases(aliases: DataFrame, new: DataFrame) -> DataFrame:
    """Pages that occur in ``new`` (page_id, alias) have exactly its aliases afterwards; a null alias leaves a page without any."""
    return delete(aliases, new, ["page_id"]).unionByName(new.filter("alias is not null").select(*aliases.columns).distinct())


def resolve_aliases(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name, page_id): pages that have the name as an alias, in any case and spacing; a name with several pages is ambiguous and gives none."""
    norm = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    hit = names.select("name", norm(F.col("name")).alias("a")).distinct().join(aliases.select(norm(F.col("alias")).alias("a"), "page_id").distinct(), "a")
    return hit.groupBy("name").agg(F.count("*").alias("n"), F.min("page_id").alias("page_id")).filter("n = 1").select("name", "page_id")


def generations_valid(stored: DataFrame, pages: DataFrame) -> DataFrame:
    """(entry, valid): whether all pages of a cache entry (entry, page_id, generation) still have the generation it was made from."""
    j = stored.join(pages.select(F.col("id").alias("page_id"), F.col("generation").alias("now")), "page_id", "left")
    return j.groupBy("entry").agg(F.coalesce(F.min(F.coalesce(F.col("now") == F.col("generation"), F.lit(False))), F.lit(False)).alias("valid"))


def bump_generations(pages: DataFrame, changed: DataFrame) -> DataFrame:
    """Pages whose id is among the changed ones have the next generation."""
    c = changed.select("id").distinct().withColumn("__hit", F.lit(True))
    return changed_where(pages.join(c, "id", "left"), F.col("__hit"), generation=F.col("generation") + 1).select(*pages.columns)


def knobs_hash(**knobs: object) -> str:
    """A key for cached results: the SHA-256 of the settings in the order of their names."""
    import hashlib

    return hashlib.sha256(json.dumps(knobs, sort_keys=True, default=str).encode()).hexdigest()


def decay_map(*layers: dict[str, tuple[float, float]] | None) -> dict[str, tuple[float, float]]:
    """Half-lives and coefficients by prefix; later layers override earlier ones, an invalid entry is left out."""
    out: dict[str, tuple[float, float]] = {}
    for layer in layers:
        out |= {p: v for p, v in (layer or {}).items() if p and len(v) == 2 and all(isinstance(x, (int, float)) and x >= 0 for x in v)}
    return out


def content_hash(df: DataFrame, *cols: str, name: str = "hash") -> DataFrame:
    """SHA-256 of the JSON of the columns in the order of their names; nulls are written."""
    fields = sorted(cols)
    return df.withColumn(name, F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256))


def copy_tables(spark: SparkSession, src: str, dst: str, names: list[str]) -> None:
    """All rows of the named tables of one folder written to another."""
    for n in names:
        spark.read.parquet(f"{src}/{n}.parquet").write.mode("overwrite").parquet(f"{dst}/{n}.parquet")


# -- dates --------------------------------------------------------------------------------------------------------------------------------------------------------


def dated(pages: DataFrame, as_of: str) -> DataFrame:
    """(id, effective, origin): the first date that can be read and lies between 1990 and a year from ``as_of``: event_date, date, published of the front matter, the file name (first
    for daily and meeting pages), else the last change, else the creation.
    """
    def ok(c: Column) -> Column:
        return F.when((c >= F.lit("1990-01-01").cast("timestamp_ntz")) & (c <= F.lit(as_of).cast("timestamp_ntz") + F.make_interval(years=F.lit(1))), c)

    field = lambda k: ok(F.try_to_date(F.substring(F.get_json_object("frontmatter", f"$.{k}"), 1, 10), "yyyy-MM-dd").cast("timestamp_ntz"))
    name = ok(F.try_to_date(F.nullif(F.regexp_extract(F.coalesce("import_filename", "slug"), r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")), "yyyy-MM-dd").cast("timestamp_ntz"))
    early = F.when(F.col("slug").startswith("daily/") | F.col("slug").startswith("meetings/"), name)
    steps = [("filename", early), ("event_date", field("event_date")), ("date", field("date")), ("published", field("published")), ("filename", name), ("updated", F.col("updated_at")), ("created", F.col("created_at"))]
    return pages.select("id", F.coalesce(*[c for _, c in steps]).alias("effective"), F.coalesce(*[F.when(c.isNotNull(), F.lit(n)) for n, c in steps]).alias("origin"))


# -- scores of pages and claims -----------------------------------------------------------------------------------------------------------------------------------


def completeness(pages: DataFrame, links: DataFrame, entries: DataFrame, weights: dict[str, dict[str, float]], default: dict[str, float]) -> DataFrame:
    """(id, score): the weighted sum, to three decimals, of what a page of its type has: body (up to 800 characters), title, tags, timeline, links, date, a file it was imported from."""
    out = links.select(F.col("from_page_id").alias("id")).distinct().withColumn("has_links", F.lit(1.0))
    tl = entries.select(F.col("page_id").alias("id")).distinct().withColumn("has_timeline", F.lit(1.0))
    one = lambda c: F.when(F.coalesce(c, F.lit(False)), 1.0).otherwise(0.0)
    checks = {
        "body": F.least(F.coalesce(F.length("compiled_truth"), F.lit(0)) / 800, F.lit(1.0)), "title": one(F.length("title") > 0), "tags": one(F.get_json_object("frontmatter", "$.tags").isNotNull()),
        "timeline": F.coalesce("has_timeline", F.lit(0.0)), "links": F.coalesce("has_links", F.lit(0.0)), "date": one(F.col("effective_date").isNotNull()), "file": one(F.col("import_filename").isNotNull()),
    }
    total = lambda w: reduce(lambda a, b: a + b, [checks[k] * v for k, v in w.items()]) / sum(w.values())
    score = F.coalesce(*[F.when(F.col("type") == t, total(w)) for t, w in weights.items()], total(default))
    return pages.join(out, "id", "left").join(tl, "id", "left").select("id", F.round(score, 3).alias("score"))


def forecast(claims: DataFrame, card: DataFrame, least: int = 5) -> DataFrame:
    """Open claims (holder, domain) with the holder's accuracy in the domain, or the domain's if the holder has fewer than ``least`` resolved claims there."""
    own = card.filter(F.col("correct") + F.col("incorrect") >= least).select("holder", "domain", F.col("accuracy").alias("own"))
    every = card.groupBy("domain").agg(F.try_divide(F.sum("correct"), F.sum(F.col("correct") + F.col("incorrect"))).alias("base"))
    j = claims.join(own, ["holder", "domain"], "left").join(every, "domain", "left")
    return j.select("id", F.round(F.coalesce("own", "base"), 6).alias("expected"), F.when(F.col("own").isNotNull(), "holder").otherwise("domain").alias("basis"))


def drift_candidates(takes: DataFrame, evidence: DataFrame, as_of: str, days: int = 30, k: int = 200) -> DataFrame:
    """Open claims of middling weight (0.3 to 0.7) by the number of dated entries of their page within ``days``: (page_id, row_num, recent)."""
    age = age_days(F.col("date").cast("timestamp"), as_of)
    n = evidence.filter((age >= 0) & (age <= days)).groupBy("page_id").agg(F.count("*").alias("recent"))
    mid = takes.filter(F.col("quality").isNull() & F.col("weight").between(0.3, 0.7))
    return mid.join(n, "page_id").select("page_id", "row_num", "recent").orderBy(F.desc("recent"), "page_id", "row_num").limit(k)


def hot_pages(findings: DataFrame, k: int = 10) -> DataFrame:
    """(page_id, appearances, severity) of the pages that most findings (page_a, page_b, severity from 1 to 3) name, on either side."""
    both = findings.select(F.col("page_a").alias("page_id"), "severity").unionAll(findings.select(F.col("page_b").alias("page_id"), "severity"))
    return both.groupBy("page_id").agg(F.count("*").alias("appearances"), F.max("severity").alias("severity")).orderBy(F.desc("appearances"), F.desc("severity"), F.asc("page_id")).limit(k)


def precision_by(used: DataFrame, *by: str) -> DataFrame:
    """Rows with a flag ``used``: (by, offered, used, precision to three decimals)."""
    n = used.groupBy(*by).agg(F.count("*").alias("offered"), F.count_if("used").alias("used"))
    return n.withColumn("precision", F.round(F.col("used") / F.col("offered"), 3))


def capped_sessions(events: DataFrame, by: str, stamp: str, order: str, gap_minutes: int = 30, most: int = 30, least: int = 2) -> DataFrame:
    """(entity, session, n, first_id, last_id): runs without a gap of more than ``gap_minutes``, cut after every ``most`` events; shorter ones than ``least`` are dropped."""
    w = Window.partitionBy(by).orderBy(stamp, order)
    gap = F.unix_micros(F.col(stamp).cast("timestamp")) - F.unix_micros(F.lag(stamp).over(w).cast("timestamp")) > gap_minutes * 60_000_000
    s = events.withColumn("__run", F.sum(F.coalesce(gap.cast("int"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = s.withColumn("__part", F.floor((F.row_number().over(Window.partitionBy(by, "__run").orderBy(stamp, order)) - 1) / most))
    g = s.groupBy(F.col(by).alias("entity"), "__run", "__part").agg(F.count("*").alias("n"), F.min(order).alias("first_id"), F.max(order).alias("last_id")).filter(F.col("n") >= least)
    return g.select("entity", (F.col("__run") * 1_000_000 + F.col("__part")).alias("session"), "n", "first_id", "last_id")
