"""Links, fields, dates and pointers out of front matter and text; masks for what must not go on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loregraph.functions.expressions import slugify
from loregraph.session import broadcast_if_small

# Fixed values: (front matter field, page type or None for any, link type, direction as seen from the page).
FIELD_LINKS = [
    ("company", "person", "works_at", "out"), ("companies", "person", "works_at", "out"), ("founded", "person", "founded", "out"), ("key_people", "company", "works_at", "in"), ("partner", "company", "yc_partner", "in"),
    ("investors", "company", "invested_in", "in"), ("investors", "deal", "invested_in", "in"), ("lead", "deal", "led_round", "in"), ("attendees", "meeting", "attended", "in"), ("sources", None, "discussed_in", "in"),
    ("source", None, "source", "out"), ("related", None, "related_to", "out"), ("see_also", None, "related_to", "out"),
]


def frontmatter_links(pages: DataFrame, fields: list[tuple] = FIELD_LINKS) -> DataFrame:
    """(from_page_id, to_page_id, link_type, field): links that front matter fields state; a value, or each of a list, is a slug, the last part of one, or a title, of the same source.

    A name that fits several pages gives the one of the smallest id; names of no page give no link.
    """
    live = pages.filter("deleted_at is null")
    kinds = [F.struct(F.lit(f).alias("field"), F.lit(t).cast("string").alias("of"), F.lit(k).alias("link_type"), F.lit(d).alias("way"), F.from_json(v, "array<string>").alias("list"), v.alias("one")) for f, t, k, d in fields for v in [F.get_json_object("frontmatter", f"$.{f}")]]
    j = live.filter("frontmatter <> '{}'").select("id", "source_id", "type", F.explode(F.array(*kinds)).alias("x")).select("id", "source_id", "type", "x.*").filter(F.col("one").isNotNull() & (F.col("of").isNull() | (F.col("of") == F.col("type"))))
    named = j.select("id", "source_id", "link_type", "field", "way", F.explode(F.when(F.startswith("one", F.lit("[")), F.coalesce("list", F.array().cast("array<string>"))).otherwise(F.array("one"))).alias("name"))
    named = named.withColumn("key", F.lower(F.trim("name"))).filter("key <> ''")
    keys = F.array(F.lower("slug"), F.lower(F.substring_index("slug", "/", -1)), F.lower(F.trim("title")), slugify(F.col("title")))
    index = live.select("source_id", "id", F.explode(F.array_distinct(F.filter(keys, lambda k: k.isNotNull() & (k != "")))).alias("key")).groupBy("source_id", "key").agg(F.min("id").alias("other"))
    hit = named.join(index, ["source_id", "key"]).filter("id <> other")
    out = F.col("way") == "out"
    return hit.select(F.when(out, F.col("id")).otherwise(F.col("other")).alias("from_page_id"), F.when(out, F.col("other")).otherwise(F.col("id")).alias("to_page_id"), "link_type", "field").distinct()


def inferred_types(texts: Column, rules: list[tuple[str, str]], default: str = "mentions") -> Column:
    """The link type of the first rule (pattern, link type) that a context fits."""
    c = None
    for pattern, kind in rules:
        hit = F.lower(texts).rlike(pattern)
        c = F.when(hit, kind) if c is None else c.when(hit, kind)
    return F.lit(default) if c is None else c.otherwise(default)


def code_refs(pages: DataFrame, text: str = "compiled_truth") -> DataFrame:
    """(id, path, line): paths of source files that a text names, with the line after a colon if there is one; the first of each path."""
    ref = r"(?<![\w/.-])((?:[\w.-]+/)+[\w.-]+\.(?:ts|tsx|js|jsx|py|go|rs|java|rb|sql|c|h|cpp|cs|sh|swift|kt|scala|php))(?::(\d+))?(?![\w/])"
    hit = pages.filter(F.col(text).isNotNull()).select("id", F.posexplode(F.regexp_extract_all(text, F.lit(ref), 0)).alias("p", "m"))
    got = hit.select("id", "p", F.regexp_replace("m", r":\d+$", "").alias("path"), F.nullif(F.regexp_extract("m", r":(\d+)$", 1), F.lit("")).cast("int").alias("line"))
    return got.groupBy("id", "path").agg(F.min_by("line", "p").alias("line"))


def timeline_blocks(pages: DataFrame, text: str = "timeline") -> DataFrame:
    """(id, date, summary, detail): dated lines with the indented lines below them, for real dates."""
    entry = r"(?m)^\s*-?\s*\*\*(\d{4}-\d{2}-\d{2})\*\*\s*[|–—-][^\n]*(?:\n[ \t]+(?!-?\s*\*\*\d{4}-)\S[^\n]*)*"
    e = pages.filter(F.col(text).isNotNull()).select("id", F.explode(F.regexp_extract_all(F.regexp_replace(text, "\r\n", "\n"), F.lit(entry), 0)).alias("e"))
    first = F.substring_index(F.ltrim("e"), "\n", 1)
    rest = F.when(F.locate("\n", F.ltrim("e")) > 0, F.trim(F.regexp_replace(F.substr(F.ltrim("e"), F.locate("\n", F.ltrim("e"))), r"\n[ \t]+", "\n"))).otherwise("")
    return e.select("id", F.try_to_date(F.regexp_extract("e", r"\*\*(\d{4}-\d{2}-\d{2})\*\*", 1), "yyyy-MM-dd").alias("date"), F.trim(F.regexp_replace(first, r"^\s*-?\s*\*\*[\d-]+\*\*\s*[|–—-]\s*", "")).alias("summary"), F.regexp_replace(rest, r"^\s+", "").alias("detail")).filter("date is not null")


def metric_label(raw: Column, known: dict[str, str]) -> Column:
    """A label in lower case with underscores, by the name it is known under if there is one; empty ones are null."""
    t = F.lower(F.trim(raw))
    named = F.coalesce(*[F.when(t == k, F.lit(v)) for k, v in known.items()], F.regexp_replace(F.regexp_replace(t, r"\s+", "_"), "[^a-z0-9_]", ""))
    return F.when(t != "", named)


def word_count(text: Column, dense: float = 0.30) -> Column:
    """Words between blanks; characters instead where at least ``dense`` of the text is written without blanks (Han, kana, Hangul)."""
    bare = F.regexp_replace(text, r"\s+", "")
    cjk = F.length(bare) - F.length(F.regexp_replace(bare, r"[぀-ヿ㐀-䶿一-鿿가-힯豈-﫿]", ""))
    blanks = F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""))
    return F.when(F.coalesce(text, F.lit("")) == "", 0).when(cjk >= dense * F.length(bare), F.length(bare)).otherwise(blanks)


def dates_in(text: Column) -> Column:
    """The dates of a text: 2024-03-01, 2024/03/01, March 1 2024, March 2024 (its first day), Q2 2024 (the year's first day)."""
    months = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
    all_of = lambda p, g: F.regexp_extract_all(text, F.lit(p), g)
    iso = F.transform(F.array_union(all_of(r"\b(\d{4}-\d{2}-\d{2})\b", 1), F.transform(all_of(r"\b(\d{4}/\d{2}/\d{2})\b", 1), lambda d: F.replace(d, F.lit("/"), F.lit("-")))), lambda d: F.try_to_date(d, "yyyy-MM-dd"))
    long = F.transform(all_of(rf"\b((?:{months})[a-z]*\.? \d{{1,2}},? \d{{4}})\b", 1), lambda d: F.try_to_date(F.regexp_replace(d, r"^(\w{3})[a-z]*\.? (\d{1,2}),? (\d{4})$", "$1 $2 $3"), "MMM d yyyy"))
    month = F.transform(all_of(rf"\b((?:{months})[a-z]*\.? \d{{4}})\b", 1), lambda d: F.try_to_date(F.regexp_replace(d, r"^(\w{3})[a-z]*\.? (\d{4})$", "$1 1 $2"), "MMM d yyyy"))
    quarter = F.transform(all_of(r"\bQ[1-4] (\d{4})\b", 1), lambda y: F.try_to_date(F.concat(y, F.lit("-01-01")), "yyyy-MM-dd"))
    return F.array_sort(F.array_distinct(F.filter(F.concat(iso, long, month, quarter), lambda d: d.isNotNull())))


def dates_apart(a: Column, b: Column, days: int = 365) -> Column:
    """Whether two texts both have dates and their nearest ones lie more than ``days`` apart: they do not contradict each other, they are of different times."""
    x, y = dates_in(a), dates_in(b)
    gaps = F.flatten(F.transform(x, lambda p: F.transform(y, lambda q: F.abs(F.datediff(p, q)))))
    return (F.size(x) > 0) & (F.size(y) > 0) & (F.array_min(gaps) > days)


def fields_in(text: Column, patterns: dict[str, list[str]]) -> Column:
    """A struct of the first group of the first pattern of each field that fits, null where none does."""
    first = lambda ps: F.coalesce(*[F.nullif(F.trim(F.regexp_extract(text, p, 1)), F.lit("")) for p in ps])
    return F.struct(*[first(ps).alias(f) for f, ps in patterns.items()])


def near_duplicates(rows: DataFrame, known: DataFrame, equal: list[str], amount: str, tolerance: float, id_col: str = "id") -> DataFrame:
    """(id, duplicate): whether a row has a known one that is equal in ``equal`` and whose amount is within ``tolerance`` of its own, found in buckets of that width and their neighbours."""
    cell = F.floor(F.col(amount) / tolerance)
    k = known.select(*equal, cell.alias("__cell"), F.col(amount).alias("__amount"))
    a = rows.select(id_col, *equal, F.col(amount).alias("__mine"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("__cell"))
    bounds = k.groupBy(*equal, "__cell").agg(F.min("__amount").alias("__lo"), F.max("__amount").alias("__hi"))
    # within a neighbour the nearest amount is its least or greatest; within the own bucket every amount is near enough
    hit = a.join(bounds, [*equal, "__cell"]).withColumn("own", F.col("__cell") == F.floor(F.col("__mine") / tolerance))
    near = F.col("own") | (F.abs(F.col("__lo") - F.col("__mine")) <= tolerance) | (F.abs(F.col("__hi") - F.col("__mine")) <= tolerance)
    return rows.select(id_col).join(hit.filter(near).select(id_col).distinct().withColumn("duplicate", F.lit(True)), id_col, "left").select(id_col, F.coalesce("duplicate", F.lit(False)).alias("duplicate"))


#: Phrases and tags that address a model instead of telling something, and what stands in their place.
INJECTIONS = [
    (r"ignore\s+(?:all\s+)?(?:prior|previous|above|earlier)\s+(?:instructions?|prompts?|messages?)", "[redacted]"), (r"forget\s+(?:everything|all\s+(?:of\s+)?the\s+above)", "[redacted]"),
    (r"disregard\s+(?:all\s+)?(?:prior|previous|above|earlier)\s+(?:instructions?|prompts?)", "[redacted]"), (r"(?:new|updated|revised)\s+instructions?:", "[redacted]:"), (r"system\s*:\s*(?:you\s+are|you\s+must|never|always)", "[redacted]"),
    (r"you\s+are\s+(?:now|actually|really)\s+an?\s+\w+", "[redacted]"), (r"\b(?:do\s+anything\s+now|developer\s+mode\s+enabled?)\b", "[redacted]"), (r"(?:print|output|reveal|show)\s+(?:your\s+)?(?:system\s+prompt|instructions?|hidden)", "[redacted]"),
    (r"(?:repeat|echo)\s+(?:back|verbatim)", "[redacted]"), (r"<\s*(/?)\s*(take|system|instructions?|trajectory)\b[^>]*>", "&lt;$1$2&gt;"), (r"\b(eval|exec|system|shell)\s*\(", "[redacted]("),
]


def sanitised(text: Column, longest: int = 500) -> Column:
    """A claim made harmless for a prompt: phrases that address the model are masked, tags escaped; at most ``longest`` characters (a limit of the feature)."""
    t = reduce(lambda c, p: F.regexp_replace(c, f"(?i){p[0]}", p[1]), INJECTIONS, text)
    return F.when(F.length(t) > longest, F.concat(F.substring(t, 1, longest - 3), F.lit("..."))).otherwise(t)


def redacted(text: Column) -> Column:
    """Names of two capitalised words, amounts of money and slugs replaced by marks."""
    t = F.regexp_replace(text, r"\b[a-z]+/[a-z0-9]+(?:-[a-z0-9]+)+\b", "<slug>")
    t = F.regexp_replace(t, r"[$€£]\s?\d[\d,.]*(?:\s?[kKmMbB]\b)?", "<amount>")
    return F.regexp_replace(t, r"\b\p{Lu}\p{Ll}+ \p{Lu}\p{Ll}+\b", "<name>")


def pointers(candidates: DataFrame, pages: DataFrame, aliases: DataFrame, most: int = 3, gate: float = 0.7) -> DataFrame:
    """(turn, page_id, confidence, how): pages to volunteer for the candidates (turn, candidate, repeated): 0.9 for an alias, 0.8 for a title, 0.6 for the end of a slug, 0.05 more if it
    was said more than once; from ``gate`` on, the best ``most`` of each turn.
    """
    c = candidates.select("turn", F.lower(F.trim("candidate")).alias("key"), slugify(F.col("candidate")).alias("tail"), F.when(F.col("repeated"), 0.05).otherwise(0.0).alias("more"))
    p = pages.filter("deleted_at is null")
    a = c.join(aliases.select(F.lower(F.trim("alias")).alias("key"), "page_id"), "key").select("turn", "page_id", (0.9 + F.col("more")).alias("confidence"), F.lit("alias").alias("how"))
    t = c.join(p.select(F.lower(F.trim("title")).alias("key"), F.col("id").alias("page_id")), "key").select("turn", "page_id", (0.8 + F.col("more")).alias("confidence"), F.lit("title").alias("how"))
    s = c.join(p.select(F.substring_index("slug", "/", -1).alias("tail"), F.col("id").alias("page_id")), "tail").select("turn", "page_id", (0.6 + F.col("more")).alias("confidence"), F.lit("suffix").alias("how"))
    best = a.unionAll(t).unionAll(s).groupBy("turn", "page_id").agg(F.max("confidence").alias("confidence"), F.max_by("how", "confidence").alias("how")).filter(F.col("confidence") >= gate)
    w = Window.partitionBy("turn").orderBy(F.desc("confidence"), F.asc("page_id"))
    return best.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= most).select("turn", "page_id", F.round("confidence", 2).alias("confidence"), "how")


def symbol_matches(symbols: DataFrame, names: DataFrame, most: int = 5) -> DataFrame:
    """(name, symbol, exact): the symbols that are a name, or, where there is none, up to ``most`` that contain it in any case, shortest first; names are a small, counted set."""
    n = broadcast_if_small(names.select("name").distinct())
    s = symbols.select("symbol").distinct()
    exact = s.join(n, F.col("symbol") == F.col("name")).select("name", "symbol", F.lit(True).alias("exact"))
    rest = broadcast_if_small(n.join(exact.select("name"), "name", "left_anti"))
    near = s.join(rest, F.contains(F.lower("symbol"), F.lower("name"))).withColumn("__rn", F.row_number().over(Window.partitionBy("name").orderBy(F.length("symbol"), "symbol"))).filter(F.col("__rn") <= most)
    return exact.unionByName(near.select("name", "symbol", F.lit(False).alias("exact")))
