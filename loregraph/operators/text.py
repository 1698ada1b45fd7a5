"""Structure out of text: references, timelines, conversations, mentions, chunks, markdown."""

from __future__ import annotations

import hashlib
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loregraph.functions.expressions import words
from loregraph.session import broadcast_if_small, checkpointed


def entity_refs(pages: DataFrame, text: str = "compiled_truth") -> DataFrame:
    """(id, target, label): markdown links to pages and wiki links, outside code fences."""
    body = F.regexp_replace(text, r"(?s)```.*?```", "")
    md = F.regexp_extract_all(body, F.lit(r"\[([^\]\n]+)\]\(([a-z]+/[a-z0-9/-]+)(?:\.md)?\)"), 0)
    wiki = F.regexp_extract_all(body, F.lit(r"\[\[([^\]\n]+)\]\]"), 1)
    a = pages.select("id", F.explode(md).alias("m")).select("id", F.regexp_extract("m", r"\(([a-z]+/[a-z0-9/-]+)", 1).alias("target"), F.regexp_extract("m", r"\[([^\]]+)\]", 1).alias("label"))
    b = pages.select("id", F.explode(wiki).alias("m")).select("id", F.substring_index("m", "|", 1).alias("target"), F.substring_index("m", "|", -1).alias("label"))
    return a.unionAll(b).distinct()


def timeline_lines(pages: DataFrame, text: str = "timeline") -> DataFrame:
    """(id, date, summary): lines ``- **YYYY-MM-DD** | text`` with real dates."""
    line = pages.filter(F.col(text).isNotNull()).select("id", F.explode(F.split(text, r"\r?\n")).alias("l"))
    m = line.select("id", F.regexp_extract("l", r"^\s*-?\s*\*\*(\d{4}-\d{2}-\d{2})\*\*\s*[|–—-]\s*(.*)$", 1).alias("d"), F.regexp_extract("l", r"^\s*-?\s*\*\*(\d{4}-\d{2}-\d{2})\*\*\s*[|–—-]\s*(.*)$", 2).alias("summary"))
    return m.filter("d <> ''").withColumn("date", F.try_to_date("d", "yyyy-MM-dd")).filter("date is not null").select("id", "date", F.trim("summary").alias("summary"))


def speakers(pages: DataFrame, text: str = "compiled_truth") -> DataFrame:
    """(id, line_no, speaker, at, message): transcript lines ``**Name** (hh:mm): text`` and ``[hh:mm] Name: text``."""
    line = pages.filter(F.col(text).isNotNull()).select("id", F.posexplode(F.split(text, r"\r?\n")).alias("p", "l"))
    a, b = r"^\*\*([^*]+)\*\* \((\d{1,2}:\d{2})\): (.*)$", r"^\[(\d{1,2}:\d{2})\] ([^:]{1,60}): (.*)$"
    is_a = F.col("l").rlike(a)
    pick = lambda i, j: F.when(is_a, F.regexp_extract("l", a, i)).otherwise(F.regexp_extract("l", b, j))
    return line.filter(is_a | F.col("l").rlike(b)).select("id", (F.col("p") + 1).alias("line_no"), pick(1, 2).alias("speaker"), pick(2, 1).alias("at"), pick(3, 3).alias("message"))


def mentions(texts: DataFrame, gazetteer: DataFrame, id_col: str, text: str, least: int = 4) -> DataFrame:
    """(id, entity): names of the gazetteer (name, entity, source_id) that occur as runs of words in a text of their source, once per text and entity; a text's own name does not count.

    A word of a text is looked up among the first words of names, and only runs that begin with one are built, as long as the names that begin with it; so what is
    joined follows the mentions, not the words. Of names that begin at one word the longest that occurs counts.
    """
    w = words(F.col("name"))
    names = gazetteer.filter(F.length("name") >= least).select(F.array_join(w, " ").alias("run"), F.element_at(w, 1).alias("first"), F.size(w).alias("k"), "entity", "source_id").filter("run <> ''").distinct()
    starts = broadcast_if_small(names.groupBy("first").agg(F.sort_array(F.collect_set("k"), False).alias("ks")))
    longest_name = names.agg(F.max("k")).first()[0] or 1
    heads = F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.slice("w", i, longest_name))
    tokens = texts.select(F.col(id_col).alias("id"), "source_id", words(F.col(text)).alias("w")).filter("size(w) > 0").select("id", "source_id", F.posexplode(heads).alias("p", "head"))
    runs = tokens.withColumn("first", F.col("head")[0]).join(starts, "first").select("id", "source_id", "p", "head", F.explode("ks").alias("k")).filter("size(head) >= k")
    hit = runs.select("id", "source_id", "p", "k", F.array_join(F.slice("head", F.lit(1), F.col("k")), " ").alias("run")).join(broadcast_if_small(names.select("run", "entity", "source_id")), ["run", "source_id"])
    longest = hit.groupBy("id", "p").agg(F.max("k").alias("k"))
    return hit.join(longest, ["id", "p", "k"]).filter("id <> entity").select("id", "entity").distinct()


def strip_html(text: Column) -> Column:
    no = F.regexp_replace(text, r"(?is)<(script|style)\b.*?</(script|style)>", " ")
    no = F.regexp_replace(no, r"(?s)<!--.*?-->|<[^<>]+>", " ")
    return F.trim(F.regexp_replace(no, r"[ \t\r\n]+", " "))


def money_total(text: Column) -> Column:
    """The sum of amounts like $1,234.50 in a text."""
    amounts = F.transform(F.regexp_extract_all(text, F.lit(r"[$€£]([0-9][0-9,]*(?:\.[0-9]+)?)"), 1), lambda a: F.try_to_number(F.replace(a, F.lit(","), F.lit("")), F.lit("999999999999D99")))
    return F.aggregate(amounts, F.lit(0).cast("decimal(20,2)"), lambda s, a: (s + F.coalesce(a, F.lit(0))).cast("decimal(20,2)"))


def link_type(context: Column) -> Column:
    c = F.lower(context)
    return F.when(c.rlike(r"\b(founded|founder|co-founded|started)\b"), "founded").when(c.rlike(r"\b(invested|investor|backed|led the round)\b"), "invested_in").when(c.rlike(r"\b(advises|adviser|advisor|mentor)\b"), "advises").when(c.rlike(r"\b(works at|engineer|joined|employee|head of)\b"), "works_at").otherwise("mentions")


def typed_link(context: Column, page_type: Column, target: Column, role: Column | None = None) -> Column:
    """The link type by the page: media only mentions, a meeting's people attended it; else by the context, and for a person whose own role (a text about them) tells it, by that."""
    by = link_type(context)
    prior = F.when(F.lower(role).rlike(r"\b(partner|investor|venture|fund)\b"), "invested_in").when(F.lower(role).rlike(r"\badvis(?:e|o)r\b"), "advises").otherwise("mentions") if role is not None else F.lit("mentions")
    rest = F.when((by == "mentions") & (page_type == "person") & target.startswith("companies/"), prior).otherwise(by)
    return F.when(page_type == "media", "mentions").when((page_type == "meeting") & target.startswith("people/"), "attended").otherwise(rest)


@F.pandas_udf(StringType())
def alias_norm(s: pd.Series) -> pd.Series:
    """NFKC, lower case, single blanks, without wrapping quotes."""
    return s.map(lambda x: None if x is None else re.sub(r"\s+", " ", unicodedata.normalize("NFKC", x).lower()).strip(" \"'“”‘’()[]"))


_LEVELS = [re.compile(p) for p in (r"\n{2,}", r"\n", r"(?<=[.!?])\s+|(?<=[。！？])", r"(?<=[;:,])\s+|(?<=[；：，、])", r"\s+")]
_CJK = re.compile(r"[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af\uf900-\ufaff]")


def count_words(text: str, dense: float = 0.30) -> int:
    """Words between blanks; characters where at least ``dense`` of the text is written without blanks."""
    w = text.split()
    n = sum(map(len, w))
    return n if n and len(_CJK.findall(text)) >= dense * n else len(w)


def chunk_spans(text: str, target: int = 300, overlap: int = 50, most_chars: int = 6_000) -> list[tuple[int, int, int]]:
    """(begin, core, end) of chunks of about ``target`` words, cut at the strongest delimiter that makes small enough parts and merged again up to half more than that.

    The cores follow one another and make up the whole text; each chunk begins with the last ``overlap`` words of the one before. A chunk of more than ``most_chars`` characters is cut
    there, with a tenth of that, 500 at most, of overlap.
    """

    def parts(s: int, e: int, level: int) -> list[tuple[int, int]]:
        if count_words(text[s:e]) <= target:
            return [(s, e)]
        if level == len(_LEVELS):
            step = max(1, target)
            return [(k, min(k + step, e)) for k in range(s, e, step)]  # one word, or a text without blanks
        cuts = [s, *(m.end() for m in _LEVELS[level].finditer(text, s, e) if s < m.end() < e), e]
        if level == len(_LEVELS) - 1:
            cuts = [*cuts[:-1:target], e] if len(cuts) > 2 else cuts
        return [p for x, y in zip(cuts, cuts[1:]) for p in parts(x, y, level + 1)]

    cores: list[list[int]] = []
    size = 0
    for s, e in parts(0, len(text), 0):
        n = count_words(text[s:e])
        if cores and size < target and size + n <= target * 1.5:
            cores[-1][1], size = e, size + n
        else:
            cores.append([s, e])
            size = n
    out = []
    for k, (s, e) in enumerate(cores):
        begin = s
        if k and overlap:
            starts = [m.start() for m in re.finditer(r"\S+", text[cores[k - 1][0] : s])][-overlap:]
            begin = cores[k - 1][0] + starts[0] if starts else s
        if e - begin <= most_chars:
            out.append((begin, s, e))
            continue
        lap, at = min(500, most_chars // 10), s
        while at < e:
            lead = max(begin if at == s else at - lap, at - most_chars // 2)
            stop = min(e, lead + most_chars)
            out.append((lead, at, stop))
            at = stop
    return out


def chunk_text(text: str | None, target: int = 300, overlap: int = 50, most_chars: int = 6_000) -> list[str]:
    """The chunks of a body without its tables of claims and without its private facts; blank ones are left out."""
    from loregraph.operators.fences import FENCES, strip_facts

    body = strip_facts(FENCES["takes"].sub("", text or ""), {"world"})
    return [c for b, _, e in (chunk_spans(body, target, overlap, most_chars) if body.strip() else []) if (c := body[b:e].strip())]


def recursive_chunks(df: DataFrame, id_col: str, text: str, target: int = 300, overlap: int = 50, most_chars: int = 6_000) -> DataFrame:
    """(id, chunk_index, chunk, words) of every text; null and blank texts give no chunk."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, k, c, count_words(c)) for i, t in zip(b["id"], b["t"]) for k, c in enumerate(chunk_text(t, target, overlap, most_chars))]
            yield pd.DataFrame(rows, columns=["id", "chunk_index", "chunk", "words"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("t")).mapInPandas(run, "id long, chunk_index int, chunk string, words int")


def to_markdown(pages: DataFrame) -> DataFrame:
    """(id, markdown): front matter, body and timeline; the inverse of ``from_markdown``."""
    head = F.concat(F.lit("---\n"), F.coalesce("frontmatter", F.lit("{}")), F.lit("\n---\n"))
    tail = F.when(F.coalesce("timeline", F.lit("")) == "", "").otherwise(F.concat(F.lit("\n\n<!-- timeline -->\n"), "timeline"))
    return pages.select("id", F.concat(head, F.coalesce("compiled_truth", F.lit("")), tail).alias("markdown"))


def from_markdown(docs: DataFrame) -> DataFrame:
    m = r"(?s)\A---\n(.*?)\n---\n(.*)\z"
    rest = F.regexp_extract("markdown", m, 2)
    cut = F.locate("\n\n<!-- timeline -->\n", rest)
    return docs.select("id", F.regexp_extract("markdown", m, 1).alias("frontmatter"), F.when(cut > 0, F.substring(rest, F.lit(1), cut - 1)).otherwise(rest).alias("compiled_truth"), F.when(cut > 0, F.substring(rest, cut + 20, F.length(rest))).otherwise("").alias("timeline"))


def sections(pages: DataFrame, text: str = "compiled_truth") -> DataFrame:
    """(id, line_no, level, heading) of markdown headings."""
    line = pages.filter(F.col(text).isNotNull()).select("id", F.posexplode(F.split(text, r"\r?\n")).alias("p", "l")).filter(F.col("l").rlike(r"^#{1,6} \S"))
    return line.select("id", (F.col("p") + 1).alias("line_no"), F.length(F.regexp_extract("l", r"^(#+)", 1)).alias("level"), F.trim(F.regexp_replace("l", r"^#+ ", "")).alias("heading"))


def distinct_texts(texts: list[str | None], limit: float) -> list[bool]:
    """Of texts in order, those whose set of lower-case words is not nearer than ``limit`` (Jaccard) to one already kept."""
    kept: list[set[str]] = []
    out = []
    for t in texts:
        s = set((t or "").lower().split())
        out.append(all(len(s & k) <= limit * len(s | k) for k in kept if min(len(s), len(k)) >= limit * max(len(s), len(k)) and (s or k)))
        if out[-1]:
            kept.append(s)
    return out


def greedy_distinct(results: DataFrame, by: str, order: list[str], ascending: list[bool], text: str, limit: float = 0.85) -> DataFrame:
    """Of each ranking the rows whose text is not nearer than ``limit`` to a better one that is kept; for result lists, which are short by construction. Texts alone and row keys
    go to Python; a null text is kept.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(order, ascending=ascending, kind="stable")
        known = g[text].notna()
        keep = pd.Series(True, index=g.index)
        keep[known] = distinct_texts(g.loc[known, text].tolist(), limit)
        return g[keep]

    return results.groupBy(by).applyInPandas(run, results.schema)


#: Bits of the parity marks of a set of words.
MARK_BITS = 256


def word_marks(text: str | None) -> tuple[int, bytes, bytes] | None:
    """Size, parity marks and digest of the set of lower-case words; None for a null or empty one. Each word flips one bit, so two sets differ by as many words as their marks by bits, at least."""
    s = set((text or "").lower().split())
    if not s:
        return None
    bits = 0
    for w in s:
        bits ^= 1 << (zlib.crc32(w.encode("utf-8", "surrogatepass")) % MARK_BITS)
    return len(s), bits.to_bytes(MARK_BITS // 8, "little"), hashlib.blake2b(" ".join(sorted(s)).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def may_be_near(size: np.ndarray, marks: np.ndarray, limit: float) -> np.ndarray:
    """Whether each set may be nearer than ``limit`` to another: sets of Jaccard ``limit`` differ by (1 - limit) / (1 + limit) of their joint sizes at most. Never false for sets that are."""
    out = np.zeros(len(size), bool)
    for a in range(0, len(size), 512):
        apart = np.bitwise_count(marks[a : a + 512, None, :] ^ marks[None, :, :]).sum(axis=2, dtype=np.int64)
        n, m = size[a : a + 512, None], size[None, :]
        near = (apart <= (1 - limit) / (1 + limit) * (n + m) + 1e-6) & (np.minimum(n, m) >= limit * np.maximum(n, m) - 1e-6)
        near[np.arange(len(near)), a + np.arange(len(near))] = False
        out[a : a + 512] = near.any(axis=1)
    return out


def greedy_distinct_rows(results: DataFrame, docs: DataFrame, by: str, order: list[str], ascending: list[bool], key: str, text: str, limit: float = 0.85) -> DataFrame:
    """The rows of ``results`` that ``greedy_distinct`` keeps, with texts looked up in ``docs`` (``key``, ``text``), below 1 for ``limit``.

    Texts do not go along: sizes, marks and digests of their words do, which tell most rows from all others and equal sets apart from the rest; texts are fetched for rows alone that these leave open.
    """

    def mark(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in parts:
            got = [word_marks(t) for t in d[text]]
            known = [g is not None for g in got]
            yield pd.DataFrame({key: d[key][known], **{c: pd.Series([g[i] for g in got if g], index=d.index[known], dtype=kind) for i, (c, kind) in enumerate((("__n", "int32"), ("__bits", "object"), ("__same", "object")))}})

    def sift(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(order, ascending=ascending, kind="stable")
        g = g[g["__n"].isna() | ~g["__same"].duplicated()]
        known = g["__n"].notna().to_numpy()
        ask = np.zeros(len(g), bool)
        if known.any():
            marks = np.frombuffer(b"".join(bytes(x) for x in g["__bits"][known]), np.uint64).reshape(-1, MARK_BITS // 64)
            ask[known] = may_be_near(g["__n"][known].to_numpy(np.int64), marks, limit)
        return g.drop(columns=["__n", "__bits", "__same"]).assign(__ask=ask)

    cols = list(dict.fromkeys([by, *order, key]))
    kind = dict(docs.dtypes)[key]
    marks = docs.select(key, text).mapInPandas(mark, f"{key} {kind}, __n int, __bits binary, __same binary")
    lean = results.filter(F.col(key).isNotNull()).select(*cols)
    sifted = checkpointed(lean.join(marks, key, "left").groupBy(by).applyInPandas(sift, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in lean.schema) + ", __ask boolean"))
    asked = sifted.filter("__ask").drop("__ask")
    texts = docs.select(key, text).join(broadcast_if_small(asked.select(key).distinct()), key, "left_semi")
    kept = greedy_distinct(asked.join(texts, key).select(*cols, text), by, order, ascending, text, limit)
    some = results.join(sifted.filter("not __ask").select(by, key).unionAll(kept.select(by, key)), [by, key], "left_semi").select(*results.columns)
    return some.unionAll(results.filter(F.col(key).isNull()))  # rows without a text to look up are kept


def semantic_breaks(vectors: DataFrame, by: str, order: str, vec: str, share: float = 0.2) -> DataFrame:
    """(by, order, segment): a new segment begins where the similarity to the row before is a local minimum of the smoothed curve below its ``share`` quantile.

    The curve is smoothed by the quadratic five-point filter, in windows over neighbours; sequences are not collected.
    """
    from loregraph.functions.expressions import cosine

    w = Window.partitionBy(by).orderBy(order)
    s = vectors.withColumn("c", cosine(F.col(vec), F.lag(vec).over(w)))
    at = lambda k: F.coalesce(F.lead("c", k).over(w) if k > 0 else F.lag("c", -k).over(w) if k < 0 else F.col("c"), F.col("c"))
    s = s.withColumn("smooth", (-3 * at(-2) + 12 * at(-1) + 17 * at(0) + 12 * at(1) - 3 * at(2)) / 35)
    s = checkpointed(s.select(by, order, "smooth"))
    low = broadcast_if_small(s.groupBy(by).agg(F.percentile("smooth", F.lit(share)).alias("__low")))
    s = s.join(low, by)
    cut = (F.col("smooth") <= F.col("__low")) & (F.col("smooth") <= F.coalesce(F.lag("smooth").over(w), F.lit(2.0))) & (F.col("smooth") < F.coalesce(F.lead("smooth").over(w), F.lit(2.0)))
    from loregraph.operators.stats import running

    return running(s.select(by, order, F.coalesce(cut, F.lit(False)).cast("int").alias("cut")), [by], [order], F.col("cut"), "segment").select(by, order, "segment")
