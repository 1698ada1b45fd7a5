"""Column expressions shared by the operators; all of them run in the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Score factor by slug prefix; the longest matching prefix counts.
SOURCE_FACTORS = {
    "originals/": 1.5, "writing/": 1.4, "concepts/": 1.3, "people/": 1.2, "companies/": 1.2, "deals/": 1.2, "meetings/": 1.1, "media/articles/": 1.1, "media/repos/": 1.1,
    "yc/": 1.0, "civic/": 1.0, "daily/": 0.8, "media/x/": 0.7, "openclaw/chat/": 0.5, "archive/": 0.5, "extracts/": 0.3,
}
# Fixed values: (half-life in days, coefficient) by slug prefix; 0 means evergreen.
RECENCY = {
    "concepts/": (0, 0.0), "originals/": (180, 0.5), "writing/": (365, 0.4), "daily/": (14, 1.5), "meetings/": (60, 1.0), "chat/": (7, 1.0), "openclaw/chat/": (7, 1.0), "media/x/": (7, 1.5),
    "media/articles/": (90, 0.5), "people/": (365, 0.3), "companies/": (365, 0.3), "deals/": (180, 0.5),
}
RECENCY_DEFAULT = (90, 0.5)
HARD_EXCLUDED = ("test/", "attachments/", ".raw/")


def by_prefix(slug: Column, table: Mapping[str, float], default: float) -> Column:
    """A ``when`` chain from the longest prefix down."""
    out = None
    for p in sorted(table, key=lambda p: (-len(p), p)):
        c = slug.startswith(p)
        out = F.when(c, F.lit(table[p])) if out is None else out.when(c, F.lit(table[p]))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def source_factor(slug: Column, detail: str = "medium") -> Column:
    return F.lit(1.0) if detail == "high" else by_prefix(slug, SOURCE_FACTORS, 1.0)


def not_excluded(slug: Column, prefixes: Iterable[str] = HARD_EXCLUDED) -> Column:
    return ~reduce(lambda a, b: a | b, [slug.startswith(p) for p in prefixes], F.lit(False))


def age_days(stamp: Column, as_of: str) -> Column:
    return (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(stamp.cast("timestamp"))) / F.lit(86_400e6)


def recency(slug: Column, days: Column, clamp: bool = True) -> Column:
    """coefficient x half-life / (half-life + age); evergreen prefixes give 0."""
    h = by_prefix(slug, {k: float(v[0]) for k, v in RECENCY.items()}, float(RECENCY_DEFAULT[0]))
    c = by_prefix(slug, {k: v[1] for k, v in RECENCY.items()}, RECENCY_DEFAULT[1])
    d = F.greatest(days, F.lit(0.0)) if clamp else days
    return F.when((h == 0) | (c == 0), F.lit(0.0)).otherwise(c * h / (h + d))


def js_round(x: Column) -> Column:
    """Halves go up."""
    return F.floor(x + F.lit(0.5))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def words(text: Column) -> Column:
    """Runs of letters and digits, of any script, of the lower-case text."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def english_stem(word: Column) -> Column:
    """A word without the ending of an English plural (the three rules of the S-stemmer)."""
    return (
        F.when(word.rlike("[^ea]ies$"), F.regexp_replace(word, "ies$", "y")).when(word.rlike("ies$"), word)
        .when(word.rlike("[^aeo]es$"), F.regexp_replace(word, "es$", "e")).when(word.rlike("es$"), word).when(word.rlike("[^us]s$"), F.regexp_replace(word, "s$", "")).otherwise(word)
    )


def stems(text: Column) -> Column:
    return F.transform(words(text), english_stem)


def trigrams(text: Column) -> Column:
    """Distinct letter trigrams, each word padded with two blanks before and one behind."""
    padded = F.transform(words(text), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def _latin() -> tuple[str, str]:
    """Accented Latin letters and the plain ones they are decomposed to."""
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c))) for lo, hi in ((0xC0, 0x250), (0x1E00, 0x1F00)) for c in range(lo, hi)]
    plain = [(c, "".join(x for x in d if not unicodedata.combining(x))) for c, d in pairs if c == c.lower()]
    plain = [(c, p) for c, p in plain if len(p) == 1 and p.isascii()]
    return "".join(c for c, _ in plain), "".join(p for _, p in plain)


ACCENTED, PLAIN = _latin()


def slugify(text: Column) -> Column:
    plain = F.translate(F.lower(text), ACCENTED, PLAIN)
    return F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+$", "")
