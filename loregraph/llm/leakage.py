"""Evaluation passages that leaked into a corpus: rare n-gram seeds join documents to items, Smith-Waterman alignment scores the copies, an exact check measures them.

A copy of ``MIN_WORDS`` words or more with at most one altered in ten holds an unaltered run of six words (20 words with two altered: 6 x 6 x 6), that is two five-word
seeds in a row. Of every two neighbouring seeds of a passage the rarer one, by the documents and items that have it, is joined, so that boilerplate between rarer words costs
nothing, and still every such run has a seed. In each run the alignment is computed in a band along its diagonal. Its score is a proven gate: no copy scores less than
``least_score``. The best alignment alone would not do to measure a copy, for it ends where a short run beyond an altered word does not pay for the edit; so the copies that
pass the gate are measured by edit distances on both sides of their run.
"""

from __future__ import annotations

import re as stdre
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex as re
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loregraph.session import broadcast_if_small, checkpointed

SEED_WORDS, CHAIN, MIN_WORDS, ALTERED_SHARE = 5, 2, 15, 0.1
MATCH, EDIT = 1, -1
#: Bits of the filter that drops words which are in no seed, for each seed of the items, and its bounds: at most 32 MB, whatever the items.
FILTER_BITS, LEAST_BITS, MOST_BITS = 32, 23, 28
#: Hits of a seed in documents from which its rows are spread over several tasks.
HOT_SEED = 100_000

_TAG = stdre.compile(r"<[^<>]{1,200}>|&#?\w{1,10};")
_FORMAT = re.compile(r"\p{Cf}+")
_WORDS = re.compile(r"[\p{L}\p{M}\p{N}]+")
#: The same where no marks are left beside their letters.
_PLAIN_WORDS, _MARK = stdre.compile(r"[^\W_]+"), re.compile(r"\p{M}")
_MULTIPLIER = 0x9E3779B97F4A7C15


def words_of(text: str | None) -> list[str]:
    """The words of a text without case, punctuation, markup, spacing and invisible characters."""
    if not text:
        return []
    find = _PLAIN_WORDS
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _FORMAT.sub("", text))
        find = _WORDS if _MARK.search(text) else find
    return find.findall(_TAG.sub(" ", text).casefold())


class Hasher:
    """Hashes of the n-grams of a word list; word hashes are kept."""

    def __init__(self, n: int = SEED_WORDS, keep: int = 1_000_000) -> None:
        self.n, self.keep, self.known = n, keep, {}

    def __call__(self, words: list[str]) -> np.ndarray:
        if len(words) < self.n:
            return np.empty(0, np.int64)
        if len(self.known) > self.keep:
            self.known.clear()
        known = self.known
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        h = np.array([known[w] for w in words], dtype=np.uint64)
        out = np.zeros(len(words) - self.n + 1, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(self.n):
                out = out * np.uint64(_MULTIPLIER) + h[k : k + len(out)]
        return out.view(np.int64)


def least_score(min_words: int = MIN_WORDS, share: float = ALTERED_SHARE) -> int:
    """The lowest alignment score that a copy of ``min_words`` passage words or more, with at most ``share`` of them altered, can have."""
    return min(n * MATCH + int(share * n) * (EDIT - MATCH) for n in range(min_words, min_words + int(1 / share) + 1))


def least_seeds(min_words: int = MIN_WORDS, share: float = ALTERED_SHARE) -> int:
    """The fewest seeds that such a copy shares with the passage: each altered word spoils as many as a seed has words, and an end of unaltered words has fewer by one."""
    return max(CHAIN, min(n - int(share * n) - (SEED_WORDS - 1) * (int(share * n) + 1) for n in range(min_words, min_words + int(1 / share) + 1)))


def alignment_score(passage: list[int], words: np.ndarray, diagonal: int, band: int) -> int:
    """Smith-Waterman: the score of the best local alignment that stays within ``band`` words of a diagonal (position in the words less position in the passage).

    A row of the table for each passage word, as wide as the band; the gaps along a row are a running maximum. Words that lie outside the list match nothing.
    """
    width = 2 * band + 1
    padded = np.full(len(passage) + width, -1)
    low = diagonal - band
    lo, hi = max(0, low), min(len(words), low + len(padded))
    if lo < hi:
        padded[lo - low : hi - low] = words[lo:hi]
    ramp = -EDIT * np.arange(width)
    row, best = np.zeros(width, np.int64), 0
    for i, w in enumerate(passage):
        new = row + np.where(padded[i : i + width] == w, MATCH, EDIT)
        new[:-1] = np.maximum(new[:-1], row[1:] + EDIT)
        row = np.maximum.accumulate(np.maximum(new, 0) + ramp) - ramp
        best = max(best, int(row.max()))
    return best


def reaches(passage: list[str], words: list[str], edits: int) -> list[tuple[int, int]]:
    """How far a copy goes on from the beginning of both lists with 0, 1, ... ``edits`` words altered: (passage words, words), the last ones equal; (0, 0) if there are none.

    Edit distances by rows of the passage, in the band that so many edits can reach.
    """
    far = [(0, 0)] * (edits + 1)
    ids: dict[str, int] = {}
    p = [ids.setdefault(w, len(ids)) for w in passage]
    width, never = 2 * edits + 1, edits + 1
    # column c of row i stands for i + c - edits words
    t = np.full(len(p) + width + 1, -1)
    known = [ids.get(w, -1) for w in words[: len(t) - edits - 1]]
    t[edits + 1 : edits + 1 + len(known)] = known
    ramp = np.arange(width)
    row = np.where(ramp >= edits, ramp - edits, never)
    for i, w in enumerate(p, 1):
        here = t[i : i + width]
        same = here == w
        for e in range(int(row[same].min(initial=never)), never):
            c = int(np.flatnonzero(same & (row <= e))[0])
            far[e] = (i, i + c - edits)
        new = row + ~same
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        new = np.minimum.accumulate(new - ramp) + ramp
        new[: max(0, edits - i)] = never  # before the first word
        row = np.minimum(new, never)
        if row.min() > edits:
            break
    return far


def extend(passage: list[str], words: list[str], at: int, pos: int, n: int, share: float = ALTERED_SHARE) -> tuple[int, int, int]:
    """The longest copy around ``n`` equal words, which begin at ``at`` in the passage and at ``pos`` in the words: (passage words, altered, where it begins in the words).

    At most ``share`` of the passage words are altered; it begins and ends with equal words.
    """
    most = int(share * len(passage))
    near = len(passage) + most + 1
    left = reaches(passage[:at][::-1], words[max(0, pos - near) : pos][::-1], most)
    right = reaches(passage[at + n :], words[pos + n : pos + n + near], most)
    found = [(a + n + b, -(x + y), pos - back) for x, (a, back) in enumerate(left) for y, (b, _) in enumerate(right) if x + y <= share * (a + n + b)]
    size, less, begin = max(found)
    return size, -less, begin


def runs(doc: np.ndarray, item: np.ndarray, step: int = 20_000) -> list[tuple[int, int, int]]:
    """(position in the document, position in the passage, seeds) of the longest runs of equal seeds in a row, given the seeds of both.

    Documents are read in steps, so that memory is bounded by the step and the passage.
    """
    order = np.argsort(item, kind="stable")
    ranked = item[order]
    at = np.flatnonzero(np.isin(doc, ranked))
    open_, out = {}, []
    for a in range(0, len(at), step):
        pos = at[a : a + step]
        lo, hi = np.searchsorted(ranked, doc[pos]), np.searchsorted(ranked, doc[pos], "right")
        n = hi - lo
        p = np.repeat(pos, n)
        q = order[np.repeat(lo, n) + np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n)]
        by = np.lexsort((p, p - q))
        p, q = p[by], q[by]
        first = np.flatnonzero(np.r_[True, (p[1:] - q[1:] != p[:-1] - q[:-1]) | (p[1:] != p[:-1] + 1)])
        for x, y in zip(first, np.r_[first[1:], len(p)]):
            d, i, k = int(p[x]), int(q[x]), int(y - x)
            before = open_.pop((d, i), None)  # a run that the end of the last step cut
            if before:
                d, i, k = before[0], before[1], before[2] + k
            if len(pos) == step and d + k == int(pos[-1]) + 1:
                open_[(d + k, i + k)] = (d, i, k)
            else:
                out.append((d, i, k))
        late = [key for key in open_ if key[0] <= int(pos[0])]
        out += [open_.pop(key) for key in late]
    return [*out, *open_.values()]


def best_copy(passage: list[str], words: list[str], found: list[tuple[int, int, int]], min_words: int, share: float = ALTERED_SHARE) -> tuple[int, int, int, int] | None:
    """(passage words, altered, where it begins in the words, alignment score) of the longest copy around one of the runs ``found``; None if there is none."""
    band, gate, few = int(share * len(passage)), least_score(min_words, share), least_seeds(min_words, share)
    near = len(passage) + 2 * band + 1
    # runs of one seed, and runs that have too few seeds near them, begin no copy
    r = np.array(found).reshape(-1, 3)
    r = r[np.lexsort((r[:, 0], r[:, 0] - r[:, 1]))]
    diag = r[:, 0] - r[:, 1]
    lo, hi = np.searchsorted(diag, diag - band), np.searchsorted(diag, diag + band, "right")
    seeds = [int(r[a:b][abs(r[a:b, 0] - x) <= near, 2].sum()) if n >= CHAIN else 0 for a, b, x, n in zip(lo, hi, r[:, 0], r[:, 2])]
    todo = [(int(a), int(b), int(n)) for (a, b, n), k in zip(r, seeds) if k >= few]
    if not todo:
        return None
    ids: dict[str, int] = {}
    p = [ids.setdefault(w, len(ids)) for w in passage]
    w = np.array([ids.get(x, -2) for x in words])
    best = None
    for pos, at, n in todo:
        score = alignment_score(p, w, pos - at, band)
        if score < gate:
            continue
        size, k, begin = extend(passage, words, at, pos, n + SEED_WORDS - 1, share)
        if size >= min_words:
            best = max(best or (0, 0, 0, 0), (size, -k, begin, score))
    return best and (best[0], -best[1], best[2], best[3])


def _seeds(items: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        for b in batches:
            for item, passage in zip(b["passage_id"], b["passage"]):
                g = hasher(words_of(passage))
                yield pd.DataFrame({"gram": g, "passage_id": item, "at": np.arange(len(g))})

    return items.mapInPandas(run, "gram long, passage_id long, at int")


def _seed_filter(seeds: DataFrame) -> tuple[np.ndarray, int]:
    """A bit for each residue of a seed; its size follows the number of seeds between two bounds. A word list is dropped early or late, never wrongly."""
    bits = int(np.clip(np.ceil(np.log2(FILTER_BITS * max(seeds.count(), 1))), LEAST_BITS, MOST_BITS))
    cell = F.shiftright("bit", 6)
    rows = seeds.select(F.col("gram").bitwiseAND(F.lit((1 << bits) - 1)).alias("bit")).groupBy(cell.alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("v"))
    got = rows.toPandas()  # at most 2 ** (MOST_BITS - 6) rows of the filter itself
    out = np.zeros(1 << (bits - 6), np.int64)
    out[got["cell"].to_numpy(np.int64)] = got["v"].to_numpy(np.int64)
    return out.view(np.uint64), bits


def in_filter(table: np.ndarray, bits: int, grams: np.ndarray) -> np.ndarray:
    g = grams.view(np.uint64) & np.uint64((1 << bits) - 1)
    return (table[(g >> np.uint64(6)).astype(np.int64)] >> (g & np.uint64(63))) & np.uint64(1) == 1


def find_leaks(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document and leaked item: doc_id, item_id, copied_words, altered_words, passage_words, first_word (of the copy in the document, from 1), score.

    Null and empty texts and passages match nothing; a passage of fewer than ``min_words`` words can't leak. A document that holds several copies of an item reports the
    longest; rows that repeat a doc_id count as one document. An item passage that repeats under several ids is searched once and leaks under each. Whole texts are read, whatever
    their length, and every run of seeds is measured. Other columns are not looked at; empty tables give an empty result.
    """
    spark = docs.sparkSession
    its = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(passage).alias("passage")).filter("passage is not null").withColumn("passage_id", F.xxhash64("passage"))
    passages = checkpointed(its.groupBy("passage_id").agg(F.first("passage").alias("passage")))
    seeds = checkpointed(_seeds(passages))
    wanted = spark.sparkContext.broadcast(_seed_filter(seeds))

    def hits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, (table, bits) = Hasher(), wanted.value
        for b in batches:
            rows = []
            for doc, t in zip(b["doc_id"], b["t"]):
                words = words_of(t)
                g = hasher(words)
                if len(g) < CHAIN:
                    continue
                hit = in_filter(table, bits, g)
                pair = hit[1:] & hit[:-1]  # a copy has two seeds in a row
                hit[0], hit[-1], hit[1:-1] = pair[0], pair[-1], pair[1:] | pair[:-1]
                if hit.any():
                    at = np.flatnonzero(hit)
                    three = np.unique(np.stack([g[at], g[np.maximum(at - 1, 0)], g[np.minimum(at + 1, len(g) - 1)]], axis=1), axis=0)
                    rows.append((doc, " ".join(words), *three.T))
            yield pd.DataFrame(rows, columns=["doc_id", "words", "grams", "before", "after"])

    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t")).filter(F.col("t").isNotNull())
    found = checkpointed(src.mapInPandas(hits, "doc_id long, words string, grams array<long>, before array<long>, after array<long>"))
    at = found.select("doc_id", F.xxhash64("words").alias("words_id"), F.inline(F.arrays_zip("grams", "before", "after"))).withColumnRenamed("grams", "gram")
    docs_with = at.groupBy("gram").agg(F.count("*").alias("n_docs"))
    known = seeds.join(docs_with, "gram", "left").withColumn("cost", F.coalesce("n_docs", F.lit(0)) * F.count("*").over(Window.partitionBy("gram")))
    # of two neighbours the rarer; the last seed of a passage and the first have one neighbour each
    w = Window.partitionBy("passage_id").orderBy("at")
    rarer = (F.col("cost") <= F.lead("cost").over(w)) | (F.col("cost") < F.lag("cost").over(w))
    beside = [F.lag("gram").over(w).alias("item_before"), F.lead("gram").over(w).alias("item_after")]
    chosen = checkpointed(known.select("*", *beside, F.coalesce(rarer, F.lit(False)).alias("rarer")).filter("rarer and cost > 0").select("gram", "passage_id", "n_docs", "item_before", "item_after").distinct())
    # seeds that very many documents hold are spread: their documents by hash, their passages to each part
    hot = broadcast_if_small(chosen.filter(F.col("n_docs") > HOT_SEED).select("gram", F.ceil(F.col("n_docs") / F.lit(HOT_SEED)).cast("int").alias("parts")).distinct())
    part = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"), F.lit(0)).alias("part")
    parts = F.explode(F.sequence(F.lit(0), F.coalesce(F.ceil(F.col("n_docs") / F.lit(HOT_SEED)), F.lit(1)).cast("int") - 1)).alias("part")
    left = at.join(hot, "gram", "left").select("doc_id", "words_id", "gram", "before", "after", part)
    right = broadcast_if_small(chosen.select("gram", "passage_id", "item_before", "item_after", parts), 500_000)
    # the seed beside it is shared, too
    pairs = left.join(right, ["gram", "part"]).filter("before = item_before or after = item_after").select("doc_id", "words_id", "passage_id").distinct()

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, passages_, few = Hasher(), {}, least_seeds(min_words)
        for b in batches:
            out = []
            for doc, words, items_ in zip(b["doc_id"], b["words"], b["items"]):
                w = words.split(" ")
                wg = hasher(w)
                for x in items_:
                    item = x["passage_id"]
                    if item not in passages_:
                        if len(passages_) >= 100_000:
                            passages_.clear()
                        p = words_of(x["passage"])
                        passages_[item] = p, (g := hasher(p)), np.sort(g)
                    p, pg, ranked = passages_[item]
                    if (ranked[np.minimum(np.searchsorted(ranked, wg), len(ranked) - 1)] == wg).sum() < few:
                        continue  # too few seeds in common, wherever they stand
                    if got := best_copy(p, w, runs(wg, pg), min_words):
                        out.append((doc, item, got[0], got[1], len(p), got[2] + 1, got[3]))
            yield pd.DataFrame(out, columns=["doc_id", "passage_id", "copied_words", "altered_words", "passage_words", "first_word", "score"])

    words = found.select("doc_id", F.xxhash64("words").alias("words_id"), "words")
    # one row for a document: its text is sent to Python once, whatever the number of passages
    asked = pairs.join(broadcast_if_small(passages), "passage_id").groupBy("doc_id", "words_id").agg(F.collect_list(F.struct("passage_id", "passage")).alias("items"))
    todo = asked.join(words, ["doc_id", "words_id"]).select("doc_id", "words", "items")
    scored = todo.mapInPandas(score, "doc_id long, passage_id long, copied_words int, altered_words int, passage_words int, first_word int, score int")
    best = F.max(F.struct("copied_words", (-F.col("altered_words")).alias("less"), "passage_words", "first_word", "score")).alias("b")
    got = scored.groupBy("doc_id", "passage_id").agg(best).join(broadcast_if_small(its.select("passage_id", "item_id")), "passage_id")
    return got.select("doc_id", "item_id", "b.copied_words", (-F.col("b.less")).alias("altered_words"), "b.passage_words", "b.first_word", "b.score").distinct()
