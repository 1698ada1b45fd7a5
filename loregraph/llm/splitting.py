"""Splitting oversized texts at natural boundaries by recursive bisection.

A text over the limit is cut at the strongest boundary near its midpoint; each half still above ``limit - overlap`` is cut again.
Afterwards every piece but the first is extended to the left by the overlap. Sizes are in tokens of ``chars_per_token`` code points,
rounded up, measured on the text itself.
"""

from __future__ import annotations

import bisect
import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT_TOKENS, OVERLAP_TOKENS, CHARS_PER_TOKEN = 512, 64, 4
#: Code points of the texts whose pieces leave Python at once.
FRAME_CHARS = 8_000_000

#: Boundaries from strong to weak; the cut is made at the end of a match.
BOUNDARIES = [
    regex.compile(p)
    for p in (
        r"(?:\r\n|\r|\n)[ \t]*(?:(?:\r\n|\r|\n)[ \t]*)+(?=\S)|(?:\r\n|\r|\n)(?=#{1,6} )",  # paragraph, heading
        r"\r\n|[\r\n\u2028\u2029]",  # line
        r"[.!?…]+[\"'”’»)\]]*\s+|[。！？]+[」』”’）]*",  # sentence
        r"[;:,–—]\s+|[；：，、]",  # clause
        r"\s+",  # word
    )
]
_GRAPHEME_JOINERS = {"\u200d", "\ufe0f", "\ufe0e", "\u20e3"}


def splits_cluster(text: str, at: int) -> bool:
    """Whether a cut before ``text[at]`` tears apart what is read as one character."""
    if not 0 < at < len(text):
        return False
    c, before = text[at], text[at - 1]
    return (
        c in _GRAPHEME_JOINERS
        or before == "\u200d"
        or unicodedata.combining(c) != 0
        or unicodedata.category(c) in ("Mn", "Me", "Mc")
        or "\U0001f3fb" <= c <= "\U0001f3ff"
        or (before == "\r" and c == "\n")
        or ("\U0001f1e6" <= c <= "\U0001f1ff" and "\U0001f1e6" <= before <= "\U0001f1ff")
    )


def _hard_cut(text: str, at: int, low: int) -> int:
    while at > low + 1 and splits_cluster(text, at):
        at -= 1
    return at


def bisect_text(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """Pieces ``(start, end, overlap)`` in code points; ``start`` already includes the overlap of that many code points.

    The pieces without their overlaps follow one another and make up the whole text. ``limit`` and ``overlap`` are code points.
    """
    n = len(text)
    if n <= limit:
        return [(0, n, 0)]
    core = limit - overlap
    levels = [[m.end() for m in b.finditer(text)] for b in BOUNDARIES]

    def _inside(ends: list[int], mid: int, way: int, low: int, high: int) -> int:
        """The boundary nearest to ``mid`` on one side that lies within the part; 0 if there is none."""
        j = bisect.bisect_left(ends, mid) - (way < 0)
        while 0 <= j < len(ends) and low < ends[j] < high:
            if not splits_cluster(text, ends[j]):
                return ends[j]
            j += way
        return 0

    def cut(low: int, high: int) -> int:
        mid, reach = (low + high) // 2, max(1, (high - low) // 4)
        for ends in levels:
            k = bisect.bisect_left(ends, mid)
            near = [ends[j] for j in (k - 1, k) if 0 <= j < len(ends) and abs(ends[j] - mid) <= reach and low < ends[j] < high and not splits_cluster(text, ends[j])]
            if near:
                return min(near, key=lambda e: abs(e - mid))
        # no boundary in the middle half: the one nearest to the midpoint, wherever it is, unless it cuts off little and what is left has to be torn all the same
        far = [e for ends in levels for e in (_inside(ends, mid, -1, low, high), _inside(ends, mid, 1, low, high)) if e]
        at = min(far, key=lambda e: abs(e - mid), default=low)
        small, large = sorted((at - low, high - at))
        return at if small and (small >= core // 8 or large <= core) else _hard_cut(text, mid, low)

    todo, cores = [(0, n)], []
    while todo:
        low, high = todo.pop()
        if high - low <= core:
            cores.append((low, high))
        else:
            at = cut(low, high)
            todo += [(at, high), (low, at)]
    out = []
    for k, (low, high) in enumerate(cores):
        back = min(overlap, low - cores[k - 1][0]) if k else 0
        while back > 0 and splits_cluster(text, low - back):
            back -= 1
        out.append((low - back, high, back))
    return out


def token_size(text: Column, chars_per_token: int = CHARS_PER_TOKEN) -> Column:
    return F.ceil(F.char_length(text) / F.lit(chars_per_token)).cast("long")


def split_oversized(
    df: DataFrame, kind: str, id_col: str, text_col: str, *, limit: int = LIMIT_TOKENS, overlap: int = OVERLAP_TOKENS, chars_per_token: int = CHARS_PER_TOKEN
) -> DataFrame:
    """Pieces of every text larger than ``limit`` tokens.

    Columns: item_kind, item_id, item_tokens, piece_no (from 1), start_pos and end_pos (from 1, both included), overlap_chars, piece_tokens,
    piece_text. Null, empty and fitting texts give no rows; an id that occurs on several rows gives the pieces of each; other
    columns of ``df`` are not looked at. Texts without any boundary are cut in the middle, never inside a grapheme.
    """
    if not 0 <= overlap * 2 <= limit:
        raise ValueError("the overlap must be at most half the limit")
    over = df.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("t")).filter(token_size(F.col("t"), chars_per_token) > limit)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["item_id", "item_tokens", "piece_no", "start_pos", "end_pos", "overlap_chars", "piece_tokens", "piece_text"]
        for batch in batches:
            rows, size = [], 0
            for item, text in zip(batch["item_id"], batch["t"]):
                for k, (s, e, o) in enumerate(bisect_text(text, limit * chars_per_token, overlap * chars_per_token), 1):
                    rows.append((item, -(-len(text) // chars_per_token), k, s + 1, e, o, -(-(e - s) // chars_per_token), text[s:e]))
                size += len(text)
                if size > FRAME_CHARS:
                    yield pd.DataFrame(rows, columns=names)
                    rows, size = [], 0
            yield pd.DataFrame(rows, columns=names)

    schema = "item_id long, item_tokens long, piece_no int, start_pos int, end_pos int, overlap_chars int, piece_tokens int, piece_text string"
    return over.mapInPandas(run, schema).select(F.lit(kind).alias("item_kind"), "*")
