"""Chat logs: the format of a log is told by the share of its lines that fit, then every message is read with the lines that continue it."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_NAME, _CLOCK, _ISO = r"(?P<who>[^:\n|\[\]]{1,60}?)", r"(?P<time>\d{1,2}:\d{2}(?::\d{2})?(?:[ \u202f]?[AaPp][Mm])?)", r"(?P<date>\d{4}-\d{2}-\d{2})"
_US, _EU = r"(?P<date>\d{1,2}/\d{1,2}/\d{2,4})", r"(?P<date>\d{1,2}\.\d{1,2}\.\d{2,4})"
#: Formats, those that say most first: exports of chat programs, meeting notes, subtitles, plain dialogue.
FORMATS = {
    name: re.compile(p)
    for name, p in {
        "bold_dated": rf"^\*\*(?P<who>[^*]{{1,60}})\*\* \({_ISO}[ T]{_CLOCK}\): ?(?P<text>.*)$",
        "bracket_iso": rf"^\[{_ISO},? {_CLOCK}\] {_NAME}: ?(?P<text>.*)$",
        "bracket_us": rf"^\u200e?\[{_US},? {_CLOCK}\] {_NAME}: ?(?P<text>.*)$",
        "bracket_eu": rf"^\u200e?\[{_EU},? {_CLOCK}\] {_NAME}: ?(?P<text>.*)$",
        "dash_us": rf"^{_US},? {_CLOCK} [-–] {_NAME}: ?(?P<text>.*)$",
        "dash_eu": rf"^{_EU},? {_CLOCK} [-–] {_NAME}: ?(?P<text>.*)$",
        "log_iso": rf"^{_ISO}[ T]{_CLOCK}Z? (?:[-–] )?<?{_NAME}>?: ?(?P<text>.*)$",
        "pipe": rf"^{_ISO} {_CLOCK} ?\| ?(?P<who>[^|]{{1,60}}?) ?\| ?(?P<text>.*)$",
        "bold_bracket": rf"^\*\*\[{_CLOCK}\] (?P<who>[^*:]{{1,60}}):\*\* ?(?P<text>.*)$",
        "bold_paren": rf"^\*\*(?P<who>[^*]{{1,60}})\*\* \({_CLOCK}\) ?: ?(?P<text>.*)$",
        "bracket_time": rf"^\[{_CLOCK}\] <?{_NAME}>?: ?(?P<text>.*)$",
        "angle": rf"^{_CLOCK} <(?P<who>[^>]{{1,60}})> (?P<text>.*)$",
        "bold_name": r"^\*\*(?!\[)(?P<who>[^*:]{1,60}):\*\* ?(?P<text>.*)$",
        "dialogue": r"^(?P<who>\w[\w.'’ -]{0,40}): (?P<text>\S.*)$",
    }.items()
}
HEAD_LINES, SURE, LEAST = 10, 0.3, 0.05


def best_format(lines: list[str]) -> str | None:
    """The format most lines fit: of the first ten that are not blank, or, where fewer than three in ten of them fit any, of all; None below one in twenty."""
    full = [x for x in lines if x.strip()]
    for part, least in ((full[:HEAD_LINES], SURE), (full, LEAST)):
        if not part:
            return None
        share = {f: sum(bool(p.match(x)) for x in part) / len(part) for f, p in FORMATS.items()}
        best = max(share, key=share.get)  # of equal shares the first, which says more
        if share[best] >= least:
            return best
    return None


def messages(body: str | None) -> list[tuple[int, str, str | None, str | None, str, str]]:
    """(line_no, speaker, date, time, text, format); lines that begin no message continue the one before, lines before the first are left out."""
    lines = (body or "").replace("\r\n", "\n").split("\n")
    name = best_format(lines)
    if name is None:
        return []
    out: list[list] = []
    for k, x in enumerate(lines, 1):
        if m := FORMATS[name].match(x):
            g = m.groupdict()
            out.append([k, g["who"].strip(), g.get("date"), g.get("time"), g["text"].strip(), name])
        elif out and x.strip() and not x.startswith("#"):
            out[-1][4] = f"{out[-1][4]}\n{x.strip()}".strip()
    return [tuple(m) for m in out]


def conversations(pages: DataFrame, text: str = "compiled_truth") -> DataFrame:
    """(id, line_no, speaker, date, time, message, format) of all pages that are a log in one of the known formats; null and empty bodies give no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(i, *m) for i, t in zip(b["id"], b["t"]) for m in messages(t)], columns=["id", "line_no", "speaker", "date", "time", "message", "format"])

    src = pages.filter(F.col(text).isNotNull()).select(F.col("id").cast("long").alias("id"), F.col(text).alias("t"))
    return src.mapInPandas(run, "id long, line_no int, speaker string, date string, time string, message string, format string")


def window_candidates(turns: DataFrame, by: str, order: str, speaker: str, text: str, user: str, most: int = 12) -> DataFrame:
    """(by, candidate, occurrences, newest, by_user): runs of capitalised words and handles in a conversation's turns, the ``most`` most frequent and then newest of each."""
    found = F.concat(F.regexp_extract_all(F.col(text), F.lit(r"(?<![.!?] )(?<!^)(?<!\p{L})(\p{Lu}[\p{L}'’-]+(?: \p{Lu}[\p{L}'’-]+)*)"), 1), F.regexp_extract_all(F.col(text), F.lit(r"(?<![\w@])@(\w{2,30})"), 1))
    hit = turns.select(by, order, (F.col(speaker) == user).alias("mine"), F.explode(found).alias("candidate"))
    n = hit.groupBy(by, "candidate").agg(F.count("*").alias("occurrences"), F.max(order).alias("newest"), F.max("mine").alias("by_user"))
    w = Window.partitionBy(by).orderBy(F.desc("occurrences"), F.desc("newest"), F.asc("candidate"))
    return n.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= most).drop("__rn")
