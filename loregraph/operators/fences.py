"""Tables of claims and facts that pages carry between comment marks: parse, render, strip by visibility."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Columns by kind of table, as they stand in its head.
COLUMNS = {
    "takes": ("#", "claim", "kind", "who", "weight", "since", "source"),
    "facts": ("#", "claim", "kind", "confidence", "visibility", "notability", "valid_from", "valid_until", "source", "context"),
}
KINDS = {"takes": {"fact", "take", "bet", "hunch"}, "facts": {"event", "preference", "commitment", "belief", "fact"}}
VISIBILITIES = {"private", "world"}
_CELLS = re.compile(r"(?<!\\)\|")


def _fence(what: str) -> re.Pattern:
    """A table between ``<!--- ns:what:begin -->`` and the matching end, whatever the name space."""
    return re.compile(rf"<!---?\s*([\w-]+):{what}:begin\s*-->(.*?)<!---?\s*\1:{what}:end\s*-->", re.S)


FENCES = {w: _fence(w) for w in COLUMNS}


def _rows(table: str, what: str) -> Iterator[dict[str, str]]:
    """The rows of a table that have the right number of cells, by column name."""
    for line in table.splitlines():
        line = line.strip()
        if not (line.startswith("|") and line.endswith("|") and len(line) > 1):
            continue
        cells = [c.strip().replace("\\|", "|") for c in _CELLS.split(line)[1:-1]]
        if len(cells) == len(COLUMNS[what]) and cells[0].isdigit():
            yield dict(zip(COLUMNS[what], cells))


def _number(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def parse_takes(body: str | None) -> list[dict]:
    """row_num, claim, kind, holder, weight, since, until, source, active of the rows that are well formed; a struck claim is inactive, ``a → b`` is a span of time."""
    out = []
    for m in FENCES["takes"].finditer(body or ""):
        for r in _rows(m.group(2), "takes"):
            weight = _number(r["weight"])
            if weight is None or r["kind"] not in KINDS["takes"]:
                continue
            struck = re.fullmatch(r"~~(.*)~~", r["claim"])
            since, _, until = re.sub(r"\s*(?:→|->)\s*", "\0", r["since"]).partition("\0")
            out.append({"row_num": int(r["#"]), "claim": struck.group(1) if struck else r["claim"], "kind": r["kind"], "holder": r["who"], "weight": weight, "since": since or None, "until": until or None, "source": r["source"] or None, "active": not struck})
    return out


def parse_facts(body: str | None) -> list[dict]:
    """The well-formed facts, with ``active``, ``superseded_by`` and ``forgotten`` told by a struck claim and its context."""
    out = []
    for m in FENCES["facts"].finditer(body or ""):
        for r in _rows(m.group(2), "facts"):
            confidence = _number(r["confidence"])
            if confidence is None or r["kind"] not in KINDS["facts"] or r["visibility"] not in VISIBILITIES:
                continue
            struck = re.fullmatch(r"~~(.*)~~", r["claim"])
            by = re.match(r"superseded by #(\d+)", r["context"]) if struck else None
            out.append(
                {
                    "row_num": int(r["#"]), "claim": struck.group(1) if struck else r["claim"], "kind": r["kind"], "confidence": confidence, "visibility": r["visibility"], "notability": r["notability"], "valid_from": r["valid_from"] or None,
                    "valid_until": r["valid_until"] or None, "source": r["source"] or None, "context": r["context"] or None, "active": not struck, "superseded_by": int(by.group(1)) if by else None, "forgotten": bool(struck and r["context"].startswith("forgotten:")),
                }
            )
    return out


def _table(what: str, rows: list[list[str]], space: str) -> str:
    line = lambda cells: "| " + " | ".join(str(c).replace("|", "\\|").replace("\n", " ") for c in cells) + " |"
    head = [line(COLUMNS[what]), "|" + "---|" * len(COLUMNS[what])]
    return f"<!--- {space}:{what}:begin -->\n" + "\n".join([*head, *map(line, rows)]) + f"\n<!--- {space}:{what}:end -->"


def render_takes(takes: list[dict], space: str = "kb") -> str:
    return _table("takes", [[t["row_num"], t["claim"] if t["active"] else f"~~{t['claim']}~~", t["kind"], t["holder"], f"{t['weight']:g}", f"{t['since'] or ''} → {t['until']}" if t["until"] else t["since"] or "", t["source"] or ""] for t in takes], space)


def render_facts(facts: list[dict], space: str = "kb") -> str:
    cells = ("kind", "confidence", "visibility", "notability", "valid_from", "valid_until", "source", "context")
    return _table("facts", [[f["row_num"], f["claim"] if f["active"] else f"~~{f['claim']}~~", *[f"{f[c]:g}" if c == "confidence" else f[c] or "" for c in cells]] for f in facts], space)


def strip_facts(body: str | None, keep: set[str] | None = None) -> str | None:
    """Without the facts' table, or, if visibilities are named, with their rows alone; rows that can't be read are never kept."""
    if body is None:
        return None
    return FENCES["facts"].sub(lambda m: render_facts([f for f in parse_facts(m.group()) if f["visibility"] in keep], m.group(1)) if keep else "", body)


TAKES_SCHEMA = "row_num int, claim string, kind string, holder string, weight double, since string, until string, source string, active boolean"
FACTS_SCHEMA = "row_num int, claim string, kind string, confidence double, visibility string, notability string, valid_from string, valid_until string, source string, context string, active boolean, superseded_by int, forgotten boolean"


def _parsed(pages: DataFrame, text: str, parse: Callable[[str], list[dict]], schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, *[r[n] for n in names]) for i, t in zip(b["id"], b["t"]) for r in parse(t)]
            yield pd.DataFrame(rows, columns=["page_id", *names]).astype({n: "Int64" for n in names if n == "superseded_by"})

    src = pages.filter(F.col(text).contains(":begin")).select(F.col("id").cast("long").alias("id"), F.col(text).alias("t"))
    return src.mapInPandas(run, f"page_id long, {schema}")


def takes_of(pages: DataFrame, text: str = "compiled_truth") -> DataFrame:
    """(page_id, row_num, claim, kind, holder, weight, since, until, source, active) of the claim tables of all pages; pages without a table are not sent to Python."""
    return _parsed(pages, text, parse_takes, TAKES_SCHEMA)


def facts_of(pages: DataFrame, text: str = "compiled_truth") -> DataFrame:
    return _parsed(pages, text, parse_facts, FACTS_SCHEMA)


def with_takes(pages: DataFrame, takes: DataFrame, text: str = "compiled_truth", space: str = "kb") -> DataFrame:
    """Pages (id, body) with a table of their claims (page_id and the columns of ``takes_of``) at the end; a page's claims are one table, as long as the page has them."""

    @F.pandas_udf(StringType())
    def table(rows: pd.Series) -> pd.Series:
        return rows.map(lambda x: render_takes([dict(r) for r in x], space))

    cols = [c.split()[0] for c in TAKES_SCHEMA.split(", ")]
    t = takes.groupBy(F.col("page_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("rows")).select("id", table("rows").alias("table"))
    return pages.join(t, "id").select("id", F.concat(F.coalesce(text, F.lit("")), F.lit("\n\n"), "table").alias("body"))


def stripped(keep: set[str] | None = None) -> Callable:
    """A column function that takes a body and gives it without facts, or with those of the named visibilities."""

    @F.pandas_udf(StringType())
    def strip(body: pd.Series) -> pd.Series:
        return body.map(lambda x: strip_facts(x, keep))

    return strip
