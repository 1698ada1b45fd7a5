"""Markdown pages as people write them: front matter in the common part of YAML, body, timeline, title, type and tags."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = {"people": "person", "companies": "company", "orgs": "company", "meetings": "meeting", "daily": "daily", "emails": "email", "concepts": "concept", "transcripts": "transcript"}
_FRONT = re.compile(r"\A\ufeff?---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\Z)", re.S)
#: Where the timeline of a page begins: the mark of this library's own files, or a heading.
_TIMELINE = re.compile(r"\n*(?:<!-- timeline -->|^#{1,3} timeline[ \t]*$)\r?\n?", re.I | re.M)
_KEY = re.compile(r"^([A-Za-z_][\w -]*?)\s*:(?:\s+(.*))?$")


def _scalar(text: str) -> object:
    t = text.strip()
    if len(t) >= 2 and t[0] == t[-1] and t[0] in "\"'":
        return t[1:-1].replace("''", "'") if t[0] == "'" else json.loads(t) if _is_json(t) else t[1:-1]
    t = re.sub(r"\s+#.*$", "", t)
    if t in ("", "~", "null", "Null", "NULL"):
        return None
    if t.lower() in ("true", "false"):
        return t.lower() == "true"
    if re.fullmatch(r"[-+]?\d+", t):
        return int(t)
    if re.fullmatch(r"[-+]?(?:\d+\.\d*|\.\d+)(?:[eE][-+]?\d+)?", t):
        return float(t)
    if t[0] in "[{" and _is_json(t):
        return json.loads(t)
    if t[0] == "[" and t[-1] == "]":
        return [_scalar(x) for x in re.findall(r"\s*(\"(?:[^\"\\]|\\.)*\"|'[^']*'|[^\s,\[\]][^,\[\]]*)", t[1:-1])]
    return t


def _is_json(t: str) -> bool:
    try:
        json.loads(t)
        return True
    except ValueError:
        return False


def parse_front(text: str) -> dict:
    """Keys with scalars, lists in brackets or with hyphens, maps one level deeper, and blocks after ``|`` or ``>``; lines it can't read are left out. JSON is read as it is."""
    if text.lstrip().startswith("{") and _is_json(text):
        return json.loads(text)
    lines = [x.rstrip() for x in text.replace("\r\n", "\n").split("\n")]
    out: dict = {}
    k = 0
    while k < len(lines):
        m = _KEY.match(lines[k])
        k += 1
        if not m:
            continue
        key, value = m.group(1), (m.group(2) or "").strip()
        below = []
        while k < len(lines) and (not lines[k] or lines[k][0] in " \t" or lines[k].startswith("- ")):
            below.append(lines[k])
            k += 1
        full = [x for x in below if x.strip() and not x.strip().startswith("#")]
        if value in ("|", ">", "|-", ">-"):
            out[key] = ("\n" if value[0] == "|" else " ").join(x.strip() for x in below).strip()
        elif value:
            out[key] = _scalar(value)
        elif full and all(x.strip().startswith("- ") or x.strip() == "-" for x in full):
            out[key] = [_scalar(x.strip()[1:]) for x in full]
        elif full and all(_KEY.match(x.strip()) for x in full):
            out[key] = {m.group(1): _scalar(m.group(2) or "") for m in (_KEY.match(x.strip()) for x in full)}
        else:
            out[key] = None
    return out


def parse_page(slug: str, text: str | None) -> tuple[str, str, list[str], str, str, str]:
    """(title, type, tags, front matter as JSON, compiled truth, timeline): a title from the front matter, else the first heading, else the slug; a type from the front matter, else the folder."""
    text = text or ""
    m = _FRONT.match(text)
    front = parse_front(m.group(1)) if m else {}
    front = front if isinstance(front, dict) else {}
    body = text[m.end() :] if m else text
    cut = _TIMELINE.search(body)
    truth, timeline = (body[: cut.start()], body[cut.end() :]) if cut else (body, "")
    heading = re.search(r"^# (.+)$", truth, re.M)
    title = front.get("title") or (heading and heading.group(1).strip()) or re.sub(r"[-_]+", " ", slug.rpartition("/")[2])
    kind = front.get("type") or KINDS.get(slug.partition("/")[0], "note")
    tags = front.get("tags") or []
    tags = tags if isinstance(tags, list) else str(tags).split(",")
    return str(title), str(kind), list(dict.fromkeys(str(t).strip().lstrip("#") for t in tags if t is not None and str(t).strip())), json.dumps(front, ensure_ascii=False, default=str), truth.strip("\n"), timeline.strip("\n")


def parse_pages(files: DataFrame) -> DataFrame:
    """(slug, title, type, tags, frontmatter, compiled_truth, timeline) of files (slug, markdown); an empty or null file gives an empty page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(s, *parse_page(s, t)) for s, t in zip(b["slug"], b["markdown"])], columns=["slug", "title", "type", "tags", "frontmatter", "compiled_truth", "timeline"])

    return files.filter(F.col("slug").isNotNull()).select("slug", "markdown").mapInPandas(run, "slug string, title string, type string, tags array<string>, frontmatter string, compiled_truth string, timeline string")
