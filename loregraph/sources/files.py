"""File sources and sinks of a knowledge base: markdown folders, binary files, JSON lines, Parquet."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """(path, slug, markdown) of every ``.md`` file below ``folder``; the slug is the path below it without the suffix."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("markdown"))
    base = F.regexp_replace(F.lit(folder.rstrip("/")), "^file:/*", "/")
    clean = F.regexp_replace("path", "^file:/*", "/")
    return files.select("path", F.regexp_replace(F.substr(clean, F.length(base) + 2), r"\.md$", "").alias("slug"), "markdown")


def stream_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """New ``.md`` files of a watched folder as a stream."""
    return spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("markdown"))


def infer_front(files: DataFrame) -> DataFrame:
    """(slug, title, type, day, body): front matter where there is any, else the first heading, the folder and a date in the file name."""
    front = F.regexp_extract("markdown", r"(?s)\A---\n(.*?)\n---\n", 1)
    field = lambda n: F.nullif(F.trim(F.regexp_extract(front, rf"(?m)^{n}:\s*[\"']?(.*?)[\"']?\s*$", 1)), F.lit(""))
    body = F.regexp_replace("markdown", r"(?s)\A---\n.*?\n---\n", "")
    heading = F.nullif(F.trim(F.regexp_extract(body, r"(?m)^# (.+)$", 1)), F.lit(""))
    name = F.regexp_replace(F.substring_index("slug", "/", -1), "[-_]+", " ")
    kinds = {"people": "person", "companies": "company", "orgs": "company", "meetings": "meeting", "daily": "daily", "emails": "email", "concepts": "concept"}
    first = F.substring_index("slug", "/", 1)
    kind = F.coalesce(field("type"), *[F.when(first == k, F.lit(v)) for k, v in kinds.items()], F.lit("note"))
    day = F.coalesce(F.try_to_date(field("date"), "yyyy-MM-dd"), F.try_to_date(F.nullif(F.regexp_extract("slug", r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")), "yyyy-MM-dd"))
    return files.select("slug", F.coalesce(field("title"), heading, name).alias("title"), kind.alias("type"), day.alias("day"), body.alias("body"))


def write_markdown(docs: DataFrame, folder: str) -> int:
    """One ``.md`` file per row of (slug, markdown) below ``folder``, a place all executors share, written by the executors; ``read_markdown`` reads them back. Gives their number.

    A slug that leaves the folder is an error; a task that runs again writes the same files again.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)
        made: set[str] = set()
        for b in batches:
            for slug, text in zip(b["slug"], b["markdown"]):
                if not slug or ".." in slug.split("/") or slug.startswith("/"):
                    raise ValueError(f"no file name: {slug!r}")
                path = f"{base.rstrip('/')}/{slug}.md"
                parent = path.rpartition("/")[0]
                if parent not in made:
                    fs.create_dir(parent, recursive=True)
                    made.add(parent)
                with fs.open_output_stream(path) as f:
                    f.write((text or "").encode())
            yield pd.DataFrame({"n": [len(b)]})

    return docs.select("slug", "markdown").mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def read_binary(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, length, modificationTime, content, kind) with the kind told by the leading bytes."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder)
    head = F.hex(F.substring("content", 1, 4))
    return df.withColumn("kind", F.when(head.startswith("89504E47"), "png").when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("47494638"), "gif").when(head.startswith("52494646"), "webp").when(head.startswith("25504446"), "pdf").otherwise("other"))


def code_fences(pages: DataFrame, text: str = "compiled_truth", most: int = 100) -> DataFrame:
    """(id, fence_no, language, code): the fenced code of a markdown text, the first ``most`` fences of each (a limit of the feature)."""
    fences = F.slice(F.regexp_extract_all(text, F.lit(r"(?s)```([\w+-]*)\n(.*?)```"), 0), 1, most)
    f = pages.filter(F.col(text).isNotNull()).select("id", F.posexplode(fences).alias("p", "m"))
    return f.select("id", (F.col("p") + 1).alias("fence_no"), F.regexp_extract("m", r"```([\w+-]*)\n", 1).alias("language"), F.regexp_extract("m", r"(?s)```[\w+-]*\n(.*?)```", 1).alias("code"))


def changed(files: DataFrame, known: DataFrame, key: str = "slug", text: str = "markdown") -> DataFrame:
    """Files whose content hash is not the known one: the rows to ingest of an incremental run."""
    h = files.withColumn("content_hash", F.sha2(F.col(text), 256))
    return h.join(known.select(key, "content_hash"), [key, "content_hash"], "left_anti")
