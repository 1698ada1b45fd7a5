"""Source files without a tree parser: language by suffix, definitions and the chunks they make, imports and calls as edges. Definitions are told by line patterns."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LANGUAGES = {"py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "go": "go", "rs": "rust", "java": "java", "rb": "ruby", "sql": "sql", "c": "c", "h": "c", "cpp": "cpp", "cs": "csharp", "sh": "shell", "swift": "swift", "kt": "kotlin", "php": "php"}
#: Lines at which a definition begins, by language: the kind and the name.
_JS = r"^(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:abstract\s+)?(?P<kind>function|class|interface|type|enum|const|let)\*?\s+(?P<name>[A-Za-z_$][\w$]*)"
_C = r"^(?:(?:public|private|protected|internal|static|final|abstract|export|pub(?:\([a-z]+\))?|unsafe|async|const|open|override|data|sealed)\s+)*(?P<kind>class|interface|enum|struct|trait|impl|record|object|namespace|fn|func|fun|def|mod|type)\s+(?:\([^)]*\)\s*)?(?P<name>[A-Za-z_]\w*)"
DEFINITIONS = {
    "python": r"^(?:async\s+)?(?P<kind>def|class)\s+(?P<name>[A-Za-z_]\w*)", "typescript": _JS, "javascript": _JS, "ruby": r"^(?P<kind>def|class|module)\s+(?P<name>[A-Za-z_][\w.:?!]*)", "sql": r"(?i)^create\s+(?:or\s+replace\s+)?(?P<kind>table|view|function|index|type)\s+(?:if\s+not\s+exists\s+)?(?P<name>[\w.]+)",
    "shell": r"^(?P<kind>function\s+)?(?P<name>[A-Za-z_][\w-]*)\s*\(\)", "php": r"^(?:(?:public|private|protected|static|abstract|final)\s+)*(?P<kind>function|class|interface|trait)\s+(?P<name>[A-Za-z_]\w*)",
}
IMPORTS = {
    "python": r"(?m)^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))", "typescript": r"(?:from|require\(|import\()\s*['\"]([^'\"]+)['\"]", "javascript": r"(?:from|require\(|import\()\s*['\"]([^'\"]+)['\"]", "go": r"(?m)^\s*(?:import\s+)?\"([\w./-]+)\"$",
    "rust": r"(?m)^\s*(?:pub\s+)?use\s+([\w:]+)", "java": r"(?m)^import\s+(?:static\s+)?([\w.]+)", "kotlin": r"(?m)^import\s+([\w.]+)", "c": r"#include\s+[<\"]([\w./]+)[>\"]", "cpp": r"#include\s+[<\"]([\w./]+)[>\"]", "csharp": r"(?m)^using\s+([\w.]+);", "ruby": r"(?m)^\s*require(?:_relative)?\s+['\"]([^'\"]+)", "php": r"(?m)^use\s+([\w\\]+)",
}
_CALL = re.compile(r"(?<![\w.])([A-Za-z_]\w*)\s*\(")
_WORDS = frozenset("if for while switch return catch function def class elif print super with and or not in is lambda await new typeof sizeof assert except match case".split())
LINES = 120


def language_of(path: Column) -> Column:
    suffix = F.lower(F.element_at(F.split(path, r"\."), -1))
    return F.coalesce(*[F.when(suffix == s, F.lit(l)) for s, l in LANGUAGES.items()])


def read_code(spark: SparkSession, folder: str) -> DataFrame:
    """(path, language, code) of the source files below a folder, told by their suffixes."""
    glob = "*.{" + ",".join(LANGUAGES) + "}"
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("code"))
    return files.select("path", language_of(F.col("path")).alias("language"), "code")


def pieces(code: str | None, language: str | None, most: int = LINES) -> list[tuple[int, int, str, str]]:
    """(first line, last line, kind, name) of the definitions at the outermost level and the lines between them; longer ones than ``most`` lines are cut at blank lines where there are any.

    The pieces follow one another and make up the file. A file of no known language is cut by length alone.
    """
    lines = (code or "").split("\n")
    if not code:
        return []
    pattern = re.compile(DEFINITIONS.get(language or "", _C))
    starts = [(k, m.group("kind") or "function", m.group("name")) for k, x in enumerate(lines) if (m := pattern.match(x))] if language else []
    marks = [] if starts and starts[0][0] == 0 else [(0, "text", "")]
    marks += [(k, kind.strip(), name) for k, kind, name in starts]
    out = []
    for (a, kind, name), b in zip(marks, [m[0] for m in marks[1:]] + [len(lines)]):
        while b - a > most:
            blank = next((k for k in range(a + most, a + most // 2, -1) if not lines[k - 1].strip()), a + most)
            out.append((a + 1, blank, kind, name))
            a = blank
        out.append((a + 1, b, kind, name))
    return out


def code_chunks(files: DataFrame, most: int = LINES) -> DataFrame:
    """(path, chunk_index, first_line, last_line, kind, symbol, chunk): the pieces of source files (path, language, code); null and empty files give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, language, code in zip(b["path"], b["language"], b["code"]):
                lines = (code or "").split("\n")
                rows += [(path, k, s, e, kind, name or None, "\n".join(lines[s - 1 : e])) for k, (s, e, kind, name) in enumerate(pieces(code, language, most))]
            yield pd.DataFrame(rows, columns=["path", "chunk_index", "first_line", "last_line", "kind", "symbol", "chunk"])

    return files.select("path", "language", "code").mapInPandas(run, "path string, chunk_index int, first_line int, last_line int, kind string, symbol string, chunk string")


def code_edges(files: DataFrame) -> DataFrame:
    """(path, symbol, target, edge): what a file imports, and what each of its definitions calls, each once; a definition does not call itself here."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: dict[tuple, None] = {}
            for path, language, code in zip(b["path"], b["language"], b["code"]):
                lines = (code or "").split("\n")
                for m in re.finditer(IMPORTS[language], code or "") if language in IMPORTS else ():
                    rows[path, None, next(g for g in m.groups() if g), "import"] = None
                for s, e, kind, name in pieces(code, language, 1 << 30):
                    for target in _CALL.findall("\n".join(lines[s - 1 : e])) if name else ():
                        if target != name and target not in _WORDS:
                            rows[path, name, target, "call"] = None
            yield pd.DataFrame(list(rows), columns=["path", "symbol", "target", "edge"])

    return files.select("path", "language", "code").mapInPandas(run, "path string, symbol string, target string, edge string")


def definitions(chunks: DataFrame, name: str) -> DataFrame:
    """Where a symbol is defined: types before functions before the rest, then by path and line."""
    order = F.when(F.col("kind").isin("class", "interface", "struct", "trait", "enum", "type", "record", "table"), 0).when(F.col("kind").isin("def", "function", "fn", "func", "fun"), 1).otherwise(2)
    return chunks.filter(F.col("symbol") == name).withColumn("__o", order).orderBy("__o", "path", "first_line").drop("__o")


def references(chunks: DataFrame, name: str) -> DataFrame:
    """Chunks that name a symbol as a word, without its definition."""
    return chunks.filter(F.col("chunk").rlike(rf"(?<![\w]){re.escape(name)}(?![\w])") & ~F.col("symbol").eqNullSafe(name))
