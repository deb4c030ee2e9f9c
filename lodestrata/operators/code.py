"""Chunks of source code: module header, classes, functions. Python is parsed; other languages are chunked as text."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunk import SCHEMA, chunk_text

# Languages by extension, and names that code may be marked with.
LANGUAGES = {
    "py": "python", "ts": "typescript", "js": "javascript", "go": "go", "cpp": "cpp", "cc": "cpp", "h": "cpp", "hpp": "cpp", "md": "markdown", "json": "json", "yaml": "yaml", "yml": "yaml",
    "log": "log", "txt": "text", "docx": "text", "pdf": "text", "epub": "text", "rtf": "text", "html": "html", "htm": "html", "xhtml": "html",
}
CODE_NAMES = {"py": "python", "python": "python", "js": "javascript", "javascript": "javascript", "ts": "typescript", "typescript": "typescript", "go": "go", "cpp": "cpp", "c++": "cpp", "cc": "cpp"}
# What a line of a module's header looks like, and how many lines are read for it.
HEADER = {"python": r"(?:import|from) ", "javascript": r"(?:import|export) |.*require\(", "typescript": r"(?:import|export) |.*require\(", "go": r"package |import", "cpp": r"#include|using "}
HEADER_LINES = 30

_COLUMNS = [c.split()[0] for c in ("id", "layer", "namespace", "file_path", "line_start", "line_end", "section_headers", "tags", "text")]


def language(path: Column) -> Column:
    """Language of a file by its extension; null if unknown."""
    known = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return F.try_element_at(known, F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)))


def module_header(source: Column, lang: Column) -> Column:
    """Import-like lines among the first HEADER_LINES, joined; empty for other languages."""
    pattern = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in HEADER.items() for x in (kv[0], rf"^\s*(?:{kv[1]})"))), lang), F.lit("^(?!)"))
    first = F.slice(F.split(F.coalesce(source, F.lit("")), "\n", -1), 1, HEADER_LINES)
    return F.array_join(F.filter(first, lambda line: F.rlike(line, pattern)), "\n")


def _definitions(tree: ast.AST) -> Iterator[tuple[ast.AST, list[str], str]]:
    """Classes and the functions that no other function holds, with the classes around each."""
    waiting: list[tuple[ast.AST, list[str]]] = [(tree, [])]
    while waiting:
        node, around = waiting.pop()
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                yield child, around, "function"
            elif isinstance(child, ast.ClassDef):
                yield child, [*around, child.name], "class"
                waiting.append((child, [*around, child.name]))
            else:
                waiting.append((child, around))


def chunk_code(source: str | None, file_path: str, lang: str | None = None, layer: str = "workspace", namespace: str = "") -> list[dict]:
    """Header chunk, then classes and functions by line. Source that can't be parsed, or holds none of these, is chunked as text."""
    marked = CODE_NAMES.get((lang or "").lower()) or CODE_NAMES.get(file_path.rsplit(".", 1)[-1].lower())
    text = re.sub(r"\r\n?", "\n", source or "")
    found = []
    if marked == "python":
        try:
            found = sorted(_definitions(ast.parse(text)), key=lambda d: (d[0].lineno, d[0].col_offset))
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return chunk_text(source, file_path, layer, namespace)
    lines = text.split("\n")
    heads = [x for x in lines[:HEADER_LINES] if re.match(rf"\s*(?:{HEADER[marked]})", x)] if marked == "python" else []
    if not found and not heads:
        return chunk_text(source, file_path, layer, namespace)
    prefix = re.sub(r"[^a-zA-Z0-9_\-./\\]", "_", file_path) + ":1-1"

    def row(key: str, first: int, last: int, headers: list[str], tags: list[str], body: str) -> dict:
        return {
            "id": f"{prefix}:{key}", "layer": layer, "namespace": namespace, "file_path": file_path, "line_start": first, "line_end": last,
            "section_headers": [{"level": None, "title": h} for h in headers], "tags": tags, "text": body,
        }

    out = [row("module:header", 1, len(heads), [marked, "module"], [marked, "module"], "\n".join(heads))] if heads else []
    for node, around, kind in found:
        part = lines[node.lineno - 1 : node.end_lineno]
        part[-1] = part[-1].encode()[: node.end_col_offset].decode()
        part[0] = part[0].encode()[node.col_offset :].decode()
        out.append(row(f"{kind}:{node.name}:{node.lineno}-{node.end_lineno}", node.lineno, node.end_lineno, [marked, *around], [marked, kind, node.name], "\n".join(part)))
    return out


def _chunks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield pd.DataFrame([c for r in frame.itertuples() for c in chunk_code(r.text, r.file_path, r.language, r.layer, r.namespace)], columns=_COLUMNS)


def chunk_sources(files: DataFrame) -> DataFrame:
    """files: (file_path, language, layer, namespace, text) to chunk rows; a null language is read from the path. No shuffle."""
    plain = files.select("file_path", "language", F.coalesce("layer", F.lit("workspace")).alias("layer"), F.coalesce("namespace", F.lit("")).alias("namespace"), "text")
    return plain.where("file_path IS NOT NULL").mapInPandas(_chunks, SCHEMA)
