"""Structured, line-addressed chunks of texts: a sequential fold a document, in Arrow batches."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Lengths of chunks, how far a block may go beyond, and what the next chunk repeats.
TARGET, SLACK, OVERLAP = 1000, 300, 120
SCHEMA = "id string, layer string, namespace string, file_path string, line_start int, line_end int, section_headers array<struct<level:int,title:string>>, tags array<string>, text string"

# Headings, and tags as #word or [word].
_HEADING = re.compile(r"^(#{1,6})\s+(.+)$")
_TAG = re.compile(r"(?:^|\s)#([A-Za-z0-9_][A-Za-z0-9_-]*)|\[([A-Za-z0-9_][A-Za-z0-9_-]*)\]")


def sections(lines: list[str]) -> list[tuple[int, int, tuple[int, str] | None, list[tuple[int | None, str]]]]:
    """(first line, line after the last, heading, headers above and own title) of parts that begin at headings of level 1 to 3.

    Headers are read before deeper ones are closed, so a preceding sibling's title is among them.
    """
    out, stack, start, heading, headers = [], [], 0, None, []
    for i, line in enumerate(lines):
        m = _HEADING.match(line)
        if not m:
            continue
        level, title = len(m[1]), m[2].strip()
        if level <= 3:
            if start < i:
                out.append((start, i, heading, headers))
            start, heading, headers = i, (level, title), [*stack, (None, title)]
        stack = [h for h in stack if h[0] < level] + [(level, title)]
    if start < len(lines):
        out.append((start, len(lines), heading, headers))
    return out


def blocks(lines: list[str], first: int, after: int) -> list[tuple[int, int, str]]:
    """Paragraphs between blank lines as (first line, last line, text); those over TARGET + SLACK are split at line ends."""
    out, at = [], first
    while at < after:
        if not lines[at].strip():
            at += 1
            continue
        end = at
        while end < after and lines[end].strip():
            end += 1
        text = "\n".join(lines[at:end]).strip()
        if len(text) <= TARGET + SLACK:
            out.append((at, end - 1, text))
        else:
            begin, held = at, ""
            for i in range(at, end):
                joined = f"{held}\n{lines[i]}" if held else lines[i]
                if held and len(joined) > TARGET:
                    out.append((begin, i - 1, held))
                    begin, held = i, lines[i]
                else:
                    held = joined
            if held:
                out.append((begin, end - 1, held))
        at = end
    return out


def chunk_text(text: str | None, file_path: str, layer: str = "workspace", namespace: str = "") -> list[dict]:
    """Chunks of one text; none of an empty one. A chunk opens with the last OVERLAP characters of the one before it in its section."""
    if not text or not text.strip() or not file_path:
        return []
    lines = text.replace("\r\n", "\n").split("\n")
    out = []
    for start, after, heading, headers in sections(lines):
        body: list[list] = []
        for first, last, block in blocks(lines, start + (heading is not None), after):
            if body and len(body[-1][2]) + 2 + len(block) <= TARGET:
                body[-1][1], body[-1][2] = last, f"{body[-1][2]}\n\n{block}"
            else:
                tail = body[-1][2].strip()[-OVERLAP:] if body else ""
                body.append([first, last, f"{tail}\n\n{block}" if tail else block])
        if heading and body:
            body[0][2] = f"{'#' * heading[0]} {heading[1]}\n\n{body[0][2]}"
        for first, last, chunk in body:
            chunk = chunk.strip()
            found = sorted({(a or b).lower() for a, b in _TAG.findall(chunk) if not (a or b).isdigit()})
            words = [w.lower() for w in heading[1].split()] if heading else []
            out.append({
                "id": hashlib.sha1(f"{file_path}:{first + 1}:{last + 1}".encode()).hexdigest(), "layer": layer, "namespace": namespace, "file_path": file_path,
                "line_start": first + 1, "line_end": last + 1, "section_headers": [{"level": lv, "title": t} for lv, t in headers], "tags": list(dict.fromkeys(found + words)), "text": chunk,
            })
    return out


def _chunks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in ("id", "layer", "namespace", "file_path", "line_start", "line_end", "section_headers", "tags", "text")]
    for frame in frames:
        rows = [c for r in frame.itertuples() for c in chunk_text(r.text, r.file_path, r.layer, r.namespace)]
        yield pd.DataFrame(rows, columns=columns)


def chunk_documents(docs: DataFrame) -> DataFrame:
    """docs: (file_path, layer, namespace, text) to chunk rows with file_hash. Partitioning is that of the input; no shuffle."""
    return docs.select("file_path", F.coalesce("layer", F.lit("workspace")).alias("layer"), F.coalesce("namespace", F.lit("")).alias("namespace"), "text").mapInPandas(_chunks, SCHEMA)
