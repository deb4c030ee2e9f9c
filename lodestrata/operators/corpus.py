"""Corpus tools: search with context, line ranges, path patterns, ignore rules, trees, store statistics."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .structure import roman

# Paths that are never indexed, and extensions that are.
IGNORED = ("**/.env", "**/.env.*", "**/node_modules/**", "**/.git/**", "**/__pycache__/**", "**/dist/**", "**/build/**", "**/.rag/**", "**/chat_history/**", "**/artifacts/**", "**/test/tmp/**", "**/*.local.env")
EXTENSIONS = ("md", "pdf", "txt", "docx", "epub", "rtf", "html", "htm", "xhtml", "py", "ts", "js", "go", "cpp", "json", "yaml", "yml", "log")
MAX_BYTES = 150 * 1024
#: The largest page number that is told from text where it is written in Roman numerals.
LARGEST_PAGE = 99


def glob_regex(glob: str) -> str:
    """** is any path, * any name part, ? one character; a leading **/ may match nothing."""
    out = ""
    i = 0
    while i < len(glob):
        if glob.startswith("**/", i) and i == 0:
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"


def indexable(path: Column, rules: list[str] | None = None) -> Column:
    """Whether a relative path is indexed: built-in patterns, allowed extensions (or none), then ignore-file rules, the last match wins."""
    denied = F.lit(False)
    for g in IGNORED:
        denied = denied | path.rlike(glob_regex(g))
    name = F.element_at(F.split(path, "/"), -1)
    extension = F.lower(F.regexp_extract(name, r".\.([^.]+)$", 1))
    verdict = F.lit(False)
    for rule in rules or []:
        rule = rule.strip()
        if not rule or rule.startswith("#"):
            continue
        again = rule.startswith("!")
        body = rule.lstrip("!").strip("/")
        pattern = body if "/" in body else f"**/{body}"
        hit = path.rlike(glob_regex(pattern)) | path.rlike(glob_regex(pattern + "/**"))
        verdict = F.when(hit, F.lit(not again)).otherwise(verdict)
    return ~denied & ((extension == "") | extension.isin(*EXTENSIONS)) & ~verdict


def split_lines(text: Column) -> Column:
    """A text's lines; line ends of any kind."""
    return F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n", -1)


def lines(docs: DataFrame) -> DataFrame:
    """(id, line_number, line) of docs (id, text); line ends of any kind."""
    return docs.select("id", F.posexplode(split_lines(F.col("text"))).alias("pos", "line")).select("id", (F.col("pos") + 1).alias("line_number"), "line")


def grep(docs: DataFrame, pattern: str, regex: bool = False, context: int = 2, limit: int = 50) -> DataFrame:
    """(id, line_number, line, context) of lines that contain a string or match a regular expression; first by id and line, 0 for all.

    Context is cut from the document's own array of lines: no line is shuffled.
    """
    hit = (lambda c: c.rlike(pattern)) if regex else (lambda c: F.contains(c, F.lit(pattern)))
    split = docs.where(hit(F.col("text")) if not regex else F.lit(True)).select("id", F.split(F.replace(F.col("text"), F.lit("\r\n"), F.lit("\n")), "\n", -1).alias("ls"))
    found = split.select("id", "ls", F.explode(F.filter(F.sequence(F.lit(1), F.size("ls")), lambda i: hit(F.element_at("ls", i)))).alias("line_number"))
    low = F.greatest(F.lit(1), F.col("line_number") - context)
    around = F.slice("ls", low, F.least(F.size("ls"), F.col("line_number") + context) - low + 1)
    got = found.select("id", "line_number", F.element_at("ls", F.col("line_number")).alias("line"), F.array_join(around, "\n").alias("context"))
    return got.orderBy("id", "line_number").limit(limit) if limit else got


def searchable(files: DataFrame, glob: str = "**/*", max_bytes: int = MAX_BYTES) -> DataFrame:
    """Files (id, path, text) that a glob selects, with skipped: true where they are too large, or binary by a NUL in their first 512 characters."""
    text = F.coalesce("text", F.lit(""))
    return files.where(F.col("path").rlike(glob_regex(glob))).withColumn("skipped", (F.octet_length(text) > max_bytes) | F.contains(F.substring(text, 1, 512), F.lit("\x00")))


def grep_files(files: DataFrame, pattern: str, glob: str = "**/*", regex: bool = False, context: int = 2, limit: int = 50, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """The hits of grep in files that aren't skipped, and one row of totals: matches, searched, skipped, truncated (whether the limit left hits out)."""
    chosen = searchable(files, glob, max_bytes)
    hit = (lambda c: c.rlike(pattern)) if regex else (lambda c: F.contains(c, F.lit(pattern)))
    lines_of = F.split(F.replace(F.coalesce("text", F.lit("")), F.lit("\r\n"), F.lit("\n")), "\n", -1)
    n = F.when(~F.col("skipped"), F.size(F.filter(lines_of, hit))).otherwise(0)
    totals = chosen.agg(F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("matches"), F.count_if(~F.col("skipped")).alias("searched"), F.count_if("skipped").alias("skipped"))
    return grep(chosen.where("NOT skipped").select("id", "text"), pattern, regex, context, limit), totals.withColumn("truncated", (F.col("matches") > limit) if limit else F.lit(False))


def grep_context(docs: DataFrame, pattern: str, regex: bool = False, context: int = 2) -> DataFrame:
    """(id, hit, line_number, line, is_match): every line around each hit, is_match on the hit itself."""
    found = grep(docs, pattern, regex, context, 0)
    low = F.greatest(F.lit(1), F.col("line_number") - context)
    return found.select("id", F.col("line_number").alias("hit"), low.alias("low"), F.posexplode(F.split("context", "\n", -1)).alias("pos", "line")).select(
        "id", "hit", (F.col("low") + F.col("pos")).alias("line_number"), "line", (F.col("low") + F.col("pos") == F.col("hit")).alias("is_match")
    )


def line_range(docs: DataFrame, start: int, end: int) -> DataFrame:
    """Lines start to end of every document, clamped, as numbered text."""
    return lines(docs).where(F.col("line_number").between(max(start, 1), end)).select("id", "line_number", F.format_string("%6d|%s", "line_number", "line").alias("shown"))


def tree(paths: DataFrame, depth: int = 10) -> DataFrame:
    """Every folder and file on the way to paths (path), with its parent, depth and kind; folders first, then names without case."""
    parts = F.split("path", "/")
    nodes = paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("node"), i.alias("depth"), (i < F.size(parts)).alias("folder")))).alias("n")).select("n.*")
    return nodes.where(F.col("depth") <= depth).distinct().withColumn("name", F.element_at(F.split("node", "/"), -1)).withColumn("parent", F.regexp_extract("node", "^(.*)/[^/]+$", 1))


def tree_order(nodes: DataFrame) -> DataFrame:
    """Nodes of tree() with their place among those of the same parent: folders first, then names without case."""
    return nodes.withColumn("place", F.row_number().over(Window.partitionBy("parent").orderBy(F.desc("folder"), F.lower("name"), "name")))


def without_namespace(store: DataFrame, prefix: str) -> DataFrame:
    """A chunk store less every namespace that starts with a prefix, taken literally; chunks without a namespace stay."""
    return store.where(~F.coalesce(F.startswith("namespace", F.lit(prefix)), F.lit(False)))


def page_of_limit(pages: DataFrame, max_chars: int) -> DataFrame:
    """(id, total_chars, truncated_at): the first page past max_chars when pages (id, page, text) are joined by blank lines, null if none is."""
    upto = Window.partitionBy("id").orderBy("page")
    grown = pages.withColumn("upto", F.sum(F.length(F.coalesce("text", F.lit("")))).over(upto) + 2 * (F.row_number().over(upto) - 1))
    return grown.groupBy("id").agg(F.max("upto").alias("total_chars"), F.min(F.when(F.col("upto") > max_chars, F.col("page"))).alias("truncated_at"))


def page_of_rows(rows: DataFrame, page: int, *order: Column | str, size: int = 5) -> DataFrame:
    """One page (from 1) of ordered rows."""
    return rows.orderBy(*order).offset((max(page, 1) - 1) * size).limit(size)


def corpus_sums(sources: DataFrame) -> DataFrame:
    """One row over extracted sources (text, pages, size_mb, has_toc): sums, and whether any has a contents page."""
    from ..functions import text as X

    t = F.coalesce("text", F.lit(""))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return sources.agg(
        F.count(F.lit(1)).alias("sources"), total(F.col("pages")).alias("pages"), F.round(F.coalesce(F.sum("size_mb"), F.lit(0.0)), 2).alias("size_mb"), total(F.length(t)).alias("chars"),
        total(X.word_count(t)).alias("words"), total(X.budget_tokens(t)).alias("tokens"), F.coalesce(F.bool_or("has_toc"), F.lit(False)).alias("has_toc"),
    )


def changed_files(live: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files (layer, path, file_hash) that are new or changed, and known ones that are gone."""
    old = known.withColumnRenamed("file_hash", "old_hash")
    new = live.join(old, ["layer", "path"], "left").where(~F.col("file_hash").eqNullSafe(F.col("old_hash"))).select(live.columns)
    return new, known.join(live.select("layer", "path"), ["layer", "path"], "left_anti")


def page_cleanup(pages: DataFrame) -> DataFrame:
    """Running heads and page numbers go from the first and last non-blank line of pages (id, page, text).

    A line that stands at such an edge on over half of a document's pages (of three or more) is boilerplate.
    """
    numbers = [roman(n).lower() for n in range(1, LARGEST_PAGE + 1)]
    is_number = lambda c: c.rlike("^[0-9]{1,4}$") | F.lower(c).isin(numbers)
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    ls = pages.select("id", "page", F.split("text", "\n", -1).alias("ls")).withColumn("full", F.filter(F.sequence(F.lit(1), F.size("ls")), lambda i: strip(F.element_at("ls", i)) != ""))
    ls = ls.withColumn("first", F.get("full", F.lit(0))).withColumn("last", F.when(F.size("full") > 0, F.element_at("full", -1)))
    edges = ls.select("id", F.explode(F.array_distinct(F.filter(F.array(F.get("ls", F.col("first") - 1), F.get("ls", F.col("last") - 1)), lambda e: e.isNotNull()))).alias("e")).select("id", strip(F.col("e")).alias("edge"))
    many = pages.groupBy("id").agg(F.count(F.lit(1)).alias("pages"))
    boiler = edges.groupBy("id", "edge").agg(F.count(F.lit(1)).alias("votes")).join(many, "id").where((F.col("pages") >= 3) & (F.col("votes") > F.col("pages") / 2)).groupBy("id").agg(F.collect_set("edge").alias("boiler"))
    joined = ls.join(many, "id").join(boiler, "id", "left")
    bad = lambda i: ((i == F.col("first")) | (i == F.col("last"))) & (F.array_contains(F.coalesce("boiler", F.array().cast("array<string>")), strip(F.element_at("ls", i))) | is_number(strip(F.element_at("ls", i))))
    kept = F.when(F.col("pages") < 3, F.col("ls")).otherwise(F.transform(F.filter(F.sequence(F.lit(1), F.size("ls")), lambda i: ~bad(i)), lambda i: F.element_at("ls", i)))
    whole = joined.select("id", "page", kept.alias("kept")).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("page", "kept"))).alias("ps"))
    text = F.array_join(F.flatten(F.transform("ps", lambda p: p["kept"])), "\n")
    return whole.select("id", F.regexp_replace(text, r"(\w)-\n(\w)", "$1$2").alias("text"))


def store_stats(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy(F.coalesce("layer", F.lit("unknown")).alias("layer")).agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length("text")).alias("n_chars"))


def preview(docs: DataFrame, max_chars: int, page_chars: int = 3000) -> DataFrame:
    """(id, total_chars, pages, fingerprint, shown_chars, truncated) of docs (id, text)."""
    t = F.coalesce("text", F.lit(""))
    return docs.select(
        "id", F.length(t).alias("total_chars"), F.ceil(F.length(t) / page_chars).alias("pages"), F.sha2(F.substring(t, 1, 1024).cast("binary"), 256).alias("fingerprint"),
        F.least(F.length(t), F.lit(max_chars)).alias("shown_chars"), (F.length(t) > max_chars).alias("truncated"),
    )


def line_of_offset(text: Column, offset: Column) -> Column:
    """1-based line that holds a 0-based offset."""
    return F.regexp_count(F.substr(text, F.lit(1), offset), F.lit("\n")) + 1


def evict_turns(messages: DataFrame, limit: Column | int, keep_ratio: float = 0.8) -> DataFrame:
    """The latest whole user turns of each conversation within keep_ratio * limit tokens; system messages and the last turn stay.

    messages: (conv_id, turn, role, tokens).
    """
    order = Window.partitionBy("conv_id").orderBy("turn")
    turns = messages.withColumn("ut", F.sum((F.col("role") == "user").cast("int")).over(order))
    system = F.col("role") == "system"
    sums = turns.groupBy("conv_id", "ut").agg(F.sum(F.when(~system, F.col("tokens")).otherwise(0)).alias("t"))
    fixed = turns.groupBy("conv_id").agg(F.sum(F.when(system, F.col("tokens")).otherwise(0)).alias("fixed"), F.max("ut").alias("last"))
    after = sums.withColumn("after", F.sum("t").over(Window.partitionBy("conv_id").orderBy(F.desc("ut")))).join(fixed, "conv_id")
    kept = after.where((F.col("after") + F.col("fixed") <= keep_ratio * F.lit(limit)) | (F.col("ut") == F.col("last"))).select("conv_id", "ut")
    return turns.join(kept.withColumn("kept", F.lit(True)), ["conv_id", "ut"], "left").where(system | F.col("kept")).drop("kept", "ut")
