"""Text functions as column expressions; everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words of the keyword index.
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "that", "the", "to", "was", "were", "will", "with")

# What a failed query is retried with, by the first keyword that it contains.
SYNONYMS = (
    ("deploy", "deployment, release"),
    ("config", "configuration, settings"),
    ("auth", "authentication, login"),
    ("error", "error, exception, failure"),
    ("api", "api, endpoint, interface"),
    ("test", "test, testing, unit test"),
    ("security", "security, authentication, access control"),
)

# Invisible code points (zero width, bidirectional controls, invisible letters, tag block).
INVISIBLE = (
    r"[\x{200B}-\x{200F}\x{2060}-\x{2064}\x{2066}-\x{2069}\x{202A}-\x{202E}\x{FEFF}\x{00AD}\x{034F}\x{180E}\x{061C}"
    r"\x{115F}\x{1160}\x{3164}\x{FFA0}\x{E0000}-\x{E007F}]"
)

# Characters counted singly by the token estimate.
CJK = r"[\x{3000}-\x{303F}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}\x{20000}-\x{3FFFF}]"


def tokens(text: Column, stopwords: bool = True) -> Column:
    """Lower-cased ASCII words of two characters or more, without stop words if asked; null is no token."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "), " ")
    keep = lambda w: F.length(w) > 1
    return F.filter(words, (lambda w: keep(w) & ~w.isin(*STOPWORDS)) if stopwords else keep)


def sanitize(text: Column) -> Column:
    return F.regexp_replace(text, INVISIBLE, "")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"(?U)\S+"))


def cjk_tokens(text: Column) -> Column:
    """Words over 0.75 and CJK characters over 1.5, cut to an integer."""
    latin = word_count(F.regexp_replace(text, CJK, " "))
    return F.coalesce(F.floor(latin / 0.75 + F.regexp_count(text, F.lit(CJK)) / 1.5), F.lit(0)).cast("long")


def budget_tokens(text: Column) -> Column:
    """Token count of a result: four characters each, or the CJK estimate."""
    return F.when(text.rlike(CJK), cjk_tokens(text)).otherwise(F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4)).cast("long")


def message_tokens(text: Column, multiplier: float = 1.6) -> Column:
    """Message estimate: characters over four beyond 10,000, words up to there."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.length(t) > 10_000, F.length(t) / 4 * multiplier).otherwise(word_count(t) * F.lit(multiplier))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def expand_query(query: Column) -> Column:
    """The query, its parts between 'and', then their parts between 'or'; distinct, in that order."""
    q = trimmed(F.coalesce(query, F.lit("")))
    parts = lambda s, word: F.filter(F.transform(F.split(s, rf"(?iU)\s+{word}\s+"), trimmed), lambda p: p != "")
    return F.array_distinct(F.concat(F.array(q), parts(q, "and"), F.flatten(F.transform(parts(q, "and"), lambda p: parts(p, "or")))))


def rewrite_query(query: Column) -> Column:
    """Synonyms of the first known keyword appended, unless the query is a list; closing ? and ! go."""
    q = F.coalesce(query, F.lit(""))
    chain = None
    for keyword, more in SYNONYMS:
        hit = F.contains(F.lower(q), F.lit(keyword))
        longer = F.concat(q, F.lit(" " + more))
        chain = F.when(hit, longer) if chain is None else chain.when(hit, longer)
    return F.regexp_replace(F.when(q.rlike("[/,]"), q).otherwise(F.coalesce(chain, q)), "[?!]+$", "")


def tags(text: Column) -> Column:
    """Sorted distinct lower-cased #tags and [tags] that are not numbers."""
    hashed = F.regexp_extract_all(text, F.lit(r"(?:^|\s)#([A-Za-z0-9_][A-Za-z0-9_-]*)"), F.lit(1))
    boxed = F.regexp_extract_all(text, F.lit(r"\[([A-Za-z0-9_][A-Za-z0-9_-]*)\]"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(F.filter(F.concat(hashed, boxed), lambda t: ~t.rlike("^[0-9]+$")), F.lower)))


def heading_level(line: Column) -> Column:
    return F.length(F.regexp_extract(line, r"^(#{1,6})\s+(.+)$", 1))


def heading_title(line: Column) -> Column:
    return trimmed(F.regexp_extract(line, r"^(#{1,6})\s+(.+)$", 2))


def host_label(url: Column) -> Column:
    """The second-last label of a URL's host."""
    labels = F.split(F.parse_url(url, F.lit("HOST")), r"\.")
    return F.when(F.size(labels) >= 2, F.element_at(labels, -2)).otherwise(F.element_at(labels, 1))


def middle_cut(text: Column, limit: int) -> Column:
    """Head and tail of a text longer than limit, with a note between of what was cut."""
    half = limit // 2
    note = F.concat(F.lit("\n[... "), (F.length(text) - limit).cast("string"), F.lit(" characters cut ...]\n"))
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, half), note, F.right(text, F.lit(half)))).otherwise(text)


def saturation(score: Column) -> Column:
    """Keyword score to [0, 1)."""
    return 1 - 1 / (1 + score)


def search_tag(text: Column) -> Column:
    """manual, keyword or exact for a message that begins with @rag or @rag:mode; null otherwise."""
    m = r"(?i)^\s*@rag(?::(keyword|exact))?(?=\s|$)"
    mode = F.lower(F.regexp_extract(text, m, 1))
    return F.when(text.rlike(m), F.when(mode == "", F.lit("manual")).otherwise(mode))


def nearest(word: Column, choices: list[str]) -> Column:
    """The choice at the least edit distance; ties to the first."""
    options = F.array(*(F.struct(F.levenshtein(word, F.lit(c)).alias("d"), F.lit(i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(choices)))
    return F.array_min(options)["c"]


def unit_vector(vector: Column) -> Column:
    """A vector over its length; a zero vector stays."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(wide, lambda x: x / norm)).otherwise(wide)


def saved_at(folder: Column, file: Column) -> Column:
    """When a conversation was saved, from names like 31.12.2024 and 23.59.58 - title.json; null for others."""
    day, time = F.regexp_extract(folder, r"^(\d{2}\.\d{2}\.\d{4})$", 1), F.regexp_extract(file, r"^(\d{2}\.\d{2}\.\d{2})(?:\s*-\s*.*)?\.json$", 1)
    return F.try_to_timestamp(F.concat(day, F.lit(" "), time), F.lit("dd.MM.yyyy HH.mm.ss"))


def saved_title(file: Column) -> Column:
    """A saved conversation's title, from its file name."""
    dated = F.regexp_extract(file, r"^\d{2}\.\d{2}\.\d{2}(?:\s*-\s*(.*))?\.json$", 1)
    return F.when(file.rlike(r"^\d{2}\.\d{2}\.\d{2}(?:\s*-\s*.*)?\.json$"), dated).otherwise(F.regexp_replace(file, r"\.json$", ""))


def table_cells(line: Column) -> Column:
    """Trimmed cells of a Markdown table row, without those outside its outer bars."""
    return F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|", -1), lambda c: F.trim(c))


def file_name(raw: Column, longest: int = 50) -> Column:
    """A title as the name of a file: characters that file systems refuse become hyphens, runs collapse, edges and length are cut."""
    c = F.regexp_replace(F.coalesce(raw, F.lit("")), r'[<>:"/\\|?*]', "-")
    c = F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), "-+", "-")
    c = F.regexp_replace(c, r"(?U)^[.\s-]+|[.\s-]+$", "")
    return F.when(F.length(c) > longest, F.regexp_replace(F.substring(c, 1, longest), r"(?U)[.\s-]+$", "")).otherwise(c)


def short_title(text: Column) -> Column:
    """A conversation's title: 57 characters and three dots of texts over 60, a stand-in without text."""
    return F.when(text.isNull(), "Untitled Conversation").when(F.length(text) > 60, F.concat(F.substring(text, 1, 57), F.lit("..."))).otherwise(text)


def changed_only(modified: Column, created: Column) -> Column:
    """Modified files that weren't created too, sorted."""
    return F.array_sort(F.array_except(modified, created))


_STRING = r'"(?:\\.|[^"\\])*"'


def repaired_json(raw: Column) -> Column:
    """Cut-off JSON with its open string, braces and brackets closed, braces first; null where that gives no valid JSON."""
    bare = F.regexp_replace(raw, r'(?s)' + _STRING, "")
    closed = F.when(F.contains(bare, F.lit('"')), F.concat(raw, F.lit('"'))).otherwise(raw)
    outside = F.regexp_replace(closed, r'(?s)' + _STRING, "")
    missing = lambda o, c: F.repeat(F.lit(c), F.greatest(F.lit(0), F.regexp_count(outside, F.lit("\\" + o)) - F.regexp_count(outside, F.lit("\\" + c))))
    full = F.concat(closed, missing("{", "}"), missing("[", "]"))
    return F.when(F.try_parse_json(full).isNotNull(), full)


def fenced_block(text: Column, kind: str = "json") -> Column:
    """The inside of the first fence of a kind, or of one without a kind; null if there is none."""
    found = F.regexp_extract(text, r"(?s)```(?:" + kind + r")?[ \t]*\n(.*?)\n?```", 1)
    return F.when(found != "", found)


def relevant(file_path: Column, text: Column, file: Column, terms: Column, every: bool = False) -> Column:
    """Whether a result comes from a file (a part of its path; null: any) and holds any or all of the terms, in any case; no terms are always held."""
    held = lambda t: F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lower(t))
    terms = F.coalesce(terms, F.array().cast("array<string>"))
    return F.coalesce(F.contains(F.coalesce(file_path, F.lit("")), file), F.lit(True)) & ((F.size(terms) == 0) | (F.forall(terms, held) if every else F.exists(terms, held)))


def invisible_count(text: Column) -> Column:
    """How many characters sanitize() takes out."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(INVISIBLE))


def relative_path(path: Column, root: str) -> Column:
    """A path below a root, with forward slashes; paths outside of it stay as they are."""
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    base = root.replace("\\", "/").rstrip("/") + "/"
    return F.when(F.startswith(plain, F.lit(base)), F.substr(plain, F.lit(len(base) + 1))).otherwise(plain)


def namespace(path: Column, root: str) -> Column:
    """The folders between a root and a file, empty directly below the root."""
    return F.regexp_extract(relative_path(path, root), r"^(?s)(.*)/[^/]*$", 1)


def base_name(path: Column) -> Column:
    """The last part of a path, with its extension."""
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)


def extension(path: Column) -> Column:
    """The lower-cased extension of a file's name without its dot; empty for none and for names that only begin with a dot."""
    return F.lower(F.regexp_extract(base_name(path), r"(?s)^.+\.([^.]*)$", 1))
