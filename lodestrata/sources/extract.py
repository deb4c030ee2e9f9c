"""Text of files and pages: standard-library parsers in Arrow batches, routed by extension and leading bytes."""

from __future__ import annotations

import codecs
import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from posixpath import dirname, join, normpath
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Elements whose content is skipped, that break lines, that are cells.
SKIPPED = frozenset("script style head".split())
BREAKING = frozenset(
    "address article aside blockquote br dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main nav ol p pre section table tbody tfoot thead tr ul".split()
)
CELLS = frozenset("td th".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Markup(HTMLParser):
    """A page as flat tokens: (opened or closed, element) and (data, text)."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.tokens: list[tuple[str, str]] = []
        self.handle_starttag = lambda tag, attrs: self.tokens.append(("opened", tag))
        self.handle_endtag = lambda tag: self.tokens.append(("closed", tag))
        self.handle_data = lambda text: self.tokens.append(("data", text))
        self.feed(html)
        self.close()


def _shown(tokens: list[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """Tokens outside of the elements whose content is skipped."""
    depth = 0
    for kind, what in tokens:
        if what in SKIPPED and kind != "data":
            depth = depth + 1 if kind == "opened" else max(0, depth - 1)
        elif not depth or kind != "data":
            yield kind, what


def html_text(html: str | None) -> str:
    """Texts of a page in order. Those that blocks part get a line break between them, those that only cells part a tab; blank texts among such marks go."""
    texts: list[str] = []
    marks: list[set[str]] = [set()]  # elements before each text
    for kind, what in _shown(_Markup(html or "").tokens):
        if kind == "data":
            if what.strip() or not marks[-1]:
                texts.append(what)
                marks.append(set())
        elif what in BREAKING or what in CELLS:
            if kind == "opened" or what not in VOID:
                marks[-1].add(what)
    parts = ["\n" if m & BREAKING else "\t" if m else "" for m in marks[1:-1]]
    return "".join(x for pair in zip(["", *parts], texts) for x in pair)


def decoded(data: bytes) -> str:
    """By byte-order mark, else UTF-8, else Latin-1."""
    for mark, name in ((codecs.BOM_UTF32_LE, "utf-32-le"), (codecs.BOM_UTF32_BE, "utf-32-be"), (codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")):
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def _safe_xml(data: bytes):
    import xml.etree.ElementTree as ET

    if re.search(rb"<!(?:DOCTYPE|ENTITY)", data[:65536], re.I):
        raise ValueError("document type declarations are refused")
    return ET.fromstring(data)


def docx_text(data: bytes) -> str:
    """Paragraphs in order, one line each; a table row is one line of cells parted by tabs."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = _safe_xml(z.read("word/document.xml")).find(f"{w}body")

    def run(p) -> str:
        return "".join(t.text or "" if t.tag == f"{w}t" else "\t" if t.tag == f"{w}tab" else "\n" if t.tag in (f"{w}br", f"{w}cr") else "" for t in p.iter())

    out = []
    for e in body if body is not None else ():
        if e.tag == f"{w}p":
            out.append(run(e))
        elif e.tag == f"{w}tbl":
            out += ["\t".join(" ".join(filter(None, (run(p) for p in c.iter(f"{w}p")))) for c in r.findall(f"{w}tc")) for r in e.findall(f"{w}tr")]
    return "\n".join(x for x in out if x.strip())


def epub_text(data: bytes) -> str:
    """Documents in spine order, then those of the manifest that the spine leaves out, parted by blank lines."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        package = next((e.get("full-path") for e in _safe_xml(z.read("META-INF/container.xml")).iter() if e.tag.endswith("rootfile")), None) if "META-INF/container.xml" in names else next((n for n in sorted(names) if n.endswith(".opf")), None)
        if not package:
            return ""
        root = _safe_xml(z.read(package))
        items = {e.get("id"): (e.get("href"), e.get("media-type") or "") for e in root.iter() if e.tag.endswith("}item") or e.tag == "item"}
        spine = [e.get("idref") for e in root.iter() if e.tag.endswith("itemref")]
        order = [i for i in spine if i in items] + [i for i, (h, m) in items.items() if i not in spine and ("html" in m or re.search(r"\.x?html?$", h or ""))]
        paths = [normpath(join(dirname(package), unquote(items[i][0].split("#")[0]))) for i in order]
        return "\n\n".join(t for p in dict.fromkeys(paths) if p in names and (t := html_text(decoded(z.read(p))).strip()))


_RTF = re.compile(r"\\([a-z]{1,32})(-?\d{1,10})? ?|\\'([0-9a-fA-F]{2})|\\([^a-z])|([{}])|[\r\n]+|([^\\{}\r\n]+)")
# Groups of RTF without text of the document, and page furniture.
_RTF_HIDDEN = frozenset(
    "fonttbl colortbl stylesheet info listtable listoverridetable revtbl rsidtbl latentstyles datastore themedata colorschememapping filetbl xmlnstbl pgptbl protusertbl userprops docvar pict objdata bkmkstart bkmkend".split()
) | frozenset("header footer generator object".split())
_RTF_TEXT = {"par": "\n", "line": "\n", "sect": "\n", "page": "\n", "row": "\n", "tab": "\t", "cell": "\t", "emdash": "—", "endash": "–", "bullet": "•", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”"}


def rtf_text(data: str) -> str:
    out, stack, hidden, fallback, skip = [], [], False, 1, 0
    for m in _RTF.finditer(data):
        word, number, code, symbol, brace, plain = m.groups()
        if brace == "{":
            stack.append((hidden, fallback))
        elif brace == "}":
            hidden, fallback = stack.pop() if stack else (False, 1)
            skip = 0
        elif symbol == "*" or word in _RTF_HIDDEN:
            hidden = True
        elif word == "uc":
            fallback = int(number or 1)
        elif hidden:
            continue
        elif word == "u" and number:
            out.append(chr(int(number) % 65536))
            skip = fallback
        elif word:
            out.append(_RTF_TEXT.get(word, ""))
        elif code:
            if skip:
                skip -= 1
            else:
                out.append(bytes([int(code, 16)]).decode("cp1252", "replace"))
        elif symbol:
            out.append({"~": "\u00a0", "_": "-"}.get(symbol, symbol if symbol in "\\{}" else ""))
        elif plain:
            out.append(plain[skip:])
            skip = max(0, skip - len(plain))
    return "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace").strip()


def kind_of(path: str, data: bytes) -> str:
    """By leading bytes, then extension."""
    if data.startswith(b"%PDF"):
        return "pdf"
    if data.startswith(b"PK"):
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                names = z.namelist()
        except zipfile.BadZipFile:
            return "broken"
        return "docx" if "word/document.xml" in names else "epub" if "META-INF/container.xml" in names or any(n.endswith(".opf") for n in names) else "zip"
    e = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    return "html" if e in ("html", "htm", "xhtml") else "rtf" if e == "rtf" or data.startswith(b"{\\rtf") else "text"


def extract_bytes(path: str, data: bytes) -> str:
    kind = kind_of(path, data)
    if kind in ("pdf", "zip", "broken"):
        raise ValueError(f"no parser for {kind}")
    parse = {"docx": docx_text, "epub": epub_text}.get(kind)
    return parse(data) if parse else html_text(decoded(data)) if kind == "html" else rtf_text(data.decode("latin-1")) if kind == "rtf" else decoded(data)


def _extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        texts, errors = [], []
        for path, data in zip(frame.path, frame.content, strict=True):
            try:
                texts.append(extract_bytes(path, bytes(data) if data is not None else b""))
                errors.append(None)
            except Exception as e:  # one broken file must not end the job: its row says why
                texts.append(None)
                errors.append(f"{type(e).__name__}: {e}")
        yield pd.DataFrame({"path": frame.path, "text": texts, "error": errors})


def extract_files(files: DataFrame) -> DataFrame:
    """(path, content) to (path, text, error); a file that fails has its error and no text."""
    return files.select("path", "content").mapInPandas(_extract, "path string, text string, error string")


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """Every file under a folder with its bytes, hash, size and time."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).withColumn("file_hash", F.sha2("content", 256))


def html_column(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with a column more, the page's text."""

    @F.pandas_udf("string")
    def text(s: pd.Series) -> pd.Series:
        return s.map(html_text)

    return pages.withColumn("text", text(F.col(html)))
