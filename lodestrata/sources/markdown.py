"""Web pages as Markdown: the main part of a page without scripts, navigation and frames around it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Elements that are no content, and where the content is looked for, in this order.
DROPPED = frozenset(("script", "style", "nav", "footer", "header", "aside", "noscript"))
MAIN = (("main", None, None), ("article", None, None), ("div", "class", "content"), (None, "id", "content"), ("body", None, None))

VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
BLOCKS = frozenset(("address", "article", "blockquote", "body", "dd", "div", "dl", "dt", "figure", "form", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "html", "li", "main", "ol", "p", "pre", "section", "table", "tr", "ul"))
PAGES = 64  # of a batch read at once
DEEPEST = 200  # elements nested deeper give their content to the last one above

_SPECIAL = re.compile(r"([\\*_`\[\]])|^([-+>#=~]|\d+(?=\.\s))", re.M)


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs = tag, attrs
        self.children: list[Node | str] = []

    def find(self, tag: str | None, key: str | None, value: str | None) -> Node | None:
        for c in self.children:
            if isinstance(c, str):
                continue
            if (tag is None or c.tag == tag) and (key is None or value in c.attrs.get(key, "").split()):
                return c
            if found := c.find(tag, key, value):
                return found
        return None


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def _close(self, tags: tuple[str, ...], within: tuple[str, ...]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                del self.open[i:]
                return
            if self.open[i].tag in within:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self._close(("p",), ("table", "td", "th", "li", "div", "blockquote"))
        if tag == "li":
            self._close(("li",), ("ul", "ol"))
        elif tag in ("td", "th"):
            self._close(("td", "th"), ("tr", "table"))
        elif tag == "tr":
            self._close(("tr",), ("table",))
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID and len(self.open) < DEEPEST:
            self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        self._close((tag,), ())

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def _text(node: Node) -> str:
    return "".join(c if isinstance(c, str) else _text(c) for c in node.children if isinstance(c, str) or c.tag not in DROPPED)


def _block(body: str) -> str:
    return f"\n\n{body}\n\n" if body else ""


def _indented(body: str, mark: str, rest: str) -> str:
    first, *others = body.split("\n")
    return "\n".join([mark + first, *(rest + o if o else o for o in others)])


def _list(node: Node) -> str:
    items, n = [], int(node.attrs["start"]) if node.attrs.get("start", "").isdecimal() else 1
    for c in node.children:
        if isinstance(c, Node) and c.tag == "li":
            mark = "*   " if node.tag == "ul" else f"{n}.  "
            items.append(_indented(_tidy(_inside(c)), mark, "    "))
            n += 1
    return _block("\n".join(items))


def _row(node: Node) -> str:
    return " | ".join(_tidy(_inside(c)).replace("\n", " ") for c in node.children if isinstance(c, Node) and c.tag in ("td", "th"))


def _tidy(body: str) -> str:
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"(?<! ) ?\n(?=\n)|(?<=\n) (?! )", lambda m: "\n" if "\n" in m[0] else "", body)).strip()


def _around(body: str, mark: str) -> str:
    core = body.strip()
    return body.replace(core, mark + core + mark, 1) if core else body


def _element(node: Node) -> str:
    tag = node.tag
    if tag in DROPPED:
        return ""
    if tag == "br":
        return "  \n"
    if tag == "hr":
        return _block("* * *")
    if tag == "img":
        return f"![{node.attrs.get('alt', '')}]({node.attrs['src']})" if node.attrs.get("src") else ""
    if tag == "pre":
        code = _text(node).strip("\n")
        return _block(_indented(code, "    ", "    ")) if code.strip() else ""
    if tag == "code":
        code = re.sub(r"\s+", " ", _text(node))
        fence = "``" if "`" in code else "`"
        return f"{fence}{code}{fence}" if code.strip() else ""
    if tag in ("ul", "ol"):
        return _list(node)
    if tag == "tr":
        return _block(_row(node))
    body = _inside(node)
    if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        title = _tidy(body).replace("\n", " ")
        return _block(f"{'#' * int(tag[1])} {title}" if title else "")
    if tag in ("strong", "b"):
        return _around(body, "**")
    if tag in ("em", "i"):
        return _around(body, "_")
    if tag == "a" and node.attrs.get("href") and body.strip():
        return f"[{body.strip()}]({node.attrs['href']})"
    if tag == "blockquote":
        quoted = _tidy(body)
        return _block("\n".join(f"> {line}".rstrip() for line in quoted.split("\n")) if quoted else "")
    return _block(_tidy(body)) if tag in BLOCKS else body


def _inside(node: Node) -> str:
    return "".join(_SPECIAL.sub(r"\\\g<0>", re.sub(r"[ \t\r\n\f]+", " ", c)) if isinstance(c, str) else _element(c) for c in node.children)


def html_markdown(html: str | None) -> str:
    """A page's main part as Markdown; null and pages without content are empty."""
    parser = _Tree()
    parser.feed(html or "")
    parser.close()
    main = next((found for where in MAIN if (found := parser.root.find(*where))), parser.root)
    return _tidy(_inside(main))


def page_cut(text: Column, max_chars: int) -> Column:
    """Texts beyond max_chars are cut there, with a note of how many of how many characters are missing, and their share."""
    n = F.length(text)
    note = F.format_string("\n\n(cut: %d of %d characters are missing, %d%%)", n - max_chars, n, F.round((n - max_chars) / n * 100).cast("int"))
    return F.when(n > max_chars, F.concat(F.substring(text, 1, max_chars), note)).otherwise(text)


def in_slices(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Pages as Markdown; of a batch only some pages at a time are Python's strings."""
    for batch in batches:
        for at in range(0, len(batch), PAGES):
            yield pa.array([html_markdown(html) for html in batch.slice(at, PAGES).to_pylist()], pa.string())


def markdown_column(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with a column more, the page as Markdown."""
    return pages.withColumn("markdown", F.arrow_udf(in_slices, "string")(F.col(html)))
