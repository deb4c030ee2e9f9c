"""Personal data by anchor expansion.

An Aho-Corasick automaton finds at-signs, plus signs, digits, schemes and cue words in one pass over
a text; deterministic local parsers grow each anchor to its boundaries and validate it.

Defined cases: null or empty text has no spans; a null doc_id passes through; repeated rows each get
their row; positions count code points, end exclusive; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import trim, worker_cache

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "iban", "account", "secret", "address")

# Cue words, by the parser that they start.
CUES = {
    "secret": ("password", "passwd", "pwd", "token", "secret", "api_key", "api-key", "apikey", "access_key"),
    "iban": ("iban",),
    "account": ("account", "acct", "konto", "cuenta", "compte", "ssn", "passport"),
    "address": ("street", "avenue", "road", "boulevard", "lane", "drive", "st.", "ave.", "rd.", "blvd", "court", "square", "place", "terrace", "highway", "parkway"),
    "url": ("http://", "https://", "ftp://", "mailto:"),
}
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP_RUN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD_RUN = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL = re.compile(r"[A-Za-z]+:(?://)?[^\s<>\"']{3,}")
_IBAN = re.compile(r"[\s:=#]{0,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"(?: ?(?:no|nr|number|num)\b\.?)?[ :#=]{1,4}([0-9](?:[ -]?[0-9]){5,17})(?![0-9])")
_SECRET = re.compile(r"[\"']?[ \t]*[=:][ \t]*[\"']?([^\s\"',;]{8,})")
_HOUSE = re.compile(r"[0-9]{1,5}[A-Za-z]?,?")
_STREET = re.compile(r"(?:[A-Z][\w.'’-]*|[0-9]+(?:st|nd|rd|th)|of|the|de|la|del|du|von|van|der|den)")


def automaton():
    """The anchors: single characters, and every cue in lower, upper and title case."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for c in "@+0123456789":
        found.add_word(c, (c, 1))
    for kind, cues in CUES.items():
        for cue in cues:
            for form in {cue, cue.upper(), cue.capitalize()}:
                found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _iban_ok(code: str) -> bool:
    code = code.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


class _Houses:
    """Where the house number before a cue stands, over words of a street's name, token by token to the left.

    All tokens that a scan passes share its outcome, so a later scan that comes to one of them ends there: every token of a text is read once.
    """

    def __init__(self, text: str) -> None:
        self.text = text
        self.low, self.high, self.known = 0, -1, -1

    def before(self, at: int, least: int) -> int:
        """The start of the address whose cue stands at this place, not before least; -1 if there is none."""
        text, start, first, found = self.text, at, -1, -1
        while (end := start - 1) > least:
            if self.low <= start <= self.high and first >= 0:
                found = self.known
                break
            left = text.rfind(" ", least, end) + 1 or least
            left = max(left, text.rfind("\n", left, end) + 1)
            token = text[left:end]
            if first >= 0 and _HOUSE.fullmatch(token):
                found = left
                break
            if not _STREET.fullmatch(token) or text[left - 1 : left] == "\n":
                break
            first = first if first >= 0 else left
            start = left
        if first >= 0:
            self.low, self.high, self.known = start, first, found
        return found


def find_spans(text: str | None, anchors) -> list[tuple[str, int, int]]:
    """All spans of a text as (kind, start, end), by kind in the order of KINDS, then start."""
    if not text:
        return []
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    done = dict.fromkeys(KINDS, 0)
    houses = _Houses(text)

    def add(kind: str, start: int, end: int) -> None:
        found[kind].append((start, end))
        done[kind] = end

    for last, (what, length) in anchors.iter(text):
        at = last + 1 - length
        if what == "@":
            start = at
            while start > done["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                add("email", start, m.end())
        elif what == "+":
            if at >= done["phone"] and (m := _PHONE.match(text, at)):
                done["phone"] = m.end()
                if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                    add("phone", at, m.end())
        elif length == 1:
            if at >= done["card"]:
                m = _CARD_RUN.match(text, at)
                done["card"] = m.end() if m else at + 1
                if m and m.end() - at >= 16:
                    digits = m.group().replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and _luhn(digits):
                        add("card", at, m.end())
            if at >= done["ip"]:
                m = _IP_RUN.match(text, at)
                done["ip"] = m.end()
                parts, pos = m.group().split("."), at
                for i in range(0, len(parts) - 3, 4):
                    four = parts[i : i + 4]
                    size = sum(map(len, four)) + 3
                    if all(len(d := p.lstrip("0")) <= 3 and int(d or 0) <= 255 for p in four):
                        found["ip"].append((pos, pos + size))
                    pos += size + 1
        elif what == "url":
            if at >= done["url"] and (m := _URL.match(text, at)):
                add("url", at, m.end())
        elif what == "address":
            if text[at - 1 : at] == " " and not text[last + 1 : last + 2].isalnum() and (start := houses.before(at, done["address"])) >= 0:
                add("address", start, last + 1)
        else:
            # a cue inside a span of its kind opens none, and its run isn't read again
            parser = {"iban": _IBAN, "account": _ACCOUNT, "secret": _SECRET}[what]
            if last >= done[what] and (m := parser.match(text, last + 1)) and (what != "iban" or _iban_ok(m.group(1))):
                add(what, m.start(1), m.end(1))
    return [(k, s, e) for k in KINDS for s, e in found[k]]


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = worker_cache()
    if not hasattr(cache, "pii_anchors"):
        cache.pii_anchors = automaton()
    anchors = cache.pii_anchors
    for batch in batches:
        out: list[list] = [[] for _ in range(7)]
        for text in batch.column("text"):
            spans = find_spans(text.as_py(), anchors)
            said = [f"{k}:{s}:{e}" for k, s, e in spans]
            base = sum(x[0] in BASE_KINDS for x in spans)
            for i, k in enumerate(BASE_KINDS):
                out[i].append(sum(x[0] == k for x in spans))
            out[4].append(hashlib.sha256(",".join(said[:base]).encode()).hexdigest())
            out[5].append(",".join(said))
            out[6].append(len(said))
        counts = [pa.array(x, pa.int64()) for x in out[:4]]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *counts, pa.array(out[4], pa.string()), pa.array(out[5], pa.string()), pa.array(out[6], pa.int64())],
            names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"],
        )
    trim()


def detect(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text) with its counts, digest and spans. No shuffle."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_batches, SCHEMA)
