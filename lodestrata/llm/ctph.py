"""Context-triggered piecewise hashing of whole texts.

A rolling hash over the last WINDOW bytes of a text's UTF-8 triggers the end of a piece where its lowest bits are all ones, as many bits as the block
size has; a piece's letter is the hash of its bytes. A fingerprint is `size:letters:letters`, letters at the block size and at twice of it. The size is the
least power of two that gives at most PIECES pieces of even length; it is halved while a text has under a quarter of that (texts that
repeat themselves trigger rarely). The last of MOST letters hashes all that is left, so every byte of a text counts.

Two fingerprints are compared at the block sizes that they share: likeness is one less the edit distance of the letters over the longer's length,
or 0 if no run of RUN letters (of half of the shorter's, if that is less) stands in both. Without a shared size it is 0; equal fingerprints give 1.

Every document is also fingerprinted as edited, its last quarter replaced by the head of the document that follows by id. Texts are shuffled
once, by ranges of their order; each task walks its range and the edges between ranges, one row each, are joined after it.

Defined cases: a null text is the empty text; documents without an id come last; of rows that share an id the order is that of a hash of their
texts, equal rows after each other; a single document follows itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import drop, keep, trim

WINDOW, PIECES, MOST, RUN = 7, 64, 128, 7
_BLOCK = 1 << 20  # bytes hashed at a time
#: Odd multipliers of a window's bytes, from the golden ratio.
_TAPS = [np.uint32(0x9E3779B1 * (2 * i + 1) & 0xFFFFFFFF) for i in range(WINDOW)]
_LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)


def _rolling(padded: np.ndarray) -> np.ndarray:
    """Hash of every WINDOW bytes of an array."""
    n = len(padded) - WINDOW + 1
    wide = padded.astype(np.uint32)
    h = wide[WINDOW - 1 :] * _TAPS[0]
    for i in range(1, WINDOW):
        h += wide[WINDOW - 1 - i : WINDOW - 1 - i + n] * _TAPS[i]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(16)
    return h


class _Letters:
    """Letters of one block size, fed with hashes in order: MOST at most."""

    def __init__(self, bits: int) -> None:
        self.mask = np.uint32((1 << bits) - 1)
        self.done: list[np.ndarray] = []
        self.n, self.open, self.any = 0, np.uint32(0), False

    def feed(self, h: np.ndarray, mixed: np.ndarray) -> None:
        ends = np.flatnonzero((h & self.mask) == self.mask)[: MOST - 1 - self.n] + 1
        if not len(ends):
            self.open += mixed.sum(dtype=np.uint32)
            self.any = True
            return
        starts = np.concatenate([[0], ends[:-1]])
        sums = np.add.reduceat(mixed[: ends[-1]], starts, dtype=np.uint32)
        sums[0] += self.open
        self.done.append(sums)
        self.n += len(sums)
        self.any = ends[-1] < len(h)
        self.open = mixed[ends[-1] :].sum(dtype=np.uint32)

    def text(self) -> str:
        sums = np.concatenate([*self.done, np.array([self.open] if self.any else [], np.uint32)])
        sums = (sums ^ (sums >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        return _LETTERS[(sums >> np.uint32(26)).astype(np.intp)].tobytes().decode()


def fingerprint(text: str | None) -> str:
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    n = len(data)
    bits = max(0, (max(n, 1) - 1).bit_length() - PIECES.bit_length() + 1)
    with np.errstate(over="ignore"):
        while True:
            one, two = _Letters(bits), _Letters(bits + 1)
            tail = np.zeros(WINDOW - 1, np.uint8)
            for at in range(0, n, _BLOCK):
                padded = np.concatenate([tail, data[at : at + _BLOCK]])
                h = _rolling(padded)
                mixed = h * np.uint32(0x27D4EB2F) ^ (h >> np.uint32(9))
                one.feed(h, mixed)
                two.feed(h, mixed)
                tail = padded[1 - WINDOW :]
            if one.n + one.any >= PIECES // 4 or not bits:
                return f"{1 << bits}:{one.text()}:{two.text()}"
            bits -= 1


def _alike(a: Column, b: Column) -> Column:
    """Likeness of two strings of letters."""
    longer, shorter = F.greatest(F.length(a), F.length(b)), F.least(F.length(a), F.length(b))
    run = F.least(F.lit(RUN), F.ceil(shorter / 2)).cast("int")
    shared = F.exists(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(a) - run + 1)), lambda i: F.contains(b, F.substr(a, i, run)))
    return F.when(a == b, 1.0).when((shorter > 0) & shared, 1 - F.levenshtein(a, b) / longer).otherwise(0.0)


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two fingerprints, 0 to 1."""
    size, one, two = ((lambda c, i=i: F.split_part(c, F.lit(":"), F.lit(i))) for i in (1, 2, 3))
    x, y = size(a).cast("long"), size(b).cast("long")
    same = F.greatest(_alike(one(a), one(b)), _alike(two(a), two(b)))
    return F.when(a == b, 1.0).when(x == y, same).when(x == 2 * y, _alike(one(a), two(b))).when(2 * x == y, _alike(two(a), one(b))).otherwise(0.0)


def edited(text: str, following: str) -> str:
    """A text whose last quarter, rounded down, gives way to as many of the following text's first characters."""
    gone = len(text) // 4
    return text[: len(text) - gone] + following[:gone]


_ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string"
_EDGE = f"{_ROW}, part int, edge string, text string"


def _row(doc_id, text: str, own: str, following: str, other: str) -> tuple:
    changed = edited(text, following)
    digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(text), digest, own, own if changed == text else fingerprint(changed), other


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], names=[n for n, _ in fields])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range in order, each with the one after it; the range's first and last text go out as edges."""
    from pyspark import TaskContext

    part, held = TaskContext.get().partitionId(), None
    for batch in batches:
        out = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            text = text.as_py() or ""
            own = fingerprint(text)
            if held is None:
                out.append((None, None, None, own, None, None, part, "first", text))
            else:
                out.append((*_row(*held, text, own), part, None, None))
            held = doc_id, text, own
        if out:
            yield _batch(out, _EDGE)
    if held is not None:
        yield _batch([(held[0], None, None, held[2], None, None, part, "last", held[1])], _EDGE)
    trim()


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _batch([_row(r["doc_id"], r["text"], r["own"], r["following"], r["other"]) for r in batch.to_pylist()], _ROW)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    # rows alike in id and text are told apart by their place, so that a range may end between them
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("place"))
    order = [F.asc_nulls_last("doc_id"), F.asc("h"), F.asc("place")]
    ranged = plain.withColumn("h", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order)
    walked = keep(ranged.select("doc_id", "text").mapInArrow(_walk, _EDGE), "walked")

    edges = walked.where("edge IS NOT NULL")
    parts = sorted(r.part for r in edges.where("edge = 'first'").select("part").collect())  # a number a range
    after = spark.createDataFrame([(p, q) for p, q in zip(parts, parts[1:] + parts[:1], strict=True)], "part int, next_part int")
    last = edges.where("edge = 'last'").select("doc_id", "text", F.col("fingerprint").alias("own"), "part")
    first = edges.where("edge = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("following"), F.col("fingerprint").alias("other"))
    met = last.join(F.broadcast(after), "part").join(first.hint("shuffle_hash"), "next_part").select("doc_id", "text", "own", "following", "other").mapInArrow(_meet, _ROW)

    rows = walked.where("edge IS NULL").select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint").unionByName(met)
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
