"""Near-duplicate documents by HyperMinHash.

A document's set of word shingles becomes REGISTERS compressed registers: a bucket's least hash is kept as its leading-zero count and
MANTISSA further bits. Buckets that are still empty are filled from further rounds of hashing, so short texts have full sketches too.
Bands of registers propose candidates; pairs must pass the collision-corrected Jaccard estimate, less a margin of over five standard deviations; what passes is
verified on the full sets. Components of verified links are found by distributed label propagation.

Equal sets are one class from the start, so exact copies never meet. Within a band's bucket, first every class meets the smallest
one (a star); once the components of those links are known, classes that share a bucket but not a component meet in blocks of
bounded size, so no bucket is capped and no link between different texts is lost to the choice of stars.

Defined cases: texts without words have an empty set, link with nothing and are their own component; a text of fewer words
than a shingle is one shingle; rows with a null id take no part (component null, kept true); rows that repeat an id are one document.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import drop, keep, mix64, trim, words_of

REGISTERS = 128
MANTISSA = 10
ROWS = 4  # registers a band
BANDS = REGISTERS // ROWS
BLOCK = 512  # classes of one bucket that meet at a time
PAIRS = 32_768  # compared at once
PORTION = 1 << 18  # characters of texts that are hashed at once
TURNS = 16  # rounds of hashing before a small set's buckets are drawn one by one
MARGIN = 0.19  # below the threshold; a standard deviation of the estimate is 0.035 there

SLOTS = 1 << 25  # bits of the filter over wanted ids: 4 MB

_K = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles."""
    import xxhash

    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(h) - size + 1
    with np.errstate(over="ignore"):
        if n < 1:
            acc = np.full(1, len(h), np.uint64)  # the whole sequence as one; its length tells it from longer shingles
            for x in h:
                acc = mix64(acc * _K ^ x)
            return acc
        acc = h[:n]
        for k in range(1, size):
            acc = mix64(acc * _K ^ h[k : n + k])
    return np.unique(acc)


def shingle_sets(texts: list[str | None], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sets of shingle_set() of many texts, one after the other, and where each begins, with the end."""
    import xxhash

    words = [words_of(t) for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(words)), np.uint64, int(counts.sum()))
    begins = np.concatenate([[0], np.cumsum(counts)])
    acc, n = h.copy(), np.maximum(counts - size + 1, 0)
    with np.errstate(over="ignore"):
        for k in range(1, min(size, len(h))):
            acc[:-k] = mix64(acc[:-k] * _K ^ h[k:])
    whole = np.flatnonzero((counts > 0) & (n == 0))  # the whole sequence as one
    for i in whole:
        acc[begins[i]] = shingle_set(texts[i], size)[0]
    n[whole] = 1
    owner = np.repeat(np.arange(len(n)), n)
    offsets = np.concatenate([[0], np.cumsum(n)])
    acc = acc[np.arange(len(owner)) + np.repeat(begins[:-1] - offsets[:-1], n)]
    for lo, hi in zip(offsets[:-1], offsets[1:], strict=True):
        acc[lo:hi].sort()
    new = np.ones(len(acc), bool)
    new[1:] = (acc[1:] != acc[:-1]) | (owner[1:] != owner[:-1])
    return acc[new], np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=len(n)))])


def sketches(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """REGISTERS compressed registers (uint16) of each of many sets, as shingle_sets() gives them; those of an empty set mean nothing."""
    bits, n = REGISTERS.bit_length() - 1, np.diff(offsets)
    least, filled = np.zeros((len(n), REGISTERS), np.uint64), np.zeros((len(n), REGISTERS), bool)
    left, owner = hashes, np.repeat(np.arange(len(n)), n)
    with np.errstate(over="ignore"):
        for turn in range(TURNS):
            h = mix64(left + np.uint64(turn) * _K)
            at = owner * REGISTERS + (h >> np.uint64(64 - bits)).astype(np.int64)
            low, new = np.full(least.size, ~np.uint64(0)), np.zeros(least.size, bool)
            np.minimum.at(low, at, h)
            new[at] = True
            new = new.reshape(filled.shape) & ~filled
            least[new] = low.reshape(filled.shape)[new] << np.uint64(bits)
            filled |= new
            more = ~filled.all(1)[owner]
            left, owner = left[more], owner[more]
            if not len(left):
                break
        for i in np.unique(owner):  # a small set: every bucket left takes a minimum of its own, over all hashes
            empty = np.flatnonzero(~filled[i])
            own = mix64(hashes[offsets[i] : offsets[i + 1], None] + (empty + TURNS).astype(np.uint64) * _K)
            least[i, empty] = own.min(axis=0) << np.uint64(bits)
    zeros = np.where(least == 0, 63, 63 - np.floor(np.log2(np.maximum(least, np.uint64(1)).astype(np.float64))).astype(np.int64)).clip(0, 62).astype(np.uint64)
    mantissa = (least << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    return (zeros << np.uint64(MANTISSA) | mantissa).astype(np.uint16)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """REGISTERS compressed registers (uint16) of a non-empty set."""
    return sketches(hashes, np.array([0, len(hashes)]))[0]


def _portions(texts: pa.Array) -> Iterator[list[str | None]]:
    """Texts in order, so many at a time that their words fit a core's cache."""
    some, size = [], 0
    for text in texts:
        some.append(text.as_py())
        size += len(some[-1] or "")
        if size >= PORTION or len(some) >= PORTION >> 8:
            yield some
            some, size = [], 0
    if some:
        yield some


def estimate(equal: np.ndarray | int) -> np.ndarray | float:
    """Jaccard similarity from the number of equal registers, less what chance collisions of compressed registers add."""
    chance = 2.0**-MANTISSA / 3  # two independent minima share their leading zeros with chance 1/3, and then their mantissa
    return np.maximum(0.0, (equal / REGISTERS - chance) / (1 - chance))


def _sketches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in _portions(batch.column("text")):
                sets, offsets = shingle_sets(texts, size)
                n = np.diff(offsets)
                with np.errstate(over="ignore"):
                    ends = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(x), dtype=np.uint64)])[offsets] for x in (sets, sets ^ _K)]
                    f1, f2 = ((e[1:] - e[:-1]).view(np.int64) for e in ends)
                none = n == 0
                regs = [None if e else r.tobytes() for e, r in zip(none, sketches(sets, offsets), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, len(texts)), pa.array(n, pa.int64()), pa.array(f1, pa.int64(), mask=none), pa.array(f2, pa.int64(), mask=none), pa.array(regs, pa.binary())],
                    names=["doc_id", "n_shingles", "f1", "f2", "regs"],
                )
                at += len(texts)
        trim()

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(band key, place of the band, id) of every band of every sketch."""
    salt = mix64(np.arange(1, BANDS + 1, dtype=np.uint64))
    for batch in batches:
        ids = batch.column("rep").to_numpy()
        if not len(ids):
            continue
        regs = np.frombuffer(b"".join(batch.column("regs").to_pylist()), np.uint16).reshape(len(ids), BANDS, ROWS)
        with np.errstate(over="ignore"):
            key = np.ascontiguousarray(regs).view(np.uint64)[:, :, 0]  # ROWS x 16 bits
            key = mix64(mix64(key) ^ salt)
        place = np.tile(np.arange(BANDS, dtype=np.int32), len(ids))
        yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(place), pa.array(np.repeat(ids, BANDS))], names=["band", "place", "rep"])


def _long(short: bytes) -> np.ndarray:
    b = np.frombuffer(short, np.uint8).reshape(-1, 3).astype(np.uint32)
    return b[:, 0] | b[:, 1] << np.uint32(8) | b[:, 2] << np.uint32(16)


def _short(hashes: np.ndarray) -> bytes:
    """A set as sorted 3-byte hashes, repeats kept: what two of them share is never fewer than what the full sets share."""
    return np.sort(hashes >> np.uint64(40)).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def _sets_of(plain: DataFrame, wanted: DataFrame, size: int, short: bool) -> DataFrame:
    """(rep, shingles) of the documents in wanted, full or short. Rows that repeat an id with other texts give a row each.

    A bitmap of SLOTS bits over hashes of the wanted ids goes to where texts are read, so few others' sets are shuffled; however
    full the bitmap gets, the join behind it keeps those that are wanted.
    """
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS))
    bits = wanted.select(slot("rep").alias("s")).groupBy(F.floor(F.col("s") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(s % 64))")).alias("bits")).toPandas()
    bitmap = np.zeros(SLOTS // 64, np.int64)
    bitmap[bits.word.to_numpy(np.int64)] = bits.bits.to_numpy(np.int64)
    shared = plain.sparkSession.sparkContext.broadcast(bitmap)  # SLOTS / 8 bytes, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = batch.column("slot").to_numpy()
            at = np.flatnonzero(shared.value[s >> 6] >> (s & 63) & 1)
            part, at = batch.take(pa.array(at)), 0
            for texts in _portions(part.column("text")):
                sets, offsets = shingle_sets(texts, size)
                if short:
                    column = pa.array([_short(sets[lo:hi]) for lo, hi in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())
                else:
                    column = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(sets.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("rep").slice(at, len(texts)), column], names=["rep", "short" if short else "shingles"])
                at += len(texts)
        trim()

    known = plain.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("rep"), slot("doc_id").alias("slot"), "text")
    return known.mapInArrow(run, "rep long, short binary" if short else "rep long, shingles array<long>").join(wanted, "rep", "left_semi")


@F.pandas_udf(T.DoubleType())
def _similar(a: pd.Series, b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype=float)
    x, y = (np.frombuffer(b"".join(s), np.uint16).reshape(len(s), -1) for s in (a, b))
    return pd.Series(estimate((x == y).sum(1)))


def _verified(pairs: DataFrame, reps: DataFrame, plain: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose full sets are similar enough. Kept as a table."""
    regs = reps.select("rep", "regs", "n_shingles")
    sided = lambda s: regs.select(F.col("rep").alias(s), F.col("regs").alias(f"r{s}"), F.col("n_shingles").alias(f"n{s}"))
    near = (
        pairs.join(sided("a"), "a").join(sided("b"), "b")
        .where((100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (_similar("ra", "rb") >= percent / 100 - MARGIN))
        .select("a", "b", "na", "nb")
    )
    near = keep(near, "near")
    wanted = keep(near.select(F.col("a").alias("rep")).union(near.select("b")).distinct(), "wanted")
    sets = keep(_sets_of(plain, wanted, size, False), "sets")
    one = lambda s: sets.select(F.col("rep").alias(s), F.col("shingles").alias(f"s{s}"))
    meet = F.size(F.array_intersect("sa", "sb"))
    links = near.join(one("a"), "a").join(one("b"), "b").withColumn("i", meet).where(100 * F.col("i") >= percent * (F.size("sa") + F.size("sb") - F.col("i"))).select("a", "b").distinct()
    links = keep(links, "links")
    for d in (near, wanted, sets):
        drop(d)
    return links


def components(links: DataFrame) -> DataFrame:
    """(rep, component) for every node of links (a, b): the smallest node reachable. Kept as a table.

    Alternating large-star and small-star steps; each step's edges are kept in the shared folder.
    """
    edges = keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = keep(both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        low2 = keep(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low2, "u")
        small = keep(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low2.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "small")
        same = small.join(edges, ["u", "v"], "left_anti").isEmpty() and edges.join(small, ["u", "v"], "left_anti").isEmpty()
        for d in (edges, low, large, low2):
            drop(d)
        edges = small
        if same:
            break
    out = keep(edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("rep"), "component"), "components")
    drop(edges)
    return out


def _across(percent: int):
    """Of rows sorted by bucket, pair of blocks and side: pairs of different components that may be links by their short sets, which miss none.

    Most open buckets hold a few classes, so all that a batch holds meet in the same array operations. A pair of blocks is at most some
    2 * BLOCK rows; the last of a batch waits for the next. A pair is looked at in the first band that it shares only, so once in all buckets.
    """
    least = percent / 100 - MARGIN
    keys = ["band", "x", "y"]

    def meet(rows: pa.Table) -> pa.RecordBatch:
        column = {c: rows[c].to_numpy() for c in (*keys, "side", "place", "rep", "component")}
        regs = np.frombuffer(b"".join(rows["regs"].to_pylist()), np.uint16).reshape(rows.num_rows, REGISTERS)
        short = rows["short"].combine_chunks()
        sizes = pc.binary_length(short).to_numpy() // 3
        begins = _begins([column[c] for c in keys])
        ends = np.append(begins[1:], rows.num_rows)
        m = ends - begins
        second = ends - np.add.reduceat(column["side"], begins)  # where a group's rows of the other block begin
        one = (column["x"] == column["y"])[begins]
        place = np.arange(rows.num_rows)
        lo = np.where(np.repeat(one, m), place + 1, np.repeat(second, m))
        n = np.where(np.repeat(one, m) | (column["side"] == 0), np.repeat(ends, m) - lo, 0)
        before = np.concatenate([[0], np.cumsum(n)])
        found, at, decoded = [], 0, {}
        full = lambda i: decoded[i] if i in decoded else decoded.setdefault(i, _long(short[i].as_py()))
        while at < rows.num_rows:
            to = max(at + 1, int(np.searchsorted(before, before[at] + PAIRS, "right")) - 1)
            left = np.repeat(place[at:to], n[at:to])
            right = np.arange(len(left)) - np.repeat(before[at:to] - before[at], n[at:to]) + np.repeat(lo[at:to], n[at:to])
            at = to
            a, b = sizes[left], sizes[right]
            some = np.flatnonzero((column["component"][left] != column["component"][right]) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b)))
            left, right = left[some], right[some]
            equal = regs[left] == regs[right]
            some = np.flatnonzero(estimate(equal.view(np.uint8).sum(1, dtype=np.uint8)) >= least)
            left, right, equal = left[some], right[some], equal[some]
            some = np.flatnonzero(equal.reshape(len(some), BANDS, ROWS).all(2).argmax(1) == column["place"][left])
            left, right = left[some], right[some]
            bounds = np.append(_begins([left]), len(left))
            for s, e in zip(bounds[:-1], bounds[1:], strict=True):
                own, others = full(left[s]), right[s:e]
                other = np.concatenate([full(i) for i in others])
                hit = own[np.minimum(np.searchsorted(own, other), len(own) - 1)] == other
                shared = np.minimum(np.add.reduceat(hit.astype(np.int64), np.concatenate([[0], np.cumsum(sizes[others])[:-1]])), len(own))
                others = others[100 * shared >= percent * (len(own) + sizes[others] - shared)]
                found.append(np.stack([np.full(len(others), column["rep"][left[s]]), column["rep"][others]], 1))
        pairs = np.concatenate([np.empty((0, 2), np.int64), *found])
        return pa.RecordBatch.from_arrays([pa.array(pairs.min(1)), pa.array(pairs.max(1))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            if not rows.num_rows:
                continue
            last = int(_begins([rows[c].to_numpy() for c in keys])[-1])
            rest = rows.slice(last)
            if last:
                yield meet(rows.slice(0, last))
        if rest is not None:
            yield meet(rest)
        trim()

    return run


def _begins(columns: list[np.ndarray]) -> np.ndarray:
    """Where rows begin that differ from the row before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.flatnonzero(new)


def link_documents(docs: DataFrame, size: int = 2, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """Components of documents under 100 * intersection >= percent * union of their sets of size-word shingles.

    docs: (doc_id, text). Returns (doc_id, n_shingles, f1, f2) for every row and (f1, f2, component) for every class.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = keep(plain.mapInArrow(_sketches(size), "doc_id long, n_shingles long, f1 long, f2 long, regs binary"), "sketches")
    classes = keep(rows.where("f1 IS NOT NULL AND doc_id IS NOT NULL").groupBy("f1", "f2").agg(F.min("doc_id").alias("rep")), "classes")
    owners = rows.where("f1 IS NOT NULL").select(F.col("doc_id").alias("rep"), "f1", "f2", "n_shingles", "regs")
    reps = keep(owners.join(classes, ["rep", "f1", "f2"], "left_semi").dropDuplicates(["rep", "f1", "f2"]), "reps")

    bands = keep(reps.select("rep", "regs").mapInArrow(_bands, "band long, place int, rep long"), "bands")
    buckets = keep(bands.groupBy("band").agg(F.min("rep").alias("star"), F.max("rep").alias("last")).where("star < last").select("band", "star"), "buckets")
    shared = keep(bands.join(buckets, "band"), "shared")
    drop(bands)
    stars = shared.where("rep <> star").select(F.col("star").alias("a"), F.col("rep").alias("b")).distinct()
    links = _verified(stars, reps, plain, size, percent)
    found = components(links)

    # buckets that still hold several components
    labelled = shared.join(found, "rep", "left").select("band", "place", "rep", F.coalesce("component", "rep").alias("component"))
    labelled = keep(labelled, "labelled")
    open_ = keep(labelled.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("band", "n"), "open")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK)).cast("int")
    members = labelled.join(open_, "band").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    members = keep(members, "members")
    wanted = keep(members.select("rep").distinct(), "wanted")
    sets = keep(_sets_of(plain, wanted, size, True).join(reps.select("rep", "regs"), "rep"), "sets")
    members = members.join(sets, "rep").select("band", "place", "rep", "component", "regs", "short", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    members = members.select("band", "place", "rep", "component", "regs", "short", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    more = members.repartition("band", "x", "y").sortWithinPartitions("band", "x", "y", "side").mapInArrow(_across(percent), "a long, b long").distinct()
    late = _verified(keep(more, "more"), reps, plain, size, percent)
    if not late.isEmpty():
        again = components(links.unionByName(late))
        drop(found)
        found = again
    named = classes.join(found, "rep", "left").select("f1", "f2", F.coalesce("component", "rep").alias("component"))
    named = keep(named, "named")
    for d in (classes, reps, buckets, shared, labelled, open_, members, wanted, sets, links, late, found):
        drop(d)
    return rows.select("doc_id", "n_shingles", "f1", "f2"), named


def near_duplicates(docs: DataFrame, size: int = 2, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs."""
    rows, named = link_documents(docs, size, percent)
    return rows.join(named, ["f1", "f2"], "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(True)).alias("kept"),
    )


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) END AS g FROM d),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, any_value(a.n) AS nu, any_value(b.n) AS nv, count(*) AS i FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2),
l AS (SELECT u, v FROM p WHERE 100 * i >= 80 * (nu + nv - i)),
r AS (SELECT doc_id AS u, doc_id AS v FROM s UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u),
c AS (SELECT u, min(v) AS component_id FROM r GROUP BY u)
SELECT doc_id, len(g) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c ON s.doc_id = c.u
"""
