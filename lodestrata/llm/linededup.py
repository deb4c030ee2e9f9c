"""Line deduplication over levelled sorted runs of line hashes.

The store holds runs: tables of (h1, h2, owner), sorted by the 128-bit hash of a line's key, no key in two
runs. Batches of documents come in rising order of id. Each new batch is merge-anti-joined with the
runs, and the keys that are new to all of them, with the smallest id that holds each, become a run of
level 0. FANOUT runs of one level are compacted into one of the next. A line is dropped if its key's owner is a smaller id
than its document's. DataFrame functions only.

A key is its line, stripped of white space (\\x20, \\x09-\\x0D) and with A-Z lower-cased; keys under MIN_KEY code points never drop.

Defined cases: null or empty text is one empty line; rows with a null id keep all lines and own none; rows that
repeat an id are one document for ownership and each get their row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import SPACE_CHARS, drop, keep

MIN_KEY = 10
FANOUT = 2
#: Batches that a whole table is fed in: over FANOUT, so the last one meets a compacted run.
BATCHES = FANOUT + 1

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE_CHARS)), _UPPER, _LOWER)


class LineRuns:
    """Levelled sorted runs. levels[i] lists runs of level i."""

    def __init__(self, spark: SparkSession, fanout: int | None = None) -> None:
        self.spark, self.fanout = spark, fanout or FANOUT
        self.levels: list[list[DataFrame]] = []

    def all(self) -> DataFrame | None:
        runs = [r for level in self.levels for r in level]
        return None if not runs else runs[0] if len(runs) == 1 else _union(runs)

    def add(self, fresh: DataFrame) -> None:
        """Add a run whose keys no run holds, then compact full levels."""
        self._put(0, keep(fresh.sortWithinPartitions("h1", "h2"), "run"))

    def _put(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fanout:
            full, self.levels[level] = self.levels[level], []
            merged = keep(_union(full).repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2"), "run")
            for r in full:
                drop(r)
            self._put(level + 1, merged)

    def add_batch(self, lines: DataFrame) -> DataFrame:
        """lines: (doc_id, h1, h2) of documents later than all before. Returns (h1, h2, owner) of the batch's keys that drop lines somewhere in it."""
        keys = keep(lines.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")), "keys")
        known = self.all()
        if known is None:
            fresh, repeated = keys, keys.where("last > first").select("h1", "h2", F.col("first").alias("owner"))
        else:
            fresh = keys.hint("merge").join(known.select("h1", "h2"), ["h1", "h2"], "left_anti")
            inside = keys.where("last > first").select("h1", "h2", F.col("first").alias("owner"))
            before = known.join(keys.select("h1", "h2").hint("merge"), ["h1", "h2"]).select("h1", "h2", "owner")
            repeated = inside.unionByName(before).groupBy("h1", "h2").agg(F.min("owner").alias("owner"))
        repeated = keep(repeated, "repeated")
        self.add(fresh.select("h1", "h2", F.col("first").alias("owner")))
        drop(keys)
        return repeated

    def close(self) -> None:
        for level in self.levels:
            for r in level:
                drop(r)
        self.levels = []


def _union(runs: list[DataFrame]) -> DataFrame:
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    return out


def _hashed_lines(docs: DataFrame, cuts: list[int]) -> DataFrame:
    """(batch, doc_id, t1, pos, h1, h2) of every line that could drop; t1 tells rows with one id apart."""
    batch = F.lit(0)
    for c in cuts:
        batch = batch + (F.col("doc_id") > F.lit(c)).cast("int")
    return (
        docs.where(F.col("doc_id").isNotNull())
        .select("doc_id", F.xxhash64("text").alias("t1"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
        .select("doc_id", "t1", "pos", line_key(F.col("line")).alias("key"))
        .where(F.length("key") >= MIN_KEY)
        .select(batch.alias("batch"), "doc_id", "t1", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(41), F.col("key")).alias("h2"))
    )


def dropped_lines(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(doc_id, t1, dropped array<int>) for the rows of docs (doc_id, text) that lose lines."""
    spark = docs.sparkSession
    share = [i / batches for i in range(1, batches)]
    cuts = sorted({int(c) for c in docs.stat.approxQuantile("doc_id", share, 0.001)}) if share else []
    lines = keep(_hashed_lines(docs, cuts), "lines")
    store, parts, spent = LineRuns(spark), [], []
    for b in range(len(cuts) + 1):
        own = lines.where(F.col("batch") == b)
        repeated = store.add_batch(own)
        spent.append(repeated)
        hit = own.hint("merge").join(repeated, ["h1", "h2"]).where(F.col("owner") < F.col("doc_id"))
        parts.append(hit.select("doc_id", "t1", "pos"))
    out = keep(_union(parts).groupBy("doc_id", "t1").agg(F.collect_set("pos").alias("dropped")), "dropped")
    store.close()
    for d in (lines, *spent):
        drop(d)
    return out


def with_kept_text(docs: DataFrame, text: str = "text") -> DataFrame:
    """row (a struct of all columns of docs, whatever their names), n_lines, n_dropped, kept (the text that stays) for every row of docs. docs needs a long doc_id; reads it twice."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    gone = dropped_lines(plain)
    own = F.coalesce(F.col("row")[text].cast("string"), F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    joined = rows.hint("merge").join(gone, (F.col("row")["doc_id"].cast("long") == F.col("doc_id")) & (F.xxhash64(own) == F.col("t1")), "left")
    lines = F.split(own, "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("dropped"))
    kept = F.when(F.col("dropped").isNull(), own).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col("lines"), i)), "\n"))
    return joined.withColumn("lines", F.when(F.col("dropped").isNotNull(), lines)).select(
        "row", (F.length(own) - F.length(F.replace(own, F.lit("\n"))) + 1).cast("long").alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept")
    )


def dedup_lines(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 for every row of docs."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_kept_text(plain).select(F.col("row")["doc_id"].alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT rid, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 AND doc_id IS NOT NULL GROUP BY key),
m AS (SELECT k.*, o.owner IS NOT NULL AND o.owner < k.doc_id AS gone FROM k LEFT JOIN o ON k.key = o.key AND length(k.key) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid
"""
