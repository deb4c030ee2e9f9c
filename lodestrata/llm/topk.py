"""Exact top-k inner products by three-phase uniform thresholds.

The nodes are blocks of candidates, each holding M score lists per query: the partial inner products over
M segments of the components. Phase 1: from the heads of its lists every block gathers k candidates
with exact sums, and a query's k-th best of these over all blocks is its cutoff, a safe lower bound. Phase 2: the cutoff goes out with its query, and
blocks collect every candidate with some partial score of at least cutoff / M; no other can reach the cutoff. Phase 3:
the missing partial scores of those candidates are resolved, giving exact sums; a block returns its k best that reach the cutoff.

Queries and candidates meet in blocks of bounded size, so no side is broadcast and no pairs are emitted.

Defined cases: components beyond +-2^53 after scaling count as +-2^53, and scores beyond +-(2^63 - 1) as that; vectors null, empty, or with null or non-finite components take no part; vectors of different lengths score over
none (they are compared within their length only); rows that repeat a vec_id are candidates each, none of them for
its own id; as a query such an id is asked once, by its least vector.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import keep

SEGMENTS = 4
QUERY_BLOCK = 8192
CANDIDATE_BLOCK = 8192
MIN_BLOCKS = 16
_STEP = 256  # queries at a time within a block
#: What components and scores are held to.
LARGEST, MOST_SCORE = 1 << 53, (1 << 63) - 1

_FOUND = "query_id long, vec_id long, score long"


def _matrix(column: pd.Series) -> np.ndarray:
    """Rows of long arrays."""
    return np.stack([np.asarray(v, np.int64) for v in column])


def _exact(q: np.ndarray, c: np.ndarray):
    """The type in which inner products of q and c cannot lose a unit."""
    most = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(c.astype(float)).max(initial=0)) * q.shape[1]
    kind = np.float64 if most < 2**52 else np.int64 if most < 2**62 else object
    return q.astype(kind), c.astype(kind)


def _whole(sums: np.ndarray) -> np.ndarray:
    """Exact sums as 64-bit integers, held to +-MOST_SCORE."""
    return np.clip(sums, -MOST_SCORE, MOST_SCORE).astype(np.int64) if sums.dtype == object else sums.astype(np.int64)


def _less(x: np.ndarray) -> np.ndarray:
    """Doubles lowered by more than the rounding of integers of their size."""
    return np.where(np.isfinite(x), x - np.abs(x) * 2.0**-50, x)


def _segments(width: int) -> list[slice]:
    m = min(SEGMENTS, width)
    at = [i * width // m for i in range(m + 1)]
    return [slice(a, b) for a, b in zip(at, at[1:], strict=False)]


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best by (score descending, id ascending)."""
    if len(ids) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(ids))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _by_width(left: pd.DataFrame, right: pd.DataFrame):
    for width, q in left.groupby(left.v.map(len)):
        c = right[right.v.map(len) == width]
        if len(c):
            yield q, c


def _lower(k: int):
    """Phase 1 in one block: exact sums of candidates at the heads of the partial lists, k a query."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for q, c in _by_width(left, right):
            ids, qids = c.vec_id.to_numpy(), q.vec_id.to_numpy()
            a, b = _exact(_matrix(q.v), _matrix(c.v))
            head = min(k + 1, len(ids))
            for s in range(0, len(qids), _STEP):
                heads = []
                for seg in _segments(a.shape[1]):
                    part = a[s : s + _STEP, seg] @ b[:, seg].T
                    heads.append(np.argpartition(part.astype(float), len(ids) - head, axis=1)[:, -head:])
                heads = np.concatenate(heads, axis=1)
                for i in range(len(heads)):
                    h = np.unique(heads[i])
                    h = h[ids[h] != qids[s + i]]
                    sums = _whole(b[h] @ a[s + i])
                    top = np.sort(sums)[::-1][:k]
                    out.append(pd.DataFrame({"query_id": np.full(len(top), qids[s + i]), "vec_id": np.zeros(len(top), np.int64), "score": top}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    return run


def _resolve(k: int):
    """Phases 2 and 3 in one block."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for q, c in _by_width(left, right):
            ids, qids, cut = c.vec_id.to_numpy(), q.vec_id.to_numpy(), _less(q.cutoff.to_numpy(float))
            a, b = _exact(_matrix(q.v), _matrix(c.v))
            segs = _segments(a.shape[1])
            for s in range(0, len(qids), _STEP):
                share = _less(np.floor(cut[s : s + _STEP] / len(segs)))[:, None]
                enough = np.zeros((len(share), len(ids)), bool)
                for seg in segs:
                    enough |= (a[s : s + _STEP, seg] @ b[:, seg].T).astype(float) >= share
                for i in range(len(share)):
                    h = np.flatnonzero(enough[i])
                    h = h[ids[h] != qids[s + i]]
                    sums = _whole(b[h] @ a[s + i])
                    ok = sums >= cut[s + i]
                    h, sums = h[ok], sums[ok]
                    top = _best(ids[h], sums, k)
                    out.append(pd.DataFrame({"query_id": np.full(len(top), qids[s + i]), "vec_id": ids[h][top], "score": sums[top]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """vectors and queries: (vec_id long, v array<long>). Returns query_id, rank, vec_id, score."""
    n, m = vectors.count(), queries.count()
    blocks = max(MIN_BLOCKS, -(-n // CANDIDATE_BLOCK))
    query_blocks = max(1, -(-m // QUERY_BLOCK))
    spread = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    cand = vectors.withColumn("cb", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("qb", spread(query_blocks))
    asked = keep(queries.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("qb", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(query_blocks)).cast("int")), "asked")
    by = ["qb", "cb"]
    lower = asked.withColumn("cb", spread(blocks)).groupBy(by).cogroup(cand.groupBy(by)).applyInPandas(_lower(k), _FOUND)
    place = Window.partitionBy("query_id").orderBy(F.desc("score"))
    cutoff = lower.withColumn("r", F.row_number().over(place)).where(F.col("r") <= k).groupBy("query_id").agg(F.min("score").alias("low"), F.count(F.lit(1)).alias("got"))
    cutoff = cutoff.select(F.col("query_id").alias("vec_id"), F.when(F.col("got") >= k, F.col("low")).alias("cutoff"))
    # without k candidates there is no cutoff: everything is sufficient
    ready = keep(asked.join(cutoff, "vec_id", "left").withColumn("cutoff", F.coalesce(F.col("cutoff").cast("double"), F.lit(float("-inf")))), "cutoffs")
    found = ready.withColumn("cb", spread(blocks)).groupBy(by).cogroup(cand.groupBy(by)).applyInPandas(_resolve(k), _FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def scaled(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v): floor(256 * x) of every component; vectors that are null or hold null or non-finite components go."""
    x = F.col("e")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return (
        embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda c: c.cast("double")).alias("e"))
        .where(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & (F.size("e") > 0) & fine)
        .select("vec_id", F.transform("e", lambda c: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(F.lit(256.0) * c)))).alias("v"))
    )


def search(embeddings: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """Rows whose vec_id is divisible by every, against all other rows."""
    vectors = scaled(embeddings)
    return top_k(vectors, vectors.where(F.col("vec_id") % every == 0), k)


ORACLE = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(greatest(-{LARGEST}, least({LARGEST}, floor(256 * CAST(x AS DOUBLE)))) AS HUGEINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(greatest(-{MOST_SCORE}, least({MOST_SCORE}, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])))) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
