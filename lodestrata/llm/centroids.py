"""Centroid clustering with block-norm screening.

Vectors become integers. Each is stored once with its compressed form: components rounded to LEVELS steps to either side of zero, a byte each, the step,
the vector's length, and the norms of what rounding left over in each of SEGMENTS segments. For a centroid c, Cauchy-Schwarz by segment bounds what the rest
can add to the inner product, so |x - c|^2 >= |x|^2 + |c|^2 - 2 <rounded x, c> - 2 sum over s of |rest_s| |c_s|. The centroid with the least
bound gets an exact integer distance first; of the others, only those whose bound doesn't exceed it get theirs. Bounds are floating point and are
lowered by more than their rounding error, so no centroid at an equal or smaller distance is ever pruned. Rounds add up exact sums, a row a
centroid and component and task; only these centroids reach the driver.

Defined cases: vectors null, of another width, or with null or non-finite components take no part; components beyond +-2^24 after scaling
count as +-2^24, so that distances fit 64 bits, and sums of distances beyond 2^63 - 1 as that; rows that repeat a vec_id are vectors each (as first centroids
in the order of their components); a null vec_id hashes as empty text; with fewer vectors than centroids there are as many centroids
as vectors; a centroid that no vector is nearest to stays; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import drop, keep, trim

WIDTH, SCALE, CENTROIDS, ROUNDS = 64, 64, 16, 3
SEGMENTS, LEVELS = 8, 31
MOST = 1 << 24
_STEP = 4096  # vectors at a time

_COMPACT = "vec_id long, v binary, codes binary, about binary"


def scaled(embeddings: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """(vec_id, v array<int>) of the vectors that take part."""
    e = F.col("e")
    fine = F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    whole = lambda c: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(F.lit(float(scale)) * c))).cast("int")
    return (
        embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda c: c.cast("double")).alias("e"))
        .where(e.isNotNull() & (F.size("e") == width) & fine).select("vec_id", F.transform("e", whole).alias("v"))
    )


def norms(rows: np.ndarray, segments: int = SEGMENTS) -> np.ndarray:
    """Lengths of each row's segments, runs of components of alike size."""
    at = [i * rows.shape[1] // segments for i in range(segments)]
    return np.sqrt(np.add.reduceat(rows.astype(float) ** 2, at, axis=1))


def compressed(rows: np.ndarray, segments: int = SEGMENTS, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray]:
    """Codes of rows, and about them: step, squared length, norms of the rest by segment."""
    step = np.maximum(np.abs(rows).max(1, initial=0), 1) / levels
    codes = np.rint(rows / step[:, None]).astype(np.int8)
    rest = norms(rows - codes * step[:, None], segments)
    return codes, np.column_stack([step, (rows.astype(float) ** 2).sum(1), rest])


def _compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        rows = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype("<i4").reshape(n, -1)
        codes, about = compressed(rows)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), *(pa.array([r.tobytes() for r in x], pa.binary()) for x in (rows, codes, about.astype("<f8")))], names=["vec_id", "v", "codes", "about"])


def nearest(rows: np.ndarray, codes: np.ndarray, about: np.ndarray, centroids: np.ndarray, many: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centroid (ties: the smaller number) and its exact squared distance; many gets the number of exact distances."""
    n, k = len(rows), len(centroids)
    step, square, rest = about[:, 0], about[:, 1], about[:, 2:]
    sides = square[:, None] + (centroids.astype(float) ** 2).sum(1)[None, :]
    low = sides - 2 * step[:, None] * (codes.astype(float) @ centroids.T.astype(float)) - 2 * rest @ norms(centroids, rest.shape[1]).T
    low -= sides * 1e-9 + 1e-6
    wide, c = rows.astype(np.int64), centroids.astype(np.int64)
    first = low.argmin(1)
    cluster, best, done = first.copy(), ((wide - c[first]) ** 2).sum(1), n
    for j in range(k):
        at = np.flatnonzero((low[:, j] <= best) & (first != j))
        if len(at):
            done += len(at)
            d = ((wide[at] - c[j]) ** 2).sum(1)
            better = (d < best[at]) | ((d == best[at]) & (j < cluster[at]))
            best[at[better]], cluster[at[better]] = d[better], j
    if many is not None:
        many.append(done)
    return cluster, best


def _steps(batches: Iterator[pa.RecordBatch], centroids: np.ndarray):
    """(ids, rows, cluster, distance) of bounded runs of rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, _STEP):
            part = batch.slice(at, _STEP)
            rows, codes, about = (np.frombuffer(b"".join(part.column(c).to_pylist()), t).reshape(part.num_rows, -1) for c, t in (("v", "<i4"), ("codes", "i1"), ("about", "<f8")))
            yield part.column("vec_id"), rows, *nearest(rows, codes, about, centroids)


def _sums(centroids: np.ndarray):
    """A task's share of a round: (cluster, pos, total, n) for the centroids that its vectors chose."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, width = centroids.shape
        total, n = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for _, rows, cluster, _ in _steps(batches, centroids):
            for j in np.unique(cluster):
                mine = rows[cluster == j]
                total[j] += mine.sum(0, dtype=np.int64)
                n[j] += len(mine)
        at = np.repeat(np.flatnonzero(n), width)
        pos = np.tile(np.arange(width), len(at) // width)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(pos.astype(np.int32)), pa.array(total[at, pos]), pa.array(n[at])], names=["cluster", "pos", "total", "n"])
        trim()

    return run


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, cluster, distance in _steps(batches, centroids):
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])
        trim()

    return run


def clusters(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """vectors: (vec_id, v array<int>) of one width. Returns vec_id, cluster, distance as a kept table, and the final centroids."""
    compact = keep(vectors.mapInArrow(_compact, _COMPACT), "vectors")
    seed = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = vectors.orderBy(seed, "v").limit(k).collect()  # k rows
    if not first:
        return compact.selectExpr("vec_id", "0 AS cluster", "0L AS distance").where(F.lit(False)), np.zeros((0, 0), np.int64)
    centroids = np.array([r.v for r in first], np.int64)
    for _ in range(rounds):
        sums = compact.mapInArrow(_sums(centroids), "cluster int, pos int, total long, n long").groupBy("cluster", "pos").agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total"), F.sum("n").alias("n"))
        for r in sums.collect():  # a row a centroid and component
            centroids[r.cluster, r.pos] = int(r.total) // r.n
    out = keep(compact.mapInArrow(_assigned(centroids), "vec_id long, cluster int, distance long"), "clusters")
    drop(compact)
    return out, centroids


def cluster_vectors(embeddings: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every vector that takes part."""
    spark = embeddings.sparkSession
    found, centroids = clusters(scaled(embeddings), k, rounds)
    most = 2**63 - 1
    sums = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}  # a row a centroid
    inertia = min(sum(sums.values()), most)
    about = [(j, min(s, most), inertia, hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for j, s in sums.items()]
    table = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    distance = "CAST(list_sum(list_transform(list_zip(t.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
    out = [
        f"""WITH t AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(greatest(-{MOST}, least({MOST}, floor({SCALE} * CAST(x AS DOUBLE)))) AS BIGINT)) AS v FROM embeddings
WHERE embedding IS NOT NULL AND len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS j, v FROM t ORDER BY j LIMIT {CENTROIDS})"""
    ]
    for r in range(ROUNDS + 1):
        out.append(f"a{r} AS (SELECT rid, arg_min(j, (d, j)) AS j, min(d) AS d FROM (SELECT rid, j, {distance} AS d FROM t CROSS JOIN c{r} c) GROUP BY rid)")
        if r < ROUNDS:
            out.append(f"s{r} AS (SELECT j, pos, sum(x) AS s, count(*) AS n FROM (SELECT j, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM t JOIN a{r} USING (rid)) GROUP BY j, pos)")
            out.append(f"m{r} AS (SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY pos) AS v FROM s{r} GROUP BY j)")
            out.append(f"c{r + 1} AS (SELECT c.j, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m USING (j))")
    last = f"""SELECT vec_id, CAST(a.j AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.j) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN t USING (rid) JOIN c{ROUNDS} c ON c.j = a.j"""
    return ",\n".join(out) + "\n" + last


ORACLE = _oracle()
