"""Best cosine scores of queries among vectors, block by block."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Queries and vectors of a block, and in how many a block's namespaces are dealt; scores held at once.
QUERIES, VECTORS, SPREAD, TILE = 4096, 16_384, 16, 4_194_304
SLACK = 2e-9  # scores are compared at nine digits
PAIRS = 65_536  # taken exactly at once


def _lists(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, components and lengths of the vectors of each size; empty ones and those that hold a null are in none."""
    lists = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    flat = lists.flatten().cast(pa.float64())
    starts = np.cumsum(sizes) - sizes
    holes = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))])
    whole = (sizes > 0) & (holes[starts + sizes] == holes[starts])
    values, found = flat.to_numpy(zero_copy_only=False), {}
    for size in np.unique(sizes[whole]):
        rows = np.flatnonzero(whole & (sizes == size))
        m = values[starts[rows][:, None] + np.arange(size)]
        found[int(size)] = rows, m, np.sqrt(_products(m, m))
    return found


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, components added in their order."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
    return total


def _clamped(dots: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Cosines in [0, 1]; 0 without a length, 1 where they are no number."""
    ratio = dots / norms
    ratio[np.isnan(ratio)] = 1.0
    return np.where((norms > 0) | np.isnan(norms), np.clip(ratio, 0.0, 1.0), 0.0) + 0.0


def _first(rows: np.ndarray, columns: np.ndarray, scores: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a row's equal scores the first limit columns."""
    order = np.lexsort((columns, -scores, rows))
    rows, columns, scores = rows[order], columns[order], scores[order]
    place = np.arange(len(rows))
    begins = np.ones(len(rows), bool)
    begins[1:] = (rows[1:] != rows[:-1]) | (scores[1:] != scores[:-1])
    kept = place - np.maximum.accumulate(np.where(begins, place, 0)) < limit
    return rows[kept], columns[kept], scores[kept]


def _block(queries: pa.ChunkedArray, vectors: pa.ChunkedArray, limit: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, vector, score) of all that may be among a query's best: matrix products choose, what they choose is summed in order. Vectors are sorted by id."""
    n, asked, held = len(vectors), _lists(queries), _lists(vectors)
    out, apart = [], np.ones(len(queries), bool)
    for size in asked.keys() & held.keys():
        (qi, q, qn), (vi, v, vn) = asked[size], held[size]
        apart[qi], at = False, np.full(n, -1)
        at[vi] = np.arange(len(vi))
        step = max(1, TILE // n)
        for lo in range(0, len(qi), step):
            part, length = q[lo : lo + step], qn[lo : lo + step]
            near = np.zeros((len(part), n))
            near[:, vi] = _clamped(part @ v.T, np.outer(length, vn))
            least = np.partition(near, n - limit, axis=1)[:, n - limit, None] if n > limit else np.zeros((len(part), 1))
            rows, columns = np.nonzero(near >= least - SLACK)
            scores, known = np.zeros(len(rows)), np.flatnonzero(at[columns] >= 0)
            for some in np.array_split(known, -(-len(known) // PAIRS) or 1):
                r, c = rows[some], at[columns[some]]
                scores[some] = _clamped(_products(part[r], v[c]), length[r] * vn[c])
            rows, columns, scores = _first(rows, columns, scores, limit)
            out.append((qi[lo + rows], columns, scores))
    rest, few = np.flatnonzero(apart), min(limit, n)  # of no size that vectors have: all scores are 0
    out.append((np.repeat(rest, few), np.tile(np.arange(few), len(rest)), np.zeros(len(rest) * few)))
    return out


def _members(table: pa.Table, same: int) -> dict[tuple, np.ndarray]:
    if not same:
        return {(): np.arange(table.num_rows)}
    found: dict[tuple, list[int]] = {}
    for i, key in enumerate(zip(*(table[f"__same{i}"].to_pylist() for i in range(same)), strict=True)):
        found.setdefault(key, []).append(i)
    return {k: np.array(x) for k, x in found.items()}


def nearest(queries: DataFrame, vectors: DataFrame, limit: int, same: list[str]) -> DataFrame:
    """(qid, id, score) of queries (qid, qv) and vectors (id, v), equal in the columns of same: at least every query's limit best, by score at nine digits, then id.

    Every block of queries meets every block of vectors as one group, so memory is bounded by blocks and the work is dealt by pairs of them.
    """
    many, parts = (max(1, -(-d.count() // n)) for d, n in ((queries, QUERIES), (vectors, VECTORS)))
    spread = SPREAD if same else 1
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    space = F.pmod(F.xxhash64(*same), F.lit(spread)).cast("int") if same else F.lit(0)
    keys = ["__space", "__q", "__v"]
    apart = min(many * parts * spread, 1000)

    known = lambda d, *columns: (d.dropna(subset=same) if same else d).select(*columns, *(F.col(c).alias(f"__same{i}") for i, c in enumerate(same)), space.alias("__space"))
    asked = known(queries, "qid", "qv").withColumns({"__q": dealt("qid", many), "__v": every(parts)}).repartition(apart, *keys)
    held = known(vectors, "id", "v").withColumns({"__q": every(many), "__v": dealt("id", parts)}).repartition(apart, *keys)
    schema = StructType([StructField("qid", queries.schema["qid"].dataType), StructField("id", vectors.schema["id"].dataType), StructField("score", DoubleType())])

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.take(pc.sort_indices(right, sort_keys=[("id", "ascending")], null_placement="at_start"))
        groups, found = _members(right, len(same)), [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
        with np.errstate(all="ignore"):
            for key, qs in _members(left, len(same)).items():
                vs = groups.get(key, np.zeros(0, int))
                if len(vs):
                    found += [(qs[r], vs[c], s) for r, c, s in _block(left["qv"].take(pa.array(qs)), right["v"].take(pa.array(vs)), limit)]
        rows, columns, scores = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table({"qid": left["qid"].take(pa.array(rows)), "id": right["id"].take(pa.array(columns)), "score": pa.array(scores)})

    return asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(best, schema)
