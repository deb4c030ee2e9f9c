"""Language-model scoring by context-tree weighting over binary-decomposed byte contexts.

Counts of (DEPTH + 1)-grams of bytes over all training texts make a context tree: a node for every suffix context, each with a binary tree of
eight decisions for the next byte. A decision's probability mixes Krichevsky-Trofimov estimates of all depths by the weights that
the training counts give them; what has no counts has probability 1/2. The tree has every context, whatever the corpus: it is a table, dealt by the last SPLIT bytes of
the contexts. Depths from SPLIT on are worked out where a part lies, those above by sums over all parts. Frozen after training, the model is a table of the
log-probabilities of all grams that occur in the input, those of held-out texts among them.

The base score is a smoothed unigram model of words. Counts of all words are gathered by shuffle. A bounded number of frequent words and of frequent grams is
resolved where the text is read, all others by a join on their keys: what that number is changes no result.

Defined cases: null text is empty: its end alone is scored; rows with a null id are held out; rows that repeat each get their row; without
training rows N and V are 0 and a token's base probability is 0.1 / 0.1, and a byte's is 1/256; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import drop, fold, keep, local, trim, worker_cache

DEPTH = 5
SPLIT = 3
FREQUENT = 100_000
CACHE = 1 << 21  # grams that are resolved where the text is read
FOLDS = 10
PAD = 0xFF  # never a byte of UTF-8: stands before a text and ends it
_FLUSH = 200_000
_STRANDS = 8192
_CHUNK = 2048  # contexts at a time, which bounds temporary arrays

_GROUP = 100_000  # grams worked out at a time, beyond those of one context of SPLIT bytes
_SLICE = 1 << 20  # bytes of texts at a time, beyond those of one text

_COUNTS = "kind int, key long, n long, seen long"


def stream(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts as one array of bytes, DEPTH pads before the first and after each; where each begins, and where its end symbol stands."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    begin = DEPTH + np.concatenate([[0], np.cumsum(sizes + DEPTH)[:-1]]) if len(raw) else np.empty(0, np.int64)
    pad = bytes([PAD]) * DEPTH
    return np.frombuffer(pad + b"".join(x for r in raw for x in (r, pad)), np.uint8), begin, begin + sizes


def codes(texts: list[str | None]) -> np.ndarray:
    """(DEPTH + 1)-grams that end in a byte of a text or its end symbol, text by text, as integers with the last byte lowest."""
    data, begin, end = stream(texts)
    wide = data.astype(np.uint64)
    n = len(wide) - DEPTH
    code = np.zeros(n, np.uint64)
    for k in range(DEPTH + 1):
        code = code << np.uint64(8) | wide[k : n + k]
    scored = np.ones(n, bool)
    if DEPTH > 1:  # pads after the end symbol
        for k in range(1, DEPTH):
            scored[np.minimum(end + k - DEPTH, n - 1)[end + k - DEPTH < n]] = False
    return code[scored]


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes of texts, with counts."""
    return np.unique(codes(texts), return_counts=True)


def _slices(column: pa.Array, most: int) -> Iterator[tuple[int, list[str | None]]]:
    """Consecutive values of a column with the place of the first: at most so many, of about _SLICE characters."""
    a, some, size = 0, [], 0
    for i, t in enumerate(column):
        some.append(t.as_py())
        size += len(some[-1] or "")
        if len(some) == most or size >= _SLICE:
            yield a, some
            a, some, size = i + 1, [], 0
    if some:
        yield a, some


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of the words (kind 0, by hash), grams (kind 1) and number (kind 2) of training texts (text, train). Grams of other texts are there as well, with n 0; seen counts both."""
    import xxhash

    words: Counter = Counter()
    keys, numbers, sums, held = [], [], [], 0

    def out(kind: int, keys: np.ndarray, n: np.ndarray, seen: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(seen.astype(np.int64))], names=["kind", "key", "n", "seen"])

    def spilled_words() -> pa.RecordBatch:
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        n = np.fromiter(words.values(), np.int64, len(words))
        words.clear()
        return out(0, hashes, n, n)

    def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        u, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        return u, np.bincount(inverse, weights=np.concatenate(numbers)).astype(np.int64), np.bincount(inverse, weights=np.concatenate(sums)).astype(np.int64)

    texts = 0
    for batch in batches:
        flags = batch.column("train").to_pylist()
        for a, some in _slices(batch.column("text"), 200):
            train = [t for t, f in zip(some, flags[a:], strict=False) if f]
            texts += len(train)
            for t in train:
                if t:
                    words.update(t.encode("utf-8", "surrogatepass").lower().split())
            if len(words) > _FLUSH:
                yield spilled_words()
            for part, learnt in ((train, 1), ([t for t, f in zip(some, flags[a:], strict=False) if not f], 0)):
                if part:
                    u, c = grams(part)
                    keys.append(u)
                    numbers.append(c * learnt)
                    sums.append(c)
                    held += len(u)
            if held > 6 * _FLUSH:
                k, n, m = merged()
                keys, numbers, sums, held = [k], [n], [m], len(k)
                if held > 4 * _FLUSH:
                    yield out(1, k, n, m)
                    keys, numbers, sums, held = [], [], [], 0
    if words:
        yield spilled_words()
    if keys:
        yield out(1, *merged())
    if texts:
        yield out(2, np.zeros(1, np.uint64), np.array([texts]), np.array([texts]))
    del words, keys, numbers, sums
    trim()


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log gamma for x >= 0.5, by a shifted Stirling series."""
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        shift += np.log(y)
        y += 1
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) - shift


def _kt(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Log Krichevsky-Trofimov probabilities of decisions with these counts."""
    out = np.empty(zero.shape)
    for a in range(0, len(zero), _CHUNK):
        z, o = zero[a : a + _CHUNK].astype(float), one[a : a + _CHUNK].astype(float)
        out[a : a + _CHUNK] = _lgamma(z + 0.5) + _lgamma(o + 0.5) - _lgamma(z + o + 1) - math.log(math.pi)
    return out


def _one(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    """KT estimates of a one."""
    one = one.astype(float)
    return (one + 0.5) / (zero + one + 1)


class Tree:
    """A whole context tree in one memory, for small corpora and to hold the tables against: step[state, column] is the next state, logp[state, column] a natural logarithm; state start is all pads.

    column maps a byte to its column; all bytes that no training text has share the last one, and evenly the probability left for them.
    """

    def __init__(self, edges: pd.DataFrame, depth: int = DEPTH) -> None:
        """edges: depth, context (its latest byte lowest), symbol, n; contexts closed under suffixes, the empty one among them."""
        seen = np.unique(np.append(edges.symbol.to_numpy(np.int64), PAD))
        other = np.setdiff1d(np.arange(256), seen)
        self.column = np.full(256, len(seen), np.int64)
        self.column[seen] = np.arange(len(seen))
        # the decisions on the way to a seen byte; any other has no counts and probability 1/2
        nodes = np.unique([(256 | s) >> k for s in seen for k in range(1, 9)])
        place = np.full(256, len(nodes), np.int64)
        place[nodes] = np.arange(len(nodes))

        self.codes, zeros, ones = [], [], []
        for d in range(depth + 1):
            own = edges[edges.depth == d]
            codes = np.unique(own.context.to_numpy(np.int64))
            if d == 0 and not len(codes):
                codes = np.zeros(1, np.int64)
            self.codes.append(codes)
            row, symbol, n = np.searchsorted(codes, own.context.to_numpy(np.int64)), own.symbol.to_numpy(np.int64), own.n.to_numpy(np.float32)
            both = np.zeros((2, len(codes), len(nodes)), np.float32)
            for k in range(1, 9):
                np.add.at(both, ((256 | symbol) >> (k - 1) & 1, row, place[(256 | symbol) >> k]), n)
            zeros.append(both[0])
            ones.append(both[1])
        self.base = np.concatenate([[0], np.cumsum([len(c) for c in self.codes])])
        parent = [np.searchsorted(self.codes[d - 1], self.codes[d] & ((1 << 8 * (d - 1)) - 1)) if d else np.empty(0, np.int64) for d in range(depth + 1)]

        # bottom up: log P_w of each decision, and how far a context's own estimate outweighs its children's
        weight: list[np.ndarray] = [np.empty(0)] * (depth + 1)
        tops: list[np.ndarray] = [np.empty(0)] * (depth + 1)
        below = np.empty((0, len(nodes)))
        for d in range(depth, -1, -1):
            own, has = _kt(zeros[d], ones[d]), np.zeros(len(self.codes[d]), bool)
            if d == depth or not len(self.codes[d + 1]):
                weight[d], tops[d], below = np.full(own.shape, np.inf, np.float32), _one(zeros[d], ones[d]).astype(np.float32), own
                continue
            inner, rest_zero, rest_one = np.zeros_like(own), zeros[d].copy(), ones[d].copy()
            np.add.at(inner, parent[d + 1], below)
            np.subtract.at(rest_zero, parent[d + 1], zeros[d + 1])
            np.subtract.at(rest_one, parent[d + 1], ones[d + 1])
            has[parent[d + 1]] = True
            rest_zero, rest_one = np.maximum(rest_zero, 0), np.maximum(rest_one, 0)
            inner[has] += _kt(rest_zero[has], rest_one[has])
            weight[d] = np.where(has[:, None], own - inner, np.inf).astype(np.float32)
            tops[d] = np.where(has[:, None], _one(rest_zero, rest_one), _one(zeros[d], ones[d])).astype(np.float32)
            below = np.where(has[:, None], np.logaddexp(own, inner) - math.log(2), own)
            del own, inner, rest_zero, rest_one

        # a context's decision: its merged child's estimate (or its own, at a leaf), mixed with those of all its suffixes
        width = len(seen) + (len(other) > 0)
        self.logp = np.zeros((int(self.base[-1]), width), np.float32)
        for d, a in ((d, a) for d in range(depth + 1) for a in range(0, len(self.codes[d]), _CHUNK)):
            at = np.arange(a, min(a + _CHUNK, len(self.codes[d])))
            rows = self.base[d] + at
            p = tops[d][at].astype(float)
            for up in range(d, -1, -1):
                own = 1 / (1 + np.exp(-np.clip(weight[up][at].astype(float), -700, 700)))
                p = own * _one(zeros[up][at], ones[up][at]) + (1 - own) * p
                if up:
                    at = parent[up][at]
            one, zero = (np.append(np.log(q), np.full((len(p), 1), math.log(0.5)), axis=1) for q in (p, 1 - p))
            logp = np.zeros((len(p), 256))
            for s in range(256):
                for k in range(1, 9):
                    logp[:, s] += (one if (256 | s) >> (k - 1) & 1 else zero)[:, place[(256 | s) >> k]]
            self.logp[rows, : len(seen)] = logp[:, seen]
            if len(other):
                self.logp[rows, -1] = np.logaddexp.reduce(logp[:, other], axis=1) - math.log(len(other))
        del zeros, ones, weight, tops, below

        self.step = np.zeros((int(self.base[-1]), width), np.int32)
        for d, a in ((d, a) for d in range(depth + 1) for a in range(0, len(self.codes[d]), _CHUNK)):
            nxt = self.codes[d][a : a + _CHUNK, None] << 8 | seen
            rows = slice(self.base[d] + a, self.base[d] + a + len(nxt))
            for k in range(1, min(d + 1, depth) + 1):  # the longest suffix that is a context stays
                if len(self.codes[k]):
                    want = nxt & ((1 << 8 * k) - 1)
                    found = np.minimum(np.searchsorted(self.codes[k], want), len(self.codes[k]) - 1)
                    self.step[rows, : len(seen)] = np.where(self.codes[k][found] == want, self.base[k] + found, self.step[rows, : len(seen)])
        self.start = 0
        for _ in range(depth):
            self.start = int(self.step[self.start, self.column[PAD]])


def score_texts(step: np.ndarray, logp: np.ndarray, column: np.ndarray, start: int, texts: list[str | None]) -> np.ndarray:
    """Natural log-probability of every text under a tree's automaton, its end included."""
    data, begin, end = stream(texts)
    if not len(begin):
        return np.empty(0)
    n = len(data)
    strand = max(64, -(-n // _STRANDS))
    many = -(-n // strand)
    # each strand starts DEPTH bytes early: a state depends on DEPTH bytes at most
    padded = np.concatenate([np.full(DEPTH, PAD, np.uint8), data, np.full(many * strand - n, PAD, np.uint8)])
    lanes = np.lib.stride_tricks.as_strided(padded, (DEPTH + strand, many), (1, strand))
    flat_step, flat_logp, width = step.ravel(), logp.ravel(), step.shape[1]
    got = np.empty((strand, many), np.float32)
    state = np.full(many, start, np.int64)
    for t in range(DEPTH + strand):
        at = state * width + column[lanes[t]]
        if t >= DEPTH:
            got[t - DEPTH] = flat_logp[at]
        state = flat_step[at].astype(np.int64)
    # a cumulative sum over megabytes keeps some nine digits after the point
    total = np.concatenate([[0.0], np.cumsum(got.T.ravel()[:n].astype(float))])
    return total[end + 1] - total[begin]


def _most(rows: DataFrame, by: str, cost: Column, limit: float, keys: list[str]) -> DataFrame:
    """The rows with the largest by (1 at least), as far as their costs fit in limit. Buckets are 1/64 of an octave wide, without a last one; the bucket that doesn't fit is cut by a hash of the keys."""
    rows = rows.withColumn("__bucket", F.floor(F.log2(F.col(by)) * 64)).withColumn("__part", F.pmod(F.xxhash64(*keys), F.lit(1024)))
    tally = local(rows.groupBy("__bucket").agg(F.sum(cost).cast("double").alias("c"))).sort_values("__bucket", ascending=False)
    fits = tally.c.cumsum() <= limit
    if fits.all():
        return rows.drop("__bucket", "__part")
    edge = int(tally["__bucket"][~fits].iloc[0])
    parts = local(rows.where(F.col("__bucket") == edge).groupBy("__part").agg(F.sum(cost).cast("double").alias("c"))).sort_values("__part")
    inside = parts["__part"][parts.c.cumsum() <= limit - tally.c[fits].sum()]
    last = int(inside.max()) if len(inside) else -1
    return rows.where((F.col("__bucket") > edge) | (F.col("__bucket") == edge) & (F.col("__part") <= last)).drop("__bucket", "__part")


def _log_kt(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    """_kt, by a table where counts are small."""
    cache = worker_cache()
    if not hasattr(cache, "lm_gamma"):
        n = np.arange(4096.0)
        cache.lm_gamma = _lgamma(n + 0.5), _lgamma(n + 1)
    half, whole = cache.lm_gamma
    small = zero + one < len(half)
    z, o = np.where(small, zero, 0).astype(np.int64), np.where(small, one, 0).astype(np.int64)
    out = half[z] + half[o] - whole[z + o] - math.log(math.pi)
    if not small.all():
        out[~small] = _kt(zero[~small], one[~small])
    return out


def _own(own: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """How far contexts' own estimates count against their children's."""
    return 1 / (1 + np.exp(-np.clip(own - inner, -700, 700)))


class Part:
    """The depths DEPTH to SPLIT over all grams of some contexts of SPLIT bytes. Decisions are context << 8 | node; those of depth d are keys[d], sorted, and up[d] has the place of each one's parent."""

    def __init__(self, code: np.ndarray, n: np.ndarray) -> None:
        symbol = 256 | code & 255
        self.bits = np.concatenate([symbol >> (k - 1) & 1 for k in range(1, 9)]).astype(bool)
        self.keys, self.zero, self.one, self.inner, self.below, self.up = ({} for _ in range(6))
        d = DEPTH
        self.keys[d], self.at = np.unique(np.concatenate([(code >> 8) << 8 | symbol >> k for k in range(1, 9)]), return_inverse=True)
        weights = np.tile(n.astype(float), 8)
        self.zero[d], self.one[d] = (np.bincount(self.at, weights=np.where(x, weights, 0), minlength=len(self.keys[d])) for x in (~self.bits, self.bits))
        self.below[d] = _log_kt(self.zero[d], self.one[d])
        for d in range(DEPTH - 1, SPLIT - 1, -1):
            child = self.keys[d + 1]
            self.keys[d], self.up[d + 1] = np.unique((child >> 8 & (1 << 8 * d) - 1) << 8 | child & 255, return_inverse=True)
            self.zero[d], self.one[d], self.inner[d] = (np.bincount(self.up[d + 1], weights=x[d + 1], minlength=len(self.keys[d])) for x in (self.zero, self.one, self.below))
            self.below[d] = np.logaddexp(own := _log_kt(self.zero[d], self.one[d]), self.inner[d]) - math.log(2)
            self.inner[d] = _own(own, self.inner[d])

    def logp(self, known: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Natural log-probabilities of the grams, from what the depths above SPLIT make of each decision at SPLIT: a sum, and the share left to the deeper ones."""
        for d in range(SPLIT, DEPTH):
            known, left = known + left * self.inner[d] * _one(self.zero[d], self.one[d]), left * (1 - self.inner[d])
            known, left = known[self.up[d + 1]], left[self.up[d + 1]]
        p = known + left * _one(self.zero[DEPTH], self.one[DEPTH])
        return np.log(np.where(self.bits, p[self.at], 1 - p[self.at])).reshape(8, -1).sum(0)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    """Rows sorted by column part, all of a part in one group."""
    held, size = [], 0
    for batch in batches:
        rows = batch.to_pandas()
        held.append(rows)
        size += len(rows)
        if size >= _GROUP:
            whole = pd.concat(held, ignore_index=True)
            cut = int(np.searchsorted(whole.part.to_numpy(), whole.part.iloc[-1]))
            held = [whole.iloc[cut:]]
            size = 0 if cut == 0 else len(whole) - cut  # a part beyond _GROUP isn't joined again with every batch
            if cut:
                yield whole.iloc[:cut]
    if held and sum(map(len, held)):
        yield pd.concat(held, ignore_index=True)


def _deepest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and weighted log-probabilities of all decisions at depth SPLIT, from grams (part, key, n)."""
    for rows in _groups(batches):
        part = Part(rows.key.to_numpy(), rows.n.to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(x[SPLIT]) for x in (part.keys, part.zero, part.one, part.below)], names=["node", "zero", "one", "below"])
    trim()


def _probabilities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, seen, logp of all grams, from grams (kind 1) and from what is known of the decisions at depth SPLIT (kind 0)."""
    for rows in _groups(batches):
        above, own = rows[rows.kind == 0].sort_values("key"), rows[rows.kind == 1]
        part = Part(own.key.to_numpy(), own.n.to_numpy())
        assert np.array_equal(above.key.to_numpy(), part.keys[SPLIT])
        yield pa.RecordBatch.from_arrays([pa.array(own.key.to_numpy()), pa.array(own.seen.to_numpy()), pa.array(part.logp(above.known.to_numpy(), above.left.to_numpy()))], names=["key", "seen", "logp"])
    trim()


def _lift(rows: DataFrame, depth: int) -> DataFrame:
    """Sums of children (node, zero, one, below) at their parents of this depth: node, zero, one, inner, below."""
    up = F.shiftleft(F.shiftright("node", 8).bitwiseAND(F.lit((1 << 8 * depth) - 1).cast("long")), 8).bitwiseOR(F.col("node").bitwiseAND(F.lit(255).cast("long")))
    sums = rows.groupBy(up.alias("node")).agg(F.sum("zero").alias("zero"), F.sum("one").alias("one"), F.sum("below").alias("inner"))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            zero, one, inner = (batch.column(c).to_numpy() for c in ("zero", "one", "inner"))
            below = np.logaddexp(_log_kt(zero, one), inner) - math.log(2)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(below)], names=["node", "zero", "one", "inner", "below"])

    return keep(sums.mapInArrow(weigh, "node long, zero double, one double, inner double, below double"), "lifted")


def _descend(known: np.ndarray, left: np.ndarray, zero: np.ndarray, one: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own = _own(_log_kt(zero, one), inner)
    return known + left * own * _one(zero, one), left * (1 - own)


def learn(counts: DataFrame) -> DataFrame:
    """key, seen, logp (natural) of all grams among counts (kind, key, n, seen) under the tree that n makes."""
    part = F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * SPLIT) - 1).cast("long"))
    rows = counts.where("kind = 1").select(part.alias("part"), "key", "n", "seen")
    deepest = keep(rows.select("part", "key", "n").repartition("part").sortWithinPartitions("part").mapInArrow(_deepest, "node long, zero double, one double, below double"), "decisions")
    levels = {}
    for d in range(SPLIT - 1, 0, -1):
        levels[d] = _lift(levels.get(d + 1, deepest), d)
    # depths 0 and 1 have 256 and 65,536 decisions at most
    top = local(levels[1].select("node", "zero", "one", "inner", "below"))
    zero, one, inner, below = (np.zeros(1 << 16) for _ in range(4))
    for name, x in (("zero", zero), ("one", one), ("inner", inner), ("below", below)):
        x[top.node.to_numpy(np.int64)] = top[name]
    root = _descend(np.zeros(256), np.ones(256), *(x.reshape(256, 256).sum(0) for x in (zero, one, below)))
    known, left = _descend(np.tile(root[0], 256), np.tile(root[1], 256), zero, one, inner)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column("node").to_numpy()
            a, b = _descend(known[node & 0xFFFF], left[node & 0xFFFF], *(batch.column(c).to_numpy() for c in ("zero", "one", "inner")))
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(a), pa.array(b)], names=["up", "known", "left"])

    above = levels[2].mapInArrow(second, "up long, known double, left double")
    reached = deepest.select("node", F.col("node").bitwiseAND(F.lit(0xFFFFFF).cast("long")).alias("up")).hint("merge").join(above, "up")
    both = rows.selectExpr("1 AS kind", "part", "key", "n", "seen", "0D AS known", "0D AS left").unionByName(
        reached.selectExpr("0 AS kind", "shiftright(node, 8) AS part", "node AS key", "0L AS n", "0L AS seen", "known", "left")
    )
    model = keep(both.repartition("part").sortWithinPartitions("part").mapInArrow(_probabilities, "key long, seen long, logp double"), "model")
    for d in (deepest, *levels.values()):
        drop(d)
    return model


def _frequent(counts: DataFrame, limit: int) -> pd.DataFrame:
    """key, n of the most frequent words, at most limit."""
    return local(_most(counts.where("kind = 0"), "n", F.lit(1), limit, ["key"]).select("key", "n"))


def _hash(code: np.ndarray, bits: int) -> np.ndarray:
    return ((code.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def _slots(keys: np.ndarray) -> np.ndarray:
    """Places of keys by their hashes; of keys with one hash the last stays."""
    bits = max(4, int(2 * len(keys)).bit_length())
    slots = np.zeros(1 << bits, np.int32)
    slots[_hash(keys, bits)] = np.arange(len(keys), dtype=np.int32)
    return slots


def _find(keys: np.ndarray, slots: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Places of codes among sorted keys, or -1: by their slots, else by bisection."""
    if not len(keys):
        return np.full(len(code), -1, np.int64)
    place = slots[_hash(code, len(slots).bit_length() - 1)].astype(np.int64)
    miss = np.flatnonzero(keys[place] != code)
    at = np.minimum(np.searchsorted(keys, code[miss]), len(keys) - 1)
    place[miss] = np.where(keys[at] == code[miss], at, -1)
    return place


def score_corpus(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = plain.select("text", (fold(F.col("doc_id"), FOLDS) != 0).alias("train"))
    counts = keep(marked.mapInArrow(_gather, _COUNTS).groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen")), "counts")
    totals = {r.kind: (r.n, r.v) for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    ends = totals.get(2, (0, 0))[0]
    train_tokens = totals.get(0, (0, 0))[0] + ends
    distinct = totals.get(0, (0, 0))[1] + (ends > 0)
    denominator = train_tokens + 0.1 * (distinct + 1)
    often = _frequent(counts, FREQUENT).sort_values("key")
    grams_table = learn(counts)
    cached = local(_most(grams_table, "seen", F.lit(1), CACHE, ["key"]).select("key", "logp")).sort_values("key")
    model = spark.sparkContext.broadcast((cached.key.to_numpy(np.int64), cached.logp.to_numpy(np.float64), often.key.to_numpy(np.int64), np.log10(often.n.to_numpy(float) + 0.1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        cache_keys, cache_logp, keys, logs = model.value
        slots = _slots(cache_keys)
        row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
        for batch in batches:
            for a, texts in _slices(batch.column("text"), 400):
                part = batch.slice(a, len(texts))
                split = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
                sizes = np.array([len(w) for w in split], np.int64)
                hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for ws in split for w in ws), np.uint64, int(sizes.sum())).view(np.int64)
                at = np.minimum(np.searchsorted(keys, hashes), max(len(keys) - 1, 0))
                hit = keys[at] == hashes if len(keys) else np.zeros(len(hashes), bool)
                owner = np.repeat(np.arange(len(texts)), sizes)
                known = np.bincount(owner[hit], minlength=len(texts))
                sums = np.bincount(owner[hit], weights=logs[at[hit]], minlength=len(texts)) if len(keys) else np.zeros(len(texts))
                offsets = np.concatenate([[0], np.cumsum(sizes - known)]).astype(np.int32)
                code = codes(texts).view(np.int64)
                size = np.array([len((t or "").encode("utf-8", "surrogatepass")) for t in texts]) + 1
                place = _find(cache_keys, slots, code)
                held = place >= 0
                at_text = np.repeat(np.arange(len(texts)), size)
                score = np.bincount(at_text[held], weights=cache_logp[place[held]], minlength=len(texts)) if len(cache_keys) else np.zeros(len(texts))
                more = np.concatenate([[0], np.cumsum(np.bincount(at_text[~held], minlength=len(texts)))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row + np.arange(len(texts))), part.column("doc_id"), pa.array(sizes + 1), pa.array(known.astype(np.int64)), pa.array(sums.astype(float)), pa.array(score.astype(float)), pa.array(size), pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes[~hit])), pa.ListArray.from_arrays(pa.array(more), pa.array(code[~held]))],
                    names=["row", "doc_id", "n_tokens", "known", "logs", "score", "size", "rare", "rare_grams"],
                )
                row += len(texts)
        trim()

    scored = keep(plain.mapInArrow(run, "row long, doc_id long, n_tokens long, known long, logs double, score double, size long, rare array<long>, rare_grams array<long>"), "scored")
    model.destroy()
    del cached, often, model
    trim()
    words = counts.where("kind = 0").select("key", F.log10(F.col("n") + 0.1).alias("log"))
    rare = scored.select("row", F.explode("rare").alias("key")).join(words, "key").groupBy("row").agg(F.count(F.lit(1)).alias("more"), F.sum("log").alias("more_logs"))
    grams_left = scored.select("row", F.explode("rare_grams").alias("key")).hint("merge").join(grams_table.select("key", "logp"), "key").groupBy("row").agg(F.sum("logp").alias("more_score"))
    score = (F.col("score") + F.coalesce("more_score", F.lit(0.0))) / F.lit(math.log(10))
    known = F.col("known") + F.coalesce("more", F.lit(0))
    log_end = math.log10(ends + 0.1)
    base = F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) + (F.col("n_tokens") - 1 - known) * F.lit(math.log10(0.1)) + F.lit(log_end) - F.col("n_tokens") * F.lit(math.log10(denominator))
    return scored.drop("rare", "rare_grams").join(rare, "row", "left").join(grams_left, "row", "left").select(
        "doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "n_tokens", (known + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"), (-score * F.lit(math.log2(10)) / F.col("size")).alias("bits_per_byte"),
    )
