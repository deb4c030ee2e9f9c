"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target; a document's expected copies are its source's target over its source's size. The whole part is taken outright, and
the fractional parts are rounded dependently: two documents meet, mass (expected words) moves at random from one to the other until one of
them is integral, and the other one goes on. Every move keeps both expectations and, exactly, the sum of words. Documents meet within bounded blocks of one source and alike size, each of
which leaves one fractional residual at most; residuals are combined in a distributed reduction tree over blocks, whose root settles a source's classes. The order of meetings and
all draws derive from hashes and counts of the input, so reruns agree.

Defined cases: null text has size 0; null source is a source of its own, last in order; documents of size 0 are never copied; rows that
repeat are documents each; an empty table gives an empty mix; other columns are ignored (or pass through copies()).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import SPACE, keep

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK = 256
FAN = 64
#: Tables of at most so many rows may be broadcast; larger ones are joined by a shuffle.
SMALL = 20_000


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(f"[^{SPACE}]+")).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> dict[str | None, float]:
    """Target words of every source: shares of the total by weight, none above most times its size, excess reshared by weight."""
    order = sorted((s for s, _ in sizes if s is not None)) + [s for s, _ in sizes if s is None]
    size = dict(sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, out, free = float(sum(size.values())), {}, list(order)
    while free:
        total = sum(weight[s] for s in free)
        full = [s for s in free if left * weight[s] / total > most * size[s]]
        if not full:
            out.update({s: left * weight[s] / total for s in free})
            break
        for s in full:
            out[s] = float(most * size[s])
        left -= sum(out[s] for s in full)
        gone = set(full)
        free = [s for s in free if s not in gone]
    return out


def _pivot(group: pd.DataFrame, seed: int) -> pd.DataFrame:
    """One pass of pivotal rounding; copies stays null on the residual, if there is one."""
    group = group.sort_values(["size", "doc_id", "p"], kind="stable", na_position="first").reset_index(drop=True)
    draws = np.random.default_rng(seed).random(len(group))
    p, size, done = group.p.to_numpy(float).copy(), group["size"].to_numpy(float), np.zeros(len(group), bool)
    held = -1
    for i in range(len(p)):
        if held < 0:
            held = i
            continue
        was = held
        # words that can move from i to held, and from held to i, before one of the two is integral
        up = min((1 - p[held]) * size[held], p[i] * size[i])
        down = min(p[held] * size[held], (1 - p[i]) * size[i])
        moved = up if draws[i] * (up + down) < down else -down
        p[held] += moved / size[held]
        p[i] -= moved / size[i]
        fractional = [j for j in (held, i) if 1e-9 < p[j] < 1 - 1e-9]
        held = fractional[0] if fractional else -1
        done[i] = done[was] = True
        if held >= 0:
            done[held] = False
    group["p"] = p
    group["copies"] = pd.array(np.where(done, group.whole + np.round(p), 0).astype("int64"), dtype="Int64")
    group.loc[~done, "copies"] = pd.NA
    return group


def _settle(group: pd.DataFrame) -> pd.DataFrame:
    """The root of the tree: the residuals of one source, the largest document first, each against all smaller ones together.

    A large document becomes integral by trading its words with the smaller ones, whose fractions give or take in proportion; so
    what a source misses its target by is about its smallest residual's size.
    """
    group = group.sort_values(["size", "doc_id", "p"], ascending=False, kind="stable").reset_index(drop=True)
    p, size = group.p.to_numpy(float).copy(), group["size"].to_numpy(float)
    draws = np.random.default_rng(xxhash.xxh3_64_intdigest(repr((group.source[0], bool(group.has_source[0]))))).random(len(p))
    for i in range(len(p)):
        q, s = p[i + 1 :], size[i + 1 :]
        mass, space = float(q @ s), float((1 - q) @ s)
        want, give = (1 - p[i]) * size[i], p[i] * size[i]
        up = mass >= want if (mass >= want) != (space >= give) else draws[i] < p[i] if mass >= want else p[i] >= 0.5
        if up and mass > 0:
            p[i + 1 :] = q * (1 - min(1.0, want / mass))
        elif not up and space > 0:
            p[i + 1 :] = 1 - (1 - q) * (1 - min(1.0, give / space))
        p[i] = float(up)
    group["p"] = p
    group["copies"] = (group.whole + p).round().astype("int64")
    return group


def _meet(level: int):
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return _pivot(group, xxhash.xxh3_64_intdigest(repr((level, *key))))

    return run


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row of docs (doc_id, source, text)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"))
    rows = keep(rows.withColumn("class", F.when(F.col("size") > 0, F.floor(4 * F.log2("size"))).cast("int")), "sizes")
    # one row a source reaches the driver
    sizes = [(r.source, r.total) for r in rows.groupBy("source").agg(F.sum("size").alias("total")).collect()]
    goal = targets(sizes)
    table = spark.createDataFrame(
        [(s, s is not None, t, goal[s], min(float(MOST), goal[s] / t) if t else 0.0) for s, t in sizes],
        "source string, has_source boolean, source_size long, target double, rate double",
    )
    small = (lambda d, n: F.broadcast(d) if n <= SMALL else d)
    rated = rows.withColumn("has_source", F.col("source").isNotNull()).withColumn("source", F.coalesce("source", F.lit("")))
    table = table.withColumn("source", F.coalesce("source", F.lit("")))
    rated = rated.join(small(table, len(sizes)), ["source", "has_source"])
    near = F.when(F.abs(F.col("rate") - F.round("rate")) < 1e-9, F.round("rate")).otherwise(F.floor("rate"))
    rated = rated.withColumn("whole", near.cast("long")).withColumn("p", F.greatest(F.lit(0.0), F.col("rate") - F.col("whole")))
    rated = rated.withColumn("p", F.when(F.col("p") < 1e-9, 0.0).otherwise(F.col("p")))

    split = rated.where("size > 0 AND p > 0")
    counts = split.groupBy("source", "has_source", "class").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    counts = keep(counts, "blocks")
    top = counts.agg(F.max("blocks"), F.count(F.lit(1))).first()
    key = ["source", "has_source", "class", "block"]
    split = split.join(small(counts, top[1]), ["source", "has_source", "class"]).withColumn("block", F.pmod(F.xxhash64("doc_id", "size"), F.col("blocks")))
    columns = ["doc_id", "size", "p", "whole", *key, "rate", "source_size", "target"]
    schema = "doc_id long, size long, p double, whole long, source string, has_source boolean, class int, block long, rate double, source_size long, target double, copies long"
    level, done, blocks = 0, [], top[0] or 1
    step = keep(split.select(columns).groupBy(key).applyInPandas(_meet(0), schema), "rounded")
    while blocks > 1:
        done.append(step.where("copies IS NOT NULL"))
        level, blocks = level + 1, -(-blocks // FAN)
        rest = step.where("copies IS NULL").drop("copies").withColumn("block", F.floor(F.col("block") / FAN))
        step = keep(rest.select(columns).groupBy(key).applyInPandas(_meet(level), schema), "rounded")
    done.append(step.where("copies IS NOT NULL"))
    # one residual a source and class is left
    done.append(step.where("copies IS NULL").drop("copies").groupBy("source", "has_source").applyInPandas(_settle, schema))
    done.append(rated.where("NOT (size > 0 AND p > 0)").withColumn("copies", F.when(F.col("size") > 0, F.col("whole")).otherwise(F.lit(0).cast("long"))))
    out = ["doc_id", "source", "has_source", "size", "source_size", "target", "copies"]
    mixed = done[0].select(out)
    for d in done[1:]:
        mixed = mixed.unionByName(d.select(out))
    return mixed.select("doc_id", F.when(F.col("has_source"), F.col("source")).alias("source"), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def copies(docs: DataFrame) -> DataFrame:
    """docs with every row as often as the mix takes it; columns may have any names."""
    unit = F.xxhash64("id", "source", "size")
    chosen = mix(docs).groupBy(F.col("doc_id").alias("id"), "source", "size").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows"))
    chosen = keep(chosen.withColumn("unit", unit), "chosen").alias("c")
    own = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    own = own.withColumn("unit", unit).alias("o")
    # one shuffle of texts, by the unit's hash, serves both the join and the window, and is planned alike at every size
    same = F.col("o.id").eqNullSafe(F.col("c.id")) & F.col("o.source").eqNullSafe(F.col("c.source")) & (F.col("o.size") == F.col("c.size"))
    joined = own.hint("merge").join(chosen, F.col("o.unit") == F.col("c.unit")).where(same)
    # rows alike in id, source and size share their copies, the first rows by text taking what is left over
    turn = F.row_number().over(Window.partitionBy("o.unit", "o.id", "o.source", "o.size").orderBy(F.col("row")["text"]))
    each = (F.floor(F.col("copies") / F.col("rows")) + (F.col("turn") <= F.col("copies") % F.col("rows")).cast("long")).cast("int")
    often = joined.select("row", "copies", "rows", turn.alias("turn")).select("row", each.alias("each")).where("each > 0")
    return often.select("row", F.explode(F.sequence(F.lit(1), F.col("each")))).select(*(F.col("row")[c].alias(c) for c in docs.columns))
