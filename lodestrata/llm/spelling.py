"""Spelling variants by letter-parity bitmask bands.

Every word has a mask that holds, for each letter, whether it occurs an odd number of times. One inserted or deleted letter flips one bit, one
replaced letter at most two, so of three bands of the mask one is equal in words one edit apart. Words meet by equal bands, within equal
length or one more, and are verified. A band alone is a coarse key, so it is joined together with an exact companion: words one edit apart
agree on the first or on the last half (of the shorter word's letters), as the edit lies in one of the two. A pair is taken at
the first band and half at which it agrees, so none comes twice. Verified links alone leave the join.

A word's form is its near word of largest n, if that n is at least RATIO times the word's own; roots follow forms to the last by doubling: n grows
RATIO-fold a step, so chains have fewer than 28 words and five doublings reach their ends.

Defined cases: null and empty texts have no words; a null doc_id counts as empty text in the hash; repeated rows count each; ties
between forms go to the smaller word in code-point order; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import drop, keep

LETTERS = r"[A-Za-zÀ-ÿ]"
LEAST, OFTEN, RATIO, EVERY = 6, 5, 5, 199
BANDS = 3
DOUBLINGS = 5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def count_words(docs: DataFrame, least: int = LEAST, often: int = OFTEN) -> DataFrame:
    """(word, n): the words of docs (doc_id, text) with at least so many letters and occurrences. Shorter runs can't become words, so they aren't read out."""
    runs = F.regexp_extract_all(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(f"{LETTERS}{{{least},}}"), F.lit(0))
    found = docs.select(F.concat(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.lit(":")).alias("head"), F.explode(runs).alias("run"))
    found = found.select("head", F.translate("run", _UPPER, _LOWER).alias("run"))
    h = found.withColumn("h", F.crc32(F.concat("head", "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    words = h.select(F.when(F.col("h") % EVERY == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= often)


def band(word: str, which: int) -> Column:
    """The parities of the letters whose code is which modulo BANDS, as bits."""
    step = f"(m, c) -> IF(ascii(c) % {BANDS} = {which}, m ^ shiftleft(1L, CAST(ascii(c) div {BANDS} % 63 AS INT)), m)"
    return F.expr(f"aggregate(split({word}, ''), 0L, {step})")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b, na, nb): each pair of words (word, n) that one inserted, deleted or replaced letter turns into each other, once."""
    masked = keep(words.select("word", "n", F.length("word").alias("size"), F.array(*(band("word", i) for i in range(BANDS))).alias("bands")), "masked")
    half = F.floor(F.col("short") / 2).cast("int")
    keys = F.explode(F.array(*(F.struct(F.lit(i).alias("band"), F.get("bands", F.lit(i)).alias("bits"), F.lit(side).alias("side")) for i in range(BANDS) for side in (0, 1))))

    def keyed(rows: DataFrame) -> DataFrame:
        """A row for each band and half of a word, given the shorter length of the pairs that it is to meet."""
        each = rows.withColumn("k", keys)
        part = F.when(F.col("k.side") == 0, F.substr("word", F.lit(1), half)).otherwise(F.right("word", half))
        return each.select("word", "n", "size", "bands", "short", F.col("k.band").alias("band"), F.col("k.bits").alias("bits"), F.col("k.side").alias("side"), part.alias("part"))

    a = keyed(masked.withColumn("short", F.col("size"))).alias("a")
    # a word meets those of its own length, and as the longer one those of one less
    b = keyed(masked.withColumn("short", F.explode(F.array(F.col("size"), F.col("size") - 1)))).alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("short", "band", "bits", "side", "part")]
    col = lambda c: F.col(c)
    earlier = F.lit(False)  # agreement at an earlier band, with either half
    heads = F.substr("a.word", F.lit(1), F.floor(col("a.short") / 2).cast("int")) == F.substr("b.word", F.lit(1), F.floor(col("a.short") / 2).cast("int"))
    for i in range(BANDS):
        earlier = earlier | ((F.lit(i) < col("a.band")) & (F.get("a.bands", F.lit(i)) == F.get("b.bands", F.lit(i))))
    first = ~earlier & ((col("a.side") == 0) | ~heads)
    once = (col("b.size") > col("a.size")) | (col("a.word") < col("b.word"))
    near = F.levenshtein("a.word", "b.word", 1) == 1
    on = once & first & near
    for s in same:
        on = s & on
    return a.hint("merge").join(b, on).select(col("a.word").alias("a"), col("b.word").alias("b"), col("a.n").alias("na"), col("b.n").alias("nb"))


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n for every row of words (word, n), words distinct."""
    words = keep(words, "words")
    pairs = keep(near_pairs(words), "near")
    links = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("nb").alias("m")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("na").alias("m")))
    best = links.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("best"))
    joined = words.join(best, "word", "left")
    form = F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best"))
    formed = joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form["other"].alias("form"), (-form["less"]).alias("form_n"))
    formed = keep(formed, "forms")
    chain = formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    spent = [pairs]
    for _ in range(DOUBLINGS):
        onward = chain.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        chain = keep(chain.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root")), "roots")
        spent.append(chain)
    out = formed.join(chain, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    for d in spent[:-1]:
        drop(d)
    return out


def group_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for the words of docs (doc_id, text)."""
    return variants(count_words(docs))


ORACLE = rf"""
WITH RECURSIVE r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')), '{_UPPER}', '{_LOWER}') AS run FROM documents),
g AS (SELECT id, run, count(*) AS c FROM r WHERE length(run) >= {LEAST} GROUP BY id, run),
bytes AS (SELECT id, run, c, list_transform(string_split(regexp_replace(hex(encode(id || ':' || run)), '(..)', '\1 ', 'g'), ' ')[:-2], lambda x: CAST('0x' || x AS BIGINT)) AS bs FROM g),
h AS (SELECT id, run, c, xor(4294967295, list_reduce(list_concat([4294967295], bs), lambda s, b: list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1))))) AS h FROM bytes),
w AS (SELECT CASE WHEN h % {EVERY} = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, c FROM h),
n AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM w WHERE length(word) >= {LEAST} GROUP BY word HAVING sum(c) >= {OFTEN}),
v AS (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS less FROM (SELECT word, n, unnest(generate_series(1, length(word))) AS i FROM n)),
p AS (SELECT DISTINCT a.word AS a, b.word AS b FROM v a JOIN v b ON a.less = b.less AND a.i = b.i AND a.word <> b.word UNION SELECT DISTINCT v.word, n.word FROM v JOIN n ON n.word = v.less UNION SELECT DISTINCT n.word, v.word FROM v JOIN n ON n.word = v.less),
k AS (SELECT p.a AS word, p.b AS other, o.n AS m, row_number() OVER (PARTITION BY p.a ORDER BY o.n DESC, p.b) AS place, count(*) OVER (PARTITION BY p.a) AS n_near FROM p JOIN n o ON o.word = p.b),
f AS (SELECT n.word, n.n, coalesce(k.n_near, 0) AS n_near, CASE WHEN k.m >= {RATIO} * n.n THEN k.other END AS form, CASE WHEN k.m >= {RATIO} * n.n THEN k.m END AS form_n FROM n LEFT JOIN k ON k.word = n.word AND k.place = 1),
t AS (SELECT word, word AS root, form AS onward FROM f UNION ALL SELECT t.word, f.word, f.form FROM t JOIN f ON f.word = t.onward)
SELECT f.word, f.form, t.root, f.n, f.n_near, f.form_n FROM f JOIN t ON t.word = f.word AND t.onward IS NULL
"""
