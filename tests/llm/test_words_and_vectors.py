"""Spelling variants, piecewise fingerprints and centroid clustering, each against a plain second version."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from lodestrata.llm import centroids, ctph, spelling

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOC)


def lower(w):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)


def brute_variants(rows):
    n = Counter()
    for i, t in rows:
        run = ""
        for c in (t or "") + "\n":
            if "a" <= c <= "z" or "A" <= c <= "Z" or "À" <= c <= "ÿ":
                run += c
                continue
            if run:
                w = lower(run)
                h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
                if h % 199 == 0:
                    w = w[: h % len(w)] + w[h % len(w) + 1 :]
                n[w] += 1
            run = ""
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    out = {}
    for w in n:
        close = sorted((-n[o], o) for o in n if near(w, o))
        form = close[0][1] if close and -close[0][0] >= 5 * n[w] else None
        out[w] = [form, None, n[w], len(close), n[form] if form else None]
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w][1] = root
    return {(w, *x) for w, x in out.items()}


def test_variants_brute_force(spark):
    r = random.Random(11)
    base = ["".join(r.choice("abeinstéß") for _ in range(r.randint(6, 9))) for _ in range(12)]
    pool = []
    for i, w in enumerate(base):
        pool += [w.upper() if i % 3 else w] * 5 ** (i % 4)
        for _ in range(6):
            v, k = w, r.randrange(len(w))
            kind = r.randrange(3)
            v = v[:k] + v[k + 1 :] if kind == 0 else v[:k] + r.choice("abxyé") + v[k + (kind == 1) :]
            pool += [v] * r.choice([1, 1, 2, 6])
    rows = [(i, " ".join(r.choice(pool) for _ in range(400)) + "×-end") for i in range(40)] + [(None, " ".join(pool)), (7, None), (8, ""), (8, "tiny"), (9, "x" * 50_000)]
    rows += [(20 + i, "abcdef " * 9) for i in range(3)] + [(20, "abcdef " * 9)]
    # a chain of forms: each five times as frequent
    rows += [(100, " ".join(["chainaa"] * 5 + ["chainab"] * 25 + ["chainbb"] * 125 + ["chainbbb"] * 700))]
    d = docs_of(spark, rows).selectExpr("*", "'q' AS word", "1 AS n", "'z' AS run", "2 AS h")
    got = spelling.group_variants(d).collect()
    assert got[0].__fields__ == ["word", "form", "root", "n", "n_near", "form_n"]
    want = brute_variants(rows)
    assert {tuple(x) for x in got} == want and len(got) == len(want)
    roots = {x.word: x.root for x in got}
    assert {roots[w] for w in ("chainaa", "chainab", "chainbb")} == {"chainbbb"}
    assert spelling.group_variants(d.limit(0)).count() == 0


def test_variants_of_many_words_alike(spark):
    """Words that share a band and a half by the thousand are linked only where they are near."""
    words = [("prefix" + "".join(chr(97 + (i // 26**k) % 26) for k in range(3)), 5 + i % 7) for i in range(2000)]
    d = spark.createDataFrame(words, "word string, n long")
    got = {tuple(sorted((r.a, r.b))) for r in spelling.near_pairs(d).collect()}
    n = [w for w, _ in words]
    near = {w[:k] + "*" + w[k + 1 :]: [] for w in n for k in range(6, 9)}
    for w in n:
        for k in range(6, 9):
            near[w[:k] + "*" + w[k + 1 :]].append(w)
    want = {tuple(sorted((a, b))) for g in near.values() for a in g for b in g if a != b}
    assert got == want and spelling.near_pairs(d).count() == len(want)


def plain_fingerprint(text):
    data = (text or "").encode()
    bits = 0
    while (1 << bits) * 64 < max(len(data), 1):
        bits += 1
    m32 = 0xFFFFFFFF

    def roll(i):
        h = sum((data[i - k] if i >= k else 0) * (0x9E3779B1 * (2 * k + 1) & m32) for k in range(7)) & m32
        h ^= h >> 15
        h = h * 0x85EBCA6B & m32
        h ^= h >> 13
        h = h * 0xC2B2AE35 & m32
        return h ^ h >> 16

    hs = [roll(i) for i in range(len(data))]

    def letters(b):
        out, total, any_ = [], 0, False
        for h in hs:
            total, any_ = total + ((h * 0x27D4EB2F & m32) ^ h >> 9) & m32, True
            if h & (1 << b) - 1 == (1 << b) - 1 and len(out) < 127:
                out.append(total)
                total, any_ = 0, False
        out += [total] if any_ else []
        alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
        return "".join(alphabet[((x ^ x >> 15) * 0x2C1B3C6D & m32) >> 26] for x in out)

    while bits and len(letters(bits)) < 16:
        bits -= 1
    return f"{1 << bits}:{letters(bits)}:{letters(bits + 1)}"


def plain_likeness(a, b):
    if a == b:
        return 1.0
    (x, a1, a2), (y, b1, b2) = a.split(":"), b.split(":")
    x, y = int(x), int(y)

    def alike(p, q):
        if p == q:
            return 1.0
        run = min(7, -(-min(len(p), len(q)) // 2))
        if not run or not any(p[i : i + run] in q for i in range(len(p) - run + 1)):
            return 0.0
        row = list(range(len(q) + 1))
        for i, c in enumerate(p, 1):
            last, row[0] = row[0], i
            for j, e in enumerate(q, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != e))
        return 1 - row[-1] / max(len(p), len(q))

    return max(alike(a1, b1), alike(a2, b2)) if x == y else alike(a1, b2) if x == 2 * y else alike(a2, b1) if 2 * x == y else 0.0


@pytest.fixture(scope="module")
def some_texts():
    r = random.Random(12)
    words = ["".join(r.choice("abcdefghijé中") for _ in range(r.randint(2, 9))) for _ in range(300)]
    texts = [" ".join(r.choice(words) for _ in range(r.choice([1, 3, 20, 200, 900]))) for _ in range(60)]
    return texts + [texts[5], texts[5] + "!", "", None, "a", "ab", "abc", "abcd", "aaaa" * 3000, "word " * 4000, "\U0001f600" * 9, "x"]


def test_fingerprint_is_the_plain_one(some_texts, monkeypatch):
    for t in some_texts:
        assert ctph.fingerprint(t) == plain_fingerprint(t), t
    want = [ctph.fingerprint(t) for t in some_texts]
    monkeypatch.setattr(ctph, "_BLOCK", 50)  # hashed in many runs
    assert [ctph.fingerprint(t) for t in some_texts] == want


@pytest.mark.parametrize("parts", [1, 9])
def test_fingerprints_brute_force(spark, some_texts, parts):
    r = random.Random(13)
    rows = [(3 * i % 101 if i % 10 else i // 20, t) for i, t in enumerate(some_texts)]
    rows = {i: t for i, t in rows}
    rows = [*rows.items()]
    r.shuffle(rows)
    d = docs_of(spark, rows).repartition(5).selectExpr("*", "'p' AS place", "1 AS h", "'f' AS fingerprint")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {x.doc_id: tuple(x) for x in ctph.fingerprints(d).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    rows.sort()
    assert len(got) == len(rows)
    for (i, t), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        t, following = t or "", following or ""
        changed = t[: len(t) - len(t) // 4] + following[: len(t) // 4]
        own, new, other = (plain_fingerprint(x) for x in (t, changed, following))
        assert got[i][:5] == (i, len(t), hashlib.sha256(changed.encode()).hexdigest(), own, new)
        assert got[i][5:] == pytest.approx((plain_likeness(own, new), plain_likeness(own, other)))


def test_fingerprints_odd_rows(spark):
    same = [(4, "copy of one text, many times over")] * 30
    rows = [(None, "no id"), (None, None), (1, "first"), *same]
    got = ctph.fingerprints(docs_of(spark, rows).repartition(3)).collect()
    assert len(got) == 33 and Counter(x.doc_id for x in got) == {None: 2, 1: 1, 4: 30}
    # all but the last copy are followed by a copy
    assert sum(x.near_next == 1 and x.edited_fingerprint != "" for x in got if x.doc_id == 4) >= 29
    alone = ctph.fingerprints(docs_of(spark, [(9, "by itself, followed by itself")])).collect()
    assert alone[0].near_next == 1 and ctph.fingerprints(docs_of(spark, rows[:0])).count() == 0


def test_edited_texts_stay_alike_and_others_do_not(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = ctph.fingerprints(docs).toPandas()
    long = got[got.n_chars >= 40]
    assert (long.near_edited > 0.4).mean() > 0.97 and (long.near_next > 0.4).mean() < 0.05


def brute_clusters(rows):
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    kept = [(i, [max(-(2**24), min(2**24, x)) for x in v]) for i, v in kept]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:16]
    c = [list(v) for _, v in first]
    dist = lambda v, w: sum((a - b) ** 2 for a, b in zip(v, w, strict=True))
    for step in range(4):
        a = [min((dist(v, w), j) for j, w in enumerate(c)) for _, v in kept]
        if step < 3:
            for j in range(len(c)):
                mine = [v for (_, v), (_, k) in zip(kept, a, strict=True) if k == j]
                if mine:
                    c[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    total, own = sum(d for d, _ in a), Counter()
    for d, j in a:
        own[j] += d
    sha = [hashlib.sha256(",".join(map(str, w)).encode()).hexdigest() for w in c]
    return sorted(((i, j, d, own[j], total, sha[j]) for (i, _), (d, j) in zip(kept, a, strict=True)), key=repr)


def test_clusters_brute_force(spark):
    rng = np.random.default_rng(13)
    middle = rng.normal(size=(9, 64)) * 0.3
    rows = [(i, [float(x) for x in middle[i % 9] + rng.normal(size=64) * 0.1]) for i in range(260)]
    rows += [(i, [0.25] * 64) for i in range(300, 340)] + [(300, [0.25] * 64), (301, [-0.5] * 64)]
    rows += [(None, [0.1] * 64), (None, [0.2] * 64), (400, None), (401, []), (402, [0.1] * 63), (403, [0.1] * 63 + [None]), (404, [float("nan")] * 64), (405, [float("-inf")] * 64), (406, [3e38] * 64)]
    schema = "vec_id long, embedding array<double>"
    d = spark.createDataFrame(rows, schema).selectExpr("*", "1 AS cluster", "2 AS v", "3 AS distance", "4 AS pos").repartition(7)
    got = centroids.cluster_vectors(d)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_clusters(rows)
    few = rows[:3]
    assert sorted((tuple(r) for r in centroids.cluster_vectors(spark.createDataFrame(few, schema)).collect()), key=repr) == brute_clusters(few)
    none = centroids.cluster_vectors(spark.createDataFrame([], schema))
    assert none.count() == 0 and none.columns == got.columns


def test_screening_prunes_and_is_exact():
    rng = np.random.default_rng(14)
    for scale in (3, 200, 2**24):
        middle = rng.integers(-scale, scale, (16, 64))
        rows = np.clip(middle[rng.integers(0, 16, 3000)] + rng.integers(-scale // 3, scale // 3 + 1, (3000, 64)), -(2**24), 2**24).astype(np.int32)
        rows[:50] = 0
        many = []
        cluster, best = centroids.nearest(rows, *centroids.compressed(rows), middle, many)
        d = ((rows[:, None].astype(np.int64) - middle[None]) ** 2).sum(2)
        assert (best == d.min(1)).all() and (cluster == d.argmin(1)).all()
        assert many[0] < 0.25 * d.size  # most centroids never got an exact distance
