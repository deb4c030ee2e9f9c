import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from lodestrata.llm import base, linededup, lm, mixing, neardup, packing, pii, quality, rules, topk, toxicity

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
DOC_NAMES = ("doc_id", "text", "lang", "source", "n_chars")


def docs_of(spark, texts, ids=None, sources=None):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", (sources or ["s"] * len(texts))[k], len(t or "")) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and white texts, a long text, ties, repeated rows, clashing extra columns."""
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, "word " * 30_000, "en", "b", 150_000), (5, "one two three four five six", "en", "a", 27), (6, "one two three four five six", "en", None, 27),
            (6, "one two three four five six", "en", None, 27), (None, "no id here at all", "fr", "b", 17), (7, "x", "de", "b", 1), (8, "mail a.b@c.de, +1 (555) 555-1234\nsame long line\nsame long line", "de", "b", 60)]
    return spark.createDataFrame(rows, DOC).selectExpr("*", "1 AS score", "2 AS size", "'x' AS __kept", "3 AS rank", "4 AS n_words", "5 AS component")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m.group())
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


def test_pii_base_equals_regular_expressions():
    r = random.Random(1)
    anchors = pii.automaton()
    parts = ["a", "@", ".", "b.c", "1", "23", "+", "4111111111111111", " ", "-", "(", ")", "256", "x@y.z", "1.2.3.4", "@@", "é", "\n", "+1 555 555 0000"]
    for _ in range(4000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 25)))
        assert [s for s in pii.find_spans(t, anchors) if s[0] in pii.BASE_KINDS] == brute_spans(t), t


def plain_house(text, least, at):
    """The address parser without a memory: from each cue the whole name is read again."""
    end, names = at - 1, 0
    while end > least:
        start = max(max(text.rfind(" ", least, end), text.rfind("\n", least, end)) + 1, least)
        token = text[start:end]
        if names and pii._HOUSE.fullmatch(token):
            return start
        if not pii._STREET.fullmatch(token) or text[start - 1 : start] == "\n":
            return -1
        names, end = names + 1, start - 1
    return -1


def test_pii_addresses_are_those_of_the_plain_parser(monkeypatch):
    r, anchors = random.Random(5), pii.automaton()
    parts = ["12", "12B", "5th", "Main", "Street", "street", " ", "\n", "St.", "of", "King", "Road", "lane", " 7,", "x", "Avenue", " 99999 "]
    texts = ["".join(r.choice(parts) + r.choice(["", " ", " "]) for _ in range(r.randint(0, 14))) for _ in range(5000)]
    got = [pii.find_spans(t, anchors) for t in texts]
    monkeypatch.setattr(pii._Houses, "before", lambda self, at, least: plain_house(self.text, least, at))
    assert got == [pii.find_spans(t, anchors) for t in texts] and sum(any(s[0] == "address" for s in g) for g in got) > 200


@pytest.mark.parametrize("unit", [c.capitalize() + " " for cues in pii.CUES.values() for c in cues] + ["12 Street ", "12 Main Street ", "password=", "a@", "@", "+1", "1 ", "1.", "Xyz ", "A"])
def test_pii_takes_time_in_proportion(unit):
    anchors, times = pii.automaton(), []
    for n in (10_000, 80_000):
        text, best = unit * n, 1e9
        for _ in range(3):
            began = time.perf_counter()
            pii.find_spans(text, anchors)
            best = min(best, time.perf_counter() - began)
        times.append(best)
    assert times[1] < 24 * times[0] + 0.2  # eight times the text; squared, it would be 64


def test_pii_more_kinds():
    t = "iban DE89 3704 0044 0532 0130 00, password=hunter2hunter, at 12 Main Street"
    kinds = {k: t[s:e] for k, s, e in pii.find_spans(t, pii.automaton())}
    assert kinds["iban"].startswith("DE89") and kinds["secret"] == "hunter2hunter" and kinds["address"] == "12 Main Street"


def test_pii_rows(spark, odd):
    got = {r.doc_id: r for r in pii.detect(odd).collect()}
    assert got[1].spans == "" and got[1].base_sha256 == hashlib.sha256(b"").hexdigest() and got[8].n_email == got[8].n_phone == 1


def brute_lines(rows):
    key = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s.strip(" \t\n\x0b\x0c\r"))
    owner = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 10:
                owner[key(line)] = min(owner.get(key(line), i), i)
    out = []
    for i, t in rows:
        ls = (t or "").split("\n")
        kept = [x for x in ls if i is None or owner.get(key(x), i) >= i]
        out.append((i, len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_line_dedup_and_compaction(spark, odd, monkeypatch):
    seen, close = [], linededup.LineRuns.close
    monkeypatch.setattr(linededup.LineRuns, "close", lambda store: (seen.append([len(x) for x in store.levels]), close(store)))
    r = random.Random(2)
    pool = [f"Shared line number {i}" for i in range(30)] + ["short", "", "  Shared LINE number 3 "]
    texts = ["\n".join(r.choice(pool) for _ in range(r.randint(0, 8))) for _ in range(60)]
    for d in (docs_of(spark, texts), odd):
        want = brute_lines([(x.doc_id, x.text) for x in d.collect()])
        assert sorted((tuple(x) for x in linededup.dedup_lines(d).collect()), key=repr) == want
    assert seen[0] == [1, 1]  # the query itself compacts: two runs became one of level 1, and the last batch met it


def test_line_runs_hold_keys_once(spark):
    store = linededup.LineRuns(spark, fanout=2)
    for b in range(5):
        store.add_batch(spark.range(b * 10, b * 10 + 20).selectExpr("id AS doc_id", "id % 37 AS h1", "0L AS h2"))
    rows = store.all()
    assert rows.count() == rows.select("h1").distinct().count() == 37 and all(len(x) < 2 for x in store.levels)
    store.close()


def test_top_k_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=7)]) for i in range(300)] + [(300 + i, [0.5] * 7) for i in range(60)]
    rows += [(400, None), (450, [float("nan")] * 7), (500, [0.1, None] + [0.0] * 5), (550, []), (None, [1.0] * 7), (600, [float("inf")] * 7)]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    v = {i: np.floor(256 * np.array(x)).astype(int) for i, x in rows[:360]}
    want = {(q, k + 1, c, -s) for q in v if q % 50 == 0 for k, (s, c) in enumerate(sorted((-int(v[q] @ v[c]), c) for c in v if c != q)[:5])}
    assert {tuple(r) for r in got} == want
    few = topk.search(spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>"))
    assert few.count() == 2
    assert topk.search(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_top_k_of_huge_components(spark):
    rng = np.random.default_rng(4)
    for scale in (1e8, 1e13, 1e300):
        rows = [(i, [float(x) for x in rng.normal(size=9) * scale]) for i in range(120)]
        got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
        v = {i: [max(-(2**53), min(2**53, math.floor(256 * x))) for x in e] for i, e in rows}
        held = lambda s: max(-(2**63) + 1, min(2**63 - 1, s))
        want = {(q, k + 1, c, -s) for q in v if q % 50 == 0 for k, (s, c) in enumerate(sorted((-held(sum(a * b for a, b in zip(v[q], v[c], strict=True))), c) for c in v if c != q)[:5])}
        assert {tuple(r) for r in got} == want


def brute_components(rows, size, percent=80):
    sets = {}
    for i, t in rows:
        w = base.words_of(t)
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_brute_force(spark, size, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 7)  # buckets of many blocks
    r = random.Random(size)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(12):
        seed = [r.choice(words) for _ in range(r.randint(3, 120))]
        for _ in range(r.randint(1, 14)):  # copies with up to a fifth of their words changed
            texts.append(" ".join(r.choice(words) if r.random() < r.choice([0, 0.02, 0.05, 0.1]) else w for w in seed))
    texts += ["", None, "  ", "one", "ONE", "one two", "one two"]
    want = brute_components(list(enumerate(texts)), size)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in neardup.near_duplicates(docs_of(spark, texts), size).collect()}
    assert got == want


def test_near_duplicates_odd(spark, odd):
    got = neardup.near_duplicates(odd).collect()
    assert len(got) == 10 and {r.component_id for r in got if r.doc_id in (5, 6)} == {5}
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]


def test_sketch_estimates():
    rng = np.random.default_rng(0)
    for n in (1, 5, 40, 2000):
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        b = np.concatenate([a[: int(n * 0.9)], rng.integers(0, 2**63, n - int(n * 0.9)).astype(np.uint64)])
        j = len(set(a) & set(b)) / len(set(a) | set(b))
        assert abs(neardup.estimate((neardup.sketch(a) == neardup.sketch(b)).sum()) - j) < 0.2
    assert (neardup.sketch(a) == neardup.sketch(a)).all()


def test_sketches_of_many_texts_equal_those_of_one():
    r = random.Random(3)
    texts = [" ".join(r.choice("abcdefgh") * r.randint(1, 3) for _ in range(n)) for n in [0, 1, 2, 3, 4, 700, *(r.randint(0, 90) for _ in range(60))]] + [None, "  "]
    for size in (1, 2, 5):
        for some in (texts, texts[:4], [None]):
            sets, at = neardup.shingle_sets(some, size)
            many = neardup.sketches(sets, at)
            for i, t in enumerate(some):
                own = neardup.shingle_set(t, size)
                assert (sets[at[i] : at[i + 1]] == own).all() and at[i + 1] - at[i] == len(own) and (not len(own) or (many[i] == neardup.sketch(own)).all())


def test_open_buckets_of_few_meet_together():
    """5,000 buckets of two or three and one of two blocks, cut into batches anywhere: as every pair by itself, in one result for each batch."""
    rng = np.random.default_rng(4)
    kinds = [rng.integers(0, 2**63, 60).astype(np.uint64) for _ in range(8)]
    some = [np.unique(np.concatenate([kinds[i % 8][: rng.integers(52, 61)], rng.integers(0, 2**63, 4).astype(np.uint64)])) for i in range(200)]
    regs, short = [neardup.sketch(x) for x in some], [neardup._short(x) for x in some]
    groups = [(band, 0, 0, [(int(i), 0) for i in rng.choice(200, rng.integers(2, 4), replace=False)]) for band in range(5000)]
    groups += [(5000, 0, 1, [(i, int(i >= 40)) for i in range(80)]), (5001, 1, 2, [(3, 0), (11, 0)])]  # the last one's other block is empty
    rows, want = [], set()
    for band, x, y, members in groups:
        pairs = [(i, j) for (i, s), (j, t) in itertools.combinations(members, 2) if x == y or s != t]
        first = {p: next((k for k in range(neardup.BANDS) if (regs[p[0]].reshape(-1, neardup.ROWS)[k] == regs[p[1]].reshape(-1, neardup.ROWS)[k]).all()), 0) for p in pairs}
        place = min(first.values(), default=0)
        rows += [(band, x, y, s, place, i, i % 5, regs[i].tobytes(), short[i]) for i, s in members]
        alike = lambda i, j: 100 * len(np.intersect1d(some[i], some[j])) >= 80 * len(np.union1d(some[i], some[j]))
        want |= {(min(p), max(p)) for p in pairs if p[0] % 5 != p[1] % 5 and first[p] == place and alike(*p)}
    names = ["band", "x", "y", "side", "place", "rep", "component", "regs", "short"]
    table = pa.table(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)))
    batches = table.to_batches(max_chunksize=997)
    out = list(neardup._across(80)(iter(batches)))
    assert len(out) <= len(batches) + 1 and len(want) > 100
    assert {(a, b) for batch in out for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True)} == want


def auc_rows(got, labels, column):
    m = got.merge(labels.toPandas(), on="doc_id")
    return m[m.held_out], column


def test_quality_held_out(spark, odd):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held, _ = auc_rows(quality.classify(docs, labels).toPandas(), labels, "quality")
    assert (held.predicted == held.quality).mean() > 0.9 and held.score.between(0, 1).all()
    assert held.held_out.eq([zlib.crc32(str(i).encode()) % 5 == 0 for i in held.doc_id]).all()
    assert quality.classify(odd, labels).count() == 10
    none = spark.createDataFrame([(None, None, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.classify(odd, none).collect()} == {0.5}


def test_toxicity_held_out(spark, odd):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held, _ = auc_rows(toxicity.classify(docs, labels).toPandas(), labels, "toxic")
    assert (held.predicted == held.toxic).mean() > 0.95 and held.predicted[held.toxic == 0].mean() < 0.01
    assert held.predicted[held.toxic == 1].mean() >= 0.9
    assert toxicity.classify(odd, labels).count() == 10


@pytest.mark.parametrize("module", [quality, toxicity])
def test_long_training_texts_are_whole(spark, monkeypatch, module):
    long = " ".join("".join(chr(97 + i // 26**k % 26) for k in range(4)) + "qwz" for i in range(6000))
    d = docs_of(spark, [long] * 10)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(10)], "doc_id long, quality int, toxic int")
    learnt, update = [], module.Ftrl.update
    monkeypatch.setattr(module.Ftrl, "update", lambda self, slots, *a: (learnt.append(len(slots)), update(self, slots, *a))[1])
    module.train(d, labels)
    own = quality.ngram_features(long, quality.Hasher()) if module is quality else toxicity.presence_features(long, toxicity.Hasher())
    assert learnt and set(learnt) == {len(np.unique(own))} and learnt[0] > 4096
    rows = len(learnt)
    learnt.clear()
    monkeypatch.setattr(quality, "TRAIN_FEATURES", 2 * len(np.unique(own)) + 1)
    module.train(d, labels)
    assert 0 < len(learnt) < rows and set(learnt) == {len(np.unique(own))}


def test_label_model_finds_classes():
    rng = np.random.default_rng(5)
    y = rng.random(3000) < 0.1
    votes = np.stack([np.where(y, rng.random(3000) < 0.4, rng.random(3000) < 0.002) for _ in range(10)] , axis=1).astype(float)
    votes = np.concatenate([votes, votes[:, :1]], axis=1)  # a copy of a voter
    post, info = toxicity.label_model(votes)
    assert ((post > 0.5) == (y & (votes.sum(1) > 0))).mean() > 0.97 and info["correlation"][10, 0] > 0.9


def test_label_model_is_plain_expectation_maximisation():
    """Against loops over rows and voters that never correlate, and a copy of a voter changes nothing."""
    rng = np.random.default_rng(9)
    y = rng.random(400) < 0.2
    votes = np.stack([np.where(y, rng.random(400) < 0.5, rng.random(400) < 0.01 * (k + 1)) for k in range(4)] + [rng.random(400) < np.where(y, 0.02, 0.3)], axis=1).astype(float)
    post, info = toxicity.label_model(votes, 1)
    assert len(set(info["group"])) == 5
    n, m = votes.shape
    hits = [sum(votes[i, :4]) for i in range(n)]
    p = [0.9 if h else 0.02 for h in hits]
    for _ in range(30):
        total = sum(p)
        prior = total / n
        on = [(sum(p[i] for i in range(n) if votes[i, j]) + 0.5) / (total + 1) for j in range(m)]
        off = [max(1e-5, (sum(1 - p[i] for i in range(n) if votes[i, j]) + 0.01) / (n - total + 1)) for j in range(m)]
        quiet = math.log((sum(p[i] for i in range(n) if not hits[i]) + 0.5) / (total + 1) / ((sum(1 - p[i] for i in range(n) if not hits[i]) + 0.5) / (n - total + 1)))
        odds = [math.log(prior / (1 - prior)) + sum(math.log(on[j] / off[j]) for j in range(m) if votes[i, j]) + (0 if hits[i] else quiet) for i in range(n)]
        p = [1 / (1 + math.exp(-x)) for x in odds]
    assert np.allclose(post, p, atol=1e-6)
    copied = toxicity.label_model(np.concatenate([votes[:, :1], votes], axis=1), 1)[0]
    assert np.abs(copied - post).max() < 0.02


def test_ftrl_is_the_plain_update():
    from lodestrata.llm.linear import WIDTH, Ftrl

    r, model = random.Random(3), Ftrl(alpha=0.3, beta=1.0, l1=0.3, l2=1.0)
    z, n = defaultdict(float), defaultdict(float)
    for _ in range(200):
        slots = sorted(r.sample(range(12), 4))
        x = {**{s: r.random() for s in slots}, WIDTH: 1.0}
        y = float(r.random() < 0.4)
        w = {i: 0.0 if abs(z[i]) <= 0.3 else -(z[i] - math.copysign(0.3, z[i])) / ((1 + math.sqrt(n[i])) / 0.3 + 1) for i in x}
        g = 1 / (1 + math.exp(-sum(w[i] * x[i] for i in x))) - y
        for i in x:
            gi = g * x[i]
            z[i] += gi - (math.sqrt(n[i] + gi * gi) - math.sqrt(n[i])) / 0.3 * w[i]
            n[i] += gi * gi
        model.update(np.array(slots), np.array([x[s] for s in slots]), y)
    assert all(model.z[i] == pytest.approx(z[i]) and model.n[i] == pytest.approx(n[i]) for i in n)


def test_families_are_counted():
    own = toxicity.terms_of("Prefixone prefixtwo PREFIXONE alone")
    assert {"prefixone", "prefix~1", "prefix~2", "alon~1"} <= own and "prefix~3" not in own and "alon~2" not in own
    one, two = (set(toxicity.presence_features(t, toxicity.Hasher())) for t in ("prefixone", "prefixone prefixtwo"))
    assert one < two and (len(one), len(two)) == (5, 10)  # a word and four stems; two words, three shared stems, two of seven letters, three families


def test_rules(spark, odd):
    r = random.Random(4)
    clean = " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(r.randint(0, 99)) for _ in range(200))
    texts = [clean, clean.upper() + "!!", " ".join(f"{w}### " for w in clean.split()), "a b c a b c", None, "same\nsame\n \n "]
    got = {x.doc_id: x for x in rules.apply_rules(docs_of(spark, texts)).collect()}
    assert [got[i].kept for i in range(6)] == [True, False, False, False, False, False]
    assert (got[3].n_words, got[3].n_repeat_words, got[3].base_failed) == (6, 6, True) and got[5].n_dup_lines == 1
    assert rules.apply_rules(odd).count() == 10 and rules.apply_rules(odd.limit(0)).count() == 0


def test_repeat_words_brute_force():
    r = random.Random(6)
    for _ in range(300):
        w = [r.choice("abc") for _ in range(r.randint(0, 15))]
        c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        assert rules.repeat_words(w) == len({i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)})


def test_mix_targets():
    got = mixing.targets([("a", 10), ("b", 1000), (None, 990)])
    assert got["a"] == 30 and sum(got.values()) == pytest.approx(2000) and got["b"] == pytest.approx(1970 * 2 / 3)
    assert mixing.targets([]) == {} and mixing.targets([("z", 0)]) == {"z": 0.0}


def test_mix(spark, odd):
    r = random.Random(7)
    texts = ["w " * r.randint(1, 300) for _ in range(1500)]
    d = docs_of(spark, texts, sources=[r.choice(["hot"] * 4 + ["a", "b", "c"]) for _ in texts])
    got = mixing.mix(d).toPandas()
    assert (got.taken <= 3 * got["size"]).all() and len(got) == 1500
    for _, g in got.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 0.01 * g.target.iloc[0] + 5
    again = mixing.mix(d.repartition(7)).toPandas()
    assert got.sort_values("doc_id").copies.tolist() == again.sort_values("doc_id").copies.tolist()
    assert mixing.copies(d).count() == got.copies.sum()
    whole = mixing.mix(odd)
    assert whole.count() == 10 and mixing.copies(odd).columns == odd.columns and mixing.mix(odd.limit(0)).count() == 0


def test_pack_histogram():
    r = random.Random(8)
    counts = Counter(r.randint(1, 2048) for _ in range(5000))
    patterns = packing.pack_histogram(counts)
    held = Counter()
    for often, pattern in patterns:
        assert sum(pattern) <= 2048
        for n in pattern:
            held[n] += often
    assert held == counts


def test_pack(spark, odd):
    from tokenizers import Tokenizer

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["Hello wörld 123", "", None, "a" * 5000 + " <|endoftext|> x", "the cat " * 3000]
    for d in (docs_of(spark, texts), odd):
        got = packing.pack(d).toPandas().sort_values(["sequence_id", "offset"])
        assert (got.groupby("sequence_id").length.cumsum() - got.length == got.offset).all() and got.groupby("sequence_id").length.sum().max() <= 2048
        for doc_id, text in {(r.doc_id, r.text) for r in d.collect() if r.doc_id is not None}:
            ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
            own = got[got.doc_id == doc_id].drop_duplicates("start").sort_values("start")
            assert own.length.sum() == len(ids) == own.doc_tokens.iloc[0]
            assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(own.start, own.length, strict=True)] == own.ids_crc32.tolist()


def test_lm_base_and_distribution(spark, odd):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = lm.score_corpus(d).toPandas().set_index("doc_id")
    rows = {r.doc_id: base.words_of(r.text) for r in d.collect()}
    train = {i: w for i, w in rows.items() if zlib.crc32(str(i).encode()) % 10}
    c = Counter(x for w in train.values() for x in w)
    n, v, ends = sum(c.values()) + len(train), len(c) + 1, len(train)
    for i, w in rows.items():
        want = sum(math.log10((x + 0.1) / (n + 0.1 * (v + 1))) for x in [*(c[y] for y in w), ends])
        assert got.base_score[i] == pytest.approx(want, abs=1e-6) and got.n_known[i] == sum(c[y] > 0 for y in w) + 1 and got.train_tokens[i] == n
    assert (got.score < 0).all() and lm.score_corpus(odd).count() == 10 and lm.score_corpus(odd.limit(0)).count() == 0


def test_lm_frequent_words_only_move_work(spark, monkeypatch):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    want = lm.score_corpus(d).toPandas().set_index("doc_id").base_score
    monkeypatch.setattr(lm, "FREQUENT", 3)
    assert np.allclose(lm.score_corpus(d).toPandas().set_index("doc_id").base_score.loc[want.index], want)


def test_lm_most_frequent_stay(spark):
    """Counts beyond any clip keep their order, and a bucket that doesn't fit is cut, not dropped."""
    big = spark.range(4000).selectExpr("id AS key", "IF(id < 3000, 5000000 + id % 2, IF(id < 3010, 9000000000, 3)) AS n")
    got = lm._most(big, "n", lm.F.lit(1), 500, ["key"]).toPandas()
    assert 400 <= len(got) <= 500 and (got.n > 3).all() and (got.n == 9_000_000_000).sum() == 10
    assert lm._most(big, "n", lm.F.lit(1), 4000, ["key"]).count() == 4000 and lm._most(big.limit(0), "n", lm.F.lit(1), 5, ["key"]).count() == 0


def test_lm_scores_by_every_context(spark, monkeypatch):
    """The tables give what the whole tree gives in one memory, wherever grams are resolved."""
    d = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60 AND length(text) < 4000").union(docs_of(spark, ["qzx \u00e9\u4e2d", None, "same " * 50], [1000, 1001, None]))
    rows = d.collect()
    u, c = lm.grams([r.text for r in rows if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 10])
    parts, code, n = [], u.astype(np.int64), c
    for k in range(lm.DEPTH, -1, -1):
        code, at = np.unique(code & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
        n = np.bincount(at, weights=n)
        parts.append(pd.DataFrame({"depth": k, "context": code >> 8, "symbol": code & 255, "n": n}))
    tree = lm.Tree(pd.concat(parts))
    seen = {int(s) for s in parts[-1].symbol}
    for cache in (lm.CACHE, 50):
        monkeypatch.setattr(lm, "CACHE", cache)
        monkeypatch.setattr(lm, "_GROUP", 1000)
        got = lm.score_corpus(d).toPandas().set_index("doc_id").score
        for r in rows:
            if set((r.text or "").encode()) <= seen:
                want = lm.score_texts(tree.step, tree.logp, tree.column, tree.start, [r.text])[0] / math.log(10)
                assert (got[got.index.isna()].iloc[0] if r.doc_id is None else got[r.doc_id]) == pytest.approx(want, rel=1e-4)
    assert np.isfinite(got).all()


def brute_tree(texts, depth):
    """Context-tree weighting by plain recursion over all contexts."""
    counts = defaultdict(lambda: [0, 0])
    for t in texts:
        data = bytes([255] * depth) + t.encode() + b"\xff"
        for i in range(depth, len(data)):
            for d in range(depth + 1):
                for k in range(8, 0, -1):
                    counts[data[i - d : i], (256 | data[i]) >> k][data[i] >> (k - 1) & 1] += 1
    contexts = {c for c, _ in counts}
    kids = defaultdict(set)
    for c in contexts:
        if c:
            kids[c[1:]].add(c)
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(c, node):
        own = kt(*counts.get((c, node), (0, 0)))
        if not kids[c]:
            return own, 0.0, own
        inner = sum(weighted(k, node)[0] for k in kids[c])
        return float(np.logaddexp(own, inner)) - math.log(2), own - inner, own

    def bit(c, path, node):
        a, b = counts.get((c, node), (0, 0))
        p = (b + 0.5) / (a + b + 1)
        if not kids[c]:
            return p
        child = path[len(path) - len(c) - 1 :]
        below = bit(child, path, node) if child in kids[c] else 0.5
        w = 1 / (1 + math.exp(-max(-700, min(700, weighted(c, node)[1]))))
        return w * p + (1 - w) * below

    return bit


def test_lm_tree_is_context_tree_weighting(monkeypatch):
    monkeypatch.setattr(lm, "DEPTH", 2)
    texts = ["abab", "abba", "ba"]
    u, c = lm.grams(texts)
    code, n, parts = u.astype(np.int64), c, []
    for d in (2, 1, 0):
        key, at = np.unique(code & ((1 << 8 * (d + 1)) - 1), return_inverse=True)
        n = np.bincount(at, weights=n)
        code = key
        parts.append(pd.DataFrame({"depth": d, "context": key >> 8, "symbol": key & 255, "n": n}))
    tree, bit = lm.Tree(pd.concat(parts), 2), brute_tree(texts, 2)
    for text in ("ab", "bbaa", "a"):
        data, want = b"\xff\xff" + text.encode() + b"\xff", 0.0
        for i in range(2, len(data)):
            for k in range(8, 0, -1):
                p = bit(b"", data[i - 2 : i], (256 | data[i]) >> k)
                want += math.log(p if data[i] >> (k - 1) & 1 else 1 - p)
        assert lm.score_texts(tree.step, tree.logp, tree.column, tree.start, [text])[0] == pytest.approx(want, rel=1e-5)
    sums = np.exp(tree.logp[:, :-1].astype(float)).sum(1) + np.exp(tree.logp[:, -1].astype(float)) * (256 - tree.logp.shape[1] + 1)
    assert np.allclose(sums, 1, atol=1e-5)


def test_pipeline_stages_brute_force(spark, odd):
    """Every stage's rows on planted documents and odd rows, under names that operators use themselves, against a plain version of the stage."""
    import corpus_pipeline as cp
    from tokenizers import Tokenizer

    import public_tokenizers

    r = random.Random(21)
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 90 AND length(text) < 6000").select(*DOC_NAMES).collect()
    texts = [tuple(x) for x in docs] + [tuple(x)[:5] for x in odd.collect()]
    long = [w for x in docs for w in x.text.split()][:700]
    for k in range(8):  # near copies and exact ones, and shared lines
        words = list(long)
        words[r.randrange(len(words))] += "x" * (k % 3)
        texts.append((1000 + k, " ".join(words) + "\nA line that many documents share.\n" + f"own {k}", "en", "near", 1))
    made = spark.createDataFrame(texts, DOC)
    extra = ["row", "kept", "dropped", "lines", "gone", "turn", "copies", "size_", "id", "unit", "__kept", "__score", "t1", "each"]
    docs = made.selectExpr("*", *(f"{i} AS `{c}`" for i, c in enumerate(extra)), "3 AS score", "4 AS size")
    columns = docs.columns
    of = lambda d: sorted(((x.doc_id, x.text or "", x.source) for x in d.collect()), key=repr)

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    weights, hasher, want = quality.train(docs, labels), quality.Hasher(), []
    for i, t, s in of(docs):
        f = quality.ngram_features(t, hasher)
        z = float(weights[-1]) + (sum(float(weights[x]) for x in f) / math.sqrt(len(f)) if len(f) else 0.0)
        if 1 / (1 + math.exp(-z)) >= 0.3:
            want.append((i, t, s))
    stages = [f for _, f in cp.STAGES]
    first = base.keep(stages[0](spark, docs, SF), "first")
    assert of(first) == want and 0 < len(want) and first.columns == columns

    second = base.keep(stages[1](spark, first, SF), "second")
    assert second.columns == columns
    before, key = of(first), lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    owner = {}
    for i, t, _ in before:
        for line in t.split("\n"):
            if i is not None and len(key(line)) >= 10:
                owner[key(line)] = min(owner.get(key(line), i), i)
    assert of(second) == sorted(((i, "\n".join(x for x in t.split("\n") if i is None or owner.get(key(x), i) >= i), s) for i, t, s in before), key=repr)
    assert all(x.n_chars == len(x.text) for x in second.collect())

    third = base.keep(stages[2](spark, second, SF), "third")
    rows = of(second)
    component = brute_components([(i, t) for i, t, _ in rows if i is not None], 5)
    assert of(third) == [x for x in rows if x[0] is None or component[x[0]][1] == x[0]] and third.columns == columns and len(of(third)) < len(rows)

    fourth = base.keep(stages[3](spark, third, SF), "fourth")
    assert fourth.columns == columns
    rows, sizes = of(third), Counter()
    for _, t, s in rows:
        sizes[s] += len(base.words_of(t))
    taken, often = Counter(), Counter(of(fourth))
    assert set(often) <= set(rows)
    for x, n in often.items():
        taken[x[2]] += n * len(base.words_of(x[1]))
        assert n <= 3 * rows.count(x)
    goal = brute_targets(sizes)
    for s in sizes:
        largest = max(len(base.words_of(t)) for _, t, o in rows if o == s)
        assert abs(taken[s] - goal[s]) <= largest  # one document at most is rounded against its source

    fifth = stages[4](spark, fourth, SF).toPandas()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, t, _ in of(fourth):
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4")
        for at in range(0, len(ids), 2048):
            want[-1 if i is None else i, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes()), len(ids)] += 1
    assert Counter(zip(fifth.doc_id.fillna(-1), fifth.start, fifth.length, fifth.ids_crc32, fifth.doc_tokens, strict=True)) == want
    for _, g in fifth.sort_values("offset").groupby("sequence_id"):
        assert (g.length.cumsum() - g.length == g.offset).all() and g.length.sum() <= 2048
    for stage in stages:
        assert stage(spark, docs.limit(0), SF).count() == 0


def brute_targets(sizes):
    """Shares by weight, none above three times its source, in exact steps from the fullest source on."""
    order = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    weight, goal, left = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, {}, sum(sizes.values())
    for s in sorted(order, key=lambda s: sizes[s] / weight[s]):  # sources fill in this order
        goal[s] = min(3 * sizes[s], left * weight[s] / sum(weight[o] for o in order if o not in goal))
        left -= goal[s]
    return goal


def test_pipeline(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "1 AS score", "2 AS __copy")
    columns = docs.columns
    for i, (_, stage) in enumerate(cp.STAGES[:-1]):
        before = docs.count()
        docs = base.keep(stage(spark, docs, SF), f"test{i}")
        assert docs.columns == columns and docs.count() > 0.3 * before
    rows = docs.collect()
    assert max(Counter(r.doc_id for r in rows).values()) <= 3
    packed = cp.packed(spark, docs, SF)
    assert packed.where("start = 0").count() == len(rows)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in rows}
