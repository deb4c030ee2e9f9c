"""Quality rules as a short-circuit cascade.

Cost and rejection rate of every rule are measured on a bounded sample, texts of any length among it, where the texts lie; rules then run in order of
rejection per cost until one rejects. The order changes the time only: a document is kept if no rule rejects it.

Defined cases: a null or empty text has no words and fails the base rule; repeated rows each get their row.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import trim

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"
#: Cost and rejection are measured on the rows of so many runs of so many ids.
SAMPLE_RUNS, RUN_LENGTH = 32, 32

_NOT_SPACE = re.compile(r"[^\x20\x09-\x0D]")


def repeat_words(words: list) -> int:
    """How many words lie in a 3-word window that occurs at least twice."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, n)
    pairs = np.unique(w[:-1] * len(ids) + w[1:], return_inverse=True)[1].astype(np.int64)
    _, inverse, counts = np.unique(pairs[:-1] * len(ids) + w[2:], return_inverse=True, return_counts=True)
    hit = counts[inverse] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= hit
    return int(covered.sum())


def measures(text: str | None) -> dict:
    """The base measures of a text, with its words."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    seen: set[str] = set()
    lines = text.split("\n")
    dup = 0
    for line in lines:
        if line in seen:
            dup += 1
        elif _NOT_SPACE.search(line):
            seen.add(line)
    return {
        "text": text, "words": words, "n_words": len(words), "n_lines": len(lines), "n_dup_lines": dup,
        "word_chars": len(text) - sum(map(text.count, "\x20\x09\x0a\x0b\x0c\x0d")),
        "n_symbols": sum(map(text.count, "#*$%&|<>")),
        "n_repeat_words": repeat_words(words),
    }


def base_failed(m: dict) -> bool:
    return m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"]


def _top_word(m: dict) -> bool:
    counts: dict = {}
    for w in m["words"]:
        counts[w] = counts.get(w, 0) + 1
    return max(counts.values()) > 0.3 * m["n_words"]


def _shouts(m: dict) -> bool:
    letters = [c for c in m["text"] if c.isalpha()]
    return bool(letters) and sum(c.isupper() for c in letters) > 0.4 * len(letters)


#: name -> whether a text with these measures is rejected. Thresholds are shares of the text.
RULES: dict[str, Callable[[dict], bool]] = {
    "symbols": lambda m: m["n_symbols"] > 0.10 * m["n_words"],
    "duplicate_lines": lambda m: m["n_dup_lines"] > 0.30 * m["n_lines"],
    "word_length": lambda m: not 2 <= m["word_chars"] / m["n_words"] <= 20,
    "shouting": _shouts,
    "exclamation": lambda m: m["text"].count("!") > 0.3 * m["n_words"],
    "no_letters": lambda m: sum(not any(b > 127 or 65 <= b <= 90 or 97 <= b <= 122 for b in w) for w in m["words"]) > 0.3 * m["n_words"],
    "one_word": _top_word,
}


def measured(texts: Iterable[str | None], rules: dict[str, Callable[[dict], bool]] = RULES) -> dict[str, tuple[float, int]]:
    """Seconds and rejections of every rule over the texts that pass the base."""
    cost, hits = dict.fromkeys(rules, 0.0), dict.fromkeys(rules, 0)
    for text in texts:
        m = measures(text)
        if not base_failed(m):
            for name, rule in rules.items():
                began = time.perf_counter()
                hits[name] += rule(m)
                cost[name] += time.perf_counter() - began
    return {k: (cost[k], hits[k]) for k in rules}


def plan_order(found: dict[str, tuple[float, int]], rules: dict[str, Callable[[dict], bool]] = RULES) -> list[str]:
    """Rule names by rejections per second over a sample, best first; ties and an empty sample keep the given order."""
    rate = {k: found[k][1] / max(found[k][0], 1e-9) if k in found else 0.0 for k in rules}
    return sorted(rules, key=lambda k: -rate[k])


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = measured(t.as_py() for batch in batches for t in batch.column("text"))
    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([c for c, _ in found.values()]), pa.array([h for _, h in found.values()], pa.int64())], names=["rule", "cost", "hits"])


def sampled(docs: DataFrame) -> DataFrame:
    """The rows of SAMPLE_RUNS runs of ids, a run after each of the ids with the smallest hashes. Ids are read alone; the runs are ranges, which a scan of sorted files skips to."""
    first = [r.doc_id for r in docs.select("doc_id").where("doc_id IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_RUNS).collect()]
    within = F.lit(False)
    for i in first:
        within = within | F.col("doc_id").between(i, i + RUN_LENGTH - 1)
    return docs.where(within).limit(SAMPLE_RUNS * RUN_LENGTH)


def _runner(order: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = [RULES[k] for k in order]
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                m = measures(text.as_py())
                failed = base_failed(m)
                rows.append((*(m[k] for k in names), failed, not (failed or any(rule(m) for rule in chain))))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:5]), *(pa.array(c, pa.bool_()) for c in columns[5:])],
                names=["doc_id", *names, "base_failed", "kept"],
            )
        trim()

    return run


def apply_rules(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text) with its measures and the cascade's verdict. No shuffle of texts."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = sampled(docs).mapInArrow(_sample, "rule string, cost double, hits long").groupBy("rule").agg(F.sum("cost").alias("cost"), F.sum("hits").alias("hits"))
    order = plan_order({r.rule: (r.cost, r.hits) for r in found.collect()})  # a row a rule
    return docs.mapInArrow(_runner(order), SCHEMA)
