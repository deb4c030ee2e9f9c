"""Packing token sequences by shortest-pack-first over the length histogram.

Documents become token ids and an end id, cut into pieces of WIDTH tokens and a rest. Pieces are packed as a histogram: lengths are
placed longest first, each onto the emptiest packs that still have room, as counts of packing patterns. Patterns have as many slots as the
histogram has lengths, whatever the number of documents. Pieces then find their slot by their rank within their length.

Ranks are counted in blocks of one length with bounded size, so a length that many pieces share is spread over tasks.

Defined cases: null or empty text is the end id alone; rows that repeat are documents each; a null id passes through; other columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import keep, trim, worker_cache

WIDTH = 2048
END = 1
VOCABULARY = "byte_bpe_50k"
RANK_BLOCK = 16_384

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def encoder(vocabulary: str = VOCABULARY) -> Callable[[str], np.ndarray]:
    """Text to the ids that tokenizers gives with the vocabulary's file as it is, add_special_tokens=False.

    Ranks are read by tiktoken, some four times as fast. Texts that hold the string of an added token, which tokenizers turns into that token's
    id, and texts that tiktoken can't take go to tokenizers itself.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    whole = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
    added = [t.content for t in whole.get_added_tokens_decoder().values()]

    def encode(text: str) -> np.ndarray:
        if not any(a in text for a in added):
            try:
                return np.asarray(fast.encode_ordinary(text), np.uint32)
            except (KeyboardInterrupt, SystemExit, MemoryError):
                raise
            except BaseException:  # noqa: S110 - the library's panics are no Exceptions; the text goes on below
                pass
        return np.asarray(whole.encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = worker_cache()
    if not hasattr(cache, "encode"):
        cache.encode = encoder()
    for batch in batches:
        doc, start, length, crc, tokens = [], [], [], [], []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            ids = np.append(cache.encode(text.as_py() or ""), np.uint32(END)).astype("<u4")
            for s in range(0, len(ids), WIDTH):
                piece = ids[s : s + WIDTH]
                doc.append(doc_id)
                start.append(s)
                length.append(len(piece))
                crc.append(zlib.crc32(piece.tobytes()))
                tokens.append(len(ids))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc, start, length, crc, tokens)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
    trim()


def pack_histogram(counts: dict[int, int], width: int = WIDTH) -> list[tuple[int, list[int]]]:
    """Patterns (how often, lengths in order of placing) that hold counts[length] pieces of every length."""
    room: dict[int, list[tuple[int, list[int]]]] = {width: []}
    out: list[tuple[int, list[int]]] = []
    for length in sorted(counts, reverse=True):
        todo = counts[length]
        while todo:
            space = max((s for s, packs in room.items() if packs and s >= length), default=None)
            if space is None:
                often, pattern, space = todo, [], width
            else:
                often, pattern = room[space].pop()
                if often > todo:
                    room[space].append((often - todo, pattern))
                    often = todo
            todo -= often
            left = space - length
            if left:
                room.setdefault(left, []).append((often, [*pattern, length]))
            else:
                out.append((often, [*pattern, length]))
    return out + [pack for packs in room.values() for pack in packs]


def slots(patterns: list[tuple[int, list[int]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For every length, over its slots: first rank, first sequence, offset. A slot takes a run of ranks, one for each of its pattern's packs."""
    taken: dict[int, int] = {}
    found: dict[int, list[tuple[int, int, int]]] = {}
    sequence = 0
    for often, pattern in patterns:
        offset = 0
        for length in pattern:
            found.setdefault(length, []).append((taken.get(length, 0), sequence, offset))
            taken[length] = taken.get(length, 0) + often
            offset += length
        sequence += often
    return {k: tuple(np.array(v, np.int64).T) for k, v in found.items()}


def pieces(docs: DataFrame) -> DataFrame:
    """Every piece of every row of docs (doc_id, text), with the crc32 of its ids."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_cut, _PIECES)


def pack(docs: DataFrame) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    cut = keep(pieces(docs), "pieces")
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # WIDTH rows at most
    shared = spark.sparkContext.broadcast(slots(pack_histogram(counts)))

    many = F.array(*(F.lit(-(-counts.get(k, 1) // RANK_BLOCK)) for k in range(1, WIDTH + 1)))  # blocks of every length, by length
    blocked = cut.withColumn("block", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.element_at(many, F.col("length").cast("int"))))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    per_block = blocked.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n"))
    per_block = keep(per_block.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "offsets")
    within = F.row_number().over(Window.partitionBy("length", "block").orderBy("doc_id", "start", "ids_crc32", "doc_tokens"))
    ranked = blocked.withColumn("within", within).join(per_block, ["length", "block"]).withColumn("rank", F.col("before") + F.col("within") - 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for k in np.unique(length):
                at = np.flatnonzero(length == k)
                first, base, where = shared.value[int(k)]
                slot = np.searchsorted(first, rank[at], side="right") - 1
                sequence[at], offset[at] = base[slot] + rank[at] - first[slot], where[slot]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    return ranked.select(*names, "rank").mapInArrow(place, f"{_PIECES}, sequence_id long, offset long")
