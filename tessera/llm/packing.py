"""Packing token sequences with certified bin counts (operator 6).

Method: best-fit decreasing per partition, and a lower bound on the number of
sequences from dual-feasible functions (Fekete & Schepers, "New classes of
fast lower bounds for bin packing problems", Math. Program. 2001). A partition
whose count equals its bound is certified: no packing of its pieces needs
fewer sequences. A partition with a gap gives the documents of its loosest
sequences to a common pool, the pool is dealt out anew and packed again; this
goes on while it saves sequences.

Documents are tokenized where they lie; the text is never shuffled. Only
(key, length) rows move, in partitions of about ``PART_ROWS`` pieces, packed one
after the other by at most ``MOST_TASKS`` tasks, so the memory of a task is
bounded whatever the table's size. Every round is a table in the shared folder;
``certificates`` gives the count and the bound of every partition. A document's key numbers the rows of the written piece
table, so repeated rows and null ids need no care.

Tokens: a byte-level BPE. Its rank form is what packs quickly; texts that hold
a special token's string, or characters outside the blocks where the two
libraries' character classes are known to agree, go through ``tokenizers``.

Defined cases: null text is empty; an empty document is its end id alone; an
empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..session import stored
from .common import batches

CAPACITY = 2048
END_ID = 0
PART_ROWS = 50_000
MOST_TASKS = 20_000
#: deals of a pool that may save nothing before the exchange ends
PATIENCE = 2
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

#: Latin letters, digits, punctuation, tab and newline: Unicode classes that no
#: version of the tables has changed
_PLAIN = re.compile("[\t\n\x20-\x7e¡-ȳ]*")


class Encoder:
    """Text to ids; one per worker process and vocabulary."""

    _made: dict[tuple[str, str], Encoder] = {}

    def __init__(self, vocabulary: str, ranks: str):
        self.whole = Tokenizer.from_file(vocabulary)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table,
                                       special_tokens={})

    @classmethod
    def of(cls, vocabulary: str = VOCABULARY, ranks: str = RANKS) -> Encoder:
        key = (vocabulary, ranks)
        if key not in cls._made:
            cls._made[key] = cls(vocabulary, ranks)
        return cls._made[key]

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        if _PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            return np.asarray(self.quick.encode_to_numpy(text, disallowed_special=()), "<u4")
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4")


def pieces_of(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids: one, or full
    ones after a first that may be shorter."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    return ([(0, head)] if head else []) + [(s, capacity) for s in range(head, n, capacity)]


def _tokenizer(vocabulary: str, ranks: str, with_ids: bool):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder.of(vocabulary, ranks)
        for b in batches(it, 4 << 20):
            rows, ids = [], []
            for r, text in enumerate(b.column(1).to_pylist()):
                t = np.append(encode(text), np.uint32(END_ID)).astype("<u4")
                for k, (s, n) in enumerate(pieces_of(len(t))):
                    rows.append((r, k, s, n, zlib.crc32(t[s:s + n].tobytes())))
                    if with_ids:
                        ids.append(t[s:s + n].astype(np.int32))
            a = np.array(rows, np.int64).reshape(-1, 5)
            cols = [b.column(0).take(pa.array(a[:, 0])), pa.array(a[:, 1].astype(np.int32)), *(pa.array(a[:, i]) for i in (2, 3, 4))]
            if with_ids:
                cols.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:len(cols)])
    return run


def token_pieces(docs: DataFrame, with_ids: bool = False, vocabulary: str = VOCABULARY,
                 ranks: str = RANKS) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32[, ids]``: each document's ids
    and the end id, cut only where longer than a sequence."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _tokenizer(vocabulary, ranks, with_ids),
        "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of every item, and the fill of every bin. Longest first;
    each goes to the fullest bin that still takes it."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets, fill = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    open_bins: dict[int, list[int]] = {}
    free = 0  # bit c: some bin has c left
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        fits = free >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                free ^= 1 << room
        else:
            b, room = len(fill), capacity
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        left = room - n
        if left:
            open_bins.setdefault(left, []).append(b)
            free |= 1 << left
    return bins, offsets, np.array(fill, np.int64)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """The best of the bounds that the dual-feasible functions u(k) after
    f(eps) give, for k = 1..20 and every eps up to half a bin: items above
    capacity - eps count as whole bins, items below eps as nothing, and the
    others by k-th steps (k = 0: by their length)."""
    if len(lengths) == 0:
        return 0
    x = np.arange(capacity + 1)
    count = np.bincount(lengths, minlength=capacity + 1)
    many = np.cumsum(count[::-1])[::-1]  # items of at least x
    eps = np.arange(1, capacity // 2 + 1)
    whole = np.append(many, 0)[capacity - eps + 1]
    best = 0
    for k in range(21):
        if k == 0:
            weight, unit = x, capacity
        else:
            steps, exact = (k + 1) * x // capacity, (k + 1) * x % capacity == 0
            # in units of 1 / (k * capacity): exact multiples keep their size
            weight, unit = np.where(exact, k * x, steps * capacity), k * capacity
        total = np.concatenate([[0], np.cumsum(count * weight)])
        between = total[capacity - eps + 1] - total[eps]
        best = max(best, int((whole + -(-between // unit)).max()))
    return best


PLACED = "uid long, length int, bin long, offset long, fill int, bins long, bound long, loose boolean"


def _pack_part(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
    """Packs one partition, certifies it, and marks the loosest bins of a
    partition with a gap."""
    lengths = p.length.to_numpy(np.int64)
    bins, offsets, fill = best_fit_decreasing(lengths)
    bound = lower_bound(lengths)
    loose = np.zeros(len(fill), bool)
    gap = len(fill) - bound
    if gap > 0:
        order = np.argsort(fill, kind="stable")
        room = np.cumsum(CAPACITY - fill[order])
        take = int(np.searchsorted(room, 8 * (gap + 1) * CAPACITY)) + 1
        loose[order[:max(take, 2 * gap)]] = True
    return pd.DataFrame({"uid": p.uid, "length": p.length, "bin": (int(key[0]) << 32) + bins, "offset": offsets,
                         "fill": fill[bins], "bins": len(fill), "bound": bound, "loose": loose[bins]})


def _packed(rows: DataFrame, seed: int) -> DataFrame:
    """One round: deal the rows into partitions and pack each."""
    n = rows.count()
    parts = max(1, -(-n // PART_ROWS))
    dealt = rows.select("uid", "length", F.pmod(F.xxhash64("uid", F.lit(seed)), F.lit(parts)).alias("part"))
    return stored(dealt.repartition(min(parts, MOST_TASKS), "part").groupBy("part").applyInPandas(_pack_part, PLACED), "packed")


def _bin_count(placed: DataFrame) -> int:
    """Bins in use; every bin has one item at offset 0."""
    return placed.filter("offset = 0").count()


def place(pieces: DataFrame) -> DataFrame:
    """``uid, sequence_id, offset`` for ``pieces (uid, length)``: distinct
    uids, lengths from 1 to CAPACITY. Full pieces are sequences of their own."""
    return _exchanged(pieces)[0]


def certificates(pieces: DataFrame) -> DataFrame:
    """``turn, part, bins, bound, exchanged``: how many sequences each partition
    took, how many its pieces need at least, and how many of its sequences went
    into the next turn. A partition with bins = bound is proven best."""
    return _exchanged(pieces)[1]


def _certified(placed: DataFrame, turn: int) -> DataFrame:
    return placed.filter("offset = 0").groupBy(F.shiftright("bin", 32).alias("part")).agg(
        F.max("bins").alias("bins"), F.max("bound").alias("bound"), F.count_if("loose").alias("loose")).select(
            F.lit(turn).alias("turn"), "part", "bins", "bound", "loose")


def _exchanged(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Places, and the certificates of all turns."""
    full = pieces.filter(F.col("length") == CAPACITY).select("uid", (-F.col("uid") - 1).alias("sequence_id"),
                                                             F.lit(0).cast("long").alias("offset"))
    now = _packed(pieces.filter(F.col("length") < CAPACITY).select("uid", F.col("length").cast("int").alias("length")), 0)
    done, turn, deal, idle = [], 0, 0, 0
    proofs = None
    while idle < PATIENCE:
        pool = now.filter("loose")
        before = _bin_count(pool)
        if before == 0:
            break
        deal += 1
        again = _packed(pool.select("uid", "length"), deal)
        if _bin_count(again) >= before:
            idle += 1  # another deal may still save some
            continue
        idle = 0
        done.append(now.filter("not loose").select("uid", F.lit(turn).alias("turn"), "bin", "offset"))
        proof = _certified(now, turn).withColumnRenamed("loose", "exchanged")
        proofs = proof if proofs is None else proofs.unionByName(proof)
        now, turn = again, turn + 1
    out = now.select("uid", F.lit(turn).alias("turn"), "bin", "offset")
    for d in done:
        out = out.unionByName(d)
    last = _certified(now, turn).withColumn("loose", F.lit(0).cast("long")).withColumnRenamed("loose", "exchanged")
    return full.unionByName(out.select(
        "uid", (F.shiftleft(F.col("turn").cast("long"), 56) + F.col("bin")).alias("sequence_id"), "offset")), (
            last if proofs is None else proofs.unionByName(last))


def pack_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``, one
    row per piece of ``docs (doc_id, text, ...)``."""
    rows = stored(token_pieces(docs).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    return rows.join(place(rows.select("uid", "length")), "uid").select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", F.col("offset").cast("long").alias("offset"))


def packed_sequences(docs: DataFrame) -> DataFrame:
    """``sequence_id, ids, doc_ids``: the token rows themselves. A sequence
    holds at most CAPACITY ids, so gathering one is bounded."""
    rows = stored(token_pieces(docs, with_ids=True).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    placed = rows.join(place(rows.select("uid", "length")), "uid")
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return placed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"),
        F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"))
