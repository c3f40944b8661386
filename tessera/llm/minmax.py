"""Near-duplicate documents by min-max hashing (operator 5).

Method: min-max hash (Ji et al., "Min-Max Hash for Jaccard Similarity", ICDM
2013). Each of ``PERMUTATIONS`` hash permutations gives two signature values,
the minimum and the maximum over a document's shingles, so 40 evaluations
yield 80 values whose agreement is an unbiased estimate of the Jaccard
similarity, with less variance than 80 minima. The values are banded; equal
bands make candidates; every link is confirmed on the full shingle sets.

Plan
1. One pass over the texts: set size, digest of the sorted set, bands, and one
   byte of each signature value.
2. Documents with equal sets form a class (partial aggregation, so a set that
   a third of all rows share costs one row per task); only the smallest id of
   a class goes on.
3. The full sets of documents that share a bucket are written once.
4. Stars: every bucket proposes (smallest member, other member), never all
   pairs. The signature bytes drop hopeless pairs; the rest is verified on
   full sets with ``array_intersect``.
5. Buckets whose members are not all in one component yet are finished in
   blocks: a task holds two blocks of members with their sets, and counts the
   common shingles of each member outside the main component with all others
   through an inverted index. It emits only links that join two components, at
   most one row per component, so nothing grows with the square of a group,
   and no link between different sets is lost.
6. Class membership and components give one row per input row.

With 20 bands of 4 values a pair of similarity 0.85 shares no bucket with
probability (1 - 0.85**4)**20 = 4e-7, one of 0.8 with 3e-5. A star pair is
dropped before verification when fewer than 55 % of its signature bytes agree,
over five standard deviations below 0.8; its bucket is then looked at again in
step 5 without the signature.

Defined cases: null and wordless texts have an empty set, link with nothing and
are kept. Rows without ``doc_id`` link with nothing and are kept
(``component_id`` null). Rows that share a ``doc_id`` are one document, whose
links are those of all its rows; every input row gives one output row. An
empty table gives an empty result. Other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import component_labels
from ..session import stored
from .common import SPACED_WORDS, batches, mix64, words


SHINGLE = 5
PERMUTATIONS = 40
BANDS = 20
MIN_AGREEMENT = 0.55
BLOCK = 256
#: members of neighbouring buckets are finished together up to this number;
#: beyond it every bucket is a unit of its own
UNIT_ROWS = 8192
#: pairs that may be broadcast (16 bytes each)
SMALL_PAIRS = 250_000
#: wanted ids that may be broadcast (8 bytes each)
SMALL_IDS = 1_000_000
WORD_CACHE = 1 << 17

_RNG = np.random.default_rng(20240917)
_MUL = _RNG.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
_POS = _RNG.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _WordHash(dict):
    """Word -> 64-bit hash, computed once per word; emptied when it grows large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, cache: _WordHash, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text; with
    fewer than ``size`` words the whole sequence is the one shingle."""
    w = words(text, SPACED_WORDS)
    n = len(w)
    if n == 0:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, w), np.uint64, n)
    k = min(n, size)
    acc = np.full(n - k + 1, np.uint64(k))
    for j in range(k):
        acc += h[j:n - k + 1 + j] * _POS[j]
    return np.unique(mix64(acc))


def signature(s: np.ndarray) -> np.ndarray:
    """Minima, then maxima, of a non-empty set under every permutation."""
    low = np.empty(PERMUTATIONS, np.uint64)
    high = np.empty(PERMUTATIONS, np.uint64)
    for i in range(0, len(s), 4096):  # long texts: bounded working memory
        v = s[None, i:i + 4096] * _MUL[:, None] + _ADD[:, None]
        a, b = v.min(1), v.max(1)
        low, high = (a, b) if i == 0 else (np.minimum(low, a), np.maximum(high, b))
    return np.concatenate([low, high])


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, -1)
    mul = _MUL[:rows.shape[1]]
    return mix64((mix64(rows) * mul).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


SIG_SCHEMA = "doc_id long, n_shingles long, digest binary, bands array<long>, sig binary"


def _signatures(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = _WordHash()
    for b in batches(it, 4 << 20):
        ids, n, digest, bands, sigs = b.column(0), [], [], [], []
        for text in b.column(1).to_pylist():
            s = shingle_set(text, cache)
            n.append(len(s))
            if len(s) == 0:
                digest.append(None), bands.append(None), sigs.append(None)
                continue
            sig = signature(s)
            digest.append(xxhash.xxh3_128_digest(s.tobytes()))
            bands.append(band_keys(sig))
            sigs.append(mix64(sig).astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(n, pa.int64()), pa.array(digest, pa.binary()),
             pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
            names=["doc_id", "n_shingles", "digest", "bands", "sig"])


def _sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = _WordHash()
    for b in batches(it, 4 << 20):
        sets = [shingle_set(t, cache).view(np.int64) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "s"])


def _agreement(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in it:
        x = np.frombuffer(b"".join(p.sig_a), np.uint8).reshape(len(p), -1)
        y = np.frombuffer(b"".join(p.sig_b), np.uint8).reshape(len(p), -1)
        yield p.loc[(x == y).mean(1) >= MIN_AGREEMENT, ["a", "b"]] if len(p) else p[["a", "b"]]


def _similar_sizes(a: str, b: str, percent: int):
    return (F.col(a) * 100 >= F.col(b) * percent) & (F.col(b) * 100 >= F.col(a) * percent)


def _verified(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets satisfy 100 * |A & B| >= percent * |A | B|.
    Each pair fetches its two sets; a set that many pairs want is no hot key,
    because the halves meet on the pair."""
    few = pairs.count() <= SMALL_PAIRS
    side = lambda c: (F.broadcast(pairs) if few else pairs.hint("merge")).join(
        sets.select(F.col("id").alias(c), F.col("s").alias(f"s{c}")), c)
    both = side("a").hint("merge").join(side("b"), ["a", "b"])
    common = F.size(F.array_intersect("sa", "sb"))
    return both.filter(common * 100 >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def join_components(percent: int):
    """For one unit's pair of blocks: links that join different components."""
    def find(p: pd.DataFrame) -> pd.DataFrame:
        ids, comp = p.id.to_numpy(), p.comp.to_numpy()
        size = p.s.map(len).to_numpy()
        asks = p.asks.to_numpy()
        root = {c: c for c in comp.tolist()}

        def top(c):
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        _, column = np.unique(np.concatenate(p.s.to_list()), return_inverse=True)
        begin = np.concatenate([[0], np.cumsum(size)])
        data = np.flatnonzero(~asks)
        where = np.concatenate([column[begin[k]:begin[k + 1]] for k in data])
        edge = np.concatenate([[0], np.cumsum(size[data])])[:-1]
        mark = np.zeros(column.max() + 1, np.int64)
        out = []
        for i in np.flatnonzero(asks):
            own = column[begin[i]:begin[i + 1]]
            mark[own] = 1
            common = np.add.reduceat(mark[where], edge)
            mark[own] = 0
            for k in data[100 * common >= percent * (size[data] + size[i] - common)]:
                a, b = top(comp[i]), top(comp[k])
                if a != b:
                    root[max(a, b)] = min(a, b)
                    out.append((ids[i], ids[k]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    def run(p: pd.DataFrame) -> pd.DataFrame:
        if p.asks.all() or not p.asks.any():
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        return find(p)
    return run


def _finish(members: DataFrame, links: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different components of one bucket."""
    labels = component_labels(links)
    m = stored(members.join(labels.select(F.col("node").alias("id"), "component"), "id", "left")
               .select("band", "id", F.coalesce("component", "id").alias("comp")), "members")
    open_ = m.groupBy("band").agg(F.min("comp").alias("x"), F.max("comp").alias("y"),
                                  F.min("id").alias("low")).filter("x < y").select("band", "low")
    m = stored(m.join(open_, "band"), "members")
    unit = component_labels(m.filter("id > low").select(F.col("id").alias("a"), F.col("low").alias("b")))
    m = m.join(unit.select(F.col("node").alias("id"), F.col("component").alias("unit")), "id")
    # the small sides of the joins on units are written tables, so that adaptive execution may split a hot unit
    m = stored(m, "members")
    large = stored(m.groupBy("unit").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > UNIT_ROWS * BANDS), "large")
    m = m.join(large.withColumnRenamed("k", "_k"), "unit", "left").withColumn(
        "unit", F.when(F.col("_k").isNull(), F.col("unit")).otherwise(F.xxhash64("band")))
    m = stored(m.select("unit", "id", "comp").distinct(), "units")
    top = (m.groupBy("unit", "comp").agg(F.count(F.lit(1)).alias("k")).groupBy("unit")
            .agg(F.max(F.struct("k", "comp")).alias("t"), F.sum("k").alias("size"))
            .select("unit", F.col("t.comp").alias("main"), "size", (F.col("size") - F.col("t.k")).alias("apart")))
    rows = m.join(stored(top, "units"), "unit")
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / BLOCK)).cast("int")
    key = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    data = rows.withColumns({"j": (key % blocks("size")).cast("int"),
                             "i": F.explode(F.sequence(F.lit(0), blocks("apart") - 1)), "asks": F.lit(False)})
    asks = rows.filter("comp != main").withColumns(
        {"i": (key % blocks("apart")).cast("int"),
         "j": F.explode(F.sequence(F.lit(0), blocks("size") - 1)), "asks": F.lit(True)})
    cols = ["unit", "i", "j", "id", "comp", "asks"]
    placed = data.select(cols).unionByName(asks.select(cols)).join(sets.hint("merge"), "id")
    return placed.groupBy("unit", "i", "j").applyInPandas(join_components(percent), "a long, b long")


def link_documents(docs: DataFrame, percent: int = 85) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of
    ``docs (doc_id, text, ...)``; links are pairs of sets with
    100 * intersection >= ``percent`` * union (see the module docstring)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sigs = stored(docs.mapInArrow(_signatures, SIG_SCHEMA), "signatures")
    full = sigs.filter("n_shingles > 0 and doc_id is not null")
    reps = stored(full.groupBy("digest").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"),
        F.first("sig").alias("sig")), "classes")
    # a digest's documents, linked to the class's smallest id; only real copies give a row
    copies = (full.select("doc_id", "digest").join(reps.select("digest", "rep"), "digest")
                  .filter("doc_id != rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))
    banded = reps.select(F.col("rep").alias("id"), F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("id").alias("a"), F.max("id").alias("z"),
                                         F.count(F.lit(1)).alias("k")).filter("k > 1 and a < z")
    buckets = stored(buckets, "buckets")
    shared = banded.join(buckets.select("band", "a"), "band")
    members = stored(shared.select("band", "id", "a"), "members")
    wanted = stored(members.select(F.col("id").alias("doc_id")).distinct(), "wanted")
    # few wanted ids go to the texts; many meet them in a shuffle
    some = (docs.join(F.broadcast(wanted), "doc_id", "left_semi") if wanted.count() <= SMALL_IDS
            else docs.hint("merge").join(wanted, "doc_id", "left_semi"))
    sets = stored(some.select("doc_id", "text").mapInArrow(_sets, "id long, s array<long>"), "sets")
    half = lambda side: reps.select(F.col("rep").alias(side), F.col("sig").alias(f"sig_{side}"),
                                    F.col("n_shingles").alias(f"n_{side}"))
    stars = members.filter("id > a").select("a", F.col("id").alias("b")).distinct()
    near = (stars.join(half("b"), "b").join(half("a"), "a").filter(_similar_sizes("n_a", "n_b", percent))
                 .select("a", "b", "sig_a", "sig_b").mapInPandas(_agreement, "a long, b long"))
    links = stored(_verified(sets, stored(near, "candidates"), percent), "links")
    links = stored(links.unionByName(_finish(members.select("band", "id"), links, sets, percent)), "links")
    # one pass of components over classes and copies together
    final = component_labels(links.unionByName(copies))
    out = sigs.select("doc_id", "n_shingles").join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    comp = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", comp.alias("component_id"),
                      F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept"))
