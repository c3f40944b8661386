"""Near-duplicate lines by a segment-partition edit join (operator 8).

Method: Pass-Join (Li et al., "Pass-Join: A Partition-based Method for
Similarity Joins", VLDB 2011). A line is cut into ``EDITS + 1`` even segments;
two lines within ``EDITS`` edits share one of them. Segments are indexed by
(length, segment number, content); a line probes the index with the substrings
that the multi-match-aware windows allow for each shorter length. Candidates
are verified by bit-parallel edit distance on a band of ``2 * EDITS + 1``
diagonals, after the common beginning and end have been cut off.

A document's lines are its text split at newlines, without blanks at either
end. Lines of ``MIN_CHARS`` code points or more take part, in any script and
with any or no blanks; shorter ones are always kept. Lines linked
directly or through others form a class, and only the first occurrence of a
class (smallest doc_id, then line number) stays.

Plan
1. (key, line) rows: 3 index and 12 probe keys a line at two edits, made from
   whole lines; a task drops lines that it has seen, so a line that a third of
   all documents share gives a few rows per task. One shuffle by key, sorted,
   then read as a stream: a key of any size needs no memory.
2. Keys with up to ``SMALL`` different lines give their candidate pairs. Larger
   ones only give (key, line) rows; such a unit is verified in pairs of blocks
   inside tasks, which emit link counts and joining links, never all pairs. A
   pair that several units share counts in the smallest only. Inside a block
   pair, lengths and counts of characters (which two edits change by four at
   most) rule out nearly all pairs in bulk before any is verified.
3. Components of the links, and one pass over the line occurrences.

Line identities are 63-bit hashes of whole lines. The texts of candidate
lines are fetched through their ids: broadcast when at most ``SMALL_IDS`` of
8 bytes, else by a shuffle join.

Defined cases: null texts have no lines; rows without ``doc_id`` are not
compared and stay as they are; rows that share a ``doc_id`` are one document.
``remove_repeated_lines`` takes out repeats of ``REMOVED_CHARS`` code points or
of ``MIN_WORDS`` words, as blanks count them; other repeats are reported only.
A document that loses all its lines is dropped by ``remove_repeated_lines``;
``n_chars``, if there is one, follows the text; other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import component_labels
from ..session import stored
from .common import batches, fresh_names, link_rows, mix64

EDITS = 2
MIN_CHARS = 6
REMOVED_CHARS = 20
MIN_WORDS = 5
SMALL = 12
BLOCK = 256
SMALL_IDS = 1_000_000
SEEN_LINES = 1 << 17
MOST_TASKS = 2000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2 ** 64."""
    p = _powers.get(int(base))
    if p is None or len(p) <= n:
        p = np.full(max(n + 1, 1 << 18), base)
        p[0] = 1
        _powers[int(base)] = p = np.cumprod(p, dtype=np.uint64)
    return p


def segments(n: np.ndarray, i: int, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of segment ``i`` of lines of ``n`` characters."""
    k = edits + 1
    short, longer = n // k, n % k  # the last `longer` segments have one more
    first_long = k - longer
    return i * short + np.maximum(i - first_long, 0), short + (i >= first_long)


def line_keys(lines: list[str], edits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the line, key, is it a probe) for all segments and substrings."""
    code = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = np.fromiter(map(len, lines), np.int64, len(lines))
    begin = np.concatenate([[0], np.cumsum(n)])[:-1]
    up, down = _power(_BASE, len(code)), _power(_BACK, len(code))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((code.astype(np.uint64) + np.uint64(1)) * up[:len(code)])])
    rows, keys, probes = [], [], []

    def add(row, start, size, length, i, probe):
        a = begin[row] + start
        h = (total[a + size] - total[a]) * down[a]
        keys.append(mix64(h + mix64((length * (edits + 1) + i).astype(np.uint64))).view(np.int64))
        rows.append(row)
        probes.append(np.full(len(row), probe))

    every = np.arange(len(lines))
    for i in range(edits + 1):
        start, size = segments(n, i, edits)
        add(every, start, size, n, i, False)
        for less in range(edits + 1):
            row = np.flatnonzero(n - less > edits)
            start, size = segments(n[row] - less, i, edits)
            for shift in range(max(-i, less - (edits - i)), min(i, less + edits - i) + 1):
                ok = (start + shift >= 0) & (start + shift + size <= n[row])
                add(row[ok], start[ok] + shift, size[ok], n[row[ok]] - less, i, True)
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(probes)


def _key_rows(edits: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches(it, 1 << 20):
            ids, lines = [], []
            for h, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if h not in seen:
                    if len(seen) >= SEEN_LINES:
                        seen.clear()
                    seen.add(h)
                    ids.append(h), lines.append(line)
            if lines:
                row, key, probe = line_keys(lines, edits)
                x = np.array(ids, np.int64)[row] | probe  # ids are even: the last bit says probe
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(x)], names=["key", "x"])
    return run


def _matches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (key, x) rows sorted by key: candidate pairs of small keys, and the
    members of large ones (b is null)."""
    key, tail, large = None, [], False  # the lines of a key that may go on; large: some have left already

    def close(out):
        index = {x & ~1 for x in tail if not x & 1}
        probe = {x & ~1 for x in tail if x & 1}
        if large or len(index | probe) > SMALL and index and probe:
            out += [(key, i, None) for i in index | probe]
        else:
            out += [(key, min(i, p), max(i, p)) for i in index for p in probe if i != p]

    for b in it:
        if b.num_rows == 0:
            continue
        out: list[tuple[int, int, int | None]] = []
        k, x = b.column(0).to_numpy(), b.column(1).to_numpy()
        edge = np.concatenate([[0], np.flatnonzero(np.diff(k)) + 1, [len(k)]])
        several = np.diff(edge) > 1
        several[0] = several[-1] = True  # may go on in the next batch
        for r in np.flatnonzero(several):
            s, e = edge[r], edge[r + 1]
            if key is not None and int(k[s]) != key:
                close(out)
                tail, large = [], False
            key = int(k[s])
            tail += set(x[s:e].tolist())
            if len(tail) > 4 * SMALL:
                tail = list(set(tail))
                if len(tail) > 8192:  # a very large key: its lines leave as they come
                    out += [(key, i & ~1, None) for i in tail]
                    tail, large = [], True
        yield _match_rows(out)
    out = []
    if key is not None:
        close(out)
    yield _match_rows(out)


def _match_rows(out) -> pa.RecordBatch:
    a = list(zip(*out)) if out else [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in a], names=["unit", "a", "b"])


def within(a: str, b: str, edits: int) -> bool:
    """Is the edit distance of two lines at most ``edits``? Bit-parallel over a
    diagonal band (Hyyrö, "A Bit-Vector Algorithm for Computing Levenshtein and
    Damerau Edit Distances", 2003), with an early end."""
    if abs(len(a) - len(b)) > edits:
        return False
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:  # length of the common beginning
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    a, b = a[lo:], b[lo:]
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:  # of the common end
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[len(a) - mid:len(a) - lo] == b[len(b) - mid:len(b) - lo] else (lo, mid - 1)
    a, b = a[:len(a) - lo], b[:len(b) - lo]
    if min(len(a), len(b)) == 0:
        return max(len(a), len(b)) <= edits
    if len(a) > len(b):
        a, b = b, a
    # Column j (a character of b) holds rows j - edits .. j + edits of a in a
    # band of bits; vp / vn are the vertical +1 / -1 differences.
    width = 2 * edits + 1
    full = (1 << width) - 1
    m = len(a)
    vp, vn, score = full & ~((1 << edits) - 1), 0, min(m, edits)
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | (1 << i)
    for j, c in enumerate(b):
        p = places.get(c, 0)
        low = j - edits
        eq = (p >> low if low >= 0 else p << -low) & full
        d0 = (((eq & vp) + vp) ^ vp) | eq | vn
        hp = vn | ~(d0 | vp)
        hn = vp & d0
        # the band moves down one row, so the score follows its lowest diagonal
        if j + edits < m:
            score += 0 if d0 >> (width - 1) & 1 else 1
        else:
            bit = width - 1 - (j + edits - (m - 1))
            score += (hp >> bit & 1) - (hn >> bit & 1)
        vp = (hn | ~((d0 >> 1) | hp)) & full
        vn = (hp & (d0 >> 1)) & full
        if score > 2 * edits + (len(b) - j):
            return False
    return score <= edits


def _verify(edits: int):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            ok = [within(x, y, edits) for x, y in zip(p.ta, p.tb)]
            yield p.loc[np.array(ok, bool), ["a", "b"]]
    return run


COUNTED = 64


def char_counts(lines: list[str]) -> np.ndarray:
    """Characters of each line by code point modulo COUNTED. One edit changes
    two counts by one at most, so lines within k edits differ by 2 k in sum."""
    out = np.zeros((len(lines), COUNTED), np.int16)
    for i, t in enumerate(lines):
        c = np.bincount(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) % COUNTED, minlength=COUNTED)
        out[i] = np.minimum(c, 30_000)      # cut counts differ by no more than whole ones
    return out


def unit_links(edits: int):
    """For one large key's pair of blocks: the number of links of each line,
    counted where the key is the smallest that both lines share, and links that
    join two of the block's components (b is null in a count)."""
    def run(p: pd.DataFrame) -> pd.DataFrame:
        unit = p.unit.iloc[0]
        ids, text, units = p.id.to_list(), p.line.to_list(), [set(u) for u in p.units]
        size = p.line.map(len).to_numpy()
        asks, data = np.flatnonzero(p.asks.to_numpy()), np.flatnonzero(~p.asks.to_numpy())
        root = {i: i for i in ids}
        links: dict[int, int] = {}

        def top(c):
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        out = []
        counts = char_counts(text)
        for i in asks:
            near = data[np.abs(size[data] - size[i]) <= edits]
            near = near[np.abs(counts[near] - counts[i]).sum(1, dtype=np.int32) <= 2 * edits]
            for k in near:
                a, b = ids[i], ids[k]
                if a == b or min(units[i] & units[k]) != unit or not within(text[i], text[k], edits):
                    continue
                links[a] = links.get(a, 0) + 1
                x, y = top(a), top(b)
                if x != y:
                    root[max(x, y)] = min(x, y)
                    out.append((a, b, 0))
        out += [(a, None, n) for a, n in links.items()]
        return link_rows(out)
    return run


def document_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, line, text, id`` for each line; ``id`` is null for empty lines."""
    d = docs.filter("doc_id is not null and text is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("line", "text"))
    d = d.withColumn("text", F.trim("text"))
    return d.withColumn("id", F.when(F.col("text") != "", F.xxhash64("text").bitwiseAND(F.lit(-2))))


def link_lines(lines: DataFrame, edits: int = EDITS) -> tuple[DataFrame, DataFrame]:
    """(links ``a, b`` that span every class of near-equal lines, counts ``id,
    n_links``) of ``lines (id, text)``."""
    lines = lines.filter(F.char_length("text") >= MIN_CHARS)
    rows = lines.filter("id is not null").select("id", "text").mapInArrow(_key_rows(edits), "key long, x long")
    found = stored(rows.repartition("key").sortWithinPartitions("key").mapInArrow(_matches, "unit long, a long, b long"),
                   "matches")
    pairs = found.filter("b is not null").select("a", "b").distinct()
    units = stored(found.filter("b is null").select("unit", F.col("a").alias("id")).distinct(), "units")
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).unionByName(units.select("id")).distinct(), "ids")
    ids = F.broadcast(ids) if ids.count() <= SMALL_IDS else ids
    texts = stored(lines.select("id", "text").join(ids, "id", "left_semi").groupBy("id").agg(
        F.first("text").alias("text")), "lines")
    of = units.groupBy("id").agg(F.collect_set("unit").alias("units"))  # a line has 15 keys at most
    known = stored(texts.join(of, "id", "left"), "lines")
    side = lambda c: known.select(F.col("id").alias(c), F.col("text").alias(f"t{c}"), F.col("units").alias(f"u{c}"))
    apart = pairs.join(side("a"), "a").join(side("b"), "b").filter(
        ~F.coalesce(F.arrays_overlap("ua", "ub"), F.lit(False)))
    small = stored(apart.select("a", "b", "ta", "tb").mapInPandas(_verify(edits), "a long, b long"), "links")
    size = units.groupBy("unit").agg(F.count(F.lit(1)).alias("k")).withColumn(
        "blocks", F.greatest(F.lit(1), F.ceil(F.col("k") / BLOCK)).cast("int"))
    member = units.join(size.drop("k"), "unit")
    key = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    placed = (member.withColumns({"i": key, "j": each, "asks": F.lit(True)})
              .unionByName(member.withColumns({"j": key, "i": each, "asks": F.lit(False)}))
              .join(known.withColumnRenamed("text", "line"), "id"))
    # a fixed number of tasks: the rows are few and small, the work on each block pair is not
    work = size.agg(F.sum(F.col("k") * F.col("blocks"))).first()[0] or 1
    dealt = placed.repartition(max(1, min(int(work) // BLOCK, MOST_TASKS)), "unit", "i", "j")
    large = stored(dealt.groupBy("unit", "i", "j").applyInPandas(unit_links(edits), "a long, b long, n long"), "links")
    links = small.unionByName(large.filter("b is not null").select("a", "b"))
    counts = (small.select(F.explode(F.array("a", "b")).alias("id"), F.lit(1).cast("long").alias("n"))
              .unionByName(large.filter("b is null").select(F.col("a").alias("id"), "n"))
              .groupBy("id").agg(F.sum("n").alias("n_links")))
    return links, counts


def classify_lines(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """``doc_id, line, first_doc_id, first_line, n_links, kept``: one row per
    line; the class is named by its first occurrence, ``n_links`` counts the
    other line texts within ``edits`` edits."""
    lines = document_lines(docs)
    links, counts = link_lines(lines, edits)
    # written tables on both sides of the joins below, so that adaptive execution may split a hot class or line
    label = stored(component_labels(links).withColumnRenamed("node", "id"), "labels")
    occurrences = stored(lines.select("doc_id", "line", "id"), "occurrences")
    named = (occurrences.filter("id is not null").join(label, "id", "left")
             .withColumn("class", F.coalesce("component", "id")))
    first = stored(named.groupBy("class").agg(F.min(F.struct("doc_id", "line")).alias("first"), F.count(F.lit(1)).alias("k")), "first")
    counts = stored(counts, "counts")
    # a class of one occurrence needs no join
    many = named.join(first.filter("k > 1"), "class").join(counts, "id", "left").select(
        "doc_id", "line", "first", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    alone = first.filter("k = 1").select("first.doc_id", "first.line", "first", F.lit(0).cast("long").alias("n_links"))
    short = occurrences.filter("id is null").select(
        "doc_id", "line", F.struct("doc_id", "line").alias("first"), F.lit(0).cast("long").alias("n_links"))
    return many.unionByName(alone).unionByName(short).select(
        "doc_id", F.col("line").cast("int").alias("line"), F.col("first.doc_id").alias("first_doc_id"),
        F.col("first.line").cast("int").alias("first_line"), "n_links",
        (F.struct("doc_id", "line") == F.col("first")).alias("kept"))


def _removable(line):
    """Is a line long enough to go when it repeats another one?"""
    t = F.trim(line)
    return (F.char_length(t) >= REMOVED_CHARS) | (F.char_length(t) - F.char_length(F.replace(t, F.lit(" "))) >= MIN_WORDS - 1)


def _without(lines, gone):
    """The lines without the removable ones among those numbered in ``gone``."""
    out_of = F.filter(gone, lambda i: _removable(F.element_at(lines, i + 1)))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), out_of)
    return F.transform(left, lambda i: F.element_at(lines, i + 1))


def remove_repeated_lines(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """``docs`` without the long lines that repeat an earlier one, columns unchanged."""
    by, gone, rest = fresh_names(docs, "_doc", "_gone", "_rest")
    repeats = classify_lines(docs, edits).filter("not kept").groupBy(F.col("doc_id").alias(by)).agg(
        F.collect_list("line").alias(gone))  # at most a document's own lines
    kept = docs.join(repeats, F.col("doc_id").cast("long") == F.col(by), "left")
    # the text is split once, and its lines are a variable of the expression; gone lines leave by hash, not line by line
    held = F.transform(F.array(F.split("text", "\n")), lambda lines: _without(lines, F.col(gone)))[0]
    touched = F.col(gone).isNotNull() & F.col("text").isNotNull()
    out = kept.withColumn(rest, F.when(touched, held)).filter(F.col(rest).isNull() | (F.size(rest) > 0))
    text = F.when(F.col(rest).isNotNull(), F.array_join(rest, "\n")).otherwise(F.col("text"))
    cols = []
    for f in docs.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name == "text":
            c = text
        elif f.name == "n_chars":
            c = F.when(F.col(rest).isNotNull(), F.char_length(text)).otherwise(c).cast(f.dataType)
        cols.append(c.alias(f.name))
    return out.select(*cols)
