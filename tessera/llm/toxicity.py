"""Toxicity scores on deobfuscated text (operator 3).

Method: a noisy channel. Spans that may be obfuscated (leetspeak inside a word,
letters set apart one by one, letters repeated three times or more) become
character lattices: each place lists what may have been meant, with the
channel's cost. A Viterbi search finds the most likely reading under a
character trigram model counted over the whole corpus. The restored text is
then scored by a logistic model of its words and word beginnings.

Everything outside such spans has a lattice with a single path, so it is left
as it is without a search; equal spans are decoded once per task.

Passes: (1) trigram counts over all documents, partial sums per task, at most
64**3 rows; (2) a bounded sample of labelled rows (``MAX_POSITIVE`` and
``MAX_NEGATIVE``, smallest hashes of doc_id) is restored; features are counted
by class in Spark, at most ``MAX_FEATURES`` of those that speak for toxicity
are kept, and the driver fits the model on the sample's rows of kept features;
(3) one pass that scores all documents. No text but the sample is shuffled. Labels are used for fitting only, and only those of rows whose
crc32(doc_id as text) mod 3 is not 1; language, source and ids are no inputs.

Defined cases: null and empty texts get the score of a text without features;
rows without ``doc_id`` are scored, never trained on and not held out; several
labels of an id count as toxic if any does; without labels of both classes all
scores are equal. Empty tables give empty results; other columns are kept as
they are by ``remove_toxic``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored
from .common import PLAIN_WORDS, batches, fresh_names

MAX_POSITIVE = 4000
MAX_NEGATIVE = 8000
MAX_FEATURES = 20_000
#: least surplus of a feature in toxic rows, in standard deviations
EVIDENCE = 3.0
THRESHOLD = 0.7
CACHE = 1 << 17
PREFIXES = (4, 5, 6)

# What a sign may stand for in leetspeak.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
        "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "*": "aeiou"}

#: cost (negative log probability) of a substituted sign, of keeping a sign as
#: it is, of a separator that is a real word break, and of a doubled letter
SUBSTITUTED, KEPT, BREAK, DOUBLED = 1.0, 4.0, 3.0, 0.5

N_CLASS = 64
OTHER_LETTER, DIGIT, SYMBOL = 59, 60, 61


def _char_classes() -> np.ndarray:
    """Code point -> class: 0 blank or sentence sign, 1-26 a-z, 27-58 the lower-case
    letters of Latin-1, other letters, digits, other signs."""
    t = np.full(0x251, OTHER_LETTER, np.uint8)
    t[:0x100] = SYMBOL
    for c in " \t\n\r\x0b\x0c.,;:?\"'()-\x00":
        t[ord(c)] = 0
    for c in range(0x30, 0x3A):
        t[c] = DIGIT
    for k in range(26):
        t[0x61 + k] = t[0x41 + k] = 1 + k
    for c in range(0xDF, 0x100):
        t[c] = 27 + (c - 0xDF) % 32
    t[0xC0:0xDF] = t[0xE0:0xFF]
    return t


CLASSES = _char_classes()


def classes_of(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return CLASSES[np.minimum(code, 0x250)]


def _trigrams(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(N_CLASS ** 3, np.int64)
    for b in batches(it, 1 << 20):
        c = classes_of("\x00\x00".join(["", *(t for t in b.column(0).to_pylist() if t), ""]))
        c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])].astype(np.int32) if len(c) else c
        if len(c) > 2:
            total += np.bincount((c[:-2] * N_CLASS + c[1:-1]) * N_CLASS + c[2:], minlength=len(total))
    key = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(total[key])], names=["key", "n"])


def trigram_costs(docs: DataFrame) -> np.ndarray:
    """Costs of a character class after two others, interpolated with bigrams
    and single classes; counted over the whole texts of all documents."""
    # at most N_CLASS ** 3 rows, whatever the corpus
    rows = docs.select("text").mapInArrow(_trigrams, "key int, n long").groupBy("key").agg(F.sum("n").alias("n"))
    n3 = np.zeros(N_CLASS ** 3)
    for r in rows.collect():
        n3[r.key] = r.n
    n3 = n3.reshape(N_CLASS, N_CLASS, N_CLASS)
    n2 = n3.sum(0)
    p1 = (n2.sum(0) + 1) / (n2.sum() + N_CLASS)
    p2 = (n2 + 5 * p1) / (n2.sum(1, keepdims=True) + 5)
    p3 = (n3 + 5 * p2[None]) / (n3.sum(2, keepdims=True) + 5)
    return -np.log(p3).astype(np.float32)


# --- the channel --------------------------------------------------------------------------------

def _kinds() -> bytes:
    """Byte classes for finding spans: a letter, 1 a sign that may stand for a
    letter, 2 such a sign that is common punctuation, blank, '.' a separator,
    ',' anything else."""
    t = bytearray(b"," * 256)
    for c in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
        t[c] = ord("a")
    for c in range(0xC0, 0x100):
        t[c] = ord("a")
    for c in LEET:
        if ord(c) < 128:
            t[ord(c)] = ord("2" if c in "!+|*" else "1")
    for c in b" \t\n":
        t[c] = ord(" ")
    for c in b".-_":
        t[c] = ord(".")
    return bytes(t)


KINDS, TAILS = _kinds(), bytes(range(0x80, 0xC0))
#: a word with a sign before, between or behind letters (punctuation behind a
#: word is none); letters standing alone in a row
_MIXED = re.compile(rb"[a12]*(?:[12]a|a2*1)[a12]*")
_APART = re.compile(rb"(?<![a12])[a12](?:[ .][a12]){2,}(?!2*[a1])")
#: a word of signs alone, no amount of money
_SIGNS = re.compile(r"(?<![^\W_])(?=[0-9$!+|*]*[@$])(?!\$+[0-9]*(?![0-9@$!+|*])|[0-9]+\$+(?![0-9@$!+|*]))[0-9@$!+|*]{2,}(?![^\W_])")
#: every match of _APART, with what is before it, holds this once _PLACES has been applied
_PLACES, _THREE = bytes(ord("x") if c in b"a12" else ord(".") for c in range(256)), b".x.x.x"


def suspicious_spans(text: str) -> list[tuple[int, int]]:
    """Code point ranges, apart from each other, that may be obfuscated."""
    raw = text.encode("utf-8", "surrogatepass")
    kind = raw.translate(KINDS, TAILS)  # one byte per code point
    found = []
    if b"1a" in kind or b"2a" in kind or b"a1" in kind or b"a2" in kind:
        found += [m.span() for m in _MIXED.finditer(kind)]
    if _THREE in b".%b" % kind.translate(_PLACES):
        found += [m.span() for m in _APART.finditer(kind)]
    if "@" in text or "$" in text:
        found += [m.span() for m in _SIGNS.finditer(text)]
    a = np.frombuffer(raw, np.uint8) if len(raw) == len(text) else np.frombuffer(
        text.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = np.frombuffer(kind, np.uint8) == 0x61
    if len(a) > 2:
        r = (a[2:] == a[1:-1]) & (a[1:-1] == a[:-2]) & (a[2:] >= 0x41)
        if r.any():
            for m in re.finditer(r"[^\W\d_]*?([^\W\d_])\1\1[^\W\d_]*", text):
                if letter[m.start():m.end()].all():
                    found.append(m.span())
    if len(found) < 2:
        return found
    found.sort()
    out = [found[0]]
    for s, e in found[1:]:
        if s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def lattice(span: str) -> list[list[tuple[str, float]]]:
    """For each place of a lower-cased span, the readings and their costs."""
    apart = len(span) > 4 and all(not c.isalnum() and c not in LEET for c in span[1::2])
    out, i = [], 0
    while i < len(span):
        c, j = span[i], i + 1
        while j < len(span) and span[j] == c:
            j += 1
        if apart and i % 2 and j == i + 1:
            out.append([("", 0.0), (" ", BREAK)])
        elif c in LEET:
            for _ in range(j - i):
                out.append([(x, SUBSTITUTED) for x in LEET[c]] + [(c, KEPT)])
        elif c.isalpha() and j - i >= 3:
            out.append([(c, 0.0), (c + c, DOUBLED)])
        else:
            out += [[(c, 0.0)]] * (j - i)
        i = j
    return out


def viterbi(places: list[list[tuple[str, float]]], cost: np.ndarray) -> str:
    """The cheapest reading; the state is the classes of the last two characters."""
    best: dict[tuple[int, int], tuple[float, object]] = {(0, 0): (0.0, None)}
    for alternatives in places:
        step: dict[tuple[int, int], tuple[float, object]] = {}
        for (u, v), (paid, path) in best.items():
            for reading, price in alternatives:
                x, y, total = u, v, paid + price
                for ch in reading:
                    z = int(CLASSES[min(ord(ch), 0x250)])
                    total += float(cost[x, y, z])
                    x, y = y, z
                old = step.get((x, y))
                if old is None or total < old[0]:
                    step[x, y] = (total, (path, reading) if reading else path)
        best = step
    total, path = min(((paid + float(cost[u, v, 0]), path) for (u, v), (paid, path) in best.items()),
                      key=lambda t: t[0])
    out = []
    while path is not None:
        path, reading = path
        out.append(reading)
    return "".join(reversed(out))


class Restorer:
    """Text to restored, lower-cased text; equal spans are decoded once."""

    def __init__(self, cost: np.ndarray):
        self.cost, self.seen = cost, {}

    def __call__(self, text: str | None) -> str:
        if not text:
            return ""
        spans = suspicious_spans(text)
        if not spans:
            return text.lower()
        out, at = [], 0
        for s, e in spans:
            span = text[s:e].lower()
            read = self.seen.get(span)
            if read is None:
                if len(self.seen) >= CACHE:
                    self.seen.clear()
                read = self.seen[span] = viterbi(lattice(span), self.cost)
            out += [text[at:s].lower(), read]
            at = e
        out.append(text[at:].lower())
        return "".join(out)


# --- the scorer ---------------------------------------------------------------------------------

def word_features(word: bytes) -> list[int]:
    """Hashes of a word and of its beginnings; the kind is part of the hash."""
    return [xxhash.xxh3_64_intdigest(word) >> 1] + [
        xxhash.xxh3_64_intdigest(word[:k], seed=k) >> 1 for k in PREFIXES if len(word) >= k]


def _restored(cost):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = Restorer(cost.value)
        for b in batches(it):
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([restore(t) for t in b.column(1).to_pylist()], pa.string())], names=["y", "text"])
    return run


def row_features(text: str) -> np.ndarray:
    """Feature ids of a restored text: those of each distinct word."""
    found: list[int] = []
    for w in set(text.encode("utf-8", "surrogatepass").translate(PLAIN_WORDS).split()):
        found += word_features(w)
    return np.array(found, np.int64)


def _class_counts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches(it, 4 << 20):
        rows = [row_features(t) for t in b.column(1).to_pylist()]
        y = np.repeat(b.column(0).to_numpy(), [len(r) for r in rows])
        f, at = np.unique(np.concatenate(rows) if rows else np.zeros(0, np.int64), return_inverse=True)
        toxic = np.bincount(at, weights=y, minlength=len(f)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(toxic), pa.array(np.bincount(at, minlength=len(f)))],
                                         names=["f", "toxic", "n"])


def _kept_features(kept):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 4 << 20):
            rows = [r[np.isin(r, kept.value)] for r in map(row_features, b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.int64()))], names=["y", "f"])
    return run


def fit_logistic(y: np.ndarray, size: np.ndarray, feature: np.ndarray, l1: float = 5e-5, rounds: int = 300
                 ) -> tuple[float, dict[int, float]]:
    """L1-penalised logistic regression by accelerated proximal gradient on
    rows of feature ids (``size`` of them each). The intercept speaks for rows
    without features."""
    if len(y) == 0 or y.min() == y.max():
        p = (y.sum() + 0.5) / (len(y) + 1.0)
        return math.log(p / (1 - p)) if len(y) else 0.0, {}
    ids, column = np.unique(feature, return_inverse=True)
    row = np.repeat(np.arange(len(y)), size)
    d, n = len(ids), len(y)
    w, z, b, zb, t = np.zeros(d), np.zeros(d), 0.0, 0.0, 1.0
    # each feature has its own step: a bound of its share of the curvature
    per_row = np.bincount(row, minlength=n).astype(float) + 1
    step = 4.0 * n / np.maximum(np.bincount(column, weights=per_row[row], minlength=d), 1)
    step_b = 4.0 * n / per_row.sum()
    for _ in range(rounds):
        margin = zb + np.bincount(row, weights=z[column], minlength=n)
        r = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y
        g = np.bincount(column, weights=r[row], minlength=d) / n
        v = z - step * g
        w2 = np.sign(v) * np.maximum(np.abs(v) - step * l1, 0)
        b2 = zb - step_b * r.mean()
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        z, zb = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    margin = b + np.bincount(row, weights=w[column], minlength=n)
    used = np.flatnonzero(w)
    return float(b + math.log(THRESHOLD / (1 - THRESHOLD)) - best_cut(margin, y)), dict(
        zip(ids[used].tolist(), w[used].tolist()))


def best_cut(margin: np.ndarray, y: np.ndarray) -> float:
    """The margin that splits the classes with the least cost, in the
    middle of the widest gap among equals; the model's scores are shifted so
    that it scores THRESHOLD."""
    order = np.argsort(margin, kind="stable")
    m, pos = margin[order], y[order]
    # cost of a cut behind each row: toxic rows below it, and twice the clean rows above
    wrong = np.cumsum(pos)[:-1] + 2 * (1 - pos)[::-1].cumsum()[::-1][1:]
    gap = np.diff(m)
    wrong = np.where(gap > 0, wrong, np.inf)
    if not np.isfinite(wrong).any():
        return float(m[0])
    k = np.flatnonzero(wrong == wrong.min())
    k = k[gap[k].argmax()]
    return float((m[k] + m[k + 1]) / 2)


class _WordWeight(dict):
    def __init__(self, weights: dict[int, float]):
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        if len(self) >= CACHE:
            self.clear()
        s = self[word] = sum(self.weights.get(f, 0.0) for f in word_features(word))
        return s


def _scorer(model, cost, index: int, keep: list[int]):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, weights = model.value
        restore, weight = Restorer(cost.value), _WordWeight(weights)
        for b in batches(it, 4 << 20):
            scores = []
            for text in b.column(index).to_pylist():
                w = set(restore(text).encode("utf-8", "surrogatepass").translate(PLAIN_WORDS).split())
                x = bias + sum(map(weight.__getitem__, w))
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, x)))))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.array(scores, pa.float64())],
                                             names=[str(i) for i in range(len(keep) + 1)])
    return run


def held_out(doc_id):
    """Rows that are never trained on: crc32 of the id's text, mod 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame):
    """(model, costs): broadcasts of the logistic model and the trigram costs."""
    sc = docs.sparkSession.sparkContext
    cost = sc.broadcast(trigram_costs(docs))
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y"))
             .filter("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
             .filter(~held_out(F.col("doc_id"))))
    order = [F.xxhash64("doc_id"), "doc_id"]
    sample = known.filter("y = 1").orderBy(*order).limit(MAX_POSITIVE).unionByName(
        known.filter("y = 0").orderBy(*order).limit(MAX_NEGATIVE))
    # at most MAX_POSITIVE + MAX_NEGATIVE rows of 12 bytes
    train = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    rows = stored(train.select("y", "text").mapInArrow(_restored(cost), "y int, text string"), "sample")
    size = rows.agg(F.coalesce(F.sum("y"), F.lit(0)).alias("toxic"), F.count(F.lit(1)).alias("n")).head()
    counts = rows.mapInArrow(_class_counts, "f long, toxic long, n long").groupBy("f").agg(
        F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    expected = F.col("n") * (size.toxic / max(size.n, 1))
    surplus = (F.col("toxic") - expected) / F.sqrt(expected + 1)
    best = counts.filter(surplus >= EVIDENCE).orderBy(surplus.desc(), "f").limit(MAX_FEATURES).select("f")
    kept = sc.broadcast(np.sort(np.array([r.f for r in best.collect()], np.int64)))
    sparse = rows.mapInArrow(_kept_features(kept), "y int, f array<long>").toArrow()
    f = sparse.column("f").combine_chunks()
    lengths = np.diff(f.offsets.to_numpy()) if len(sparse) else np.zeros(0, int)
    model = fit_logistic(sparse.column("y").to_numpy().astype(float), lengths,
                         f.flatten().to_numpy() if len(sparse) else np.zeros(0, np.int64))
    return sc.broadcast(model), cost


def _scored(docs: DataFrame, labels: DataFrame, columns: list[str], into: str) -> DataFrame:
    model, cost = fit(docs, labels)
    keep = [docs.columns.index(c) for c in columns]
    fields = [docs.schema.fields[i] for i in keep] + [T.StructField(into, T.DoubleType())]
    named = T.StructType([T.StructField(str(i), f.dataType) for i, f in enumerate(fields)])
    return docs.mapInArrow(_scorer(model, cost, docs.columns.index("text"), keep), named).toDF(*[f.name for f in fields])


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs (doc_id, text, ...)``."""
    s = _scored(docs.select("doc_id", "text"), labels, ["doc_id"], "score")
    return s.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                    F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"))


def remove_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold, columns unchanged."""
    (into,) = fresh_names(docs, "_score")
    s = _scored(docs, labels, docs.columns, into)
    return s.filter(F.col(into) < THRESHOLD).select(*[F.col(f"`{c}`") for c in docs.columns])
