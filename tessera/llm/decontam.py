"""Benchmark decontamination with suffix arrays over the training text (operator 1).

Method (after Lee et al., "Deduplicating Training Data Makes Language Models
Better", ACL 2022): the corpus is cut into shards, every shard gets a suffix
array over its words, every suffix of every test item is binary-searched in
it, and each place where a match begins is extended to its full length, which
gives the longest verbatim matches and their places.

Equal windows of several items are one class, searched once, and a match is
extended in the items' own suffix array, where all suffixes that still agree
are one range. So a prompt that thousands of items and documents share costs
what one item's does: a row never holds a list by (document, item), but the key
of a set of items. A task writes out each set once; the sets, as many as
different combinations of matched classes, are joined by key afterwards.

A shard is one Arrow batch (about ``SHARD_BYTES`` of text), so the whole search
is one pass over the documents without a shuffle, a hot source or passage
stays spread over all tasks, and a lost task is simply run again. Two facts
keep the arrays small without losing a match: a word that no test item holds
ends every match, and a match of a whole window needs a run of at least
``min(window, shortest item)`` known words. Only such runs are sorted.

The test items are the stated query set. They are sent to the tasks in blocks
of at most ``BLOCK_BYTES`` of text, one block at a time; a larger benchmark
takes several passes, whose matches are united per row, by row numbers in a
written table.

Defined cases: null and wordless texts have no words and are never
contaminated; items without words match nothing; items that share an id are
one item; an item without an id counts under the id ''. Empty tables give
empty results (documents) or no matches (benchmark). Columns of the documents
are passed through, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored
from .common import PLAIN_WORDS, batches, fresh_names

WINDOW = 13
SHARD_BYTES = 8 << 20
BLOCK_BYTES = 8 << 20
SEEN_SETS = 1 << 14
#: sets of items whose digests may be broadcast (some 150 bytes each)
SMALL_SETS = 50_000

#: a match: its place in the document, its length, and one item (of all that hold it) with the place there
MATCH = "struct<doc_start:int,n_words:int,item_id:string,item_start:int>"
#: hits: the runs of hit words; items: the ids of a set, where a task meets it first
FOUND = (f"struct<n_words:bigint,hits:array<struct<a:bigint,b:bigint>>,matches:array<{MATCH}>,item_set:string,"
         "items:array<string>>")


class TestItems:
    """The windows of a block of test items, ready for searching."""

    def __init__(self, items: list[tuple[object, bytes | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        coded, self.ids = [], []
        for item_id, text in items:
            w = [] if text is None else text.translate(PLAIN_WORDS).split()
            if w:
                self.ids.append("" if item_id is None else str(item_id))
                coded.append([self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w])
        self.size = np.array([len(c) for c in coded], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size + 1)])[:-1].astype(np.int64)
        # all items in one array, a 0 after each
        self.words = np.array([x for c in coded for x in [*c, 0]], np.int32)
        self.shortest = int(np.minimum(self.size, window).min()) if coded else 0
        # every suffix that still holds a whole window of its item
        n_suffix = np.maximum(self.size - window, 0) + 1 if coded else np.zeros(0, np.int64)
        item = np.repeat(np.arange(len(coded)), n_suffix)
        offset = np.arange(len(item)) - np.repeat(np.cumsum(n_suffix) - n_suffix, n_suffix)
        length = np.minimum(self.size[item], window) if coded else np.zeros(0, np.int64)
        heads = np.zeros((len(item), window), np.int32)
        for j in range(window):
            inside = length > j
            heads[inside, j] = self.words[self.start[item[inside]] + offset[inside] + j]
        # equal windows are searched once; `member` lists the suffixes of each
        keys = np.hstack([heads, length[:, None].astype(np.int32)])
        self.heads, group = np.unique(keys, axis=0, return_inverse=True) if len(item) else (keys, np.zeros(0, int))
        # the suffixes of a class in the order of the items' suffix array
        source = self.start[item] + offset if len(item) else np.zeros(0, np.int64)
        rank = np.empty(len(self.words), np.int64)
        rank[suffix_array(self.words, int(self.size.max(initial=0)) + 1)] = np.arange(len(self.words))
        order = np.lexsort((rank[source], group)) if len(item) else np.zeros(0, np.int64)
        self.item, self.offset, self.source = item[order], offset[order], source[order]
        self.first = np.searchsorted(group[order], np.arange(len(self.heads) + 1))
        # the word before all of a class's windows, if it is the same one: 0 else
        before = np.where(self.offset > 0, self.words[self.source - 1], 0) if len(item) else np.zeros(0, np.int32)
        low, high = ((np.minimum.reduceat(before, self.first[:-1]), np.maximum.reduceat(before, self.first[:-1]))
                     if len(item) else (before, before))
        self.left = np.where(low == high, low, 0)

    def ids_of(self, classes: np.ndarray) -> list[str]:
        """The sorted different ids of all items that hold a window of these classes."""
        _, s = _ranges(self.first[classes], self.first[classes + 1])
        return sorted({self.ids[i] for i in np.unique(self.item[s]).tolist()})


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Start positions of ``text`` sorted by their first ``depth`` (or more)
    words, by prefix doubling; past the end counts as 0."""
    rank, k = text.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while k < depth and len(text):
        behind = np.zeros_like(rank)
        behind[:-k or None] = rank[k:] + 1 if k < len(rank) else 0
        key = rank * (len(text) + int(text.max()) + 2) + behind
        order = np.argsort(key, kind="stable")
        step = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = np.empty_like(rank)
        rank[order] = step
        if step[-1] == len(text) - 1:
            break
        k *= 2
    return order


def _bounds(text: np.ndarray, order: np.ndarray, heads: np.ndarray, width: int, upper: bool) -> np.ndarray:
    """For all windows at once, by binary search: the first place in ``order``
    whose words are not below (``upper``: are above) the window's."""
    lo, hi = np.zeros(len(heads), np.int64), np.full(len(heads), len(order), np.int64)
    padded = np.concatenate([text, np.zeros(width, text.dtype)])
    length = heads[:, width]
    while (lo < hi).any():
        live = np.flatnonzero(lo < hi)
        mid = (lo[live] + hi[live]) >> 1
        here = order[mid]
        sign = np.zeros(len(live), np.int8)
        for j in range(width):
            undecided = np.flatnonzero((sign == 0) & (length[live] > j))
            if len(undecided) == 0:
                break
            sign[undecided] = np.sign(padded[here[undecided] + j].astype(np.int64) - heads[live[undecided], j])
        go_right = (sign <= 0) if upper else (sign < 0)
        lo[live[go_right]] = mid[go_right] + 1
        hi[live[~go_right]] = mid[~go_right]
    return lo


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the ranges [lo, hi), with the index of their range."""
    n = hi - lo
    of = np.repeat(np.arange(len(lo)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + lo[of]


def _narrow(items: TestItems, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts of ranges of suffixes, equal up to ``depth``, that go on with ``word``."""
    ends = []
    for upper in (False, True):
        a, b = lo.copy(), hi.copy()
        while (live := np.flatnonzero(a < b)).size:
            mid = (a[live] + b[live]) >> 1
            here = items.words[items.source[mid] + depth[live]]
            right = (here <= word[live]) if upper else (here < word[live])
            a[live[right]] = mid[right] + 1
            b[live[~right]] = mid[~right]
        ends.append(a)
    return ends[0], ends[1]


def search_shard(texts: list[bytes | None], items: TestItems, window: int = WINDOW
                 ) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of one shard: word counts; the runs of hit words (document, first, end);
    the classes of matched windows (document, class), each once; and where
    matches begin: (document, place, length, item, place in it)."""
    get, coded, n_words = items.vocabulary.get, [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        w = [] if t is None else t.translate(PLAIN_WORDS).split()
        n_words[i] = len(w)
        coded.append(np.fromiter(map(get, w, repeat(0)), np.int32, len(w)))
        coded.append(np.zeros(1, np.int32))
    none = n_words, np.zeros((0, 3), np.int64), np.zeros((0, 2), np.int64), [np.zeros(0, np.int64)] * 5
    if not items.shortest:
        return none
    flat = np.concatenate([np.zeros(1, np.int32), *coded])  # a 0 before, between and after the texts
    edge = np.flatnonzero(np.diff((flat > 0).astype(np.int8)))  # word runs are (edge[2k], edge[2k + 1]]
    a, b = edge[0::2] + 1, edge[1::2] + 2  # with the 0 behind the run
    long = b - a > items.shortest
    _, place = _ranges(a[long], b[long])
    if len(place) == 0:
        return none
    text = flat[place]
    order = suffix_array(text, window)
    order = order[text[order] > 0]
    lo = _bounds(text, order, items.heads, window, False)
    hi = _bounds(text, order, items.heads, window, True)
    win, at = _ranges(lo, hi)
    where = place[order[at]]                                        # in `flat`
    begin = np.concatenate([[0], np.cumsum(n_words + 1)]) + 1       # first word of each text in `flat`
    doc = np.searchsorted(begin, where, "right") - 1
    size = items.heads[win, window].astype(np.int64)
    cover = np.zeros(len(flat) + 1, np.int32)
    np.add.at(cover, where, 1)
    np.add.at(cover, where + size, -1)
    hit = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(cover[:-1]) > 0).astype(np.int8), [0]])))
    first, end = hit[0::2], hit[1::2]                               # runs never reach over a text's end
    of = np.searchsorted(begin, first, "right") - 1
    runs = np.stack([of, first - begin[of], end - begin[of]], 1) if len(first) else none[1]
    classes = np.unique(np.stack([doc, win], 1), axis=0)
    # a window whose predecessors all agree with the text goes on from the place before
    starts = (items.left[win] == 0) | (items.left[win] != flat[where - 1])
    win, where, doc, size = win[starts], where[starts], doc[starts], size[starts]
    lo, hi, length = items.first[win], items.first[win + 1], size.copy()
    grow = np.flatnonzero(flat[where + length] > 0)
    while len(grow):
        x, y = _narrow(items, lo[grow], hi[grow], length[grow], flat[where[grow] + length[grow]])
        grow, x, y = grow[x < y], x[x < y], y[x < y]
        lo[grow], hi[grow] = x, y
        length[grow] += 1
        grow = grow[flat[where[grow] + length[grow]] > 0]
    return n_words, runs, classes, [doc, where - begin[doc], length, items.item[lo], items.offset[lo]]


def _lists(doc: np.ndarray, n: int, fields: dict[str, pa.Array]) -> pa.ListArray:
    """Rows sorted by ``doc`` as one list of structs for each of ``n`` documents."""
    cut = np.searchsorted(doc, np.arange(n + 1))
    return pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.StructArray.from_arrays(list(fields.values()), names=list(fields)))


def _searcher(shared, block: int, index: int, keep: list[int]):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, seen = None, set()
        for b in batches(it, SHARD_BYTES):
            if items is None:
                items = TestItems(shared.value)
                ids = np.array(items.ids, object)
            n_words, runs, classes, (doc, at, length, item, off) = search_shard(
                b.column(index).cast(pa.binary()).to_pylist(), items)
            order = np.lexsort((length, at, doc))
            keys, lists = [None] * b.num_rows, [None] * b.num_rows
            cut = np.searchsorted(classes[:, 0], np.arange(b.num_rows + 1))
            for i in np.flatnonzero(np.diff(cut)):
                own = classes[cut[i]:cut[i + 1], 1]
                keys[i] = f"{block}:{hashlib.md5(own.tobytes()).hexdigest()}"
                if keys[i] not in seen:
                    if len(seen) >= SEEN_SETS:
                        seen.clear()
                    seen.add(keys[i])
                    lists[i] = items.ids_of(own)
            found = pa.StructArray.from_arrays(
                [pa.array(n_words),
                 _lists(runs[:, 0], b.num_rows, {"a": pa.array(runs[:, 1]), "b": pa.array(runs[:, 2])}),
                 _lists(doc[order], b.num_rows, {"doc_start": pa.array(at[order], pa.int32()), "n_words": pa.array(length[order], pa.int32()),
                                                 "item_id": pa.array(ids[item[order]], pa.string()),
                                                 "item_start": pa.array(off[order], pa.int32())}),
                 pa.array(keys, pa.string()), pa.array(lists, pa.list_(pa.string()))],
                names=["n_words", "hits", "matches", "item_set", "items"])
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), found],
                                             names=[str(i) for i in range(len(keep) + 1)])
    return run


def _blocks(benchmark: DataFrame) -> list[DataFrame]:
    """The test items in blocks of at most about BLOCK_BYTES of text."""
    total = benchmark.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    n = -(-total // BLOCK_BYTES)
    items = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("binary"))
    if n <= 1:
        return [items]
    return [items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) for i in range(n)]


def find_matches(docs: DataFrame, benchmark: DataFrame, into: str = "found",
                 columns: list[str] | None = None) -> DataFrame:
    """The ``columns`` (default: all) of ``docs (text, ...)`` and a column
    ``into``: word count, runs of hit words, the longest verbatim match at each
    place where one begins, and ``sets``, the keys of the sets of items found
    (one for each block of the benchmark), with their ids where they are met
    first (``items_of``)."""
    spark = docs.sparkSession
    index = docs.columns.index("text")
    columns = docs.columns if columns is None else columns
    keep = [docs.columns.index(c) for c in columns]
    fields = [T.StructField(str(i), docs.schema.fields[k].dataType) for i, k in enumerate(keep)]
    found = T.StructField("found", T._parse_datatype_string(FOUND))
    blocks = _blocks(benchmark)

    def search(rows: DataFrame, number: int, index: int, keep: list[int], fields: list[T.StructField]):
        items = [(r[0], None if r[1] is None else bytes(r[1])) for r in blocks[number].collect()]   # BLOCK_BYTES at most
        shared = spark.sparkContext.broadcast(items)
        return rows.mapInArrow(_searcher(shared, number, index, keep), T.StructType([*fields, found])), shared

    sets = lambda one: F.array_compact(F.array(one["item_set"]))
    if len(blocks) == 1:
        one, _ = search(docs, 0, index, keep, fields)
        f = F.col("found")
        return one.select(*(F.col(str(i)) for i in range(len(keep))), F.struct(
            f["n_words"].alias("n_words"), f["hits"].alias("hits"), f["matches"].alias("matches"), sets(f).alias("sets"),
            F.array(f["items"]).alias("items")).alias("found")).toDF(*columns, into)
    # several passes, one after the other: unite the matches of each row by its number in a written table
    numbered = stored(docs.toDF(*(str(i) for i in range(len(docs.columns)))).withColumn(
        "row", F.monotonically_increasing_id()), "numbered")
    whole = None
    for number in range(len(blocks)):
        p, shared = search(numbered.select("row", str(index)), number, 1, [0], [T.StructField("row", T.LongType())])
        p = stored(p.toDF("row", "found"), "pass")
        shared.unpersist()
        whole = p if whole is None else whole.unionByName(p)
    f = F.col("found")
    parts = whole.groupBy("row").agg(F.max(f["n_words"]).alias("n_words"), F.flatten(F.collect_list(f["hits"])).alias("hits"),
                                     F.flatten(F.collect_list(f["matches"])).alias("matches"),
                                     F.array_sort(F.collect_list(f["item_set"])).alias("sets"),
                                     F.array_sort(F.collect_list(F.struct(f["item_set"].alias("k"), f["items"].alias("v")))).alias("pairs"))
    united = parts.select("row", F.struct("n_words", "hits", "matches", "sets", F.transform(
        F.filter("pairs", lambda e: e["k"].isNotNull()), lambda e: e["v"]).alias("items")).alias("found"))
    return numbered.select("row", *(str(k) for k in keep)).join(united, "row").drop("row").toDF(*columns, into)


def items_of(found: DataFrame, column: str = "found") -> DataFrame:
    """``sets, items``: the sorted ids of every combination of sets in a written
    table of ``find_matches``."""
    f = F.col(column)
    pairs = found.select(F.explode(F.arrays_zip(f["sets"].alias("k"), f["items"].alias("v"))).alias("p"))
    known = pairs.filter("p.k IS NOT NULL AND p.v IS NOT NULL").groupBy(F.col("p.k").alias("k")).agg(F.first("p.v").alias("v"))
    combos = found.select(f["sets"].alias("sets")).distinct()
    joined = combos.select("sets", F.explode("sets").alias("k")).join(known, "k")
    return joined.groupBy("sets").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("v")))).alias("items"))


def _hit_words(hits):
    """Number of words inside any run: the union of the runs."""
    return F.aggregate(
        F.array_sort(hits), F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("end")),
        lambda u, x: F.struct((u["hit"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], u["end"]))).alias("hit"),
                              F.greatest(u["end"], x["b"]).alias("end")), lambda u: u["hit"])


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of ``docs (doc_id, text)``: words, hit words, items found,
    their digest, the longest match and the verdict: contaminated when at
    least one word in twenty is hit."""
    found = stored(find_matches(docs.select("doc_id", "text"), benchmark, columns=["doc_id"]), "contamination")
    f = F.col("found")
    items = stored(items_of(found).select("sets", F.size("items").cast("long").alias("n_items"),
                                          F.sha2(F.array_join("items", ","), 256).alias("items_sha256")), "item_sets")
    d = found.select("doc_id", f["n_words"].alias("n_words"), _hit_words(f["hits"]).alias("n_hit"), f["sets"].alias("sets"),
                     F.array_max(F.transform(f["matches"], lambda x: x["n_words"])).alias("longest"))
    if items.count() <= SMALL_SETS:
        known = d.join(F.broadcast(items), "sets", "left")
    else:   # rows without a set need no join and would be one hot key
        nothing = d.filter(F.size("sets") == 0).withColumns({"n_items": F.lit(0).cast("long"), "items_sha256": F.lit(None).cast("string")})
        known = d.filter(F.size("sets") > 0).join(items, "sets").unionByName(nothing)
    return known.select(
        "doc_id", "n_words", "n_hit", F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))).alias("contaminated"),
        F.coalesce("longest", F.lit(0)).cast("long").alias("longest_match"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, columns unchanged."""
    (into,) = fresh_names(docs, "_found")
    found = find_matches(docs, benchmark, into)
    hit = _hit_words(F.col(f"{into}.hits"))
    kept = found.filter(~((hit > 0) & (hit * 20 >= F.col(f"{into}.n_words"))))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
