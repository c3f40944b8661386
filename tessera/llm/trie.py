"""Conversation prefix trie (operator 12).

Method: the distinct sequences, sorted, are dealt to shards by ranges. Every
shard writes its part of the trie as balanced parentheses, in preorder, with the
excess kept per block and a tree of block minima and maxima above. findclose
delimits a node's subtree, the rank of leaf pairs ``()`` counts its leaves, and
cumulative arrays over the parentheses give its savings. Only the nodes on a
shard's first and last path, its spines, may go on in another shard; shards give
partial sums for them, and the spines of all shards, again a sorted list of
sequences, are merged by a second, much smaller trie (two paths a shard).

What is true of a node alone comes from plain aggregation: a node is named by
the exclusive-or of hashes of (place, turn) along its path, two lanes of 64
bits; the parent's name follows by taking the last turn away. Members, the
smallest of them, children and ends are group counts with partial sums, so a
first turn that a third of all conversations share is no hot task.

The shards hold the trie with single-child runs folded: a run of nodes with the
same members is one node, named by (smallest member, number of members), which
is unique, as members get fewer down a path. So a conversation's row has an
entry per branching on its path, not per turn. Positions and running names
inside a conversation go through range partitions and blocks of ``BLOCK``
turns; no conversation is gathered. The digest of a node's ends is sequential by
nature: runs of ids are joined into texts first, and one task streams these.

Defined cases: null roles and texts are empty; turns sort by number, null first,
equal numbers by md5 of role and text; rows without a conversation id belong to
no conversation and are left out; repeated rows are turns like others; an empty
table has no conversations and gives no nodes. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from ..sources.tables import row_index

BLOCK = 4096
SHARD_PATHS = 100_000
EXCESS_BLOCK = 256
RUN_IDS = 5_000


# --- the encoding -------------------------------------------------------------------------------

class Parens:
    """Balanced parentheses with a range min-max tree over blocks of excess."""

    def __init__(self, bits: np.ndarray, block: int = EXCESS_BLOCK):
        self.bits = bits.astype(bool)
        self.block = block
        self.excess = np.cumsum(np.where(self.bits, 1, -1), dtype=np.int64)
        n = -(-len(bits) // block)
        padded = np.concatenate([self.excess, np.full(n * block - len(bits), self.excess[-1] if len(bits) else 0)]).reshape(n, block)
        self.low, self.high = [padded.min(1) if n else np.zeros(0, np.int64)], [padded.max(1) if n else np.zeros(0, np.int64)]
        while len(self.low[-1]) > 1:
            for tree, pick in ((self.low, np.minimum), (self.high, np.maximum)):
                t = tree[-1] if len(tree[-1]) % 2 == 0 else np.append(tree[-1], tree[-1][-1])
                tree.append(pick(t[0::2], t[1::2]))

    def _in_block(self, begin: int, target: int) -> int:
        end = min((begin // self.block + 1) * self.block, len(self.excess))
        hit = np.flatnonzero(self.excess[begin:end] == target)
        return begin + int(hit[0]) if len(hit) else -1

    def findclose(self, i: int) -> int:
        """The place of the parenthesis that closes the one opened at ``i``."""
        target = int(self.excess[i]) - 1
        if i + 1 < len(self.excess) and (at := self._in_block(i + 1, target) if (i + 1) % self.block else -1) >= 0:
            return at
        node, level = (i + 1 + self.block - 1) // self.block, 0
        while True:     # climb to the first later block whose excess comes down to the target
            if node >= len(self.low[level]):
                raise ValueError("not balanced")
            if self.low[level][node] <= target <= self.high[level][node]:
                break
            node += 1
            while node % 2 == 0 and level + 1 < len(self.low) and node < len(self.low[level]):
                node, level = node // 2, level + 1
        while level:
            level, node = level - 1, 2 * node
            if not self.low[level][node] <= target <= self.high[level][node]:
                node += 1
        return self._in_block(node * self.block, target)

    def leaf_pairs(self) -> np.ndarray:
        """Where ``()`` begins."""
        out = np.zeros(len(self.bits), bool)
        out[:-1] = self.bits[:-1] & ~self.bits[1:]
        return out


def encode(paths: list[list[tuple]]) -> tuple[np.ndarray, list[tuple]]:
    """The parentheses of the trie of sorted sequences, and its nodes in
    preorder. The first two fields of an entry name it."""
    bits, nodes, open_ = [], [], []
    for path in paths:
        same = 0
        while same < len(open_) and same < len(path) and open_[same] == path[same][:2]:
            same += 1
        bits += [0] * (len(open_) - same)
        del open_[same:]
        for entry in path[same:]:
            bits.append(1)
            nodes.append(entry)
            open_.append(entry[:2])
    bits += [0] * len(open_)
    return np.array(bits, np.uint8), nodes


def subtree_sums(paths: list[list[tuple]], ranked: bool, spines: set[tuple]) -> list[tuple[tuple, int, int]]:
    """(name, sum of weights, leaves) of the subtree of every node of the trie
    of ``paths``, entries (smallest member, members, weight, leaves). Nodes of
    ``spines`` count nothing of their own. ``ranked``: leaves are leaf pairs."""
    bits, nodes = encode(paths)
    if not nodes:
        return []
    p = Parens(bits)
    opens = np.flatnonzero(p.bits)
    own = np.array([e[:2] not in spines for e in nodes])
    weight, leaves = np.zeros(len(bits), np.int64), np.zeros(len(bits), np.int64)
    weight[opens] = np.where(own, np.array([e[2] for e in nodes], np.int64), 0)
    leaves[opens] = np.where(own, p.leaf_pairs()[opens] if ranked else np.array([e[3] for e in nodes], np.int64), 0)
    total, rank = np.concatenate([[0], np.cumsum(weight)]), np.concatenate([[0], np.cumsum(leaves)])
    close = opens + 1
    for k in np.flatnonzero(p.bits[np.minimum(opens + 1, len(bits) - 1)]):
        close[k] = p.findclose(int(opens[k]))
    return [(e[:2], s, n) for e, s, n in zip(nodes, (total[close] - total[opens]).tolist(), (rank[close] - rank[opens]).tolist())]


PATH = "array<struct<rep:long,n:long,weight:long,leaf:long>>"
PART = f"kind int, rep long, n long, weight long, leaves long, path {PATH}"
_ENTRY = pa.list_(pa.struct([("rep", pa.int64()), ("n", pa.int64()), ("weight", pa.int64()), ("leaf", pa.int64())]))
DONE, PARTIAL, SPINE = 0, 1, 2


def _paths(it: Iterator[pa.RecordBatch]) -> list[list[tuple]]:
    return [[(e["rep"], e["n"], e["weight"], e["leaf"]) for e in path] for b in it for path in b.column(0).to_pylist()]


def _parts(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), _ENTRY]
    names = [f.split()[0] for f in PART.split(", ")]
    for i in range(0, len(rows), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows[i:i + 10_000]), types)], names=names)


def _shard(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    paths = _paths(it)
    if not paths:
        return
    ends = [paths[0], paths[-1]]
    spines = {e[:2] for path in ends for e in path}
    rows = [(PARTIAL if name in spines else DONE, *name, weight, leaves, None)
            for name, weight, leaves in subtree_sums(paths, True, spines) if name[1] > 1 or name in spines]
    rows += [(SPINE, None, None, None, None, [dict(zip(("rep", "n", "weight", "leaf"), e)) for e in path]) for path in ends]
    yield from _parts(rows)


def _merge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    paths = sorted(_paths(it), key=lambda path: [(e[0], e[1]) for e in path])
    yield from _parts([(DONE, *name, weight, leaves, None) for name, weight, leaves in subtree_sums(paths, False, set())])


def chain_sums(paths: DataFrame, shards: int) -> DataFrame:
    """``rep, n, weight, leaves`` over the subtree of every folded node with
    more than one member, from the distinct ``path``s."""
    ids = F.transform("path", lambda e: F.struct(e["rep"], e["n"]))
    ranged = paths.withColumn("ids", ids).repartitionByRange(shards, "ids").sortWithinPartitions("ids").select("path")
    parts = stored(ranged.mapInArrow(_shard, PART), "trie-shards")
    spines = parts.filter(f"kind = {SPINE}").select("path").distinct()
    merged = spines.repartition(1).mapInArrow(_merge, PART)  # two paths a shard of SHARD_PATHS
    # a spine node: what lies under it off the spines, by shard, and on them, merged
    return parts.filter(f"kind <> {SPINE}").unionByName(merged).filter("n > 1").groupBy("rep", "n").agg(
        F.sum("weight").alias("weight"), F.sum("leaves").alias("leaves"))


# --- turns and nodes ----------------------------------------------------------------------------

def numbered_turns(rows: DataFrame) -> DataFrame:
    """``conv_id, p, n_own, t1, t2, bytes``: turns by place, named by md5."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    name = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))
    t = (rows.filter("conv_id IS NOT NULL")
         .select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), name.alias("name"),
                 F.octet_length(text).cast("long").alias("bytes"))
         .select(F.struct("conv_id", "turn", "name").alias("key"), "bytes"))
    lane = lambda at: F.conv(F.substring("key.name", at, 15), 16, 10).cast("long")
    indexed = row_index(t, "key", "i").select("key.conv_id", "i", lane(1).alias("t1"), lane(16).alias("t2"), "bytes")
    starts = indexed.groupBy("conv_id").agg(F.min("i").alias("first"), F.count(F.lit(1)).alias("n_own"))
    return indexed.join(starts, "conv_id").select("conv_id", (F.col("i") - F.col("first")).alias("p"), "n_own", "t1", "t2", "bytes")


def graft(turns: DataFrame, every: int = 5, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on shared beginnings: the first h turns of the
    conversation c - c % every, then one's own after the first h, h being
    crc32(c) % (most + 1). Returns ``conv_id, pos, length, t1, t2, bytes`` and
    ``conv_id, length`` of every conversation."""
    convs = turns.filter("p = 0").select("conv_id", "n_own")
    plan = convs.select("conv_id", "n_own", (F.col("conv_id") - F.col("conv_id") % every).alias("base"),
                        (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).alias("h"))
    plan = plan.join(convs.select(F.col("conv_id").alias("base"), F.col("n_own").alias("n_base")), "base", "left").withColumn(
        "shift", F.least("h", F.coalesce("n_base", F.lit(0))))
    plan = stored(plan.select("conv_id", "base", "h", "shift",
                              (F.col("shift") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("length")), "trie-plan")
    head = turns.filter(f"p < {most}").select(F.col("conv_id").alias("base"), "p", "t1", "t2", "bytes").join(plan, "base").filter("p < h")
    tail = turns.join(plan, "conv_id").filter("p >= h")
    cols = ["conv_id", "length", "t1", "t2", "bytes"]
    rows = head.select(*cols, F.col("p").alias("pos")).unionByName(tail.select(*cols, (F.col("p") - F.col("h") + F.col("shift")).alias("pos")))
    return rows, plan.select("conv_id", "length")


def named_prefixes(rows: DataFrame) -> DataFrame:
    """``conv_id, depth, last, k1, k2, p1, p2, bytes, upto``: the node that
    ends at each turn, its parent's name, and the text bytes on its path."""
    steps = rows.withColumns({"x1": F.xxhash64("pos", "t1", "t2", F.lit(1)), "x2": F.xxhash64("pos", "t1", "t2", F.lit(2)),
                              "block": F.floor(F.col("pos") / BLOCK)})
    sums = steps.groupBy("conv_id", "block").agg(F.bit_xor("x1").alias("b1"), F.bit_xor("x2").alias("b2"), F.sum("bytes").alias("b"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    ahead = sums.select("conv_id", "block", *[zero(f.over(before)).alias(n) for f, n in (
        (F.bit_xor("b1"), "a1"), (F.bit_xor("b2"), "a2"), (F.sum("b"), "a"))])
    upto = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    run = steps.join(ahead, ["conv_id", "block"]).select(
        "conv_id", "pos", "length", "bytes", "x1", "x2", F.col("a1").bitwiseXOR(F.bit_xor("x1").over(upto)).alias("k1"),
        F.col("a2").bitwiseXOR(F.bit_xor("x2").over(upto)).alias("k2"), (F.col("a") + F.sum("bytes").over(upto)).alias("upto"))
    return run.select("conv_id", (F.col("pos") + 1).alias("depth"), (F.col("pos") + 1 == F.col("length")).alias("last"), "k1", "k2",
                      F.col("k1").bitwiseXOR(F.col("x1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("x2")).alias("p2"), "bytes", "upto")


def _runs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (k1, k2, conv_id) to texts of up to RUN_IDS ids."""
    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(
            zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["k1", "k2", "first", "ids"])

    key, ids, out = None, [], []
    for b in it:
        for *k, c in zip(*(x.to_pylist() for x in b.columns)):
            if k != key or len(ids) >= RUN_IDS:
                if ids:
                    out.append((*key, ids[0], ",".join(map(str, ids))))
                key, ids = k, []
            ids.append(c)
        if out:
            yield batch(out)
            out = []
    if ids:
        yield batch([(*key, ids[0], ",".join(map(str, ids)))])


def _digests(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (k1, k2, ids) to the digest of each key's ids."""
    key, h = None, None

    def batch(rows):
        cols = list(zip(*rows)) if rows else [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string()))],
                                          names=["k1", "k2", "ends_sha256"])

    for b in it:
        out = []
        for *k, ids in zip(*(x.to_pylist() for x in b.columns)):
            if k != key:
                if key is not None:
                    out.append((*key, h.hexdigest()))
                key, h = k, hashlib.sha256()
            else:
                h.update(b",")
            h.update(ids.encode())
        yield batch(out)
    if key is not None:
        yield batch([(*key, h.hexdigest())])


def end_digests(ends: DataFrame) -> DataFrame:
    """``k1, k2, ends_sha256`` of ``ends (k1, k2, conv_id)``."""
    order = ["k1", "k2", "conv_id"]
    runs = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _runs, "k1 long, k2 long, first long, ids string")
    return runs.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first").select("k1", "k2", "ids").mapInArrow(
        _digests, "k1 long, k2 long, ends_sha256 string")


def prefix_trie(rows: DataFrame, convs: DataFrame, shard_paths: int = SHARD_PATHS) -> DataFrame:
    """A row per node of the trie of the sequences in ``rows`` (see ``graft``):
    ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256``."""
    steps = stored(named_prefixes(rows), "trie-steps")
    own = steps.groupBy("k1", "k2").agg(
        F.max("depth").alias("depth"), F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.count(F.lit(1)).alias("n"),
        F.min("conv_id").alias("rep"), F.count_if("last").alias("ends"), F.max("bytes").alias("bytes"), F.max("upto").alias("upto"))
    nothing, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    root = convs.agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("rep"), F.count_if(F.col("length") == 0).alias("ends")).filter(
        "n > 0").select(zero.alias("k1"), zero.alias("k2"), zero.alias("depth"), nothing.alias("p1"), nothing.alias("p2"), "n", "rep",
                        "ends", zero.alias("bytes"), zero.alias("upto"))
    nodes = stored(own.unionByName(root), "trie-nodes")
    children = nodes.filter("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
        F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("rep").alias("parent_rep"))
    known = stored(nodes.join(children, ["k1", "k2"], "left").join(parents, ["p1", "p2"], "left").select(
        "k1", "k2", "depth", "n", "rep", "parent_rep", "bytes", "upto", F.coalesce("n_children", zero).alias("n_children"),
        (F.coalesce("n_children", zero).cast("long") != 1).alias("forks"), "ends"), "trie-known")

    # folded: runs of nodes with the same members, named by (rep, n); their last node forks or is an end
    below = known.filter("depth > 0")
    chains = below.groupBy("rep", "n").agg(((F.col("n") - 1) * F.sum("bytes")).alias("weight"),
                                           F.min(F.col("upto") - F.col("bytes")).alias("above"))
    last = below.filter("forks OR ends > 0").select("k1", "k2", "rep", "n", F.when(F.col("n_children") == 0, 1).otherwise(0)
                                                    .cast("long").alias("leaf")).join(chains.drop("above"), ["rep", "n"])
    on_path = steps.select("k1", "k2", "conv_id", "depth").join(last, ["k1", "k2"])
    entry = F.struct("depth", "rep", "n", "weight", "leaf")
    paths = stored(on_path.groupBy("conv_id").agg(F.sort_array(F.collect_list(entry)).alias("path"))
                   .filter(F.element_at("path", -1)["rep"] == F.col("conv_id"))
                   .select(F.transform("path", lambda e: F.struct(e["rep"].alias("rep"), e["n"].alias("n"), e["weight"].alias("weight"),
                                                                  e["leaf"].alias("leaf"))).alias("path")), "trie-paths")
    sums = chain_sums(paths, max(1, -(-paths.count() // shard_paths)))
    at = F.col("upto") - F.col("bytes")
    shared = below.filter("n > 1").join(sums, ["rep", "n"]).join(chains.drop("weight"), ["rep", "n"]).withColumn(
        "saved", F.col("weight") - (F.col("n") - 1) * (at - F.col("above")))
    single = below.filter("n = 1").withColumns({"leaves": F.lit(1).cast("long"), "saved": zero})
    whole = below.agg(F.count_if(F.col("n_children") == 0).alias("leaves"), F.sum((F.col("n") - 1) * F.col("bytes")).alias("saved"))
    top = known.filter("depth = 0").withColumns(
        {"leaves": F.greatest(whole.select("leaves").scalar(), F.lit(1).cast("long")),
         "saved": F.coalesce(whole.select("saved").scalar(), zero)})
    cols = ["k1", "k2", "rep", "depth", "parent_rep", "n", "n_children", "leaves", "saved"]
    every = shared.select(*cols).unionByName(single.select(*cols)).unionByName(top.select(*cols))
    ends = end_digests(steps.filter("last").select("k1", "k2", "conv_id").unionByName(
        convs.filter("length = 0").select(zero.alias("k1"), zero.alias("k2"), "conv_id")))
    return every.join(ends, ["k1", "k2"], "left").select(
        F.col("rep").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("parent_rep").alias("parent_conv_id"),
        F.col("n").alias("n_convs"), "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def conversation_trie(rows: DataFrame, shard_paths: int = SHARD_PATHS) -> DataFrame:
    """The trie of the rebuilt conversations of ``rows (conv_id, turn, role, text)``."""
    turns = stored(numbered_turns(rows), "trie-turns")
    return prefix_trie(*graft(turns), shard_paths)
