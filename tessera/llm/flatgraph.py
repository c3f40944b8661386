"""Near-duplicate vectors by a robust-pruned flat graph (operator 4).

Method: a single-layer proximity graph in the manner of DiskANN (Subramanya et
al., NeurIPS 2019). The vectors are dealt to overlapping cluster shards, every
shard builds its graph with robust pruning, and the adjacency lists of a vector
are united over its shards. Each vector then searches every shard it belongs
to: greedily from the shard's medoid (and one entry for each part of the graph
that the medoid cannot reach), then, from what lies within the radius, the
search expands until no vector in range has an unvisited neighbour (over the
united lists, as far as they lead to vectors of the shard). Every hit is
verified by cosine in double precision. An audit compares the numbers of linked
vectors, equal ones counted once, of ``AUDIT_QUERIES`` vectors and of as many
that have links with brute force over all vectors; if recall is below
``RECALL``, the overlap grows and the search is repeated, at last over all
clusters. The last round is audited too: below ``LEAST_RECALL`` the job ends
with an error.

What keeps it bounded: equal vectors are one node with a weight (partial
aggregation, so a vector that a third of all rows share is no hot key). A
cluster of more than ``CAP`` vectors is cut into parts, each with a graph of
its own, and its vectors search all parts, one task for each pair of parts.
Tasks emit link counts and joining links, never pairs. A link that several
shards see counts in the smallest cluster that both vectors belong to.
Centroids are fitted on a sample of at most ``SAMPLE`` vectors; all vectors are
indexed.

Defined cases: vectors that are null, zero, or hold null or non-finite
components link with nothing and are kept, as do rows without ``vec_id``;
vectors of different lengths do not link; an empty table gives an empty result.
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
from .common import link_rows

SAMPLE = 16_384
SHARD_ROWS = 256
CAP = 1024
OVERLAP = 3
DEGREE = 24
ALPHA = 1.2
EXPANSIONS = 32
AUDIT_QUERIES = 200
RECALL = 0.99
LEAST_RECALL = 0.9


def fit_centroids(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means on the rows of ``x`` (unit vectors)."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.linalg.norm(total, axis=1)
        c[size > 0] = total[size > 0] / size[size > 0, None]
    return c


def robust_prune(x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> list[np.ndarray]:
    """Out-neighbours of every row: nearest first, leaving out what a chosen
    neighbour is ``alpha`` times closer to; all rows are candidates. Reverse
    edges are added."""
    n = len(x)
    near = x @ x.T
    far = np.maximum(2 - 2 * near, 0)  # squared distance of unit vectors
    alive = ~np.eye(n, dtype=bool)
    rows = np.arange(n)
    out: list[list[int]] = [[] for _ in range(n)]
    for _ in range(min(degree, n - 1)):
        pick = np.where(alive, near, -3).argmax(1)
        ok = alive[rows, pick]
        if not ok.any():
            break
        for i in np.flatnonzero(ok).tolist():
            out[i].append(int(pick[i]))
        alive &= alpha * alpha * far[pick] > far
        alive[rows, pick] = False
        alive[~ok] = False
    both = [set(o) for o in out]
    for i, o in enumerate(out):
        for j in o:
            both[j].add(i)
    return [np.fromiter(sorted(b), np.int64, len(b)) for b in both]


def entry_points(x: np.ndarray, edges: list[np.ndarray]) -> list[int]:
    """The medoid, and one entry for every part that is not reached from it."""
    order = np.argsort(-(x @ x.mean(0)), kind="stable")
    seen, entries = np.zeros(len(x), bool), []
    for start in order.tolist():
        if seen[start]:
            continue
        entries.append(start)
        seen[start] = True
        front = [start]
        while front:
            nxt = np.unique(np.concatenate([edges[i] for i in front])) if front else np.zeros(0, int)
            nxt = nxt[~seen[nxt]] if len(nxt) else nxt
            seen[nxt] = True
            front = nxt.tolist()
    return entries


def range_search(x: np.ndarray, edges: list[np.ndarray], queries: np.ndarray, radius: float,
                 expansions: int = EXPANSIONS) -> list[np.ndarray]:
    """For each query the rows of ``x`` found with cosine >= radius: greedy
    steps for all queries together, then range expansion for each."""
    n, nq = len(x), len(queries)
    wide = max((len(e) for e in edges), default=0)
    table = np.full((n + 1, max(wide, 1)), n)
    for i, e in enumerate(edges):
        table[i, :len(e)] = e
    score = np.full((nq, n + 1), -2.0)  # -2: not visited; the last column is a filler
    done = np.zeros((nq, n + 1), bool)
    done[:, n] = True
    padded = np.vstack([x, np.zeros(x.shape[1])])
    first = entry_points(x, edges)
    score[:, first] = queries @ x[first].T
    rows = np.arange(nq)
    for _ in range(expansions):
        best = np.where(done, -3, score).argmax(1)
        live = np.flatnonzero((score[rows, best] > -2) & ~done[rows, best])
        if len(live) == 0:
            break
        done[live, best[live]] = True
        around = table[best[live]]
        got = np.einsum("qrd,qd->qr", padded[around], queries[live])
        score[live[:, None], around] = np.where(around == n, -2, got)
    out = []
    for q in range(nq):
        front = np.flatnonzero((score[q, :n] >= radius) & ~done[q, :n])
        seen = score[q] > -2
        seen[n] = True
        while len(front):
            around = np.unique(table[front])
            around = around[~seen[around]]
            seen[around] = True
            score[q, around] = x[around] @ queries[q]
            front = around[score[q, around] >= radius]
        out.append(np.flatnonzero(score[q, :n] >= radius))
    return out


def _units(column) -> np.ndarray:
    x = np.array(column.to_list() if isinstance(column, pd.Series) else column.to_pylist(), np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)    # squares of huge or tiny components would not be finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _assign(shared, overlap: int):
    """The nearest clusters of every vector, by its length; smallest first."""
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centroids = shared.value
        for p in it:
            out = []
            for row in range(0, len(p), 1024):
                q = p.iloc[row:row + 1024]
                lists = pd.Series([[]] * len(q), index=q.index, dtype=object)
                for size, part in q.groupby(q.x.map(len)):
                    base, c = centroids[size]
                    near = np.argsort(-(_units(part.x) @ c.T), axis=1, kind="stable")[:, :overlap] + base
                    for i, r in zip(part.index, np.sort(near, 1).tolist()):
                        lists[i] = r
                out.append(q.assign(clusters=lists))
            yield pd.concat(out) if out else p.assign(clusters=pd.Series([], dtype=object))
    return run


def _build(p: pd.DataFrame) -> pd.DataFrame:
    edges = robust_prune(_units(p.x))
    ids = p.rep.to_numpy()
    return pd.DataFrame({"rep": ids, "near": [ids[e].tolist() for e in edges]})


def search_part(radius: float):
    """Of one part's graph and one part's queries: link weights counted in the
    smallest common cluster, and links that join components. b is null in a
    weight, and a itself in a number of linked vectors."""
    def run(p: pd.DataFrame) -> pd.DataFrame:
        data, asks = p[~p.asks], p[p.asks]
        out: list[tuple] = []
        if len(data) and len(asks):
            cluster = p.cluster.iloc[0]
            data = data.sort_values("rep")
            ids, weight = data.rep.to_numpy(), data.weight.to_numpy()
            x, q, own = _units(data.x), _units(asks.x), asks.rep.to_numpy()
            edges = []
            for near in data.near:
                e = np.asarray(near, np.int64)
                at = np.minimum(np.searchsorted(ids, e), len(ids) - 1)
                edges.append(at[ids[at] == e])
            member = [set(c) for c in data.clusters]
            asked = [set(c) for c in asks.clusters]
            root: dict[int, int] = {}

            def top(c):
                root.setdefault(c, c)
                while root[c] != c:
                    root[c] = c = root[root[c]]
                return c

            for start in range(0, len(q), 256):
                for i, found in enumerate(range_search(x, edges, q[start:start + 256], radius), start):
                    total = linked = 0
                    for k in found.tolist():
                        if ids[k] == own[i]:
                            continue
                        if min(asked[i] & member[k]) == cluster:
                            total += int(weight[k])
                            linked += 1
                        a, b = top(int(own[i])), top(int(ids[k]))
                        if a != b:
                            root[max(a, b)] = min(a, b)
                            out.append((int(own[i]), int(ids[k]), 0))
                    if total:
                        out.append((int(own[i]), None, total))
                        out.append((int(own[i]), int(own[i]), linked))
        return link_rows(out)
    return run


def _search(nodes: DataFrame, centroids, overlap: int, radius: float) -> DataFrame:
    """Rows ``a, b, n``: joining links, link weights (b null), and numbers of linked vectors (b = a)."""
    sc = nodes.sparkSession.sparkContext
    dealt = nodes.mapInPandas(_assign(sc.broadcast(centroids), overlap),
                              "rep long, weight long, x array<double>, clusters array<int>")
    rows = stored(dealt.withColumn("cluster", F.explode("clusters")), "shards")
    size = rows.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / CAP).cast("int").alias("parts"))
    rows = rows.join(size, "cluster").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    lists = rows.groupBy("cluster", "part").applyInPandas(_build, "rep long, near array<long>")
    # a vector is in `overlap` shards, so its united list is bounded by them
    united = stored(lists.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "graph")
    each = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    data = rows.join(united, "rep").withColumns({"other": each, "asks": F.lit(False)})
    asks = rows.withColumns({"other": F.col("part"), "near": F.array().cast("array<long>"), "asks": F.lit(True)})
    asks = asks.withColumn("part", each)
    cols = ["cluster", "part", "other", "rep", "weight", "x", "clusters", "near", "asks"]
    return stored(data.select(cols).unionByName(asks.select(cols)).groupBy("cluster", "part", "other")
                  .applyInPandas(search_part(radius), "a long, b long, n long"), "found")


def _brute(shared, radius: float):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            total = np.zeros(len(shared.value[0]), np.int64)
            for size, part in p.groupby(p.x.map(len)):
                x, ids = _units(part.x), part.rep.to_numpy()
                for j, (rep, q) in enumerate(zip(*shared.value)):
                    if len(q) == size:
                        total[j] += int(((x @ q >= radius) & (ids != rep)).sum())
            yield pd.DataFrame({"rep": shared.value[0], "n": total})
    return run


def audit(nodes: DataFrame, counts: DataFrame, radius: float) -> float:
    """Share of the true links that were found, over a bounded sample of
    vectors: some of all, and some that have links. ``counts (rep, n)`` are
    numbers of linked vectors."""
    some = nodes.orderBy(F.xxhash64("rep"), "rep").limit(AUDIT_QUERIES)
    linked = nodes.join(counts.filter("n > 0").select("rep"), "rep", "left_semi").orderBy(F.xxhash64("rep", F.lit(1)), "rep").limit(AUDIT_QUERIES)
    picked = {r.rep: r.x for r in some.select("rep", "x").unionByName(linked.select("rep", "x")).collect()}
    if not picked:
        return 1.0
    shared = nodes.sparkSession.sparkContext.broadcast((list(picked), [_units(pd.Series([x]))[0] for x in picked.values()]))
    true = nodes.mapInPandas(_brute(shared, radius), "rep long, n long").groupBy("rep").agg(F.sum("n").alias("n"))
    both = true.join(counts.select("rep", F.col("n").alias("found")), "rep", "left").agg(
        F.sum("n").alias("n"), F.sum(F.least("n", F.coalesce("found", F.lit(0)))).alias("found")).head()
    return 1.0 if not both.n else both.found / both.n


def link_vectors(vectors: DataFrame, radius: float = 0.95) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors
    (vec_id, embedding, ...)``."""
    spark = vectors.sparkSession
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    finite = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    usable = F.coalesce(F.col("vec_id").isNotNull() & finite & F.exists("x", lambda e: e != 0), F.lit(False))
    good = v.filter(usable)
    nodes = stored(good.groupBy("x").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"))
                   .select("rep", "weight", "x"), "nodes")
    centroids, base = {}, 0
    for r in nodes.groupBy(F.size("x").alias("size")).count().collect():  # one row per vector length
        k = max(1, min(-(-r["count"] // SHARD_ROWS), SAMPLE // 4))
        some = nodes.filter(F.size("x") == r["size"]).orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("x").collect()
        x = np.array([s.x for s in some])
        centroids[r["size"]] = (base, fit_centroids(_units(pd.Series(list(x))), min(k, len(x))))
        base += k
    overlap, clusters = OVERLAP, base
    while True:
        found = _search(nodes, centroids, overlap, radius)
        counts = found.filter("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
        recall = audit(nodes, found.filter("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n")), radius)
        if overlap >= clusters or recall >= RECALL:
            break
        overlap *= 2
    if recall < LEAST_RECALL:
        raise RuntimeError(f"the graph finds {recall:.3f} of the links of the audited vectors")
    label = component_labels(found.filter("b is not null")).withColumnRenamed("node", "rep")
    of = (nodes.join(counts, "rep", "left").join(label, "rep", "left")
          .select("x", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
                  F.coalesce("component", "rep").alias("component_id")))
    # a written table on the small side, so that adaptive execution may split a vector that many rows share
    of = stored(of.withColumn("code", F.xxhash64("x")), "labelled")
    linked = good.withColumn("code", F.xxhash64("x")).join(of, ["code", "x"]).select("vec_id", "n_links", "component_id")
    rest = v.filter(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(rest).select(
        "vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
