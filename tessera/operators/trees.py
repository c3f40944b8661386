"""Regression trees of all series together (M4 forest, M5 boosting, M6 histogram boosting).

X is shared by the series, so its features are binned once: up to ``bins`` cut
points between neighbouring quantiles (all midpoints where a feature has no
more values). A training row is then a label and its bin numbers.

Two ways lead to the same trees, chosen by the checked size of a series:

* up to ``LOCAL_CELLS`` cells (rows x features) a series is one group of a
  grouped map: all rounds of its model are grown in one task, and all series
  and all blocks of forest trees side by side, in one job; large nodes are cut
  by sums by bin, without sorting a row, small ones in value order;
* larger series are cut into blocks of ``BLOCK_ROWS`` steps and grown level by
  level: tasks sum gradients, weights and counts by (series, tree, node,
  feature, bin) over their blocks, one shuffle adds these histograms, prefix
  sums give the best split of every node. The number of jobs follows rounds x
  depth, not series, and no series is gathered. A forest's nodes that have
  become small enough go on as groups of the first kind.

Trees are rows ``(sid, tree, feature, threshold, left, right, value, n, gain,
depth)`` of flat node arrays (feature -1 at leaves; inner nodes keep their value, so a
tree can be read at any smaller depth). Splits maximise
``GL^2/(WL+l) + GR^2/(WR+l)``; ties (within TIE of the score, as sums in another
order differ in their last bits) go to the lowest feature, then the lowest cut. Row samples come from a hash of (seed, tree, t): Poisson(1) weights for
forests, inclusion for boosting; feature samples of a round are drawn by seed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path, stored

#: cells (rows x features, two bytes each) of a series that is grown in a task
LOCAL_CELLS = 1 << 26
#: cells of a series whose grid search is a task for every (fold, growth), with a copy each
GRID_CELLS = 1 << 23
BLOCK_ROWS = 4096
#: trees of a forest grown in one task, and features whose histograms are merged in one
TREE_BLOCK = 10
FEATURE_BLOCK = 64
CHUNK_CELLS = 1 << 17
#: nodes up to this many rows are cut in value order, larger ones by sums by bin
SORTED_ROWS = 1024
TIE = 1e-10
TREE_SCHEMA = ("sid string, tree int, feature array<int>, threshold array<double>, left array<int>, right array<int>, "
               "value array<double>, n array<bigint>, gain array<double>, depth int")


@dataclass(frozen=True)
class TreeParams:
    """What a family's model is grown with."""
    kind: str = "boost"             # "forest" or "boost"
    trees: int = 100
    depth: int = 3
    rate: float = 0.1
    sample: float = 1.0
    features: float = 1.0           # share of the features a boosting round may use
    min_split: int = 2
    min_leaf: int = 1
    penalty: float = 0.0            # on the squared leaf value
    bins: int = 1024
    seed: int = 42


#: stands for "no limit"; a tree of n rows is never deeper than n
UNLIMITED = 10_000


def family_params(family: str, params: dict, seed: int = 42) -> TreeParams:
    """The reference's hyper-parameters of a tree family."""
    depth = UNLIMITED if params.get("max_depth") is None else int(params["max_depth"])
    common = dict(trees=int(params["n_estimators"]), depth=depth, seed=seed)
    if family == "RandomForest":
        return TreeParams("forest", min_split=int(params.get("min_samples_split", 2)),
                          min_leaf=int(params.get("min_samples_leaf", 1)), **common)
    boost = dict(rate=float(params["learning_rate"]), sample=float(params.get("subsample", 1.0)), **common)
    if family == "GradientBoosting":
        return TreeParams("boost", **boost)
    if family == "XGBoost":
        return TreeParams("boost", features=float(params.get("colsample_bytree", 1.0)), penalty=1.0, bins=256, **boost)
    raise ValueError(f"not a tree family: {family!r}")


# --- random choices -----------------------------------------------------------------------------

def uniform(seed: int, tree: int, t: np.ndarray) -> np.ndarray:
    """Uniform numbers from a 64-bit finaliser of (seed, tree, t)."""
    x = t.astype(np.uint64) + np.uint64(((seed * 1_000_003 + tree + 1) * 0x9E3779B97F4A7C15) % (1 << 64))
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


POISSON = np.cumsum(np.exp(-1.0) / np.cumprod(np.r_[1.0, np.arange(1.0, 16.0)]))


def row_weights(p: TreeParams, tree: int, t: np.ndarray) -> np.ndarray:
    """Poisson(1) counts for a forest, 0 / 1 for a boosting round."""
    if p.kind == "forest":
        return np.searchsorted(POISSON, uniform(p.seed, tree, t)).astype(np.float64)
    return np.ones(len(t)) if p.sample >= 1 else (uniform(p.seed, tree, t) < p.sample).astype(np.float64)


def used_features(p: TreeParams, tree: int, width: int) -> np.ndarray:
    if p.features >= 1:
        return np.arange(width)
    some = np.random.default_rng((p.seed, tree)).permutation(width)[:max(1, int(p.features * width))]
    return np.sort(some)


# --- growing one tree in a task -----------------------------------------------------------------

class Tree:
    """Flat node arrays under construction; cuts are bin numbers."""

    def __init__(self):
        self.feature, self.cut, self.left, self.right, self.value, self.n, self.gain = [], [], [], [], [], [], []

    def add(self, value: float, n: int) -> int:
        for column, x in ((self.feature, -1), (self.cut, 0), (self.left, -1), (self.right, -1), (self.value, value),
                          (self.n, n), (self.gain, 0.0)):
            column.append(x)
        return len(self.feature) - 1

    def split(self, node: int, feature: int, cut: int, gain: float, left: tuple, right: tuple) -> tuple[int, int]:
        self.feature[node], self.cut[node], self.gain[node] = int(feature), int(cut), float(gain)
        self.left[node], self.right[node] = self.add(*left), self.add(*right)
        return self.left[node], self.right[node]

    def split_all(self, nodes: np.ndarray, feature: np.ndarray, cut: np.ndarray, gain: np.ndarray, value: np.ndarray) -> int:
        """Split several nodes; their children, two by two, have the values
        ``value``. Returns the first child's number."""
        first, more = len(self.feature), 2 * len(nodes)
        for column, x in ((self.feature, -1), (self.cut, 0), (self.left, -1), (self.right, -1), (self.n, 0), (self.gain, 0.0)):
            column.extend([x] * more)
        self.value.extend(value.tolist())
        for i, (node, f, c, g) in enumerate(zip(nodes.tolist(), feature.tolist(), cut.tolist(), gain.tolist())):
            self.feature[node], self.cut[node], self.gain[node] = f, c, g
            self.left[node], self.right[node] = first + 2 * i, first + 2 * i + 1
        return first

    def row(self, edges: list[np.ndarray]) -> tuple:
        cut = np.array([edges[f][c] if f >= 0 else 0.0 for f, c in zip(self.feature, self.cut)], np.float64)
        feature, left, right = (np.array(x, np.int32) for x in (self.feature, self.left, self.right))
        return feature, cut, left, right, np.array(self.value, np.float64), np.array(self.n, np.int64), np.array(self.gain, np.float64), max(self.depths())

    def depths(self) -> list[int]:
        """The depth of every node; children stand behind their parent."""
        deep = [0] * len(self.feature)
        for i, (a, b) in enumerate(zip(self.left, self.right)):
            if a >= 0:
                deep[a] = deep[b] = deep[i] + 1
        return deep


def value_order(bins: np.ndarray) -> np.ndarray | None:
    """Row numbers by bin, for every feature (features x rows); None where the
    first node is too large to need them."""
    return np.argsort(bins, axis=1, kind="stable").astype(np.int32) if bins.shape[1] <= SORTED_ROWS else None


def _first_cuts(score: np.ndarray, bound: np.ndarray, which: np.ndarray, node: np.ndarray) -> np.ndarray:
    """For every node the first place where its row ``which`` of ``score`` reaches
    ``bound``; ``node`` numbers the places' nodes, in order. Nodes without any keep 0."""
    hit = np.flatnonzero(score[which[node], np.arange(len(node))] >= bound[node])
    first = np.zeros(len(which), np.int64)
    at = node[hit]
    new = np.r_[True, at[1:] != at[:-1]] if len(at) else np.zeros(0, bool)
    first[at[new]] = hit[new]
    return first


def _take_better(best: tuple, at: np.ndarray, most: np.ndarray, enough: np.ndarray, found: tuple) -> None:
    """Put the nodes ``at`` whose best score beats the features before into ``best``
    (score, feature, cut, left sum, left weight)."""
    better = enough > best[0][at]
    for old, new in zip(best, (most, *found)):
        old[at[better]] = new[better]


def _sorted_cuts(best: tuple, at: np.ndarray, cur: np.ndarray, bins: np.ndarray, wy: np.ndarray, w: np.ndarray, unit: bool,
                 counts: np.ndarray, sums: np.ndarray, weights: np.ndarray, p: TreeParams, use: np.ndarray) -> None:
    """The best cuts of the nodes ``at`` from running sums over ``cur``, their
    rows in value order, node after node."""
    starts = np.r_[0, np.cumsum(counts)[:-1]]
    m = int(counts.sum())
    node = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(m) - starts[node] + 1                 # rows to the left, this one included
    behind = counts[node] - place
    allowed = (place >= p.min_leaf) & (behind >= max(p.min_leaf, 1))
    G, W = sums[node], weights[node]
    step = max(1, CHUNK_CELLS // max(m, 1))

    def running(x: np.ndarray, o: np.ndarray) -> np.ndarray:
        total = x.take(o)
        np.cumsum(total, axis=1, out=total)
        total -= np.where(starts > 0, total[:, starts - 1], 0.0).take(node, axis=1)
        return total

    for lo in range(0, len(cur), step):
        o = cur[lo:lo + step].astype(np.intp)
        b = np.empty(o.shape, bins.dtype)
        for i, f in enumerate(use[lo:lo + step]):
            b[i] = bins[f].take(o[i])
        gl = running(wy, o)
        wl = place[None, :].astype(np.float64) if unit else running(w, o)
        ok = np.empty(b.shape, bool)
        np.not_equal(b[:, :-1], b[:, 1:], out=ok[:, :-1])
        ok[:, -1] = False
        ok &= allowed
        with np.errstate(divide="ignore", invalid="ignore"):
            score = gl * gl
            score /= wl + p.penalty
            rest = G - gl
            rest *= rest
            rest /= W - wl + p.penalty
            score += rest
        np.copyto(score, -np.inf, where=~ok)
        top = np.maximum.reduceat(score, starts, axis=1)
        most = top.max(0)
        enough = most - TIE * np.abs(np.where(np.isfinite(most), most, 0.0))
        which = (top >= enough).argmax(0)
        i = _first_cuts(score, enough, which, node)
        _take_better(best, at, most, enough, (use[lo + which], b[which, i], gl[which, i], wl[np.zeros_like(which) if unit else which, i]))


def _counted_cuts(best: tuple, at: np.ndarray, rows: np.ndarray, slot: np.ndarray, bins: np.ndarray, wy: np.ndarray, w: np.ndarray,
                  unit: bool, counts: np.ndarray, sums: np.ndarray, weights: np.ndarray, p: TreeParams, use: np.ndarray,
                  n_bins: int) -> None:
    """The best cuts of the nodes ``at`` from sums by bin; ``slot`` is each of
    the ``rows``' number in ``at``. No row is sorted."""
    size = len(at) * n_bins
    base, g_of, w_of = slot * n_bins, wy[rows], w[rows]
    every = len(rows) == bins.shape[1]
    G, W, C = sums[:, None], weights[:, None], counts[:, None]
    for f in use:
        flat = base + (bins[f] if every else bins[f].take(rows))
        gl = np.cumsum(np.bincount(flat, g_of, size).reshape(-1, n_bins), axis=1)
        cl = wl = np.cumsum((np.bincount(flat, None, size) if unit else np.bincount(flat, w_of, size)).reshape(-1, n_bins), axis=1)
        if not unit and p.min_leaf > 1:
            cl = np.cumsum(np.bincount(flat, None, size).reshape(-1, n_bins), axis=1)
            ok = (cl >= p.min_leaf) & (C - cl >= p.min_leaf)
        elif unit:
            ok = (cl >= max(p.min_leaf, 1)) & (C - cl >= max(p.min_leaf, 1))
        else:
            ok = (wl > 0) & (W - wl > 0)                    # whole weights: none is lost in a sum
        with np.errstate(divide="ignore", invalid="ignore"):
            score = gl * gl
            score /= wl + p.penalty
            rest = G - gl
            rest *= rest
            rest /= W - wl + p.penalty
            score += rest
        np.copyto(score, -np.inf, where=~ok)
        most = score.max(1)
        enough = most - TIE * np.abs(np.where(np.isfinite(most), most, 0.0))
        better = np.flatnonzero(enough > best[0][at])
        if len(better):
            cut = (score[better] >= enough[better, None]).argmax(1)
            _take_better(best, at[better], most[better], enough[better],
                         (np.full(len(better), f), cut, gl[better, cut], wl[better, cut].astype(np.float64)))


def grow(bins: np.ndarray, order: np.ndarray | None, y: np.ndarray, w: np.ndarray, p: TreeParams, use: np.ndarray) -> tuple[Tree, np.ndarray]:
    """One tree on ``y`` with row weights ``w``, level by level, all nodes of a
    level at once: those of more than SORTED_ROWS rows from sums by bin, the
    others from running sums in value order. ``bins`` and ``order`` (None: rows
    are put in order where they are needed) are features x rows. Returns the tree and the leaf of every row, rows of weight
    0 included."""
    tree, at = Tree(), np.zeros(len(y), np.int64)
    wy = w * y
    total, weight = float(wy.sum()), float(w.sum())
    inside = w > 0
    rows = int(np.count_nonzero(inside))
    tree.add(total / (weight + p.penalty) if weight else 0.0, rows)
    least = 1e-13 * float((wy * y).sum()) + 1e-300
    unit = bool((w[inside] == 1).all())
    n_bins = int(bins.max(initial=0)) + 1 if rows > SORTED_ROWS else 0
    enough_rows = max(p.min_split, 2 * p.min_leaf, 2)

    def in_order(some: np.ndarray) -> np.ndarray:
        """The rows ``some`` in value order, for every used feature."""
        if order is not None and len(use) == len(order) and some.all():
            return order
        rows = np.flatnonzero(some).astype(np.int32)
        out = np.empty((len(use), len(rows)), np.int32)
        for i, f in enumerate(use):
            out[i] = rows[bins[f].take(rows).argsort(kind="stable")] if order is None else order[f][some[order[f]]]
        return out

    # rows in nodes that are still split: their node's number among those; in value order where the node is small
    nodes, counts = np.array([0]), np.array([rows])
    sums, weights = np.array([total]), np.array([weight])
    slot = np.where(inside, 0, -1)
    small = counts <= SORTED_ROWS
    cur = in_order(inside) if small[0] else np.zeros((len(use), 0), np.int32)
    depth = 0
    while len(nodes) and depth < p.depth and counts.max() >= enough_rows:
        k = len(nodes)
        best = (np.full(k, -np.inf), np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros(k), np.zeros(k))
        if small.any():
            j = np.flatnonzero(small)
            _sorted_cuts(best, j, cur, bins, wy, w, unit, counts[j], sums[j], weights[j], p, use)
        if not small.all():
            j = np.flatnonzero(~small)
            some = np.flatnonzero((slot >= 0) & ~small[slot])
            number = np.cumsum(~small) - 1
            _counted_cuts(best, j, some, number[slot[some]], bins, wy, w, unit, counts[j], sums[j], weights[j], p, use, n_bins)
        top, winner, cuts, lefts, left_w = best
        gains = top - sums ** 2 / (weights + p.penalty)
        split = np.flatnonzero((gains > least) & (counts >= p.min_split))
        if not len(split):
            break
        new_sums = np.stack([lefts[split], sums[split] - lefts[split]], 1).ravel()
        new_weights = np.stack([left_w[split], weights[split] - left_w[split]], 1).ravel()
        first = tree.split_all(nodes[split], winner[split], cuts[split], gains[split], new_sums / (new_weights + p.penalty))
        # every row goes to its child; the right one stands behind the left one
        feature = np.full(first, -1, np.int64)
        cut, left = np.zeros(first, np.int64), np.zeros(first, np.int64)
        feature[nodes[split]], cut[nodes[split]] = winner[split], cuts[split]
        left[nodes[split]] = first + 2 * np.arange(len(split))
        f = feature[at]
        moving = np.flatnonzero(f >= 0)
        old = at[moving]
        at[moving] = left[old] + (bins[f[moving], moving] > cut[old])
        child = np.where(inside & (at >= first), at - first, -1)
        new_counts = np.bincount(child[child >= 0], minlength=2 * len(split))
        tree.n[first:] = new_counts.tolist()
        depth += 1
        alive = (new_counts >= enough_rows) & (depth < p.depth)
        if not alive.any():
            break
        was_small = np.r_[small, True][slot]                # rows of no node do not matter
        number = np.where(alive, np.cumsum(alive) - 1, -1)
        slot = np.where(child >= 0, number[child], -1)
        nodes = first + np.flatnonzero(alive)
        counts, sums, weights = new_counts[alive], new_sums[alive], new_weights[alive]
        small = counts <= SORTED_ROWS
        sorted_now = np.r_[small, False][slot]
        fresh = sorted_now & ~was_small
        if fresh.any():
            cur = np.concatenate([cur, in_order(fresh)], axis=1)
        # value order within each node: a stable sort by the small nodes' numbers
        m, n_small = int(counts[small].sum()), int(small.sum())
        where = np.where(sorted_now, (np.cumsum(small) - 1)[slot], n_small).astype(np.uint16 if n_small < 65_000 else np.int64)
        after = np.empty((len(cur), m), np.int32)
        for i, o in enumerate(cur):
            after[i] = o.take(where.take(o).argsort(kind="stable")[:m])
        cur = after
    return tree, at


def walk(tree: Tree, bins: np.ndarray) -> np.ndarray:
    """The leaf of every row (bins: features x rows)."""
    feature, cut = np.array(tree.feature), np.array(tree.cut)
    left, right = np.array(tree.left), np.array(tree.right)
    at = np.zeros(bins.shape[1], np.int64)
    while True:
        f = feature[at]
        moving = np.flatnonzero(f >= 0)
        if not len(moving):
            return at
        old = at[moving]
        at[moving] = np.where(bins[f[moving], moving] <= cut[old], left[old], right[old])


def boost(bins: np.ndarray, y: np.ndarray, t: np.ndarray, p: TreeParams) -> Iterator[tuple[int, Tree]]:
    """The rounds of a boosted model; the first "tree" is the mean, a single node."""
    base = Tree()
    base.add(float(y.mean()), len(y))
    yield 0, base
    order, rest = value_order(bins), y - y.mean()
    for k in range(1, p.trees + 1):
        tree, at = grow(bins, order, rest, row_weights(p, k, t), p, used_features(p, k, len(bins)))
        tree.value = [v * p.rate for v in tree.value]
        rest = rest - np.array(tree.value)[at]
        yield k, tree


def forest(bins: np.ndarray, y: np.ndarray, t: np.ndarray, p: TreeParams, numbers: range) -> Iterator[tuple[int, Tree]]:
    """The trees ``numbers`` of a forest, each on its own row weights."""
    order, middle = value_order(bins), float(y.mean())
    every = np.arange(len(bins))
    for k in numbers:
        tree, _ = grow(bins, order, y - middle, row_weights(p, k, t), p, every)
        tree.value = [v + middle for v in tree.value]
        yield k, tree


# --- binning ------------------------------------------------------------------------------------

def _array(features: str, df: DataFrame):
    return vector_to_array(features) if isinstance(df.schema[features].dataType, VectorUDT) else F.col(features).cast("array<double>")


def cut_points(X: DataFrame, bins: int, features: str = "features") -> list[np.ndarray]:
    """Per feature the cuts between neighbouring quantiles; at most bins - 1
    numbers for each feature come to the driver, whatever the rows."""
    long = X.select(F.posexplode(_array(features, X)).alias("idx", "x"))
    share = F.array(*[F.lit(i / bins) for i in range(bins + 1)])
    rows = long.groupBy("idx").agg(F.array_distinct(F.percentile_approx("x", share, F.lit(10 * bins))).alias("q")).collect()
    found = {r["idx"]: np.array(r["q"], np.float64) for r in rows}
    out = []
    for i in range(max(found, default=-1) + 1):
        q = np.unique(found[i])
        out.append(np.unique((q[:-1] + q[1:]) / 2))
    return out


def binned(X: DataFrame, edges: list[np.ndarray], features: str = "features") -> DataFrame:
    """``t, bins``: 16-bit bin numbers of every row; bin b is x <= edges[b]."""
    shared = X.sparkSession.sparkContext.broadcast(edges)   # width x bins numbers

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            x = np.stack(pdf["x"].to_numpy()) if len(pdf) else np.zeros((0, len(shared.value)))
            b = np.stack([np.searchsorted(e, x[:, i]) for i, e in enumerate(shared.value)], 1) if len(shared.value) else np.zeros((len(x), 0))
            yield pd.DataFrame({"t": pdf["t"], "bins": [r.tobytes() for r in b.astype("<u2")]})

    return X.select("t", _array(features, X).alias("x")).mapInPandas(run, "t bigint, bins binary")


def _matrix(column, width: int) -> np.ndarray:
    """features x rows from packed rows."""
    flat = np.frombuffer(b"".join(column), "<u2")
    return np.ascontiguousarray(flat.reshape(-1, width).T) if width else np.zeros((0, len(column)), np.uint16)


def _tree_rows(sid, grown: Iterator[tuple[int, Tree]], edges) -> pd.DataFrame:
    names = [f.split()[0] for f in TREE_SCHEMA.split(", ")]
    return pd.DataFrame([(sid, k, *t.row(edges)) for k, t in grown], columns=names)


# --- all series ---------------------------------------------------------------------------------

def fit_trees(X: DataFrame, labels: DataFrame, p: TreeParams, rows=None, features: str = "features",
              per_series: dict[str, TreeParams] | None = None, local_cells: int | None = None,
              edges: list[np.ndarray] | None = None) -> DataFrame:
    """The trees of every series of ``labels (sid, t, label)`` (TREE_SCHEMA),
    written once. ``per_series`` gives series their own parameters; ``edges``
    are cut points already known."""
    limit = LOCAL_CELLS if local_cells is None else local_cells
    lab = (labels if rows is None else labels.filter(rows)).select(F.col("sid").cast("string").alias("sid"), "t",
                                                                   F.col("label").cast("double").alias("y")).filter("y IS NOT NULL")
    steps = X.join(lab.select("t").distinct(), "t", "left_semi")
    edges = cut_points(steps, p.bins, features) if edges is None else edges
    data = stored(lab.join(binned(steps, edges, features), "t"), "binned")
    sizes = data.groupBy("sid").agg(F.count(F.lit(1)).alias("n_rows"))
    large = stored(sizes.filter(F.col("n_rows") * len(edges) > limit), "large")
    n_small, n_large = sizes.count(), large.count()
    out = _fit_local(data.join(F.broadcast(large), "sid", "left_anti") if n_large < 10_000 else
                     data.join(large, "sid", "left_anti"), n_small - n_large, p, edges, per_series or {})
    out = stored(out, "trees")
    if n_large:
        out = out.unionByName(_fit_blocks(data.join(large, "sid"), p, edges, per_series or {}, limit))
    return out


def _fit_local(data: DataFrame, n_series: int, p: TreeParams, edges: list[np.ndarray], per: dict[str, TreeParams]) -> DataFrame:
    """Series that fit a task: groups of (series, block of forest trees)."""
    shared = data.sparkSession.sparkContext.broadcast((edges, per))
    most = max([p.trees, *[q.trees for q in per.values()]])
    blocks = -(-most // TREE_BLOCK) if p.kind == "forest" else 1
    spread = data.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        edges, per = shared.value
        q = per.get(key[0], p)
        pdf = pdf.sort_values("t", kind="stable")
        bins, y, t = _matrix(pdf["bins"], len(edges)), pdf["y"].to_numpy(), pdf["t"].to_numpy()
        if q.kind == "boost":
            return _tree_rows(key[0], boost(bins, y, t, q), edges)
        mine = range(key[1] * TREE_BLOCK, min(q.trees, (key[1] + 1) * TREE_BLOCK))
        return _tree_rows(key[0], forest(bins, y, t, q, mine), edges)

    parts = max(1, min(2 * n_series * blocks, 4096))
    return spread.repartition(parts, "sid", "part").groupBy("sid", "part").applyInPandas(run, TREE_SCHEMA)


# --- series beyond a task -----------------------------------------------------------------------

HIST = "sid string, tree int, node int, part int, squares double, hist binary"
SPLIT = ("sid string, tree int, node int, gain double, feature int, cut int, gl double, wl double, cl bigint, "
         "g double, w double, c bigint, squares double")
HELD_BYTES = 64 << 20


class Growing:
    """A tree that is grown across tasks: its nodes, the depth of the open ones,
    and those that have become small enough for a task."""

    def __init__(self, number: int):
        self.number, self.tree, self.open, self.small, self.least = number, Tree(), {0: 0}, {}, 0.0
        self.tree.add(0.0, 0)

    def settle(self, found: dict[int, dict], p: TreeParams, small_rows: int) -> None:
        """Take the best splits of the open nodes."""
        todo, self.open = self.open, {}
        for node, depth in todo.items():
            s = found.get(node)
            if s is None:
                continue
            if node == 0 and depth == 0:
                self.tree.value[0], self.tree.n[0] = s["g"] / (s["w"] + p.penalty) if s["w"] else 0.0, int(s["c"])
                self.least = 1e-13 * s["squares"] + 1e-300
            if s["feature"] < 0 or s["gain"] <= self.least or s["c"] < p.min_split:
                continue
            sides = [(s["gl"], s["wl"], s["cl"]), (s["g"] - s["gl"], s["w"] - s["wl"], s["c"] - s["cl"])]
            children = self.tree.split(node, s["feature"], s["cut"], s["gain"],
                                       *[(g / (w + p.penalty), int(c)) for g, w, c in sides])
            for child, (_, _, c) in zip(children, sides):
                if depth + 1 < p.depth and c >= max(p.min_split, 2 * p.min_leaf, 2):
                    (self.small if p.kind == "forest" and c <= small_rows else self.open)[child] = depth + 1


def node_histograms(bins: np.ndarray, y: np.ndarray, w: np.ndarray, n_bins: int) -> np.ndarray:
    """Sums of w * y, w and rows by (feature, bin): 3 x features x bins."""
    flat = (bins + (np.arange(len(bins)) * n_bins)[:, None]).ravel()
    size = len(bins) * n_bins
    rows = [np.broadcast_to(x, bins.shape).ravel() for x in (w * y, w, (w > 0).astype(np.float64))]
    return np.stack([np.bincount(flat, x, size).reshape(len(bins), n_bins) for x in rows])


def best_cut(hist: np.ndarray, p: TreeParams, use: np.ndarray) -> dict:
    """The best split in a node's histograms of the features ``use``."""
    g, w, c = (h[0].sum() for h in hist)
    gl, wl, cl = np.cumsum(hist, axis=2)
    ok = (cl >= max(p.min_leaf, 1)) & (c - cl >= max(p.min_leaf, 1))
    with np.errstate(divide="ignore", invalid="ignore"):
        score = gl * gl / (wl + p.penalty) + (g - gl) ** 2 / (w - wl + p.penalty)
    score[~ok] = -np.inf
    most = score.max()
    f, b = np.unravel_index(int((score >= most - TIE * abs(most)).argmax()) if ok.any() else 0, score.shape)
    none = {"gain": float("-inf"), "feature": -1, "cut": 0, "gl": 0.0, "wl": 0.0, "cl": 0, "g": g, "w": w, "c": int(c)}
    if not ok.any():
        return none
    return {"gain": float(score[f, b] - g * g / (w + p.penalty)), "feature": int(use[f]), "cut": int(b), "gl": float(gl[f, b]),
            "wl": float(wl[f, b]), "cl": int(cl[f, b]), "g": float(g), "w": float(w), "c": int(c)}


def _blocks(data: DataFrame, middle: DataFrame) -> DataFrame:
    """``sid, blk, t, y, bins``: steps of a series in blocks, y less its mean."""
    rows = data.join(middle, "sid").select("sid", F.floor(F.col("t") / BLOCK_ROWS).alias("blk"),
                                           F.struct("t", (F.col("y") - F.col("mean")).alias("y"), "bins").alias("r"))
    packed = rows.groupBy("sid", "blk").agg(F.array_sort(F.collect_list("r")).alias("r"))
    return stored(packed.select("sid", "blk", F.col("r.t").alias("t"), F.col("r.y").alias("y"), F.col("r.bins").alias("bins")), "blocks")


def _fit_blocks(data: DataFrame, p: TreeParams, edges: list[np.ndarray], per: dict[str, TreeParams], limit: int) -> DataFrame:
    """Level-wise growth of all large series together."""
    import pickle

    spark = data.sparkSession
    shared = spark.sparkContext.broadcast((edges, per))
    width, n_bins = len(edges), max(len(e) for e in edges) + 1
    small_rows = max(1, limit // max(width, 1))
    middle = stored(data.groupBy("sid").agg(F.avg("y").alias("mean"), F.count(F.lit(1)).alias("n")), "means")
    blocks = _blocks(data, middle)
    out = scratch_path(spark, "trees")
    STATE = "sid string, n_open bigint, state binary"

    def begin(numbers):
        def run(it):
            for pdf in it:
                _, per = shared.value
                rows = []
                for sid in pdf["sid"]:
                    some = [Growing(k) for k in numbers if k <= per.get(sid, p).trees - (per.get(sid, p).kind == "forest")]
                    rows.append((sid, sum(len(g.open) for g in some), pickle.dumps(some)))
                yield pd.DataFrame(rows, columns=["sid", "n_open", "state"])
        return stored(middle.select("sid").mapInPandas(run, STATE), "growing")

    def partial(it):
        edges, per = shared.value
        held, squares, size = {}, {}, 0

        def flush():
            rows = [(*k, squares[k], h.tobytes()) for k, h in held.items()]
            held.clear()
            squares.clear()
            for i in range(0, len(rows), 64):
                yield pd.DataFrame(rows[i:i + 64], columns=[c.split()[0] for c in HIST.split(", ")])

        for pdf in it:
            for sid, state, t, y, packed in zip(pdf["sid"], pdf["state"], pdf["t"], pdf["y"], pdf["bins"]):
                q, t, y, bins = per.get(sid, p), np.asarray(t), np.asarray(y), _matrix(packed, width)
                for g in pickle.loads(state):
                    if not g.open:
                        continue
                    w = row_weights(q, g.number, t)
                    leaf = walk(g.tree, bins)
                    use = used_features(q, g.number, width)
                    for node in g.open:
                        rows = np.flatnonzero((leaf == node) & (w > 0))
                        if not len(rows):
                            continue
                        for part in range(0, len(use), FEATURE_BLOCK):
                            h = node_histograms(bins[np.ix_(use[part:part + FEATURE_BLOCK], rows)].astype(np.int64), y[rows], w[rows], n_bins)
                            key = (sid, g.number, node, part)
                            squares[key] = squares.get(key, 0.0) + float((w[rows] * y[rows] ** 2).sum())
                            if key in held:
                                held[key] += h
                            else:
                                held[key], size = h, size + h.nbytes
                        if size > HELD_BYTES:
                            yield from flush()
                            size = 0
        yield from flush()

    def choose(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, per = shared.value
        sid, tree, node, part = key
        q = per.get(sid, p)
        use = used_features(q, tree, width)[part:part + FEATURE_BLOCK]
        hist = sum(np.frombuffer(h, np.float64) for h in pdf["hist"]).reshape(3, len(use), n_bins)
        s = best_cut(hist, q, use)
        return pd.DataFrame([{"sid": sid, "tree": tree, "node": node, **s, "squares": float(pdf["squares"].sum())}])

    def settle(it):
        _, per = shared.value
        for pdf in it:
            rows = []
            for sid, state, found in zip(pdf["sid"], pdf["state"], pdf["found"]):
                some, q = pickle.loads(state), per.get(sid, p)
                by = {}
                for s in found if found is not None else ():
                    mine = by.setdefault(s["tree"], {})
                    held = mine.get(s["node"])
                    if held is None or s["gain"] > held["gain"] + TIE * (abs(held["gain"]) + held["g"] ** 2 / max(held["w"], 1e-300)):
                        mine[s["node"]] = s
                for g in some:
                    g.settle(by.get(g.number, {}), q, small_rows)
                rows.append((sid, sum(len(g.open) for g in some), pickle.dumps(some)))
            yield pd.DataFrame(rows, columns=["sid", "n_open", "state"])

    def level(state, source):
        hist = source.join(state.filter("n_open > 0").select("sid", "state"), "sid").mapInPandas(partial, HIST)
        splits = hist.groupBy("sid", "tree", "node", "part").applyInPandas(choose, SPLIT)
        names = [c.split()[0] for c in SPLIT.split(", ")]
        # a row for each open node and block of features: the node's first block within a tie of its best
        found = splits.groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("tree", "node", "feature", *[
            n for n in names if n not in ("tree", "node", "feature")]))).alias("found"))
        return stored(state.join(found, "sid", "left").select("sid", "state", "found").mapInPandas(settle, STATE), "growing")

    def finish(state, source):
        """Grow until no large node is open."""
        while state.agg(F.sum("n_open")).first()[0]:
            state = level(state, source)
        return state

    def rows_of(scale):
        def run(it):
            edges, per = shared.value
            for pdf in it:
                for sid, state, mean in zip(pdf["sid"], pdf["state"], pdf["mean"]):
                    q, grown = per.get(sid, p), []
                    for g in pickle.loads(state):
                        g.tree.value = [v * q.rate if scale else v + mean for v in g.tree.value]
                        grown.append((g.number, g.tree))
                    yield _tree_rows(sid, grown, edges)
        return run

    if p.kind == "forest":
        most = max([p.trees, *[q.trees for q in per.values()]])
        top = finish(begin(range(most)), blocks)
        _graft_small(top, blocks, shared, p, width).join(middle, "sid").mapInPandas(rows_of(False), TREE_SCHEMA).write.parquet(out)
        return spark.read.schema(TREE_SCHEMA).parquet(out)

    first = middle.select("sid", F.lit(0).alias("tree"), F.array(F.lit(-1)).alias("feature"), F.array(F.lit(0.0)).alias("threshold"),
                          F.array(F.lit(-1)).alias("left"), F.array(F.lit(-1)).alias("right"), F.array("mean").alias("value"),
                          F.array("n").alias("n"), F.array(F.lit(0.0)).alias("gain"), F.lit(0).alias("depth"))
    first.write.parquet(out)

    def remain(it):
        _, per = shared.value
        for pdf in it:
            rest = []
            for sid, state, y, packed in zip(pdf["sid"], pdf["state"], pdf["y"], pdf["bins"]):
                r = np.asarray(y).copy()
                for g in pickle.loads(state):
                    r -= per.get(sid, p).rate * np.array(g.tree.value)[walk(g.tree, _matrix(packed, width))]
                rest.append(r)
            yield pd.DataFrame({"sid": pdf["sid"], "blk": pdf["blk"], "y": rest})

    most = max([p.trees, *[q.trees for q in per.values()]])
    rest, fixed = blocks.select("sid", "blk", "y"), blocks.drop("y")
    for k in range(1, most + 1):
        source = fixed.join(rest, ["sid", "blk"])
        state = finish(begin([k]), source)
        state.join(middle, "sid").mapInPandas(rows_of(True), TREE_SCHEMA).write.mode("append").parquet(out)
        if k < most:
            rest = stored(source.join(state.select("sid", "state"), "sid").select("sid", "blk", "y", "bins", "state").mapInPandas(
                remain, "sid string, blk bigint, y array<double>"), "residuals")
    return spark.read.schema(TREE_SCHEMA).parquet(out)


def _graft_small(top: DataFrame, blocks: DataFrame, shared, p: TreeParams, width: int) -> DataFrame:
    """The forest's nodes that fit a task, grown there and put into their trees:
    ``sid, state`` with one tree a row."""
    import pickle

    def rows(it):
        _, per = shared.value
        for pdf in it:
            for sid, state, t, y, packed in zip(pdf["sid"], pdf["state"], pdf["t"], pdf["y"], pdf["bins"]):
                q, t, y, bins = per.get(sid, p), np.asarray(t), np.asarray(y), _matrix(packed, width)
                raw = np.array(list(packed), object)
                for g in pickle.loads(state):
                    w, leaf = row_weights(q, g.number, t), walk(g.tree, bins)
                    for node, depth in g.small.items():
                        i = np.flatnonzero((leaf == node) & (w > 0))
                        if len(i):
                            yield pd.DataFrame({"sid": sid, "tree": g.number, "node": node, "depth": depth, "least": g.least, "t": t[i],
                                                "y": y[i], "w": w[i], "bins": raw[i]})

    def grown(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, per = shared.value
        q = per.get(key[0], p)
        pdf = pdf.sort_values("t", kind="stable")
        bins = _matrix(pdf["bins"], width)
        left = replace(q, depth=q.depth - int(pdf["depth"].iloc[0]))
        tree, _ = grow(bins, value_order(bins), pdf["y"].to_numpy(), pdf["w"].to_numpy(), left, np.arange(width))
        return pd.DataFrame([(key[0], key[1], key[2], pickle.dumps(tree))], columns=["sid", "tree", "node", "grown"])

    def graft(it):
        for pdf in it:
            out = []
            for sid, state, subs in zip(pdf["sid"], pdf["state"], pdf["subs"]):
                (g,) = pickle.loads(state)
                for s in subs if subs is not None else ():
                    node, sub = s["node"], pickle.loads(s["grown"])
                    shift = len(g.tree.feature) - 1         # the subtree's root takes the node's place
                    move = lambda i: -1 if i < 0 else i + shift  # noqa: E731, B023
                    for name in ("feature", "cut", "value", "n", "gain"):
                        mine, more = getattr(g.tree, name), getattr(sub, name)
                        mine[node] = more[0]
                        mine.extend(more[1:])
                    for name in ("left", "right"):
                        mine, more = getattr(g.tree, name), [move(i) for i in getattr(sub, name)]
                        mine[node] = more[0]
                        mine.extend(more[1:])
                out.append((sid, pickle.dumps([g])))
            yield pd.DataFrame(out, columns=["sid", "state"])

    def single(it):
        for pdf in it:
            yield pd.DataFrame([(sid, g.number, pickle.dumps([g])) for sid, state in zip(pdf["sid"], pdf["state"])
                                for g in pickle.loads(state)], columns=["sid", "tree", "state"])

    source = blocks.join(top.select("sid", "state"), "sid")
    nodes = source.mapInPandas(rows, "sid string, tree int, node int, depth int, least double, t bigint, y double, w double, bins binary")
    subs = nodes.groupBy("sid", "tree", "node").applyInPandas(grown, "sid string, tree int, node int, grown binary")
    each = top.mapInPandas(single, "sid string, tree int, state binary")
    joined = each.join(subs.groupBy("sid", "tree").agg(F.collect_list(F.struct("node", "grown")).alias("subs")), ["sid", "tree"], "left")
    return joined.select("sid", "state", "subs").mapInPandas(graft, "sid string, state binary")


# --- grids --------------------------------------------------------------------------------------

#: what a grown model gives for free: a boosted one at fewer rounds, a forest
#: also at smaller depths and larger nodes, as these only end branches earlier
READ_OFF = {"boost": ("n_estimators",), "forest": ("n_estimators", "max_depth", "min_samples_split")}


def pruned_values(tree: Tree, bins: np.ndarray, depth: int, min_split: int) -> np.ndarray:
    """What the tree would give had it been grown with these limits."""
    n, value = np.array(tree.n), np.array(tree.value)
    feature = np.where(n >= min_split, np.array(tree.feature), -1)
    cut, left, right = np.array(tree.cut), np.array(tree.left), np.array(tree.right)
    at = np.zeros(bins.shape[1], np.int64)
    for _ in range(depth):
        f = feature[at]
        moving = np.flatnonzero(f >= 0)
        if not len(moving):
            break
        old = at[moving]
        at[moving] = np.where(bins[f[moving], moving] <= cut[old], left[old], right[old])
    return value[at]


def _staged_errors(grown: Iterator[tuple[int, Tree]], p: TreeParams, points: list[tuple[int, dict]], bins: np.ndarray,
                   y: np.ndarray) -> Iterator[tuple[int, float]]:
    """(point, mean squared error) of all grid points that one growth serves."""
    forest_ = p.kind == "forest"
    limits = sorted({(UNLIMITED if q.get("max_depth") is None else q["max_depth"], q.get("min_samples_split", 2))
                     for _, q in points}) if forest_ else [(UNLIMITED, 0)]
    sums = {c: np.zeros(len(y)) for c in limits}
    for k, tree in grown:
        deepest, seen = max(tree.depths()), {}
        for c in limits:
            key = (min(c[0], deepest), c[1])
            if key not in seen:
                seen[key] = pruned_values(tree, bins, *key)
            sums[c] += seen[key]
        done = k + 1 if forest_ else k
        for i, q in points:
            if q["n_estimators"] == done:
                c = limits[0] if not forest_ else (UNLIMITED if q.get("max_depth") is None else q["max_depth"], q.get("min_samples_split", 2))
                yield i, float(np.mean((y - (sums[c] / done if forest_ else sums[c])) ** 2))


def grid_errors(X: DataFrame, labels: DataFrame, family: str, defaults: dict, points: list[dict], folds: list[tuple], seed: int = 42,
                features: str = "features", local_cells: int | None = None) -> DataFrame:
    """G2 for a tree family: ``sid, point, fold, mse`` for every series of
    ``labels``, every grid point and every fold (fold, train_lo, test_lo,
    test_hi). Features are binned once; points that differ in what can be read
    off a grown model share its growth. A group is (series, fold, growth)."""
    limit = GRID_CELLS if local_cells is None else local_cells
    kind = family_params(family, {**defaults, **points[0]}).kind
    shared_by: dict[tuple, list[tuple[int, dict]]] = {}
    for i, q in enumerate(points):
        full = {**defaults, **q}
        shared_by.setdefault(tuple(sorted((k, v) for k, v in full.items() if k not in READ_OFF[kind])), []).append((i, full))
    growths = []
    for group in shared_by.values():
        most = {**group[0][1], "n_estimators": max(q["n_estimators"] for _, q in group)}
        if kind == "forest":
            depths = [q.get("max_depth") for _, q in group]
            most["max_depth"] = None if None in depths else max(depths)
            most["min_samples_split"] = min(q.get("min_samples_split", 2) for _, q in group)
        growths.append((family_params(family, most, seed), group))

    first, last = min(f[1] for f in folds), max(f[3] for f in folds)
    lab = labels.filter((F.col("t") >= first) & (F.col("t") < last)).select(
        F.col("sid").cast("string").alias("sid"), "t", F.col("label").cast("double").alias("y")).filter("y IS NOT NULL")
    steps = X.join(lab.select("t").distinct(), "t", "left_semi")
    edges = cut_points(steps, growths[0][0].bins, features)
    sizes = lab.groupBy("sid").agg(F.count(F.lit(1)).alias("n_rows"))
    large = [r["sid"] for r in sizes.filter(F.col("n_rows") * max(len(edges), 1) > limit).collect()]
    width = len(edges)
    tasks = X.sparkSession.sparkContext.broadcast((folds, growths))
    jobs = F.array(*[F.struct(F.lit(f[1]).alias("lo"), F.lit(f[3]).alias("hi"), F.lit(i).alias("fold_at"), F.lit(g).alias("growth"))
                     for i, f in enumerate(folds) for g in range(len(growths))])
    data = lab.filter(~F.col("sid").isin(large)).join(binned(steps, edges, features), "t")
    spread = data.withColumn("j", F.explode(jobs)).filter("t >= j.lo AND t < j.hi").select("sid", "t", "y", "bins", "j.fold_at", "j.growth")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        folds, growths = tasks.value
        fold, _, test_lo, _ = folds[key[1]]
        p, points = growths[key[2]]
        pdf = pdf.sort_values("t", kind="stable")
        t, y, bins = pdf["t"].to_numpy(), pdf["y"].to_numpy(), _matrix(pdf["bins"], width)
        train = t < test_lo
        if not train.any() or train.all():
            return pd.DataFrame(columns=["sid", "point", "fold", "mse"])
        inner = np.ascontiguousarray(bins[:, train])
        grown = forest(inner, y[train], t[train], p, range(p.trees)) if p.kind == "forest" else boost(inner, y[train], t[train], p)
        rows = [(key[0], i, fold, e) for i, e in _staged_errors(grown, p, points, bins[:, ~train], y[~train])]
        return pd.DataFrame(rows, columns=["sid", "point", "fold", "mse"])

    schema = "sid string, point int, fold bigint, mse double"
    parts = max(1, min(2 * sizes.count() * len(folds) * len(growths), 4096))
    out = spread.repartition(parts, "sid", "fold_at", "growth").groupBy("sid", "fold_at", "growth").applyInPandas(run, schema)
    if not large:
        return out
    from . import model_table
    for fold, lo, test_lo, hi in folds:         # series beyond a task: a model a point, grown by blocks
        for i, q in enumerate(points):
            p = family_params(family, {**defaults, **q}, seed)
            some = labels.filter(F.col("sid").isin(large))
            grown = fit_trees(X, some, p, (F.col("t") >= lo) & (F.col("t") < test_lo), features, local_cells=limit,
                              edges=edges)
            m = model_table.tree_models("m", grown, p.kind == "forest")
            err = model_table.predict_models(m, X, some, (F.col("t") >= test_lo) & (F.col("t") < hi), features)
            out = out.unionByName(err.groupBy("sid").agg(F.avg((F.col("y") - F.col("yhat")) ** 2).alias("mse")).select(
                "sid", F.lit(i).alias("point"), F.lit(fold).cast("bigint").alias("fold"), "mse"))
    return out


def best_points(errors: DataFrame) -> DataFrame:
    """``sid, point, cv_mse``: the least mean over the folds, the first point on ties."""
    mean = errors.groupBy("sid", "point").agg(F.avg("mse").alias("cv_mse"))
    return mean.groupBy("sid").agg(F.min_by(F.struct("point", "cv_mse"), F.struct("cv_mse", "point")).alias("b")).select("sid", "b.*")
