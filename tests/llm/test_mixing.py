"""Operator 13: targets, quotas, the splitting tree and defined cases."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing

SCHEMA = "doc_id long, text string, source string, size long, place string, bucket string, shard string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, s, 99, "p", "b", "s") for i, t, s in rows], SCHEMA)


def corpus(seed=5):
    rng = random.Random(seed)
    names = ["a", "b", "z", "é", "", None, "hot"]
    rows = [(i, " ".join(["w"] * int(rng.lognormvariate(3, 1))), rng.choice(names + ["hot"] * 4)) for i in range(600)]
    rows += [(1000 + i, None, "empty") for i in range(3)] + [(None, "x y z", "hot")] * 40 + [(7, "same row here", "b")] * 5
    return rows + [(2000, "w\t" * 5000, "a"), (2001, " w w\x0bx", "z")]


def targets(rows, weights=(3, 1, 2), share=1.5, most=2):
    """Sharing in rounds, as stated: the excess goes to the others by weight."""
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    full, total = set(), share * sum(sizes.values())
    while True:
        left = sum(w[s] for s in names if s not in full)
        level = (total - sum(most * sizes[s] for s in full)) / left if left else 0.0
        more = {s for s in names if s not in full and most * sizes[s] < level * w[s]}
        if not more:
            return {s: (sizes[s], min(float(most * sizes[s]), level * w[s])) for s in names}
        full |= more


def test_targets_and_taken(spark):
    rows = corpus()
    want = targets(rows)
    mix, dealt = mixing.mix_documents(docs_of(spark, rows), block_words=400, shard_blocks=4)
    out = mixing.mixed_sizes(mix, dealt).collect()
    assert Counter((r.doc_id, r.size) for r in out) == Counter(
        (i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, _ in rows)
    assert {round(t, 6) for _, t in want.values()} == {round(r.target, 6) for r in out}
    assert all(r.taken in (0, r.size, 2 * r.size) for r in out)
    taken = {r.source: r.n for r in mix.join(dealt.select("place", "source").distinct(), "place").groupBy("source").agg(
        F.sum("size").alias("n")).collect()}
    for s, (size, target) in want.items():
        biggest = max(len((t or "").split()) for _, t, x in rows if x == s)
        assert abs(taken.get(s, 0) - target) <= biggest / 2 + 1, (s, size, target)


def test_shards_hold_the_quotas_once(spark):
    rows = corpus(6)
    mix, dealt = mixing.mix_documents(docs_of(spark, rows), block_words=100, shard_blocks=8)
    m = mix.collect()
    draws = Counter((r.place, r.bucket, r.epoch) for r in m)
    per_shard = {}
    for r in m:
        per_shard.setdefault(r.shard, set()).add((r.place, r.bucket, r.epoch))
    assert sum(len(x) for x in per_shard.values()) == len(draws)        # a draw lies in one shard
    assert max(len(x) for x in per_shard.values()) <= 8
    by = {}
    for r in m:
        by.setdefault(r.shard, []).append(r.position)
    assert all(sorted(p) == list(range(len(p))) for p in by.values())
    again = mixing.mix_documents(docs_of(spark, random.Random(1).sample(rows, len(rows))).repartition(7), block_words=100, shard_blocks=8)[0]
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, m))


@pytest.mark.parametrize("population,marked,drawn", [(20, 7, 9), (5, 5, 2), (9, 0, 4), (9, 4, 9), (1, 1, 1), (4000, 1300, 2000)])
def test_hypergeometric_draws(spark, population, marked, drawn):
    n = 4000
    sql = mixing.hypergeometric("m", "c", "n", "u")
    got = Counter(r.x for r in spark.range(n).select(
        F.lit(population).cast("long").alias("m"), F.lit(marked).cast("long").alias("c"), F.lit(drawn).cast("long").alias("n"),
        ((F.col("id") + 0.5) / n).alias("u")).select(F.expr(sql).alias("x")).collect())
    p = {k: math.exp(sum(a * (math.lgamma(x + 1) - math.lgamma(y + 1) - math.lgamma(x - y + 1)) for a, x, y in (
        (1, marked, k), (1, population - marked, drawn - k), (-1, population, drawn))))
        for k in range(max(0, drawn + marked - population), min(drawn, marked) + 1)}
    assert abs(sum(p.values()) - 1) < 1e-9
    assert all(abs(got.get(k, 0) - n * v) <= 2.5 for k, v in p.items())      # evenly spaced uniforms: inversion is exact


def test_tree_leaves_add_up(spark):
    root = spark.createDataFrame([(0, 1000), (3, 1), (4, 70), (9, 333)], "place long, n long")
    for shards in (1, 2, 7, 130):
        got = mixing.split_quotas(root, shards, 7).collect()
        total, sizes = Counter(), Counter()
        for r in got:
            total[r.place] += r.n
            sizes[r.shard] += r.n
        assert total == {0: 1000, 3: 1, 4: 70, 9: 333}
        assert max(sizes.values()) - min(sizes.values()) <= 2 and len(sizes) == shards
    spread = [r.n for r in mixing.split_quotas(root, 130, 7).filter("place = 0").collect()]
    assert len(set(spread)) > 3                                             # drawn, not dealt evenly


def test_empty_tables(spark):
    for rows in ([], [(1, None, "s"), (2, " ", None)]):
        mix, dealt = mixing.mix_documents(docs_of(spark, rows))
        assert mix.count() == 0
        assert [(r.size, r.target, r.taken) for r in mixing.mixed_sizes(mix, dealt).collect()] == [(0, 0.0, 0)] * len(rows)


def test_no_python_in_the_plan(spark):
    mix, dealt = mixing.mix_documents(docs_of(spark, corpus()[:50]))
    plan = mixing.mixed_sizes(mix, dealt)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
