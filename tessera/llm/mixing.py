"""Mixing sources to target weights (operator 13), with DataFrame functions only.

Method: the documents of a source are dealt by hash into blocks of about
``BLOCK_WORDS`` words. A source's target, from water-filled weights, fixes how
many of its blocks the mix draws: every block once for each whole epoch, and
for the rest the first blocks of a permutation of the source's blocks. These
exact quotas are the root of a splitting tree. A node stands for a run of
output shards; its left child gets a multivariate hypergeometric draw of its
blocks, the right child the others, down to single shards. Every source's
permuted list of draws is then cut into disjoint runs by the shards' counts,
and each shard shuffles its documents locally.

The last block of the rest is opened: its documents are taken in permuted order
up to the target, and one more if that comes closer, so a source misses its
target by less than half of one document of that block.

A univariate hypergeometric draw walks the exact probability ratios from the
mode to both sides, over 12 standard deviations and 30 steps, and inverts the
sum; no factorials, and cost with the square root of the block count.
All randomness is md5 of stated keys, so reruns agree whatever the partitioning.

Scale: texts are read once, for their word counts; everything later moves ids
and numbers. Running sums over a source's blocks go through groups of about
``GROUP`` blocks, so a source with a third of all blocks is many small windows.
The tree's rows hold entries for the sources with blocks below them only; the
root is one row with an entry per source. Only sums over the sources come to
the driver, once per round of sharing the excess.

Defined cases: null texts have size 0; a null source is a source of its own,
last in order; null ids are numbered like other repeated rows: rows that agree
in id, source and size are told apart by a copy number. Sources without words
have target 0; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from ..sources.tables import row_index

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BLOCK_WORDS = 1 << 14
SHARD_BLOCKS = 64
GROUP = 4096
COPIES = 4096
#: tree levels between two exchanges of the nodes
LEVELS = 6
WORD = r"[^\x20\x09-\x0D]+"
DOC = ["place", "doc_id", "copy", "size"]


def number(*parts) -> Column:
    """60 bits of the md5 of the parts, nulls empty, joined by bars."""
    text = F.concat_ws("|", *[F.coalesce(F.col(p).cast("string"), F.lit("")) if not isinstance(p, Column) else p for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def sized_documents(docs: DataFrame, word: str = WORD) -> DataFrame:
    """``doc_id, source, size, copy``: copy numbers rows that agree in the rest."""
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(word)).cast("long").alias("size"))
    runs = (sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("run", F.explode(F.expr(f"sequence(0L, (n - 1) div {COPIES})"))))
    return runs.select("doc_id", "source", "size",
                       F.explode(F.expr(f"sequence(run * {COPIES}, least(n, (run + 1) * {COPIES}) - 1)")).alias("copy"))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``source, place, weight, source_size, target``: the weights repeat over
    the sources by code point, null last; together the targets are ``share`` of
    all sizes, none is above ``most`` times its source's size, and the excess
    goes to the others by weight."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = row_index(sums.withColumn("key", F.struct(F.col("source").isNull().alias("last"), "source")), "key", "place")
    src = stored(placed.select("source", "place", "source_size",
                               F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
                               .cast("long").alias("weight")), "sources")
    cap, w = most * F.col("source_size"), F.col("weight")
    total = share * (src.agg(F.sum("source_size")).first()[0] or 0)
    level, full = None, -1
    while True:
        above = F.lit(False) if level is None else cap < F.lit(level) * w
        n, spent, left = src.agg(F.count_if(above), F.sum(F.when(above, cap)), F.sum(F.when(~above, w))).first()
        if n == full:
            break
        full, level = n, (total - (spent or 0)) / left if left else 0.0
    return src.withColumn("target", F.least(cap.cast("double"), F.lit(float(level)) * w))


def running(df: DataFrame, key: str, order: str, tie: list[str], measure: str, total: str) -> DataFrame:
    """``df`` with ``before``: the sum of ``measure`` over the rows of the same
    ``key`` that come earlier in ``order`` (60 uniform bits), then ``tie``.
    ``total`` is a column that says how many rows a key has, about; the order
    is cut into that many / GROUP ranges, summed first."""
    g = df.withColumn("_g", F.expr(f"shiftright(shiftright({order}, 30) * ceil({total} / {GROUP}), 30)"))
    sums = g.groupBy(key, "_g").agg(F.sum(measure).alias("_s"))
    ahead = sums.select(key, "_g", F.coalesce(F.sum("_s").over(
        Window.partitionBy(key).orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    inner = Window.partitionBy(key, "_g").orderBy(order, *tie).rowsBetween(Window.unboundedPreceding, -1)
    return (g.join(ahead, [key, "_g"])
            .withColumn("before", F.col("_ahead") + F.coalesce(F.sum(measure).over(inner), F.lit(0))).drop("_g", "_ahead"))


def hypergeometric(population: str, marked: str, drawn: str, uniform: str) -> str:
    """SQL for a hypergeometric draw by inversion from the mode: how many of
    ``drawn`` items, out of ``population``, are among the ``marked`` ones."""
    right = "(v.c - k) * (v.n - k) / ((k + 1D) * (v.m - v.c - v.n + k + 1))"
    left = "k * (v.m - v.c - v.n + k) / ((v.c - k + 1D) * (v.n - k + 1))"
    up, down = "sequence(v.o, v.hi)", "slice(sequence(v.o, v.lo, -1), 1, int(v.o - v.lo))"
    sums = (f"aggregate({up}, named_struct('p', 1D, 's', 0D), (a, k) -> named_struct('p', a.p * {right}, 's', a.s + a.p), a -> a.s) AS r",
            f"aggregate({down}, named_struct('p', 1D, 's', 0D), (a, k) -> named_struct('p', a.p * {left}, "
            f"'s', a.s + a.p * {left}), a -> a.s) AS l")
    start = "named_struct('p', 1D, 's', 0D, 'x', CAST(NULL AS BIGINT))"
    walk_up = (f"aggregate({up}, {start}, (a, k) -> named_struct('p', a.p * {right}, 's', a.s + a.p, "
               f"'x', coalesce(a.x, IF(a.s + a.p > t.at, k, NULL))), a -> coalesce(a.x, v.hi))")
    walk_down = (f"aggregate({down}, {start}, (a, k) -> named_struct('p', a.p * {left}, 's', a.s + a.p * {left}, "
                 f"'x', coalesce(a.x, IF(a.s + a.p * {left} > t.at - t.r, k - 1, NULL))), a -> coalesce(a.x, v.lo))")
    binding = lambda fields, name, body: f"element_at(transform(array(struct({fields})), {name} -> {body}), 1)"
    mode = binding(
        f"bigint({population}) AS m, bigint({marked}) AS c, bigint({drawn}) AS n, "
        f"greatest(0L, {drawn} + {marked} - {population}) AS least_, least({drawn}, {marked}) AS most_, "
        f"bigint(floor(({drawn} + 1D) * ({marked} + 1D) / ({population} + 2D))) AS o, "
        f"bigint(ceil(12 * sqrt(double({drawn}) * {marked} / {population} * (1 - double({marked}) / {population}) "
        f"* ({population} - {drawn}) / greatest({population} - 1, 1)))) + 30 AS wide", "q",
        binding("q.m AS m, q.c AS c, q.n AS n, greatest(q.least_, least(q.most_, q.o)) AS o, "
                "greatest(q.least_, least(q.o, q.most_) - q.wide) AS lo, least(q.most_, greatest(q.o, q.least_) + q.wide) AS hi", "v",
                binding(", ".join(sums), "w", binding(f"w.r AS r, w.l AS l, {uniform} * (w.r + w.l) AS at", "t",
                                                      f"IF(t.at < t.r, {walk_up}, {walk_down})"))))
    return (f"CASE WHEN {marked} = 0 OR {drawn} = 0 THEN 0L WHEN {drawn} >= {population} THEN bigint({marked}) "
            f"WHEN {marked} >= {population} THEN bigint({drawn}) ELSE {mode} END")


def split_quotas(root: DataFrame, shards: int, seed: int) -> DataFrame:
    """``shard, place, n``: the splitting tree over ``root`` (place, n)."""
    size = "aggregate(quotas, 0L, (a, e) -> a + e.n)"
    draw = hypergeometric("a.rest", "e.n", "a.draw",
                          f"(conv(substring(md5(concat_ws('|', 't', {seed}, first, h, e.place)), 1, 13), 16, 10) / 4503599627370496D)")
    step = (f"element_at(transform(array(struct({draw} AS x)), d -> named_struct('rest', a.rest - e.n, 'draw', a.draw - d.x, "
            "'out', concat(a.out, array(d.x)))), 1)")
    drawn = (f"aggregate(quotas, named_struct('rest', total, 'draw', (total * (h div 2)) div h, 'out', CAST(array() AS array<bigint>)), "
             f"(a, e) -> {step}, a -> a.out)")
    nodes = (root.groupBy().agg(F.sort_array(F.collect_list(F.struct("place", "n"))).alias("quotas"))
             .filter("size(quotas) > 0").select(F.lit(0).cast("long").alias("first"), F.lit(shards).cast("long").alias("h"), "quotas"))
    kept = "filter({}, e -> e.n > 0)"
    lefts = kept.format("transform(quotas, (e, i) -> named_struct('place', e.place, 'n', got[i]))")
    rights = kept.format("transform(quotas, (e, i) -> named_struct('place', e.place, 'n', e.n - got[i]))")
    children = (f"IF(h > 1, array(named_struct('first', first, 'h', h div 2, 'quotas', {lefts}), "
                f"named_struct('first', first + h div 2, 'h', h - h div 2, 'quotas', {rights})), "
                "array(named_struct('first', first, 'h', h, 'quotas', quotas)))")
    for level in range((shards - 1).bit_length()):
        if level and level % LEVELS == 0:
            nodes = nodes.repartition("first")
        sized = nodes.withColumn("total", F.expr(size))
        nodes = sized.withColumn("got", F.expr(f"IF(h > 1, {drawn}, NULL)")).select(F.expr(f"inline({children})"))
    return nodes.select(F.col("first").alias("shard"), F.expr("inline(quotas)"))


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 7,
                  block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS) -> tuple[DataFrame, DataFrame]:
    """The mix, and all documents with their source's figures.

    The first table has a row per drawn document: ``shard, position, place,
    doc_id, copy, size, bucket, epoch``. The second: ``doc_id, copy, size,
    source, place, source_size, target, bucket``."""
    sized = stored(sized_documents(docs), "sized")
    src = source_targets(sized, weights, share, most)
    src = src.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words)))
    dealt = stored(sized.join(src.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).select(
        *DOC, "source", "source_size", "target", "blocks", number(F.lit("d"), "doc_id", "copy", "size").alias("key"))
        .withColumn("bucket", F.col("key") % F.col("blocks")), "dealt")

    per_source = ["place", "source_size", "target", "blocks"]
    blocks = dealt.groupBy(*per_source, "bucket").agg(F.sum("size").alias("words"))
    blocks = blocks.withColumn("permuted", number(F.lit("b"), "place", "bucket"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    drawn = stored(running(blocks, "place", "permuted", ["bucket"], "words", "blocks").withColumn("epochs", epochs)
                   .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
                   .withColumn("cut", F.expr("before < rest AND rest < before + words"))
                   .withColumn("draws", F.expr("epochs + IF(words > 0 AND before < rest, 1, 0)"))
                   .filter("draws > 0").select("place", "bucket", "draws", "cut", (F.col("rest") - F.col("before")).alias("rest")), "drawn")

    # documents of the cut blocks: in permuted order up to the rest, then the one that fits the gap best
    open_ = dealt.join(drawn.filter("cut").select("place", "bucket", "rest"), ["place", "bucket"])
    inner, whole = Window.partitionBy("place").orderBy("key", "doc_id", "copy", "size"), Window.partitionBy("place")
    upto = open_.withColumn("upto", F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    gap = upto.withColumn("inside", F.expr("upto <= rest")).withColumn(
        "gap", F.col("rest") - F.coalesce(F.max(F.when(F.col("inside"), F.col("upto"))).over(whole), F.lit(0)))
    fit = F.struct(F.abs(F.col("size") - F.col("gap")).alias("miss"), "key", "doc_id", "copy", "size")
    best = gap.withColumn("fit", F.when(~F.col("inside") & (F.col("size") < 2 * F.col("gap")), fit))
    chosen = best.withColumn("fits", F.coalesce(F.col("fit") == F.min("fit").over(whole), F.lit(False)))
    left_out = stored(chosen.filter("NOT (inside OR fits)").select(*DOC, "bucket"), "left_out")

    items = drawn.select("place", "bucket", "cut", "draws", F.explode(F.expr("sequence(0L, draws - 1)")).alias("epoch"))
    items = items.withColumn("permuted", number(F.lit("i"), F.lit(str(seed)), "place", "bucket", "epoch"))
    counts = stored(drawn.groupBy("place").agg(F.sum("draws").alias("n")), "quotas")
    ranked = running(items.join(counts, "place").withColumn("one", F.lit(1)), "place", "permuted", ["bucket", "epoch"], "one", "n")
    total = counts.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total // shard_blocks))
    quotas = stored(split_quotas(counts, shards, seed), "shards")
    runs = running(quotas.withColumn("permuted", F.expr(f"bigint(shard * {float(1 << 60) / shards:.17g}D)"))
                   .withColumn("n_shards", F.lit(shards)), "place", "permuted", ["shard"], "n", "n_shards")
    seats = runs.select("shard", "place", F.explode(F.expr("sequence(before, before + n - 1)")).alias("before"))
    placed = ranked.join(seats, ["place", "before"]).select("shard", "place", "bucket", "epoch",
                                                            (F.col("cut") & (F.col("epoch") == F.col("draws") - 1)).alias("part"))

    rows = dealt.select(*DOC, "bucket").join(placed, ["place", "bucket"])
    same = [rows[c].eqNullSafe(left_out[c]) for c in (*DOC, "bucket")]
    out = rows.join(left_out, [*same, F.col("part")], "left_anti")
    local = Window.partitionBy("shard").orderBy(number(F.lit("s"), "shard", "doc_id", "copy", "size", "epoch"), "doc_id", "copy",
                                                "size", "epoch", "place")
    mix = out.select("shard", (F.row_number().over(local) - 1).alias("position"), *DOC, "bucket", "epoch")
    return mix, dealt.select("doc_id", "copy", "size", "source", "place", "source_size", "target", "bucket")


def mixed_sizes(mix: DataFrame, docs: DataFrame) -> DataFrame:
    """Per document what the mix takes of it: ``doc_id, size, source_size, target, taken``."""
    taken = mix.groupBy(*[F.col(c).alias(f"_{c}") for c in DOC]).agg(F.sum("size").alias("taken"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in DOC]
    return docs.join(taken, same, "left").select("doc_id", "size", "source_size", "target",
                                                 F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
