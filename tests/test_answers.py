"""Answers that must not depend on partitioning, path lengths or origins."""

import datetime

import pytest
from pyspark.sql import functions as F

from tessera.operators import correlation, evaluate
from tessera.operators.components import component_labels
from tessera.plans import registry
from tessera.sources import panels, tables

SF_SMALL = "/root/testdata/sf0.001"


def test_row_index_of_wide_rows_is_dense(spark):
    n = 300_000
    df = spark.range(n).select((F.col("id") * 7919 % n).alias("k"), *[F.sha2(F.concat(F.col("id").cast("string"), F.lit(i)), 256)
                                                                       .alias(f"c{i}") for i in range(4)])
    out = tables.row_index(df, "k")
    r = out.agg(F.count("*").alias("n"), F.countDistinct("t").alias("d"), F.min("t").alias("lo"), F.max("t").alias("hi"),
                F.sum((F.col("t") != F.col("k")).cast("int")).alias("wrong")).head()
    assert (r.n, r.d, r.lo, r.hi, r.wrong) == (n, n, 0, n - 1, 0)


@pytest.mark.parametrize("n", [60, 300])
def test_long_chains_are_one_component(spark, n):
    nodes = spark.createDataFrame([(f"s{i:04d}",) for i in range(n + 2)], "sid string")
    edges = spark.createDataFrame([(f"s{i:04d}", f"s{i + 1:04d}") for i in range(n)], "sid_a string, sid_b string")
    got = {r.sid: r.component for r in correlation.connected_components(nodes, edges).collect()}
    assert len(got) == n + 2
    assert set(got.values()) == {"s0000", f"s{n + 1:04d}"}


def test_components_of_nothing_and_loops(spark):
    assert component_labels(spark.createDataFrame([], "a long, b long")).count() == 0
    got = component_labels(spark.createDataFrame([(1, 1), (None, 2), (3, 2), (2, 3)], "a long, b long")).collect()
    assert sorted((r.node, r.component) for r in got) == [(2, 2), (3, 2)]


def test_a_series_can_be_best_and_worst(spark):
    r2 = spark.createDataFrame([("f", f"s{i}", i / 10) for i in range(5)], "family string, sid string, r2 double")
    out = evaluate.best_worst_series(r2, 3).collect()
    assert len(out) == 6
    assert {(r.sid, r.rank) for r in out if r.side == "best"} == {("s4", 1), ("s3", 2), ("s2", 3)}
    assert {(r.sid, r.rank) for r in out if r.side == "worst"} == {("s0", 1), ("s1", 2), ("s2", 3)}


def test_monthly_panel_starts_with_the_data(spark, tmp_path):
    base = str(tmp_path)
    d = datetime.date
    spark.createDataFrame([(1, 2.0, d(1994, 11, 5)), (1, 3.0, d(1995, 2, 1))],
                          "l_suppkey long, l_quantity double, l_shipdate date").write.parquet(f"{base}/lineitem.parquet")
    spark.createDataFrame([(1, 4)], "s_suppkey long, s_nationkey long").write.parquet(f"{base}/supplier.parquet")
    got = {r.t: r.v for r in panels.monthly(spark, base).collect()}
    assert got == {0: 2.0, 1: 0.0, 2: 0.0, 3: 3.0}


def test_wide_csv_becomes_a_panel(spark, tmp_path):
    path = str(tmp_path / "wide.csv")
    spark.createDataFrame([(i, float(i), float(-i)) for i in range(50)], "at int, x double, y double").coalesce(1).write.option(
        "header", True).csv(path)
    wide = tables.read_wide_csv(spark, path)
    got = {(r.sid, r.t): r.v for r in tables.wide_to_long(wide, ["x", "y"], "at").collect()}
    assert got == {(c, i): s * i for i in range(50) for c, s in (("x", 1.0), ("y", -1.0))}


BLOCKED = ["lag_features", "ewm_mean", "lead_target", "rolling_full_mean_std", "autocorr_lags", "assemble_features"]


@pytest.mark.parametrize("broadcast", ["10485760", "-1"])
@pytest.mark.parametrize("name", BLOCKED)
def test_registered_windows_run_on_series_and_block(spark, name, broadcast):
    """In the plan that ran, rows reach every blocked window through an
    exchange on (sid, block)."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        df = registry.queries()[name](spark, SF_SMALL)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    exchanges = [seg.split(")")[0] for seg in plan.split("hashpartitioning(")[1:]]
    assert any("sid" in e and "_blk" in e for e in exchanges), exchanges


def test_one_scan_per_panel(spark):
    """The raw table is read by the cell aggregation only."""
    plan = registry.queries()["scan_panel"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "events.parquet" not in plan


def test_correlation_is_pairwise_complete(spark):
    import numpy as np
    import pandas as pd

    r = np.random.default_rng(3)
    wide = pd.DataFrame(r.normal(1000, 1, (80, 4)), columns=list("abcd"))
    wide["d"] = 5.0
    wide.loc[wide.index % 7 == 0, "a"] = np.nan
    wide.loc[wide.index % 5 == 0, "b"] = np.nan
    rows = [(s, int(t), None if np.isnan(wide[s][t]) else float(wide[s][t])) for s in wide for t in wide.index
            if not (s == "c" and t % 11 == 0)]  # a missing row, not a NULL cell
    wide.loc[wide.index % 11 == 0, "c"] = np.nan
    got = {(x.sid_a, x.sid_b): x for x in correlation.pair_moments(
        spark.createDataFrame(rows, "sid string, t long, v double")).collect()}
    want, cov = wide.corr(), wide.cov()
    assert len(got) == 6
    for (a, b), x in got.items():
        both = (wide[a].notna() & wide[b].notna()).sum()
        assert x.n_common == both and abs(x.cov - cov[a][b]) < 1e-9
        assert x.r is None if "d" in (a, b) else abs(x.r - want[a][b]) < 1e-9


def test_wide_inputs_are_planned_in_one_expression(spark):
    from tessera.operators import reshape

    df = spark.range(30).select(F.col("id").alias("t"), F.transform(
        F.sequence(F.lit(1), F.lit(10_000)), lambda j: (F.col("id") * j).cast("double")).alias("x"))
    out = reshape.standardize_wide(df)
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    x = out.filter("t = 0").select("x").head()[0]
    assert len(x) == 10_000 and abs(x[0] - x[-1]) < 1e-9
