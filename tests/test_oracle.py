"""A subset of registered queries against their DuckDB oracle on sf0.001
(the driver's gate runs all of them at sf0.01; tools/check_oracle.py mirrors it)."""
import os

import duckdb
import pytest

from conftest import SF_SMALL

SUBSET = ["scan_panel", "row_index", "series_stats", "corr_matrix", "series_shape", "autocorr_lags",
          "correlogram", "corr_groups", "ewm_mean", "rolling_std", "chronological_split", "expanding_folds",
          "model_comparison", "weighted_predictions", "final_summary", "grid_search_cv", "select_by_importance",
          "r2_histogram", "nearest_series", "standardize_wide", "assemble_features", "importance_rank",
          "group_importance", "param_mode", "broadcast_group_params", "stream_panel_chunks"]


@pytest.fixture(scope="module")
def con():
    from tessera.sources.tables import TABLES
    c = duckdb.connect()
    for t in TABLES:
        p = os.path.join(SF_SMALL, f"{t}.parquet")
        if os.path.exists(p):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", SUBSET)
def test_query_matches_oracle(spark, con, name):
    import __spark_entry__ as E
    from tools.check_oracle import digest
    df = E.queries()[name](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    rel = con.sql(E.oracle_sql()[name])
    drows = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    types = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "int": "INTEGER"}
    st = {f.name: types.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    assert st == dict(zip(rel.columns, [str(t) for t in rel.types]))
    assert len(srows) == len(drows)
    assert digest(df.columns, srows) == digest(rel.columns, drows)


def test_entry_smoke(spark):
    import __spark_entry__ as E
    out = E.entry(spark)
    assert out.count() >= 0
    assert set(out.columns) == {"family", "mse", "rmse", "mae", "avg_r2"}


def test_every_sql_query_is_registered():
    import __spark_entry__ as E
    assert set(E.oracle_sql()) <= set(E.queries())


def test_registry_imports_without_a_session():
    """The driver may read the SQL before it starts Spark."""
    import subprocess
    import sys
    code = ("import sys; sys.path.insert(0, '.'); import __spark_entry__ as E; "
            "q = E.queries(); o = E.oracle_sql(); assert set(o) <= set(q); print(len(q), len(o))")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-2000:]


def test_other_queries_without_a_corpus_dependency():
    """A missing library of the corpus operators takes only them away."""
    import subprocess
    import sys
    code = ("import sys; sys.path.insert(0, '.'); sys.modules['xxhash'] = None; import __spark_entry__ as E; "
            "q = E.queries(); assert len(q) > 90 and not any(k.startswith('op') or k == 'pipeline' for k in q), sorted(q); E.oracle_sql()")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-2000:]
