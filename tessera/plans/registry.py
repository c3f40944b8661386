"""Query registry used by ``__spark_entry__`` and ``bench.py``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir
from . import common

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def prepare(spark: SparkSession) -> None:
    """Session settings the queries rely on (idempotent, cheap)."""
    for k, v in RUNTIME_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    ensure_checkpoint_dir(spark)


def _wrap(fn):
    def run(spark: SparkSession, base: str) -> DataFrame:
        prepare(spark)
        common.new_run()
        return fn(spark, base)
    run.__doc__ = fn.__doc__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import ml_queries, queries as q  # noqa: F401  (registration side effects)
    return {k: _wrap(v) for k, v in q.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    from . import ml_queries, queries as q  # noqa: F401
    return dict(q.ORACLE)
