"""Independent DuckDB formulations of the registered queries.

Written straight from the operator definitions (not from the Spark code):
plain windows over ``PARTITION BY sid ORDER BY t``, self-joins where DuckDB
is happy to do them, and a recursive CTE for connected components. Doubles
are rounded to 6 decimals (``+ 0.0`` folds -0.0) like the Spark side.
"""

from __future__ import annotations

from ..config import V2, PanelConfig
from ..functions.stats import ewm_alpha

W = "PARTITION BY sid ORDER BY t"


def R(expr: str) -> str:
    return f"round(({expr})::DOUBLE, 6) + 0.0"


def rounded(inner: str, cols: list[str], dbl: list[str]) -> str:
    sel = ", ".join(f"{R(c)} AS {c}" if c in dbl else c for c in cols)
    return f"SELECT {sel} FROM ({inner}) q"


def _spine(cells: str, name: str, fill: str | None) -> str:
    v = f"coalesce(c.v, {fill})" if fill is not None else "c.v"
    return (f"{name} AS (SELECT s.sid, s.t::BIGINT AS t, ({v})::DOUBLE AS v FROM "
            f"(SELECT d.sid, unnest(range(0, (SELECT max(t) + 1 FROM {cells}))) AS t "
            f"FROM (SELECT DISTINCT sid FROM {cells}) d) s "
            f"LEFT JOIN {cells} c ON c.sid = s.sid AND c.t = s.t)")


def feature_exprs(cfg: PanelConfig = V2, v: str = "v") -> list[str]:
    out = []
    for k in range(1, cfg.n_lags + 1):
        out.append(f"coalesce(lag({v}, {k}) OVER ({W}), 0.0::DOUBLE) AS lag{k}")
    stats = ("mean", "std", "min", "max") if cfg.rolling_minmax else ("mean", "std")
    for n in cfg.rolling_windows:
        fr = f"OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        for s in stats:
            e = {"mean": f"avg({v}) {fr}", "std": f"coalesce(stddev_samp({v}) {fr}, 0.0::DOUBLE)",
                 "min": f"min({v}) {fr}", "max": f"max({v}) {fr}"}[s]
            out.append(f"{e} AS roll{s}{n}")
    for k in cfg.diff_orders:
        out.append(f"coalesce({v} - lag({v}, {k}) OVER ({W}), 0.0::DOUBLE) AS diff{k}")
    for s in cfg.ewm_spans:
        out.append(ewm_expr(s, v) + f" AS ewm{s}")
    if cfg.lag_interaction:
        out.append(f"coalesce(lag({v}, 1) OVER ({W}) * lag({v}, 2) OVER ({W}), 0.0::DOUBLE) AS interaction")
    return out


def ewm_expr(span: float, v: str = "v") -> str:
    q = repr(1.0 - ewm_alpha(span))
    return (f"(pow({q}::DOUBLE, t::DOUBLE) * sum({v} * pow({q}::DOUBLE, -(t::DOUBLE))) OVER ({W} "
            f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / ((1 - pow({q}::DOUBLE, t::DOUBLE + 1)) "
            f"/ (1 - {q}::DOUBLE)))")


def split_case(cfg: PanelConfig = V2, src: str = "scaled") -> str:
    start = cfg.n_lags
    fr_train = repr(1 - cfg.test_size - cfg.val_size)
    fr_val = repr(1 - cfg.test_size)
    return (f"bounds AS (SELECT n, {start} AS start, "
            f"{start} + floor((n - {start})::DOUBLE * {fr_train}::DOUBLE)::BIGINT AS train_end, "
            f"{start} + floor((n - {start})::DOUBLE * {fr_val}::DOUBLE)::BIGINT AS val_end, n AS \"end\" "
            f"FROM (SELECT max(t) + 1 AS n FROM {src}))")


SPLIT_EXPR = ("CASE WHEN t < b.start THEN 'drop' WHEN t < b.train_end THEN 'train' "
              "WHEN t < b.val_end THEN 'val' WHEN t < b.\"end\" THEN 'test' ELSE 'drop' END")


def ctes(cfg: PanelConfig = V2) -> list[str]:
    """Every building block; DuckDB only evaluates the ones a query uses."""
    feats = ",\n  ".join(feature_exprs(cfg))
    parts = [
        "ev AS (SELECT event_type AS sid, date_trunc('hour', ts) AS h, value FROM events)",
        "cells AS (SELECT sid, date_diff('hour', (SELECT min(h) FROM ev), h)::BIGINT AS t, "
        "sum(value) AS v FROM ev GROUP BY ALL)",
        _spine("cells", "nullable", None),
        _spine("cells", "hourly", "0.0"),
        "mcells AS (SELECT s.s_nationkey::VARCHAR AS sid, "
        "(year(l.l_shipdate) * 12 + month(l.l_shipdate) - "
        "(SELECT min(year(l_shipdate) * 12 + month(l_shipdate)) FROM lineitem JOIN supplier ON l_suppkey = s_suppkey))"
        "::BIGINT AS t, "
        "sum(l.l_quantity) AS v FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey GROUP BY ALL)",
        _spine("mcells", "monthly", "0.0"),
        "hstats AS (SELECT sid, avg(v) AS mu, stddev_pop(v) AS sd FROM hourly GROUP BY sid)",
        "scaled AS (SELECT h.sid, h.t, CASE WHEN s.sd = 0 THEN 0.0::DOUBLE ELSE (h.v - s.mu) / s.sd END AS v "
        "FROM hourly h JOIN hstats s USING (sid))",
        f"feat AS (SELECT sid, t, v,\n  {feats}\n  FROM scaled)",
        split_case(cfg, "scaled"),
        f"fs AS (SELECT f.*, {SPLIT_EXPR} AS split FROM feat f, bounds b)",
        "scored AS (SELECT 'persist' AS family, sid, t, split, v AS y, lag1 AS yhat FROM fs "
        "UNION ALL SELECT 'rollmean3', sid, t, split, v, rollmean3 FROM fs "
        "UNION ALL SELECT 'ewm5', sid, t, split, v, ewm5 FROM fs)",
        "fam AS (SELECT * FROM (VALUES ('persist', 1), ('rollmean3', 2), ('ewm5', 3)) f(family, ord))",
        "r2 AS (SELECT family, sid, split, CASE WHEN sst = 0 THEN (CASE WHEN sse = 0 THEN 1.0 ELSE 0.0 END) "
        "ELSE 1 - sse / sst END AS r2 FROM (SELECT family, sid, split, sum((y - yhat) * (y - yhat)) AS sse, "
        "var_pop(y) * count(y) AS sst FROM scored GROUP BY ALL))",
        "avgr2 AS (SELECT family, split, avg(r2) AS avg_r2 FROM r2 GROUP BY ALL)",
        "cand AS (SELECT family, avg_r2 FROM (SELECT a.family, a.avg_r2 FROM avgr2 a JOIN fam USING (family) "
        "WHERE split = 'val' ORDER BY avg_r2 DESC, ord LIMIT 3) WHERE avg_r2 > 0)",
        "inputs AS (SELECT vec_id::BIGINT AS t, embedding::DOUBLE[] AS x FROM embeddings)",
    ]
    return parts


def sql(body: str, cols: list[str], dbl: list[str], extra: list[str] = (),
        cfg: PanelConfig = V2) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes(cfg) + list(extra)) + "\n" + rounded(body, cols, dbl)


def corr_expr(x: str, y: str) -> str:
    """Pearson r over pairs where both are present; NULL on constant input."""
    return (f"covar_samp({x}, {y}) / nullif(stddev_samp(CASE WHEN {y} IS NOT NULL THEN {x} END) * "
            f"stddev_samp(CASE WHEN {x} IS NOT NULL THEN {y} END), 0)")


def monthly_corr_edges(threshold: float) -> str:
    return (f"mpairs AS (SELECT a.sid AS sid_a, b.sid AS sid_b, {corr_expr('a.v', 'b.v')} AS r "
            f"FROM monthly a JOIN monthly b ON a.t = b.t AND a.sid < b.sid GROUP BY ALL), "
            f"medges AS (SELECT sid_a AS src, sid_b AS dst FROM mpairs WHERE abs(r) > {threshold} AND abs(r) < 1.0 "
            f"UNION ALL SELECT sid_b, sid_a FROM mpairs WHERE abs(r) > {threshold} AND abs(r) < 1.0), "
            f"reach AS (SELECT DISTINCT sid AS node, sid AS comp FROM monthly "
            f"UNION SELECT e.dst, r.comp FROM reach r JOIN medges e ON e.src = r.node), "
            f"groups AS (SELECT node AS sid, min(comp) AS component FROM reach GROUP BY node)")


__all__ = ["R", "rounded", "ctes", "sql", "feature_exprs", "ewm_expr", "corr_expr",
           "monthly_corr_edges", "SPLIT_EXPR"]
