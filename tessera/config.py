"""Pipeline configuration.

``PanelConfig`` is a frozen dataclass so that a configuration can be shared
between driver threads and hashed into cache keys. ``V1`` and ``V2`` reproduce
the two reference presets; ``compat`` switches keep the reference's (leaky)
semantics so results stay comparable, the alternatives are opt-in.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class PanelConfig:
    # feature construction
    n_lags: int = 8
    rolling_windows: tuple[int, ...] = (3, 7, 14, 30)
    rolling_minmax: bool = True
    diff_orders: tuple[int, ...] = (1, 2, 3)
    ewm_spans: tuple[int, ...] = (5, 10, 20)
    lag_interaction: bool = True
    fourier_periods: tuple[int, ...] = (7, 14, 30)
    steps_per_period_unit: int = 24  # "assuming hourly data": one period unit = 24 steps
    n_components: int = 300
    forecast_horizon: int = 1
    # compat: features include y_t (reference behaviour, T1); causal ends every frame at t-1
    causal: bool = False
    # compat: scalers / SVD fitted on every row (T2); "train" fits on the train rows only
    fit_on: str = "all"
    # split
    test_size: float = 0.15
    val_size: float = 0.15
    cv_folds: int = 3
    # grouping
    n_station_clusters: int = 5
    kmeans_restarts: int = 10
    corr_threshold: float = 0.8
    corr_min_degree: int = 1
    # selection
    importance_threshold: float = 0.80
    min_features: int = 20
    importance_source: str = "first"  # "first" series (T8) or "mean" over series
    # models
    seed: int = 42
    families: tuple[str, ...] = (
        "LinearRegression", "Ridge", "Lasso", "RandomForest", "GradientBoosting", "XGBoost",
    )
    ensemble: str = "stacked"  # "weighted" (v1) or "stacked" (v2)
    tune_strategy: str = "groups"  # "first_k" (v1), "groups" (v2), "sampled" (v2 without clusters)
    tune_first_k: int = 3
    tune_sample: int = 5
    # concurrent Spark ML fits, and the split statistics (MB per task) of each tree fit:
    # their product times the concurrent tasks has to fit an executor
    fit_parallelism: int = 8
    tree_memory_mb: int = 256
    # physical layout of time windows: rows of one series are split in blocks of
    # ``block_size`` steps so a hot (very long) series is spread over many tasks.
    block_size: int = 512
    extra: dict = field(default_factory=dict, compare=False, hash=False)

    def with_(self, **kw) -> "PanelConfig":
        return replace(self, **kw)

    @property
    def max_lookback(self) -> int:
        """Largest number of preceding rows any bounded feature window reads."""
        parts = [self.n_lags, 2 if self.lag_interaction else 0]
        parts += [w - 1 for w in self.rolling_windows]
        parts += list(self.diff_orders)
        return max([p for p in parts if p] or [0]) + (1 if self.causal else 0)


# Reference presets (fixed values of the two programs).
V1 = PanelConfig(
    n_lags=5,
    rolling_windows=(3, 5, 10),
    rolling_minmax=False,
    diff_orders=(1,),
    ewm_spans=(10,),
    lag_interaction=False,
    fourier_periods=(),
    n_station_clusters=4,
    importance_threshold=0.90,
    min_features=5,
    families=("LinearRegression", "Ridge", "Lasso", "RandomForest", "GradientBoosting"),
    ensemble="weighted",
    tune_strategy="first_k",
)

V2 = PanelConfig()
