"""End-to-end research chain: data, signals, models, portfolio, backtests, analysis, telemetry."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analysis as an
from ..operators import backtest as bt
from ..operators import cleaning as cl
from ..operators import models as mo
from ..operators import portfolio as pf
from ..operators import signals as sg
from ..operators import telemetry as tm
from ..sources.generators import GenSpec, write_all
from ..sources.loader import DatasetLoader, batch, stream
from ..streaming.events import drain


@dataclass(frozen=True)
class StrategySpec:
    """Validated knobs of a run, kept as JSON."""

    gen: GenSpec = field(default_factory=lambda: GenSpec(40, 120, 8, 4, seed=3))
    wf_splits: int = 3
    wf_embargo: int = 5
    risk_aversion: float = 1.0
    max_weight: float = 0.10
    rebalance_every: int = 21
    n_optimized: int = 40

    def __post_init__(self):
        if self.wf_splits < 1 or self.rebalance_every < 1 or not 0 < self.max_weight <= 1 or self.wf_embargo < 0:
            raise ValueError("strategy out of range")

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> StrategySpec:
        raw = json.loads(text)
        return cls(**{**raw, "gen": GenSpec(**raw["gen"])})


@dataclass
class PipelineSummary:
    ic_raw: float
    ic_neutralized: float
    horizon_ic: dict[str, float]
    wf_mean_ic: float
    wf_mean_r2: float
    opt_gross: float
    factor_vol: float
    tracking_error: float
    gross_sharpe: float
    net_sharpe: float
    max_drawdown: float
    cost_drag: float
    n_trades: int
    n_scaling_fits: int


INPUTS = ("prices", "forward_returns", "alpha_signals", "security_master", "feature_panel", "sample_weights", "factor_loadings", "factor_covariance", "specific_risk", "benchmark_weights", "transaction_costs", "universe_mask", "borrow_rates", "position_constraints", "group_constraints", "stage_measurements")


def run_production_pipeline(spark: SparkSession, folder: str, strategy: StrategySpec = StrategySpec()) -> PipelineSummary:
    """Generate, load with validation, and chain all stages; each is a plan, and only summaries are collected."""
    spec = strategy.gen
    write_all(spark, folder, spec, INPUTS)
    load = DatasetLoader(spark, folder).load
    prices, forward, master = load("prices"), load("forward_returns"), load("security_master")
    returns = cl.returns_from_prices(prices).persist()
    signal = load("alpha_signals").where("signal_name = 'momentum'").select("date", "id", "signal").persist()

    neutral = sg.neutralize_groups(signal, master)
    mean_ic = lambda s: sg.ic_series(s, forward, return_col="fwd_ret_1").agg(F.avg("ic")).first()[0]
    curve = sg.ic_horizon_curve(signal, forward, ["fwd_ret_1", "fwd_ret_5", "fwd_ret_21"])

    panel = mo.build_panel(load("feature_panel"), forward, "fwd_ret_1", load("sample_weights"))
    wf = mo.walk_forward_ridge(panel, mo.WalkForwardSplitter(strategy.wf_splits, strategy.wf_embargo, 20), mo.WalkForwardConfig((0.1, 1.0, 10.0)))

    ids = list(range(min(spec.n_assets, strategy.n_optimized)))
    last = returns.agg(F.max("date")).first()[0]
    risk = pf.FactorRisk.at(load("factor_loadings"), load("factor_covariance"), load("specific_risk"), str(last))
    factored = risk.factored(ids)
    alpha = signal.where((F.col("date") == F.lit(last)) & F.col("id").isin(ids)).orderBy("id").toPandas()["signal"].to_numpy() / 100
    tables = pf.constraints_from_tables(load("position_constraints"), load("group_constraints"), master, ids, long_only=False, net_exposure=0.0, max_gross=2.0)
    weights = pf.mean_variance(alpha, factored, tables, strategy.risk_aversion).weights
    w = spark.createDataFrame([(i, float(x)) for i, x in zip(ids, weights, strict=True)], "id long, weight double")
    variance = risk.variance(w).first()
    bench = load("benchmark_weights").where(F.col("date") == F.lit(last)).select("id", "benchmark_weight").toPandas().set_index("id")["benchmark_weight"].reindex(ids).fillna(0).to_numpy()
    active = weights - bench / max(bench.sum(), 1e-12)
    te = float(np.sqrt(max(active @ factored.times(active), 0.0)))

    cfg = bt.BacktestConfig(rebalance_every=strategy.rebalance_every, max_weight=strategy.max_weight, universe_mask=True)
    mask = load("universe_mask")
    gross = bt.run_backtest(returns, neutral, cfg, mask=mask)
    net_cfg = replace(cfg, transaction_costs=True, slippage=True, short_gating=True, financing=True, borrow_rate_annual=0.01, funding_rate_annual=0.03)
    net = bt.run_backtest(returns, neutral, net_cfg, prices.select("date", "id", "close", "adv_20"), load("transaction_costs"), mask, borrow=load("borrow_rates"))
    a, b = an.analyze(gross.nav_history).first(), an.analyze(net.nav_history).first()
    end = lambda r: r.nav_history.agg(F.max_by("nav", "date")).first()[0]
    return PipelineSummary(
        mean_ic(signal), mean_ic(neutral), {r.horizon: r.mean_ic for r in curve.collect()}, wf.mean_ic, wf.mean_r2, float(np.abs(weights).sum()), float(np.sqrt(max(variance.factor_variance, 0.0))), te,
        a.sharpe, b.sharpe, b.max_drawdown, end(gross) - end(net), net.trade_log.count(), tm.fit_scaling(load("stage_measurements")).count(),
    )


def run_from_spec(spark: SparkSession, folder: str, text: str) -> PipelineSummary:
    """The whole chain from a strategy kept as JSON."""
    return run_production_pipeline(spark, folder, StrategySpec.from_json(text))


def build_components(spark: SparkSession, folder: str) -> dict[str, Callable[[dict[str, int]], Callable[[], object]]]:
    """The seven components for ``run_harness``: from the sizes of a point, whose tables are generated once below the
    folder, each makes the call to time.  Calls return plans, or run their own jobs."""
    written: set[GenSpec] = set()

    def tables(params: dict[str, int]) -> Callable[[str], DataFrame]:
        spec = GenSpec(**{d: params[d] for d in tm.DIMS if d in params})
        at = f"{folder}/" + "-".join(str(getattr(spec, d)) for d in tm.DIMS)
        if spec not in written:
            write_all(spark, at, spec, (*INPUTS, "stage_baselines", "regression_thresholds"))
            written.add(spec)
        return DatasetLoader(spark, at).load

    def momentum(load) -> DataFrame:
        return load("alpha_signals").where("signal_name = 'momentum'").select("date", "id", "signal")

    def etl(params):
        load = tables(params)
        return lambda: cl.returns_from_prices(load("prices"))

    def signals(params):
        load = tables(params)
        return lambda: sg.ic_series(sg.neutralize_groups(momentum(load), load("security_master")), load("forward_returns"), return_col="fwd_ret_1")

    def models(params):
        load = tables(params)
        panel = mo.build_panel(load("feature_panel"), load("forward_returns"), "fwd_ret_1", load("sample_weights"))
        return lambda: mo.walk_forward_ridge(panel, mo.WalkForwardSplitter(2, 5, 20), mo.WalkForwardConfig((0.1, 1.0, 10.0))).mean_ic

    def analysis(params):
        load = tables(params)
        return lambda: an.analyze(load("prices").groupBy("date").agg(F.avg("close").alias("nav")))

    def portfolio(params):
        load = tables(params)
        last = str(load("factor_loadings").agg(F.max("date")).first()[0])
        risk = pf.FactorRisk.at(load("factor_loadings"), load("factor_covariance"), load("specific_risk"), last)
        weights = pf.softmax_weights(momentum(load).where(F.col("date") == F.lit(last).cast("date"))).select("id", "weight")
        return lambda: risk.breakdown(weights)

    def backtest(params):
        load = tables(params)
        cfg = bt.BacktestConfig(transaction_costs=True, universe_mask=True)
        return lambda: bt.run_backtest(cl.returns_from_prices(load("prices")), momentum(load), cfg, load("prices").select("date", "id", "close", "adv_20"), load("transaction_costs"), load("universe_mask")).nav_history

    def profiling(params):
        load = tables(params)
        now = load("stage_measurements").groupBy("stage").agg(*(F.median(c).alias(c) for c in ("elapsed_s", "result_mb", "peak_rss_mb")))
        return lambda: tm.check_regressions(now, load("stage_baselines"), load("regression_thresholds"), tm.fit_scaling(load("stage_measurements")), 0.0)

    return {f.__name__: f for f in (etl, signals, models, analysis, portfolio, backtest, profiling)}


def run_experiment(spark: SparkSession, params: dict[str, int], folder: str, window: int = 63) -> list[tm.TrialResult]:
    """Nine stages, timed once each on generated prices: batch and stream load, backtest, analysis, holdings, exposures,
    rolling volatility, information coefficient and cross-validation."""
    spec = GenSpec(**{d: params[d] for d in tm.DIMS if d in params})
    write_all(spark, folder, spec, ("prices", "feature_panel", "forward_returns"))
    path = f"{folder}/prices.parquet"
    prices = batch(spark, path)
    returns = cl.returns_from_prices(prices)
    signal = bt.random_signals(prices.select("date", "id"), seed=1)
    load = DatasetLoader(spark, folder).load
    nav = lambda: bt.run_backtest(returns, signal).nav_history
    weights = pf.softmax_weights(signal)
    panel = mo.build_panel(load("feature_panel"), load("forward_returns"), "fwd_ret_1")
    stages = {
        "etl.batch": lambda: returns, "etl.stream": lambda: drain(stream(spark, path, prices.schema.simpleString()[7:-1].replace(":", " ")), f"{folder}/stream-{uuid.uuid4().hex}", "append"),
        "backtest": nav, "analysis": lambda: an.analyze(nav()), "portfolio.holdings": lambda: weights,
        "portfolio.exposures": lambda: pf.compute_exposures(weights, pf.random_loadings(spark, spec.n_assets, spec.n_factors, 2)),
        "portfolio.rolling_vol": lambda: pf.rolling_portfolio_vol(weights, returns, window), "signals.ic": lambda: sg.ic_next_period(signal, returns),
        "models.cv": lambda: mo.cv_loop(panel, mo.feature_names(load("feature_panel"))),
    }
    return [tm.run_trials(name, call, 1, 0) for name, call in stages.items()]


def summary_frame(spark: SparkSession, summary: PipelineSummary) -> DataFrame:
    """(field, value) rows."""
    flat = {k: v for k, v in asdict(summary).items() if not isinstance(v, dict)} | {f"horizon_ic.{k}": v for k, v in summary.horizon_ic.items()}
    return spark.createDataFrame([(k, None if v is None else float(v)) for k, v in sorted(flat.items())], "field string, value double")


def walk_forward_backtest(returns: DataFrame, result: mo.WalkForwardResult, cfg: bt.BacktestConfig) -> DataFrame:
    """(fold, date, nav): out-of-sample predictions drive a backtest in each test window, all folds as strategies of
    one run, and the paths are joined end to end."""
    panel = result.predictions.withColumnRenamed("prediction", "signal").join(returns, ["date", "id"])
    log = bt.bar_backtest(panel.withColumn("strategy", F.col("fold").cast("string")), cfg)
    folds = log.where("kind = 'nav'").select(F.col("strategy").cast("int").alias("fold"), "date", "nav")
    return bt.stitch_nav(folds, cfg.initial_cash)
