"""Holdings, exposures, covariance, factor risk, weighting schemes and optimisation."""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.linalg import ewma_cov, ledoit_wolf
from ..functions.qp import Constraints, Factored, Solution, solve
from ..functions.stats import TRADING_DAYS, normal_density, normal_quantile, ratio


def _day():
    return Window.partitionBy("date")


# --- holdings and exposures ------------------------------------------------------------------------

def softmax_weights(signals: DataFrame, signal_col: str = "signal") -> DataFrame:
    e = F.exp(F.col(signal_col) - F.max(signal_col).over(_day()))
    return signals.select("date", "id", e.alias("_e")).select("date", "id", (F.col("_e") / F.sum("_e").over(_day())).alias("weight"))


def random_loadings(spark, n_assets: int, n_factors: int, seed: int = 0) -> DataFrame:
    return spark.range(n_assets).crossJoin(spark.range(n_factors).withColumnRenamed("id", "factor_id")).withColumn("loading", F.randn(seed))


def compute_exposures(weights: DataFrame, loadings: DataFrame) -> DataFrame:
    """(date, factor_id, exposure): weights times loadings, by id, or by date and id if loadings have dates."""
    on = ["date", "id"] if "date" in loadings.columns else ["id"]
    return weights.join(loadings, on).groupBy("date", "factor_id").agg(F.sum(F.col("weight") * F.col("loading")).alias("exposure"))


# --- rolling risk ----------------------------------------------------------------------------------

def _window_returns(weights: DataFrame, returns: DataFrame, window: int) -> DataFrame:
    """(date, _s, _r): for each date t and each of the ``window`` sessions s before it, the return at s of the weights
    at t.  The date axis is numbered once; rows grow with weights times window, as the definition asks."""
    axis = returns.select("date").distinct().withColumn("_t", F.row_number().over(Window.orderBy("date")))  # a date axis
    past = returns.join(axis, "date").select(F.col("_t").alias("_s"), "id", "return")
    w = weights.join(axis, "date").where(F.col("_t") > window)
    steps = w.withColumn("_s", F.explode(F.sequence(F.col("_t") - window, F.col("_t") - 1)))
    return steps.join(past, ["_s", "id"]).groupBy("date", "_s").agg(F.sum(F.col("weight") * F.col("return")).alias("_r"))


def rolling_portfolio_vol(weights: DataFrame, returns: DataFrame, window: int) -> DataFrame:
    """sqrt(w' C w) with the sample covariance of the sessions before; no covariance is formed."""
    return _window_returns(weights, returns, window).groupBy("date").agg(F.stddev_samp("_r").alias("vol"))


def rolling_var(weights: DataFrame, returns: DataFrame, window: int, confidence: float = 0.95) -> DataFrame:
    """Historical value at risk, a positive loss, of today's weights over the sessions before."""
    return _window_returns(weights, returns, window).groupBy("date").agg((-F.percentile("_r", 1 - confidence)).alias("var"))


# --- covariance ------------------------------------------------------------------------------------

def sample_cov(returns: DataFrame, ids: list[int] | None = None) -> DataFrame:
    """(i, j, cov) in long form for i <= j.  Pairs are the output itself, its size ids squared."""
    r = returns if ids is None else returns.where(F.col("id").isin(ids))
    a, b = r.select("date", F.col("id").alias("i"), F.col("return").alias("x")), r.select("date", F.col("id").alias("j"), F.col("return").alias("y"))
    return a.join(b, "date").where("i <= j").groupBy("i", "j").agg(F.covar_samp("x", "y").alias("cov"))


def return_matrix(returns: DataFrame, ids: list[int]) -> np.ndarray:
    """Dense dates x ids of a bounded list of ids, missing cells 0, for the matrix kernels."""
    rows = returns.where(F.col("id").isin(ids)).groupBy("date").agg(F.map_from_entries(F.collect_list(F.struct("id", "return"))).alias("m")).orderBy("date").collect()
    return np.array([[r.m.get(i) or 0.0 for i in ids] for r in rows], float).reshape(len(rows), len(ids))


def shrunk_cov(returns: DataFrame, ids: list[int], kind: str = "ledoit_wolf", halflife: float = 63.0) -> np.ndarray:
    x = return_matrix(returns, ids)
    if kind == "ledoit_wolf":
        return ledoit_wolf(x)[0]
    if kind == "ewma":
        return ewma_cov(x, halflife)
    return np.cov(x, rowvar=False, ddof=1)


# --- factor risk -----------------------------------------------------------------------------------

class FactorRisk:
    """Loadings (id, factor_id, loading), factor covariance (factor_i, factor_j, cov) and specific variance (id,
    specific_var) of one date.  Risk is joins and sums; the asset covariance is never formed."""

    def __init__(self, loadings: DataFrame, factor_cov: DataFrame, specific: DataFrame):
        self.loadings, self.factor_cov, self.specific = loadings, factor_cov, specific

    @classmethod
    def at(cls, loadings: DataFrame, factor_cov: DataFrame, specific: DataFrame, date: str) -> FactorRisk:
        return cls(*(t.where(F.col("date") == F.lit(date).cast("date")).drop("date") for t in (loadings, factor_cov, specific)))

    def exposures(self, w: DataFrame) -> DataFrame:
        return w.join(self.loadings, "id").groupBy("factor_id").agg(F.sum(F.col("weight") * F.col("loading")).alias("x"))

    def _spread(self, w: DataFrame) -> DataFrame:
        """(factor_id, x, fx): exposures, and factor covariance times exposures."""
        x = self.exposures(w)
        fx = self.factor_cov.join(x.withColumnRenamed("factor_id", "factor_j"), "factor_j").groupBy(F.col("factor_i").alias("factor_id")).agg(F.sum(F.col("cov") * F.col("x")).alias("fx"))
        return x.join(fx, "factor_id")

    def variance(self, w: DataFrame) -> DataFrame:
        """One row: factor_variance, specific_variance, total_variance and the factor share (0 where total is 0)."""
        f = self._spread(w).agg(F.coalesce(F.sum(F.col("x") * F.col("fx")), F.lit(0.0)).alias("factor_variance"))
        s = w.join(self.specific, "id").agg(F.coalesce(F.sum(F.col("weight") ** 2 * F.col("specific_var")), F.lit(0.0)).alias("specific_variance"))
        out = f.crossJoin(s).withColumn("total_variance", F.col("factor_variance") + F.col("specific_variance"))  # one row each
        return out.withColumn("factor_fraction", F.coalesce(ratio(F.col("factor_variance"), F.col("total_variance")), F.lit(0.0)))

    def contributions(self, w: DataFrame) -> DataFrame:
        """(id, marginal, component): covariance times weights, and times the weight again."""
        part = self.loadings.join(self._spread(w), "factor_id").groupBy("id").agg(F.sum(F.col("loading") * F.col("fx")).alias("_m"))
        out = w.join(part, "id", "left").join(self.specific, "id", "left")
        marginal = F.coalesce("_m", F.lit(0.0)) + F.col("weight") * F.coalesce("specific_var", F.lit(0.0))
        return out.select("id", marginal.alias("marginal"), (F.col("weight") * marginal).alias("component"))

    def factor_contributions(self, w: DataFrame) -> DataFrame:
        return self._spread(w).select("factor_id", (F.col("x") * F.col("fx")).alias("component"))

    def breakdown(self, w: DataFrame) -> DataFrame:
        """The row of ``variance`` with specific_fraction (0 where total is 0) and factor_contrib, a map of the factors'
        contributions, whose sum is factor_variance."""
        v = self.variance(w).withColumn("specific_fraction", F.coalesce(ratio(F.col("specific_variance"), F.col("total_variance")), F.lit(0.0)))
        parts = self.factor_contributions(w).agg(F.map_from_entries(F.collect_list(F.struct("factor_id", "component"))).alias("factor_contrib"))  # one entry for each factor
        return v.crossJoin(parts)  # one row each

    def cov(self) -> DataFrame:
        """(i, j, cov) for i <= j: the dense covariance of all assets.  Pairs are the output itself, its size ids
        squared; for reports, nothing else here needs it."""
        b = self.loadings.select("id", "factor_id", "loading")
        bf = b.join(self.factor_cov, b["factor_id"] == F.col("factor_i")).groupBy(F.col("id").alias("i"), F.col("factor_j").alias("factor_id")).agg(F.sum(F.col("loading") * F.col("cov")).alias("bf"))
        pairs = bf.join(b.select(F.col("id").alias("j"), "factor_id", "loading"), "factor_id").where("i <= j").select("i", "j", (F.col("bf") * F.col("loading")).alias("c"))
        own = self.specific.select(F.col("id").alias("i"), F.col("id").alias("j"), F.col("specific_var").alias("c"))
        return pairs.unionByName(own).groupBy("i", "j").agg(F.sum("c").alias("cov"))

    def factored(self, ids: list[int]) -> Factored:
        """Arrays for the optimiser, in the order of ``ids``."""
        rows = self.loadings.collect()
        factors = sorted({r.factor_id for r in rows})
        place, at = {i: n for n, i in enumerate(ids)}, {f: n for n, f in enumerate(factors)}
        b, f, d = np.zeros((len(ids), len(factors))), np.zeros((len(factors),) * 2), np.zeros(len(ids))
        for r in rows:
            if r.id in place:
                b[place[r.id], at[r.factor_id]] = r.loading
        for r in self.factor_cov.collect():
            f[at[r.factor_i], at[r.factor_j]] = r["cov"]
        for r in self.specific.collect():
            if r.id in place:
                d[place[r.id]] = r.specific_var
        return Factored(b, f, d)


# --- constraints and optimisation ------------------------------------------------------------------

def constraints_from_tables(position: DataFrame, groups: DataFrame, master: DataFrame, ids: list[int], long_only: bool = True, net_exposure: float = 1.0, **more) -> Constraints:
    """Bounds by id (not tradable: 0, absent: [0, 1]) and by sector; one row for each asset is read."""
    rows = {r.id: r for r in position.collect()}
    low, high = np.zeros(len(ids)), np.ones(len(ids))
    for n, i in enumerate(ids):
        if (r := rows.get(i)) is not None:
            low[n], high[n] = (r.min_weight, r.max_weight) if r.tradable else (0.0, 0.0)
    sector = {r.id: r.sector for r in master.select("id", "sector").collect()}
    names = sorted(set(sector.values()), key=str)
    limits = {names.index(r.sector): (r.min_exposure, r.max_exposure) for r in groups.collect() if r.sector in names}
    own = np.array([names.index(sector[i]) if i in sector else -1 for i in ids])
    return Constraints(len(ids), long_only, low, high, net_exposure, sector_ids=own, sector_limits=limits, **more)


def mean_variance(alpha: np.ndarray, cov: np.ndarray | Factored, spec: Constraints, risk_aversion: float = 1.0, w0: np.ndarray | None = None, cost_per_unit: float | np.ndarray | None = None, cost_scale: float = 1.0, no_trade_band: float = 0.0) -> Solution:
    """Optimal weights; names within the band of their old weight are then set back to it."""
    cost = None if cost_per_unit is None else np.asarray(cost_per_unit) * cost_scale
    found = solve(alpha, cov, spec, risk_aversion, w0, cost)
    if w0 is not None and no_trade_band > 0:
        found.weights = apply_no_trade_band(found.weights, w0, no_trade_band)
    return found


def optimize_by_date(alphas: DataFrame, cov: np.ndarray, ids: list[int], spec: Constraints, risk_aversion: float = 1.0) -> DataFrame:
    """(date, id, weight): one program for each rebalance date, the dates in parallel."""
    import pandas as pd

    def one(p: pd.DataFrame) -> pd.DataFrame:
        a = p.set_index("id")["signal"].reindex(ids).fillna(0.0).to_numpy()
        return pd.DataFrame({"date": p["date"].iloc[0], "id": ids, "weight": solve(a, cov, spec, risk_aversion).weights})

    return alphas.select("date", "id", "signal").groupBy("date").applyInPandas(one, "date date, id long, weight double")


# --- weighting schemes -----------------------------------------------------------------------------

def equal_weight(panel: DataFrame) -> DataFrame:
    return panel.select("date", "id", (1 / F.count(F.lit(1)).over(_day())).alias("weight"))


def inverse_vol(panel: DataFrame, vol_col: str = "vol", min_vol: float = 1e-8) -> DataFrame:
    x = panel.select("date", "id", (1 / F.greatest(F.col(vol_col), F.lit(min_vol))).alias("_x"))
    return x.select("date", "id", (F.col("_x") / F.sum("_x").over(_day())).alias("weight"))


def cap_weight(panel: DataFrame, cap_col: str = "market_cap", min_cap: float = 0.0) -> DataFrame:
    x = panel.select("date", "id", F.greatest(F.col(cap_col), F.lit(min_cap)).alias("_x"))
    total = F.sum("_x").over(_day())
    return x.select("date", "id", F.when(total < 1e-15, 1 / F.count(F.lit(1)).over(_day())).otherwise(F.try_divide(F.col("_x"), total)).alias("weight"))


def apply_no_trade_band(new: np.ndarray, old: np.ndarray, band: float) -> np.ndarray:
    return np.where(np.abs(new - old) <= band, old, new)


def no_trade_band(new: Column, old: Column, band: float) -> Column:
    return F.when(F.abs(new - old) <= band, old).otherwise(new)


def rebalance_costs(weights: DataFrame, cost_per_unit: float = 0.001) -> DataFrame:
    """(date, turnover, cost) of moving each id from its weight on the date before."""
    delta = F.abs(F.col("weight") - F.coalesce(F.lag("weight").over(Window.partitionBy("id").orderBy("date")), F.lit(0.0)))
    return weights.select("date", delta.alias("_d")).groupBy("date").agg((F.sum("_d") / 2).alias("turnover"), (F.sum("_d") * cost_per_unit).alias("cost"))


# --- tracking and parametric risk ------------------------------------------------------------------

def tracking_error(weights: DataFrame, benchmark: DataFrame, cov: DataFrame) -> DataFrame:
    """sqrt(a' C a) of active weights (id, weight) with a long covariance for i <= j."""
    a = weights.join(benchmark.withColumnRenamed("weight", "_b"), "id", "full").select("id", (F.coalesce("weight", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0))).alias("a"))
    rows = cov.join(a.toDF("i", "ai"), "i").join(a.toDF("j", "aj"), "j")
    q = F.sum(F.col("ai") * F.col("aj") * F.col("cov") * F.when(F.col("i") == F.col("j"), 1).otherwise(2))
    return rows.agg(F.sqrt(F.greatest(q, F.lit(0.0))).alias("tracking_error"))


def information_ratio(active: DataFrame, col: str = "active_return", periods: float = TRADING_DAYS) -> DataFrame:
    sd = F.stddev_samp(col)
    return active.agg(F.when(sd >= 1e-15, F.avg(col) / sd * periods**0.5).alias("information_ratio"))


def parametric_var(variance: float, mean: float = 0.0, confidence: float = 0.95, horizon: int = 1) -> float:
    return -(horizon * mean + normal_quantile(1 - confidence) * (horizon * variance) ** 0.5)


def parametric_cvar(variance: float, mean: float = 0.0, confidence: float = 0.95, horizon: int = 1) -> float:
    return -horizon * mean + (horizon * variance) ** 0.5 * normal_density(normal_quantile(1 - confidence)) / (1 - confidence)


def var_cvar_table(spark, variance: float, mean: float = 0.0, confidences=(0.95, 0.99), horizons=(1, 5, 21)) -> DataFrame:
    rows = [(c, h, parametric_var(variance, mean, c, h), parametric_cvar(variance, mean, c, h)) for c, h in product(confidences, horizons)]
    return spark.createDataFrame(rows, "confidence double, horizon int, var double, cvar double")
