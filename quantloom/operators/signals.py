"""Signal research: information coefficients, quantiles, neutralisation, blending, stability, regimes."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.linalg import kendall_tau_b, ols_residual
from ..functions.stats import TRADING_DAYS, average_rank, correlation, finite, full, p_value, p_value_column, trailing, zscore

KEY = ["date", "id"]


# --- information coefficients ----------------------------------------------------------------------

def ic_series(signals: DataFrame, returns: DataFrame, signal_col: str = "signal", return_col: str = "return", method: str = "rank", min_obs: int = 10) -> DataFrame:
    """(date, ic, n_obs) on the dates that both tables have: rank, pearson or kendall correlation across ids."""
    both = signals.select(*KEY, F.col(signal_col).alias("_s")).join(returns.select(*KEY, F.col(return_col).alias("_r")), KEY)
    both = both.where(finite("_s", "_r"))
    if method == "kendall":
        out = _kendall(both, min_obs)
    else:
        x, y = ("_s", "_r") if method == "pearson" else (F.col("_rs"), F.col("_rr"))
        if method == "rank":
            both = both.withColumns({"_rs": average_rank("_s", "date"), "_rr": average_rank("_r", "date")})
        elif method != "pearson":
            raise ValueError(f"unknown method {method}")
        out = both.groupBy("date").agg(correlation(x, y, max(2, min_obs)).alias("ic"), F.count(F.lit(1)).alias("n_obs"))
    dates = signals.select("date").distinct().join(returns.select("date").distinct(), "date", "left_semi")
    return dates.join(out, "date", "left").select("date", "ic", F.coalesce("n_obs", F.lit(0)).alias("n_obs"))


def _kendall(both: DataFrame, min_obs: int) -> DataFrame:
    def one(p: pd.DataFrame) -> pd.DataFrame:
        tau = kendall_tau_b(p["_s"].to_numpy(), p["_r"].to_numpy()) if len(p) >= max(2, min_obs) else np.nan
        return pd.DataFrame({"date": [p["date"].iloc[0]], "ic": [None if np.isnan(tau) else tau], "n_obs": [len(p)]})

    return both.groupBy("date").applyInPandas(one, "date date, ic double, n_obs long")


def ic_next_period(signals: DataFrame, returns: DataFrame, categorical: bool = False, min_obs: int = 2) -> DataFrame:
    """Signal of a date against the next date's return: Spearman, or Pearson for a categorical signal."""
    ahead = returns.withColumn("_next", F.lead("return").over(Window.partitionBy("id").orderBy("date"))).select(*KEY, "_next")
    return ic_series(signals, ahead, "signal", "_next", "pearson" if categorical else "rank", min_obs)


def rolling_ic(ic: DataFrame, window: int) -> DataFrame:
    w = trailing(window)
    return ic.withColumn("rolling_ic", full(F.avg("ic").over(w), "ic", w, window))


def rolling_ic_ir(ic: DataFrame, window: int) -> DataFrame:
    """Trailing mean, sample deviation and their ratio; null until the window is full."""
    w = trailing(window)
    mean, sd = F.avg("ic").over(w), F.stddev_samp("ic").over(w)
    return ic.select("date", full(mean, "ic", w, window).alias("ic_mean"), full(sd, "ic", w, window).alias("ic_std"), full(F.try_divide(mean, sd), "ic", w, window).alias("ic_ir"))


def default_lags(n: int) -> int:
    return int(4 * (n / 100) ** (2 / 9))


def newey_west(ic: DataFrame, n_lags: int | None = None, by: list[str] = ()) -> DataFrame:
    """Bartlett-weighted t-statistic of the mean of ``ic`` for each group: (by, n, mean_ic, t_stat).

    The residuals become one array for each group, ordered by date, a per-date series and so short; the
    autocovariances are folds over it.  No spread gives 0.
    """
    rows = ic.where("ic is not null").groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("ic").alias("mean_ic"), F.array_sort(F.collect_list(F.struct("date", "ic"))).alias("_a"))
    rows = rows.withColumn("_e", F.expr("transform(_a, x -> x.ic - mean_ic)"))
    lags = F.lit(n_lags) if n_lags is not None else F.floor(4 * F.pow(F.col("n") / 100, F.lit(2 / 9)))
    rows = rows.withColumn("_l", F.least(lags, F.col("n") - 1).cast("int"))
    auto = "aggregate(sequence(0, _l), 0D, (s, k) -> s + (if(k = 0, 1D, 2D * (1D - k / (_l + 1)))) * aggregate(zip_with(slice(_e, 1, size(_e) - k), slice(_e, k + 1, size(_e) - k), (a, b) -> a * b), 0D, (t, v) -> t + v) / n)"
    se = F.sqrt(F.greatest(F.expr(auto), F.lit(0.0)) / F.col("n"))
    return rows.select(*by, "n", "mean_ic", F.when(se > 1e-15, F.col("mean_ic") / se).otherwise(0.0).alias("t_stat"))


def ic_summary(ic: DataFrame, by: list[str] = (), population: bool = False) -> DataFrame:
    """(by, mean_ic, ic_ir, t_stat, n): mean over deviation, sample or population, and the Newey-West t."""
    sd = F.stddev_pop("ic") if population else F.stddev_samp("ic")
    stats = ic.where("ic is not null").groupBy(*by).agg(F.coalesce(F.try_divide(F.avg("ic"), sd), F.lit(0.0)).alias("ic_ir"))
    nw = newey_west(ic, by=by)
    joined = nw.join(stats, list(by)) if by else nw.crossJoin(stats)  # one row each
    return joined.select(*by, "mean_ic", "ic_ir", "t_stat", "n")


def ic_horizon_curve(signals: DataFrame, forward: DataFrame, horizons: list[str], signal_col: str = "signal", method: str = "rank", min_obs: int = 10) -> DataFrame:
    """(horizon, mean_ic, ic_ir, t_stat, n_dates), the ratio by the population deviation.  All horizons share one
    long plan: they are partitions, not passes."""
    long = forward.select(*KEY, *horizons).unpivot(KEY, horizons, "horizon", "_r")
    both = signals.select(*KEY, F.col(signal_col).alias("_s")).join(long, KEY).where(finite("_s", "_r"))
    if method == "rank":
        both = both.withColumns({"_s": average_rank("_s", "horizon", "date"), "_r": average_rank("_r", "horizon", "date")})
    ic = both.groupBy("horizon", "date").agg(correlation("_s", "_r", max(2, min_obs)).alias("ic"))
    return ic_summary(ic, ["horizon"], population=True).withColumnRenamed("n", "n_dates")


# --- quantiles -------------------------------------------------------------------------------------

def bucket_of(rank: str, n: str, q: int):
    """Bucket 1..q of an average rank; divides first, as the edges depend on it."""
    return F.greatest(F.lit(1), F.least(F.lit(q), F.ceil(F.col(rank) / F.col(n) * q))).cast("int")


def quantile_buckets(signals: DataFrame, forward: DataFrame, signal_col: str = "signal", return_col: str = "fwd_ret_1", q: int = 5, min_obs: int = 10) -> DataFrame:
    """(date, bucket, mean_ret, n_assets); dates below ``min_obs`` are left out."""
    both = signals.select(*KEY, F.col(signal_col).alias("_s")).join(forward.select(*KEY, F.col(return_col).alias("_r")), KEY).where(finite("_s", "_r"))
    both = both.withColumns({"_rank": average_rank("_s", "date"), "_n": F.count(F.lit(1)).over(Window.partitionBy("date"))}).where(F.col("_n") >= min_obs)
    return both.groupBy("date", bucket_of("_rank", "_n", q).alias("bucket")).agg(F.avg("_r").alias("mean_ret"), F.count(F.lit(1)).alias("n_assets"))


def quantile_spread(buckets: DataFrame, q: int = 5) -> DataFrame:
    """(date, spread, monotonicity): top minus bottom mean, and the rank correlation of bucket and mean where at
    least three buckets are filled."""
    ranked = buckets.withColumn("_r", average_rank("mean_ret", "date")).withColumn("_b", average_rank("bucket", "date"))
    top, bottom = (F.max(F.when(F.col("bucket") == b, F.col("mean_ret"))) for b in (q, 1))
    return ranked.groupBy("date").agg((top - bottom).alias("spread"), correlation("_b", "_r", 3).alias("monotonicity"))


def spread_summary(spread: DataFrame) -> DataFrame:
    sd = F.stddev_samp("spread")
    return spread.agg(F.avg("spread").alias("mean_spread"), F.try_divide(F.avg("spread"), sd).alias("spread_ir"), F.avg("monotonicity").alias("mean_monotonicity"), F.count("spread").alias("n_dates"))


# --- neutralisation --------------------------------------------------------------------------------

def neutralize_groups(signals: DataFrame, groups: DataFrame, signal_col: str = "signal", group_col: str = "sector") -> DataFrame:
    """Residual of the signal on group dummies within each date, over the date's population deviation of the
    residuals; ids without a group pass unprojected."""
    s = signals.join(groups.select("id", F.col(group_col).alias("_g")), "id", "left")
    mean = F.avg(signal_col).over(Window.partitionBy("date", "_g"))
    s = s.withColumn("_e", F.when(F.col("_g").isNull(), F.col(signal_col)).otherwise(F.col(signal_col) - mean))
    sd = F.stddev_pop("_e").over(Window.partitionBy("date"))
    return s.select(*KEY, F.when(F.col("_e").isNotNull(), F.when(sd > 1e-12, F.col("_e") / sd).otherwise(0.0)).alias(signal_col))


def neutralize_factors(signals: DataFrame, loadings: DataFrame, signal_col: str = "signal", factor_col: str = "factor_id", loading_col: str = "loading") -> DataFrame:
    """Per date, residual of a regression on factor loadings without intercept, standardised.  A date's cross
    section is one group of a Pandas function."""
    wide = loadings.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct(factor_col, loading_col))).alias("_l"))
    joined = signals.select(*KEY, F.col(signal_col).alias("_s")).join(wide, KEY, "left").select(*KEY, "_s", F.expr(f"transform(_l, x -> x.{loading_col})").alias("_x"))

    def one(p: pd.DataFrame) -> pd.DataFrame:
        k = max((len(v) for v in p["_x"] if v is not None), default=0)
        x = np.array([v if v is not None and len(v) == k else [np.nan] * k for v in p["_x"]], float).reshape(len(p), k)
        r = ols_residual(p["_s"].to_numpy(float), x) if k else np.full(len(p), np.nan)
        return pd.DataFrame({"date": p["date"], "id": p["id"], signal_col: pd.Series(r, index=p.index).astype(object).where(np.isfinite(r), None)})

    return joined.groupBy("date").applyInPandas(one, f"date date, id long, `{signal_col}` double")


def evaluate_neutralization(raw: DataFrame, neutral: DataFrame, forward: DataFrame, signal_col: str = "signal", return_col: str = "fwd_ret_1", method: str = "rank", min_obs: int = 10) -> DataFrame:
    """(kind, mean_ic, ic_ir, t_stat, n) of the raw and the neutral signal."""
    series = [ic_series(s, forward, signal_col, return_col, method, min_obs).withColumn("kind", F.lit(k)) for k, s in (("neutral", neutral), ("raw", raw))]
    return ic_summary(reduce(DataFrame.unionByName, series), ["kind"], population=True)


# --- combination -----------------------------------------------------------------------------------

def _stack(signals: list[DataFrame], signal_col: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [s.select(*KEY, F.col(signal_col).alias("_s"), F.lit(i).alias("_k")) for i, s in enumerate(signals)])


def zscore_blend(signals: list[DataFrame], weights: list[float] | None = None, signal_col: str = "signal") -> DataFrame:
    """Weighted mean of per-date z-scores over the signals that a cell has; null where their weights do not sum
    to more than 0."""
    weights = weights or [1 / len(signals)] * len(signals)
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), F.col("_k") + 1)
    z = _stack(signals, signal_col).where(finite("_s")).withColumn("_z", zscore("_s", "_k", "date")).withColumn("_w", F.when(F.col("_z").isNotNull(), w))
    total = F.sum("_w")
    return z.groupBy(*KEY).agg(F.when(total > 0, F.sum(F.col("_z") * F.col("_w")) / total).alias(signal_col))


def ic_weights(mean_ics: list[float]) -> list[float]:
    total = sum(abs(x) for x in mean_ics)
    return [x / total for x in mean_ics] if total > 0 else [1 / len(mean_ics)] * len(mean_ics)


def ic_weighted_blend(signals: list[DataFrame], mean_ics: list[float], signal_col: str = "signal") -> DataFrame:
    return zscore_blend(signals, ic_weights(mean_ics), signal_col)


def gram_schmidt(signals: list[DataFrame], signal_col: str = "signal") -> list[DataFrame]:
    """Each signal's z-scores less their projections on those before, over all cells, and z-scored again by date.
    One aggregate gives all projections of a step."""
    cells = reduce(lambda a, b: a.join(b, KEY), [s.select(*KEY, F.col(signal_col).alias(f"_{i}")) for i, s in enumerate(signals)])
    cells = cells.withColumns({f"_{i}": F.coalesce(zscore(f"_{i}", "date"), F.lit(0.0)) for i in range(len(signals))})
    for i in range(1, len(signals)):
        sums = cells.agg(*(F.sum(F.col(f"_{i}") * F.col(f"_{j}")).alias(f"n{j}") for j in range(i)), *(F.sum(F.col(f"_{j}") ** 2).alias(f"d{j}") for j in range(i))).first()
        less = reduce(lambda a, j: a - F.col(f"_{j}") * ((sums[f"n{j}"] or 0.0) / sums[f"d{j}"] if sums[f"d{j}"] else 0.0), range(i), F.col(f"_{i}"))
        cells = cells.withColumn(f"_{i}", less).withColumn(f"_{i}", F.coalesce(zscore(f"_{i}", "date"), F.lit(0.0)))
    return [cells.select(*KEY, F.col(f"_{i}").alias(signal_col)) for i in range(len(signals))]


def incremental_ic(signals: list[DataFrame], forward: DataFrame, signal_col: str = "signal", return_col: str = "fwd_ret_1", min_obs: int = 10) -> DataFrame:
    """(n_signals, mean_ic, increment) of the blends of the first 1, 2, ... signals."""
    parts = []
    for i in range(1, len(signals) + 1):
        ic = ic_series(zscore_blend(signals[:i], None, signal_col), forward, signal_col, return_col, "rank", min_obs)
        parts.append(ic.agg(F.avg("ic").alias("mean_ic")).withColumn("n_signals", F.lit(i)))
    out = reduce(DataFrame.unionByName, parts)
    before = F.lag("mean_ic", 1, 0.0).over(Window.orderBy("n_signals"))  # a handful of rows
    return out.select("n_signals", "mean_ic", (F.col("mean_ic") - before).alias("increment"))


def signal_pair_correlation(signals: list[DataFrame], signal_col: str = "signal", min_obs: int = 10) -> DataFrame:
    """(i, j, corr, n): correlation of within-date ranks, pooled over dates; each signal is ranked over its own
    cells."""
    ranked = _stack(signals, signal_col).where(finite("_s")).withColumn("_r", average_rank("_s", "_k", "date"))
    a = ranked.select(*KEY, F.col("_k").alias("i"), F.col("_r").alias("_a"))
    b = ranked.select(*KEY, F.col("_k").alias("j"), F.col("_r").alias("_b"))
    return a.join(b, KEY).where("i < j").groupBy("i", "j").agg(correlation("_a", "_b", max(2, min_obs)).alias("corr"), F.count(F.lit(1)).alias("n"))


def redundancy(pairs: DataFrame, n_signals: int) -> DataFrame:
    """Mean absolute pair correlation, and the mean entry of the whole correlation matrix."""
    total = F.coalesce(F.sum("corr"), F.lit(0.0))
    return pairs.agg(F.avg(F.abs("corr")).alias("mean_abs_corr"), ((2 * total + n_signals) / n_signals**2).alias("redundancy_ratio"))


# --- multiple testing ------------------------------------------------------------------------------

def tstat_to_pvalue(t: float) -> float:
    return p_value(t)


def multiple_testing(tests: DataFrame, alpha: float = 0.05, p_col: str | None = None) -> DataFrame:
    """Tests with p_value (from ``t_stat`` unless given), Bonferroni and Benjamini-Hochberg decisions and the
    step-up threshold.  One row for each signal, so a global order is small."""
    p = tests.withColumn("p_value", p_value_column("t_stat") if p_col is None else F.col(p_col))
    everything = Window.partitionBy(F.lit(0))
    p = p.withColumns({"_k": F.count(F.lit(1)).over(everything), "_rk": F.row_number().over(everything.orderBy("p_value"))})
    line = F.col("_rk") * alpha / F.col("_k")
    m = F.coalesce(F.max(F.when(F.col("p_value") <= line, F.col("_rk"))).over(everything), F.lit(0))
    return p.withColumns({"bonferroni": F.col("p_value") <= alpha / F.col("_k"), "bh_threshold": m * alpha / F.col("_k"), "bh": F.col("_rk") <= m}).drop("_k", "_rk")


# --- stability -------------------------------------------------------------------------------------

def _consecutive(signals: DataFrame, signal_col: str) -> DataFrame:
    """(date, id, previous and present value) on consecutive dates of the whole table."""
    s = signals.where(finite(signal_col)).select(*KEY, F.col(signal_col).alias("_s"))
    days = signals.select("date").distinct().withColumn("_prev", F.lag("date").over(Window.orderBy("date")))  # a date axis
    now = s.join(days.where("_prev is not null"), "date")
    return now.join(s.select(F.col("date").alias("_prev"), "id", F.col("_s").alias("_p")), ["_prev", "id"]).select(*KEY, "_p", "_s")


def signal_autocorr(signals: DataFrame, signal_col: str = "signal") -> DataFrame:
    """Mean rank correlation of consecutive dates over their common ids, three at least."""
    pairs = _consecutive(signals, signal_col).withColumns({"_a": average_rank("_p", "date"), "_b": average_rank("_s", "date")})
    return pairs.groupBy("date").agg(correlation("_a", "_b", 3).alias("_c")).agg(F.avg("_c").alias("autocorr"), F.count("_c").alias("n_pairs"))


def rank_stability(signals: DataFrame, signal_col: str = "signal", q: int = 5) -> DataFrame:
    """Mean share of ids in an extreme bucket that keep it on the next date, where 2q ids are common."""
    p = _consecutive(signals, signal_col).withColumns({"_a": average_rank("_p", "date"), "_b": average_rank("_s", "date"), "_n": F.count(F.lit(1)).over(Window.partitionBy("date"))})
    p = p.where(F.col("_n") >= 2 * q).withColumns({"_a": bucket_of("_a", "_n", q), "_b": bucket_of("_b", "_n", q)})
    day = p.where(F.col("_a").isin(1, q)).groupBy("date").agg(F.avg((F.col("_a") == F.col("_b")).cast("double")).alias("_k"))
    return day.agg(F.avg("_k").alias("stability"), F.count("_k").alias("n_pairs"))


def turnover_score(signals: DataFrame, ic_ir_gross: float, signal_col: str = "signal", cost_bps: float = 10.0, q: int = 5) -> DataFrame:
    """Autocorrelation, stability and the ratio net of 2 * cost * (1 - autocorrelation)."""
    joined = signal_autocorr(signals, signal_col).select("autocorr").crossJoin(rank_stability(signals, signal_col, q).select("stability"))  # one row each
    return joined.withColumn("ic_ir_net", ic_ir_gross - 2 * cost_bps / 100 * (1 - F.col("autocorr")))


# --- regimes ---------------------------------------------------------------------------------------

def detect_regimes(returns: DataFrame, n_regimes: int = 3, window: int = 21, min_window: int = 5) -> DataFrame:
    """(date, vol, regime): trailing sample deviation of a per-date series, cut at its overall quantiles; -1 until
    ``min_window`` rows are there."""
    w = trailing(window)
    vol = returns.select("date", F.when(F.count("return").over(w) >= min_window, F.stddev_samp("return").over(w)).alias("vol"))
    edges = vol.agg(F.percentile("vol", F.array(*(F.lit(i / n_regimes) for i in range(1, n_regimes)))).alias("_e"))
    label = F.expr("case when vol is null then -1 else size(filter(_e, e -> e <= vol)) end")
    return vol.crossJoin(edges).select("date", "vol", label.alias("regime"))  # edges: one row


def regime_conditional_ic(signals: DataFrame, forward: DataFrame, regimes: DataFrame, signal_col: str = "signal", return_col: str = "fwd_ret_1", method: str = "rank", min_obs: int = 10) -> DataFrame:
    """(regime, mean_ic, n_obs, n_dates) for the labels from 0 up."""
    ic = ic_series(signals, forward, signal_col, return_col, method, min_obs)
    return ic.join(regimes.where("regime >= 0").select("date", "regime"), "date").groupBy("regime").agg(F.avg("ic").alias("mean_ic"), F.sum("n_obs").alias("n_obs"), F.count("ic").alias("n_dates"))


def annualize(mean_daily: float) -> float:
    return mean_daily * TRADING_DAYS
