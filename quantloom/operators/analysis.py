"""Performance analytics.  Returns here are fractions; a return series is (date, return_1d)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import TRADING_DAYS, compound, full, ratio, running, trailing

ROOT = TRADING_DAYS**0.5


def by_date():
    """Per-date series of one portfolio: a few thousand rows, ordered as a whole."""
    return Window.orderBy("date")


# --- returns and drawdowns -------------------------------------------------------------------------

def returns_from_nav(nav: DataFrame) -> DataFrame:
    return nav.select("date", (ratio(F.col("nav"), F.lag("nav").over(by_date())) - 1).alias("return_1d")).where("return_1d is not null")


def drawdown(nav: DataFrame) -> DataFrame:
    """(date, nav, drawdown) against the running maximum."""
    return nav.select("date", "nav", (F.col("nav") / F.max("nav").over(running()) - 1).alias("drawdown"))


def max_drawdown(nav: DataFrame) -> DataFrame:
    return drawdown(nav).agg(F.min("drawdown").alias("max_drawdown"))


def drawdown_events(nav: DataFrame) -> DataFrame:
    """One row for each fall below the running maximum: peak, trough (the earliest deepest row), recovery (null if
    open), depth and numbers of sessions between them."""
    rows = drawdown(nav).withColumn("_t", F.row_number().over(by_date())).withColumn("_i", F.sum(F.when(F.col("drawdown") >= 0, 1).otherwise(0)).over(running()))
    isles = rows.groupBy("_i").agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct("_t", "date")).alias("_peak"),
        F.min(F.struct("drawdown", "_t", "date")).alias("_low"),
    )
    isles = isles.withColumn("_next", F.lead("_peak").over(Window.orderBy("_i"))).where("_n > 1")
    return isles.select(
        F.col("_peak.date").alias("peak_date"), F.col("_low.date").alias("trough_date"), F.col("_next.date").alias("recovery_date"), F.col("_low.drawdown").alias("depth"),
        (F.col("_low._t") - F.col("_peak._t")).alias("drawdown_days"), (F.col("_next._t") - F.col("_low._t")).alias("recovery_days"), (F.col("_next._t") - F.col("_peak._t")).alias("peak_to_recovery_days"),
    )


# --- one-pass summaries ----------------------------------------------------------------------------

def sharpe(r: Column, rf_annual: float = 0.0) -> Column:
    """Aggregate: mean excess over sample deviation, annualised; 0 without spread."""
    e = r - rf_annual / TRADING_DAYS
    return F.coalesce(ratio(F.avg(e), F.stddev_samp(e)) * ROOT, F.lit(0.0))


def sortino(r: Column, rf_daily: float = 0.0, target: float = 0.0) -> Column:
    """Aggregate: mean excess over the root mean square of the days below target; 0 without any."""
    e = r - rf_daily - target
    down = F.sqrt(F.avg(F.when(e < 0, e * e)))
    return F.coalesce(ratio(F.avg(e), down) * ROOT, F.lit(0.0))


def value_at_risk(r: str, confidence: float = 0.95) -> Column:
    """Aggregate: signed quantile, linearly interpolated."""
    return F.percentile(r, 1 - confidence)


def cvar(returns: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Mean of the returns at or below the quantile."""
    edge = returns.agg(value_at_risk("return_1d", confidence).alias("_q"))
    return returns.crossJoin(edge).where("return_1d <= _q").agg(F.avg("return_1d").alias("cvar"))  # edge: one row


def cagr(nav: DataFrame, n_sessions: int | None = None) -> DataFrame:
    """(end / start)^(252 / rows) - 1."""
    n = F.lit(n_sessions) if n_sessions else F.count(F.lit(1))
    return nav.agg((F.pow(ratio(F.max_by("nav", "date"), F.min_by("nav", "date")), TRADING_DAYS / n) - 1).alias("cagr"))


def risk_summary(returns: DataFrame, confidence: float = 0.95) -> DataFrame:
    """One row of moments, tails and hit rate from one aggregate."""
    r = F.col("return_1d")
    out = returns.agg(
        F.avg(r).alias("mean"), F.stddev_samp(r).alias("std"), sharpe(r).alias("sharpe"), sortino(r).alias("sortino"), value_at_risk("return_1d", confidence).alias("var_95"),
        F.skewness(r).alias("skewness"), F.kurtosis(r).alias("excess_kurtosis"), F.avg((r > 0).cast("double")).alias("hit_rate"), F.max(r).alias("best_day"), F.min(r).alias("worst_day"),
    )
    return out.crossJoin(cvar(returns, confidence).withColumnRenamed("cvar", "cvar_95"))  # one row each


def analyze(nav: DataFrame, risk_free: float = 0.0) -> DataFrame:
    """One row: Sharpe, drawdown, annual return and volatility, CAGR, Sortino, Calmar, from one window stage and one
    aggregate."""
    rows = drawdown(nav).withColumn("_r", ratio(F.col("nav"), F.lag("nav").over(by_date())) - 1)
    r = F.col("_r")
    out = rows.agg(
        sharpe(r, risk_free).alias("sharpe"), F.min("drawdown").alias("max_drawdown"), (F.avg(r) * TRADING_DAYS).alias("annual_return"), (F.stddev_samp(r) * ROOT).alias("annual_vol"),
        (F.pow(ratio(F.max_by("nav", "date"), F.min_by("nav", "date")), TRADING_DAYS / F.count(F.lit(1))) - 1).alias("cagr"), sortino(r, risk_free / TRADING_DAYS).alias("sortino"),
    )
    return out.withColumn("calmar", F.when(F.col("max_drawdown") < 0, F.col("cagr") / F.abs("max_drawdown")).otherwise(0.0))


def annualized_return_calendar(returns: DataFrame, calendar: DataFrame) -> DataFrame:
    """Compounded return annualised by the calendar's number of sessions in the span."""
    span = returns.agg(F.min("date").alias("_a"), F.max("date").alias("_b"), F.product(1 + F.col("return_1d")).alias("_g"))
    n = calendar.where("is_session").select("date").distinct().crossJoin(span).where("date between _a and _b")  # span: one row
    return n.groupBy("_g").agg(F.count(F.lit(1)).alias("_n")).select((F.pow("_g", TRADING_DAYS / F.col("_n")) - 1).alias("annualized_return"))


# --- benchmark -------------------------------------------------------------------------------------

def aligned(returns: DataFrame, benchmark: DataFrame) -> DataFrame:
    return returns.select("date", F.col("return_1d").alias("r")).join(benchmark.select("date", F.col("return_1d").alias("b")), "date")


def benchmark_to_fraction(benchmark: DataFrame) -> DataFrame:
    """Percent returns (date, return) to fractions (date, return_1d)."""
    return benchmark.select("date", (F.col("return") / 100).alias("return_1d"))


def benchmark_metrics(returns: DataFrame, benchmark: DataFrame, rf_daily: float = 0.0) -> DataFrame:
    """One row from one join and one aggregate: beta, alpha (annual), r_squared, tracking error (population),
    information ratio, up and down capture."""
    r, b = F.col("r"), F.col("b")
    te = F.stddev_pop(r - b) * ROOT
    beta = F.coalesce(ratio(F.covar_pop(r, b), F.var_pop(b)), F.lit(0.0))
    up, down = (F.coalesce(ratio(F.avg(F.when(c, r)), F.avg(F.when(c, b))), F.lit(0.0)) for c in (b > 0, b < 0))
    out = aligned(returns, benchmark).agg(
        beta.alias("beta"), ((F.avg(r) - rf_daily - beta * (F.avg(b) - rf_daily)) * TRADING_DAYS).alias("alpha"),
        F.when((F.var_pop(r) > 0) & (F.var_pop(b) > 0), F.pow(F.covar_pop(r, b), 2) / (F.var_pop(r) * F.var_pop(b))).otherwise(0.0).alias("r_squared"),
        te.alias("tracking_error"), F.coalesce(ratio(F.avg(r - b) * TRADING_DAYS, te), F.lit(0.0)).alias("information_ratio"), up.alias("up_capture"), down.alias("down_capture"),
    )
    return out


def active_returns(returns: DataFrame, benchmark: DataFrame) -> DataFrame:
    return aligned(returns, benchmark).select("date", (F.col("r") - F.col("b")).alias("active_return"))


def relative_drawdown(returns: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Drawdown of the compounded active return."""
    level = active_returns(returns, benchmark).withColumn("_v", compound("active_return", running()))
    return level.select("date", (F.col("_v") / F.max("_v").over(running()) - 1).alias("relative_drawdown"))


# --- rolling ---------------------------------------------------------------------------------------

def rolling_metrics(returns: DataFrame, benchmark: DataFrame, window: int = 63, rf_daily: float = 0.0) -> DataFrame:
    """(date, rolling_sharpe, rolling_vol, rolling_beta) with population moments; null until the window is full."""
    w = trailing(window)
    e, b = F.col("r") - rf_daily, F.col("b")
    sd = F.stddev_pop(e).over(w)
    out = returns.select("date", F.col("return_1d").alias("r")).join(benchmark.select("date", F.col("return_1d").alias("b")), "date", "left")
    return out.select(
        "date", full(F.coalesce(ratio(F.avg(e).over(w), sd) * ROOT, F.lit(0.0)), "r", w, window).alias("rolling_sharpe"), full(F.stddev_pop("r").over(w) * ROOT, "r", w, window).alias("rolling_vol"),
        full(F.coalesce(ratio(F.covar_pop("r", b).over(w), F.var_pop(b).over(w)), F.lit(0.0)), "b", w, window).alias("rolling_beta"),
    )


def rolling_max_drawdown(returns: DataFrame, window: int = 63) -> DataFrame:
    """Deepest fall within each window's own compounded path, whose first peak is after its first return.  A fold
    over the window's array."""
    w = trailing(window)
    path = F.aggregate(
        F.collect_list("return_1d").over(w), F.struct(F.lit(1.0).alias("v"), F.lit(0.0).alias("m"), F.lit(0.0).alias("d")),
        lambda s, r: F.struct((s["v"] * (1 + r)).alias("v"), F.greatest(s["m"], s["v"] * (1 + r)).alias("m"), F.least(s["d"], s["v"] * (1 + r) / F.greatest(s["m"], s["v"] * (1 + r)) - 1).alias("d")),
        lambda s: s["d"],
    )
    return returns.select("date", full(path, "return_1d", w, window).alias("rolling_max_drawdown"))


# --- periods ---------------------------------------------------------------------------------------

def _compounded(returns: DataFrame, **parts: Column) -> DataFrame:
    return returns.groupBy(*(c.cast("long").alias(k) for k, c in parts.items())).agg((F.product(1 + F.col("return_1d")) - 1).alias("return"))


def monthly_returns(returns: DataFrame) -> DataFrame:
    return _compounded(returns, year=F.year("date"), month=F.month("date"))


def quarterly_returns(returns: DataFrame) -> DataFrame:
    return _compounded(returns, year=F.year("date"), quarter=F.quarter("date"))


def annual_returns(returns: DataFrame) -> DataFrame:
    return _compounded(returns, year=F.year("date"))


def monthly_returns_wide(returns: DataFrame) -> DataFrame:
    """A row for each year, columns m1 to m12, null where there is no return."""
    out = monthly_returns(returns).groupBy("year").pivot("month", list(range(1, 13))).agg(F.first("return"))
    return out.select("year", *(F.col(str(m)).alias(f"m{m}") for m in range(1, 13)))


# --- turnover and exposure -------------------------------------------------------------------------

def two_way_turnover(trades: DataFrame) -> DataFrame:
    return trades.groupBy("date").agg(F.sum(F.abs("quantity")).alias("turnover"))


def one_way_turnover(trades: DataFrame) -> DataFrame:
    return trades.groupBy("date").agg((F.sum(F.abs("quantity")) / 2).alias("turnover"))


def cost_bps(trades: DataFrame, costs: DataFrame) -> DataFrame:
    """Trades with the basis points that they pay: commission, twice the half spread and fee; missing ones are 0."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    bps = zero(F.col("commission_bps")) + 2 * zero(F.col("half_spread_bps")) + zero(F.col("exchange_fee_bps"))
    return trades.join(costs, ["date", "id"], "left").select("date", "id", "quantity", bps.alias("bps"))


def net_nav(nav: DataFrame, trades: DataFrame, costs: DataFrame, corrected: bool = False) -> DataFrame:
    """(date, nav, net_nav): gross value times the running product of 1 - cost, relative to the first date.

    Literally, quantities are taken as fractions of the value; ``corrected`` divides dollars by the value and
    keeps the first day's cost.
    """
    paid = cost_bps(trades, costs).groupBy("date").agg(F.sum(F.abs("quantity") * F.col("bps") / 1e4).alias("_c"))
    rows = nav.join(paid, "date", "left").withColumn("_c", F.coalesce("_c", F.lit(0.0)))
    if corrected:
        rows = rows.withColumn("_c", ratio(F.col("_c"), F.col("nav")))
    rows = rows.withColumn("_g", compound(-F.col("_c"), running()))
    first = F.lit(1.0) if corrected else F.first("_g").over(running())
    return rows.select("date", "nav", (F.col("nav") * ratio(F.col("_g"), first)).alias("net_nav"))


def traded_weights(trades: DataFrame) -> DataFrame:
    """Each date's share of traded notional."""
    total = F.sum(F.abs("quantity")).over(Window.partitionBy("date"))
    return trades.select("date", "id", ratio(F.abs("quantity"), total).alias("weight"))


def held_positions(trades: DataFrame) -> DataFrame:
    """Running position of each id, in the units of ``quantity``."""
    return trades.select("date", "id", F.sum("quantity").over(running("id")).alias("position"))


def exposures(weights: DataFrame) -> DataFrame:
    """(date, gross, net, effective_n)."""
    w = F.col("weight")
    return weights.groupBy("date").agg(F.sum(F.abs(w)).alias("gross"), F.sum(w).alias("net"), F.try_divide(F.lit(1.0), F.sum(w * w)).alias("effective_n"))


def top_n_weight(weights: DataFrame, n: int = 10) -> DataFrame:
    top = weights.withColumn("_k", F.row_number().over(Window.partitionBy("date").orderBy(F.desc(F.abs("weight")), "id"))).where(F.col("_k") <= n)
    return top.groupBy("date").agg(F.sum(F.abs("weight")).alias("top_weight"))


# --- attribution -----------------------------------------------------------------------------------

def factor_attribution(returns: DataFrame, factor_returns: DataFrame) -> DataFrame:
    """(factor_id, exposure, alpha, r_squared): regression of the series on factor returns with an intercept.  The
    normal equations are one aggregate; only they leave the cluster."""
    import numpy as np

    spark = returns.sparkSession
    factors = sorted(r[0] for r in factor_returns.select("factor_id").distinct().collect())  # a short axis
    x = factor_returns.groupBy("date").pivot("factor_id", factors).agg(F.first("return")).toDF("date", *(f"x{i}" for i in range(len(factors))))
    rows = returns.select("date", F.col("return_1d").alias("y")).join(x, "date").dropna().withColumn("one", F.lit(1.0))
    names = ["one", *(f"x{i}" for i in range(len(factors)))]
    pairs = [(a, b) for a in names for b in [*names, "y"]]
    s = rows.agg(*(F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a, b in pairs), F.sum(F.col("y") * F.col("y")).alias("yy")).first()
    if s is None or not s["one_one"]:
        return spark.createDataFrame([], "factor_id string, exposure double, alpha double, r_squared double")
    g = np.array([[s[f"{a}_{b}"] for b in names] for a in names], float)
    h = np.array([s[f"{a}_y"] for a in names], float)
    beta = np.linalg.lstsq(g, h, rcond=None)[0]
    sst = s["yy"] - s["one_y"] ** 2 / s["one_one"]
    r2 = 1 - (s["yy"] - float(beta @ h)) / sst if sst > 0 else 0.0
    return spark.createDataFrame([(str(f), float(b), float(beta[0]) * TRADING_DAYS, float(r2)) for f, b in zip(factors, beta[1:], strict=True)], "factor_id string, exposure double, alpha double, r_squared double")


def factor_residuals(returns: DataFrame, factor_returns: DataFrame, attribution: DataFrame) -> DataFrame:
    """(date, residual) of ``factor_attribution``."""
    part = factor_returns.join(F.broadcast(attribution), factor_returns["factor_id"].cast("string") == attribution["factor_id"])
    fitted = part.groupBy("date").agg(F.sum(F.col("return") * F.col("exposure")).alias("_f"), (F.first("alpha") / TRADING_DAYS).alias("_a"))
    return returns.join(fitted, "date").select("date", (F.col("return_1d") - F.col("_f") - F.col("_a")).alias("residual"))


def sector_attribution(weights: DataFrame, asset_returns: DataFrame, groups: DataFrame, group_col: str = "sector") -> DataFrame:
    """(date, sector, contribution): sum of weight times return; a missing return is 0, a missing group null."""
    rows = weights.join(asset_returns, ["date", "id"], "left").join(groups.select("id", group_col), "id", "left")
    return rows.groupBy("date", group_col).agg(F.sum(F.col("weight") * F.coalesce("return", F.lit(0.0))).alias("contribution"))


def _sector_side(weights: DataFrame, asset_returns: DataFrame, groups: DataFrame, weight_col: str, group_col: str, tag: str) -> DataFrame:
    rows = weights.join(asset_returns, ["date", "id"], "left").join(groups.select("id", group_col), "id", "left")
    w, r = F.col(weight_col), F.coalesce("return", F.lit(0.0))
    total = F.sum(w)
    return rows.groupBy("date", F.coalesce(group_col, F.lit("Unknown")).alias(group_col)).agg(total.alias(f"w_{tag}"), (F.sum(w * r) / F.greatest(total, F.lit(1e-12))).alias(f"r_{tag}"))


def brinson(portfolio: DataFrame, benchmark: DataFrame, asset_returns: DataFrame, groups: DataFrame, group_col: str = "sector", benchmark_col: str = "benchmark_weight") -> DataFrame:
    """(sector, allocation, selection, interaction) summed over dates: a full join of both sides on date and sector."""
    p = _sector_side(portfolio, asset_returns, groups, "weight", group_col, "p")
    b = _sector_side(benchmark, asset_returns, groups, benchmark_col, group_col, "b")
    both = p.join(b, ["date", group_col], "full").na.fill(0.0, ["w_p", "w_b", "r_p", "r_b"])
    total = F.sum(F.col("w_b") * F.col("r_b")).over(Window.partitionBy("date"))
    wp, wb, rp, rb = (F.col(c) for c in ("w_p", "w_b", "r_p", "r_b"))
    both = both.withColumns({"_a": (wp - wb) * (rb - total), "_s": wb * (rp - rb), "_i": (wp - wb) * (rp - rb)})
    return both.groupBy(group_col).agg(F.sum("_a").alias("allocation"), F.sum("_s").alias("selection"), F.sum("_i").alias("interaction"))


def active_factor_exposures(portfolio: DataFrame, loadings: DataFrame, benchmark: DataFrame | None = None) -> DataFrame:
    """(factor_id, exposure): mean over dates of the weighted loading, less the benchmark's if given."""

    def mean(weights: DataFrame, col: str, name: str) -> DataFrame:
        day = weights.join(loadings, ["date", "id"]).groupBy("date", "factor_id").agg(F.sum(F.col(col) * F.col("loading")).alias("_e"))
        return day.groupBy("factor_id").agg(F.avg("_e").alias(name))

    p = mean(portfolio, "weight", "_p")
    if benchmark is None:
        return p.select("factor_id", F.col("_p").alias("exposure"))
    b = mean(benchmark, "benchmark_weight", "_b")
    return p.join(b, "factor_id", "full").select("factor_id", (F.coalesce("_p", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0))).alias("exposure"))


def factor_contributions(exposure: DataFrame, factor_returns: DataFrame) -> DataFrame:
    """(factor_id, contribution): exposure times the sum of the factor's returns."""
    total = factor_returns.groupBy("factor_id").agg(F.sum("return").alias("_t"))
    return exposure.join(total, "factor_id").select("factor_id", (F.col("exposure") * F.col("_t")).alias("contribution"))


def attribution_report(nav: DataFrame, weights: DataFrame, benchmark: DataFrame, factor_returns: DataFrame, loadings: DataFrame, asset_returns: DataFrame, groups: DataFrame, benchmark_weights: DataFrame | None = None) -> dict[str, DataFrame]:
    """All parts of an attribution as named tables."""
    series = returns_from_nav(nav)
    exposure = active_factor_exposures(weights, loadings, benchmark_weights)
    out = {"factors": factor_attribution(series, factor_returns), "exposures": exposure, "contributions": factor_contributions(exposure, factor_returns), "relative": benchmark_metrics(series, benchmark)}
    if benchmark_weights is not None:
        out["brinson"] = brinson(weights, benchmark_weights, asset_returns, groups)
    return out


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
