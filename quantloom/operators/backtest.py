"""Backtest simulation.

In weight space the targets, the drift between rebalances and the portfolio return do not depend on the
value of the portfolio, so they are windows over the panel; only the value itself is a recurrence, a fold
over one short array of per-date terms.  Share accounting, lags, corporate actions, financing and short
gating depend on the value bar by bar; a strategy is then one group of a Pandas function and many
strategies run in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import TRADING_DAYS, clip, compound, running
from .cleaning import DIVIDENDS
from .portfolio import softmax_weights

#: Slippage in basis points where the average daily volume is unknown, and the longest financing step in years.
FALLBACK_BPS, LONGEST_STEP = 500.0, 5 / TRADING_DAYS


@dataclass(frozen=True)
class BacktestConfig:
    """Switches of a run; costs and constraints are off by default."""

    initial_cash: float = 1_000_000.0
    rebalance_every: int = 21
    rebalance_dates: tuple | None = None
    execution_lag: int = 0
    min_weight: float | None = None
    max_weight: float | None = None
    max_gross: float | None = None
    max_net: float | None = None
    share_space: bool = False
    transaction_costs: bool = False
    slippage: bool = False
    impact_coef: float | None = None
    universe_mask: bool = False
    corporate_actions: bool = False
    borrow_costs: bool = False
    cash_interest_rate: float = 0.0
    short_gating: bool = False
    financing: bool = False
    #: Share space values a bar by its own close, as daily accounts do; else by the close that its return leads to.
    mark_at_close: bool = True
    borrow_rate_annual: float = 0.0
    funding_rate_annual: float = 0.0


@dataclass
class BacktestResult:
    nav_history: DataFrame
    trade_log: DataFrame
    final_positions: DataFrame
    fill_log: DataFrame | None = None
    cash_history: DataFrame | None = None
    financing_drag: float = 0.0


def _day():
    return Window.partitionBy("date")


# --- signals ---------------------------------------------------------------------------------------

def random_signals(grid: DataFrame, seed: int = 0, binary: bool = False) -> DataFrame:
    value = (F.rand(seed) < 0.5).cast("double") if binary else F.randn(seed)
    return grid.select("date", "id", value.alias("signal"))


# --- constraint chain (never renormalised) ---------------------------------------------------------

def apply_universe_mask(w: DataFrame, mask: DataFrame, flag: str = "tradable") -> DataFrame:
    joined = w.join(mask.select("date", "id", flag), ["date", "id"], "left")
    return joined.withColumn("weight", F.when(F.coalesce(flag, F.lit(False)), F.col("weight")).otherwise(0.0)).select(*w.columns)


def apply_weight_caps(w: DataFrame, low: Column | float | None = None, high: Column | float | None = None) -> DataFrame:
    return w.withColumn("weight", clip("weight", -1e308 if low is None else low, 1e308 if high is None else high))


def apply_gross_cap(w: DataFrame, max_gross: float) -> DataFrame:
    gross = F.sum(F.abs("weight")).over(_day())
    return w.withColumn("weight", F.when(gross > max_gross, F.col("weight") * max_gross / gross).otherwise(F.col("weight")))


def apply_net_cap(w: DataFrame, max_net: float) -> DataFrame:
    """Trim the dominant side in proportion until |sum of weights| is within the cap."""
    net, side = F.sum("weight").over(_day()), F.col("weight")
    long, short = F.sum(F.greatest(side, F.lit(0.0))).over(_day()), F.sum(F.greatest(-side, F.lit(0.0))).over(_day())
    out = F.when((net > max_net) & (side > 0), side * (1 - (net - max_net) / long)).when((net < -max_net) & (side < 0), side * (1 - (-net - max_net) / short)).otherwise(side)
    return w.withColumn("weight", out)


def apply_weight_bounds(w: DataFrame, bounds: DataFrame, cfg: BacktestConfig) -> DataFrame:
    """Caps of each id (id, min_weight, max_weight); where an id has none, those of the configuration."""
    default = lambda x, y: F.lit(float(y if x is None else x))
    low, high = F.coalesce("_low", default(cfg.min_weight, -1e308)), F.coalesce("_high", default(cfg.max_weight, 1e308))
    own = bounds.select("id", F.col("min_weight").alias("_low"), F.col("max_weight").alias("_high"))
    return apply_weight_caps(w.join(own, "id", "left"), low, high).select(*w.columns)


def apply_constraints(w: DataFrame, cfg: BacktestConfig, mask: DataFrame | None = None, bounds: DataFrame | None = None) -> DataFrame:
    """Mask, caps (by id, or of the configuration), gross, net, in this order."""
    if mask is not None:
        w = apply_universe_mask(w, mask)
    if bounds is not None:
        w = apply_weight_bounds(w, bounds, cfg)
    elif cfg.min_weight is not None or cfg.max_weight is not None:
        w = apply_weight_caps(w, cfg.min_weight, cfg.max_weight)
    if cfg.max_gross is not None:
        w = apply_gross_cap(w, cfg.max_gross)
    return apply_net_cap(w, cfg.max_net) if cfg.max_net is not None else w


# --- costs, as column expressions ------------------------------------------------------------------

def transaction_cost(value: Column, commission: Column, half_spread: Column, fee: Column, minimum: Column) -> Column:
    """Of one trade: commission with its minimum, half spread and fee; no trade is free."""
    notional = F.abs(value)
    return F.when(notional > 0, F.greatest(notional * commission / 1e4, minimum) + notional * (half_spread + fee) / 1e4).otherwise(0.0)


def slippage_bps(value: Column, adv: Column, impact: Column) -> Column:
    return F.when(adv > 0, impact * F.sqrt(F.abs(value) / adv)).otherwise(FALLBACK_BPS)


def slippage_cost(value: Column, adv: Column, impact: Column) -> Column:
    return F.abs(value) * slippage_bps(value, adv, impact) / 1e4


def fill_price(mid: Column, value: Column, adv: Column, impact: Column) -> Column:
    return mid * (1 + F.signum(value) * slippage_bps(value, adv, impact) / 1e4)


def borrow_cost(weight: Column, nav: Column, bps: Column) -> Column:
    return F.greatest(-weight, F.lit(0.0)) * nav * bps / 1e4 / TRADING_DAYS


def cash_interest(cash: Column, rate: float) -> Column:
    return cash * rate / TRADING_DAYS


# --- weight space ----------------------------------------------------------------------------------

def rebalance_axis(panel: DataFrame, cfg: BacktestConfig) -> DataFrame:
    """(date, t, rebal, seg): ordinal of each date, whether it rebalances, and the count of rebalances so far."""
    axis = panel.select("date").distinct().withColumn("t", F.row_number().over(Window.orderBy("date")) - 1)  # a date axis
    rebal = F.col("date").isin([F.lit(d).cast("date") for d in cfg.rebalance_dates]) if cfg.rebalance_dates else F.col("t") % cfg.rebalance_every == 0
    return axis.withColumn("rebal", rebal).withColumn("seg", F.sum(F.col("rebal").cast("int")).over(running(order="t")))


def held_weights(targets: DataFrame, returns: DataFrame, axis: DataFrame) -> DataFrame:
    """(date, t, id, rebal, target, before, held, return): each target drifts with the returns (percent) since its
    rebalance and is normalised to sum 1 after the first bar; ``before`` is what is held when a bar begins."""
    rows = returns.join(axis, "date").join(targets.withColumnRenamed("weight", "target"), ["date", "id"], "left")
    in_seg = Window.partitionBy("id", "seg").orderBy("t")
    rows = rows.withColumn("_start", F.first("target").over(in_seg.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    growth = compound(F.coalesce("return", F.lit(0.0)) / 100, in_seg.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_raw", F.coalesce("_start", F.lit(0.0)) * growth)
    total = F.sum("_raw").over(_day())
    rows = rows.withColumn("held", F.when(F.col("rebal") | (total <= 0), F.col("_raw")).otherwise(F.col("_raw") / total))
    # What the previous bar leaves after its own return, normalised over ids.
    grown = F.col("held") * (1 + F.coalesce("return", F.lit(0.0)) / 100)
    sum_grown = F.sum(grown).over(_day())
    rows = rows.withColumn("_left", F.when(sum_grown > 0, grown / sum_grown).otherwise(grown))
    before = F.coalesce(F.lag("_left").over(Window.partitionBy("id").orderBy("t")), F.lit(0.0))
    return rows.withColumn("before", before).select("date", "t", "id", "rebal", "target", "before", "held", "return")


def gross_backtest(returns: DataFrame, signals: DataFrame, cfg: BacktestConfig = BacktestConfig(), mask: DataFrame | None = None) -> DataFrame:
    """(date, port_ret, nav) without costs: a plain running product."""
    held = held_weights(apply_constraints(softmax_weights(signals), cfg, mask), returns, rebalance_axis(returns, cfg))
    day = held.groupBy("date").agg(F.sum(F.col("held") * F.coalesce("return", F.lit(0.0)) / 100).alias("port_ret"))
    return day.select("date", "port_ret", (cfg.initial_cash * compound("port_ret", running())).alias("nav"))


def weight_space_backtest(returns: DataFrame, signals: DataFrame, cfg: BacktestConfig = BacktestConfig(), costs: DataFrame | None = None, adv: DataFrame | None = None, mask: DataFrame | None = None, bounds: DataFrame | None = None) -> BacktestResult:
    """Value with costs and slippage charged at each rebalance.

    Per date the panel reduces to its return, linear cost, square-root impact, the sum of the commissions without a
    minimum, and an array of those with one.  One fold over the dates gives the value.
    """
    held = held_weights(apply_constraints(softmax_weights(signals), cfg, mask, bounds), returns, rebalance_axis(returns, cfg)).withColumn("delta", F.when(F.col("rebal"), F.coalesce("target", F.lit(0.0)) - F.col("before")).otherwise(0.0))
    names = ("commission_bps", "half_spread_bps", "exchange_fee_bps", "min_commission", "impact_coef")
    held = held.join(costs.select("date", "id", *names), ["date", "id"], "left") if costs is not None else held.withColumns({n: F.lit(0.0) for n in names})
    held = held.join(adv.select("date", "id", "adv_20"), ["date", "id"], "left") if adv is not None else held.withColumn("adv_20", F.lit(0.0))
    held = held.na.fill(0.0, [*names, "adv_20"])
    a, on, slip = F.abs("delta"), F.lit(float(cfg.transaction_costs)), F.lit(float(cfg.slippage))
    impact = F.lit(cfg.impact_coef) if cfg.impact_coef is not None else F.col("impact_coef")
    plain = (F.col("min_commission") == 0) & (F.col("commission_bps") >= 0)  # a plain sum for each date
    day = held.groupBy("date", "t").agg(
        F.sum(F.col("held") * F.coalesce("return", F.lit(0.0)) / 100).alias("r"),
        F.sum(a * (F.col("half_spread_bps") + F.col("exchange_fee_bps")) * on / 1e4 + F.when(F.col("adv_20") > 0, 0.0).otherwise(a * FALLBACK_BPS * slip / 1e4)).alias("lin"),
        F.sum(F.when(F.col("adv_20") > 0, F.pow(a, 1.5) * impact / F.sqrt(F.col("adv_20")) * slip / 1e4).otherwise(0.0)).alias("root"),
        F.sum(F.when(plain, a * F.col("commission_bps") * on / 1e4).otherwise(0.0)).alias("com"),
        F.collect_list(F.when((a > 0) & (on > 0) & ~plain, F.struct((a * F.col("commission_bps") / 1e4).alias("m"), F.col("min_commission").alias("f")))).alias("c"),
    )
    fold = F.aggregate(
        F.col("days"), F.struct(F.lit(float(cfg.initial_cash)).alias("nav"), F.array().cast("array<struct<date:date,nav:double,start:double,cost:double>>").alias("out")),
        lambda s, d: _step(s, d),
        lambda s: s["out"],
    )
    path = day.agg(F.array_sort(F.collect_list(F.struct("t", "date", "r", "lin", "root", "com", "c"))).alias("days")).select(F.inline(fold))
    trades = held.where("rebal").join(path.select("date", (F.col("start") - F.col("cost")).alias("_v")), "date").select("date", "id", (F.col("delta") * F.col("_v")).alias("quantity"))
    last = held.join(F.broadcast(held.agg(F.max("t").alias("t"))), "t").select("id", F.col("held").alias("weight"))  # one row
    return BacktestResult(path.select("date", "nav"), trades, last)


def _step(s: Column, d: Column) -> Column:
    start = s["nav"]
    commission = F.aggregate(d["c"], F.greatest(start, F.lit(0.0)) * d["com"], lambda t, x: t + F.greatest(start * x["m"], x["f"]))
    cost = start * d["lin"] + F.pow(start, F.lit(1.5)) * d["root"] + commission
    after = (start - cost) * (1 + d["r"])
    return F.struct(after.alias("nav"), F.concat(s["out"], F.array(F.struct(d["date"].alias("date"), after.alias("nav"), start.alias("start"), cost.alias("cost")))).alias("out"))


# --- bar by bar ------------------------------------------------------------------------------------

@dataclass
class _Book:
    nav: float
    cash: float
    weights: np.ndarray
    shares: np.ndarray
    drag: float = 0.0
    queue: list = field(default_factory=list)


def simulate(panel: pd.DataFrame, cfg: BacktestConfig, actions: pd.DataFrame | None = None) -> Iterator[tuple[str, pd.DataFrame]]:
    """One strategy over a complete panel (date, id, return in percent, signal, and optional side columns close,
    tradable, adv_20, cost terms, min_weight, max_weight, borrow_rate_bps, shortable, loan_availability), bar by bar.

    Order within a bar: corporate actions, the lagged target, a new target, the bar's return, then borrow,
    interest and financing.  Yields ("nav", ...), ("trades", ...), ("fills", ...), ("cash", ...).
    """
    dates, ids = np.sort(panel["date"].unique()), np.sort(panel["id"].unique())
    cube = panel.set_index(["date", "id"]).reindex(pd.MultiIndex.from_product([dates, ids]))
    n = len(ids)

    def side(name: str, default: float) -> np.ndarray:
        values = cube[name].to_numpy(float) if name in cube else np.full(len(cube), default)
        return np.nan_to_num(values.reshape(len(dates), n), nan=default)

    ret, signal = side("return", 0.0) / 100, side("signal", 0.0)
    close, tradable, adv = side("close", 0.0), side("tradable", 1.0) > 0, side("adv_20", 0.0)
    comm, spread, fee, least = (side(c, 0.0) for c in ("commission_bps", "half_spread_bps", "exchange_fee_bps", "min_commission"))
    impact = np.full_like(ret, cfg.impact_coef) if cfg.impact_coef is not None else side("impact_coef", 0.0)
    # Bounds of an id come before those of the configuration.
    lower = side("min_weight", -np.inf if cfg.min_weight is None else cfg.min_weight)
    upper = side("max_weight", np.inf if cfg.max_weight is None else cfg.max_weight)
    borrow, shortable, loan = side("borrow_rate_bps", 0.0), side("shortable", 1.0) > 0, side("loan_availability", np.inf)
    book = _Book(cfg.initial_cash, cfg.initial_cash, np.zeros(n), np.zeros(n))
    fixed = {pd.Timestamp(d) for d in cfg.rebalance_dates} if cfg.rebalance_dates else None
    navs, cash, trades, fills = [], [], [], []
    place = {i: k for k, i in enumerate(ids)}
    by_day: dict = {}
    if cfg.corporate_actions and actions is not None:
        for a in actions.itertuples():
            by_day.setdefault(pd.Timestamp(a.ex_date), []).append(a)

    def target(t: int) -> np.ndarray:
        e = np.exp(signal[t] - signal[t].max())
        w = e / e.sum()
        if cfg.universe_mask:
            w = np.where(tradable[t], w, 0.0)
        w = np.clip(w, lower[t], upper[t])
        if cfg.max_gross is not None and (g := np.abs(w).sum()) > cfg.max_gross:
            w = w * cfg.max_gross / g
        if cfg.max_net is not None and abs(net := w.sum()) > cfg.max_net:
            sel = w > 0 if net > 0 else w < 0
            w = np.where(sel, w * (1 - (abs(net) - cfg.max_net) / np.abs(w[sel]).sum()), w)
        if cfg.short_gating:
            w = np.where(w < 0, np.where(shortable[t], np.maximum(w, -loan[t] / max(book.nav, 1e-12)), 0.0), w)
        return w

    def costs(t: int, value: np.ndarray) -> tuple[float, float]:
        v = np.abs(value)
        on = v > 0
        paid = float((np.maximum(v * comm[t] / 1e4, least[t]) + v * (spread[t] + fee[t]) / 1e4)[on].sum()) if cfg.transaction_costs else 0.0
        return paid, float((v * slip_bps(t, value) / 1e4).sum()) if cfg.slippage else 0.0

    def slip_bps(t: int, value: np.ndarray) -> np.ndarray:
        return np.where(adv[t] > 0, impact[t] * np.sqrt(np.abs(value) / np.where(adv[t] > 0, adv[t], 1.0)), FALLBACK_BPS)

    def execute(t: int, w: np.ndarray) -> None:
        before = book.weights
        if cfg.share_space:
            value = w * book.nav - book.shares * close[t]
            price = close[t] * (1 + np.sign(value) * slip_bps(t, value) / 1e4) if cfg.slippage else close[t]
            delta = np.where(price > 0, (w * book.nav) / np.where(price > 0, price, 1.0) - book.shares, 0.0)
            moved = delta * price
            paid, slipped = costs(t, moved)
            book.shares = book.shares + delta
            book.cash -= float(moved.sum()) + paid + slipped
            book.nav = float(book.shares @ close[t]) + book.cash
            total = np.abs(moved).sum()
            for k in np.flatnonzero(np.abs(delta) > 0):
                part = abs(moved[k]) / total if total else 0.0
                fills.append((dates[t], ids[k], delta[k], price[k], paid * part, slipped * part))
            book.weights = book.shares * close[t] / book.nav if book.nav > 0 else np.zeros(n)
        else:
            moved = (w - before) * book.nav
            book.nav -= sum(costs(t, moved))
            book.weights = w
        # The log has every id, by the value after costs.
        trades.extend(zip(repeat(dates[t]), ids, (w - before) * book.nav))

    for t, day in enumerate(dates):
        stamp = pd.Timestamp(day)
        for a in by_day.get(stamp, ()):
            if (k := place.get(a.id)) is None:
                continue
            if a.action_type == "split" and a.split_ratio and a.split_ratio > 0:
                book.shares[k] *= a.split_ratio
                close[t, k] /= a.split_ratio
            elif a.action_type in DIVIDENDS and a.cash_amount and a.cash_amount > 0:
                book.cash += book.shares[k] * a.cash_amount
        if book.queue and book.queue[0][0] <= t:
            execute(t, book.queue.pop(0)[1])
        if (stamp in fixed) if fixed is not None else t % cfg.rebalance_every == 0:
            w = target(t)
            if cfg.execution_lag:
                book.queue.append((t + cfg.execution_lag, w))
            else:
                execute(t, w)
        if cfg.share_space:
            if t + 1 < len(dates):
                close[t + 1] = close[t] * (1 + ret[t])
            value = book.shares * close[t] * (1.0 if cfg.mark_at_close else 1 + ret[t])
            book.nav = float(value.sum()) + book.cash
            book.weights = value / book.nav if book.nav > 0 else np.zeros(n)
        else:
            book.nav *= 1 + float(book.weights @ ret[t])
            grown = book.weights * (1 + ret[t])
            book.weights = grown / grown.sum() if grown.sum() > 0 else grown
        short = np.maximum(-book.weights, 0.0) * book.nav
        owed = 0.0
        if cfg.borrow_costs:
            owed += float((short * borrow[t]).sum()) / 1e4 / TRADING_DAYS
        if cfg.short_gating:
            owed += float((short * borrow[t]).sum()) / 1e4 / TRADING_DAYS
        gain = book.cash * cfg.cash_interest_rate / TRADING_DAYS if cfg.cash_interest_rate and cfg.share_space else 0.0
        if cfg.financing:
            # Until the next date; a default step after the last one.
            dt = min((pd.Timestamp(dates[t + 1]) - pd.Timestamp(day)).days / 365, LONGEST_STEP) if t + 1 < len(dates) else 1 / TRADING_DAYS
            paid = (float(short.sum()) * cfg.borrow_rate_annual + max(np.abs(book.weights).sum() - 1, 0.0) * book.nav * cfg.funding_rate_annual) * dt
            book.drag += paid
            owed += paid
        book.nav += gain - owed
        book.cash += gain - owed
        navs.append((day, book.nav))
        cash.append((day, book.cash if cfg.share_space else 0.0))
    yield "nav", pd.DataFrame(navs, columns=["date", "nav"])
    yield "trades", pd.DataFrame(trades, columns=["date", "id", "quantity"])
    yield "fills", pd.DataFrame(fills, columns=["date", "id", "shares", "fill_price", "cost", "slippage"])
    yield "cash", pd.DataFrame(cash, columns=["date", "cash"])
    yield "final", pd.DataFrame({"id": ids, "weight": book.weights, "shares": book.shares, "drag": book.drag})


_LOG = "strategy string, kind string, date date, id long, nav double, quantity double, shares double, fill_price double, cost double, slippage double, cash double, weight double, drag double"


def bar_backtest(panel: DataFrame, cfg: BacktestConfig, actions: DataFrame | None = None, strategy: str = "strategy") -> DataFrame:
    """All logs of all strategies (column ``strategy``, one if absent) in one long table with a ``kind``."""
    if strategy not in panel.columns:
        panel = panel.withColumn(strategy, F.lit("all"))
    shared = None if actions is None else actions.toPandas()  # an event table
    names = [c.split()[0] for c in _LOG.split(", ")]

    def one(p: pd.DataFrame) -> pd.DataFrame:
        parts = [x.assign(kind=k) for k, x in simulate(p, cfg, shared) if len(x)]
        out = pd.concat(parts, ignore_index=True).assign(strategy=p[strategy].iloc[0]).reindex(columns=names)
        out["id"] = out["id"].astype("Int64")
        return out

    return panel.groupBy(strategy).applyInPandas(one, _LOG)


def validate_universe(returns: DataFrame, signals: DataFrame) -> None:
    """Both tables must have the same ids."""
    a, b = returns.select("id").distinct(), signals.select("id").distinct()
    if not a.join(b, "id", "left_anti").isEmpty() or not b.join(a, "id", "left_anti").isEmpty():
        raise ValueError("returns and signals have different ids")


def weight_space_eligible(cfg: BacktestConfig) -> bool:
    return not (cfg.share_space or cfg.execution_lag or cfg.corporate_actions or cfg.borrow_costs or cfg.short_gating or cfg.financing or cfg.cash_interest_rate)


def run_backtest(returns: DataFrame, signals: DataFrame, cfg: BacktestConfig = BacktestConfig(), prices: DataFrame | None = None, costs: DataFrame | None = None, mask: DataFrame | None = None, actions: DataFrame | None = None, borrow: DataFrame | None = None, bounds: DataFrame | None = None) -> BacktestResult:
    """The windows where the configuration allows, else bar by bar."""
    validate_universe(returns, signals)
    if cfg.share_space and prices is None:
        raise ValueError("share accounting needs prices")
    if weight_space_eligible(cfg):
        return weight_space_backtest(returns, signals, cfg, costs, prices, mask if cfg.universe_mask else None, bounds)
    panel = returns.join(signals.select("date", "id", "signal"), ["date", "id"], "left")
    for table, names in ((prices, ("close", "adv_20")), (costs, ("commission_bps", "half_spread_bps", "exchange_fee_bps", "min_commission", "impact_coef")), (mask, ("tradable",)), (borrow, ("borrow_rate_bps", "shortable", "loan_availability"))):
        if table is not None:
            panel = panel.join(table.select("date", "id", *(n for n in names if n in table.columns)), ["date", "id"], "left")
    if bounds is not None:
        panel = panel.join(bounds.select("id", "min_weight", "max_weight"), "id", "left")
    log = bar_backtest(panel, cfg, actions).persist()
    pick = lambda k, *c: log.where(F.col("kind") == k).select(*c)
    drag = log.where("kind = 'final'").agg(F.max("drag")).first()[0] or 0.0
    return BacktestResult(
        pick("nav", "date", "nav"), pick("trades", "date", "id", "quantity"), pick("final", "id", "weight", "shares"),
        pick("fills", "date", "id", "shares", "fill_price", "cost", "slippage"), pick("cash", "date", "cash"), drag,
    )


def with_dates(cfg: BacktestConfig, dates: list) -> BacktestConfig:
    return replace(cfg, rebalance_dates=tuple(dates))


def stitch_nav(folds: DataFrame, initial: float) -> DataFrame:
    """One path from per-fold paths (fold, date, nav): each starts where the one before ended."""
    ends = folds.groupBy("fold").agg(F.max_by("nav", "date").alias("_end"))
    scale = ends.select("fold", F.coalesce(F.exp(F.sum(F.log(F.col("_end") / initial)).over(Window.orderBy("fold").rowsBetween(Window.unboundedPreceding, -1))), F.lit(1.0)).alias("_x"))
    return folds.join(F.broadcast(scale), "fold").select("date", "fold", (F.col("nav") * F.col("_x")).alias("nav"))  # one row for each fold
