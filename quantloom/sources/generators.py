"""Synthetic research datasets as DataFrame plans.

Every random value is a hash of a seed, a label and the row's keys, so a table is the same however it is
partitioned and any column can be derived again elsewhere.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stats import clip, compound, running
from .schema import schema_for

# Names that the datasets use.
SECTORS = ("Tech", "Financials", "Energy", "Health", "Industrials", "Consumer")
ACTION_TYPES = ("split", "cash_dividend", "special_dividend", "spinoff", "delisting")
FEATURE_CATEGORIES = ("momentum", "value", "quality", "growth", "volatility")
EXCHANGES = ("XNYS", "XNAS", "XLON", "XTKS")
HORIZONS = (1, 5, 21, 63)
STAGES = ("etl", "signals", "models", "portfolio", "backtest", "analysis", "profiling", "io", "report")
SIGNALS = ("momentum", "value", "quality")


@dataclass(frozen=True)
class GenSpec:
    n_assets: int = 100
    n_dates: int = 252
    n_features: int = 10
    n_factors: int = 4
    n_signals: int = 3
    n_benchmarks: int = 1
    start: str = "2000-01-03"
    seed: int = 0


def uniform(spec: GenSpec, label: str, *keys: str | Column) -> Column:
    """Uniform in (0, 1) by hash of seed, label and keys."""
    h = F.xxhash64(F.lit(spec.seed), F.lit(label), *keys)
    return (F.pmod(h, F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def normal(spec: GenSpec, label: str, *keys: str | Column) -> Column:
    """Standard normal by the polar form of two uniforms."""
    return F.sqrt(-2 * F.log(uniform(spec, label + "/r", *keys))) * F.cos(2 * math.pi * uniform(spec, label + "/a", *keys))


def pick(values: tuple[str, ...], u: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), F.floor(u * len(values)).cast("int") + 1)


# --- axes ------------------------------------------------------------------------------------------

def date_axis(spark: SparkSession, n_dates: int, start: str = "2000-01-01") -> DataFrame:
    """Consecutive calendar days."""
    return spark.range(n_dates).select(F.date_add(F.lit(start).cast("date"), F.col("id").cast("int")).alias("date"))


def session_axis(spark: SparkSession, n_dates: int, start: str = "2000-01-01") -> DataFrame:
    """(date, t): the first weekdays from a start, by arithmetic on weeks, so no row is generated in vain."""
    first = F.weekday(F.lit(start).cast("date"))
    lead = F.when(first < 5, first).otherwise(F.lit(7))  # sessions before the start in its week, or the next week
    k = F.col("id") + F.when(first < 5, lead).otherwise(0)
    monday = F.date_sub(F.lit(start).cast("date"), F.when(first < 5, first).otherwise(first - 7).cast("int"))
    return spark.range(n_dates).select(F.date_add(monday, (F.floor(k / 5) * 7 + k % 5).cast("int")).alias("date"), F.col("id").alias("t"))


def panel_axis(spark: SparkSession, spec: GenSpec) -> DataFrame:
    """(date, t, id) for all sessions and assets."""
    return session_axis(spark, spec.n_dates, spec.start).crossJoin(spark.range(spec.n_assets))


def returns_column(spec: GenSpec) -> Column:
    """Daily percent return of a cell, clipped so that prices stay positive."""
    return clip(normal(spec, "return", "t", "id") * 3, -50.0, 50.0)


def generate_returns(spark: SparkSession, n_assets: int, n_dates: int, start: str = "2000-01-01", seed: int = 0) -> DataFrame:
    spec = GenSpec(n_assets, n_dates, seed=seed)
    days = date_axis(spark, n_dates, start).withColumn("t", F.datediff("date", F.lit(start).cast("date")).cast("long"))
    return days.crossJoin(spark.range(n_assets)).select("date", "id", (normal(spec, "return", "t", "id") * 3).alias("return"))


# --- panels ----------------------------------------------------------------------------------------

def prices(spark: SparkSession, spec: GenSpec) -> DataFrame:
    p = panel_axis(spark, spec).withColumn("_r", F.when(F.col("t") == 0, 0.0).otherwise(returns_column(spec)))
    p = p.withColumn("close", (20 + 80 * uniform(spec, "base", "id")) * compound(F.col("_r") / 100, running("id", order="t")))
    p = p.withColumn("open", F.col("close") * (1 + normal(spec, "open", "t", "id") * 0.005)).withColumn("volume", F.exp(13 + normal(spec, "volume", "t", "id") * 0.5))
    p = p.withColumns({"high": F.greatest("open", "close") * (1 + F.abs(normal(spec, "high", "t", "id")) * 0.003), "low": F.least("open", "close") * (1 - clip(F.abs(normal(spec, "low", "t", "id")) * 0.003, 0, 0.5))})
    p = p.withColumn("vwap", (F.col("high") + F.col("low") + F.col("close")) / 3).withColumn("dollar_volume", F.col("volume") * F.col("vwap"))
    p = p.withColumn("adv_20", F.avg("dollar_volume").over(Window.partitionBy("id").orderBy("t").rowsBetween(-19, 0))).withColumn("currency", F.lit("USD"))
    return p.select("date", "id", "open", "high", "low", "close", "vwap", "volume", "dollar_volume", "adv_20", "currency")


def shares_outstanding(spark, spec):
    shares = F.exp(17 + normal(spec, "shares", "id"))
    return prices(spark, spec).select("date", "id", shares.alias("shares_outstanding"), (shares * F.col("close")).alias("market_cap"))


def universe_mask(spark, spec):
    p = panel_axis(spark, spec).withColumns({"listed": uniform(spec, "listed", "id", "t") < 0.99, "halted": uniform(spec, "halted", "t", "id") < 0.01})
    p = p.withColumn("tradable", F.col("listed") & ~F.col("halted")).withColumn("in_universe", F.col("tradable") & (uniform(spec, "member", "id", "t") < 0.95))
    return p.select("date", "id", "in_universe", "tradable", "halted", "listed")


def borrow_rates(spark, spec):
    return panel_axis(spark, spec).select("date", "id", (25 + 75 * uniform(spec, "borrow", "t", "id")).alias("borrow_rate_bps"), (uniform(spec, "shortable", "t", "id") < 0.9).alias("shortable"), (1e6 * (1 + 9 * uniform(spec, "loan", "t", "id"))).alias("loan_availability"))


def transaction_costs(spark, spec):
    u = lambda n: uniform(spec, n, "t", "id")
    return panel_axis(spark, spec).select("date", "id", (0.5 + u("comm")).alias("commission_bps"), (1 + 4 * u("spread")).alias("half_spread_bps"), (5 + 10 * u("impact")).alias("impact_coef"), F.lit(1.0).alias("min_commission"), F.lit(0.3).alias("exchange_fee_bps"))


def specific_risk(spark, spec):
    return panel_axis(spark, spec).select("date", "id", (0.5 + 2 * uniform(spec, "specific", "t", "id")).alias("specific_var"))


def _factors(spark, spec, name="factor_id"):
    return spark.range(spec.n_factors).withColumnRenamed("id", name)


def factor_loadings(spark, spec):
    return panel_axis(spark, spec).crossJoin(_factors(spark, spec)).select("date", "id", "factor_id", (normal(spec, "loading", "id", "factor_id") + 0.05 * normal(spec, "loading noise", "t", "id", "factor_id")).alias("loading"))


def factor_returns(spark, spec):
    return session_axis(spark, spec.n_dates, spec.start).crossJoin(_factors(spark, spec)).select("date", "factor_id", normal(spec, "factor", "t", "factor_id").alias("return"))


def factor_covariance(spark, spec):
    """A positive semidefinite matrix: the product of a hashed root with itself plus a diagonal."""
    n = spec.n_factors
    root = lambda i, k: normal(spec, "root", i, F.lit(k)) * 0.3
    cov = reduce(lambda a, k: a + root("factor_i", k) * root("factor_j", k), range(n), F.when(F.col("factor_i") == F.col("factor_j"), 0.1).otherwise(0.0))
    pairs = _factors(spark, spec, "factor_i").crossJoin(_factors(spark, spec, "factor_j")).withColumn("cov", cov)
    return session_axis(spark, spec.n_dates, spec.start).select("date").crossJoin(pairs)


def forward_returns(spark, spec):
    p = panel_axis(spark, spec).withColumn("_r", F.when(F.col("t") == 0, 0.0).otherwise(returns_column(spec)))
    w = Window.partitionBy("id").orderBy("t")
    out = {f"fwd_ret_{h}": F.when(F.count("_r").over(w.rowsBetween(1, h)) == h, (compound(F.col("_r") / 100, w.rowsBetween(1, h)) - 1) * 100) for h in HORIZONS}
    return p.select("date", "id", *(c.alias(n) for n, c in out.items()))


def _next(spec: GenSpec) -> Column:
    """z-score, about, of the next session's return."""
    return F.coalesce(clip(normal(spec, "return", F.col("t") + 1, "id"), -16.0, 16.0), F.lit(0.0))


def feature_panel(spark, spec):
    cols = [((0.3 * (-1) ** i / (1 + i)) * _next(spec) + normal(spec, f"feature {i}", "t", "id")).alias(f"feat_{i}") for i in range(spec.n_features)]
    return panel_axis(spark, spec).select("date", "id", *cols)


def alpha_signals(spark, spec):
    names = [SIGNALS[i] if i < len(SIGNALS) else f"signal_{i}" for i in range(spec.n_signals)]
    parts = [panel_axis(spark, spec).select("date", "id", F.lit(n).alias("signal_name"), ((0.05 + 0.03 * k) * _next(spec) + math.sqrt(1 - (0.05 + 0.03 * k) ** 2) * normal(spec, f"signal {k}", "t", "id")).alias("signal")) for k, n in enumerate(names)]
    return reduce(DataFrame.unionByName, parts)


def sample_weights(spark, spec, halflife: int = 126):
    w = F.pow(F.lit(0.5), (spec.n_dates - 1 - F.col("t")) / halflife) * (0.5 + uniform(spec, "weight", "t", "id"))
    p = panel_axis(spark, spec).withColumn("_w", w)
    mean = p.agg(F.avg("_w").alias("_m"))
    return p.crossJoin(mean).select("date", "id", (F.col("_w") / F.col("_m")).alias("weight"))  # mean: one row


def benchmark_weights(spark, spec):
    p = panel_axis(spark, spec).withColumn("_w", uniform(spec, "bench", "t", "id"))
    return p.select("date", "id", (F.col("_w") / F.sum("_w").over(Window.partitionBy("date"))).alias("benchmark_weight"))


# --- series ----------------------------------------------------------------------------------------

def risk_free_rate(spark, spec):
    s = session_axis(spark, spec.n_dates, spec.start).withColumn("annual_rate", clip(0.03 + F.sum(normal(spec, "rf", "t") * 0.0005).over(running(order="t")), 0.0, 0.10))
    return s.select("date", "annual_rate", (F.col("annual_rate") / 252).alias("daily_rate"))


def benchmark_returns(spark, spec):
    names = spark.range(spec.n_benchmarks).select(F.concat(F.lit("BENCH_"), F.col("id")).alias("benchmark_id"))
    return session_axis(spark, spec.n_dates, spec.start).crossJoin(names).select("date", "benchmark_id", (0.03 + normal(spec, "benchmark", "t", "benchmark_id")).alias("return"))


def fx_rates(spark, spec):
    base = {"EUR": 1.1, "JPY": 0.009, "GBP": 1.3}
    parts = [session_axis(spark, spec.n_dates, spec.start).select("date", F.lit(c).alias("from_currency"), F.lit("USD").alias("to_currency"), (b * compound(clip(normal(spec, f"fx {c}", "t") * 0.005, -0.5, 0.5), running(order="t"))).alias("rate")) for c, b in base.items()]
    return reduce(DataFrame.unionByName, parts)


def trading_calendar(spark, spec):
    s = session_axis(spark, spec.n_dates, spec.start).withColumn("is_half_day", uniform(spec, "half", "t") < 0.02)
    return s.select("date", F.lit("XNYS").alias("exchange"), F.lit(True).alias("is_session"), "is_half_day", F.lit("09:30").alias("session_open"), F.when(F.col("is_half_day"), "13:00").otherwise("16:00").alias("session_close"))


def regime_states(spark, spec, stay: float = 0.85):
    """A three-state chain: one fold over the date axis, a short array."""
    s = session_axis(spark, spec.n_dates, spec.start).withColumns({"_u": uniform(spec, "regime", "t"), "_j": uniform(spec, "jump", "t")})
    days = s.agg(F.array_sort(F.collect_list(F.struct("t", "date", "_u", "_j"))).alias("days"))
    path = F.aggregate("days", F.array().cast("array<struct<date:date,regime_state:bigint>>"), lambda a, d: F.concat(a, F.array(F.struct(d["date"].alias("date"), F.when(F.size(a) == 0, F.floor(d["_u"] * 3)).when(d["_u"] < stay, F.element_at(a, -1)["regime_state"]).otherwise(F.pmod(F.element_at(a, -1)["regime_state"] + 1 + F.floor(d["_j"] * 2), F.lit(3))).cast("bigint").alias("regime_state")))))
    return days.select(F.inline(path))


# --- reference tables ------------------------------------------------------------------------------

def _day(spec: GenSpec, t: Column) -> Column:
    """Date of the session with an ordinal, for a start on a Monday; else the nearest such weekday."""
    monday = F.date_sub(F.lit(spec.start).cast("date"), F.weekday(F.lit(spec.start).cast("date")))
    return F.date_add(monday, (F.floor(t / 5) * 7 + t % 5).cast("int"))


def corporate_actions(spark, spec):
    """About one event in a thousand cells, at least a tenth of the assets; one for each date, id and kind."""
    n = max(int(spec.n_assets * spec.n_dates * 0.001), spec.n_assets // 10, 1)
    e = spark.range(n).withColumnRenamed("id", "k")
    e = e.select(_day(spec, F.floor(uniform(spec, "ca day", "k") * spec.n_dates)).alias("ex_date"), F.floor(uniform(spec, "ca id", "k") * spec.n_assets).alias("id"), pick(ACTION_TYPES, uniform(spec, "ca kind", "k")).alias("action_type"), "k")
    e = e.withColumn("_rn", F.row_number().over(Window.partitionBy("ex_date", "id", "action_type").orderBy("k"))).where("_rn = 1")
    return e.select(
        "ex_date", "id", "action_type", F.when(F.col("action_type") == "split", F.element_at(F.array(F.lit(2.0), F.lit(3.0), F.lit(0.5)), F.floor(uniform(spec, "ratio", "k") * 3).cast("int") + 1)).alias("split_ratio"),
        F.when(F.col("action_type").isin("cash_dividend", "special_dividend"), 0.1 + uniform(spec, "cash", "k")).alias("cash_amount"), F.lit("USD").alias("currency"), F.when(F.col("action_type") == "spinoff", F.col("id") + spec.n_assets).alias("new_id"),
    )


def security_master(spark, spec):
    gone = uniform(spec, "delisted", "id") < 0.05
    s = spark.range(spec.n_assets).withColumn("sector", pick(SECTORS, uniform(spec, "sector", "id")))
    return s.select(
        "id", F.format_string("T%05d", "id").alias("ticker"), F.format_string("Company %d", "id").alias("name"), "sector", F.concat(F.col("sector"), F.lit(" "), (F.col("id") % 3).cast("string")).alias("industry"), F.lit("US").alias("country"),
        pick(EXCHANGES, uniform(spec, "exchange", "id")).alias("exchange"), F.lit("USD").alias("currency"), F.lit(100).cast("bigint").alias("lot_size"), F.lit(spec.start).cast("date").alias("listing_date"),
        F.when(gone, _day(spec, F.lit(spec.n_dates // 2) + F.floor(uniform(spec, "gone", "id") * (spec.n_dates // 2)))).alias("delisting_date"), (~gone).alias("is_active"),
    )


def fundamentals(spark, spec):
    """Quarterly rows (63 sessions), known 30 sessions later, at most on the last date."""
    q = spark.range(spec.n_assets).crossJoin(spark.range(max(1, spec.n_dates // 63) + 1).withColumnRenamed("id", "q"))
    t = F.least(F.col("q") * 63, F.lit(spec.n_dates - 1))
    revenue = F.exp(18 + normal(spec, "revenue", "id", "q") * 0.3)
    rows = q.select(_day(spec, t).alias("report_date"), _day(spec, F.least(t + 30, F.lit(spec.n_dates - 1))).alias("knowledge_date"), "id", revenue.alias("revenue"), "q").dropDuplicates(["report_date", "knowledge_date", "id"])
    share = lambda n, lo, hi: F.col("revenue") * (lo + (hi - lo) * uniform(spec, n, "id", "q"))
    return rows.select("report_date", "knowledge_date", "id", "revenue", share("income", -0.05, 0.2).alias("net_income"), share("assets", 1, 3).alias("total_assets"), share("equity", 0.5, 1).alias("total_equity"), share("debt", 0.1, 0.5).alias("total_debt"), share("cash flow", 0, 0.3).alias("operating_cash_flow"), F.lit("USD").alias("currency"))


def feature_metadata(spark, spec):
    return spark.range(spec.n_features).select(F.concat(F.lit("feat_"), F.col("id")).alias("feature"), pick(FEATURE_CATEGORIES, uniform(spec, "category", "id")).alias("category"), (uniform(spec, "winsorize", "id") < 0.5).alias("winsorize"), (5 + 5 * F.col("id")).alias("lookback_days"))


def signal_registry(spark, spec):
    names = [(SIGNALS[i] if i < 3 else f"signal_{i}", SIGNALS[i % 3], False, HORIZONS[i % 4]) for i in range(spec.n_signals)]
    return spark.createDataFrame(names, schema_for("signal_registry").ddl())


def position_constraints(spark, spec):
    cap = 0.02 + 0.08 * uniform(spec, "cap", "id")
    return spark.range(spec.n_assets).select("id", (-cap).alias("min_weight"), cap.alias("max_weight"), (uniform(spec, "position", "id") < 0.97).alias("tradable"))


def group_constraints(spark, spec):
    return spark.createDataFrame([(s, -0.30, 0.30) for s in SECTORS], schema_for("group_constraints").ddl())


def cv_splits_calendar(spark, spec, n_folds: int = 5, embargo: int = 5):
    size = spec.n_dates // (n_folds + 1)
    t = lambda x: _day(spec, x)
    f = F.col("fold")
    return spark.range(n_folds).withColumnRenamed("id", "fold").select("fold", t(F.lit(0)).alias("train_start"), t(F.greatest((f + 1) * size - 1 - embargo, F.lit(0))).alias("train_end"), F.lit(embargo).cast("bigint").alias("embargo_days"), t((f + 1) * size).alias("test_start"), t((f + 2) * size - 1).alias("test_end"))


# --- telemetry -------------------------------------------------------------------------------------

def _runs(spark, n=5):
    return spark.range(n).select(F.format_string("run_%03d", "id").alias("run_id"), "id")


def profiling_runs(spark, spec):
    return _runs(spark).select("run_id", F.date_add(F.lit(spec.start).cast("date"), F.col("id").cast("int")).alias("run_ts"), F.sha1(F.col("run_id").cast("binary")).alias("git_sha"), F.lit(False).alias("git_dirty"), F.lit("host").alias("hostname"), F.lit("cpu").alias("cpu_model"), F.lit(8).cast("bigint").alias("n_cores"), F.lit(32768.0).alias("total_ram_mb"), F.lit("3.13").alias("python_version"), F.lit("-").alias("polars_version"), F.lit("2").alias("numpy_version"), F.lit(1).cast("bigint").alias("blas_threads"), F.lit(5).cast("bigint").alias("trials"), F.lit(1).cast("bigint").alias("warmup_trials"))


def _points(spark):
    return spark.range(4).select(F.col("id").alias("param_point_id"), (100 * F.pow(F.lit(2), "id")).cast("bigint").alias("n_assets"), F.lit(252).cast("bigint").alias("n_dates"), F.lit(10).cast("bigint").alias("n_features"), F.lit(4).cast("bigint").alias("n_factors"))


def _stages(spark):
    return spark.createDataFrame([(s,) for s in STAGES], "stage string")


def stage_measurements(spark, spec, n_trials: int = 5):
    rows = _runs(spark).crossJoin(_points(spark)).crossJoin(_stages(spark)).crossJoin(spark.range(n_trials).withColumnRenamed("id", "trial_idx"))
    k = ("run_id", "param_point_id", "stage", "trial_idx")
    size = F.col("n_assets") / 100
    noise = lambda n: 1 + 0.05 * normal(spec, n, *k)
    return rows.select("run_id", "param_point_id", "n_assets", "n_dates", "n_features", "n_factors", "stage", "trial_idx", (0.05 * size * noise("s")).alias("elapsed_s"), (2 * size * noise("r")).alias("result_mb"), (size * noise("d")).alias("rss_delta_mb"), (200 + 10 * size * noise("p")).alias("peak_rss_mb"), (5 * size * noise("t")).alias("peak_traced_mb"))


def stage_baselines(spark, spec):
    rows = _points(spark).where("param_point_id < 2").crossJoin(_stages(spark))
    e = 0.05 * F.col("n_assets") / 100
    return rows.select(F.lit("base").alias("baseline_id"), "param_point_id", "n_assets", "n_dates", "n_features", "n_factors", "stage", e.alias("elapsed_s_p50"), (e * 1.1).alias("elapsed_s_p90"), (2 * F.col("n_assets") / 100).alias("result_mb"), (200 + F.col("n_assets") / 10).alias("peak_rss_mb"), F.lit("run_000").alias("source_run_id"), F.lit(spec.start).cast("date").alias("created_ts"))


def regression_thresholds(spark, spec):
    m = spark.createDataFrame([("elapsed_s",), ("result_mb",), ("peak_rss_mb",)], "metric string")
    return _stages(spark).crossJoin(m).select("stage", "metric", F.lit(0.20).alias("max_pct_increase"), F.lit(0.05).alias("max_abs_increase"), F.lit(3).cast("bigint").alias("min_samples"))


def scaling_fits(spark, spec):
    m = spark.createDataFrame([("elapsed_s",), ("result_mb",), ("peak_traced_mb",), ("peak_rss_mb",)], "metric string")
    k = ("stage", "metric")
    return _stages(spark).crossJoin(m).select(F.lit("run_000").alias("run_id"), "stage", "metric", F.lit("n_assets").alias("scaling_dim"), (1 + 0.1 * normal(spec, "slope", *k)).alias("log_log_slope"), normal(spec, "intercept", *k).alias("intercept"), (0.9 + 0.1 * uniform(spec, "r2", *k)).alias("r_squared"), F.lit(4).cast("bigint").alias("n_points"))


def cpu_profile_frames(spark, spec):
    f = spark.createDataFrame([(f"fn_{i}", i) for i in range(6)], "function string, i int")
    total = 0.01 * (6 - F.col("i"))
    return _stages(spark).crossJoin(f).select(F.lit("run_000").alias("run_id"), F.lit(0).cast("bigint").alias("param_point_id"), "stage", "function", F.lit("engine.py").alias("filename"), (10 * (F.col("i") + 1)).cast("bigint").alias("lineno"), total.alias("cumulative_s"), (total / 2).alias("self_s"), (100 + F.col("i")).cast("bigint").alias("call_count"))


GENERATORS = {
    f.__name__: f
    for f in (
        prices, shares_outstanding, universe_mask, borrow_rates, transaction_costs, specific_risk, factor_loadings, factor_returns, factor_covariance, feature_panel, forward_returns, alpha_signals, sample_weights, risk_free_rate,
        benchmark_returns, benchmark_weights, fx_rates, trading_calendar, corporate_actions, security_master, fundamentals, feature_metadata, signal_registry, position_constraints, group_constraints, cv_splits_calendar,
        profiling_runs, stage_measurements, stage_baselines, regression_thresholds, scaling_fits, cpu_profile_frames, regime_states,
    )
}


def generate(spark: SparkSession, name: str, spec: GenSpec = GenSpec(), validate: bool = False) -> DataFrame:
    """One dataset with its declared types."""
    s = schema_for(name, spec.n_features)
    df = GENERATORS[name](spark, spec)
    df = df.select(*(F.col(c.name).cast(c.dtype).alias(c.name) for c in s.columns))
    return s.validate(df) if validate else df


def generate_all(spark: SparkSession, spec: GenSpec = GenSpec(), validate: bool = False) -> dict[str, DataFrame]:
    return {name: generate(spark, name, spec, validate) for name in GENERATORS}


def write_all(spark: SparkSession, folder: str, spec: GenSpec = GenSpec(), names: tuple[str, ...] | None = None) -> None:
    for name in names or GENERATORS:
        generate(spark, name, spec).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def measure(tables: dict[str, DataFrame]) -> list[tuple[str, int, int, int]]:
    """(name, rows, columns, bytes by the plan's own estimate), largest first."""
    rows = [(n, df.count(), len(df.columns), int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().longValue())) for n, df in tables.items()]
    return sorted(rows, key=lambda r: -r[3])


def format_report(sizes: list[tuple[str, int, int, int]]) -> str:
    return "\n".join(f"{n:<24}{r:>12}{c:>6}{b / 1e6:>12.2f} MB" for n, r, c, b in sizes)
