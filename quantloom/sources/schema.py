"""Declared schemas of the 33 datasets and their validation."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class SchemaError(ValueError):
    """A table does not match its declared schema."""


@dataclass(frozen=True)
class Column:
    name: str
    dtype: str
    nullable: bool = False


@dataclass(frozen=True)
class Schema:
    name: str
    columns: tuple[Column, ...]
    keys: tuple[str, ...]

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, T._parse_datatype_string(c.dtype), c.nullable) for c in self.columns])

    def ddl(self) -> str:
        return ", ".join(f"`{c.name}` {c.dtype}" for c in self.columns)

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name == name:
                return c
        raise KeyError(name)

    def empty(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([], self.ddl())

    def validate(self, df: DataFrame) -> DataFrame:
        """Types, then nulls and repeated keys in one aggregate each; extra columns are allowed."""
        have = dict(df.dtypes)
        for c in self.columns:
            if c.name not in have:
                raise SchemaError(f"{self.name}: no column {c.name}")
            if have[c.name] != c.dtype:
                raise SchemaError(f"{self.name}.{c.name}: {have[c.name]} instead of {c.dtype}")
        strict = [c.name for c in self.columns if not c.nullable]
        nulls = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in strict)).first().asDict() if strict else {}
        if bad := {k: v for k, v in nulls.items() if v}:
            raise SchemaError(f"{self.name}: nulls in {bad}")
        if n := key_violations(df, self.keys).agg(F.sum("n")).first()[0]:
            raise SchemaError(f"{self.name}: {n} rows with repeated keys")
        return df


def key_violations(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, n) of the keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


# The columns of each dataset in order as name:type, with ? where null is allowed, and its keys.
_DECLARED = {
    "prices": ("date id", "date:date id:bigint open:double high:double low:double close:double vwap:double volume:double dollar_volume:double adv_20:double currency:string"),
    "shares_outstanding": ("date id", "date:date id:bigint shares_outstanding:double market_cap:double"),
    "universe_mask": ("date id", "date:date id:bigint in_universe:boolean tradable:boolean halted:boolean listed:boolean"),
    "borrow_rates": ("date id", "date:date id:bigint borrow_rate_bps:double shortable:boolean loan_availability:double"),
    "transaction_costs": ("date id", "date:date id:bigint commission_bps:double half_spread_bps:double impact_coef:double min_commission:double exchange_fee_bps:double"),
    "specific_risk": ("date id", "date:date id:bigint specific_var:double"),
    "factor_loadings": ("date id factor_id", "date:date id:bigint factor_id:bigint loading:double"),
    "factor_returns": ("date factor_id", "date:date factor_id:bigint return:double"),
    "factor_covariance": ("date factor_i factor_j", "date:date factor_i:bigint factor_j:bigint cov:double"),
    "feature_panel": ("date id", "date:date id:bigint"),
    "forward_returns": ("date id", "date:date id:bigint fwd_ret_1:double? fwd_ret_5:double? fwd_ret_21:double? fwd_ret_63:double?"),
    "alpha_signals": ("date id signal_name", "date:date id:bigint signal_name:string signal:double"),
    "sample_weights": ("date id", "date:date id:bigint weight:double"),
    "risk_free_rate": ("date", "date:date annual_rate:double daily_rate:double"),
    "benchmark_returns": ("date benchmark_id", "date:date benchmark_id:string return:double"),
    "benchmark_weights": ("date id", "date:date id:bigint benchmark_weight:double"),
    "fx_rates": ("date from_currency to_currency", "date:date from_currency:string to_currency:string rate:double"),
    "trading_calendar": ("date exchange", "date:date exchange:string is_session:boolean is_half_day:boolean session_open:string session_close:string"),
    "corporate_actions": ("ex_date id action_type", "ex_date:date id:bigint action_type:string split_ratio:double? cash_amount:double? currency:string new_id:bigint?"),
    "security_master": ("id", "id:bigint ticker:string name:string sector:string industry:string country:string exchange:string currency:string lot_size:bigint listing_date:date delisting_date:date? is_active:boolean"),
    "fundamentals": ("report_date knowledge_date id", "report_date:date knowledge_date:date id:bigint revenue:double net_income:double total_assets:double total_equity:double total_debt:double operating_cash_flow:double currency:string"),
    "feature_metadata": ("feature", "feature:string category:string winsorize:boolean lookback_days:bigint"),
    "signal_registry": ("signal_name", "signal_name:string family:string is_categorical:boolean intended_horizon:bigint"),
    "position_constraints": ("id", "id:bigint min_weight:double max_weight:double tradable:boolean"),
    "group_constraints": ("sector", "sector:string min_exposure:double max_exposure:double"),
    "cv_splits_calendar": ("fold", "fold:bigint train_start:date train_end:date embargo_days:bigint test_start:date test_end:date"),
    "profiling_runs": ("run_id", "run_id:string run_ts:date git_sha:string git_dirty:boolean hostname:string cpu_model:string n_cores:bigint total_ram_mb:double python_version:string polars_version:string numpy_version:string blas_threads:bigint trials:bigint warmup_trials:bigint"),
    "stage_measurements": ("run_id param_point_id stage trial_idx", "run_id:string param_point_id:bigint n_assets:bigint n_dates:bigint n_features:bigint n_factors:bigint stage:string trial_idx:bigint elapsed_s:double result_mb:double rss_delta_mb:double peak_rss_mb:double peak_traced_mb:double"),
    "stage_baselines": ("baseline_id param_point_id stage", "baseline_id:string param_point_id:bigint n_assets:bigint n_dates:bigint n_features:bigint n_factors:bigint stage:string elapsed_s_p50:double elapsed_s_p90:double result_mb:double peak_rss_mb:double source_run_id:string created_ts:date"),
    "regression_thresholds": ("stage metric", "stage:string metric:string max_pct_increase:double max_abs_increase:double min_samples:bigint"),
    "scaling_fits": ("run_id stage metric scaling_dim", "run_id:string stage:string metric:string scaling_dim:string log_log_slope:double intercept:double r_squared:double n_points:bigint"),
    "cpu_profile_frames": ("run_id param_point_id stage function", "run_id:string param_point_id:bigint stage:string function:string filename:string lineno:bigint cumulative_s:double self_s:double call_count:bigint"),
    "regime_states": ("date", "date:date regime_state:bigint"),
}


def _schema(name: str) -> Schema:
    keys, columns = _DECLARED[name]
    return Schema(name, tuple(Column(c.split(":")[0], c.split(":")[1].rstrip("?"), c.endswith("?")) for c in columns.split()), tuple(keys.split()))


REGISTRY: dict[str, Schema] = {name: _schema(name) for name in _DECLARED}


def schema_for(name: str, n_features: int = 0) -> Schema:
    """Schema of a dataset; the feature panel has as many feature columns as asked for."""
    s = REGISTRY[name]
    if name != "feature_panel":
        return s
    return reduce(lambda a, i: Schema(a.name, (*a.columns, Column(f"feat_{i}", "double")), a.keys), range(n_features), s)
