"""DuckDB SQL of the registered queries that SQL can express, with the same names and rounding."""

from __future__ import annotations

from ..sources.generators import GENERATORS, GenSpec
from ..sources.schema import schema_for
from .adapters import sql

RANK = "rank() OVER (PARTITION BY {p} ORDER BY {v}) + (count(*) OVER (PARTITION BY {p}, {v}) - 1) / 2.0"


def avg_rank(value: str, part: str = "date") -> str:
    return RANK.format(p=part, v=value)


def corr(x: str, y: str, least: int = 2) -> str:
    return f"CASE WHEN count(*) >= {least} AND var_pop({x}) > 0 AND var_pop({y}) > 0 THEN covar_pop({x}, {y}) / sqrt(var_pop({x}) * var_pop({y})) END"


def z(value: str, part: str = "date") -> str:
    return f"CASE WHEN count({value}) OVER (PARTITION BY {part}) >= 2 AND stddev_pop({value}) OVER (PARTITION BY {part}) > 0 THEN ({value} - avg({value}) OVER (PARTITION BY {part})) / stddev_pop({value}) OVER (PARTITION BY {part}) END"


_PAIRS = "SELECT date, id, signal AS s, fwd AS r FROM nation_panel WHERE fwd IS NOT NULL"
_IC = f"SELECT date, {corr('a', 'b', 5)} AS ic, count(*) AS n_obs FROM (SELECT date, {avg_rank('s')} AS a, {avg_rank('r')} AS b FROM pairs) GROUP BY date"
_IC_ALL = "SELECT d.date, ic, coalesce(n_obs, 0) AS n_obs FROM (SELECT DISTINCT date FROM nation_panel) d LEFT JOIN ic0 USING (date)"


def ic(body: str, **more: str) -> str:
    return sql(body, "nation_panel", pairs=_PAIRS, ic0=_IC, ic=_IC_ALL, **more)


_SPAIRS = "SELECT date, id, signal AS s, fwd_1 AS r FROM supplier_panel WHERE fwd_1 IS NOT NULL"
_BUCKETED = f"SELECT date, r, least(5, greatest(1, CAST(ceil(k / n * 5) AS INT))) AS bucket FROM (SELECT date, r, {avg_rank('s')} AS k, count(*) OVER (PARTITION BY date) AS n FROM spairs) WHERE n >= 5"
_BUCKETS = "SELECT date, bucket, avg(r) AS mean_ret, count(*) AS n_assets FROM bucketed GROUP BY 1, 2"
_BLEND = "SELECT date, id, unnest([signal, signal2, signal3]) AS s, unnest([0, 1, 2]) AS k FROM supplier_panel"
_REGIMES = "SELECT date, vol, CASE WHEN vol IS NULL THEN -1 ELSE (vol >= e1)::INT + (vol >= e2)::INT END AS regime FROM vols, (SELECT quantile_cont(vol, 1.0/3) AS e1, quantile_cont(vol, 2.0/3) AS e2 FROM vols)"
_VOLS = "SELECT date, CASE WHEN count(*) OVER w >= 5 THEN stddev_samp(return_1d) OVER w END AS vol FROM series WINDOW w AS (ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"
_ALIGNED = "SELECT d.date, i.id, w.value FROM (SELECT DISTINCT date FROM supplier_week WHERE month(date) <> 12) d CROSS JOIN (SELECT DISTINCT id FROM supplier_week) i LEFT JOIN supplier_week w ON w.date = d.date AND w.id = i.id"
_LOAD = "SELECT date, w.id, factor_id, loading FROM (SELECT DISTINCT date, id FROM supplier_month) w JOIN (SELECT s_suppkey AS id, 0 AS factor_id, 1.0::DOUBLE AS loading FROM supplier UNION ALL SELECT s_suppkey, 1, s_acctbal / 1000 FROM supplier) l ON w.id = l.id"
_ADJ = {
    "p": "SELECT date, id, value AS close FROM user_day WHERE value > 0",
    "a": "SELECT CAST(ts AS DATE) AS ex_date, user_id AS id, CAST(sum(CAST(value AS DECIMAL(28,4))) AS DOUBLE) / 100 AS cash FROM events WHERE event_type = 'purchase' GROUP BY 1, 2",
    "f": "SELECT a.ex_date, a.id, p.close / (p.close + a.cash) AS factor FROM a ASOF JOIN p ON a.id = p.id AND a.ex_date > p.date",
}
_DRAW = "SELECT date, nav, nav / max(nav) OVER (ORDER BY date) - 1 AS drawdown FROM nav"
_ONE = "SELECT date, ret / 100 AS r FROM nation_panel WHERE id = 3 AND date > DATE '1995-02-01'"
_BOTH = "SELECT date, r, return_1d AS b FROM one JOIN series USING (date)"
_TRADES = "SELECT date, id, CASE WHEN id % 2 = 0 THEN 1.0 ELSE -1.0 END * value AS quantity FROM supplier_month"
_BENCH = "SELECT date, id, 1.0::DOUBLE / count(*) OVER (PARTITION BY date) AS bw FROM supplier_month"
_STATIC = {
    "axis": "SELECT date, row_number() OVER (ORDER BY date) AS t FROM (SELECT DISTINCT date FROM nation_panel)",
    "x": "SELECT date, t, id, ret, 1.0::DOUBLE / count(*) OVER (PARTITION BY date) AS w FROM nation_panel JOIN axis USING (date)",
    "past": "SELECT a.date, b.t AS s, sum(a.w * b.ret) AS r FROM x a JOIN x b ON a.id = b.id AND b.t BETWEEN a.t - 12 AND a.t - 1 WHERE a.t > 12 GROUP BY 1, 2",
}
_RISK = {
    "w": "SELECT s_suppkey AS id, (s_suppkey % 7 + 1) / 100.0::DOUBLE AS weight, s_acctbal / 10000 AS x, (s_suppkey % 5 + 1) / 50.0::DOUBLE AS d FROM supplier",
    "e": "SELECT sum(weight) AS x0, sum(weight * x) AS x1 FROM w",
    "fx": "SELECT 0.04 * x0 + 0.01 * x1 AS f0, 0.01 * x0 + 0.09 * x1 AS f1, x0, x1 FROM e",
}
_GROSS = {
    "raw": "SELECT date, id, ret / 50 AS ret, exp(signal / 50 - max(signal / 50) OVER (PARTITION BY date)) AS e FROM nation_panel",
    "target": "SELECT date, id, ret, least(0.2, e / sum(e) OVER (PARTITION BY date)) AS w FROM raw",
    "axis": "SELECT date, t, t % 6 = 0 AS rebal, sum((t % 6 = 0)::INT) OVER (ORDER BY t) AS seg FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS t FROM (SELECT DISTINCT date FROM nation_panel))",
    "g": "SELECT date, t, rebal, id, ret, coalesce(first_value(CASE WHEN rebal THEN w ELSE w END) OVER (PARTITION BY id, seg ORDER BY t), 0) * coalesce(exp(sum(ln(1 + ret / 100)) OVER (PARTITION BY id, seg ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) AS raw FROM target JOIN axis USING (date)",
    "held": "SELECT date, t, ret, CASE WHEN rebal OR sum(raw) OVER (PARTITION BY date) <= 0 THEN raw ELSE raw / sum(raw) OVER (PARTITION BY date) END AS h FROM g",
    "day": "SELECT date, sum(h * ret / 100) AS port_ret FROM held GROUP BY date",
}
_MODEL = "SELECT date, id, value / 1e5 AS x1, signal2 AS x2, fwd_1 AS y, 1.0::DOUBLE AS weight FROM supplier_panel WHERE fwd_1 IS NOT NULL"
_AXIS = "SELECT date, row_number() OVER (ORDER BY date) - 1 AS t, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM nation_panel)"


def folds(reserved: str, embargo: int, splits: int, columns: str) -> str:
    """Test ranges [a, b] of (n - reserved) // splits dates behind the reserved ones, each begun ``embargo`` dates late;
    without reserved dates the last range takes what is left."""
    step = f"((n - {reserved}) // {splits})"
    end = "n - 1" if reserved == "0" else f"least(a + {step} - 1, n - 1)"
    part = f"SELECT *, CASE WHEN fold = {splits - 1} THEN {end} ELSE least(a + {step} - 1, n - 1) END AS b FROM (SELECT f AS fold, n, {reserved} + f * {step} + {embargo} AS a FROM (SELECT DISTINCT n FROM axis), range({splits}) r(f)) WHERE a < n"
    return sql(f"SELECT {columns} FROM part", "nation_panel", axis=_AXIS, part=part)


def on(expr: str) -> str:
    return f"(SELECT date FROM axis WHERE t = {expr})"


_SIGNED = "SELECT date, id, CASE WHEN id % 3 = 0 THEN -weight ELSE weight END AS w FROM weights"
_DATASETS = [(n, len(schema_for(n, GenSpec().n_features).columns)) for n in GENERATORS]

ORACLE: dict[str, str] = {
    "scan_filter_project": "SELECT CAST(l_shipdate AS DATE) AS date, l_suppkey AS id, l_extendedprice AS price FROM lineitem WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1998-01-10' AND DATE '1998-02-20' AND l_suppkey BETWEEN 1 AND 10",
    "schema_key_violations": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "duplicate_keys": "SELECT CAST(ts AS DATE) AS date, user_id AS id, count(*) AS n_dupes FROM events GROUP BY 1, 2 HAVING count(*) > 1",
    "join_left_coalesce": "SELECT c_custkey, coalesce(spend, 0.0) AS spend FROM customer LEFT JOIN (SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS spend FROM orders GROUP BY 1) ON o_custkey = c_custkey",
    "join_full_outer": "SELECT k, coalesce(customers, 0) AS customers, coalesce(suppliers, 0) AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS customers FROM customer WHERE c_nationkey % 2 = 0 GROUP BY 1) FULL JOIN (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier WHERE s_nationkey % 3 = 0 GROUP BY 1) USING (k)",
    "join_semi_anti": "SELECT c_mktsegment, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) THEN 'with' ELSE 'without' END AS kind, count(*) AS n FROM customer GROUP BY 1, 2",
    "join_range_interval": "SELECT CAST(f AS INT) AS fold, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders JOIN range(6) r(f) ON CAST(o_orderdate AS DATE) BETWEEN make_date(1995 + f, 3, 1) AND make_date(1995 + f, 9, 1) GROUP BY 1",
    "pivot_status": "SELECT l_returnflag AS flag, count(*) FILTER (WHERE l_linestatus = 'F') AS f, count(*) FILTER (WHERE l_linestatus = 'O') AS o FROM lineitem GROUP BY 1",
    "unpivot_measures": "SELECT l_returnflag, measure, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM (SELECT l_returnflag, l_quantity, l_extendedprice FROM lineitem) UNPIVOT (value FOR measure IN (l_quantity, l_extendedprice)) GROUP BY 1, 2",
    "set_operations": "SELECT 'intersect' AS op, count(*) AS n, CAST(sum(k) AS BIGINT) AS total FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'except', count(*), CAST(sum(k) AS BIGINT) FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_nationkey % 2 = 0) UNION ALL SELECT 'union', count(*), CAST(sum(k) AS BIGINT) FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier)",
    "aggregate_statistics": "SELECT l_returnflag, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, round(median(l_quantity), 8) AS median, round(stddev_samp(l_quantity), 8) AS std, min(l_quantity) AS low, max(l_quantity) AS high, (SELECT CAST(min(k) AS BIGINT) FROM (SELECT l_linenumber AS k, rank() OVER (ORDER BY count(*) DESC) AS r FROM lineitem b WHERE b.l_returnflag = a.l_returnflag GROUP BY 1) WHERE r = 1) AS mode, round(quantile_cont(l_quantity, 0.9), 8) AS p90 FROM lineitem a GROUP BY l_returnflag",
    "top_parts_by_type": "SELECT p_type, p_partkey, p_retailprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) WHERE rank <= 3",
    "date_parts": "SELECT year(o_orderdate) AS y, quarter(o_orderdate) AS q, CAST(isodow(o_orderdate) - 1 AS BIGINT) AS wd, count(*) AS n FROM orders GROUP BY 1, 2, 3",
    "rank_ic_by_month": ic("SELECT date, round(ic, 8) AS ic, n_obs FROM ic"),
    "pearson_ic_by_month": sql(f"SELECT d.date, round(ic, 8) AS ic, coalesce(n_obs, 0) AS n_obs FROM (SELECT DISTINCT date FROM nation_panel) d LEFT JOIN (SELECT date, {corr('s', 'r', 5)} AS ic, count(*) AS n_obs FROM pairs GROUP BY date) USING (date)", "nation_panel", pairs=_PAIRS),
    "kendall_ic_by_month": sql(
        "SELECT d.date, CASE WHEN m >= 5 AND x > 0 AND y > 0 THEN round(c / sqrt(x * y), 8) END AS ic, coalesce(m, 0) AS n_obs FROM (SELECT DISTINCT date FROM nation_panel) d LEFT JOIN tau USING (date) LEFT JOIN (SELECT date, count(*) AS m FROM pairs GROUP BY 1) USING (date)", "nation_panel", pairs=_PAIRS,
        tau="SELECT a.date, sum(sign(a.s - b.s) * sign(a.r - b.r))::DOUBLE AS c, sum((a.s <> b.s)::INT)::DOUBLE AS x, sum((a.r <> b.r)::INT)::DOUBLE AS y FROM pairs a JOIN pairs b ON a.date = b.date AND a.id < b.id GROUP BY 1",
    ),
    "ic_horizon_curve": sql(
        "SELECT horizon, round(avg(ic), 7) AS mean_ic, round(coalesce(avg(ic) / nullif(stddev_pop(ic), 0), 0), 7) AS ic_ir, count(ic) AS n_dates FROM h GROUP BY 1", "supplier_panel",
        long="SELECT date, id, signal AS s, unnest([fwd_1, fwd_3, fwd_6]) AS r, unnest(['fwd_1', 'fwd_3', 'fwd_6']) AS horizon FROM supplier_panel", ok="SELECT * FROM long WHERE r IS NOT NULL",
        h=f"SELECT horizon, date, {corr('a', 'b', 5)} AS ic FROM (SELECT horizon, date, {avg_rank('s', 'horizon, date')} AS a, {avg_rank('r', 'horizon, date')} AS b FROM ok) GROUP BY 1, 2 HAVING {corr('a', 'b', 5)} IS NOT NULL",
    ),
    "newey_west_t": ic(
        "SELECT n, round(m, 7) AS mean_ic, round(m / sqrt((g0 + 2 * (0.75 * g1 + 0.5 * g2 + 0.25 * g3)) / n), 7) AS t_stat FROM g",
        e="SELECT date, ic - avg(ic) OVER () AS e, avg(ic) OVER () AS m, count(*) OVER () AS n FROM ic WHERE ic IS NOT NULL", l="SELECT m, n, e, lag(e, 1) OVER w AS e1, lag(e, 2) OVER w AS e2, lag(e, 3) OVER w AS e3 FROM e WINDOW w AS (ORDER BY date)",
        g="SELECT any_value(n) AS n, any_value(m) AS m, sum(e * e) / any_value(n) AS g0, sum(e * e1) / any_value(n) AS g1, sum(e * e2) / any_value(n) AS g2, sum(e * e3) / any_value(n) AS g3 FROM l",
    ),
    "rolling_ic_ir": ic("SELECT date, CASE WHEN c = 6 THEN round(m, 6) END AS ic_mean, CASE WHEN c = 6 THEN round(s, 6) END AS ic_std, CASE WHEN c = 6 THEN round(m / nullif(s, 0), 6) END AS ic_ir FROM (SELECT date, count(ic) OVER w AS c, avg(ic) OVER w AS m, stddev_samp(ic) OVER w AS s FROM ic WINDOW w AS (ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))"),
    "quantile_buckets": sql("SELECT date, bucket, round(mean_ret, 8) AS mean_ret, n_assets FROM buckets", "supplier_panel", spairs=_SPAIRS, bucketed=_BUCKETED, buckets=_BUCKETS),
    "quantile_spread": sql(
        f"SELECT date, round(max(mean_ret) FILTER (WHERE bucket = 5) - max(mean_ret) FILTER (WHERE bucket = 1), 7) AS spread, round({corr('b', 'k', 3)}, 7) AS monotonicity FROM (SELECT date, bucket, mean_ret, {avg_rank('mean_ret')} AS k, {avg_rank('bucket')} AS b FROM buckets) GROUP BY date",
        "supplier_panel", spairs=_SPAIRS, bucketed=_BUCKETED, buckets=_BUCKETS,
    ),
    "neutralize_by_nation": sql("SELECT date, id, CASE WHEN e IS NOT NULL THEN CASE WHEN s > 1e-12 THEN round(e / s, 6) + 0.0 ELSE 0.0 END END AS signal FROM (SELECT date, id, e, stddev_pop(e) OVER (PARTITION BY date) AS s FROM r)", "supplier_panel", "supplier_groups", r="SELECT date, id, signal - avg(signal) OVER (PARTITION BY date, sector) AS e FROM supplier_panel JOIN supplier_groups USING (id)"),
    "neutralize_factors": sql(
        "SELECT date, id, CASE WHEN n >= 3 AND s > 0 THEN round(e / s, 6) + 0.0 END AS signal FROM (SELECT date, id, n, e, stddev_pop(e) OVER (PARTITION BY date) AS s FROM r)", "supplier_panel",
        x="SELECT date, p.id, signal, s_acctbal / 1000 AS x FROM supplier_panel p JOIN supplier ON s_suppkey = p.id", b="SELECT date, regr_slope(signal, x) AS b, avg(signal) AS my, avg(x) AS mx, count(*) AS n FROM x GROUP BY 1",
        r="SELECT date, id, n, signal - my - b * (x - mx) AS e FROM x JOIN b USING (date)",
    ),
    "zscore_blend": sql("SELECT date, id, CASE WHEN sum(w) > 0 THEN round(sum(zz * w) / sum(w), 6) + 0.0 END AS signal FROM (SELECT date, id, zz, CASE WHEN zz IS NOT NULL THEN [0.5, 0.3, 0.2][k + 1] END AS w FROM zs) GROUP BY 1, 2", "supplier_panel", stacked=_BLEND, zs=f"SELECT date, id, k, {z('s', 'k, date')} AS zz FROM stacked"),
    "ic_weighted_blend": sql("SELECT date, id, CASE WHEN sum(w) > 0 THEN round(sum(zz * w) / sum(w), 6) + 0.0 END AS signal FROM (SELECT date, id, zz, CASE WHEN zz IS NOT NULL THEN [0.6, 0.3, 0.1][k + 1] END AS w FROM zs) GROUP BY 1, 2", "supplier_panel", stacked=_BLEND, zs=f"SELECT date, id, k, {z('s', 'k, date')} AS zz FROM stacked"),
    "gram_schmidt_2": sql(
        f"SELECT date, id, round(coalesce({z('e')}, 0.0), 5) + 0.0 AS signal FROM (SELECT date, id, b - a * (SELECT sum(a * b) / sum(a * a) FROM c) AS e FROM c)", "supplier_panel",
        c=f"SELECT date, id, coalesce({z('signal')}, 0.0) AS a, coalesce({z('signal2')}, 0.0) AS b FROM supplier_panel",
    ),
    "signal_pair_correlation": sql(f"SELECT CAST(a.k AS BIGINT) AS i, CAST(b.k AS BIGINT) AS j, round({corr('a.r', 'b.r', 10)}, 8) AS corr, count(*) AS n FROM ranked a JOIN ranked b ON a.date = b.date AND a.id = b.id AND a.k < b.k GROUP BY 1, 2", "supplier_panel", stacked=_BLEND, ranked=f"SELECT date, id, k, {avg_rank('s', 'k, date')} AS r FROM stacked"),
    "signal_autocorr": sql(
        "SELECT round(avg(c), 8) AS autocorr, count(c) AS n_pairs FROM days", "supplier_panel", ax="SELECT date, lag(date) OVER (ORDER BY date) AS prev FROM (SELECT DISTINCT date FROM supplier_panel)",
        pr="SELECT a.date, a.id, b.signal AS p, a.signal AS s FROM supplier_panel a JOIN ax USING (date) JOIN supplier_panel b ON b.date = prev AND b.id = a.id", days=f"SELECT date, {corr('a', 'b', 3)} AS c FROM (SELECT date, {avg_rank('p')} AS a, {avg_rank('s')} AS b FROM pr) GROUP BY 1",
    ),
    "rank_stability": sql(
        "SELECT round(avg(k), 8) AS stability, count(k) AS n_pairs FROM (SELECT date, avg((a = b)::INT) AS k FROM bk WHERE a IN (1, 3) GROUP BY 1)", "supplier_panel", ax="SELECT date, lag(date) OVER (ORDER BY date) AS prev FROM (SELECT DISTINCT date FROM supplier_panel)",
        pr="SELECT a.date, a.id, b.signal AS p, a.signal AS s FROM supplier_panel a JOIN ax USING (date) JOIN supplier_panel b ON b.date = prev AND b.id = a.id",
        bk=f"SELECT date, greatest(1, least(3, ceil(a / n * 3))) AS a, greatest(1, least(3, ceil(b / n * 3))) AS b FROM (SELECT date, {avg_rank('p')} AS a, {avg_rank('s')} AS b, count(*) OVER (PARTITION BY date) AS n FROM pr) WHERE n >= 6",
    ),
    "regime_labels": sql("SELECT date, round(vol, 8) AS vol, CAST(regime AS BIGINT) AS regime FROM regimes", "series", vols=_VOLS, regimes=_REGIMES),
    "regime_ic": sql("SELECT CAST(regime AS BIGINT) AS regime, round(avg(ic), 8) AS mean_ic, CAST(sum(n_obs) AS BIGINT) AS n_obs, count(ic) AS n_dates FROM ic JOIN regimes USING (date) WHERE regime >= 0 GROUP BY 1", "nation_panel", "series", pairs=_PAIRS, ic0=_IC, ic=_IC_ALL, vols=_VOLS, regimes=_REGIMES),
    "bh_bonferroni": "SELECT n_nationkey, round(p, 8) AS p_value, p <= 0.05 / k AS bonferroni, rk <= m AS bh, round(m * 0.05 / k, 8) AS bh_threshold FROM (SELECT *, coalesce(max(CASE WHEN p <= rk * 0.05 / k THEN rk END) OVER (), 0) AS m FROM (SELECT n_nationkey, p, count(*) OVER () AS k, row_number() OVER (ORDER BY p) AS rk FROM (SELECT n_nationkey, (n_nationkey * 7 % 25 + 1) / 1000.0::DOUBLE AS p FROM nation)))",
    "asof_prev_view": "SELECT a.event_id, a.ts, a.user_id, b.value AS prev_view FROM (SELECT * FROM events WHERE event_type = 'purchase') a ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2) b ON a.user_id = b.user_id AND a.ts > b.ts",
    "back_adjusted_price": sql("SELECT date, id, round(close, 5) AS close, round(close * coalesce((SELECT exp(sum(ln(factor))) FROM f WHERE f.id = p.id AND f.ex_date > p.date), 1.0), 5) AS adj_close FROM p", "user_day", **_ADJ),
    "adjustment_log": sql("SELECT ex_date, id, CASE WHEN id % 2 = 0 THEN 'cash_dividend' ELSE 'special_dividend' END AS action_type, round(factor, 8) AS factor FROM f", "user_day", **_ADJ),
    "latest_known_order": "SELECT id, knowledge_date, o_orderkey, o_totalprice FROM (SELECT o_custkey AS id, CAST(o_orderdate AS DATE) AS knowledge_date, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey DESC) AS k FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '1998-06-30') WHERE k = 1",
    "universe_overlay": sql("SELECT date, id, coalesce(n > 2 AND inside, false) AS in_universe, coalesce(inside, false) AS listed FROM (SELECT date, id, n, id % 7 <> 0 AND date >= DATE '1996-01-01' AND (id % 3 <> 0 OR date <= DATE '1999-01-01') AS inside FROM supplier_month)", "supplier_month"),
    "resolved_universe": sql("SELECT d.date, count(*) AS cells, count(*) FILTER (WHERE m.n > 2) AS members FROM (SELECT DISTINCT date FROM supplier_month) d CROSS JOIN (SELECT DISTINCT id FROM supplier_month) i LEFT JOIN supplier_month m ON m.date = d.date AND m.id = i.id GROUP BY 1", "supplier_month"),
    "sessions_between": sql("SELECT DISTINCT date FROM supplier_week WHERE month(date) <> 12 AND date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'", "supplier_week"),
    "align_calendar": sql("SELECT * FROM aligned", "supplier_week", aligned=_ALIGNED),
    "fill_forward": sql("SELECT date, id, last_value(value IGNORE NULLS) OVER (PARTITION BY id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM aligned", "supplier_week", aligned=_ALIGNED),
    "fill_backward": sql("SELECT date, id, first_value(value IGNORE NULLS) OVER (PARTITION BY id ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM aligned", "supplier_week", aligned=_ALIGNED),
    "fill_zero": sql("SELECT date, id, coalesce(value, 0.0) AS value FROM aligned", "supplier_week", aligned=_ALIGNED),
    "missing_sessions": sql("SELECT date, id FROM (SELECT DISTINCT date FROM supplier_week) CROSS JOIN (SELECT DISTINCT id FROM supplier_week) EXCEPT SELECT date, id FROM supplier_week", "supplier_week"),
    "masked_panel": sql("SELECT d.date, i.id, coalesce(w.value, 0.0) AS value, w.value IS NOT NULL AS is_observed FROM (SELECT DISTINCT date FROM supplier_week) d CROSS JOIN (SELECT DISTINCT id FROM supplier_week) i LEFT JOIN supplier_week w ON w.date = d.date AND w.id = i.id", "supplier_week"),
    "quality_flags": sql(
        "SELECT date, id, value, false AS is_duplicate_key, coalesce(stddev_samp(value) OVER (PARTITION BY id) = 0, true) AS is_frozen_series, coalesce(value = lag(value) OVER (PARTITION BY id ORDER BY date), false) AS price_stale, coalesce(abs((value - avg(value) OVER (PARTITION BY date)) / (stddev_samp(value) OVER (PARTITION BY date) + 1e-12)) > 3.0, false) AS outlier_flagged, id IN (SELECT id FROM sparse) AS sparse_coverage FROM supplier_week",
        "supplier_week", sparse="SELECT DISTINCT id FROM (SELECT date, id FROM (SELECT DISTINCT date FROM supplier_week WHERE date < DATE '1996-01-01') CROSS JOIN (SELECT DISTINCT id FROM supplier_week) EXCEPT SELECT date, id FROM supplier_week)",
    ),
    "frozen_series": sql("SELECT id, count(*) AS n_obs, arg_min(value, date) AS value_constant FROM (SELECT date, id, CASE WHEN id % 5 = 0 THEN 1.5::DOUBLE ELSE value END AS value FROM user_day) GROUP BY id HAVING count(*) = 1 OR stddev_samp(value) = 0", "user_day"),
    "spike_outliers": sql("SELECT date, id, value, round(zz, 6) AS z_score FROM (SELECT date, id, value, abs((value - avg(value) OVER (PARTITION BY date)) / (stddev_samp(value) OVER (PARTITION BY date) + 1e-12)) AS zz FROM supplier_week) WHERE zz > 3.0", "supplier_week"),
    "returns_panel": sql("SELECT date, id, ret AS \"return\" FROM nation_panel", "nation_panel"),
    "returns_drawdown": sql("SELECT date, round(nav, 2) AS nav, round(drawdown, 8) AS drawdown FROM dd", "nav", dd=_DRAW),
    "drawdown_events": sql(
        "SELECT pd AS peak_date, td AS trough_date, nd AS recovery_date, round(depth, 8) AS depth, tt - pt AS drawdown_days, nt - tt AS recovery_days, nt - pt AS peak_to_recovery_days FROM ev WHERE n > 1", "nav", dd=_DRAW,
        rows_="SELECT *, row_number() OVER (ORDER BY date) AS t, sum((drawdown >= 0)::INT) OVER (ORDER BY date) AS i FROM dd", isles="SELECT i, count(*) AS n, min(t) AS pt, min(date) AS pd, min({'d': drawdown, 't': t, 'x': date}) AS low FROM rows_ GROUP BY i",
        ev="SELECT n, pt, pd, low.d AS depth, low.t AS tt, low.x AS td, lead(pd) OVER (ORDER BY i) AS nd, lead(pt) OVER (ORDER BY i) AS nt FROM isles",
    ),
    "risk_summary": sql(
        "SELECT round(avg(return_1d), 6) AS mean, round(stddev_samp(return_1d), 6) AS std, round(avg(return_1d) / stddev_samp(return_1d) * sqrt(252), 6) AS sharpe, round(avg(return_1d) / sqrt(avg(return_1d * return_1d) FILTER (WHERE return_1d < 0)) * sqrt(252), 6) AS sortino, round(quantile_cont(return_1d, 0.05), 6) AS var_95, round(avg((return_1d - m) * (return_1d - m) * (return_1d - m)) / pow(avg((return_1d - m) * (return_1d - m)), 1.5), 6) AS skewness, round(avg(pow(return_1d - m, 4)) / pow(avg(pow(return_1d - m, 2)), 2) - 3, 6) AS excess_kurtosis, round(avg((return_1d > 0)::INT), 6) AS hit_rate, round(max(return_1d), 6) AS best_day, round(min(return_1d), 6) AS worst_day, round(avg(return_1d) FILTER (WHERE return_1d <= q), 6) AS cvar_95 FROM series, (SELECT avg(return_1d) AS m, quantile_cont(return_1d, 0.05) AS q FROM series)",
        "series",
    ),
    "performance_summary": sql(
        "SELECT sharpe, max_drawdown, annual_return, annual_vol, cagr, sortino, CASE WHEN max_drawdown < 0 THEN round(g / abs(md), 6) ELSE 0.0 END AS calmar FROM (SELECT round((avg(r) - 0.02 / 252) / stddev_samp(r) * sqrt(252), 6) AS sharpe, round(min(drawdown), 6) AS max_drawdown, round(avg(r) * 252, 6) AS annual_return, round(stddev_samp(r) * sqrt(252), 6) AS annual_vol, round(pow(arg_max(nav, date) / arg_min(nav, date), 252.0 / count(*)) - 1, 6) AS cagr, round((avg(r) - 0.02 / 252) / sqrt(avg(pow(r - 0.02 / 252, 2)) FILTER (WHERE r - 0.02 / 252 < 0)) * sqrt(252), 6) AS sortino, pow(arg_max(nav, date) / arg_min(nav, date), 252.0 / count(*)) - 1 AS g, min(drawdown) AS md FROM x)",
        "nav", dd=_DRAW, x="SELECT *, nav / lag(nav) OVER (ORDER BY date) - 1 AS r FROM dd",
    ),
    "benchmark_metrics": sql(
        "SELECT round(be, 6) AS beta, round((mr - 0.001 - be * (mb - 0.001)) * 252, 6) AS alpha, round(c * c / (vr * vb), 6) AS r_squared, round(te, 6) AS tracking_error, round((mr - mb) * 252 / te, 6) AS information_ratio, round(up, 6) AS up_capture, round(down, 6) AS down_capture FROM (SELECT covar_pop(r, b) / var_pop(b) AS be, avg(r) AS mr, avg(b) AS mb, covar_pop(r, b) AS c, var_pop(r) AS vr, var_pop(b) AS vb, stddev_pop(r - b) * sqrt(252) AS te, avg(r) FILTER (WHERE b > 0) / avg(b) FILTER (WHERE b > 0) AS up, avg(r) FILTER (WHERE b < 0) / avg(b) FILTER (WHERE b < 0) AS down FROM both_)",
        "nation_panel", "series", one=_ONE, both_=_BOTH,
    ),
    "relative_drawdown": sql("SELECT date, round(v / max(v) OVER (ORDER BY date) - 1, 7) + 0.0 AS relative_drawdown FROM (SELECT date, exp(sum(ln(1 + (return_1d - return_1d / 3))) OVER (ORDER BY date)) AS v FROM daily)", "daily"),
    "rolling_sharpe_vol_beta": sql(
        "SELECT date, CASE WHEN n = 12 THEN round(coalesce(m / nullif(s, 0) * sqrt(252), 0), 6) END AS rolling_sharpe, CASE WHEN n = 12 THEN round(s * sqrt(252), 6) END AS rolling_vol, CASE WHEN nb = 12 THEN round(coalesce(c / nullif(vb, 0), 0), 6) END AS rolling_beta FROM (SELECT date, count(r) OVER w AS n, count(b) OVER w AS nb, avg(r) OVER w AS m, stddev_pop(r) OVER w AS s, covar_pop(r, b) OVER w AS c, var_pop(b) OVER w AS vb FROM x WINDOW w AS (ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))",
        "nation_panel", "series", one=_ONE, x="SELECT date, r, return_1d AS b FROM one LEFT JOIN series USING (date)",
    ),
    "monthly_returns": sql("SELECT year(date) AS year, month(date) AS month, round(product(1 + return_1d) - 1, 8) AS \"return\" FROM daily GROUP BY 1, 2", "daily"),
    "quarterly_returns": sql("SELECT year(date) AS year, quarter(date) AS quarter, round(product(1 + return_1d) - 1, 8) AS \"return\" FROM daily GROUP BY 1, 2", "daily"),
    "annual_returns": sql("SELECT year(date) AS year, round(product(1 + return_1d) - 1, 8) AS \"return\" FROM daily GROUP BY 1", "daily"),
    "monthly_returns_wide": sql("SELECT year(date) AS year, " + ", ".join(f"round(CASE WHEN count(*) FILTER (WHERE month(date) = {m}) > 0 THEN product(1 + return_1d) FILTER (WHERE month(date) = {m}) - 1 END, 8) AS m{m}" for m in range(1, 13)) + " FROM daily GROUP BY 1", "daily"),
    "turnover": sql("SELECT date, round(sum(abs(quantity)) / 2, 4) AS one_way, round(sum(abs(quantity)), 4) AS two_way FROM trades GROUP BY 1", "supplier_month", trades=_TRADES),
    "exposures": sql("SELECT date, round(sum(abs(w)), 7) AS gross, round(sum(w), 7) + 0.0 AS net, round(1 / sum(w * w), 7) AS effective_n FROM (SELECT date, CASE WHEN id % 3 = 0 THEN -weight ELSE weight END AS w FROM weights) GROUP BY 1", "weights"),
    "top_n_weight": sql("SELECT date, round(sum(weight), 8) AS top_weight FROM (SELECT date, weight, row_number() OVER (PARTITION BY date ORDER BY weight DESC, id) AS k FROM weights) WHERE k <= 5 GROUP BY 1", "weights"),
    "traded_weights": sql("SELECT date, id, round(abs(quantity) / sum(abs(quantity)) OVER (PARTITION BY date), 8) AS weight FROM trades", "supplier_month", trades=_TRADES),
    "held_positions": sql("SELECT date, id, round(sum(quantity) OVER (PARTITION BY id ORDER BY date), 2) AS position FROM trades", "supplier_month", trades=_TRADES),
    "net_nav": sql(
        "SELECT date, nav, round(nav * g / first_value(g) OVER (ORDER BY date), 6) AS net_nav FROM (SELECT date, nav, exp(sum(ln(1 - c)) OVER (ORDER BY date)) AS g FROM v)", "weights",
        v="SELECT date, 1000.0::DOUBLE + month(date) AS nav, sum(weight * CASE WHEN id % 4 <> 0 THEN id % 3 + 1.25 ELSE 0 END / 1e4) AS c FROM weights GROUP BY date",
    ),
    "sector_attribution": sql("SELECT date, sector, round(sum(weight * coalesce(r, 0)), 6) + 0.0 AS contribution FROM weights LEFT JOIN (SELECT date, id, fwd_1 AS r FROM supplier_panel WHERE fwd_1 IS NOT NULL) USING (date, id) LEFT JOIN supplier_groups USING (id) GROUP BY 1, 2", "weights", "supplier_panel", "supplier_groups"),
    "brinson": sql(
        "SELECT sector, round(sum((wp - wb) * (rb - t)), 5) + 0.0 AS allocation, round(sum(wb * (rp - rb)), 5) + 0.0 AS selection, round(sum((wp - wb) * (rp - rb)), 5) + 0.0 AS interaction FROM (SELECT *, sum(wb * rb) OVER (PARTITION BY date) AS t FROM s) GROUP BY 1", "weights", "supplier_panel", "supplier_groups",
        bench=_BENCH, s="SELECT date, coalesce(CAST(sector AS VARCHAR), 'Unknown') AS sector, sum(weight) AS wp, sum(weight * coalesce(fwd_1, 0)) / greatest(sum(weight), 1e-12) AS rp, sum(bw) AS wb, sum(bw * coalesce(fwd_1, 0)) / greatest(sum(bw), 1e-12) AS rb FROM weights JOIN bench USING (date, id) LEFT JOIN supplier_panel USING (date, id) LEFT JOIN (SELECT * FROM supplier_groups WHERE sector <> 4) USING (id) GROUP BY 1, 2",
    ),
    "active_factor_exposures": sql("SELECT CAST(factor_id AS BIGINT) AS factor_id, round(avg(p) - avg(b), 8) + 0.0 AS exposure FROM (SELECT date, factor_id, sum(weight * loading) AS p, sum(bw * loading) AS b FROM weights JOIN bench USING (date, id) JOIN load_ USING (date, id) GROUP BY 1, 2) GROUP BY 1", "weights", bench=_BENCH, load_=_LOAD),
    "softmax_holdings": sql("SELECT date, id, round(e / sum(e) OVER (PARTITION BY date), 8) AS weight FROM (SELECT date, id, exp(value / 1e5 - max(value / 1e5) OVER (PARTITION BY date)) AS e FROM supplier_month)", "supplier_month"),
    "factor_exposure": sql("SELECT date, CAST(factor_id AS BIGINT) AS factor_id, round(sum(weight * loading), 8) + 0.0 AS exposure FROM weights JOIN load_ USING (date, id) GROUP BY 1, 2", "weights", load_=_LOAD),
    "factor_variance": sql("SELECT round(fv, 7) AS factor_variance, round(sv, 7) AS specific_variance, round(fv + sv, 7) AS total_variance, round(fv / (fv + sv), 7) AS factor_fraction FROM (SELECT x0 * f0 + x1 * f1 AS fv, (SELECT sum(weight * weight * d) FROM w) AS sv FROM fx)", **_RISK),
    "risk_breakdown": sql("SELECT round(fv + sv, 7) AS total_variance, round(fv, 7) AS factor_variance, round(sv, 7) AS specific_variance, round(fv / (fv + sv), 7) AS factor_fraction, round(sv / (fv + sv), 7) AS specific_fraction, round(x0 * f0, 7) + 0.0 AS factor_0, round(x1 * f1, 7) + 0.0 AS factor_1 FROM (SELECT *, x0 * f0 + x1 * f1 AS fv, (SELECT sum(weight * weight * d) FROM w) AS sv FROM fx)", **_RISK),
    "factor_covariance": "SELECT a.id AS i, b.id AS j, round(0.04 + 0.01 * (a.x + b.x) + 0.09 * a.x * b.x + CASE WHEN a.id = b.id THEN (a.id % 5 + 1) / 50.0::DOUBLE ELSE 0 END, 8) AS cov FROM (SELECT CAST(n_nationkey AS BIGINT) AS id, n_regionkey / 10.0::DOUBLE AS x FROM nation) a JOIN (SELECT CAST(n_nationkey AS BIGINT) AS id, n_regionkey / 10.0::DOUBLE AS x FROM nation) b ON a.id <= b.id",
    "risk_contributions": sql("SELECT id, round(m, 7) + 0.0 AS marginal, round(weight * m, 7) + 0.0 AS component FROM (SELECT id, weight, f0 + x * f1 + weight * d AS m FROM w, fx)", **_RISK),
    "rolling_portfolio_vol": sql("SELECT date, round(stddev_samp(r), 6) AS vol FROM past GROUP BY 1", "nation_panel", **_STATIC),
    "rolling_var": sql("SELECT date, round(-quantile_cont(r, 0.05), 6) + 0.0 AS \"var\" FROM past GROUP BY 1", "nation_panel", **_STATIC),
    "sample_covariance": sql("SELECT a.id AS i, b.id AS j, round(covar_samp(a.ret, b.ret), 5) + 0.0 AS cov FROM nation_panel a JOIN nation_panel b ON a.date = b.date AND a.id <= b.id GROUP BY 1, 2", "nation_panel"),
    "weighting_schemes": sql("SELECT date, id, round(value / sum(value) OVER d, 8) AS cap, round((1 / quantity) / sum(1 / quantity) OVER d, 8) AS inverse_vol, round(1.0::DOUBLE / count(*) OVER d, 8) AS \"equal\" FROM supplier_month WINDOW d AS (PARTITION BY date)", "supplier_month"),
    "rebalance_costs": sql("SELECT date, round(sum(d) / 2, 7) AS turnover, round(sum(d) * 0.002, 7) AS cost FROM (SELECT date, abs(weight - coalesce(lag(weight) OVER (PARTITION BY id ORDER BY date), 0)) AS d FROM weights) GROUP BY 1", "weights"),
    "backtest_gross": sql("SELECT date, round(port_ret, 6) + 0.0 AS port_ret, round(1000.0 * exp(sum(ln(1 + port_ret)) OVER (ORDER BY date)), 6) AS nav FROM day", "nation_panel", **_GROSS),
    "trade_costs": "SELECT l_orderkey, round(sum(greatest(l_extendedprice * l_linenumber / 1e4, 5.0) + l_extendedprice * 2.3 / 1e4), 8) AS cost, round(sum(l_extendedprice * 10 * sqrt(l_extendedprice / (l_quantity * 1e5)) / 1e4), 8) AS slippage FROM lineitem WHERE l_extendedprice > 0 GROUP BY 1",
    "walk_forward_folds": folds("12", 2, 5, f"fold, {on('0')} AS train_start, {on('a - 3')} AS train_end, {on('a')} AS test_start, {on('b')} AS test_end"),
    "rolling_folds": folds("24", 2, 4, f"fold, {on('a - 26')} AS train_start, {on('a - 3')} AS train_end, {on('a')} AS test_start, {on('b')} AS test_end"),
    "purged_folds": folds("0", 0, 5, f"fold, (SELECT min(date) FROM axis WHERE {on('a')} - date > 45) AS train_start, (SELECT max(date) FROM axis WHERE {on('a')} - date > 45) AS train_end, {on('a')} AS test_start, {on('b')} AS test_end"),
    "fold_sizes": folds("12", 2, 5, "fold, 'train' AS role, (SELECT count(*) FROM nation_panel JOIN axis USING (date) WHERE t <= a - 3) AS n FROM part UNION ALL SELECT fold, 'test', (SELECT count(*) FROM nation_panel JOIN axis USING (date) WHERE t BETWEEN a AND b)"),
    "wf_ridge_moments": sql(
        "SELECT date, count(*) AS n, round(sum(weight), 4) AS w, round(sum(y), 4) + 0.0 AS wy, round(sum(y * y), 4) AS wyy, round(sum(y), 4) + 0.0 AS y, round(sum(y * y), 4) AS yy, round(sum(x1), 4) AS wx_0, round(sum(x1 * y), 4) + 0.0 AS wxy_0, round(sum(x1), 4) AS x_0, round(sum(x1 * x1), 4) AS xx_0, round(sum(x1 * x1), 4) AS wxx_0_0, round(sum(x1 * x2), 4) AS wxx_0_1, round(sum(x2), 4) AS wx_1, round(sum(x2 * y), 4) + 0.0 AS wxy_1, round(sum(x2), 4) AS x_1, round(sum(x2 * x2), 4) AS xx_1, round(sum(x2 * x2), 4) AS wxx_1_1 FROM m GROUP BY date",
        "supplier_panel", m=_MODEL,
    ),
    "leakage_audit": folds("12", 2, 5, f"(SELECT max(abs(fwd - nxt) / (abs(nxt) + 1e-8)) FROM (SELECT fwd, lead(ret) OVER (PARTITION BY id ORDER BY date) AS nxt FROM nation_panel) WHERE fwd IS NOT NULL AND nxt IS NOT NULL) AS max_error, (SELECT count(fwd) FROM nation_panel) AS n, min({on('a')} - {on('a - 3')}) AS min_gap"),
    "held_out_scores": sql(
        f"SELECT date, round(CASE WHEN var_pop(y) > 0 THEN 1 - sum(pow(y - x1 / 10, 2)) / (var_pop(y) * count(*)) ELSE 0.0 END, 6) AS r2, round(coalesce({corr('a', 'b', 3)}, 0.0), 6) AS ic FROM (SELECT date, y, x1, {avg_rank('y')} AS a, {avg_rank('x1')} AS b FROM m) GROUP BY date", "supplier_panel", m=_MODEL,
    ),
    "rolling_max_drawdown": sql(
        "SELECT e.date, CASE WHEN e.t >= 21 THEN round(least(min(exp(x.l - x.m) - 1), 0.0), 11) + 0.0 END AS rolling_max_drawdown FROM p e LEFT JOIN x ON x.e = e.t GROUP BY e.date, e.t", "daily",
        p="SELECT date, row_number() OVER (ORDER BY date) AS t, sum(ln(1 + return_1d)) OVER (ORDER BY date) AS l FROM daily",
        x="SELECT e.t AS e, b.t AS t, b.l AS l, max(a.l) AS m FROM p e JOIN p b ON b.t BETWEEN e.t - 20 AND e.t JOIN p a ON a.t BETWEEN e.t - 20 AND b.t GROUP BY 1, 2, 3",
    ),
    "incremental_ic": sql(
        "SELECT CAST(n_signals AS INT) AS n_signals, round(m, 8) AS mean_ic, round(m - coalesce(lag(m) OVER (ORDER BY n_signals), 0.0), 8) AS increment FROM (SELECT n_signals, avg(ic) AS m FROM c GROUP BY 1)", "supplier_panel", stacked=_BLEND,
        zs=f"SELECT date, id, k, {z('s', 'k, date')} AS zz FROM stacked",
        b="SELECT i AS n_signals, date, id, avg(zz) AS s FROM zs, range(1, 4) r(i) WHERE k < i AND zz IS NOT NULL GROUP BY 1, 2, 3",
        p="SELECT n_signals, date, id, s, fwd_1 AS r FROM b JOIN supplier_panel USING (date, id) WHERE fwd_1 IS NOT NULL",
        c=f"SELECT n_signals, date, {corr('a', 'q', 5)} AS ic FROM (SELECT n_signals, date, {avg_rank('s', 'n_signals, date')} AS a, {avg_rank('r', 'n_signals, date')} AS q FROM p) GROUP BY 1, 2",
    ),
    "parametric_risk": "SELECT c AS confidence, CAST(h AS INT) AS horizon, round(-(h * 0.0002::DOUBLE + q * sqrt(h * 0.0004::DOUBLE)), 8) AS \"var\", round(-h * 0.0002::DOUBLE + sqrt(h * 0.0004::DOUBLE) * exp(-q * q / 2) / sqrt(2 * pi()) / (1 - c), 8) AS cvar FROM (VALUES (0.95::DOUBLE, -1.6448536269514729::DOUBLE), (0.99::DOUBLE, -2.3263478740408408::DOUBLE)) v(c, q), (VALUES (1), (5), (21)) u(h)",
    "gross_capped": sql(f"SELECT date, id, round(w * CASE WHEN sum(abs(w)) OVER d > 0.5 THEN 0.5 / sum(abs(w)) OVER d ELSE 1 END, 8) + 0.0 AS weight FROM ({_SIGNED}) WINDOW d AS (PARTITION BY date)", "weights"),
    "net_capped": sql(f"SELECT date, id, round(CASE WHEN sum(w) OVER d > 0.2 AND w > 0 THEN w * (1 - (sum(w) OVER d - 0.2) / sum(greatest(w, 0)) OVER d) WHEN sum(w) OVER d < -0.2 AND w < 0 THEN w * (1 - (-0.2 - sum(w) OVER d) / sum(greatest(-w, 0)) OVER d) ELSE w END, 8) + 0.0 AS weight FROM ({_SIGNED}) WINDOW d AS (PARTITION BY date)", "weights"),
    "masked_weights": sql("SELECT date, id, CASE WHEN n > 2 THEN round(weight, 8) ELSE 0.0 END + 0.0 AS weight FROM weights JOIN supplier_month USING (date, id)", "weights", "supplier_month"),
    "bounded_weights": sql(f"SELECT date, id, round(greatest(-0.001::DOUBLE, least(CASE WHEN id % 5 > 0 THEN (id % 5) / 100.0::DOUBLE ELSE 0.05 END, w)), 8) + 0.0 AS weight FROM ({_SIGNED})", "weights"),
    "no_trade_band": sql("SELECT date, id, round(CASE WHEN abs(weight - old) <= 0.003 THEN old ELSE weight END, 8) AS weight FROM (SELECT *, coalesce(lag(weight) OVER (PARTITION BY id ORDER BY date), 0.0) AS old FROM weights)", "weights"),
    "holding_costs": sql(f"SELECT date, round(sum(greatest(-w, 0.0) * 1e6 * (id % 7) * 10 / 1e4 / 252), 5) + 0.0 AS borrow_cost, round(1e6 * (1 - sum(w)) * 0.03 / 252, 5) + 0.0 AS cash_interest FROM ({_SIGNED}) GROUP BY 1", "weights"),
    "active_returns": sql("SELECT date, round(return_1d - return_1d / 3, 8) + 0.0 AS active_return FROM daily", "daily"),
    "information_ratio": sql("SELECT round(avg(a) / stddev_samp(a) * sqrt(252), 8) AS information_ratio FROM (SELECT return_1d - return_1d / 3 AS a FROM daily)", "daily"),
    "annualized_calendar": sql("SELECT round(pow((SELECT product(1 + return_1d) FROM series), 252.0 / count(*)) - 1, 7) AS annualized_return FROM (SELECT DISTINCT date FROM daily WHERE month(date) <> 12 AND date BETWEEN (SELECT min(date) FROM series) AND (SELECT max(date) FROM series))", "daily", "series"),
    "tracking_error": sql("SELECT round(sqrt(sum(CASE WHEN i = j THEN 1 ELSE 2 END * ((i + 1) / 325.0::DOUBLE - 0.04) * ((j + 1) / 325.0::DOUBLE - 0.04) * c)), 6) AS tracking_error FROM (SELECT a.id AS i, b.id AS j, covar_samp(a.ret, b.ret) AS c FROM nation_panel a JOIN nation_panel b ON a.date = b.date AND a.id <= b.id GROUP BY 1, 2)", "nation_panel"),
    "generated_datasets": "SELECT name AS dataset, CAST(n AS BIGINT) AS n_columns, true AS has_rows, CAST(0 AS BIGINT) AS repeated_keys, CAST(0 AS BIGINT) AS nulls FROM (VALUES " + ", ".join(f"('{n}', {k})" for n, k in _DATASETS) + ") v(name, n)",
    "scaling_fit": "SELECT stage, 'elapsed_s' AS metric, 'n_assets' AS scaling_dim, round(regr_slope(y, x), 8) AS log_log_slope, round(regr_intercept(y, x), 8) AS intercept, round(regr_r2(y, x), 8) AS r_squared, CAST(count(*) AS BIGINT) AS n_points FROM (SELECT stage, ln(n_assets) AS x, ln(median(elapsed_s)) AS y FROM (SELECT 'stage' || (i % 2) AS stage, 100 * (1 + (i // 2) % 5) AS n_assets, pow(1.0 + (i // 2) % 5, 1.5) * (1 + i / 1000.0) AS elapsed_s FROM range(60) r(i)) GROUP BY stage, n_assets) GROUP BY 1",
    "regression_check": "SELECT * FROM (VALUES ('etl', 'elapsed_s', 1.0::DOUBLE, 1.5::DOUBLE, 0.5::DOUBLE, 0.5::DOUBLE), ('signals', 'result_mb', 10.0::DOUBLE, 30.0::DOUBLE, 2.0::DOUBLE, 20.0::DOUBLE)) v(stage, metric, baseline_value, current_value, pct_increase, abs_increase)",
    "events_tumbling": "SELECT CAST(ts AS DATE) AS window_start, event_type, count(*) AS n, round(CAST(sum(CAST(value AS DECIMAL(28,6))) AS DOUBLE), 4) AS total FROM events GROUP BY 1, 2",
    "events_sessions": "SELECT user_id, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS events, max(n) AS longest FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY 1, 2) GROUP BY 1",
}
ORACLE["events_stream_tumbling"] = ORACLE["events_tumbling"]
