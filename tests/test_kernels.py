"""Numeric kernels against plain definitions."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.functions import linalg, stats
from quantloom.functions.qp import Constraints, Factored, solve
from quantloom.operators import backtest as bt
from quantloom.operators import cleaning as cl
from quantloom.operators import models as mo
from quantloom.operators import signals as sg

RNG = np.random.default_rng(0)


def test_kendall_counts_pairs():
    for _ in range(20):
        x, y = RNG.integers(0, 5, 30).astype(float), RNG.integers(0, 6, 30).astype(float)
        c = tx = ty = 0
        for i, j in itertools.combinations(range(30), 2):
            a, b = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
            c, tx, ty = c + a * b, tx + (a != 0), ty + (b != 0)
        assert linalg.kendall_tau_b(x, y) == pytest.approx(c / np.sqrt(tx * ty))
    assert np.isnan(linalg.kendall_tau_b(np.ones(5), np.arange(5.0)))
    for n in (0, 1, 2, 33, 257):
        r = RNG.integers(0, 40, n)
        assert linalg.inversions(r) == sum(a > b for a, b in itertools.combinations(r.tolist(), 2))


def test_p_value_column_matches(spark):
    df = spark.createDataFrame([(float(x),) for x in np.linspace(-6, 6, 50)], "t double")
    for r in df.select("t", stats.p_value_column("t").alias("p")).collect():
        assert r.p == pytest.approx(stats.p_value(r.t), rel=1e-6)


def test_compound_keeps_signs(spark):
    df = spark.createDataFrame([(i, r) for i, r in enumerate([0.1, -1.5, 0.2, -2.0, -1.0, 0.3])], "date int, r double")
    got = [r.g for r in df.withColumn("g", stats.compound("r", stats.running())).orderBy("date").collect()]
    assert got == pytest.approx(np.cumprod([1.1, -0.5, 1.2, -1.0, 0.0, 1.3]))


def _problem(n=12):
    x = RNG.normal(size=(60, n))
    return RNG.normal(size=n) * 0.5, np.cov(x, rowvar=False)


def test_qp_meets_optimality():
    alpha, cov = _problem()
    spec = Constraints(12, long_only=True, max_weight=0.4, net_exposure=1.0)
    s = solve(alpha, cov, spec, 2.0)
    assert s.converged and s.weights.sum() == pytest.approx(1, abs=1e-6) and s.weights.min() >= -1e-9 and s.weights.max() <= 0.4 + 1e-9
    grad = alpha - 4.0 * cov @ s.weights
    inside = (s.weights > 1e-5) & (s.weights < 0.4 - 1e-5)
    level = grad[inside].mean()
    assert np.ptp(grad[inside]) < 1e-4 and (grad[s.weights <= 1e-5] <= level + 1e-4).all() and (grad[s.weights >= 0.4 - 1e-5] >= level - 1e-4).all()


def test_qp_gross_sectors_and_costs():
    alpha, cov = _problem()
    groups = np.arange(12) % 3
    spec = Constraints(12, long_only=False, min_weight=-0.5, max_weight=0.5, net_exposure=0.0, max_gross=1.5, sector_ids=groups, sector_limits={0: (-0.1, 0.1)})
    s = solve(alpha, cov, spec, 1.0)
    assert np.abs(s.weights).sum() <= 1.5 + 1e-5 and abs(s.weights.sum()) < 1e-6 and abs(s.weights[groups == 0].sum()) <= 0.1 + 1e-5
    still = solve(alpha, cov, Constraints(12, net_exposure=1.0), 1.0, np.full(12, 1 / 12), 100.0)
    assert still.weights == pytest.approx(np.full(12, 1 / 12), abs=1e-5)


def test_factored_equals_dense():
    b, f, d = RNG.normal(size=(10, 3)), np.diag([0.5, 0.2, 0.1]), RNG.uniform(0.1, 0.5, 10)
    spec = Constraints(10, max_weight=0.3)
    alpha = RNG.normal(size=10) * 0.2
    one, two = solve(alpha, Factored(b, f, d), spec), solve(alpha, b @ f @ b.T + np.diag(d), spec)
    assert one.weights == pytest.approx(two.weights, abs=1e-6)


def test_ledoit_wolf_shrinks_between():
    x = RNG.normal(size=(30, 20))
    cov, shrink = linalg.ledoit_wolf(x)
    assert 0 <= shrink <= 1 and np.trace(cov) == pytest.approx(np.trace(np.cov(x, rowvar=False, ddof=0))) and np.linalg.eigvalsh(cov).min() > 0


def _panel(spark, n_dates=40, n_ids=12):
    rows = [(pd.Timestamp("2020-01-06") + pd.offsets.BDay(t), i) for t in range(n_dates) for i in range(n_ids)]
    x = RNG.normal(size=(len(rows), 2))
    y = 0.3 * x[:, 0] - 0.2 * x[:, 1] + 0.1 * RNG.normal(size=len(rows))
    w = RNG.uniform(0.5, 1.5, len(rows))
    p = pd.DataFrame({"date": [r[0].date() for r in rows], "id": [r[1] for r in rows], "x1": x[:, 0], "x2": x[:, 1], "y": y, "weight": w})
    return p, spark.createDataFrame(p)


def test_walk_forward_matches_direct_ridge(spark):
    p, df = _panel(spark)
    splitter = mo.WalkForwardSplitter(3, 2, 10)
    got = mo.walk_forward_ridge(df, splitter, mo.WalkForwardConfig((2.0,)))
    dates = sorted(p["date"].unique())
    have = got.predictions.toPandas().set_index(["date", "id"])["prediction"]
    assert len(got.folds) == 3 and got.mean_r2 > 0.8
    for _, a, b, c, d in splitter.split(dates):
        tr, te = p[(p["date"] >= a) & (p["date"] <= b)], p[(p["date"] >= c) & (p["date"] <= d)]
        m, s = tr[["x1", "x2"]].mean().to_numpy(), tr[["x1", "x2"]].std(ddof=0).to_numpy()
        z, w = (tr[["x1", "x2"]].to_numpy() - m) / s, tr["weight"].to_numpy()
        zc, yc = z - np.average(z, axis=0, weights=w), tr["y"] - np.average(tr["y"], weights=w)
        beta = np.linalg.solve((zc * w[:, None]).T @ zc + 2.0 * np.eye(2), (zc * w[:, None]).T @ yc)
        want = ((te[["x1", "x2"]].to_numpy() - m) / s - np.average(z, axis=0, weights=w)) @ beta + np.average(tr["y"], weights=w)
        assert have.loc[list(zip(te["date"], te["id"], strict=True))].to_numpy() == pytest.approx(want)


def test_penalty_by_the_last_rows(spark):
    """The cut falls within a date (0.17 of 120, 180, ... rows by 12 a date) or on its edge (0.2, 0.5)."""
    p, df = _panel(spark)
    p = p.sort_values(["date", "id"])
    for share in (0.17, 0.2, 0.5, 0.0):
        splitter, alphas = mo.WalkForwardSplitter(3, 2, 10), (0.01, 5.0, 500.0)
        got = mo.walk_forward_ridge(df, splitter, mo.WalkForwardConfig(alphas, inner_share=share)).folds["alpha"].tolist()
        want = []
        for _, a, b, _, _ in splitter.split(sorted(p["date"].unique())):
            tr = p[(p["date"] >= a) & (p["date"] <= b)]
            x, y, w, k = tr[["x1", "x2"]].to_numpy(), tr["y"].to_numpy(), tr["weight"].to_numpy(), int(len(tr) * (1 - share))
            z = (x - x.mean(axis=0)) / x.std(axis=0)

            def r2(alpha):
                zm, ym = np.average(z[:k], axis=0, weights=w[:k]), np.average(y[:k], weights=w[:k])
                zc = z[:k] - zm
                beta = np.linalg.solve((zc * w[:k, None]).T @ zc + alpha * np.eye(2), (zc * w[:k, None]).T @ (y[:k] - ym))
                e = y[k:] - ym - (z[k:] - zm) @ beta
                return 1 - (w[k:] * e**2).sum() / (w[k:] * (y[k:] - np.average(y[k:], weights=w[k:])) ** 2).sum()

            want.append(max(alphas, key=r2) if k < len(tr) else alphas[0])
        assert got == want


def test_other_learners_and_comparison(spark):
    _, df = _panel(spark, 30, 8)
    s = mo.WalkForwardSplitter(2, 1, 10)
    table = mo.compare_models(df, s, {"ridge": mo.ridge(["x1", "x2"]), "net": mo.elastic_net(["x1", "x2"]), "trees": mo.gradient_boost(["x1", "x2"], iterations=5, leaf=5)})
    assert set(table["model"]) == {"ridge", "net", "trees"} and (table["mean_ic"] > 0.5).all()


def test_folds_of_rows(spark):
    """Seven folds of 240 rows: sizes 35, 35, 34, ...; each against a direct ridge on the other rows."""
    p, df = _panel(spark, 30, 8)
    p = p.sort_values(["date", "id"])
    x, y, w = p[["x1", "x2"]].to_numpy(), p["y"].to_numpy(), p["weight"].to_numpy()
    want = []
    for test in np.array_split(np.arange(240), 7):
        train = np.setdiff1d(np.arange(240), test)
        xm, ym = np.average(x[train], axis=0, weights=w[train]), np.average(y[train], weights=w[train])
        z, v = x[train] - xm, w[train]
        beta = np.linalg.solve((z * v[:, None]).T @ z + np.eye(2), (z * v[:, None]).T @ (y[train] - ym))
        e, d = y[test] - ym - (x[test] - xm) @ beta, y[test] - np.average(y[test], weights=w[test])
        want.append(1 - (w[test] * e**2).sum() / (w[test] * d**2).sum())
    assert mo.cv_loop(df, ["x1", "x2"], 7)["r2"].tolist() == pytest.approx(want)
    with pytest.raises(ValueError):
        mo.cv_loop(df, ["x1", "x2"], 241)


def test_artifact_round_trip(spark, tmp_path):
    _, df = _panel(spark, 25, 6)
    wf = mo.walk_forward_ridge(df, mo.WalkForwardSplitter(2, 1, 10))
    a = mo.artifact_from_fold(wf.folds.iloc[-1], ["x1", "x2"])
    mo.save_artifact(spark, a, str(tmp_path / "m"))
    assert mo.load_artifact(spark, str(tmp_path / "m")) == a
    bad = mo.predict_from_artifact(a, df.withColumn("x1", F.when(F.col("id") == 0, float("nan")).otherwise(F.col("x1"))))
    assert bad.where("id = 0 and prediction is not null").count() == 0 and bad.where("is_valid").count() == 25 * 5


def _market(spark, n_dates=45, n_ids=6):
    dates = [(pd.Timestamp("2021-01-04") + pd.offsets.BDay(t)).date() for t in range(n_dates)]
    r = RNG.normal(0, 1.5, (n_dates, n_ids))
    s = RNG.normal(size=(n_dates, n_ids))
    long = pd.DataFrame([(d, i, r[t, i], s[t, i]) for t, d in enumerate(dates) for i in range(n_ids)], columns=["date", "id", "return", "signal"])
    return dates, r / 100, s, spark.createDataFrame(long)


def test_weight_space_equals_bar_by_bar(spark):
    _, _, _, df = _market(spark)
    cfg = bt.BacktestConfig(rebalance_every=7, max_weight=0.3, transaction_costs=True, slippage=True)
    costs = df.select("date", "id", F.lit(1.5).alias("commission_bps"), F.lit(2.0).alias("half_spread_bps"), F.lit(0.3).alias("exchange_fee_bps"), F.when(F.col("id") % 2 == 0, 30.0).otherwise(0.0).alias("min_commission"), F.lit(8.0).alias("impact_coef"))
    adv = df.select("date", "id", F.when(F.col("id") == 0, 0.0).otherwise(1e6).alias("adv_20"))
    fast = bt.weight_space_backtest(df, df, cfg, costs, adv)
    panel = df.join(costs, ["date", "id"]).join(adv, ["date", "id"])
    slow = bt.bar_backtest(panel, cfg)
    a = fast.nav_history.orderBy("date").toPandas()["nav"].to_numpy()
    b = slow.where("kind = 'nav'").orderBy("date").toPandas()["nav"].to_numpy()
    assert a == pytest.approx(b, rel=1e-9)
    x = fast.trade_log.orderBy("date", "id").toPandas()["quantity"].to_numpy()
    y = slow.where("kind = 'trades'").orderBy("date", "id").toPandas()["quantity"].to_numpy()
    assert x == pytest.approx(y, rel=1e-8, abs=1e-6)


def test_share_space_books_balance(spark):
    _, _, _, df = _market(spark)
    panel = df.withColumns({"close": F.lit(50.0), "adv_20": F.lit(1e7), "impact_coef": F.lit(5.0), "half_spread_bps": F.lit(2.0)})
    actions = spark.createDataFrame([(pd.Timestamp("2021-01-20").date(), 1, "split", 2.0, None), (pd.Timestamp("2021-01-25").date(), 2, "cash_dividend", None, 0.5)], "ex_date date, id long, action_type string, split_ratio double, cash_amount double")
    cfg = bt.BacktestConfig(rebalance_every=10, share_space=True, execution_lag=1, transaction_costs=True, slippage=True, corporate_actions=True, cash_interest_rate=0.01)
    log = bt.bar_backtest(panel, cfg, actions).toPandas()
    nav = log[log["kind"] == "nav"]["nav"]
    assert (nav > 0).all() and len(nav) == 45 and len(log[log["kind"] == "fills"]) > 0
    two = bt.bar_backtest(panel.withColumn("strategy", F.explode(F.array(F.lit("a"), F.lit("b")))), cfg, actions)
    assert two.where("kind = 'nav'").groupBy("date").agg(F.countDistinct(F.round("nav", 6)).alias("n")).where("n > 1").count() == 0


def test_newey_west(spark):
    e = RNG.normal(0.1, 1, 60)
    ic = spark.createDataFrame([(i, float(x)) for i, x in enumerate(e)], "date int, ic double")
    r = sg.newey_west(ic, 4).first()
    d = e - e.mean()
    v = (d @ d + 2 * sum((1 - k / 5) * (d[k:] @ d[:-k]) for k in range(1, 5))) / 60
    assert r.t_stat == pytest.approx(e.mean() / np.sqrt(v / 60))
    flat = sg.newey_west(ic.withColumn("ic", F.lit(0.5)), 2).first()
    assert flat.t_stat == 0.0


def test_splitters_by_hand():
    """Worked by hand on 20 dates: equal steps, the purged splitter's last fold with what is left."""
    days = [pd.Timestamp("2021-01-01").date() + pd.Timedelta(days=t) for t in range(20)]
    at = lambda folds: [(days.index(c), days.index(d)) for _, _, _, c, d in folds]
    ends = lambda folds: [(days.index(a), days.index(b)) for _, a, b, _, _ in folds]
    assert at(mo.PurgedSplitter(3, 0).split(days)) == [(0, 5), (6, 11), (12, 19)]
    walk = mo.WalkForwardSplitter(3, 2, 5).split(days)
    assert at(walk) == [(7, 11), (12, 16), (17, 19)] and ends(walk) == [(0, 4), (0, 9), (0, 14)]
    roll = mo.RollingSplitter(3, 1, 8).split(days)
    assert at(roll) == [(9, 12), (13, 16), (17, 19)] and ends(roll) == [(0, 7), (4, 11), (8, 15)]
    assert mo.PurgedSplitter(2, 3).split(days)[1][2] == days[6]
    for bad in (mo.PurgedSplitter(1, 0), mo.PurgedSplitter(21, 0), mo.WalkForwardSplitter(3, 0, 18), mo.RollingSplitter(6, 0, 15), mo.WalkForwardSplitter(1, 0, 5)):
        with pytest.raises(ValueError):
            bad.split(days)


def test_dividends_and_odd_actions(spark):
    prices = spark.createDataFrame([(pd.Timestamp(f"2021-01-0{d}").date(), i, 100.0) for d in (4, 5, 6) for i in (1, 2, 3)], "date date, id long, close double")
    day = pd.Timestamp("2021-01-06").date()
    actions = [(day, 1, "cash_dividend", None, 25.0), (day, 2, "special_dividend", None, 25.0), (day, 3, "cash_dividend", None, -5.0), (day, 3, "special_dividend", None, None), (day, 3, "split", 0.0, None), (day, 9, "split", 2.0, None)]
    out, log = cl.adjust_prices(prices, spark.createDataFrame(actions, "ex_date date, id long, action_type string, split_ratio double, cash_amount double"))
    got = {(r.date.day, r.id): round(r.adj_close, 9) for r in out.collect()}
    assert all(got[d, i] == (80.0 if d < 6 and i < 3 else 100.0) for d in (4, 5, 6) for i in (1, 2, 3)) and log.count() == 2


def test_bars_by_hand(spark):
    """Two ids, two bars: financing looks to the next date, the log has every id by the value after costs, and a bar of
    shares is valued by its own close or by the one that its return leads to."""
    days = [pd.Timestamp("2021-01-04"), pd.Timestamp("2021-01-06")]
    panel = pd.DataFrame([(d, i, 10.0, 0.0, 50.0) for d in days for i in (0, 1)], columns=["date", "id", "return", "signal", "close"])
    run = lambda **kw: dict(bt.simulate(panel.assign(**kw.pop("side", {})), bt.BacktestConfig(initial_cash=1000.0, **kw)))
    out = run(rebalance_every=2, transaction_costs=True, side={"commission_bps": 100.0})
    assert out["trades"]["quantity"].tolist() == pytest.approx([0.5 * 990, 0.5 * 990]) and out["nav"]["nav"].tolist() == pytest.approx([990 * 1.1, 990 * 1.1**2])
    out = run(rebalance_every=2, financing=True, funding_rate_annual=0.1, max_gross=2.0, min_weight=1.0)
    first = 1000 * 1.2 - (2.0 * 1.1 / 2.2 - 1.0) * 1200 * 0.1 * 2 / 365
    assert out["nav"]["nav"].iloc[0] == pytest.approx(first)
    assert run(share_space=True)["nav"]["nav"].tolist() == pytest.approx([1000.0, 1100.0])
    assert run(share_space=True, mark_at_close=False)["nav"]["nav"].tolist() == pytest.approx([1100.0, 1210.0])
    assert run(max_weight=0.4, side={"max_weight": [0.1, np.nan, 0.1, np.nan]})["trades"]["quantity"].tolist() == pytest.approx([100.0, 400.0])
