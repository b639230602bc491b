"""Leakage-safe modelling: panels, splitters, walk-forward ridge from moments, other learners, audits."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.linalg import ridge_from_moments
from ..functions.stats import average_rank, correlation, finite, p_value

KEY = ["date", "id"]


# --- panel -----------------------------------------------------------------------------------------

def feature_names(features: DataFrame) -> list[str]:
    return [c for c in features.columns if c not in KEY]


def build_panel(features: DataFrame, target: DataFrame, target_col: str, weights: DataFrame | None = None, feature_cols: list[str] | None = None) -> DataFrame:
    """(date, id, features, y, weight): complete rows only; a missing weight is 1."""
    cols = feature_cols or feature_names(features)
    out = features.select(*KEY, *cols).join(target.select(*KEY, F.col(target_col).alias("y")), KEY)
    out = out.join(weights.select(*KEY, "weight"), KEY, "left") if weights is not None else out.withColumn("weight", F.lit(1.0))
    return out.where(finite(*cols, "y")).withColumn("weight", F.coalesce("weight", F.lit(1.0)))


def date_ordinal(c: Column | str = "date") -> Column:
    """Proleptic ordinal of a date."""
    return F.datediff(c, F.lit("0001-01-01").cast("date")) + 1


def date_axis(panel: DataFrame) -> DataFrame:
    """(date, pos): position of each date; a short axis."""
    return panel.select("date").distinct().withColumn("pos", F.row_number().over(Window.orderBy("date")) - 1)


# --- splitters: (fold, train_start, train_end, test_start, test_end), all inclusive ------------------

def _enough(n: int, reserved: int, k: int) -> int:
    """Dates of each of ``k`` test ranges behind ``reserved`` ones."""
    if k < 2:
        raise ValueError("n_splits must be 2 or more")
    if n - reserved < k:
        raise ValueError(f"{n} dates are too few for {reserved} training dates and {k} test ranges")
    return (n - reserved) // k


@dataclass(frozen=True)
class PurgedSplitter:
    """Contiguous test folds of equal size, the last one with what is left; training rows lie more than ``embargo``
    calendar days before the test."""

    n_splits: int = 5
    embargo: int = 5

    def split(self, dates: list) -> list[tuple]:
        size, out = _enough(len(dates), 0, self.n_splits), []
        for f in range(self.n_splits):
            first, last = dates[f * size], dates[-1] if f == self.n_splits - 1 else dates[(f + 1) * size - 1]
            train = [d for d in dates if (first - d).days > self.embargo]
            out.append((f, train[0] if train else None, train[-1] if train else None, first, last))
        return out


def _after(dates: list, reserved: int, k: int, embargo: int) -> list[tuple[int, int, int]]:
    """(fold, first, last) of test ranges of equal steps that begin ``embargo`` dates late and end with the axis."""
    step = _enough(len(dates), reserved, k)
    starts = ((f, reserved + f * step + embargo) for f in range(k))
    return [(f, a, min(a + step, len(dates)) - 1) for f, a in starts if a < len(dates)]


@dataclass(frozen=True)
class WalkForwardSplitter:
    """Expanding training window; the embargo counts dates of the axis."""

    n_splits: int = 5
    embargo: int = 5
    min_train: int = 1

    def split(self, dates: list) -> list[tuple]:
        return [(f, dates[0], dates[a - self.embargo - 1], dates[a], dates[b]) for f, a, b in _after(dates, self.min_train, self.n_splits, self.embargo)]


@dataclass(frozen=True)
class RollingSplitter:
    """Training window of fixed length."""

    n_splits: int = 5
    embargo: int = 5
    train: int = 60

    def split(self, dates: list) -> list[tuple]:
        return [(f, dates[a - self.embargo - self.train], dates[a - self.embargo - 1], dates[a], dates[b]) for f, a, b in _after(dates, self.train, self.n_splits, self.embargo)]


FOLDS = "fold int, train_start date, train_end date, test_start date, test_end date"


def fold_table(panel: DataFrame, splitter) -> DataFrame:
    """Intervals of a splitter; only the date axis is read."""
    dates = [r[0] for r in panel.select("date").distinct().orderBy("date").collect()]
    return panel.sparkSession.createDataFrame(splitter.split(dates), FOLDS)


def splits_from_calendar(calendar: DataFrame) -> DataFrame:
    return calendar.select(F.col("fold").cast("int").alias("fold"), "train_start", "train_end", "test_start", "test_end")


def fold_rows(panel: DataFrame, folds: DataFrame) -> DataFrame:
    """Panel rows with fold and role (train or test): a range join with a handful of intervals."""
    parts = [panel.join(F.broadcast(folds.select("fold", F.col(f"{r}_start").alias("_a"), F.col(f"{r}_end").alias("_b"))), F.col("date").between(F.col("_a"), F.col("_b"))).withColumn("role", F.lit(r)).drop("_a", "_b") for r in ("train", "test")]
    return parts[0].unionByName(parts[1])


# --- moments ---------------------------------------------------------------------------------------

def date_moments(panel: DataFrame, cols: list[str], *by: str) -> DataFrame:
    """(date, n, w, wy, wyy, wx_i, wxy_i, wxx_i_j, x_i, xx_i): all that a ridge needs, one row for each date, or by
    other columns."""
    w, y = F.col("weight"), F.col("y")
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(w).alias("w"), F.sum(w * y).alias("wy"), F.sum(w * y * y).alias("wyy"), F.sum(y).alias("y"), F.sum(y * y).alias("yy")]
    for i, a in enumerate(cols):
        x = F.col(a)
        aggs += [F.sum(w * x).alias(f"wx_{i}"), F.sum(w * x * y).alias(f"wxy_{i}"), F.sum(x).alias(f"x_{i}"), F.sum(x * x).alias(f"xx_{i}")]
        aggs += [F.sum(w * x * F.col(cols[j])).alias(f"wxx_{i}_{j}") for j in range(i, len(cols))]
    return panel.groupBy(*(by or ("date",))).agg(*aggs)


@dataclass
class Moments:
    """Sums over some rows, and what follows from them."""

    n: float
    w: float
    wy: float
    wyy: float
    wx: np.ndarray
    wxy: np.ndarray
    wxx: np.ndarray
    x: np.ndarray
    xx: np.ndarray

    @classmethod
    def of(cls, rows: pd.DataFrame, p: int) -> Moments:
        s = rows.sum(numeric_only=True)
        wxx = np.zeros((p, p))
        for i in range(p):
            for j in range(i, p):
                wxx[i, j] = wxx[j, i] = s.get(f"wxx_{i}_{j}", 0.0)
        vec = lambda name: np.array([s.get(f"{name}_{i}", 0.0) for i in range(p)])
        return cls(s["n"], s["w"], s["wy"], s["wyy"], vec("wx"), vec("wxy"), wxx, vec("x"), vec("xx"))

    def scaling(self, on: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Unweighted mean and population deviation; 1 where there is none."""
        if not on:
            return np.zeros_like(self.x), np.ones_like(self.x)
        mean = self.x / self.n
        sd = np.sqrt(np.maximum(self.xx / self.n - mean**2, 0))
        return mean, np.where(sd > 1e-12, sd, 1.0)

    def ridge(self, alpha: float, mean: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, float]:
        return ridge_from_moments(self.w, self.wx, self.wy, self.wxx, self.wxy, mean, scale, alpha)

    def r2(self, beta: np.ndarray, intercept: float) -> float:
        sse = self.wyy - 2 * (beta @ self.wxy + intercept * self.wy) + beta @ self.wxx @ beta + 2 * intercept * beta @ self.wx + intercept**2 * self.w
        sst = self.wyy - self.wy**2 / self.w
        return float(1 - sse / sst) if sst > 0 else 0.0


# --- walk forward ----------------------------------------------------------------------------------

@dataclass(frozen=True)
class WalkForwardConfig:
    alphas: tuple[float, ...] = (1.0,)
    scale: bool = True
    inner_share: float = 0.2
    min_group: int = 3


@dataclass
class WalkForwardResult:
    """``folds``: one row for each fold; ``predictions``: (date, id, prediction, fold); scalars over folds."""

    folds: pd.DataFrame
    predictions: DataFrame
    mean_r2: float = 0.0
    std_r2: float = 0.0
    mean_ic: float = 0.0
    ic_ir: float = 0.0
    ic_t: float = 0.0
    extra: dict = field(default_factory=dict)


def _cut_moments(panel: DataFrame, cols: list[str], cuts: list[tuple]) -> pd.DataFrame:
    """Moments of single dates cut by row count: cuts are (fold, date, rows), and of each the first rows by id and the
    others give one row each.  Only these dates are read, for all folds at once."""
    at = panel.sparkSession.createDataFrame(cuts, "fold int, date date, _rows long")
    rows = panel.join(F.broadcast(at), "date").withColumn("_first", F.row_number().over(Window.partitionBy("fold").orderBy("id")) <= F.col("_rows"))
    return date_moments(rows, cols, "fold", "_first").toPandas()  # at most two rows for each fold


def _inner_cut(train: pd.DataFrame, rows: int) -> tuple[int, int]:
    """Where a window's first rows end: the position of the date that they end in, and how many of its rows are theirs."""
    upto = train["n"].cumsum().to_numpy()
    at = int(np.searchsorted(upto, rows, "right"))
    return at, rows - int(upto[at - 1] if at else 0)


def walk_forward_ridge(panel: DataFrame, splitter, cfg: WalkForwardConfig = WalkForwardConfig(), cols: list[str] | None = None) -> WalkForwardResult:
    """Ridge by fold from per-date moments: the panel is scanned once for all folds, training sums are sums of
    dates, and predictions are a dot product with broadcast coefficients (one row for each fold).

    The scaler uses the whole training window; the penalty is chosen on its last rows by count.
    """
    cols = cols or [c for c in panel.columns if c not in (*KEY, "y", "weight")]
    p, spark = len(cols), panel.sparkSession
    panel = panel.select(*KEY, *cols, "y", "weight").persist()
    moments = date_moments(panel, cols).toPandas().sort_values("date", ignore_index=True)  # one row for each date
    windows = [(fold, moments[(moments["date"] >= a) & (moments["date"] <= b)], c, d) for fold, a, b, c, d in splitter.split(list(moments["date"])) if a]
    windows = [w for w in windows if w[1]["n"].sum() > 1]
    cuts = {fold: _inner_cut(train, int(train["n"].sum() * (1 - cfg.inner_share))) for fold, train, _, _ in windows}
    inside = [(fold, train["date"].iloc[cuts[fold][0]], cuts[fold][1]) for fold, train, _, _ in windows if cuts[fold][0] < len(train)]
    partial = _cut_moments(panel, cols, inside) if len(cfg.alphas) > 1 and inside else None
    rows = []
    for fold, train, c, d in windows:
        m = Moments.of(train, p)
        mean, scale = m.scaling(cfg.scale)
        alpha = cfg.alphas[0]
        if partial is not None:
            at, mine = cuts[fold][0], partial[partial["fold"] == fold]
            first = mine["_first"].astype(bool)
            inner, rest = pd.concat([train.iloc[:at], mine[first]]), pd.concat([train.iloc[at + 1 :], mine[~first]])
            if len(inner) and len(rest):
                fit, held = Moments.of(inner, p), Moments.of(rest, p)
                alpha = max(cfg.alphas, key=lambda x: held.r2(*fit.ridge(x, mean, scale)))
        beta, intercept = m.ridge(alpha, mean, scale)
        rows.append((fold, alpha, m.r2(beta, intercept), float(intercept), [float(x) for x in beta], c, d, int(m.n)))
    model = spark.createDataFrame(rows, "fold int, alpha double, train_r2 double, intercept double, beta array<double>, test_start date, test_end date, n_train long")
    dot = reduce(lambda s, i: s + F.col(cols[i]) * F.col("beta")[i], range(p), F.col("intercept"))
    scored = panel.join(F.broadcast(model), F.col("date").between(F.col("test_start"), F.col("test_end"))).select(*KEY, "y", "fold", dot.alias("prediction"))
    return _summarise(scored, pd.DataFrame(rows, columns=["fold", "alpha", "train_r2", "intercept", "beta", "test_start", "test_end", "n_train"]), cfg.min_group)


def held_out_r2(y: str = "y", prediction: str = "prediction") -> Column:
    """Aggregate: 1 - SSE / SST; 0 where y is constant."""
    sse, n = F.sum((F.col(y) - F.col(prediction)) ** 2), F.count(F.lit(1))
    sst = F.var_pop(y) * n
    return F.when(sst > 0, 1 - sse / sst).otherwise(0.0)


def rank_ic(scored: DataFrame, by: list[str], min_group: int = 3) -> DataFrame:
    """(by, ic): Spearman of y and prediction; 0, not null, where it is undefined."""
    r = scored.withColumns({"_a": average_rank("y", *by), "_b": average_rank("prediction", *by)})
    return r.groupBy(*by).agg(F.coalesce(correlation("_a", "_b", min_group), F.lit(0.0)).alias("ic"))


def ic_stats(ic: DataFrame) -> DataFrame:
    """One row: mean, sample deviation, ratio and plain t of the mean."""
    sd = F.stddev_samp("ic")
    ir = F.coalesce(F.try_divide(F.avg("ic"), sd), F.lit(0.0))
    return ic.agg(F.avg("ic").alias("mean_ic"), F.coalesce(sd, F.lit(0.0)).alias("std_ic"), ir.alias("ic_ir"), (ir * F.sqrt(F.count("ic"))).alias("ic_t"))


def _summarise(scored: DataFrame, folds: pd.DataFrame, min_group: int) -> WalkForwardResult:
    scored = scored.persist()
    ic = rank_ic(scored, ["fold", "date"], min_group)
    r2 = scored.groupBy("fold").agg(held_out_r2().alias("r2"))
    by_fold = ic.groupBy("fold").agg(F.avg("ic").alias("mean_ic"), F.stddev_pop("ic").alias("ic_std"), F.avg((F.col("ic") > 0).cast("double")).alias("hit_rate"))
    folds = folds.merge(r2.join(by_fold, "fold").toPandas(), on="fold", how="left").sort_values("fold", ignore_index=True)
    s = ic_stats(ic).first()
    predictions = scored.select(*KEY, "prediction", "fold")
    return WalkForwardResult(folds, predictions, float(folds["r2"].mean()) if len(folds) else 0.0, float(folds["r2"].std(ddof=0)) if len(folds) else 0.0, s.mean_ic or 0.0, s.ic_ir or 0.0, s.ic_t or 0.0)


def walk_forward(panel: DataFrame, splitter, fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]], min_group: int = 3) -> WalkForwardResult:
    """Any learner: ``fit`` takes training rows (with y, weight) and gives a function that adds ``prediction``."""
    folds = fold_table(panel, splitter)
    parts, rows = [], []
    for f in folds.where("train_start is not null").orderBy("fold").collect():
        predict = fit(panel.where(F.col("date").between(F.lit(f.train_start), F.lit(f.train_end))))
        test = panel.where(F.col("date").between(F.lit(f.test_start), F.lit(f.test_end)))
        parts.append(predict(test).select(*KEY, "y", F.lit(f.fold).alias("fold"), "prediction"))
        rows.append((f.fold, f.test_start, f.test_end))
    return _summarise(reduce(DataFrame.unionByName, parts), pd.DataFrame(rows, columns=["fold", "test_start", "test_end"]), min_group)


def _assembled(learner, cols: list[str]):
    from pyspark.ml.feature import VectorAssembler

    vectors = VectorAssembler(inputCols=cols, outputCol="_v")

    def fit(train: DataFrame):
        model = learner.fit(vectors.transform(train))
        return lambda test: model.transform(vectors.transform(test)).drop("_v")

    return fit


def elastic_net(cols: list[str], alpha: float = 1e-3, l1_ratio: float = 0.5, weighted: bool = True):
    """Learner with an L1/L2 penalty on the raw features; l1_ratio 1 is the lasso."""
    from pyspark.ml.regression import LinearRegression

    more = {"weightCol": "weight"} if weighted else {}
    return _assembled(LinearRegression(featuresCol="_v", labelCol="y", regParam=alpha, elasticNetParam=l1_ratio, standardization=False, tol=1e-8, maxIter=500, **more), cols)


def lasso(cols: list[str], alpha: float = 1e-3):
    return elastic_net(cols, alpha, 1.0)


def gradient_boost(cols: list[str], learning_rate: float = 0.05, iterations: int = 200, depth: int = 4, leaf: int = 20, seed: int = 0):
    """Boosted trees; alike in behaviour to a histogram learner, not in numbers."""
    from pyspark.ml.regression import GBTRegressor

    return _assembled(GBTRegressor(featuresCol="_v", labelCol="y", weightCol="weight", stepSize=learning_rate, maxIter=iterations, maxDepth=depth, minInstancesPerNode=leaf, seed=seed), cols)


def ridge(cols: list[str], alpha: float = 1.0, scale: bool = False):
    """Learner for ``walk_forward`` from moments, without scaling by default."""

    def fit(train: DataFrame):
        m = Moments.of(date_moments(train, cols).toPandas(), len(cols))
        beta, b0 = m.ridge(alpha, *m.scaling(scale))
        expr = reduce(lambda s, i: s + F.col(cols[i]) * float(beta[i]), range(len(cols)), F.lit(b0))
        return lambda test: test.withColumn("prediction", expr)

    return fit


def cv_loop(panel: DataFrame, cols: list[str], n_splits: int = 5, alpha: float = 1.0) -> pd.DataFrame:
    """(fold, r2) of a ridge over contiguous folds of rows in (date, id) order, the larger ones first.  The moments of
    all folds come from one scan; a fold's training sums are those of the others."""
    size = panel.where("date is not null").groupBy("date").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("date")  # a short axis
    total, p = int(size["n"].sum()), len(cols)
    if not 2 <= n_splits <= total:
        raise ValueError(f"{n_splits} folds of {total} rows")
    ends = np.cumsum([total // n_splits + (f < total % n_splits) for f in range(n_splits)]).tolist()
    before = (size["n"].cumsum() - size["n"]).tolist()
    at = panel.sparkSession.createDataFrame(list(zip(size["date"], before, strict=True)), "date date, _before long")
    rows = panel.join(F.broadcast(at), "date").withColumn("_k", F.col("_before") + F.row_number().over(Window.partitionBy("date").orderBy("id")))
    fold = reduce(lambda e, end: e + (F.col("_k") > end).cast("int"), ends[:-1], F.lit(0))
    moments = date_moments(rows.withColumn("fold", fold), cols, "fold").toPandas()  # one row for each fold
    out = []
    for f in range(n_splits):
        train, test = Moments.of(moments[moments["fold"] != f], p), Moments.of(moments[moments["fold"] == f], p)
        out.append((f, test.r2(*train.ridge(alpha, *train.scaling(False)))))
    return pd.DataFrame(out, columns=["fold", "r2"])


def compare_models(panel: DataFrame, splitter, learners: dict[str, Callable]) -> pd.DataFrame:
    """(model, mean_ic, mean_r2) by mean IC, best first."""
    rows = [(name, (r := walk_forward(panel, splitter, fit)).mean_ic, r.mean_r2) for name, fit in learners.items()]
    return pd.DataFrame(rows, columns=["model", "mean_ic", "mean_r2"]).sort_values("mean_ic", ascending=False, ignore_index=True)


# --- leakage ---------------------------------------------------------------------------------------

def next_returns(daily: DataFrame) -> DataFrame:
    return daily.select(*KEY, F.lead("return").over(Window.partitionBy("id").orderBy("date")).alias("next_return"), F.col("return").alias("same_return"))


def horizon_error(forward: DataFrame, daily: DataFrame, col: str = "fwd_ret_1") -> DataFrame:
    """One row: largest relative error of a forward return against the next daily return, and rows compared."""
    both = forward.select(*KEY, F.col(col).alias("_f")).join(next_returns(daily), KEY).where(finite("_f", "next_return"))
    return both.agg(F.max(F.abs(F.col("_f") - F.col("next_return")) / (F.abs("next_return") + 1e-8)).alias("max_error"), F.count(F.lit(1)).alias("n"))


def target_alignment(panel: DataFrame, daily: DataFrame) -> DataFrame:
    """One row: largest relative errors of y against the next and the same day's return."""
    both = panel.select(*KEY, "y").join(next_returns(daily), KEY)
    rel = lambda c: F.max(F.abs(F.col("y") - F.col(c)) / (F.abs(F.col(c)) + 1e-8))
    return both.agg(rel("next_return").alias("next_error"), rel("same_return").alias("same_error"))


def embargo_gap(folds: DataFrame) -> DataFrame:
    """(fold, gap): calendar days between the end of training and the start of testing."""
    return folds.where("train_end is not null").select("fold", F.datediff("test_start", "train_end").cast("long").alias("gap"))


def audit_leakage(forward: DataFrame, daily: DataFrame, panel: DataFrame, splitter, embargo: int, rtol: float = 1e-6) -> pd.DataFrame:
    """(check, passed, value) of the three checks."""
    h = horizon_error(forward, daily).first()
    a = target_alignment(panel, daily).first()
    g = embargo_gap(fold_table(panel, splitter)).agg(F.min("gap")).first()[0]
    rows = [
        ("horizon", bool(h.n) and h.max_error <= rtol, h.max_error),
        ("alignment", a.next_error is not None and a.next_error <= rtol < (a.same_error or 0.0), a.next_error),
        ("embargo", g is not None and g > embargo, g),
    ]
    return pd.DataFrame(rows, columns=["check", "passed", "value"])


# --- persistence -----------------------------------------------------------------------------------

@dataclass
class Artifact:
    """A linear model with its scaler, as plain values."""

    features: list[str]
    beta: list[float]
    intercept: float
    mean: list[float] | None = None
    scale: list[float] | None = None
    alpha: float = 1.0
    kind: str = "ridge"
    train_start: str | None = None
    train_end: str | None = None
    extra: dict = field(default_factory=dict)


def artifact_from_fold(row: pd.Series, features: list[str], **more) -> Artifact:
    return Artifact(features, list(row["beta"]), float(row["intercept"]), alpha=float(row["alpha"]), **more)


def save_artifact(spark: SparkSession, artifact: Artifact, path: str) -> None:
    spark.createDataFrame([(json.dumps(asdict(artifact), sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_artifact(spark: SparkSession, path: str) -> Artifact:
    return Artifact(**json.loads(spark.read.text(path).first()[0]))


def predict_from_artifact(artifact: Artifact, df: DataFrame) -> DataFrame:
    """Adds prediction and is_valid; rows with a null or NaN feature have neither."""
    mean = artifact.mean or [0.0] * len(artifact.features)
    scale = artifact.scale or [1.0] * len(artifact.features)
    terms = [(F.col(c) - m) / s * b for c, m, s, b in zip(artifact.features, mean, scale, artifact.beta, strict=True)]
    ok = finite(*artifact.features)
    return df.withColumn("prediction", F.when(ok, reduce(lambda a, b: a + b, terms, F.lit(artifact.intercept)))).withColumn("is_valid", ok)


def significant(t: float, level: float = 0.05) -> bool:
    return p_value(t) <= level
