"""Run telemetry: timed trials, scaling fits, regression checks, histories, manifests and summary diffs."""

from __future__ import annotations

import cProfile
import contextlib
import json
import math
import os
import platform
import pstats
import resource
import shutil
import statistics
import subprocess
import time
import tracemalloc
from collections.abc import Callable, Iterator
from dataclasses import astuple, dataclass
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

METRICS = ("elapsed_s", "result_mb", "peak_traced_mb", "peak_rss_mb")
DIMS = ("n_assets", "n_dates", "n_features", "n_factors")


# --- trials ----------------------------------------------------------------------------------------

@dataclass
class TrialResult:
    stage: str
    elapsed: list[float]
    rss_mb: float

    def stats(self) -> dict[str, float]:
        x = sorted(self.elapsed)
        at = lambda q: x[0] if len(x) == 1 else statistics.quantiles(x, n=100, method="inclusive")[q - 1]
        return {"min": x[0], "p50": at(50), "p90": at(90), "p95": at(95), "std": statistics.stdev(x) if len(x) > 1 else 0.0}


def rss_mb() -> float:
    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024


@contextlib.contextmanager
def stage_timer() -> Iterator[list[float]]:
    """Gives a list that gets the elapsed seconds."""
    out: list[float] = []
    began = time.perf_counter()
    yield out
    out.append(time.perf_counter() - began)


def run_trials(stage: str, fn: Callable[[], object], n_trials: int = 5, warmup: int = 1) -> TrialResult:
    """Warm up, then time some calls; a DataFrame that a call returns is run to a sink that keeps nothing."""

    def call() -> float:
        with stage_timer() as t:
            if isinstance(out := fn(), DataFrame):
                out.write.format("noop").mode("overwrite").save()
        return t[0]

    for _ in range(warmup):
        call()
    return TrialResult(stage, [call() for _ in range(n_trials)], rss_mb())


def _git(*args: str) -> str:
    try:
        return subprocess.run(["git", *args], capture_output=True, text=True, timeout=10).stdout.strip()
    except OSError:
        return ""


def capture_environment(spark: SparkSession, run_id: str) -> dict[str, object]:
    return {
        "run_id": run_id, "git_sha": _git("rev-parse", "HEAD"), "git_dirty": bool(_git("status", "--porcelain")), "hostname": platform.node(), "cpu_model": platform.processor(),
        "n_cores": os.cpu_count(), "python_version": platform.python_version(), "spark_version": spark.version, "master": spark.sparkContext.master,
    }


# --- profiles --------------------------------------------------------------------------------------

ARTIFACTS = "run_id string, param_point_id int, stage string, profiler string, kind string, fmt string, path string, size_bytes long, on_regression boolean, git_sha string"


@dataclass(frozen=True)
class ProfileArtifact:
    """A file of a profile, by its path below the folder of all profiles."""

    run_id: str
    param_point_id: int
    stage: str
    profiler: str
    kind: str
    fmt: str
    path: str
    size_bytes: int
    on_regression: bool = False
    git_sha: str = ""


def _capture(stage: str, fn: Callable[[], object], folder: str, run_id: str, param_point_id: int, git_sha: str, on_regression: bool, cpu: bool, memory: bool) -> tuple[object, list[ProfileArtifact]]:
    at = Path(folder) / run_id
    at.mkdir(parents=True, exist_ok=True)
    name, profile, out = f"{stage}.{param_point_id}", cProfile.Profile(), []
    was_tracing = tracemalloc.is_tracing()
    if memory:
        tracemalloc.start() if not was_tracing else tracemalloc.clear_traces()
    try:
        with profile if cpu else contextlib.nullcontext():
            result = fn()
            if isinstance(result, DataFrame):
                result.write.format("noop").mode("overwrite").save()
        held = tracemalloc.take_snapshot() if memory else None
    finally:
        if memory and not was_tracing:
            tracemalloc.stop()

    def kept(profiler: str, kind: str, fmt: str, file: str) -> None:
        path = at / file
        out.append(ProfileArtifact(run_id, param_point_id, stage, profiler, kind, fmt, str(path.relative_to(folder)), path.stat().st_size, on_regression, git_sha))

    if cpu:
        profile.dump_stats(at / f"{name}.cpu.pstats")
        with open(at / f"{name}.cpu.txt", "w") as f:
            pstats.Stats(profile, stream=f).sort_stats("cumulative").print_stats(50)
        kept("cprofile", "cpu", "pstats", f"{name}.cpu.pstats")
        kept("cprofile", "cpu", "calltree", f"{name}.cpu.txt")
    if memory:
        held.dump(str(at / f"{name}.memory.bin"))
        (at / f"{name}.memory.txt").write_text("\n".join(str(x) for x in held.statistics("lineno")[:50]) + "\n")
        kept("tracemalloc", "memory", "snapshot", f"{name}.memory.bin")
        kept("tracemalloc", "memory", "summary", f"{name}.memory.txt")
    return result, out


def capture_cpu(stage: str, fn: Callable[[], object], folder: str, run_id: str, param_point_id: int = 0, git_sha: str = "", on_regression: bool = False) -> tuple[object, list[ProfileArtifact]]:
    """The result of a call, and the files of its profile on the driver: raw counts and a call tree.  A DataFrame is run
    to a sink that keeps nothing; what executors do is in Spark's own interface."""
    return _capture(stage, fn, folder, run_id, param_point_id, git_sha, on_regression, True, False)


def capture_memory(stage: str, fn: Callable[[], object], folder: str, run_id: str, param_point_id: int = 0, git_sha: str = "", on_regression: bool = False) -> tuple[object, list[ProfileArtifact]]:
    """Like ``capture_cpu`` for allocations: a snapshot and its largest lines."""
    return _capture(stage, fn, folder, run_id, param_point_id, git_sha, on_regression, False, True)


def capture_both(stage: str, fn: Callable[[], object], folder: str, run_id: str, param_point_id: int = 0, git_sha: str = "", on_regression: bool = False) -> tuple[object, list[ProfileArtifact]]:
    """Both profiles of one call; each slows the other a little."""
    return _capture(stage, fn, folder, run_id, param_point_id, git_sha, on_regression, True, True)


def write_artifacts(spark: SparkSession, folder: str, artifacts: list[ProfileArtifact], run_ts: int | None = None) -> None:
    """Append to the index of all profiles; nothing to do for none."""
    if artifacts:
        ts = time.time_ns() if run_ts is None else run_ts
        append(spark.createDataFrame([(*astuple(a), ts) for a in artifacts], ARTIFACTS + ", run_ts long"), f"{folder}/profile_artifacts.parquet")


def read_artifacts(spark: SparkSession, folder: str) -> DataFrame:
    return read_or_empty(spark, f"{folder}/profile_artifacts.parquet", ARTIFACTS + ", run_ts long")


def prune_profiles(spark: SparkSession, folder: str, keep_last: int) -> list[str]:
    """Delete the files of runs other than the last ones and those with a regression; the runs that went.  Their rows
    stay in the index."""
    index = read_artifacts(spark, folder)
    gone = index.join(prune_runs(index, keep_last).select("run_id").distinct(), "run_id", "left_anti").select("run_id").distinct()
    out = [r.run_id for r in gone.orderBy("run_id").collect() if (Path(folder) / r.run_id).is_dir()]  # one row for each run
    for run in out:
        shutil.rmtree(Path(folder) / run)
    return out


# --- scaling ---------------------------------------------------------------------------------------

def fit_scaling(measurements: DataFrame, metrics: tuple[str, ...] = METRICS, dims: tuple[str, ...] = DIMS, min_points: int = 3) -> DataFrame:
    """(stage, metric, scaling_dim, log_log_slope, intercept, r_squared, n_points): a line through the logarithms of
    per-size medians, with the other dimensions at their most frequent values.  All fits are one plan."""
    metrics, dims = ([c for c in x if c in measurements.columns] for x in (metrics, dims))
    modes = measurements.groupBy("stage").agg(*(F.mode(d, True).alias(f"_m_{d}") for d in dims))
    rows = measurements.join(modes, "stage")
    long = rows.select("stage", *dims, *(f"_m_{d}" for d in dims), F.expr(f"stack({len(metrics)}, {', '.join(f'{m!r}, cast({m} as double)' for m in metrics)}) as (metric, value)"))
    at = lambda d: [F.col(o) == F.col(f"_m_{o}") for o in dims if o != d]
    options = F.array(*(F.when(F.expr("true") if not at(d) else _all(at(d)), F.struct(F.lit(d).alias("scaling_dim"), F.col(d).cast("double").alias("size"))) for d in dims))
    points = long.withColumn("_o", F.explode(F.filter(options, lambda o: o.isNotNull()))).select("stage", "metric", "value", "_o.*")
    medians = points.where("value > 0 and size > 0").groupBy("stage", "metric", "scaling_dim", "size").agg(F.log(F.median("value")).alias("y")).withColumn("x", F.log("size"))
    fit = medians.groupBy("stage", "metric", "scaling_dim").agg(F.count(F.lit(1)).alias("n_points"), F.var_pop("x").alias("_vx"), F.var_pop("y").alias("_vy"), F.covar_pop("x", "y").alias("_c"), F.avg("x").alias("_mx"), F.avg("y").alias("_my"))
    fit = fit.where((F.col("n_points") >= min_points) & (F.col("_vx") > 0)).withColumn("log_log_slope", F.col("_c") / F.col("_vx"))
    r2 = F.when(F.col("_vy") > 0, F.col("_c") * F.col("_c") / (F.col("_vx") * F.col("_vy"))).otherwise(1.0)
    return fit.select("stage", "metric", "scaling_dim", "log_log_slope", (F.col("_my") - F.col("log_log_slope") * F.col("_mx")).alias("intercept"), r2.alias("r_squared"), "n_points")


def _all(tests):
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def best_r_squared(fits: DataFrame) -> DataFrame:
    return fits.groupBy("stage", "metric").agg(F.max("r_squared").alias("r_squared"))


# --- regressions -----------------------------------------------------------------------------------

def check_regressions(current: DataFrame, baselines: DataFrame, thresholds: DataFrame, fits: DataFrame | None = None, min_r_squared: float | None = None) -> DataFrame:
    """Violations (stage, metric, baseline_value, current_value, pct_increase, abs_increase): above both the relative
    and the absolute limit against the first baseline of the stage; with ``min_r_squared`` only where a fit is that
    good."""
    names = {"elapsed_s": "elapsed_s_p50", "result_mb": "result_mb", "peak_rss_mb": "peak_rss_mb"}
    one = baselines.withColumn("_k", F.row_number().over(Window.partitionBy("stage").orderBy("baseline_id", "param_point_id"))).where("_k = 1")
    stack = lambda df, cols, v: df.select("stage", F.expr(f"stack({len(cols)}, {', '.join(f'{m!r}, cast({c} as double)' for m, c in cols.items())}) as (metric, {v})"))
    both = stack(current, {m: m for m in names}, "current_value").join(stack(one, names, "baseline_value"), ["stage", "metric"]).join(thresholds, ["stage", "metric"])
    if fits is not None and min_r_squared is not None:
        both = both.join(best_r_squared(fits).where(F.col("r_squared") >= min_r_squared), ["stage", "metric"], "left_semi")
    rise = F.col("current_value") - F.col("baseline_value")
    both = both.withColumns({"abs_increase": rise, "pct_increase": F.try_divide(rise, F.col("baseline_value"))})
    bad = both.where((F.col("pct_increase") > F.col("max_pct_increase")) & (F.col("abs_increase") > F.col("max_abs_increase")))
    return bad.select("stage", "metric", "baseline_value", "current_value", "pct_increase", "abs_increase")


# --- stores ----------------------------------------------------------------------------------------

def append(df: DataFrame, path: str) -> None:
    """Append rows; new columns are merged on reading, nothing is rewritten."""
    df.write.mode("append").parquet(path)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.option("mergeSchema", True).parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return spark.createDataFrame([], schema)
        raise


def trial_rows(spark: SparkSession, run_id: str, params: dict[str, int], results: list[TrialResult], param_point_id: int = 0) -> DataFrame:
    rows = [(run_id, param_point_id, *(int(params.get(d, 0)) for d in DIMS), r.stage, i, x, r.rss_mb) for r in results for i, x in enumerate(r.elapsed)]
    return spark.createDataFrame(rows, "run_id string, param_point_id int, n_assets int, n_dates int, n_features int, n_factors int, stage string, trial_idx int, elapsed_s double, peak_rss_mb double")


def snapshots(measurements: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """(run_id, component, p50, delta_prev_pct, delta_first_pct): median per component and their sum as ``e2e``;
    changes against the runs before in order of run_id."""
    p50 = measurements.groupBy("run_id", F.col("stage").alias("component")).agg(F.median("elapsed_s").alias("p50"))
    rows = p50.unionByName(p50.groupBy("run_id").agg(F.lit("e2e").alias("component"), F.sum("p50").alias("p50")).select("run_id", "component", "p50"))
    if history is not None:
        rows = rows.unionByName(history.select("run_id", "component", "p50"))
    w = Window.partitionBy("component").orderBy("run_id")
    pct = lambda b: (F.try_divide(F.col("p50"), b) - 1) * 100
    return rows.withColumns({"delta_prev_pct": pct(F.lag("p50").over(w)), "delta_first_pct": pct(F.first("p50").over(w))})


RUNS = "run_id string, run_ts timestamp, git_sha string, branch string, commit_message string, agent_id string, target_component string, goal string, strategy string, e2e_p50_s double, e2e_vs_prev_pct double, regression_passed boolean, n_violations int, parent_run_id string"
SNAPSHOTS = "run_id string, component string, p50 double, delta_prev_pct double, delta_first_pct double"
ANNOTATIONS = "run_id string, hypothesis string, outcome string, lessons string, next_target string, confidence double, improvement_type string"


@dataclass(frozen=True)
class RunContext:
    """Who made a run, and what for."""

    agent_id: str = ""
    target_component: str = ""
    goal: str = ""
    strategy: str = ""
    parent_run_id: str | None = None


@dataclass(frozen=True)
class Annotation:
    hypothesis: str
    outcome: str
    lessons: str = ""
    next_target: str = ""
    confidence: float | None = None
    improvement_type: str = ""


def write_history_run(spark: SparkSession, folder: str, run_id: str, run_ts: datetime, measurements: DataFrame, context: RunContext = RunContext(), violations: DataFrame | None = None, note: Annotation | None = None) -> None:
    """Append a run to the history: a row of its own, its snapshots against the runs before, and a note if there is one.
    Without ``violations`` the run counts as passed."""
    before = read_component_snapshots(spark, folder)
    mine = snapshots(measurements.where(F.col("run_id") == run_id), before).where(F.col("run_id") == run_id).collect()  # one row for each component
    whole = next(r for r in mine if r.component == "e2e")
    bad = 0 if violations is None else violations.count()
    row = (run_id, run_ts, _git("rev-parse", "--short", "HEAD"), _git("rev-parse", "--abbrev-ref", "HEAD"), _git("log", "-1", "--format=%s"), context.agent_id, context.target_component, context.goal, context.strategy, whole.p50, whole.delta_prev_pct, bad == 0, bad, context.parent_run_id)
    append(spark.createDataFrame([row], RUNS), f"{folder}/improvement_runs.parquet")
    append(spark.createDataFrame([(r.run_id, r.component, r.p50, r.delta_prev_pct, r.delta_first_pct) for r in mine], SNAPSHOTS), f"{folder}/component_snapshots.parquet")
    if note is not None:
        append(spark.createDataFrame([(run_id, *astuple(note))], ANNOTATIONS), f"{folder}/agent_annotations.parquet")


def read_improvement_runs(spark: SparkSession, folder: str) -> DataFrame:
    return read_or_empty(spark, f"{folder}/improvement_runs.parquet", RUNS)


def read_component_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    return read_or_empty(spark, f"{folder}/component_snapshots.parquet", SNAPSHOTS)


def read_agent_annotations(spark: SparkSession, folder: str) -> DataFrame:
    return read_or_empty(spark, f"{folder}/agent_annotations.parquet", ANNOTATIONS)


def prune_runs(index: DataFrame, keep_last: int) -> DataFrame:
    """Rows of the last runs by timestamp, and of all runs with a regression."""
    last = index.groupBy("run_id").agg(F.max("run_ts").alias("_t")).orderBy(F.desc("_t"), "run_id").limit(keep_last).select("run_id")
    return index.join(last.unionByName(index.where("on_regression").select("run_id")).distinct(), "run_id", "left_semi")


def run_harness(spark: SparkSession, grid: list[dict[str, int]], components: dict[str, Callable[[dict[str, int]], Callable[[], object]]], store: str, run_id: str, n_trials: int = 3, warmup: int = 1) -> DataFrame:
    """Time each component at each point, append the measurements, and give this run's."""
    for k, params in enumerate(grid):
        results = [run_trials(name, make(params), n_trials, warmup) for name, make in components.items()]
        append(trial_rows(spark, run_id, params, results, k), store)
    return spark.read.parquet(store).where(F.col("run_id") == run_id)


def write_summary(path: str, document: dict) -> None:
    with open(path, "w") as f:
        json.dump(document, f, indent=2, sort_keys=True, default=str)


# --- provenance ------------------------------------------------------------------------------------

def hash_files(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> DataFrame:
    """(path, sha256, n_bytes) of each file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("n_bytes"))


def diff_manifests(a: DataFrame, b: DataFrame) -> DataFrame:
    """(path, change): added, removed or changed files between two hash tables."""
    both = a.select("path", F.col("sha256").alias("_a")).join(b.select("path", F.col("sha256").alias("_b")), "path", "full")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed")
    return both.select("path", change.alias("change")).where("change is not null")


def build_manifest(run_id: str, spec: dict, hashes: DataFrame, environment: dict) -> dict:
    return {"run_id": run_id, "spec": spec, "environment": environment, "files": {r.path: r.sha256 for r in hashes.collect()}}  # one row for each file


def read_manifest(path: str) -> dict:
    with open(path) as f:
        return json.load(f)


# --- golden summaries ------------------------------------------------------------------------------

def diff_summaries(golden: dict, current: dict, rel_tol: float = 1e-6, field_tol: dict[str, float] | None = None) -> list[tuple[str, str, object, object]]:
    """(field, state, golden, current) with state held, moved, new or missing; nested dicts by their paths."""

    def flat(d: dict, at: str = "") -> dict:
        out = {}
        for k, v in d.items():
            out |= flat(v, f"{at}{k}.") if isinstance(v, dict) else {f"{at}{k}": v}
        return out

    a, b, rows = flat(golden), flat(current), []
    for k in sorted(a.keys() | b.keys()):
        if k not in b:
            state = "missing"
        elif k not in a:
            state = "new"
        elif isinstance(a[k], (int, float)) and isinstance(b[k], (int, float)):
            tol = (field_tol or {}).get(k, rel_tol)
            state = "held" if a[k] == b[k] or math.isclose(a[k], b[k], rel_tol=tol) or (a[k] != a[k] and b[k] != b[k]) else "moved"
        else:
            state = "held" if a[k] == b[k] else "moved"
        rows.append((k, state, a.get(k), b.get(k)))
    return rows


def additive_only(rows: list[tuple]) -> bool:
    return all(r[1] in ("held", "new") for r in rows)
