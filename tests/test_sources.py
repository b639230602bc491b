from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quantloom.operators import analysis as an
from quantloom.operators import cleaning as cl
from quantloom.operators import telemetry as tm
from quantloom.plans.pipeline import INPUTS, StrategySpec, build_components, run_experiment, run_from_spec, run_production_pipeline, summary_frame
from quantloom.sources import generators as g
from quantloom.sources.loader import DatasetLoader
from quantloom.sources.schema import REGISTRY, SchemaError, schema_for
from quantloom.streaming import events as ev

SPEC = g.GenSpec(12, 70, 4, 3, seed=5)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_every_dataset_is_valid(spark, name):
    assert g.generate(spark, name, SPEC, validate=True).count() > 0


def test_generators_repeat(spark):
    a, b = (g.generate(spark, "prices", SPEC).orderBy("date", "id").collect() for _ in range(2))
    assert a == b and a != g.generate(spark, "prices", g.GenSpec(12, 70, 4, 3, seed=6)).orderBy("date", "id").collect()


def test_sessions_are_weekdays(spark):
    for start in ("2000-01-01", "2000-01-03", "2000-01-05", "2000-01-09"):
        days = [r[0] for r in g.session_axis(spark, 12, start).orderBy("t").select("date").collect()]
        import pandas as pd

        assert days == [d.date() for d in pd.bdate_range(start, periods=12)]


def test_returns_and_prices_agree(spark):
    p = g.generate(spark, "prices", SPEC)
    r = cl.returns_from_prices(p).withColumnRenamed("return", "_r")
    f = g.generate(spark, "forward_returns", SPEC)
    ahead = r.withColumn("next", F.lead("_r").over(__import__("pyspark").sql.Window.partitionBy("id").orderBy("date")))
    worst = f.join(ahead, ["date", "id"]).where("next is not null").agg(F.max(F.abs(F.col("fwd_ret_1") - F.col("next")))).first()[0]
    assert worst < 1e-8
    assert f.where("fwd_ret_21 is null").count() == 12 * 21


def test_loader(spark, tmp_path):
    g.write_all(spark, str(tmp_path), SPEC, ("prices", "security_master"))
    d = DatasetLoader(spark, str(tmp_path))
    some = d.load("prices", "2000-02-01", "2000-02-29", [1, 2], ["close"])
    assert some.columns == ["date", "id", "close"] and some.agg(F.countDistinct("id")).first()[0] == 2
    assert "PushedFilters: [IsNotNull(date)" in some._jdf.queryExecution().toString()
    assert d.load("security_master", "2000-02-01").count() == 12
    with pytest.raises(KeyError):
        d.scan("nothing")


def test_schema_errors(spark):
    s = schema_for("risk_free_rate")
    good = g.generate(spark, "risk_free_rate", SPEC)
    for bad in (good.drop("daily_rate"), good.withColumn("daily_rate", F.lit("x")), good.union(good), good.withColumn("daily_rate", F.when(F.rand(0) > 2, 1.0))):
        with pytest.raises(SchemaError):
            s.validate(bad)
    assert s.validate(good.withColumn("more", F.lit(1))).count() == 70 and s.empty(spark).count() == 0
    assert s.column("date").dtype == "date"


def test_pipeline(spark, tmp_path):
    spec = StrategySpec(g.GenSpec(16, 90, 4, 3, seed=1), wf_splits=2, n_optimized=16)
    assert StrategySpec.from_json(spec.to_json()) == spec
    s = run_production_pipeline(spark, str(tmp_path), spec)
    assert s.ic_raw is not None and -1 <= s.ic_raw <= 1 and s.wf_mean_ic > 0 and s.opt_gross <= 2.0 + 1e-4
    assert s.cost_drag > 0 and s.n_scaling_fits > 0 and s.n_trades > 0
    assert summary_frame(spark, s).count() == 16 and "prices" in INPUTS
    again = dict(summary_frame(spark, run_from_spec(spark, str(tmp_path / "again"), spec.to_json())).collect())
    assert again == pytest.approx(dict(summary_frame(spark, s).collect()), rel=1e-6)  # sums depend on their order
    with pytest.raises(ValueError):
        StrategySpec(max_weight=2.0)


def test_telemetry(spark, tmp_path):
    store = str(tmp_path / "runs")
    rows = tm.run_harness(spark, [{"n_assets": 10}, {"n_assets": 20}], {"count": lambda p: lambda: spark.range(p["n_assets"])}, store, "r1", 2, 0)
    assert rows.count() == 4 and tm.snapshots(rows).count() == 2
    assert tm.read_or_empty(spark, str(tmp_path / "none"), "a int").count() == 0
    kept = tm.prune_runs(spark.createDataFrame([("a", 1, False), ("b", 2, False), ("c", 0, True)], "run_id string, run_ts int, on_regression boolean"), 1)
    assert {r.run_id for r in kept.collect()} == {"b", "c"}
    diff = tm.diff_summaries({"a": 1.0, "b": {"c": 2.0}, "d": 1}, {"a": 1.0 + 1e-9, "b": {"c": 3.0}, "e": 1})
    assert {r[0]: r[1] for r in diff} == {"a": "held", "b.c": "moved", "d": "missing", "e": "new"} and not tm.additive_only(diff)
    h = tm.hash_files(spark, store)
    assert h.count() > 0 and tm.diff_manifests(h, h).count() == 0


def test_components_and_experiment(spark, tmp_path):
    sizes = {"n_assets": 12, "n_dates": 70, "n_features": 4, "n_factors": 3}
    parts = build_components(spark, str(tmp_path / "points"))
    rows = tm.run_harness(spark, [sizes], parts, str(tmp_path / "runs"), "r1", 1, 0)
    assert {r.stage for r in rows.collect()} == {"etl", "signals", "models", "analysis", "portfolio", "backtest", "profiling"}
    done = run_experiment(spark, sizes, str(tmp_path / "experiment"), 20)
    assert len(done) == 9 and all(len(r.elapsed) == 1 and r.elapsed[0] > 0 for r in done)


def test_history(spark, tmp_path):
    folder = str(tmp_path)
    assert tm.read_improvement_runs(spark, folder).count() == tm.read_agent_annotations(spark, folder).count() == 0
    schema = "run_id string, stage string, elapsed_s double"
    for day, (run, a) in enumerate((("r1", 1.0), ("r2", 3.0)), 1):
        rows = spark.createDataFrame([(run, "a", a), (run, "a", a), (run, "b", 1.0), ("other", "a", 9.0)], schema)
        note = tm.Annotation("faster joins", "slower", confidence=0.5) if day == 2 else None
        bad = spark.range(day - 1)
        tm.write_history_run(spark, folder, run, datetime(2020, 1, day), rows, tm.RunContext("me", "a"), bad, note)
    runs = {r.run_id: r for r in tm.read_improvement_runs(spark, folder).collect()}
    assert (runs["r1"].e2e_p50_s, runs["r1"].e2e_vs_prev_pct, runs["r1"].regression_passed) == (2.0, None, True)
    assert (runs["r2"].e2e_p50_s, runs["r2"].e2e_vs_prev_pct, runs["r2"].n_violations) == (4.0, 100.0, 1)
    snaps = {(r.run_id, r.component): r.delta_prev_pct for r in tm.read_component_snapshots(spark, folder).collect()}
    assert len(snaps) == 6 and snaps["r2", "a"] == pytest.approx(200.0) and snaps["r2", "b"] == 0.0
    assert [(r.run_id, r.confidence) for r in tm.read_agent_annotations(spark, folder).collect()] == [("r2", 0.5)]


def test_profiles(spark, tmp_path):
    folder = str(tmp_path)
    assert tm.read_artifacts(spark, folder).count() == 0
    for i, (run, capture) in enumerate((("r1", tm.capture_cpu), ("r2", tm.capture_memory), ("r3", tm.capture_both), ("r4", tm.capture_cpu))):
        got, files = capture("sum", lambda: sum(range(1000)), folder, run, on_regression=run == "r2")
        assert got == 499500 and len(files) == (4 if run == "r3" else 2)
        assert all((tmp_path / f.path).stat().st_size == f.size_bytes > 0 for f in files)
        tm.write_artifacts(spark, folder, files, i)
    tm.write_artifacts(spark, folder, [])
    assert tm.read_artifacts(spark, folder).count() == 10
    assert tm.prune_profiles(spark, folder, 1) == ["r1", "r3"] and (tmp_path / "r2").is_dir() and (tmp_path / "r4").is_dir()
    frame, _ = tm.capture_cpu("plan", lambda: spark.range(10), folder, "r5")
    assert frame.count() == 10


def test_drawdown_events_take_the_earliest_trough(spark):
    nav = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 2, 1, 1.5, 1, 2, 3, 2.5])], "date int, nav double")
    e = an.drawdown_events(nav).orderBy("peak_date").collect()
    assert [(r.peak_date, r.trough_date, r.recovery_date) for r in e] == [(1, 2, 5), (6, 7, None)] and e[0].recovery_days == 3


def test_drain_keeps_batches(spark, tmp_path):
    """Two files are two batches: appended both stay, complete leaves the last; a second run has nothing new."""
    for i in (1, 2):
        spark.range(10 * i).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    assert ev.drain(stream, str(tmp_path / "a"), "append").count() == 30
    assert ev.drain(stream, str(tmp_path / "a"), "append").count() == 0
    n = ev.drain(stream.groupBy((F.col("id") % 2).alias("odd")).count(), str(tmp_path / "b"))
    assert sorted(map(tuple, n.collect())) == [(0, 15), (1, 15)]
