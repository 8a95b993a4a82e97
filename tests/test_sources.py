"""Sources and sinks: run folders, YAML configs, dataset registry, writers."""

import json
import os

import pytest
from pyspark.sql import functions as F

from prefspark.operators import runs
from prefspark.sources import datasets, runfolders, runsource, sinks


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


@pytest.fixture()
def run_root(scratch):
    root = os.path.join(scratch, "results")
    _write(f"{root}/ppo_hh_7b/experiment_summary.json", json.dumps({
        "experiment_duration_hours": 1.5, "final_metrics": {"reward_mean": [0.1, 0.4], "kl_divergence": 0.02},
        "reward_mean": 0.0, "best_reward": None, "config": {"algorithm": "ppo"}}))
    _write(f"{root}/ppo_hh_7b/metrics.json", json.dumps({"entropy": 1.2, "kl_divergence": 0.03}))
    _write(f"{root}/grpo_offpolicy_hh_7b/metrics.json", json.dumps({"reward_mean": 0.7}))
    _write(f"{root}/dpo_oasst_13b/experiment_summary.json", "{not json")
    _write(f"{root}/.hidden_run/metrics.json", json.dumps({"reward_mean": 9.0}))
    _write(f"{root}/ppo_hh_7b/config.yaml", "model:\n  checkpoint: gpt2\ntraining:\n  learning_rate: 1e-5\n"
                                            "  batch_size: 4\n  fp16: true\n")
    _write(f"{root}/dpo_oasst_13b/config.yaml", "training:\n  batch_size: 2\n")
    return root


def test_scan_runs_merge(spark, run_root):
    r = {x.run: x for x in runfolders.scan_runs(spark, run_root).collect()}
    assert set(r) == {"ppo_hh_7b", "grpo_offpolicy_hh_7b", "dpo_oasst_13b"}
    m = r["ppo_hh_7b"].metrics
    assert m["reward_mean"] == 0.4            # list -> last element; final_metrics beats top level
    assert m["kl_divergence"] == 0.03         # metrics.json (later file) wins
    assert m["entropy"] == 1.2 and m["best_reward"] is None
    assert r["ppo_hh_7b"].duration_hours == 1.5
    assert r["dpo_oasst_13b"].metrics == {}   # malformed file -> empty


def test_results_from_run_folders(spark, run_root):
    t = runs.results_projection(runfolders.scan_runs(spark, run_root).withColumnRenamed("run", "experiment_name"))
    got = {x.experiment_name: x for x in t.collect()}
    assert got["grpo_offpolicy_hh_7b"].algorithm == "grpo_offpolicy"
    assert got["grpo_offpolicy_hh_7b"].entropy == 0.0          # absent key reads 0
    assert got["ppo_hh_7b"].best_reward is None                # explicit null stays null
    assert len(runs.RESULT_COLUMNS) == 17 and t.columns == runs.RESULT_COLUMNS


def test_scan_configs(spark, run_root):
    c = {(x.run, x.path): (x.value, x.num) for x in runfolders.scan_configs(spark, run_root).collect()}
    assert c[("ppo_hh_7b", "training.learning_rate")] == ("1e-5", 1e-5)   # YAML 1.1 string, cast
    assert c[("ppo_hh_7b", "training.fp16")] == ("true", None)
    assert c[("dpo_oasst_13b", "training.batch_size")] == ("2", 2.0)
    missing = runs.missing_sections(runfolders.scan_configs(spark, run_root), ["model", "training"])
    assert [(x.run, x.section) for x in missing.collect()] == [("dpo_oasst_13b", "model")]


def test_dataset_registry(spark, scratch):
    spark.createDataFrame([("a", "b")], "chosen string, rejected string").write.parquet(f"{scratch}/hh/part")
    datasets.register_dataset("hh", datasets.DatasetSpec("hh/part/*.parquet",
                                                         columns={"chosen": "chosen", "rejected": "rejected"}))
    assert datasets.load_dataset(spark, "hh", scratch).count() == 1
    with pytest.raises(ValueError):
        datasets.load_dataset(spark, "nope", scratch)


def test_mock_samples(spark):
    rows = datasets.mock_samples(spark).orderBy("id").collect()
    assert len(rows) == 5 and rows[4].quality_score == pytest.approx(1.0)
    assert rows[0].length == len(rows[0].text.split())


def test_sink_round_trips(spark, scratch):
    df = spark.createDataFrame([(1, 0, 0.5, 0.1), (1, 1, 0.7, 0.2), (2, 0, 0.1, 0.3)],
                               "run_id long, step long, reward_mean double, kl double")
    sinks.append_metric_log(df, f"{scratch}/log", ["run_id", "step"], ["reward_mean", "kl"])
    back = spark.read.parquet(f"{scratch}/log")
    assert back.count() == 6 and back.filter(F.col("run_id") == 2).count() == 2
    for fmt in ("json", "csv", "parquet"):
        sinks.export(df, f"{scratch}/x_{fmt}", fmt)
    assert spark.read.option("header", True).csv(f"{scratch}/x_csv").count() == 3
    assert spark.read.json(f"{scratch}/x_json").count() == 3
    with pytest.raises(ValueError):
        sinks.export(df, f"{scratch}/x", "pdf")


def test_j3_base_config_lookup(spark):
    from prefspark.operators import runs as R
    grid = spark.createDataFrame([("ppo", "hh"), ("rlaif", "hh")], "algorithm string, dataset string")
    cfg = spark.createDataFrame([("ppo", "training.batch_size", "4")], "algorithm string, path string, value string")
    ok, missing = R.base_config_lookup(grid, cfg)
    assert ok.count() == 1 and [r.algorithm for r in missing.collect()] == ["rlaif"]


def test_s11_save_generations(spark, scratch):
    g = spark.createDataFrame([(1, "a"), (2, "b")], "run_id long, text string")
    sinks.save_generations(g, f"{scratch}/gen")
    sinks.save_generations(g, f"{scratch}/gen")
    assert spark.read.parquet(f"{scratch}/gen").count() == 4


def test_config_names_runs_and_broken_configs_show(spark, scratch):
    root = os.path.join(scratch, "only_configs")
    _write(f"{root}/exp1/config.yaml", "algorithm: ppo\ndataset:\n  name: hh\n")
    _write(f"{root}/exp2/config.yaml", "a: [unclosed\n")
    _write(f"{root}/exp3/config.yaml", "")
    _write(f"{root}/exp4/experiment_summary.json", json.dumps(
        {"final_metrics": {"reward_mean": 1.0, "entropy": 2.0}, "config": {"algorithm": "dpo"}}))
    t = runs.results_projection(runfolders.scan_runs(spark, root).withColumnRenamed("run", "experiment_name"))
    got = {x.experiment_name: (x.algorithm, x.dataset, x.reward_mean, x.entropy, x.duration_hours) for x in t.collect()}
    assert got == {"exp1": ("ppo", "hh", 0, 0, 0), "exp2": ("unknown", "unknown", 0, 0, 0),
                   "exp3": ("unknown", "unknown", 0, 0, 0), "exp4": ("dpo", "unknown", 1.0, 2.0, 0)}
    cfg = runfolders.scan_configs(spark, root)
    missing = runs.missing_sections(cfg, ["algorithm"])
    assert sorted(x.run for x in missing.collect()) == ["exp2", "exp3"]
    over = spark.createDataFrame([("exp2", "seed", "1")], "run string, path string, value string")
    merged = runs.flatten_overrides(cfg.select("run", "path", "value"), over)
    assert all(x.path is not None for x in merged.collect())
    # nested final metrics of metrics.json replace the summary's
    _write(f"{root}/exp4/metrics.json", json.dumps({"final_metrics": {"reward_mean": 3.0}}))
    m = {x.run: x.metrics for x in runfolders.scan_runs(spark, root).collect()}["exp4"]
    assert m["reward_mean"] == 3.0 and "entropy" not in m


def test_run_folder_source_round_trip(spark, scratch):
    """Written and read by many tasks; null documents leave no file, empty
    ones an empty file, odd names and bytes stay."""
    n = 50
    docs = spark.range(0, n, 1, 6).select(
        F.concat(F.lit("run é "), F.col("id")).alias("run"), F.when(F.col("id") % 3 != 0, F.concat(F.lit("née\n"), F.col("id"))).alias("a"),
        F.when(F.col("id") % 5 == 0, "").otherwise("x").alias("b"))
    root = os.path.join(scratch, "folders")
    runsource.write_run_folders(docs, root, {"a": "a.txt", "b": "b.txt"})
    runsource.write_run_folders(docs, root, {"a": "a.txt"})            # again: the same files
    want = {(r.run, "a.txt"): r.a for r in docs.collect() if r.a is not None} | {(r.run, "b.txt"): r.b for r in docs.collect()}
    back = runsource.read_run_folders(spark, f"file://{root}", ["a.txt", "b.txt", "none.txt"], runs_per_task=7)
    assert back.rdd.getNumPartitions() == -(-n // 7)
    assert {(r.run, r.file): bytes(r.content).decode() for r in back.collect()} == want
    assert sum(len(os.listdir(os.path.join(root, d))) for d in os.listdir(root) if d != "_SUCCESS") == len(want)
    assert json.load(open(os.path.join(root, "_SUCCESS")))["files"] == sum(k[1] == "a.txt" for k in want)
    os.makedirs(os.path.join(scratch, "bare"))
    assert runsource.read_run_folders(spark, os.path.join(scratch, "bare"), ["a.txt"]).count() == 0
    bad = spark.createDataFrame([("../up", "x")], "run string, a string")
    with pytest.raises(Exception, match="not a folder"):
        runsource.write_run_folders(bad, root, {"a": "a.txt"})


def test_partitioned_write_makes_few_files(spark, scratch):
    df = spark.range(0, 2000, 1, 16).select((F.col("id") % 5).alias("run_id"), F.col("id").cast("string").alias("text"))
    sinks.save_generations(df, f"{scratch}/few")
    files = [f for _, _, names in os.walk(f"{scratch}/few") for f in names if f.endswith(".parquet")]
    assert len(files) == 5 and spark.read.parquet(f"{scratch}/few").count() == 2000


def test_entry_guard_hides_only_the_missing_folder(tmp_path):
    """Without the folders the entry point imports; a slip inside is an error."""
    import shutil
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in ("prefspark", "__spark_entry__.py"):
        src = os.path.join(root, name)
        if os.path.isdir(src):
            shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__", "llm"))
        else:
            shutil.copy(src, tmp_path / name)
    run = [sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run(run, cwd=tmp_path, capture_output=True, text=True, env=env)
    assert out.returncode == 0 and int(out.stdout.split()[-1]) > 100, out.stderr
    (tmp_path / "prefspark" / "llm").mkdir()
    (tmp_path / "prefspark" / "llm" / "__init__.py").write_text("")
    (tmp_path / "prefspark" / "llm" / "queries.py").write_text("import no_such_package\n")
    out = subprocess.run(run, cwd=tmp_path, capture_output=True, text=True, env=env)
    assert out.returncode != 0 and "no_such_package" in out.stderr
