"""Skew-safe helpers against brute force on fixtures with one hot group."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from prefspark.operators import report, steps
from prefspark.operators.pareto import not_dominated, pareto_front
from prefspark.plans.recurrence import discounted_prefix, discounted_suffix
from prefspark.plans.scan import Running, row_index, running, with_chunk
from prefspark.plans.selection import top_n


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(7)
    # run 0 holds a third of all rows; the rest spread over 40 runs
    runs = np.concatenate([np.zeros(1500, dtype=int), rng.integers(1, 41, 3000)])
    ts = rng.permutation(len(runs)).astype(np.int64) * 1000 + rng.integers(0, 999, len(runs))
    pdf = pd.DataFrame({"run_id": runs, "ts": ts, "event_id": np.arange(len(runs)),
                        "v": np.round(rng.normal(50, 20, len(runs)), 2)})
    return spark.createDataFrame(pdf), pdf


def test_row_index_matches_row_number(spark, skewed):
    df, _ = skewed
    got = row_index(df, ["run_id"], ["ts", "event_id"], "idx", chunks=8)
    ref = df.withColumn("rn", F.row_number().over(Window.partitionBy("run_id").orderBy("ts", "event_id")) - 1)
    j = got.join(ref, ["run_id", "event_id"])
    assert j.filter("idx != rn").count() == 0 and j.count() == df.count()


def test_running_aggregates(spark, skewed):
    df, pdf = skewed
    out = running(df, ["run_id"], ["ts", "event_id"],
                  {"cmax": Running("max", "v"), "csum_prev": Running("sum", "v", inclusive=False),
                   "cmin": Running("min", "v")}, chunks=8).toPandas()
    p = pdf.sort_values(["run_id", "ts", "event_id"])
    g = p.groupby("run_id")["v"]
    exp = p.assign(cmax=g.cummax(), cmin=g.cummin(), csum_prev=g.cumsum() - p["v"])
    m = out.merge(exp, on="event_id", suffixes=("", "_e"))
    assert np.allclose(m.cmax, m.cmax_e) and np.allclose(m.cmin, m.cmin_e)
    first = m.groupby("run_id")["ts"].transform("min") == m["ts"]
    assert m.loc[first, "csum_prev"].isna().all()
    assert np.allclose(m.loc[~first, "csum_prev"], m.loc[~first, "csum_prev_e"])


def _indexed(spark, skewed):
    df, _ = skewed
    return row_index(df, ["run_id"], ["ts", "event_id"], "step")


def test_discounted_suffix_and_prefix(spark, skewed):
    d = _indexed(spark, skewed)
    # small chunks force many halo boundaries inside the hot run
    s = discounted_suffix(d, ["run_id"], "step", "v", 0.9, "g", chunk=400).toPandas()
    p = discounted_prefix(d, ["run_id"], "step", "v", 0.9, "e", chunk=400).toPandas()
    for run, grp in s.groupby("run_id"):
        g = grp.sort_values("step")
        v = g["v"].to_numpy()
        ref = np.zeros_like(v)
        acc = 0.0
        for i in range(len(v) - 1, -1, -1):
            acc = v[i] + 0.9 * acc
            ref[i] = acc
        assert np.allclose(g["g"].to_numpy(), ref, rtol=1e-9, atol=1e-9), run
    for run, grp in p.groupby("run_id"):
        g = grp.sort_values("step")
        v = g["v"].to_numpy()
        ref, acc = np.zeros_like(v), 0.0
        for i in range(len(v)):
            acc = v[i] + 0.9 * acc
            ref[i] = acc
        assert np.allclose(g["e"].to_numpy(), ref, rtol=1e-9, atol=1e-9), run


def test_moving_baseline_with_halo(spark, skewed):
    d = _indexed(spark, skewed)
    got = steps.moving_baseline(d, reward="v", window=100).toPandas()
    for run, grp in got.groupby("run_id"):
        g = grp.sort_values("step")
        ref = g["v"].shift(1).rolling(100, min_periods=1).mean()
        assert np.allclose(g["baseline"].fillna(-1), ref.fillna(-1)), run


def test_pareto_against_pairwise(spark):
    rng = np.random.default_rng(3)
    n = 400
    pdf = pd.DataFrame({"g": rng.integers(0, 3, n), "name": [f"e{i}" for i in range(n)],
                        "r": np.round(rng.random(n), 2), "d": np.round(rng.random(n) * 10, 1)})
    got = {r.name for r in pareto_front(spark.createDataFrame(pdf), "g", "r", "d").collect()}
    exp = set()
    for _, p in pdf.iterrows():
        same = pdf[pdf.g == p.g]
        dom = ((same.r >= p.r) & (same.d <= p.d) & ((same.r > p.r) | (same.d < p.d))).any()
        if not dom:
            exp.add(p["name"])
    assert got == exp


def test_curriculum_against_percent_rank(spark):
    pdf = pd.DataFrame({"id": range(300), "difficulty": np.random.default_rng(1).integers(0, 40, 300)})
    from prefspark.operators.prep import curriculum_stage
    got = curriculum_stage(spark.createDataFrame(pdf), "difficulty").toPandas().set_index("id")
    rank = pdf.difficulty.rank(method="min") - 1
    pr = rank / (len(pdf) - 1)
    assert np.allclose(got.loc[pdf.id, "pct_rank"].to_numpy(), pr.to_numpy())


def test_quartiles_with_heavy_ties(spark):
    rng = np.random.default_rng(5)
    g = np.concatenate([np.zeros(3000, dtype=int), rng.integers(1, 6, 1500)])
    v = np.round(rng.integers(0, 7, len(g)) * 0.5, 1)          # few distinct values
    pdf = pd.DataFrame({"g": g, "v": v})
    got = report.quartiles(spark.createDataFrame(pdf), "g", "v").toPandas().set_index("g")
    exp = pdf.groupby("g")["v"].quantile([0.25, 0.5, 0.75]).unstack()
    assert np.allclose(got.loc[exp.index, ["q1", "median", "q3"]].to_numpy(), exp.to_numpy())


def test_rank_with_ties_matches_stable_sort(spark):
    from prefspark.operators.pairs import rank_feedback
    rng = np.random.default_rng(9)
    n = 2000
    pdf = pd.DataFrame({"prompt": np.where(rng.random(n) < 0.6, "hot", rng.choice(["a", "b", "c"], n)),
                        "resp_idx": np.arange(n), "score": rng.integers(0, 4, n) / 4.0})
    got = rank_feedback(spark.createDataFrame(pdf)).toPandas().set_index("resp_idx")["rank"]
    exp = (pdf.sort_values(["prompt", "score", "resp_idx"], ascending=[True, False, True])
              .assign(rank=lambda d: d.groupby("prompt").cumcount() + 1).set_index("resp_idx")["rank"])
    assert (got.loc[exp.index] == exp).all()


def test_running_fixed_width_chunks(spark, skewed):
    d = _indexed(spark, skewed)
    got = running(d, ["run_id"], ["step"], {"m": Running("max", "v", inclusive=False)}, width=97).toPandas()
    p = got.sort_values(["run_id", "step"])
    exp = p.groupby("run_id")["v"].transform(lambda s: s.shift(1).cummax())
    assert np.allclose(p["m"].fillna(-1e9), exp.fillna(-1e9))


def _chunk_sizes(df, key, n):
    return [r["count"] for r in with_chunk(df, key, n, "c").groupBy("c").count().collect()]


def test_hot_run_is_split_across_chunks(spark, skewed):
    df, pdf = skewed
    hot = int((pdf.run_id == 0).sum())
    assert hot * 3 >= len(pdf)                     # run 0 holds a third of all rows
    sizes = _chunk_sizes(df, F.struct("run_id", "ts", "event_id"), 16)
    assert len(sizes) == 16 and max(sizes) <= 2 * len(pdf) / 16
    # fixed-width chunks over a step index split a long run too
    d = _indexed(spark, skewed).filter("run_id = 0")
    got = running(d, ["run_id"], ["step"], {"m": Running("count")}, width=256).agg(F.max("m")).first()[0]
    assert got == hot


@pytest.mark.parametrize("key", ["far", "text", "ties", "null"])
def test_no_chunk_above_twice_the_mean(spark, key):
    """An outlier, text keys with a common head, a first order column of few
    values and mostly null keys do not gather rows in one chunk."""
    n = 20_000
    i = F.col("id")
    order = {"far": F.when(i == 0, F.lit(10 ** 17)).otherwise(i * i), "text": F.format_string("customer-run-%09d", i),
             "ties": i % 3, "null": F.when(i % 10 == 0, i)}[key]
    df = spark.range(0, n, 1, 5).withColumn("o", order)
    sizes = _chunk_sizes(df, F.struct("o", "id"), 16)
    assert sum(sizes) == n and max(sizes) <= 2 * n / 16
    got = row_index(df, [], ["o", "id"], "idx", chunks=16).toPandas().sort_values("idx")
    assert got["idx"].tolist() == list(range(n))
    want = df.orderBy("o", "id").toPandas()
    assert got["id"].tolist() == want["id"].tolist()


def test_group_totals_beside_running_sums(spark, skewed):
    df, pdf = skewed
    got = running(df, ["run_id"], ["ts", "event_id"], {"c": Running("count"), "n": Running("count", whole=True), "m": Running("max", "v", whole=True)},
                  chunks=8).toPandas().set_index("event_id")
    g = pdf.groupby("run_id")["v"]
    exp = pdf.assign(n=g.transform("size"), m=g.transform("max")).set_index("event_id")
    assert (got.loc[exp.index, "n"] == exp["n"]).all() and np.allclose(got.loc[exp.index, "m"], exp["m"])


@pytest.mark.parametrize("epsilon", [0.0, 0.1, {"a": 0.25, "b": 0.0, "c": 0.5}])
def test_pareto_three_objectives(spark, epsilon, monkeypatch):
    """Against all pairs, with many tasks, blocks and rows passed on early."""
    from prefspark.operators import pareto
    monkeypatch.setattr(pareto, "BLOCK_POINTS", 7)
    rng = np.random.default_rng(11)
    n = 900
    pdf = pd.DataFrame({"g": rng.choice(["x", "y", None], n, p=[0.6, 0.3, 0.1]), "name": np.arange(n)})
    for c in "abc":
        pdf[c] = np.round(rng.random(n), 2)
    pdf.loc[:20, "a"] = np.nan
    pdf = pd.concat([pdf, pdf.assign(name=pdf.name + n)])       # every row twice
    df = spark.createDataFrame(pdf).withColumn("a", F.when(~F.isnan("a"), F.col("a")))
    got = {r.name for r in pareto_front(df.repartition(6), "g", ["a", "b"], "c", epsilon).collect()}
    use = pdf[pdf.g.notna() & pdf.a.notna()].reset_index(drop=True)
    eps = epsilon if isinstance(epsilon, dict) else dict.fromkeys("abc", epsilon)
    v = np.column_stack([use.a, use.b, -use.c])
    box = np.column_stack([np.floor(v[:, k] / e) if (e := eps[c]) else v[:, k] for k, c in enumerate("abc")])
    exp = set()
    for i in range(len(use)):
        q = (use.g == use.g[i]).to_numpy()
        bigger = (box >= box[i]).all(1) & (box > box[i]).any(1)
        inside = (box == box[i]).all(1) & (v >= v[i]).all(1) & (v > v[i]).any(1)
        if not (q & (bigger | inside)).any():
            exp.add(use.name[i])
    assert got == exp and 0 < len(got) < n


def test_front_that_is_everything(spark):
    """Rows on a line trade off: none goes, also when tasks pass rows on."""
    x = np.arange(3000.0)
    v = np.column_stack([x, -x])
    assert len(not_dominated(np.zeros(3000, int), v, v)) == 3000
    df = spark.range(3000).select(F.lit(1).alias("g"), F.col("id").alias("a"), F.col("id").alias("b"))
    assert pareto_front(df, "g", "a", "b").count() == 3000
    assert pareto_front(df.limit(0), "g", "a", "b").count() == 0


@pytest.mark.parametrize("sample", [64, 400, 1 << 16])
@pytest.mark.parametrize("largest", [False, True])
def test_top_n_of_hot_runs(spark, sample, largest):
    """Exact with a sample of any size; only little more than n rows of the
    hot run are ranked."""
    n = 30_000
    df = spark.range(0, n, 1, 6).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 1000 == 1, F.lit(None)).otherwise(
        F.concat(F.lit("r"), F.col("id") % 50)).alias("run"), F.when(F.col("id") % 7 != 0, F.col("id") * 7919 % 10007).alias("k"), F.col("id"))
    got = top_n(df, ["run"], F.struct("k", "id"), 300, largest, sample).toPandas()
    pdf = df.toPandas()
    pdf["s"] = pdf.k.fillna(-1)                                # nulls first
    pdf = pdf.sort_values(["s", "id"], ascending=not largest)
    exp = pdf.groupby("run", dropna=False).head(300)
    assert sorted(got.id) == sorted(exp.id)


def test_top_n_ranks_few_rows_of_a_hot_run(spark):
    from prefspark.plans import selection
    n = 200_000
    df = spark.range(0, n, 1, 8).select((F.col("id") < 0).cast("string").alias("run"), F.xxhash64("id").alias("k"), "id")
    ranked = top_n(df, ["run"], F.struct("k", "id"), 500, sample=8192)
    ranked.collect()
    before = ranked._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in before
    rows = df.withColumns({"__g": F.struct("run"), "__k": F.struct("k", "id")})
    b = selection._bounds(rows.select("__g", "__k"), 500, False, 8192).first()
    left = [rows.where(F.col("__k") <= F.struct(F.lit(b[f"__t{i}"][0]).alias("k"), F.lit(b[f"__t{i}"][1]).alias("id"))).count() for i in range(4)]
    assert min(x for x in left if x >= 500) <= 1000


@pytest.mark.parametrize("decay", [1.0, 0.999, 0.5, 1e-3, 1e-300, 0.0])
def test_recurrences_keep_every_term(spark, decay):
    n = 900
    v = np.random.default_rng(5).random(n)
    v[n - 5] = v[4] = 1e20
    d = spark.createDataFrame(pd.DataFrame({"run_id": [None if i % 2 else 1.0 for i in range(2 * n)],
                                            "step": np.arange(2 * n) // 2, "v": np.repeat(v, 2)}))
    back, ahead = np.zeros(n), np.zeros(n)
    acc = 0.0
    for i in range(n - 1, -1, -1):
        back[i] = acc = v[i] + decay * acc
    acc = 0.0
    for i in range(n):
        ahead[i] = acc = v[i] + decay * acc
    for fn, want in ((discounted_suffix, back), (discounted_prefix, ahead)):
        got = fn(d, ["run_id"], "step", "v", decay, "y", chunk=70).toPandas()
        assert len(got) == 2 * n and list(got.columns) == ["run_id", "step", "v", "y"]
        for _, g in got.groupby("run_id", dropna=False):
            assert np.allclose(g.sort_values("step")["y"], want, rtol=1e-9, atol=0)
