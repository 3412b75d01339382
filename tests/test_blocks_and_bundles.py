"""Fits and moments added up in blocks, running totals over ranges, versions and bundles, malformed cells."""

import json
import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.functions.expr import threshold_label
from strata.operators import blocks as blocks_module
from strata.operators import classify, cluster, distribution, explore, features, metrics, missing, profile, reshape
from strata.operators.score import Scorer
from strata.plans import models, wide
from strata.sources import csv_rejects, read_csv
from strata.sources.versions import Conflict, VersionedTable, load_scorer, save_scorer

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def points(spark, n=400, d=3, seed=1, centres=4):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d)) + r.integers(0, centres, n)[:, None] * 6
    cols = [f"f{i}" for i in range(d)]
    return x, cols, spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], "id long, " + ", ".join(f"{c} double" for c in cols))


# --- k-means ---------------------------------------------------------------------------------------
def test_all_restarts_end_in_means_of_their_members(spark):
    x, cols, df = points(spark)
    with cluster._blocks(df, cols, "id") as b:
        fits = cluster.kmeans_all(b, 3, [(k, r) for k in (2, 4, 5) for r in range(3)], tol=0.0)
    for f in fits:
        label = ((x[:, None] - f.centres) ** 2).sum(axis=2).argmin(axis=1)
        assert f.converged and np.allclose(f.centres, [x[label == j].mean(axis=0) for j in range(f.k)])
        assert f.sizes.tolist() == np.bincount(label, minlength=f.k).tolist()
        assert f.cost == pytest.approx(((x - f.centres[label]) ** 2).sum())
    best = cluster.kmeans_best_of(df, cols, 4, 3, key="id")
    assert best.cost <= min(f.cost for f in fits if f.k == 4) + 1e-3 and best.converged
    true = np.array([x[np.abs(x - 6 * c).max(axis=1) < 5].mean(axis=0) for c in range(4)])
    assert np.allclose(sorted(best.centres), sorted(true.tolist()), atol=0.5)


def test_restarts_do_not_depend_on_partitions(spark, monkeypatch):
    _, cols, df = points(spark)
    one = cluster.k_sweep(df.repartition(1), cols, [2, 3], 3, key="id").collect()
    monkeypatch.setattr(blocks_module, "DIRECT", 2)  # groups of tasks add up first
    monkeypatch.setattr(blocks_module, "ROWS", 7)
    many = cluster.k_sweep(df.repartition(9), cols, [2, 3], 3, key="id").collect()
    assert [r.k for r in one] == [2, 3]
    assert all(a.cost == pytest.approx(b.cost) and a.silhouette_sq == pytest.approx(b.silhouette_sq) for a, b in zip(one, many))
    frame = cluster.kmeans_best_of(df, cols, 3, 3, key="id").transform(df, "c")
    assert many[1].silhouette_sq == pytest.approx(cluster.silhouette_sq(frame, cols, "c"))


def test_one_array_a_pass_goes_to_the_driver(spark, monkeypatch):
    frame, collected = type(spark.range(0)), []
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: collected.append(collect(self)) or collected[-1])
    for fan, tasks in ((32, 1), (32, 9), (32, 40), (2, 9)):  # one level of groups, and several
        monkeypatch.setattr(blocks_module, "DIRECT", fan)
        with blocks_module.Blocks(spark.range(0, 200, 1, tasks), ["id"], keep=False) as b:
            assert b.sum(lambda x: np.array([len(x), x.sum()]), 2).tolist() == [200, 19900]
    with blocks_module.Blocks(spark.range(0), ["id"], keep=False) as b:
        assert b.sum(lambda x: np.ones(2), 2).tolist() == [0, 0]
    assert [len(rows) for rows in collected] == [1, 1, 1, 1, 0]


def test_a_cut_fit_says_so_and_odd_rows_are_left_out(spark):
    _, cols, df = points(spark)
    assert not cluster.kmeans_best_of(df, cols, 4, 2, max_iter=1, key="id").converged
    odd = df.unionByName(spark.createDataFrame([(900, float("nan"), 1.0, 1.0), (901, None, 1.0, 1.0)], df.schema))
    assert cluster.kmeans_best_of(odd, cols, 2, 2, key="id").centres == cluster.kmeans_best_of(df, cols, 2, 2, key="id").centres
    same = spark.createDataFrame([(i, 1.0) for i in range(5)], "id long, x double")  # fewer values than clusters
    assert cluster.kmeans_best_of(same, ["x"], 3, 2, key="id").cost == 0
    with pytest.raises(ValueError):
        cluster.kmeans_best_of(same.where("id < 0"), ["x"], 2)


def test_registered_sweep_runs_whole(spark):
    swept = models.k_sweep(spark, SF).orderBy("k").collect()
    assert [r.k for r in swept] == list(range(2, 11)) and all(r.converged for r in swept)
    assert all(a.cost > b.cost for a, b in zip(swept, swept[1:]))


def test_euclidean_silhouette_of_a_sample(spark):
    x, cols, df = points(spark, 500)
    df = df.withColumn("c", (F.col("f0") > 9).cast("int") + (F.col("f0") > 3).cast("int"))
    c = np.array([r.c for r in df.orderBy("id").collect()])
    dist = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2))
    s = []
    for i in range(len(x)):
        a = dist[i][c == c[i]].sum() / max(1, (c == c[i]).sum() - 1)
        b = min(dist[i][c == k].mean() for k in set(c) if k != c[i])
        s.append((b - a) / max(a, b))
    whole = cluster.silhouette_euclidean(df, cols, "c").first()
    assert whole.silhouette == pytest.approx(np.mean(s)) and whole.standard_error == 0 and whole.n_scored == whole.n == 500
    part = cluster.silhouette_euclidean(df.repartition(3), cols, "c", sample=100).first()
    assert part.n_scored == 100 and abs(part.silhouette - np.mean(s)) < 4 * part.standard_error
    assert cluster.silhouette_euclidean(df.where("c = 0"), cols, "c").first().silhouette is None


def mean_silhouette(x, c):
    """By all pairs, feature by feature; a cluster of one row scores 0."""
    sizes, s = np.bincount(c), []
    for i in range(0, len(x), 500):
        dist = np.sqrt(sum((x[i:i + 500, f, None] - x[:, f]) ** 2 for f in range(x.shape[1])))
        sums = np.array([dist[:, c == j].sum(axis=1) for j in range(len(sizes))])
        own, at = c[i:i + 500], np.arange(len(dist))
        a, mean = sums[own, at] / np.maximum(sizes[own] - 1, 1), sums / sizes[:, None]
        mean[own, at] = np.inf
        b = mean.min(axis=0)
        s.append(np.where(sizes[own] > 1, (b - a) / np.maximum(a, b), 0))
    return np.concatenate(s).mean()


def test_registered_euclidean_silhouette_scores_every_row(spark, tmp_path):
    n = 20_500
    r = np.random.default_rng(3)
    rows = [(i, int(size), float(price)) for i, size, price in zip(range(n), r.integers(1, 51, n), r.integers(90_000, 210_000, n) / 100)]
    spark.createDataFrame(rows, "p_partkey long, p_size int, p_retailprice double").repartition(3).write.parquet(f"{tmp_path}/part.parquet")
    got = wide.silhouette_euclidean(spark, str(tmp_path)).first()
    assert (got.n_scored, got.n, got.standard_error) == (n, n, 0)
    x = np.array([(size / 10, price / 1000) for _, size, price in rows])
    assert got.silhouette == pytest.approx(mean_silhouette(x, np.array([size % 3 for _, size, _ in rows])), abs=1e-6)


@pytest.mark.parametrize("tile, tasks, piece", [(65_536, 10_000, 2 ** 15), (70, 10_000, 2 ** 15), (70, 4, 50)])
def test_euclidean_silhouette_does_not_depend_on_blocks(spark, monkeypatch, tile, tasks, piece):
    for name, value in (("TILE", tile), ("TILE_TASKS", tasks), ("PIECE_NUMBERS", piece)):
        monkeypatch.setattr(cluster, name, value)
    x, cols, _ = points(spark, 600, 3)
    x[100:160] = x[0]  # rows alike
    c = np.where(np.arange(600) < 450, 0, np.arange(600) % 3)
    c[599] = 3  # a cluster of its own
    rows = [(*map(float, p), "abcd"[k]) for p, k in zip(x, c)] + [(1.0, None, 1.0, "a"), (1.0, float("nan"), 1.0, "b"), (1.0, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, ", ".join(f"{f} double" for f in cols) + ", c string")
    for frame in (df, df.repartition(7), df.coalesce(1)):
        got = cluster.silhouette_euclidean(frame, cols, "c").first()
        assert got.silhouette == pytest.approx(mean_silhouette(x, c), rel=1e-12) and got.n_scored == got.n == 600
    some = cluster.silhouette_euclidean(df, cols, "c", sample=200).first()
    assert some.n_scored == 200 and some.n == 600 and abs(some.silhouette - mean_silhouette(x, c)) < 4 * some.standard_error


def test_distances_of_near_points_far_from_zero():
    r = np.random.default_rng(5)
    x, y = r.normal(size=(2, 70)), r.normal(size=(2, 9000))
    for at in (0.0, 2.0 ** 30):
        near, far = np.round(x * 2 ** 16) / 2 ** 16, np.round(y * 2 ** 16) / 2 ** 16  # exact after the shift
        to_x, to_y = np.ones(70), np.ones(9000)
        cluster._add_distances(near + at, far + at, to_x, to_y)
        dist = np.hypot(near[0][:, None] - far[0], near[1][:, None] - far[1])
        assert np.allclose(to_x, 1 + dist.sum(axis=1), rtol=1e-12) and np.allclose(to_y, 1 + dist.sum(axis=0), rtol=1e-12)


# --- wide fits -----------------------------------------------------------------------------------------
def test_wide_newton_has_no_gradient_left(spark):
    d = wide._labelled(spark, SF)
    m = classify.logistic_newton(d, wide.FEATS, "y", C=10.0)
    rows = np.array([tuple(r)[1:] for r in d.collect()], float)
    x = np.column_stack([rows[:, 1:], np.ones(len(rows))])
    beta = np.array([*m.coef, m.intercept])
    g = beta + 10 * x.T @ (1 / (1 + np.exp(-x @ beta)) - rows[:, 0])
    assert m.info["converged"] and np.abs(g).max() < 1e-6


def test_a_fit_without_convergence_is_an_error(spark):
    d = wide._labelled(spark, SF)
    with pytest.raises(classify.NotConverged):
        classify.logistic_newton(d, wide.FEATS, "y", max_iter=2)
    assert not classify.logistic_newton(d, wide.FEATS, "y", max_iter=2, strict=False).info["converged"]
    with pytest.raises(classify.NotConverged):
        classify.logistic_ml(d, wide.FEATS, "y", max_iter=1)


def test_newton_halves_steps_that_overshoot(spark):
    rows = [(float(x), int(x > 0)) for x in (-1000, -900, -1, 1, 2, 1000, 1100, 5000)] + [(3.0, 0)]
    m = classify.logistic_newton(spark.createDataFrame(rows, "x double, y int"), ["x"], "y", C=1000.0)
    assert m.info["converged"]


def test_correlation_of_pairs_that_never_meet_and_of_constants(spark):
    df = spark.createDataFrame([(1.0, None, 0.1, float("inf")), (2.0, None, 0.1, 1.0), (None, 3.0, 0.1, 2.0), (4.0, 5.0, 0.1, 3.0)],
                               "a double, b double, c double, d double")
    got = {(r.col_x, r.col_y): r["corr"] for r in profile.corr_matrix(df, df.columns).collect()}
    assert got["a", "a"] == pytest.approx(1) and got["a", "b"] is None and got["c", "c"] is None and got["a", "d"] is None


def test_density_has_no_generator_and_leaves_infinities_out(spark):
    df = spark.createDataFrame([(float(i),) for i in range(50)], "x double")
    odd = df.unionByName(spark.createDataFrame([(float("inf"),), (float("nan"),)], "x double"))
    a, b = ([r.density for r in distribution.density_curve(d, "x").collect()] for d in (df, odd))
    assert a == pytest.approx(b) and len(a) == 200


# --- running totals ---------------------------------------------------------------------------------------
def test_curve_and_auc_over_thousands_of_ranges(spark):
    r = np.random.default_rng(3)
    score, y = r.integers(0, 8000, 20_000), r.integers(0, 2, 20_000)
    df = spark.createDataFrame(list(zip(score.tolist(), y.tolist())), "s long, y int")
    few, many = (metrics.roc_curve(df, "y", "s", ranges=n).orderBy("i").collect() for n in (1, 5000))
    assert few == many and len(few) > 4000
    a, b = (metrics.roc_auc(df, "y", "s", ranges=n).first().auc for n in (1, 5000))
    order = np.argsort(score)
    below = np.searchsorted(np.sort(score[y == 0]), score[y == 1], "left") + np.searchsorted(np.sort(score[y == 0]), score[y == 1], "right")
    assert a == pytest.approx(b) == pytest.approx(below.sum() / 2 / (y.sum() * (1 - y).sum())) and len(order)


def test_confusion_of_many_classes(spark):
    df = spark.range(3000).select((F.col("id") % 1500).alias("a"), (F.col("id") % 1499).alias("p"))
    got = metrics.confusion(df, "a", "p")
    assert got.count() == df.distinct().count() and got.agg(F.sum("count")).first()[0] == 3000
    small = metrics.confusion(df.where("a < 3"), "a", "p", labels=[77]).collect()
    classes = {r.actual for r in small}
    assert 77 in classes and len(small) == len(classes) ** 2


def test_few_distinct_values(spark):
    df = spark.range(10_000).select((F.col("id") % 7).alias("a"), F.when(F.col("id") % 2 == 0, F.lit(float("nan"))).otherwise(1.0).alias("b"), "id")
    assert reshape.few_distinct(df, "a", 10) == [float(i) for i in range(7)] and reshape.few_distinct(df, "b", 10) == [1.0]
    assert reshape.few_distinct(df, "id", 10) is None and reshape.few_distinct(df, "a", 6) is None


def test_weights_and_baseline_of_many_classes(spark):
    df = spark.range(5000).select((F.col("id") % 1700).alias("y"), F.lit("own").alias("weight"))
    w = classify.with_class_weight(df, "y")
    assert w.count() == 5000 and w.where("y = 0").first().weight == pytest.approx(5000 / (1700 * 3))
    assert classify.majority_baseline(df, "y")[0] == 0
    gone = classify.with_class_weight(spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "y double"), "y").collect()
    assert [r.weight for r in gone] == [1.0, None, None]


# --- NaN, infinities, decimals ------------------------------------------------------------------------------
def test_one_rule_for_nan(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (0.9,)], "x double")
    assert [r.l for r in df.select(threshold_label("x").alias("l")).collect()] == [None, None, "Survived"]
    model = classify.LogisticModel(["x"], [1.0], 0.0)
    assert [r.prediction for r in model.transform(df).collect()] == [None, None, 1]
    scorer = Scorer(scaler=None, kmeans=cluster.KMeansModel(["x"], [[0.0], [1.0]]), logistic=model)
    assert [(r.x is None or r.x != r.x, r.cluster, r.prediction) for r in scorer.transform(df, keep=["x"]).collect()] == [
        (True, 0, "Deceased"), (True, 0, "Deceased"), (False, 1, "Survived")]
    scorer.missing = "null"
    assert [(r.cluster, r.prediction) for r in scorer.transform(df).collect()] == [(None, None), (None, None), (1, "Survived")]


def test_infinite_values_in_bins(spark):
    inf = float("inf")
    df = spark.createDataFrame([(float(i), i % 2) for i in range(20)] + [(inf, 1), (-inf, 0)], "x double, g int")
    got = {r.bin: r["count"] for r in distribution.histogram(df, "x", bins=4).collect()}
    assert got == {0: 6, 1: 5, 2: 5, 3: 6} and distribution.histogram(df, "x", bins="auto").agg(F.sum("count")).first()[0] == 22
    only = distribution.histogram(df.where("x > 1e9"), "x", by="g")
    assert only.columns == ["bin", "bin_lo", "bin_hi", "g", "count"] and only.count() == 0
    assert [r.x_bin for r in reshape.bin_equal_width(df, "x", 2).collect()][-2:] == [2, 1]


def test_decimal_means_keep_their_fraction(spark):
    df = spark.createDataFrame([(1,), (2,), (4,), (None,)], "n int").select(F.col("n").cast("decimal(10,0)").alias("n"))
    assert float(missing.fill_mean(df).collect()[3].n) == pytest.approx(7 / 3)
    cents = spark.createDataFrame([("1.50",), ("2.50",), (None,)], "n string").select(F.col("n").cast("decimal(10,2)").alias("n"))
    assert missing.fill_mean(cents).schema["n"].dataType.simpleString() == "decimal(10,2)"


def test_scatter_samples_without_a_key(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("x"), F.lit(1.0).alias("y"), F.lit(0).alias("cluster"))
    n = explore.scatter(df, "x", "y", fraction=0.5).count()
    assert 400 < n < 600 and n == explore.scatter(df.repartition(7), "x", "y", fraction=0.5).count()


# --- versions, bundles, CSV ------------------------------------------------------------------------------------
def test_a_table_is_replaced_whole_or_not_at_all(spark, tmp_path):
    store = VersionedTable(spark, f"file://{tmp_path}/t")
    with pytest.raises(FileNotFoundError):
        store.read()
    store.write(spark.range(5))

    def killed(df):
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        store.replace(killed)
    folder = store.stage(store.read().where("id < 2"))  # a job that dies before it publishes
    assert store.read().count() == 5 and store.versions() == [1]
    store.replace(lambda d: d.where("id > 1"))
    with pytest.raises(Conflict):
        store.publish(folder, after=1)
    assert sorted(r.id for r in store.read().collect()) == [2, 3, 4] and store.read(1).count() == 5
    assert store.expire(keep=1) == 1 and store.versions() == [2] and store.read().count() == 3


def test_a_bundle_comes_back_whole(spark, tmp_path):
    part = spark.read.parquet(f"{SF}/part.parquet")
    f = ["p_size", "p_retailprice"]
    scorer = Scorer(features.fit_scaler(part, f), cluster.KMeansModel(f, [[0.0, 0.0], [1.0, 1.0]], cost=2.0), classify.LogisticModel(f, [0.5, -1.0], 0.1, 2.0),
                    threshold=0.4, inclusive=True, positive="p", negative="n", band_names=["a", "b", "c", "d"], risk_rules=[("p_size", "<", 25)],
                    imputer=missing.fit_mean_imputer(part, f), pca=features.fit_pca(part, f, 2), missing="null")
    root = f"file://{tmp_path}/scorer"
    save_scorer(spark, scorer, root)
    back = load_scorer(spark, root)
    assert json.loads(json.dumps(back.params())) == json.loads(json.dumps(scorer.params()))
    a, b = (s.transform(part, keep=["p_partkey"]).orderBy("p_partkey").collect() for s in (scorer, back))
    assert a == b and np.allclose(back.pca.components, scorer.pca.components)
    with pytest.raises(ValueError):
        Scorer.from_params({**scorer.params(), "format": 99})


def test_malformed_cells_fail_or_are_listed(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("n,x,s\n1,2.5,a\n12abc,NA,b\n3,oops,NA\n4,1.0\n5,NaN,e,f\n")
    schema = "n int, x double, s string"
    with pytest.raises(Exception, match="12abc"):
        read_csv(spark, str(path), schema).where("s = 'b'").collect()
    got = read_csv(spark, str(path), schema, on_malformed="null").collect()
    assert [tuple(r) for r in got] == [(1, 2.5, "a"), (None, None, "b"), (3, None, None), (4, 1.0, None), (5, None, "e")]
    bad = sorted((r.column or "", r.raw) for r in csv_rejects(spark, str(path), schema).collect())
    assert bad == [("", "4,1.0"), ("", "5,NaN,e,f"), ("n", "12abc"), ("x", "oops")]


# --- executors without the library ---------------------------------------------------------------------------------
def test_workers_need_no_copy_of_the_library(tmp_path):
    script = tmp_path / "job.py"
    script.write_text(f"""
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
spark.sparkContext.setCheckpointDir({str(tmp_path / 'ck')!r})
sys.path.insert(0, {ROOT!r})  # on the driver's path only
def absent(batches):
    import importlib.util
    assert importlib.util.find_spec("strata") is None
    yield from batches
spark.range(3).mapInArrow(absent, "id long").collect()
from strata.plans import catalog
for name in ("kmeans_best_of_restarts", "grid_search_wide", "corr_matrix", "density_curve", "silhouette_euclidean", "explore_bar_binned"):
    print(name, catalog.QUERIES[name](spark, {SF!r}).count())
""")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert out.returncode == 0, out.stderr[-2000:]
    assert "grid_search_wide 9" in out.stdout


# --- exact samples ---------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("ranked", [200_000, 5])
def test_exact_samples_by_sorting(spark, monkeypatch, ranked):
    monkeypatch.setattr(reshape, "RANKED", ranked)
    monkeypatch.setattr(reshape, "CUT_BUCKETS", 16)
    df = spark.range(3000).select(F.when(F.col("id") % 100 != 7, F.col("id")).alias("id"))
    for method in ("arith", "xxhash64"):
        order = df.where("id IS NOT NULL").select("id", reshape.hash_column("id", 42, method).alias("h")).orderBy("h", "id").collect()
        got = {r.id for r in reshape.sample_exact(df, "id", 0.2, method=method).collect()}
        assert got == {r.id for r in order[:600]}
        split = reshape.split_train_test(df, "id", 0.25, method=method)
        assert {r.id for r in split.where("is_test").collect()} == {r.id for r in order[:750]} and split.count() == 3000
    clash = spark.range(1000).select((F.col("id") * 1000003).alias("id"))  # one arithmetic hash
    assert {r.id for r in reshape.sample_exact(clash, "id", 0.3, method="arith").collect()} == {i * 1000003 for i in range(300)}
    assert reshape.sample_exact(df, "id", 0.0).count() == 0 and reshape.sample_exact(df.where("id < 0"), "id", 0.5).count() == 0
    assert reshape.flag_first_m(df, "id", 10 ** 6).where("in_sample").count() == 2970
