"""Properties of the iterative / fitted operators, checked against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.operators import classify, cluster, features, metrics, quantiles, reshape

SF = "/root/testdata/sf0.001"


def test_quantiles_match_numpy_through_refinement(spark, monkeypatch):
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    vals = np.array([r.l_extendedprice for r in li.select("l_extendedprice").collect()])
    # force several refinement passes with tiny finish size and few buckets
    monkeypatch.setattr(quantiles.kth_smallest, "__defaults__", (4, 3, 60))
    q = {r.prob: r.value for r in quantiles.quantiles(li, ["l_extendedprice"], [0.0, 0.1, 0.5, 0.9, 1.0]).collect()}
    for p, v in q.items():
        assert v == pytest.approx(float(np.quantile(vals, p)), rel=1e-12)


def test_grouped_quantiles_with_duplicates(spark):
    df = spark.createDataFrame([(g, float(v)) for g in ("a", "b") for v in [1, 1, 1, 2, 2, 9] * (3 if g == "a" else 1)],
                               "g string, v double")
    q = {(r.g, r.prob): r.value for r in quantiles.quantiles(df, ["v"], [0.25, 0.5, 0.75], by=["g"]).collect()}
    for g, mult in (("a", 3), ("b", 1)):
        arr = np.array([1, 1, 1, 2, 2, 9] * mult, dtype=float)
        for p in (0.25, 0.5, 0.75):
            assert q[(g, p)] == pytest.approx(float(np.quantile(arr, p)))


def test_exact_sample_size_and_determinism(spark):
    o = spark.read.parquet(f"{SF}/orders.parquet")
    a = reshape.sample_exact(o, "o_orderkey", 0.2)
    b = reshape.sample_exact(o.repartition(5), "o_orderkey", 0.2)
    assert a.count() == int(0.2 * o.count())
    assert {r.o_orderkey for r in a.collect()} == {r.o_orderkey for r in b.collect()}


def test_newton_matches_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 2))
    y = (x[:, 0] + 0.5 * rng.normal(size=300) > 0).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y)], "a double, b double, y int")
    m = classify.logistic_newton(df, ["a", "b"], "y", C=1.0)
    # numpy Newton on the same (penalised-intercept) objective
    X = np.c_[x, np.ones(300)]
    beta = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-X @ beta))
        g = X.T @ (p - y) + beta
        H = X.T @ (X * (p * (1 - p))[:, None]) + np.eye(3)
        beta -= np.linalg.solve(H, g)
    assert m.coef == pytest.approx(list(beta[:2]), abs=1e-8)
    assert m.intercept == pytest.approx(beta[2], abs=1e-8)


def test_ml_logistic_unpenalised_intercept_agrees_with_newton(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 2))
    y = (x[:, 1] - x[:, 0] + rng.normal(size=400) > 0).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y)], "a double, b double, y int")
    a = classify.logistic_newton(df, ["a", "b"], "y", C=1.0, penalize_intercept=False)
    b = classify.logistic_ml(df, ["a", "b"], "y", C=1.0)
    assert a.coef == pytest.approx(b.coef, abs=1e-4)


def test_pca_orthonormal(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    cols = [F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(8)]
    d = e.select(*cols)
    m = features.fit_pca(d, [f"e{i}" for i in range(8)], 3)
    c = np.array(m.components)
    assert np.allclose(c @ c.T, np.eye(3), atol=1e-10)
    assert m.explained_variance[0] >= m.explained_variance[1] >= m.explained_variance[2]


def test_kmeans_cost_non_increasing(spark):
    o = spark.read.parquet(f"{SF}/orders.parquet").select((F.col("o_totalprice") / 1e5).alias("x"),
                                                          (F.col("o_custkey") / 100.0).alias("y"))
    init = [[0.5, 0.2], [2.0, 0.8], [4.0, 1.4]]
    costs = [cluster.kmeans_lloyd(o, ["x", "y"], init, max_iter=i, tol=-1).cost for i in (1, 2, 4)]
    assert costs[0] >= costs[1] - 1e-9 >= costs[2] - 2e-9


def test_silhouette_matches_clustering_evaluator(spark):
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import VectorAssembler

    p = spark.read.parquet(f"{SF}/part.parquet")
    d = p.select((F.col("p_size") / 10.0).alias("f1"), (F.col("p_retailprice") / 1000.0).alias("f2"),
                 (F.col("p_size") % 3).alias("c"))
    ours = cluster.silhouette_sq(d, ["f1", "f2"], "c")
    v = VectorAssembler(inputCols=["f1", "f2"], outputCol="features").transform(d)
    ref = ClusteringEvaluator(predictionCol="c", distanceMeasure="squaredEuclidean").evaluate(v)
    assert ours == pytest.approx(ref, abs=1e-9)


def test_auc_matches_evaluator_and_bucketed_prefix(spark, monkeypatch):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    d = li.select((F.col("l_returnflag") == "R").cast("int").alias("y"), F.col("l_extendedprice").alias("s"))
    one = metrics.roc_auc(d, "y", "s").first().auc
    monkeypatch.setattr(metrics, "BUCKET_ROWS", 500)
    monkeypatch.setattr(metrics.running_totals, "__defaults__", (500,))
    many = metrics.roc_auc(d, "y", "s").first().auc
    ref = BinaryClassificationEvaluator(rawPredictionCol="s", labelCol="y", numBins=0).evaluate(
        d.withColumn("y", F.col("y").cast("double")))
    assert one == pytest.approx(ref, abs=1e-12) and many == pytest.approx(ref, abs=1e-12)


def test_stratified_folds_exact(spark):
    o = spark.read.parquet(f"{SF}/orders.parquet").withColumn("y", (F.col("o_orderstatus") == "F").cast("int"))
    f = classify.stratified_folds(o, "y", "o_orderkey", 3)
    counts = {(r.y, r.fold): r.n for r in f.groupBy("y", "fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    for y in (0, 1):
        sizes = [counts.get((y, k), 0) for k in range(3)]
        assert max(sizes) - min(sizes) <= 1
