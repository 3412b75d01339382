"""Hand-made edge fixtures: one test per rule that the small tables would not exercise."""

import math

import pytest
from pyspark.sql import functions as F

from strata.functions.expr import clamp_decrement, clamp_increment, indicator, recode, threshold_label
from strata.operators import classify, distribution, features, metrics, missing, profile, reshape
from strata.sources.readers import normalize_missing, read_csv


def test_mode_tie_takes_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "x string")
    assert [r.x for r in missing.fill_mode(df).collect()] == ["b", "a", "b", "a", "a"]


def test_mean_fill(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (None,), (9.0,)], "a double")
    assert missing.fill_mean(df).collect()[3].a == pytest.approx(3.75)


def test_all_null_column(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert missing.fill_mean(df).collect()[0].x is None
    filled = missing.fill_by_rules(df, {"x": "median"}, fallbacks={"x": 60})
    assert [r.x for r in filled.collect()] == [60.0, 60.0]
    with pytest.raises(ValueError):
        missing.fit_mean_imputer(df, ["x"])


def test_null_flag_and_unmapped(spark):
    df = spark.createDataFrame([("Male", "Stage I"), (None, "Stage V")], "g string, s string")
    out = df.select(indicator("g", "Male").alias("m"),
                    recode("s", {"Stage I": 1, "Stage II": 2}).alias("code")).collect()
    assert [(r.m, r.code) for r in out] == [(1, 1), (0, None)]


def test_none_token_stays_text(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("alcohol,x\nNone,1\nModerate,\nHeavy,NA\n,3\n")
    df = read_csv(spark, str(p), "alcohol string, x double")
    rows = df.collect()
    assert [r.alcohol for r in rows] == ["None", "Moderate", "Heavy", None]
    assert [r.x for r in rows] == [1.0, None, None, 3.0]


def test_clamps(spark):
    df = spark.createDataFrame([(1,), (4,)], "s int")
    r = df.select(clamp_decrement("s", 1).alias("d"), clamp_increment("s", 4).alias("u")).collect()
    assert [(x.d, x.u) for x in r] == [(1, 2), (3, 4)]


def test_describe(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (None,)], "a double")
    r = profile.describe(df, ["a"]).first()
    assert (r["count"], r["mean"], r["std"], r["min"], r["max"]) == (3, 2.0, 1.0, 1.0, 3.0)
    assert (r.q25, r.q50, r.q75) == (1.5, 2.0, 2.5)


def test_corr_pairwise_and_constant(spark):
    df = spark.createDataFrame([(1.0, 1.0, 2.0), (2.0, 1.0, 4.0), (3.0, 1.0, 7.0), (None, 1.0, 8.0)],
                               "a double, b double, c double")
    m = {(r.col_x, r.col_y): r.corr for r in profile.corr_matrix(df, ["a", "b", "c"]).collect()}
    assert m[("a", "c")] == pytest.approx(0.993399, abs=1e-6)
    assert m[("a", "b")] is None and m[("b", "c")] is None


def test_crosstab_null_key(spark):
    df = spark.createDataFrame([("x", "m"), ("x", "f"), (None, "m")], "r string, c string")
    rows = profile.crosstab(df, "r", "c").collect()
    assert len(rows) == 1 and rows[0]["f"] == 1 and rows[0]["m"] == 1


def test_cut_edges(spark):
    df = spark.createDataFrame([(v,) for v in [0.0, 1.0, 2.0, 5.0, 9.99, 10.0]], "x double")
    out = reshape.bin_equal_width(df, "x", 10, "b").collect()
    assert [r.b for r in out] == [1, 1, 2, 5, 10, 10]
    assert out[0].b_lo == pytest.approx(-0.01)


def test_cut_constant(spark):
    df = spark.createDataFrame([(5.0,), (5.0,), (5.0,)], "x double")
    assert len({r.b for r in reshape.bin_equal_width(df, "x", 10, "b").collect()}) == 1


def test_grid_completion(spark):
    df = spark.createDataFrame([(0.0, 0, 1.0), (1.0, 1, 2.0), (10.0, 1, 3.0)], "x double, c int, y double")
    b = reshape.bin_equal_width(df, "x", 3, "xb")
    g = {(r.xb, r.c): r.y for r in distribution.group_mean_grid(b, "xb", 3, "c", "y").collect()}
    assert len(g) == 6
    assert g[(1, 0)] == 1.0 and g[(1, 1)] == 2.0 and g[(3, 1)] == 3.0
    assert g[(2, 0)] is None and g[(2, 1)] is None and g[(3, 0)] is None


def test_one_class_repair(spark):
    df = spark.createDataFrame([(i, 0, 3, 1, 5.0) for i in range(10)], "id long, t int, stage int, met int, chemo double")
    rules = {1: {"stage": ("decrement", 1), "met": ("set", 0), "chemo": ("add", 2)},
             0: {"stage": ("increment", 4), "met": ("set", 1)}}
    out = classify.synthesize_missing_class(df, "t", "id", 0.2, rules=rules)
    syn = out.where("is_synthetic").collect()
    assert len(syn) == 2 and out.count() == 12
    assert all((r.t, r.stage, r.met, r.chemo) == (1, 2, 0, 7.0) for r in syn)


def test_constant_feature_scaler(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (1.0,)], "b double")
    m = features.fit_scaler(df, ["b"])
    assert [r.b for r in m.transform(df).collect()] == [0.0, 0.0, 0.0]
    assert m.transform(spark.createDataFrame([(4.0,)], "b double")).first().b == 3.0


def test_auc_ties(spark):
    df = spark.createDataFrame([(0, 0.5), (1, 0.5), (0, 0.2), (1, 0.9)], "y int, s double")
    assert metrics.roc_auc(df, "y", "s").first().auc == pytest.approx(0.875)
    neg = df.withColumn("s", -F.col("s"))
    assert metrics.roc_auc(neg, "y", "s").first().auc == pytest.approx(0.125)


def test_no_positive_prediction(spark):
    df = spark.createDataFrame([(1, 0), (0, 0), (1, 0)], "y int, p int")
    r = metrics.binary_metrics(df, "y", "p").first()
    assert (r.precision, r.recall, r.f1) == (0.0, 0.0, 0.0)


def test_threshold_edge(spark):
    df = spark.createDataFrame([(0.5,)], "p double")
    r = df.select(threshold_label("p").alias("a"), threshold_label("p", inclusive=True).alias("b")).first()
    assert (r.a, r.b) == ("Deceased", "Survived")


def test_split_is_partition_independent(spark):
    o = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select("o_orderkey")
    a = reshape.split_train_test(o.coalesce(1), "o_orderkey", 0.2).where("is_test")
    b = reshape.split_train_test(o.repartition(7), "o_orderkey", 0.2).where("is_test")
    ka = {r.o_orderkey for r in a.collect()}
    assert ka == {r.o_orderkey for r in b.collect()}
    assert len(ka) == math.ceil(0.2 * o.count())


def test_normalize_missing_nan(spark):
    df = spark.createDataFrame([(float("nan"), "NA"), (1.0, "x")], "a double, s string")
    r = normalize_missing(df, ["NA"]).collect()
    assert r[0].a is None and r[0].s is None and r[1].s == "x"


def test_recode_join_and_unmapped_report(spark):
    from strata.operators.encode import recode_join, unmapped_report

    df = spark.createDataFrame([("Stage I",), ("Stage V",), (None,)], "s string")
    m = spark.createDataFrame([("Stage I", 1), ("Stage II", 2)], "k string, v int")
    out = recode_join(df, "s", m, "k", "v", "code", broadcast_limit=1)  # 2 rows > limit: shuffle join path
    assert sorted((r.s or "", r.code) for r in out.collect()) == [("", None), ("Stage I", 1), ("Stage V", None)]
    rep = unmapped_report(df, {"code": ("s", {"Stage I": 1})}).collect()
    assert [(r.column_name, r.n_unmapped) for r in rep] == [("code", 1)]
