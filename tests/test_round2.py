"""Inputs that used to lose rows or values silently."""

from pyspark.sql import functions as F

from strata.functions.expr import threshold_label
from strata.operators.cluster import nearest_centre
from strata.operators.metrics import confusion
from strata.operators.missing import column_modes, fill_by_rules, fill_mean
from strata.operators.distribution import box_stats, histogram
from strata.operators.features import fit_scaler
from strata.operators.profile import agreement_pct, corr_matrix, describe, info
from strata.operators.quantiles import kth_smallest_local
from strata.operators.reshape import bin_equal_width, split_train_test
from strata.streaming.scoring import read_parquet_stream


def test_integer_fills_keep_their_fraction(spark):
    df = spark.createDataFrame([(1, 1), (2, 2), (4, None), (None, None)], "a int, b int")
    assert [r.a for r in fill_mean(df, ["a"]).collect()][3] == 7 / 3
    assert [r.b for r in fill_by_rules(df, {"b": "median"}).collect()][2] == 1.5


def test_missing_features_get_no_label(spark):
    df = spark.createDataFrame([(0.7, 1.0), (None, None)], "p double, x double")
    got = df.select(threshold_label("p").alias("l"), nearest_centre(["x"], [[0.0], [1.0]]).alias("c")).collect()
    assert [tuple(r) for r in got] == [("Survived", 1), (None, None)]


def test_confusion_counts_every_class(spark):
    df = spark.createDataFrame([(0, 0), (2, 1), (1, 2)], "a int, p int")
    rows = confusion(df, "a", "p").collect()
    assert len(rows) == 9 and sum(r["count"] for r in rows) == 3


def test_missing_values_agree_with_nothing(spark):
    df = spark.createDataFrame([(1, 1), (None, None)], "a int, b int")
    assert agreement_pct(df, "a", "b").first()[0] == 50.0


def test_rows_without_a_key_stay_in_one_half(spark):
    df = spark.createDataFrame([(i,) for i in range(9)] + [(None,)], "k long")
    for method in ("xxhash64", "arith"):
        flagged = split_train_test(df, "k", method=method)
        flagged = flagged[-1] if isinstance(flagged, tuple) else flagged
        if "is_test" in flagged.columns:
            assert flagged.where(F.col("is_test")).count() + flagged.where(~F.col("is_test")).count() == 10


def test_stream_reads_a_folder_by_uri(spark, tmp_path):
    path = f"file://{tmp_path}/rows.parquet"
    spark.range(100).write.parquet(path)
    q = read_parquet_stream(spark, path, "id long").writeStream.format("memory").queryName("by_uri").trigger(availableNow=True).option(
        "checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination()
    assert spark.table("by_uri").count() == 100


def test_nan_is_missing_in_every_statistic(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1.0, 2.0, "a"), (2.0, 4.0, "a"), (3.0, 6.0, "a"), (nan, 1.0, "a")], "x double, y double, g string")
    r = describe(df, ["x"]).first()
    assert (r["count"], r["mean"], r["std"], r["min"], r["q25"], r["q50"], r["q75"], r["max"]) == (3, 2.0, 1.0, 1.0, 1.5, 2.0, 2.5, 3.0)
    assert {r.column_name: r.non_null for r in info(df).collect()} == {"x": 3, "y": 4, "g": 4}
    assert abs(corr_matrix(df, ["x", "y"]).where("col_x = 'x' AND col_y = 'y'").first()["corr"] - 1) < 1e-12
    assert fit_scaler(df, ["x"]).means == [2.0]
    assert sum(r["count"] for r in histogram(df, "x", 2).collect()) == 3
    box = box_stats(df, "x", ["g"]).first()
    assert (box["n"], box["max"], box["n_outliers"]) == (3, 3.0, 0)
    assert [r.x_bin for r in bin_equal_width(df, "x", 2).orderBy("y").select("y", "x_bin").collect()] == [None, 1, 1, 2]


def test_order_statistics_with_infinities_take_few_passes(spark):
    inf = float("inf")
    data = spark.createDataFrame([(0, float(i)) for i in range(100)] + [(0, inf), (0, -inf)], "_g int, _v double")
    targets = [{"_g": 0, "tid": k, "k": k, "n": 102, "lo": -inf, "hi": inf} for k in (0, 1, 50, 101)]
    got = kth_smallest_local(data, targets, ["_g"], buckets=8, finish_below=1, max_passes=6)
    assert got == {(0, 0): -inf, (0, 1): 0.0, (0, 50): 49.0, (0, 101): inf}


def test_mode_ties_take_the_smaller_number(spark):
    df = spark.createDataFrame([(9, "b"), (10, "a")], "n int, s string")
    assert column_modes(df, ["n", "s"]) == {"n": "9", "s": "a"}
