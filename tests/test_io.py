"""Sources and sinks: fallback scan, literal tables, parameter persistence, prediction sink."""

import pytest

from strata.operators import classify, features
from strata.sources import load_params, read_first_existing, records_table, save_params, write_prediction

SF = "/root/testdata/sf0.001"


def test_read_first_existing(spark, tmp_path):
    df = read_first_existing(spark, [str(tmp_path / "missing"), f"{SF}/region.parquet"])
    assert df.count() == 5
    with pytest.raises(FileNotFoundError):
        read_first_existing(spark, [str(tmp_path / "a"), str(tmp_path / "b")])


def test_params_roundtrip_and_prediction_sink(spark, tmp_path):
    part = spark.read.parquet(f"{SF}/part.parquet")
    sc = features.fit_scaler(part, ["p_size", "p_retailprice"])
    save_params(spark, sc.params(), str(tmp_path / "scaler"))
    back = load_params(spark, str(tmp_path / "scaler"))
    assert back["means"] == pytest.approx(sc.means) and back["features"] == sc.features
    rec = records_table(spark, [{"p_size": 10, "p_retailprice": 1200.0}])
    m = classify.LogisticModel(["p_size", "p_retailprice"], [0.01, -0.001], 0.1)
    scored = m.transform(rec).withColumn("cluster", rec.p_size * 0)
    write_prediction(scored, str(tmp_path / "pred"), prob_col="probability", label_col="prediction")
    got = spark.read.option("header", True).csv(str(tmp_path / "pred")).collect()
    assert len(got) == 1 and set(got[0].asDict()) == {"Cluster", "Survival_Probability", "Prediction"}
