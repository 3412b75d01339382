"""Streaming: the batch scorer and a watermarked profile over a parquet file stream."""

from pyspark.sql import functions as F

from strata.operators import classify, features
from strata.operators.cluster import KMeansModel
from strata.operators.score import Scorer
from strata.streaming.scoring import read_parquet_stream, score_stream, start, windowed_profile

SF = "/root/testdata/sf0.001"


def test_stream_scores_equal_batch_scores(spark):
    part = spark.read.parquet(f"{SF}/part.parquet")
    sc = Scorer(scaler=features.fit_scaler(part, ["p_size", "p_retailprice"]),
                kmeans=KMeansModel(["p_size", "p_retailprice"], [[-1.0, -1.0], [1.0, 1.0]]),
                logistic=classify.LogisticModel(["p_size", "p_retailprice"], [0.8, -0.5], 0.2))
    stream = read_parquet_stream(spark, f"{SF}/part.parquet", part.schema)
    q = start(score_stream(stream, sc, keep=["p_partkey"]), "scored_parts", sink="memory", trigger_once=True)
    q.awaitTermination()
    got = {r.p_partkey: (r.cluster, round(r.probability, 9)) for r in spark.table("scored_parts").collect()}
    want = {r.p_partkey: (r.cluster, round(r.probability, 9)) for r in sc.transform(part, keep=["p_partkey"]).collect()}
    assert got == want and len(got) == part.count()


def test_windowed_profile_counts_every_event(spark):
    ev = spark.read.parquet(f"{SF}/events.parquet")
    stream = read_parquet_stream(spark, f"{SF}/events.parquet", ev.schema)
    q = start(windowed_profile(stream, "ts", "event_type", "value", "1 hour", "1 hour"), "ev_profile",
              sink="memory", mode="complete", trigger_once=True)
    q.awaitTermination()
    total = spark.table("ev_profile").agg(F.sum("n")).first()[0]
    assert total == ev.count()
